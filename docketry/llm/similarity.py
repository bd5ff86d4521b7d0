"""Near copies by the Jaccard similarity of five-word shingles, found by MinHash bands and verified on the whole sets.

Two texts with a similarity s agree in one of 30 bands of 5 minima with a probability of 1 - (1 - s^5)^30: a pair at 0.8 is missed
about seven times in a million, others less. Texts with equal sets are one node. Bands only propose pairs:

1. every node is verified against one other, the one with the most company that it shares a band with, which joins most of a group;
2. what still stands in different components is compared, band by band, by sketches of the 150 minima, a byte each. A pair at 0.8 is
   4.6 standard deviations above what is let through, so about two in a million are lost. What is let through is verified on the
   whole sets there and then, and only links are written: never a pair that was only proposed.

Clusters are what bands hang together, found over one link for each node of a band. Each node's set is sent once to its cluster; large
clusters are cut into blocks, and a group holds two blocks of one, so none is held by one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import common, simhash
from docketry.llm.components import components

BANDS, ROWS = 30, 5
#: Least share of equal sketch bytes; nodes of a block; shingles of a block, and of the small clusters of a group (about).
LEAST, BLOCK, SHINGLES = 0.65, 1024, 1_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
FACTORS, MASKS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in order, and len + 1 offsets into them; a shorter text is one shingle."""
    raw, begin, end, bounds = simhash.words_of(data, offsets)
    count = np.diff(bounds)
    per = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    if not per.any():
        return np.empty(0, np.uint64), np.zeros(len(per) + 1, np.int64)
    marks = np.empty(2 * len(begin), np.int64)
    marks[::2], marks[1::2] = begin, end
    both = pa.Array.from_buffers(pa.large_binary(), len(marks) - 1, [None, pa.py_buffer(marks), pa.py_buffer(raw)]).dictionary_encode()
    of_word = np.array([xxhash.xxh64_intdigest(w, simhash.SEED) for w in both.dictionary.to_pylist()], np.uint64)
    h = of_word[both.indices.to_numpy()[::2]]
    owner = np.repeat(np.arange(len(per)), per)
    left = bounds[:-1][owner] + np.arange(len(owner)) - (np.cumsum(per) - per)[owner]
    length = np.minimum(count, words)[owner]
    out = length.astype(np.uint64)
    for j in range(words):
        out = np.where(j < length, mixed((out ^ h[np.minimum(left + j, len(h) - 1)]) * STEP), out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.r_[True, (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])]
    return out[new], np.searchsorted(owner[new], np.arange(len(per) + 1))


def set_hashes(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; no shingles: 0."""
    return np.array([xxhash.xxh64_intdigest(sets[a:b].tobytes(), simhash.SEED) if b > a else 0 for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64).view(np.int64)


def bands(sets: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The keys of each set's bands and a byte of each of its minima; none where there are no shingles."""
    full = np.flatnonzero(np.diff(at))
    keys, sketch = np.empty((len(full), BANDS), np.uint64), np.empty((len(full), BANDS * ROWS), np.uint8)
    for band in range(BANDS if len(full) else 0):
        h = np.full(len(full), band, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat((sets ^ MASKS[k]) * FACTORS[k], at[full])
            sketch[:, k] = mixed(least) & np.uint64(255)
            h = mixed((h ^ least) * STEP)
        keys[:, band] = h
    some = np.diff(at) > 0
    ends = np.r_[0, np.cumsum(some)].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
    return lists, pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends * np.int32(BANDS * ROWS)), pa.py_buffer(sketch)])


def described(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For every row its id, op9's fingerprint, a hash of the text, the hash and size of its shingle set, its band keys and sketch."""
    common.bounded_batches(df)

    def step(block: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = common.buffers(block.column("text"))
        sets, at = shingle_sets(data, offsets)
        columns = [block.column("doc_id"), pa.array(simhash.fingerprints(data, offsets)), block.column("content"), pa.array(set_hashes(sets, at)), pa.array(np.diff(at)), *bands(sets, at)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "content", "node", "size", "keys", "sketch"])

    rows = common.two_columns(df, id_col, text_col).withColumn("content", F.xxhash64("text"))
    return common.map_blocks(rows, step, "doc_id long, fp long, content long, node long, size long, keys array<long>, sketch binary", 1 << 20)


def sets_of(df: DataFrame, contents: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles) of the texts with these hashes."""

    def step(block: pa.RecordBatch) -> pa.RecordBatch:
        sets, at = shingle_sets(*common.buffers(block.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sets.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(set_hashes(sets, at)), lists], ["node", "shingles"])

    texts = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("content", F.xxhash64("text"))
    texts = texts.join(contents.hint("merge"), "content", "left_semi").groupBy("content").agg(F.first("text").alias("text"))
    return common.written(common.map_blocks(texts, step, "node long, shingles array<long>", 1 << 20).dropDuplicates(["node"]), "shingles")


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def still_open(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, node, size, root, n) of the bands that still meet more than one component of the links; n: nodes of the band."""
    rows = common.written(members.select("key", "node", "size").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    wide = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x != y")
    return common.written(rows.join(wide.select("key", "n"), "key"), "open")


def first_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each node with the one that, of the leaders of its bands, has the most company; a band's leader is the node with the
    most of it, the number of nodes that its bands hold. At most one pair a node."""
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    rows = members.join(company, "node")
    leader = rows.groupBy("key").agg(F.max(F.struct("company", "node", "root", "size")).alias("l"))
    met = rows.join(leader, "key").where("root != l.root and 5 * least(size, l.size) >= 4 * greatest(size, l.size)")
    best = met.groupBy("node").agg(F.max("l").alias("l"))
    return best.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()


def placed(rows: DataFrame, key: str, count: str, item: str, groups: int) -> DataFrame:
    """rows with (bin, block, i, j): small keys share a bin, large ones (count blocks > 1) have a grid of pairs of blocks."""
    block = F.pmod(F.xxhash64(item), F.col(count)).cast("int")
    rows = rows.withColumn("block", block).withColumn("bin", F.when(F.col(count) == 1, F.pmod(F.xxhash64(key), F.lit(groups))).otherwise(F.col(key)))
    return rows.withColumn("_t", F.explode(F.expr(f"sequence(0, cast({count} as int) - 1)"))).withColumns({"i": F.least("block", "_t"), "j": F.greatest("block", "_t")}).drop("_t")


def linked(rows: pa.Table, sets: pa.Table) -> pa.Table:
    """Of the bands of a group, links between components: pairs whose sizes allow the similarity, whose sketches agree and whose sets
    have it; pairs that earlier links of the group join already are left out."""
    a, b = [], []
    if rows.num_rows:
        key, root, block = (rows[c].to_numpy() for c in ("key", "root", "block"))
        names, lists = sets["node"].to_numpy(), sets["shingles"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        by_name = np.argsort(names)
        at = by_name[np.searchsorted(names[by_name], rows["node"].to_numpy())]  # each row's set
        sketch, size = np.frombuffer(b"".join(sets["sketch"].to_pylist()), np.uint8).reshape(len(names), -1), np.diff(ends)
        roots, own_root = np.unique(root, return_inverse=True)
        top, failed = np.arange(len(roots)), set()
        across = rows["i"][0].as_py() != rows["j"][0].as_py()
        order = np.lexsort((names[at], key))
        cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = order[x:y]
            for k, r in enumerate(own[:-1].tolist()):
                rest = own[k + 1 :]
                ok = top[own_root[rest]] != top[own_root[r]]
                if across:
                    ok &= block[rest] != block[r]
                rest = rest[ok]
                rest = rest[5 * np.minimum(size[at[rest]], size[at[r]]) >= 4 * np.maximum(size[at[rest]], size[at[r]])]
                if not len(rest):
                    continue
                p = int(at[r])
                for o in rest[(sketch[at[rest]] == sketch[p]).sum(1) >= LEAST * sketch.shape[1]].tolist():
                    q = int(at[o])
                    if top[own_root[o]] == top[own_root[r]] or (p, q) in failed:
                        continue
                    if alike(flat[ends[p] : ends[p + 1]], flat[ends[q] : ends[q + 1]]):
                        a.append(names[p])
                        b.append(names[q])
                        top[top == top[own_root[o]]] = top[own_root[r]]
                    else:
                        failed.add((p, q))
    return pa.table([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])


def settled(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The pairs of a group whose sets have a similarity of 0.8 or more."""
    lists = sets["shingles"].combine_chunks() if pairs.num_rows else None
    place = {n: k for k, n in enumerate(sets["node"].to_pylist())} if pairs.num_rows else {}
    flat, ends = (lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]) if pairs.num_rows else (None, None)
    of = lambda n: flat[ends[place[n]] : ends[place[n] + 1]]
    good = [alike(of(x), of(y)) for x, y in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())]
    return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a similarity of 0.8 or more; a set goes once to each group that its cluster has."""
    pairs = common.written(pairs, "pairs")
    roots = components(pairs)
    rows = sets.join(roots, "node")
    sized = roots.join(sets.select("node", F.size("shingles").alias("size")), "node").groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / SHINGLES)).alias("blocks"), F.sum("size").alias("size"))
    sized = common.written(sized, "clusters")
    groups = int(-(-(sized.agg(F.sum("size")).first()[0] or 0) // SHINGLES)) or 1
    rows = placed(rows.join(sized.select("root", "blocks"), "root"), "root", "blocks", "node", groups).select("bin", "i", "j", "node", "shingles")
    ends = pairs.join(roots.withColumnRenamed("node", "a"), "a").join(sized.select("root", "blocks"), "root")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    ends = ends.select(F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.col("root")).alias("bin"), F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j"), "a", "b")
    place = ["bin", "i", "j"]
    return common.written(ends.groupBy(*place).cogroup(rows.groupBy(*place)).applyInArrow(settled, "a long, b long"), "similar")


def similar_roots(df: DataFrame, docs: DataFrame, known: DataFrame, text_col: str) -> DataFrame:
    """(node, root) over the known links (a, b) of nodes and all pairs of a similarity of 0.8 or more."""
    nodes = common.written(docs.where("size > 0").groupBy("node").agg(F.min("content").alias("content"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "sets")
    index = nodes.select("node", "size", F.explode("keys").alias("key"))
    groups = index.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x")).where("n > 1")
    groups = groups.groupBy("n", "x").agg(F.min("key").alias("key"))  # bands with the same nodes count once
    members = still_open(common.written(index.join(groups.select("key"), "key"), "bands"), known)
    sets = sets_of(df, nodes.join(members.select("node").distinct(), "node", "left_semi").select("content"), text_col)
    links = known.union(verified(first_pairs(members), sets))
    rows = still_open(members, links)
    first = rows.groupBy("key").agg(F.min("node").alias("a"))
    clusters = components(rows.join(first, "key").where("a != node").select("a", F.col("node").alias("b"))).withColumnRenamed("root", "cluster")
    held = clusters.join(nodes.select("node", "size", "sketch"), "node")
    sized = common.written(held.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / SHINGLES)).alias("blocks"), F.sum("size").alias("total")), "clusters")
    groups = int(-(-(sized.agg(F.sum("total")).first()[0] or 0) // SHINGLES)) or 1
    blocks = sized.select("cluster", "blocks")
    left = placed(rows.join(clusters, "node").join(blocks, "cluster"), "cluster", "blocks", "node", groups).select("bin", "i", "j", "key", "node", "root", "block")
    right = placed(held.join(blocks, "cluster"), "cluster", "blocks", "node", groups).select("bin", "i", "j", "node", "sketch").join(sets, "node")
    place = ["bin", "i", "j"]
    found = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(linked, "a long, b long")
    return components(links.union(common.written(found, "similar")))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable) for every row of df, over the links of op9 (three words, two bits)
    and those of a five-word similarity of 0.8 or more. Null texts and ids as in simhash.near_duplicates."""
    docs = common.written(described(df, id_col, text_col), "described")
    of_print = simhash.rooted(docs).select("fp", "root")
    rows = common.written(docs.join(of_print, "fp").groupBy("node", "root").agg(F.min("doc_id").alias("first")), "node-roots")
    least = rows.groupBy("root").agg(F.min("node").alias("a"))
    known = common.written(rows.join(least, "root").where("a != node").select("a", F.col("node").alias("b")), "known")
    roots = similar_roots(df, docs, known, text_col).withColumnRenamed("root", "top")
    tops = common.written(rows.groupBy("node").agg(F.min("first").alias("first")).join(roots, "node", "left").withColumn("top", F.coalesce("top", "node")), "tops")
    ids = tops.groupBy("top").agg(F.min("first").alias("component_id"))
    return docs.join(tops.join(ids, "top").select("node", "component_id"), "node").select("doc_id", "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all columns, less those that aren't the one with the smallest id of their component in near_copies;
    rows with a null id stay, and rows that share an id stay or go together."""
    found = near_copies(df, id_col, text_col)
    gone = common.written(found.where("doc_id > component_id").select(F.col("doc_id").alias("_gone")).distinct(), "copies")
    return df.join(gone.hint("merge"), df[id_col].cast("long") == gone["_gone"], "left_anti")
