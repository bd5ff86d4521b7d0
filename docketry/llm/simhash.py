"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most 2 of 64 bits agree, with one bit left out, on one of two halves: of two segments one differs
in at most one bit. Each fingerprint is indexed under its 64 one-wildcard halves, equal variants meet in an equality
join, and what meets is verified on all bits. Variants that more fingerprints than a cap share are worked on exactly in another
way: two fingerprints differ in at most two bits if and only if some 64-bit word is within one bit of both, so the members are
linked to the least of each such word, and no pairs are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common
from docketry.llm.components import components

SEED = 42
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LANES = np.uint64(0x0101010101010101)
#: Variants of up to so many fingerprints are verified pair by pair; larger ones go the other way.
PAIRWISE = 24


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with A-Z lower-cased and one space between words: the bytes, starts and ends of the words, words before each text."""
    data = LOWER[data]
    blank = BLANK[data]
    data[blank] = 32
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.r_[True, blank[:-1]] | first  # no word goes on here
    keep = ~blank | ~before
    begin = np.flatnonzero(~blank & before)
    after = np.r_[blank[1:], True]
    last = np.flatnonzero(first)
    after[last[last > 0] - 1] = True
    end = np.flatnonzero(~blank & after) + 1
    moved = np.r_[0, np.cumsum(keep)]
    return data[keep].tobytes(), moved[begin], moved[end], np.searchsorted(begin, offsets)


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = 3) -> np.ndarray:
    """The 64-bit fingerprint of each text, as int64; no words: 0."""
    raw, begin, end, bounds = words_of(data, offsets)
    count = np.diff(bounds)
    out = np.zeros(len(count), np.uint64)
    per = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    if not per.any():
        return out.view(np.int64)
    owner = np.repeat(np.arange(len(per)), per)
    base = np.cumsum(per) - per
    left = bounds[:-1][owner] + np.arange(len(owner)) - base[owner]
    right = np.minimum(left + words, bounds[1:][owner]) - 1
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(raw[a:b], SEED) for a, b in zip(begin[left].tolist(), end[right].tolist())]), ">u8").astype(np.uint64)
    # bits are summed in byte lanes, over runs of at most 255 shingles of a text
    place = np.arange(len(h)) - base[owner]
    runs = np.flatnonzero(place % 255 == 0)
    texts = np.flatnonzero(per)
    of_text = np.flatnonzero(np.r_[True, owner[runs][1:] != owner[runs][:-1]])
    for shift in range(8):
        lanes = np.add.reduceat(h >> np.uint64(shift) & LANES, runs)
        sums = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), of_text, axis=0)
        for byte in range(8):
            out[texts] |= (2 * sums[:, byte] > per[texts]).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out.view(np.int64)


def fingerprint_table(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) for every row."""

    def step(block: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(fingerprints(*common.buffers(block.column("text")), words))], ["doc_id", "fp"])

    return common.map_blocks(common.two_columns(df, id_col, text_col), step, "doc_id long, fp long", 1 << 20)


def variants(prints: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard halves of each fingerprint; a key holds the wildcard's place and the half without it."""
    half = "(case when i < 32 then shiftrightunsigned(fp, 32) else fp & 4294967295L end)"
    key = f"shiftleft(cast(i as bigint), 32) | ({half} & ~shiftleft(1L, i % 32))"
    return prints.select("fp", F.explode(F.expr("sequence(0, 63)")).alias("i")).select(F.expr(key).alias("key"), "fp")


def links(prints: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints: every pair that differs in at most 2 bits is in one component of these links."""
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    # dealt by another hash than the one they were counted by, which would be taken for done and merged into few tasks
    index = variants(prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp")))
    groups = common.written(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "variants")
    pairs = groups.where("n = 2").where(near).select("a", "b")
    met = common.written(index.join(groups.where("n > 2").select("key", "n"), "key"), "met")
    some = met.where(F.col("n") <= PAIRWISE)
    few = some.select("key", F.col("fp").alias("a")).join(some.select("key", F.col("fp").alias("b")), "key").where("a < b").where(near).select("a", "b")
    # larger variants: each member meets, at every word within one bit, the least member there
    many = met.where(F.col("n") > PAIRWISE).select("fp").distinct()
    words = many.select("fp", F.explode(F.expr("sequence(0, 64)")).alias("i")).select("fp", F.expr("case when i = 64 then fp else fp ^ shiftleft(1L, i) end").alias("word"))
    words = words.join(words.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"), "word")
    return pairs.union(few).union(words.where("a != fp").select("a", F.col("fp").alias("b"))).distinct()


def rooted(docs: DataFrame) -> DataFrame:
    """(fp, first, root) for every distinct fingerprint of docs: the smallest doc_id that has it, and the root of its component."""
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return common.written(nodes, "nodes")


def near_duplicates(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for every row of df.

    Null texts count as empty; texts without words have fingerprint 0 and are linked like any other. Rows with a null id get the
    component of their text, and null if no id is in it; repeated rows give repeated results; an empty table gives an empty
    result; other columns are not read. Equal fingerprints are one node, so copies, however many, add no links.
    """
    docs = common.written(fingerprint_table(df, words, id_col, text_col), "fingerprints")
    nodes = rooted(docs)
    ids = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    return docs.join(nodes.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all columns, less those that aren't the one with the smallest id of their component; rows with a
    null id stay, and rows that share an id stay or go together."""
    found = near_duplicates(df, words, id_col, text_col)
    gone = common.written(found.where("doc_id > component_id").select(F.col("doc_id").alias("_gone")).distinct(), "copies")
    # always by merging, which splits hot keys and needs no bound on the ids that go
    return df.join(gone.hint("merge"), df[id_col].cast("long") == gone["_gone"], "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
