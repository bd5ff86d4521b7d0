"""Removal of byte strings that also start in an earlier document, over a sparse suffix array in range partitions.

Every 50-byte window has an anchor: the leftmost of its 16-byte grams with the least hash, which is the same wherever the window
occurs. So only suffixes that start at anchors are sorted, about one in 18, and only those whose gram occurs in two documents:

1. documents are dealt to groups of bounded size, packed and compressed;
2. hashes of the anchors' grams meet in buckets, and a bit for each goes back: does another document have it;
3. for the anchors that are left, equal contexts of a group are one record with the least document, written in sorted chunks;
4. splitters are sampled from all records. They are whole records, 50 bytes from the anchor on and then the bytes before it, read
   backwards, so records that begin alike are parted as well and no frequent string fills a range;
5. each range sorts its records by multikey quicksort, eight bytes at a time. Two windows whose anchors lie d bytes after their
   starts are equal if their suffixes have 50 - d bytes in common and what stands before the anchors d bytes: both are read off
   the common prefixes of neighbours, in suffix order and in the order of the parts before the anchors. Windows that an earlier
   document has go back to their groups as bits;
6. ranges are compared across their boundaries: equal windows can only stand on both sides of a boundary if they have the gram of
   its splitter, so the windows of such records that no earlier document of the range has meet by their 50 bytes;
7. groups mark the bytes and cut them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common

SPAN, GRAM = 50, 16
LEFT = SPAN - GRAM  # bytes before an anchor that its windows may have; they are one more than that many
WIDE = LEFT + SPAN
#: Text bytes of a group; beyond MANY groups they grow up to the most.
GROUP_BYTES, MANY, MOST_BYTES = 8 << 20, 4096, 256 << 20
FLUSH, CHUNK = 24 << 20, 1 << 17
#: Buckets of hashes: as many as groups, and so many at least.
LEAST_BUCKETS = 256
#: Records of a chunk and of a range; beyond MANY ranges they grow up to the most.
CHUNK_RECORDS, RANGE_RECORDS, MOST_RECORDS = 8192, 1 << 16, 1 << 21
#: Records that the splitters are taken from: so many of each chunk, of at most so many chunks.
SAMPLE, SAMPLE_ROWS = 8, 16_000
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
CODEC = "zstd"


def squeeze(raw: bytes | np.ndarray) -> bytes:
    return pa.Codec(CODEC, compression_level=1).compress(raw if isinstance(raw, bytes) else np.ascontiguousarray(raw).tobytes(), asbytes=True)


def swell(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.Codec(CODEC).decompress(raw, decompressed_size=size, asbytes=True), np.uint8) if size else np.empty(0, np.uint8)


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    h = ids.astype(np.uint64) * A
    h ^= h >> np.uint64(31)
    return ((h * C >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def packed(df: DataFrame, groups: int) -> DataFrame:
    """Rows (g, ids, sizes, text): documents of one group and stretch of input, their texts compressed together."""

    def out(blocks: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(blocks)
        ids = table["doc_id"].to_numpy()
        texts = pa.chunked_array([c.cast(pa.large_binary()) for c in table["text"].chunks]).combine_chunks()
        g = group_of(ids, groups)
        order = np.argsort(g, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(g[order])) + 1, len(order)]
        data, offsets = common.buffers(texts.take(pa.array(order)))
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows.append((int(g[order[a]]), ids[order[a:b]].tobytes(), np.diff(offsets[a : b + 1]).tobytes(), squeeze(data[offsets[a] : offsets[b]])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["g", "ids", "sizes", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for block in common.blocks(batches):
            held.append(block)
            total += block.column("text").nbytes
            if total >= FLUSH:
                yield out(held)
                held, total = [], 0
        if sum(b.num_rows for b in held):
            yield out(held)

    return df.mapInArrow(run, "g long, ids binary, sizes binary, text binary")


class Group:
    """The documents of a group in an order that doesn't hang on how they came, and their anchors."""

    def __init__(self, table: pa.Table):
        ids, parts, sizes = [], [], []
        for i, s, t in zip(*(table[c].to_pylist() for c in ("ids", "sizes", "text"))):
            ids.append(np.frombuffer(i, np.int64))
            sizes.append(np.frombuffer(s, np.int64))
            parts.append(swell(t, int(sizes[-1].sum())))
        ids, sizes, data = np.concatenate(ids), np.concatenate(sizes), np.concatenate(parts)
        offsets = np.r_[0, np.cumsum(sizes)]
        order = np.argsort(ids, kind="stable")
        if (np.diff(ids[order]) == 0).any():
            raw = data.tobytes()
            order = np.array(sorted(order.tolist(), key=lambda k: (ids[k], raw[offsets[k] : offsets[k + 1]])))
        texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).take(pa.array(order))
        self.ids = ids[order]
        self.data, self.offsets = common.buffers(texts)

    def anchors(self) -> None:
        """at: place of each anchor; low, high: first and last of its windows' starts; hash and doc (its index) of each."""
        parts = []
        for start in range(0, max(len(self.data) - SPAN + 1, 0), CHUNK):
            part = self.data[start : start + CHUNK + SPAN - 1]
            word = np.ndarray(len(part) - 7, "<u8", part.tobytes(), strides=(1,))
            h = word[:-8] * A + word[8:] * B
            h ^= h >> np.uint64(32)
            h *= C
            h ^= h >> np.uint64(29)
            key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
            least, wide = key, 1
            while 2 * wide <= LEFT + 1:
                least = np.minimum(least[:-wide], least[wide:])
                wide *= 2
            more = LEFT + 1 - wide
            least = np.minimum(least[: len(least) - more], least[more:]) if more else least
            at = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
            s = np.arange(len(at))
            last = self.offsets[np.searchsorted(self.offsets, s + start, side="right")] - SPAN - start
            at[s > last] = -1
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            end = np.r_[first[1:], len(at)] - 1
            real = at[first] >= 0
            parts.append((at[first][real] + start, first[real] + start, end[real] + start, h[at[first][real]]))
        if not parts:
            parts = [(np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)]
        at, low, high, h = (np.concatenate(c) for c in zip(*parts))
        again = np.flatnonzero((at[1:] == at[:-1])) + 1  # an anchor on either side of a chunk's end
        if len(again):
            high[again - 1] = high[again]
            at, low, high, h = (np.delete(x, again) for x in (at, low, high, h))
        self.at, self.low, self.high, self.hash = at, low, high, h
        self.doc = np.searchsorted(self.offsets, at, side="right") - 1

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes of the group, sorted and short of their low bits, and whether two documents here have it."""
        key = self.hash >> np.uint64(16)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], self.ids[self.doc[order]]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        if not len(key):
            return key, np.empty(0, bool)
        return key[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)

    def records(self, keys: np.ndarray, many: np.ndarray) -> None:
        """Of the anchors whose gram is in many documents: distinct contexts (with the least document), and the record of each."""
        key = self.hash >> np.uint64(16)
        self.kept = np.flatnonzero(many[np.searchsorted(keys, key)]) if len(key) else np.empty(0, np.int64)
        k, n = self.kept, len(self.kept)
        if not n:
            self.context, self.span, self.least, self.record = np.empty((0, WIDE), np.uint8), np.empty((0, 2), np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
            return
        around = np.lib.stride_tricks.sliding_window_view(np.r_[np.zeros(LEFT, np.uint8), self.data, np.zeros(SPAN, np.uint8)], WIDE)
        context = around[self.at[k]]
        span = np.stack([self.at[k] - self.low[k], self.at[k] - self.high[k]], 1).astype(np.uint8)  # of the first and last window
        place = np.arange(WIDE, dtype=np.int16)
        for a in range(0, n, 1 << 16):
            b = slice(a, a + (1 << 16))
            context[b][(place < LEFT - span[b, :1].astype(np.int16)) | (place >= LEFT + SPAN - span[b, 1:].astype(np.int16))] = 0
        order, run = sorted_runs(words_of(context, span))
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        self.least = np.minimum.reduceat(self.ids[self.doc[k[order]]], first)
        self.record = np.empty(n, np.int64)
        self.record[order] = np.cumsum(np.r_[False, run[1:] != run[:-1]])
        self.context, self.span = context[order[first]], span[order[first]]


def words_of(context: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Sorting words of records: the suffix from the anchor on, then what stands before it, backwards, then the windows' places."""
    n = len(context)
    wide = np.zeros((n, 104), np.uint8)
    wide[:, :SPAN], wide[:, 56 : 56 + LEFT], wide[:, 96:98] = context[:, LEFT:], context[:, :LEFT][:, ::-1], span
    return wide.view(">u8")


def keys_of(context: np.ndarray) -> np.ndarray:
    """Records as strings in the order of words_of."""
    return np.ascontiguousarray(np.concatenate([context[:, LEFT:], context[:, :LEFT][:, ::-1]], 1)).view(f"S{WIDE}").ravel()


def sorted_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort, breadth first: rows are parted by their first word, then those that are equal by the next, and so on.

    The order, and for each place of it the number of its run of equal rows."""
    n = len(words)
    first = words[:, 0].astype(np.uint64)
    order = np.argsort(first, kind="stable")
    run = np.cumsum(np.r_[False, first[order][1:] != first[order][:-1]]) if n else np.empty(0, np.int64)
    for depth in range(1, words.shape[1]):
        same = np.r_[False, run[1:] == run[:-1]] | np.r_[run[1:] == run[:-1], False] if n else np.empty(0, bool)
        tied = np.flatnonzero(same)
        if not len(tied):
            break
        word = words[order[tied], depth].astype(np.uint64)
        by = np.lexsort((word, run[tied]))
        order[tied] = order[tied[by]]
        word = word[by]
        new = np.zeros(n, bool)
        new[tied[1:]] = (word[1:] != word[:-1]) & (run[tied][1:] == run[tied][:-1])
        run = np.cumsum(np.r_[False, (run[1:] != run[:-1])] | new)
    return order, run


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row of a sorted matrix has in common with the one before it (the first: none)."""
    if not len(rows):
        return np.empty(0, np.int64)
    other = rows[1:] != rows[:-1]
    return np.r_[0, np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])]


def range_windows(context: np.ndarray, span: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each record of a range a bit for each of its windows, from its first: does it start in an earlier document."""
    n = len(context)
    bits = np.zeros(n, np.uint64)
    if not n:
        return bits
    count = (span[:, 0].astype(np.int64) - span[:, 1]) + 1
    whole = (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)
    order, run = sorted_runs(words_of(context, span))
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    least = np.minimum.reduceat(doc[order], first)
    later = doc[order] > np.repeat(least, np.diff(np.r_[first, n]))
    bits[order[later]] = whole[order[later]]  # the whole context stands in an earlier document
    rest = order[~later]  # in suffix order, one for each distinct context (or more of one document)
    begin = np.flatnonzero(common_prefixes(context[rest, LEFT:]) < GRAM)
    several = np.minimum.reduceat(doc[rest], begin) != np.maximum.reduceat(doc[rest], begin)
    rest = rest[np.repeat(several, np.diff(np.r_[begin, len(rest)]))]
    if not len(rest):
        return bits
    after = common_prefixes(context[rest, LEFT:])
    back = np.zeros((len(rest), 40), np.uint8)
    back[:, :LEFT] = context[rest, :LEFT][:, ::-1]
    by_back, _ = sorted_runs(back.view(">u8"))
    before = common_prefixes(back[by_back, :LEFT])
    place = np.empty(len(rest), np.int64)
    place[by_back] = np.arange(len(rest))
    high, low, owner = span[rest, 0], span[rest, 1], doc[rest]
    for d in range(LEFT + 1):
        own = np.flatnonzero((high >= d) & (low <= d))
        if not len(own):
            continue
        # the runs of suffixes with 50 - d bytes in common, and of parts before the anchor with d bytes in common
        runs = np.cumsum(after < SPAN - d)[own] * np.int64(len(rest) + 1) + np.cumsum(before < d)[place[own]]
        by = np.argsort(runs, kind="stable")
        head = np.flatnonzero(np.r_[True, runs[by][1:] != runs[by][:-1]])
        of = owner[own[by]]
        hit = own[by[of > np.repeat(np.minimum.reduceat(of, head), np.diff(np.r_[head, len(by)]))]]
        bits[rest[hit]] |= np.uint64(1) << (high[hit].astype(np.uint64) - np.uint64(d))
    return bits


def hash_rows(table: pa.Table, buckets: int) -> pa.Table:
    """Step 2, from a group: (bucket, g, n, keys, flags) for each bucket of hashes; every hash is in one row."""
    group = Group(table)
    group.anchors()
    keys, several = group.grams()
    cuts = np.searchsorted((keys >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
    rows = []
    for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if x < y:
            delta = np.diff(keys[x:y], prepend=np.uint64(0))
            rows.append((b, int(table["g"][0].as_py()), y - x, squeeze(delta.view(np.uint8).reshape(-1, 8).T), np.packbits(several[x:y]).tobytes()))
    return as_table(rows, HASH_ROWS)


def hash_answers(table: pa.Table) -> pa.Table:
    """Step 2, in a bucket: (g, at, step, n, blob): a bit for each hash of a group; at: the bucket."""
    got = list(zip(*(table[c].to_pylist() for c in ("g", "n", "keys", "flags"))))
    keys = [np.cumsum(np.ascontiguousarray(swell(k, 8 * n).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64) for _, n, k, _ in got]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    many = np.empty(len(every), bool)
    many[order] = np.r_[False, same] | np.r_[same, False]
    many |= np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) for _, n, _, f in got])
    # a hash that two documents of one group have is held by many in every group
    first = np.flatnonzero(np.r_[True, ~same])
    many[order] = np.repeat(np.logical_or.reduceat(many[order], first), np.diff(np.r_[first, len(order)]))
    rows, at, bucket = [], 0, int(table["bucket"][0].as_py())
    for g, n, _, _ in got:
        rows.append((g, bucket, 0, n, squeeze(np.packbits(many[at : at + n]))))
        at += n
    return as_table(rows, ANSWERS)


def answered(group: Group, replies: dict[int, bytes], buckets: int) -> None:
    """The anchors of a group that step 2 left, as records."""
    group.anchors()
    keys, _ = group.grams()
    cuts = np.searchsorted((keys >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
    many = np.zeros(len(keys), bool)
    for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if x < y:
            many[x:y] = np.unpackbits(swell(replies[b], -(-(y - x) // 8)), count=y - x).astype(bool)
    group.records(keys, many)


def record_rows(docs: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """Step 3, from a group: (g, at, n, context, span, least, lead) for each chunk of its sorted records; at: the place of the
    chunk's first one; lead: some of the records as keys."""
    if not docs.num_rows:
        return as_table([], RECORDS)
    group = Group(docs)
    answered(group, dict(zip(replies["at"].to_pylist(), replies["blob"].to_pylist())), buckets)
    g, rows = int(docs["g"][0].as_py()), []
    for x in range(0, len(group.context), CHUNK_RECORDS):
        own = slice(x, min(x + CHUNK_RECORDS, len(group.context)))
        n = own.stop - x
        some = x + (2 * np.arange(min(SAMPLE, n)) + 1) * n // (2 * min(SAMPLE, n))
        rows.append((g, x, n, squeeze(group.context[own]), squeeze(group.span[own]), group.least[own].tobytes(), keys_of(group.context[some]).tobytes()))
    return as_table(rows, RECORDS)


def routed(row: tuple, splitters: np.ndarray) -> list[tuple]:
    """Step 4, a chunk: (bucket, g, at, n, context, span, least) for each range that it has records of."""
    g, start, n, context, span, least = row
    context, span = swell(context, WIDE * n).reshape(n, WIDE), swell(span, 2 * n).reshape(n, 2)
    keys = keys_of(context)
    low, high = np.searchsorted(splitters, keys[[0, -1]], side="right").tolist()
    cuts = [0, *np.searchsorted(keys, splitters[low:high], side="left").tolist(), n]
    return [(low + k, g, start + x, y - x, squeeze(context[x:y]), squeeze(span[x:y]), least[8 * x : 8 * y]) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if x < y]


def range_answers(table: pa.Table, splitters: np.ndarray) -> pa.Table:
    """Step 5, in a range: (g, at, step, n, blob, window, doc). Step 1: the bits of n records of a group from place `at`; step 2: a
    window (the n-th of record `at`) next to a boundary that no earlier document of the range has."""
    got = list(zip(*(table[c].to_pylist() for c in ("g", "at", "n", "context", "span", "least"))))
    got.sort(key=lambda r: r[:2])
    sizes = np.array([r[2] for r in got])
    context = np.concatenate([swell(r[3], WIDE * r[2]).reshape(r[2], WIDE) for r in got])
    span = np.concatenate([swell(r[4], 2 * r[2]).reshape(r[2], 2) for r in got])
    doc = np.concatenate([np.frombuffer(r[5], np.int64) for r in got])
    bits, ends = range_windows(context, span, doc), np.cumsum(sizes)
    rows = [(g, at, 1, n, squeeze(bits[e - n : e])) for (g, at, n, *_), e in zip(got, ends.tolist())]
    bucket = int(table["bucket"][0].as_py())
    grams = np.ascontiguousarray(context[:, LEFT : LEFT + GRAM]).view(f"S{GRAM}").ravel()
    edge = splitters[max(bucket - 1, 0) : bucket + 1].astype(f"S{GRAM}")
    near = np.flatnonzero(np.isin(grams, edge))
    count = span[near, 0].astype(np.int64) - span[near, 1] + 1
    own, shift = np.repeat(near, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    left = (bits[own] >> shift.astype(np.uint64) & np.uint64(1)) == 0
    own, shift = own[left], shift[left]
    start = LEFT - span[own, 0].astype(np.int64) + shift
    windows = context[own[:, None], start[:, None] + np.arange(SPAN)] if len(own) else np.empty((0, SPAN), np.uint8)
    part = np.searchsorted(ends, own, side="right")
    g, at = np.array([r[0] for r in got], np.int64)[part], np.array([r[1] for r in got], np.int64)[part] + own - (ends - sizes)[part]
    text = pa.Array.from_buffers(pa.binary(SPAN), len(own), [None, pa.py_buffer(np.ascontiguousarray(windows))]).cast(pa.binary())
    bounds = pa.table([pa.array(g), pa.array(at), pa.array(np.full(len(own), 2)), pa.array(shift), pa.nulls(len(own), pa.binary()), text, pa.array(doc[own])], names=RANGE_NAMES)
    told = as_table(rows, ANSWERS)
    return pa.concat_tables([pa.table([*told.columns, pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())], names=RANGE_NAMES), bounds])


def cut_rows(docs: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """Step 7, from a group: (doc_id, n_bytes, spans, kept) for each document."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names, types = ["doc_id", "n_bytes", "spans", "kept"], [pa.int64(), pa.int64(), kind, pa.large_binary()]
    if not docs.num_rows:
        return pa.table([pa.array([], t) for t in types[:3]] + [pa.array([], pa.binary())], names=names)
    group, heard, told = Group(docs), {}, []
    step = replies["step"].to_numpy()
    for at, s, n, blob in zip(*(replies.filter(pa.array(step < 2))[c].to_pylist() for c in ("at", "step", "n", "blob"))):
        if s:
            told.append((at, n, blob))
        else:
            heard[at] = blob
    answered(group, heard, buckets)
    bits = np.zeros(len(group.context), np.uint64)
    for at, n, blob in told:
        bits[at : at + n] = swell(blob, 8 * n).view(np.uint64)
    across = replies.filter(pa.array(step == 2))
    np.bitwise_or.at(bits, across["at"].to_numpy(), np.uint64(1) << across["n"].to_numpy().astype(np.uint64))
    # an occurrence in the record's own document has the record's bits; one in a later document all
    k = group.kept
    count = group.high[k] - group.low[k] + 1
    later = group.ids[group.doc[k]] > group.least[group.record] if len(k) else np.empty(0, bool)
    depth = np.zeros(len(group.data) + 1, np.int32)
    for x in range(0, len(k), CHUNK):  # in portions, since each anchor has many windows
        part = slice(x, x + CHUNK)
        own = np.repeat(np.arange(len(count[part]), dtype=np.int32), count[part])
        shift = np.arange(len(own), dtype=np.int32) - np.repeat((np.cumsum(count[part]) - count[part]).astype(np.int32), count[part])
        hit = later[part][own] | ((bits[group.record[part]][own] >> shift.astype(np.uint64)) & np.uint64(1)).astype(bool)
        start = group.low[k[part]][own[hit]] + shift[hit]
        depth[start] += 1  # a start is in one window of one anchor only
        depth[start + SPAN] -= 1
    gone = np.cumsum(depth)[:-1] > 0
    keep = group.data[~gone]
    left = np.r_[0, np.cumsum(~gone)][group.offsets]
    edge = np.zeros(len(group.data) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[group.offsets] = True
    if len(gone):
        edge[1:-1] |= gone[1:] != gone[:-1]
    edges = np.flatnonzero(edge)
    removed = edges[:-1][gone[edges[:-1]]] if len(gone) else np.empty(0, np.int64)
    ends = edges[1:][gone[edges[:-1]]] if len(gone) else np.empty(0, np.int64)
    doc = np.searchsorted(group.offsets, removed, side="right") - 1
    flat = pa.StructArray.from_arrays([pa.array(removed - group.offsets[doc]), pa.array(ends - group.offsets[doc])], ["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(group.ids) + 1)).astype(np.int32)), flat)
    kept = pa.Array.from_buffers(pa.large_binary(), len(group.ids), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(keep))])
    return pa.table([pa.array(group.ids), pa.array(np.diff(group.offsets)), spans, kept.cast(pa.binary())], names=names)


HASH_ROWS = "bucket long, g long, n long, keys binary, flags binary"
ANSWERS = "g long, at long, step long, n long, blob binary"
RECORDS = "g long, at long, n long, context binary, span binary, least binary, lead binary"
ROUTED = "bucket long, g long, at long, n long, context binary, span binary, least binary"
RANGE_ANSWERS = f"{ANSWERS}, window binary, doc long"
RANGE_NAMES = [f.split()[0] for f in RANGE_ANSWERS.split(", ")]


def freeing(step, tables: tuple, fixed: tuple) -> pa.Table:
    """A step that gives freed memory back when it is done: workers go on to other groups and stages."""
    try:
        return step(*tables, *fixed)
    finally:
        common.trim()


def one(step, *fixed):
    """A step over one group, with what is the same for all groups."""
    return lambda t: freeing(step, (t,), fixed)


def two(step, *fixed):
    """A step over two groups of one key."""
    return lambda a, b: freeing(step, (a, b), fixed)


def as_table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(list(c), pa.int64() if t == "long" else pa.binary()) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def sampled(records: DataFrame) -> tuple[np.ndarray, int]:
    """The splitters, keys of sampled records in order, and the number of ranges that they make."""
    about = records.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    total = about.n or 0
    ranges = max(1, -(-total // min(MOST_RECORDS, max(RANGE_RECORDS, total // MANY))))
    some = records.where(F.pmod(F.xxhash64("g", "at"), F.lit(max(1, -(-about.rows // SAMPLE_ROWS)))) == 0).select("lead").collect()
    keys = np.sort(np.frombuffer(b"".join(bytes(r.lead) for r in some), f"S{WIDE}"))
    splitters = np.unique(keys[np.arange(1, ranges) * len(keys) // ranges]) if len(keys) else keys
    return splitters, len(splitters) + 1


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of byte start and end of maximal removed runs) and kept (the remaining bytes) for every row.

    A byte goes if a 50-byte string over it, within its document, also starts in a document with a smaller id, as the documents
    came in. Null texts count as empty, texts under 50 bytes stay whole; rows with null ids stay whole and remove nothing; rows
    that share an id don't remove each other's bytes; an empty table gives an empty result; other columns are not read.
    """
    rows = common.two_columns(df, id_col, text_col)
    known = rows.where("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // min(MOST_BYTES, max(GROUP_BYTES, total // MANY))))
    buckets = max(groups, LEAST_BUCKETS)
    docs = packed(known, groups).repartition(groups, "g")
    heard = docs.groupBy("g").applyInArrow(one(hash_rows, buckets), HASH_ROWS).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(one(hash_answers), ANSWERS)
    heard = common.written(heard, "repeated-grams")
    records = docs.groupBy("g").cogroup(heard.repartition(groups, "g").groupBy("g")).applyInArrow(two(record_rows, buckets), RECORDS)
    records = common.written(records, "records")
    splitters, ranges = sampled(records)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "at", "n", "context", "span", "least"))):
                yield from as_table(routed(row, splitters), ROUTED).to_batches()

    parted = records.drop("lead").mapInArrow(route, ROUTED).repartition(ranges, "bucket")
    told = common.written(parted.groupBy("bucket").applyInArrow(one(range_answers, splitters), RANGE_ANSWERS), "ranges")
    # windows on both sides of a boundary meet by their bytes; a range sends each window's least document only
    border = told.where("step = 2").select("g", "at", "step", "n", "blob", "window", "doc")
    least = border.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("window", "least")
    across = border.join(least, "window").where("doc > least").select("g", "at", "step", "n", "blob")
    replies = heard.union(told.where("step = 1").select("g", "at", "step", "n", "blob")).union(across)
    out = docs.groupBy("g").cogroup(replies.repartition(groups, "g").groupBy("g")).applyInArrow(two(cut_rows, buckets), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    whole = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"), F.col("text").cast("binary").alias("kept"))
    return out.union(whole)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
