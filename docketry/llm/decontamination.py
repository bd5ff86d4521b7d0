"""Benchmark decontamination with a broadcast set of the test items' normalised word windows.

Words of texts are looked up in the vocabulary of the test set; only where as many words of it as a window has stand together
is a window hash looked up, and each hit is verified word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Words of test items (about) that are sent to all tasks at once, some 25 bytes each; a larger test set is scanned for in parts.
PART_WORDS = 400_000
#: Words of a segment: a longer item is cut into overlapping ones, so that no row is larger.
SEGMENT = 20_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def item_words(text: str | None) -> list[bytes]:
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode("utf-8").lower())


class Windows:
    """The windows of some segments of test items, by length: sorted hashes of the distinct ones, where the words of each are, and
    the items that have it, as offsets into a list. All are arrays, which are small to hold and to send."""

    def __init__(self, segments: list[tuple], size: int):
        names = sorted({i for i, _ in segments if i is not None})
        place = {i: k for k, i in enumerate(names)}
        self.names = np.array([*names, ""], object)  # the last one: no id
        words = [w.split(b" ") for _, w in segments]
        coded = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode()
        self.vocabulary, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int32)
        counts = np.array([len(ws) for ws in words], np.int64)
        begin = np.cumsum(counts) - counts
        owner = np.array([place.get(i, len(names)) for i, _ in segments], np.int64)
        self.by_length = {}
        for length in sorted(set(np.minimum(counts, size).tolist())):
            own = np.flatnonzero(np.minimum(counts, size) == length)
            per = counts[own] - length + 1
            of = np.repeat(own, per)
            at = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
            matrix = self.ids[at[:, None] + np.arange(length)]
            hashes = self.hash(lambda j, matrix=matrix: matrix[:, j], length)
            order = np.lexsort((*matrix.T, hashes))
            hashes, matrix, at, of = hashes[order], matrix[order], at[order], owner[of[order]]
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (matrix[1:] != matrix[:-1]).any(axis=1)]
            both = np.unique(np.stack([np.cumsum(new) - 1, of], 1), axis=0)
            self.by_length[length] = (hashes[new], at[new].astype(np.int32), np.searchsorted(both[:, 0], np.arange(new.sum() + 1)).astype(np.int32), both[:, 1].astype(np.int32))

    @staticmethod
    def hash(column, length: int) -> np.ndarray:
        h = np.uint64(0)
        for j in range(length):
            h = (h ^ (column(j).astype(np.uint64) + np.uint64(1))) * STEP
            h ^= h >> np.uint64(29)
        return h

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[set]]:
        """Starts and ends (in bytes) of all words, words before each text, which words are hit, and each text's items."""
        low = LOWER[data]
        real = WORD[low]
        first = np.zeros(len(low) + 1, bool)
        first[offsets] = True
        begin = np.flatnonzero(real & (np.r_[True, ~real[:-1]] | first[:-1])) if len(low) else np.empty(0, np.int64)
        end = np.flatnonzero(real & (np.r_[~real[1:], True] | first[1:])) + 1 if len(low) else np.empty(0, np.int64)
        bounds = np.searchsorted(begin, offsets)
        items: list[set] = [set() for _ in range(len(offsets) - 1)]
        hit = np.zeros(len(begin) + 1, np.int32)
        if not len(begin) or not len(self.vocabulary):
            return begin, end, bounds, hit[:-1] > 0, np.diff(bounds), items
        # words as a binary array: each entry reaches to the next word, so the gaps are entries between
        marks = np.empty(2 * len(begin) + 1, np.int64)
        marks[:-1:2], marks[1::2], marks[-1] = begin, end, end[-1]
        both = pa.Array.from_buffers(pa.large_binary(), len(marks) - 1, [None, pa.py_buffer(marks), pa.py_buffer(low)])
        ids = pc.index_in(both, value_set=self.vocabulary).fill_null(-1).to_numpy()[::2].astype(np.int64)
        # how many words of the vocabulary follow in the same text, this one included
        stop = np.zeros(len(ids) + 1, bool)
        stop[:-1] = ids < 0
        stop[bounds] = True
        at = np.arange(len(ids))
        breaks = np.flatnonzero(stop)
        nxt = breaks[np.searchsorted(breaks, at + 1, side="left")]
        room = np.where(ids < 0, 0, nxt - at)
        for length, (hashes, places, bounds_of, items_of) in self.by_length.items():
            able = np.flatnonzero(room >= length)
            if not len(able):
                continue
            h = self.hash(lambda j, able=able: ids[able + j], length)
            left = np.searchsorted(hashes, h, side="left")
            ok = left < len(hashes)
            ok[ok] = hashes[left[ok]] == h[ok]
            able, left = able[ok], left[ok]
            while len(able):  # windows with equal hashes follow one another
                same = (ids[able[:, None] + np.arange(length)] == self.ids[places[left][:, None] + np.arange(length)]).all(axis=1)
                np.add.at(hit, able[same], 1)
                np.add.at(hit, able[same] + length, -1)
                text = np.searchsorted(bounds, able[same], side="right") - 1
                pair = np.unique(text * len(hashes) + left[same])
                d, w = pair // len(hashes), pair % len(hashes)
                n = bounds_of[w + 1] - bounds_of[w]
                item = items_of[np.repeat(bounds_of[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                pair = np.unique(np.repeat(d, n) * len(self.names) + item)
                pair = pair[pair % len(self.names) < len(self.names) - 1]
                for k, name in zip((pair // len(self.names)).tolist(), self.names[pair % len(self.names)].tolist()):
                    items[k].add(name)
                more = ~same & (left + 1 < len(hashes))
                more[more] = hashes[left[more] + 1] == hashes[left[more]]
                able, left = able[more], left[more] + 1
        return begin, end, bounds, np.cumsum(hit)[:-1] > 0, np.diff(bounds), items


def parts(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> Iterator[tuple[Windows, bool]]:
    """The windows of the test set in parts of bounded size, one part at a time, and whether it is the last.

    Executors cut the items into segments, which are written; the driver collects those of one part when it is asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = item_words(text)
                own = [words[k : k + SEGMENT] for k in range(0, max(len(words) - size + 1, min(len(words), 1)), SEGMENT - size + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(list(map(len, own)), pa.int64()), pa.array([b" ".join(w) for w in own], pa.binary())], ["item", "n", "words"])

    common.bounded_batches(benchmark)
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    rows = common.written(rows.mapInArrow(cut, "item string, n long, words binary").distinct(), "test-items")
    n = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // PART_WORDS))
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == k) if n > 1 else rows
        yield Windows([(r.item, bytes(r.words)) for r in own.select("item", "words").collect()], size), k == n - 1


def scan(df: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted) and spans (array of byte start and end of hit runs) for every row.

    Null texts have no words; items without words or with a null text have no windows; a null item id hits but isn't listed;
    repeated rows give repeated results; empty tables on either side are allowed; other columns are not read. The test set is
    sent to the tasks in parts of about PART_WORDS words; each further part is one more pass over a written table, and the driver
    never holds two parts.
    """
    fields = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
    kept = "text string, marks array<long>, named array<string>"

    def passed(rows: DataFrame, windows: Windows, first: bool, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in common.blocks(batches):
                column = block.column("text")
                begin, end, bounds, hit, n, named = windows.scan(*common.buffers(column))
                if not first:
                    for k, (marks, more) in enumerate(zip(block.column("marks").to_pylist(), block.column("named").to_pylist())):
                        hit[bounds[k] + np.array(marks, np.int64)] = True
                        named[k] |= set(more)
                docs = block.column("doc_id")
                if not last:
                    marks = [np.flatnonzero(hit[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([docs, column, pa.array(marks, pa.list_(pa.int64())), pa.array([list(x) for x in named], pa.list_(pa.string()))], ["doc_id", "text", "marks", "named"])
                    continue
                starts = common.buffers(column)[1]
                spans = [[] for _ in named]
                for k in np.flatnonzero(np.add.reduceat(np.r_[hit, False].astype(np.int64), np.minimum(bounds[:-1], len(hit)))).tolist() if hit.any() else []:
                    own = np.r_[False, hit[bounds[k] : bounds[k + 1]], False]
                    if own.any():
                        edge = np.flatnonzero(own[1:] != own[:-1])
                        a, b = begin[bounds[k] + edge[::2]] - starts[k], end[bounds[k] + edge[1::2] - 1] - starts[k]
                        spans[k] = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())]
                total = np.r_[0, np.cumsum(hit)]
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(n.astype(np.int64)), pa.array(total[bounds[1:]] - total[bounds[:-1]]), pa.array([sorted(x) for x in named], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "n_words", "n_hit", "items", "spans"],
                )

        return rows.mapInArrow(run, fields if last else f"doc_id long, {kept}")

    rows, first = common.two_columns(df, id_col, text_col), True
    for windows, last in parts(benchmark, size, item_col, item_text):
        rows, first = passed(rows, windows, first, last), False
        if not last:
            rows = common.written(rows, "decontamination")
    return rows


def remove_documents(df: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df, with all columns, that hold no window of the test set: one narrow pass for each part of it."""
    for windows, last in parts(benchmark, size, item_col, item_text):

        def keep(texts: pa.Array, windows: Windows = windows) -> np.ndarray:
            _, _, bounds, hit, _, _ = windows.scan(*common.buffers(texts))
            total = np.r_[0, np.cumsum(hit)]
            return total[bounds[1:]] == total[bounds[:-1]]

        df = common.keep_rows(df, text_col, keep)
        df = df if last else common.written(df, "decontaminated")
    return df


def remove_spans(df: DataFrame, benchmark: DataFrame, mark: str = " ", size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of df, with all columns, every run of hit words replaced by a mark; null texts stay null. One pass for each part."""
    place = df.columns.index(text_col)
    for windows, last in parts(benchmark, size, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], windows: Windows = windows) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = pa.RecordBatch.from_arrays([pc.fill_null(batch.column(place).cast(pa.string()), "")], ["text"])
                done: list[str | None] = []
                for block in common.blocks([texts]):
                    data, offsets = common.buffers(block.column("text"))
                    begin, end, bounds, hit, _, _ = windows.scan(data, offsets)
                    out = block.column("text").to_pylist()
                    total = np.r_[0, np.cumsum(hit)]
                    for k in np.flatnonzero(total[bounds[1:]] > total[bounds[:-1]]).tolist():
                        own = np.r_[False, hit[bounds[k] : bounds[k + 1]], False]
                        edge, raw, left, at = np.flatnonzero(own[1:] != own[:-1]), data[offsets[k] : offsets[k + 1]].tobytes(), [], 0
                        for a, b in zip((begin[bounds[k] + edge[::2]] - offsets[k]).tolist(), (end[bounds[k] + edge[1::2] - 1] - offsets[k]).tolist()):
                            left += [raw[at:a], mark.encode()]
                            at = b
                        out[k] = b"".join([*left, raw[at:]]).decode("utf-8")
                    done += out
                column = pc.if_else(batch.column(place).is_valid(), pa.array(done, pa.string()), pa.scalar(None, pa.string()))
                yield batch.set_column(place, batch.schema.field(place).with_type(pa.string()), column)

        df = df.mapInArrow(run, df.schema)
        df = df if last else common.written(df, "decontaminated")
    return df


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
