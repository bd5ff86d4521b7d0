"""Packing documents into token windows by the sum-of-squares rule.

Each task packs the documents of its input split, online: a piece goes to the fill level that leaves the sum of the squared
counts of partially filled windows least; the counts are a level array. Full windows leave at once. What the rule has put
together stays together: at the end of a split only the emptiest open windows, as few as have the tokens that the others lack,
are taken apart. Their pieces, and windows of powers of two for what the others don't lack, fill the gaps: whole into the least room
that takes them, else cut. So no sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from docketry.llm import common

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Distinct words whose ids a worker remembers.
REMEMBERED = 120_000
#: Class of each byte: letter 0 (UTF-8 bytes of U+00C0..U+00FF too), digit 1, sign 2, white space 3.
KIND = np.full(256, 2, np.uint8)
KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 0
KIND[48:58] = 1
KIND[[32, *range(9, 14)]] = 3
#: Bytes that are left to the tokenizer with what stands around them: apostrophes, "<", what isn't ASCII or led by C3.
ODD = np.zeros(256, bool)
ODD[[39, 60, *range(0xC0, 0xC3), *range(0xC4, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Sequences that one task can number.
TASK_RANGE = 1 << 40


class WordIds:
    """Ids of texts by a tokenizer that lower-cases, drops white space and parts letters, digits and signs.

    Plain words (ASCII and U+00C0..U+00FF) are lower-cased and parted here, as the tokenizer does it, and each distinct one is
    encoded once: many at a time, joined by spaces; a token with the end-of-word mark ends each. Everything between two spaces
    that holds another character, an apostrophe or a special string goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        size = self.tokenizer.get_vocab_size()
        self.is_end = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[bytes, int] = {}  # word -> its number
        self.flat, self.begin = np.empty(0, np.uint32), np.zeros(1, np.int64)  # ids of the words by number
        self.rare: dict[bytes, np.ndarray] = {}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each of some distinct plain words; new ones are encoded."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.flat, self.begin = np.empty(0, np.uint32), np.zeros(1, np.int64)
        got = np.array([self.known.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(got < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            lines = [b" ".join(fresh[k : k + 200]).decode("utf-8") for k in range(0, len(fresh), 200)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.encode(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(fresh):
                raise ValueError("the tokenizer parts a plain word")
            got[new] = np.arange(len(fresh)) + len(self.known)
            self.begin = np.r_[self.begin, ends + len(self.flat)]
            self.flat = np.r_[self.flat, ids]
            self.known.update(zip(fresh, got[new].tolist()))
        return got

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each."""
        data, offsets = common.buffers(column)
        n = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(n, np.int64)
        data = LOWER[data]
        high = np.flatnonzero(data[:-1] == 0xC3) + 1
        high = high[(data[high] < 0x9F) & (data[high] != 0x97)]
        data[high] += 0x20
        kind, odd = KIND[data], ODD[data]
        odd[:-1] |= (data[:-1] == 0xC3) & (data[1:] == 0xB7) | (data[:-1] == 0xC3) & (data[1:] == 0x97)
        new = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == 1)]
        new[offsets[:-1][offsets[:-1] < len(data)]] = True
        if odd.any():
            # what stands between two spaces (or ends of a text) goes together
            edge = np.zeros(len(data) + 1, bool)
            edge[:-1] |= data == 32
            edge[1:] |= data == 32
            edge[offsets] = True
            edges = np.flatnonzero(edge)
            rare = np.flatnonzero(np.logical_or.reduceat(odd, edges[:-1]))
            left, right = edges[rare], edges[rare + 1]
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, left, 1)
            np.add.at(depth, right, -1)
            inside = np.cumsum(depth)[:-1] > 0
            new[inside] = False
            new[left] = True
            new[right[right < len(data)]] = True
        else:
            inside = np.zeros(len(data), bool)
        marks = np.flatnonzero(new)
        words = pa.Array.from_buffers(pa.large_binary(), len(marks), [None, pa.py_buffer(np.r_[marks, len(data)].astype(np.int64)), pa.py_buffer(data)])
        plain = (kind[marks] < 3) & ~inside[marks]
        coded = words.filter(pa.array(plain)).dictionary_encode()
        number = self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if plain.any() else np.empty(0, np.int64)
        begin, size = np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int64)
        begin[plain], size[plain] = self.begin[number], self.begin[number + 1] - self.begin[number]
        flat, odd_at = self.flat, np.flatnonzero(inside[marks])
        if len(odd_at):
            raw, more = common.buffers(column)[0], np.r_[marks, len(data)]
            values = [raw[more[k] : more[k + 1]].tobytes() for k in odd_at.tolist()]
            if len(self.rare) > REMEMBERED:
                self.rare.clear()
            fresh = [v for v in dict.fromkeys(values) if v not in self.rare]
            if fresh:
                self.rare.update((v, np.array(e.ids, np.uint32)) for v, e in zip(fresh, self.encode([v.decode("utf-8") for v in fresh], add_special_tokens=False)))
            arrays = [self.rare[v] for v in values]
            size[odd_at] = list(map(len, arrays))
            begin[odd_at] = len(flat) + np.cumsum(size[odd_at]) - size[odd_at]
            flat = np.concatenate([flat, *arrays])
        ends = np.cumsum(size)
        where = np.repeat(begin - (ends - size), size) + np.arange(ends[-1])
        per = np.bincount(np.searchsorted(offsets, marks, side="right") - 1, size, n).astype(np.int64)
        return flat[where], per


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """The level array of one split, and its open windows."""

    def __init__(self, size: int, first_id: int):
        self.size, self.next_id = size, first_id
        self.counts = np.zeros(size + 1, np.int64)  # of open windows by level
        self.open: list[list[list]] = [[] for _ in range(size)]  # windows by level; a window is a list of pieces
        self.rows: list[tuple] = []

    def place(self, length: int) -> int:
        """The level (0: a new window) that takes a piece of this length at the least sum of squares; the fuller one at a tie."""
        n = self.counts
        room = n[: self.size - length + 1]
        cost = 2 * (n[length : self.size + 1] - room) + 2
        cost[-1] = 1 - 2 * room[-1]  # a window that gets full leaves the sum
        cost[room == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * n[length] + 1
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def write(self, window: list) -> None:
        at = 0
        for doc, start, ids, total in window:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        """A document: whole windows as they are, then its rest by the rule."""
        total, whole = len(ids), len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            self.write([(doc, start, ids[start : start + self.size], total)])
        length = total - whole
        if not length:
            return
        level = self.place(length)
        window = self.open[level].pop() if level else []
        window.append((doc, whole, ids[whole:].copy(), total))
        self.counts[level] -= level > 0
        if level + length == self.size:
            self.write(window)
        else:
            self.open[level + length].append(window)
            self.counts[level + length] += 1

    def close(self) -> None:
        """Fills the open windows up with the pieces of the emptiest ones and writes them all."""
        left = [(self.size - level, w) for level in range(self.size - 1, 0, -1) for w in self.open[level]]
        self.open, self.counts[:] = [[] for _ in range(self.size)], 0
        lack, loose = sum(room for room, _ in left), []
        while left and sum(len(p[2]) for p in loose) < lack:
            room, window = left.pop()  # the emptiest
            lack -= room
            loose += window
        rooms, left = [room for room, _ in left], [w for _, w in left]
        count = sum(len(p[2]) for p in loose) - lack  # what no gap takes
        while count > 0:
            left.append([])
            rooms.append(1 << (count.bit_length() - 1))
            count -= rooms[-1]
        cut = []
        for piece in sorted(loose, key=lambda p: -len(p[2])):
            room, k = min(((room, k) for k, room in enumerate(rooms) if room >= len(piece[2])), default=(0, 0))
            if room:
                left[k].append(piece)
                rooms[k] -= len(piece[2])
            else:
                cut.append(piece)
        gaps = [k for k, room in enumerate(rooms) if room]
        for doc, start, ids, total in cut:
            while len(ids):
                part, ids = ids[: rooms[gaps[0]]], ids[rooms[gaps[0]] :]
                left[gaps[0]].append((doc, start, part, total))
                start, rooms[gaps[0]] = start + len(part), rooms[gaps[0]] - len(part)
                if not rooms[gaps[0]]:
                    gaps.pop(0)
        for window in left:
            self.write(window)

    def taken(self) -> pa.RecordBatch:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        columns = zip(*self.rows) if self.rows else [()] * len(names)
        self.rows, columns = [], [pa.array(list(c), pa.int64()) for c in columns]
        return pa.RecordBatch.from_arrays(columns, names)


def pack(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids (no special tokens added) and end_id; a null or empty text is end_id alone. Documents longer than a
    window give whole windows and one rest, which the rule places; only a few rests of a split's emptiest windows are placed or cut
    a second time. Every sequence is full or a power of two long, so none is padded. Sequence ids are unique over the table: a split has a range of
    its own. Repeated rows are packed as often as they occur, null ids stay null, an empty table gives an empty result, other
    columns are not read. Narrow: no shuffle; a task holds its open windows only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(size, (context.partitionId() if context else 0) * TASK_RANGE)
        for block in common.blocks(batches, 1 << 20):
            ids, per = word_ids(tokenizer).ids(block.column("text"))
            ends = np.cumsum(per)
            for k, doc in enumerate(block.column("doc_id").to_pylist()):
                packer.add(doc, np.append(ids[ends[k] - per[k] : ends[k]], np.uint32(end_id)))
            yield packer.taken()
        packer.close()
        yield packer.taken()

    return common.two_columns(df, id_col, text_col).mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
