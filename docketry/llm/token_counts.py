"""Token counts by rank-synchronous array merging of byte-level BPE.

Pre-tokens of a block are made unique, held as one ragged array of symbols, and merged in rounds: in every round each sequence
applies its own lowest-rank pair at all places at once (leftmost first where places overlap). That equals merging one pair at a
time, because a pair that holds a new symbol always has a higher rank than the merge that made the symbol.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from docketry.llm import common

#: Fixed values of the public byte-level BPE format: its pre-token pattern, white space as the library takes it.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NONE = np.iinfo(np.int32).max
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000
#: Class of each byte: letter 0 (UTF-8 bytes of U+00C0..U+00FF too), digit 1, sign 2, space 3, other ASCII white space 4.
KIND = np.full(256, 2, np.uint8)
KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 0
KIND[48:58] = 1
KIND[32], KIND[9:14] = 3, 4
#: Bytes whose chunk is left to the pattern: apostrophes and what isn't ASCII or led by C3.
ODD = np.zeros(256, bool)
ODD[[39, *range(0xC0, 0xC3), *range(0xC4, 256)]] = True


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: its own, or the next free one from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class Merger:
    """Vocabulary and merges as sorted arrays, and the counting."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pattern = regex.compile(PATTERN)
        self.splitter = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known: dict[bytes, int] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of each of the words (none empty) after all merges."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        left = np.zeros(len(words), np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbols), NONE, np.int32)  # of the pair that begins here
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self.pair_ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            over = least == NONE
            left[owner[starts[over]]] = sizes[over]
            if over.all():
                break
            if over.any():  # finished sequences leave the arrays
                stay = np.repeat(~over, sizes)
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                least, sizes = least[~over], sizes[~over]
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            run = np.r_[True, np.diff(hit) != 1]  # hits that touch overlap: every second one of a run, from its left
            first = np.flatnonzero(run)
            place = np.arange(len(hit)) - np.repeat(first, np.diff(np.r_[first, len(hit)]))
            hit = hit[place % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            gone = np.ones(len(symbols), bool)
            gone[hit + 1] = False
            # after the cut, the pairs that begin at a new symbol or just before one are looked up anew
            at = np.cumsum(gone)[hit] - 1
            symbols, owner, rank = symbols[gone], owner[gone], rank[gone]
            touched = np.zeros(len(symbols) + 1, bool)
            touched[at] = touched[at - 1] = True  # the last place stands for what is before the first
            anew = np.flatnonzero(touched[:-1])
            rank[anew] = NONE
            anew = anew[anew < len(symbols) - 1]
            anew = anew[owner[anew] == owner[anew + 1]]
            rank[anew] = self.pair_ranks(symbols[anew], symbols[anew + 1])
        return left

    def known_counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each of some distinct pre-tokens."""
        found = np.array([self.known.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            found[new] = self.merge(fresh)
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known.clear()
            self.known.update(zip(fresh, found[new].tolist()))
        return found

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text, of which none holds a special string."""
        starts, ends, owner = cut(data, offsets)
        out = np.zeros(len(offsets) - 1, np.int64)
        if not len(starts):
            return out
        # a chunk of plain letters, digits and signs parts where the class of its bytes changes; the pattern takes the others
        odd = ODD[data]
        odd[1:] |= (data[1:] == 32) & (KIND[data[:-1]] <= 2)  # a space that no cut stands before
        space = KIND[data] >= 3
        touch = space[1:] & space[:-1]
        odd[1:] |= touch
        odd[:-1] |= touch
        sign = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd[:-1] |= sign
        odd[starts[data[starts] == 32]] = False
        odd[:-1][touch] = True
        rare = np.logical_or.reduceat(odd, starts)
        kind = KIND[data]
        new = np.zeros(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 3)
        new[starts] = True
        if rare.any():
            for i in np.flatnonzero(rare).tolist():
                new[starts[i] : ends[i]] = False
        at = np.flatnonzero(new)
        if len(at):
            new[starts[rare]] = True  # rare chunks lie between as entries of their own, which are not counted here
            marks = np.flatnonzero(new)
            words = pa.Array.from_buffers(pa.large_binary(), len(marks), [None, pa.py_buffer(np.r_[marks, len(data)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            if len(marks) > len(at):
                words = words.filter(pa.array(np.isin(marks, at, assume_unique=True)))
            words = words.dictionary_encode()
            n = self.known_counts(words.dictionary.to_pylist())[words.indices.to_numpy()]
            out += np.bincount(np.searchsorted(offsets, at, side="right") - 1, n, len(out)).astype(np.int64)
        if rare.any():
            raw, words, whose = data.tobytes(), [], []
            for i in np.flatnonzero(rare).tolist():
                got = self.pattern.findall(raw[starts[i] : ends[i]].decode("utf-8"))
                words += got
                whose += [owner[i]] * len(got)
            coded = pa.array(words, pa.large_string()).dictionary_encode()
            n = self.known_counts([w.encode() for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
            out += np.bincount(np.array(whose), n, len(out)).astype(np.int64)
        return out

    def texts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text; a special string inside a text is one token and parts what stands around it."""
        data, offsets = common.buffers(column)
        raw = data.tobytes()
        if not any(s.encode() in raw for s in self.special):
            return self.counts(data, offsets)
        parts, owner, extra = [], [], np.zeros(len(column), np.int64)
        for i, text in enumerate(column.to_pylist()):
            got = self.splitter.split(text)
            extra[i] = len(got) - 1
            parts += got
            owner += [i] * len(got)
        return extra + np.bincount(owner, self.counts(*common.buffers(pa.array(parts, pa.large_string()))), len(column)).astype(np.int64)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks that are tokenised on their own: cuts before a lone space between two bytes that surely aren't white space.

    A lone space always begins a pre-token there, so the pre-tokens of the chunks are those of the text. Where white space
    can't be told by a byte or two, there is no cut, which only makes a chunk longer.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    plain = (data > 32) & (data < 127)
    lead = (data >= 0xC3) & (data <= 0xE0) | (data >= 0xE4)
    before = plain.copy()
    before[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    at = np.zeros(n, bool)
    at[1:-1] = (data[1:-1] == 32) & before[:-2] & (plain | lead)[2:]
    first = offsets[:-1][np.diff(offsets) > 0]
    edge = offsets[1:-1]
    at[edge[edge < n]] = False  # a space that begins a text follows nothing
    last = edge[(edge > 0)] - 1
    at[last] = False  # and one that ends a text precedes nothing
    at[first] = True
    starts = np.flatnonzero(at)
    ends = np.r_[starts[1:], n]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(df: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of df.

    tokenizer: path of a byte-level BPE file in the tokenizers JSON format, the same on all machines. Null texts count as empty
    (0 tokens), repeated rows give repeated results, null ids stay null, an empty table gives an empty result, and other columns
    are not read. Texts of any length are counted whole. Narrow: no shuffle; a worker holds one block of text and its distinct chunks.
    """

    def step(block: pa.RecordBatch) -> pa.RecordBatch:
        n = merger(tokenizer).texts(block.column("text"))
        sizes = pa.compute.binary_length(block.column("text")).cast(pa.int64())
        return pa.RecordBatch.from_arrays([block.column("doc_id"), sizes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.map_blocks(common.two_columns(df, id_col, text_col), step, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", 2 * common.BLOCK_BYTES)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
