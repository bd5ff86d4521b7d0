"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling, in numpy.

A word's embedding is the sum of those of its hashed beginnings and of the whole word, so inflected forms share what is learned.

The language that a threshold belongs to is told from the words of the text, by hashed words that are nearly always of one
language among the fitted documents; it moves the logit so that 0.5 is the threshold of each language.
"""

from __future__ import annotations

import contextlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common

#: Rows of the table of embeddings, which bounds the model whatever the vocabulary, and its other sizes.
BUCKETS, EMBED, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
#: Beginnings of a word that have an embedding, in bytes.
BEGINNINGS = range(3, 11)
#: Documents and text bytes of a shard, which a task trains on at a time.
SHARD_DOCS, SHARD_BYTES = 4096, 16 << 20
#: Code points from which a text counts as long in tests; nothing is cut there.
FIT_CHARS = 50_000
#: Rounds of training over all shards, and passes over the documents that few shards need at least.
ROUNDS, EPOCHS = 4, 10
BATCH, RATE, SEED, LEAST_DOCS = 64, 0.05, 11, 4
#: Sums over shards are in integers of this unit, so that they don't hang on the order of tasks; steps of a logit for thresholds.
UNIT, LOGIT_STEPS = 2.0**32, 1024
#: While the fit runs: the files of a shuffle go with the query that made them (they would stay until the driver collects its garbage).
SHORT_LIVED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
STEP = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(words: pa.Array) -> np.ndarray:
    """The buckets of each word's beginnings (0: the word is shorter) and of the word itself."""
    data, offsets = common.buffers(words)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), len(BEGINNINGS) + 1), np.int64)
    h = np.zeros(len(sizes), np.uint64)
    for k in range(BEGINNINGS[-1]):
        h = (h ^ data[np.minimum(offsets[:-1] + k, len(data) - 1)].astype(np.uint64)) * STEP
        h ^= h >> np.uint64(31)
        if k + 1 in BEGINNINGS:
            out[:, k + 1 - BEGINNINGS[0]] = np.where(sizes > k, h % np.uint64(BUCKETS - 1) + np.uint64(1), 0).astype(np.int64)
    digest = xxhash.xxh64_intdigest
    out[:, -1] = [digest(w) % (BUCKETS - 1) + 1 for w in words.to_pylist()]
    return out


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters, digits and what isn't ASCII) of all texts as numbers, words before each text, and the buckets
    of each number's word; number 0 is no word."""
    low = LOWER[data]
    real = WORD[low]
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True
    begin = np.flatnonzero(real & (np.r_[True, ~real[:-1]] | first[:-1])) if len(low) else np.empty(0, np.int64)
    if not len(begin):
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros((1, len(BEGINNINGS) + 1), np.int64)
    end = np.flatnonzero(real & (np.r_[~real[1:], True] | first[1:])) + 1
    marks = np.empty(2 * len(begin), np.int64)
    marks[::2], marks[1::2] = begin, end
    words = pa.Array.from_buffers(pa.large_binary(), len(marks) - 1, [None, pa.py_buffer(marks), pa.py_buffer(low)])
    coded = words.filter(pa.array(np.arange(len(marks) - 1) % 2 == 0)).dictionary_encode()
    known = features(coded.dictionary)
    return coded.indices.to_numpy().astype(np.int64) + 1, np.searchsorted(begin, offsets), np.r_[np.zeros((1, known.shape[1]), np.int64), known]


def padded(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with a gap (bucket 0) after each text as long as the widest filter needs, and where each text begins."""
    gap = max(WIDTHS)
    sizes = np.diff(bounds) + gap
    out = np.zeros(sizes.sum() + gap, np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), np.diff(bounds))
    out[np.arange(len(words)) + owner * gap] = words
    return out, starts


class Classifier:
    """Parameters, training and inference; buckets that few fitted documents have keep no embedding (they are 0)."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.w = {w: rng.normal(0, 0.5, (w, EMBED, FILTERS)) for w in WIDTHS}
        self.b = {w: np.zeros(FILTERS) for w in WIDTHS}
        self.o = np.abs(rng.normal(0.5, 0.1, len(WIDTHS) * FILTERS))
        self.c = np.array([-1.0])
        self.active = np.zeros(BUCKETS, bool)
        self.rows = np.zeros((BUCKETS, EMBED))
        self.seen = {k: np.full_like(v, 1e-6) for k, v in self.dense().items()}
        self.seen_rows = np.full(BUCKETS, 1e-6)
        self.languages: list[str] = []
        self.votes = np.full(BUCKETS, -1, np.int16)
        self.threshold = np.zeros(1)

    def dense(self) -> dict[str, np.ndarray]:
        """All parameters but the embeddings."""
        return {f"w{w}": self.w[w] for w in WIDTHS} | {f"b{w}": self.b[w] for w in WIDTHS} | {"o": self.o, "c": self.c}

    def __getstate__(self) -> dict:
        """For tasks: only the rows of buckets that have embeddings, since each copy of the model is also a file on each machine."""
        at = np.flatnonzero(self.active)
        return self.__dict__ | {"active": at.astype(np.int32), "rows": self.rows[at], "seen_rows": self.seen_rows[at], "votes": self.votes[at]}

    def __setstate__(self, state: dict) -> None:
        at = state["active"]
        fill = {"active": np.zeros(BUCKETS, bool), "rows": np.zeros((BUCKETS, EMBED)), "seen_rows": np.full(BUCKETS, 1e-6), "votes": np.full(BUCKETS, -1, np.int16)}
        for k, x in fill.items():
            x[at] = True if k == "active" else state[k]
        self.__dict__ = state | fill

    def know(self, buckets: np.ndarray) -> None:
        """The buckets that get embeddings."""
        self.active[buckets] = True
        self.rows = np.random.default_rng(SEED).normal(0, 0.05, (BUCKETS, EMBED)) * self.active[:, None]

    def number(self, words: np.ndarray) -> np.ndarray:
        """Row of each bucket; 0, which has no weight, for those without one."""
        return np.where(self.active[words], words, 0)

    def pooled(self, words: np.ndarray, starts: np.ndarray, known: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter over a text, and (places) where it is; known: the rows of each word."""
        best, where = [], []
        embedded = self.rows[known].sum(1)
        for w in WIDTHS:
            n = len(words) - w + 1
            conv = sum((embedded @ self.w[w][j]).astype(np.float32)[words[j : j + n]] for j in range(w)) + self.b[w].astype(np.float32)
            if places:
                top = np.maximum.reduceat(conv, starts, axis=0)
                sizes = np.diff(np.r_[starts, n])
                hit, col = np.nonzero(conv == np.repeat(top, sizes, axis=0))
                at = np.zeros(top.shape, np.int64)
                at[np.searchsorted(starts, hit, side="right") - 1, col] = hit
                where.append(at)
            else:
                top = np.maximum.reduceat(conv, starts, axis=0)
            best.append(top)
        return np.concatenate(best, 1), np.concatenate(where, 1) if where else np.empty(0)

    def train(self, words: np.ndarray, bounds: np.ndarray, buckets: np.ndarray, y: np.ndarray, share: float, epochs: int, seed: list[int]) -> None:
        """Passes over one shard; share: that of label 1 among all documents."""
        rng = np.random.default_rng(seed)
        known, seen, seen_e = self.number(buckets), self.seen, self.seen_rows
        balance = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))

        def move(name: str, value: np.ndarray, grad: np.ndarray) -> None:
            seen[name] += grad * grad
            value -= RATE * grad / np.sqrt(seen[name])

        for _ in range(epochs):
            order = rng.permutation(len(y))
            for k in range(0, len(y), BATCH):
                own = order[k : k + BATCH]
                used, part = np.unique(np.concatenate([[0], *(words[bounds[i] : bounds[i + 1]] for i in own)]), return_inverse=True)
                part, starts = padded(part[1:], np.r_[0, np.cumsum(np.diff(bounds)[own])])
                mine = known[used]
                raw, where = self.pooled(part, starts, mine, True)
                embedded = self.rows[mine].sum(1)
                h = np.maximum(raw, 0)
                q = 1 / (1 + np.exp(-(h @ self.o + self.c)))
                d = (q - y[own]) * balance[own] / len(own)
                back = d[:, None] * self.o * (raw > 0)
                grad_w = np.zeros((len(used), EMBED))
                for i, w in enumerate(WIDTHS):
                    g, at = back[:, i * FILTERS : (i + 1) * FILTERS], where[:, i * FILTERS : (i + 1) * FILTERS]
                    gw = np.empty_like(self.w[w])
                    for j in range(w):
                        r = part[at + j]
                        gw[j] = np.einsum("nfe,nf->ef", embedded[r], g)
                        np.add.at(grad_w, r, g[:, :, None] * self.w[w][j].T[None])
                    move(f"w{w}", self.w[w], gw)
                    move(f"b{w}", self.b[w], g.sum(0))
                move("o", self.o, h.T @ d)
                move("c", self.c, np.array([d.sum()]))
                moved = np.flatnonzero(grad_w.any(1))
                touched, own_row = np.unique(mine[moved], return_inverse=True)
                grad_e = np.zeros((len(touched), EMBED))
                np.add.at(grad_e, own_row.reshape(-1, mine.shape[1]), grad_w[moved][:, None, :])
                grad_e[touched == 0] = 0
                seen_e[touched] += (grad_e**2).mean(1)
                self.rows[touched] -= 2 * RATE * grad_e / np.sqrt(seen_e[touched])[:, None]

    def state(self) -> np.ndarray:
        """What training moves: embeddings and their sums of squares, then the other parameters and theirs."""
        return np.concatenate([self.rows.ravel(), self.seen_rows, *(x.ravel() for x in (*self.dense().values(), *self.seen.values()))])

    def move_to(self, state: np.ndarray) -> None:
        self.rows, self.seen_rows = state[: self.rows.size].reshape(BUCKETS, EMBED).copy(), state[self.rows.size :][:BUCKETS].copy()
        at = self.rows.size + BUCKETS
        for x in (*self.dense().values(), *self.seen.values()):
            x[...] = state[at : at + x.size].reshape(x.shape)
            at += x.size

    def outputs(self, words: np.ndarray, bounds: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language (an index; the last one: none) of each text."""
        known, n = self.number(buckets), len(bounds) - 1
        part, starts = padded(words, bounds)
        logit = np.maximum(self.pooled(part, starts, known)[0], 0) @ self.o + self.c[0]
        votes = self.votes[known[:, -1]][words]
        text = np.repeat(np.arange(n), np.diff(bounds))
        count = np.zeros((n, len(self.threshold)))
        np.add.at(count, (text[votes >= 0], votes[votes >= 0]), 1)
        return logit, np.where(count.any(1), count.argmax(1), len(self.threshold) - 1)

    def calibrate(self, logit: np.ndarray, lang: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> None:
        """For each language the threshold with the best F1 on rows (n of each, or one) that training didn't see, in the middle of its gap."""
        n = np.ones(len(y), np.int64) if n is None else n

        def best(z: np.ndarray, t: np.ndarray, n: np.ndarray) -> float:
            order = np.argsort(-z, kind="stable")
            z, t, n = z[order], t[order], n[order]
            last = np.flatnonzero(np.r_[z[1:] != z[:-1], True])  # equal logits are on one side
            f1 = (2 * np.cumsum(t * n) / (np.cumsum(n) + (t * n).sum()))[last]
            k = int(f1.argmax())
            return float(z[last[k]] + (z[last[k + 1]] if k + 1 < len(last) else z[last[k]] - 2)) / 2

        overall = best(logit, y, n) if len(y) and 0 < (y * n).sum() < n.sum() else 0.0
        for k in range(len(self.threshold)):
            own = lang == k
            self.threshold[k] = best(logit[own], y[own], n[own]) if (y * n)[own].sum() >= 5 and ((1 - y) * n)[own].sum() >= 5 else overall

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logit, lang = self.outputs(*hashed(data, offsets))
        return 1 / (1 + np.exp(-np.clip(logit - self.threshold[lang], -60, 60)))


class Shard:
    """A row of the stored shards: words of its texts as numbers, their bounds, the buckets of each number, and what is known of each text."""

    SCHEMA = "shard int, piece int, n long, toxic long, n_trained long, toxic_trained long, y binary, held binary, langs array<string>, words binary, bounds binary, buckets binary"

    def __init__(self, row: dict) -> None:
        self.key = [row["shard"], row["piece"]]
        self.y, self.held = (np.frombuffer(row[k], np.int8) for k in ("y", "held"))
        self.langs, self.words, self.bounds = np.array(row["langs"], object), np.frombuffer(row["words"], np.int32), np.frombuffer(row["bounds"], np.int64)
        self.buckets = np.frombuffer(row["buckets"], np.int32).reshape(-1, len(BEGINNINGS) + 1)

    def part(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, bounds and buckets of some texts."""
        words = np.concatenate([self.words[self.bounds[i] : self.bounds[i + 1]] for i in own] + [self.words[:0]])
        return words, np.r_[0, np.cumsum(np.diff(self.bounds)[own])].astype(np.int64), self.buckets


def packed(table: pa.Table) -> Iterator[dict]:
    """The rows of Shard of one group of (shard, doc_id, toxic, lang, size, text), texts as compressed() makes them."""
    table = table.take(pa.compute.sort_indices(table, sort_keys=[(c, "ascending") for c in ("doc_id", "toxic", "lang", "text")])).combine_chunks()
    ends = np.cumsum(table.column("size").to_numpy())
    start, piece = 0, 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SHARD_BYTES, side="right")))
        part = table.slice(start, end - start)
        texts = [pa.decompress(z, n, "zstd", asbytes=True) if n else b"" for z, n in zip(part.column("text").to_pylist(), part.column("size").to_pylist(), strict=True)]
        words, bounds, buckets = hashed(*common.buffers(pa.array(texts, pa.large_binary())))
        y = part.column("toxic").to_numpy().astype(np.int8)
        held = np.array([common.crc_rest_py(k + 1, 5) == 3 for k in part.column("doc_id").to_pylist()], np.int8)
        yield {
            "shard": part.column("shard")[0].as_py(), "piece": piece, "n": len(y), "toxic": int(y.sum()), "n_trained": int((1 - held).sum()), "toxic_trained": int((y * (1 - held)).sum()), "y": y.tobytes(), "held": held.tobytes(),
            "langs": part.column("lang").to_pylist(), "words": words.astype(np.int32).tobytes(), "bounds": bounds.astype(np.int64).tobytes(), "buckets": buckets.astype(np.int32).tobytes(),
        }
        start, piece = end, piece + 1


def compressed(docs: DataFrame) -> DataFrame:
    """doc_id, lang, bytes and whole text of each document that has id and text; texts by zstd, as shuffles compress them far less."""
    common.bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            small = pa.array([pa.compress(x, "zstd", asbytes=True) if x else b"" for x in texts.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.compute.binary_length(texts).cast(pa.int64()), small], ["doc_id", "lang", "size", "text"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, size long, text binary")


def labelled(docs: DataFrame, marked: DataFrame, count: int, tasks: int) -> DataFrame:
    """All labelled documents (each different row once) in shards by a hash of their ids; whole texts meet their labels in one shuffle, which
    also makes the shards and deals them evenly."""
    dealt = lambda x: x.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int")).repartitionById(tasks, F.col("shard"))
    return dealt(compressed(docs)).join(dealt(marked).hint("shuffle_hash"), ["shard", "doc_id"]).select("shard", "doc_id", "toxic", "lang", "size", "text").distinct()


def shards(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled documents, hashed and stored in shards. Null ids, texts and labels are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    marked = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).distinct()
    n, mean = marked.count(), docs.where("doc_id is not null").agg(F.avg(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    count = int(n * max(1 / SHARD_DOCS, mean / SHARD_BYTES)) + 1
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, min(count, 2000))
    schema = to_arrow_schema(_parse_datatype_string(Shard.SCHEMA))

    def pack(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(packed(table)), schema)

    return common.written(labelled(docs, marked, count, tasks).groupBy("shard").applyInArrow(pack, Shard.SCHEMA), "toxicity-shards", "zstd")


@contextlib.contextmanager
def sent(net: Classifier, spark: SparkSession) -> Iterator[Callable[[], Classifier]]:
    """Gives tasks a copy of the model each, and takes its files off all machines when the query is over (those of a closure would stay)."""
    held = spark.sparkContext.broadcast(pickle.dumps(net))
    try:
        yield lambda: pickle.loads(held.value)  # tasks of one worker share the value, and training changes the model
    finally:
        held.destroy()


def over_shards(stored: DataFrame, step, schema: str) -> DataFrame:
    """step over the shards that each of few tasks holds one at a time; a task's results are one sum, whatever its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(Shard(b.slice(k, 1).to_pylist()[0]) for b in batches for k in range(b.num_rows))
        common.trim()

    return stored.coalesce(2 * stored.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)


def learn_words(net: Classifier, stored: DataFrame, every: bool) -> None:
    """Buckets that enough documents have, and which bucket's word (as a whole) is of which language: nine in ten of its documents are."""

    def count(some: Iterator[Shard]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])
            sums.clear()

        for x in some:
            own = np.flatnonzero((x.held == 0) | every)
            for i in own:
                got = x.buckets[np.unique(x.words[x.bounds[i] : x.bounds[i + 1]])]
                # the empty name counts all buckets of a document, the others their whole words
                for lang, hit in (("", got), ("=" + x.langs[i] if x.langs[i] is not None else None, got[:, -1])):
                    if lang is not None:
                        if lang not in sums and len(sums) >= 50:
                            yield from out()
                        sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[np.unique(hit)] += 1
        yield from out()

    counts = common.written(over_shards(stored, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "toxicity-words")
    net.know(counts.where(f"lang = '' and bucket > 0 and n >= {LEAST_DOCS}").select("bucket").toArrow().column(0).to_numpy())
    whole = counts.where("lang != ''").groupBy("bucket").agg(F.max(F.struct("n", "lang")).alias("most"), F.sum("n").alias("n")).where("most.n >= 0.9 * n").select("bucket", F.substring("most.lang", 2, 1 << 30).alias("lang")).toArrow()
    net.languages = sorted(r[0][1:] for r in counts.where("lang != ''").select("lang").distinct().collect())
    net.threshold = np.zeros(len(net.languages) + 1)
    place = {x: k for k, x in enumerate(net.languages)}
    net.votes[whole.column(0).to_numpy()] = [place[x] for x in whole.column(1).to_pylist()]
    net.votes[~net.active] = -1


def train_round(net: Classifier, stored: DataFrame, every: bool, share: float, epochs: int, turn: int) -> None:
    """Each shard is trained on from the same state; the embeddings then move by the mean of the shards that moved them, the rest by that of all."""
    cells = BUCKETS * (EMBED + 1)

    def train(some: Iterator[Shard]) -> Iterator[pa.RecordBatch]:
        net = model()
        start, total = net.state(), None
        for x in some:
            own = np.flatnonzero((x.held == 0) | every)
            if not len(own):
                continue
            net.move_to(start)
            net.train(*x.part(own), x.y[own].astype(np.int64), share, epochs, [SEED, turn, *x.key])
            moved = np.rint((net.state() - start) * UNIT).astype(np.int64)
            moved = np.concatenate([moved, moved[cells - BUCKETS : cells] != 0, [1]])
            total = moved if total is None else total + moved
        if total is not None:
            for k, block in enumerate(np.array_split(total, 16)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["block", "sums"])

    def add(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("sums"))
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    with sent(net, stored.sparkSession) as model:
        got = over_shards(stored, train, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").toArrow().sort_by("block")
    sums = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in got.column("sums")])
    size = len(sums) - BUCKETS - 1
    touched = np.maximum(sums[size:-1], 1)
    over = np.concatenate([np.repeat(touched, EMBED), touched, np.full(size - cells, sums[-1])])
    net.move_to(net.state() + sums[:size] / UNIT / over)


def learn_thresholds(net: Classifier, stored: DataFrame) -> None:
    """Thresholds from all rows that training didn't see, counted by logits in small steps."""

    def place(some: Iterator[Shard]) -> Iterator[pa.RecordBatch]:
        net = model()
        for x in some:
            own = np.flatnonzero(x.held)
            if len(own):
                logit, lang = net.outputs(*x.part(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.clip(logit, -60, 60) * LOGIT_STEPS).astype(np.int64)), pa.array(lang.astype(np.int64)), pa.array(x.y[own].astype(np.int64))], ["z", "lang", "y"])

    with sent(net, stored.sparkSession) as model:
        got = over_shards(stored, place, "z long, lang long, y long").groupBy("z", "lang", "y").count().orderBy("z", "lang", "y").toArrow()
    z, lang, y, n = (got.column(k).to_numpy() for k in range(4))
    net.calibrate(z / LOGIT_STEPS, lang, y, n)


def fit(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """A classifier from all documents (doc_id, text, lang) that have a label (doc_id, toxic) and their whole texts; a fifth of them set the
    thresholds, the others the words, languages and the network. Tasks train on shards of a bounded size and are averaged, for some rounds;
    the driver holds the model only, whose size is fixed, and counts by steps of a logit. None unless both labels are there."""
    with common.settings(docs.sparkSession, SHORT_LIVED):
        return fitted(docs, labels)


def fitted(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    stored = shards(docs, labels)
    n, toxic, n_trained, toxic_trained, pieces = stored.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "toxic", "n_trained", "toxic_trained")), F.count("*")).first()
    if not 0 < toxic < n:
        return None
    every = not 0 < toxic_trained < n_trained
    net = Classifier()
    learn_words(net, stored, every)
    epochs = max(1, -(-EPOCHS // (ROUNDS * pieces)))
    for turn in range(ROUNDS):
        train_round(net, stored, every, toxic / n if every else toxic_trained / n_trained, epochs, turn)
    if not every:
        learn_thresholds(net, stored)
    return net


def score(df: DataFrame, net: Classifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted for every row of df, from the text alone.

    Null and empty texts get the score of a text without known words; without a classifier every score is 0.0; repeated rows
    give repeated results; null ids stay null; an empty table gives an empty result; other columns are not read. Narrow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, 1 << 20):
            got = net.scores(*common.buffers(block.column("text"))) if net else np.zeros(block.num_rows)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return common.two_columns(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held = lambda c: F.coalesce(common.crc_rest(F.col(c), 5) == 0, F.lit(False))
    return score(docs, fit(docs.where(~held("doc_id")), labels.where(~held("doc_id")))).select("doc_id", held("doc_id").alias("held_out"), "score", "predicted")
