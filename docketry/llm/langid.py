"""Language ID by a byte convolutional network: filters of several widths, max pooling and softmax, trained in numpy.

Windows have a fixed length and cover the whole text; every one of the 256 byte values has an embedding of its own. For inference
the embedding and the filters are folded into tables by pairs of bytes, so a filter's value is the sum of two looked-up rows; the
result is that of the network. Tables are made in the worker that needs them and never sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm import common

WINDOW, EMBED, FILTERS, WIDTHS = 256, 6, 8, (2, 3, 4)
#: Bounds of the fit: documents of each language, and windows of each document, spread over it.
DOCS, SPREAD = 150, 8
EPOCHS, BATCH, RATE, SEED = 10, 64, 0.02, 7
#: Byte that windows are padded with.
BLANK = 32
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes that weigh a window: ASCII letters, and those of all other characters.
HEAVY = LETTER | (np.arange(256) >= 128)
#: Code points of a labelled text that training sees, at a place that its id gives.
FIT_CHARS = 1 << 16


def windows(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as a matrix of bytes, padded with blanks, and the text of each."""
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(per)), per)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    at = offsets[:-1][owner] + place * WINDOW
    index = at[:, None] + np.arange(WINDOW)
    out = codes[np.minimum(index, max(len(codes) - 1, 0))] if len(codes) else np.empty((0, WINDOW), np.uint8)
    out[index >= offsets[1:][owner][:, None]] = BLANK
    return out, owner


class Network:
    """Parameters, training and inference."""

    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(SEED)
        self.languages = languages
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 0.4, (w, EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["o"] = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages)))
        self.p["c"] = np.zeros(len(languages))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter over a window, and where it is."""
        best, where = [], []
        for w in WIDTHS:
            rows = np.einsum("ce,jef->jcf", self.p["e"], self.p[f"w{w}"])
            n = x.shape[1] - w + 1
            conv = sum(rows[j][x[:, j : j + n]] for j in range(w)) + self.p[f"b{w}"]
            at = conv.argmax(axis=1)
            best.append(np.take_along_axis(conv, at[:, None], 1)[:, 0])
            where.append(at)
        return np.concatenate(best, 1), np.concatenate(where, 1)

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for k in range(0, len(x), BATCH):
                rows = order[k : k + BATCH]
                b, z = x[rows], np.arange(len(rows))
                raw, where = self.pooled(b)
                h = np.maximum(raw, 0)
                logits = h @ self.p["o"] + self.p["c"]
                q = np.exp(logits - logits.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[z, y[rows]] -= 1
                q /= len(rows)
                g = {"o": h.T @ q, "c": q.sum(0), "e": np.zeros_like(self.p["e"])}
                back = (q @ self.p["o"].T) * (raw > 0)
                for i, w in enumerate(WIDTHS):
                    d, at = back[:, i * FILTERS : (i + 1) * FILTERS], where[:, i * FILTERS : (i + 1) * FILTERS]
                    g[f"b{w}"], gw = d.sum(0), np.zeros_like(self.p[f"w{w}"])
                    for j in range(w):
                        c = b[z[:, None], at + j]
                        gw[j] = np.einsum("nfe,nf->ef", self.p["e"][c], d)
                        np.add.at(g["e"], c, d[:, :, None] * self.p[f"w{w}"][j].T[None])
                    g[f"w{w}"] = gw
                step += 1
                for name, grad in g.items():
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    v[name] = 0.99 * v[name] + 0.01 * grad * grad
                    self.p[name] = self.p[name] - RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("head", "tail")}

    def fold(self) -> None:
        """Tables by pairs of bytes: what a pair adds as the first two places of a filter, and as the third and fourth."""
        rows = {w: np.einsum("ce,jef->jcf", self.p["e"], self.p[f"w{w}"]).astype(np.float32) for w in WIDTHS}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        self.head = np.concatenate([pair(rows[w][0], rows[w][1]) + self.p[f"b{w}"].astype(np.float32) for w in WIDTHS], 1)
        self.tail = np.concatenate([pair(rows[3][2], np.zeros((256, FILTERS), np.float32)), pair(rows[4][2], rows[4][3])], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not hasattr(self, "head"):
            self.fold()
        out = np.empty((len(x), len(self.languages)))
        for k in range(0, len(x), 64):
            b = x[k : k + 64].astype(np.int32)
            pairs = b[:, :-1] * 256 + b[:, 1:]
            conv = self.head[pairs[:, :-2]]
            conv[:, :, FILTERS:] += self.tail[pairs[:, 2:]]
            out[k : k + 64] = np.maximum(conv.max(axis=1), 0) @ self.p["o"] + self.p["c"]
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language (an index, -1: no letter) and its probability for each text: window logits weighted by their letters."""
        n = len(offsets) - 1
        x, owner = windows(data, offsets)
        weight = HEAVY[x].sum(1).astype(float) + 1e-9
        total = np.zeros((n, len(self.languages)))
        np.add.at(total, owner, self.logits(x) * weight[:, None])
        total /= np.maximum(np.bincount(owner, weight, n), 1e-9)[:, None]
        q = np.exp(total - total.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        ascii_letters = np.r_[0, np.cumsum(LETTER[data])]
        lacking = np.flatnonzero(ascii_letters[offsets[1:]] == ascii_letters[offsets[:-1]])
        best = q.argmax(1)
        for i in lacking.tolist():
            if not any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8"))):
                best[i] = -1
        return best, np.where(best < 0, 0.0, q.max(1))


def fit(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """A network trained on at most DOCS documents of each language, the first by a hash of their ids, on at most SPREAD windows of
    FIT_CHARS code points of each, one row for each id and language; None without any."""
    rows = df.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), common.excerpt(F.col(text_col), F.col(id_col), FIT_CHARS).alias("t")).where("l is not null and i is not null")
    first = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    chosen = rows.select("i", "l").distinct().withColumn("k", F.row_number().over(first)).where(F.col("k") <= DOCS).select("i").distinct()
    one = rows.where("t is not null").join(F.broadcast(chosen), "i", "left_semi").groupBy("i", "l").agg(F.min("t").alias("t"))
    got = sorted(map(tuple, one.collect()), key=lambda r: (r[1], r[0]))
    languages = sorted({r[1] for r in got})
    if not languages:
        return None
    xs, ys = [], []
    for _, lang, text in got:
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        x, _ = windows(raw, np.array([0, len(raw)]))
        x = x[HEAVY[x].sum(1) > 8]
        x = x[np.linspace(0, len(x) - 1, min(SPREAD, len(x))).astype(int)] if len(x) else x
        xs.append(x)
        ys += [languages.index(lang)] * len(x)
    net = Network(languages)
    net.train(np.concatenate(xs), np.array(ys, np.int64))
    return net


def identify(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every row of df, from the text alone.

    Null texts and texts without a letter give `und` and 0.0, as does every row where nothing could be learned; repeated rows
    give repeated results; null ids stay null; an empty table gives an empty result; other columns are not read. Narrow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, 1 << 20):
            n = block.num_rows
            best, score = net.texts(*common.buffers(block.column("text"))) if net else (np.full(n, -1), np.zeros(n))
            names = [net.languages[k] if k >= 0 else "und" for k in best.tolist()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(names, pa.string()), pa.array(score.astype(float))], ["doc_id", "lang_pred", "score"])

    return common.two_columns(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(df: DataFrame, net: Network | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of df, with all columns, whose language is told with at least this probability (never `und`)."""

    def keep(texts: pa.Array) -> np.ndarray:
        best, score = net.texts(*common.buffers(texts)) if net else (np.full(len(texts), -1), np.zeros(len(texts)))
        return (best >= 0) & (score >= least)

    return common.keep_rows(df, text_col, keep, 1 << 20)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    rest = lambda c: F.coalesce(common.crc_rest(F.col(c), 4) == 2, F.lit(False))
    net = fit(docs.where(~rest("doc_id")))
    return identify(docs, net).select("doc_id", rest("doc_id").alias("held_out"), "lang_pred", "score")
