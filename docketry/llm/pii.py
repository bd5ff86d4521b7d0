"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

The network decodes overlapping windows; each character takes its tag from the window in which it is farthest from an edge, and
spans are read off that one sequence of a text. All kinds hold a digit, an @ or its name in brackets, so windows without any of
these signs, which can hold no span, are not decoded, and nor is a span without any taken. What the network is for is what the
patterns miss: cards with other separators, phones without a plus, addresses with (at), defanged IPs.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds. An email's are those of its parts on either side of the @, so that no run is tried twice.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]*\Z"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

LENGTH, STRIDE = 48, 24
SYMBOLS, EMBED, HIDDEN, TAGS = 130, 10, 16, 2 * len(KINDS) + 1
#: Bounds of the fit: documents whose base spans are labels, and labelled lines made by rule.
DOCS, MADE = 300, 2600
#: Code points of a sampled document, at a place that its id gives, and windows of it.
FIT_CHARS, FIT_WINDOWS = 1 << 14, 64
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.01, 5


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def byte_part(digits: str) -> bool:
    """At most 255, however many zeros come first (int() refuses thousands of digits)."""
    rest = digits.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        got = DOMAIN.match(text, at + 1) if start < at else None
        if got:
            out.append((0, start, got.end()))
            done = got.end()
        at = text.find("@", max(at + 1, done))
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(byte_part, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def symbols(text: str) -> np.ndarray:
    """A symbol for each code point: ASCII as it is, one for the rest."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128).astype(np.int64)


TRIGGER = np.zeros(SYMBOLS, bool)
TRIGGER[[40, 64, 91, *range(48, 58)]] = True
SIGNS = np.r_[TRIGGER[:128], np.zeros(128, bool)]


def windows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that hold a digit, an @ or an opening bracket, padded with symbol 129, and where they start."""
    hits = np.flatnonzero(TRIGGER[codes])
    last = hits // STRIDE
    starts = np.unique(np.concatenate([last - k for k in range(LENGTH // STRIDE)]))
    starts = starts[starts >= 0] * STRIDE
    index = starts[:, None] + np.arange(LENGTH)
    out = codes[np.minimum(index, len(codes) - 1)]
    out[index >= len(codes)] = SYMBOLS - 1
    return out, starts


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Tag 0 outside, 2k + 1 where a span of kind k begins, 2k + 2 inside."""
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        out[start:end] = 2 * kind + 2
        out[start] = 2 * kind + 1
    return out


def made(n: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Lines with labelled spans made by rule: each kind in usual and less usual forms, and numbers that are none of them."""
    rng = random.Random(SEED)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda a=2, b=9: "".join(rng.choice("aeiounrstlhdmc") for _ in range(rng.randint(a, b)))

    def card() -> str:
        body = rng.choice("3456") + digits(14)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", " ", "-", ".", ".", "/", "  ", " - ", "_"])
        return sep.join(full[k : k + 4] for k in range(0, 16, 4))

    def email() -> str:
        name = f"{word()}{rng.choice(['.', '_', '', '-', '+'])}{rng.choice([word(), digits(2)])}"
        dot, at = rng.choice([(".", "@"), (".", "@"), (".", " (at) "), (".", "(at)"), (".", " [at] "), (" (dot) ", " (at) "), (" [dot] ", " [at] "), (".", " @ ")])
        ends = rng.choice([["com"], ["org"], ["example", "com"], ["net"], ["de"], ["co", "uk"]])
        return name + at + dot.join([word() + rng.choice(["", digits(1)]), *ends])

    def ip() -> str:
        return rng.choice([".", ".", "[.]", "(.)", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))

    def phone() -> str:
        return rng.choice(
            [
                f"+{rng.randint(1, 49)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{rng.randint(1, 99)} {digits(3)} {digits(4)} {digits(3)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(11)}",
                f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"00{rng.randint(1, 99)} {digits(3)} {digits(7)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"(0{digits(3)}) {digits(6)}",
            ]
        )

    kinds = [email, ip, card, phone]
    others = [
        lambda: digits(rng.randint(1, 7)), lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{digits(2)}.{digits(2)}", lambda: '"' + "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 32, 40]))) + '"',
        lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"@{word()}", lambda: digits(rng.choice([9, 12, 16])), lambda: f"({word()} {word()})", lambda: f"[{digits(2)}]",
        lambda: f"({digits(2)})", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}", lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"({rng.randint(1900, 2030)})",
        lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1900, 2030)} {rng.randint(1900, 2030)}", lambda: f"${digits(3)}.{digits(2)}", lambda: f"({rng.choice(['at', 'dot'])} {word()})",
    ]
    out = []
    for _ in range(n):
        text, spans = word() + " ", []
        for _ in range(rng.randint(1, 2)):
            text += " ".join(word() for _ in range(rng.randint(0, 4))) + rng.choice([" ", " ", ", ", ": "])
            if rng.random() < 0.75:
                k = rng.randrange(4)
                value = kinds[k]()
                spans.append((k, len(text), len(text) + len(value)))
            else:
                value = rng.choice(others)()
            text += value + rng.choice([" ", ". ", ", ", "\n"])
        out.append((text + " ".join(word() for _ in range(rng.randint(0, 5))), spans))
    return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Parameters, training by the CRF's likelihood, and Viterbi decoding."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.p = {"e": rng.normal(0, 0.4, (SYMBOLS, EMBED)), "o": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (EMBED, 4 * HIDDEN))
            self.p[f"h{d}"] = rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN))
            self.p[f"b{d}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
        inside = np.arange(2, TAGS, 2)
        self.bar = np.zeros((TAGS, TAGS))  # an inside tag follows only its own kind
        self.bar[:, inside] = -30
        self.bar[inside, inside] = self.bar[inside - 1, inside] = 0
        self.first = np.zeros(TAGS)

    def lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states over time (time first), in the direction d."""
        steps, n, _ = x.shape
        h = c = np.zeros((n, HIDDEN), x.dtype)
        out = np.empty((steps, n, HIDDEN), x.dtype)
        into = x @ self.p[f"x{d}"].astype(x.dtype) + self.p[f"b{d}"].astype(x.dtype)
        wh = self.p[f"h{d}"].astype(x.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = into[t] + h @ wh
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before, th, h_before))
        return out

    def back(self, d: str, keep: list, dh_out: np.ndarray, x: np.ndarray, grads: dict) -> np.ndarray:
        dx = np.empty_like(x)
        n = x.shape[1]
        dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        for t, i, f, o, g, before, th, h_before in reversed(keep):
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
            grads[f"x{d}"] += x[t].T @ dz
            grads[f"h{d}"] += h_before.T @ dz
            grads[f"b{d}"] += dz.sum(0)
            dx[t] = dz @ self.p[f"x{d}"].T
            dh, dc = dz @ self.p[f"h{d}"].T, dc * f
        return dx

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for k in range(0, len(x), BATCH):
                rows = order[k : k + BATCH]
                step += 1
                for name, grad in self.gradient(x[rows].T, y[rows].T).items():
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    v[name] = 0.99 * v[name] + 0.01 * grad * grad
                    self.p[name] -= RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)

    def gradient(self, codes: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean negative log-likelihood; codes and tags have time first."""
        steps, n = codes.shape
        grads = {k: np.zeros_like(a) for k, a in self.p.items()}
        x = self.p["e"][codes]
        keep_f, keep_b = [], []
        h = np.concatenate([self.lstm(x, "f", keep_f), self.lstm(x, "b", keep_b)], 2)
        e = h @ self.p["o"] + self.p["c"]
        trans, start = self.p["t"] + self.bar, self.p["s"] + self.first
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = start + e[0]
        for t in range(1, steps):
            alpha[t] = log_sum(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = log_sum(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = log_sum(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        for t in range(1, steps):
            both = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t] - z[:, None])[:, None, :])
            grads["t"] += both.sum(0)
        np.subtract.at(grads["t"], (y[:-1].ravel(), y[1:].ravel()), 1)
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        grads["s"] = de[0].sum(0)
        grads["o"] = h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
        grads["c"] = de.sum((0, 1))
        dh = de @ self.p["o"].T
        dx = self.back("f", keep_f, dh[:, :, :HIDDEN], x, grads) + self.back("b", keep_b, dh[:, :, HIDDEN:], x, grads)
        np.add.at(grads["e"], codes, dx)
        return {k: g / n for k, g in grads.items()}

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags of windows (one window a row)."""
        x = self.p["e"].astype(np.float32)[codes.T]
        h = np.concatenate([self.lstm(x, "f"), self.lstm(x, "b")], 2)
        e = h @ self.p["o"].astype(np.float32) + self.p["c"].astype(np.float32)
        trans = (self.p["t"] + self.bar).astype(np.float32)
        score, came = e[0] + (self.p["s"] + self.first).astype(np.float32), []
        for t in range(1, len(e)):
            step = score[:, :, None] + trans
            came.append(step.argmax(1))
            score = step.max(1) + e[t]
        out = np.empty(codes.T.shape, np.int64)
        out[-1] = score.argmax(1)
        for t in range(len(e) - 2, -1, -1):
            out[t] = np.take_along_axis(came[t], out[t + 1][:, None], 1)[:, 0]
        return out.T

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) that the network finds in each text."""
        coded = [symbols(t) for t in texts]
        cut = [windows(c) for c in coded]
        sizes = [len(s) for _, s in cut]
        if not sum(sizes):
            return [[] for _ in texts]
        every = np.concatenate([w for w, _ in cut])
        tags = np.concatenate([self.decode(every[k : k + 2048]) for k in range(0, len(every), 2048)])
        out, at = [], 0
        depth = np.minimum(np.arange(LENGTH), LENGTH - 1 - np.arange(LENGTH))
        for codes, (_, starts), n in zip(coded, cut, sizes):
            own, at = tags[at : at + n], at + n
            best, tag = np.full(len(codes) + LENGTH, -1), np.zeros(len(codes) + LENGTH, np.int64)
            for shift in range(LENGTH // STRIDE):  # windows of one residue don't overlap
                part = starts // STRIDE % (LENGTH // STRIDE) == shift
                index = starts[part][:, None] + np.arange(LENGTH)
                # the first and the last window of a text have no neighbour on one side; ties go to the later residue
                deeper = depth >= best[index]
                best[index] = np.where(deeper, depth, best[index])
                tag[index] = np.where(deeper, own[part], tag[index])
            tag = tag[: len(codes)]
            kind = (tag + 1) // 2
            begin = np.flatnonzero((kind > 0) & ((tag % 2 == 1) | (np.r_[0, kind[:-1]] != kind)))
            found = []
            for b in begin.tolist():
                e = b + 1
                while e < len(tag) and tag[e] == 2 * kind[b]:
                    e += 1
                if TRIGGER[codes[b:e]].any():
                    found.append((int(kind[b]) - 1, b, e))
            out.append(found)
        return out


AT, DOT = re.compile(r"@|[(\[]at[)\]]"), re.compile(r"\.|[(\[]dot[)\]]")


def plausible(kind: int, hit: str) -> bool:
    """What a found span must have to be added: an email one @ (or its name in brackets) and a dot after it, a number as many
    digits as its kind has, a card its check digit."""
    digits = re.sub("[^0-9]", "", hit)
    if kind == 0:
        parts = AT.split(hit)
        return len(parts) == 2 and bool(re.search("[A-Za-z0-9]", parts[0])) and bool(re.search(r"[A-Za-z0-9]\s*(?:\.|[(\[]dot[)\]])\s*[A-Za-z]{2}", parts[1]))
    if kind == 1:
        numbers = re.findall("[0-9]+", hit)
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits) and not digits == hit
    return 9 <= len(digits) <= 15 and digits != hit and bool(re.fullmatch(r"[0-9+() .-]+", hit))


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A found span without blanks and stops at its ends."""
    while start < end and text[start] in " \t\n.,;:":
        start += 1
    while start < end and text[end - 1] in " \t\n.,;:":
        end -= 1
    return start, end


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """A tagger trained on lines made by rule and on at most FIT_WINDOWS windows in FIT_CHARS code points of each of at most DOCS
    documents (the first by a hash of their ids, one row an id), whose base spans are the labels."""
    rows = common.two_columns(df, id_col, text_col).where("doc_id is not null")
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(DOCS)
    some = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", common.excerpt(F.col("text"), F.col("doc_id"), FIT_CHARS).alias("text"))
    got = sorted(tuple(r) for r in some.groupBy("doc_id").agg(F.min("text")).collect())
    xs, ys = [], []
    for text, spans in made(MADE) + [(t, base_spans(t)) for _, t in got]:
        codes = symbols(text)
        if not len(codes) or not TRIGGER[codes].any():
            continue
        x, starts = windows(codes)
        some = np.unique(np.linspace(0, len(starts) - 1, min(FIT_WINDOWS, len(starts))).astype(int))
        x, starts = x[some], starts[some]
        spans = [s for s in spans if not any(o[0] < s[0] and o[1] < s[2] and s[1] < o[2] for o in spans)]
        tags = np.r_[tags_of(len(codes), spans), np.zeros(LENGTH, np.int64)]
        xs.append(x)
        ys.append(tags[starts[:, None] + np.arange(LENGTH)])
    net = Tagger()
    net.train(np.concatenate(xs), np.concatenate(ys))
    return net


def clear(found: list[tuple[int, int, int]], own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The found spans that overlap none of one's own, by kind and start; both lists are walked once, by place."""
    out, ends, k = [], 0, 0
    own = sorted((a, b) for _, a, b in own)
    for kind, start, end in sorted(found, key=lambda s: s[1]):
        while k < len(own) and own[k][0] < end:
            ends, k = max(ends, own[k][1]), k + 1
        if start >= ends:
            out.append((kind, start, end))
    return sorted(out)


SCHEMA = "doc_id long, base array<struct<kind: int, start: int, end: int>>, added array<struct<kind: int, start: int, end: int>>"


def find_pii(df: DataFrame, net: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: spans of the patterns, and those of the network that overlap none of them, for every row of df.

    Places are in code points, ends exclusive, by kind (email, ip, card, phone) and start. Null texts count as empty; repeated
    rows give repeated results; null ids stay null; an empty table gives an empty result; other columns are not read. Narrow.
    """
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    shown = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches):
            data, offsets = common.buffers(block.column("text"))
            total = np.r_[0, np.cumsum(SIGNS[data])]
            some = np.flatnonzero(total[offsets[1:]] > total[offsets[:-1]]).tolist()
            texts = block.column("text").take(pa.array(some, pa.int64())).to_pylist()
            base, added = [[] for _ in range(block.num_rows)], [[] for _ in range(block.num_rows)]
            for row, text, found in zip(some, texts, net.spans(texts)):
                own = base_spans(text)
                base[row] = shown(own)
                found = [(k, *trimmed(text, a, b)) for k, a, b in found]
                added[row] = shown(clear([s for s in found if plausible(s[0], text[s[1] : s[2]])], own))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(base, kind), pa.array(added, kind)], ["doc_id", "base", "added"])

    return common.two_columns(df, id_col, text_col).mapInArrow(run, SCHEMA)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = find_pii(docs, fit(docs))
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    shown = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", lambda x, k=k: x["kind"] == k)).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(F.concat("base", "added")).alias("spans"))
