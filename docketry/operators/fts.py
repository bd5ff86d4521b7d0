"""BM25 full-text search: a term, phrase and prefix query language, an inverted index, scoring with column weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Weights of path, title and body.
WEIGHTS = {"filepath": 1.5, "title": 4.0, "body": 1.0}
WORDS = r"[\p{L}\p{N}\p{Co}]+"


@dataclass(frozen=True)
class Term:
    """A phrase of one or more words; prefix: its last word may go on; negated: documents with it are left out."""

    words: tuple[str, ...]
    prefix: bool = False
    negated: bool = False


def parse_query(text: str) -> list[Term]:
    """Terms between blanks and commas: `-x` negates, `x*` is a prefix; what isn't a letter or digit parts a term into a phrase."""
    import regex

    out = []
    for raw in text.replace(",", " ").split(" "):
        negated, rest = raw.startswith("-"), raw.removeprefix("-")
        prefix, rest = rest.endswith("*"), rest.removesuffix("*")
        words = tuple(regex.findall(WORDS, rest.lower()))
        if words:
            out.append(Term(words, prefix, negated))
    return out


def build_query_string(text: str) -> str:
    """The query in the syntax of full-text engines: terms with signs of that syntax are quoted."""
    out = []
    for raw in text.replace(",", " ").split(" "):
        negated, rest = raw.startswith("-"), raw.removeprefix("-")
        prefix, rest = rest.endswith("*"), rest.removesuffix("*")
        if rest:
            quoted = '"' + rest.replace('"', '""') + '"' if any(c in rest for c in '-():"+^{}') else rest
            out.append("-" * negated + quoted + "*" * prefix)
    return " ".join(out)


def porter(word: str) -> str:
    """The stem of an English word by Porter's five steps; other words come back as they are."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word

    def consonant(w: str, i: int) -> bool:
        return w[i] not in "aeiou" and not (w[i] == "y" and i > 0 and consonant(w, i - 1))

    def measure(w: str) -> int:
        kinds = [consonant(w, i) for i in range(len(w))]
        return sum(not a and b for a, b in zip(kinds, kinds[1:]))

    def vowel(w: str) -> bool:
        return any(not consonant(w, i) for i in range(len(w)))

    def cvc(w: str) -> bool:
        n = len(w)
        return n >= 3 and consonant(w, n - 1) and not consonant(w, n - 2) and consonant(w, n - 3) and w[-1] not in "wxy"

    def double(w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1)

    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")) or measure(w) == 1 and cvc(w):
                        w += "e"
                    elif double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"

    def swap(w: str, pairs: str, least: int) -> str:
        for pair in sorted(pairs.split(), key=lambda p: -len(p.split(":")[0])):
            end, new = pair.split(":")
            if w.endswith(end):
                return w[: -len(end)] + new if measure(w[: -len(end)]) > least else w
        return w

    w = swap(w, "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble", 0)
    w = swap(w, "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:", 0)
    for end in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if measure(w) > 1 and double(w) and w.endswith("l") else w


def words(c: Column) -> Column:
    """Words of a text, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0))


def stemmed(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """docs with the given columns as their words, without Latin marks and stemmed (Spark has neither function)."""
    import unicodedata

    def fold(word: str) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFD", word) if not 0x300 <= ord(c) < 0x370)
        return porter(unicodedata.normalize("NFC", plain))

    kinds = ", ".join(f"`{f.name}` {'array<string>' if f.name in columns else f.dataType.simpleString()}" for f in docs.schema.fields)
    ready = docs.withColumns({c: words(F.col(c)) for c in columns})

    class Stems(dict):
        def __missing__(self, word: str) -> str:
            self[word] = fold(word)
            return self[word]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Stems()
        for b in batches:
            for c in columns:
                k = b.schema.get_field_index(c)
                lists = b.column(k).to_pylist()
                new = pa.array([None if x is None else [known[w] for w in x] for x in lists], pa.list_(pa.string()))
                b = b.set_column(k, c, new)
            if len(known) > 500_000:
                known.clear()
            yield b

    return ready.mapInArrow(run, kinds)


def postings(docs: DataFrame, id_col: str = "id", columns: tuple[str, ...] = ("body",), stem: bool = False) -> DataFrame:
    """The inverted index (term, id, col, pos, dl): one row for each word of a document; dl: its words over all columns."""
    ready = stemmed(docs.select(id_col, *columns), columns) if stem else docs.select(id_col, *[words(F.col(c)).alias(c) for c in columns])
    sizes = sum((F.coalesce(F.size(c), F.lit(0)) for c in columns), F.lit(0))
    parts = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("w")) for c in columns])
    rows = ready.select(id_col, sizes.alias("dl"), F.explode(parts).alias("p"))
    return rows.select(id_col, "dl", F.col("p.col").alias("col"), F.posexplode_outer("p.w").alias("pos", "term")).where("term is not null")


def _hits(c: Column, term: Term) -> Column:
    """How often a phrase is in an array of words."""
    n = len(term.words)

    def here(x: Column, i: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(term.words):
            at = x if k == 0 else F.try_element_at(c, (i + k + 1).cast("int"))
            ok = ok & F.coalesce(at.startswith(w) if term.prefix and k == n - 1 else at == w, F.lit(False))
        return ok

    return F.size(F.filter(c, here))


def stemmed_term(t: Term) -> Term:
    """A term of stems; the last word of a prefix stays as it is."""
    return Term(tuple(porter(w) for w in t.words[:-1]) + (t.words[-1] if t.prefix else porter(t.words[-1]),), t.prefix, t.negated)


def part(n: Column, df: Column, f: Column, dl: Column, avg: Column) -> Column:
    """What a term adds to a document's BM25; idf is held above 0 as full-text engines do."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avg))


def search(docs: DataFrame, query: str, id_col: str = "id", columns: dict[str, float] | None = None, limit: int | None = 100, where: Column | None = None, stem: bool = False) -> DataFrame:
    """(id, bm25, score): the documents that hold every term and no negated one, best first, ties by id.

    For tables without a stored index (plans.text_index): the texts are read for the figures and for the result. Figures are of the
    whole table, `where` restricts the result before the limit. No hits: no rows.
    """
    weights = columns or {"body": 1.0}
    terms = parse_query(query)
    wanted = [t for t in terms if not t.negated]
    if not wanted:
        return docs.select(id_col, F.lit(0.0).alias("bm25"), F.lit(0.0).alias("score")).limit(0)
    if stem:
        terms = [stemmed_term(t) for t in terms]
        wanted = [t for t in terms if not t.negated]
    keep = F.lit(True) if where is None else where
    cols = tuple(weights)
    base = docs.select(id_col, keep.alias("_ok"), *cols)
    ready = stemmed(base, cols) if stem else base.select(id_col, "_ok", *[words(F.col(c)).alias(c) for c in cols])
    hits = {f"_n{k}": sum((_hits(F.col(c), t) for c in cols), F.lit(0)) for k, t in enumerate(terms)}
    freq = {f"_f{k}": sum((_hits(F.col(c), t) * float(w) for c, w in weights.items()), F.lit(0.0)) for k, t in enumerate(wanted)}
    counted = ready.select(id_col, "_ok", sum((F.size(c) for c in cols), F.lit(0)).alias("_dl"), *[v.alias(k) for k, v in (hits | freq).items()])
    place = [k for k, t in enumerate(terms) if not t.negated]
    figures = counted.agg(F.count("*").alias("_N"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_n{k}") > 0).alias(f"_df{j}") for j, k in enumerate(place)])
    ok = F.col("_ok")
    for k, t in enumerate(terms):
        ok = ok & (F.col(f"_n{k}") == 0 if t.negated else F.col(f"_n{k}") > 0)
    score = F.lit(0.0)
    for j in range(len(wanted)):
        score = score + part(F.col("_N"), F.col(f"_df{j}"), F.col(f"_f{j}"), F.col("_dl"), F.col("_avg"))
    out = counted.where(ok).join(F.broadcast(figures)).select(id_col, score.alias("bm25"))
    out = out.withColumn("score", F.col("bm25") / (1 + F.col("bm25"))).orderBy(F.desc("bm25"), id_col)
    return out if limit is None else out.limit(limit)
