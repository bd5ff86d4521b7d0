"""Secret scan in native expressions: pattern hits, and character Markov models of random strings against identifiers.

Positions of pattern hits come from splitting a text at them: the lengths of what stands between and of the hits, summed. Long
tokens that no pattern hits are scored by the log-likelihood ratio of two first-order character models; their transitions are
counted by DataFrame aggregation over labelled samples and the table of ratios, whose size the alphabet fixes, is a literal. The
least ratio of a secret is set on samples that were not counted. Ordinary samples are joined as identifiers, paths, names in camel
case, with versions, dates and numbers; random ones are drawn by rule in the usual alphabets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import common

#: Fixed patterns of the base kinds. A failing hit takes its characters with it, so only equivalent bounds are put in.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Tokens that the models judge: long, with a letter and a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[+/_-]*[0-9+/_-]*[A-Za-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
#: Documents whose words and pattern hits are labelled samples (a bound of the fit only), and random strings made by rule.
SAMPLE_DOCS, SAMPLE_RANDOM = 400, 3000
#: Code points of a sampled document, at a place that its id gives (a bound of the fit only).
SAMPLE_CHARS = 1 << 16
#: Largest share of ordinary held-out samples that the threshold may take for secrets.
FALSE_SHARE = 0.002
RUN = 256
#: Fixed labelled samples of ordinary words in identifiers, beside the words of the sampled documents.
ORDINARY = """account action address agent amount array author backup batch block buffer build button cache callback channel
check class client cluster code column command commit compute config connection container content context control count create
current cursor data database date default delete depth deploy detail device directory document domain driver element email enable
encode engine entry error event example export factory field file filter final find flag folder format frame function gateway global
group handler header height history host image import index info init input instance item job key label language layer length level
library limit line link list load local lock logger lookup manager map master matrix max memory merge message method metric migration
min mode model module monitor name network node number object offset option order output package page param parent parse password path
payload permission phase pipeline plugin point policy port prefix price process product profile project property provider proxy query
queue range read record region register release remote report request resource response result retry role root route row rule sample
schedule schema scope script search section segment select sequence server service session setting shard size sort source stack stage
start state status step storage stream string structure style summary suffix support switch sync system table target task template test
text thread time title token tool total trace transform tree type unit update upload user utility value vector version view volume warning
watch weight width window worker write zone"""


def running(sizes: Column) -> Column:
    """Sums of what stands before each element; in groups, so that the work stays near linear in long arrays."""
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda g: F.slice(sizes, g * RUN + 1, RUN))
    empty = F.array().cast("array<bigint>")

    def sums(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), empty.alias("out"))
        return F.aggregate(values, first, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    totals = F.transform(groups, lambda g: F.aggregate(g, F.lit(0).cast("bigint"), lambda a, x: a + x))
    return F.when(F.size(sizes) > 0, F.flatten(F.zip_with(groups, sums(totals, F.lit(0).cast("bigint")), sums))).otherwise(empty)


#: Fields in the order in which spans are sorted.
SPAN = "array<struct<start:bigint,kind:int,end:bigint,hit:string>>"


def spans_of(text: Column, pattern: str, kind: int, probe: Column) -> Column:
    """Array of (start, kind, end, hit) in code points of all hits; texts for which the cheap probe is false have none."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), lambda x: F.length(x).cast("bigint"))
    sizes = F.transform(hits, lambda x: F.length(x).cast("bigint"))
    both = F.zip_with(gaps, sizes, lambda g, s: g + s)
    found = F.zip_with(F.zip_with(running(both), gaps, lambda b, g: b + g), hits, lambda s, h: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(h)).cast("bigint").alias("end"), h.alias("hit")))
    return F.when(probe, found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def base_spans(df: DataFrame) -> DataFrame:
    """df (doc_id, text) with the arrays assign, access and hex of the spans that meet their bounds."""
    text = F.col("text")
    value = lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 1)) >= 8
    assign = spans_of(text, ASSIGN, 0, text.rlike("(?i:passw|secret|token|api_?key)"))
    return df.withColumns({"assign": F.filter(assign, value), "access": spans_of(text, ACCESS, 1, text.contains("AKIA")), "hex": spans_of(text, HEX, 2, text.rlike(HEX))})


def samples(df: DataFrame) -> DataFrame:
    """(token, secret): labelled samples. Secrets: what the patterns hit in a bounded sample of documents, and strings made by
    rule from hashes in the usual alphabets; others: the remaining words of those documents and a fixed list of them, alone and
    joined in the usual ways."""
    spark = df.sparkSession
    chosen = df.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    some = df.join(F.broadcast(chosen), "doc_id", "left_semi").withColumn("text", common.excerpt(F.col("text"), F.col("doc_id"), SAMPLE_CHARS))
    docs = base_spans(common.written(some, "secret-samples"))
    hits = docs.select(F.explode(F.concat("assign", "access", "hex")).alias("x")).select(F.regexp_extract(F.col("x.hit"), "([A-Za-z0-9+/_-]{16,})[^A-Za-z0-9+/_-]*$", 1).alias("token")).where("token != ''")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.regexp_extract_all(rest, F.lit("(?<![A-Za-z0-9])[A-Za-z]{2,}(?![A-Za-z0-9])"), F.lit(0))
    common_words = spark.createDataFrame([(ORDINARY.split(),)], "w array<string>").select(F.expr("flatten(transform(sequence(0, 19), k -> transform(w, (x, i) -> w[pmod(i * (2 * k + 1) + k, size(w))])))").alias("w"))
    words = docs.select(words.alias("w")).union(common_words)
    alone = words.select(F.explode("w").alias("token"))
    # runs of four words, a number made of their hash, and a number of ways to join them
    runs = words.select(F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.size("w") + 1), lambda k: k + 4 <= F.size("w")), lambda k: F.slice("w", k, 4))).alias("w"))
    runs = runs.select("w", F.pmod(F.xxhash64("w"), F.lit(1_000_003)).alias("h"))
    low, n = F.transform("w", F.lower), F.col("h")
    camel = F.array_join(F.transform("w", F.initcap), "")
    number = F.pmod(n, F.lit(10) ** F.pmod(n, F.lit(4)) + 1).cast("int").cast("string")
    day = F.concat_ws("/", (1990 + n % 45).cast("string"), F.lpad((1 + n % 12).cast("string"), 2, "0"), F.lpad((1 + n % 28).cast("string"), 2, "0"))
    ways = [
        F.concat(F.array_join(low, "_"), number), F.concat(F.array_join(low, "-"), F.lit("-"), number), F.concat(F.array_join(low, "/"), number), F.concat(F.element_at(low, 1), camel, number),
        F.concat(F.concat_ws("/", F.slice(low, 1, 3)), F.lit("/"), camel, number), F.concat(F.array_join(F.transform("w", F.upper), "_"), F.lit("_"), number), F.concat(F.array_join(low, "-"), F.lit("-v"), number, F.lit("-"), number),
        F.concat(F.element_at(low, 1), F.lit("/"), day, F.lit("/"), F.upper(F.element_at("w", 2)), F.lit("_"), F.regexp_replace(day, "/", ""), F.lit("_"), F.lpad(n.cast("string"), 6, "0")),
        F.concat(F.lit("v"), number, F.lit("/"), F.concat_ws("/", F.slice(low, 1, 2)), F.lit("_"), number, F.lit("-"), F.element_at(low, 3)), F.concat(camel, F.lit("V"), number, F.element_at("w", 1)), F.concat(F.array_join(low, ""), number),
        F.concat(F.regexp_replace(day, "/", "-"), F.lit("_"), F.concat_ws("-", F.slice(low, 1, 3))), F.concat(F.element_at(low, 1), F.lit("_"), F.regexp_replace(day, "/", ""), F.lit("_"), F.lpad(n.cast("string"), 6, "0")),
    ]
    joined = runs.select(F.element_at(F.array(*ways), (F.pmod(F.xxhash64("w", F.lit(7)), F.lit(len(ways))) + 1).cast("int")).alias("token"))
    made = spark.range(SAMPLE_RANDOM).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    b64 = F.regexp_replace(F.base64(F.unhex("h")), "=", "")
    plain = F.regexp_replace(b64, "[^A-Za-z0-9]", "")
    uuid = F.regexp_replace("h", "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")
    made = made.select(F.explode(F.array("h", b64, plain, F.translate(b64, "+/", "-_"), F.upper(F.substring(plain, 1, 24)), F.lower(F.substring(plain, 8, 28)), uuid)).alias("token"))
    return hits.union(made).withColumn("secret", F.lit(True)).union(alone.union(joined).withColumn("secret", F.lit(False)))


@dataclass(frozen=True)
class Model:
    """The log-likelihood ratio of each transition, row by row over the alphabet, and the least mean of a secret."""

    table: tuple[float, ...]
    threshold: float


def fit(labelled: DataFrame) -> Model:
    """Ratios from the counts of nine tenths of the labelled tokens, with one added to each; the threshold from the rest: of the
    values that at most FALSE_SHARE of the ordinary candidates reach, the one with the best balance of both kinds' errors.

    Aggregations leave two counts for each of the alphabet's pairs, and for each hundredth of a ratio, which is what comes to the
    driver.
    """
    n = len(ALPHABET)
    held = F.pmod(F.xxhash64("token", F.lit(1)), F.lit(10)) == 0
    long = labelled.where(~held & (F.length("token") > 1))
    pairs = long.select("secret", F.explode(F.expr("transform(sequence(1, length(token) - 1), i -> substring(token, i, 2))")).alias("pair"))
    pairs = pairs.select("secret", F.expr(f"locate(substring(pair, 1, 1), '{ALPHABET}')").alias("a"), F.expr(f"locate(substring(pair, 2, 1), '{ALPHABET}')").alias("b")).where("a > 0 and b > 0")
    counts = {s: [1.0] * (n * n) for s in (False, True)}
    for r in pairs.groupBy("secret", "a", "b").count().collect():
        counts[r.secret][(r.a - 1) * n + r.b - 1] += r["count"]
    out = []
    for row in range(n):
        yes, no = (counts[s][row * n : row * n + n] for s in (True, False))
        out += [round(math.log(y / sum(yes)) - math.log(x / sum(no)), 4) for y, x in zip(yes, no)]
    table = tuple(out)
    tried = labelled.where(held).where(F.regexp_extract("token", CANDIDATE, 0) == F.col("token"))
    shares: dict[bool, dict[int, int]] = {False: {}, True: {}}
    for r in tried.groupBy("secret", F.floor(ratio(F.col("token"), table) * 100).cast("int").alias("at")).count().collect():
        shares[r.secret][r["at"]] = r["count"]
    above = lambda s, at: sum(c for k, c in shares[s].items() if k >= at) / max(sum(shares[s].values()), 1)
    able = [at for at in range(-200, 400) if above(False, at) <= FALSE_SHARE]
    best = max(able, key=lambda at: (above(True, at) - above(False, at), -at), default=75)
    ties = [at for at in able if above(True, at) - above(False, at) == above(True, best) - above(False, best)]
    return Model(table, sum(ties) / max(len(ties), 1) / 100 if ties else best / 100)


def ratio(token: Column, table: tuple[float, ...]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    n = len(ALPHABET)
    cells = F.array(*[F.lit(x) for x in table])
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: F.element_at(cells, a * n + b + 1))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.size(steps)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, text, assign, access, hex and markov: arrays of (start, kind, end, hit) in code points, for every row of df.

    Null texts count as empty; repeated rows give repeated results; rows with null ids are scanned too; an empty table gives an
    empty result; other columns are not read. Narrow but for the fit: no shuffle of texts, no Python.
    """
    docs = common.two_columns(df, id_col, text_col)
    return with_markov(base_spans(docs), model or fit(samples(docs)))


def masked(text: Column, pattern: str, ok: Column) -> Column:
    """The text with as many blanks for each hit of a pattern that is wanted (ok: of the hits, which are)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    cover = F.zip_with(parts, F.transform(hits, lambda h: F.when(ok(h), F.repeat(F.lit(" "), F.length(h))).otherwise(h)), lambda p, h: F.concat(p, F.coalesce(h, F.lit(""))))
    return F.array_join(cover, "")


def with_markov(found: DataFrame, model: Model) -> DataFrame:
    """Rows of base_spans with the array markov: long tokens that look random, in what the base spans leave of the text: these are
    blanked out before tokens are read, so no list of spans is held against another."""
    text = F.col("text")
    for pattern, spans, ok in ((ASSIGN, "assign", lambda h: F.length(F.regexp_extract(h, ASSIGN, 1)) >= 8), (ACCESS, "access", lambda h: F.lit(True)), (HEX, "hex", lambda h: F.lit(True))):
        text = F.when(F.size(spans) > 0, masked(text, pattern, ok)).otherwise(text)
    able = F.col("text").rlike("[A-Za-z0-9+/_-]{20}")
    rows = found.withColumn("_left", F.when(able, text).otherwise(F.lit("")))
    token = spans_of(F.col("_left"), CANDIDATE, 3, able)
    return rows.withColumn("markov", F.filter(token, lambda x: ratio(x["hit"], model.table) >= model.threshold)).drop("_left")


def redacted(mark: str = "[REDACTED]") -> Column:
    """The text of a row of find_secrets with every span, overlapping ones as one, replaced by a mark."""
    spans = F.array_sort(F.concat("assign", "access", "hex", "markov"))
    first = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.greatest(x["start"] - a["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text")))
    return F.when(F.size(spans) > 0, F.aggregate(spans, first, step, rest)).otherwise(F.col("text"))


def redact(df: DataFrame, mark: str = "[REDACTED]", id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """The rows of df, with all columns, every secret in the text replaced by a mark; null texts stay null. No Python."""
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = model or fit(samples(common.two_columns(df, id_col, text_col)))
    found = with_markov(base_spans(row), model)
    new = F.when(F.col(f"row.`{text_col}`").isNotNull(), redacted(mark))
    return found.withColumn("new", new).select(*[F.col("new").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in df.columns])


NAMES = ["assign", "access", "hex", "markov"]


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    name = lambda x: F.element_at(F.array(*map(F.lit, NAMES)), x["kind"] + 1)
    shown = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.concat("assign", "access", "hex")
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.concat(base, F.col("markov"))).alias("spans"))
