"""All queries of the engine and their DuckDB oracles, by name.

Search and vector queries run on `documents` and `embeddings`, catalog queries on the star-schema tables, and extraction queries
on the corpus that docketry.plans.corpus makes of them, where the oracle reads the source columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import frontmatter as FM
from docketry.functions import text as T
from docketry.functions import vector as V
from docketry.operators import catalog, citations, fts, fusion, knn, persons, segments
from docketry.plans import api, corpus, indexing
from docketry.plans.corpus import SYLLABLES, read
from docketry.plans.text_index import TextIndex
from docketry.plans.vector_table import VectorTable
from docketry.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "hybrid_search"


def query(sql: str | None = None):
    """Registers a query by its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def six(c):
    return F.round(c, 6)


# ---- full text ---------------------------------------------------------------------------------------------------------------

TOKENS = r"""tok AS MATERIALIZED (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
cor AS (SELECT count(*) AS n, avg(len(w)) AS a FROM tok)"""


def bm25_sql(hits: list[str], absent: str = "", where: str = "true", limit: int = 100) -> str:
    """BM25 of terms given as SQL counts of their hits in the word list w."""
    counts = ", ".join(f"{h} AS f{k}" for k, h in enumerate(hits))
    dfs = ", ".join(f"sum((f{k} > 0)::INT) AS d{k}" for k in range(len(hits)))
    part = lambda k: f"(CASE WHEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) > 0 THEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) ELSE 1e-6 END) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / a))"
    need = " AND ".join(f"f{k} > 0" for k in range(len(hits)))
    return f"""WITH {TOKENS}, cnt AS (SELECT doc_id, lang, len(w) AS dl, {counts}, {absent or '0'} AS x FROM tok), dfs AS (SELECT {dfs} FROM cnt),
sc AS (SELECT doc_id, {' + '.join(map(part, range(len(hits))))} AS s FROM cnt, dfs, cor WHERE {need} AND x = 0 AND {where} ORDER BY s DESC, doc_id LIMIT {limit})
SELECT doc_id, round(s, 6) AS bm25, round(s / (1 + s), 6) AS score FROM sc"""


def one(word: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{word}'))"


#: Indices that this session has stored, by what they are of.
STORED: dict[tuple, object] = {}


def stored(spark: SparkSession, sf_dir: str, kind: str, make):
    """What make() stores, made once a session and data folder: searches then read the stored tables."""
    key = (spark.conf.get("spark.app.id", ""), sf_dir, kind)
    if key not in STORED:
        STORED[key] = make()
    return STORED[key]


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored index of the documents' texts, unstemmed."""

    def make() -> TextIndex:
        index = TextIndex(spark, scratch(spark, "text-index"), {"text": 1.0}, "doc_id")
        index.add(read(spark, sf_dir, "documents"))
        return index

    return stored(spark, sf_dir, "text", make)


def weighted_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The stored index of three weighted columns, stemmed."""

    def make() -> TextIndex:
        index = TextIndex(spark, scratch(spark, "weighted-index"), fts.WEIGHTS, "doc_id", stem=True)
        path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
        index.add(read(spark, sf_dir, "documents").select("doc_id", path.alias("filepath"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("body")))
        return index

    return stored(spark, sf_dir, "weighted", make)


def shown(found: DataFrame) -> DataFrame:
    return found.select("doc_id", six("bm25").alias("bm25"), six("score").alias("score"))


def searched(spark: SparkSession, sf_dir: str, text: str, **more) -> DataFrame:
    return shown(text_index(spark, sf_dir).search(text, **more))


@query(bm25_sql([one("thing"), one("than")]))
def bm25_search(spark, sf_dir):
    return searched(spark, sf_dir, "thing than")


@query(bm25_sql(["len(list_filter(w, lambda x: starts_with(x, 'worth')))"]))
def bm25_prefix(spark, sf_dir):
    return searched(spark, sf_dir, "worth*")


@query(bm25_sql(["len(list_filter(list_zip(w[:-2], w[2:]), lambda x: x[1] = 'of' AND x[2] = 'the'))"]))
def bm25_phrase(spark, sf_dir):
    return searched(spark, sf_dir, "of-the")


@query(bm25_sql([one("idiot")], absent=one("clown")))
def bm25_not(spark, sf_dir):
    return searched(spark, sf_dir, "idiot -clown")


@query(bm25_sql([one("die")], where="lang = 'de'"))
def bm25_in_collection(spark, sf_dir):
    return searched(spark, sf_dir, "die", among=read(spark, sf_dir, "documents").where("lang = 'de'"))


@query(bm25_sql([one("thing"), one("than")]))
def bm25_scan(spark, sf_dir):
    """The same as bm25_search without an index."""
    return shown(fts.search(read(spark, sf_dir, "documents"), "thing than", "doc_id", {"text": 1.0}))


#: Words of the texts that have the stem of `things`, and what the three columns are.
STEM = "('thing', 'things', 'thinge', 'thinges', 'thinged', 'thinging')"
WEIGHTED = r"""tok AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(source || '/' || doc_id), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(substr(text, 1, 60)), '[\p{L}\p{N}]+') AS b,
regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS c FROM documents), cor AS (SELECT count(*) AS n, avg(len(a) + len(b) + len(c)) AS avg FROM tok)"""


def weighted_sql(test: str) -> str:
    hit = lambda c: f"len(list_filter({c}, lambda x: {test}))"
    return f"""WITH {WEIGHTED}, cnt AS (SELECT doc_id, len(a) + len(b) + len(c) AS dl, {hit('a')} + {hit('b')} + {hit('c')} AS h, 1.5 * {hit('a')} + 4.0 * {hit('b')} + {hit('c')} AS f FROM tok),
dfs AS (SELECT sum((h > 0)::INT) AS d FROM cnt),
sc AS (SELECT doc_id, greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg)) AS s FROM cnt, dfs, cor WHERE h > 0 ORDER BY s DESC, doc_id LIMIT 100)
SELECT doc_id, round(s, 6) AS bm25, round(s / (1 + s), 6) AS score FROM sc"""


@query(weighted_sql(f"x IN {STEM}"))
def bm25_weighted(spark, sf_dir):
    return shown(weighted_index(spark, sf_dir).search("things"))


@query(weighted_sql("starts_with(x, 'wor')"))
def bm25_weighted_prefix(spark, sf_dir):
    return shown(weighted_index(spark, sf_dir).search("wor*"))


@query(r"""SELECT t AS term, count(*) AS n, count(DISTINCT doc_id) AS n_docs, sum(p)::BIGINT AS positions FROM
(SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)) GROUP BY t""")
def postings(spark, sf_dir):
    p = fts.postings(read(spark, sf_dir, "documents"), "doc_id", ("text",))
    return p.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.sum("pos").alias("positions"))


@query(bm25_sql([f"len(list_filter(w, lambda x: x IN {STEM}))"]))
def bm25_stemmed(spark, sf_dir):
    return shown(fts.search(read(spark, sf_dir, "documents"), "things", "doc_id", {"text": 1.0}, stem=True))


# ---- vectors -----------------------------------------------------------------------------------------------------------------

QUERY = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)"


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    e = read(spark, sf_dir, "embeddings")
    return e, list(e.where("vec_id = 7").select("embedding").first()[0])


def knn_sql(f: str, where: str = "true", within: str = "true", k: int = 10) -> str:
    return f"SELECT vec_id, round(dist, 6) AS dist FROM (SELECT vec_id, {f}(embedding::DOUBLE[], {QUERY}) AS dist FROM embeddings WHERE {where}) WHERE {within} ORDER BY dist, vec_id LIMIT {k}"



def near(spark, sf_dir, metric="l2", **more):
    e, q = asked(spark, sf_dir)
    return knn.flat(e, q, 10, metric, **more).select("vec_id", six("dist").alias("dist"))


@query(knn_sql("list_distance"))
def knn_l2(spark, sf_dir):
    return near(spark, sf_dir)


@query(knn_sql("list_cosine_distance"))
def knn_cosine(spark, sf_dir):
    return near(spark, sf_dir, "cosine")


@query(f"SELECT vec_id, round(dist, 6) AS dist FROM (SELECT vec_id, list_sum(list_transform(list_zip(embedding::DOUBLE[], {QUERY}), lambda x: abs(x[1] - x[2]))) AS dist FROM embeddings) ORDER BY dist, vec_id LIMIT 10")
def knn_l1(spark, sf_dir):
    return near(spark, sf_dir, "l1")


@query(knn_sql("list_distance", "label < 4"))
def knn_filtered(spark, sf_dir):
    return near(spark, sf_dir, where=F.col("label") < 4)


@query(f"SELECT label, vec_id, round(dist, 6) AS dist, rank::INT AS rank FROM (SELECT label, vec_id, dist, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rank FROM (SELECT label, vec_id, list_distance(embedding::DOUBLE[], {QUERY}) AS dist FROM embeddings)) WHERE rank <= 3")
def knn_partition(spark, sf_dir):
    e, q = asked(spark, sf_dir)
    return knn.by_partition(e, q, 3, ["label"]).select("label", "vec_id", six("dist").alias("dist"), "rank")


@query(knn_sql("list_distance", within="dist > 1.0 AND dist <= 1.35"))
def knn_distance_range(spark, sf_dir):
    return near(spark, sf_dir, within=(F.col("dist") > 1.0) & (F.col("dist") <= 1.35))


@query(knn_sql("list_distance", "vec_id IN (1, 7, 30, 31, 99, 250, 444)"))
def knn_rowid_in(spark, sf_dir):
    return near(spark, sf_dir, where=F.col("vec_id").isin(1, 7, 30, 31, 99, 250, 444))


@query(f"""WITH c AS (SELECT vec_id, embedding, list_sum(list_transform(list_zip(embedding, {QUERY}), lambda x: ((x[1] >= 0) != (x[2] >= 0))::INT)) AS h FROM embeddings ORDER BY h, vec_id LIMIT 80)
SELECT vec_id, round(list_distance(embedding::DOUBLE[], {QUERY}), 6) AS dist FROM c ORDER BY list_distance(embedding::DOUBLE[], {QUERY}), vec_id LIMIT 10""")
def rescore_knn(spark, sf_dir):
    e, q = asked(spark, sf_dir)
    return knn.rescore(e, q, 10).select("vec_id", six("dist").alias("dist"))


BYTES = "list_transform({}::DOUBLE[], lambda x: least(greatest(trunc((x + 1.0) / (2.0 / 255.0) - 128.0), -128), 127))"


@query(f"""WITH c AS (SELECT vec_id, embedding FROM (SELECT vec_id, embedding, list_distance({BYTES.format('embedding')}, {BYTES.format(QUERY)}) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 80)
SELECT vec_id, round(list_distance(embedding::DOUBLE[], {QUERY}), 6) AS dist FROM c ORDER BY list_distance(embedding::DOUBLE[], {QUERY}), vec_id LIMIT 10""")
def rescore_knn_int8(spark, sf_dir):
    e, q = asked(spark, sf_dir)
    return knn.rescore(e, q, 10, quantizer="int8").select("vec_id", six("dist").alias("dist"))


def element(c: str, at: int = 3):
    return F.element_at(c, at)


@query(f"SELECT vec_id, round(embedding[3]::DOUBLE + {QUERY}[3], 6) AS added, round(embedding[3]::DOUBLE - {QUERY}[3], 6) AS subbed FROM embeddings")
def vec_add_sub(spark, sf_dir):
    e, q = asked(spark, sf_dir)
    both = e.select("vec_id", V.vec_add(F.col("embedding"), knn.literal(q)).alias("a"), V.vec_sub(F.col("embedding"), knn.literal(q)).alias("s"))
    return both.select("vec_id", six(element("a")).alias("added"), six(element("s")).alias("subbed"))


@query("SELECT vec_id, len(embedding[3:6])::INT AS n, round(list_sum(embedding[3:6]::DOUBLE[]), 6) AS total FROM embeddings")
def vec_slice(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", V.vec_slice(F.col("embedding"), 2, 6).alias("v"))
    return e.select("vec_id", F.size("v").alias("n"), six(V.total(F.col("v").cast("array<double>"))).alias("total"))


@query("SELECT vec_id, round(embedding[3]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS third FROM embeddings")
def vec_normalize(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", six(element(V.vec_normalize(F.col("embedding")))).alias("third"))


@query("SELECT vec_id, len(embedding)::INT AS n, 'float32' AS kind FROM embeddings")
def vec_length_type(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", V.vec_length(F.col("embedding")).alias("n"), V.vec_type(dict(e.dtypes)["embedding"]).alias("kind"))


@query("SELECT vec_id, list_sum(list_transform(embedding::DOUBLE[], lambda x: least(greatest(trunc((x + 1.0) / (2.0 / 255.0) - 128.0), -128), 127)))::BIGINT AS total FROM embeddings")
def quantize_int8(spark, sf_dir):
    v = V.vec_quantize_int8(F.col("embedding"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT vec_id, list_sum(list_transform(list_zip(embedding, generate_series(0, 63)), lambda x: CASE WHEN x[1] > 0 AND x[2] < 8 THEN 2 ** x[2] ELSE 0 END))::BIGINT AS first_byte, list_sum(list_transform(embedding, lambda x: (x > 0)::INT))::INT AS ones FROM embeddings")
def quantize_binary(spark, sf_dir):
    b = read(spark, sf_dir, "embeddings").select("vec_id", F.hex(V.vec_quantize_binary(F.col("embedding"))).alias("h"))
    return b.select("vec_id", F.conv(F.substring("h", 1, 2), 16, 10).cast("long").alias("first_byte"), F.bit_count(F.conv("h", 16, -10).cast("long")).alias("ones"))


@query(f"SELECT vec_id, list_sum(list_transform(list_zip(embedding, {QUERY}), lambda x: ((x[1] > 0) != (x[2] > 0))::INT))::INT AS dist FROM embeddings")
def hamming(spark, sf_dir):
    e, q = asked(spark, sf_dir)
    return e.select("vec_id", knn.distance(F.col("embedding"), q, "hamming").alias("dist"))


@query("SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS rowid, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings")
def vec_each(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("rowid", "value")).select("vec_id", "rowid", six(F.col("value").cast("double")).alias("value"))


@query("SELECT vec_id, '[' || list_aggregate(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), 'string_agg', ',') || ']' AS json FROM embeddings")
def vec_to_json(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", V.vec_to_json(F.col("embedding")).alias("json"))


@query("SELECT vec_id, i::INT AS rowid, (embedding[((i // 8) * 8 + 8 - i % 8)::BIGINT] > 0)::INT AS value FROM embeddings, (SELECT unnest(range(0, 64)) AS i)")
def vec_each_bit(spark, sf_dir):
    """Bit vectors are read from the most bit of each byte on."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.explode(V.vec_each(V.vec_bit(V.vec_quantize_binary(F.col("embedding"))), True)).alias("x"))
    return e.select("vec_id", "x.rowid", "x.value")


@query("SELECT vec_id, '[' || list_aggregate(list_transform(embedding[9:24], lambda x: (x > 0)::INT::VARCHAR), 'string_agg', ',') || ']' AS json, 64 AS n FROM embeddings")
def vec_slice_bit(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", V.vec_quantize_binary(F.col("embedding")).alias("b"))
    return e.select("vec_id", V.vec_to_json_bit(V.vec_slice_bit(F.col("b"), 8, 24)).alias("json"), V.vec_length(F.col("b"), True).alias("n"))


INT8 = "list_transform({}::DOUBLE[], lambda x: least(greatest(trunc((x + 1.0) / (2.0 / 255.0) - 128.0), -128), 127)::INT)"
WRAP = "list_sum(list_transform(list_zip({}, list_reverse({})), lambda p: (p[1] {} p[2] + 640) % 256 - 128))::BIGINT"


@query(f"SELECT vec_id, {WRAP.format('q', 'q', '+')} AS added, {WRAP.format('q', 'q', '-')} AS subbed FROM (SELECT vec_id, list_transform({INT8.format('embedding')}, lambda x: (x * 5 + 640) % 256 - 128) AS q FROM embeddings)")
def vec_add_sub_int8(spark, sf_dir):
    """Sums and differences of bytes wrap."""
    q = F.transform(V.vec_quantize_int8(F.col("embedding")), lambda x: (F.pmod(x.cast("int") * 5 + 128, F.lit(256)) - 128).cast("tinyint"))
    e = read(spark, sf_dir, "embeddings").select("vec_id", q.alias("q"))
    whole = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return e.select("vec_id", whole(V.vec_add_int8(F.col("q"), F.reverse("q"))).alias("added"), whole(V.vec_sub_int8(F.col("q"), F.reverse("q"))).alias("subbed"))


def vector_table(spark: SparkSession, sf_dir: str, text: str) -> VectorTable:
    """A stored table of the embeddings, in two versions: the second moves vectors 10 to 19 and deletes 20 to 29."""

    def make() -> VectorTable:
        table = VectorTable(spark, scratch(spark, "vectors"), text)
        e = read(spark, sf_dir, "embeddings")
        e = e if table.about.kind == "float" else e.withColumn("embedding", V.vec_quantize_binary(F.col("embedding")) if table.about.kind == "bit" else V.vec_quantize_int8(F.col("embedding")))
        table.append(e, 1)
        if table.about.kind == "float":
            table.append(e.where("vec_id between 10 and 19").withColumn("embedding", F.transform("embedding", lambda x: -x)), 2)
            table.delete(e.where("vec_id between 20 and 29").select("vec_id"), 3)
        return table

    return stored(spark, sf_dir, text, make)


MOVED = "(SELECT vec_id, label, CASE WHEN vec_id BETWEEN 10 AND 19 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings WHERE vec_id NOT BETWEEN 20 AND 29)"


def from_table(spark, sf_dir, text, **more):
    _, q = asked(spark, sf_dir)
    return vector_table(spark, sf_dir, text).search(q, 10, **more).select("vec_id", six("dist").alias("dist"))


@query(knn_sql("list_distance").replace("FROM embeddings WHERE true)", f"FROM {MOVED} WHERE label = 3)"))
def stored_partition(spark, sf_dir):
    """Only the folder of one partition is read; changed and deleted rows count."""
    return from_table(spark, sf_dir, "embedding float[64], vec_id integer primary key, label integer partition key", among={"label": 3})


@query(f"""WITH c AS (SELECT vec_id, embedding, list_sum(list_transform(list_zip(embedding, {QUERY}), lambda x: ((x[1] >= 0) != (x[2] >= 0))::INT)) AS h FROM {MOVED} ORDER BY h, vec_id LIMIT 80)
SELECT vec_id, round(list_distance(embedding::DOUBLE[], {QUERY}), 6) AS dist FROM c ORDER BY list_distance(embedding::DOUBLE[], {QUERY}), vec_id LIMIT 10""")
def stored_rescore(spark, sf_dir):
    """Two stages over stored sign bits."""
    return from_table(spark, sf_dir, "embedding float[64] indexed by rescore(quantizer=bit), vec_id integer primary key, label integer")


@query(f"""WITH c AS (SELECT vec_id, embedding FROM (SELECT vec_id, embedding, list_distance({INT8.format('embedding')}::DOUBLE[], {INT8.format(QUERY)}::DOUBLE[]) AS d FROM {MOVED}) ORDER BY d, vec_id LIMIT 40)
SELECT vec_id, round(list_distance(embedding::DOUBLE[], {QUERY}), 6) AS dist FROM c ORDER BY list_distance(embedding::DOUBLE[], {QUERY}), vec_id LIMIT 10""")
def stored_rescore_int8(spark, sf_dir):
    return from_table(spark, sf_dir, "embedding float[64] indexed by rescore(quantizer=int8, oversample=4), vec_id integer primary key, label integer")


@query(f"""WITH c AS (SELECT vec_id, embedding, list_sum(list_transform(list_zip(embedding, {QUERY}), lambda x: ((x[1] >= 0) != (x[2] >= 0))::INT)) AS h FROM {MOVED} ORDER BY h, vec_id LIMIT 200)
SELECT vec_id, round(list_distance(embedding::DOUBLE[], {QUERY}), 6) AS dist FROM c ORDER BY list_distance(embedding::DOUBLE[], {QUERY}), vec_id LIMIT 10""")
def stored_approximate(spark, sf_dir):
    """The approximate index: a search list of 200 over stored codes."""
    return from_table(spark, sf_dir, "embedding float[64] indexed by diskann(search_list_size=200), vec_id integer primary key, label integer")


@query(f"SELECT vec_id, list_sum(list_transform(list_zip(embedding, {QUERY}), lambda x: ((x[1] > 0) != (x[2] > 0))::INT))::INT AS dist FROM embeddings WHERE label < 5 ORDER BY dist, vec_id LIMIT 10")
def stored_bits(spark, sf_dir):
    """A table of bit vectors, by hamming distance."""
    _, q = asked(spark, sf_dir)
    octets = bytes(sum((q[8 * i + k] > 0) << k for k in range(8)) for i in range(8))
    return vector_table(spark, sf_dir, "embedding bit[64], vec_id integer primary key, label integer").search(octets, 10, where=F.col("label") < 5)


@query(f"SELECT vec_id, round(list_distance({INT8.format('embedding')}::DOUBLE[], {INT8.format(QUERY)}::DOUBLE[]), 6) AS dist FROM embeddings ORDER BY dist, vec_id LIMIT 10")
def stored_int8(spark, sf_dir):
    """A table of byte vectors."""
    e, _ = asked(spark, sf_dir)
    q = [float(x) for x in e.where("vec_id = 7").select(V.vec_quantize_int8(F.col("embedding")).alias("q")).first().q]
    return vector_table(spark, sf_dir, "embedding int8[64], vec_id integer primary key, label integer").search(q, 10).select("vec_id", six("dist").alias("dist"))


FNV = """list_reduce(list_prepend(40389, list_transform(range(0, octet_length(encode(t))), lambda i: ('0x' || substr(hex(encode(t)), (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda h, c: ((h + c) * 403) % 65536)"""


@query(f"""WITH b AS (SELECT item_id, 'passage: ' || text AS t FROM benchmark WHERE length(text) < 1500 AND text NOT LIKE '%  %'),
v AS (SELECT item_id, {FNV} AS h FROM (SELECT item_id, regexp_replace(trim(regexp_replace(t, '[ \\n\\t\\r]+', ' ', 'g')), '^$', '') AS t FROM b)),
r AS (SELECT item_id, list_transform(range(0, 384), lambda i: ((h + i) * 403) % 65536 / 65535.0 - 0.5) AS e FROM v)
SELECT item_id, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS first, round(e[384] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS last FROM r""")
def fnv_embed(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    e = b.select("item_id", V.fnv_embed(T.passage(F.col("text"))).alias("e"))
    return e.select("item_id", six(element("e", 1)).alias("first"), six(element("e", 384)).alias("last"))


@query(f"""SELECT label AS id, round(max(1 / (1 + dist)), 6) AS score FROM (SELECT vec_id, label, list_distance(embedding::DOUBLE[], {QUERY}) AS dist FROM embeddings ORDER BY dist, vec_id LIMIT 200) GROUP BY label""")
def best_chunk_per_doc(spark, sf_dir):
    e, q = asked(spark, sf_dir)
    chunks = e.select("vec_id", F.col("label").alias("id"), "embedding")
    return knn.best_chunk(knn.flat(chunks, q, 200), chunks).select("id", six("score").alias("score"))


HYBRID = bm25_sql([one("thing"), one("than")]).replace("SELECT doc_id, round(s, 6) AS bm25, round(s / (1 + s), 6) AS score FROM sc", "")


@query(HYBRID + f""", tr AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM sc),
vh AS (SELECT vec_id AS doc_id, list_distance(embedding::DOUBLE[], {QUERY}) AS dist FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY dist, vec_id LIMIT 200),
vr AS (SELECT doc_id, row_number() OVER (ORDER BY dist, doc_id) AS r FROM vh)
SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) AS s FROM (SELECT * FROM tr UNION ALL SELECT * FROM vr) GROUP BY doc_id) ORDER BY s DESC, doc_id LIMIT 20""")
def hybrid_search(spark, sf_dir):
    e, q = asked(spark, sf_dir)
    docs = read(spark, sf_dir, "documents")
    chunks = e.withColumn("doc_id", F.col("vec_id")).join(docs.select("doc_id"), "doc_id", "left_semi")
    return fusion.fused(text_index(spark, sf_dir).search("thing than"), chunks, q, 20, "doc_id").select("doc_id", six("score").alias("score"))


@query(f"""WITH b AS (SELECT item_id, regexp_replace(trim(regexp_replace('passage: ' || text, '[ \\n\\t\\r]+', ' ', 'g')), '^$', '') AS t FROM benchmark), q AS (SELECT 'query: thing than' AS t),
v AS (SELECT item_id, list_transform(range(0, 384), lambda i: (({FNV} + i) * 403) % 65536 / 65535.0::DOUBLE - 0.5) AS e FROM b), w AS (SELECT list_transform(range(0, 384), lambda i: (({FNV} + i) * 403) % 65536 / 65535.0::DOUBLE - 0.5) AS e FROM q),
d AS (SELECT item_id, sqrt(greatest(2 - 2 * list_cosine_similarity(v.e, w.e), 0)) AS dist FROM v, w)
SELECT item_id, round(1 / (1 + dist), 5) AS score FROM d ORDER BY dist, item_id LIMIT 10""")
def question_search(spark, sf_dir):
    """The passages nearest to the embedding of a query's text."""
    passages = read(spark, sf_dir, "benchmark").select(F.col("item_id"), F.col("item_id").alias("id"), V.fnv_embed(T.passage(F.col("text"))).alias("embedding"))
    near = knn.flat(passages, fusion.embedded(spark, "thing than"), 10, id_col="item_id")
    return knn.best_chunk(near, passages, "id", "item_id").select(F.col("id").alias("item_id"), F.round("score", 5).alias("score"))


@query("""WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 50),
b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 50)
SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id""")
def rrf_fusion(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    lists = [fusion.ranks(o.orderBy(F.desc(c), "id").limit(50), c) for c in ("o_totalprice", "o_orderdate")]
    return fusion.rrf(*lists).select("id", six("score").alias("score"))


# ---- indexing ----------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return indexing.fingerprint(read(spark, sf_dir, "documents")).select("doc_id", "hash")


@query("SELECT sha256(text) AS hash, min(length(text))::BIGINT AS n FROM documents GROUP BY 1")
def dedup_content(spark, sf_dir):
    return indexing.content(indexing.fingerprint(read(spark, sf_dir, "documents"))).select("hash", F.length("text").cast("long").alias("n"))


def snapshots(spark, sf_dir):
    """An index of four fifths of the documents, and the files after some were touched, changed or added."""
    d = read(spark, sf_dir, "documents").select(F.lit("docs").alias("collection"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text", F.octet_length("text").cast("long").alias("size"))
    old = indexing.fingerprint(d.where("doc_id % 5 != 0")).select("collection", "path", "size", F.lit(1).cast("long").alias("mtime"), "hash")
    touched, changed = F.col("doc_id") % 7 == 0, F.col("doc_id") % 11 == 0
    new = d.withColumn("text", F.when(changed, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return new.select("collection", "path", "doc_id", "text", F.octet_length("text").cast("long").alias("size"), F.when(touched, 2).otherwise(1).cast("long").alias("mtime")), old


ACTIONS = """WITH old AS (SELECT doc_id, text, strlen(text) AS size FROM documents WHERE doc_id % 5 != 0),
new AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS mtime FROM documents),
act AS (SELECT n.doc_id, CASE WHEN o.doc_id IS NOT NULL AND strlen(n.text) = o.size AND n.mtime = 1 THEN 'skip' WHEN o.text = n.text THEN 'refresh'
WHEN n.text IN (SELECT text FROM old) THEN 'reuse' ELSE 'add' END AS action FROM new n LEFT JOIN old o ON n.doc_id = o.doc_id)"""


@query(ACTIONS + " SELECT doc_id, action FROM act")
def incremental_diff(spark, sf_dir):
    return indexing.changes(*snapshots(spark, sf_dir)).select("doc_id", "action")


@query(ACTIONS + """ SELECT count(*) AS indexed, count(*) FILTER (action IN ('add', 'reuse')) AS added, count(*) FILTER (action = 'skip') AS skipped,
count(*) FILTER (action = 'refresh') AS metadata_refreshed, count(*) FILTER (action != 'skip') AS rehashed FROM act""")
def index_stats(spark, sf_dir):
    return indexing.stats(indexing.changes(*snapshots(spark, sf_dir)))


@query()
def chunk_sizes(spark, sf_dir):
    rows = indexing.fingerprint(read(spark, sf_dir, "documents")).select("doc_id", F.posexplode_outer(indexing.chunks_of(F.col("text").cast("binary"))).alias("seq", "chunk")).where("chunk is not null")
    return rows.select("doc_id", "seq", F.octet_length("chunk").alias("n"))


@query("SELECT doc_id, strlen(text)::BIGINT AS n FROM documents")
def chunks_whole(spark, sf_dir):
    return chunk_sizes(spark, sf_dir).groupBy("doc_id").agg(F.sum("n").alias("n"))


# ---- documents ---------------------------------------------------------------------------------------------------------------

ARTICLES = "SELECT 'kr/법' || p_partkey || '/법률' AS id, unnest(generate_series(1, p_size % 5 + 1)) AS n, p_size % 5 + 1 AS total, p_name, p_partkey FROM part"


@query("SELECT 'kr/법' || p_partkey || '/법률' AS id, '법' || p_partkey AS title, p_brand AS category, p_type || ',부' || p_size AS departments, '2020-01-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS promulgation_date, '시행' AS status FROM part")
def frontmatter_project(spark, sf_dir):
    h = corpus.laws(spark, sf_dir).withColumn("h", FM.parse_frontmatter(F.col("raw")))
    s = lambda k: FM.scalar(F.col("h"), k)
    return h.select("id", s("제목").alias("title"), s("법령구분").alias("category"), F.array_join(FM.values(F.col("h"), "소관부처"), ",").alias("departments"), s("공포일자").alias("promulgation_date"), s("상태").alias("status"))


@query("SELECT 'kr/법' || p_partkey || '/법률' AS id, '법' || p_partkey AS title FROM part")
def title_extract(spark, sf_dir):
    return corpus.laws(spark, sf_dir).select("id", T.extract_title(F.col("raw")).alias("title"))


@query(f"SELECT id, (n - 1)::INT AS idx, '제' || n || '조 (목적' || n || ')' AS label, (2 + 3 * (n - 1))::INT AS line_index FROM ({ARTICLES})")
def articles(spark, sf_dir):
    return segments.extract(corpus.laws(spark, sf_dir), "article").select("id", "idx", "label", "line_index")


@query(f"SELECT id, (n - 1)::INT AS idx, '제' || n || '조 (목적' || n || ')' || chr(10) || p_name || ' 제' || n AS text FROM ({ARTICLES})")
def article_text(spark, sf_dir):
    return segments.extract(corpus.laws(spark, sf_dir), "article").select("id", "idx", "text")


@query(f"""SELECT id, '법' || p_partkey || chr(10) || string_agg('제' || n || '조 (목적' || n || ')' || chr(10) || p_name || ' 제' || n, chr(10) ORDER BY n) AS text FROM ({ARTICLES}) GROUP BY id, p_partkey""")
def full_text(spark, sf_dir):
    return corpus.laws(spark, sf_dir).select("id", T.full_text(F.col("raw")).alias("text"))


@query(f"SELECT id, max(n) FILTER (2 + 3 * (n - 1) <= 6)::INT AS article FROM ({ARTICLES}) GROUP BY id")
def asof_article(spark, sf_dir):
    docs = corpus.laws(spark, sf_dir)
    found = segments.at_line(segments.extract(docs, "article", text=False), docs.select("id", F.lit(6).alias("line")))
    return found.select("id", F.regexp_extract("label", "제([0-9]+)조", 1).cast("int").alias("article"))


@query(f"SELECT id, n::INT AS article, (n % total + 1)::INT AS next_article, ((n + total - 2) % total + 1)::INT AS prev_article FROM ({ARTICLES})")
def next_prev_article(spark, sf_dir):
    number = lambda c: F.regexp_extract(c, "제([0-9]+)조", 1).cast("int")
    return segments.neighbours(segments.extract(corpus.laws(spark, sf_dir), "article", text=False)).select("id", number("label").alias("article"), number("next_label").alias("next_article"), number("prev_label").alias("prev_article"))


@query(f"SELECT id, '제2조 (목적2)' AS label, 5::INT AS line_index FROM ({ARTICLES}) WHERE n = 2")
def article_by_prefix(spark, sf_dir):
    return segments.first_starting(segments.extract(corpus.laws(spark, sf_dir), "article", text=False), "제2조")


@query("""SELECT o_orderkey AS id, unnest(['판시사항'] || CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN ['참조조문'] ELSE [] END ||
CASE WHEN o_orderkey % 4 != 0 THEN ['참조판례'] ELSE [] END || ['판례내용']) AS label FROM orders""")
def sections(spark, sf_dir):
    return segments.extract(corpus.rulings(spark, sf_dir), "section", text=False).select("id", "label")


@query("SELECT o_orderkey AS id, '판시사항' || chr(10) || '[1] ' || o_orderstatus AS text FROM orders")
def section_text(spark, sf_dir):
    return segments.extract(corpus.rulings(spark, sf_dir), "section").where("label = '판시사항'").select("id", "text")


NAME = lambda k: f"substr('{SYLLABLES}', (({k}) % 20 + 1)::BIGINT, 1) || substr('{SYLLABLES}', (({k}) // 20 % 20 + 1)::BIGINT, 1) || substr('{SYLLABLES}', (({k}) // 400 % 20 + 1)::BIGINT, 1)"
PERSONS = f"""SELECT o_orderkey AS id, {NAME('o_custkey')} AS name, 'judge' AS role, '재판장' AS qualifier FROM orders UNION ALL
SELECT o_orderkey, {NAME('o_custkey + 7')}, 'judge', NULL FROM orders UNION ALL SELECT o_orderkey, {NAME('o_orderkey')}, 'attorney', NULL FROM orders UNION ALL
SELECT o_orderkey, {NAME('o_orderkey + 3')}, 'prosecutor', NULL FROM orders"""


def people(spark, sf_dir):
    return persons.extract(corpus.rulings(spark, sf_dir))


@query(f"SELECT id, name, role, coalesce(qualifier, '') AS qualifier FROM ({PERSONS})")
def persons_extract(spark, sf_dir):
    return people(spark, sf_dir).select("id", "name", "role", F.coalesce("qualifier", F.lit("")).alias("qualifier"))


@query(f"SELECT name, count(DISTINCT id) AS n FROM ({PERSONS}) GROUP BY name")
def person_index(spark, sf_dir):
    return persons.by_name(people(spark, sf_dir))


@query(f"SELECT p.id, p.role, o.o_orderpriority AS case_type FROM ({PERSONS}) p JOIN orders o ON p.id = o.o_orderkey WHERE name = '박이김' AND role = 'judge'")
def person_search(spark, sf_dir):
    docs = corpus.rulings(spark, sf_dir)
    return persons.search(persons.extract(docs), "박이김", "judge").join(docs.select("id", "case_type"), "id").select("id", "role", "case_type")


# ---- citations ---------------------------------------------------------------------------------------------------------------

STATUTES = """SELECT l_orderkey AS id, (CASE WHEN l_suppkey % 3 = 0 THEN '구 ' ELSE '' END) || '법' || (l_partkey % 50) AS law_name, '제' || l_linenumber || '조' AS article,
'제' || l_quantity::INT || '항' AS detail, (CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 2 END)::INT AS grp, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""


def statutes(spark, sf_dir):
    return citations.extract_statutes(corpus.rulings(spark, sf_dir))


@query(f"SELECT id, law_name, article, detail, grp FROM ({STATUTES})")
def statute_refs(spark, sf_dir):
    return statutes(spark, sf_dir).select("id", "law_name", "article", "detail", "grp")


@query("""SELECT o_orderkey AS id, '대법원' AS court, year(o_orderdate) || '다' || o_orderkey AS case_number, strftime(o_orderdate, '%Y-%m-%d') AS ruling_date FROM orders WHERE o_orderkey % 4 != 0
UNION ALL SELECT o_orderkey, '헌법재판소', '98헌바' || o_custkey, strftime(o_orderdate, '%Y-%m-%d') FROM orders WHERE o_orderkey % 4 != 0""")
def case_refs(spark, sf_dir):
    return citations.extract_cases(corpus.rulings(spark, sf_dir)).select("id", "court", "case_number", "ruling_date")


def known_laws(spark, sf_dir):
    """Titles of all laws."""
    return corpus.laws(spark, sf_dir).select("title")


MATCHES = """SELECT law_name, CASE WHEN e IS NOT NULL AND law_name NOT LIKE '구 %' THEN 'Exact' WHEN e IS NOT NULL THEN 'OldVersion' WHEN t IS NULL THEN 'Unmatched' ELSE 'Substring' END AS match_type,
'kr/' || coalesce(e, t) || '/법률' AS law_id FROM (SELECT law_name, (SELECT min(title) FROM titles WHERE title = name) AS e, (SELECT min(title) FROM titles WHERE contains(title, name) OR contains(name, title)) AS t
FROM (SELECT DISTINCT law_name, replace(law_name, '구 ', '') AS name FROM (""" + STATUTES + """)), (SELECT 1)) x"""
TITLES = "titles AS (SELECT '법' || p_partkey AS title FROM part)"


@query(f"WITH {TITLES} SELECT * FROM ({MATCHES})")
def match_tiers(spark, sf_dir):
    return citations.match_laws(statutes(spark, sf_dir), known_laws(spark, sf_dir))


@query(f"""WITH {TITLES}, m AS ({MATCHES}), r AS (SELECT id, count(*) AS n, count(m.law_id) AS k FROM ({STATUTES}) s LEFT JOIN m USING (law_name) GROUP BY id)
SELECT o_orderkey AS id, CASE WHEN n = k THEN 'ExactStatuteMatch' WHEN k > 0 THEN 'PartialStatuteMatch' WHEN o_orderkey % 4 != 0 THEN 'CaseRefsOnly' ELSE 'AffinityFallback' END AS resolution
FROM orders LEFT JOIN r ON r.id = o_orderkey""")
def resolution(spark, sf_dir):
    docs = corpus.rulings(spark, sf_dir)
    refs = citations.extract_statutes(docs)
    return citations.resolutions(docs, refs, citations.extract_cases(docs), citations.match_laws(refs, known_laws(spark, sf_dir)))


@query(f"SELECT DISTINCT law_name, article, id FROM ({STATUTES})")
def citation_map(spark, sf_dir):
    return citations.citation_index(statutes(spark, sf_dir))


@query(f"SELECT law_name, count(DISTINCT id) AS n_rulings FROM ({STATUTES}) GROUP BY law_name")
def law_counts(spark, sf_dir):
    return citations.law_counts(citations.citation_index(statutes(spark, sf_dir)))


@query(f"SELECT law_name, article, count(DISTINCT id) AS n_rulings FROM ({STATUTES}) GROUP BY law_name, article")
def article_counts(spark, sf_dir):
    return citations.law_counts(citations.citation_index(statutes(spark, sf_dir)), ("law_name", "article"))


@query(f"SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT id FROM ({STATUTES}) WHERE law_name = '법7' AND article = '제3조')")
def rulings_for_law(spark, sf_dir):
    docs = corpus.rulings(spark, sf_dir)
    return citations.rulings_for(citations.citation_index(citations.extract_statutes(docs)), docs, "법7", "제3조").select("id")


@query(f"SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT id FROM ({STATUTES}) WHERE law_name = '법7')")
def rulings_for_law_fallback(spark, sf_dir):
    docs = corpus.rulings(spark, sf_dir)
    return citations.rulings_for(citations.citation_index(citations.extract_statutes(docs)), docs, "법7", "제99조").select("id")


@query(f"""WITH r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 100)
SELECT law_name, article, arg_min(detail, rank * 100 + (1 - l_linenumber % 2) * 50 + l_linenumber) AS detail, count(*) AS cite_count, count(DISTINCT id) AS ruling_count FROM ({STATUTES}) JOIN r USING (id)
GROUP BY law_name, article ORDER BY cite_count DESC, law_name, article LIMIT 20""")
def cited_laws_ranked(spark, sf_dir):
    best = fusion.ranks(read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id").orderBy(F.desc("o_totalprice"), "id").limit(100), "o_totalprice")
    return citations.cited_in(corpus.rulings(spark, sf_dir), best)


@query(f"""WITH refs AS (SELECT * FROM ({STATUTES})),
cited AS (SELECT id, count(*) FILTER (law_name IN ('법7', '구 법7')) AS f0, count(*) FILTER (article = '제3조') AS f1,
1 + max(l_linenumber % 2) + max(1 - l_linenumber % 2) + sum(3 + (law_name LIKE '구 %')::INT + CASE WHEN l_linenumber = 2 THEN 6 ELSE 0 END) AS words FROM refs GROUP BY id),
cnt AS (SELECT o_orderkey AS id, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1, 26 + len(regexp_extract_all(o_orderpriority, '[A-Z0-9]+')) + CASE WHEN o_orderkey % 4 != 0 THEN 16 ELSE 0 END + coalesce(words, 0) AS dl
FROM orders LEFT JOIN cited ON id = o_orderkey),
dfs AS (SELECT sum((f0 > 0)::INT) AS d0, sum((f1 > 0)::INT) AS d1, count(*) AS n, avg(dl) AS a FROM cnt),
sc AS (SELECT id, greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / a)) + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / a)) AS s
FROM cnt, dfs WHERE f0 > 0 AND f1 > 0),
r AS (SELECT id, row_number() OVER (ORDER BY round(s, 9) DESC, id) AS rank FROM sc QUALIFY rank <= 50)
SELECT law_name, article, arg_min(detail, rank * 100 + (1 - l_linenumber % 2) * 50 + l_linenumber) AS detail, count(*) AS cite_count, count(DISTINCT id) AS ruling_count FROM refs JOIN r USING (id)
GROUP BY law_name, article ORDER BY cite_count DESC, law_name, article LIMIT 20""")
def similarity_search(spark, sf_dir):
    return fusion.similar(corpus.rulings(spark, sf_dir), "법7 제3조", 50)


TYPES = ["", "민사", "형사", "가사", "세무", "일반행정", "특허"]
SUGGESTED = ", ".join(f"('{t}', {k}, '{term}', '{why}')" for t, terms in citations.AFFINITY.items() for k, (term, why) in enumerate(terms, 1))


@query(f"""WITH t(case_type, rank, search_term, reason) AS (VALUES {SUGGESTED})
SELECT o_orderkey AS id, rank::INT AS rank, search_term, reason FROM orders JOIN t ON t.case_type = {TYPES}[o_orderkey % 7 + 1]""")
def affinity(spark, sf_dir):
    """All types, one row in seven of them unknown."""
    kind = F.element_at(F.array(*[F.lit(t or "?") for t in TYPES]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("case_type"))
    return citations.affinity(o).select("id", "rank", "search_term", "reason")


@query(f"""WITH {TITLES}, m AS ({MATCHES}), r AS (SELECT id, count(*) AS n, count(m.law_id) AS k, min(m.law_id) AS first_law FROM ({STATUTES}) s LEFT JOIN m USING (law_name) GROUP BY id)
SELECT o_orderkey AS id, coalesce(n, 0)::INT AS n_refs, coalesce(k, 0)::INT AS n_matched, first_law, (CASE WHEN o_orderkey % 4 != 0 THEN 2 ELSE 0 END)::INT AS n_cases, 2 AS n_suggested,
CASE WHEN n = k THEN 'ExactStatuteMatch' WHEN k > 0 THEN 'PartialStatuteMatch' WHEN o_orderkey % 4 != 0 THEN 'CaseRefsOnly' ELSE 'AffinityFallback' END AS resolution FROM orders LEFT JOIN r ON r.id = o_orderkey""")
def cross_reference(spark, sf_dir):
    rows = citations.cross_reference(corpus.rulings(spark, sf_dir), known_laws(spark, sf_dir))
    laws = F.filter(F.transform("law_matches", lambda x: x["law_id"]), lambda x: x.isNotNull())
    return rows.select("id", F.size("statute_refs").alias("n_refs"), F.size(laws).alias("n_matched"), F.array_min(laws).alias("first_law"), F.size("case_refs").alias("n_cases"), F.size("affinity").alias("n_suggested"), "resolution")


@query(f"""SELECT '법' || p_partkey AS title, count(DISTINCT s.id) AS n_rulings FROM part LEFT JOIN ({STATUTES}) s ON s.law_name = '법' || p_partkey GROUP BY p_partkey""")
def laws_with_counts(spark, sf_dir):
    laws = corpus.laws(spark, sf_dir).select("id", "title")
    return citations.with_counts(laws, citations.citation_index(statutes(spark, sf_dir))).select("title", "n_rulings")


# ---- catalog -----------------------------------------------------------------------------------------------------------------


def parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("category"), F.split("p_type", " ").alias("departments"), F.col("p_size").alias("size"))


@query("SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#4' AND list_contains(string_split(p_type, ' '), 'SMALL')")
def law_filter(spark, sf_dir):
    return catalog.law_filter(parts(spark, sf_dir), "Brand#4", "SMALL").select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def semi_bookmarks(spark, sf_dir):
    return catalog.law_filter(parts(spark, sf_dir), bookmarks=read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("id"))).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_discount < 0.05)")
def anti_uncached(spark, sf_dir):
    return catalog.to_fetch(parts(spark, sf_dir), read(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_discount < 0.05").select(F.col("l_partkey").alias("id"))).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def precedent_filter(spark, sf_dir):
    return catalog.equal_filter(read(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select(F.col("o_orderkey").alias("id"))


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 100")
def list_sorted_date(spark, sf_dir):
    top = catalog.by_date(read(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").limit(100)
    return fusion.ranks(top.withColumnRenamed("o_orderkey", "id"), "o_orderdate")


@query("SELECT DISTINCT unnest(string_split(p_type, ' ')) AS value FROM part")
def facets(spark, sf_dir):
    return catalog.facets(parts(spark, sf_dir), "departments", many=True)


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'hot g')")
def title_search(spark, sf_dir):
    return catalog.title_search(parts(spark, sf_dir), "HOT g").select("id")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN 'x' || p_size ELSE p_brand END AS category, CASE WHEN p_partkey % 3 = 0 AND p_size % 5 = 0 THEN 1 ELSE len(string_split(p_type, ' ')) END::INT AS n FROM part")
def enrich_left_join(spark, sf_dir):
    p = parts(spark, sf_dir)
    cache = p.where("id % 3 = 0").select("id", F.when(F.col("size") % 2 == 0, F.concat(F.lit("x"), F.col("size").cast("string"))).otherwise("").alias("category"), F.when(F.col("size") % 5 == 0, F.array(F.lit("d"))).otherwise(F.array().cast("array<string>")).alias("departments"))
    return catalog.enrich(p, cache, ("category",), ("departments",)).select("id", "category", F.size("departments").alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(nfc_normalize(lower(text)), 'é')")
def nfc_search(spark, sf_dir):
    return catalog.composed_search(read(spark, sf_dir, "documents"), "é", "text").select("doc_id")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<br\\s*/?>', ' ', 'gi'), '\\s+', ' ', 'g'), '^ | $', '', 'g')) AS name FROM pages")
def sanitize_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.sanitize_case_name(F.col("html")).alias("name"))


@query("SELECT * FROM (VALUES ('als', '민'), ('alsqjq', '민법'), ('gksrmf', '한글'), ('rhk', '과'), ('rksk', '가나'), ('r1k', 'ㄱ1ㅏ')) t(keys, hangul)")
def keyboard_hangul(spark, sf_dir):
    rows = spark.createDataFrame([(k,) for k in ("als", "alsqjq", "gksrmf", "rhk", "rksk", "r1k")], "keys string")
    return rows.select("keys", T.hangul_keys(F.col("keys")).alias("hangul"))


@query("SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def ranked_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("oid"), F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("rank"))
    return catalog.ranked(o, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")).select(F.col("oid").alias("id"), F.col("c_name").alias("name"))


# ---- sources, sinks, streams -------------------------------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_distinct(spark, sf_dir):
    from docketry.streaming.ingest import distinct_stream

    source, out, state = (scratch(spark, x) for x in ("events", "distinct", "state"))
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.union(e.where("event_id % 10 = 0")).repartition(4).write.parquet(source)
    rows = spark.readStream.schema(e.schema).parquet(source)
    distinct_stream(rows, "event_id", state, out, "ts", "365 days").awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT source AS collection, count(*) AS n, count(DISTINCT sha256(text)) AS n_contents FROM documents GROUP BY source")
def stream_ingest(spark, sf_dir):
    from docketry.streaming.ingest import index_stream, parquet_stream

    source, root, state = (scratch(spark, x) for x in ("files", "store", "state"))
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("collection"), F.col("doc_id").cast("string").alias("path"), "text", F.octet_length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"))
    d.repartition(2, "path").write.parquet(source)
    store = indexing.Store(spark, root)
    index_stream(parquet_stream(spark, source, d.schema, 1), store, state).awaitTermination()
    return store.documents().groupBy("collection").agg(F.count("*").alias("n"), F.count_distinct("hash").alias("n_contents"))


def small_store(spark: SparkSession, sf_dir: str) -> indexing.Store:
    """A store of the benchmark items as two collections: indexed, then one changed, one gone, one added."""

    def make() -> indexing.Store:
        b = read(spark, sf_dir, "benchmark").select(F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("collection"), F.col("item_id").cast("string").alias("path"), F.concat(F.lit("# item "), F.col("item_id").cast("string"), F.lit("\n"), "text").alias("text"), "item_id")
        rows = lambda d, when: d.select("collection", "path", "text", F.octet_length("text").cast("long").alias("size"), F.lit(when).cast("long").alias("mtime"))
        store = indexing.Store(spark, scratch(spark, "small-store"))
        store.index(rows(b.where("item_id != 5"), 1), 1)
        store.index(rows(b.where("item_id != 2").withColumn("text", F.when(F.col("item_id") == 3, F.concat("text", F.lit(" zebra zebra"))).otherwise(F.col("text"))), 2), 2, tombstones=True)
        return store

    return stored(spark, sf_dir, "store", make)


@query("""SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS collection, count(*) AS n, count(DISTINCT text) AS n_contents FROM (SELECT item_id, text || (CASE WHEN item_id = 3 THEN 'z' ELSE '' END) || item_id AS text FROM benchmark WHERE item_id != 2) GROUP BY 1""")
def store_status(spark, sf_dir):
    """Active documents and contents of each collection."""
    return api.status(small_store(spark, sf_dir)).select("collection", "n", "n_contents")


@query(r"""WITH tok AS MATERIALIZED (SELECT item_id, regexp_extract_all(lower((CASE WHEN item_id % 2 = 0 THEN 'even/' ELSE 'odd/' END) || item_id), '[\p{L}\p{N}]+') || ['item', item_id::VARCHAR, 'item', item_id::VARCHAR] ||
regexp_extract_all(lower(text || (CASE WHEN item_id = 3 THEN ' zebra zebra' ELSE '' END)), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE item_id != 2),
cnt AS (SELECT item_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'zebra')) AS f FROM tok), cor AS (SELECT count(*) AS n, avg(dl) AS a, sum((f > 0)::INT) AS d FROM cnt)
SELECT CASE WHEN item_id % 2 = 0 THEN 'even/' ELSE 'odd/' END || item_id AS id, round(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)), 6) AS bm25 FROM cnt, cor WHERE f > 0""")
def store_search(spark, sf_dir):
    """Text search of the stored index sees the versions that are active, and no others."""
    return small_store(spark, sf_dir).search("zebra").select("id", six("bm25").alias("bm25"))


@query("""SELECT o_orderpriority AS case_type, o_orderstatus AS court_level, count(*) AS n FROM orders GROUP BY ALL""")
def staged_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("case_type"), F.col("o_orderstatus").alias("court_level"))
    return api.staged_counts(rows)


@query("SELECT 'kr/법' || p_partkey || '/법률' AS id, '법' || p_partkey AS title, p_brand AS category, (length(p_type) > 0)::INT + 1 AS n_departments FROM part")
def scan_laws(spark, sf_dir):
    from docketry.sources import files

    root = scratch(spark, "tree") + "/kr"
    write_tree(corpus.laws(spark, sf_dir).select(F.concat("title", F.lit("/법률.md")).alias("path"), "raw"), root)
    return files.laws(files.collected(files.markdown(spark, root), "laws")).select("id", "title", "category", F.size("departments").alias("n_departments"))


def rulings_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, raw): a ruling for each supplier, in two types and two courts, and files that are none."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    kind, level = F.when(F.col("s_suppkey") % 2 == 0, "민사").otherwise("형사"), F.when(F.col("s_suppkey") % 3 == 0, "대법원").otherwise("하급심")
    head = F.concat(F.lit("---\n사건명: 사건<br/>가  "), k, F.lit("\n사건번호: '"), k, F.lit("다1'\n선고일자: 2001-02-03\n법원명:  법원"), F.col("s_nationkey").cast("string"), F.lit("\n법원등급: "), level, F.lit("\n사건종류: "), kind, F.lit("\n판결유형: 판결\n---\n# 글 "), k)
    files = s.select(F.concat(kind, F.lit("/"), level, F.lit("/법원"), F.col("s_nationkey").cast("string"), F.lit("_"), k, F.lit(".md")).alias("path"), head.alias("raw"))
    return files.union(spark.createDataFrame([("README.md", "x"), ("민사/README.md", "x"), ("민사/대법원/더/깊은.md", "---\n사건명: x\n---\n"), ("민사/대법원/글.txt", "x")], "path string, raw string"))


@query("""SELECT CASE WHEN s_suppkey % 2 = 0 THEN '민사' ELSE '형사' END || '/대법원/법원' || s_nationkey || '_' || s_suppkey AS id, '사건 가 ' || s_suppkey AS case_name, s_suppkey || '다1' AS case_number, '2001-02-03' AS ruling_date,
'법원' || s_nationkey AS court_name, '대법원' AS court_level, CASE WHEN s_suppkey % 2 = 0 THEN '민사' ELSE '형사' END AS case_type, '판결' AS ruling_type FROM supplier WHERE s_suppkey % 3 = 0""")
def scan_rulings(spark, sf_dir):
    """Rulings of one court level of a tree, by their headers."""
    from docketry.sources import files

    root = scratch(spark, "rulings")
    write_tree(rulings_tree(spark, sf_dir), root)
    return files.rulings(files.collected(files.markdown(spark, root), "rulings", court_level="대법원")).drop("path")


@query("SELECT '규칙/' || n_nationkey AS id, '훈령' || n_regionkey AS rule_type, n_name AS agency, '광역' || n_regionkey AS region FROM nation")
def scan_rules(spark, sf_dir):
    """Only files of one name, with nested header keys."""
    from docketry.sources import files

    root, k = scratch(spark, "rules"), F.col("n_nationkey").cast("string")
    raw = F.concat(F.lit("---\n종류: 훈령"), F.col("n_regionkey").cast("string"), F.lit("\n기관: "), "n_name", F.lit("\n관할:\n  광역: 광역"), F.col("n_regionkey").cast("string"), F.lit("\n---\n글"))
    n = read(spark, sf_dir, "nation")
    write_tree(n.select(F.concat(F.lit("규칙/"), k, F.lit("/본문.md")).alias("path"), raw.alias("raw")).union(n.select(F.concat(F.lit("규칙/"), k, F.lit("/별표.md")), F.lit("x"))), root)
    return files.rules(files.collected(files.markdown(spark, root), "leaves"), {"rule_type": "종류", "agency": "기관", "region": "광역"}).drop("path")


@query("""SELECT CASE WHEN s_suppkey % 2 = 0 THEN '민사' ELSE '형사' END AS case_type, CASE WHEN s_suppkey % 3 = 0 THEN '대법원' ELSE '하급심' END AS court_level, '법원' || s_nationkey AS court_name, '법원' || s_nationkey || '_' || s_suppkey AS case_number,
'사건<br/>가  ' || s_suppkey AS case_name, '2001-02-03' AS ruling_date FROM supplier""")
def store_catalog(spark, sf_dir):
    """Catalog rows from the paths and first characters of stored documents."""
    from docketry.sources import files

    store = indexing.Store(spark, scratch(spark, "rulings-store"))
    rows = rulings_tree(spark, sf_dir).where("path rlike '_[0-9]+[.]md$'")
    store.index(rows.select(F.lit("precedents").alias("collection"), "path", F.col("raw").alias("text"), F.octet_length("raw").cast("long").alias("size"), F.lit(1).cast("long").alias("mtime")), 1)
    return files.catalog_of_store(store.documents(), store.read("content", store.CONTENT)).drop("id")


@query("SELECT replace(n_name, '/', '_') || ' (' || n_nationkey || '_' || n_regionkey || ').md' AS file, '# ' || n_name AS raw FROM nation")
def export_rulings(spark, sf_dir):
    """A file for each document, named by its name and number."""
    from docketry.sources import files, sinks

    root, n = scratch(spark, "export"), read(spark, sf_dir, "nation")
    number = F.concat_ws("/", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"))
    sinks.export_markdown(n.select(sinks.export_name(F.col("n_name"), number).alias("file"), F.concat(F.lit("# "), "n_name").alias("raw")), root)
    return files.markdown(spark, root).select(F.col("path").alias("file"), "raw")


@query("""SELECT * FROM (VALUES ('hello world', 'hello world'), ('auth -test', 'auth -test'), ('a-b c*', '"a-b" c*'), ('-x-y*', '-"x-y"*'), ('제3조,제4조', '제3조 제4조'), ('법(제5조)', '"법(제5조)"'), ('"q"', '"' || '""q""' || '"')) t(text, query)""")
def query_strings(spark, sf_dir):
    """Queries in the syntax of full-text engines."""
    return spark.createDataFrame([(t, fts.build_query_string(t)) for t in ("hello world", "auth -test", "a-b c*", "-x-y*", "제3조,제4조", "법(제5조)", '"q"')], "text string, query string")


@query("""WITH tok AS MATERIALIZED (SELECT p_partkey AS id, p_type, regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[a-z0-9]+') AS w FROM part),
cnt AS (SELECT id, p_type, len(w) AS dl, len(list_filter(w, lambda x: x = 'hot')) AS f FROM tok), cor AS (SELECT count(*) AS n, avg(dl) AS a, sum((f > 0)::INT) AS d FROM cnt)
SELECT id, round(s, 6) AS bm25 FROM (SELECT id, greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)) AS s FROM cnt, cor WHERE f > 0 AND list_contains(string_split(p_type, ' '), 'SMALL')) ORDER BY s DESC, id LIMIT 50""")
def ranked_titles(spark, sf_dir):
    """Laws by rank in a stored index of titles, categories and departments, held to one department."""
    laws = parts(spark, sf_dir)
    index = stored(spark, sf_dir, "titles", lambda: api.title_index(spark, scratch(spark, "titles"), laws))
    return api.ranked_titles(index, laws, "hot", department="SMALL").select("id", six("bm25").alias("bm25"))


def ruling_rows(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("case_type"), F.col("o_orderstatus").alias("court_name"), F.col("o_orderpriority").alias("case_name"), F.col("o_orderkey").cast("string").alias("case_number"))


@query("SELECT o_orderkey AS id FROM orders WHERE contains(lower(o_orderpriority), '12') OR contains(o_orderkey::VARCHAR, '12') ORDER BY o_orderpriority, o_orderkey LIMIT 50")
def search_precedents(spark, sf_dir):
    """By name or number, the first 50."""
    return api.search_precedents(ruling_rows(spark, sf_dir), "12").select("id")


@query(f"SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT id FROM ({PERSONS}) WHERE name = '박이김') ORDER BY o_orderpriority, o_orderkey LIMIT 20".replace("SELECT DISTINCT", "SELECT"))
def search_precedents_fallback(spark, sf_dir):
    """No ruling has the name in its own; those that name the person are found."""
    return api.search_precedents(ruling_rows(spark, sf_dir), "박이김", people(spark, sf_dir)).select("id")


@query(f"SELECT p.id, p.role FROM ({PERSONS}) p JOIN orders ON p.id = o_orderkey WHERE name = '박이김' AND o_orderstatus = 'F' ORDER BY p.id, role LIMIT 20")
def search_person_filtered(spark, sf_dir):
    return api.search_person(people(spark, sf_dir), ruling_rows(spark, sf_dir), "박이김", court="F").select("id", "role")


@query("SELECT p_partkey AS id FROM part WHERE p_brand != '' ORDER BY (CASE WHEN p_size % 3 = 0 THEN '' ELSE '2020-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') END) DESC, p_name, p_partkey LIMIT 60")
def list_laws_newest(spark, sf_dir):
    """Newest first, those without a date last, then by title."""
    day = F.when(F.col("size") % 3 == 0, "").otherwise(F.concat(F.lit("2020-"), F.lpad((F.col("size") % 12 + 1).cast("string"), 2, "0")))
    return api.list_laws(parts(spark, sf_dir).withColumn("promulgation_date", day), newest=True, limit=60).select("id")


@query(f"SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 5) AS total, list_sum({INT8.format('embedding')})::BIGINT AS total8 FROM embeddings")
def vec_parse(spark, sf_dir):
    """Vectors read from JSON."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", V.vec_f32(F.to_json("embedding")).alias("f"), V.vec_int8(F.to_json(V.vec_quantize_int8(F.col("embedding")))).alias("i"))
    return e.select("vec_id", F.round(V.total(F.col("f").cast("array<double>")), 5).alias("total"), F.aggregate("i", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total8"))


@query(f"SELECT id, law_name, article, detail, grp FROM ({STATUTES})")
def statute_refs_strict(spark, sf_dir):
    return citations.extract_statutes(corpus.rulings(spark, sf_dir), strict=True).select("id", "law_name", "article", "detail", "grp")


def write_tree(rows: DataFrame, root: str) -> None:
    """A file for each row (path, raw), as a checkout would leave them; written by the executors to a folder that they share."""

    def write(part) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for r in part:
            store.create_dir(f"{base}/{r.path}".rpartition("/")[0])
            with store.open_output_stream(f"{base}/{r.path}") as out:
                out.write(r.raw.encode("utf-8"))

    rows.foreachPartition(write)


@query("SELECT to_json({'id': p_partkey, 'title': p_name})::VARCHAR AS value FROM part")
def json_sink(spark, sf_dir):
    from docketry.sources.sinks import json_lines

    return json_lines(parts(spark, sf_dir).select("id", "title"))


@query("SELECT p_partkey || chr(9) || p_name || chr(9) || p_brand || chr(9) || list_aggregate(string_split(p_type, ' '), 'string_agg', ',') AS value FROM part")
def tsv_sink(spark, sf_dir):
    from docketry.sources.sinks import tsv_lines

    return tsv_lines(parts(spark, sf_dir).select("id", "title", "category", "departments"))


@query(f"SELECT id, '= 법' || p_partkey || chr(10) || chr(10) || string_agg('===== 제' || n || '조 (목적' || n || ')' || chr(10) || '*' || p_name || '* 제' || n || chr(10) || chr(10), '' ORDER BY n) AS markup FROM ({ARTICLES}) GROUP BY id, p_partkey")
def markup_sink(spark, sf_dir):
    from docketry.sources.sinks import to_markup

    return corpus.laws(spark, sf_dir).select("id", to_markup(F.col("raw")).alias("markup"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN chr(10) ELSE chr(10) || chr(10) END || '#pad(left: 1em)[① ' || p_name || ' \\$5]' || chr(10) || '#pad(left: 2.5em)[1. *' || replace(p_brand, '#', '\\#') || '*]' || chr(10) || chr(10) ||
'#pad(left: 2.5em)[2.]' || chr(10) || CASE p_size % 3 WHEN 0 THEN '#line(length: 100%)' WHEN 1 THEN '== ' || p_type || ' \\#2' ELSE p_type END || chr(10) || '3. ' || p_mfgr2 || chr(10) AS markup
FROM (SELECT *, p_partkey || ' \\@ x_y' AS p_mfgr2 FROM part)""")
def markup_clauses(spark, sf_dir):
    """Clauses, items, rules and headings without a blank; what ends a clause leaves the item after it plain."""
    from docketry.sources.sinks import to_markup

    line = F.when(F.col("p_size") % 3 == 0, "---").when(F.col("p_size") % 3 == 1, F.concat(F.lit("##"), "p_type", F.lit(" #2"))).otherwise(F.col("p_type"))
    raw = F.concat_ws("\n", F.when(F.col("p_size") % 2 == 1, ""), F.concat(F.lit("① "), "p_name", F.lit(" $5")), F.concat(F.lit("  1. **"), "p_brand", F.lit("**")), F.lit(""), F.lit("2. "), line, F.concat(F.lit("3. "), F.col("p_partkey").cast("string"), F.lit(" @ x_y")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), to_markup(raw).alias("markup"))


@query("""SELECT p_partkey AS id, p_name AS given, '' AS listed, '' AS opened, '' AS missing, p_brand || '|' || p_type AS items, p_name AS single, 1 + (p_size % 2)::INT AS n_listed, 0 AS n_opened FROM part""")
def frontmatter_lists(spark, sf_dir):
    """Lists of one item are lists: they have no scalar; keys without a value are empty scalars."""
    p = read(spark, sf_dir, "part")
    more = F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("\n  - "), "p_type"))
    raw = F.concat(F.lit("---\ngiven: "), "p_name", F.lit("\nlisted:\n- "), "p_brand", F.coalesce(more, F.lit("")), F.lit("\nopened:\nitems:\n- "), "p_brand", F.lit("\n- '"), "p_type", F.lit("'\n---\nbody"))
    h = p.select(F.col("p_partkey").alias("id"), FM.parse_frontmatter(raw).alias("h"))
    s, v = (lambda k: FM.scalar(F.col("h"), k)), (lambda k: FM.values(F.col("h"), k))
    return h.select("id", *[s(k).alias(k) for k in ("given", "listed", "opened", "missing")], F.array_join(v("items"), "|").alias("items"), F.array_join(v("given"), "|").alias("single"), F.size(v("listed")).alias("n_listed"), F.size(v("opened")).alias("n_opened"))
