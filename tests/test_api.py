"""Commands, stored vector tables, file scans and sinks."""

import re

import pytest
from pyspark.sql import functions as F

from docketry.operators import citations, persons
from docketry.plans import api
from docketry.plans.vector_table import VectorTable, declare
from docketry.sources import files, sinks


@pytest.fixture(scope="module")
def rulings(spark):
    raw = "---\n사건명: {0}\n---\n## 판시사항\n\n글\n\n## 참조조문\n\n{1}\n\n## 판례내용\n\n판사 김철수(재판장)\n"
    rows = [("r1", "민사", "손해배상", "2001다1", "대법원", "2001-02-03", raw.format("손해배상", "민법 제750조")), ("r2", "형사", "사기", "2002도2", "대법원", "", raw.format("사기", "구 형법 제347조, 제30조"))]
    return spark.createDataFrame(rows, "id string, case_type string, case_name string, case_number string, court_name string, ruling_date string, raw string")


def test_commands(spark, rulings):
    laws = spark.createDataFrame([("kr/민법/법률", "민법", "법률", ["법무부"], "1958-02-22"), ("kr/형법/법률", "형법", "법률", ["법무부", "경찰청"], "")], "id string, title string, category string, departments array<string>, promulgation_date string")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(api.list_laws(laws, department="경찰청")) == ["kr/형법/법률"] and ids(api.list_laws(laws, newest=True)) == ["kr/민법/법률", "kr/형법/법률"]
    assert ids(api.search_laws(laws, "민")) == ["kr/민법/법률"] and ids(api.list_precedents(rulings)) == ["r1", "r2"]
    index = persons.extract(rulings)
    assert ids(api.search_precedents(rulings, "2002도", index)) == ["r2"] and sorted(ids(api.search_precedents(rulings, "김철수", index))) == ["r1", "r2"]
    assert [r.label for r in api.precedent_sections(rulings, "r1").collect()] == ["판시사항", "참조조문", "판례내용"]
    assert [(r.article, r.match_type) for r in api.precedent_laws(rulings, laws, "r2").collect()] == [("제347조", "OldVersion"), ("제30조", "OldVersion")]
    assert [r.qualifier for r in api.precedent_persons(rulings, "r1").collect()] == ["재판장"]
    assert ids(api.search_person(index, rulings, "김철수", "judge", case_type="형사")) == ["r2"]
    cited = citations.citation_index(citations.extract_statutes(rulings))
    assert ids(api.law_precedents(cited, rulings, "민법", "제999조")) == ["r1"]
    documents = spark.createDataFrame([("b", "민법"), ("a", "민법")], "path string, title string")
    assert [(r.law_name, r.law_doc_path) for r in api.similar(rulings, documents, "손해배상").collect()] == [("민법", "a")]
    assert api.show(rulings, "r1").first().text.startswith("## 판시사항")


def test_vector_table(spark, tmp_path):
    t = VectorTable(spark, str(tmp_path / "v"), "embedding float[2] distance_metric=l1, id integer primary key, lang text partition key, size integer, +note text")
    rows = lambda x: spark.createDataFrame(x, "id long, embedding array<float>, size long, note string, lang string")
    t.append(rows([(1, [0.0, 0.0], 5, "a", "ko"), (2, [1.0, 0.0], 6, "b", "ko"), (3, [3.0, 3.0], 7, "c", "en")]), 1)
    assert [(r.id, r.dist) for r in t.search([0.0, 0.0], 2).collect()] == [(1, 0.0), (2, 1.0)]
    t.append(rows([(1, [9.0, 9.0], 5, "a", "ko")]), 2)
    t.delete(spark.createDataFrame([(2,)], "id long"), 3)
    assert [r.id for r in t.search([0.0, 0.0], 5).collect()] == [3, 1]
    assert [r.id for r in t.search([0.0, 0.0], 5, where=F.col("lang") == "ko").collect()] == [1]
    pruned = t.search([0.0, 0.0], 5, among={"lang": "ko"})
    assert [r.id for r in pruned.collect()] == [1] and "lang" in re.search(r"PartitionFilters: \[([^\]]*)", pruned._jdf.queryExecution().toString())[1]
    with pytest.raises(ValueError, match="move"):
        t.append(rows([(3, [3.0, 3.0], 7, "c", "ko")]), 4)
    t.command("compact")
    assert t.state()[1] == [3] and [r.id for r in t.search([0.0, 0.0], 5).collect()] == [3, 1]
    t.append(rows([(2, [0.0, 1.0], 6, "b", "en")]), 4)
    t.append(rows([(2, [0.0, 1.0], 6, "b", "en")]), 4)
    assert [r.id for r in t.search([0.0, 0.0], 5).collect()] == [2, 3, 1]
    assert [r.id for r in t.search([0.0, 0.0], 5, within=F.col("dist") < 10).collect()] == [2, 3]
    with pytest.raises(ValueError, match="dimensions"):
        t.search([0.0], 1)
    for bad in ("embedding float[9000]", "embedding bit[12]", "embedding bit[8] distance_metric=l2", "embedding float[8] indexed by tree()", "embedding float[8] indexed by rescore(oversample=0)", "embedding float[8], chunk_size=9"):
        with pytest.raises(ValueError):
            declare(bad)
    about = declare("v float[8] indexed by rescore(quantizer=int8, oversample=16), id integer primary key, chunk_size=64")
    assert (about.quantizer, about.oversample, about.chunk_size) == ("int8", 16, 64)


def test_files_and_sinks(spark, tmp_path):
    root = tmp_path / "kr"
    for name, body in {"민법/법률.md": "---\n제목: 민법\n소관부처:\n- 법무부\n---\n# 민법\n", "민법/시행령.md": "no header", "README.md": "x", "서울/본문.md": "---\n관할:\n  광역: 서울특별시\n---\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body, encoding="utf-8")
    found = files.markdown(spark, str(root))
    assert sorted(r.path for r in found.collect()) == ["민법/법률.md", "민법/시행령.md", "서울/본문.md"]
    laws = {r.id: r for r in files.laws(found).collect()}
    assert laws["kr/민법/법률"].departments == ["법무부"] and laws["kr/민법/시행령"].category == "대통령령" and laws["kr/민법/시행령"].status == "시행"
    assert [r.region for r in files.rules(found, {"region": "광역"}).collect()] == ["서울특별시"]
    assert files.markdown(spark, str(root), head=8).where("path like '%법률.md'").first().raw == "---\n제\ufffd"
    df = spark.createDataFrame([("a/b", "1", ["x", "y"], None)], "name string, number string, d array<string>, e string")
    assert df.select(sinks.export_name(F.col("name"), F.col("number")).alias("f")).first().f == "a_b (1).md"
    assert sinks.tsv_lines(df).first().value == "a/b\t1\tx,y\t" and sinks.json_lines(df).first().value == '{"name":"a/b","number":"1","d":["x","y"]}'
    sinks.export_markdown(df.select(F.lit("one").alias("file"), F.lit("# t").alias("raw")), str(tmp_path / "out"))
    assert (tmp_path / "out" / "one").read_text() == "# t"


def test_trees_are_listed_by_tasks(spark, tmp_path):
    """The driver holds no entry for each file; deep folders, a folder named as the root, odd names and globs."""
    root = tmp_path / "kr"
    raw = {f"법{k}/법률.md": f"---\n제목: 법{k}\n---\n" for k in range(200)} | {"a/kr/c d/e%20f.md": "x", "a/빈.md": "", "a/.git/x.md": "x", ".h/x.md": "x", "_h/x.md": "x", "_k=1/x.md": "y", "a/README.md": "x", "a/b.txt": "x"}
    for name, body in raw.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body, encoding="utf-8")
    (root / "empty").mkdir()
    found = files.markdown(spark, str(root))
    assert len(found.inputFiles()) < 100
    want = {k: v for k, v in raw.items() if k.endswith(".md") and not k.endswith(("README.md", "h/x.md", ".git/x.md"))}
    got = found.collect()
    assert {r.path: r.raw for r in got} == want and len(got) == len(want)
    assert all(r.size == len(want[r.path].encode()) and r.mtime == (root / r.path).stat().st_mtime_ns // 1_000_000 * 1000 for r in got)
    assert sorted(r.path for r in files.markdown(spark, f"file:{root}", "[b-e]?{x,t*}t").collect() + files.markdown(spark, str(root), "{b,c}.t[!y]t").collect()) == ["a/b.txt"] * 2
    assert files.markdown(spark, str(root / "empty")).count() == 0
    with pytest.raises(NotADirectoryError):
        files.markdown(spark, str(root / "gone"))


def test_sync_status_reset(spark, tmp_path):
    from docketry.plans.indexing import Store

    store = Store(spark, str(tmp_path / "store"))
    files = lambda rows: spark.createDataFrame([(p, t, len(t), 1) for p, t in rows], "path string, text string, size long, mtime long")
    api.sync(store, {"laws": files([("a", "# Reed\nwater and reed"), ("b", "# Owl\nnight")]), "admrules": files([("r", "# Rule\nreed")])}, 1)
    got = {r.collection: (r.n, r.last_batch) for r in api.status(store).collect()}
    assert got == {"laws": (2, 1), "admrules": (1, 1)}
    done = {r.collection: (r.changed, r.gone) for r in api.sync(store, {"laws": files([("a", "# Reed\nwater and reed"), ("c", "# Fox\nreeds")])}, 2).collect()}
    assert done == {"laws": (1, 1)}
    once = sorted(r.id for r in store.search("reed").collect())
    assert once == ["admrules/r", "laws/a", "laws/c"]  # stemmed; what is gone is not found
    assert [r.id for r in store.search("night").collect()] == []
    assert sorted(r.id for r in store.search("reed", "laws").collect()) == ["laws/a", "laws/c"]
    assert {r.id for r in api.search(store, "fox").collect()} >= {"laws/c"} and "laws/b" not in {r.id for r in api.search(store, "fox").collect()}
    api.sync(store, {"laws": files([("a", "# Reed\nwater and reed"), ("c", "# Fox\nreeds")])}, 2)  # a batch that runs again
    assert store.read("chunks", store.CHUNKS).count() == 4 and sorted(r.id for r in store.search("reed").collect()) == once
    with pytest.raises(ValueError, match="collections"):
        api.sync(store, {"novels": files([("a", "x")])}, 3)
    with pytest.raises(ValueError, match="needed"):
        api.index_all(store, {"laws": files([("a", "x")])}, 3)
    api.reset(store)
    assert api.status(store).count() == 0 and store.search("reed").count() == 0


def test_cached_tables(spark, tmp_path):
    from docketry.sources import cache

    root, df = str(tmp_path), spark.range(3)
    assert cache.get(spark, root, "enriched") is None
    cache.put(df, root, "enriched", now=1000.0)
    cache.put(spark.range(5), root, "enriched", now=2000.0)
    assert cache.get(spark, root, "enriched", now=2000.0 + 168 * 3600).count() == 5
    assert cache.get(spark, root, "enriched", now=2001.0 + 168 * 3600) is None
    cache.put(df, root, "citations", now=0.0)
    assert cache.get(spark, root, "citations", count=3).count() == 3 and cache.get(spark, root, "citations", count=4) is None


def test_enrich_stream(spark, tmp_path):
    from docketry.streaming.ingest import enrich_stream

    rows = [(f"법{k}/법률.md", f"---\n제목: 법{k}\n소관부처:\n- 청{k}\n---\n") for k in range(5)]
    spark.createDataFrame(rows, "path string, raw string").repartition(3).write.parquet(str(tmp_path / "heads"))
    heads = spark.readStream.schema("path string, raw string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "heads"))
    enrich_stream(heads, str(tmp_path / "known"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "known"))
    assert sorted((r.title, r.departments) for r in got.collect()) == [(f"법{k}", [f"청{k}"]) for k in range(5)]


def test_cross_reference(spark, rulings):
    titles = spark.createDataFrame([("민법",), ("형법",)], "title string")
    got = {r.id: r for r in citations.cross_reference(rulings, titles).collect()}
    assert got["r1"].resolution == "ExactStatuteMatch" and got["r2"].resolution == "ExactStatuteMatch"
    assert [(m.article, m.match_type, m.law_id) for m in got["r2"].law_matches] == [("제347조", "OldVersion", "kr/형법/법률"), ("제30조", "OldVersion", "kr/형법/법률")]
    assert got["r1"].affinity[0].search_term == "민법" and got["r1"].case_refs == []
    none = citations.cross_reference(rulings.withColumn("raw", F.lit("없음")).withColumn("case_type", F.lit(None).cast("string")), titles).first()
    assert none.resolution == "AffinityFallback" and none.law_matches == [] and none.affinity[0].search_term == "헌법"


def test_shared_folder():
    from docketry.session import shared_dir

    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    assert shared_dir(Session(spark_checkpoint_dir="hdfs://x/y", spark_master="yarn")) == "hdfs://x/y"
    assert shared_dir(Session(spark_master="local[8]"))
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(Session(spark_master=master))
