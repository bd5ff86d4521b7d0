"""The corpus pipeline: every stage against brute force on its own input."""

import corpus_pipeline
import pytest
from test_operators import brute_scan, brute_secrets
from test_similarity import brute_firsts

from docketry.llm import common, packing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, SF), "test")
        seen[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()])
        assert name == "packing" or out.columns == columns
        docs = out
    before, after = seen["language ID"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and len(after) >= 0.98 * len(before)
    before, after = seen["near-duplicates"]
    assert sorted(r["doc_id"] for r in after) == sorted(brute_firsts([(r["doc_id"], r["text"]) for r in before])[0])
    before, after = seen["decontamination"]
    bench = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    clean = {d for d, _, n, _ in brute_scan([(r["doc_id"], r["text"]) for r in before], bench) if n == 0}
    assert {r["doc_id"] for r in after} == clean
    before, after = seen["secret scan"]
    assert len(before) == len(after)
    old = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        assert not brute_secrets(r["text"]) and r["n_chars"] == len(r["text"])
        assert brute_secrets(old[r["doc_id"]]) or "[REDACTED]" in r["text"] or r["text"] == old[r["doc_id"]]
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    sizes = {}
    for r in after:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes.values()) and packing.TASK_RANGE > len(sizes)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:3] == ["doc_id", "start", "length"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near-duplicates", "decontamination", "secret scan", "packing"]
    rows = out.collect()
    ids = {r.doc_id for r in common.table(spark, SF, "documents").select("doc_id").collect()}
    assert rows and {r.doc_id for r in rows} <= ids
    at = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0)
        at[r.doc_id] = r.start + r.length
    assert all(at[r.doc_id] == r.doc_tokens for r in rows)


ODD = [
    (1, "hello world and some more words of it " * 9, "en", "x", None), (2, None, None, None, 0), (3, "", "fr", "y", 0), (None, "no id here at all but words that are read", "en", "z", 5), (1, "hello world and some more words of it " * 9, "en", "x", 7),
    (4, "Größe, naïve café und mehr <|endoftext|> don't token=abcdefgh12", "de", "", 1), (5, "long words of a text " * 30000, "en", "x", 2), (6, "\t\n  ", None, "x", 3), (7, "12345 67890", "en", "q", 4), (8, "la vida de las palabras en el agua", "es", "q", 4), (9, "et les mots de la rue dans le pays", "fr", "q", 4),
]


@pytest.mark.parametrize("n", [0, 1, len(ODD)])
def test_odd_rows_go_through(spark, tmp_path, n):
    """Nulls, empty and long texts, repeated rows and ids, extra columns with clashing names, and no rows at all."""
    docs = spark.createDataFrame(ODD[:n], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "word", "fp", "node", "_gone", "root"):
        docs = docs.withColumn(name, docs["source"])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "hello world of another item that is long enough to be ten words"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = common.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, docs, str(tmp_path)), "odd")
        assert out.columns == docs.columns, name
        docs = out
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r.doc_id for r in docs.select("doc_id").collect()]
    assert sorted({str(r.doc_id) for r in rows}) == sorted(set(map(str, kept)))
    if n == len(ODD):
        assert 2 not in kept and 3 not in kept and 6 not in kept and 7 not in kept and {1, 4, 5, None} <= set(kept)
        assert kept.count(1) == 2  # rows that share an id stay together
        assert "abcdefgh12" not in docs.where("doc_id = 4").first().text
