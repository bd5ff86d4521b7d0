"""Registered queries over the whole of their tables."""

import re

import duckdb
import numpy as np
import pytest

from docketry import registry
from docketry.operators import citations

SF = "/root/testdata/sf0.001"


def test_vec_each(spark):
    want = duckdb.sql(f"SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT, round(unnest(embedding)::DOUBLE, 6) FROM '{SF}/embeddings.parquet'").fetchall()
    got = [tuple(r) for r in registry.vec_each(spark, SF).select("vec_id", "rowid", "value").collect()]
    assert max(w[0] for w in want) >= 20 and [g[:2] for g in sorted(got)] == [w[:2] for w in sorted(want)]
    assert np.allclose([g[2] for g in sorted(got)], [w[2] for w in sorted(want)], atol=2e-6)


def test_scan_laws(spark):
    want = duckdb.sql(f"SELECT 'kr/법' || p_partkey || '/법률', '법' || p_partkey, p_brand, (length(p_type) > 0)::INT + 1 FROM '{SF}/part.parquet'").fetchall()
    got = [tuple(r) for r in registry.scan_laws(spark, SF).select("id", "title", "category", "n_departments").collect()]
    assert len(want) > 40 and sorted(got) == sorted(want)


def brute_passage(text):
    return b"passage: " + " ".join(w for w in re.split("[ \n\t\r]+", text) if w).encode()[:2048].rstrip(b" ")


def test_fnv_embed(spark, tmp_path):
    texts = ["short", "two  blanks", " a \n\t b ", "x" * 1500, "word " * 700, "가나다 " * 600, "", "a" * 2038 + "가나"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r["first"], r["last"]) for r in registry.fnv_embed(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        h = 40389
        for c in brute_passage(text):
            h = (h + c) * 403 % 65536
        e = np.array([(h + i) * 403 % 65536 / 65535 - 0.5 for i in range(384)])
        assert got[k] == pytest.approx(tuple((e / np.sqrt((e * e).sum()))[[0, -1]]), abs=2e-6)


def test_match_all_laws(spark):
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    refs = con.execute(f"SELECT id, law_name FROM ({registry.STATUTES})").fetchall()
    laws = {f"법{k}" for (k,) in con.execute("SELECT p_partkey FROM part").fetchall()}
    tiers = {n: "Exact" if n in laws else "OldVersion" if n.removeprefix("구 ") in laws else "Unmatched" for _, n in refs}
    assert {r.law_name: r.match_type for r in registry.match_tiers(spark, SF).collect()} == tiers and tiers["법47"] == tiers["법2"] == "Exact"
    found = {}
    for i, n in refs:
        found.setdefault(i, []).append(tiers[n] != "Unmatched")
    kind = lambda i: "ExactStatuteMatch" if i in found and all(found[i]) else "PartialStatuteMatch" if any(found.get(i, [])) else "CaseRefsOnly" if i % 4 else "AffinityFallback"
    want = {i: kind(i) for (i,) in con.execute("SELECT o_orderkey FROM orders").fetchall()}
    assert {r.id: r.resolution for r in registry.resolution(spark, SF).collect()} == want


def test_tiers(spark):
    names = spark.createDataFrame([("법7",), ("구 법7",), ("법47",), ("구 법47",), ("없는 이름",), ("대법8",)], "law_name string")
    titles = spark.createDataFrame([("법7",), ("새법47",), ("법8",)], "title string")
    got = {r.law_name: (r.match_type, r.law_id) for r in citations.match_laws(names, titles).collect()}
    assert got == {
        "법7": ("Exact", "kr/법7/법률"), "구 법7": ("OldVersion", "kr/법7/법률"), "법47": ("Substring", "kr/새법47/법률"), "구 법47": ("Substring", "kr/새법47/법률"),
        "없는 이름": ("Unmatched", None), "대법8": ("Substring", "kr/법8/법률"),
    }
