"""A corpus of markdown documents made from the test tables: the oracles read the source columns, never the markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Syllables that names are made of by index arithmetic.
SYLLABLES = "김이박최정강조윤장임한오서신권황안송류홍"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def person(k: Column) -> Column:
    """A name of three syllables for a number."""
    at = lambda n: F.substring(F.lit(SYLLABLES), (F.pmod(n, F.lit(20)) + 1).cast("int"), F.lit(1))
    return F.concat(at(k), at(F.floor(k / 20)), at(F.floor(k / 400)))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows over all cores: a few megabytes of tables, which would be one task, become many times as much text."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw, …): a statute for each part: header, then as many articles as its size modulo 5 and one."""
    p = spread(read(spark, sf_dir, "part"), "p_partkey")
    name = F.concat(F.lit("법"), _s("p_partkey"))
    article = lambda n: F.concat(F.lit("##### 제"), n.cast("string"), F.lit("조 (목적"), n.cast("string"), F.lit(")\n**"), F.col("p_name"), F.lit("** 제"), n.cast("string"), F.lit("\n\n"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 5 + 1), article), "")
    day = F.concat(F.lit("'2020-01-"), F.lpad(_s(F.col("p_partkey") % 28 + 1), 2, "0"), F.lit("'"))
    head = F.concat(F.lit("---\n제목: "), name, F.lit("\n법령구분: "), F.col("p_brand"), F.lit("\n소관부처:\n- "), F.col("p_type"), F.lit("\n- 부"), _s("p_size"), F.lit("\n공포일자: "), day, F.lit("\n상태: 시행\n---\n"))
    return p.select(F.concat(F.lit("kr/"), name, F.lit("/법률")).alias("id"), F.col("p_partkey").alias("key"), name.alias("title"), F.concat(head, F.lit("# "), name, F.lit("\n\n"), body).alias("raw"))


def rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw): a ruling for each order: its lines are citations of statutes in two groups, its customer and clerk are persons."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    law = F.concat(F.when(F.col("l_suppkey") % 3 == 0, "구 ").otherwise(""), F.lit("법"), _s(F.col("l_partkey") % 50))
    text = F.concat(law, F.when(F.col("l_linenumber") == 2, "(1998. 12. 31. 개정되기 전의 것)").otherwise(""), F.lit(" 제"), _s("l_linenumber"), F.lit("조 제"), _s(F.col("l_quantity").cast("int")), F.lit("항"))
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), text.alias("t")))).alias("ls"))
    d = spread(o.join(lines, o.o_orderkey == lines.l_orderkey, "left"), "o_orderkey")
    some = F.coalesce("ls", F.array().cast("array<struct<n:int,p:bigint,s:bigint,t:string>>"))
    odd = F.array_join(F.transform(F.filter(some, lambda x: x["n"] % 2 == 1), lambda x: x["t"]), ", ")
    even = F.array_join(F.transform(F.filter(some, lambda x: x["n"] % 2 == 0), lambda x: x["t"]), ", ")
    cited = F.concat(F.when(odd != "", F.concat(F.lit("[1] "), odd)).otherwise(""), F.when((odd != "") & (even != ""), " / ").otherwise(""), F.when(even != "", F.concat(F.lit("[2] "), even)).otherwise(""))
    day = F.concat(F.year("o_orderdate").cast("string"), F.lit(". "), F.month("o_orderdate").cast("string"), F.lit(". "), F.dayofmonth("o_orderdate").cast("string"), F.lit("."))
    number = F.concat(F.year("o_orderdate").cast("string"), F.lit("다"), _s("o_orderkey"))
    cases = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("## 참조판례\n\n대법원 "), day, F.lit(" 선고 "), number, F.lit(" 판결(공1998, 12), 헌법재판소 "), day, F.lit(" 98헌바"), _s("o_custkey"), F.lit(" 결정\n\n"))).otherwise("")
    people = F.concat(F.lit("대법관 "), person(F.col("o_custkey")), F.lit("(재판장) "), person(F.col("o_custkey") + 7), F.lit("\n(소송대리인 변호사 "), person(F.col("o_orderkey")), F.lit(" 외 1인)\n【검    사】 "), person(F.col("o_orderkey") + 3), F.lit("\n"))
    raw = F.concat(
        F.lit("---\n사건명: 사건"), _s("o_orderkey"), F.lit("\n사건번호: "), number, F.lit("\n사건종류: "), F.col("o_orderpriority"), F.lit("\n선고일자: '"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("'\n---\n# 사건\n\n## 판시사항\n\n[1] "),
        F.col("o_orderstatus"), F.lit("\n\n"), F.when((odd != "") | (even != ""), F.concat(F.lit("## 참조조문\n\n"), cited, F.lit("\n\n"))).otherwise(""), cases, F.lit("## 판례내용\n\n"), people,
    )
    return d.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("case_type"), raw.alias("raw"))
