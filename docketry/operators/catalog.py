"""Catalog queries over metadata tables: filters, sorts, searches, facets, enrichment. All narrow but for sorts and distincts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import eng_to_hangul, nfc


def law_filter(laws: DataFrame, category: str | None = None, department: str | None = None, bookmarks: DataFrame | None = None) -> DataFrame:
    """Laws of a category and a department that are bookmarked; a condition that is None doesn't hold anything back."""
    if category is not None:
        laws = laws.where(F.col("category") == category)
    if department is not None:
        laws = laws.where(F.array_contains("departments", department))
    return laws if bookmarks is None else laws.join(bookmarks.select("id").distinct(), "id", "left_semi")


def equal_filter(table: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns have the wanted values (rulings by case_type and court_name, rules by rule_type and agency or region)."""
    for column, value in wanted.items():
        if value is not None:
            table = table.where(F.col(column) == value)
    return table


def title_search(table: DataFrame, query: str, columns: tuple[str, ...] = ("title",)) -> DataFrame:
    """Rows that hold the query in one of the columns, in either case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(query.lower()))
    return table.where(hit)


def composed_search(table: DataFrame, query: str, column: str = "title") -> DataFrame:
    """Rows that hold the query, composed canonically, or what its keys give on the Hangul layout."""
    import unicodedata

    text = nfc(F.lower(F.col(column)))
    wanted = [unicodedata.normalize("NFC", q) for q in (query.lower(), eng_to_hangul(query)) if q]
    hit = F.lit(False)
    for q in wanted:
        hit = hit | F.contains(text, F.lit(q))
    return table.where(hit)


def by_date(table: DataFrame, date: str, *names: str) -> DataFrame:
    """Newest first, rows without a date last, then by names."""
    return table.orderBy(F.desc(date), *names)


def facets(table: DataFrame, column: str, many: bool = False) -> DataFrame:
    """Distinct values that aren't empty, sorted; many: of an array column."""
    value = (F.explode(column) if many else F.col(column)).alias("value")
    return table.select(value).where("value != ''").distinct().orderBy("value")


def enrich(laws: DataFrame, cache: DataFrame, columns: tuple[str, ...], arrays: tuple[str, ...] = ()) -> DataFrame:
    """Laws with what a cache (by id) knows of them: its values, where not empty, stand for theirs."""
    known = cache.select("id", *[F.col(c).alias(f"_{c}") for c in (*columns, *arrays)])
    out = laws.join(known, "id", "left")
    new: dict[str, Column] = {c: F.coalesce(F.nullif(f"_{c}", F.lit("")), c) for c in columns}
    new |= {c: F.when(F.size(f"_{c}") > 0, F.col(f"_{c}")).otherwise(F.col(c)) for c in arrays}
    return out.withColumns(new).drop(*[f"_{c}" for c in (*columns, *arrays)])


def to_fetch(laws: DataFrame, cache: DataFrame) -> DataFrame:
    """Laws that the cache doesn't have."""
    return laws.join(cache.select("id").distinct(), "id", "left_anti")


def ranked(ranks: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a table for ids with a rank, in rank order."""
    return ranks.join(table, key).orderBy("rank", key)
