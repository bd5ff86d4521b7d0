"""Cached tables with an age: versions in a folder, of which the last one counts while it is fresh."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3600
#: Fixed ages in seconds after which a table is stale; None: never by age.
AGES = {"enriched": 168 * HOUR, "precedents": 24 * HOUR, "persons": 168 * HOUR, "content": 24 * HOUR, "citations": None}


def put(df: DataFrame, root: str, name: str, now: float | None = None) -> None:
    """Stores a table as a new version; readers see it when it is complete, and the one before until then."""
    stamp = int((time.time() if now is None else now) * 1000)
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/version={stamp}")


def get(spark: SparkSession, root: str, name: str, now: float | None = None, count: int | None = None) -> DataFrame | None:
    """The last version of a table; None if there is none, if it is too old, or (count) if it was made of another number of rows."""
    try:
        rows = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    except AnalysisException:
        return None
    last = rows.agg(F.max("version")).first()[0]
    age = AGES[name]
    if last is None or age is not None and (time.time() if now is None else now) - last / 1000 > age:
        return None
    rows = rows.where(F.col("version") == last).drop("version")
    return None if count is not None and rows.count() != count else rows
