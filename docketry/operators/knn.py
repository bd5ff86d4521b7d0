"""Nearest neighbours of a query vector: exact, filtered, by partition, and in two stages over quantised vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import vector as V

METRICS = {"l2": V.distance_l2, "l1": V.distance_l1, "cosine": V.distance_cosine}


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def distance(c: Column, query: list[float], metric: str) -> Column:
    """Distance of a vector column to a query; hamming compares the signs' bits."""
    if metric == "hamming":
        return V.distance_hamming(V.vec_quantize_binary(c), V.vec_quantize_binary(literal(query)))
    return METRICS[metric](c, literal(query))


def flat(table: DataFrame, query: list[float], k: int, metric: str = "l2", where: Column | None = None, within: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dist): the k nearest, ties by id. where: on the table's columns; within: on dist. Both hold before the top k, which
    every task takes of its own rows before they meet."""
    rows = table if where is None else table.where(where)
    rows = rows.select(id_col, distance(F.col(vector_col), query, metric).alias("dist")).where("dist is not null")
    rows = rows if within is None else rows.where(within)
    return rows.orderBy("dist", id_col).limit(k)


def by_partition(table: DataFrame, query: list[float], k: int, keys: list[str], metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of each partition key; tasks keep k rows a key before the shuffle."""
    rows = table.select(*keys, id_col, distance(F.col(vector_col), query, metric).alias("dist")).where("dist is not null")
    w = Window.partitionBy(*keys).orderBy("dist", id_col)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rescore(table: DataFrame, query: list[float], k: int, oversample: int = 8, quantizer: str = "bit", metric: str = "l2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Two stages: the k * oversample nearest (at most 4096) by sign bits or by bytes, then the k nearest of them exactly."""
    wide = min(k * oversample, 4096)
    c = F.col(vector_col)
    if quantizer == "bit":
        coarse = V.distance_hamming(V.vec_quantize_binary(c, True), V.vec_quantize_binary(literal(query), True))
    else:
        coarse = METRICS[metric](V.vec_quantize_int8(c).cast("array<double>"), V.vec_quantize_int8(literal(query)).cast("array<double>"))
    some = table.select(id_col, vector_col, coarse.alias("coarse")).where("coarse is not null").orderBy("coarse", id_col).limit(wide)
    return some.select(id_col, distance(c, query, metric).alias("dist")).orderBy("dist", id_col).limit(k)


def best_chunk(hits: DataFrame, chunks: DataFrame, id_col: str = "id", chunk_col: str = "vec_id") -> DataFrame:
    """(id, score) of documents from hits on chunks: the best chunk's 1 / (1 + distance)."""
    both = hits.join(chunks.select(chunk_col, id_col), chunk_col)
    return both.groupBy(id_col).agg(F.max(1 / (1 + F.col("dist"))).alias("score"))
