"""Stored vector tables: declared like virtual tables, kept as partitioned Parquet, searched flat or in two stages over stored codes.

Rows lie by generation, version and partition keys. The first version of a generation is its base; later ones hold rows that were
added, changed or deleted since (a deletion is a row without a vector). Reads take the base without the keys that later versions
have, and the last of those, so what is aggregated and sent is what changed since the last compaction, not the table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import vector as V
from docketry.operators import knn

#: Fixed limits of a declaration.
MOST_DIMS, MOST_K, MOST_PARTITIONS, MOST_OTHERS = 8192, 4096, 4, 16
TYPES = {"text": "string", "integer": "bigint", "int": "bigint", "float": "double", "boolean": "boolean", "blob": "binary"}
KINDS = {"float": "array<float>", "int8": "array<tinyint>", "bit": "binary"}
METRICS = {"float": ("l2", "l1", "cosine"), "int8": ("l2", "l1", "cosine"), "bit": ("hamming",)}


@dataclass
class Declaration:
    """Columns of a vector table."""

    vector: str
    dims: int
    kind: str = "float"
    metric: str = "l2"
    index: str = "flat"
    quantizer: str = "bit"
    oversample: int = 8
    search_list: int = 128
    chunk_size: int = 1024
    key: str = "id"
    key_type: str = "bigint"
    partitions: dict[str, str] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)
    auxiliary: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> dict[str, str]:
        code = {"_code": "binary" if self.quantizer == "bit" else "array<tinyint>"} if self.index != "flat" else {}
        return {self.key: self.key_type, self.vector: KINDS[self.kind], **self.metadata, **self.auxiliary, **code, **self.partitions}

    @property
    def schema(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in self.columns.items())


def declare(text: str) -> Declaration:
    """Reads `embedding float[64] distance_metric=cosine indexed by rescore(quantizer=int8, oversample=16), id integer primary key,
    lang text partition key, +note text, size integer, chunk_size=512`: vector (float, int8 or bit), key, partition, auxiliary (+) and
    metadata columns. `indexed by diskann(search_list_size=128)` is the approximate index over bit codes: what the graph would visit
    is a list of that length."""
    out = Declaration("", 0)
    for part in (p.strip() for p in re.split(r",(?![^(]*\))", text)):
        if m := re.fullmatch(r"(?i)(\w+)\s+(float|int8|bit)\[(\d+)\](.*)", part):
            out.vector, out.kind, out.dims = m[1], m[2].lower(), int(m[3])
            out.metric = "hamming" if out.kind == "bit" else "l2"
            if metric := re.search(r"(?i)distance_metric\s*=\s*(\w+)", m[4]):
                out.metric = metric[1].lower()
            if index := re.search(r"(?i)indexed\s+by\s+(\w+)\s*(?:\(([^)]*)\))?", m[4]):
                out.index = index[1].lower()
                for name, value in re.findall(r"(\w+)\s*=\s*(\w+)", index[2] or ""):
                    option(out, name.lower(), value.lower())
        elif m := re.fullmatch(r"(?i)chunk_size\s*=\s*(\d+)", part):
            out.chunk_size = int(m[1])
        elif m := re.fullmatch(r"(?i)(\+?)(\w+)\s+(\w+)\s*(primary key|partition key)?", part):
            kind = TYPES.get(m[3].lower())
            if kind is None:
                raise ValueError(f"unknown type {m[3]}")
            if (m[4] or "").lower() == "primary key":
                out.key, out.key_type = m[2], kind
            else:
                (out.partitions if m[4] else out.auxiliary if m[1] else out.metadata)[m[2]] = kind
        else:
            raise ValueError(f"can't read {part!r}")
    if not 0 < out.dims <= MOST_DIMS or out.metric not in METRICS[out.kind] or out.index not in ("flat", "rescore", "diskann"):
        raise ValueError("dimensions, metric or index out of range")
    if out.kind == "bit" and out.dims % 8 or out.kind != "float" and out.index != "flat" or out.index != "flat" and out.dims % 8:
        raise ValueError("bit vectors and codes need a multiple of 8 dimensions, codes a float vector")
    if out.chunk_size <= 0 or out.chunk_size % 8:
        raise ValueError("chunk_size must be a multiple of 8")
    if len(out.partitions) > MOST_PARTITIONS or max(len(out.metadata), len(out.auxiliary)) > MOST_OTHERS:
        raise ValueError("too many columns")
    return out


def option(about: Declaration, name: str, value: str) -> None:
    """Sets an option of an index; unknown names and values out of range are errors."""
    if name == "quantizer" and value in ("bit", "binary", "int8") and about.index == "rescore":
        about.quantizer = "int8" if value == "int8" else "bit"
    elif name == "oversample" and value.isdigit() and 0 < int(value) <= 128:
        about.oversample = int(value)
    elif name == "search_list_size" and value.isdigit() and 0 < int(value) <= MOST_K and about.index == "diskann":
        about.search_list = int(value)
    elif name not in ("neighbor_quantizer", "n_neighbors", "buffer_threshold") or about.index != "diskann":
        raise ValueError(f"can't set {name} to {value}")


class VectorTable:
    """A stored table; versions have rising numbers, and one that is written again replaces itself."""

    def __init__(self, spark: SparkSession, path: str, text: str):
        self.spark, self.path, self.about = spark, path.rstrip("/"), declare(text)

    def state(self) -> tuple[int, list[int]]:
        """The last generation and its versions, from the folders' names."""
        try:
            seen = self.spark.read.parquet(f"{self.path}/rows").select("_gen", "_version").distinct().collect()
        except AnalysisException:
            return 0, []
        last = max((r["_gen"] for r in seen), default=0)
        return last, sorted(r["_version"] for r in seen if r["_gen"] == last)

    def checked(self, rows: DataFrame) -> DataFrame:
        """Rows with their codes; a vector of another size or with what isn't finite is an error when it is written."""
        a, v = self.about, F.col(self.about.vector)
        good = F.octet_length(v) * 8 == a.dims if a.kind == "bit" else (F.size(v) == a.dims) & ~F.exists(v, lambda x: x.isNull() | (F.isnan(x) | (F.abs(x) == float("inf")) if a.kind == "float" else F.lit(False)))
        rows = rows.withColumn(a.vector, F.when(v.isNull() | good, v).otherwise(F.raise_error(F.lit("bad vector")).cast(KINDS[a.kind])))
        if a.index != "flat":
            rows = rows.withColumn("_code", F.when(v.isNotNull(), self.code(F.col(a.vector))))
        return rows.select(*[F.col(c).cast(t).alias(c) for c, t in a.columns.items()])

    def code(self, v: Column) -> Column:
        return V.vec_quantize_binary(v, True) if self.about.quantizer == "bit" else V.vec_quantize_int8(v)

    def put(self, rows: DataFrame, gen: int, version: int) -> None:
        target = f"{self.path}/rows/_gen={gen}/_version={version}"
        rows.write.mode("overwrite").partitionBy(*self.about.partitions).parquet(target)

    def append(self, rows: DataFrame, version: int) -> None:
        """Adds or replaces rows; a key that is there must keep its partition keys."""
        if self.about.partitions and self.state()[1]:
            old = self.read().select(self.about.key, *[F.col(c).alias(f"_{c}") for c in self.about.partitions])
            moved = F.lit(False)
            for c in self.about.partitions:
                moved = moved | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
            if not rows.join(old, self.about.key).where(moved).isEmpty():
                raise ValueError("a row can't move to another partition: delete it first")
        self.put(self.checked(rows), self.state()[0], version)

    def delete(self, keys: DataFrame, version: int) -> None:
        gone = self.read().join(keys.select(self.about.key).distinct(), self.about.key, "left_semi")
        self.put(self.checked(gone.withColumn(self.about.vector, F.lit(None).cast(KINDS[self.about.kind]))), self.state()[0], version)

    def compact(self) -> None:
        """Writes what is live as the base of a new generation."""
        gen, versions = self.state()
        if versions:
            self.put(self.read(), gen + 1, versions[-1])

    def command(self, text: str) -> None:
        """`name=value` sets an option of later searches; `compact` compacts."""
        if text.strip().lower() == "compact":
            self.compact()
        else:
            name, _, value = text.partition("=")
            option(self.about, name.strip().lower(), value.strip().lower())

    def read(self, among: dict[str, object] | None = None) -> DataFrame:
        """The live rows; among: values of partition keys, whose folders alone are read."""
        gen, versions = self.state()
        if not versions:
            return self.spark.createDataFrame([], self.about.schema)
        rows = self.spark.read.schema(f"{self.about.schema}, _gen int, _version bigint").parquet(f"{self.path}/rows").where(F.col("_gen") == gen)
        for c, value in (among or {}).items():
            if c not in self.about.partitions:
                raise ValueError(f"{c} is no partition key")
            rows = rows.where(F.col(c) == value)
        names, key = list(self.about.columns), self.about.key
        base = rows.where(F.col("_version") == versions[0]).select(*names)
        if len(versions) > 1:
            later = rows.where(F.col("_version") > versions[0])
            last = later.groupBy(key).agg(F.max_by(F.struct(*[c for c in names if c != key]), "_version").alias("r")).select(key, "r.*").select(*names)
            base = base.join(later.select(key).distinct(), key, "left_anti").unionByName(last)
        return base.where(F.col(self.about.vector).isNotNull())

    def search(self, query, k: int, where: Column | None = None, within: Column | None = None, oversample: int | None = None, among: dict[str, object] | None = None) -> DataFrame:
        """(key, dist): the k nearest that meet the conditions on partition keys (among), columns (where) and dist (within). query: a
        list of numbers, for a bit vector of bytes. With codes, the first stage reads codes and filtered columns only."""
        a = self.about
        if (len(query) * 8 if a.kind == "bit" else len(query)) != a.dims or not 0 < k <= MOST_K:
            raise ValueError("wrong dimensions or k")
        rows = self.read(among)
        rows = rows if where is None else rows.where(where)
        if a.kind == "bit":
            found = rows.select(a.key, V.distance_hamming(F.col(a.vector), F.lit(bytes(query))).alias("dist"))
            return (found if within is None else found.where(within)).orderBy("dist", a.key).limit(k)
        if a.index == "flat" or within is not None:
            return knn.flat(rows, query, k, a.metric, None, within, a.key, a.vector)
        wide = min(max(k * (oversample or a.oversample), a.search_list if a.index == "diskann" else 0), MOST_K)
        asked = self.code(knn.literal(query))
        near = V.distance_hamming(F.col("_code"), asked) if a.quantizer == "bit" else knn.METRICS[a.metric](F.col("_code").cast("array<double>"), asked.cast("array<double>"))
        some = rows.select(a.key, near.alias("_near")).where("_near is not null").orderBy("_near", a.key).limit(wide).select(a.key)
        return knn.flat(self.read(among).join(F.broadcast(some), a.key, "left_semi"), query, k, a.metric, None, None, a.key, a.vector)
