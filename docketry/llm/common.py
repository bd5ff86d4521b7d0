"""What the training-data operators share: reading, Arrow buffers, blocks of bounded size, table folders."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    LIBC = ctypes.CDLL("libc.so.6")
    LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    LIBC = None

#: Text bytes that one step of a Python worker holds at a time (one longer text is a block of its own).
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame) -> None:
    """Bounds what Spark hands to a Python worker at a time by bytes: by rows alone, texts make batches of any size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BLOCK_BYTES))


def two_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, null texts as empty; other columns, whatever their names, are not read."""
    bounded_batches(df)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and len + 1 offsets into them."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def trim() -> None:
    """Gives freed memory back to the system: workers outlive tasks, and what their allocators keep adds up over stages."""
    pa.default_memory_pool().release_unused()
    if LIBC is not None:
        LIBC.malloc_trim(0)


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most so many text bytes, or of one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        total, start = np.cumsum(sizes), 0
        while start < len(sizes):
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
        trim()


def map_blocks(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """step over blocks of (doc_id, text) rows; narrow, so there is no shuffle and a lost task is run again from its input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit):
            yield step(block)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray], limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of df, with all columns, for which keep (of a block's texts, null ones as empty) is true. Narrow."""
    bounded_batches(df)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.compute.fill_null(batch.column(place).cast(pa.large_string()), "")], ["text"])
            at = 0
            for block in blocks([texts], limit):
                yield batch.slice(at, block.num_rows).filter(pa.array(keep(block.column("text")), pa.bool_()))
                at += block.num_rows

    return df.mapInArrow(run, df.schema)


def excerpt(text: Column, id_col: Column, most: int) -> Column:
    """At most so many code points of a text, from a place that a hash of its id gives: for fitting, never for results."""
    over = F.greatest(F.length(text) - most, F.lit(0)) + 1
    return F.substring(text, (F.pmod(F.xxhash64(id_col), over.cast("bigint")) + 1).cast("int"), F.lit(most))


def crc_rest(id_col: Column, by: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(id_col.cast("string").cast("binary")) % by


def crc_rest_py(value: int, by: int) -> int:
    return zlib.crc32(str(value).encode()) % by


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Only a local session (tests), where all is one
    machine, may leave it unset; a cluster without it is an error, since tables in a machine's own folder would be lost or split."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if name:
        return name
    if not spark.conf.get("spark.master", "local").startswith(("local[", "local*")) and spark.conf.get("spark.master", "local") != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return os.path.join(tempfile.gettempdir(), "docketry-checkpoints")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while; then what was there before."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, x in values.items():
            spark.conf.set(k, x)
        yield
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage in a way that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)

