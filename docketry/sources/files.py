"""Scans of markdown trees: laws, rulings, rules and ordinances, with metadata from headers and paths."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.frontmatter import parse_frontmatter, scalar, trimmed, values
from docketry.functions.text import sanitize_case_name
from docketry.session import shared_dir

#: Bytes of files that a task holds at a time, and about those that one task reads.
READ_BYTES, PART_BYTES = 4 << 20, 128 << 20

#: Fixed categories by the name of a law's file.
CATEGORIES = {"법률": "법률", "시행령": "대통령령", "시행규칙": "부령", "대통령령": "대통령령"}


def glob_regex(pattern: str) -> str:
    """A file name's glob (`*`, `?`, `[a-z]`, `[^a]`, `{a,b}`, escapes) as a regular expression."""
    out, k, deep = "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            k += 1
            out += re.escape(pattern[k])
        elif c == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            inner = pattern[k + 1 : end].replace("\\", "\\\\")
            out += f"[^{inner[1:]}]" if inner[0] in "!^" else f"[{inner}]"
            k = end
        elif c in "{}" or (c == "," and deep):
            deep += {"{": 1, "}": -1, ",": 0}[c]
            out += {"{": "(?:", "}": ")", ",": "|"}[c]
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        k += 1
    return out


def entries(store, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, is a folder, size, mtime in microseconds, to a millisecond as Spark has it) of what is in a folder; hidden names are left
    out as by Spark's readers. Local folders are streamed, so one of any number of entries takes no memory."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if not hidden(e.name):
                    at = e.stat()
                    yield e.name, e.is_dir(), at.st_size, at.st_mtime_ns // 1_000_000 * 1000
    else:
        for e in store.get_file_info(fs.FileSelector(folder)):
            if not hidden(e.base_name):
                yield e.base_name, e.type == fs.FileType.Directory, e.size or 0, (e.mtime_ns or 0) // 1_000_000 * 1000


def hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def opened(root: str) -> tuple[object, str]:
    """A folder's file system and its path there, on the driver or in a task."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else os.path.abspath(root))
    return store, base.rstrip("/") or "/"


def listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, size, mtime) of the files below root, dealt over tasks. Tasks list the folders, level by level, into the shared folder: the
    driver holds no entry, however many files there are."""
    about, where, fits = "path string, folder boolean, size long, mtime long", f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}", re.compile(glob_regex(pattern))

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        found = ((f"{folder}/{name}" if folder else name, *rest) for b in batches for folder in b.column(0).to_pylist() for name, *rest in entries(store, f"{base}/{folder}") if rest[0] or fits.fullmatch(name))
        while rows := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["path", "folder", "size", "mtime"])

    level, paths, n_files, n_bytes, folders = spark.createDataFrame([("",)], "path string").coalesce(1), [], 0, 0, 1
    while folders:
        paths.append(f"{where}/{len(paths)}")
        level.mapInArrow(children, about).write.parquet(paths[-1])
        got = spark.read.schema(about).parquet(paths[-1])
        folders, n, size = got.agg(F.count_if("folder"), F.count_if(~F.col("folder")), F.coalesce(F.sum(F.when(~F.col("folder"), F.col("size"))), F.lit(0))).first()
        n_files, n_bytes = n_files + n, n_bytes + size
        level = got.where("folder").select("path").repartition(max(1, min(spark.sparkContext.defaultParallelism, folders)), "path")
    tasks = max(min(spark.sparkContext.defaultParallelism, n_files), n_bytes // PART_BYTES + 1)
    return spark.read.schema(about).parquet(*paths).where("not folder").drop("folder").repartition(tasks, "path")


def markdown(spark: SparkSession, root: str, pattern: str = "*.md", head: int | None = None) -> DataFrame:
    """(path, raw, size, mtime): files below root, paths relative to it. head: only so many first bytes. What isn't
    valid text, as a character that they cut, is replaced. README.md and what is in .git is left out. Files are listed at once and
    read by tasks, some megabytes at a time."""
    from pyarrow import fs

    store, base = opened(root)
    if store.get_file_info(base).type != fs.FileType.Directory:
        raise NotADirectoryError(root)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        for b in batches:
            start, size, held = 0, 0, []
            for k, path in enumerate(b.column("path").to_pylist()):
                with store.open_input_file(f"{base}/{path}") as f:
                    held.append(f.read(head) if head is not None else f.read())
                size += len(held[-1])
                if k + 1 == b.num_rows or size >= READ_BYTES:
                    yield b.slice(start, len(held)).append_column("content", pa.array(held, pa.binary()))
                    start, size, held = k + 1, 0, []

    rows = listed(spark, root, pattern).where(~F.col("path").rlike(r"(^|/)\.git/|(^|/)README\.md$"))
    read = rows.mapInArrow(contents, "path string, size long, mtime long, content binary")
    return read.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("raw"), "size", "mtime")


def collected(files: DataFrame, kind: str, case_type: str | None = None, court_level: str | None = None, leaf: str = "본문.md") -> DataFrame:
    """The files of a kind, in the order of their paths: laws are `kr/{name}/법률.md` (or below kr itself) at that depth only, rulings
    `{case_type}/{court_level}/*.md` (any if None), leaves the files of one name at any depth."""
    part = lambda x: r"[^/]+" if x is None else rf"\Q{x}\E"
    pattern = {"laws": r"^(kr/)?[^/]+/법률\.md$", "rulings": rf"^{part(case_type)}/{part(court_level)}/[^/]+\.md$", "leaves": rf"(^|/)\Q{leaf}\E$"}[kind]
    return files.where(F.col("path").rlike(pattern)).orderBy("path")


def laws(files: DataFrame) -> DataFrame:
    """(id, title, category, departments, two dates, status, path): by path, then what the header has."""
    title, kind = F.regexp_extract("path", "([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)\.md$", 1)
    head = files.withColumn("h", parse_frontmatter(F.col("raw")))
    known = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    given = lambda key, default: F.coalesce(F.nullif(scalar(F.col("h"), key), F.lit("")), default)
    return head.select(
        F.concat_ws("/", F.lit("kr"), title, kind).alias("id"), given("제목", title).alias("title"), given("법령구분", F.coalesce(F.try_element_at(known, kind), kind)).alias("category"), values(F.col("h"), "소관부처").alias("departments"),
        given("공포일자", F.lit("")).alias("promulgation_date"), given("시행일자", F.lit("")).alias("enforcement_date"), given("상태", F.lit("시행")).alias("status"), "path",
    )


def rulings(files: DataFrame) -> DataFrame:
    """Catalog rows of rulings; the id is the path without its ending."""
    head = files.withColumn("h", parse_frontmatter(F.col("raw")))
    s = lambda k: scalar(F.col("h"), k)
    return head.select(
        F.regexp_replace("path", r"\.md$", "").alias("id"), sanitize_case_name(s("사건명")).alias("case_name"), s("사건번호").alias("case_number"), s("선고일자").alias("ruling_date"), trimmed(s("법원명")).alias("court_name"),
        trimmed(s("법원등급")).alias("court_level"), s("사건종류").alias("case_type"), s("판결유형").alias("ruling_type"), "path",
    )


def rules(files: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Catalog rows of documents named 본문.md: a column for each header key; the id is the folder."""
    head = files.where(F.col("path").endswith("본문.md")).withColumn("h", parse_frontmatter(F.col("raw")))
    return head.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("id"), *[scalar(F.col("h"), k).alias(c) for c, k in keys.items()], "path")


def catalog_of_store(documents: DataFrame, content: DataFrame) -> DataFrame:
    """Catalog rows of rulings from stored documents: path parts, and two header keys from the first 500 characters."""
    both = documents.join(content, "hash").select("path", F.substring("text", 1, 500).alias("t"))
    part = F.split("path", "/")
    stem = F.regexp_replace(F.element_at(part, -1), r"\.md$", "")
    key = lambda k: trimmed(F.regexp_extract("t", rf"(?m)^{k}:(.*)$", 1))
    return both.select(F.regexp_replace("path", r"\.md$", "").alias("id"), F.try_element_at(part, F.lit(1)).alias("case_type"), F.try_element_at(part, F.lit(2)).alias("court_level"), F.substring_index(stem, "_", 1).alias("court_name"), stem.alias("case_number"), key("사건명").alias("case_name"), key("선고일자").alias("ruling_date"))
