"""Sinks: JSON and tab-separated lines, markdown files and typesetting markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.frontmatter import lines, strip_frontmatter, trimmed


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def tsv_lines(df: DataFrame) -> DataFrame:
    """Tab-separated, arrays joined by commas, nulls empty."""
    cells = [F.coalesce(F.array_join(c, ",") if t.startswith("array") else F.col(f"`{c}`").cast("string"), F.lit("")) for c, t in df.dtypes]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def export_name(name: Column, number: Column) -> Column:
    """The file name of an exported ruling."""
    return F.concat(F.translate(F.concat(name, F.lit(" ("), number, F.lit(")")), "/\\", "__"), F.lit(".md"))


def export_markdown(docs: DataFrame, path: str, name_col: str = "file", raw_col: str = "raw") -> None:
    """A file of that name for each document, below a folder that the executors share; each task writes its own, and a task that runs
    again writes the same bytes. Names that occur twice keep the last document in the order of their texts."""
    once = docs.groupBy(F.col(name_col).alias("file")).agg(F.max(raw_col).alias("raw"))

    def write(part) -> None:
        from pyarrow import fs

        store, base = (fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path))
        store.create_dir(base)
        for r in part:
            with store.open_output_stream(f"{base}/{r.file}") as out:
                out.write((r.raw or "").encode("utf-8"))

    once.foreachPartition(write)


#: Fixed ranges of circled numbers, which mark clauses.
CIRCLED = "^[\u2460-\u2473\u3251-\u325F\u32B1-\u32BF]"


def to_markup(raw: Column) -> Column:
    """Markdown as typesetting markup, each line with its end: headings by level, bold, rules, signs that have a meaning escaped;
    clauses (circled numbers) are indented, after an empty line, and numbered items below a clause more so."""
    rows = F.transform(lines(strip_frontmatter(raw)), trimmed)
    # a letter for the kind of each line: e empty, c clause, n numbered item, x what ends a clause
    kind = lambda x: F.when(x == "", "e").when(x.rlike(CIRCLED), "c").when(x.rlike(r"^[0-9]+\.( |$)"), "n").otherwise("x")
    runs = F.regexp_extract_all(F.array_join(F.transform(rows, kind), ""), F.lit("c[en]*|[^c]"), F.lit(0))
    kinds = F.array_remove(F.split(F.array_join(F.transform(runs, lambda r: F.when(r.startswith("c"), F.translate(r, "n", "i")).otherwise(r)), ""), ""), "")
    before = F.concat(F.array(F.lit("x")), kinds)
    escaped = lambda x: F.regexp_replace(x, r"([#@$<>])", r"\\$1")

    def line(x: Column, now: Column, last: Column, i: Column) -> Column:
        level = F.length(F.regexp_extract(x, "^#{1,6}", 0))
        heading = F.concat(F.repeat(F.lit("="), level), F.lit(" "), escaped(F.regexp_replace(F.regexp_replace(x, "^#{1,6}", ""), "^ +", "")))
        text = F.regexp_replace(escaped(x), r"(?s)\*\*(.*?)\*\*", r"*$1*")
        padded = lambda em: F.concat(F.lit(f"#pad(left: {em})["), text, F.lit("]"))
        clause = F.concat(F.when((last == "e") & (i > 1), "").otherwise("\n"), padded("1em"))
        out = F.when(x.isin("---", "***", "___"), "#line(length: 100%)").when(level > 0, heading).when(now == "c", clause).when(now == "i", padded("2.5em")).otherwise(text)
        return F.concat(out, F.lit("\n"))

    both = F.zip_with(rows, F.arrays_zip(kinds.alias("now"), F.slice(before, 1, F.size(kinds)).alias("last")), lambda x, k: F.struct(x.alias("x"), k["now"].alias("now"), k["last"].alias("last")))
    return F.array_join(F.transform(both, lambda r, i: line(r["x"], r["now"], r["last"], i)), "")
