"""Articles and sections of documents as rows, their text, and positions between them. Narrow: all per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.frontmatter import bound, lines, strip_frontmatter, trimmed
from docketry.functions.text import plain

HEADINGS = {"article": "##### ", "section": "## "}


def headings(rows: Column, kind: str) -> Column:
    """Array of (label, line_index) of a kind of heading in an array of lines: articles name 제 and 조, sections have a label."""
    mark = HEADINGS[kind]
    label = lambda x: F.substring(x, F.lit(len(mark) + 1), F.length(x))
    found = F.filter(F.transform(rows, lambda x, i: F.struct(label(x).alias("label"), i.alias("line_index"), x.startswith(mark).alias("ok"))), lambda h: h["ok"])
    good = (lambda h: h["label"].contains("제") & h["label"].contains("조")) if kind == "article" else (lambda h: trimmed(h["label"]) != "")
    return F.transform(F.filter(found, good), lambda h: F.struct(trimmed(h["label"]).alias("label"), h["line_index"].cast("int").alias("line_index")))


def pieces(raw: Column, kind: str, text: bool) -> Column:
    """Array of (label, line_index[, text]) of a document's headings; text is plain, from each to the next."""

    def cut(d: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            end = F.coalesce(F.get(d["h"], i + 1)["line_index"], F.size(d["l"]))
            own = [plain(F.slice(d["l"], h["line_index"] + 1, end - h["line_index"])).alias("text")] if text else []
            return F.struct(h["label"].alias("label"), h["line_index"].alias("line_index"), *own)

        return F.transform(d["h"], one)

    return bound(bound(lines(strip_frontmatter(raw)), lambda x: F.struct(x.alias("l"), headings(x, kind).alias("h"))), cut)


def extract(docs: DataFrame, kind: str, id_col: str = "id", raw_col: str = "raw", text: bool = True) -> DataFrame:
    """(id, idx, label, line_index, text): one row for each heading; text (if asked for) is plain, from it to the next of its kind.

    Texts are cut before headings become rows, so that a row carries its own part only and not the document."""
    # an outer explode, because a plain one adds a filter that parses every document a second time
    rows = docs.select(id_col, F.posexplode_outer(pieces(F.col(raw_col), kind, text)).alias("idx", "_x")).where("_x is not null")
    return rows.select(id_col, "idx", "_x.*")


def at_line(segments: DataFrame, positions: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, line, label): the last heading at or before a line of its document; null before the first."""
    both = positions.join(segments.select(id_col, "label", "line_index"), id_col, "left")
    before = F.col("line_index") <= F.col("line")
    return both.groupBy(id_col, "line").agg(F.max_by(F.when(before, F.col("label")), F.when(before, F.col("line_index"))).alias("label"))


def neighbours(segments: DataFrame, id_col: str = "id") -> DataFrame:
    """Each heading with the labels of the next and the one before, going round at the ends of the document."""
    w = Window.partitionBy(id_col).orderBy("line_index")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return segments.withColumns({"next_label": F.coalesce(F.lead("label").over(w), F.first("label").over(whole)), "prev_label": F.coalesce(F.lag("label").over(w), F.last("label").over(whole))})


def first_starting(segments: DataFrame, prefix: str, id_col: str = "id") -> DataFrame:
    """The first heading of each document whose label starts so."""
    return segments.where(F.col("label").startswith(prefix)).groupBy(id_col).agg(F.min_by("label", "line_index").alias("label"), F.min("line_index").alias("line_index"))
