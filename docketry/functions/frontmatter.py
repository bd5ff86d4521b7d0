"""Metadata headers of markdown documents, as column expressions.

A header is what stands between a first line `---` and the next one. Values are scalars or lists; both are kept in one map of
structs (list, v): an array of values, and whether they were given as a list. Columns are nullable only where the input is: a missing key gives '' or an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = r"(?U)^\s+|\s+$"


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it (expressions in lambdas are not shared otherwise)."""
    return F.transform(F.array(value), f)[0]


def trimmed(c: Column) -> Column:
    """Without white space, of any alphabet, at either end."""
    return F.regexp_replace(c, EDGES, "")


def lines(text: Column) -> Column:
    """Lines without their ends; a last line end opens no further line."""
    parts = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip_frontmatter(raw: Column) -> Column:
    """The text after the header; unchanged if there is none, if it isn't closed or nothing follows it."""
    close = F.locate("\n---", raw, 4)
    rest = F.substring(raw, (close + 4).cast("int"), F.length(raw))
    return F.when(raw.startswith("---") & (close > 0) & (rest != ""), F.regexp_replace(rest, "^\n", "")).otherwise(raw)


def header_lines(raw: Column) -> Column:
    """Lines of the header; none if there is no header or no end to it."""
    close = F.locate("\n---", raw, 4)
    return F.when(raw.startswith("---") & (close > 0), F.split(F.substring(raw, F.lit(4), (close - 4).cast("int")), "\n", -1)).otherwise(F.array().cast("array<string>"))


def unquoted(c: Column) -> Column:
    """Without one pair of equal quotes around it."""
    return F.regexp_replace(c, r"""(?s)^(?:"(.*)"|'(.*)')$""", "$1$2")


def parse_frontmatter(raw: Column) -> Column:
    """MAP of key to (list, v). Later values of a key win, nested keys are taken as keys, list items that follow no open
    key are dropped, an open key without items is an empty scalar."""
    pair = "struct<k:string,v:array<string>,open:boolean>"
    start = F.struct(F.array().cast(f"array<{pair}>").alias("done"), F.lit(None).cast(pair).alias("now"))

    def step(acc: Column, line: Column) -> Column:
        text = trimmed(line)
        item = F.regexp_extract(line, r"^(?:  )?- (.*)$", 1)
        is_item = line.rlike(r"^(?:  )?- ")
        key, value = trimmed(F.regexp_extract(text, "(?s)^([^:]*):(.*)$", 1)), unquoted(trimmed(F.regexp_extract(text, "(?s)^([^:]*):(.*)$", 2)))
        now = acc["now"]
        added = F.struct(now["k"].alias("k"), F.concat(now["v"], F.array(unquoted(trimmed(item)))).alias("v"), now["open"].alias("open"))
        new = F.struct(key.alias("k"), F.when(value == "", F.array().cast("array<string>")).otherwise(F.array(value)).alias("v"), (value == "").alias("open"))
        is_pair = text.contains(":") & ~text.startswith("#") & ~is_item
        return F.struct(
            F.when(is_pair & now.isNotNull(), F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"),
            F.when(is_pair, new).when(is_item & now["open"], added).otherwise(now).alias("now"),
        )

    def close(acc: Column) -> Column:
        every = F.when(acc["now"].isNotNull(), F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        last = F.filter(every, lambda x, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda y: y["k"] == x["k"]))
        value = lambda x: F.struct((x["open"] & (F.size(x["v"]) > 0)).alias("list"), F.when(F.size(x["v"]) == 0, F.array(F.lit(""))).otherwise(x["v"]).alias("v"))
        return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], value(x))))

    return F.aggregate(header_lines(raw), start, step, close)


def scalar(header: Column, key: str) -> Column:
    """A key's value; '' for a list, also of one, or a missing key."""
    x = F.try_element_at(header, F.lit(key))
    return F.when(~x["list"], x["v"][0]).otherwise(F.lit(""))


def values(header: Column, key: str) -> Column:
    """A key's values as a list: all items of a list, a scalar that isn't empty as one; empty for a missing key."""
    x = F.try_element_at(header, F.lit(key))
    return F.coalesce(F.when(x["list"] | (x["v"][0] != ""), x["v"]), F.array().cast("array<string>"))
