"""Judges, attorneys and prosecutors named in rulings, and the index by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.frontmatter import bound, lines, strip_frontmatter, trimmed

ROLES = ("judge", "attorney", "prosecutor")
#: Fixed ranges of Hangul syllables and letters; a name has two to four of them.
NAME = "^[\\uAC00-\\uD7AF\\u1100-\\u11FF\\u3130-\\u318F]{2,4}$"
PERSON = "array<struct<name:string,role:string,qualifier:string>>"


def is_name(c: Column) -> Column:
    return c.rlike(NAME)


def _person(name: Column, role: str, qualifier: Column) -> Column:
    return F.struct(trimmed(name).alias("name"), F.lit(role).alias("role"), qualifier.cast("string").alias("qualifier"))


def persons_of(raw: Column) -> Column:
    """Array of (name, role, qualifier) in the order in which they are named, the first of each name and role."""
    none = F.array().cast(PERSON)
    tokens = lambda x: F.regexp_extract_all(x, F.lit(r"(?U)\S+"), F.lit(0))

    def of_line(x: Column, bare: Column) -> Column:
        bench = F.regexp_extract(x, "(?s)^(?:대법관|판사)(.*)$", 1)
        after = lambda t: F.regexp_replace(F.regexp_extract(t, r"(?s)^[^(]*\((.*)$", 1), r"\)$", "")
        judges = F.transform(tokens(bench), lambda t: _person(F.regexp_extract(t, r"^[^(]*", 0), "judge", F.when(t.contains("("), after(t))))
        counsel = F.regexp_extract_all(x, F.lit(r"(?U)변호사\s*((?:(?!변호사)\S)++|(?=변호사))"), F.lit(1))
        attorneys = F.transform(counsel, lambda t: _person(F.regexp_replace(F.regexp_extract(t, r"^[^(]*", 0), "[,.，)）]+$", ""), "attorney", F.lit(None)))
        named = F.regexp_extract(bare, "(?s)【검사】(.*)$", 1)
        state = F.transform(F.split(named, "[,，]"), lambda t: _person(F.regexp_extract(trimmed(F.regexp_extract(t, "(?s)^[^외]*", 0)), r"(?U)^\S*", 0), "prosecutor", F.lit(None)))
        return F.concat(
            F.when(x.startswith("대법관") | x.startswith("판사"), judges).otherwise(none).cast(PERSON),
            F.when(x.contains("변호사"), attorneys).otherwise(none).cast(PERSON),
            F.when(bare.contains("【검사】"), state).otherwise(none).cast(PERSON),
        )

    def named_in(line: Column) -> Column:
        return bound(F.struct(trimmed(line).alias("x"), F.replace(trimmed(line), F.lit(" "), F.lit("")).alias("bare")), lambda s: of_line(s["x"], s["bare"]))

    # only lines that can name anyone are looked at
    some = F.filter(lines(strip_frontmatter(raw)), lambda x: x.contains("대법관") | x.contains("판사") | x.contains("변호사") | x.contains("【"))
    every = F.filter(F.flatten(F.transform(some, named_in)), lambda p: is_name(p["name"]))
    # sorted by name and role, equal ones stand next to each other, the first named first
    key = lambda p, i: F.struct(p["name"].alias("name"), p["role"].alias("role"), i.alias("i"), p["qualifier"].alias("qualifier"))
    first = lambda s: F.filter(s, lambda p, i: (i == 0) | (p["name"] != F.get(s, i - 1)["name"]) | (p["role"] != F.get(s, i - 1)["role"]))
    placed = F.transform(bound(F.array_sort(F.transform(every, key)), first), lambda p: F.struct(p["i"].alias("i"), p["name"].alias("name"), p["role"].alias("role"), p["qualifier"].alias("qualifier")))
    return F.transform(F.array_sort(placed), lambda p: F.struct(p["name"].alias("name"), p["role"].alias("role"), p["qualifier"].alias("qualifier")))


def extract(docs: DataFrame, id_col: str = "id", raw_col: str = "raw") -> DataFrame:
    """(id, pos, name, role, qualifier): one row for each person of each document. Narrow."""
    return docs.select(id_col, F.posexplode_outer(persons_of(F.col(raw_col))).alias("pos", "p")).where("p is not null").select(id_col, "pos", "p.name", "p.role", "p.qualifier")


def search(index: DataFrame, name: str, role: str | None = None) -> DataFrame:
    """Rows of the index for a name, and a role if one is given."""
    if role is not None and role not in ROLES:
        raise ValueError(f"role must be one of {', '.join(ROLES)}")
    found = index.where(F.col("name") == name)
    return found if role is None else found.where(F.col("role") == role)


def by_name(index: DataFrame, id_col: str = "id") -> DataFrame:
    """(name, n): documents of each name, counted; the flat index itself is the map's other form."""
    return index.groupBy("name").agg(F.count_distinct(id_col).alias("n"))


def stale(current: int, scanned: int) -> bool:
    """Is an index of so many documents too old: more than a twentieth have come."""
    return current * 100 > scanned * 105
