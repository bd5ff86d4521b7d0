"""Vector functions over ARRAY columns (float vectors, int8 vectors) and BINARY columns (bit vectors, least bit first).

Distances are computed in double. A null or a different length gives null; zero vectors have no cosine (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.frontmatter import bound

def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def paired(a: Column, b: Column, f) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f))


def vec_f32(text: Column) -> Column:
    """A JSON list as a float vector; null if it isn't one, is empty, or holds what isn't finite."""
    v = F.from_json(text, "array<float>")
    return F.when((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), v)


def vec_int8(text: Column) -> Column:
    """A JSON list of whole numbers from -128 to 127; null if it isn't one."""
    v = F.from_json(text, "array<int>")
    return F.when((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | (x < -128) | (x > 127)), v.cast("array<tinyint>"))


def vec_bit(c: Column) -> Column:
    """Bytes as a bit vector; null if there are none."""
    return F.when(F.octet_length(c) > 0, c)


def vec_version() -> Column:
    return F.lit("v1.0.0")


def vec_debug() -> Column:
    return F.lit("Version: v1.0.0\nBuilt for: Spark expressions over arrays and binary columns")


def bits_of(c: Column, most_first: bool = False) -> Column:
    """The bits of a bit vector as an array of 0 and 1, the least bit of each byte first unless most_first."""
    octets = F.transform(F.regexp_extract_all(F.hex(c), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))
    places = F.array(*[F.lit(k) for k in (range(7, -1, -1) if most_first else range(8))])
    return F.flatten(F.transform(octets, lambda b: F.transform(places, lambda k: F.call_function("shiftright", b, k).bitwiseAND(1))))


def vec_each(c: Column, bit: bool = False) -> Column:
    """Array of (rowid, value) for each element; bit vectors are read from the most bit of each byte on."""
    return F.transform(bits_of(c, True) if bit else c, lambda x, i: F.struct(i.alias("rowid"), x.alias("value")))


def vec_length(c: Column, bit: bool = False) -> Column:
    return (F.octet_length(c) * 8 if bit else F.size(c)).cast("int")


def vec_type(kind: str) -> Column:
    """'float32', 'int8' or 'bit' for a Spark type name."""
    return F.lit({"array<float>": "float32", "array<double>": "float32", "array<tinyint>": "int8", "binary": "bit"}[kind])


def distance_l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(paired(a, b, lambda x, y: (x - y) * (x - y))))


def distance_l1(a: Column, b: Column) -> Column:
    return total(paired(a, b, lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(paired(a, b, lambda x, y: x * y))


def distance_cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, 1 - dot(a, b) / size)


def distance_hamming(a: Column, b: Column) -> Column:
    """Bits that differ, of two bit vectors of one length: bits set in the exclusive or, eight bytes at a time."""
    words = lambda c: F.transform(F.regexp_extract_all(F.hex(c), F.lit(".{1,16}"), F.lit(0)), lambda w: F.conv(w, 16, -10).cast("bigint"))
    bits = F.zip_with(words(a), words(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.when(F.octet_length(a) == F.octet_length(b), F.aggregate(bits, F.lit(0), lambda s, x: s + x))


def vec_add(a: Column, b: Column) -> Column:
    return paired(a, b, lambda x, y: x + y)


def vec_sub(a: Column, b: Column) -> Column:
    return paired(a, b, lambda x, y: x - y)


def vec_add_int8(a: Column, b: Column) -> Column:
    """Sums that wrap at a byte."""
    return F.zip_with(a, b, lambda x, y: (F.pmod(x.cast("int") + y.cast("int") + 128, F.lit(256)) - 128).cast("tinyint"))


def vec_sub_int8(a: Column, b: Column) -> Column:
    """Differences that wrap at a byte."""
    return F.zip_with(a, b, lambda x, y: (F.pmod(x.cast("int") - y.cast("int") + 128, F.lit(256)) - 128).cast("tinyint"))


def vec_slice_bit(c: Column, start: int, end: int) -> Column:
    """Bits from start up to but not including end, which must be multiples of 8; null outside the vector."""
    if start % 8 or end % 8:
        raise ValueError("bit vectors are cut at multiples of 8")
    return F.when((F.octet_length(c) * 8 >= end) & F.lit(0 <= start < end), F.substring(c, start // 8 + 1, (end - start) // 8))


def vec_slice(c: Column, start: int, end: int) -> Column:
    """Elements from start up to but not including end, counted from 0; null outside the vector."""
    return F.when((F.size(c) >= end) & F.lit(0 <= start < end), F.slice(c, start + 1, end - start))


def vec_normalize(c: Column) -> Column:
    d = c.cast("array<double>")
    return bound(F.sqrt(dot(d, d)), lambda n: F.transform(d, lambda x: x / n))


def vec_quantize_int8(c: Column) -> Column:
    """From the unit interval [-1, 1] to a byte, cut towards zero and held in range."""
    return F.transform(c.cast("array<double>"), lambda x: F.least(F.greatest(((x + 1.0) / (2.0 / 255.0) - 128.0).cast("int"), F.lit(-128)), F.lit(127)).cast("tinyint"))


def vec_quantize_binary(c: Column, least: bool = False) -> Column:
    """A bit for each element: is it above 0 (least: or 0). Least bit first; the length must be a multiple of 8, else null."""
    test = (lambda x: x >= 0) if least else (lambda x: x > 0)
    byte = lambda v: F.aggregate(v, F.lit(0), lambda a, x: (a / 2).cast("int") + F.when(test(x), 128).otherwise(0))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / 8).cast("int") - 1), lambda i: F.lpad(F.hex(byte(F.slice(c, i * 8 + 1, 8)).cast("bigint")), 2, "0")), "")
    return F.when((F.size(c) > 0) & (F.size(c) % 8 == 0), F.unhex(text))


def vec_to_json_bit(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(bits_of(c).cast("array<string>"), ","), F.lit("]"))


def six_places(x: Column) -> Column:
    """A float with six decimals as C's printf gives it. Java's takes halves away from zero, C's to the even digit. A binary number
    with a half at the seventh decimal is an odd number of 128ths; below every second of them the sixth digit is even, and is cut."""
    seven = F.format_string("%.7f", x)
    return F.when(F.abs(x) * 128 % 4 == 1, F.substring(seven, F.lit(1), F.length(seven) - 1)).otherwise(F.format_string("%.6f", x))


def vec_to_json(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c.cast("array<double>"), six_places), ","), F.lit("]"))


def fnv_embed(data: Column, dims: int = 384) -> Column:
    """The hash embedding of bytes: 16 bits of a multiplicative hash for each dimension, centred, to unit length.

    Only the low 16 bits of the hash are used, so it is folded modulo 65536.
    """
    pairs = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    base = F.aggregate(pairs, F.lit(40389).cast("bigint"), lambda h, c: ((h + F.conv(c, 16, 10).cast("bigint")) * 403) % 65536)
    raw = lambda b: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (((b + i) * 403) % 65536).cast("double") / 65535.0 - 0.5)
    return bound(base, lambda b: bound(raw(b), vec_normalize))
