"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def left_pad(s: Column, n: int, c: str) -> Column:
    """Padded on the left to n characters, never cut."""
    return F.concat(F.repeat(F.lit(c), F.greatest(F.lit(n) - F.length(s), F.lit(0))), s)


def right_pad(s: Column, n: int, c: str) -> Column:
    return F.concat(s, F.repeat(F.lit(c), F.greatest(F.lit(n) - F.length(s), F.lit(0))))


def justify(s: Column, how: str, width: int) -> Column:
    """Left, right or centred; of an odd rest the larger part goes to the right."""
    gap = F.greatest(F.lit(width) - F.length(s), F.lit(0))
    if how == "left":
        return right_pad(s, width, " ")
    if how == "right":
        return left_pad(s, width, " ")
    before = F.floor(gap / 2).cast("int")
    return F.concat(F.repeat(F.lit(" "), before), s, F.repeat(F.lit(" "), gap - before))


def map_tokens(s: Column, c: str, f) -> Column:
    """Split at a character, map each token, join again."""
    return F.array_join(F.transform(F.split(s, f"\\Q{c}\\E", -1), f), c)


def head(s: Column) -> Column:
    """The first character; A for the empty string."""
    return F.when(F.length(s) == 0, "A").otherwise(F.substring(s, 1, 1))


def is_ascii(c: Column) -> Column:
    """Whether the first character is ASCII."""
    return F.ascii(c) < 128


def hex_to_u64(s: Column) -> Column:
    """The value of exactly 16 hexadecimal digits as decimal(20,0), else NULL."""
    return F.when(s.rlike("^[0-9a-fA-F]{16}$"), F.conv(s, 16, 10).cast("decimal(20,0)"))


def to_hex_digits(n: Column, size: int) -> Column:
    """A natural number's lowest `size` bytes as 2 * size hexadecimal digits, size up to 8."""
    return F.right(F.lpad(F.lower(F.hex(n)), 16, "0"), F.lit(2 * size))


def content_hash(s: Column) -> Column:
    """A hash that is equal for texts that differ in line ends only."""
    return F.xxhash64(F.replace(s, F.lit("\r\n"), F.lit("\n")))


def shortlex(s: Column) -> list[Column]:
    """Sort keys: by length, then by code points."""
    return [F.length(s), s]


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(a == b, 0).when(a < b, -1).otherwise(1)


def wrapped(s: Column, width: int) -> Column:
    """Lines of at most `width` characters, cut at the last space that fits; a longer word stays whole."""
    return F.trim(F.regexp_replace(s, rf"(.{{1,{width}}})(?: +|$)|(\S{{{width},}})(?: +|$)", "$1$2\n"), F.lit("\n"))


def split_top_level(s: Column) -> Column:
    """The parts between commas outside all brackets, trimmed: one fold with the depth as its state."""
    step = lambda a, c: F.struct(
        (a["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)).alias("depth"),
        F.when((c == ",") & (a["depth"] == 0), F.concat(a["parts"], F.array(a["part"]))).otherwise(a["parts"]).alias("parts"),
        F.when((c == ",") & (a["depth"] == 0), F.lit("")).otherwise(F.concat(a["part"], c)).alias("part"),
    )
    zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("parts"), F.lit("").alias("part"))
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), zero, step, lambda a: F.transform(F.concat(a["parts"], F.array(a["part"])), lambda x: F.trim(x)))


def non_ascii(s: Column) -> Column:
    """The distinct characters outside of ASCII, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(s, ""), lambda c: F.ascii(c) > 127)))
