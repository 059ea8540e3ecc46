"""Column expressions with the semantics the engine relies on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """Not null, not NaN (which Spark orders above every number), not infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def half_even(c: Column | str) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.rint(col(c)).cast("int")


def close_to(a: Column | str, b: Column | str, rel: float = 1e-5, absolute: float = 1e-8) -> Column:
    """|a - b| <= absolute + rel * |b|."""
    return F.abs(col(a) - col(b)) <= F.lit(absolute) + F.lit(rel) * F.abs(col(b))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    """Whole seconds from a to b; works for TIMESTAMP_NTZ, which unix_micros doesn't take."""
    return F.timestamp_diff("SECOND", col(a), col(b)).cast("long")


def unit_name(c: Column | str) -> Column:
    return F.replace(F.lower(col(c)), F.lit(" "), F.lit(""))


def joined_ids(c: Column | str) -> Column:
    """A list of numbers as text, parted by semicolons."""
    return F.array_join(F.transform(col(c), lambda v: v.cast("string")), ";")


def stamp_in_name(path: Column | str) -> Column:
    """The time in a snapshot's file name (YYYY-MM-DD_HH:MM:SS), null if there is none."""
    found = F.regexp_extract(col(path), r"(\d{4}-\d{2}-\d{2}_\d{2}[:_]\d{2}[:_]\d{2})(?:\.nc)?$", 1)
    plain = F.regexp_replace(found, r"^(\d{4}-\d{2}-\d{2})_(\d{2})[:_](\d{2})[:_](\d{2})$", "$1 $2:$3:$4")
    return F.when(plain != "", F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def internal_stamp(c: Column | str) -> Column:
    """The time that a snapshot holds, of the form YYYY-MM-DD_HH:MM:SS."""
    return F.try_to_timestamp(F.replace(F.trim(col(c)), F.lit("_"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
