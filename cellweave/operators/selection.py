"""Exact order statistics and table differences without gathering values.

A percentile is found by radix selection: a few passes that count 16 bits of the values' order at a time, so that what leaves a task is at most
65,536 counts, however many distinct values there are. Tables are compared by fingerprints of buckets of their keys; only
rows of buckets that differ are looked at one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_finite

#: Bits of a value's order that a pass counts.
DIGIT = 16

#: Buckets of keys that two tables are compared by.
BUCKETS = 4096


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; -0.0 is 0.0."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def from_bits(number: int) -> float:
    bits = number ^ (1 << 63) if number >> 63 else ~number & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _counts(values: DataFrame, shift: int, prefix: int | None) -> dict[int, int]:
    """How many values have each DIGIT bits from ``shift`` on, of those whose higher bits are ``prefix``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << DIGIT, np.int64)
        for batch in batches:
            bits = ordered_bits(batch.column(0).to_numpy(zero_copy_only=False))
            if prefix is not None:
                bits = bits[bits >> np.uint64(shift + DIGIT) == np.uint64(prefix)]
            total += np.bincount(((bits >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64), minlength=1 << DIGIT)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["digit", "n"])

    found = values.mapInArrow(run, "digit long, n long").groupBy("digit").agg(F.sum("n").alias("n"))
    return {r.digit: r.n for r in found.collect()}


def exact_percentile(df: DataFrame, column: str, share: float) -> float | None:
    """The value at ``share`` (0 to 1) of the finite values of a column, between two of them in proportion; None of none.

    Four passes over the column and one more for the value above.
    """
    if not 0 <= share <= 1:
        raise ValueError("share goes from 0 to 1")
    values = df.select(F.col(column).cast("double").alias("v")).where(is_finite("v"))
    prefix, rank, place, here = None, 0, 0.0, 0
    for shift in range(64 - DIGIT, -1, -DIGIT):
        counts = _counts(values, shift, prefix)
        if prefix is None:
            n = sum(counts.values())
            if not n:
                return None
            place = share * (n - 1)
            rank = math.floor(place)
        for digit in sorted(counts):
            if rank < counts[digit]:
                break
            rank -= counts[digit]
        prefix, here = ((prefix or 0) << DIGIT) | digit, counts[digit]
    low = from_bits(prefix)
    part = place - math.floor(place)
    if not part or rank + 1 < here:
        return low
    high = values.where(F.col("v") > low).agg(F.min("v")).first()[0]
    return low + (high - low) * part


def _fingerprints(df: DataFrame, names: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(bucket, n, x, s) of the rows by bucket of their key, in whatever order they come: number, and two sums of row hashes."""
    row = F.xxhash64(*names)
    other = F.pmod(F.xxhash64(F.lit(1), *reversed(names)), F.lit(1 << 31))
    return df.groupBy(_bucket(key)).agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(other).alias("s"))


def _bucket(key: Sequence[str]):
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).alias("bucket")


def changed_rows(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, with ``side``, that one of two tables has more often than the other, as ``quality.differences`` gives them.

    Both tables are summed up to BUCKETS fingerprints; only rows of buckets that differ are shuffled and compared. Columns may come in any
    order; maps can't be compared.
    """
    names = a.columns
    if sorted(names) != sorted(b.columns):
        raise ValueError("tables have different columns")
    left, right = (_fingerprints(df.select(*names), names, key) for df in (a, b))
    both = left.join(right.select("bucket", *(F.col(c).alias(f"b_{c}") for c in ("n", "x", "s"))), "bucket", "full")
    same = F.lit(True)
    for c in ("n", "x", "s"):
        same &= F.col(c).eqNullSafe(F.col(f"b_{c}"))
    bad = both.where(~same).select("bucket")
    held = lambda df: df.select(*names).withColumn("bucket", _bucket(key)).join(F.broadcast(bad), "bucket", "left_semi").select(*names)
    mine, theirs = held(a), held(b)
    return mine.exceptAll(theirs).withColumn("side", F.lit("left")).unionByName(theirs.exceptAll(mine).withColumn("side", F.lit("right")))
