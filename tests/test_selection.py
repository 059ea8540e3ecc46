"""Radix selection against sorting; tables compared by fingerprints."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.operators import quality, selection


@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=40))
def test_bits_keep_the_order(values):
    values = np.array(values)
    bits = selection.ordered_bits(values)
    assert np.array_equal(np.argsort(values, kind="stable"), np.argsort(bits, kind="stable"))
    assert [selection.from_bits(int(b)) for b in bits] == (values + 0.0).tolist()


def plain(values, share):
    held = sorted(v for v in values if v is not None and math.isfinite(v))
    place = share * (len(held) - 1)
    low = math.floor(place)
    return held[low] if place == low else held[low] + (held[low + 1] - held[low]) * (place - low)


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_are_those_of_sorted_values(spark, seed):
    rng = np.random.default_rng(seed)
    values = [float(v) for v in np.concatenate([rng.normal(0, 10.0 ** rng.integers(-8, 8), 300), rng.integers(-3, 4, 200), [0.0, -0.0, 5e-324, 1e308, -1e308]])] + [None, math.nan, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    for share in (0.0, 0.01, 0.37, 0.5, 0.99, 1.0):
        assert selection.exact_percentile(df, "v", share) == pytest.approx(plain(values, share), rel=1e-15, abs=0)
    assert selection.exact_percentile(df.where("v is null"), "v", 0.5) is None
    with pytest.raises(ValueError):
        selection.exact_percentile(df, "v", 1.1)


def test_a_changed_cell_is_named(spark):
    a = spark.range(5000).selectExpr("id AS k", "id % 7 AS v", "array(id, 1) AS w", "cast(null as string) AS z")
    b = a.withColumn("v", F.when(F.col("k") == 1234, 99).otherwise(F.col("v"))).where("k <> 77").union(a.where("k = 5")).select("z", "w", "v", "k")
    got = selection.changed_rows(a, b, ["k"])
    rows = sorted((r.side, r.k, r.v) for r in got.collect())
    assert rows == [("left", 77, 0), ("left", 1234, 2), ("right", 5, 5), ("right", 1234, 99)]
    other = quality.differences(a, b.select(*a.columns))
    assert sorted(map(str, got.select(*other.columns).collect())) == sorted(map(str, other.collect()))
    assert selection.changed_rows(a, a.repartition(3), ["k"]).isEmpty() and selection.changed_rows(a.where("false"), a.where("false"), ["k"]).isEmpty()
    with pytest.raises(ValueError):
        selection.changed_rows(a, a.drop("w"), ["k"])
