"""Input of many files with many samples each: one order of time, one kind of rain, increments across file boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.preprocess import RATE_UNITS, check_amounts, classify_rain, difference_cumulative, require, to_rate

#: Units that are seconds' rates of water: mm/s.
PER_SECOND = ("kgm-2s-1", "kg/m2/s", "kg/m^2/s", "mm/s", "mms-1")


def plan_samples(samples: DataFrame, hours: float = 1.0, origin: str | None = None) -> DataFrame:
    """(path, sample, t, valid_time) of rows (path, sample, valid_time): a row per frame of each file.

    Samples with times go by time, whatever file they are in, ``hours`` apart and none twice. Without times
    they go by path, then index; indices may begin anew in each file but must be consecutive in it, and ``origin`` gives the
    first a time. Some with and some without times are an error. There is a row per frame, so the plan is small.
    """
    timed = samples.agg(F.count("*").alias("n"), F.count("valid_time").alias("timed")).first()
    if timed.timed not in (0, timed.n):
        raise ValueError("some samples have times and some have none")
    if timed.timed:
        order = Window.orderBy("valid_time")
        steps = samples.withColumn("step", F.timestamp_diff("SECOND", F.lag("valid_time").over(order), F.col("valid_time")))
        require(steps, F.col("step") == 0, "two samples have the same time")
        require(steps, F.col("step") != round(hours * 3600), "samples are missing or irregular")
        return samples.select("path", "sample", (F.row_number().over(order) - 1).cast("long").alias("t"), "valid_time")
    inside = Window.partitionBy("path").orderBy("sample")
    require(samples.withColumn("step", F.col("sample") - F.lag("sample").over(inside)), F.col("step") != 1, "indices of a file aren't consecutive")
    t = (F.row_number().over(Window.orderBy("path", "sample")) - 1).cast("long")
    begin = F.to_timestamp_ntz(F.lit(origin)) if origin else F.lit(None).cast("timestamp_ntz")
    return samples.select("path", "sample", t.alias("t")).withColumn("valid_time", (begin + F.make_dt_interval(secs=F.col("t") * round(hours * 3600))).cast("timestamp_ntz"))


def read_precipitation(values: DataFrame, samples: DataFrame, name: str, unit: str, attributes: dict[str, str] | None = None, rain_kind: str | None = None, hours: float = 1.0, origin: str | None = None, sequence_id: str = "default") -> tuple[DataFrame, DataFrame]:
    """(cells, frames) in mm/h of ``values`` (path, sample, y, x, rain), whose samples are those of ``plan_samples``.

    The kind of rain is ``rain_kind``, or what name, unit and attributes tell. Amounts that accumulate are differenced, across files
    as well: their first sample is only the one before, and frame t is from sample t to t + 1. Interval amounts in mm are divided
    by ``hours``, rates per second made hourly. ``frames`` has (sequence_id, t, interval_start, interval_end), null without times.
    """
    kind = rain_kind or classify_rain(name, unit, attributes)
    plain = unit.lower().replace(" ", "")
    if kind not in ("cumulative", "interval", "rate"):
        raise ValueError(f"unknown kind of rain {kind!r}")
    if kind != "rate" and plain not in ("mm", "kgm-2", "kg/m2"):
        raise ValueError("amounts need the unit mm")
    if kind == "rate" and plain not in (*RATE_UNITS, *PER_SECOND):
        raise ValueError("rates need the unit mm/h")
    plan = plan_samples(samples, hours, origin)
    rows = values.join(plan.select("path", "sample", "t"), ["path", "sample"])
    cells = rows.select(F.lit(sequence_id).alias("sequence_id"), "t", "y", "x", F.col("rain").cast("float").alias("rain"), (F.col("rain").isNotNull() & ~F.isnan("rain")).alias("valid"))
    step = F.make_dt_interval(secs=F.lit(round(hours * 3600)))
    frames = plan.select(F.lit(sequence_id).alias("sequence_id"), "t", (F.col("valid_time") - step).cast("timestamp_ntz").alias("interval_start"), F.col("valid_time").alias("interval_end"))
    if kind == "cumulative":
        cells = difference_cumulative(cells).drop("clipped").withColumn("t", F.col("t") - 1)
        frames = frames.where("t > 0").withColumn("t", F.col("t") - 1)
    else:
        check_amounts(cells)
    if kind == "rate":
        return cells.withColumn("rain", (F.col("rain") * (3600.0 if plain in PER_SECOND else 1.0)).cast("float")), frames
    return to_rate(cells, hours), frames
