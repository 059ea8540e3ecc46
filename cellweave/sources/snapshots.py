"""Snapshots: one accumulated frame per file, its time in the name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import internal_stamp, stamp_in_name
from ..operators.preprocess import difference_cumulative, require


def manifest(paths: DataFrame, check: bool = True) -> DataFrame:
    """(path, valid_time, t) in order of time, then path; files without a time in their name are left out.

    Two of one time, or fewer than two in all, are an error.
    """
    dated = paths.select("path", stamp_in_name("path").alias("valid_time")).where("valid_time is not null")
    if check:
        if not dated.groupBy("valid_time").count().where("count > 1").isEmpty():
            raise ValueError("two snapshots have the same time")
        if len(dated.limit(2).collect()) < 2:
            raise ValueError("at least two snapshots are needed")
    order = Window.orderBy("valid_time", "path")  # a row per file: small
    return dated.withColumn("t", (F.row_number().over(order) - 1).cast("long"))


def list_snapshots(spark: SparkSession, directory: str) -> DataFrame:
    """(path) of all files below a directory; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    return found.select("path")


def check_internal_times(files: DataFrame) -> None:
    """(path, times): the time inside each file must be the one in its name."""
    inside, named = internal_stamp("times"), stamp_in_name("path")
    require(files, ~inside.eqNullSafe(named), "Filename/Times differ")


def hourly(files: DataFrame) -> None:
    """Snapshots must be one hour apart."""
    order = Window.orderBy("valid_time")
    steps = files.withColumn("step", F.timestamp_diff("SECOND", F.lag("valid_time").over(order), F.col("valid_time")))
    require(steps, F.col("step") != 3600, "snapshots are missing or irregular")


def increments(snapshots: DataFrame, files: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Hourly cells of (path, y, x, rain) snapshots listed in ``manifest`` form; checked for cadence and resets.

    Increment t is from file t to file t + 1, so the first frame is 0.
    """
    hourly(files)
    cells = snapshots.join(files.select("path", "t"), "path").select(F.lit("default").alias("sequence_id"), "t", "y", "x", F.col("rain").cast("float").alias("rain"))
    return difference_cumulative(cells, tolerance).withColumn("t", F.col("t") - 1)
