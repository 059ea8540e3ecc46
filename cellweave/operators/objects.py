"""Statistics of objects, frames and whole runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import is_finite
from ..grid import Grid
from .selection import exact_percentile

FRAME = ("sequence_id", "t")


def object_table(labels: DataFrame, cells: DataFrame, pixels: bool = False) -> DataFrame:
    """A row per object: area, sum, mean, max, centroid, half-open box; with ``pixels`` also its cells.

    The centroid is weighted by intensity; where the sum isn't positive it is the plain mean. Sums are in
    double precision; their order isn't fixed, so last digits may differ between runs.
    """
    rows = labels.join(cells.select(*FRAME, "y", "x", F.col("rain").cast("double").alias("r")), [*FRAME, "y", "x"], "left")
    total = F.sum("r")

    def centre(axis: str) -> Column:
        return F.when(total > 0, F.sum(F.col(axis) * F.col("r")) / total).otherwise(F.avg(axis))

    more = [F.array_sort(F.collect_list(F.struct("y", "x"))).alias("pixels")] if pixels else []
    return rows.groupBy(*FRAME, "label").agg(
        F.count("*").alias("area_cells"), centre("y").alias("centroid_y"), centre("x").alias("centroid_x"), F.avg("r").alias("mean_intensity"), F.max("r").alias("max_intensity"), total.alias("precipitation_sum"),
        F.min("y").alias("y_start"), (F.max("y") + 1).alias("y_stop"), F.min("x").alias("x_start"), (F.max("x") + 1).alias("x_stop"), *more,
    )


def frame_statistics(frames: DataFrame, cells: DataFrame, labels: DataFrame, grid: Grid) -> DataFrame:
    """A row per frame, empty ones too. Rain isn't cut by the threshold here; its mean is over finite cells of
    the grid, cells without a row being 0."""
    n = grid.ny * grid.nx
    ok = F.col("valid") & is_finite("rain")
    r = F.when(ok, F.col("rain").cast("double"))
    seen = cells.groupBy(*FRAME).agg(F.count_if(~ok).alias("missing"), F.sum(r).alias("total"), F.max(r).alias("most"), F.count("*").alias("rows"))
    found = labels.groupBy(*FRAME).agg(F.max("label").alias("objects"), F.count("*").alias("wet"))
    out = frames.select(*FRAME).join(seen, list(FRAME), "left").join(found, list(FRAME), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    finite = n - zero("missing")
    dry = zero("rows") < n  # some cell has no row: its 0 counts for the maximum
    most = F.when(finite > 0, F.when(dry, F.greatest(F.coalesce("most", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("most")))
    return out.select(*FRAME, zero("objects").alias("objects"), F.when(finite > 0, F.coalesce("total", F.lit(0.0)) / finite).alias("mean_rain_mm_h"), most.alias("max_rain_mm_h"), (zero("wet") / n).alias("wet_fraction"), (zero("missing") / n).alias("missing_fraction"))


def branch_spans(nodes: DataFrame, hours: float = 1.0) -> DataFrame:
    """Hours from a branch's first to its last frame, both included, gaps too."""
    span = nodes.groupBy("sequence_id", "branch_id").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    return span.withColumn("span_hours", (F.col("last") - F.col("first") + 1) * F.lit(hours))


def branch_speeds(nodes: DataFrame, edges: DataFrame, hours: float = 1.0, km: float | None = None) -> DataFrame:
    """Cells per hour along edges that stay on a branch; with the grid's spacing in km also km/h."""
    n = nodes.select("sequence_id", "node_id", "branch_id", "time", "centroid_y", "centroid_x")
    side = lambda k, id: n.select("sequence_id", F.col("node_id").alias(id), *(F.col(c).alias(f"{k}_{c}") for c in n.columns[2:]))
    rows = edges.select("sequence_id", "parent_node_id", "child_node_id").join(side("p", "parent_node_id"), ["sequence_id", "parent_node_id"]).join(side("c", "child_node_id"), ["sequence_id", "child_node_id"]).where("p_branch_id = c_branch_id")
    far = F.hypot(F.col("c_centroid_y") - F.col("p_centroid_y"), F.col("c_centroid_x") - F.col("p_centroid_x"))
    out = rows.select("sequence_id", F.col("p_branch_id").alias("branch_id"), F.col("c_time").alias("time"), (far / (F.lit(hours) * (F.col("c_time") - F.col("p_time")))).alias("cells_per_hour"))
    return out if km is None else out.withColumn("km_per_hour", F.col("cells_per_hour") * km)


def censored_branches(nodes: DataFrame, frames: DataFrame, grid: Grid) -> DataFrame:
    """Whether a branch touches the first or last frame or the grid's edge: its life may be cut there."""
    ends = frames.groupBy("sequence_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    edge = (F.col("y_start") == 0) | (F.col("x_start") == 0) | (F.col("y_stop") == grid.ny) | (F.col("x_stop") == grid.nx)
    touch = edge | (F.col("time") == F.col("t0")) | (F.col("time") == F.col("t1"))
    return nodes.join(ends, "sequence_id").groupBy("sequence_id", "branch_id").agg(F.bool_or(touch).alias("censored"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n) of ``bins`` equal bins from low to high; the last holds ``high``; empty bins have rows. Bins 0 and
    ``bins`` + 1 count what is below and above; null and NaN are in none."""
    v = F.col(column)
    at = F.when(v == high, F.lit(bins)).otherwise(F.width_bucket(v, F.lit(float(low)), F.lit(float(high)), F.lit(bins)))
    counted = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins + 2).withColumnRenamed("id", "bin").join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def rain_percentile(cells: DataFrame, share: float = 0.99, floor: float = 2.0) -> DataFrame:
    """Exact percentile of positive rain, at least ``floor``: one row (limit). No task holds the distinct values."""
    found = exact_percentile(cells.where(F.col("valid") & (F.col("rain") > 0)), "rain", share)
    return cells.sparkSession.createDataFrame([(floor if found is None else max(found, floor),)], "limit double")


def run_summary(frames: DataFrame, cells: DataFrame, labels: DataFrame, nodes: DataFrame, edges: DataFrame, events: DataFrame, grid: Grid, hours: float = 1.0) -> DataFrame:
    """One row: numbers of frames, nodes, edges, gaps, events by kind, families, spans, speeds, fractions."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("sequence_id", "branch_id").alias("branches"), F.count_distinct("sequence_id", "family_id").alias("families"))
    largest = nodes.groupBy("sequence_id", "family_id").agg(F.count_distinct("branch_id").alias("k")).agg(F.max("k").alias("largest_family_branches"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("gap") > 0).alias("gap_edges"))
    k = events.agg(*(F.count_if(F.col("event") == kind).alias(f"{kind}_events") for kind in ("split", "merge", "complex")))
    s = branch_spans(nodes, hours).agg(F.median("span_hours").alias("median_span_hours"), F.max("span_hours").alias("max_span_hours"))
    v = branch_speeds(nodes, edges, hours).agg(F.median("cells_per_hour").alias("median_cells_per_hour"))
    c = censored_branches(nodes, frames, grid).agg(F.count_if("censored").alias("censored_branches"))
    f = frame_statistics(frames, cells, labels, grid).agg(F.count("*").alias("frames"), F.avg("wet_fraction").alias("wet_fraction"), F.avg("missing_fraction").alias("missing_fraction"))
    out = f
    for one in (n, largest, e, k, s, v, c):  # each is a single row
        out = out.crossJoin(one)
    return out
