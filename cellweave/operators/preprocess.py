"""From raw cells to valid hourly rates: differencing, checks, units, windows, masks.

Cells are rows (sequence_id, t, y, x, rain, valid); a cell without a row is valid and exactly 0.
Checks are aggregates that raise ValueError: the driver sees one row per check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import close_to, is_finite, seconds_between, unit_name
from ..grid import Grid

RATE_UNITS = ("mm/h", "mm/hr", "mmh-1", "mmhr-1")
CUMULATIVE_NAMES = ("RAINNC", "RAINC", "RAINSH")


def require(df: DataFrame, bad: Column, message: str) -> None:
    """Raise ValueError if any row is ``bad``; the plan stops at the first."""
    if not df.where(bad).isEmpty():
        raise ValueError(message)


def require_none(df: DataFrame, *checks: tuple[Column, str]) -> None:
    """``require`` for several conditions in one pass; the first that any row meets is raised."""
    found = df.agg(*(F.bool_or(F.coalesce(bad, F.lit(False))).alias(f"c{k}") for k, (bad, _) in enumerate(checks))).first()
    for hit, (_, message) in zip(found, checks):
        if hit:
            raise ValueError(message)


def difference_cumulative(cells: DataFrame, tolerance: float = 1e-3, check: bool = True) -> DataFrame:
    """Hourly increments (t from the second frame on) of accumulated amounts, in single precision.

    An increment is valid if both ends are finite. One below -tolerance means that the
    accumulation was reset: an error, never clipped; small negatives become 0 (``clipped`` marks them). Every
    cell must have a row in every frame: increments are between rows of neighbouring t.
    """
    order = Window.partitionBy("sequence_id", "y", "x").orderBy("t")
    before, at = F.lag("rain").over(order), F.lag("t").over(order)
    rows = cells.withColumns({"before": before, "gap": F.col("t") - at, "valid": is_finite("rain") & is_finite(before)})
    change = F.when(F.col("valid"), F.col("rain").cast("float") - F.col("before").cast("float")).otherwise(F.lit(float("nan")).cast("float"))
    if check:
        fell = F.col("valid") & (change < -tolerance)
        require_none(rows, (is_finite("rain") & (F.col("rain") < 0), "an accumulated amount is negative"), (F.col("gap") != 1, "frames are missing or irregular"), (fell, "accumulation decreased"))
    raw = rows.where("gap is not null").withColumn("rain", change)
    clipped = F.col("valid") & (F.col("rain") < 0)
    return raw.select("sequence_id", "t", "y", "x", F.when(clipped, F.lit(0.0)).otherwise(F.col("rain")).cast("float").alias("rain"), "valid", clipped.alias("clipped"))


def check_amounts(cells: DataFrame) -> None:
    require(cells, is_finite("rain") & (F.col("rain") < 0), "negative precipitation")


def check_frames_present(cells: DataFrame, grid: Grid) -> None:
    """A frame all of whose cells are missing is an error."""
    lost = cells.groupBy("sequence_id", "t").agg(F.count_if(~F.col("valid")).alias("lost"))
    require(lost, F.col("lost") >= grid.ny * grid.nx, "entire frame is missing")


def cadence(frames: DataFrame) -> DataFrame:
    """(sequence_id, frames, shortest, longest) of each sequence: steps between frames in seconds."""
    order = Window.partitionBy("sequence_id").orderBy("t")
    steps = frames.withColumn("step", seconds_between(F.lag("interval_start").over(order), F.col("interval_start")))
    return steps.groupBy("sequence_id").agg(F.count("*").alias("frames"), F.min("step").alias("shortest"), F.max("step").alias("longest"))


def check_cadence(frames: DataFrame, hours: float | None = None) -> None:
    """Frames' start times must rise by equal steps, of ``hours`` if given.

    Give one frame more on each side of a window, so that its ends are looked at as well.
    """
    require(frames, F.col("interval_start").isNull(), "invalid time")
    spread = cadence(frames)
    require(spread, F.col("shortest") <= 0, "frame times have to be increasing")
    require(spread, F.col("shortest") != F.col("longest"), "irregular time steps")
    if hours is not None:
        require(spread, ~close_to(F.col("shortest") / 3600, F.lit(hours)), "time step disagrees with dt_hours")


def check_interval(kind: str, unit: str) -> None:
    """Amounts per interval are in mm, rates in mm per hour."""
    plain = unit.lower().replace(" ", "")
    if kind == "interval" and plain != "mm":
        raise ValueError("interval amounts need the unit mm")
    if kind == "rate" and plain not in RATE_UNITS:
        raise ValueError("rates need the unit mm/h")
    if kind not in ("interval", "rate"):
        raise ValueError("cumulative input needs the snapshot reader")


def refuse_cumulative(variable: str) -> None:
    if variable.upper() in CUMULATIVE_NAMES:
        raise ValueError("Cumulative variables need the snapshot reader")


def to_rate(cells: DataFrame, hours: float) -> DataFrame:
    """Amount per interval to mm/h."""
    if hours <= 0:
        raise ValueError("dt_hours must be positive")
    return cells.withColumn("rain", (F.col("rain") / F.lit(hours)).cast(cells.schema["rain"].dataType))


def with_unit(df: DataFrame, unit: str = "unit") -> DataFrame:
    return df.withColumn(unit, unit_name(unit))


def crop(cells: DataFrame, grid: Grid, width: int) -> tuple[DataFrame, Grid]:
    """The central square of ``width`` cells, its corner at (0, 0); 0 keeps all. Filters reach the scan."""
    if width < 0:
        raise ValueError("crop must be non-negative")
    if width == 0:
        return cells, grid
    y0, x0 = max(0, (grid.ny - width) // 2), max(0, (grid.nx - width) // 2)
    small = Grid(min(width, grid.ny), min(width, grid.nx))
    kept = cells.where(F.col("y").between(y0, y0 + small.ny - 1) & F.col("x").between(x0, x0 + small.nx - 1))
    return kept.withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0}), small


def time_window(df: DataFrame, start: int, count: int, n_frames: int | None = None) -> DataFrame:
    """Frames ``start`` to ``start + count`` - 1; outside of what there is it's an error."""
    if start < 0 or count < 1 or (n_frames is not None and start + count > n_frames):
        raise ValueError("time window is outside of the input")
    return df.where(F.col("t").between(start, start + count - 1))


def check_same_grid(coordinates: DataFrame) -> None:
    """(sequence_id, t, y, x, lat, lon): the same in every frame, NaN equal to NaN."""
    by_frame = coordinates.groupBy("sequence_id", "t").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("y", "x", "lat", "lon")).alias("h"), F.sum(F.pmod(F.xxhash64("lat", "lon", "x", "y"), F.lit(1 << 31))).alias("s"))
    shapes = by_frame.groupBy("sequence_id").agg(F.count_distinct("n", "h", "s").alias("k"))
    require(shapes, F.col("k") > 1, "Coordinates change between frames")


def provenance_warning(meta: DataFrame, reference: str = "wrfout_ref", start: str = "interval_start") -> DataFrame:
    """Rows of ``meta`` with a warning where the reference file's name lacks the frame's year."""
    missing = F.instr(F.col(reference), F.date_format(start, "yyyy")) == 0
    return meta.withColumn("warning", F.when(missing, F.lit("reference file is of another year")))


def wet_cells(cells: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Valid cells with finite rain >= threshold and > 0. The threshold takes rain's own type."""
    if threshold < 0:
        raise ValueError("threshold: give 0 or more")
    limit = F.lit(threshold).cast(cells.schema["rain"].dataType)
    return cells.where(F.col("valid") & is_finite("rain") & (F.col("rain") >= limit) & (F.col("rain") > 0))


def missing_cells(cells: DataFrame) -> DataFrame:
    return cells.where(~F.coalesce(F.col("valid"), F.lit(False)) | ~is_finite("rain"))


def below_to_zero(cells: DataFrame, threshold: float) -> DataFrame:
    limit = F.lit(threshold).cast(cells.schema["rain"].dataType)
    return cells.withColumn("rain", F.when(is_finite("rain") & (F.col("rain") >= limit), F.col("rain")).otherwise(F.lit(0).cast(cells.schema["rain"].dataType)))


def fill_missing(cells: DataFrame) -> DataFrame:
    """Rain 0 where it isn't finite, which ``valid`` goes on telling apart from dry."""
    ok = is_finite("rain")
    return cells.withColumns({"valid": F.col("valid") & ok, "rain": F.when(ok, F.col("rain")).otherwise(F.lit(0).cast(cells.schema["rain"].dataType))})


def classify_rain(name: str, unit: str, attributes: dict[str, str] | None = None) -> str:
    """cumulative, interval or rate, by name, unit and attributes (``rain_kind`` among them); ValueError where that doesn't tell."""
    attributes = {k.lower(): str(v).lower() for k, v in (attributes or {}).items()}
    if (said := attributes.get("rain_kind")) in ("cumulative", "interval", "rate"):
        return said
    text = " ".join([attributes.get(k, "") for k in ("description", "long_name", "standard_name", "cell_methods")])
    plain = unit.lower().replace(" ", "")
    kinds = set()
    if plain in RATE_UNITS or plain in ("kgm-2s-1", "kg/m2/s", "kg/m^2/s", "mm/s", "mms-1"):
        kinds.add("rate")
    if name.upper() in CUMULATIVE_NAMES or "accumulated" in text or "cumulative" in text:
        kinds.add("cumulative")
    if plain == "mm" and ("interval" in text or "hourly" in text or "time: sum" in text) and "cumulative" not in kinds:
        kinds.add("interval")
    if len(kinds) != 1:
        raise ValueError(f"ambiguous rain variable {name!r}")
    return kinds.pop()


def index_frames(df: DataFrame, index: str = "sample_index", origin: str | None = None, hours: int = 1) -> DataFrame:
    """Frames of an input that has indices only: hourly from ``origin``; without it times are null."""
    start = F.to_timestamp_ntz(F.lit(origin)) if origin else F.lit(None).cast("timestamp_ntz")
    step = F.make_dt_interval(hours=F.col(index) * hours)
    begin = (start + step).cast("timestamp_ntz")
    return df.select("sequence_id", F.col(index).cast("long").alias("t"), begin.alias("interval_start"), (begin + F.make_dt_interval(hours=F.lit(hours))).cast("timestamp_ntz").alias("interval_end"))
