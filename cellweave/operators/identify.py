"""Objects of each frame: wet cells whose dilated neighbourhoods hang together.

An object is the wet cells of one 8-connected component of (dilate(wet) AND valid) OR wet. Cells are
handled as runs, so a disk of radius 9 costs 19 spans per run of wet cells and not 253 per
cell. Frames are independent, and the grid bounds them: identification is one shuffle by frame. The steps
stand as DataFrame operations as well (``runs_of``, ``dilate_runs``, ``subtract_missing``, ``label_runs``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import SQUARE, Footprint, Grid
from .preprocess import missing_cells, wet_cells

FRAME = ("sequence_id", "t")
_ROW = (*FRAME, "y")


def runs_of(cells: DataFrame) -> DataFrame:
    """(sequence_id, t, y, x0, x1): maximal runs of cells side by side. Repeated cells count once."""
    order = Window.partitionBy(*_ROW).orderBy("x")
    island = cells.select(*_ROW, "x").distinct().withColumn("island", F.col("x") - F.row_number().over(order))
    return island.groupBy(*_ROW, "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Runs of the union of the given runs, which may overlap or touch."""
    order = Window.partitionBy(*_ROW).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.withColumn("new", F.coalesce(F.col("x0") > reach + 1, F.lit(True)).cast("int"))
    numbered = begun.withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*_ROW, "k").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("k")


def dilate_runs(runs: DataFrame, shape: Footprint, grid: Grid) -> DataFrame:
    """Runs of the cells that the footprint reaches from any cell of ``runs``, within the grid."""
    spans = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(low).alias("low"), F.lit(high).alias("high")) for dy, low, high in shape.spans))
    reached = runs.withColumn("s", F.explode(spans)).select(*FRAME, (F.col("y") + F.col("s.dy")).alias("y"), F.greatest(F.col("x0") + F.col("s.low"), F.lit(0)).alias("x0"), F.least(F.col("x1") + F.col("s.high"), F.lit(grid.nx - 1)).alias("x1"))
    return merge_runs(reached.where(F.col("y").between(0, grid.ny - 1) & (F.col("x0") <= F.col("x1"))))


def subtract_missing(runs: DataFrame, missing: DataFrame, grid: Grid) -> DataFrame:
    """``runs`` without missing cells: missing cells are a barrier."""
    gaps = runs_of(missing)
    order = Window.partitionBy(*_ROW).orderBy("x0")
    # what lies between a row's gaps, and on both sides
    left = gaps.select(*_ROW, (F.coalesce(F.lag("x1").over(order), F.lit(-1)) + 1).alias("a"), (F.col("x0") - 1).alias("b"))
    right = gaps.groupBy(*_ROW).agg((F.max("x1") + 1).alias("a")).withColumn("b", F.lit(grid.nx - 1))
    open_ = left.unionByName(right).where("a <= b").withColumn("gapped", F.lit(True))
    rows = gaps.select(*_ROW).distinct().withColumn("gapped", F.lit(True))
    whole = runs.join(rows, list(_ROW), "left_anti")
    cut = runs.join(open_.drop("gapped"), list(_ROW)).where("a <= x1 and b >= x0").select(*_ROW, F.greatest("a", "x0").alias("x0"), F.least("b", "x1").alias("x1"))
    return whole.select(*_ROW, "x0", "x1").unionByName(cut)


def _roots(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int = 1) -> np.ndarray:
    """Component of each run (sorted by y, x0): runs of neighbouring rows hang together if they overlap
    after widening by ``reach``."""
    parent = np.arange(len(y))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    rows, start = np.unique(y, return_index=True)
    bounds = dict(zip(rows.tolist(), zip(start.tolist(), np.append(start[1:], len(y)).tolist())))
    for row, (a, b) in bounds.items():
        if row - 1 not in bounds:
            continue
        c, d = bounds[row - 1]
        first = c + np.searchsorted(x1[c:d], x0[a:b] - reach, "left")
        last = c + np.searchsorted(x0[c:d], x1[a:b] + reach, "right")
        for k, (f, g) in enumerate(zip(first.tolist(), last.tolist())):
            for j in range(f, g):
                p, q = find(a + k), find(j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return np.array([find(k) for k in range(len(y))], dtype=np.int64)


def _label_frames(nx: int, min_size: int, connectivity: int):
    reach = 1 if connectivity == 8 else 0

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x0"], kind="stable")
        ground, wet = frame[~frame.wet], frame[frame.wet]
        root = _roots(ground.y.to_numpy(), ground.x0.to_numpy(), ground.x1.to_numpy(), reach)
        # each wet run lies in one run of the ground: the last that begins at or before it
        at = np.searchsorted(ground.y.to_numpy() * nx + ground.x0.to_numpy(), wet.y.to_numpy() * nx + wet.x0.to_numpy(), "right") - 1
        owner = root[at]
        size = np.bincount(owner, (wet.x1 - wet.x0 + 1).to_numpy(), minlength=len(ground))
        kept = size[owner] >= min_size
        _, first = np.unique(owner[kept], return_index=True)
        label = np.zeros(len(ground) + 1, np.int64)
        label[owner[kept][np.sort(first)]] = np.arange(1, len(first) + 1)  # wet runs are in row-major order
        out = wet[kept][["sequence_id", "t", "y", "x0", "x1"]].copy()
        out["label"] = label[owner[kept]].astype(np.int32)
        return out

    return run


def _intervals(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers of a sorted list."""
    cut = np.flatnonzero(np.diff(place) > 1)
    return place[np.append(0, cut + 1)], place[np.append(cut, len(place) - 1)]


def _ground(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, spans: np.ndarray, grid: Grid, missing: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of cells that the footprint reaches from the given runs and that aren't missing. Cells are
    numbered y * width + x with ``width`` over the grid's, so stretches of different rows don't touch."""
    ry = (y[:, None] + spans[:, 0]).ravel()
    a, b = np.maximum(x0[:, None] + spans[:, 1], 0).ravel(), np.minimum(x1[:, None] + spans[:, 2], grid.nx - 1).ravel()
    inside = (ry >= 0) & (ry < grid.ny) & (a <= b)
    start, stop = ry[inside] * width + a[inside], ry[inside] * width + b[inside] + 1
    m0, m1 = _intervals(missing) if len(missing) else (missing, missing - 1)
    # one sweep over all ends: how many reaches and how many gaps are open after each
    at = np.concatenate([start, stop, m0, m1 + 1])
    if not len(at):
        return at, at
    reach = np.concatenate([np.ones(len(start)), -np.ones(len(stop)), np.zeros(2 * len(m0))])
    gap = np.concatenate([np.zeros(2 * len(start)), np.ones(len(m0)), -np.ones(len(m1))])
    order = np.argsort(at, kind="stable")
    at, last = np.unique(at[order], return_index=True)
    last = np.append(last[1:], len(order)) - 1
    held = (np.cumsum(reach[order])[last] > 0) & (np.cumsum(gap[order])[last] == 0)
    first = np.flatnonzero(held & ~np.append(False, held[:-1]))
    end = np.flatnonzero(~held & np.append(False, held[:-1]))
    return at[first], at[end] - 1


def _identify_frames(grid: Grid, shape: Footprint, min_size: int):
    spans = np.array(shape.spans, np.int64)
    if not shape.holds_origin:
        spans = np.vstack([spans, (0, 0, 0)])  # wet cells belong to the ground, whatever they reach
    width = grid.nx + 2
    label = _label_frames(grid.nx, min_size, 8)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        place = (frame.y.to_numpy(np.int64) * width + frame.x.to_numpy(np.int64))
        wet = np.unique(place[frame.wet.to_numpy(bool)])
        if not len(wet):
            none = frame[["sequence_id", "t", "y"]].iloc[:0]
            return none.assign(x0=none.y, x1=none.y, label=np.zeros(0, np.int32))
        w0, w1 = _intervals(wet)
        g0, g1 = _ground(w0 // width, w0 % width, w1 % width, spans, grid, np.unique(place[~frame.wet.to_numpy(bool)]), width)
        both = pd.DataFrame({"y": np.concatenate([g0, w0]) // width, "x0": np.concatenate([g0, w0]) % width, "x1": np.concatenate([g1, w1]) % width, "wet": np.arange(len(g0) + len(w0)) >= len(g0)})
        both.insert(0, "sequence_id", frame.sequence_id.iloc[0])
        both.insert(1, "t", frame.t.iloc[0])
        return label(both)

    return run


def identify_runs(cells: DataFrame, grid: Grid, threshold: float = 0.0, shape: Footprint = SQUARE, min_size: int = 1) -> DataFrame:
    """(sequence_id, t, y, x0, x1, label): labelled runs of wet cells.

    One shuffle by frame of the wet and the missing cells; all else happens on a frame's runs.
    """
    if min_size < 1:
        raise ValueError("min_size: give 1 or more cells")
    wet = wet_cells(cells, threshold).select(*_ROW, "x", F.lit(True).alias("wet"))
    both = wet.unionByName(missing_cells(cells).select(*_ROW, "x", F.lit(False).alias("wet")))
    kinds = dict(both.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in _ROW) + f", x0 {kinds['x']}, x1 {kinds['x']}, label int"
    return both.groupBy(*FRAME).applyInPandas(_identify_frames(grid, shape, min_size), schema)


def label_runs(ground: DataFrame, wet: DataFrame, grid: Grid, min_size: int = 1, connectivity: int = 8) -> DataFrame:
    """Components of ``ground``, painted on the runs of ``wet`` (each within one of ground).

    Labels are 1, 2, ... in a frame by the component's first wet cell in row-major order; components with
    under ``min_size`` wet cells are left out. A frame, which the grid bounds, is one group.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    both = ground.select(*_ROW, "x0", "x1", F.lit(False).alias("wet")).unionByName(wet.select(*_ROW, "x0", "x1", F.lit(True).alias("wet")))
    kinds = dict(both.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*_ROW, "x0", "x1")) + ", label int"
    return both.groupBy(*FRAME).applyInPandas(_label_frames(grid.nx, min_size, connectivity), schema)


def cells_of(runs: DataFrame) -> DataFrame:
    """One row per cell of the runs."""
    kind = dict(runs.dtypes)["x0"]
    return runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("x", F.col("x").cast(kind)).drop("x0", "x1")


def identify(cells: DataFrame, grid: Grid, threshold: float = 0.0, shape: Footprint = SQUARE, min_size: int = 1) -> DataFrame:
    """(sequence_id, t, y, x, label): objects of every frame; background has no rows."""
    return cells_of(identify_runs(cells, grid, threshold, shape, min_size)).select(*FRAME, "y", "x", "label")


def identify_frame(cells: DataFrame, grid: Grid, t: int, **options) -> DataFrame:
    """Objects of frame ``t`` only; the filter reaches the scan."""
    return identify(cells.where(F.col("t") == t), grid, **options)


def seeded_envelope(cells: DataFrame, seeds: DataFrame, grid: Grid, threshold: float, connectivity: int = 8, mode: str = "system") -> DataFrame:
    """(sequence_id, t, y, x, label): components of rain >= threshold that hold a cell of ``seeds``."""
    if mode != "system":
        raise NotImplementedError("the flooding order of partition mode has no published definition")
    if threshold <= 0:
        raise ValueError("the envelope threshold must be positive")
    weak = runs_of(wet_cells(cells, threshold))
    found = cells_of(label_runs(weak, weak, grid, 1, connectivity))
    held = found.join(seeds.select(*FRAME, "y", "x").distinct(), [*FRAME, "y", "x"], "left_semi").select(*FRAME, "label").distinct()
    rank = Window.partitionBy(*FRAME).orderBy("label")
    names = held.withColumn("new", F.row_number().over(rank))
    return found.join(names, [*FRAME, "label"]).select(*FRAME, "y", "x", F.col("new").alias("label"))


def identify_envelope(cells: DataFrame, grid: Grid, core_threshold: float, envelope_threshold: float, shape: Footprint = SQUARE, min_size: int = 1, connectivity: int = 8, mode: str = "system") -> tuple[DataFrame, DataFrame]:
    """Core objects, and the envelopes that hold any of their cells."""
    if not 0 < envelope_threshold <= core_threshold:
        raise ValueError("0 < envelope threshold <= core threshold is needed")
    cores = identify(cells, grid, core_threshold, shape, min_size)
    return cores, seeded_envelope(cells, cores, grid, envelope_threshold, connectivity, mode)


def envelope_statistics(cells: DataFrame, envelopes: DataFrame, cores: DataFrame, areas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(statistics, membership) of envelopes.

    Statistics count cells, rain and cores; ``areas`` (y, x, cell_area in km2) gives area and volume rate
    (m3/h: mm/h * km2 * 1000), which are null without it. Membership has a row for each envelope and core.
    """
    key = [*FRAME, "y", "x"]
    core = cores.select(*key, F.col("label").alias("core_label"))
    rows = envelopes.join(cells.select(*key, "rain"), key).join(core, key, "left")
    if areas is not None:
        rows = rows.join(areas.select("y", "x", "cell_area"), ["y", "x"], "left")
    else:
        rows = rows.withColumn("cell_area", F.lit(None).cast("double"))
    r, inside = F.col("rain").cast("double"), F.col("core_label").isNotNull()
    stats = rows.groupBy(*FRAME, "label").agg(
        F.count("*").alias("envelope_cells"), F.count_if(inside).alias("core_cells"), F.count_distinct("core_label").alias("cores"), F.sum(r).alias("rain_sum"), F.avg(r).alias("rain_mean"), F.max(r).alias("rain_max"),
        F.sum(F.when(inside, r).otherwise(0.0)).alias("core_rain_sum"), (F.sum(F.col("y") * r) / F.sum(r)).alias("centroid_y"), (F.sum(F.col("x") * r) / F.sum(r)).alias("centroid_x"),
        F.min("y").alias("y_start"), (F.max("y") + 1).alias("y_stop"), F.min("x").alias("x_start"), (F.max("x") + 1).alias("x_stop"),
        F.sum("cell_area").alias("area_km2"), F.sum(r * F.col("cell_area") * 1000).alias("volume_rate_m3_h"),
    ).withColumn("core_fraction", F.col("core_cells") / F.col("envelope_cells"))
    membership = rows.where(inside).groupBy(*FRAME, "label", "core_label").agg(F.count("*").alias("cells"))
    return stats, membership


