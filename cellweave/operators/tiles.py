"""Objects of frames that are too large for one task: each frame is cut into tiles.

A tile gets the wet cells that can reach it, dilates them, cuts at its missing cells and finds its own components. Components of neighbouring
tiles hang together where their cells touch over a seam; these links, a few for each tile, are united by ``matching.families``. No task holds
more than a tile's cells, and the objects are those of ``identify.identify``, numbers included.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import SQUARE, Footprint, Grid
from .identify import FRAME, _ground, _intervals, _roots, cells_of
from .matching import families, shared_checkpoints
from .preprocess import missing_cells, wet_cells

#: What a task says of a tile: runs of wet cells, and ground cells at a seam, with their component's name.
_FOUND = "sequence_id string, t long, kind int, y int, x0 int, x1 int, part long"
_WET, _SEAM = 0, 1


def _tiles_reached(axis: str, low: int, high: int, side: int, n: int) -> Column:
    """Tiles along an axis that a cell's reach touches, its own among them."""
    first, last = F.greatest(F.col(axis) + min(low, 0), F.lit(0)), F.least(F.col(axis) + max(high, 0), F.lit(n - 1))
    return F.sequence(F.floor(first / side).cast("int"), F.floor(last / side).cast("int"))


def _tile_parts(grid: Grid, shape: Footprint, side: int):
    spans = np.array(shape.spans if shape.holds_origin else (*shape.spans, (0, 0, 0)), np.int64)
    reach_y, reach_x = int(abs(spans[:, 0]).max()), int(abs(spans[:, 1:]).max())
    stride = side + 2 * reach_x + 2  # runs of different rows don't touch

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        sequence, t, ty, tx = (tile[c].iloc[0] for c in (*FRAME, "ty", "tx"))
        y0, x0 = int(ty) * side, int(tx) * side
        here = Grid(min(side, grid.ny - y0), min(side, grid.nx - x0))
        width = here.nx + 2
        y, x, is_wet = tile.y.to_numpy(np.int64) - y0, tile.x.to_numpy(np.int64) - x0, tile.wet.to_numpy(bool)
        out = {"kind": [], "y": [], "x0": [], "x1": [], "part": []}
        wet = np.unique((y[is_wet] + reach_y) * stride + x[is_wet] + reach_x)
        if len(wet):
            a, b = _intervals(wet)
            missing = np.unique(y[~is_wet] * width + x[~is_wet])
            g0, g1 = _ground(a // stride - reach_y, a % stride - reach_x, b % stride - reach_x, spans, here, missing, width)
            root = _roots(g0 // width, g0 % width, g1 % width) if len(g0) else g0
            # a component is named by its first cell: its first run is its root
            name = (int(t) * grid.ny + y0 + g0[root] // width) * grid.nx + x0 + g0[root] % width
            inside = is_wet & (y >= 0) & (y < here.ny) & (x >= 0) & (x < here.nx)
            own = np.unique(y[inside] * width + x[inside])
            if len(own):
                w0, w1 = _intervals(own)
                at = np.searchsorted(g0, w0, "right") - 1
                _add(out, _WET, w0 // width + y0, w0 % width + x0, w1 % width + x0, name[at])
            if len(g0):
                place = np.concatenate([np.arange(p, q + 1) for p, q in zip(g0.tolist(), g1.tolist())])
                of = np.repeat(name, g1 - g0 + 1)
                gy, gx = place // width, place % width
                seam = (gy == 0) & (y0 > 0) | (gy == here.ny - 1) & (y0 + here.ny < grid.ny) | (gx == 0) & (x0 > 0) | (gx == here.nx - 1) & (x0 + here.nx < grid.nx)
                _add(out, _SEAM, gy[seam] + y0, gx[seam] + x0, gx[seam] + x0, of[seam])
        found = pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()})
        found.insert(0, "sequence_id", sequence)
        found.insert(1, "t", t)
        return found

    return run


def _add(out: dict[str, list], kind: int, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, part: np.ndarray) -> None:
    for name, column in (("kind", np.full(len(y), kind)), ("y", y), ("x0", x0), ("x1", x1), ("part", part)):
        out[name].append(column)


def _seam_links(seams: DataFrame) -> DataFrame:
    """(sequence_id, a, b): components with cells beside each other, corners included. Neighbours are looked up ahead only: to the right and below."""
    ahead = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    asked = seams.select(*FRAME, "y", "x0", F.col("part").alias("a"), ahead.alias("s")).select(*FRAME, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x0") + F.col("s.dx")).alias("x0"), "a")
    met = asked.join(seams.select(*FRAME, "y", "x0", F.col("part").alias("b")), [*FRAME, "y", "x0"]).where("a <> b")
    return met.select("sequence_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def identify_tiled_runs(cells: DataFrame, grid: Grid, side: int, threshold: float = 0.0, shape: Footprint = SQUARE, min_size: int = 1) -> DataFrame:
    """(sequence_id, t, y, x0, x1, label): labelled runs of wet cells, as ``identify.identify_runs`` gives them but for runs being cut at tiles.

    Tiles have ``side`` by ``side`` cells. Labels are 1, 2, ... in a frame by the component's first wet cell in row-major order, which
    takes one row per object; components with under ``min_size`` wet cells are left out.
    """
    if min_size < 1 or side < 1:
        raise ValueError("min_size and side: give 1 or more cells")
    shared_checkpoints(cells.sparkSession)
    spans = shape.spans
    ends = {"y": (min(s[0] for s in spans), max(s[0] for s in spans), grid.ny), "x": (min(s[1] for s in spans), max(s[2] for s in spans), grid.nx)}
    wet = wet_cells(cells, threshold).select(*FRAME, "y", "x", F.lit(True).alias("wet"))
    for axis, (low, high, n) in ends.items():
        wet = wet.withColumn(f"t{axis}", F.explode(_tiles_reached(axis, low, high, side, n)))
    missing = missing_cells(cells).select(*FRAME, "y", "x", F.lit(False).alias("wet"), *(F.floor(F.col(axis) / side).cast("int").alias(f"t{axis}") for axis in "yx"))
    tiles = wet.unionByName(missing).select(F.col("sequence_id").cast("string").alias("sequence_id"), F.col("t").cast("long").alias("t"), "ty", "tx", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "wet")
    found = tiles.groupBy(*FRAME, "ty", "tx").applyInPandas(_tile_parts(grid, shape, side), _FOUND).checkpoint()
    links = _seam_links(found.where(F.col("kind") == _SEAM))
    touched = links.select("sequence_id", F.col("a").alias("branch_id")).union(links.select("sequence_id", "b"))
    roots = families(touched, links).select("sequence_id", F.col("branch_id").alias("part"), "family_id")
    runs = found.where(F.col("kind") == _WET).join(roots, ["sequence_id", "part"], "left").select(*FRAME, "y", "x0", "x1", F.coalesce("family_id", "part").alias("root"))
    first = F.min(F.col("y").cast("long") * grid.nx + F.col("x0"))
    objects = runs.groupBy(*FRAME, "root").agg(first.alias("first"), F.sum(F.col("x1") - F.col("x0") + 1).alias("size")).where(F.col("size") >= min_size)
    named = objects.withColumn("label", F.row_number().over(Window.partitionBy(*FRAME).orderBy("first")))
    return runs.join(named.select(*FRAME, "root", "label"), [*FRAME, "root"]).select(*FRAME, "y", "x0", "x1", "label")


def identify_tiled(cells: DataFrame, grid: Grid, side: int, threshold: float = 0.0, shape: Footprint = SQUARE, min_size: int = 1) -> DataFrame:
    """(sequence_id, t, y, x, label): objects of every frame, found tile by tile; background has no rows."""
    return cells_of(identify_tiled_runs(cells, grid, side, threshold, shape, min_size)).select(*FRAME, "y", "x", "label")
