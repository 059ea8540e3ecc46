"""Objects found tile by tile, against whole frames and the naive version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.grid import SQUARE, Grid, disk, footprint
from cellweave.operators import tiles
from cellweave.operators.identify import identify
from tests.helpers import dense, naive_identify, tables

SHAPES = {"square": SQUARE, "disk0": disk(0), "disk3": disk(3), "no origin": footprint([[1, 0, 1]]), "bar": footprint([[1, 1, 1, 1, 1, 1, 0]]), "plus": footprint([[0, 1, 0], [1, 1, 1], [0, 1, 0]])}


def cube(seed, n, ny, nx, wet=0.15, lost=0.1):
    rng = np.random.default_rng(seed)
    out = rng.random((n, ny, nx)) * (rng.random((n, ny, nx)) < wet)
    out[rng.random(out.shape) < lost] = np.nan
    return out


@pytest.mark.parametrize("name, side", [("square", 1), ("square", 5), ("disk0", 4), ("disk3", 2), ("disk3", 7), ("disk3", 40), ("no origin", 4), ("no origin", 1), ("bar", 5), ("plus", 7)])
def test_tiles_give_the_labels_of_whole_frames(spark, name, side):
    shape = SHAPES[name]
    data = cube(len(name) + side, 5, 13, 11)
    data[2] = 0  # a dry frame
    cells, _, grid = tables(spark, data)
    got = dense(tiles.identify_tiled(cells, grid, side, 0.2, shape), data.shape)
    offsets = [(dy, dx) for dy, low, high in shape.spans for dx in range(low, high + 1)]
    want = np.stack([naive_identify(f.astype(np.float32), offsets, 0.2) for f in data])
    assert np.array_equal(got, want) and want.max() >= 1


@pytest.mark.parametrize("side", [3, 6])
def test_least_size_counts_over_tiles(spark, side):
    data = cube(5, 4, 18, 18, 0.25, 0.05)
    cells, _, grid = tables(spark, data)
    for least in (2, 6):
        got = dense(tiles.identify_tiled(cells, grid, side, 0.0, SQUARE, least), data.shape)
        assert np.array_equal(got, dense(identify(cells, grid, 0.0, SQUARE, least), data.shape))


def test_long_objects_over_many_seams(spark):
    """Spirals and combs: components that meet again and again through other tiles."""
    data = np.zeros((3, 24, 24))
    data[0, ::4, :] = 1
    data[0, 2::8, :1] = data[0, :, 0] = 1
    for k in range(0, 12, 2):
        data[1, k, k : 24 - k] = data[1, k : 24 - k, 23 - k] = data[1, 23 - k, k : 24 - k] = 1
        data[1, k + 2 : 24 - k, k] = 1
        data[1, k + 2, k : k + 3] = 1
    data[2] = np.eye(24) + np.eye(24)[::-1]  # over corners of tiles only
    cells, _, grid = tables(spark, data)
    for side in (3, 4, 5):
        got = dense(tiles.identify_tiled(cells, grid, side, 0.0, disk(0)), data.shape)
        assert np.array_equal(got, dense(identify(cells, grid, 0.0, disk(0)), data.shape))
    assert got[0].max() == got[1].max() == got[2].max() == 1


def test_a_missing_wall_on_a_seam(spark):
    """A barrier stays one where it stands along the tiles' border; the reach over it joins nothing."""
    data = np.zeros((1, 8, 8))
    data[0, 3, :], data[0, 5, :], data[0, 4, :] = 1, 1, np.nan
    cells, _, grid = tables(spark, data)
    got = dense(tiles.identify_tiled(cells, grid, 4, 0.0, disk(2)), data.shape)
    assert np.array_equal(got, dense(identify(cells, grid, 0.0, disk(2)), data.shape)) and got.max() == 2


def test_no_task_gets_a_frame(spark, monkeypatch):
    """Groups are tiles: a tile's cells and the wet ones that reach it."""
    data = cube(9, 3, 30, 30, 0.5, 0.02)
    cells, _, grid = tables(spark, data)
    plain = tiles._tile_parts

    def watched(grid, shape, side):
        run = plain(grid, shape, side)

        def checked(tile):
            assert len(tile) <= (side + 2) ** 2, len(tile)
            return run(tile)

        return checked

    monkeypatch.setattr(tiles, "_tile_parts", watched)
    assert tiles.identify_tiled(cells, grid, 10).agg(F.max("label")).first()[0] >= 1


def test_arguments(spark):
    cells, _, grid = tables(spark, cube(1, 1, 4, 4))
    for bad in ({"side": 0}, {"side": 2, "min_size": 0}):
        with pytest.raises(ValueError):
            tiles.identify_tiled(cells, grid, **bad)
    assert tiles.identify_tiled(cells.where("false"), Grid(4, 4), 2).count() == 0
