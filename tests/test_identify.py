import numpy as np
import pytest

from cellweave.grid import SQUARE, Footprint, disk, footprint
from cellweave.operators.identify import envelope_statistics, identify, identify_envelope, identify_frame, seeded_envelope
from tests.helpers import dense, naive_identify, tables


def offsets(shape: Footprint):
    return [(dy, dx) for dy, low, high in shape.spans for dx in range(low, high + 1)]


def test_disk_is_all_cells_within_the_radius():
    for r in range(6):
        want = {(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if y * y + x * x <= r * r}
        assert set(offsets(disk(r))) == want


def test_footprints_need_odd_sides():
    assert set(offsets(footprint([[0, 1, 0], [1, 0, 1], [0, 1, 0]]))) == {(-1, 0), (1, 0), (0, -1), (0, 1)}
    for bad in ([[1, 1], [1, 1]], [], [[0]], [[1, 0]]):
        with pytest.raises(ValueError):
            footprint(bad)


def test_two_objects_and_one(spark):
    cube = np.zeros((3, 30, 30))
    cube[:, 10:14, 10:14] = 2
    cube[1, 10:14, 18:22] = 1
    cells, _, grid = tables(spark, cube)
    out = dense(identify(cells, grid), cube.shape)
    assert [out[t].max() for t in range(3)] == [1, 2, 1]
    assert dense(identify_frame(cells, grid, 1), cube.shape)[1].max() == 2


def test_barrier_and_threshold(spark):
    cube = np.zeros((1, 7, 12))
    cube[0, 1:3, 8:10], cube[0, 4:6, 1:3], cube[0, 3] = 2, 1, np.nan
    cells, _, grid = tables(spark, cube)
    out = dense(identify(cells, grid, 1.5, footprint(np.ones((5, 5)))), cube.shape)
    assert out.max() == 1 and not out[0, 4:6, 1:3].any() and not out[0, 3].any()


@pytest.mark.parametrize(("radius", "gap", "n"), [(2, False, 1), (1, False, 2), (2, True, 2)])
def test_bridges(spark, radius, gap, n):
    cube = np.zeros((1, 1, 9))
    cube[0, 0, [0, 4]] = 1
    if gap:
        cube[0, 0, 2] = np.nan
    cells, _, grid = tables(spark, cube)
    assert dense(identify(cells, grid, shape=disk(radius)), cube.shape).max() == n


def test_diagonal_passes_a_barrier(spark):
    cells, _, grid = tables(spark, [[[1, np.nan], [np.nan, 1]]])
    assert dense(identify(cells, grid, shape=disk(0)), (1, 2, 2)).max() == 1


def test_not_finite_is_never_wet(spark):
    cells, _, grid = tables(spark, [[[np.inf, np.nan, 0, 3]]])
    assert dense(identify(cells, grid), (1, 1, 4)).tolist() == [[[0, 0, 0, 1]]]


@pytest.mark.parametrize(("shape", "size"), [(disk(0), 1), (SQUARE, 1), (disk(2), 3), (footprint([[1, 0, 1], [0, 0, 0], [1, 0, 1]]), 1)])
def test_against_flood_fill(spark, shape, size):
    rng = np.random.default_rng(len(shape.spans) + size)
    cube = np.where(rng.random((6, 14, 17)) < 0.12, rng.random((6, 14, 17)) * 3, 0)
    cube[rng.random(cube.shape) < 0.08] = np.nan
    cells, _, grid = tables(spark, cube)
    got = dense(identify(cells, grid, 0.5, shape, size), cube.shape)
    for t in range(len(cube)):
        assert (got[t] == naive_identify(cube[t].astype(np.float32), offsets(shape), 0.5, size)).all()


def test_arguments(spark):
    cells, _, grid = tables(spark, np.ones((1, 2, 2)))
    for bad in ({"min_size": 0}, {"threshold": -1.0}):
        with pytest.raises(ValueError):
            identify(cells, grid, **bad)
    with pytest.raises(NotImplementedError):
        seeded_envelope(cells, identify(cells, grid), grid, 0.5, mode="partition")


def test_envelopes(spark):
    cube = np.zeros((1, 5, 12))
    cube[0, 1, 1:5] = [0.2, 2, 0.3, 0.2]
    cube[0, 3, 8:10] = 0.4
    cells, _, grid = tables(spark, cube)
    cores, envelopes = identify_envelope(cells, grid, 1.0, 0.1, disk(0))
    assert dense(envelopes, cube.shape)[0].tolist() == (np.where(cube[0] * (np.arange(5) == 1)[:, None] > 0, 1, 0)).tolist()
    stats, members = envelope_statistics(cells, envelopes, cores)
    row = stats.first()
    assert (row.envelope_cells, row.core_cells, row.cores, row.volume_rate_m3_h) == (4, 1, 1, None)
    assert members.first().cells == 1
    with pytest.raises(ValueError):
        identify_envelope(cells, grid, 1.0, 2.0)
