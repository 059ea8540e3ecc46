"""Short prepared cubes against the arrays they come from."""

import datetime
import json
import os
import shutil

import numpy as np
import pytest

from cellweave.__main__ import main
from cellweave.grid import TrackOptions, disk
from cellweave.operators.identify import identify
from cellweave.operators.lineage import track
from cellweave.sources.prepared import prepare_cube
from tests.helpers import tables
from tests.test_series import put_classic, totals

START = datetime.datetime(1996, 7, 31, 20)  # over the end of a month


def put(folder, cube, start=START):
    os.makedirs(folder, exist_ok=True)
    for k, frame in enumerate(cube):
        t = start + datetime.timedelta(hours=k)
        put_classic(f"{folder}/cstm_d01_{t:%Y-%m-%d_%H:%M:%S}.rain", "RAINNC", frame[None].astype("f4"), stamps=[f"{t:%Y-%m-%d_%H:%M:%S}"])


def test_cube_of_snapshots(spark, tmp_path):
    cube = np.nan_to_num(totals(n=12)).cumsum(axis=0)
    put(tmp_path / "in", cube)
    put(tmp_path / "in" / "below", cube, START - datetime.timedelta(hours=12))  # folders below and other names don't count
    shutil.copy(tmp_path / "in" / "cstm_d01_1996-07-31_20:00:00.rain", tmp_path / "in" / "cstm_d01_1996-07-31_20:00:00.nc")
    main(["prepare", str(tmp_path / "in"), "--start", "1996-07-31T22:00:00", "--hours", "8", "--output-dir", str(tmp_path / "out")])
    got = np.load(tmp_path / "out" / "rain_mm_h.npy")
    assert got.dtype == np.float32 and np.array_equal(got, np.diff(cube[2:11].astype(np.float32), axis=0))
    told = json.load(open(tmp_path / "out" / "input_metadata.json"))
    assert (told["start"], told["end"], told["grid"]) == ("1996-07-31T22:00:00", "1996-08-01T06:00:00", {"ny": 5, "nx": 7})
    assert len(told["source_files"]) == 9 and told["source_files"][0] == "cstm_d01_1996-07-31_22:00:00.rain"
    assert sorted(os.listdir(tmp_path / "out")) == ["input_metadata.json", "rain_mm_h.npy"]
    with pytest.raises(FileExistsError):
        prepare_cube(spark, str(tmp_path / "in"), "1996-07-31T22:00:00", 8, str(tmp_path / "out"))


def test_dry_hours_have_frames(spark, tmp_path):
    put(tmp_path / "in", np.ones((4, 3, 3)))
    prepare_cube(spark, str(tmp_path / "in"), START.isoformat(), 3, str(tmp_path / "out"))
    assert np.array_equal(np.load(tmp_path / "out" / "rain_mm_h.npy"), np.zeros((3, 3, 3), np.float32))


@pytest.mark.parametrize("kind", ["hours", "before", "hole", "nan", "fall", "twice"])
def test_refused(spark, tmp_path, kind):
    cube = np.arange(5.0)[:, None, None] * np.ones((5, 3, 3))
    if kind == "nan":
        cube[2, 1, 1] = np.nan
    if kind == "fall":
        cube[3, 0, 0] = 0
    put(tmp_path / "in", cube)
    start, hours = START, 4
    if kind == "hours":
        hours = 73
    if kind == "before":
        start, hours = START - datetime.timedelta(hours=1), 3
    if kind == "hole":
        os.remove(tmp_path / "in" / "cstm_d01_1996-07-31_22:00:00.rain")
    if kind == "twice":
        shutil.copy(tmp_path / "in" / "cstm_d01_1996-07-31_22:00:00.rain", tmp_path / "in" / "cstm_d01_1996-07-31_22_00_00.rain")
    message = {"hours": "1 to 72", "before": "no snapshot", "hole": "no snapshot", "nan": "finite", "fall": "decreased", "twice": "same time"}[kind]
    with pytest.raises(Exception, match=message):
        prepare_cube(spark, str(tmp_path / "in"), start.isoformat(), hours, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out" / "rain_mm_h.npy")


def test_twelve_frames_over_the_end_of_a_month(spark, tmp_path):
    """One object moves for twelve hours and isn't seen in one of them: 11 nodes, 10 edges, one of them over the gap, one branch."""
    rate = np.zeros((12, 12, 24))
    for t in range(12):
        if t != 5:
            rate[t, 4:8, t : t + 5] = 2
    put(tmp_path / "in", np.concatenate([np.zeros((1, 12, 24)), rate.cumsum(axis=0)]))
    prepare_cube(spark, str(tmp_path / "in"), START.isoformat(), 12, str(tmp_path / "out"))
    rain = np.load(tmp_path / "out" / "rain_mm_h.npy")
    cells, frames, grid = tables(spark, rain)
    graph = track(cells, frames, identify(cells, grid, 1.0, disk(1)), grid, TrackOptions())
    edges = graph.edges.collect()
    assert graph.nodes.count() == 11 and len(edges) == 10 and [e.gap for e in edges if e.event == "gap_continue"] == [1]
    assert graph.family_map.count() == 1 and graph.events.count() == 0
