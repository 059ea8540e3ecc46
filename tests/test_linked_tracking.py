"""Tracking with joined overlaps against the kernel that counts cells: same rows, with default options, over many sequences and chunks."""

import functools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.grid import Grid, TrackOptions, disk
from cellweave.operators import lineage
from cellweave.operators.identify import identify
from cellweave.operators.objects import object_table
from tests.helpers import tables


def storm(seed, n=14, side=26):
    """Blobs that move at their own speeds, some of them fast, merge, part and pause."""
    rng = np.random.default_rng(seed)
    cube = np.zeros((n, side, side))
    yy, xx = np.mgrid[:side, :side]
    for _ in range(7):
        y, x, vy, vx, r = rng.uniform(3, side - 3), rng.uniform(3, side - 3), *rng.uniform(-2.6, 2.6, 2), rng.uniform(1.0, 3.2)
        pause = rng.integers(2, n)
        for t in range(n):
            if t != pause:
                cube[t] += np.round(8 * rng.uniform(0.8, 1.2)) * (((yy - y - vy * t) ** 2 + (xx - x - vx * t) ** 2) <= r * r)
    cube[rng.random(cube.shape) < 0.01] = np.nan
    cube[n // 2] = 0  # a dry frame
    return cube


def many(spark, seeds, **options):
    parts = [tables(spark, storm(seed), f"s{seed}", seed % 5) for seed in seeds]
    union = lambda k: functools.reduce(lambda a, b: a.unionByName(b), [p[k] for p in parts])
    return union(0), union(1), parts[0][2]


def rows(graph):
    plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    return [sorted((plain(r) for r in df.collect()), key=str) for df in (graph.nodes, graph.edges, graph.events, graph.family_map, graph.candidates)]


def by_cells(cells, frames, labels, grid, options):
    return lineage.graph_of(lineage.run_lineage(lineage.frame_rows(frames, labels, cells), options, grid).checkpoint())


OPTIONS = {"default": TrackOptions(), "near": TrackOptions(max_displacement=2.5, max_gap=2), "wide gaps": TrackOptions(tau=0.25, max_gap=3, gap_tau=0.3, event_overlap=0.0, max_displacement=6), "no gap": TrackOptions(max_gap=0, max_displacement=4)}


@pytest.mark.parametrize("name", sorted(OPTIONS))
def test_same_as_by_cells_over_many_sequences(spark, name):
    cells, frames, grid = many(spark, range(9))
    labels = identify(cells, grid, 0.5, disk(1))
    got = rows(lineage.track(cells, frames, labels, grid, OPTIONS[name]))
    assert got == rows(by_cells(cells, frames, labels, grid, OPTIONS[name]))
    assert len({r[0] for r in got[0]}) == 9 and got[1] and got[4]
    if name == "default":
        assert {r[5] for r in got[1]} >= {"continue", "split", "complex"}


def test_shifts_that_nobody_guessed_are_joined(spark, monkeypatch):
    """Without any guess the kernel asks for what it needs and comes to the same rows."""
    cells, frames, grid = many(spark, range(3))
    labels = identify(cells, grid, 0.5, disk(0))
    want = rows(by_cells(cells, frames, labels, grid, TrackOptions()))
    runs = []
    plain = lineage.run_lineage
    monkeypatch.setattr(lineage, "run_lineage", lambda *a: runs.append(1) or plain(*a))
    assert rows(lineage.track(cells, frames, labels, grid)) == want
    guessed = len(runs)
    monkeypatch.setattr(lineage, "GUESSES", 0)
    assert rows(lineage.track(cells, frames, labels, grid)) == want and len(runs) - guessed >= guessed > 0


def test_kernel_rows_have_no_cells(spark):
    cells, frames, grid = many(spark, range(2))
    labels = identify(cells, grid, 0.5, disk(0))
    none = spark.createDataFrame([], "sequence_id string, t long, parent_t long, parent_label int, sy int, sx int, child_label int, n long")
    found = lineage.linked_rows(frames, object_table(labels, cells), none, none.drop("child_label", "n"))
    assert "array<bigint>" not in found.schema.simpleString() and "pixels" not in found.schema.simpleString()
    assert found.count() == frames.count() and found.where(F.size("objects") == 0).count() >= 2


def test_chunks_with_saved_states_give_the_rows_of_the_whole(spark):
    """States hold the cells of what they go on from, whichever way they were made; either way goes on from them."""
    cells, frames, grid = many(spark, (0, 5, 10))  # all begin at frame 0
    labels = identify(cells, grid, 0.5, disk(1))
    options = TrackOptions(max_gap=2)
    whole = rows(lineage.track(cells, frames, labels, grid, options))
    states, found, texts = None, [], []
    for span in ("t < 3", "t = 3", "t > 3 and t < 8", "t >= 8"):
        graph = lineage.track(cells.where(span), frames.where(span), labels.where(span), grid, options, states)
        other = lineage.graph_of(lineage.run_lineage(lineage.frame_rows(frames.where(span), labels.where(span), cells.where(span)), options, grid, states).checkpoint())
        kept = [r for r in graph.states.collect()]
        assert {r.sequence_id: json.loads(r.state) for r in kept} == {r.sequence_id: json.loads(r.state) for r in other.states.collect()}
        states = spark.createDataFrame(kept, "sequence_id string, state string")
        found.append(rows(graph))
        texts.append(kept)
    for k in (1, 2, 4):  # nodes' families are those of the chunk
        assert sorted(sum((f[k] for f in found), []), key=str) == whole[k]
    assert sorted((r[:4] for f in found for r in f[0]), key=str) == sorted((r[:4] for r in whole[0]), key=str) and found[-1][3] == whole[3]
    assert any(x["cells"] for r in texts[0] for x in json.loads(r.state)["active"])


def test_nothing_to_track(spark):
    cells, frames, grid = tables(spark, np.zeros((3, 4, 4)))
    graph = lineage.track(cells, frames, identify(cells, grid), Grid(4, 4))
    assert graph.nodes.count() == graph.edges.count() == 0 and graph.states.count() == 1
