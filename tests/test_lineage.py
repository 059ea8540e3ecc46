import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.grid import TrackOptions, disk
from cellweave.operators.identify import identify
from cellweave.operators.lineage import Lineage, branch_cells, check_state, frame_rows, load_state, run_lineage, save_state, track
from cellweave.operators.matching import ambiguous_children, assign, best_assignment, bipartite_groups, event_kind
from tests.helpers import dense, tables


def cube_of(shape, boxes):
    cube = np.zeros(shape)
    for t, y, x in boxes:
        cube[t, slice(*y), slice(*x)] = 2
    return cube


def run(spark, cube, start=0, states=None, **options):
    cells, frames, grid = tables(spark, cube, start=start)
    labels = identify(cells, grid, shape=disk(0))
    graph = track(cells, frames, labels, grid, TrackOptions(**options), states)
    return graph, labels


def rows(df, *order):
    return sorted(tuple(sorted(r.asDict().items(), key=lambda x: x[0])) for r in df.collect()) if not order else [tuple(r) for r in df.orderBy(*order).collect()]


def kinds(graph):
    return sorted(r.event for r in graph.edges.collect())


MOVE = cube_of((3, 40, 40), [(t, (10, 15), (10 + t, 15 + t)) for t in range(3)])
SPLIT = cube_of((2, 20, 20), [(0, (8, 12), (5, 15)), (1, (8, 12), (5, 9)), (1, (8, 12), (11, 15))])
GAP = cube_of((6, 20, 20), [(0, (8, 12), (8, 12)), (2, (8, 12), (9, 13)), (5, (8, 12), (10, 14))])


def test_move(spark):
    graph, labels = run(spark, MOVE, tau=0.2, max_displacement=4)
    assert kinds(graph) == ["continue", "continue"] and graph.nodes.select("branch_id").distinct().count() == 1
    raster = dense(branch_cells(labels, graph.nodes), MOVE.shape, "branch_id")
    assert ((raster > 0) == (MOVE > 0)).all()


def test_split_and_merge(spark):
    graph, _ = run(spark, SPLIT, tau=0.2, max_displacement=5)
    event = graph.events.collect()
    assert [e.event for e in event] == ["split"] and kinds(graph) == ["split", "split"]
    branches = {r.node_id: r.branch_id for r in graph.nodes.collect()}
    assert len(set(branches.values())) == 3
    graph, _ = run(spark, SPLIT[::-1], tau=0.2, max_displacement=5)
    assert [e.event for e in graph.events.collect()] == ["merge"]
    assert graph.nodes.select("family_id").distinct().count() == 1


def test_gap(spark):
    graph, _ = run(spark, GAP, tau=0.2, gap_tau=0.2, max_displacement=4, max_gap=1)
    at = {r.time: r.branch_id for r in graph.nodes.collect()}
    assert at[0] == at[2] != at[5] and kinds(graph) == ["gap_continue"]
    assert graph.edges.first().gap == 1
    graph, _ = run(spark, GAP, tau=0.2, gap_tau=0.2, max_displacement=4, max_gap=1, gap_min_pixels=17)
    assert kinds(graph) == []


def test_ambiguous_gap(spark):
    cube = cube_of((3, 20, 20), [(0, (8, 10), (4, 6)), (0, (8, 10), (12, 14)), (2, (8, 10), (8, 10))])
    graph, _ = run(spark, cube, tau=0.1, gap_tau=0.1, gap_ambiguity=0.05, max_displacement=10)
    assert kinds(graph) == [] and graph.nodes.select("branch_id").distinct().count() == 3


@pytest.mark.parametrize("cut", [1, 2, 3, 5])
def test_chunks_give_the_same(spark, cut):
    cube = cube_of((6, 24, 24), [(t, (8, 12), (6 + t, 10 + t)) for t in (0, 1, 3, 4, 5)])
    options = {"tau": 0.2, "gap_tau": 0.2, "max_displacement": 4}
    whole, _ = run(spark, cube, **options)
    first, _ = run(spark, cube[:cut], **options)
    second, _ = run(spark, cube[cut:], start=cut, states=first.states, **options)
    assert rows(whole.edges) == sorted(rows(first.edges) + rows(second.edges))
    assert rows(whole.nodes.drop("family_id")) == sorted(rows(first.nodes.drop("family_id")) + rows(second.nodes.drop("family_id")))
    assert rows(whole.family_map) == rows(second.family_map)
    assert whole.states.first().state == second.states.first().state


def test_events_over_a_chunk_boundary(spark):
    cube = cube_of((4, 24, 24), [(0, (9, 13), (5, 17)), (1, (9, 13), (5, 10)), (1, (9, 13), (12, 17)), (2, (9, 13), (5, 17)), (3, (9, 13), (6, 18))])
    options = {"tau": 0.2, "max_displacement": 5}
    whole, _ = run(spark, cube, **options)
    assert [(e.time, e.event) for e in whole.events.orderBy("event_id").collect()] == [(1, "split"), (2, "merge")]
    parts, states = [], None
    for a, b in ((0, 1), (1, 2), (2, 4)):
        graph, _ = run(spark, cube[a:b], start=a, states=states, **options)
        states = graph.states
        parts += rows(graph.events)
    assert sorted(parts) == rows(whole.events)


def test_reversal_keeps_a_branch(spark):
    cube = cube_of((3, 12, 100), [(t, (4, 8), (x, x + 30)) for t, x in enumerate((20, 39, 25))])
    graph, _ = run(spark, cube, tau=0.35, max_displacement=20)
    assert graph.nodes.select("branch_id").distinct().count() == 1
    assert graph.edges.orderBy(F.desc("time")).first().distance > 20


def test_overlap_admits_far_objects(spark):
    graph, _ = run(spark, cube_of((2, 12, 160), [(0, (4, 8), (10, 110)), (1, (4, 8), (35, 135))]), tau=0.35, max_displacement=5)
    assert [round(e.raw_iou, 6) for e in graph.edges.collect()] == [0.6]


def test_boxes_alone_admit_nothing():
    def thing(cells, y, x):
        ys, xs = [c[0] for c in cells], [c[1] for c in cells]
        return {"label": 1, "area_cells": 2, "centroid_y": y, "centroid_x": x, "mean_intensity": 50.5, "max_intensity": 100.0, "precipitation_sum": 101.0, "y_start": min(ys), "y_stop": max(ys) + 1, "x_start": min(xs), "x_stop": max(xs) + 1, "cells": [a * (1 << 20) + b for a, b in cells]}

    lineage = Lineage(TrackOptions(max_displacement=1))
    lineage.advance(0, [thing([(0, 0), (9, 9)], 0.1, 0.1)])
    assert lineage.advance(1, [thing([(0, 9), (9, 0)], 0.1, 8.9)])["candidate"] == []


def test_split_merge_and_gap_together(spark):
    halves = [(8, 12), (5, 9)], [(8, 12), (11, 15)]
    cube = cube_of((5, 20, 20), [(0, (8, 12), (5, 15)), *((1, y, x) for y, x in halves), (2, (8, 12), (5, 15)), (4, (8, 12), (5, 15))])
    graph, _ = run(spark, cube, tau=0.35, max_displacement=5)
    assert sorted(e.event for e in graph.events.collect()) == ["merge", "split"]
    assert kinds(graph).count("gap_continue") == 1


def test_time_goes_on_through_empty_frames():
    lineage = Lineage(TrackOptions())
    for t in (3, 4, 5):
        lineage.advance(t, [])
    with pytest.raises(ValueError, match="contiguous"):
        lineage.advance(7, [])
    with pytest.raises(ValueError, match="increasing"):
        lineage.advance(5, [])


def test_guards(spark, tmp_path):
    first = Lineage(TrackOptions(), sequence_id="a")
    first.advance(0, [])
    with pytest.raises(ValueError, match="sequence_id"):
        Lineage(TrackOptions(), json.loads(json.dumps(first.state)), "b")
    with pytest.raises(ValueError, match="parameters"):
        Lineage(TrackOptions(tau=0.5), first.state)
    with pytest.raises(ValueError, match="parameters"):
        Lineage(TrackOptions(), first.state | {"config": {k: v for k, v in first.state["config"].items() if k != "algorithm_revision"}})
    with pytest.raises(ValueError, match="schema_version"):
        check_state({"schema_version": 7})
    save_state(first.state, str(tmp_path / "s.json"))
    assert load_state(str(tmp_path / "s.json")) == first.state
    with pytest.raises(NotImplementedError):
        run_policy(spark)
    for bad in ({"tau": 2}, {"max_displacement": 0}, {"max_gap": -1}, {"event_overlap": -0.1}):
        with pytest.raises(ValueError):
            TrackOptions(**bad)


def run_policy(spark):
    cells, frames, grid = tables(spark, MOVE)
    track(cells, frames, identify(cells, grid), grid, score_policy="x")


def test_sequences_are_apart_and_partitions_do_not_matter(spark):
    a = tables(spark, MOVE, "a")
    b = tables(spark, GAP, "b")
    labels = identify(a[0], a[2], shape=disk(0)).unionByName(identify(b[0], a[2], shape=disk(0)))
    cells, frames = a[0].unionByName(b[0]), a[1].unionByName(b[1])
    out = [rows(run_lineage(frame_rows(frames, labels, cells).repartition(n), TrackOptions(max_displacement=4))) for n in (1, 5)]
    assert out[0] == out[1] and {dict(r)["sequence_id"] for r in out[0]} == {"a", "b"}


def test_assignment_leaves_weak_links_out():
    links = [(0, 0, 0.9), (0, 1, 0.34), (1, 0, 0.8), (1, 1, 0.0)]
    p, c, s = map(list, zip(*links))
    assert assign(p, c, s, 0.35) == [0] and assign(p, c, s, 0.95) == []


def test_assignment_against_all_choices():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = rng.integers(1, 5, 2)
        gain = np.where(rng.random((n, m)) < 0.7, rng.random((n, m)), -np.inf)
        best = max(sum(gain[r, q] for r, q in enumerate(pick) if q >= 0) for pick in itertools.product(range(-1, m), repeat=n) if len([q for q in pick if q >= 0]) == len({q for q in pick if q >= 0}))
        found = best_assignment(gain)
        taken = [q for q in found if q >= 0]
        assert len(taken) == len(set(taken))
        assert abs(sum(gain[r, q] for r, q in enumerate(found) if q >= 0) - best) < 1e-9


def test_groups_kinds_and_ambiguity():
    got = [(p, c) for p, c, _ in bipartite_groups([0, 1, 2, 5], [3, 3, 4, 4])]
    assert got == [([0, 1], [3]), ([2, 5], [4])]
    assert [event_kind(1, 1), event_kind(1, 2), event_kind(3, 1), event_kind(2, 2)] == [None, "split", "merge", "complex"]
    assert ambiguous_children([1, 1, 2, 2, 3], [0.5, 0.52, 0.5, 0.55, 0.1], 0.05) == {1}


def test_edges_in_order_of_parents(spark):
    """The kernel emits one-to-one links by child."""
    import json

    from cellweave.operators.lineage import FRAME_ROWS, TAGGED, in_order

    found = [("split", 5, 6), ("split", 5, 7), ("merge", 3, 9), ("continue", 2, 8), ("continue", 1, 10), ("gap_continue", 4, 11), ("gap_continue", 0, 12)]
    rows = [("s", "edge", t * FRAME_ROWS + k, json.dumps({"time": t, "event": event, "parent_node_id": p, "child_node_id": c})) for t in (1, 2) for k, (event, p, c) in enumerate(found)]
    got = in_order(spark.createDataFrame(rows, TAGGED).repartition(3), "edge").collect()
    for t in (1, 2):
        assert [r.child_node_id for r in sorted((r for r in got if r.time == t), key=lambda r: r.emitted)] == [6, 7, 9, 10, 8, 12, 11]
    assert sorted(r.emitted for r in got) == sorted([*range(7)] * 2)
