"""Streams whose state holds what is alive only."""

import numpy as np
import pytest

from cellweave.grid import TrackOptions, disk
from cellweave.operators.identify import identify
from cellweave.operators.lineage import Lineage, frame_rows, of_kind, run_lineage
from cellweave.streaming.living import LivingLineage, living_families, run_living
from tests.helpers import tables


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def blocks(rng, t, n=5, side=12):
    """Objects that are boxes of 2 x 2 to 4 x 4 cells at random places."""
    out = []
    for label in range(1, int(rng.integers(0, n + 1)) + 1):
        h, w = (int(v) for v in rng.integers(2, 5, 2))
        y, x = (int(v) for v in rng.integers(0, side - 4, 2))
        cells = [(y + i) * (1 << 20) + x + j for i in range(h) for j in range(w)]
        out.append({"label": label, "area_cells": h * w, "centroid_y": y + (h - 1) / 2, "centroid_x": x + (w - 1) / 2, "mean_intensity": 1.0, "max_intensity": 1.0, "precipitation_sum": float(h * w), "y_start": y, "y_stop": y + h, "x_start": x, "x_stop": x + w, "cells": cells})
    return out


def chased(branches, moved):
    to = {m["branch_id"]: m["family_id"] for m in moved}
    assert len(to) == len(moved)  # each moves once
    out = {}
    for b in branches:
        root = b
        while root in to:
            root = to[root]
        out[b] = root
    return out


@pytest.mark.parametrize("gap", [0, 2])
def test_the_state_is_flat_over_a_thousand_frames(gap):
    rng = np.random.default_rng(gap)
    options = TrackOptions(max_displacement=3, max_gap=gap, tau=0.3)
    whole, living = Lineage(options), LivingLineage(options)
    moved, ended, last, sizes, born = [], {}, {}, [], set()
    for t in range(1000):
        objects = blocks(rng, t) if t % 40 < 36 else []  # dry spells end all families
        want, got = whole.advance(t, [dict(o) for o in objects]), living.advance(t, [dict(o) for o in objects])
        assert all(got[k] == want[k] for k in ("node", "edge", "event", "candidate"))
        moved += got["moved"]
        assert not ended.keys() & {e["family_id"] for e in got["ended"]}  # each ends once
        ended |= {e["family_id"]: t for e in got["ended"]}
        assert not ended.keys() & {n["family_id"] for n in got["node"]}  # and nothing of it comes later
        born |= {n["branch_id"] for n in got["node"]}
        for n in got["node"]:
            last[n["branch_id"]] = t
        assert set(living.state["family"]) == {str(x["branch"]) for x in (*living.state["active"], *living.state["dormant"])}
        sizes.append(len(living.state["family"]))
    assert max(sizes) <= 5 * (gap + 2) and len(whole.state["family"]) > 500
    names = chased(born, moved)
    assert names == {r["branch_id"]: r["family_id"] for r in whole.family_map()}
    until = {}
    for b, f in names.items():
        until[f] = max(until.get(f, 0), last[b])
    assert ended == {f: t + gap + 1 for f, t in until.items() if t + gap + 1 < 1000}


def test_living_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    cube = np.zeros((16, 14, 14))
    for t in (*range(6), *range(9, 16)):  # all end in the dry frames between
        for _ in range(5):
            h, w, y, x = (int(v) for v in (*rng.integers(2, 6, 2), *rng.integers(0, 10, 2)))
            cube[t, y : y + h, x : x + w] = 2
    cells, frames, grid = tables(spark, cube)
    again = [d.replace("s", "z", "sequence_id") for d in (cells, frames)]
    cells, frames = cells.union(again[0]), frames.union(again[1])
    rows = frame_rows(frames, identify(cells, grid, shape=disk(0)), cells).cache()
    options = TrackOptions(max_displacement=3)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    progress = []
    for k in range(4):  # restarted before each part
        rows.where(f"t between {4 * k} and {4 * k + 3}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in" / "part=*"))
        progress += run_living(stream, options, str(tmp_path / "out"), str(tmp_path / "check"), grid)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got, want = spark.read.parquet(str(tmp_path / "out")), run_lineage(rows, options, grid)
    for kind in ("node", "edge", "event", "candidate"):
        a, b = of_kind(got, kind), of_kind(want, kind)
        drop = ["family_id"] if kind == "node" else []
        assert plain(a.drop(*drop)) == plain(b.drop(*drop)) != []
    named = living_families(got)
    assert plain(named.drop("ended")) == plain(of_kind(want, "family"))
    assert named.where("ended <= 8").count() > 0 and named.where("ended is null").count() > 0
    living = named.where("ended is null").count()
    objects = int(np.max([r.n for r in rows.selectExpr("size(objects) as n").collect()]))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert held and held[-1] <= 2 * (1 + 2 * objects * (options.max_gap + 2)) and living > 0


def test_living_stream_refuses_late_and_missing_frames(spark, tmp_path):
    cells, frames, grid = tables(spark, np.ones((4, 4, 4)))
    rows = frame_rows(frames, identify(cells, grid), cells)
    for name, order in (("late", (1, 0)), ("gap", (0, 2)), ("twice", (1, 1))):
        for k, t in enumerate(order):
            rows.where(f"t = {t}").coalesce(1).write.parquet(str(tmp_path / name / "in" / f"part={k}"))
            stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / name / "in" / "part=*"))
            run = lambda: run_living(stream, TrackOptions(), str(tmp_path / name / "out"), str(tmp_path / name / "check"), grid)  # noqa: B023, E731
            if k == 0:
                run()
            else:
                with pytest.raises(Exception, match="increasing|contiguous"):
                    run()


def test_living_stream_refuses_other_options(spark, tmp_path):
    cells, frames, grid = tables(spark, np.ones((2, 4, 4)))
    rows = frame_rows(frames, identify(cells, grid), cells)
    for t in (0, 1):
        rows.where(f"t = {t}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={t}"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in" / "part=*"))
        run = lambda o: run_living(stream, o, str(tmp_path / "out"), str(tmp_path / "check"), grid)  # noqa: B023, E731
        if t == 0:
            run(TrackOptions())
        else:
            with pytest.raises(Exception, match="parameters differ"):
                run(TrackOptions(tau=0.5))
