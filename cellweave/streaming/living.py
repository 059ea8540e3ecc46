"""Tracking as a stream whose state is bounded by what is alive.

The batch kernel keeps the family of every branch there ever was, as families may still unite. A stream needs those of living branches alone:
a branch is born as its own family; when families unite, the greater ones go out as ``moved`` rows, each once, and when none of a family's
branches can be continued any more the family goes out as ``ended``. What the output holds is enough to name every family, so
dead branches leave the state. State is kept by key: one entry per object that may be continued, one per living branch, one with the counters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..grid import Grid, TrackOptions
from ..operators.lineage import OBJECT_FIELDS, TAGGED, Lineage, emit, new_state, of_kind
from ..operators.matching import families

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_HEAD = "last_time long, next_node long, next_branch long, next_event long, ny int, nx int, config string"
_COUNTERS = ("last_time", "next_node", "next_branch", "next_event")
_OBJECT = "branch long, time long, before_y double, before_x double, before_t long, label int, area_cells long, centroid_y double, centroid_x double, mean_intensity double, max_intensity double, precipitation_sum double, y_start int, y_stop int, x_start int, x_stop int, cells binary"


class LivingLineage(Lineage):
    """The kernel with families of living branches only; ``advance`` also gives ``moved`` and ``ended`` families."""

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **kwargs)
        self.moved: list[dict] = []
        self.kin: dict[int, list[int]] = {}
        for branch, root in self.state["family"].items():
            self.kin.setdefault(root, []).append(int(branch))

    def family(self, branch: int) -> int:
        return self.state["family"][str(branch)]

    def _branch(self) -> int:
        branch = super()._branch()
        self.kin[branch] = [branch]
        return branch

    def _unite(self, branches: list[int]) -> None:
        first, *rest = sorted({self.family(b) for b in branches})
        for root in rest:
            self.moved.append({"branch_id": root, "family_id": first})
            held = self.kin.pop(root)
            self.state["family"] |= {str(b): first for b in held}
            self.kin[first] += held

    def advance(self, time: int, objects: list[dict]) -> dict[str, list[dict]]:
        out = super().advance(time, objects)
        living = {x["branch"] for x in (*self.state["active"], *self.state["dormant"])}
        self.kin = {root: [b for b in held if b in living] for root, held in self.kin.items()}
        over = sorted(root for root, held in self.kin.items() if not held)
        for root in over:
            del self.kin[root]
        self.state["family"] = {str(b): root for root, held in self.kin.items() for b in held}
        out["moved"], self.moved = [m | {"time": time} for m in self.moved], []
        out["ended"] = [{"family_id": root, "time": time} for root in over]
        return out


class LivingTracker(StatefulProcessor):
    """A sequence's state in keyed entries, of which a batch writes those that changed."""

    def __init__(self, options: TrackOptions, grid: Grid | None):
        self.options, self.grid = options, grid

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", _HEAD)
        self.objects = handle.getMapState("objects", "node long", _OBJECT)
        self.branches = handle.getMapState("branches", "branch long", "root long")

    def _load(self) -> dict | None:
        if not self.head.exists():
            return None
        *counters, ny, nx, config = self.head.get()
        state = new_state() | dict(zip(_COUNTERS, counters)) | {"grid": None if ny is None else [ny, nx], "config": json.loads(config)}
        for (node,), (branch, time, *before, label, area, cy, cx, mean, most, total, y0, y1, x0, x1, cells) in sorted(self.objects.iterator()):  # numbers grow with time, and by label within it
            row = dict(zip(OBJECT_FIELDS, (label, area, cy, cx, mean, most, total, y0, y1, x0, x1)))
            row |= {"node": node, "branch": branch, "time": time, "before": None if before[2] is None else before, "cells": np.frombuffer(cells, np.int64).tolist()}
            state["active" if time == state["last_time"] else "dormant"].append(row)
        state["family"] = {str(branch): root for (branch,), (root,) in self.branches.iterator()}
        return state

    def _store(self, was: dict | None, state: dict) -> None:
        held = {x["node"]: x for x in (*state["active"], *state["dormant"])}
        known = {x["node"] for x in (*was["active"], *was["dormant"])} if was else set()
        for node in known - held.keys():
            self.objects.removeKey((node,))
        for node in held.keys() - known:  # an object that stays doesn't change
            x = held[node]
            self.objects.updateValue((node,), (x["branch"], x["time"], *(x["before"] or (None,) * 3), *(x[f] for f in OBJECT_FIELDS), np.asarray(x["cells"], np.int64).tobytes()))
        old = was["family"] if was else {}
        for branch in old.keys() - state["family"].keys():
            self.branches.removeKey((int(branch),))
        for branch, root in state["family"].items():
            if old.get(branch) != root:
                self.branches.updateValue((int(branch),), (root,))
        self.head.update((*(state[c] for c in _COUNTERS), *(state["grid"] or (None, None)), json.dumps(state["config"], sort_keys=True)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        was = self._load()
        held = LivingLineage(self.options, dict(was) if was else None, key[0], self.grid)
        frames = pd.concat(list(rows)).sort_values("t", kind="stable")
        out: list[tuple] = []
        for t, objects in zip(frames.t.tolist(), frames.objects.tolist()):
            out += [(key[0], *x) for x in emit(held, t, json.loads(objects))]
        self._store(was, held.state)
        yield pd.DataFrame(out, columns=["sequence_id", "kind", "n", "row"])

    def close(self) -> None:
        pass


def track_living(rows: DataFrame, options: TrackOptions, grid: Grid | None = None) -> DataFrame:
    """Tagged rows (nodes, edges, events, candidates, moved, ended) of a stream of ``lineage.frame_rows`` rows.

    Frames of a batch are put in order of time. One that comes late, twice, or leaves a gap in time is an error and isn't dropped. A frame without
    objects is a row as well. The family in a node's row is the one of that moment: ``living_families`` names the families of all.
    The query has to use the RocksDB state store (``run_living`` does).
    """
    packed = rows.select("sequence_id", "t", F.to_json("objects").alias("objects"))
    return packed.groupBy("sequence_id").transformWithStateInPandas(LivingTracker(options, grid), TAGGED, "Append", "None")


def run_living(rows: DataFrame, options: TrackOptions, output: str, checkpoint: str, grid: Grid | None = None) -> list[dict]:
    """Track all that there is now and stop; called again, it goes on. Returns the progress of its batches; session settings stay as they are."""
    conf = rows.sparkSession.conf
    before = conf.get(_PROVIDER)
    conf.set(_PROVIDER, _ROCKSDB)
    try:  # a query takes the settings that hold when it starts
        query = track_living(rows, options, grid).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(_PROVIDER, before)
    query.awaitTermination()
    return [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]


def living_families(tagged: DataFrame) -> DataFrame:
    """(sequence_id, branch_id, family_id, ended) of each branch of ``track_living``'s rows: its family by now, and the frame at which nothing
    could continue that any more, null while something can. Final families never change. Chains of moves are followed by joins that
    halve them; an output that isn't to be read whole each time can go to ``matching.FamilyLog`` part by part, with moves as links."""
    branches = of_kind(tagged, "node").select("sequence_id", "branch_id").distinct()
    moves = of_kind(tagged, "moved").select("sequence_id", F.col("branch_id").alias("a"), F.col("family_id").alias("b"))
    ended = of_kind(tagged, "ended").select("sequence_id", "family_id", F.col("time").alias("ended"))
    return families(branches, moves).join(ended, ["sequence_id", "family_id"], "left").select("sequence_id", "branch_id", "family_id", "ended")
