"""The engine for array users: cubes in, label rasters and graphs out.

Arrays live on the driver, so this is for cubes that fit there; the DataFrame functions have no such limit.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .grid import Footprint, Grid, TrackOptions, footprint
from .operators import identify as _identify
from .operators.lineage import OBJECT_FIELDS, STRIDE, Lineage, branch_cells, load_state, new_state, save_state
from .operators.lineage import TrackGraph as _Tables
from .operators.lineage import track as _track

CELLS = "sequence_id string, t long, y int, x int, rain float, valid boolean"


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def cells_of_cube(data: np.ndarray, valid: np.ndarray | None = None, sequence_id: str = "default", start: int = 0) -> DataFrame:
    """Cells of a (time, y, x) array: wet and missing ones have rows."""
    import pandas as pd

    data = np.asarray(data)
    ok = np.isfinite(data) if valid is None else np.isfinite(data) & np.asarray(valid, bool)
    t, y, x = np.nonzero((np.nan_to_num(data, nan=1.0) != 0) | ~ok)
    frame = pd.DataFrame({"sequence_id": sequence_id, "t": t.astype(np.int64) + start, "y": y.astype(np.int32), "x": x.astype(np.int32), "rain": data[t, y, x].astype(np.float32), "valid": ok[t, y, x]})
    return _session().createDataFrame(frame, CELLS)


def _frames(n: int, sequence_id: str, start: int) -> DataFrame:
    return _session().range(start, start + n).selectExpr(f"'{sequence_id}' AS sequence_id", "id AS t")


def _dense(rows: DataFrame, column: str, shape: tuple[int, ...], kind: type, start: int = 0) -> np.ndarray:
    out = np.zeros(shape, kind)
    p = rows.select("t", "y", "x", column).toPandas()
    out[p.t - start, p.y, p.x] = p[column]
    return out


def _shape(structure) -> Footprint:
    if structure is None:
        return _identify.SQUARE
    return structure if isinstance(structure, Footprint) else footprint(np.asarray(structure).tolist())


def identify(data, morph_structure=None, workers=1, min_size=1, chunksize=1, threshold=0.0, valid_mask=None) -> np.ndarray:
    """Labels (int32) of each frame of a cube. ``workers`` and ``chunksize`` are checked; Spark deals frames to tasks."""
    data = np.asarray(data)
    if data.ndim != 3:
        raise ValueError("the cube needs three axes: time, y and x")
    if workers < 1 or chunksize < 1:
        raise ValueError("workers: give 1 or more")
    if valid_mask is not None and np.asarray(valid_mask).shape != data.shape:
        raise ValueError("valid_mask must have the shape of the data")
    labels = _identify.identify(cells_of_cube(data, valid_mask), Grid(*data.shape[1:]), threshold, _shape(morph_structure), min_size)
    return _dense(labels, "label", data.shape, np.int32)


def identify_frame(data, morph_structure=None, min_size=1, threshold=0.0, valid_mask=None) -> np.ndarray:
    data = np.asarray(data)
    if data.ndim != 2:
        raise ValueError("a frame has two axes: y and x")
    return identify(data[None], morph_structure, 1, min_size, 1, threshold, None if valid_mask is None else np.asarray(valid_mask)[None])[0]


@dataclass
class TrackingState:
    """What is kept between chunks."""

    data: dict = field(default_factory=new_state)

    @property
    def last_time(self) -> int | None:
        return self.data["last_time"]


@dataclass
class TrackGraph:
    """Rows of a tracked chunk as dictionaries."""

    objects: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)
    family_map: dict[int, int] = field(default_factory=dict)

    @property
    def nodes(self) -> list[dict]:
        return self.objects


def _plain(tables: _Tables) -> TrackGraph:
    rows = lambda df, *order: [{k: v for k, v in r.asDict().items() if k != "sequence_id"} for r in df.orderBy(*order).collect()]
    return TrackGraph(rows(tables.nodes, "time", "node_id"), rows(tables.edges, "time", "parent_node_id", "child_node_id"), rows(tables.events, "event_id"), {r.branch_id: r.family_id for r in tables.family_map.orderBy("branch_id").collect()})


def track_with_graph(labeled_maps, precip_data, tau=0.35, phi=None, km=20.0, workers=1, max_gap=1, gap_tau=None, gap_ambiguity=0.05, event_overlap=0.10, state: TrackingState | None = None, start_time=None, return_state=False, sequence_id=None):
    """(branch raster, graph[, state]). ``km`` is the largest displacement in cells per frame; ``phi`` and ``workers`` have no effect."""
    labels, rain = np.asarray(labeled_maps), np.asarray(precip_data)
    if labels.shape != rain.shape or labels.ndim != 3:
        raise ValueError("labels and precipitation need the same (time, y, x) shape")
    if start_time is None:
        start_time = 0 if state is None or state.last_time is None else state.last_time + 1
    name = sequence_id or (state.data["sequence_id"] if state else None) or "default"
    options = TrackOptions(tau, km, max_gap, gap_tau, gap_ambiguity, event_overlap)
    held = None
    if state is not None:
        Lineage(options, state.data, name, Grid(*labels.shape[1:]))  # an early error if it doesn't fit
        held = _session().createDataFrame([(name, json.dumps(state.data))], "sequence_id string, state string")
    cells = cells_of_cube(np.where(labels > 0, rain, 0), None, name, start_time)
    t, y, x = np.nonzero(labels > 0)
    import pandas as pd

    marked = _session().createDataFrame(pd.DataFrame({"sequence_id": name, "t": t.astype(np.int64) + start_time, "y": y.astype(np.int32), "x": x.astype(np.int32), "label": labels[t, y, x].astype(np.int32)}), "sequence_id string, t long, y int, x int, label int")
    tables = _track(cells, _frames(len(labels), name, start_time), marked, Grid(*labels.shape[1:]), options, held)
    raster = _dense(branch_cells(marked, tables.nodes), "branch_id", labels.shape, np.int64, start_time)
    graph = _plain(tables)
    if not return_state:
        return raster, graph
    return raster, graph, TrackingState(json.loads(tables.states.first().state))


def track(labeled_maps, precip_data, tau, phi, km, test=False, workers=1, **options) -> np.ndarray:
    """The branch raster only."""
    return track_with_graph(labeled_maps, precip_data, tau=tau, phi=phi, km=km, workers=workers, **options)[0]


class Tracker:
    """Frame by frame on the driver, with the kernel that Spark runs."""

    def __init__(self, tau=0.35, max_displacement=20.0, max_gap=1, gap_tau=None, gap_ambiguity=0.05, event_overlap=0.10, state: TrackingState | None = None, sequence_id=None):
        self.state = state or TrackingState()
        self.kernel = Lineage(TrackOptions(tau, max_displacement, max_gap, gap_tau, gap_ambiguity, event_overlap), self.state.data, sequence_id)

    def update(self, time, labeled_map, precip) -> tuple[np.ndarray, TrackGraph]:
        labels, rain = np.asarray(labeled_map), np.asarray(precip, np.float64)
        if labels.shape != rain.shape or labels.ndim != 2:
            raise ValueError("a frame of labels and its rain differ in shape")
        shape = list(labels.shape)
        if self.state.data["grid"] not in (None, shape):
            raise ValueError("grid shape differs from the saved state")
        self.state.data["grid"] = shape
        objects = []
        for label in np.unique(labels[labels > 0]).tolist():
            y, x = np.nonzero(labels == label)
            v = rain[y, x]
            total = float(v.sum())
            cy, cx = ((y * v).sum() / total, (x * v).sum() / total) if total > 0 else (y.mean(), x.mean())
            values = (label, len(v), float(cy), float(cx), float(v.mean()), float(v.max()), total, int(y.min()), int(y.max()) + 1, int(x.min()), int(x.max()) + 1)
            objects.append(dict(zip(OBJECT_FIELDS, values)) | {"cells": (y * STRIDE + x).tolist()})
        found = self.kernel.advance(int(time), objects)
        raster = np.zeros(labels.shape, np.int64)
        for n in found["node"]:
            raster[labels == n["label"]] = n["branch_id"]
        return raster, TrackGraph(found["node"], found["edge"], found["event"], {r["branch_id"]: r["family_id"] for r in self.kernel.family_map()})


def save_tracking_state(state: TrackingState, path: str) -> None:
    save_state(state.data, path)


def load_tracking_state(path: str) -> TrackingState:
    return TrackingState(load_state(path))
