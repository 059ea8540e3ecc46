"""The lineage kernel: one frame after another of one sequence, and its use over many sequences.

What can be computed without earlier decisions (objects, statistics, overlaps) is joined for all frames at once and comes in as columns; the
kernel keeps branches, events, motion memory and families, and sees no cell. Only how far a parent has moved depends on decisions: overlaps
are joined for the shifts that near predecessors would give, and if the kernel asks for another, it is joined as well and the kernel runs again. Its state is plain data: saved as JSON,
kept in a streaming state store, or handed to the next chunk, it goes on as if there had been no break.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import half_even
from ..grid import Grid, TrackOptions, refuse_policies
from .matching import ambiguous_children, assign, bipartite_groups, event_kind, shared_checkpoints

STATE_VERSION = 1

#: Cells are numbered y * STRIDE + x: moved cells never wrap into another row.
STRIDE = 1 << 20

OBJECT_FIELDS = ("label", "area_cells", "centroid_y", "centroid_x", "mean_intensity", "max_intensity", "precipitation_sum", "y_start", "y_stop", "x_start", "x_stop")


def new_state() -> dict:
    return {"schema_version": STATE_VERSION, "last_time": None, "next_node": 1, "next_branch": 1, "next_event": 1, "active": [], "dormant": [], "family": {}, "sequence_id": None, "grid": None, "config": None}


def check_state(state: dict) -> dict:
    if state.get("schema_version") != STATE_VERSION:
        raise ValueError("unknown schema_version of the saved state")
    return state


@dataclass
class Links:
    """Candidate links as columns."""

    parent: np.ndarray
    child: np.ndarray
    score: np.ndarray
    raw_iou: np.ndarray
    advected_iou: np.ndarray
    distance: np.ndarray
    parent_coverage: np.ndarray
    child_coverage: np.ndarray

    def take(self, at) -> Links:
        return Links(*(getattr(self, f)[at] for f in self.__dataclass_fields__))

    def __len__(self) -> int:
        return len(self.parent)


class PixelOverlaps:
    """Common cells of a parent, moved by a shift, and the objects of a frame: counted from lists of cells."""

    def __init__(self):
        self.cells: dict[int, np.ndarray] = {}

    def begin(self, objects: list[dict]) -> None:
        for x in objects:
            x["sorted"] = np.sort(np.asarray(x["cells"], np.int64))
        self.objects = objects
        self.box = np.array([[x[k] for k in ("y_start", "y_stop", "x_start", "x_stop")] for x in objects], float).reshape(-1, 4)

    def common(self, parent: dict, time: int, shift: tuple[int, int]) -> dict[int, int]:
        """{place of the object: cells}, none of 0."""
        (sy, sx), box = shift, self.box
        touch = (np.minimum(box[:, 1], parent["y_stop"] + sy) > np.maximum(box[:, 0], parent["y_start"] + sy)) & (np.minimum(box[:, 3], parent["x_stop"] + sx) > np.maximum(box[:, 2], parent["x_start"] + sx))
        at = np.flatnonzero(touch).tolist()
        if not at:
            return {}
        mine = self.cells.get(parent["node"])
        if mine is None:
            mine = self.cells[parent["node"]] = np.sort(np.asarray(parent["cells"], np.int64))
        mine = mine + (sy * STRIDE + sx)
        counts = {k: len(np.intersect1d(mine, self.objects[k]["sorted"], assume_unique=True)) for k in at}
        return {k: n for k, n in counts.items() if n}

    def keep(self, node: int, x: dict) -> dict:
        """What a terminal has of its cells."""
        self.cells[node] = x["sorted"]
        return {"cells": x["sorted"].tolist()}

    def forget(self, living: set[int]) -> None:
        self.cells = {k: v for k, v in self.cells.items() if k in living}


class TableOverlaps:
    """The same looked up in what joins have counted. Shifts that nobody asked them for count as no overlap and are ``missing``."""

    def __init__(self):
        self.missing: set[tuple[int, int, int, int, int]] = set()
        self.load((), ())

    def load(self, links: Iterable[dict], asked: Iterable[dict]) -> None:
        """Those of the next frame: (parent_t, parent_label, sy, sx, child_label, n), and the moved parents that were looked at."""
        self.table: dict[tuple, list[tuple[int, int]]] = {}
        for x in links:
            self.table.setdefault((x["parent_t"], x["parent_label"], x["sy"], x["sx"]), []).append((x["child_label"], x["n"]))
        self.known = {(x["parent_t"], x["parent_label"], x["sy"], x["sx"]) for x in asked}

    def begin(self, objects: list[dict]) -> None:
        self.place = {x["label"]: k for k, x in enumerate(objects)}

    def common(self, parent: dict, time: int, shift: tuple[int, int]) -> dict[int, int]:
        key = (parent["time"], parent["label"], *shift)
        if shift != (0, 0) and key not in self.known:
            self.missing.add((time, *key))
        return {self.place[label]: n for label, n in self.table.get(key, ())}

    def keep(self, node: int, x: dict) -> dict:
        return {}

    def forget(self, living: set[int]) -> None:
        pass


class Lineage:
    """Links objects of following frames of one sequence."""

    def __init__(self, options: TrackOptions, state: dict | None = None, sequence_id: str | None = None, grid: Grid | None = None, overlaps: PixelOverlaps | TableOverlaps | None = None):
        self.options = options
        self.overlaps = overlaps or PixelOverlaps()
        self.state = check_state(state) if state is not None else new_state()
        wanted = sequence_id or self.state["sequence_id"] or "default"
        if self.state["sequence_id"] not in (None, wanted):
            raise ValueError("saved state belongs to a different sequence_id")
        shape = [grid.ny, grid.nx] if grid else None
        if self.state["grid"] is not None and shape is not None and list(self.state["grid"]) != shape:
            raise ValueError("grid shape differs from the saved state")
        if self.state["config"] is not None and self.state["config"] != options.config():
            raise ValueError("tracking parameters differ from the saved state")
        self.state |= {"sequence_id": wanted, "config": options.config(), "grid": shape or self.state["grid"]}

    # -------------------------------------------------------- families

    def family(self, branch: int) -> int:
        parent = self.state["family"]
        key = str(branch)
        while parent[key] != int(key):
            parent[key] = parent[str(parent[key])]
            key = str(parent[key])
        return int(key)

    def _branch(self) -> int:
        branch = self.state["next_branch"]
        self.state["next_branch"] += 1
        self.state["family"][str(branch)] = branch
        return branch

    def _unite(self, branches: list[int]) -> None:
        roots = sorted({self.family(b) for b in branches})
        for r in roots[1:]:
            self.state["family"][str(r)] = roots[0]  # the least branch names a family

    # -------------------------------------------------------- candidates

    def candidates(self, parents: list[dict], objects: list[dict], time: int) -> Links:
        """Pairs near the expected or the present place of the parent, or that overlap enough."""
        o = self.options
        rows: list[tuple] = []
        if parents and objects:
            cy, cx = (np.array([x[k] for x in objects], float) for k in ("centroid_y", "centroid_x"))
            order = np.argsort(cy, kind="stable")
            sorted_y = cy[order]
            for pi, p in enumerate(parents):
                dt = time - p["time"]
                radius = o.max_displacement * dt
                vy = vx = 0.0
                if p["before"] is not None and p["time"] > p["before"][2]:
                    vy, vx = ((p[k] - q) / (p["time"] - p["before"][2]) for k, q in zip(("centroid_y", "centroid_x"), p["before"]))
                py, px = p["centroid_y"] + vy * dt, p["centroid_x"] + vx * dt
                low = int(np.searchsorted(sorted_y, min(py, p["centroid_y"]) - radius - 1e-9))
                high = int(np.searchsorted(sorted_y, max(py, p["centroid_y"]) + radius + 1e-9, "right"))
                some = order[low:high]
                near = np.zeros(len(objects), bool)
                for y, x in ((py, px), (p["centroid_y"], p["centroid_x"])):
                    near[some] |= (cy[some] - y) ** 2 + (cx[some] - x) ** 2 <= radius * radius
                shift = (round(vy * dt), round(vx * dt))
                still = self.overlaps.common(p, time, (0, 0))
                moved = self.overlaps.common(p, time, shift) if shift != (0, 0) else still
                for ci in sorted({*np.flatnonzero(near).tolist(), *still, *moved}):
                    child = objects[ci]
                    raw, adv = still.get(ci, 0), moved.get(ci, 0)
                    pa, ca = p["area_cells"], child["area_cells"]
                    cover_p, cover_c = max(raw, adv) / pa, max(raw, adv) / ca
                    cover = max(cover_p, cover_c)
                    if not near[ci] and not (cover > 0 and cover >= o.event_overlap):
                        continue
                    iou, iou_adv = raw / (pa + ca - raw), adv / (pa + ca - adv)
                    far = math.hypot(child["centroid_y"] - py, child["centroid_x"] - px)
                    a, b = p["mean_intensity"], child["mean_intensity"]
                    score = 0.60 * max(iou, iou_adv) + 0.25 * math.exp(-far / max(radius, 1.0)) + 0.15 * (min(a, b) / max(a, b, 1e-12))
                    rows.append((pi, ci, score, iou, iou_adv, far, cover_p, cover_c))
        columns = list(zip(*rows)) or [()] * 8
        return Links(*(np.array(c, np.int64 if k < 2 else float) for k, c in enumerate(columns)))

    # -------------------------------------------------------- one frame

    def advance(self, time: int, objects: list[dict]) -> dict[str, list[dict]]:
        """Nodes, edges, events and audited candidates of the next frame. ``objects`` (by label) have the
        OBJECT_FIELDS, and ``cells`` where overlaps are counted from these; a frame without any still has to come."""
        s, o = self.state, self.options
        if s["last_time"] is not None and time <= s["last_time"]:
            raise ValueError("frame times have to be increasing")
        if s["last_time"] is not None and time != s["last_time"] + 1:
            raise ValueError("frames have to be contiguous: a dry hour is an empty one")
        self.overlaps.begin(objects)
        active = s["active"]
        nodes = list(range(s["next_node"], s["next_node"] + len(objects)))
        s["next_node"] += len(objects)
        links = self.candidates(active, objects, time)
        edges: list[dict] = []
        events: list[dict] = []
        branch_of: dict[int, int] = {}
        parent_of: dict[int, dict] = {}
        used_p: set[int] = set()

        def edge(parents: list[dict], k: int, kind: str, of: Links, gap: int = 0) -> dict:
            return {"time": time, "parent_node_id": parents[of.parent[k]]["node"], "child_node_id": nodes[of.child[k]], "score": float(of.score[k]), "event": kind, "gap": gap} | {f: float(getattr(of, f)[k]) for f in ("raw_iou", "advected_iou", "distance", "parent_coverage", "child_coverage")}

        # events come before any one-to-one link
        eligible = np.flatnonzero((links.score >= o.tau) & (np.maximum(links.parent_coverage, links.child_coverage) >= o.event_overlap))
        accepted = np.zeros(len(links), bool)
        for ps, cs, at in bipartite_groups(links.parent[eligible], links.child[eligible]):
            kind = event_kind(len(ps), len(cs))
            if kind is None:
                continue
            made = [self._branch() for _ in cs]
            self._unite([active[p]["branch"] for p in ps] + made)
            branch_of |= dict(zip(cs, made))
            events.append({"event_id": s["next_event"], "time": time, "event": kind, "parent_node_ids": [active[p]["node"] for p in ps], "child_node_ids": [nodes[c] for c in cs]})
            s["next_event"] += 1
            edges += [edge(active, k, kind, links) for k in eligible[at].tolist()]
            accepted[eligible[at]] = True
            used_p |= set(ps)

        # then one-to-one links of what events left
        free = np.flatnonzero(~np.isin(links.parent, list(used_p)) & ~np.isin(links.child, list(branch_of)))
        for k in assign(links.parent[free], links.child[free], links.score[free], o.tau):
            k = int(free[k])
            parent = active[links.parent[k]]
            branch_of[int(links.child[k])], parent_of[int(links.child[k])] = parent["branch"], parent
            used_p.add(int(links.parent[k]))
            edges.append(edge(active, k, "continue", links))

        # then links over missing frames
        dormant = [d for d in s["dormant"] if time - d["time"] <= o.max_gap + 1] + [a for k, a in enumerate(active) if k not in used_p]
        over = self.candidates(dormant, objects, time)
        elapsed = np.array([time - dormant[p]["time"] for p in over.parent], np.int64)
        wide = (elapsed > 1) & (elapsed <= o.max_gap + 1)
        if o.gap_min_pixels and len(over):
            wide &= np.array([min(dormant[p]["area_cells"], objects[c]["area_cells"]) >= o.gap_min_pixels for p, c in zip(over.parent, over.child)], bool)
        over = over.take(np.flatnonzero(wide))
        unclear = ambiguous_children(over.child.tolist(), over.score.tolist(), o.gap_ambiguity)
        open_ = np.array([k for k, c in enumerate(over.child.tolist()) if c not in unclear and c not in branch_of], np.int64)
        woken: set[int] = set()
        for k in assign(over.parent[open_], over.child[open_], over.score[open_], o.gap_tau) if len(open_) else []:
            k = int(open_[k])
            parent = dormant[over.parent[k]]
            branch_of[int(over.child[k])], parent_of[int(over.child[k])] = parent["branch"], parent
            woken.add(int(over.parent[k]))
            edges.append(edge(dormant, k, "gap_continue", over, time - parent["time"] - 1))

        fresh, out = [], []
        for ci, x in enumerate(objects):
            branch = branch_of[ci] if ci in branch_of else self._branch()
            parent = parent_of.get(ci)
            before = None if parent is None else [parent["centroid_y"], parent["centroid_x"], parent["time"]]
            kept = {f: x[f] for f in OBJECT_FIELDS}
            fresh.append(kept | {"node": nodes[ci], "branch": branch, "time": time, "before": before} | self.overlaps.keep(nodes[ci], x))
            out.append({"time": time, "node_id": nodes[ci], "branch_id": branch} | kept)
        for n in out:
            n["family_id"] = self.family(n["branch_id"])
        labels = [x["label"] for x in objects]
        audit = [{"frame": time, "parent_frame": active[p]["time"], "parent_label": active[p]["label"], "child_label": labels[c], "score": float(links.score[k]), "parent_coverage": float(links.parent_coverage[k]), "child_coverage": float(links.child_coverage[k]), "passes_tau": bool(links.score[k] >= o.tau), "passes_event_overlap": bool(max(links.parent_coverage[k], links.child_coverage[k]) >= o.event_overlap), "accepted_event": bool(accepted[k])} for k, (p, c) in enumerate(zip(links.parent.tolist(), links.child.tolist()))]
        s["active"] = fresh
        s["dormant"] = [d for k, d in enumerate(dormant) if k not in woken and time - d["time"] <= o.max_gap]
        s["last_time"] = time
        self.overlaps.forget({a["node"] for a in fresh} | {d["node"] for d in s["dormant"]})
        return {"node": out, "edge": edges, "event": events, "candidate": audit}

    def family_map(self) -> list[dict]:
        return [{"branch_id": int(b), "family_id": self.family(int(b))} for b in sorted(self.state["family"], key=int)]


# ---------------------------------------------------------------- over DataFrames

_OBJECT = "struct<label:int,area_cells:long,centroid_y:double,centroid_x:double,mean_intensity:double,max_intensity:double,precipitation_sum:double,y_start:int,y_stop:int,x_start:int,x_stop:int,cells:array<long>>"

SCHEMAS = {
    "node": "time long, node_id long, branch_id long, family_id long, label int, area_cells long, centroid_y double, centroid_x double, mean_intensity double, max_intensity double, precipitation_sum double, y_start int, y_stop int, x_start int, x_stop int",
    "edge": "time long, parent_node_id long, child_node_id long, score double, event string, gap int, raw_iou double, advected_iou double, distance double, parent_coverage double, child_coverage double",
    "event": "event_id long, time long, event string, parent_node_ids array<long>, child_node_ids array<long>",
    "family": "branch_id long, family_id long",
    "candidate": "frame long, parent_frame long, parent_label int, child_label int, score double, parent_coverage double, child_coverage double, passes_tau boolean, passes_event_overlap boolean, accepted_event boolean",
    "state": "state string",
    "missing": "t long, parent_t long, parent_label int, sy int, sx int",
    "moved": "branch_id long, family_id long, time long",
    "ended": "family_id long, time long",
}

#: Numbers of rows leave room for so many of a kind in a frame.
FRAME_ROWS = 1_000_000

#: One row of what the kernel emits: its kind, its number, and the row as JSON.
TAGGED = "sequence_id string, kind string, n long, row string"


def frame_rows(frames: DataFrame, labels: DataFrame, cells: DataFrame) -> DataFrame:
    """(sequence_id, t, objects): a row per frame, empty ones too, with its objects in label order."""
    from .objects import object_table

    objects = object_table(labels, cells, pixels=True)
    number = F.transform("pixels", lambda p: p["y"].cast("long") * F.lit(STRIDE) + p["x"].cast("long"))
    one = F.struct(*(F.col(c) for c in OBJECT_FIELDS), number.alias("cells")).cast(_OBJECT)
    grouped = objects.groupBy("sequence_id", "t").agg(F.array_sort(F.collect_list(one)).alias("objects"))
    empty = F.array().cast(f"array<{_OBJECT}>")
    return frames.select("sequence_id", F.col("t").cast("long").alias("t")).join(grouped, ["sequence_id", "t"], "left").select("sequence_id", "t", F.coalesce("objects", empty).alias("objects"))


#: Objects without cells, what joins counted of their overlaps, and which moved parents they looked at.
_PLAIN = _OBJECT.replace(",cells:array<long>", "")
_ASKED = ("parent_t", "parent_label", "sy", "sx")

#: Of an object's possible predecessors, as many nearest ones and as many that share most cells are tried beforehand.
GUESSES = 3


def linked_rows(frames: DataFrame, objects: DataFrame, links: DataFrame, asked: DataFrame) -> DataFrame:
    """(sequence_id, t, objects, links, asked): a row per frame, empty ones too. Rows of ``links`` and ``asked`` are those of its children."""
    parts = {"frame": (frames, F.lit(True)), "objects": (objects, F.struct(*OBJECT_FIELDS).cast(_PLAIN)), "links": (links, F.struct(*_ASKED, "child_label", "n")), "asked": (asked, F.struct(*_ASKED))}
    kinds = {name: df.select(c.alias("c")).schema["c"].dataType for name, (df, c) in parts.items()}
    one = lambda name: [parts[name][1].alias(n) if n == name else F.lit(None).cast(kinds[n]).alias(n) for n in parts]
    rows = functools.reduce(DataFrame.union, [df.select("sequence_id", F.col("t").cast("long").alias("t"), *one(name)) for name, (df, _) in parts.items()])
    lists = [F.array_sort(F.collect_list("objects")).alias("objects"), *(F.collect_list(c).alias(c) for c in ("links", "asked"))]
    return rows.groupBy("sequence_id", "t").agg(F.first("frame", True).alias("frame"), *lists).where("frame").drop("frame")


def _followed(parents: DataFrame, steps: int) -> DataFrame:
    """``parents`` (.., parent_t) once for each of the ``steps`` frames after it, as t."""
    return parents.withColumn("t", F.explode(F.sequence(F.col("parent_t") + 1, F.col("parent_t") + steps)))


def moved_overlaps(parents: DataFrame, labels: DataFrame) -> DataFrame:
    """(sequence_id, t, parent_t, parent_label, sy, sx, child_label, n): cells in common of ``parents`` (.., sy, sx, y, x), moved by (sy, sx), and
    ``labels`` of frame t. An equality join on cells."""
    moved = parents.select("sequence_id", "t", *_ASKED, (F.col("y") + F.col("sy")).alias("y"), (F.col("x") + F.col("sx")).alias("x"))
    met = moved.join(labels.select("sequence_id", F.col("t").cast("long").alias("t"), "y", "x", F.col("label").alias("child_label")), ["sequence_id", "t", "y", "x"])
    return met.groupBy("sequence_id", "t", *_ASKED, "child_label").agg(F.count("*").alias("n"))


def guessed_shifts(objects: DataFrame, raw: DataFrame, options: TrackOptions) -> DataFrame:
    """(sequence_id, t, parent_t, parent_label, sy, sx): how far objects would move by frame t if one of their near predecessors is theirs."""
    from .candidates import within_radius

    steps = options.max_gap + 1
    ends = ("p_centroid_y", "p_centroid_x", "c_centroid_y", "c_centroid_x")
    near = [within_radius(objects, options.max_displacement, k).select("sequence_id", F.col("t").cast("long").alias("parent_t"), F.col("c_label").alias("parent_label"), F.lit(k).alias("k"), *ends, F.col("distance").alias("order")) for k in range(1, steps + 1)]
    place = objects.select("sequence_id", "t", "label", "centroid_y", "centroid_x")
    before = place.select("sequence_id", F.col("t").cast("long").alias("before_t"), F.col("label").alias("before_label"), F.col("centroid_y").alias("p_centroid_y"), F.col("centroid_x").alias("p_centroid_x"))
    now = place.select("sequence_id", F.col("t").cast("long").alias("parent_t"), F.col("label").alias("parent_label"), F.col("centroid_y").alias("c_centroid_y"), F.col("centroid_x").alias("c_centroid_x"))
    shared = raw.select("sequence_id", F.col("t").alias("parent_t"), F.col("child_label").alias("parent_label"), (F.col("t") - F.col("parent_t")).cast("int").alias("k"), F.col("parent_t").alias("before_t"), F.col("parent_label").alias("before_label"), (-F.col("n")).cast("double").alias("order"))
    shared = shared.join(before, ["sequence_id", "before_t", "before_label"]).join(now, ["sequence_id", "parent_t", "parent_label"]).select(*near[0].columns)
    asked = None
    for some in (near[0] if len(near) == 1 else functools.reduce(DataFrame.unionByName, near), shared):
        best = Window.partitionBy("sequence_id", "parent_t", "parent_label").orderBy("order", "k", "p_centroid_y", "p_centroid_x")
        kept = some.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= GUESSES)
        asked = kept if asked is None else asked.unionByName(kept)
    speed = lambda axis: (F.col(f"c_centroid_{axis}") - F.col(f"p_centroid_{axis}")) / F.col("k")
    return _shifted(_followed(asked.select("sequence_id", "parent_t", "parent_label", speed("y").alias("vy"), speed("x").alias("vx")), steps))


def _shifted(rows: DataFrame) -> DataFrame:
    """(sequence_id, t, parent_t, parent_label, sy, sx) of rows with velocities, those that don't move left out."""
    shift = lambda v: half_even(F.col(v) * (F.col("t") - F.col("parent_t")))
    return rows.select("sequence_id", "t", "parent_t", "parent_label", shift("vy").alias("sy"), shift("vx").alias("sx")).where("sy <> 0 or sx <> 0").distinct()


_TERMINAL = "array<struct<time:long,label:int,centroid_y:double,centroid_x:double,before:array<double>,cells:array<long>>>"


def terminals(states: DataFrame) -> DataFrame:
    """(sequence_id, parent_t, parent_label, vy, vx, cells) of the objects that saved states may go on from."""
    held = states.select("sequence_id", F.from_json("state", f"active {_TERMINAL}, dormant {_TERMINAL}").alias("s"))
    one = held.select("sequence_id", F.explode(F.concat("s.active", "s.dormant")).alias("p"))
    speed = lambda axis, k: F.coalesce(F.when(F.col("p.time") > F.col("p.before")[2], (F.col(f"p.centroid_{axis}") - F.col("p.before")[k]) / (F.col("p.time") - F.col("p.before")[2])), F.lit(0.0))
    return one.select("sequence_id", F.col("p.time").alias("parent_t"), F.col("p.label").alias("parent_label"), speed("y", 0).alias("vy"), speed("x", 1).alias("vx"), F.col("p.cells").alias("cells"))


def with_cells(states: DataFrame, cells: DataFrame) -> DataFrame:
    """``states`` with the cells (sequence_id, parent_t, parent_label, y, x) of the objects that they may go on from, so that each is whole by itself."""
    number = F.col("y").cast("long") * STRIDE + F.col("x")
    key = ["sequence_id", "parent_t", "parent_label"]
    mine = cells.join(terminals(states).select(*key), key).groupBy(*key).agg(F.array_sort(F.collect_list(number)).alias("cells"))
    by_sequence = mine.groupBy("sequence_id").agg(F.collect_list(F.struct("parent_t", "parent_label", "cells")).alias("held"))
    rows = states.select("sequence_id", "state").join(by_sequence, "sequence_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                state = json.loads(text)
                of = {(h["parent_t"], h["parent_label"]): h["cells"] for h in held or ()}
                for x in (*state["active"], *state["dormant"]):
                    x["cells"] = of[x["time"], x["label"]]
                out.append(json.dumps(state, sort_keys=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["sequence_id", "state"])

    return rows.mapInArrow(run, "sequence_id string, state string")


def emit(lineage: Lineage, time: int, objects: list[dict]) -> Iterator[tuple[str, int, str]]:
    for kind, rows in lineage.advance(time, objects).items():
        for k, row in enumerate(rows):
            yield kind, time * FRAME_ROWS + k, json.dumps(row)


def finish(lineage: Lineage) -> Iterator[tuple[str, int, str]]:
    for row in lineage.family_map():
        yield "family", row["branch_id"], json.dumps(row)
    yield "state", 0, json.dumps({"state": json.dumps(lineage.state, sort_keys=True)})
    for key in sorted(getattr(lineage.overlaps, "missing", ())):
        yield "missing", key[0], json.dumps(dict(zip(("t", *_ASKED), key)))


def run_lineage(rows: DataFrame, options: TrackOptions, grid: Grid | None = None, states: DataFrame | None = None) -> DataFrame:
    """Tagged rows of every sequence of ``frame_rows`` or ``linked_rows``. ``states`` (sequence_id, state) go on from there.

    Sequences are dealt to tasks and read frame by frame: memory holds a frame and the kernel's state.
    """
    rows = rows.withColumn("state", F.lit(None).cast("string")) if states is None else rows.join(states.select("sequence_id", "state"), "sequence_id", "left")
    linked = ["links", "asked"] if "links" in rows.columns else []
    placed = rows.select("sequence_id", "t", "objects", "state", *linked).repartition("sequence_id").sortWithinPartitions("sequence_id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Lineage | None = None
        name: object = run  # no sequence yet
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                sequence, t, objects, state = (batch.column(j)[k].as_py() for j in range(4))
                if held is None or sequence != name:
                    if held is not None:
                        out += [(name, *x) for x in finish(held)]
                    name, held = sequence, Lineage(options, json.loads(state) if state else None, sequence, grid, TableOverlaps() if linked else None)
                if linked:
                    held.overlaps.load(batch.column(4)[k].as_py(), batch.column(5)[k].as_py())
                out += [(name, *x) for x in emit(held, t, objects)]
            if out:
                yield _tagged(out)
        if held is not None:
            yield _tagged([(name, *x) for x in finish(held)])

    return placed.mapInArrow(run, TAGGED)


def _tagged(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.string()))], ["sequence_id", "kind", "n", "row"])


def of_kind(tagged: DataFrame, kind: str) -> DataFrame:
    return tagged.where(F.col("kind") == kind).select("sequence_id", F.from_json("row", SCHEMAS[kind]).alias("r")).select("sequence_id", "r.*")


def in_order(tagged: DataFrame, kind: str) -> DataFrame:
    """``of_kind`` with ``emitted``: the place of a row among those of its kind in its frame, from 0. Of edges, those of events come first, by the
    event's least parent, then one-to-one links, then links over missing frames; in each, by parent, then child. (The kernel has links by child.)"""
    rows = tagged.where(F.col("kind") == kind).select("sequence_id", F.pmod("n", F.lit(FRAME_ROWS)).alias("emitted"), F.from_json("row", SCHEMAS[kind]).alias("r"))
    rows = rows.select("sequence_id", "r.*", "emitted")
    if kind != "edge":
        return rows
    later = F.when(F.col("event") == "continue", 1).when(F.col("event") == "gap_continue", 2).otherwise(0)
    order = Window.partitionBy("sequence_id", "time").orderBy(later, F.when(later == 0, F.col("emitted")), "parent_node_id", "child_node_id")
    return rows.withColumn("emitted", F.row_number().over(order).cast("long") - 1)


@dataclass
class TrackGraph:
    """Nodes (objects), edges, events, family map and states of tracked sequences."""

    nodes: DataFrame
    edges: DataFrame
    events: DataFrame
    family_map: DataFrame
    candidates: DataFrame
    states: DataFrame

    @property
    def objects(self) -> DataFrame:
        return self.nodes


def graph_of(tagged: DataFrame) -> TrackGraph:
    family = of_kind(tagged, "family")
    nodes = of_kind(tagged, "node").drop("family_id").join(family, ["sequence_id", "branch_id"])  # the chunk's final family
    nodes = nodes.select("sequence_id", "time", "node_id", "branch_id", "family_id", F.col("label").alias("local_label"), *OBJECT_FIELDS[1:])
    return TrackGraph(nodes, of_kind(tagged, "edge"), of_kind(tagged, "event"), family, of_kind(tagged, "candidate"), of_kind(tagged, "state"))


def track(cells: DataFrame, frames: DataFrame, labels: DataFrame, grid: Grid, options: TrackOptions | None = None, states: DataFrame | None = None, **policies) -> TrackGraph:
    """Track labelled objects; ``states`` go on where other frames of the same sequences ended.

    Objects, overlaps and overlaps of moved objects are joins over all frames of all sequences; of each sequence, the kernel reads its objects and link lists, frame by
    frame. It runs again only if it asks for a shift that no near predecessor gives: up to there all was right, so each run gets further. Its
    rows are checkpointed and then split by kind.
    """
    from .objects import object_table

    refuse_policies(policies)
    options = options or TrackOptions()
    shared_checkpoints(cells.sparkSession)
    steps = options.max_gap + 1
    labels = labels.select("sequence_id", "t", "y", "x", "label").checkpoint()  # read by several joins
    objects = object_table(labels, cells).checkpoint()
    key = ["sequence_id", "parent_t", "parent_label"]
    parents = labels.select("sequence_id", F.col("t").cast("long").alias("parent_t"), F.col("label").alias("parent_label"), "y", "x")
    if states is not None:
        number = lambda e: F.expr(e).cast(dict(labels.dtypes)["y"])
        old = terminals(states).select(*key, F.explode("cells").alias("c"))
        parents = parents.unionByName(old.select(*key, number(f"c div {STRIDE}").alias("y"), number(f"c % {STRIDE}").alias("x")))
    zero = F.lit(0)
    raw = moved_overlaps(_followed(parents, steps).withColumns({"sy": zero, "sx": zero}), labels).checkpoint()
    asked = guessed_shifts(objects, raw, options)
    if states is not None:
        asked = asked.unionByName(_shifted(_followed(terminals(states).drop("cells"), steps))).distinct()
    asked = asked.checkpoint()
    while True:
        links = raw.unionByName(moved_overlaps(parents.join(asked, key), labels))
        tagged = run_lineage(linked_rows(frames, objects, links, asked), options, grid, states).checkpoint()
        missing = of_kind(tagged, "missing")
        if missing.isEmpty():
            break
        asked = asked.unionByName(missing.select(*asked.columns)).distinct()
    graph = graph_of(tagged)
    graph.states = with_cells(graph.states, parents)
    return graph


def branch_cells(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sequence_id, t, y, x, branch_id): the labelled cells painted with their branch."""
    named = nodes.select("sequence_id", F.col("time").alias("t"), F.col("local_label").alias("label"), "branch_id")
    return labels.join(named, ["sequence_id", "t", "label"]).select("sequence_id", "t", "y", "x", "branch_id")


def save_state(state: dict | str, path: str) -> None:
    """JSON with sorted keys, written beside the path, synced and renamed."""
    import os
    import tempfile

    text = state if isinstance(state, str) else json.dumps(state, sort_keys=True)
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".state-")
    with os.fdopen(handle, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def load_state(path: str) -> dict:
    with open(path) as f:
        return check_state(json.load(f))
