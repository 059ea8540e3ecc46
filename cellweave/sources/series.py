"""Many array files as one series of frames: a data source that plans splits from headers, and one that writes dense rasters.

Headers alone say which samples there are: they are put in order of time, checked, and cut into splits of so many samples, wherever files end.
A split of accumulated amounts is given the one sample before it as well (its halo), so each split differences its own frames and no
shuffle by cell is needed. Files must be seen by the driver and all executors under the same path.
"""

from __future__ import annotations

import datetime
import glob
import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..grid import Grid
from ..operators.preprocess import RATE_UNITS, classify_rain, refuse_cumulative
from .arrays import CELLS, _batch
from .classic import ClassicFile
from .multitime import PER_SECOND

FRAMES = "sequence_id string, t long, interval_start timestamp_ntz, interval_end timestamp_ntz"

#: How many headers the driver reads side by side.
HEADERS_AT_ONCE = 32


# ---------------------------------------------------------------- files


def local(path: str) -> str:
    return re.sub("^file:(//)?", "", path)


def stamp_of(path: str) -> datetime.datetime | None:
    """The time in a file's name, as ``functions.scalar.stamp_in_name`` reads it."""
    found = re.search(r"(\d{4}-\d{2}-\d{2})_(\d{2})[:_](\d{2})[:_](\d{2})(?:\.\w+)?$", os.path.basename(path))
    return datetime.datetime.fromisoformat(f"{found[1]} {found[2]}:{found[3]}:{found[4]}") if found else None


class NpyFile:
    """A cube (time, y, x) or one frame (y, x); its samples have no times but that in the name of a single one."""

    def __init__(self, path: str, variable: str):
        self.values = np.load(local(path), mmap_mode="r")
        if self.values.ndim == 2:
            self.values = self.values[None]
        if self.values.ndim != 3:
            raise ValueError("an array must have shape (time, y, x)")
        self.shape, self.attributes = self.values.shape, {}
        self.times = [stamp_of(path)] if len(self.values) == 1 else [None] * len(self.values)

    def frame(self, k: int) -> np.ndarray:
        return np.asarray(self.values[k], np.float64)

    def grid(self) -> tuple[np.ndarray, ...]:
        return ()


def open_array(path: str, variable: str) -> NpyFile | ClassicFile:
    """The file's header; values are read frame by frame."""
    return NpyFile(path, variable) if path.endswith(".npy") else ClassicFile(local(path), variable, stamp_of(path))


def list_files(path: str) -> list[str]:
    """Files of a folder (and below), a pattern, or names with commas between; hidden ones are left out."""
    found = []
    for one in path.split(","):
        place = local(one.strip())
        if os.path.isdir(place):
            found += [os.path.join(top, n) for top, _, names in os.walk(place) for n in names if re.search(r"\.(npy|nc|nc3|cdf)$", n) and not n.startswith((".", "_"))]
        else:
            found += glob.glob(place)
    if not found:
        raise FileNotFoundError(f"no array file at {path}")
    return sorted(set(found))


# ---------------------------------------------------------------- plan


@dataclass(frozen=True)
class Settings:
    """What the options say, checked."""

    path: str
    variable: str
    unit: str
    rain_kind: str
    hours: float
    origin: str
    tolerance: float
    sequence_id: str
    samples_per_task: int
    start: int
    stop: int | None
    crop: int
    snapshots: bool
    missing_frames: str

    @classmethod
    def of(cls, options: dict) -> Settings:
        get = lambda name, default: options.get(name, default)
        stop = get("stop", "")
        found = cls(get("path", ""), get("variable", ""), get("unit", ""), get("rain_kind", ""), float(get("hours", "1")), get("origin", ""), float(get("tolerance", "1e-3")), get("sequence_id", "default"), int(get("samples_per_task", "24")), int(get("start", "0")), int(stop) if stop else None, int(get("crop", "0")), get("snapshots", "false") == "true", get("missing_frames", "refuse"))
        if found.hours <= 0 or found.samples_per_task < 1 or found.crop < 0 or found.rain_kind not in ("", "cumulative", "interval", "rate"):
            raise ValueError("hours and samples_per_task must be positive, crop not negative, rain_kind cumulative, interval or rate")
        if found.missing_frames not in ("refuse", "keep"):
            raise ValueError("missing_frames must be refuse or keep")
        return found


@dataclass(frozen=True)
class Plan:
    """Samples (path, index in the file, time) in order; kind of rain and unit; the grid; seconds of a step."""

    samples: list[tuple[str, int, datetime.datetime | None]]
    kind: str
    factor: float
    grid: tuple[int, int]
    seconds: int

    @property
    def frames(self) -> int:
        return len(self.samples) - (self.kind == "cumulative")


def plan_series(s: Settings) -> Plan:
    """The series that the files' headers tell; no values are read."""
    paths = list_files(s.path)
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        files = list(pool.map(lambda p: open_array(p, s.variable), paths))
    if len({f.shape[1:] for f in files}) > 1:
        raise ValueError("files have different grids")
    kinds = {(s.rain_kind or classify_rain(s.variable, s.unit or f.attributes.get("units", ""), f.attributes), (s.unit or str(f.attributes.get("units", ""))).lower().replace(" ", "")) for f in files}
    if len(kinds) > 1:
        raise ValueError("files have different units or kinds of rain")
    kind, unit = kinds.pop()
    if s.snapshots and any(f.shape[0] != 1 or f.times[0] is None for f in files):
        raise ValueError("a snapshot has one sample and a time in its name")
    if kind != "cumulative":
        refuse_cumulative(s.variable)
    if kind == "rate" and unit not in (*RATE_UNITS, *PER_SECOND):
        raise ValueError("rates need the unit mm/h")
    if kind != "rate" and unit not in ("mm", "kgm-2", "kg/m2"):
        raise ValueError("amounts need the unit mm")
    samples = [(p, k, t) for p, f in zip(paths, files) for k, t in enumerate(f.times)]
    timed = sum(t is not None for *_, t in samples)
    if timed not in (0, len(samples)):
        raise ValueError("some samples have times and some have none")
    seconds = round(s.hours * 3600)
    if timed:
        samples.sort(key=lambda x: (x[2], x[0], x[1]))
        steps = {(b[2] - a[2]).total_seconds() for a, b in zip(samples, samples[1:])}
        if 0 in steps:
            raise ValueError("two samples have the same time")
        if steps - {seconds}:
            raise ValueError("samples are missing or irregular")
    elif s.origin:
        begin = datetime.datetime.fromisoformat(s.origin)
        samples = [(p, k, begin + datetime.timedelta(seconds=seconds * n)) for n, (p, k, _) in enumerate(samples)]
    if kind == "cumulative" and len(samples) < 2:
        raise ValueError("at least two samples are needed")
    factor = 3600.0 if unit in PER_SECOND else 1.0 if kind == "rate" else 1 / s.hours
    return Plan(samples, kind, factor, files[0].shape[1:], seconds)


def _window(plan: Plan, s: Settings) -> tuple[int, int]:
    stop = plan.frames if s.stop is None else s.stop
    if not 0 <= s.start < stop <= plan.frames:
        raise ValueError("time window is outside of the input")
    return s.start, stop


# ---------------------------------------------------------------- reading


class Split(InputPartition):
    """Frames from ``first`` on, the samples they come from, and the sample before them if amounts accumulate."""

    def __init__(self, first: int, halo: tuple | None, samples: list[tuple]):
        super().__init__(first)
        self.first, self.halo, self.samples = first, halo, samples


def splits(plan: Plan, s: Settings) -> list[Split]:
    start, stop = _window(plan, s)
    begin = int(plan.kind == "cumulative")  # the sample of frame 0
    out = []
    for t in range(start, stop, s.samples_per_task):
        high = min(t + s.samples_per_task, stop)
        out.append(Split(t - start, plan.samples[t] if begin else None, plan.samples[t + begin : high + begin]))
    return out


def frames_of(split: Split, plan: Plan, s: Settings) -> Iterator[np.ndarray]:
    """Rates of one frame after another; one more frame at most is in memory."""
    ny, nx = plan.grid
    side = (min(s.crop, ny), min(s.crop, nx)) if s.crop else (ny, nx)
    y0, x0 = (ny - side[0]) // 2, (nx - side[1]) // 2
    first = open_array(plan.samples[0][0], s.variable).grid()
    name, held = None, None

    def values(sample: tuple) -> np.ndarray:
        nonlocal name, held
        if sample[0] != name:
            name, held = sample[0], open_array(sample[0], s.variable)
            grid = held.grid()
            if len(grid) != len(first) or not all(np.array_equal(a, b, equal_nan=True) for a, b in zip(grid, first)):
                raise ValueError("Coordinates change between frames")
            if s.snapshots and getattr(held, "inside", None) not in (None, stamp_of(name)):
                raise ValueError("Filename/Times differ")
        found = held.frame(sample[1])[y0 : y0 + side[0], x0 : x0 + side[1]].astype(np.float32)
        if (found < 0).any():
            raise ValueError("an accumulated amount is negative" if plan.kind == "cumulative" else "negative precipitation")
        return found

    before = values(split.halo) if split.halo else None
    for sample in split.samples:
        now = values(sample)
        rate = now
        if before is not None:
            ok = np.isfinite(now) & np.isfinite(before)
            rate = np.where(ok, now - np.where(ok, before, 0), np.float32("nan"))
            if (rate < -s.tolerance).any():
                raise ValueError("accumulation decreased")
            rate = np.maximum(rate, 0)  # NaN stays
            before = now
        if s.missing_frames == "refuse" and not np.isfinite(rate).any():
            raise ValueError("entire frame is missing")
        yield np.where(np.isfinite(rate), rate * np.float32(plan.factor), rate).astype(np.float32)


class _SeriesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.settings = Settings.of(options)
        self.plan = plan_series(self.settings)
        self.only_frames = options.get("emit", "cells") == "frames"
        _window(self.plan, self.settings)

    def partitions(self):
        return splits(self.plan, self.settings)

    def read(self, split):
        s, plan = self.settings, self.plan
        if self.only_frames:
            end = [t for *_, t in split.samples]
            begin = [None if t is None else t - datetime.timedelta(seconds=plan.seconds) for t in end]
            n = len(end)
            yield pa.RecordBatch.from_arrays([pa.array([s.sequence_id] * n), pa.array(range(split.first, split.first + n), pa.int64()), pa.array(begin, pa.timestamp("us")), pa.array(end, pa.timestamp("us"))], ["sequence_id", "t", "interval_start", "interval_end"])
            return
        for k, rate in enumerate(frames_of(split, plan, s)):
            yield _batch(rate[None], s.sequence_id, split.first + k)


class SeriesSource(DataSource):
    """``spark.read.format("cellweave_series").option("variable", "RAINNC").load(folder)``: cells in mm/h, those that are exactly 0 left out."""

    @classmethod
    def name(cls) -> str:
        return "cellweave_series"

    def schema(self) -> str:
        return FRAMES if self.options.get("emit") == "frames" else CELLS

    def reader(self, schema):
        return _SeriesReader(dict(self.options))


def read_series(spark: SparkSession, path: str, variable: str = "", **options) -> tuple[DataFrame, DataFrame, Grid]:
    """(cells, frames, grid) in mm/h of the array files at ``path`` (a folder, a pattern, names with commas).

    Options are those of ``Settings``: ``unit`` and ``rain_kind`` where headers don't tell, ``hours`` of a step, ``origin`` for series without times,
    ``start`` and ``stop`` frames, ``crop`` to a central square, ``snapshots`` for one accumulated frame per file, ``samples_per_task``. Of
    accumulated amounts, frame t is from sample t to t + 1. Irregular times, repeated ones, changing grids, negative amounts, accumulations that
    fall by more than ``tolerance`` and frames that are missing as a whole are errors; with ``missing_frames`` "keep" the latter are frames of
    missing cells, as those that miss some of them are.
    """
    spark.dataSource.register(SeriesSource)
    given = {"path": path, "variable": variable} | {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    s = Settings.of(given)
    plan = plan_series(s)
    _window(plan, s)
    side = [min(s.crop, n) if s.crop else n for n in plan.grid]
    reader = lambda emit: spark.read.format("cellweave_series").options(**{k: v for k, v in given.items() if k != "path"}, emit=emit).load(path)
    return reader("cells"), reader("frames"), Grid(*side)


# ---------------------------------------------------------------- writing


@dataclass
class _Placed(WriterCommitMessage):
    cells: int


class _RasterWriter(DataSourceArrowWriter):
    """Tasks put their cells into files of the whole size, under names that a commit changes; an abort removes them.

    A task that runs twice puts the same cells to the same places.
    """

    def __init__(self, options: dict):
        self.folder, self.dtype = local(options["path"]), np.dtype(options["dtype"])
        self.shape = int(options["ny"]), int(options["nx"])
        self.cuts = json.loads(options["cuts"])  # first frames of the files, and the end
        self.temporary = os.path.join(self.folder, f"_temporary-{uuid.uuid4().hex}")
        if os.path.isdir(self.folder) and os.listdir(self.folder):
            raise FileExistsError(self.folder)
        os.makedirs(self.temporary)
        for k in range(len(self.cuts) - 1):
            np.lib.format.open_memmap(self._place(self.temporary, k), "w+", self.dtype, (self.cuts[k + 1] - self.cuts[k], *self.shape)).flush()

    def _place(self, folder: str, k: int) -> str:
        return os.path.join(folder, f"frames-{self.cuts[k]:08d}.npy")

    def write(self, iterator):
        total = 0
        cuts = np.array(self.cuts)
        for batch in iterator:
            t, y, x, value = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("t", "y", "x", "value"))
            if len(t) and not ((t >= cuts[0]) & (t < cuts[-1]) & (y >= 0) & (y < self.shape[0]) & (x >= 0) & (x < self.shape[1])).all():
                raise ValueError("cells outside of the raster")
            file = np.searchsorted(cuts, t, "right") - 1
            for k in np.unique(file).tolist():
                mine = file == k
                held = np.load(self._place(self.temporary, k), mmap_mode="r+")
                held[t[mine] - cuts[k], y[mine], x[mine]] = value[mine]
                held.flush()
            total += len(t)
        return _Placed(total)

    def commit(self, messages):
        for k in range(len(self.cuts) - 1):
            os.replace(self._place(self.temporary, k), self._place(self.folder, k))
        os.rmdir(self.temporary)
        told = {"shape": [self.cuts[-1] - self.cuts[0], *self.shape], "dtype": self.dtype.str, "first_frames": self.cuts[:-1], "cells": sum(m.cells for m in messages if m)}
        name = os.path.join(self.folder, "_manifest.json")
        with open(f"{name}.new", "w") as f:
            json.dump(told, f, sort_keys=True)
        os.replace(f"{name}.new", name)  # last: without it the folder isn't whole

    def abort(self, messages):
        for k in range(len(self.cuts) - 1):
            if os.path.exists(place := self._place(self.temporary, k)):
                os.remove(place)
        if os.path.isdir(self.temporary):
            os.rmdir(self.temporary)
        if os.path.isdir(self.folder) and not os.listdir(self.folder):
            os.rmdir(self.folder)


class RasterSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cellweave_raster"

    def writer(self, schema, overwrite):
        return _RasterWriter(dict(self.options))


def write_raster(cells: DataFrame, value: str, grid: Grid, frames: int, folder: str, dtype: str = "float32", cuts: Sequence[int] | None = None, first: int = 0) -> None:
    """``value`` of (t, y, x) rows as dense .npy files (time, y, x), 0 where no row is.

    ``frames`` from ``first`` on; ``cuts`` are the first frames of the files (24 frames each where it isn't given). Rows of a file go to a few tasks, in
    order. Frames come from the caller, so empty ones are written too. ``read_raster`` reads it back.
    """
    begins = sorted({first, *(cuts if cuts is not None else range(first, first + frames, 24))})
    if frames < 1 or begins[0] != first or begins[-1] >= first + frames:
        raise ValueError("cuts must lie within the frames")
    cells.sparkSession.dataSource.register(RasterSink)
    rows = cells.select(F.col("t").cast("long").alias("t"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).alias("value"))
    rows = rows.repartitionByRange(F.col("t"), F.col("y")).sortWithinPartitions("t", "y", "x")
    rows.write.format("cellweave_raster").options(dtype=dtype, ny=grid.ny, nx=grid.nx, cuts=json.dumps([*begins, first + frames])).mode("append").save(folder)


def read_raster(spark: SparkSession, folder: str) -> DataFrame:
    """(t, y, x, value) of the cells of ``write_raster`` that aren't 0; a folder without a manifest isn't whole."""
    place = local(folder)
    with open(os.path.join(place, "_manifest.json")) as f:
        told = json.load(f)
    names = [os.path.join(place, f"frames-{k:08d}.npy") for k in told["first_frames"]]
    kind = "double" if np.dtype(told["dtype"]).kind == "f" else "long"
    rows = spark.createDataFrame(list(zip(names, told["first_frames"])), "name string, first long").repartition(len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                held = np.load(name, mmap_mode="r")
                for k in range(len(held)):
                    y, x = np.nonzero(held[k])
                    found = held[k][y, x].astype(np.float64 if kind == "double" else np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), first + k)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(found)], ["t", "y", "x", "value"])

    return rows.mapInArrow(run, f"t long, y int, x int, value {kind}")
