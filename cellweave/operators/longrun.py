"""Identification and tracking of a long series of files, chunk by chunk, with a ledger: killed anywhere, it goes on where it was."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, TrackOptions, disk
from ..sources.ledger import Ledger, read_text
from ..sources.series import Settings, list_files, plan_series, read_series
from ..sources.tables import combine, exists, publish, read_manifest
from .identify import identify
from .lineage import frame_rows, track
from .matching import shared_checkpoints
from .objects import branch_speeds, frame_statistics
from .quality import structure_counts, tau_sweep


@dataclass(frozen=True)
class Run:
    """What a run does. The files and all of this must stay as they are when it is resumed; chunk sizes and splits may change."""

    path: str
    variable: str = ""
    series: tuple[tuple[str, object], ...] = ()  # options of ``read_series``
    threshold: float = 0.0
    bridge_radius: int = 1
    min_size: int = 1
    options: TrackOptions = TrackOptions()
    save_labels: bool = False

    def contract(self) -> dict:
        kept = {k: str(v) for k, v in self.series if k != "samples_per_task"}
        return {"path": self.path, "variable": self.variable, "series": kept, "threshold": self.threshold, "bridge_radius": self.bridge_radius, "min_size": self.min_size, "options": self.options.config(), "save_labels": self.save_labels}

    @classmethod
    def of(cls, contract: dict) -> Run:
        """The run that a contract tells of."""
        names = {f.name for f in dataclasses.fields(TrackOptions)}
        options = {k: int(v) if k in ("max_gap", "gap_min_pixels") else v for k, v in contract["options"].items() if k in names}
        return cls(contract["path"], contract["variable"], tuple(sorted(contract["series"].items())), contract["threshold"], contract["bridge_radius"], contract["min_size"], TrackOptions(**options), contract["save_labels"])

    def window(self) -> tuple[int, int]:
        """First frame and the one after the last."""
        s = Settings.of({"path": self.path, "variable": self.variable} | {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in self.series})
        return s.start, plan_series(s).frames if s.stop is None else s.stop

    def frames(self, spark: SparkSession, low: int, high: int) -> tuple[DataFrame, DataFrame, Grid]:
        """(cells, frames, grid) of frames ``low`` to below ``high``, t counted from the series' first; accumulated amounts are differenced across chunks, too."""
        given = {**dict(self.series), "start": low, "stop": high}
        cells, frames, grid = read_series(spark, self.path, self.variable, **given)
        return *(df.withColumn("t", F.col("t") + low) for df in (cells, frames)), grid


def track_series(spark: SparkSession, run: Run, folder: str, chunk_frames: int = 24, resume: bool = False, most_chunks: int | None = None) -> Ledger:
    """Track the series and publish its catalog and report in ``folder``, next to the chunks.

    Each chunk is committed with the states that the next goes on from. With ``resume``, what is there is verified and gone on with; a run that
    is done is verified only. After ``most_chunks`` chunks a call returns, and the rest waits for another. The marker SUCCESS.json comes last.
    """
    if chunk_frames < 1 or (most_chunks is not None and most_chunks < 0):
        raise ValueError("chunk_frames must be positive, most_chunks not negative")
    shared_checkpoints(spark)
    first, stop = run.window()
    ledger = Ledger(spark, folder, run.contract() | {"frames": [first, stop]}, list_files(run.path), resume)
    left = most_chunks
    while (low := first if ledger.end is None else ledger.end) < stop:
        if left == 0:
            return ledger
        high = min(low + chunk_frames, stop)
        cells, frames, grid = run.frames(spark, low, high)
        cells = cells.checkpoint()  # read from the files once
        labels = identify(cells, grid, run.threshold, disk(run.bridge_radius), run.min_size).checkpoint()
        states = ledger.last("states") if ledger.commits else None
        graph = track(cells, frames.select("sequence_id", "t"), labels, grid, run.options, states)
        tables = {"objects": graph.nodes, "edges": graph.edges, "events": graph.events, "family_map": graph.family_map, "states": graph.states, "frame_statistics": frame_statistics(frames.select("sequence_id", "t"), cells, labels, grid)}
        if run.save_labels:
            tables["labels"] = labels
        ledger.commit(low, high, tables)
        left = None if left is None else left - 1
    _end(spark, run, ledger)
    return ledger


def _end(spark: SparkSession, run: Run, ledger: Ledger) -> None:
    """The catalog of all chunks and the report, each published at once and only if it isn't there."""
    tables = combine([{n: ledger.read(n) for n in ("objects", "edges", "events")} | {"family_map": ledger.last("family_map")}])
    hours = float(dict(run.series).get("hours", 1.0))
    report = {"branch_speeds": branch_speeds(tables["objects"], tables["edges"], hours), "frame_statistics": ledger.read("frame_statistics")}
    for name, found in (("catalog", tables), ("report", report)):
        place = f"{ledger.folder}/{name}"
        if not exists(spark, place):
            publish(spark, place, found, {"head": ledger.head})
        elif read_manifest(spark, place)["head"] != ledger.head:
            raise ValueError(f"the {name} is of other chunks")
    ledger.finish({"chunks": len(ledger.commits)})


def audit_run(spark: SparkSession, folder: str, taus: tuple[float, ...]) -> Iterator[tuple[str, DataFrame]]:
    """(name, table) of the audit of a saved run: its structures and what other thresholds would give.

    The run is verified, files and chunks, before anything is read from it; its labels must have been saved.
    """
    told = json.loads(read_text(spark, f"{folder.rstrip('/')}/contract.json"))
    run = Run.of(told)
    if not run.save_labels:
        raise ValueError("the run didn't save its labels")
    if not exists(spark, f"{folder.rstrip('/')}/SUCCESS.json"):
        raise ValueError("the run isn't finished")
    ledger = Ledger(spark, folder, run.contract() | {"frames": told["frames"]}, list_files(run.path), resume=True)
    shared_checkpoints(spark)
    cells, frames, grid = run.frames(spark, *told["frames"])
    cells, labels = cells.checkpoint(), ledger.read("labels")
    again = track(cells, frames.select("sequence_id", "t"), labels, grid, run.options)
    yield "candidates", again.candidates
    yield "structures", structure_counts(again.candidates)
    yield "sweep", tau_sweep(frame_rows(frames.select("sequence_id", "t"), labels, cells), run.options, taus, grid)
    edges = ledger.read("edges").drop("sequence_id")
    yield "edges_that_differ", edges.exceptAll(again.edges.select(*edges.columns))
