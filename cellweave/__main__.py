"""python -m cellweave run|stream|series|catalog|audit|recheck|diagnose|inspect ...: the engine over .npy cubes and catalogs."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from .grid import Grid, TrackOptions, disk
from .operators import objects, quality
from .operators.identify import identify
from .operators.lineage import TrackGraph, frame_rows, graph_of, track
from .operators.longrun import Run, audit_run, track_series
from .operators.preprocess import check_amounts, check_interval, crop, refuse_cumulative, to_rate
from .sources.arrays import describe_npy, frame_table, read_npy
from .sources.prepared import prepare_cube
from .sources.tables import finalize_catalog, publish, read_part, read_states, write_part


def _input(p: argparse.ArgumentParser) -> None:
    p.add_argument("input", help=".npy cube (time, y, x) that every executor can read")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--stop", type=int)
    p.add_argument("--threshold", type=float, default=0.0, help="mm/h, inclusive")
    p.add_argument("--bridge-radius", type=int, default=1, help="cells")
    p.add_argument("--min-size", type=int, default=1, help="cells")
    p.add_argument("--crop", type=int, default=0, help="width of the central square; 0: all")
    p.add_argument("--tau", type=float, default=0.35)
    p.add_argument("--max-displacement", type=float, default=20.0, help="cells per frame")
    p.add_argument("--max-gap", type=int, default=1)
    p.add_argument("--gap-tau", type=float)
    p.add_argument("--gap-ambiguity", type=float, default=0.05)
    p.add_argument("--event-overlap", type=float, default=0.10)
    p.add_argument("--gap-min-pixels", type=int, default=0)
    p.add_argument("--sequence-id", default="default")
    p.add_argument("--state-input", help="catalog part whose states are gone on from")
    p.add_argument("--absolute-start", type=int, help="time of the first frame; by default after the state's last, else 0")
    p.add_argument("--variable", default="", help="name of what the cube holds; accumulated amounts are refused")
    p.add_argument("--units", help="mm/h for rates (what is taken where nothing tells), mm for amounts of each interval; of a series, those of the headers by default")
    p.add_argument("--dt-hours", type=float, default=1.0)
    p.add_argument("--grid-km", type=float, help="spacing of the grid: speeds are also in km/h")
    p.add_argument("--saved", help="catalog part of an earlier run to compare with or to look into")
    p.add_argument("--chunk-frames", type=int, default=24)
    p.add_argument("--rain-kind", default="", help="series: cumulative, interval or rate, where headers don't tell")
    p.add_argument("--origin", default="", help="series: time of the first sample, where files have no times")
    p.add_argument("--resume", action="store_true", help="series: verify what is committed and go on")
    p.add_argument("--most-chunks", type=int, help="series: stop after so many chunks")
    p.add_argument("--save-labels", action="store_true", help="series: keep labelled cells, which audit --saved needs")
    p.add_argument("--taus", type=float, nargs="+", default=[0.25, 0.30, 0.35, 0.40, 0.45])
    p.add_argument("--frames", type=int, nargs="+", default=[1])


def _load(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame, Grid, TrackOptions, int]:
    refuse_cumulative(a.variable)
    units = a.units or "mm/h"
    kind = "interval" if units.lower().replace(" ", "") == "mm" else "rate"
    check_interval(kind, units)
    shape = describe_npy(a.input)["shape"]
    stop = shape[0] if a.stop is None else a.stop
    cells = read_npy(spark, a.input, a.start, stop, a.sequence_id)
    states = read_states(spark, a.state_input) if a.state_input else None
    first = a.absolute_start
    if first is None:
        first = json.loads(states.where(states.sequence_id == a.sequence_id).first().state)["last_time"] + 1 if states is not None else 0
    cells = cells.withColumn("t", cells.t + first)
    check_amounts(cells)
    if kind == "interval":
        cells = to_rate(cells, a.dt_hours)
    cells, grid = crop(cells, Grid(shape[1], shape[2]), a.crop)
    labels = identify(cells, grid, a.threshold, disk(a.bridge_radius), a.min_size)
    options = TrackOptions(a.tau, a.max_displacement, a.max_gap, a.gap_tau, a.gap_ambiguity, a.event_overlap, a.gap_min_pixels)
    a.states = states
    return cells, frame_table(spark, stop - a.start, a.sequence_id, first), labels, grid, options, first


def _graph(spark: SparkSession, a: argparse.Namespace) -> tuple[TrackGraph, tuple]:
    loaded = _load(spark, a)
    cells, frames, labels, grid, options, _ = loaded
    return track(cells, frames, labels, grid, options, a.states), loaded


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    graph, _ = _graph(spark, a)
    write_part(spark, a.output_dir, graph, vars(a) | {"states": None})


def stream(spark: SparkSession, a: argparse.Namespace) -> None:
    """Chunk by chunk, each published before the next, then the catalog and a summary."""
    cells, frames, labels, grid, options, first = _load(spark, a)
    total, states, parts = frames.count(), a.states, []
    for low in range(first, first + total, a.chunk_frames):
        part = lambda df: df.where(df.t.between(low, low + a.chunk_frames - 1))  # noqa: B023, E731
        graph = track(part(cells), part(frames), part(labels), grid, options, states)
        states = graph.states
        parts.append(f"{a.output_dir}/chunk_{low:08d}")
        write_part(spark, parts[-1], graph, {"first_frame": low})
    finalize_catalog(spark, parts, f"{a.output_dir}/catalog")
    done = {n: spark.read.parquet(f"{a.output_dir}/catalog/{n}") for n in ("objects", "edges", "events")}
    summary = objects.run_summary(frames, cells, labels, done["objects"], done["edges"], done["events"], grid, a.dt_hours)
    speeds = objects.branch_speeds(done["objects"], done["edges"], a.dt_hours, a.grid_km)
    publish(spark, f"{a.output_dir}/report", {"summary": summary, "branch_speeds": speeds, "frame_statistics": objects.frame_statistics(frames, cells, labels, grid)}, {"frames": total})


def series(spark: SparkSession, a: argparse.Namespace) -> None:
    """Many files as one series, committed chunk by chunk; input is a folder, a pattern or names with commas."""
    given = {"unit": a.units, "rain_kind": a.rain_kind, "hours": a.dt_hours, "origin": a.origin, "crop": a.crop, "start": a.start, "stop": a.stop, "sequence_id": a.sequence_id}
    options = TrackOptions(a.tau, a.max_displacement, a.max_gap, a.gap_tau, a.gap_ambiguity, a.event_overlap, a.gap_min_pixels)
    run = Run(a.input, a.variable, tuple((k, v) for k, v in given.items() if v not in ("", None)), a.threshold, a.bridge_radius, a.min_size, options, a.save_labels)
    track_series(spark, run, a.output_dir, a.chunk_frames, a.resume, a.most_chunks)


def audit(spark: SparkSession, a: argparse.Namespace) -> None:
    """Structures and other thresholds; with --saved those of a finished series run, whose files and chunks are verified first."""
    if a.saved:
        publish(spark, a.output_dir, dict(audit_run(spark, a.saved, tuple(a.taus))), {"taus": a.taus, "run": a.saved})
        return
    graph, (cells, frames, labels, grid, options, _) = _graph(spark, a)
    sweep = quality.tau_sweep(frame_rows(frames, labels, cells), options, a.taus, grid)
    publish(spark, a.output_dir, {"candidates": graph.candidates, "structures": quality.structure_counts(graph.candidates), "sweep": sweep}, {"taus": a.taus})


def recheck(spark: SparkSession, a: argparse.Namespace) -> None:
    """Track whole and in chunks; publish the differences, which should be none. With --saved also the links that differ from those of that run."""
    graph, (cells, frames, labels, grid, options, _) = _graph(spark, a)
    again = graph_of(quality.replay(frame_rows(frames, labels, cells), options, a.chunk_frames, grid))
    out = {n: quality.differences(getattr(graph, n), getattr(again, n)) for n in ("nodes", "edges", "events", "family_map")}
    out["edge_diff"] = quality.edge_diff(quality.named_edges(graph.edges, graph.nodes), quality.named_edges(again.edges, again.nodes))
    if a.saved:
        old = quality.named_edges(read_part(spark, a.saved, "edges"), read_part(spark, a.saved, "objects"))
        out["saved_edge_diff"] = quality.edge_diff(old, quality.named_edges(graph.edges, graph.nodes))
    out["checks"] = quality.structure_checks(graph.nodes, graph.edges, graph.events, graph.family_map)
    publish(spark, a.output_dir, out, {"chunk_frames": a.chunk_frames})


def diagnose(spark: SparkSession, a: argparse.Namespace) -> None:
    """Why pairs of objects of the given frames were linked or not: here, or with --saved in that run."""
    if a.saved:
        cells, frames, labels, grid, options, _ = _load(spark, a)
        edges, nodes = read_part(spark, a.saved, "edges"), read_part(spark, a.saved, "objects")
    else:
        graph, (cells, frames, labels, grid, options, _) = _graph(spark, a)
        edges, nodes = graph.edges, graph.nodes
    evidence = quality.pair_evidence(objects.object_table(labels, cells), labels, options, a.frames)
    decided = quality.pair_decisions(evidence, quality.named_edges(edges, nodes), options.tau)
    publish(spark, a.output_dir, {"pair_decisions": decided}, {"frames": a.frames})


COMMANDS = {f.__name__: f for f in (run, stream, series, audit, recheck, diagnose)}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cellweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, f in COMMANDS.items():
        _input(commands.add_parser(name, help=f.__doc__))
    p = commands.add_parser("catalog", help="combine parts in order of time")
    p.add_argument("parts", nargs="+")
    p.add_argument("--output-dir", required=True)
    p = commands.add_parser("prepare", help="a short cube of rates from hourly snapshots")
    p.add_argument("folder")
    p.add_argument("--start", required=True)
    p.add_argument("--hours", type=int, required=True)
    p.add_argument("--variable", default="RAINNC")
    p.add_argument("--units", default="")
    p.add_argument("--output-dir", required=True)
    commands.add_parser("inspect", help="show what an input holds, without reading it").add_argument("input")
    a = parser.parse_args(argv)
    if a.command == "inspect":
        print(json.dumps(describe_npy(a.input)))
        return
    spark = SparkSession.builder.appName("cellweave").getOrCreate()
    if a.command == "catalog":
        finalize_catalog(spark, a.parts, a.output_dir)
    elif a.command == "prepare":
        prepare_cube(spark, a.folder, a.start, a.hours, a.output_dir, a.variable, a.units)
    else:
        COMMANDS[a.command](spark, a)


if __name__ == "__main__":
    main()
