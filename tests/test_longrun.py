import json
import os
import shutil

import numpy as np
import pytest

from cellweave.grid import TrackOptions, disk
from cellweave.operators import longrun, quality
from cellweave.operators.identify import identify
from cellweave.operators.lineage import track
from cellweave.operators.longrun import Run, audit_run, track_series
from cellweave.sources import ledger
from cellweave.sources.ledger import hash_files
from tests.helpers import tables

TABLES = ("objects", "edges", "events", "family_map")
OPTIONS = TrackOptions(tau=0.3, max_displacement=3)


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    """Accumulated amounts in three files, a run over them, and the graph of the whole at once."""
    rng = np.random.default_rng(3)
    rain = np.where(rng.random((6, 8, 8)) < 0.2, rng.integers(1, 9, (6, 8, 8)), 0)
    total = np.concatenate([np.zeros((1, 8, 8)), np.cumsum(rain, 0)])
    folder = str(tmp_path_factory.mktemp("series"))
    for k, (a, b) in enumerate(((0, 1), (1, 5), (5, 7))):
        np.save(f"{folder}/part{k}.npy", total[a:b])
    run = Run(folder, "RAINNC", (("unit", "mm"),), bridge_radius=0, options=OPTIONS, save_labels=True)
    cells, frames, grid = tables(spark, rain, "default")
    whole = track(cells, frames, identify(cells, grid, shape=disk(0)), grid, OPTIONS)
    return run, dict(zip(TABLES, (whole.nodes, whole.edges, whole.events, whole.family_map)))


def check_catalog(spark, folder, want):
    for name in TABLES:
        got = spark.read.parquet(f"{folder}/catalog/{name}")
        assert quality.tables_equal(got, want[name].select(*got.columns)), name
    assert os.path.exists(f"{folder}/SUCCESS.json")


@pytest.fixture(scope="module")
def done(spark, series, tmp_path_factory):
    """A run that stopped after a chunk and was resumed with chunks of another size."""
    folder = str(tmp_path_factory.mktemp("run") / "out")
    first = track_series(spark, series[0], folder, 4, most_chunks=1)
    assert first.end == 4 and not first.finished and not os.path.exists(f"{folder}/catalog")
    with pytest.raises(ValueError, match="finished"):
        next(audit_run(spark, folder, (0.3,)))
    again = track_series(spark, series[0], folder, 5, resume=True)
    assert [(c.low, c.high) for c in again.commits] == [(0, 4), (4, 6)] and again.writer == 2
    return folder


def test_resumed_run_equals_the_whole(spark, series, done):
    check_catalog(spark, done, series[1])
    with pytest.raises(FileExistsError):
        track_series(spark, series[0], done)
    before = open(f"{done}/SUCCESS.json").read()
    assert track_series(spark, series[0], done, resume=True).finished and open(f"{done}/SUCCESS.json").read() == before


def test_an_older_writer_commits_nothing(spark, series, done, tmp_path):
    folder = str(tmp_path / "out")
    files = longrun.list_files(series[0].path)
    old = ledger.Ledger(spark, folder, {"a": 1}, files)
    new = ledger.Ledger(spark, folder, {"a": 1}, files, resume=True)
    with pytest.raises(RuntimeError, match="another writer"):
        old.commit(0, 2, {"t": spark.range(3)})
    new.commit(0, 2, {"t": spark.range(3)})
    with pytest.raises(ValueError, match="follow"):
        new.commit(3, 4, {"t": spark.range(3)})
    assert new.read("t").count() == 3


def test_changes_refuse(spark, series, done, tmp_path):
    run = series[0]
    with pytest.raises(ValueError, match="threshold"):
        track_series(spark, Run(run.path, run.variable, run.series, 2.0, 0, 1, OPTIONS, True), done, resume=True)
    with pytest.raises(ValueError, match="options"):
        track_series(spark, Run(run.path, run.variable, run.series, 0.0, 0, 1, TrackOptions(), True), done, resume=True)
    at = f"{run.path}/part1.npy"
    held = open(at, "rb").read()
    try:
        with open(at, "wb") as f:
            f.write(held[:-1] + bytes([held[-1] ^ 1]))
        with pytest.raises(ValueError, match="have changed: .*part1.npy"):
            track_series(spark, run, done, resume=True)
    finally:
        with open(at, "wb") as f:
            f.write(held)
    for damage, match in ((lambda d: shutil.rmtree(f"{d}/chunks/00000000-00000004"), "follow"), (lambda d: shutil.rmtree(f"{d}/chunks/00000004-00000006/edges"), "gone"), (lambda d: spark.read.parquet(f"{done}/chunks/00000004-00000006/edges").limit(1).write.mode("overwrite").parquet(f"{d}/chunks/00000004-00000006/edges"), "isn't what was committed")):
        copy = str(tmp_path / match.replace(" ", "_").replace("'", ""))
        shutil.copytree(done, copy)
        damage(copy)
        with pytest.raises(ValueError, match=match):
            track_series(spark, run, copy, resume=True)


def test_killed_after_any_step(spark, series, tmp_path, monkeypatch):
    """Every file that a run puts in place, and every table it writes aside, is once the last thing it does."""
    run, want = series
    files = longrun.list_files(run.path)
    contract = run.contract() | {"frames": [0, 6]}
    done = str(tmp_path / "whole")
    full = track_series(spark, run, done, 3)
    parts = [{n: spark.read.parquet(f"{c.path}/{n}") for n in json.loads(ledger.read_text(spark, f"{c.path}/COMMITTED.json"))["tables"]} for c in full.commits]

    class Killed(Exception):
        pass

    def start(folder, budget):
        """Commit both chunks; the run dies after so many files."""
        real, left = ledger.write_text, [budget]

        def dying(spark, path, text):
            if left[0] == 0:
                raise Killed
            left[0] -= 1
            real(spark, path, text)
            if left[0] == 0:
                raise Killed

        monkeypatch.setattr(ledger, "write_text", dying)
        try:
            held = ledger.Ledger(spark, folder, contract, files, resume=True)
            for c, part in zip(full.commits, parts):
                if held.end in (None, c.low) and c.high > (held.end or 0):
                    held.commit(c.low, c.high, part)
            longrun._end(spark, run, held)
            return True
        except Killed:
            return False
        finally:
            monkeypatch.setattr(ledger, "write_text", real)

    folder = str(tmp_path / "run")
    budgets = iter((1, 2, 3, 2, 3, 99))  # dies at the claim, contract, first proof, second proof, marker
    ends = []
    for budget in budgets:
        ends.append(start(folder, budget))
    assert ends[-1] and not all(ends)
    check_catalog(spark, folder, want)
    assert os.listdir(f"{folder}/chunks") and len(os.listdir(f"{folder}/writers")) >= 6


def test_audit_of_a_saved_run(spark, series, done):
    found = dict(audit_run(spark, done, (0.3, 0.9)))
    assert found["candidates"].count() > 0 and found["structures"].count() > 0 and found["edges_that_differ"].isEmpty()
    assert {r.tau for r in found["sweep"].select("tau").distinct().collect()} >= {0.3}


def test_hashes_of_blocks(spark, tmp_path):
    for name, data in (("a", b"x" * 10), ("b", b""), ("c", b"x" * 9 + b"y")):
        (tmp_path / name).write_bytes(data)
    names = [str(tmp_path / n) for n in "abc"]
    rows = {os.path.basename(r.path): r for r in hash_files(spark, names, 4).collect()}
    assert [rows[n].bytes for n in "abc"] == [10, 0, 10] and len({r.sha256 for r in rows.values()}) == 3
    assert {r.sha256 for r in hash_files(spark, names, 4).collect()} == {r.sha256 for r in rows.values()}


def test_contract_gives_the_run_back(series):
    told = json.loads(json.dumps(series[0].contract()))
    assert Run.of(told).contract() == told


def test_commands(spark, series, tmp_path, monkeypatch):
    from cellweave import __main__ as command

    given = [series[0].path, "--variable", "RAINNC", "--units", "mm", "--bridge-radius", "0", "--tau", "0.3", "--max-displacement", "3", "--chunk-frames", "3", "--save-labels"]
    out = str(tmp_path / "out")
    command.main(["series", *given, "--output-dir", out, "--most-chunks", "1"])
    command.main(["series", *given, "--output-dir", out, "--resume"])
    check_catalog(spark, out, series[1])
    command.main(["audit", out, "--output-dir", str(tmp_path / "audit"), "--saved", out, "--taus", "0.3"])
    assert spark.read.parquet(str(tmp_path / "audit" / "edges_that_differ")).isEmpty() and spark.read.parquet(str(tmp_path / "audit" / "candidates")).count() > 0
