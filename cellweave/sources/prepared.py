"""A short cube of hourly rates, prepared once for array users: one dense file and what it was made from."""

from __future__ import annotations

import datetime
import json
import os
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.preprocess import require
from .series import local, read_series, stamp_of, write_raster

#: Most intervals of a cube, and the names that count: fixed values of the interface.
MOST_HOURS = 72
SNAPSHOT = re.compile(r"cstm_d01_\d{4}-\d{2}-\d{2}_\d{2}[:_]\d{2}[:_]\d{2}\.rain\Z")
CUBE, TOLD = "rain_mm_h.npy", "input_metadata.json"


def snapshots_between(folder: str, start: datetime.datetime, hours: int) -> list[str]:
    """The ``hours`` + 1 snapshots from ``start`` on, by the times in their names. Other names and folders below don't count."""
    at: dict[datetime.datetime, str] = {}
    for name in sorted(os.listdir(local(folder))):
        if SNAPSHOT.match(name):
            time = stamp_of(name)
            if time in at:
                raise ValueError(f"two snapshots have the same time: {at[time]}, {name}")
            at[time] = name
    wanted = [start + datetime.timedelta(hours=k) for k in range(hours + 1)]
    if lost := [t for t in wanted if t not in at]:
        raise FileNotFoundError(f"no snapshot of {lost[0]} (and {len(lost) - 1} others) in {folder}")
    return [os.path.join(local(folder), at[t]) for t in wanted]


def prepare_cube(spark: SparkSession, folder: str, start: str, hours: int, output_dir: str, variable: str = "RAINNC", unit: str = "") -> dict:
    """``rain_mm_h.npy`` (time, y, x) in single precision, and ``input_metadata.json``, of 1 to 72 hourly intervals from ``start`` on.

    Accumulated amounts come from snapshots that lie in ``folder`` itself, one hour apart; that of ``start`` is the one before the first interval.
    Missing snapshots, values that aren't finite, negative amounts, accumulations that fall, grids that change and times inside that differ
    from the name are errors, and then there is no cube. Each task differences its own frames and puts them to their places in the file. The
    metadata come last: without them the cube isn't whole. An output that is there already is an error. Both folders must be seen by all executors.
    """
    if not 1 <= hours <= MOST_HOURS:
        raise ValueError(f"hours must be 1 to {MOST_HOURS}")
    begin = datetime.datetime.fromisoformat(start)
    paths = snapshots_between(folder, begin, hours)
    out = local(output_dir)
    if os.path.exists(os.path.join(out, CUBE)) or os.path.exists(os.path.join(out, TOLD)):
        raise FileExistsError(output_dir)
    given = {"unit": unit} if unit else {}
    cells, _, grid = read_series(spark, ",".join(paths), variable, rain_kind="cumulative", snapshots=True, samples_per_task=6, **given)
    require(cells, ~F.col("valid"), "snapshots hold values that aren't finite")
    aside = os.path.join(out, "_raster")
    write_raster(cells, "rain", grid, hours, aside, "float32", cuts=(0,))
    os.replace(os.path.join(aside, "frames-00000000.npy"), os.path.join(out, CUBE))
    os.remove(os.path.join(aside, "_manifest.json"))
    os.rmdir(aside)
    end = begin + datetime.timedelta(hours=hours)
    told = {"start": begin.isoformat(), "end": end.isoformat(), "hours": hours, "unit": "mm/h", "variable": variable, "source_files": [os.path.basename(p) for p in paths], "grid": {"ny": grid.ny, "nx": grid.nx}}
    name = os.path.join(out, TOLD)
    with open(f"{name}.new", "w") as f:
        json.dump(told, f, sort_keys=True)
    os.replace(f"{name}.new", name)
    return told
