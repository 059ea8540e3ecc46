"""Series of many files, against arrays: splits and halos, headers, checks; dense rasters."""

import datetime
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators.preprocess import difference_cumulative
from cellweave.sources import series
from cellweave.sources.classic import ClassicFile

START = datetime.datetime(2024, 2, 28, 20)


def put_classic(path, name, values, version=2, units="mm", times=None, dims=("time", "y", "x"), unlimited=True, fill=None, extra=None, stamps=None, attributes=None):
    """A NetCDF classic file, written by hand."""
    kinds = {"f4": 5, "f8": 6, "i2": 3, "i4": 4, "S1": 2}
    count, place = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(count, len(s)) + pad(s.encode())

    def atts(given):
        out = struct.pack(">i", 12 if given else 0) + struct.pack(count, len(given))
        for k, v in given.items():
            if isinstance(v, str):
                out += text(k) + struct.pack(">i", 2) + text(v)
            else:
                v = np.asarray(v)
                out += text(k) + struct.pack(">i", kinds[v.dtype.str[1:]]) + struct.pack(count, v.size) + pad(v.astype(v.dtype.newbyteorder(">")).tobytes())
        return out

    values = np.asarray(values)
    sizes = dict(zip(dims, values.shape))
    names = list(dims)
    own = {"units": units} | ({"_FillValue": np.array([fill], values.dtype)} if fill is not None else {}) | (attributes or {})
    variables = [(name, list(dims), own, values)]
    if times is not None:
        variables.append(("time", ["time"], {"units": times[0]}, np.asarray(times[1], "f8")))
    if stamps is not None:
        names.append("length")
        sizes["length"] = 19
        variables.append(("Times", ["time", "length"], {}, np.array([list(s) for s in stamps], "S1")))
    for k, v in (extra or {}).items():
        variables.append((k, [d for d in dims if d != "time"], {}, np.asarray(v, "f4")))
    n = sizes.get("time", 0)
    grown = lambda v: unlimited and v[1][:1] == ["time"]
    size = lambda v: (int(np.prod([sizes[d] for d in v[1][1:]], dtype=int)) if grown(v) else v[3].size) * v[3].itemsize
    padded = lambda k: k + -k % 4

    def header(begins):
        out = b"CDF" + bytes([version]) + struct.pack(count, n if unlimited else 0) + struct.pack(">i", 10) + struct.pack(count, len(names))
        for d in names:
            out += text(d) + struct.pack(count, 0 if unlimited and d == "time" else sizes[d])
        out += atts({"title": "x"}) + struct.pack(">i", 11) + struct.pack(count, len(variables))
        for v, b in zip(variables, begins):
            out += text(v[0]) + struct.pack(count, len(v[1])) + b"".join(struct.pack(count, names.index(d)) for d in v[1]) + atts(v[2])
            out += struct.pack(">i", kinds[v[3].dtype.str[1:]]) + struct.pack(count, padded(size(v))) + struct.pack(place, b)
        return out

    at = len(header([0] * len(variables)))
    begins = [0] * len(variables)
    fixed = [k for k, v in enumerate(variables) if not grown(v)]
    along = [k for k, v in enumerate(variables) if grown(v)]
    for k in fixed:
        begins[k] = at
        at += padded(size(variables[k]))
    for k in along:
        begins[k] = at
        at += padded(size(variables[k]))
    big = lambda a: np.array(a, a.dtype.newbyteorder(">")).tobytes()
    with open(path, "wb") as f:
        f.write(header(begins))
        for k in fixed:
            f.write(pad(big(variables[k][3])))
        for r in range(n if along else 0):
            for k in along:
                raw = big(variables[k][3][r])
                f.write(raw if len(along) == 1 else pad(raw))


def totals(seed=1, n=30, ny=5, nx=7):
    """Amounts that accumulate, in eighths so that differences are exact, with missing cells."""
    rng = np.random.default_rng(seed)
    out = np.cumsum(rng.integers(0, 9, (n, ny, nx)) * (rng.random((n, ny, nx)) < 0.4) / 8, axis=0)
    out[rng.random(out.shape) < 0.05] = np.nan
    return out


def increments(cube):
    """By the array: NaN where either end is missing."""
    return np.diff(cube.astype(np.float32), axis=0)


def dense(cells, shape):
    out = np.zeros(shape, np.float32)
    for r in cells.collect():
        assert r.valid == bool(np.isfinite(r.rain)) and out[r.t, r.y, r.x] == 0
        out[r.t, r.y, r.x] = r.rain
    return out


def saved(folder, cube, cuts):
    """Uneven files; a few kinds of headers."""
    bounds = [*cuts, len(cube)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        times = ("hours since 2024-02-28 20:00:00", np.arange(a, b)) if k % 2 else ("minutes since 2024-02-28 00:00", np.arange(a, b) * 60.0 + 1200)
        part = cube[a:b]
        if k % 3 == 2:
            put_classic(f"{folder}/z{9 - k}.nc", "RAINNC", part.transpose(0, 2, 1).astype("f4"), (1, 2, 5)[k % 3], times=times, dims=("time", "x", "y"))
        else:
            put_classic(f"{folder}/z{9 - k}.nc", "RAINNC", np.where(np.isnan(part), -9e9, part).astype("f8"), (1, 2, 5)[k % 3], times=times, fill=-9e9, unlimited=k % 2 == 0)


@pytest.mark.parametrize("per_task", [1, 4, 7, 100])
def test_splits_over_file_borders(spark, tmp_path, per_task):
    """Differences across files and splits are those of the whole array and of the window over cells; no shuffle."""
    cube = totals()
    saved(tmp_path, cube, [0, 1, 9, 10, 22])
    cells, frames, grid = series.read_series(spark, str(tmp_path), "RAINNC", samples_per_task=per_task)
    want = increments(cube)
    assert (grid.ny, grid.nx) == (5, 7) and np.array_equal(dense(cells, want.shape), want, equal_nan=True)
    assert "Exchange" not in cells._jdf.queryExecution().toString()
    rows = [("default", t, y, x, float(cube[t, y, x])) for t in range(30) for y in range(5) for x in range(7)]
    by_window = difference_cumulative(spark.createDataFrame(rows, "sequence_id string, t long, y int, x int, rain double"))
    other = by_window.where("not valid or rain > 0").select("sequence_id", (F.col("t") - 1).alias("t"), "y", "x", "rain", "valid")
    assert sorted(map(str, cells.collect())) == sorted(map(str, other.collect()))
    got = frames.orderBy("t").collect()
    assert [r.t for r in got] == list(range(29)) and [r.interval_end for r in got] == [START + datetime.timedelta(hours=k + 1) for k in range(29)]
    assert all(r.interval_end - r.interval_start == datetime.timedelta(hours=1) for r in got)
    assert cells.rdd.getNumPartitions() == -(-29 // per_task)


def test_window_and_crop(spark, tmp_path):
    cube = totals(2, 20, 6, 9)
    saved(tmp_path, cube, [0, 8, 13])
    cells, frames, grid = series.read_series(spark, str(tmp_path), "RAINNC", start=5, stop=17, crop=4, samples_per_task=5)
    want = increments(cube)[5:17, 1:5, 2:6]
    assert (grid.ny, grid.nx) == (4, 4) and np.array_equal(dense(cells, want.shape), want, equal_nan=True) and frames.count() == 12
    with pytest.raises(ValueError, match="window"):
        series.read_series(spark, str(tmp_path), "RAINNC", start=5, stop=20)


def test_snapshots_of_one_frame(spark, tmp_path):
    """One accumulated frame per file, with its time in the name and inside."""
    cube = totals(3, 6)
    for k, frame in enumerate(cube):
        at = START + datetime.timedelta(hours=k)
        os.makedirs(tmp_path / str(k % 2), exist_ok=True)
        put_classic(tmp_path / str(k % 2) / f"out_d01_{at:%Y-%m-%d_%H:%M:%S}.nc", "RAINNC", frame[None].astype("f4"), stamps=[f"{at:%Y-%m-%d_%H:%M:%S}"], extra={"XLAT": np.ones((5, 7)), "XLONG": np.full((5, 7), np.nan)})
    read = lambda: series.read_series(spark, str(tmp_path), "RAINNC", snapshots=True, samples_per_task=2)[0]
    want = increments(cube)
    assert np.array_equal(dense(read(), want.shape), want, equal_nan=True)
    at = START + datetime.timedelta(hours=3)
    place = tmp_path / "1" / f"out_d01_{at:%Y-%m-%d_%H:%M:%S}.nc"
    put_classic(place, "RAINNC", cube[3][None].astype("f4"), stamps=[f"{at:%Y-%m-%d_%H:%M:%S}"], extra={"XLAT": np.zeros((5, 7)), "XLONG": np.ones((5, 7))})
    with pytest.raises(Exception, match="Coordinates change"):
        read().count()
    put_classic(place, "RAINNC", cube[3][None].astype("f4"), stamps=[f"{START:%Y-%m-%d_%H:%M:%S}"])
    with pytest.raises(Exception, match="same time"):
        read().count()
    os.rename(place, str(place).replace("23:00:00", "23_30_00"))
    put_classic(str(place).replace("23:00:00", "23_30_00"), "RAINNC", cube[3][None].astype("f4"))
    with pytest.raises(Exception, match="irregular"):
        read().count()


@pytest.mark.parametrize(
    "spoil, message",
    [(lambda c: c.__setitem__((12, 2, 3), 0.0) or c.__setitem__((11, 2, 3), 9.0), "decreased"), (lambda c: c.__setitem__((7, 0, 0), -1.0), "negative"), (lambda c: c.__setitem__(9, np.nan), "entire frame")],
)
def test_bad_values_are_errors(spark, tmp_path, spoil, message):
    cube = totals(4)
    spoil(cube)
    saved(tmp_path, cube, [0, 8, 12])  # the fall is at a file's border
    with pytest.raises(Exception, match=message):
        series.read_series(spark, str(tmp_path), "RAINNC", samples_per_task=4)[0].count()


def test_kinds_and_units(spark, tmp_path):
    values = np.abs(np.nan_to_num(totals(5, 6)))
    np.save(tmp_path / "a.npy", values[:4])
    np.save(tmp_path / "b.npy", values[4:])
    read = lambda **o: dense(series.read_series(spark, str(tmp_path), "rain", **o)[0], values.shape)
    assert np.array_equal(read(unit="mm", rain_kind="interval", hours=2), (values / 2).astype(np.float32))
    assert np.allclose(read(unit="mm s-1".replace(" ", ""), rain_kind="rate"), values * 3600)
    _, frames, _ = series.read_series(spark, str(tmp_path), "rain", unit="mm/h", origin="2024-01-01 00:00:00")
    assert frames.agg(F.max("interval_end")).first()[0] == datetime.datetime(2024, 1, 1, 5)
    for bad, message in (({"unit": "mm"}, "ambiguous"), ({"unit": "inch", "rain_kind": "interval"}, "unit mm"), ({"unit": "mm", "rain_kind": "rate"}, "mm/h"), ({"unit": "mm", "rain_kind": "odd"}, "rain_kind")):
        with pytest.raises(ValueError, match=message):
            series.read_series(spark, str(tmp_path), "rain", **bad)
    with pytest.raises(ValueError, match="snapshot reader"):
        series.read_series(spark, str(tmp_path), "RAINNC", unit="mm", rain_kind="interval")
    np.save(tmp_path / "c.npy", np.zeros((2, 3, 3)))
    with pytest.raises(ValueError, match="different grids"):
        read(unit="mm/h")
    with pytest.raises(FileNotFoundError):
        series.read_series(spark, str(tmp_path / "none"), "rain", unit="mm/h")


def test_classic_headers(tmp_path):
    packed = np.arange(24, dtype="i2").reshape(2, 3, 4)
    put_classic(tmp_path / "p.nc", "r", packed, 1, fill=-1, attributes={"scale_factor": np.array([0.5]), "add_offset": np.array([1.0])})
    file = ClassicFile(str(tmp_path / "p.nc"), "r")
    assert file.shape == (2, 3, 4) and file.times == [None, None] and np.array_equal(file.frame(1), packed[1] * 0.5 + 1)
    with pytest.raises(ValueError, match="no variable"):
        ClassicFile(str(tmp_path / "p.nc"), "q")
    (tmp_path / "bad.nc").write_bytes(b"\x89HDF rest")
    with pytest.raises(ValueError, match="classic"):
        ClassicFile(str(tmp_path / "bad.nc"), "r")
    whole = (tmp_path / "p.nc").read_bytes()
    (tmp_path / "cut.nc").write_bytes(whole[:-20])
    with pytest.raises(ValueError, match="cut off"):
        ClassicFile(str(tmp_path / "cut.nc"), "r").frame(1)


# ---------------------------------------------------------------- rasters


def test_raster_round_trip(spark, tmp_path):
    rng = np.random.default_rng(7)
    cube = rng.integers(1, 9, (9, 4, 6)) * (rng.random((9, 4, 6)) < 0.3)
    cube[4] = 0
    rows = [(int(t) + 3, int(y), int(x), int(cube[t, y, x])) for t, y, x in np.argwhere(cube)]
    from cellweave.grid import Grid

    df = spark.createDataFrame(rows, "t long, y int, x int, label int").repartition(5)
    series.write_raster(df, "label", Grid(4, 6), 9, str(tmp_path / "r"), "int32", cuts=(3, 4, 9), first=3)
    parts = [np.load(tmp_path / "r" / f"frames-{k:08d}.npy") for k in (3, 4, 9)]
    assert [p.shape[0] for p in parts] == [1, 5, 3] and parts[0].dtype == np.int32 and np.array_equal(np.concatenate(parts), cube)
    assert sorted(tuple(r) for r in series.read_raster(spark, str(tmp_path / "r")).collect()) == sorted(rows)
    with pytest.raises(Exception, match="FileExists|exist"):
        series.write_raster(df, "label", Grid(4, 6), 9, str(tmp_path / "r"), "int32", first=3)


def test_a_failed_raster_leaves_nothing(spark, tmp_path):
    from cellweave.grid import Grid

    df = spark.createDataFrame([(0, 0, 0, 1), (1, 9, 0, 1)], "t long, y int, x int, label int")
    with pytest.raises(Exception, match="outside of the raster"):
        series.write_raster(df, "label", Grid(4, 6), 2, str(tmp_path / "r"), "int32")
    assert not (tmp_path / "r").exists()
    with pytest.raises(ValueError, match="cuts"):
        series.write_raster(df, "label", Grid(4, 6), 2, str(tmp_path / "r"), "int32", cuts=(0, 5))


def test_frames_missing_as_a_whole_are_kept_if_asked_for(spark, tmp_path):
    cube = totals(4)
    cube[9] = np.nan
    saved(tmp_path, cube, [0, 8, 12])
    cells = series.read_series(spark, str(tmp_path), "RAINNC", samples_per_task=4, missing_frames="keep")[0]
    want = increments(cube)
    assert np.isnan(want[8:10]).all() and np.array_equal(dense(cells, want.shape), want, equal_nan=True)
    with pytest.raises(ValueError, match="missing_frames"):
        series.read_series(spark, str(tmp_path), "RAINNC", missing_frames="zero")
