import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions.scalar import half_even, internal_stamp, stamp_in_name
from cellweave.grid import Grid
from cellweave.operators import preprocess as P
from cellweave.sources.arrays import describe_npy, read_npy
from cellweave.sources.multitime import plan_samples, read_precipitation
from cellweave.sources.snapshots import check_internal_times, increments, list_snapshots, manifest
from tests.helpers import CELLS, tables


def series(spark, values):
    return spark.createDataFrame([("s", t, 0, 0, v, v is not None and bool(np.isfinite(v))) for t, v in enumerate(values)], CELLS)


def test_differences(spark):
    got = {r.t: (r.rain, r.valid, r.clipped) for r in P.difference_cumulative(series(spark, [0.0, 2.0, 2.0, float("nan"), 5.0, 5.0005, 5.0001])).collect()}
    assert got[1] == (2.0, True, False) and got[2] == (0.0, True, False)
    assert not got[3][1] and not got[4][1] and got[6] == (0.0, True, True)
    with pytest.raises(ValueError, match="decreased"):
        P.difference_cumulative(series(spark, [0.0, 3.0, 1.0]))
    with pytest.raises(ValueError, match="irregular"):
        P.difference_cumulative(series(spark, [0.0, 3.0, 4.0]).where("t <> 1"))
    with pytest.raises(ValueError, match="negative"):
        P.difference_cumulative(series(spark, [-1.0, 3.0]))


def times(spark, hours):
    rows = [("s", k, h * 3600) for k, h in enumerate(hours)]
    return spark.createDataFrame(rows, "sequence_id string, t long, s long").select("sequence_id", "t", F.expr("timestamp_ntz'2005-07-01 00:00:00' + make_dt_interval(0, 0, 0, s)").alias("interval_start"))


def test_cadence(spark):
    P.check_cadence(times(spark, [0, 1, 2, 3]), 1.0)
    for hours, step, text in (([0, 1, 3], None, "irregular"), ([0, 1, 2], 2.0, "disagrees"), ([0, 1, 1], None, "increasing")):
        with pytest.raises(ValueError, match=text):
            P.check_cadence(times(spark, hours), step)


def test_units_and_kinds(spark):
    P.check_interval("interval", " M M")
    P.check_interval("rate", "mm / h")
    for kind, unit in (("interval", "m"), ("rate", "mm"), ("cumulative", "mm")):
        with pytest.raises(ValueError):
            P.check_interval(kind, unit)
    with pytest.raises(ValueError, match="Cumulative"):
        P.refuse_cumulative("RAINNC")
    assert P.classify_rain("RAINNC", "mm") == "cumulative" and P.classify_rain("pr", "mm/h") == "rate"
    assert P.classify_rain("pr", "mm", {"long_name": "hourly amount"}) == "interval"
    for name, unit in (("pr", "mm"), ("RAINNC", "mm/h")):
        with pytest.raises(ValueError, match="ambiguous"):
            P.classify_rain(name, unit)
    assert P.to_rate(series(spark, [4.0]), 2.0).first().rain == 2.0


def test_windows(spark):
    cube = np.arange(1, 61, dtype=float).reshape(2, 5, 6)
    cells, _, grid = tables(spark, cube)
    small, shape = P.crop(cells, grid, 3)
    assert (shape.ny, shape.nx) == (3, 3) and small.where("t = 0 and y = 0 and x = 0").first().rain == cube[0, 1, 1]
    assert P.crop(cells, grid, 0)[1] == grid and P.crop(cells, grid, 99)[1] == grid
    assert P.time_window(cells, 1, 1, 2).count() == 30
    with pytest.raises(ValueError):
        P.time_window(cells, 1, 2, 2)


def test_frames_and_grid(spark):
    cells, _, grid = tables(spark, np.full((1, 2, 2), np.nan))
    with pytest.raises(ValueError, match="missing"):
        P.check_frames_present(cells, grid)
    places = [("s", t, 0, x, 1.0, float("nan") if x else 2.0 + (t == shifted)) for shifted in (9, 1) for t in range(2) for x in range(2)]
    schema = "sequence_id string, t long, y int, x int, lat double, lon double"
    P.check_same_grid(spark.createDataFrame(places[:4], schema))
    with pytest.raises(ValueError, match="Coordinates change"):
        P.check_same_grid(spark.createDataFrame(places[4:], schema))


def test_masks(spark):
    cells = series(spark, [0.7, float("nan"), float("inf"), 0.0, 3.0])
    assert [r.t for r in P.wet_cells(cells, 0.7).orderBy("t").collect()] == [0, 4]  # single precision against its own type
    assert [r.t for r in P.missing_cells(cells).orderBy("t").collect()] == [1, 2]
    assert [r.rain for r in P.fill_missing(cells).orderBy("t").collect()][1:3] == [0.0, 0.0]
    assert [r.rain for r in P.below_to_zero(cells, 1.0).orderBy("t").collect()] == [0.0, 0.0, 0.0, 0.0, 3.0]


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (-1.5,)], "v double")
    assert [r[0] for r in df.select(half_even("v")).collect()] == [round(v) for v in (0.5, 1.5, 2.5, -0.5, -1.5)]


def test_index_frames(spark):
    df = spark.createDataFrame([("s", 0), ("s", 5)], "sequence_id string, sample_index long")
    assert [str(r.interval_end) for r in P.index_frames(df, origin="2005-07-31 23:00:00").orderBy("t").collect()] == ["2005-08-01 00:00:00", "2005-08-01 05:00:00"]
    assert P.index_frames(df).first().interval_start is None


def snapshots(spark, values, names=None):
    names = names or [f"d/cstm_d01_2005-07-01_{h:02d}:00:00.nc" for h in range(len(values))]
    return spark.createDataFrame([(n, 0, 0, float(v)) for n, v in zip(names, values)], "path string, y int, x int, rain float"), manifest(spark.createDataFrame([(n,) for n in names], "path string"))


def test_snapshots(spark, tmp_path):
    cells, files = snapshots(spark, [0, 2, 4, 6])
    assert [(r.t, r.rain) for r in increments(cells, files).orderBy("t").collect()] == [(0, 2.0), (1, 2.0), (2, 2.0)]
    with pytest.raises(ValueError, match="decreased"):
        increments(*snapshots(spark, [0, 5, 4]))
    with pytest.raises(ValueError, match="irregular"):
        increments(*snapshots(spark, [0, 1], ["a_2005-07-01_00:00:00.nc", "a_2005-07-01_02:00:00.nc"]))
    with pytest.raises(ValueError, match="same time"):
        snapshots(spark, [0, 1], ["a_2005-07-01_00:00:00.nc", "b_2005-07-01_00:00:00.nc"])
    with pytest.raises(ValueError, match="two snapshots"):
        snapshots(spark, [0], ["a_2005-07-01_00:00:00.nc"])
    one = lambda inside: spark.createDataFrame([("a_2005-07-01_00:00:00.nc", inside)], "path string, times string")
    check_internal_times(one("2005-07-01_00:00:00"))
    with pytest.raises(ValueError, match="Filename/Times"):
        check_internal_times(one("2005-07-01_01:00:00"))
    df = one("x").select(stamp_in_name("path").cast("string"), internal_stamp("times"))
    assert tuple(df.first()) == ("2005-07-01 00:00:00", None)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a_2005-07-01_00_00_00.nc").write_bytes(b"x")
    assert list_snapshots(spark, str(tmp_path / "in")).count() == 1


def test_npy(spark, tmp_path):
    cube = np.zeros((5, 3, 4), np.float32)
    cube[2, 1, 2], cube[3, 0, 0] = 4, np.nan
    np.save(tmp_path / "c.npy", cube)
    got = read_npy(spark, str(tmp_path / "c.npy"), 1, 4, "q", frames_per_task=2).orderBy("t").collect()
    assert [(r.sequence_id, r.t, r.y, r.x, r.valid) for r in got] == [("q", 1, 1, 2, True), ("q", 2, 0, 0, False)]
    assert describe_npy(str(tmp_path / "c.npy"))["shape"] == [5, 3, 4]
    with pytest.raises(Exception, match="window"):
        read_npy(spark, str(tmp_path / "c.npy"), 4, 9).count()
    with pytest.raises(ValueError):
        Grid(0, 3)


def _samples(spark, rows):
    return spark.createDataFrame(rows, "path string, sample long, valid_time string").withColumn("valid_time", F.to_timestamp_ntz("valid_time"))


def test_plan_of_many_files(spark):
    plan = lambda rows, **k: [(r.path, r.sample, str(r.valid_time)[11:16] if r.valid_time else None) for r in plan_samples(_samples(spark, rows), **k).orderBy("t").collect()]
    hours = [(p, s, f"2024-01-01 {h:02}:00:00") for p, s, h in (("b", 0, 0), ("b", 1, 1), ("a", 0, 2), ("a", 1, 3))]
    assert [r[:2] for r in plan(hours)] == [("b", 0), ("b", 1), ("a", 0), ("a", 1)]  # by time, not by name
    plain = [("a", 5, None), ("a", 6, None), ("b", 0, None), ("b", 1, None)]
    assert plan(plain) == [(p, s, None) for p, s, _ in plain]
    assert [r[2] for r in plan(plain, origin="2024-01-01 00:00:00")] == ["00:00", "01:00", "02:00", "03:00"]
    for bad, message in ((hours[:1] + hours[2:], "irregular"), ([*hours, ("c", 0, hours[0][2])], "same time"), ([*plain, hours[0]], "some have none"), ([("a", 0, None), ("a", 2, None)], "consecutive")):
        with pytest.raises(ValueError, match=message):
            plan(bad)


def test_kinds_of_precipitation(spark):
    values = spark.createDataFrame([(p, s, 0, x, float(v)) for p, s, row in (("a", 0, [1, 2]), ("a", 1, [1, 5]), ("b", 0, [4, 5])) for x, v in enumerate(row)], "path string, sample long, y int, x int, rain double")
    samples = _samples(spark, [("a", 0, None), ("a", 1, None), ("b", 0, None)])
    read = lambda *a, **k: {(r.t, r.x): r.rain for r in read_precipitation(values, samples, *a, **k)[0].collect()}
    assert read("RAINNC", "mm") == {(0, 0): 0, (0, 1): 3, (1, 0): 3, (1, 1): 0}  # the second step is across files
    assert read("rain", "mm", {"cell_methods": "time: sum"}, hours=0.5)[0, 1] == 4
    assert read("pr", "kg m-2 s-1")[2, 0] == 4 * 3600 and read("pr", "mm / h")[2, 0] == 4
    assert read("RAINNC", "mm", {"rain_kind": "interval"})[2, 1] == 5 and read("RAINNC", "mm", rain_kind="interval")[0, 0] == 1
    for bad in (("rain", "mm"), ("RAINNC", "K"), ("pr", "m", None, "rate")):
        with pytest.raises(ValueError):
            read(*bad)
    cells, frames = read_precipitation(values, samples, "RAINNC", "mm", origin="2024-01-01 00:00:00")
    assert [(r.t, r.interval_start.hour, r.interval_end.hour) for r in frames.orderBy("t").collect()] == [(0, 0, 1), (1, 1, 2)]
