"""Array files as cells: .npy cubes by a Python data source, NetCDF where a reader is installed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CELLS = "sequence_id string, t long, y int, x int, rain float, valid boolean"


def _batch(block: np.ndarray, sequence: str, first: int) -> pa.RecordBatch:
    """Cells of frames that are not exactly 0: wet, or missing."""
    block = np.asarray(block, np.float32)
    t, y, x = np.nonzero((block != 0) | ~np.isfinite(block))
    rain = block[t, y, x]
    return pa.RecordBatch.from_arrays([pa.array([sequence] * len(t), pa.string()), pa.array(t + first, pa.int64()), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(rain), pa.array(np.isfinite(rain))], ["sequence_id", "t", "y", "x", "rain", "valid"])


def check_cube(shape: tuple[int, ...], start: int, stop: int | None) -> tuple[int, int]:
    if len(shape) != 3:
        raise ValueError("an array must have shape (time, y, x)")
    stop = shape[0] if stop is None else stop
    if not 0 <= start < stop <= shape[0]:
        raise ValueError("time window is outside of the array")
    return start, stop


class _Frames(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class _CubeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.sequence = options.get("sequence_id", "default")
        self.step = int(options.get("frames_per_task", "24"))
        cube = np.load(self.path, mmap_mode="r")
        self.start, self.stop = check_cube(cube.shape, int(options.get("start", "0")), int(options["stop"]) if "stop" in options else None)

    def partitions(self):
        return [_Frames(k, min(k + self.step, self.stop)) for k in range(self.start, self.stop, self.step)]

    def read(self, partition):
        cube = np.load(self.path, mmap_mode="r")  # pages of its own frames only
        for t in range(partition.start, partition.stop):
            yield _batch(cube[t : t + 1], self.sequence, t - self.start)


class CubeSource(DataSource):
    """``spark.read.format("cellweave_npy").option("start", ..).load(path)``; the file must be seen by all executors."""

    @classmethod
    def name(cls) -> str:
        return "cellweave_npy"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema):
        return _CubeReader(dict(self.options))


def read_npy(spark: SparkSession, path: str, start: int = 0, stop: int | None = None, sequence_id: str = "default", frames_per_task: int = 24) -> DataFrame:
    """Cells of a .npy cube, a task per range of frames."""
    spark.dataSource.register(CubeSource)
    reader = spark.read.format("cellweave_npy").option("start", start).option("sequence_id", sequence_id).option("frames_per_task", frames_per_task)
    return (reader if stop is None else reader.option("stop", stop)).load(path)


def frame_table(spark: SparkSession, n: int, sequence_id: str = "default", start: int = 0) -> DataFrame:
    return spark.range(start, start + n).selectExpr(f"'{sequence_id}' AS sequence_id", "id AS t")


def read_netcdf(spark: SparkSession, path: str, variable: str, start: int, stop: int, sequence_id: str = "default", dims: tuple[str, str, str] = ("time", "y", "x")) -> DataFrame:
    """Cells of a NetCDF variable; needs netCDF4 on the executors, else ImportError."""
    import netCDF4  # noqa: F401

    def run(batches):
        import netCDF4 as nc

        for batch in batches:
            for t in batch.column(0).to_pylist():
                with nc.Dataset(path) as ds:
                    v = ds.variables[variable]
                    index = tuple(t if d == dims[0] else slice(None) for d in v.dimensions)
                    frame = np.ma.filled(np.ma.asarray(v[index]).astype(np.float32), np.nan)
                    rest = [d for d in v.dimensions if d != dims[0]]
                    yield _batch(np.transpose(frame, [rest.index(d) for d in dims[1:]])[None], sequence_id, t - start)

    return spark.range(start, stop, 1, max(1, stop - start)).mapInArrow(run, CELLS)


def describe_npy(path: str) -> dict:
    """What inspecting shows: no values are read."""
    cube = np.load(path, mmap_mode="r")
    return {"path": path, "shape": list(cube.shape), "dtype": str(cube.dtype)}
