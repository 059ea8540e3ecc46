import numpy as np
import pytest

from cellweave.grid import TrackOptions, disk
from cellweave.operators.identify import identify
from cellweave.operators.lineage import frame_rows, of_kind, run_lineage
from cellweave.streaming.lineage import run_to_end
from tests.helpers import tables


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    cube = np.where(rng.random((8, 14, 14)) < 0.15, 2.0, 0)
    cells, frames, grid = tables(spark, cube)
    rows = frame_rows(frames, identify(cells, grid, shape=disk(1)), cells)
    options = TrackOptions(max_displacement=3)
    for k in range(4):
        rows.where(f"t between {2 * k} and {2 * k + 1}").write.parquet(str(tmp_path / "in" / f"part={k}"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in" / "part=*"))
        run_to_end(stream, options, str(tmp_path / "out"), str(tmp_path / "check"), grid)
    got, want = spark.read.parquet(str(tmp_path / "out")), run_lineage(rows, options, grid)
    for kind in ("node", "edge", "event", "candidate"):
        a, b = of_kind(got, kind), of_kind(want, kind)
        drop = ["family_id"] if kind == "node" else []
        assert plain(a.drop(*drop)) == plain(b.drop(*drop))
    last = got.where("kind = 'state'").orderBy("n", ascending=False).first().row
    assert last == want.where("kind = 'state'").first().row


def test_a_late_frame_is_an_error(spark, tmp_path):
    cells, frames, grid = tables(spark, np.ones((3, 4, 4)))
    rows = frame_rows(frames, identify(cells, grid), cells)
    rows.where("t = 2").write.parquet(str(tmp_path / "in" / "part=2"))
    rows.where("t = 1").write.parquet(str(tmp_path / "in" / "part=9"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    with pytest.raises(Exception, match="increasing|contiguous"):
        run_to_end(stream, TrackOptions(), str(tmp_path / "out3"), str(tmp_path / "check3"), grid)
