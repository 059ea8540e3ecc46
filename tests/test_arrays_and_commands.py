import numpy as np
import pytest

from cellweave import arrays
from cellweave.__main__ import main
from tests.helpers import naive_identify
from tests.test_lineage import GAP, MOVE, SPLIT


def test_identify_arrays(spark):
    rng = np.random.default_rng(31)
    cube = np.where(rng.random((3, 10, 11)) < 0.2, 2.0, 0)
    cube[1, 2, 3] = np.nan
    valid = rng.random(cube.shape) < 0.9
    got = arrays.identify(cube, np.ones((3, 3)), workers=2, min_size=2, threshold=1.0, valid_mask=valid)
    ring = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    for t in range(3):
        assert (got[t] == naive_identify(np.where(valid[t], cube[t], np.nan).astype(np.float32), ring, 1.0, 2)).all()
    assert (arrays.identify_frame(cube[0], min_size=2) == arrays.identify(cube[:1], min_size=2)[0]).all()
    for bad in ({"data": cube[0]}, {"data": cube, "workers": 0}, {"data": cube, "valid_mask": valid[:1]}, {"data": cube, "min_size": 0}, {"data": cube, "threshold": -1}):
        with pytest.raises(ValueError):
            arrays.identify(**bad)


@pytest.mark.parametrize("cube", [MOVE, SPLIT, GAP])
def test_tracker_equals_batch(spark, cube, tmp_path):
    labels = arrays.identify(cube, np.ones((1, 1)))
    raster, graph, state = arrays.track_with_graph(labels, cube, tau=0.2, km=4, gap_tau=0.2, return_state=True)
    tracker = arrays.Tracker(tau=0.2, max_displacement=4, gap_tau=0.2)
    frames, edges = [], []
    for t in range(len(cube)):
        r, g = tracker.update(t, labels[t], cube[t])
        frames.append(r)
        edges += g.edges
    assert (np.stack(frames) == raster).all() and (arrays.track(labels, cube, 0.2, None, 4, gap_tau=0.2) == raster).all()
    key = lambda e: (e["time"], e["parent_node_id"], e["child_node_id"])
    assert sorted(edges, key=key) == graph.edges and tracker.state.data == state.data
    arrays.save_tracking_state(state, str(tmp_path / "s.json"))
    half = len(cube) // 2
    _, _, first = arrays.track_with_graph(labels[:half], cube[:half], tau=0.2, km=4, gap_tau=0.2, return_state=True)
    second = arrays.track_with_graph(labels[half:], cube[half:], tau=0.2, km=4, gap_tau=0.2, state=first)
    assert (second[0] == raster[half:]).all() and arrays.load_tracking_state(str(tmp_path / "s.json")).data == state.data
    with pytest.raises(ValueError, match="parameters"):
        arrays.track_with_graph(labels, cube, tau=0.3, state=first)
    with pytest.raises(ValueError, match="contiguous"):
        arrays.Tracker(tau=0.2, max_displacement=4, gap_tau=0.2, state=first).update(99, labels[0], cube[0])
    with pytest.raises(ValueError, match="grid"):
        arrays.Tracker(tau=0.2, max_displacement=4, gap_tau=0.2, state=first).update(half, labels[0][:5], cube[0][:5])


def test_commands(spark, tmp_path, capsys):
    cube = np.zeros((5, 16, 16), np.float32)
    for t in range(5):
        cube[t, 4:7, 3 + t : 6 + t] = 4
    np.save(tmp_path / "c.npy", cube)
    path, out = str(tmp_path / "c.npy"), lambda n: str(tmp_path / n)
    common = ["--bridge-radius", "0", "--max-displacement", "4"]
    main(["inspect", path])
    assert '"shape": [5, 16, 16]' in capsys.readouterr().out
    main(["run", path, "--output-dir", out("a"), "--stop", "2", *common])
    main(["run", path, "--output-dir", out("b"), "--start", "2", "--state-input", out("a"), *common])
    main(["catalog", out("a"), out("b"), "--output-dir", out("both")])
    main(["stream", path, "--output-dir", out("s"), "--chunk-frames", "2", *common])
    key = ["time", "node_id", "branch_id", "family_id", "area_cells"]
    rows = lambda p: sorted(tuple(r) for r in spark.read.parquet(p).select(*key).collect())
    assert rows(out("both/objects")) == rows(out("s/catalog/objects")) and len(rows(out("both/objects"))) == 5
    assert spark.read.parquet(out("s/report/summary")).first().branches == 1
    for command in ("audit", "recheck", "diagnose"):
        main([command, path, "--output-dir", out(command), "--chunk-frames", "2", "--taus", "0.3", "0.9", *common])
    assert spark.read.parquet(out("recheck/nodes")).count() == spark.read.parquet(out("recheck/edges")).count() == 0
    assert spark.read.parquet(out("diagnose/pair_decisions")).first().reason == "accepted_continue"
    main(["run", path, "--output-dir", out("w"), "--grid-km", "4", *common])
    main(["recheck", path, "--output-dir", out("saved"), "--saved", out("w"), *common])
    main(["diagnose", path, "--output-dir", out("why"), "--saved", out("w"), *common])
    assert spark.read.parquet(out("saved/saved_edge_diff")).count() == 0
    assert spark.read.parquet(out("why/pair_decisions")).first().reason == "accepted_continue"
    for wrong in (["--variable", "RAINNC"], ["--units", "m"]):
        with pytest.raises(ValueError):
            main(["run", path, "--output-dir", out("x"), *wrong, *common])
