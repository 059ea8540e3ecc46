import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.grid import TrackOptions, disk
from cellweave.operators import candidates, matching, objects, quality
from cellweave.operators.identify import identify
from cellweave.operators.lineage import branch_cells, frame_rows, graph_of, run_lineage, track
from cellweave.sources.tables import chunk_of, finalize_catalog, read_manifest, read_part, write_part
from tests.helpers import tables


@pytest.fixture(scope="module")
def busy(spark):
    rng = np.random.default_rng(11)
    cube = np.where(rng.random((6, 16, 16)) < 0.2, rng.integers(1, 9, (6, 16, 16)), 0).astype(float)
    cells, frames, grid = tables(spark, cube)
    labels = identify(cells, grid, shape=disk(0)).checkpoint()
    options = TrackOptions(tau=0.3, max_displacement=3)
    return cube, cells, frames, grid, labels, options, track(cells, frames, labels, grid, options)


def test_checks_pass_and_find(busy):
    *_, graph = busy
    checks = {r["check"]: r.failures for r in quality.structure_checks(graph.nodes, graph.edges, graph.events, graph.family_map).collect()}
    assert len(checks) == 9 and not any(checks.values()) and graph.events.count() > 0
    broken = graph.edges.withColumn("child_node_id", F.lit(10_000).cast("long"))
    found = {r["check"]: r.failures for r in quality.structure_checks(graph.nodes.unionByName(graph.nodes), broken, graph.events, graph.family_map).collect()}
    assert found["edges_have_nodes"] and found["unique_nodes"] and found["events_have_edges"]


def test_families_are_components(busy):
    *_, graph = busy
    named = graph.nodes.select("sequence_id", "node_id", "branch_id")
    e = graph.edges.where("event in ('split', 'merge', 'complex')")
    links = e.join(named.select("node_id", F.col("branch_id").alias("a")), e.parent_node_id == F.col("node_id")).drop("node_id").join(named.select("node_id", F.col("branch_id").alias("b")), e.child_node_id == F.col("node_id")).select(e.sequence_id, "a", "b")
    got = matching.families(named.select("sequence_id", "branch_id"), links)
    assert quality.tables_equal(got.select("branch_id", "family_id"), graph.family_map.select("branch_id", "family_id"))


def test_replay_in_chunks(busy):
    cube, cells, frames, grid, labels, options, graph = busy
    rows = frame_rows(frames, labels, cells)
    whole = run_lineage(rows, options, grid)
    again = quality.replay(rows, options, 2, grid)
    drop = lambda df: df.where("kind not in ('node')").select("sequence_id", "kind", "n", "row")
    assert quality.tables_equal(drop(whole), drop(again))
    assert quality.tables_equal(graph_of(whole).nodes, graph_of(again).nodes)
    both = quality.named_edges(graph.edges, graph.nodes)
    assert quality.edge_diff(both, both).isEmpty()
    diff = quality.edge_diff(both, both.where("event <> 'continue'"))
    assert {r.status for r in diff.collect()} == {"removed"}


def test_catalog_of_parts(spark, busy, tmp_path):
    cube, cells, frames, grid, labels, options, graph = busy
    states, parts = None, []
    for k in range(3):
        part = lambda df: df.where(F.col("t").between(2 * k, 2 * k + 1))  # noqa: B023, E731
        g = track(part(cells), part(frames), part(labels), grid, options, states)
        states = g.states
        parts.append(str(tmp_path / f"part{k}"))
        write_part(spark, parts[-1], g, {"chunk": k})
    with pytest.raises(FileExistsError):
        write_part(spark, parts[-1], g, {})
    finalize_catalog(spark, parts, str(tmp_path / "catalog"))
    got = spark.read.parquet(str(tmp_path / "catalog" / "objects"))
    key = ["time", "node_id", "branch_id", "family_id", "area_cells"]
    assert quality.tables_equal(got.select(*key), graph.nodes.select(*key))
    assert read_manifest(spark, str(tmp_path / "catalog"))["rows"]["objects"] == graph.nodes.count()
    with pytest.raises(FileNotFoundError):
        read_part(spark, str(tmp_path / "none"), "objects")
    assert chunk_of(frames, 2).select("chunk").distinct().count() == 3


def test_partition_metrics(spark):
    def table(rows):
        return spark.createDataFrame([("s", 0, y, x, v) for y, r in enumerate(rows) for x, v in enumerate(r) if v], "sequence_id string, t long, y int, x int, label int")

    a = table([[0, 1, 1], [2, 2, 0]])
    same = quality.partition_metrics(a, table([[0, 9, 9], [4, 4, 0]])).first()
    assert (same.ari_common_wet, same.a_objects, same.b_objects, same.wet_mask_iou, same.common_wet_pixels) == (1.0, 2, 2, 1.0, 4)
    assert quality.partition_metrics(a, table([[0, 9, 8], [4, 4, 0]])).first().ari_common_wet < 1
    assert quality.partition_metrics(a, table([[0, 9, 0], [0, 0, 0]])).first().ari_common_wet is None


def test_objects_by_hand(spark, busy):
    cube, cells, frames, grid, labels, *_ = busy
    rows = {(r.t, r.label): r for r in objects.object_table(labels, cells).collect()}
    where: dict = {}
    for r in labels.collect():
        where.setdefault((r.t, r.label), []).append((r.y, r.x))
    assert rows.keys() == where.keys()
    for k, places in where.items():
        v = np.array([cube[k[0], y, x] for y, x in places])
        y, x = np.array(places).T
        r = rows[k]
        assert (r.area_cells, r.y_start, r.y_stop, r.x_start, r.x_stop) == (len(v), y.min(), y.max() + 1, x.min(), x.max() + 1)
        assert np.allclose([r.precipitation_sum, r.mean_intensity, r.max_intensity, r.centroid_y, r.centroid_x], [v.sum(), v.mean(), v.max(), (y * v).sum() / v.sum(), (x * v).sum() / v.sum()])


def test_candidates_by_hand(spark, busy):
    cube, cells, frames, grid, labels, options, graph = busy
    table = objects.object_table(labels, cells)
    items = table.collect()
    near = {(r.t, r.p_label, r.c_label) for r in candidates.within_radius(table, 3).collect()}
    boxes = {(r.t, r.p_label, r.c_label) for r in candidates.boxes_overlap(table, side=4).collect()}
    want_near, want_boxes = set(), set()
    for p in items:
        for c in items:
            if c.t == p.t + 1:
                if (c.centroid_y - p.centroid_y) ** 2 + (c.centroid_x - p.centroid_x) ** 2 <= 9:
                    want_near.add((c.t, p.label, c.label))
                if min(p.y_stop, c.y_stop) > max(p.y_start, c.y_start) and min(p.x_stop, c.x_stop) > max(p.x_start, c.x_start):
                    want_boxes.add((c.t, p.label, c.label))
    assert near == want_near and boxes == want_boxes
    still = {(r.t, r.parent_label, r.child_label): r.score for r in candidates.still_candidates(table, labels, options).where("t = 1").collect()}
    kernel = {(r.frame, r.parent_label, r.child_label): r.score for r in graph.candidates.where("frame = 1").collect()}
    assert still.keys() == kernel.keys() and all(abs(still[k] - kernel[k]) < 1e-9 for k in still)


def test_links_and_decisions(busy):
    cube, cells, frames, grid, labels, options, graph = busy
    painted = branch_cells(labels, graph.nodes)
    links, shared = quality.same_id_links(labels, painted)
    n = graph.edges.where("event = 'continue'").count()
    assert links.count() == n and shared.isEmpty()
    evidence = quality.pair_evidence(objects.object_table(labels, cells), labels, options, (1,))
    got = quality.pair_decisions(evidence, quality.named_edges(graph.edges, graph.nodes), options.tau)
    assert got.count() == evidence.count() and got.where("reason is null").isEmpty()
    assert got.where("reason like 'accepted_%'").count() == graph.edges.where("time = 1").count()
    sweep = quality.tau_sweep(frame_rows(frames, labels, cells), options, (0.3, 0.9), grid)
    assert {r.tau for r in sweep.collect()} >= {0.3}
    assert quality.structure_counts(graph.candidates).count() > 0
    assert quality.sample_frames(6, graph.events, graph.edges)[0] == 0


def test_summaries(busy):
    cube, cells, frames, grid, labels, options, graph = busy
    row = objects.run_summary(frames, cells, labels, graph.nodes, graph.edges, graph.events, grid).first()
    assert row.frames == 6 and row.nodes == graph.nodes.count() and row.edges == graph.edges.count()
    stats = {r.t: r for r in objects.frame_statistics(frames, cells, labels, grid).collect()}
    for t in range(6):
        assert abs(stats[t].mean_rain_mm_h - cube[t].mean()) < 1e-9 and stats[t].max_rain_mm_h == cube[t].max()
    assert objects.branch_speeds(graph.nodes, graph.edges, km=4.0).where("km_per_hour <> cells_per_hour * 4").isEmpty()
    hashes = quality.with_frame_hash(cells)
    assert hashes.select("sha256").distinct().count() == 6
