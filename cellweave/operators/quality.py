"""Checks, comparisons, audits and diagnoses of catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid, TrackOptions
from .lineage import graph_of, run_lineage
from .matching import bipartite_groups, event_kind, shared_checkpoints

FRAME = ("sequence_id", "t")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with ``side``, that one table has more often than the other: empty if they are equal."""
    names = a.columns
    left = a.select(*names).exceptAll(b.select(*names)).withColumn("side", F.lit("left"))
    return left.unionByName(b.select(*names).exceptAll(a.select(*names)).withColumn("side", F.lit("right")))


def tables_equal(a: DataFrame, b: DataFrame) -> bool:
    return differences(a, b).isEmpty()


def repeated(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges an end of which is not a node."""
    known = nodes.select("sequence_id", "node_id")
    ends = edges.select("*", F.explode(F.array("parent_node_id", "child_node_id")).alias("node_id"))
    return ends.join(known, ["sequence_id", "node_id"], "left_anti")


def backward_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that don't go forward in time, or whose gap isn't the frames in between."""
    at = nodes.select("sequence_id", F.col("node_id").alias("n"), F.col("time").alias("at"))
    p, c = at.select("sequence_id", F.col("n").alias("parent_node_id"), F.col("at").alias("p_time")), at.select("sequence_id", F.col("n").alias("child_node_id"), F.col("at").alias("c_time"))
    rows = edges.join(p, ["sequence_id", "parent_node_id"]).join(c, ["sequence_id", "child_node_id"])
    return rows.where((F.col("c_time") <= F.col("p_time")) | (F.col("gap") != F.col("c_time") - F.col("p_time") - 1) | (F.col("time") != F.col("c_time")))


def broken_branches(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of continuation between branches, and event edges within one."""
    b = nodes.select("sequence_id", "node_id", "branch_id")
    rows = edges.join(b.select("sequence_id", F.col("node_id").alias("parent_node_id"), F.col("branch_id").alias("pb")), ["sequence_id", "parent_node_id"])
    rows = rows.join(b.select("sequence_id", F.col("node_id").alias("child_node_id"), F.col("branch_id").alias("cb")), ["sequence_id", "child_node_id"])
    return rows.where(F.col("event").isin("continue", "gap_continue") != (F.col("pb") == F.col("cb")))


def event_ends(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Events with a parent or child that no edge of the event's kind and time has."""
    lists = (("parent_node_ids", "parent_node_id"), ("child_node_ids", "child_node_id"))
    out = None
    for many, one in lists:
        want = events.select("sequence_id", "event_id", "time", "event", F.explode(many).alias(one))
        lost = want.join(edges.select("sequence_id", "time", "event", one).distinct(), ["sequence_id", "time", "event", one], "left_anti").select("sequence_id", "event_id")
        out = lost if out is None else out.unionByName(lost)
    return out.distinct()


def id_order(nodes: DataFrame) -> DataFrame:
    """Sequences whose node ids don't rise by one in the order of time and label."""
    order = Window.partitionBy("sequence_id").orderBy("time", "local_label")
    steps = nodes.withColumn("step", F.col("node_id") - F.lag("node_id").over(order))
    return steps.where("step <> 1").select("sequence_id").distinct()


def wrong_families(nodes: DataFrame, family_map: DataFrame) -> DataFrame:
    """Nodes whose family isn't that of the map."""
    m = family_map.select("sequence_id", "branch_id", F.col("family_id").alias("f"))
    return nodes.join(m, ["sequence_id", "branch_id"], "left").where(~F.col("f").eqNullSafe(F.col("family_id")))


def structure_checks(nodes: DataFrame, edges: DataFrame, events: DataFrame, family_map: DataFrame) -> DataFrame:
    """(check, failures) of every invariant of a catalog."""
    found = {
        "unique_nodes": repeated(nodes, "sequence_id", "node_id"),
        "one_node_per_branch_and_time": repeated(nodes, "sequence_id", "branch_id", "time"),
        "unique_events": repeated(events, "sequence_id", "event_id"),
        "ids_in_order": id_order(nodes),
        "edges_have_nodes": dangling_edges(edges, nodes),
        "edges_go_forward": backward_edges(edges, nodes),
        "branches_continue": broken_branches(edges, nodes),
        "events_have_edges": event_ends(events, edges),
        "families_agree": wrong_families(nodes, family_map),
    }
    out = None
    for name, bad in found.items():
        one = bad.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- two identifications


def partition_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sequence_id, t, a_objects, b_objects, wet_mask_iou, common_wet_pixels, ari_common_wet) of two label tables.

    The adjusted Rand index is over the cells that both have: null under two of them, 1 where its
    denominator is 0.
    """
    key = [*FRAME, "y", "x"]
    both = a.select(*key, F.col("label").alias("la")).join(b.select(*key, F.col("label").alias("lb")), key, "full")
    cells = both.groupBy(*FRAME, "la", "lb").agg(F.count("*").alias("n"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    joint = cells.where("la is not null and lb is not null")
    total = joint.groupBy(*FRAME).agg(F.sum("n").alias("n"), F.sum(pairs("n")).alias("s"))
    side = lambda c: joint.groupBy(*FRAME, c).agg(F.sum("n").alias("k")).groupBy(*FRAME).agg(F.sum(pairs("k")).alias(f"s_{c}"))
    ari = total.join(side("la"), list(FRAME)).join(side("lb"), list(FRAME))
    expected = F.col("s_la") * F.col("s_lb") / pairs("n")
    bottom = (F.col("s_la") + F.col("s_lb")) / 2 - expected
    ari = ari.select(*FRAME, "n", F.when(F.col("n") < 2, None).when(bottom == 0, 1.0).otherwise((F.col("s") - expected) / bottom).alias("ari"))
    sums = cells.groupBy(*FRAME).agg(F.count_distinct("la").alias("a_objects"), F.count_distinct("lb").alias("b_objects"), F.sum("n").alias("any"))
    return sums.join(ari, list(FRAME), "left").select(*FRAME, "a_objects", "b_objects", (F.coalesce("n", F.lit(0)) / F.col("any")).alias("wet_mask_iou"), F.coalesce("n", F.lit(0)).alias("common_wet_pixels"), F.col("ari").alias("ari_common_wet"))


def object_ids(identified: DataFrame, tracked: DataFrame) -> DataFrame:
    """(sequence_id, t, label, branch_id) of each object; it must have exactly one id over all its cells."""
    key = [*FRAME, "y", "x"]
    seen = identified.join(tracked.select(*key, "branch_id"), key, "left").groupBy(*FRAME, "label").agg(F.count_distinct("branch_id").alias("n"), F.min("branch_id").alias("branch_id"))
    if not seen.where("n <> 1").isEmpty():
        raise ValueError("an object has no id or several")
    return seen.drop("n")


def same_id_links(identified: DataFrame, tracked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, shared): pairs of objects of following frames with one id; and ids that several objects of a frame share."""
    ids = object_ids(identified, tracked)
    after = ids.select("sequence_id", (F.col("t") - 1).alias("t"), F.col("label").alias("child_label"), "branch_id")
    links = ids.join(after, ["sequence_id", "t", "branch_id"]).select(*FRAME, F.col("label").alias("parent_label"), "child_label")
    shared = ids.groupBy(*FRAME, "branch_id").agg(F.count("*").alias("n")).where("n > 1").groupBy(*FRAME).agg(F.count("*").alias("shared_ids"))
    return links, shared


def link_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(status, n): links that both have, only the first, only the second."""
    a, b = a.distinct(), b.select(*a.columns).distinct()
    parts = (("both", a.intersect(b)), ("first", a.exceptAll(b)), ("second", b.exceptAll(a)))
    out = None
    for name, part in parts:
        one = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("status"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with frame and label of both ends, which don't depend on how ids were given."""
    n = nodes.select("sequence_id", "node_id", "time", "local_label")
    p = n.select("sequence_id", F.col("node_id").alias("parent_node_id"), F.col("time").alias("parent_frame"), F.col("local_label").alias("parent_label"))
    c = n.select("sequence_id", F.col("node_id").alias("child_node_id"), F.col("time").alias("child_frame"), F.col("local_label").alias("child_label"))
    return edges.drop("time").join(p, ["sequence_id", "parent_node_id"]).join(c, ["sequence_id", "child_node_id"])


def edge_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and re-typed links of two ``named_edges`` tables."""
    key = ["sequence_id", "parent_frame", "parent_label", "child_frame", "child_label"]
    both = old.select(*key, F.col("event").alias("old_event")).join(new.select(*key, F.col("event").alias("new_event")), key, "full")
    status = F.when(F.col("old_event").isNull(), "added").when(F.col("new_event").isNull(), "removed").when(F.col("old_event") != F.col("new_event"), "changed")
    return both.withColumn("status", status).where("status is not null")


def focus_pairs(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Named pairs (sequence_id, frames, labels) with the edge that each of two ``named_edges`` tables has there."""
    key = ["sequence_id", "parent_frame", "parent_label", "child_frame", "child_label"]
    side = lambda df, n: df.select(*key, F.col("event").alias(f"{n}_event"), F.col("score").alias(f"{n}_score"))
    return pairs.join(side(old, "old"), key, "left").join(side(new, "new"), key, "left")


# ---------------------------------------------------------------- audits


def structure_counts(candidates: DataFrame) -> DataFrame:
    """(sequence_id, frame, structure, n): split, merge and complex groups among candidates that overlap
    enough, before and after tau."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for stage, part in (("before_tau", pdf), ("after_tau", pdf[pdf.passes_tau])):
            for ps, cs, _ in bipartite_groups(part.parent_label.to_numpy(), part.child_label.to_numpy()):
                if kind := event_kind(len(ps), len(cs)):
                    out.append((pdf.sequence_id.iloc[0], pdf.frame.iloc[0], stage, kind))
        return pd.DataFrame(out, columns=["sequence_id", "frame", "stage", "structure"])

    held = candidates.where("passes_event_overlap").select("sequence_id", "frame", "parent_label", "child_label", "passes_tau")
    found = held.groupBy("sequence_id", "frame").applyInPandas(run, "sequence_id string, frame long, stage string, structure string")
    return found.groupBy("sequence_id", "frame", "stage", "structure").agg(F.count("*").alias("n"))


def tau_sweep(rows: DataFrame, options: TrackOptions, taus: Sequence[float], grid: Grid | None = None) -> DataFrame:
    """(tau, kind, event, n): edges and events by kind for each tau. Frames are made once and every tau is tracked once, with states of its own."""
    shared_checkpoints(rows.sparkSession)
    rows = rows.checkpoint()
    out = None
    for tau in taus:
        set_ = TrackOptions(**{f: getattr(options, f) for f in options.__dataclass_fields__} | {"tau": tau})
        graph = graph_of(run_lineage(rows, set_, grid).checkpoint())
        for kind, df in (("edge", graph.edges), ("event", graph.events)):
            one = df.groupBy("event").agg(F.count("*").alias("n")).select(F.lit(float(tau)).alias("tau"), F.lit(kind).alias("kind"), "event", "n")
            out = one if out is None else out.unionByName(one)
    return out


def pair_decisions(evidence: DataFrame, edges: DataFrame, tau: float) -> DataFrame:
    """``evidence`` (sequence_id, parent_frame, parent_label, child_frame, child_label, candidate, score) with why each pair
    was linked or not; the first reason that holds counts. ``edges`` are ``named_edges``."""
    key = ["sequence_id", "parent_frame", "parent_label", "child_frame", "child_label"]
    mine = edges.select(*key, F.col("event").alias("edge_event"))
    used_p = edges.select("sequence_id", "parent_frame", "parent_label", "child_frame").distinct().withColumn("parent_used", F.lit(True))
    used_c = edges.select("sequence_id", "child_frame", "child_label").distinct().withColumn("child_used", F.lit(True))
    rows = evidence.join(mine, key, "left").join(used_p, ["sequence_id", "parent_frame", "parent_label", "child_frame"], "left").join(used_c, ["sequence_id", "child_frame", "child_label"], "left")
    reason = (
        F.when(F.col("edge_event").isNotNull(), F.concat(F.lit("accepted_"), "edge_event"))
        .when(~F.col("candidate"), "outside_all_candidate_gates")
        .when(F.col("score") < tau, "below_score_threshold")
        .when(F.coalesce("parent_used", "child_used", F.lit(False)), "endpoint_used_by_other_edge")
        .otherwise("eligible_but_not_assigned")
    )
    return rows.withColumn("reason", reason).drop("parent_used", "child_used")


def pair_evidence(objects: DataFrame, labels: DataFrame, options: TrackOptions, frames: Sequence[int]) -> DataFrame:
    """All pairs of objects of the given frames and the frames before, with what decides about them at velocity 0,
    pairs outside of all gates too."""
    from .candidates import intensity_ratio, link_score, pixel_overlap

    names = ("label", "centroid_y", "centroid_x", "mean_intensity")
    some = objects.where(F.col("t").isin([*frames, *(f - 1 for f in frames)]))
    p = some.where(F.col("t").isin([f - 1 for f in frames])).select("sequence_id", (F.col("t") + 1).alias("t"), *(F.col(n).alias(f"p_{n}") for n in names))
    c = some.where(F.col("t").isin(list(frames))).select("sequence_id", "t", *(F.col(n).alias(f"c_{n}") for n in names))
    over = pixel_overlap(labels.where(F.col("t").isin([*frames, *(f - 1 for f in frames)])))
    rows = p.join(c, list(FRAME)).join(over.select(*FRAME, F.col("parent_label").alias("p_label"), F.col("child_label").alias("c_label"), "iou", "parent_coverage", "child_coverage"), [*FRAME, "p_label", "c_label"], "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    far = F.hypot(F.col("c_centroid_y") - F.col("p_centroid_y"), F.col("c_centroid_x") - F.col("p_centroid_x"))
    cover = F.greatest(zero("parent_coverage"), zero("child_coverage"))
    gate = (far <= options.max_displacement) | ((cover > 0) & (cover >= options.event_overlap))
    score = link_score(zero("iou"), far, options.max_displacement, intensity_ratio("p_mean_intensity", "c_mean_intensity"))
    return rows.select("sequence_id", (F.col("t") - 1).alias("parent_frame"), F.col("p_label").alias("parent_label"), F.col("t").alias("child_frame"), F.col("c_label").alias("child_label"), gate.alias("candidate"), score.alias("score"), far.alias("distance"), zero("iou").alias("raw_iou"), zero("parent_coverage").alias("parent_coverage"), zero("child_coverage").alias("child_coverage"))


def sample_frames(n_frames: int, events: DataFrame, edges: DataFrame, most: int = 6) -> list[int]:
    """Up to ``most`` evenly spaced frames, the first of each kind of event and of a gap: a few numbers."""
    spaced = sorted({round(k * (n_frames - 1) / max(1, most - 1)) for k in range(most)}) if n_frames else []
    first = [r[0] for r in events.groupBy("event").agg(F.min("time")).select("min(time)").collect()]
    gap = edges.where("gap > 0").agg(F.min("time")).first()[0]
    return sorted({*spaced, *first, *([gap] if gap is not None else [])})


def with_frame_hash(cells: DataFrame) -> DataFrame:
    """(sequence_id, t, sha256) of each frame's cells in row-major order: equal frames have equal hashes."""
    one = F.concat_ws(",", "y", "x", F.coalesce(F.col("rain").cast("string"), F.lit("null")), F.col("valid").cast("string"))
    rows = cells.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("y", "x", one.alias("v")))).alias("a"))
    return rows.select(*FRAME, F.sha2(F.concat_ws(";", F.transform("a", lambda r: r["v"])), 256).alias("sha256"))


def replay(rows: DataFrame, options: TrackOptions, chunk: int, grid: Grid | None = None) -> DataFrame:
    """Tagged rows of tracking in chunks of frames, each going on from the states of the one before."""
    from .lineage import of_kind

    shared_checkpoints(rows.sparkSession)
    bounds = rows.agg(F.min("t"), F.max("t")).first()
    if bounds[0] is None:
        return run_lineage(rows, options, grid)
    out, states = None, None
    for low in range(bounds[0], bounds[1] + 1, chunk):
        part = run_lineage(rows.where(F.col("t").between(low, low + chunk - 1)), options, grid, states)
        part = part.checkpoint()
        states = of_kind(part, "state")
        done = part.where("kind not in ('family', 'state')")
        out = done if out is None else out.unionByName(done)
        last = part
    return out.unionByName(last.where("kind in ('family', 'state')"))
