"""Queries over tracked sequences, and the same in SQL.

The cube is coarser than that of the other queries, so that objects overlap from frame to frame and split, merge and pause. Every
link that scores enough can be part of an event and a child with two links over a missing frame has none, so what is
linked follows from link counts: a recursive query over frames carries where each object came from, which its motion depends on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import internal_stamp, joined_ids, stamp_in_name, unit_name
from ..grid import Grid, TrackOptions, disk
from ..operators import candidates, matching, objects, preprocess, quality
from ..operators.candidates import still_candidates
from ..operators.identify import identify
from ..operators.lineage import TAGGED, branch_cells, frame_rows, graph_of, in_order, run_lineage, track
from ..operators.longrun import Run, track_series
from ..sources.multitime import read_precipitation
from ..sources.series import read_raster, read_series, write_raster
from ..sources.tables import canonical_families, finalize_catalog, write_part
from ..streaming.living import living_families, run_living
from .queries import FRAMES, STEP, events, frames, frames_of_events, query

SIDE, THRESHOLD = 12, 30.0
GRID = Grid(SIDE, SIDE)
OPTIONS = TrackOptions(tau=0.35, max_displacement=3.05, max_gap=1, event_overlap=0.0, gap_ambiguity=1.0)
HOURS = STEP / 3600


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence_id, t, y, x, rain, valid)"""
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    e = events(spark, sf_dir).select(F.floor(seconds / STEP).cast("long").alias("t"), (F.col("user_id") % SIDE).cast("int").alias("y"), (F.floor("value") % SIDE).cast("int").alias("x"), F.round(F.col("value") * 100).cast("long").alias("c"), (F.col("event_type") == "error").alias("bad"))
    g = e.groupBy("t", "y", "x").agg(F.max("c").alias("cents"), (~F.bool_or("bad")).alias("valid"))
    return g.select(F.lit("events").alias("sequence_id"), "t", "y", "x", (F.col("cents") / 100).alias("rain"), "valid")


def _tracked(spark: SparkSession, d: str):
    cells = cube(spark, d)
    labels = identify(cells, GRID, THRESHOLD, disk(0))
    return cells, labels, track(cells, frames(spark), labels, GRID, OPTIONS)


# ---------------------------------------------------------------- pieces of SQL

_BASE = f"""
ev AS (SELECT date_diff('second', TIMESTAMP '2024-01-01', ts) // {STEP} AS t, user_id % {SIDE} AS y, CAST(floor(value) AS BIGINT) % {SIDE} AS x, CAST(round(value * 100) AS BIGINT) AS c, event_type FROM events),
cells AS (SELECT t, y, x, max(c) AS cents, NOT bool_or(event_type = 'error') AS valid FROM ev GROUP BY t, y, x),
frames AS (SELECT unnest(generate_series(0, {FRAMES - 1})) AS t),
wet AS (SELECT t, y, x, cents FROM cells WHERE valid AND cents >= {int(THRESHOLD * 100)}),
flood AS (SELECT t, y, x, y * {SIDE} + x AS root FROM wet UNION SELECT g.t, g.y, g.x, r.root FROM flood r JOIN wet g ON g.t = r.t AND abs(g.y - r.y) <= 1 AND abs(g.x - r.x) <= 1),
parts AS (SELECT t, y, x, min(root) AS root FROM flood GROUP BY t, y, x),
lab AS (SELECT t, y, x, CAST(dense_rank() OVER (PARTITION BY t ORDER BY root) AS INTEGER) AS label FROM parts),
obj AS (SELECT l.t, l.label, count(*) AS area, sum(c.cents) / 100.0 AS total, avg(c.cents / 100.0) AS mean, max(c.cents) / 100.0 AS most,
  sum(l.y * c.cents) / CAST(sum(c.cents) AS DOUBLE) AS cy, sum(l.x * c.cents) / CAST(sum(c.cents) AS DOUBLE) AS cx, min(l.y) AS y0, max(l.y) + 1 AS y1, min(l.x) AS x0, max(l.x) + 1 AS x1,
  row_number() OVER (ORDER BY l.t, l.label) AS node FROM lab l JOIN cells c ON c.t = l.t AND c.y = l.y AND c.x = l.x GROUP BY l.t, l.label),
moved AS (SELECT p.t AS pt, c.t AS ct, p.label AS p, c.label AS c, c.y - p.y AS sy, c.x - p.x AS sx, count(*) AS n FROM lab p JOIN lab c ON c.t BETWEEN p.t + 1 AND p.t + 2 GROUP BY ALL)"""


def _links(parents: str, elapsed: str = "x.t - x.time") -> str:
    """Candidates of rows (t, time, label, by_, bx_, bt) of ``parents`` with objects of frame t."""
    r = OPTIONS.max_displacement
    return f"""SELECT t, time, label, child, cy, cx, k, iou, iou_adv, far, cover_p, cover_c, 0.6 * greatest(iou, iou_adv) + 0.25 * exp(-far / ({r} * k)) + 0.15 * ratio AS score
    FROM (SELECT x.t, x.time, x.label, x.child, x.cy, x.cx, x.k, coalesce(m0.n, 0) / CAST(x.pa + x.ca - coalesce(m0.n, 0) AS DOUBLE) AS iou, coalesce(m1.n, 0) / CAST(x.pa + x.ca - coalesce(m1.n, 0) AS DOUBLE) AS iou_adv,
        greatest(coalesce(m0.n, 0), coalesce(m1.n, 0)) / CAST(x.pa AS DOUBLE) AS cover_p, greatest(coalesce(m0.n, 0), coalesce(m1.n, 0)) / CAST(x.ca AS DOUBLE) AS cover_c,
        sqrt((x.oy - x.cy - x.vy * x.k) * (x.oy - x.cy - x.vy * x.k) + (x.ox - x.cx - x.vx * x.k) * (x.ox - x.cx - x.vx * x.k)) AS far, sqrt((x.oy - x.cy) * (x.oy - x.cy) + (x.ox - x.cx) * (x.ox - x.cx)) AS still, least(x.pm, x.cm) / greatest(x.pm, x.cm, 1e-12) AS ratio
      FROM (SELECT s.t, s.time, s.label, c.label AS child, s.t - s.time AS k, p.cy, p.cx, c.cy AS oy, c.cx AS ox, p.area AS pa, c.area AS ca, p.mean AS pm, c.mean AS cm, coalesce((p.cy - s.by_) / (s.time - s.bt), 0.0) AS vy, coalesce((p.cx - s.bx_) / (s.time - s.bt), 0.0) AS vx
        FROM {parents} s JOIN obj p ON p.t = s.time AND p.label = s.label JOIN obj c ON c.t = s.t) x
      LEFT JOIN moved m0 ON m0.pt = x.time AND m0.ct = x.t AND m0.p = x.label AND m0.c = x.child AND m0.sy = 0 AND m0.sx = 0
      LEFT JOIN moved m1 ON m1.pt = x.time AND m1.ct = x.t AND m1.p = x.label AND m1.c = x.child AND m1.sy = round_even(x.vy * x.k, 0) AND m1.sx = round_even(x.vx * x.k, 0)) z
    WHERE far <= {r} * k OR still <= {r} * k OR cover_p > 0"""


def _lineage(tau: float = OPTIONS.tau, tag: str = "") -> str:
    """CTEs st (which rows are parents of which frame, with where they came from), edges, nodes, events, families."""
    gap = OPTIONS.gap_tau  # the same for every tau
    return f""",
st{tag} AS (SELECT 0 AS step, CAST(t AS BIGINT) AS time, label, CAST(NULL AS DOUBLE) AS by_, CAST(NULL AS DOUBLE) AS bx_, CAST(NULL AS BIGINT) AS bt FROM obj WHERE t = 0 UNION ALL SELECT 0, -1, 0, NULL, NULL, NULL
  UNION ALL (WITH par AS (SELECT step + 1 AS t, time, label, by_, bx_, bt FROM st{tag} WHERE step < {FRAMES - 1}),
    cand AS ({_links('par')}),
    good AS (SELECT *, count(*) OVER (PARTITION BY label) AS dp, count(*) OVER (PARTITION BY child) AS dc FROM cand WHERE k = 1 AND score >= {tau}),
    wide AS (SELECT *, count(*) OVER (PARTITION BY child) AS dc FROM cand WHERE k = 2),
    over AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, child) AS r FROM wide WHERE dc = 1 AND score >= {gap} AND child NOT IN (SELECT child FROM good)),
    came AS (SELECT child, cy, cx, time FROM good WHERE dp = 1 AND dc = 1 UNION ALL SELECT child, cy, cx, time FROM over WHERE r = 1)
    SELECT f.t, f.t, o.label, c.cy, c.cx, c.time FROM (SELECT DISTINCT t FROM par) f JOIN obj o ON o.t = f.t LEFT JOIN came c ON c.child = o.label
    UNION ALL SELECT t, time, label, by_, bx_, bt FROM par WHERE label > 0 AND time = t - 1 AND label NOT IN (SELECT label FROM good)
    UNION ALL SELECT DISTINCT t, -1, 0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT) FROM par)),
par{tag} AS (SELECT step + 1 AS t, time, label, by_, bx_, bt FROM st{tag} WHERE label > 0),
cand{tag} AS ({_links(f'par{tag}')}),
good{tag} AS (SELECT *, count(*) OVER (PARTITION BY t, label) AS dp, count(*) OVER (PARTITION BY t, child) AS dc FROM cand{tag} WHERE k = 1 AND score >= {tau}),
wide{tag} AS (SELECT *, count(*) OVER (PARTITION BY t, child) AS dc FROM cand{tag} WHERE k = 2),
over{tag} AS (SELECT *, row_number() OVER (PARTITION BY t, label ORDER BY score DESC, child) AS r FROM wide{tag} w WHERE dc = 1 AND score >= {gap} AND NOT EXISTS (SELECT 1 FROM good{tag} g WHERE g.t = w.t AND g.child = w.child)),
many{tag} AS (SELECT t, label, child FROM good{tag} WHERE dp > 1 OR dc > 1),
comp{tag} AS (SELECT t, label, label AS root FROM many{tag} UNION SELECT b.t, b.label, g.root FROM comp{tag} g JOIN many{tag} a ON a.t = g.t AND a.label = g.label JOIN many{tag} b ON b.t = a.t AND b.child = a.child),
root{tag} AS (SELECT t, label, min(root) AS root FROM comp{tag} GROUP BY t, label),
kind{tag} AS (SELECT m.t, r.root, CASE WHEN count(DISTINCT m.label) = 1 THEN 'split' WHEN count(DISTINCT m.child) = 1 THEN 'merge' ELSE 'complex' END AS event, list_sort(list(DISTINCT m.label)) AS parents, list_sort(list(DISTINCT m.child)) AS children FROM many{tag} m JOIN root{tag} r ON r.t = m.t AND r.label = m.label GROUP BY m.t, r.root),
link{tag} AS (SELECT g.t, g.time, g.label, g.child, k.event, k.root, g.score, g.iou, g.iou_adv, g.far, g.cover_p, g.cover_c FROM good{tag} g JOIN root{tag} r ON r.t = g.t AND r.label = g.label JOIN kind{tag} k ON k.t = r.t AND k.root = r.root WHERE g.dp > 1 OR g.dc > 1
  UNION ALL SELECT t, time, label, child, 'continue', NULL, score, iou, iou_adv, far, cover_p, cover_c FROM good{tag} WHERE dp = 1 AND dc = 1 UNION ALL SELECT t, time, label, child, 'gap_continue', NULL, score, iou, iou_adv, far, cover_p, cover_c FROM over{tag} WHERE r = 1),
edges{tag} AS (SELECT l.*, l.t - l.time - 1 AS gap, p.node AS pn, c.node AS cn FROM link{tag} l JOIN obj p ON p.t = l.time AND p.label = l.label JOIN obj c ON c.t = l.t AND c.label = l.child)"""


_GRAPH = _BASE + _lineage() + """,
start AS (SELECT o.node, row_number() OVER (ORDER BY o.t, CASE WHEN k.root IS NULL THEN 1 ELSE 0 END, k.root, o.label) AS branch FROM obj o LEFT JOIN (SELECT DISTINCT cn, root FROM edges WHERE root IS NOT NULL) k ON k.cn = o.node WHERE o.node NOT IN (SELECT cn FROM edges WHERE root IS NULL)),
named AS (SELECT node, branch FROM start UNION ALL SELECT e.cn, n.branch FROM named n JOIN edges e ON e.pn = n.node AND e.root IS NULL),
tie AS (SELECT DISTINCT p.branch AS a, c.branch AS b FROM edges e JOIN named p ON p.node = e.pn JOIN named c ON c.node = e.cn WHERE e.root IS NOT NULL),
ties AS (SELECT a, b FROM tie UNION SELECT b, a FROM tie),
kin AS (SELECT branch, branch AS other FROM start UNION SELECT k.branch, t.b FROM kin k JOIN ties t ON t.a = k.other),
family AS (SELECT branch, min(other) AS family FROM kin GROUP BY branch),
nodes AS (SELECT o.*, n.branch, f.family FROM obj o JOIN named n ON n.node = o.node JOIN family f ON f.branch = n.branch)"""

_NODES = "t AS time, node AS node_id, branch AS branch_id, family AS family_id, label AS local_label, area AS area_cells, round(cy, 6) AS centroid_y, round(cx, 6) AS centroid_x, round(mean, 6) AS mean_intensity, round(most, 6) AS max_intensity, round(total, 6) AS precipitation_sum, y0 AS y_start, y1 AS y_stop, x0 AS x_start, x1 AS x_stop"


def _sql(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {_GRAPH}{more} {body}"


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


# ---------------------------------------------------------------- the graph


@query(_sql(f"SELECT {_NODES} FROM nodes"))
def track_nodes(spark, d):
    n = _tracked(spark, d)[2].nodes
    whole = ("time", "node_id", "branch_id", "family_id", "local_label", "area_cells", "y_start", "y_stop", "x_start", "x_stop")
    return n.select(*whole, *(_r(c) for c in ("centroid_y", "centroid_x", "mean_intensity", "max_intensity", "precipitation_sum")))


_EDGES = "SELECT t AS time, pn AS parent_node_id, cn AS child_node_id, event, CAST(gap AS INTEGER) AS gap, round(score, 6) AS score, round(iou, 6) AS raw_iou, round(iou_adv, 6) AS advected_iou, round(far, 6) AS distance, round(cover_p, 6) AS parent_coverage, round(cover_c, 6) AS child_coverage FROM edges"


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("time", "parent_node_id", "child_node_id", "event", "gap", *(_r(c) for c in ("score", "raw_iou", "advected_iou", "distance", "parent_coverage", "child_coverage")))


@query(_sql(_EDGES))
def track_edges(spark, d):
    return _edges(_tracked(spark, d)[2].edges)


@query(_sql(_EDGES))
def replayed_edges(spark, d):
    """The same from chunks of 30 frames, each going on from the saved states of the one before."""
    cells = cube(spark, d)
    rows = frame_rows(frames(spark), identify(cells, GRID, THRESHOLD, disk(0)), cells)
    return _edges(graph_of(quality.replay(rows, OPTIONS, 30, GRID)).edges)


@query(_sql("SELECT t AS time, pn AS parent_node_id, cn AS child_node_id, event, row_number() OVER (PARTITION BY t ORDER BY CASE event WHEN 'continue' THEN 1 WHEN 'gap_continue' THEN 2 ELSE 0 END, root, pn, cn) - 1 AS emitted FROM edges"))
def edge_order(spark, d):
    """A frame's edges in order: events by their least parent, one-to-one links, links over missing frames; in each, by parent and child."""
    cells = cube(spark, d)
    rows = frame_rows(frames(spark), identify(cells, GRID, THRESHOLD, disk(0)), cells)
    return in_order(run_lineage(rows, OPTIONS, GRID), "edge").select("time", "parent_node_id", "child_node_id", "event", "emitted")


_EVENTS = """,
happened AS (SELECT e.t, e.root, e.event, list_sort(list(DISTINCT e.pn)) AS ps, list_sort(list(DISTINCT e.cn)) AS cs, row_number() OVER (ORDER BY e.t, e.root) AS event_id FROM edges e WHERE e.root IS NOT NULL GROUP BY e.t, e.root, e.event)"""


@query(_sql("SELECT event_id, t AS time, event, array_to_string(ps, ';') AS parent_node_ids, array_to_string(cs, ';') AS child_node_ids FROM happened", _EVENTS))
def track_events(spark, d):
    return _tracked(spark, d)[2].events.select("event_id", "time", "event", joined_ids("parent_node_ids").alias("parent_node_ids"), joined_ids("child_node_ids").alias("child_node_ids"))


@query(_sql("SELECT t AS frame, time AS parent_frame, label AS parent_label, child AS child_label, round(score, 6) AS score, round(cover_p, 6) AS parent_coverage, round(cover_c, 6) AS child_coverage, score >= 0.35 AS passes_tau, dp IS NOT NULL AND (dp > 1 OR dc > 1) AS accepted_event FROM (SELECT c.*, g.dp, g.dc FROM cand c LEFT JOIN good g ON g.t = c.t AND g.label = c.label AND g.child = c.child AND g.k = c.k WHERE c.k = 1)"))
def track_candidates(spark, d):
    """Every candidate with the moved place and overlap of its parent, and what became of it."""
    c = _tracked(spark, d)[2].candidates
    return c.select("frame", "parent_frame", "parent_label", "child_label", _r("score"), _r("parent_coverage"), _r("child_coverage"), "passes_tau", "accepted_event")


_FAMILIES = _sql("SELECT branch AS branch_id, family AS family_id FROM family")


@query(_FAMILIES)
def family_map(spark, d):
    return _tracked(spark, d)[2].family_map.select("branch_id", "family_id")


@query(_FAMILIES)
def families_from_events(spark, d):
    """Families as components of branches that events join: must be those of the kernel."""
    graph = _tracked(spark, d)[2]
    named = graph.nodes.select("sequence_id", "node_id", "branch_id")
    ends = graph.edges.where("event in ('split', 'merge', 'complex')").select("sequence_id", "parent_node_id", "child_node_id")
    links = ends.join(named.select("sequence_id", F.col("node_id").alias("parent_node_id"), F.col("branch_id").alias("a")), ["sequence_id", "parent_node_id"]).join(named.select("sequence_id", F.col("node_id").alias("child_node_id"), F.col("branch_id").alias("b")), ["sequence_id", "child_node_id"])
    return matching.families(named.select("sequence_id", "branch_id"), links.select("sequence_id", "a", "b")).select("branch_id", "family_id")


@query(_FAMILIES)
def grown_families(spark, d):
    """The same, from three chunks of frames that are added one after another, each with its own branches and links only."""
    graph = _tracked(spark, d)[2]
    named = graph.nodes.select("sequence_id", "time", "node_id", "branch_id").checkpoint()
    ends = graph.edges.where("event in ('split', 'merge', 'complex')").select("sequence_id", "time", "parent_node_id", "child_node_id")
    for side in ("parent", "child"):
        ends = ends.join(named.select("sequence_id", F.col("node_id").alias(f"{side}_node_id"), F.col("branch_id").alias(side)), ["sequence_id", f"{side}_node_id"])
    log = matching.FamilyLog(spark, _folder(spark, "families"))
    for k, span in enumerate(("time < 40", "time between 40 and 79", "time >= 80")):
        log.add(k, named.where(span), ends.where(span).select("sequence_id", F.col("parent").alias("a"), F.col("child").alias("b")))
    return log.families().select("branch_id", "family_id")


@query(_sql(f"SELECT f.branch AS branch_id, f.family AS family_id, CASE WHEN e.last + 2 < {FRAMES} THEN e.last + 2 END AS ended FROM family f JOIN (SELECT family, max(t) AS last FROM nodes GROUP BY family) e ON e.family = f.family"))
def streamed_families(spark, d):
    """Families of a stream that is stopped after 60 frames and started again, and the frame at which each can't go on: two after its last one."""
    cells = cube(spark, d)
    rows = frame_rows(frames(spark), identify(cells, GRID, THRESHOLD, disk(0)), cells)
    folder = _folder(spark, "stream")
    for k, span in enumerate(("t < 60", "t >= 60")):
        rows.where(span).write.parquet(f"{folder}/in/part={k}")
        run_living(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/part=*"), OPTIONS, f"{folder}/out", f"{folder}/check", GRID)
    return living_families(spark.read.schema(TAGGED).parquet(f"{folder}/out")).drop("sequence_id")


@query(_sql("SELECT l.t, l.y, l.x, n.branch AS branch_id FROM lab l JOIN nodes n ON n.t = l.t AND n.label = l.label"))
def branch_raster(spark, d):
    _, labels, graph = _tracked(spark, d)
    return branch_cells(labels, graph.nodes).drop("sequence_id")


@query(_sql("SELECT time, node_id, branch_id, family_id, family_id AS canonical_family_id FROM (SELECT t AS time, node AS node_id, branch AS branch_id, family AS family_id FROM nodes)"))
def catalog(spark, d):
    graph = _tracked(spark, d)[2]
    return canonical_families(graph.nodes, graph.family_map).select("time", "node_id", "branch_id", "family_id", "canonical_family_id")


# ---------------------------------------------------------------- statistics

_SPANS = f""",
spans AS (SELECT branch, min(t) AS first, max(t) AS last, (max(t) - min(t) + 1) * {HOURS} AS hours, bool_or(y0 = 0 OR x0 = 0 OR y1 = {SIDE} OR x1 = {SIDE} OR t = 0 OR t = {FRAMES - 1}) AS censored FROM nodes GROUP BY branch),
speeds AS (SELECT p.branch, c.t, sqrt((c.cy - p.cy) * (c.cy - p.cy) + (c.cx - p.cx) * (c.cx - p.cx)) / ({HOURS} * (c.t - p.t)) AS v FROM edges e JOIN nodes p ON p.node = e.pn JOIN nodes c ON c.node = e.cn WHERE p.branch = c.branch)"""


@query(_sql("SELECT branch AS branch_id, first, last, hours AS span_hours FROM spans", _SPANS))
def branch_spans(spark, d):
    return objects.branch_spans(_tracked(spark, d)[2].nodes, HOURS).drop("sequence_id")


@query(_sql("SELECT branch AS branch_id, t AS time, round(v, 6) AS cells_per_hour, round(v * 4, 6) AS km_per_hour FROM speeds", _SPANS))
def branch_speeds(spark, d):
    graph = _tracked(spark, d)[2]
    return objects.branch_speeds(graph.nodes, graph.edges, HOURS, 4.0).select("branch_id", "time", _r("cells_per_hour"), _r("km_per_hour"))


@query(_sql("SELECT branch AS branch_id, censored FROM spans", _SPANS))
def censored_branches(spark, d):
    return objects.censored_branches(_tracked(spark, d)[2].nodes, frames(spark), GRID).drop("sequence_id")


@query(_sql(f"""SELECT (SELECT count(*) FROM frames) AS frames, (SELECT round(count(*) / {SIDE * SIDE * FRAMES}.0, 6) FROM lab) AS wet_fraction, (SELECT round(count(*) / {SIDE * SIDE * FRAMES}.0, 6) FROM cells WHERE NOT valid) AS missing_fraction,
(SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM family) AS branches, (SELECT count(DISTINCT family) FROM family) AS families, (SELECT max(k) FROM (SELECT count(*) AS k FROM family GROUP BY family)) AS largest_family_branches,
(SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE gap > 0) AS gap_edges, (SELECT count(*) FROM happened WHERE event = 'split') AS split_events, (SELECT count(*) FROM happened WHERE event = 'merge') AS merge_events, (SELECT count(*) FROM happened WHERE event = 'complex') AS complex_events,
(SELECT median(hours) FROM spans) AS median_span_hours, (SELECT max(hours) FROM spans) AS max_span_hours, (SELECT round(median(v), 6) FROM speeds) AS median_cells_per_hour, (SELECT count(*) FROM spans WHERE censored) AS censored_branches""", _EVENTS + _SPANS))
def run_summary(spark, d):
    cells, labels, graph = _tracked(spark, d)
    found = objects.run_summary(frames(spark), cells, labels, graph.nodes, graph.edges, graph.events, GRID, HOURS)
    return found.withColumns({c: F.round(c, 6) for c in ("wet_fraction", "missing_fraction", "median_cells_per_hour")})


# ---------------------------------------------------------------- checks, audits, comparisons

_CHECKS = """SELECT 'unique_nodes' AS "check", count(*) AS failures FROM (SELECT 1 FROM seen_nodes GROUP BY node HAVING count(*) > 1)
UNION ALL SELECT 'one_node_per_branch_and_time', count(*) FROM (SELECT 1 FROM seen_nodes GROUP BY branch, time HAVING count(*) > 1)
UNION ALL SELECT 'unique_events', count(*) FROM (SELECT 1 FROM happened GROUP BY event_id HAVING count(*) > 1)
UNION ALL SELECT 'ids_in_order', count(DISTINCT 1) FROM (SELECT node - lag(node) OVER (ORDER BY time, label, node) AS step FROM seen_nodes) WHERE step <> 1
UNION ALL SELECT 'edges_have_nodes', count(*) FROM (SELECT pn AS n FROM seen_edges UNION ALL SELECT cn FROM seen_edges) WHERE n NOT IN (SELECT node FROM seen_nodes)
UNION ALL SELECT 'edges_go_forward', count(*) FROM seen_edges e JOIN seen_nodes p ON p.node = e.pn JOIN seen_nodes c ON c.node = e.cn WHERE c.time <= p.time OR e.gap <> c.time - p.time - 1 OR e.time <> c.time
UNION ALL SELECT 'branches_continue', count(*) FROM seen_edges e JOIN seen_nodes p ON p.node = e.pn JOIN seen_nodes c ON c.node = e.cn WHERE (e.event IN ('continue', 'gap_continue')) <> (p.branch = c.branch)
UNION ALL SELECT 'events_have_edges', count(DISTINCT h.event_id) FROM (SELECT event_id, t, event, unnest(ps) AS n, TRUE AS parent FROM happened UNION ALL SELECT event_id, t, event, unnest(cs), FALSE FROM happened) h WHERE NOT EXISTS (SELECT 1 FROM seen_edges e WHERE e.time = h.t AND e.event = h.event AND CASE WHEN h.parent THEN e.pn ELSE e.cn END = h.n)
UNION ALL SELECT 'families_agree', count(*) FROM seen_nodes n LEFT JOIN family f ON f.branch = n.branch WHERE f.family IS DISTINCT FROM n.family"""


@query(_sql(_CHECKS, _EVENTS + ",\nseen_nodes AS (SELECT t AS time, node, branch, label, family FROM nodes),\nseen_edges AS (SELECT t AS time, pn, cn, event, gap FROM edges)"))
def quality_checks(spark, d):
    graph = _tracked(spark, d)[2]
    return quality.structure_checks(graph.nodes, graph.edges, graph.events, graph.family_map)


_DAMAGED = """,
seen_nodes AS (SELECT t AS time, node, branch, label, CASE WHEN node % 17 = 0 THEN family + 1 ELSE family END AS family FROM nodes WHERE node % 9 <> 0 UNION ALL SELECT t, node, branch, label, family FROM nodes WHERE node % 50 = 1),
seen_edges AS (SELECT t AS time, pn, cn, event, CASE WHEN cn % 5 = 0 THEN gap + 1 ELSE gap END AS gap FROM edges WHERE cn % 11 <> 0)"""


@query(_sql(_CHECKS, _EVENTS + _DAMAGED))
def damaged_checks(spark, d):
    """What every check finds in a catalog of which nodes are lost or twice, edges lost or wrong, and families wrong."""
    graph = _tracked(spark, d)[2]
    nodes = graph.nodes.where("node_id % 9 <> 0").withColumn("family_id", F.expr("if(node_id % 17 = 0, family_id + 1, family_id)")).unionByName(graph.nodes.where("node_id % 50 = 1"))
    edges = graph.edges.where("child_node_id % 11 <> 0").withColumn("gap", F.expr("if(child_node_id % 5 = 0, gap + 1, gap)"))
    return quality.structure_checks(nodes, edges, graph.events, graph.family_map)


def _structures(name: str, links: str) -> str:
    return f""",
{name}_l AS ({links}),
{name}_g AS (SELECT t, label, label AS root FROM {name}_l UNION SELECT b.t, b.label, g.root FROM {name}_g g JOIN {name}_l a ON a.t = g.t AND a.label = g.label JOIN {name}_l b ON b.t = a.t AND b.child = a.child),
{name}_r AS (SELECT t, label, min(root) AS root FROM {name}_g GROUP BY t, label),
{name} AS (SELECT t, CASE WHEN count(DISTINCT label) = 1 THEN 'split' WHEN count(DISTINCT child) = 1 THEN 'merge' ELSE 'complex' END AS structure FROM (SELECT l.*, r.root FROM {name}_l l JOIN {name}_r r ON r.t = l.t AND r.label = l.label) GROUP BY t, root HAVING count(DISTINCT label) > 1 OR count(DISTINCT child) > 1)"""


@query(_sql("SELECT t AS frame, 'before_tau' AS stage, structure, count(*) AS n FROM loose GROUP BY t, structure UNION ALL SELECT t, 'after_tau', structure, count(*) FROM tight GROUP BY t, structure", _structures("loose", "SELECT t, label, child FROM cand WHERE k = 1") + _structures("tight", "SELECT t, label, child FROM good")))
def structure_audit(spark, d):
    return quality.structure_counts(_tracked(spark, d)[2].candidates).drop("sequence_id")


_TAUS = (0.35, 0.42, 0.5)


@query(f"WITH RECURSIVE {_BASE}" + "".join(_lineage(t, f"_{k}") for k, t in enumerate(_TAUS)) + " " + " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS tau, 'edge' AS kind, event, count(*) AS n FROM edges_{k} GROUP BY event UNION ALL SELECT CAST({t} AS DOUBLE), 'event', event, count(*) FROM kind_{k} GROUP BY event" for k, t in enumerate(_TAUS)))
def tau_sweep(spark, d):
    cells = cube(spark, d)
    return quality.tau_sweep(frame_rows(frames(spark), identify(cells, GRID, THRESHOLD, disk(0)), cells), OPTIONS, _TAUS, GRID)


_EVIDENCE = f""",
pair AS (SELECT c.t, p.label AS p, c.label AS c, p.area AS pa, c.area AS ca, sqrt((c.cy - p.cy) * (c.cy - p.cy) + (c.cx - p.cx) * (c.cx - p.cx)) AS far, least(p.mean, c.mean) / greatest(p.mean, c.mean, 1e-12) AS ratio, coalesce(m.n, 0) AS n FROM obj p JOIN obj c ON c.t = p.t + 1 LEFT JOIN moved m ON m.pt = p.t AND m.ct = c.t AND m.p = p.label AND m.c = c.label AND m.sy = 0 AND m.sx = 0),
evidence AS (SELECT *, far <= {OPTIONS.max_displacement} OR n > 0 AS candidate, 0.6 * (n / CAST(pa + ca - n AS DOUBLE)) + 0.25 * exp(-far / {OPTIONS.max_displacement}) + 0.15 * ratio AS score FROM pair)"""


@query(_sql("SELECT t - 1 AS parent_frame, p AS parent_label, t AS child_frame, c AS child_label, candidate, round(score, 6) AS score, round(far, 6) AS distance, round(n / CAST(pa + ca - n AS DOUBLE), 6) AS raw_iou, round(n / CAST(pa AS DOUBLE), 6) AS parent_coverage, round(n / CAST(ca AS DOUBLE), 6) AS child_coverage FROM evidence", _EVIDENCE))
def pair_evidence(spark, d):
    """All pairs of objects of all following frames, pairs outside of all gates too."""
    cells = cube(spark, d)
    labels = identify(cells, GRID, THRESHOLD, disk(0))
    found = quality.pair_evidence(objects.object_table(labels, cells), labels, OPTIONS, range(1, FRAMES))
    return found.drop("sequence_id").withColumns({c: F.round(c, 6) for c in ("score", "distance", "raw_iou", "parent_coverage", "child_coverage")})


@query(
    _sql(
        f"""SELECT v.t - 1 AS parent_frame, v.p AS parent_label, v.t AS child_frame, v.c AS child_label, e.event AS edge_event, CASE WHEN e.event IS NOT NULL THEN 'accepted_' || e.event WHEN NOT v.candidate THEN 'outside_all_candidate_gates' WHEN v.score < {OPTIONS.tau} THEN 'below_score_threshold'
WHEN EXISTS (SELECT 1 FROM edges u WHERE u.t = v.t AND u.time = v.t - 1 AND u.label = v.p) OR EXISTS (SELECT 1 FROM edges u WHERE u.t = v.t AND u.child = v.c) THEN 'endpoint_used_by_other_edge' ELSE 'eligible_but_not_assigned' END AS reason
FROM evidence v LEFT JOIN edges e ON e.t = v.t AND e.time = v.t - 1 AND e.label = v.p AND e.child = v.c""",
        _EVIDENCE,
    )
)
def pair_decisions(spark, d):
    cells, labels, graph = _tracked(spark, d)
    evidence = quality.pair_evidence(objects.object_table(labels, cells), labels, OPTIONS, range(1, FRAMES))
    found = quality.pair_decisions(evidence, quality.named_edges(graph.edges, graph.nodes), OPTIONS.tau)
    return found.select("parent_frame", "parent_label", "child_frame", "child_label", "edge_event", "reason")


def _two(spark, d) -> tuple[DataFrame, DataFrame]:
    """Named edges with two values of tau."""
    cells = cube(spark, d)
    labels = identify(cells, GRID, THRESHOLD, disk(0))
    out = []
    for tau in _TAUS[::2]:
        options = TrackOptions(**{f: getattr(OPTIONS, f) for f in OPTIONS.__dataclass_fields__} | {"tau": tau})
        graph = track(cells, frames(spark), labels, GRID, options)
        out.append(quality.named_edges(graph.edges, graph.nodes))
    return out[0], out[1]


_BOTH = f"WITH RECURSIVE {_BASE}{_lineage(_TAUS[0], '_a')}{_lineage(_TAUS[2], '_b')},\nkeyed AS (SELECT a.score AS sa, b.score AS sb, coalesce(a.time, b.time) AS parent_frame, coalesce(a.label, b.label) AS parent_label, coalesce(a.t, b.t) AS child_frame, coalesce(a.child, b.child) AS child_label, a.event AS old_event, b.event AS new_event FROM edges_a a FULL JOIN edges_b b ON b.t = a.t AND b.time = a.time AND b.label = a.label AND b.child = a.child) "


@query(_BOTH + "SELECT parent_frame, parent_label, child_frame, child_label, old_event, new_event, CASE WHEN old_event IS NULL THEN 'added' WHEN new_event IS NULL THEN 'removed' ELSE 'changed' END AS status FROM keyed WHERE old_event IS DISTINCT FROM new_event")
def edge_diff(spark, d):
    return quality.edge_diff(*_two(spark, d)).drop("sequence_id")


@query(_BOTH + "SELECT o.t - 1 AS parent_frame, 1 AS parent_label, o.t AS child_frame, 1 AS child_label, k.old_event, k.new_event, round(k.sa, 6) AS old_score, round(k.sb, 6) AS new_score FROM (SELECT DISTINCT t FROM obj WHERE label = 1 AND t > 0) o LEFT JOIN keyed k ON k.parent_frame = o.t - 1 AND k.child_frame = o.t AND k.parent_label = 1 AND k.child_label = 1")
def focus_pairs(spark, d):
    """What became of the pair of the first objects of all following frames."""
    cells = cube(spark, d)
    labels = identify(cells, GRID, THRESHOLD, disk(0))
    some = labels.where("label = 1 and t > 0").select("sequence_id", "t").distinct()
    pairs = some.select("sequence_id", (F.col("t") - 1).alias("parent_frame"), F.lit(1).alias("parent_label"), F.col("t").alias("child_frame"), F.lit(1).alias("child_label"))
    return quality.focus_pairs(pairs, *_two(spark, d)).drop("sequence_id").withColumns({c: F.round(c, 6) for c in ("old_score", "new_score")})


@query(_sql("SELECT t, label, branch AS branch_id FROM nodes"))
def object_ids(spark, d):
    _, labels, graph = _tracked(spark, d)
    return quality.object_ids(labels, branch_cells(labels, graph.nodes)).drop("sequence_id")


@query(_sql("SELECT p.t, p.label AS parent_label, c.label AS child_label FROM nodes p JOIN nodes c ON c.t = p.t + 1 AND c.branch = p.branch"))
def same_id_links(spark, d):
    _, labels, graph = _tracked(spark, d)
    return quality.same_id_links(labels, branch_cells(labels, graph.nodes))[0].drop("sequence_id")


@query(_sql("SELECT DISTINCT frame FROM (SELECT unnest([0, 24, 48, 71, 95, 119]) AS frame UNION ALL SELECT min(t) FROM happened GROUP BY event UNION ALL SELECT min(t) FROM edges WHERE gap > 0) WHERE frame IS NOT NULL", _EVENTS))
def sample_frames(spark, d):
    graph = _tracked(spark, d)[2]
    return spark.createDataFrame([(t,) for t in quality.sample_frames(FRAMES, graph.events, graph.edges)], "frame long")


@query(_sql("SELECT t, label AS parent_label, child AS child_label, round(max(score), 6) AS score FROM cand WHERE k = 1 GROUP BY ALL"))
def deduped_links(spark, d):
    """Every candidate, once as it is and once with half its score: the better one is kept."""
    c = _tracked(spark, d)[2].candidates.select("sequence_id", F.col("frame").alias("t"), "parent_label", "child_label", "score")
    return matching.dedupe_links(c.withColumn("score", F.col("score") / 2).unionByName(c)).select("t", "parent_label", "child_label", _r("score"))


_SMALL = f"""still AS (SELECT c.t, p.label AS p, c.label AS c, 0.6 * (coalesce(m.n, 0) / CAST(p.area + c.area - coalesce(m.n, 0) AS DOUBLE)) + 0.25 * exp(-sqrt((c.cy - p.cy) * (c.cy - p.cy) + (c.cx - p.cx) * (c.cx - p.cx)) / {OPTIONS.max_displacement}) + 0.15 * (least(p.mean, c.mean) / greatest(p.mean, c.mean, 1e-12)) AS s
  FROM obj p JOIN obj c ON c.t = p.t + 1 LEFT JOIN moved m ON m.pt = p.t AND m.ct = c.t AND m.p = p.label AND m.c = c.label AND m.sy = 0 AND m.sx = 0
  WHERE (c.cy - p.cy) * (c.cy - p.cy) + (c.cx - p.cx) * (c.cx - p.cx) <= {OPTIONS.max_displacement ** 2} OR m.n > 0),
able AS (SELECT *, dense_rank() OVER (PARTITION BY t ORDER BY p) AS i FROM still WHERE s >= {OPTIONS.tau}),
ways AS (SELECT DISTINCT t, CAST(0 AS BIGINT) AS i, CAST([] AS INTEGER[]) AS ps, CAST([] AS INTEGER[]) AS cs, 0.0::DOUBLE AS s FROM able
  UNION ALL SELECT w.t, w.i + 1, CASE WHEN a.c IS NULL THEN w.ps ELSE list_append(w.ps, a.p) END, CASE WHEN a.c IS NULL THEN w.cs ELSE list_append(w.cs, a.c) END, w.s + coalesce(a.s, 0)
  FROM ways w JOIN (SELECT t, i, p, c, s FROM able UNION ALL SELECT DISTINCT t, i, p, NULL, NULL FROM able) a ON a.t = w.t AND a.i = w.i + 1 WHERE a.c IS NULL OR NOT list_contains(w.cs, a.c)),
best AS (SELECT t, arg_max(ps, s) AS ps, arg_max(cs, s) AS cs FROM (SELECT w.* FROM ways w JOIN (SELECT t, max(i) AS i FROM able GROUP BY t) m ON m.t = w.t AND m.i = w.i) GROUP BY t)"""


@query(f"WITH RECURSIVE {_BASE},\n{_SMALL} SELECT t, unnest(ps) AS parent_label, unnest(cs) AS child_label FROM best")
def assigned_links(spark, d):
    """The one-to-one choice of greatest total score among the still candidates of each frame; in SQL by all ways to choose."""
    cells = cube(spark, d)
    labels = identify(cells, GRID, THRESHOLD, disk(0))
    links = still_candidates(objects.object_table(labels, cells), labels, OPTIONS)
    return matching.assign_links(links, OPTIONS.tau, ("t",)).drop("score")


# ---------------------------------------------------------------- sources and tables


def _accumulated(spark: SparkSession, d: str) -> DataFrame:
    """(t, y, x, rain): running totals of every cell in every frame; what no event has is 0."""
    from pyspark.sql import Window

    cells = cube(spark, d).where("valid").select("t", "y", "x", F.round(F.col("rain") * 100).cast("long").alias("cents"))
    every = spark.range(FRAMES * SIDE * SIDE).selectExpr(f"id div {SIDE * SIDE} AS t", f"int(id div {SIDE} % {SIDE}) AS y", f"int(id % {SIDE}) AS x")
    total = F.sum(F.coalesce("cents", F.lit(0))).over(Window.partitionBy("y", "x").orderBy("t"))
    return every.join(cells, ["t", "y", "x"], "left").select("t", "y", "x", total.alias("rain"))


_INCREMENTS = f"WITH RECURSIVE {_BASE} SELECT t - 1 AS t, y, x, CAST(cents AS BIGINT) AS increment FROM cells WHERE valid AND t > 0 AND cents > 0"


@query(_INCREMENTS)
def checked_increments(spark, d):
    """Increments of totals of all cells, with the guards against resets, gaps and negative amounts."""
    found = preprocess.difference_cumulative(_accumulated(spark, d).withColumn("sequence_id", F.lit("events")))
    return found.where("rain > 0").select((F.col("t") - 1).alias("t"), "y", "x", F.col("rain").cast("long").alias("increment"))


@query(_INCREMENTS)
def many_files(spark, d):
    """The same from five files of 24 samples, whose indices begin anew: kind told by name and unit, differenced across files."""
    values = _accumulated(spark, d).select(F.format_string("part-%03d", F.floor(F.col("t") / 24)).alias("path"), (F.col("t") % 24).alias("sample"), "y", "x", "rain")
    samples = values.select("path", "sample").distinct().withColumn("valid_time", F.lit(None).cast("timestamp_ntz"))
    cells, _ = read_precipitation(values, samples, "RAINNC", "mm", origin="2024-01-01 00:00:00")
    return cells.where("rain > 0").select("t", "y", "x", F.col("rain").cast("long").alias("increment"))


@query(f"WITH {_BASE.split(',' + chr(10) + 'wet AS')[0]} SELECT t, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(t), '%Y-%m-%d %H:%M') AS interval_start, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(t + 1), '%Y-%m-%d %H:%M') AS interval_end FROM (SELECT unnest(generate_series((SELECT min(t) FROM ev), (SELECT max(t) FROM ev))) AS t)")
def index_times(spark, d):
    found = preprocess.index_frames(frames_of_events(spark, d).select("sequence_id", F.col("t").alias("sample_index")), origin="2024-01-01 00:00:00")
    return found.select("t", *(F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("interval_start", "interval_end")))


@query("SELECT event_id, strftime(date_trunc('second', ts), 'x_%Y-%m-%d_%H:%M:%S.nc') AS path, strftime(ts, '%Y-%m-%d %H:%M:%S') AS named, strftime(ts, '%Y-%m-%d %H:%M:%S') AS inside, 'mm/h' AS unit, substr(event_type, 1, 2) AS kind FROM events")
def stamps(spark, d):
    """Times read back from file names and from inside of files, plain unit names."""
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd_HH:mm:ss")
    rows = e.select("event_id", F.concat(F.lit("x_"), text, F.lit(".nc")).alias("path"), text.alias("times"), F.lit("mm / H").alias("u"), F.substring("event_type", 1, 2).alias("kind"))
    return rows.select("event_id", "path", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n) for n, c in (("named", stamp_in_name("path")), ("inside", internal_stamp("times")))), unit_name("u").alias("unit"), "kind")


@query(f"""WITH RECURSIVE {_BASE} SELECT t, sha256(string_agg(y || ',' || x || ',' || CAST(cents / 100.0 AS DOUBLE) || ',' || valid, ';' ORDER BY y, x)) AS sha256 FROM cells GROUP BY t""")
def frame_hashes(spark, d):
    return quality.with_frame_hash(cube(spark, d)).drop("sequence_id")


@query(f"WITH RECURSIVE {_BASE} SELECT t, label, count(*) AS n, string_agg(y || ':' || x, ' ' ORDER BY y, x) AS pixels FROM lab GROUP BY t, label")
def object_pixels(spark, d):
    cells = cube(spark, d)
    found = objects.object_table(identify(cells, GRID, THRESHOLD, disk(0)), cells, pixels=True)
    return found.select("t", "label", F.size("pixels").alias("n"), F.array_join(F.transform("pixels", lambda p: F.concat_ws(":", p["y"], p["x"])), " ").alias("pixels"))


@query(f"WITH RECURSIVE {_BASE} SELECT c.t, p.label AS parent_label, c.label AS child_label FROM obj p JOIN obj c ON c.t = p.t + 2 WHERE least(p.y1 + 1, c.y1) > greatest(p.y0 + 1, c.y0) AND least(p.x1 - 2, c.x1) > greatest(p.x0 - 2, c.x0)")
def moved_boxes(spark, d):
    """Boxes that overlap two frames later, the parent's moved by a row down and two columns back."""
    cells = cube(spark, d)
    found = candidates.boxes_overlap(objects.object_table(identify(cells, GRID, THRESHOLD, disk(0)), cells), 5, 2, (1, -2))
    return found.select("t", F.col("p_label").alias("parent_label"), F.col("c_label").alias("child_label"))


@query(f"WITH RECURSIVE {_BASE}, ar AS (SELECT t, label, count(*) AS a FROM lab GROUP BY t, label) SELECT m.ct AS t, m.p AS parent_label, m.c AS child_label, m.n AS common, round(m.n / CAST(p.a + c.a - m.n AS DOUBLE), 6) AS iou FROM moved m JOIN ar p ON p.t = m.pt AND p.label = m.p JOIN ar c ON c.t = m.ct AND c.label = m.c WHERE m.ct = m.pt + 1 AND m.sy = 1 AND m.sx = -2")
def moved_overlap(spark, d):
    """Cells in common with the parent's moved by a row down and two columns back."""
    found = candidates.pixel_overlap(identify(cube(spark, d), GRID, THRESHOLD, disk(0)), 1, (1, -2))
    return found.select("t", "parent_label", "child_label", "common", _r("iou"))


@query(_sql("SELECT c.node AS node_id, CAST(round_even((c.cy - p.cy) / (c.t - p.t) * 2, 0) AS INTEGER) AS shift_y, CAST(round_even((c.cx - p.cx) / (c.t - p.t) * 2, 0) AS INTEGER) AS shift_x FROM edges e JOIN nodes p ON p.node = e.pn JOIN nodes c ON c.node = e.cn WHERE p.branch = c.branch"))
def motion_shifts(spark, d):
    """Whole cells that an object is expected to move in two frames."""
    graph = _tracked(spark, d)[2]
    n = graph.nodes.select("node_id", "time", "branch_id", "centroid_y", "centroid_x")
    p = n.select(*(F.col(c).alias(f"p_{c}") for c in n.columns))
    rows = graph.edges.select("parent_node_id", "child_node_id").join(p, F.col("parent_node_id") == F.col("p_node_id")).join(n, F.col("child_node_id") == F.col("node_id")).where("branch_id = p_branch_id")
    speed = lambda a: (F.col(f"centroid_{a}") - F.col(f"p_centroid_{a}")) / (F.col("time") - F.col("p_time"))
    return rows.select("node_id", candidates.motion_shift(speed("y"), 2).alias("shift_y"), candidates.motion_shift(speed("x"), 2).alias("shift_x"))


@query(_sql(f"SELECT {_NODES} FROM nodes"))
def published_catalog(spark, d):
    """The objects of two chunks, written as CSV parts with states, combined into a catalog and read again."""
    import uuid

    matching.shared_checkpoints(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/catalog-{uuid.uuid4().hex}"
    cells = cube(spark, d)
    labels, whole, states, parts = identify(cells, GRID, THRESHOLD, disk(0)), frames(spark), None, []
    for k, span in enumerate(("t < 60", "t >= 60")):
        graph = track(cells.where(span), whole.where(span), labels.where(span), GRID, OPTIONS, states)
        states = graph.states
        parts.append(f"{place}/part{k}")
        write_part(spark, parts[-1], graph, {"part": k})
    finalize_catalog(spark, parts, f"{place}/catalog")
    n = spark.read.parquet(f"{place}/catalog/objects")
    whole_numbers = ("time", "node_id", "branch_id", "family_id", "local_label", "area_cells", "y_start", "y_stop", "x_start", "x_stop")
    return n.select(*whole_numbers, *(_r(c) for c in ("centroid_y", "centroid_x", "mean_intensity", "max_intensity", "precipitation_sum")))


# ---------------------------------------------------------------- files


def _folder(spark: SparkSession, name: str) -> str:
    """A new name in the folder that driver and executors share."""
    import uuid

    matching.shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH RECURSIVE {_BASE}, gone AS (SELECT DISTINCT c.t - v.d AS t, c.y, c.x FROM cells c, (VALUES (0), (1)) v(d) WHERE NOT c.valid AND c.t - v.d BETWEEN 0 AND {FRAMES - 2})
SELECT t, y, x, CAST(NULL AS BIGINT) AS increment, false AS valid FROM gone UNION ALL
SELECT c.t - 1, c.y, c.x, CAST(c.cents AS BIGINT), true FROM cells c WHERE c.valid AND c.t > 0 AND c.cents > 0 AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.t = c.t - 1 AND g.y = c.y AND g.x = c.x)""")
def series_increments(spark, d):
    """Running totals, written as array files of 1 to 57 frames, read back as one series: differenced by each split, with no shuffle. What a frame
    misses is missing in both increments that it ends, of a whole frame too."""
    missing = cube(spark, d).where("not valid").select("t", "y", "x", F.lit(float("nan")).alias("gone"))
    totals = _accumulated(spark, d).join(missing, ["t", "y", "x"], "left").withColumn("total", F.coalesce("gone", F.col("rain").cast("double")))
    folder = _folder(spark, "series")
    write_raster(totals, "total", GRID, FRAMES, folder, "float64", cuts=(0, 1, 38, 43, 100))
    cells, _, _ = read_series(spark, folder, "RAINNC", unit="mm", origin="2024-01-01 00:00:00", samples_per_task=7, missing_frames="keep")
    return cells.select("t", "y", "x", F.when(F.col("valid"), F.col("rain").cast("long")).alias("increment"), "valid")


@query(_sql("SELECT l.t, l.y, l.x, CAST(l.label AS BIGINT) AS label, CAST(n.branch AS BIGINT) AS branch_id FROM lab l JOIN nodes n ON n.t = l.t AND n.label = l.label"))
def dense_rasters(spark, d):
    """Label and branch rasters, written as dense arrays and read back."""
    _, labels, graph = _tracked(spark, d)
    found = []
    for name, rows, column, kind in (("labels", labels, "label", "int32"), ("branches", branch_cells(labels, graph.nodes), "branch_id", "int64")):
        folder = _folder(spark, name)
        write_raster(rows, column, GRID, FRAMES, folder, kind)
        found.append(read_raster(spark, folder).withColumnRenamed("value", column))
    return found[0].join(found[1], ["t", "y", "x"], "full")


@query(_sql(f"SELECT {_NODES} FROM nodes"))
def resumed_nodes(spark, d):
    """Objects of the catalog of a run over array files (in hundredths) that stopped after 50 frames and was resumed with larger chunks."""
    missing = cube(spark, d).select("t", "y", "x", F.when(F.col("valid"), F.round(F.col("rain") * 100).cast("double")).otherwise(F.lit(float("nan"))).alias("cents"))
    folder, out = _folder(spark, "rates"), _folder(spark, "run")
    write_raster(missing, "cents", GRID, FRAMES, folder, "float64", cuts=(0, 1, 38, 43, 100))
    run = Run(folder, "rain_rate", (("rain_kind", "rate"), ("unit", "mm/h"), ("sequence_id", "events"), ("missing_frames", "keep")), THRESHOLD * 100, 0, 1, OPTIONS)
    track_series(spark, run, out, 50, most_chunks=1)
    track_series(spark, run, out, 70, resume=True)
    n = spark.read.parquet(f"{out}/catalog/objects")
    whole = ("time", "node_id", "branch_id", "family_id", "local_label", "area_cells", "y_start", "y_stop", "x_start", "x_stop")
    return n.select(*whole, _r("centroid_y"), _r("centroid_x"), *(F.round(F.col(c) / 100, 6).alias(c) for c in ("mean_intensity", "max_intensity", "precipitation_sum")))


# ---------------------------------------------------------------- many sequences

#: The cube cut into eight sequences of so many frames. In SQL they stand one after another, with five dry frames between two.
SPAN = 15
_T = f"date_diff('second', TIMESTAMP '2024-01-01', ts) // {STEP}"
_MANY = _GRAPH.replace(f"{_T} AS t", f"{_T} + 5 * ({_T} // {SPAN}) AS t").replace(f"step < {FRAMES - 1}", f"step < {FRAMES + 5 * (FRAMES // SPAN)}")


@query(f"""WITH RECURSIVE {_MANY} SELECT 's' || (e.t // {SPAN + 5}) AS sequence_id, e.t % {SPAN + 5} AS time, e.pn - f.first + 1 AS parent_node_id, e.cn - f.first + 1 AS child_node_id, e.event, e.gap, round(e.score, 6) AS score, round(e.iou_adv, 6) AS advected_iou
FROM edges e JOIN (SELECT t // {SPAN + 5} AS s, min(node) AS first FROM obj GROUP BY 1) f ON f.s = e.t // {SPAN + 5}""")
def track_many(spark, d):
    """Edges of eight sequences that are tracked side by side, numbers beginning anew in each."""
    apart = lambda df: df.withColumn("sequence_id", F.concat(F.lit("s"), F.expr(f"t div {SPAN}"))).withColumn("t", F.col("t") % SPAN)
    cells = apart(cube(spark, d))
    graph = track(cells, apart(frames(spark)), identify(cells, GRID, THRESHOLD, disk(0)), GRID, OPTIONS)
    return graph.edges.select("sequence_id", "time", "parent_node_id", "child_node_id", "event", "gap", _r("score"), _r("advected_iou"))
