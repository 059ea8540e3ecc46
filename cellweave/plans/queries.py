"""Queries over the driver's tables, and the same in SQL.

The tables hold no gridded measurements, so a cube is made of ``events``: frames of six hours, rows by
user, columns by value; a cell is missing if any of its events is an error. Amounts are whole
hundredths, so that sums don't depend on their order.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, TrackOptions, disk
from ..operators import candidates, matching, objects, preprocess, quality
from ..operators.identify import cells_of, dilate_runs, envelope_statistics, identify, identify_envelope, runs_of, seeded_envelope, subtract_missing
from ..operators.selection import changed_rows
from ..operators.tiles import identify_tiled
from ..sources.tables import chunk_of

SIDE, FRAMES, STEP, THRESHOLD = 48, 120, 21_600, 60.0
GRID = Grid(SIDE, SIDE)
OPTIONS = TrackOptions(tau=0.35, max_displacement=6.05)  # no pair of objects is exactly so far apart

# ---------------------------------------------------------------- the cube


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table; an event outside of the frames is an error, as it would be lost."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    bounds = e.agg(F.min("ts"), F.max("ts")).first()  # from the files' footers
    start = datetime.datetime(2024, 1, 1)
    if bounds[0] is not None and not start <= bounds[0].replace(tzinfo=None) <= bounds[1].replace(tzinfo=None) < start + datetime.timedelta(seconds=STEP * FRAMES):
        raise ValueError("events outside of the frames")
    return e


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence_id, t, y, x, cents, rain, valid); an event before the first or after the last frame is an error."""
    e = events(spark, sf_dir)
    seconds = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    e = e.select(F.floor(seconds / STEP).cast("long").alias("t"), (F.col("user_id") % SIDE).cast("int").alias("y"), (F.floor("value") % SIDE).cast("int").alias("x"), F.round(F.col("value") * 100).cast("long").alias("c"), (F.col("event_type") == "error").alias("bad"))
    g = e.groupBy("t", "y", "x").agg(F.sum("c").alias("cents"), (~F.bool_or("bad")).alias("valid"))
    return g.select(F.lit("events").alias("sequence_id"), "t", "y", "x", "cents", (F.col("cents") / 100).alias("rain"), "valid")


def frames(spark: SparkSession) -> DataFrame:
    start = F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * {STEP})")
    return spark.range(FRAMES).select(F.lit("events").alias("sequence_id"), F.col("id").alias("t"), start.alias("interval_start"))


def frames_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence_id, t, interval_start): all frames from the first event's to the last one's."""
    t = F.floor(F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / STEP)
    ends = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min(t).alias("a"), F.max(t).alias("b"))
    every = ends.select(F.lit("events").alias("sequence_id"), F.explode(F.sequence("a", "b")).alias("t"))
    return every.withColumn("interval_start", F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, t * {STEP})"))


def labelled(cells: DataFrame, radius: int = 1, min_size: int = 1) -> DataFrame:
    return identify(cells, GRID, THRESHOLD, disk(radius), min_size)


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


# ---------------------------------------------------------------- pieces of SQL

_CUBE = f"""
ev AS (SELECT date_diff('second', TIMESTAMP '2024-01-01', ts) // {STEP} AS t, user_id % {SIDE} AS y, CAST(floor(value) AS BIGINT) % {SIDE} AS x, CAST(round(value * 100) AS BIGINT) AS c, event_type FROM events),
cells AS (SELECT t, y, x, CAST(sum(c) AS BIGINT) AS cents, NOT bool_or(event_type = 'error') AS valid FROM ev GROUP BY t, y, x),
frames AS (SELECT unnest(generate_series(0, {FRAMES - 1})) AS t),
wet AS (SELECT t, y, x, cents FROM cells WHERE valid AND cents >= {int(THRESHOLD * 100)}),
miss AS (SELECT t, y, x FROM cells WHERE NOT valid)"""


def _labels(radius: int = 1, min_size: int = 1, name: str = "lab", ground_from: str | None = None, adjacency: str = "abs(g.y - r.y) <= 1 AND abs(g.x - r.x) <= 1", seeds: str = "wet") -> str:
    """CTEs that end in ``name``(t, y, x, label)."""
    n = name
    ground = ground_from or f"""SELECT DISTINCT w.t, w.y + o.dy AS y, w.x + o.dx AS x FROM wet w, (SELECT dy, dx FROM (SELECT unnest(generate_series(-{radius}, {radius})) AS dy), (SELECT unnest(generate_series(-{radius}, {radius})) AS dx) WHERE dy * dy + dx * dx <= {radius * radius}) o
      WHERE w.y + o.dy BETWEEN 0 AND {SIDE - 1} AND w.x + o.dx BETWEEN 0 AND {SIDE - 1} AND NOT EXISTS (SELECT 1 FROM miss m WHERE m.t = w.t AND m.y = w.y + o.dy AND m.x = w.x + o.dx)"""
    return f""",
{n}_g AS ({ground}),
{n}_r AS (SELECT t, y, x, y * {SIDE} + x AS root FROM {n}_g UNION SELECT g.t, g.y, g.x, r.root FROM {n}_r r JOIN {n}_g g ON g.t = r.t AND {adjacency}),
{n}_c AS (SELECT t, y, x, min(root) AS root FROM {n}_r GROUP BY t, y, x),
{n}_w AS (SELECT w.t, w.y, w.x, c.root FROM {seeds} w JOIN {n}_c c ON c.t = w.t AND c.y = w.y AND c.x = w.x),
{n}_o AS (SELECT t, root, row_number() OVER (PARTITION BY t ORDER BY min(y * {SIDE} + x)) AS label FROM {n}_w GROUP BY t, root HAVING count(*) >= {min_size}),
{n} AS (SELECT w.t, w.y, w.x, CAST(o.label AS INTEGER) AS label FROM {n}_w w JOIN {n}_o o ON o.t = w.t AND o.root = w.root)"""


_OBJECTS = f""",
obj AS (SELECT l.t, l.label, count(*) AS area_cells, sum(c.cents) / 100.0 AS precipitation_sum, avg(c.cents / 100.0) AS mean_intensity, max(c.cents) / 100.0 AS max_intensity,
  sum(l.y * c.cents) / CAST(sum(c.cents) AS DOUBLE) AS centroid_y, sum(l.x * c.cents) / CAST(sum(c.cents) AS DOUBLE) AS centroid_x, min(l.y) AS y_start, max(l.y) + 1 AS y_stop, min(l.x) AS x_start, max(l.x) + 1 AS x_stop
  FROM lab l JOIN cells c ON c.t = l.t AND c.y = l.y AND c.x = l.x GROUP BY l.t, l.label)"""

_OVER = """,
ar AS (SELECT t, label, count(*) AS a FROM lab GROUP BY t, label),
ov AS (SELECT c.t, p.label AS parent_label, c.label AS child_label, count(*) AS common FROM lab p JOIN lab c ON c.t = p.t + 1 AND c.y = p.y AND c.x = p.x GROUP BY 1, 2, 3),
overlap AS (SELECT o.t, o.parent_label, o.child_label, o.common, o.common / CAST(p.a + c.a - o.common AS DOUBLE) AS iou, o.common / CAST(p.a AS DOUBLE) AS parent_coverage, o.common / CAST(c.a AS DOUBLE) AS child_coverage
  FROM ov o JOIN ar p ON p.t = o.t - 1 AND p.label = o.parent_label JOIN ar c ON c.t = o.t AND c.label = o.child_label)"""

_R = OPTIONS.max_displacement


def _candidates(elapsed: int = 1, name: str = "cand") -> str:
    reach = _R * elapsed
    return f""",
{name}_o AS (SELECT c.t, p.label AS parent_label, c.label AS child_label, count(*) AS common FROM lab p JOIN lab c ON c.t = p.t + {elapsed} AND c.y = p.y AND c.x = p.x GROUP BY 1, 2, 3),
{name}_a AS (SELECT c.t, p.label AS parent_label, c.label AS child_label, sqrt((c.centroid_y - p.centroid_y) * (c.centroid_y - p.centroid_y) + (c.centroid_x - p.centroid_x) * (c.centroid_x - p.centroid_x)) AS distance,
  coalesce(o.common, 0) AS common, p.area_cells AS pa, c.area_cells AS ca, least(p.mean_intensity, c.mean_intensity) / greatest(p.mean_intensity, c.mean_intensity, 1e-12) AS ratio
  FROM obj p JOIN obj c ON c.t = p.t + {elapsed} LEFT JOIN {name}_o o ON o.t = c.t AND o.parent_label = p.label AND o.child_label = c.label),
{name} AS (SELECT t, parent_label, child_label, {elapsed} AS elapsed, 0.6 * (common / CAST(pa + ca - common AS DOUBLE)) + 0.25 * exp(-distance / {reach}) + 0.15 * ratio AS score, common / CAST(pa + ca - common AS DOUBLE) AS raw_iou, distance,
  common / CAST(pa AS DOUBLE) AS parent_coverage, common / CAST(ca AS DOUBLE) AS child_coverage FROM {name}_a
  WHERE distance <= {reach} OR (common > 0 AND greatest(common / CAST(pa AS DOUBLE), common / CAST(ca AS DOUBLE)) >= {OPTIONS.event_overlap}))"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- sources and preprocessing


@query(f"WITH {_CUBE} SELECT t, y, x, cents, valid FROM cells")
def grid_events(spark, d):
    return cube(spark, d).select("t", "y", "x", "cents", "valid")


@query(f"""WITH {_CUBE}, acc AS (SELECT t, y, x, CAST(sum(cents) OVER (PARTITION BY y, x ORDER BY t) AS REAL) AS a FROM cells),
d AS (SELECT t, y, x, a - lag(a) OVER (PARTITION BY y, x ORDER BY t) AS increment FROM acc)
SELECT t, y, x, CAST(increment AS BIGINT) AS increment FROM d WHERE increment IS NOT NULL""")
def cumulative_difference(spark, d):
    from pyspark.sql import Window

    total = F.sum("cents").over(Window.partitionBy("y", "x").orderBy("t"))
    acc = cube(spark, d).select("sequence_id", "t", "y", "x", total.cast("float").alias("rain"))
    return preprocess.difference_cumulative(acc, check=False).select("t", "y", "x", F.col("rain").cast("long").alias("increment"))


@query(f"WITH {_CUBE} SELECT t, y, x, cents FROM wet")
def wet_mask(spark, d):
    return preprocess.wet_cells(cube(spark, d), THRESHOLD).select("t", "y", "x", "cents")


@query(f"WITH {_CUBE} SELECT t, y - 12 AS y, x - 12 AS x, cents, valid FROM cells WHERE t BETWEEN 24 AND 71 AND y BETWEEN 12 AND 35 AND x BETWEEN 12 AND 35")
def crop_window(spark, d):
    small, _ = preprocess.crop(cube(spark, d), GRID, 24)
    return preprocess.time_window(small, 24, 48, FRAMES).select("t", "y", "x", "cents", "valid")


@query(f"""WITH {_CUBE}, f AS (SELECT unnest(generate_series((SELECT min(t) FROM ev), (SELECT max(t) FROM ev))) AS t), s AS (SELECT t, t * {STEP} - lag(t * {STEP}) OVER (ORDER BY t) AS step FROM f)
SELECT count(*) AS frames, min(step) AS shortest, max(step) AS longest FROM s""")
def cadence_check(spark, d):
    found = frames_of_events(spark, d)
    preprocess.check_cadence(found, STEP / 3600)
    return preprocess.cadence(found).drop("sequence_id")


@query(f"WITH {_CUBE} SELECT t, y, x, round(cents / 100.0 / 6, 6) AS rate FROM cells WHERE valid")
def interval_rate(spark, d):
    preprocess.check_interval("interval", "m m")
    return preprocess.to_rate(cube(spark, d).where("valid"), 6.0).select("t", "y", "x", F.round("rain", 6).alias("rate"))


@query(f"WITH {_CUBE} SELECT t, y, x, CASE WHEN valid AND cents >= 6000 THEN cents / 100.0 ELSE 0 END AS rain, valid FROM cells")
def threshold_to_zero(spark, d):
    cells = cube(spark, d)
    missing = cells.withColumn("rain", F.when(F.col("valid"), F.col("rain")).otherwise(F.lit(float("nan"))))
    return preprocess.below_to_zero(preprocess.fill_missing(missing), THRESHOLD).select("t", "y", "x", "rain", "valid")


@query(f"WITH {_CUBE} SELECT t, count(*) FILTER (WHERE NOT valid) AS missing, count(*) AS seen, count(*) FILTER (WHERE NOT valid) >= {SIDE * SIDE} AS lost FROM cells GROUP BY t")
def frame_presence(spark, d):
    cells = cube(spark, d)
    preprocess.check_frames_present(cells, GRID)
    preprocess.check_amounts(cells)
    n = F.count_if(~F.col("valid"))
    return cells.groupBy("t").agg(n.alias("missing"), F.count("*").alias("seen"), (n >= SIDE * SIDE).alias("lost"))


# ---------------------------------------------------------------- identification


@query(f"WITH RECURSIVE {_CUBE}{_labels(2)} SELECT t, y, x FROM lab_g")
def dilate_disk(spark, d):
    cells = cube(spark, d)
    wide = dilate_runs(runs_of(preprocess.wet_cells(cells, THRESHOLD)), disk(2), GRID)
    return cells_of(subtract_missing(wide, preprocess.missing_cells(cells), GRID)).select("t", "y", "x")


@query(f"WITH RECURSIVE {_CUBE}{_labels()} SELECT t, y, x, label FROM lab")
def label_objects(spark, d):
    return labelled(cube(spark, d)).select("t", "y", "x", "label")


@query(f"WITH RECURSIVE {_CUBE}{_labels(2, 3)} SELECT t, y, x, label FROM lab")
def min_size_objects(spark, d):
    return labelled(cube(spark, d), 2, 3).select("t", "y", "x", "label")


@query(f"WITH RECURSIVE {_CUBE}{_labels(2, 3)} SELECT t, y, x, label FROM lab")
def tiled_objects(spark, d):
    """The same from nine tiles of each frame."""
    return identify_tiled(cube(spark, d), GRID, SIDE // 3, THRESHOLD, disk(2), 3).select("t", "y", "x", "label")


_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("precipitation_sum", "mean_intensity", "max_intensity", "centroid_y", "centroid_x"))


@query(f"WITH RECURSIVE {_CUBE}{_labels()}{_OBJECTS} SELECT t, label, area_cells, {_ROUNDED}, y_start, y_stop, x_start, x_stop FROM obj")
def object_stats(spark, d):
    cells = cube(spark, d)
    return objects.object_table(labelled(cells), cells).select("t", "label", "area_cells", *(_r(c) for c in ("precipitation_sum", "mean_intensity", "max_intensity", "centroid_y", "centroid_x")), "y_start", "y_stop", "x_start", "x_stop")


@query(f"""WITH RECURSIVE {_CUBE}{_labels()},
a AS (SELECT t, count(*) FILTER (WHERE NOT valid) AS missing, sum(cents) FILTER (WHERE valid) / 100.0 AS total, max(cents) FILTER (WHERE valid) / 100.0 AS most FROM cells GROUP BY t),
b AS (SELECT t, max(label) AS objects, count(*) AS wet FROM lab GROUP BY t)
SELECT f.t, coalesce(b.objects, 0) AS objects, round(coalesce(a.total, 0) / ({SIDE * SIDE} - coalesce(a.missing, 0)), 6) AS mean_rain_mm_h, round(coalesce(a.most, 0), 6) AS max_rain_mm_h, round(coalesce(b.wet, 0) / {SIDE * SIDE}.0, 6) AS wet_fraction, round(coalesce(a.missing, 0) / {SIDE * SIDE}.0, 6) AS missing_fraction
FROM frames f LEFT JOIN a ON a.t = f.t LEFT JOIN b ON b.t = f.t""")
def frame_stats(spark, d):
    cells = cube(spark, d)
    found = objects.frame_statistics(frames(spark), cells, labelled(cells), GRID)
    return found.select("t", "objects", *(_r(c) for c in ("mean_rain_mm_h", "max_rain_mm_h", "wet_fraction", "missing_fraction")))


@query(f"WITH {_CUBE} SELECT round(greatest(quantile_cont(cents / 100.0, 0.99), 2.0), 6) AS \"limit\" FROM cells WHERE valid AND cents > 0")
def rain_percentile(spark, d):
    return objects.rain_percentile(cube(spark, d)).select(_r("limit"))


@query(f"""WITH {_CUBE}, a AS (SELECT t, y, x, cents FROM cells), b AS (SELECT t, y, x, CASE WHEN (7 * t + 3 * y + x) % 97 = 0 THEN cents + 1 ELSE cents END AS cents FROM cells WHERE (t + 5 * y + 11 * x) % 101 <> 0)
SELECT 'left' AS side, t, y, x, cents FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'right', t, y, x, cents FROM (FROM b EXCEPT FROM a)""")
def changed_cells(spark, d):
    """What differs between the cube and one with other amounts and lost cells, found by fingerprints of buckets."""
    a = cube(spark, d).select("t", "y", "x", "cents")
    b = a.where("(t + 5 * y + 11 * x) % 101 <> 0").withColumn("cents", F.expr("cents + int((7 * t + 3 * y + x) % 97 = 0)"))
    return changed_rows(a, b, ["t", "y", "x"])


@query(f"""WITH {_CUBE}, h AS (SELECT CASE WHEN cents > 15000 THEN 16 WHEN cents = 15000 THEN 15 WHEN cents < 1000 THEN 0 ELSE CAST(floor((cents - 1000) * 15 / 14000.0) AS BIGINT) + 1 END AS bin FROM cells WHERE valid)
SELECT b.bin, count(h.bin) AS n FROM (SELECT unnest(generate_series(0, 16)) AS bin) b LEFT JOIN h ON h.bin = b.bin GROUP BY b.bin""")
def rain_histogram(spark, d):
    return objects.histogram(cube(spark, d).where("valid"), "rain", 15, 10, 150)


@query(f"WITH {_CUBE} SELECT t // 24 AS chunk, count(*) AS cells, count(DISTINCT t) AS frames FROM cells GROUP BY 1")
def chunk_frames(spark, d):
    return chunk_of(cube(spark, d), 24).groupBy("chunk").agg(F.count("*").alias("cells"), F.count_distinct("t").alias("frames"))


# ---------------------------------------------------------------- candidates


@query(f"""WITH RECURSIVE {_CUBE}{_labels()}{_OBJECTS}, p AS (SELECT c.t, p.label AS parent_label, c.label AS child_label, (c.centroid_y - p.centroid_y) * (c.centroid_y - p.centroid_y) + (c.centroid_x - p.centroid_x) * (c.centroid_x - p.centroid_x) AS d2 FROM obj p JOIN obj c ON c.t = p.t + 1)
SELECT t, parent_label, child_label, round(sqrt(d2), 6) AS distance FROM p WHERE d2 <= {_R * _R}""")
def candidate_radius(spark, d):
    cells = cube(spark, d)
    found = candidates.within_radius(objects.object_table(labelled(cells), cells), _R)
    return found.select("t", F.col("p_label").alias("parent_label"), F.col("c_label").alias("child_label"), _r("distance"))


@query(f"""WITH RECURSIVE {_CUBE}{_labels()}{_OBJECTS} SELECT c.t, p.label AS parent_label, c.label AS child_label FROM obj p JOIN obj c ON c.t = p.t + 1
WHERE least(p.y_stop, c.y_stop) > greatest(p.y_start, c.y_start) AND least(p.x_stop, c.x_stop) > greatest(p.x_start, c.x_start)""")
def bbox_overlap(spark, d):
    cells = cube(spark, d)
    found = candidates.boxes_overlap(objects.object_table(labelled(cells), cells), side=16)
    return found.select("t", F.col("p_label").alias("parent_label"), F.col("c_label").alias("child_label"))


_SHARES = "round(iou, 6) AS iou, round(parent_coverage, 6) AS parent_coverage, round(child_coverage, 6) AS child_coverage"


@query(f"WITH RECURSIVE {_CUBE}{_labels()}{_OVER} SELECT t, parent_label, child_label, common, {_SHARES} FROM overlap")
def pixel_overlap(spark, d):
    found = candidates.pixel_overlap(labelled(cube(spark, d)))
    return found.select("t", "parent_label", "child_label", "common", _r("iou"), _r("parent_coverage"), _r("child_coverage"))


_CAND = "t, parent_label, child_label, elapsed, round(score, 6) AS score, round(raw_iou, 6) AS raw_iou, round(distance, 6) AS distance, round(parent_coverage, 6) AS parent_coverage, round(child_coverage, 6) AS child_coverage"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("t", "parent_label", "child_label", "elapsed", *(_r(c) for c in ("score", "raw_iou", "distance", "parent_coverage", "child_coverage")))


@query(f"WITH RECURSIVE {_CUBE}{_labels()}{_OBJECTS}{_candidates()} SELECT {_CAND} FROM cand")
def candidate_score(spark, d):
    cells = cube(spark, d)
    labels = labelled(cells)
    return _rounded(candidates.still_candidates(objects.object_table(labels, cells), labels, OPTIONS))


@query(f"WITH RECURSIVE {_CUBE}{_labels()}{_OBJECTS}{_candidates(2)} SELECT {_CAND} FROM cand")
def gap_candidates(spark, d):
    cells = cube(spark, d)
    labels = labelled(cells)
    return _rounded(candidates.gap_candidates(objects.object_table(labels, cells), labels, OPTIONS))


@query(f"""WITH RECURSIVE {_CUBE}{_labels()}{_OBJECTS}{_candidates(2)}, k AS (SELECT t, child_label, score, row_number() OVER (PARTITION BY t, child_label ORDER BY score DESC, parent_label) AS r FROM cand),
b AS (SELECT t, child_label, max(CASE WHEN r = 1 THEN score END) AS best, max(CASE WHEN r = 2 THEN score END) AS second FROM k WHERE r <= 2 GROUP BY t, child_label)
SELECT t, child_label, round(best, 6) AS best, round(second, 6) AS second, coalesce(best - second < {OPTIONS.gap_ambiguity}, FALSE) AS ambiguous FROM b""")
def gap_ambiguity(spark, d):
    cells = cube(spark, d)
    labels = labelled(cells)
    found = matching.ambiguity(candidates.gap_candidates(objects.object_table(labels, cells), labels, OPTIONS), OPTIONS.gap_ambiguity)
    return found.select("t", "child_label", _r("best"), _r("second"), "ambiguous")


@query(f"""WITH RECURSIVE {_CUBE}{_labels()}{_OBJECTS}{_candidates()},
ln AS (SELECT t, parent_label AS p, child_label AS c FROM cand WHERE score >= 0.2),
gr AS (SELECT t, p, p AS root FROM ln UNION SELECT b.t, b.p, g.root FROM gr g JOIN ln a ON a.t = g.t AND a.p = g.p JOIN ln b ON b.t = a.t AND b.c = a.c),
rt AS (SELECT t, p, min(root) AS component FROM gr GROUP BY t, p),
al AS (SELECT l.t, l.p, l.c, r.component FROM ln l JOIN rt r ON r.t = l.t AND r.p = l.p),
sz AS (SELECT t, component, count(DISTINCT p) AS parents, count(DISTINCT c) AS children FROM al GROUP BY t, component)
SELECT a.t, a.p AS parent_label, a.c AS child_label, CAST(a.component AS BIGINT) AS component, s.parents, s.children, CASE WHEN s.parents = 1 AND s.children = 1 THEN NULL WHEN s.parents = 1 THEN 'split' WHEN s.children = 1 THEN 'merge' ELSE 'complex' END AS event
FROM al a JOIN sz s ON s.t = a.t AND s.component = a.component""")
def event_components(spark, d):
    cells = cube(spark, d)
    labels = labelled(cells)
    links = matching.event_links(candidates.still_candidates(objects.object_table(labels, cells), labels, OPTIONS), 0.2, 0.0)
    return matching.event_components(links).drop("sequence_id")


# ---------------------------------------------------------------- envelopes and comparisons

_WEAK = "SELECT t, y, x FROM cells WHERE valid AND cents >= 3000"
_ENVELOPE = f"""{_labels(0, name='lab')}{_labels(name='env', ground_from=_WEAK, seeds='env_g')},
held AS (SELECT DISTINCT e.t, e.label FROM env e JOIN lab l ON l.t = e.t AND l.y = e.y AND l.x = e.x),
named AS (SELECT t, label, CAST(row_number() OVER (PARTITION BY t ORDER BY label) AS INTEGER) AS n FROM held),
envelope AS (SELECT e.t, e.y, e.x, n.n AS label FROM env e JOIN named n ON n.t = e.t AND n.label = e.label)"""


@query(f"WITH RECURSIVE {_CUBE}{_ENVELOPE} SELECT t, y, x, label FROM envelope")
def envelope_system(spark, d):
    cells = cube(spark, d)
    return seeded_envelope(cells, labelled(cells, 0), GRID, 30.0).select("t", "y", "x", "label")


@query(f"""WITH RECURSIVE {_CUBE}{_ENVELOPE}
SELECT e.t, e.label, count(*) AS envelope_cells, count(l.label) AS core_cells, count(DISTINCT l.label) AS cores, round(sum(c.cents) / 100.0, 6) AS rain_sum, round(avg(c.cents / 100.0), 6) AS rain_mean, round(max(c.cents) / 100.0, 6) AS rain_max,
round(sum(CASE WHEN l.label IS NULL THEN 0 ELSE c.cents END) / 100.0, 6) AS core_rain_sum, round(sum(e.y * c.cents) / CAST(sum(c.cents) AS DOUBLE), 6) AS centroid_y, round(sum(e.x * c.cents) / CAST(sum(c.cents) AS DOUBLE), 6) AS centroid_x, min(e.y) AS y_start, max(e.y) + 1 AS y_stop, min(e.x) AS x_start, max(e.x) + 1 AS x_stop,
round(sum(1 + e.y / 10.0), 6) AS area_km2, round(sum(c.cents * 10 * (1 + e.y / 10.0)), 4) AS volume_rate_m3_h, round(count(l.label) / CAST(count(*) AS DOUBLE), 6) AS core_fraction
FROM envelope e JOIN cells c ON c.t = e.t AND c.y = e.y AND c.x = e.x LEFT JOIN lab l ON l.t = e.t AND l.y = e.y AND l.x = e.x GROUP BY e.t, e.label""")
def envelope_stats(spark, d):
    cells = cube(spark, d)
    cores, envelopes = identify_envelope(cells, GRID, THRESHOLD, 30.0, disk(0))
    areas = spark.range(SIDE * SIDE).selectExpr(f"int(id div {SIDE}) AS y", f"int(id % {SIDE}) AS x", f"double(1 + (id div {SIDE}) / 10) AS cell_area")
    stats, _ = envelope_statistics(cells, envelopes, cores, areas)
    rounded = {c: F.round(c, 6) for c in ("rain_sum", "rain_mean", "rain_max", "core_rain_sum", "centroid_y", "centroid_x", "area_km2", "core_fraction")}
    return stats.drop("sequence_id").withColumns(rounded | {"volume_rate_m3_h": F.round("volume_rate_m3_h", 4)})


@query(f"WITH RECURSIVE {_CUBE}{_ENVELOPE} SELECT e.t, e.label, l.label AS core_label, count(*) AS cells FROM envelope e JOIN lab l ON l.t = e.t AND l.y = e.y AND l.x = e.x GROUP BY ALL")
def envelope_membership(spark, d):
    cells = cube(spark, d)
    cores, envelopes = identify_envelope(cells, GRID, THRESHOLD, 30.0, disk(0))
    return envelope_statistics(cells, envelopes, cores)[1].drop("sequence_id")


_ARI = f"""{_labels(0, name='la')}{_labels(2, 2, name='lb')},
both_ AS (SELECT coalesce(a.t, b.t) AS t, a.label AS la, b.label AS lb FROM la a FULL JOIN lb b ON b.t = a.t AND b.y = a.y AND b.x = a.x),
joint AS (SELECT t, la, lb, count(*) AS n FROM both_ WHERE la IS NOT NULL AND lb IS NOT NULL GROUP BY t, la, lb),
tot AS (SELECT t, sum(n) AS n, sum(n * (n - 1) / 2.0) AS s FROM joint GROUP BY t),
sa AS (SELECT t, sum(k * (k - 1) / 2.0) AS s FROM (SELECT t, la, sum(n) AS k FROM joint GROUP BY t, la) GROUP BY t),
sb AS (SELECT t, sum(k * (k - 1) / 2.0) AS s FROM (SELECT t, lb, sum(n) AS k FROM joint GROUP BY t, lb) GROUP BY t),
ari AS (SELECT tot.t, tot.n, tot.s, sa.s AS a, sb.s AS b, CASE WHEN tot.n < 2 THEN NULL ELSE sa.s * sb.s / (tot.n * (tot.n - 1) / 2.0) END AS e FROM tot JOIN sa ON sa.t = tot.t JOIN sb ON sb.t = tot.t),
whole AS (SELECT t, count(DISTINCT la) AS a_objects, count(DISTINCT lb) AS b_objects, count(*) AS n FROM both_ GROUP BY t)"""


@query(f"""WITH RECURSIVE {_CUBE}{_ARI}
SELECT w.t, w.a_objects, w.b_objects, round(coalesce(a.n, 0) / CAST(w.n AS DOUBLE), 6) AS wet_mask_iou, CAST(coalesce(a.n, 0) AS BIGINT) AS common_wet_pixels,
round(CASE WHEN a.n < 2 THEN NULL WHEN (a.a + a.b) / 2 = a.e THEN 1.0 ELSE (a.s - a.e) / ((a.a + a.b) / 2 - a.e) END, 6) AS ari_common_wet FROM whole w LEFT JOIN ari a ON a.t = w.t""")
def partition_metrics(spark, d):
    cells = cube(spark, d)
    found = quality.partition_metrics(labelled(cells, 0), labelled(cells, 2, 2))
    return found.select("t", "a_objects", "b_objects", _r("wet_mask_iou"), "common_wet_pixels", _r("ari_common_wet"))


@query(f"""WITH RECURSIVE {_CUBE}{_labels()}{_OBJECTS}{_candidates()}, a AS (SELECT t, parent_label, child_label FROM cand WHERE score >= 0.2), b AS (SELECT t, parent_label, child_label FROM cand WHERE distance <= 3.05)
SELECT 'both' AS status, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def link_diff(spark, d):
    cells = cube(spark, d)
    labels = labelled(cells)
    found = candidates.still_candidates(objects.object_table(labels, cells), labels, OPTIONS)
    key = ("t", "parent_label", "child_label")
    return quality.link_diff(found.where("score >= 0.2").select(*key), found.where("distance <= 3.05").select(*key))


@query(f"WITH {_CUBE} SELECT valid, count(*) AS n FROM cells GROUP BY valid")
def value_counts(spark, d):
    return objects.value_counts(cube(spark, d), "valid")


# queries over tracked sequences add themselves
from . import lineage_queries  # noqa: E402, F401
