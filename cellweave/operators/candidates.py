"""Candidate links between objects of two frames: range joins, overlaps, scores.

The joins here have no motion memory (velocity 0, or a shift that the caller gives); the lineage
kernel adds the rest. Objects are those of ``objects.object_table``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import half_even
from ..grid import TrackOptions

FRAME = ("sequence_id", "t")


def _sides(objects: DataFrame, elapsed: int) -> tuple[DataFrame, DataFrame]:
    """Parents with the frame of their children, and children."""
    names = [c for c in objects.columns if c not in FRAME and c != "pixels"]
    p = objects.select("sequence_id", (F.col("t") + elapsed).alias("t"), *(F.col(c).alias(f"p_{c}") for c in names))
    return p, objects.select(*FRAME, *(F.col(c).alias(f"c_{c}") for c in names))


def within_radius(objects: DataFrame, radius: float, elapsed: int = 1) -> DataFrame:
    """Pairs of which the child's centroid is within ``radius`` * ``elapsed`` (inclusive) of the parent's.

    Parents go to the nine squares of that side around them, children to their own: an equality join on
    squares, then the exact distance.
    """
    if radius <= 0 or elapsed < 1:
        raise ValueError("radius must be positive and elapsed at least one")
    reach = float(radius * elapsed)
    square = lambda c: F.floor(F.col(c) / reach).cast("long")
    p, c = _sides(objects, elapsed)
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    p = p.withColumn("s", around).withColumns({"sy": square("p_centroid_y") + F.col("s.a"), "sx": square("p_centroid_x") + F.col("s.b")}).drop("s")
    c = c.withColumns({"sy": square("c_centroid_y"), "sx": square("c_centroid_x")})
    dy, dx = F.col("c_centroid_y") - F.col("p_centroid_y"), F.col("c_centroid_x") - F.col("p_centroid_x")
    return p.join(c, [*FRAME, "sy", "sx"]).where(dy * dy + dx * dx <= reach * reach).withColumn("distance", F.hypot(dy, dx)).drop("sy", "sx")


def boxes_overlap(objects: DataFrame, side: int = 64, elapsed: int = 1, shift: tuple[int, int] = (0, 0)) -> DataFrame:
    """Pairs whose half-open boxes overlap, the parent's moved by ``shift``.

    Boxes go to all squares of ``side`` that they touch; a pair is taken in the square of its overlap's corner only.
    """
    p, c = _sides(objects, elapsed)
    for axis, move in (("y", shift[0]), ("x", shift[1])):
        p = p.withColumns({f"p_{axis}_start": F.col(f"p_{axis}_start") + move, f"p_{axis}_stop": F.col(f"p_{axis}_stop") + move})

    def spread(df: DataFrame, k: str) -> DataFrame:
        for axis in "yx":
            span = F.sequence(F.floor(F.col(f"{k}_{axis}_start") / side), F.floor((F.col(f"{k}_{axis}_stop") - 1) / side))
            df = df.withColumn(f"s{axis}", F.explode(span))
        return df

    pairs = spread(p, "p").join(spread(c, "c"), [*FRAME, "sy", "sx"])
    for axis in "yx":
        low, high = F.greatest(f"p_{axis}_start", f"c_{axis}_start"), F.least(f"p_{axis}_stop", f"c_{axis}_stop")
        pairs = pairs.where((high > low) & (F.floor(low / side) == F.col(f"s{axis}")))
    return pairs.drop("sy", "sx")


def pixel_overlap(labels: DataFrame, elapsed: int = 1, shift: tuple[int, int] = (0, 0)) -> DataFrame:
    """(sequence_id, t, parent_label, child_label, common, iou, parent_coverage, child_coverage).

    Parents' cells are moved by ``shift`` and not cut at the grid's edge; shares are of the objects' own areas.
    """
    area = labels.groupBy(*FRAME, "label").agg(F.count("*").alias("area"))
    p = labels.select("sequence_id", (F.col("t") + elapsed).alias("t"), (F.col("y") + shift[0]).alias("y"), (F.col("x") + shift[1]).alias("x"), F.col("label").alias("parent_label"))
    c = labels.select(*FRAME, "y", "x", F.col("label").alias("child_label"))
    both = p.join(c, [*FRAME, "y", "x"]).groupBy(*FRAME, "parent_label", "child_label").agg(F.count("*").alias("common"))
    pa = area.select("sequence_id", (F.col("t") + elapsed).alias("t"), F.col("label").alias("parent_label"), F.col("area").alias("pa"))
    ca = area.select(*FRAME, F.col("label").alias("child_label"), F.col("area").alias("ca"))
    both = both.join(pa, [*FRAME, "parent_label"]).join(ca, [*FRAME, "child_label"])
    share = lambda n: F.col("common") / n
    return both.select(*FRAME, "parent_label", "child_label", "common", share(F.col("pa") + F.col("ca") - F.col("common")).alias("iou"), share(F.col("pa")).alias("parent_coverage"), share(F.col("ca")).alias("child_coverage"))


def intensity_ratio(a: str, b: str) -> Column:
    return F.least(a, b) / F.greatest(F.col(a), F.col(b), F.lit(1e-12))


def link_score(overlap: Column, distance: Column, radius: float, ratio: Column) -> Column:
    """0.60 overlap + 0.25 exp(-distance / max(radius, 1)) + 0.15 intensity ratio."""
    return F.lit(0.60) * overlap + F.lit(0.25) * F.exp(-distance / F.lit(max(radius, 1.0))) + F.lit(0.15) * ratio


def motion_shift(velocity: Column | str, elapsed: Column | int) -> Column:
    """Whole cells moved, halves to the even number."""
    v = F.col(velocity) if isinstance(velocity, str) else velocity
    return half_even(v * (F.lit(elapsed) if isinstance(elapsed, int) else elapsed))


def still_candidates(objects: DataFrame, labels: DataFrame, options: TrackOptions, elapsed: int = 1) -> DataFrame:
    """Candidates with velocity 0: within the radius, or overlapping by ``event_overlap`` or more of either object."""
    reach = options.max_displacement * elapsed
    keys = [*FRAME, "parent_label", "child_label"]
    near = within_radius(objects, options.max_displacement, elapsed).select(*FRAME, F.col("p_label").alias("parent_label"), F.col("c_label").alias("child_label"), F.lit(True).alias("near"))
    over = pixel_overlap(labels, elapsed)
    pairs = near.join(over, keys, "full")
    cover = F.greatest("parent_coverage", "child_coverage")
    pairs = pairs.where(F.col("near") | ((cover > 0) & (cover >= options.event_overlap)))
    p, c = _sides(objects, elapsed)
    wanted = ("label", "centroid_y", "centroid_x", "mean_intensity")
    p = p.select(*FRAME, *(f"p_{w}" for w in wanted)).withColumnRenamed("p_label", "parent_label")
    c = c.select(*FRAME, *(f"c_{w}" for w in wanted)).withColumnRenamed("c_label", "child_label")
    rows = pairs.join(p, [*FRAME, "parent_label"]).join(c, [*FRAME, "child_label"])
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    distance = F.hypot(F.col("c_centroid_y") - F.col("p_centroid_y"), F.col("c_centroid_x") - F.col("p_centroid_x"))
    score = link_score(zero("iou"), distance, reach, intensity_ratio("p_mean_intensity", "c_mean_intensity"))
    return rows.select(*keys, F.lit(elapsed).alias("elapsed"), score.alias("score"), zero("iou").alias("raw_iou"), distance.alias("distance"), zero("parent_coverage").alias("parent_coverage"), zero("child_coverage").alias("child_coverage"))


def gap_candidates(objects: DataFrame, labels: DataFrame, options: TrackOptions) -> DataFrame:
    """Candidates over 1 to ``max_gap`` missing frames, from still objects; radius grows with the time."""
    found = None
    for elapsed in range(2, options.max_gap + 2):
        one = still_candidates(objects, labels, options, elapsed)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return still_candidates(objects, labels, options, 2).where(F.lit(False))
    if options.gap_min_pixels:
        big = objects.where(F.col("area_cells") >= options.gap_min_pixels)
        found = found.join(big.select(*FRAME, F.col("label").alias("child_label")), [*FRAME, "child_label"], "left_semi")
        parents = big.select("sequence_id", F.col("t").alias("pt"), F.col("label").alias("parent_label"))
        found = found.withColumn("pt", F.col("t") - F.col("elapsed")).join(parents, ["sequence_id", "pt", "parent_label"], "left_semi").drop("pt")
    return found
