"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c are at a squared distance of at most 2 - 2c. They are rotated (which
keeps distances) and split into blocks of few dimensions; some block's squared distance is then at most its share of
that budget, which is in proportion to its dimensions. The vectors of a label are dealt to units of bounded size in which any two of them
meet once. There each block is range-joined: bitmaps over the sorted values of each coordinate give, 64 at a time, who is
within reach in all coordinates of the block; of those, pairs within the block's budget are candidates, and the union of
all blocks' candidates is verified by cosine. What leaves a task are counts and spanning forests, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, scratch_table, sorted_groups
from .graph import connected_components, forest, meetings, spread_join

#: Most dimensions of a block.
WIDTH = 8

#: Most rows of a side of a unit; a unit of work has two.
SIDE_ROWS = 2048

#: Words of 64 pairs that are looked at together.
WORDS = 1 << 13

#: Rounding room of squared distances of unit vectors in single precision.
SLACK = 1e-5


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A seeded random rotation: spreads the variance evenly over blocks, whatever the data."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _vectors(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, double matrix) for each length of vector; rows that hold nulls, non-finite values or are zero are left out."""
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        flat = values.take(pa.array(rows)).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), int(n))
        with np.errstate(over="ignore", invalid="ignore"):
            good = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1) > 0)
        yield rows[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cuts(dims: int) -> np.ndarray:
    """Where blocks begin and end: as few as WIDTH allows, as even as can be."""
    return np.linspace(0, dims, -(-dims // WIDTH) + 1).astype(int)


def _within(left: np.ndarray, right: np.ndarray, reach: float) -> np.ndarray:
    """Bitmap (rows of ``left``, words of 64 rows of ``right``): who differs by at most ``reach`` in every column."""
    box = None
    for a, b in zip(left.T, right.T):
        order = np.argsort(b, kind="stable")
        below = np.zeros((len(b) + 1, -(-len(b) // 64)), np.uint64)  # row k: the k least of the right side
        below[np.arange(1, len(b) + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
        np.bitwise_or.accumulate(below, axis=0, out=below)
        low, high = np.searchsorted(b[order], a - reach, "left"), np.searchsorted(b[order], a + reach, "right")
        near = below[high] ^ below[low]
        box = near if box is None else box & near
    return box


def candidates(left: np.ndarray, right: np.ndarray, squared: float, same: bool = False) -> np.ndarray:
    """Which pairs of two sides of rotated vectors are within some block's share of a squared distance; with ``same``, of a side and itself,
    each pair of two once."""
    found = np.zeros((len(left), len(right)), bool)
    cuts = _cuts(left.shape[1])
    for a, b in zip(cuts, cuts[1:]):
        budget = squared * (b - a) / left.shape[1] + SLACK
        z, w = left[:, a:b], right[:, a:b]
        box = _within(z, w, np.sqrt(budget))
        per_row, box = box.shape[1], box.ravel()
        some = np.flatnonzero(box)
        for low in range(0, len(some), WORDS):
            at = some[low : low + WORDS]
            k, bit = np.nonzero(np.unpackbits(box[at].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64))
            p, q = at[k] // per_row, at[k] % per_row * 64 + bit
            new = ~found[p, q]
            if same:
                new &= p < q
            p, q = p[new], q[new]
            d = z[p] - w[q]
            near = (d * d).sum(axis=1) <= budget
            found[p[near], q[near]] = True
    return found


def _linked(work: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): rows with b null say that a has n links here; others are edges of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            ids, lab, blk, times = (group.column(n).to_numpy() for n in ("vkey", "lab", "blk", "times"))
            bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
            for rows, x in _vectors(group.column("embedding").combine_chunks()):
                u = _unit(x)
                y = u @ rotation(x.shape[1])
                i, j = (np.flatnonzero(blk[rows] == side) for side in (bi, bj))
                p, q = np.nonzero(candidates(y[i], y[j], 2 - 2 * cosine, bi == bj))
                p, q = i[p], j[q]
                for low in range(0, len(p), 1 << 16):
                    l, r = p[low : low + (1 << 16)], q[low : low + (1 << 16)]
                    good = ((u[l] * u[r]).sum(axis=1) >= cosine) & (lab[rows[l]] == lab[rows[r]])
                    if not good.any():
                        continue
                    l, r = rows[l[good]], rows[r[good]]
                    here = np.bincount(l, times[r], len(ids)) + np.bincount(r, times[l], len(ids))
                    some = np.flatnonzero(here)
                    l, r = forest(len(ids), l, r)
                    a = pa.array(np.concatenate([ids[some], ids[l]]))
                    mask = np.arange(len(some) + len(l)) < len(some)
                    n = np.concatenate([here[some].astype(np.int64), np.zeros(len(l), np.int64)])
                    yield pa.RecordBatch.from_arrays([a, pa.array(np.concatenate([np.zeros(len(some), np.int64), ids[r]]), mask=mask), pa.array(n)], ["a", "b", "n"])

    return map_batches(work, run, "a long, b long, n long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.93, id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``.

    Rows are compared when labels are equal and not null and vectors have the same length; they are
    linked if the cosine in double precision is >= ``cosine`` (0 < cosine < 1). Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing. ``n_links`` counts the other
    rows linked, equal vectors included; ``component_id`` is the smallest id that links
    reach; kept = (id = component_id). Equal vectors of a label are compared once, with their
    number of rows as weight. Rows that repeat an id count as rows of their own. Other columns are ignored.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("embedding"))
    valid = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    sound = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    # a key of label and vector; -0 counts as 0
    plain = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0)).otherwise(v).cast("double"))
    keyed = rows.withColumn("ok", valid & F.coalesce(sound, F.lit(False))).withColumn("vkey", F.when(F.col("ok"), F.xxhash64("label", plain)))
    spark = vectors.sparkSession
    distinct = keyed.where("ok").groupBy("vkey").agg(F.count("*").alias("times"), F.min("id").alias("first"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    distinct, one = scratch_table(distinct, "vectors")
    placed = distinct.select(F.xxhash64("label", F.size("embedding")).alias("g"), F.xxhash64(F.lit("label"), "label").alias("lab"), "vkey", "times", "embedding", F.lit(True).alias("home"), F.xxhash64("vkey").alias("tie"))
    counts = placed.groupBy("g").agg(F.count("*").alias("n_home"), F.lit(0).cast("long").alias("n_other"))
    work = meetings(spread_join(placed, counts, "g", "tie"), SIDE_ROWS, SIDE_ROWS).select("g", "bi", "bj", "blk", "lab", "vkey", "times", "embedding")
    seen, two = scratch_table(_linked(work.repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj"), cosine), "links")
    links = seen.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "vkey")
    # components by key; then each is named by the smallest id of its rows
    reach = connected_components(seen.where("b is not null")).withColumnRenamed("id", "vkey")
    named = distinct.select("vkey", "times", "first").join(reach, "vkey", "left").withColumn("component", F.coalesce("component", "vkey"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(names, "component").join(links, "vkey", "left").select("vkey", "component_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    named, _ = scratch_table(named, "components")
    discard(spark, one, two)
    out = keyed.select("id", "vkey").join(named, "vkey", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
