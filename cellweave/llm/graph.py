"""Connected components and blocked comparison within candidate clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    Randomised contraction: each vertex joins its neighbour of least hash, edges are renamed,
    and so on until none is left; each round keeps an expected constant share of the vertices.
    Every round is written to the shared folder; nothing goes to the driver but whether edges are left.
    """
    spark = edges.sparkSession
    left, path = scratch_table(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    paths: list[str] = []
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = left.union(left.select("b", "a"))
        step = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("id"), F.least(F.col("m"), rank("a")).getField("v").alias("to"))
        step, place = scratch_table(step, "step")
        paths.append(place)
        renamed = left.join(step.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
        last = path
        left, path = scratch_table(renamed.select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct(), "edges")
        discard(spark, last)
        steps.append(step)
    if not steps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    ends = steps[0]
    for step in steps[1:]:
        ends = ends.join(step.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    ends, place = scratch_table(ends, "ends")
    least = ends.groupBy("to").agg(F.min("id").alias("component"))
    out, _ = scratch_table(ends.join(least, "to").select("id", "component"), "components")
    discard(spark, path, place, *paths)
    return out


#: Ways in which the rows of one group are dealt to tasks when they are joined with what is known of it.
WAYS = 32


def spread_join(rows: DataFrame, table: DataFrame, key: str, deal: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key``, without all rows of a key in one task."""
    ways = table.withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WAYS - 1).cast("long"))))
    return rows.withColumn("way", F.pmod(F.col(deal), F.lit(WAYS).cast("long"))).join(ways, [key, "way"]).drop("way")


def meetings(members: DataFrame, least: int = 128, most: int = 1000) -> DataFrame:
    """Copies of ``members`` with columns bi, bj, blk such that any two rows of a group g of which one is at home meet.

    Of ``members``, ``home`` is true or not, ``tie`` is a hash that deals rows to blocks, and (n_home, n_other) are the group's numbers of
    rows. Rows at home and others of a group of n rows are cut into blocks of n / 16 rows, ``least`` to ``most``; each pair of
    blocks of which one is at home becomes a unit of work of bounded size.
    """
    size = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil((F.col("n_home") + F.col("n_other")) / 16)))
    blocks = lambda n: F.ceil(F.col(n) / size).cast("int")
    held = members.where("n_home > 0 and n_home + n_other > 1").withColumns({"h": blocks("n_home"), "o": blocks("n_other")})
    held = held.withColumn("blk", F.when(F.col("home"), F.pmod("tie", "h")).otherwise(F.col("h") + F.pmod("tie", F.greatest(F.col("o"), F.lit(1)))).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("h") + F.col("o")).otherwise(F.col("h")) - 1)))
    return held.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other")).drop("other", "h", "o", "n_home", "n_other")


class Forest:
    """A spanning forest of n vertices that grows with the edges it is given: at most n - 1 are kept."""

    def __init__(self, n: int):
        self.root = list(range(n))
        self.left: list[int] = []
        self.right: list[int] = []

    def _find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            x, y = self._find(a), self._find(b)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.left.append(a)
                self.right.append(b)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph of n vertices with these edges."""
    tree = Forest(n)
    tree.add(left, right)
    return np.array(tree.left, np.int64), np.array(tree.right, np.int64)
