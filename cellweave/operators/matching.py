"""Matching of parents and children: components, events, assignment, ambiguity, families.

Pure functions over arrays are for the lineage kernel (one frame pair at a time); DataFrame forms of what
is relational stand below them.
"""

from __future__ import annotations

import heapq
import math
import tempfile
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def bipartite_groups(parents: Sequence[int], children: Sequence[int]) -> list[tuple[list[int], list[int], np.ndarray]]:
    """(parents, children, links) of each connected group of the given links, by its least parent."""
    p, c = np.asarray(parents, np.int64), np.asarray(children, np.int64)
    if not len(p):
        return []
    up, at_p = np.unique(p, return_inverse=True)
    uc, at_c = np.unique(c, return_inverse=True)
    group = np.arange(len(up))
    while True:  # least parent of each child, then of each parent, until nothing changes
        least = np.full(len(uc), len(up))
        np.minimum.at(least, at_c, group[at_p])
        new = group.copy()
        np.minimum.at(new, at_p, least[at_c])
        new = new[new]
        if (new == group).all():
            break
        group = new
    of_link = group[at_p]
    order = np.argsort(of_link, kind="stable")
    cuts = np.flatnonzero(np.diff(of_link[order])) + 1
    return [(np.unique(p[at]).tolist(), np.unique(c[at]).tolist(), at) for at in np.split(order, cuts)]


def best_assignment(gain: np.ndarray) -> np.ndarray:
    """Column of each row (-1: none) of the one-to-one choice of greatest total gain.

    ``gain`` is -inf where a pair is not allowed; leaving a row out gains 0. Shortest augmenting paths
    with potentials, row by row; among equally good choices the first column found by order is kept, so
    results don't depend on anything but the matrix.
    """
    n, m = gain.shape
    far = 1e6
    cost = np.full((n, m + n), far)
    cost[:, :m] = np.where(np.isfinite(gain), -gain, far)
    cost[np.arange(n), m + np.arange(n)] = 0.0  # its own place outside
    row_of = np.full(m + n, -1)
    u, v = np.zeros(n), np.zeros(m + n)
    for start in range(n):
        dist, back, done = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n, bool)
        row, reached, base = start, -1, 0.0
        while True:
            here = base + cost[row] - u[row] - v
            better = ~done & (here < dist - 1e-15)
            dist[better], back[better] = here[better], reached
            open_ = np.where(done, np.inf, dist)
            column = int(np.argmin(open_))
            base = open_[column]
            done[column] = True
            reached = column
            if row_of[column] < 0:
                break
            row = row_of[column]
        u[start] += base
        seen = np.flatnonzero(done & (np.arange(m + n) != reached))
        u[row_of[seen]] += base - dist[seen]
        v[seen] -= base - dist[seen]
        while True:  # turn the path round
            previous = back[reached]
            row_of[reached] = start if previous < 0 else row_of[previous]
            if previous < 0:
                break
            reached = previous
    out = np.full(n, -1)
    for column in range(m):
        if row_of[column] >= 0 and np.isfinite(gain[row_of[column], column]):
            out[row_of[column]] = column
    return out


def sparse_assignment(row: np.ndarray, column: np.ndarray, gain: np.ndarray) -> list[int]:
    """Positions of the links of ``best_assignment``, of links (row, column) that are there once each: no matrix is made.

    The same paths, from a heap of (length, column), over the links that a search reaches; equal choices go to the first column, too.
    """
    order = np.lexsort((column, row))
    n, m = int(row.max(initial=-1)) + 1, int(column.max(initial=-1)) + 1
    cuts = np.searchsorted(row[order], np.arange(n + 1)).tolist()
    to, cost, order = column[order].tolist(), (-gain[order]).tolist(), order.tolist()
    u, v, row_of = [0.0] * n, [0.0] * (m + n), [-1] * (m + n)
    for start in range(n):
        dist: dict[int, float] = {}
        back: dict[int, int] = {}
        done: dict[int, None] = {}
        heap: list[tuple[float, int]] = []
        at, reached, base = start, -1, 0.0
        while True:
            for k in range(cuts[at], cuts[at + 1] + 1):
                c, w = (to[k], cost[k]) if k < cuts[at + 1] else (m + at, 0.0)  # its own place outside comes last
                here = base + w - u[at] - v[c]
                if c not in done and here < dist.get(c, math.inf) - 1e-15:
                    dist[c], back[c] = here, reached
                    heapq.heappush(heap, (here, c))
            while True:
                base, reached = heapq.heappop(heap)
                if reached not in done and dist[reached] == base:
                    break
            if row_of[reached] < 0:
                break
            done[reached] = None
            at = row_of[reached]
        u[start] += base
        for c in done:
            u[row_of[c]] += base - dist[c]
            v[c] -= base - dist[c]
        while back[reached] >= 0:  # turn the path round
            row_of[reached] = row_of[back[reached]]
            reached = back[reached]
        row_of[reached] = start
    return [order[k] for r in range(n) for k in range(cuts[r], cuts[r + 1]) if row_of[to[k]] == r]


def assign(parents: Sequence[int], children: Sequence[int], scores: Sequence[float], minimum: float) -> list[int]:
    """Positions of the links chosen: one to one, greatest total score, none below ``minimum``.

    By child, then parent. Of links between the same two the best counts (the first if equal).
    """
    p, c, s = np.asarray(parents, np.int64), np.asarray(children, np.int64), np.asarray(scores, float)
    able = np.flatnonzero(s >= minimum)
    able = able[np.lexsort((able, -s[able], c[able], p[able]))]  # the best of each two comes first
    if len(able):
        able = able[np.r_[True, (np.diff(p[able]) != 0) | (np.diff(c[able]) != 0)]]
    chosen = []
    for ps, cs, links in bipartite_groups(p[able], c[able]):
        links = able[links]
        if len(links) == 1:
            chosen.append(int(links[0]))
            continue
        found = sparse_assignment(np.searchsorted(ps, p[links]), np.searchsorted(cs, c[links]), s[links])
        chosen += links[found].tolist()
    return sorted(chosen, key=lambda k: (c[k], p[k]))


def ambiguous_children(children: Sequence[int], scores: Sequence[float], margin: float) -> set[int]:
    """Children whose best two links differ by less than ``margin``."""
    best: dict[int, list[float]] = {}
    for c, s in zip(children, scores):
        top = best.setdefault(int(c), [])
        top.append(s)
        top.sort(reverse=True)
        del top[2:]
    return {c for c, top in best.items() if len(top) == 2 and top[0] - top[1] < margin}


def event_kind(n_parents: int, n_children: int) -> str | None:
    """None for one parent and one child: no event."""
    if n_parents == n_children == 1:
        return None
    return "split" if n_parents == 1 else "merge" if n_children == 1 else "complex"


# ---------------------------------------------------------------- as DataFrames


def event_links(candidates: DataFrame, tau: float, event_overlap: float) -> DataFrame:
    """Candidates that can be part of an event."""
    return candidates.where((F.col("score") >= tau) & (F.greatest("parent_coverage", "child_coverage") >= event_overlap))


def event_components(links: DataFrame, key: Sequence[str] = ("sequence_id", "t")) -> DataFrame:
    """(key, parent_label, child_label, component, parents, children, event) of each link: component is its
    least parent. The links of a frame pair, which objects of one frame bound, are one group."""
    import pandas as pd

    kinds = dict(links.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ps, cs, at in bipartite_groups(pdf.parent_label.to_numpy(), pdf.child_label.to_numpy()):
            part = pdf.iloc[at][[*key, "parent_label", "child_label"]].copy()
            part["component"], part["parents"], part["children"], part["event"] = ps[0], len(ps), len(cs), event_kind(len(ps), len(cs))
            out.append(part)
        return pd.concat(out)

    schema = ", ".join(f"{k} {kinds[k]}" for k in (*key, "parent_label", "child_label")) + ", component long, parents long, children long, event string"
    return links.select(*key, "parent_label", "child_label").groupBy(*key).applyInPandas(run, schema)


def top_two(candidates: DataFrame, key: Sequence[str] = ("sequence_id", "t", "child_label")) -> DataFrame:
    """The best two links of each child, with their rank."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "parent_label")
    return candidates.withColumn("rank", F.row_number().over(order)).where("rank <= 2")


def ambiguity(candidates: DataFrame, margin: float, key: Sequence[str] = ("sequence_id", "t", "child_label")) -> DataFrame:
    """(key, best, second, ambiguous): whether the best two differ by less than ``margin``."""
    best = F.max(F.when(F.col("rank") == 1, F.col("score")))
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    return top_two(candidates, key).groupBy(*key).agg(best.alias("best"), second.alias("second"), F.coalesce(best - second < margin, F.lit(False)).alias("ambiguous"))


def dedupe_links(candidates: DataFrame, key: Sequence[str] = ("sequence_id", "t", "parent_label", "child_label")) -> DataFrame:
    """One link per pair: the best."""
    rest = [c for c in candidates.columns if c not in key]
    best = candidates.groupBy(*key).agg(F.max(F.struct("score", *[c for c in rest if c != "score"])).alias("b"))
    return best.select(*key, *(F.col(f"b.{c}").alias(c) for c in rest))


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir. Where it is unset, a session that runs on this machine gets a temporary
    one; on a cluster, whose executors couldn't see that, it's an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cellweave-")
    sc.setCheckpointDir(found)


def families(branches: DataFrame, links: DataFrame) -> DataFrame:
    """(sequence_id, branch_id, family_id): the least branch that links (sequence_id, a, b) reach.

    Least labels spread along links and jump over what they reach; each round is cut off by checkpoint().
    """
    shared_checkpoints(branches.sparkSession)
    both = links.select("sequence_id", "a", "b").union(links.select("sequence_id", F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    state = branches.select("sequence_id", "branch_id", F.col("branch_id").alias("family_id")).distinct().checkpoint()
    while True:
        offered = both.join(state.select("sequence_id", F.col("branch_id").alias("b"), "family_id"), ["sequence_id", "b"]).groupBy("sequence_id", F.col("a").alias("branch_id")).agg(F.min("family_id").alias("f"))
        low = state.join(offered, ["sequence_id", "branch_id"], "left").select("sequence_id", "branch_id", "family_id", F.least("family_id", F.coalesce("f", "family_id")).alias("g"))
        jump = low.select("sequence_id", F.col("branch_id").alias("g"), F.col("g").alias("h"))
        new = low.join(jump, ["sequence_id", "g"], "left").select("sequence_id", "branch_id", F.least("g", F.coalesce("h", "g")).alias("new"), "family_id").checkpoint()
        if new.where("new <> family_id").isEmpty():
            return new.select("sequence_id", "branch_id", "family_id")
        state = new.select("sequence_id", "branch_id", F.col("new").alias("family_id"))


def assign_links(links: DataFrame, minimum: float, key: Sequence[str] = ("sequence_id", "t")) -> DataFrame:
    """(key, parent_label, child_label, score) of the one-to-one choice of greatest total score in each frame pair; none is below ``minimum``.

    Links of a frame pair are cut into components by a distributed union-find, and each component is a task's work by itself: no task needs
    the links of a whole frame unless they hang together. Null labels or scores aren't links; of repeated links the best counts.
    """
    import pandas as pd

    able = links.where(F.col("score") >= minimum).where("parent_label is not null and child_label is not null")
    able = able.groupBy(*key, "parent_label", "child_label").agg(F.max("score").alias("score"))
    pair = F.struct(*key).alias("sequence_id")
    ends = able.select(pair, (F.col("parent_label").cast("long") * 2).alias("a"), (F.col("child_label").cast("long") * 2 + 1).alias("b"))
    parents = ends.select("sequence_id", F.col("a").alias("branch_id")).distinct()
    of = families(parents.union(ends.select("sequence_id", "b").distinct()), ends)
    at = of.where("branch_id % 2 = 0").select(*(F.col(f"sequence_id.{k}").alias(k) for k in key), F.expr("branch_id div 2").alias("p"), F.col("family_id").alias("component"))
    parts = able.withColumn("p", F.col("parent_label").cast("long")).join(at, [*key, "p"]).drop("p")
    kinds = dict(able.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["parent_label", "child_label"])
        chosen = assign(pdf.parent_label.to_numpy(), pdf.child_label.to_numpy(), pdf.score.to_numpy(), minimum)
        return pdf.iloc[chosen][[*key, "parent_label", "child_label", "score"]]

    return parts.groupBy(*key, "component").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (*key, "parent_label", "child_label", "score")))


class FamilyLog:
    """Families that grow with each chunk, kept as tables in a folder that all executors see.

    Part k holds the new branches with the family they were born into, and all moves so far: which former root belongs to which root now. A
    chunk is added with its own branches and links alone: of the branches before it, those that its links name are looked up, and only their
    roots are united. So a round's work grows with the chunk and the moved roots, not with the nodes of all chunks. Parts are published by a
    rename: one is there whole or not at all, and can't be added twice.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _parts(self) -> list[str]:
        from ..sources.ledger import names_in

        names = [n for n in names_in(self.spark, self.folder) if n.startswith("part-") and not n.endswith(".incomplete")]
        if names != [f"part-{k:08d}" for k in range(len(names))]:
            raise ValueError("a part is missing")
        return [f"{self.folder}/{n}" for n in names]

    def __len__(self) -> int:
        return len(self._parts())

    def _known(self, parts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        births = self.spark.read.parquet(*(f"{p}/births" for p in parts))
        return births, self.spark.read.parquet(f"{parts[-1]}/moves")

    @staticmethod
    def _now(births: DataFrame, moves: DataFrame) -> DataFrame:
        return births.join(moves, ["sequence_id", "family_id"], "left").select("sequence_id", "branch_id", F.coalesce("now", "family_id").alias("family_id"))

    def families(self) -> DataFrame:
        """(sequence_id, branch_id, family_id) of all branches so far."""
        parts = self._parts()
        if not parts:
            raise ValueError("nothing was added")
        return self._now(*self._known(parts))

    def add(self, number: int, branches: DataFrame, links: DataFrame) -> None:
        """Part ``number``: new (sequence_id, branch_id), and links (sequence_id, a, b) between branches that are new or known.

        Branches that are known already change nothing; a link to a branch that nobody knows is an error, as is a part out of order.
        """
        from ..sources.tables import publish

        parts = self._parts()
        if number != len(parts):
            raise ValueError(f"part {len(parts)} comes next")
        shared_checkpoints(self.spark)
        new = branches.select("sequence_id", "branch_id").distinct()
        links = links.select("sequence_id", "a", "b").where("a <> b").distinct().checkpoint()
        named = links.select("sequence_id", F.explode(F.array("a", "b")).alias("branch_id")).distinct()
        old = moves = None
        if parts:
            births, moves = self._known(parts)
            touched = births.join(named.unionByName(new).distinct(), ["sequence_id", "branch_id"], "left_semi")
            old = self._now(touched, moves).checkpoint()
            new = new.join(old, ["sequence_id", "branch_id"], "left_anti")
        fresh = new.withColumn("family_id", F.col("branch_id")).checkpoint()
        roots = fresh if old is None else fresh.unionByName(old)
        if not named.join(roots, ["sequence_id", "branch_id"], "left_anti").isEmpty():
            raise ValueError("a link names an unknown branch")
        for end in ("a", "b"):
            links = links.join(roots.select("sequence_id", F.col("branch_id").alias(end), F.col("family_id").alias(f"root_{end}")), ["sequence_id", end])
        links = links.select("sequence_id", F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        united = families(roots.select("sequence_id", F.col("family_id").alias("branch_id")), links)
        born = fresh.select("sequence_id", "branch_id").join(united, ["sequence_id", "branch_id"])
        if old is not None:
            step = united.where("branch_id <> family_id").join(old.select("sequence_id", F.col("family_id").alias("branch_id")).distinct(), ["sequence_id", "branch_id"], "left_semi")
            step = step.select("sequence_id", F.col("branch_id").alias("now"), F.col("family_id").alias("then"))
            before = moves.join(step, ["sequence_id", "now"], "left").select("sequence_id", "family_id", F.coalesce("then", "now").alias("now"))
            moves = before.unionByName(step.select("sequence_id", F.col("now").alias("family_id"), F.col("then").alias("now")))
        else:
            moves = born.select("sequence_id", "family_id", F.col("family_id").alias("now")).limit(0)
        publish(self.spark, f"{self.folder}/part-{number:08d}", {"births": born, "moves": moves}, {"part": number})
