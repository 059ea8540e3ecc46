"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by the set of sources they belong to. A flow routes token capacity of
these patterns to the sources' quotas; the c-th repetition of a text costs c, so texts are
repeated only where quotas can't be met otherwise. Documents are then selected by a seeded hash.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, WORDS, discard, map_arrow, scratch_table, utf8
from .graph import connected_components, spread_join

#: Levels of 2^BITS buckets by which a seeded order of documents is cut.
BITS, LEVELS = 9, 3

#: Tasks that the rows of one text are dealt to.
WAYS = 16

#: Classes whose flow the driver finds at once; more are routed by tasks, group by group.
AT_ONCE = 4096


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` in proportion to ``weights``, none above ``most`` times its size.

    What a source can't take is shared again by weight among those below their limit.
    """
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if weights[k] * left / weight > most * sizes[k]]
        if not over:
            for k in open_:
                target[k] = weights[k] * left / weight
            break
        for k in over:
            target[k] = float(most * sizes[k])
            left -= target[k]
        open_ = [k for k in open_ if k not in set(over)]
    return target


class _Flow:
    """Words routed from patterns over their classes (the part of a pattern that certain sources can use) to sources."""

    def __init__(self, sizes: Sequence[int], classes: Sequence[tuple[int, Sequence[int], int]], quotas: Sequence[int]):
        self.sizes, self.classes, self.short = sizes, classes, list(quotas)
        self.used, self.full = [0] * len(sizes), [0] * len(classes)
        self.flow: dict[tuple[int, int], int] = {}
        self.feeds: list[list[int]] = [[] for _ in quotas]
        self.moving: list[dict[int, set[int]]] = [{} for _ in sizes]  # by pattern: classes with flow, and to which sources
        for c, (_, members, _) in enumerate(classes):
            for s in members:
                self.feeds[s].append(c)

    def change(self, c: int, s: int, amount: int) -> None:
        now = self.flow.get((c, s), 0) + amount
        self.flow[c, s] = now
        self.full[c] += amount
        held = self.moving[self.classes[c][0]].setdefault(c, set())
        held.add(s) if now else held.discard(s)

    def open_level(self, room: list[float]) -> None:
        """All paths of the cost at hand: ``room`` is what each pattern still has of it."""
        for s in range(len(self.short)):
            for c in self.feeds[s]:  # straight ones first
                p, _, most = self.classes[c]
                amount = int(min(self.short[s], most - self.full[c], room[p]))
                if amount > 0:
                    self.change(c, s, amount)
                    self.short[s] -= amount
                    room[p] -= amount
        for s in range(len(self.short)):
            while self.short[s] > 0 and self.detour(s, room):
                pass

    def detour(self, start: int, room: list[float]) -> bool:
        """Feed a source by what another one gives up, which finds its words elsewhere; the shortest such path."""
        via: dict[int, tuple[int, int, int]] = {}
        asked: set[int] = set()
        queue, end = deque([start]), None
        while queue and end is None:
            s = queue.popleft()
            for c in self.feeds[s]:
                p, _, most = self.classes[c]
                left = most - self.full[c]
                if left > 0 and room[p] > 0:
                    end = (c, s)
                    break
                if left > 0 and p in asked:
                    continue
                givers = self.moving[p].items() if left > 0 else [(c, self.moving[p].get(c, set()))]
                if left > 0:
                    asked.add(p)
                for giver, fed in givers:
                    for other in fed:
                        if other != start and other not in via:
                            via[other] = (c, giver, s)
                            queue.append(other)
        if end is None:
            return False
        c, s = end
        amount = int(min(self.classes[c][2] - self.full[c], room[self.classes[c][0]], self.short[start]))
        steps, at = [], s
        while at != start:
            to, giver, to_source = via[at]
            amount = min(amount, self.flow[giver, at])
            if to != giver:
                amount = min(amount, self.classes[to][2] - self.full[to])
            steps.append((to, giver, at, to_source))
            at = to_source
        room[self.classes[c][0]] -= amount
        self.change(c, s, amount)
        for to, giver, other, to_source in steps:
            self.change(giver, other, -amount)
            self.change(to, to_source, amount)
        self.short[start] -= amount
        return True


def min_cost_flow(sizes: Sequence[int], classes: Sequence[tuple[int, Sequence[int], int]], quotas: Sequence[int], repeats: int) -> dict[tuple[int, int], int]:
    """{(class, source): words} of a flow of least repetition cost that meets what quotas can be met.

    Using the texts of a pattern, of ``sizes`` words, for the c-th time costs c a word (from ``repeats`` + 1 on always that); ``classes`` are
    (pattern, the sources that can use it, most words). Edges cost nothing else, so levels of cost are opened one after another, and on
    each all augmenting paths are used.
    """
    net = _Flow(sizes, classes, quotas)
    for cost in range(1, repeats + 2):
        used = [0] * len(sizes)
        for c, (p, _, _) in enumerate(classes):
            used[p] += net.full[c]
        net.open_level([float("inf") if cost > repeats else size * cost - u for size, u in zip(sizes, used)])
        if not any(net.short):
            break
    return {k: v for k, v in net.flow.items() if v}


def _sized(docs: DataFrame) -> DataFrame:
    """(id, members, k1, k2, size): the number of words in place of the text, counted by where they begin."""
    part = WORDS[0]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = utf8(batch.column(4))
        sizes = np.zeros(batch.num_rows, np.int64)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + SLICE_BYTES, "right")) - 1)
            inside = part[data[at[low] : at[high]]]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            first = at[low:high] - at[low]
            first = first[first < len(inside)]
            begins[first] = inside[first]
            sizes[low:high] = np.diff(np.searchsorted(np.flatnonzero(begins), at[low : high + 1] - at[low]))
            low = high
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes)], ["id", "members", "k1", "k2", "size"])

    return map_arrow(docs, run, "id long, members array<string>, k1 long, k2 long, size long")


def _named(members: str) -> Column:
    """A number for a set of sources."""
    return F.xxhash64(F.to_json(F.struct(members), {"ignoreNullFields": "false"}))


def _shared(sized: DataFrame) -> DataFrame:
    """(k1, k2, pattern, words): texts that stand in several rows of several sources, a number for all these sources, and the text's words."""
    texts = sized.where("size > 0").groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("members")))).alias("members"), F.count("*").alias("n"), F.max("size").alias("words"))
    texts = texts.where((F.col("n") > 1) & (F.size("members") > 1)).select("k1", "k2", _named("members").alias("pattern"), "words")
    return scratch_table(texts, "texts")[0]


def _with_patterns(sized: DataFrame, shared: DataFrame) -> DataFrame:
    """``sized`` with ``pattern``, whether it is ``joint`` to several sources, and ``cls``: a number for pattern and members, what of a pattern these
    sources can use. Rows of a text are dealt to WAYS tasks."""
    ways = shared.select("k1", "k2", F.col("pattern").alias("p")).withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    rows = sized.withColumn("way", F.pmod("h", F.lit(WAYS)).cast("int")).join(ways, ["k1", "k2", "way"], "left").drop("way")
    held = F.when(F.col("size") > 0, F.col("p"))
    rows = rows.withColumns({"joint": held.isNotNull() | (F.size("members") > 1), "pattern": F.coalesce(held, _named("members"))})
    return rows.withColumn("cls", F.xxhash64("pattern", _named("members")))


def _ranked(sources: DataFrame) -> tuple[DataFrame, str]:
    """``sources`` with their rank by code point, null last; no task sorts them all."""
    held, path = scratch_table(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.part: r.n for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    begin, offsets = 0, []
    for k in sorted(counts):
        offsets.append((k, begin))
        begin += counts[k]
    known = held.sparkSession.createDataFrame(offsets, "part long, begin long")
    return held.withColumn("part", part).join(F.broadcast(known), "part").withColumn("rank", F.col("begin") + place).drop("part", "begin", "at"), path


def _targets(sources: DataFrame, weights: Sequence[float], total: float, most: float) -> DataFrame:
    """``sources`` (source, size, rank) with ``target``: ``water_fill`` as a few sums.

    A source is at its limit if its share at the present rate (words per weight) is above; what is left gives the next rate.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    held = sources.withColumn("weight", weight)
    rate, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(rate) > F.col("size") * F.lit(float(most))
        now = held.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("size") * float(most))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if now.n == full or not now.weight:
            break
        full, rate = now.n, (total - (now.full or 0.0)) / now.weight
    share = F.col("weight") * F.lit(rate)
    return held.withColumn("target", F.least(share, F.col("size") * F.lit(float(most)))).drop("weight", "rank")


def _cut(plan: DataFrame, sized: DataFrame, level: int) -> DataFrame:
    """``plan`` (cls, base, left, cut, ...) with the bucket of this level in which ``left`` words are reached, and what is left then."""
    shift = BITS * (LEVELS - 1 - level)
    rows = sized
    if level:
        above = plan.where("left > 0").select("cls", F.shiftright("cut", shift + BITS).alias("above"))
        rows = sized.withColumn("above", F.shiftright("h", shift + BITS)).join(above, ["cls", "above"], "left_semi")
    sums = rows.groupBy("cls", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
    total = F.sum("words").over(Window.partitionBy("cls").orderBy("bucket"))  # at most 2^BITS rows
    at = sums.withColumn("total", total).join(plan.where("left > 0").select("cls", "left"), "cls").where("total > left and total - words <= left")
    cut, left = F.shiftleft("bucket", shift), F.col("left") - F.col("total") + F.col("words")
    if level == LEVELS - 1:  # the bucket at the cut is taken if that comes nearer
        cut = cut + (2 * left > F.col("words")).cast("long")
    at = at.select("cls", cut.alias("new_cut"), left.alias("new_left"))
    names = [c for c in plan.columns if c not in ("cut", "left")]
    return plan.join(at, "cls", "left").select(*names, F.coalesce("new_cut", "cut").alias("cut"), F.coalesce("new_left", "left").alias("left"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, copies) per row of ``docs``.

    ``source`` is a string, or an array of strings for documents that several sources share (the
    row's target and source_size are then those of its first source). Sources, in code point order
    with null last, get ``weights`` in turn; quotas share ``share`` times all sizes by weight, none above
    ``repeats`` times its source's size. ``size`` is the number of words, runs of other
    characters than space and \\t to \\r (null and empty texts: 0; long ones are counted slice by slice). ``taken``
    counts repetitions: a whole number of times the size, at most ``repeats`` times. Rows
    with equal id are taken alike; a document of size 0 is taken 0 times. Reruns agree, whatever
    the partitions: the order in which documents are chosen is a hash of id and ``seed``. Other columns are ignored; no rows give none.

    A text that stands in rows of several sources is one supply that all of them draw on: its pattern is the set of these sources, and
    using it again costs more, from whatever row. A flow of least cost routes the patterns' words to the quotas; each source takes its words
    from its own rows. Rows whose text stands in one source only are that source's own pattern, in the same flow. Where no pattern joins a source to
    others, that flow is its quota, from its own documents, and needs no search. Which rows of a pattern a source takes follows from their ids
    alone, so two sources that take a part of it each can take the same text. The driver gets the patterns of two or more sources, and the sources and
    own patterns that these touch, if they are no more than AT_ONCE; else sources that patterns join, directly or over others, have a
    flow of their own, which one task finds. Documents and other sources stay on the executors.
    """
    spark = docs.sparkSession
    many = dict(docs.dtypes)[source].startswith("array")
    members = F.col(source) if many else F.array(source)
    members = F.when(F.size(members) > 0, F.array_sort(F.array_distinct(members))).otherwise(F.array(F.lit(None).cast("string")))
    keys = [F.xxhash64(F.lit(k), text).alias(f"k{k}") for k in (1, 2)]
    sized = _sized(docs.select(F.col(id).cast("long").alias("id"), members.alias("members"), *keys, F.col(text).alias("text")))
    sized, zero = scratch_table(sized.withColumn("h", F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 64 - BITS * LEVELS)), "sized")
    shared = _shared(sized)
    rows, _ = scratch_table(_with_patterns(sized, shared).select("id", "members", "size", "h", "pattern", "joint", "cls"), "sized")
    classes, one = scratch_table(rows.groupBy("cls", "pattern", "joint", "members").agg(F.sum("size").alias("words")), "classes")
    sources, two = _ranked(classes.select(F.explode("members").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("size")))
    total = classes.agg(F.sum("words")).first()[0] or 0
    quotas, three = scratch_table(_targets(sources, weights, share * total, repeats), "targets")
    first = classes.withColumn("source", F.col("members")[0])
    plan = first.join(quotas.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("cls", "words", F.col("size").alias("source_size"), "target", F.bround("target").cast("long").alias("wanted"))
    routed, four = scratch_table(_route(classes, shared, quotas, repeats), "routed")
    plan = plan.join(routed, "cls", "left").withColumn("wanted", F.coalesce("routed", "wanted")).drop("routed")
    # each class gives floor(wanted / size) copies of all, and one more of those first in seeded order
    copies = lambda f: F.when(F.col("words") > 0, F.expr(f)).otherwise(F.lit(0)).cast("long")
    plan = plan.select("cls", "source_size", "target", copies("wanted div words").cast("int").alias("base"), copies("wanted % words").alias("left"), F.lit(0).cast("long").alias("cut"))
    paths = [zero, one, two, three, four]
    for level in range(LEVELS):
        plan, path = scratch_table(_cut(plan, rows, level), "plan")
        paths.append(path)
    discard(spark, *paths[:-1])
    found = spread_join(rows.select("id", "size", "h", "cls"), plan, "cls", "h")
    times = F.least(F.col("base") + (F.col("h") < F.col("cut")).cast("int"), F.lit(repeats))
    return found.select(F.col("id").alias(id), "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("copies"))


def _routed(rows: list[dict], target: dict, repeats: int) -> list[tuple[int, int]]:
    """(cls, words wanted) of classes (cls, pattern, members, words, once) by the flow to the targets of their sources."""
    name = lambda m: (m is None, m or "")
    rows = sorted(rows, key=lambda r: ([name(m) for m in r["members"]], r["pattern"]))
    if len({r["cls"] for r in rows}) < len(rows):
        raise ValueError("two classes have one number")
    names = sorted(target, key=name)
    at = {m: k for k, m in enumerate(names)}
    number: dict[int, int] = {}
    sizes: list[int] = []
    for r in rows:
        if number.setdefault(r["pattern"], len(sizes)) == len(sizes):
            sizes.append(r["once"] or 0)
        if r["once"] is None:
            sizes[number[r["pattern"]]] += r["words"]
    flow = min_cost_flow(sizes, [(number[r["pattern"]], [at[m] for m in r["members"]], repeats * r["words"]) for r in rows], [round(target[m]) for m in names], repeats)
    wanted = [0] * len(rows)
    for (c, _), words in flow.items():
        wanted[c] += words
    return [(r["cls"], w) for r, w in zip(rows, wanted)]


def _route(classes: DataFrame, shared: DataFrame, quotas: DataFrame, repeats: int) -> DataFrame:
    """(cls, routed): words wanted of the classes of sources that some pattern joins to others: the flow over these.

    What no pattern joins shares no words and no quota: the flows of connected groups of sources make up that of all.
    """
    held = classes.where("words > 0").select("cls", "pattern", "joint", "members", "words", F.explode("members").alias("e"))
    joined = held.where("joint").select(F.col("e").alias("s")).distinct()
    once = shared.groupBy("pattern").agg(F.sum("words").alias("once"))  # a shared text counts once, whatever the number of rows it stands in
    rows = held.join(joined, F.col("e").eqNullSafe(F.col("s")), "left_semi").drop("e").distinct().join(once, "pattern", "left")
    targets = quotas.join(joined, F.col("source").eqNullSafe(F.col("s")), "left_semi").select("source", "target")
    first = rows.limit(AT_ONCE + 1).collect()
    if len(first) <= AT_ONCE:
        found = _routed([r.asDict() for r in first], {r.source: r.target for r in targets.collect()}, repeats)
        return held.sparkSession.createDataFrame(found, "cls long, routed long")
    node = lambda c: F.xxhash64(F.lit("source"), c.isNull(), c)
    groups = connected_components(held.where("joint").select("pattern", node(F.col("e")).alias("id")), "pattern", "id")
    named = lambda n: groups.select(F.col("id").alias(f"id{n}"), F.col("component").alias(f"g{n}"))
    left = rows.withColumn("id1", node(F.col("members")[0])).join(named(1), "id1").select("g1", "cls", "pattern", "members", "words", "once")
    right = targets.withColumn("id2", node(F.col("source"))).join(named(2), "id2").select("g2", "source", "target")

    def flow(_, classes: pa.Table, targets: pa.Table) -> pa.Table:
        found = _routed(classes.to_pylist(), {r["source"]: r["target"] for r in targets.to_pylist()}, repeats)
        return pa.table({"cls": pa.array([c for c, _ in found], pa.int64()), "routed": pa.array([w for _, w in found], pa.int64())})

    return left.groupBy("g1").cogroup(right.groupBy("g2")).applyInArrow(flow, "cls long, routed long")
