"""Merkle manifest of a table: a sparse-forest monoid that is reduced as a tree, and proofs for every row.

Rows are leaves; those of one group stand in order, and every ARITY consecutive nodes become one until one is left, the group's
subroot. Subroots, in order of their groups, become the root in the same way. A ``Forest`` holds the nodes of some leaves that can't be
resolved yet, keyed by tree, level and index; as every node knows how many stand on its level, a run of siblings is resolved as soon as it
is whole, whatever forests it comes from. Merging forests is therefore associative, and of a stretch of leaves only its edges
stay: a few nodes for each level.

Tasks make the forests of their sorted rows, and FAN at a time are merged, layer by layer, to the root. Going down the same
layers, each stretch learns the nodes beside it (the forest of all that is not its own), which with its own rows are all that its
proofs need. Nothing of this is collected: tasks hold one stretch, or the edges of FAN of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, scratch_table, sorted_groups

#: Nodes that become one; and forests that one task merges.
ARITY, FAN = 8, 32

#: The tree whose leaves are subroots. Other trees are numbered by their group.
UPPER = -1

_NODE = "part long, tree long, level int, place long, width long, digest binary"


def digest(data: bytes) -> bytes:
    """SHA-256 as lower-case hexadecimal text: digests are hashed as text."""
    return hashlib.sha256(data).hexdigest().encode()


class Forest:
    """Nodes that wait for siblings: {(tree, level, index): (nodes on that level, digest)}."""

    def __init__(self, groups: int, arity: int = ARITY):
        self.groups, self.arity = groups, arity
        self.nodes: dict[tuple[int, int, int], tuple[int, bytes]] = {}

    def add(self, tree: int, level: int, index: int, width: int, value: bytes) -> None:
        nodes, arity = self.nodes, self.arity
        while True:
            if width == 1:
                if tree == UPPER:
                    nodes[tree, level, index] = width, value
                    return
                tree, level, index, width = UPPER, 0, tree, self.groups
                continue
            nodes[tree, level, index] = width, value
            first = index - index % arity
            run = [(tree, level, k) for k in range(first, min(first + arity, width))]
            if run[-1] not in nodes or not all(k in nodes for k in run):
                return
            value = digest(b"".join(nodes.pop(k)[1] for k in run))
            level, index, width = level + 1, index // arity, -(-width // arity)

    def merge(self, other: Forest) -> Forest:
        for (tree, level, index), (width, value) in other.nodes.items():
            self.add(tree, level, index, width, value)
        return self

    def copy(self) -> Forest:
        out = Forest(self.groups, self.arity)
        out.nodes = dict(self.nodes)
        return out

    def batch(self, part: int) -> pa.RecordBatch:
        keys = list(self.nodes)
        tree, level, place = zip(*keys) if keys else ((), (), ())
        width, value = zip(*(self.nodes[k] for k in keys)) if keys else ((), ())
        columns = [pa.array([part] * len(keys), pa.int64()), pa.array(tree, pa.int64()), pa.array(level, pa.int32()), pa.array(place, pa.int64()), pa.array(width, pa.int64()), pa.array(value, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "tree", "level", "place", "width", "digest"])


def climb(first: int, values: list[bytes], width: int, tree: int, outside: dict, arity: int = ARITY) -> tuple[list[tuple[int, list[bytes]]], bytes]:
    """([(index of the first, nodes)] for each level under the top, the top): whole runs of siblings around the nodes from ``first`` on.

    Siblings that these nodes don't hold come from ``outside``.
    """
    levels: list[tuple[int, list[bytes]]] = []
    low, high = first, first + len(values)
    while width > 1:
        a, b = low - low % arity, min(-(-high // arity) * arity, width)
        level = len(levels)
        run = [outside[tree, level, k] for k in range(a, low)] + values + [outside[tree, level, k] for k in range(high, b)]
        levels.append((a, run))
        values = [digest(b"".join(run[k : k + arity])) for k in range(0, len(run), arity)]
        low, high, width = a // arity, -(-b // arity), -(-width // arity)
    return levels, values[0]


def beside(levels: list[tuple[int, list[bytes]]], index: int, start: int = 0, arity: int = ARITY) -> list[tuple[bytes, bytes]]:
    """(siblings before, siblings after) on each level from ``start`` up, of the node ``index`` of that level."""
    out = []
    for a, run in levels[start:]:
        first = index - index % arity - a
        at = index - a
        out.append((b"".join(run[first:at]), b"".join(run[at + 1 : first + arity])))
        index //= arity
    return out


def fold(value: bytes, path: Sequence[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        value = digest(before + value + after)
    return value


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


@dataclass
class Tree:
    """A manifest: its root (None of no rows), and what proofs are made of."""

    root: str | None
    rows: int
    groups: int
    stretches: DataFrame
    ordered: DataFrame
    layers: list[DataFrame]
    paths: list[str]
    arity: int


def _numbered(df: DataFrame, order: Sequence[Column], name: str) -> tuple[DataFrame, str, dict[int, int]]:
    """``df`` written in order with (part, at): its sorted partition and its place there; where that is; rows by partition."""
    placed = df.orderBy(*order).withColumn("part", F.spark_partition_id().cast("long")).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    held, path = scratch_table(placed, name)
    return held, path, {r.part: r.n for r in held.groupBy("part").agg(F.count("*").alias("n")).collect()}


def _stream(tree_rows: DataFrame, stretches: DataFrame, outside: DataFrame | None) -> DataFrame:
    """Rows of each partition together and in order: its stretches, nodes from outside, and its leaves."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = tree_rows.select("part", F.lit(2).alias("kind"), "at", none("long").alias("tree"), none("int").alias("level"), none("long").alias("place"), none("long").alias("width"), "id", "digest", "changed")
    some = stretches.select("part", F.lit(0).alias("kind"), F.col("first").alias("at"), "tree", none("int").alias("level"), F.col("begin").alias("place"), "width", F.col("n").alias("id"), none("binary").alias("digest"), none("binary").alias("changed"))
    out = rows.unionByName(some)
    if outside is not None:
        out = out.unionByName(outside.select("part", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("at"), "tree", "level", "place", "width", none("long").alias("id"), "digest", none("binary").alias("changed")))
    return out.repartition("part").sortWithinPartitions("part", "kind", "at")


def build(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", changed: dict[str, Column] | None = None, touched: Column | None = None, arity: int = ARITY) -> Tree:
    """The manifest of ``docs``: a leaf per row over ``fields``, trees by ``group`` (null first, then by UTF-8 bytes) in the order of ``order``.

    Null orders come first, and rows of equal order go by leaf; equal rows are equal leaves beside each other. Texts of any length are hashed by
    the executors' JVM. Other columns are ignored, whatever their names. A table without rows has no root. ``changed`` (columns that
    replace fields) where ``touched`` gives a second leaf of the row, for proofs of what was tampered with.
    """
    spark = docs.sparkSession
    column = {f: F.col(f) for f in fields}
    other = F.when(touched, F.unhex(leaf_digest([{**column, **(changed or {})}[f] for f in fields]))) if touched is not None else F.lit(None).cast("binary")
    leaves = docs.select(F.col(order).cast("long").alias("id"), F.col(group).cast("string").alias("g"), F.unhex(leaf_digest(list(column.values()))).alias("digest"), other.alias("changed"))
    leaves, one = scratch_table(leaves, "leaves")
    # equal rows are told apart as well, so that any number of them is sorted by many tasks
    order_by = [F.col("g").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest"), F.col("tie")]
    ordered, two, counts = _numbered(leaves.withColumn("tie", F.monotonically_increasing_id()), order_by, "ordered")
    discard(spark, one)
    rows = sum(counts.values())
    # where each group's rows stand in each partition: one row per group, and one for each partition it goes on in
    held = ordered.groupBy("part", "g").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    held, three = scratch_table(held.withColumn("key", F.struct(F.col("g").isNull().alias("none"), F.coalesce("g", F.lit("")).alias("name"))).drop("g"), "stretches")
    trees, four, of_part = _numbered(held.groupBy("key").agg(F.sum("n").alias("width")), [F.col("key.none").desc(), F.col("key.name")], "trees")
    begins, total = [], 0
    for part in sorted(of_part):
        begins.append((part, total))
        total += of_part[part]
    known = spark.createDataFrame(begins, "part long, base long")
    trees = trees.join(F.broadcast(known), "part").select("key", "width", (F.col("base") + F.col("at")).alias("tree"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    stretches = held.withColumn("begin", F.coalesce(before, F.lit(0))).join(trees, "key").select("part", "n", "first", "begin", "tree", "width")
    stretches, five = scratch_table(stretches, "stretches")
    discard(spark, three, four)

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, forest, todo, now = None, None, [], None
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(9)]
            for p, kind, at, tree, _, place, width, n, value in zip(*cols):
                if p != part:
                    if forest is not None:
                        yield forest.batch(part)
                    part, forest, todo, now = p, Forest(total, arity), [], None
                if kind == 0:
                    todo.append((at, at + n, tree, place, width))
                    continue
                if now is None or at >= now[1]:
                    now = todo.pop(0)
                forest.add(now[2], 0, now[3] + at - now[0], now[4], value.hex().encode())
        if forest is not None:
            yield forest.batch(part)

    layer, path = scratch_table(map_batches(_stream(ordered, stretches, None), forests, _NODE), "forest")
    layers, paths, top = [layer], [two, five, path], max(counts, default=0)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 1):
            forest = Forest(total, arity)
            for row in zip(*(table.column(k).to_pylist() for k in range(1, 6))):
                forest.add(*row)
            yield forest.batch(table.column(0)[0].as_py())

    while top > 0:
        layer, path = scratch_table(map_batches(layer.withColumn("part", F.expr(f"part div {FAN}")).repartition("part").sortWithinPartitions("part"), merged, _NODE), "forest")
        layers.append(layer)
        paths.append(path)
        top //= FAN
    found = layers[-1].select("digest").take(2) if rows else []
    if rows and len(found) != 1:
        raise ValueError("the forest didn't come down to one root")
    return Tree(found[0].digest.decode() if found else None, rows, total, stretches, ordered, layers, paths, arity)


def _neighbours(tree: Tree) -> tuple[DataFrame | None, list[str]]:
    """(part, tree, level, place, width, digest): the forest of all leaves that aren't in a partition, for each; None of one partition."""
    groups, arity, paths = tree.groups, tree.arity, []
    around = None
    for layer in reversed(tree.layers[:-1]):
        rows = layer.select(F.expr(f"part div {FAN}").alias("g"), "part", *layer.columns[1:])
        if around is not None:
            rows = rows.unionByName(around.select(F.col("part").alias("g"), F.lit(-1).cast("long").alias("part"), *layer.columns[1:]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in sorted_groups(batches, 1):
                own: dict[int, Forest] = {}
                for part, *node in zip(*(table.column(k).to_pylist() for k in range(1, 7))):
                    own.setdefault(part, Forest(groups, arity)).add(*node)
                left = own.pop(-1, Forest(groups, arity))
                parts = sorted(own)
                right = [Forest(groups, arity)]
                for part in reversed(parts[1:]):
                    right.append(right[-1].copy().merge(own[part]))
                for part, after in zip(parts, reversed(right)):
                    yield left.copy().merge(after).batch(part)
                    left.merge(own[part])

        around, path = scratch_table(map_batches(rows.repartition("g").sortWithinPartitions("g", "part"), run, _NODE), "around")
        paths.append(path)
    return around, paths


def prove(tree: Tree) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of the manifest.

    ``proof_sha256`` digests the siblings on the way up, level by level over the subroot to the root, left to right; ``folded_root`` is what the
    row's leaf (the changed one where it was touched) and these siblings give, ``verified`` whether that is the root.
    """
    around, paths = _neighbours(tree)
    discard(tree.ordered.sparkSession, *tree.paths[2:], *paths[:-1])
    root, arity = tree.root, tree.arity
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def proofs(stretches: list, outside: dict, leaves: list) -> Iterator[pa.RecordBatch]:
        lower, tops = [], []
        for first, last, number, begin, width in stretches:
            values = [v for _, v, _ in leaves[first:last]]
            levels, top = climb(begin, values, width, number, outside, arity)
            lower.append(levels)
            tops.append(top)
        upper, _ = climb(stretches[0][2], tops, tree_groups, UPPER, outside, arity)
        for (first, last, number, begin, _), levels, top in zip(stretches, lower, tops):
            over = beside(upper, number, 0, arity)
            tail, of = over, None
            out: list[tuple] = []
            for k in range(first, last):
                index = begin + k - first
                if levels and index // arity != of:
                    of = index // arity
                    tail = beside(levels, of, 1, arity) + over
                    tail_bytes = b"".join(x for pair in tail for x in pair)
                elif not levels:
                    tail_bytes = b"".join(x for pair in over for x in pair)
                path = (beside(levels[:1], index, 0, arity) + tail) if levels else over
                sent, value, changed = leaves[k]
                proof = digest((path[0][0] + path[0][1] if levels else b"") + tail_bytes)
                folded = fold(value if changed is None else changed, path).decode()
                out.append((sent, value.decode(), top.decode(), root, proof.decode(), folded, folded == root))
                if len(out) == 10_000 or k == last - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.string()] * 5, pa.bool_()))], names)
                    out = []

    tree_groups = tree.groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 1):
            kind, at, number, level, place, width, ids = (table.column(k).to_pylist() for k in range(1, 8))
            value, changed = table.column(8).to_pylist(), table.column(9).to_pylist()
            stretches = [(at[k], at[k] + ids[k], number[k], place[k], width[k]) for k, x in enumerate(kind) if x == 0]
            outside = {(number[k], level[k], place[k]): value[k] for k, x in enumerate(kind) if x == 1}
            leaves = [(ids[k], value[k].hex().encode(), None if changed[k] is None else changed[k].hex().encode()) for k, x in enumerate(kind) if x == 2]
            yield from proofs(stretches, outside, leaves)

    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return map_batches(_stream(tree.ordered, tree.stretches, around), run, schema)


def lower_ascii(column: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def tampered_proofs(docs: DataFrame, folds: int = 3, id: str = "doc_id", text: str = "text", group: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), arity: int = ARITY) -> DataFrame:
    """``prove`` for all rows of ``docs``, after A to Z of the text were lower-cased where ``folds`` divides the unsigned crc32 of the id.

    A row without id is never touched; a text that is null or has no capital stays what it is, so its proof still holds.
    """
    touched = F.crc32(F.col(id).cast("string")) % folds == 0
    tree = build(docs, fields, group, id, {text: lower_ascii(F.col(text))}, touched, arity)
    return prove(tree).withColumnRenamed("id", id)
