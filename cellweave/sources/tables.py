"""Catalog tables as CSV or Parquet, written so that a reader never sees half of them."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import joined_ids
from ..operators.lineage import TrackGraph

CSV_SCHEMAS = {
    "objects": "time long, node_id long, branch_id long, family_id long, local_label int, area_cells long, centroid_y double, centroid_x double, mean_intensity double, max_intensity double, precipitation_sum double, y_start int, y_stop int, x_start int, x_stop int",
    "edges": "time long, parent_node_id long, child_node_id long, score double, event string, gap int, raw_iou double, advected_iou double, distance double, parent_coverage double, child_coverage double",
    "events": "event_id long, time long, event string, parent_node_ids string, child_node_ids string",
    "family_map": "branch_id long, family_id long",
}

#: How tables are ordered in a catalog.
ORDERS = {"objects": ("time", "node_id"), "edges": ("time", "parent_node_id", "child_node_id"), "events": ("time", "event_id"), "family_map": ("branch_id",)}

CATALOG_VERSION = 1


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _hadoop(spark, path)
    return fs.exists(place)


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], manifest: dict, format: str = "parquet") -> None:
    """Write all tables and the manifest under a temporary name, then rename: all or nothing.

    FileExistsError if there is something at ``path``.
    """
    if exists(spark, path):
        raise FileExistsError(path)
    temporary = f"{path.rstrip('/')}.incomplete"
    fs, place = _hadoop(spark, temporary)
    fs.delete(place, True)
    for name, df in tables.items():
        kind = "json" if name == "states" else format  # states are JSON themselves, which CSV would garble
        writer = df.write.format(kind)
        (writer.option("header", True) if kind == "csv" else writer).save(f"{temporary}/{name}")
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{temporary}/manifest")  # last
    if not fs.rename(place, spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"can't rename to {path}")


def graph_tables(graph: TrackGraph) -> dict[str, DataFrame]:
    """The four tables as they are published: lists of ids joined by semicolons."""
    events = graph.events.withColumns({c: joined_ids(c) for c in ("parent_node_ids", "child_node_ids")})
    return {"objects": graph.nodes, "edges": graph.edges, "events": events, "family_map": graph.family_map}


def write_part(spark: SparkSession, path: str, graph: TrackGraph, settings: dict, format: str = "csv") -> None:
    """A chunk's tables with its states and settings."""
    publish(spark, path, graph_tables(graph) | {"states": graph.states}, {"schema_version": CATALOG_VERSION, "settings": settings}, format)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first().value)


def read_part(spark: SparkSession, path: str, name: str, format: str = "csv") -> DataFrame:
    if not exists(spark, f"{path}/{name}"):
        raise FileNotFoundError(f"{path}/{name}")
    if format == "csv":
        return spark.read.csv(f"{path}/{name}", header=True, schema="sequence_id string, " + CSV_SCHEMAS[name])
    return spark.read.format(format).load(f"{path}/{name}")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, state) of a part: what the next chunk goes on from."""
    if not exists(spark, f"{path}/states"):
        raise FileNotFoundError(f"{path}/states")
    return spark.read.json(f"{path}/states", schema="sequence_id string, state string")


def canonical_families(nodes: DataFrame, family_map: DataFrame) -> DataFrame:
    """Nodes with ``canonical_family_id`` of the final map beside the family they had when they were written."""
    final = family_map.select("sequence_id", "branch_id", F.col("family_id").alias("canonical_family_id"))
    out = nodes.join(final, ["sequence_id", "branch_id"], "left")
    if not out.where("canonical_family_id is null").isEmpty():
        raise ValueError("a branch is not in the final family map")
    return out


def combine(parts: Sequence[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """One catalog of chunks in order: tables one after another, families of the last part, checked."""
    if not parts:
        raise ValueError("no parts")
    all_ = {}
    for name in ("objects", "edges", "events"):
        df = parts[0][name]
        for p in parts[1:]:
            df = df.unionByName(p[name])
        all_[name] = df
    final = parts[-1]["family_map"]
    nodes = all_["objects"]
    if not nodes.groupBy("sequence_id", "node_id").count().where("count > 1").isEmpty():
        raise ValueError("a node_id is not unique")
    known = nodes.select("sequence_id", "node_id")
    ends = all_["edges"].select("sequence_id", F.explode(F.array("parent_node_id", "child_node_id")).alias("node_id"))
    if not ends.join(known, ["sequence_id", "node_id"], "left_anti").isEmpty():
        raise ValueError("an edge has an unknown node")
    named = canonical_families(nodes, final).withColumn("family_id", F.col("canonical_family_id")).drop("canonical_family_id")
    out = {"objects": named.select(*nodes.columns), "edges": all_["edges"], "events": all_["events"], "family_map": final}
    return {n: df.orderBy("sequence_id", *ORDERS[n]) for n, df in out.items()}


def finalize_catalog(spark: SparkSession, parts: Sequence[str], output: str, part_format: str = "csv", format: str = "parquet") -> None:
    """Publish the catalog of chunk directories, with the number of rows of each table in the manifest."""
    tables = combine([{n: read_part(spark, p, n, part_format) for n in CSV_SCHEMAS} for p in parts])
    counts = {n: df.count() for n, df in tables.items()}
    publish(spark, output, tables, {"schema_version": CATALOG_VERSION, "parts": list(parts), "rows": counts}, format)


def chunk_of(df: DataFrame, size: int, start: int = 0) -> DataFrame:
    """``chunk`` of each row's frame."""
    return df.withColumn("chunk", F.floor((F.col("t") - start) / size).cast("long"))


def latest_families(maps: DataFrame) -> DataFrame:
    """The family of each branch in the last chunk (column ``chunk``) that has it."""
    order = Window.partitionBy("sequence_id", "branch_id").orderBy(F.desc("chunk"))
    return maps.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
