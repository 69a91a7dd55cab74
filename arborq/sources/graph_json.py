"""Module graphs from JSON exports, configuration, snapshots and versions."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The vocabulary of exported graphs (advisory; other labels load too).
REL_TYPES = "CONTAINS DEFINES HAS_METHOD HAS_PROPERTY IMPORTS CALLS EXTENDS IMPLEMENTS STEP_IN_PROCESS".split()
ROW = "struct<id:string,label:string,type:string,sourceId:string,targetId:string,confidence:double,reason:string,step:string,properties:map<string,string>>"
SNAPSHOT_TTL = "24 hours"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a folder of JSON documents, each a list of rows or an object with nodes and relationships.

    Nodes need id and label, relationships sourceId, targetId and type; other rows are dropped. Defaults: confidence 1, reason empty,
    id source->target. Documents are read whole, one a task.
    """
    text = spark.read.option("wholetext", True).text(path)
    listed = F.from_json("value", f"array<{ROW}>")
    held = F.from_json("value", f"struct<nodes:array<{ROW}>,relationships:array<{ROW}>>")
    is_list = F.ltrim("value").startswith("[")
    rows = F.when(is_list, listed).otherwise(F.concat(F.coalesce(held["nodes"], F.array().cast(f"array<{ROW}>")), F.coalesce(held["relationships"], F.array().cast(f"array<{ROW}>"))))
    r = text.select(F.explode(rows).alias("r")).select("r.*")
    nodes = r.filter("id IS NOT NULL AND label IS NOT NULL AND sourceId IS NULL").select("id", "label", F.col("properties")["filePath"].alias("file_path"), "properties")
    edges = r.filter("sourceId IS NOT NULL AND targetId IS NOT NULL AND type IS NOT NULL")
    own = F.concat("sourceId", F.lit("->"), "targetId")
    return nodes, edges.select(F.coalesce("id", own).alias("id"), F.col("sourceId").alias("src"), F.col("targetId").alias("dst"), F.col("type").alias("rel_type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("reason", F.lit("")).alias("reason"), "step")


def read_graph_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same two tables from a Parquet export; columns that are missing get their defaults."""
    nodes, edges = (spark.read.option("mergeSchema", True).parquet(f"{path}/{n}") for n in ("nodes", "relationships"))
    for name, default in (("confidence", F.lit(1.0)), ("reason", F.lit("")), ("step", F.lit(None).cast("string"))):
        if name not in edges.columns:
            edges = edges.withColumn(name, default)
    return nodes, edges


def branch_path(root: str, branch: str | None, exists) -> str:
    """A branch's own store where ``exists`` finds one, else the root store."""
    own = f"{root}/branch={branch}" if branch else root
    return own if branch and exists(own) else root


def load_config(start: str, name: str = ".arborq.toml") -> dict:
    """The nearest configuration at or above a folder: priority, preferences, allow rows. An invalid file gives defaults."""
    at = os.path.abspath(start)
    while True:
        path = os.path.join(at, name)
        if os.path.isfile(path):
            try:
                with open(path, "rb") as f:
                    raw = tomllib.load(f)
            except (tomllib.TOMLDecodeError, UnicodeDecodeError):
                raw = {}
            rows = [r for r in raw.get("allow", []) if isinstance(r, dict) and r.get("pattern") and r.get("reason")]
            order = raw.get("priority") if isinstance(raw.get("priority"), list) else raw.get("preferences")
            return {"root": at, "ranking": order, "priority": raw.get("priority") if isinstance(raw.get("priority"), str) else None, "allow": rows}
        if os.path.dirname(at) == at:
            return {"root": None, "ranking": None, "priority": None, "allow": []}
        at = os.path.dirname(at)


def allowlist(spark: SparkSession, config: dict) -> DataFrame:
    rows = [(r["pattern"], r["reason"], r.get("scope")) for r in config["allow"]]
    return spark.createDataFrame(rows, "pattern string, reason string, scope string")


def write_snapshot(files: DataFrame, path: str, project: str) -> None:
    """Appends a baseline of files (path, source), keyed by content and stamped with the time."""
    own = files.select("path", "source", F.sha2(F.concat_ws("\0", "path", "source"), 256).alias("snapshot_id"), F.current_timestamp().alias("taken"), F.lit(project).alias("project"))
    own.write.mode("append").partitionBy("project").parquet(path)


def read_snapshot(spark: SparkSession, path: str, project: str, ttl: str = SNAPSHOT_TTL) -> DataFrame:
    """The latest baseline of each path with its status: ok or snapshot_stale. A path without one has no row (snapshot_not_found)."""
    s = spark.read.parquet(path).filter(F.col("project") == project)
    last = s.groupBy("path").agg(F.max_by("source", "taken").alias("source"), F.max("taken").alias("taken"))
    return last.withColumn("status", F.when(F.col("taken") > F.expr(f"current_timestamp() - INTERVAL {ttl}"), "ok").otherwise("snapshot_stale"))
