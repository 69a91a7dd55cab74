"""Process paths: ordered steps, transitions between them, and which paths touch a set of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .module_graph import cut, parts


def paths_from_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(process_id, step, node_id) of STEP_IN_PROCESS edges that leave Process nodes; a step that is no number takes its place in the path."""
    own = edges.filter("rel_type = 'STEP_IN_PROCESS'").join(nodes.filter("label = 'Process'").select(F.col("id").alias("src")), "src", "left_semi")
    place = F.row_number().over(W.partitionBy("src").orderBy("id")) - 1
    number = F.coalesce(F.expr("try_cast(step AS BIGINT)"), F.floor(F.expr("try_cast(step AS DOUBLE)")).cast("long"))
    return own.withColumn("place", place).select(F.col("src").alias("process_id"), F.coalesce(number, F.col("place").cast("long")).alias("step"), F.col("dst").alias("node_id"))


def transitions(steps: DataFrame) -> DataFrame:
    """(process_id, step, src, dst): each step with the next one of its path."""
    nxt = F.lead("node_id").over(W.partitionBy("process_id").orderBy("step", "node_id"))
    return steps.withColumn("dst", nxt).filter("dst IS NOT NULL").select("process_id", "step", F.col("node_id").alias("src"), "dst")


def touching(steps: DataFrame, symbols: DataFrame) -> DataFrame:
    """Whole paths that have a step among the symbols."""
    ids = steps.join(symbols.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("process_id").distinct()
    return steps.join(ids, "process_id", "left_semi")


def transitions_by_file(steps: DataFrame, owner: DataFrame, rows: int = 0) -> DataFrame:
    """(file, src, dst, weight): of each file the transitions of all paths that touch one of its symbols (owner: id, file), counted. Repeated steps are no transition.

    A path's transitions are counted once and then meet the files that it touches, so paths grow by their files and not by their symbols. They are sent with the list of these files
    and become rows of a file where all of a kind are together. Steps are ordered once and written; ``rows`` is their number, for partitions of a fixed size.
    """
    spark = steps.sparkSession
    nxt = F.lead("node_id").over(W.partitionBy("process_id").orderBy("step", "node_id"))
    paths = cut(steps.select("process_id", "node_id", nxt.alias("dst")), rows)
    by_path = lambda df: df.repartition(parts(spark, rows), "process_id")
    touched = paths.select("process_id", "node_id").join(owner.filter("file IS NOT NULL").select(F.col("id").alias("node_id"), "file"), "node_id").select("process_id", "file")
    files = by_path(touched).groupBy("process_id").agg(F.collect_set("file").alias("files"))
    arcs = by_path(paths.filter("node_id <> dst").select("process_id", F.col("node_id").alias("src"), "dst")).groupBy("process_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    alike = arcs.join(files.hint("merge"), "process_id").select("src", "dst", "files", "n").repartition(parts(spark, 4 * rows), "src", "dst")
    return alike.select(F.explode("files").alias("file"), "src", "dst", "n").groupBy("file", "src", "dst").agg(F.sum("n").cast("double").alias("weight"))
