"""Comparing two versions of files: deltas, verdict movement, suspicion, regressions by function, changesets.

Versions are (file_id, mask, simple, composable, secure, navigable) rows, before and after.
"""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import PILLARS, leq

#: A smaller distance with a larger gain is suspicious; lines of a regression report; pillars of a changeset.
SUSPICIOUS_DISTANCE, SUSPICIOUS_GAIN, DIFF_LINES = 0.02, 3.0, 40
CHANGESET_PILLARS = ("simple", "composable", "secure")


def score_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, mask_before, mask_after, d_<pillar>): score changes in percent, one decimal; a missing score is 0."""
    b = before.select("file_id", F.col("mask").alias("mask_before"), *[F.col(p).alias(f"_b_{p}") for p in PILLARS])
    a = after.select("file_id", F.col("mask").alias("mask_after"), *[F.col(p).alias(f"_a_{p}") for p in PILLARS])
    zero = F.lit(0.0)
    j = b.join(a, "file_id", "full_outer")
    return j.select("file_id", *[F.coalesce(m, F.lit(0)).alias(m) for m in ("mask_before", "mask_after")], *[F.round(100 * (F.coalesce(f"_a_{p}", zero) - F.coalesce(f"_b_{p}", zero)), 1).alias(f"d_{p}") for p in PILLARS])


def status(deltas: DataFrame, distance: DataFrame | None = None) -> DataFrame:
    """Adds status: improvement, regression, score_up, score_down, lateral; suspicious where a gain comes with hardly any change.

    With equal verdicts, scores are up if one rises and none falls, down if one falls and none rises. ``distance`` has (file_id, distance):
    the share of the tree that changed; a file without one is never suspicious.
    """
    a, b = F.col("mask_before"), F.col("mask_after")
    d = [F.col(f"d_{p}") for p in PILLARS]
    up, down = F.greatest(*d) > 0, F.least(*d) < 0
    same = F.when(up & ~down, "score_up").when(down & ~up, "score_down").otherwise("lateral")
    out = F.when(a == b, same).when(leq(a, b), "improvement").when(leq(b, a), "regression").otherwise("lateral")
    if distance is None:
        return deltas.withColumn("status", out)
    j = deltas.join(distance.select("file_id", "distance"), "file_id", "left").withColumn("status", out)
    gain = F.greatest(*[F.abs(x) for x in d]) >= SUSPICIOUS_GAIN
    odd = F.col("status").isin("improvement", "score_up") & F.coalesce(F.col("distance") < SUSPICIOUS_DISTANCE, F.lit(False)) & gain
    return j.withColumn("status", F.when(odd, "suspicious").otherwise(F.col("status")))


def complexity_relocated(metric_deltas: DataFrame) -> DataFrame:
    """Files whose largest function shrank while the file's cyclomatic number grew."""
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("delta")))
    w = metric_deltas.groupBy("file_id").agg(pick("ast.max_function_complexity").alias("f"), pick("cfg.cyclomatic").alias("c"))
    return w.filter("f < 0 AND c > 0").select("file_id")


def function_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, qualified, before, after, change) of all functions (file_id, qualified, complexity) that differ."""
    j = before.select("file_id", "qualified", F.col("complexity").alias("before")).join(after.select("file_id", "qualified", F.col("complexity").alias("after")), ["file_id", "qualified"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("after") > F.col("before"), "worse").when(F.col("after") < F.col("before"), "better")
    return j.withColumn("change", change).filter("change IS NOT NULL")


def _unified(name: str, before: str, after: str, was: int, now: int) -> str | None:
    body = list(difflib.unified_diff(before.split("\n"), after.split("\n"), f"{name} (current)", f"{name} (proposed)", lineterm=""))
    if not body:
        return None
    if len(body) > DIFF_LINES:
        body = [*body[:DIFF_LINES], f"# ... (truncated, {len(body) - DIFF_LINES} more lines)"]
    return "\n".join([f"# regression in `{name}`: cyclomatic complexity {was} -> {now} ({now - was:+d})", *body])


def regression_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, name, before, after, diff): each file's function that grew most, and the line diff of its text.

    Functions are (file_id, name, start_line, complexity, text); of several of one name the first counts. Files without a function
    that grew have no row; of equal growth the smallest name is taken. A diff beyond DIFF_LINES lines is cut short, with a note.
    """
    first = lambda df, c: df.groupBy("file_id", "name").agg(F.min_by(F.struct("complexity", "text"), "start_line").alias(c))
    j = first(before, "x").join(first(after, "y"), ["file_id", "name"]).withColumn("grown", F.col("y.complexity") - F.col("x.complexity")).filter("grown > 0")
    worst = j.groupBy("file_id").agg(F.min_by(F.struct("name", "x", "y"), F.struct(-F.col("grown"), "name")).alias("w")).select("file_id", "w.*")
    diff = F.udf(_unified, "string", useArrow=True)
    out = worst.select("file_id", "name", F.col("x.complexity").alias("before"), F.col("y.complexity").alias("after"), "x", "y")
    return out.withColumn("diff", diff("name", F.col("x.text"), F.col("y.text"), "before", "after")).drop("x", "y")


def changeset(results: DataFrame, classified: DataFrame, strict: bool = False) -> DataFrame:
    """(pillar, ok, min_score): a pillar holds only if it is measured and passes in every file, and every file parses. ``strict`` includes navigable.

    ``classified``: file_id, is_parseable and the scores. A pillar that no file has measured has no row.
    """
    pillars = PILLARS if strict else CHANGESET_PILLARS
    n = classified.agg(F.count(F.lit(1)).alias("n"))
    parse = classified.select("file_id", "is_parseable")
    ok = results.join(parse, "file_id").groupBy("pillar").agg(F.count_if(F.col("achieved") & F.col("is_parseable")).alias("passed"))
    low = classified.select(F.stack(F.lit(len(pillars)), *[x for p in pillars for x in (F.lit(p), F.col(p))]).alias("pillar", "score"))
    low = low.groupBy("pillar").agg(F.round(100 * F.min("score"), 1).alias("min_score"))
    j = low.join(ok, "pillar").crossJoin(F.broadcast(n))  # one row
    return j.select("pillar", (F.coalesce("passed", F.lit(0)) == F.col("n")).alias("ok"), "min_score")
