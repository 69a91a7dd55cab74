"""Rollups, rankings, top lists and pages over classified files.

``classified``: file_id, path, language, is_parseable, mask and the pillar scores; ``results``: file_id, pillar, achieved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lattice import PILLARS
from ..functions.lattice import name as lattice_name
from ..functions.rounding import formatted
from .gates import bit, threshold, weakest

#: Files listed as worst, rows of a page and their bounds, cyclomatic number of a giant.
WORST, PAGE, PAGE_MAX, GIANT = 3, 25, 500, 15


def percent(score: Column) -> Column:
    return F.round(score * 100, 1)


def rollup(classified: DataFrame, results: DataFrame, by: str | None = "language") -> DataFrame:
    """(grp, is_total, pillar, holds, min_score): per pillar, in total and by ``by``, whether every file passes, and the smallest score in percent.

    A pillar appears where a file has it measured. It holds if every file parses and, where measured, passes: a file without it
    passes vacuously. Files without a value of ``by`` are a group of their own, whose grp is null as the total's is.
    """
    total = F.struct(F.lit(None).cast("string").alias("grp"), F.lit(True).alias("is_total"))
    groups = F.array(total, F.struct(F.col(by).cast("string").alias("grp"), F.lit(False).alias("is_total"))) if by else F.array(total)
    one = classified.select("file_id", "is_parseable", *PILLARS, F.explode(groups).alias("g")).select("*", "g.*").drop("g")
    key = ["grp", "is_total"]
    parse = one.groupBy(*key).agg(F.bool_and("is_parseable").alias("parses"), *[F.min(p).alias(p) for p in PILLARS])
    met = results.join(one.select("file_id", *key), "file_id").groupBy(*key, "pillar").agg(F.bool_and("achieved").alias("ok"))
    p = parse.select(*[F.col(c).alias("_" + c) for c in key], "parses", *PILLARS)
    out = met.join(p, met["grp"].eqNullSafe(F.col("_grp")) & (met["is_total"] == F.col("_is_total")))
    low = F.lit(None).cast("double")
    for name in PILLARS:
        low = F.when(F.col("pillar") == name, F.col(name)).otherwise(low)
    return out.select(*key, "pillar", (F.col("ok") & F.col("parses")).alias("holds"), percent(low).alias("min_score"))


def language_summary(keyed: DataFrame) -> DataFrame:
    """(language, files, parse_failures, worst_file): the worst file is the one of the smallest weakest score, then path."""
    return keyed.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("is_parseable")).alias("parse_failures"), F.min_by("path", F.struct("weakest", "path")).alias("worst_file"))


def floor_verdict(rolled: DataFrame) -> DataFrame:
    """(grp, is_total, mask): bits of the pillars that hold."""
    return rolled.groupBy("grp", "is_total").agg(F.coalesce(F.bit_or(F.when(F.col("holds"), bit(F.col("pillar")))), F.lit(0)).cast("int").alias("mask"))


def with_sort_key(classified: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Adds weakest, failures, and the key that ranks files: hard failures by count, then giants by size, then by weakest score.

    Failures are those of deciding gates; a file that does not parse is a hard failure too, with none.
    """
    decided = outcomes.groupBy("file_id").agg(F.count_if(F.col("deciding") & ~F.col("passed")).alias("failures"), F.max(F.when(F.col("metric") == "cfg.cyclomatic", F.col("value"))).alias("cyclomatic"))
    out = classified.join(decided, "file_id", "left").na.fill(0, ["failures"])
    out = out.withColumn("hard_fail", ~F.col("is_parseable") | (F.col("failures") > 0)).withColumn("weakest", weakest(out))
    giant = ~F.col("hard_fail") & (F.coalesce("cyclomatic", F.lit(0.0)) > GIANT)
    key = F.when(F.col("hard_fail"), F.struct(F.lit(0).alias("a"), (-F.col("failures")).cast("double").alias("b"), F.col("weakest").alias("c")))
    key = key.when(giant, F.struct(F.lit(1).alias("a"), (-F.col("cyclomatic")).alias("b"), F.lit(0.0).alias("c"))).otherwise(F.struct(F.lit(2).alias("a"), F.col("weakest").alias("b"), F.lit(0.0).alias("c")))
    return out.withColumn("giant", giant).withColumn("sort_key", key)


def hard_fails(keyed: DataFrame) -> DataFrame:
    """In no order: sort_key, then path, ranks them."""
    return keyed.filter("hard_fail")


def giants(keyed: DataFrame) -> DataFrame:
    """In no order, as hard_fails."""
    return keyed.filter("giant")


def worst_files(keyed: DataFrame, n: int = WORST) -> DataFrame:
    return keyed.orderBy("weakest", "path").limit(n)


def page(keyed: DataFrame, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of the ranking, with whether there is more and where it begins."""
    limit = max(1, min(PAGE_MAX, limit))
    total = keyed.agg(F.count(F.lit(1)).alias("total"))
    out = keyed.orderBy("sort_key", "path").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row
    more = F.col("total") > offset + limit
    return out.withColumn("has_more", more).withColumn("next_offset", F.when(more, offset + limit))


def by_mean_score(classified: DataFrame, n: int | None = None) -> DataFrame:
    """The ``n`` files of the smallest mean score, then path; all of them, in no order, without ``n``."""
    held = F.filter(F.array(*[F.col(p) for p in PILLARS]), lambda x: x.isNotNull())
    mean = F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held)).otherwise(0.0)
    out = classified.withColumn("mean_score", mean)
    return out.orderBy("mean_score", "path").limit(n) if n else out


def pillar_failures(classified: DataFrame, results: DataFrame, pillar: str) -> DataFrame:
    bad = results.filter((F.col("pillar") == pillar) & ~F.col("achieved")).select("file_id")
    return classified.join(bad, "file_id", "left_semi")


def failure_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("pillar").agg(F.count_if(~F.col("achieved")).alias("failures"))


def json_rows(classified: DataFrame) -> DataFrame:
    """(path, json): one JSON object a file, scores in percent with one decimal."""
    score = F.struct(*[percent(F.col(p)).alias(p) for p in PILLARS])
    return classified.select("path", F.to_json(F.struct("path", "language", "is_parseable", "mask", score.alias("scores"))).alias("json"))


def structured(classified: DataFrame, suggested: DataFrame, targets: DataFrame | None = None, locations: DataFrame | None = None) -> DataFrame:
    """One nested row a file: verdict, scores, gates, pillars, suggestions, targets, locations; lists in their places' order, empty where there is nothing.

    ``classified`` is a table of ``gates.classify``; the others are lists of rows a file with place, as their operators make them.
    """

    def listed(rows: DataFrame, name: str) -> DataFrame:
        fields = [c for c in rows.columns if c not in ("file_id", "place")]
        return rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias(name))

    verdict = F.struct("mask", lattice_name(F.col("mask")).alias("name"), "is_parseable")
    out = classified.select("file_id", "path", "language", verdict.alias("verdict"), F.struct(*PILLARS).alias("scores"), "gates", F.col("results").alias("pillars"))
    for rows, name in ((suggested, "suggestions"), (targets, "targets"), (locations, "locations")):
        if rows is not None:
            own = listed(rows, name)
            out = out.join(own, "file_id", "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return out


def write_structured(rows: DataFrame, path: str) -> None:
    """Replaces the folder's results, one JSON object a file of code. Tasks write files of their own, and the job's commit makes one attempt of each visible: a task that runs twice leaves one copy."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


#: Gates in the order of suggestions, each with its message (%1$ the value, %2$ the bound that it violates).
SUGGESTED = (
    "cfg.cyclomatic", "ast.max_function_complexity", "ast.entropy", "mdg.instability", "mdg.main_sequence_distance", "mdg.fan_out", "mdg.fan_in",
)
MESSAGES = {
    "cfg.cyclomatic": "Collapse redundant decisions or split this file (cyclomatic %1$.0f > %2$.0f) — extracting helpers lowers `ast.max_function_complexity` but raises this whole-file sum.",
    "ast.max_function_complexity": "Split the most complex function (complexity %1$.0f > %2$.0f).",
    "ast.entropy low": "Consolidate repetitive/boilerplate code (entropy %1$.2f < %2$.1f).",
    "ast.entropy high": "Decompose dense logic into named steps (entropy %1$.2f > %2$.1f).",
    "mdg.instability": "Rebalance dependencies (instability %1$.2f; aim for 0.3–0.7).",
    "mdg.main_sequence_distance": "Rebalance abstraction and dependencies (main-sequence distance %1$.2f > %2$.2f).",
    "mdg.fan_out": "Reduce fan-out %1$.0f (> %2$.0f) — introduce an interface or invert the dependency.",
    "mdg.fan_in": "Review this file's responsibility (fan-in %1$.0f > %2$.0f); many external symbols call it.",
}
PARSE_ERROR = "Fix the parse error so the file can be evaluated."


def _message() -> Column:
    kind = F.when(F.col("metric") == "ast.entropy", F.concat("metric", F.when(F.col("outcome").endswith("low"), " low").otherwise(" high"))).otherwise(F.col("metric"))
    out = F.lit(None).cast("string")
    for k, text in MESSAGES.items():
        out = F.when(kind == k, formatted(text, F.col("value"), threshold())).otherwise(out)
    return out


def suggestions(files: DataFrame, outcomes: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(file_id, place, pillar, metric, severity, message): what to do for each file, fixes first, then improvements.

    A file that does not parse gets one line and no other. ``findings`` (file_id, callee, advice, line) come after the gates' fixes.
    """
    order = F.array_position(F.array(*[F.lit(m) for m in SUGGESTED]), F.col("metric"))
    failed = outcomes.filter("NOT passed AND pillar <> 'secure'")
    out = failed.select("file_id", "pillar", "metric", F.when(F.col("deciding"), "fix").otherwise("improve").alias("severity"), _message().alias("message"), order.cast("long").alias("ord")).filter("ord > 0")
    broken = files.filter("NOT is_parseable").select("file_id", F.lit("simple").alias("pillar"), F.lit(None).cast("string").alias("metric"), F.lit("fix").alias("severity"), F.lit(PARSE_ERROR).alias("message"), F.lit(0).cast("long").alias("ord"))
    out = out.unionByName(broken)
    if findings is not None:
        parsed = findings.join(files.filter("is_parseable").select("file_id"), "file_id", "left_semi")
        out = out.unionByName(parsed.select("file_id", F.lit("secure").alias("pillar"), F.col("callee").alias("metric"), F.lit("fix").alias("severity"), F.col("advice").alias("message"), (100 + F.col("line")).cast("long").alias("ord")))
    w = W.partitionBy("file_id").orderBy(F.col("severity") != "fix", "ord", "metric")
    return out.select("file_id", (F.row_number().over(w) - 1).alias("place"), "pillar", "metric", "severity", "message")
