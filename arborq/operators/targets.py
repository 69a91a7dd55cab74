"""Where to start: metric locations, ranked refactor targets, hot spots of one file, the most complex functions.

Functions are located rows (file_id, name, qualified_name, kind, start_line, end_line) with complexity or divergence, as ``tree`` makes them;
outcomes are the gates' rows. Lists of a file are cut by rank within the file, so no order over all files is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .gates import GATES, REMEDIES, interpretation, operations, threshold
from .module_graph import ranked

#: Rows of the lists.
TARGETS, HOTSPOTS, FUNCTIONS = 3, 5, 10
#: Order of pillars without a stated ranking, constraints by kind of target, operations on a located function or module.
PILLAR_RANK = {"simple": 0, "secure": 1, "composable": 2}
LAST_RANK = 99
KEEP_BEHAVIOUR, KEEP_API, NO_ALLOW = "preserve public behavior", "preserve module API unless the caller requested an API change", "do not allowlist unless the risk is intentional and documented"
ON_FUNCTION, ON_MODULE = ("extract_helper", "split_decision_logic"), ("split_module", "extract_cohesive_unit")
MODULE = "<module>"
#: What is said of a cycle, and of an edge or a transition of negative and of other curvature.
CYCLE = "Extract this loop/branch body into its own function to isolate the cycle and shrink cyclomatic complexity."
EDGE = (
    "Highly negative curvature: many otherwise-unrelated modules route coupling through this edge. Consider extracting a shared interface or reducing the shared surface to strengthen it.",
    "Well-supported dependency edge; no action needed.",
)
TRANSITION = (
    "Choke point: many independent execution paths squeeze through this transition. Consider an asynchronous decoupling boundary (message queue / pub-sub), or acknowledge the simplicity trade-off of keeping it.",
    "Well-distributed transition; no action needed.",
)


def _bound(metric: str) -> float:
    return next(g[3] for g in GATES if g[0] == metric)


def metric_locations(outcomes: DataFrame, complexities: DataFrame, divergences: DataFrame) -> DataFrame:
    """(file_id, metric, place, name, qualified_name, kind, start_line, end_line, value, metric_source, includes_nested) of failing gates.

    The functions over the bound, the worst first; for the whole file's cyclomatic number one marker of the module. Files that do not parse
    have no outcomes and so no locations.
    """
    failed = lambda m: outcomes.filter((F.col("metric") == m) & (F.col("value") > _bound(m)))
    shown = ["name", "qualified_name", "kind", "start_line", "end_line"]

    def located(functions: DataFrame, value: str, metric: str, source: str) -> DataFrame:
        own = functions.filter(F.col(value) > _bound(metric)).join(failed(metric).select("file_id"), "file_id", "left_semi")
        return own.select("file_id", F.lit(metric).alias("metric"), F.col(value).cast("double").alias("_by"), *shown, F.round(value).cast("long").alias("value"), F.lit(source).alias("metric_source"), F.lit(None).cast("boolean").alias("includes_nested"))

    line = complexities.schema["start_line"].dataType
    module = failed("cfg.cyclomatic").select("file_id", "metric", F.col("value").alias("_by"), F.lit(MODULE).alias("name"), F.lit(MODULE).alias("qualified_name"), F.lit("module").alias("kind"), F.lit(1).cast(line).alias("start_line"), F.lit(None).cast(line).alias("end_line"), F.col("value").cast("long").alias("value"), F.lit("cfg").alias("metric_source"), F.lit(True).alias("includes_nested"))
    out = located(complexities, "complexity", "ast.max_function_complexity", "ast").unionByName(located(divergences, "divergence", "nav.max_function_divergence", "nav")).unionByName(module)
    w = W.partitionBy("file_id", "metric").orderBy(F.desc("_by"), "start_line", "qualified_name")
    return out.withColumn("place", (F.row_number().over(w) - 1).cast("long")).drop("_by")


def _of_gate(metric: Column, part: str) -> Column:
    """pillar, high or severity of a gate by its metric."""
    value = {"pillar": lambda g: F.lit(g[1]), "high": lambda g: F.lit(g[3]).cast("double"), "severity": lambda g: F.lit("fix" if g[4] else "improve")}[part]
    out = F.lit(None).cast("double" if part == "high" else "string")
    for g in GATES:
        out = F.when(metric == g[0], value(g)).otherwise(out)
    return out


def _target_id(path: Column, metric: Column, symbol: Column, line: Column) -> Column:
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    raw = F.concat(posix, F.lit(":"), metric, F.lit(":"), F.coalesce(symbol, F.lit("")), F.lit(":"), F.coalesce(line.cast("string"), F.lit("")))
    return F.concat(F.lit("rt_"), F.substring(F.sha1(raw.cast("binary")), 1, 12))


def refactor_targets(files: DataFrame, locations: DataFrame, outcomes: DataFrame, findings: DataFrame | None = None, ranking: list[str] | None = None, n: int | None = TARGETS) -> DataFrame:
    """The ``n`` first targets of each file (file_id, path), all of them without ``n``.

    Candidates are the located functions and modules, failing gates of files and modules (other than the secure ones), and the findings
    (file_id, kind, line, snippet, callee, operations). They are ranked by severity and pillar (by pillar first under a stated ranking), then by how far the bound
    is exceeded, line and identifier.
    """
    paths = files.select("file_id", "path")
    names = ["file_id", "kind", "symbol", "line_start", "line_end", "pillar", "metric", "current_value", "threshold", "severity", "operations", "constraint", "evidence", "_id_metric", "_id_symbol", "_id_line"]
    listed = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    line = lambda c: c.cast("long")
    row = lambda df, *cols: df.select("file_id", *[c.alias(x) for c, x in zip(cols, names[1:], strict=True)])
    m, is_module = F.col("metric"), F.col("kind") == "module"
    out = row(
        locations, F.when(is_module, "module").otherwise("function"), F.col("qualified_name"), line(F.col("start_line")), line(F.col("end_line")), _of_gate(m, "pillar"), m, F.col("value").cast("double"), _of_gate(m, "high"), _of_gate(m, "severity"),
        F.when(is_module, listed(ON_MODULE)).otherwise(listed(ON_FUNCTION)), F.lit(KEEP_BEHAVIOUR), F.col("metric_source"), m, F.col("qualified_name"), line(F.col("start_line")),
    )
    wide = [k for k, v in REMEDIES.items() if v[0] in ("file", "module")]
    failed = outcomes.filter(~F.col("passed") & m.isin(*wide) & (F.col("pillar") != "secure"))
    on_file = m.isin(*[k for k, v in REMEDIES.items() if v[0] == "file"])
    scope = F.when(on_file, "<file>").otherwise(MODULE)
    out = out.unionByName(row(
        failed, F.when(on_file, "file").otherwise("module"), scope, F.lit(1).cast("long"), F.lit(None).cast("long"), F.col("pillar"), m, F.col("value"), threshold(), _of_gate(m, "severity"), operations(), F.lit(KEEP_API), interpretation(), m, scope, F.lit(1).cast("long"),
    ))
    if findings is not None:
        callee = F.when(F.col("callee") != "", F.col("callee"))
        out = out.unionByName(row(
            findings, F.lit("security_call"), callee, line(F.col("line")), line(F.col("line")), F.lit("secure"), F.coalesce(callee, F.col("kind")), F.lit(1.0), F.lit(0.0), F.lit("fix"), F.col("operations"), F.lit(NO_ALLOW), F.col("snippet"), F.col("kind"), F.coalesce(callee, F.col("snippet")), line(F.col("line")),
        ))
    places = dict(PILLAR_RANK) | {p: i for i, p in enumerate(ranking or [])}
    rank = F.lit(LAST_RANK)
    for p, i in places.items():
        rank = F.when(F.col("pillar") == p, i).otherwise(rank)
    tier = F.when(F.col("severity") == "fix", 0).otherwise(1)
    excess = F.floor(F.abs(F.col("current_value") - F.coalesce("threshold", F.col("current_value"))) * 100)
    out = out.join(paths, "file_id").withColumn("target_id", _target_id(F.col("path"), F.col("_id_metric"), F.col("_id_symbol"), F.col("_id_line"))).drop("_id_metric", "_id_symbol", "_id_line")
    by = [rank, tier] if ranking else [tier, rank]
    w = W.partitionBy("file_id").orderBy(*by, -excess, F.coalesce("line_start", F.lit(0)), "target_id")
    out = out.withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    return out.filter(F.col("place") < n) if n is not None else out


def cycle_hotspots(spans: DataFrame, cycles: DataFrame, n: int = HOTSPOTS) -> DataFrame:
    """(file_id, kind, label, line_start, line_end, score, suggestion): each file's cycles (cycles: file_id, cycle, blocks) by their span in lines."""
    j = cycles.join(spans, ["file_id", "cycle"], "left")
    span = F.coalesce(F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)), F.lit(0))
    label = F.concat(F.lit("cycle over blocks ["), F.array_join(F.col("blocks").cast("array<string>"), ", "), F.lit("]"))
    j = j.select("file_id", F.lit("cycle").alias("kind"), label.alias("label"), F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), span.cast("double").alias("score"), F.lit(CYCLE).alias("suggestion"), "cycle")
    return ranked(j, [F.desc("score"), F.col("cycle")], ["file_id"], n).drop("cycle")


def _curved(edges: DataFrame, kind: str, said: tuple[str, str], within: list[str], n: int) -> DataFrame:
    # labels are made for the first n scores and their ties alone
    edges = edges.withColumn("_rank", F.rank().over(W.partitionBy(*within).orderBy("curvature"))).filter(F.col("_rank") <= n).drop("_rank")
    label = F.concat(F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"))
    own = edges.select(*within, F.lit(kind).alias("kind"), label.alias("label"), F.col("curvature").alias("score"), F.when(F.col("curvature") < 0, said[0]).otherwise(said[1]).alias("suggestion"))
    return ranked(own, [F.col("score"), F.col("label")], within, n)


def dependency_hotspots(curvature: DataFrame, files: DataFrame, n: int = HOTSPOTS) -> DataFrame:
    """(file, kind, label, score, suggestion): of each file (file) the edges (a, b, curvature) that touch it, the most negative first."""
    ends = curvature.select(F.explode(F.array("a", "b")).alias("file"), F.col("a").alias("src"), F.col("b").alias("dst"), "curvature")
    return _curved(ends.join(files.select("file").distinct(), "file", "left_semi"), "dependency_edge", EDGE, ["file"], n)


def process_hotspots(curvature: DataFrame, n: int = HOTSPOTS) -> DataFrame:
    """(file, kind, label, score, suggestion): of each file's process graph (file, src, dst, curvature) the most negative transitions first."""
    return _curved(curvature, "process_transition", TRANSITION, ["file"], n)


def top_functions(complexities: DataFrame, n: int = FUNCTIONS) -> DataFrame:
    """The ``n`` most complex functions of each file, with their number in all."""
    total = F.count(F.lit(1)).over(W.partitionBy("file_id"))
    w = W.partitionBy("file_id").orderBy(F.desc("complexity"), "start_line", "qualified_name")
    return complexities.withColumn("total_functions", total).withColumn("place", (F.row_number().over(w) - 1).cast("long")).filter(F.col("place") < n)
