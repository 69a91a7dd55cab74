"""Gates, scores and verdicts: a constant gate table met by metrics, folded to one mask a file.

Metrics are a long table (file_id, metric, value). They are grouped to one wide row a file once; scores, gate results, pillars and the verdict are
expressions over that row, so classifying takes one shuffle. Roles (is_entrypoint, is_stable_leaf) and is_parseable are optional
columns of a files table. A file that does not parse has no metrics, no scores and no pillar: its mask is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lattice import BITS, PILLARS
from ..functions.rounding import formatted

#: Metric, pillar, low, high, whether the gate decides its pillar, exemption.
GATES = (
    ("cfg.cyclomatic", "simple", None, 15.0, False, None),
    ("ast.entropy", "simple", 0.2, 0.8, True, "entrypoint"),
    ("ast.max_function_complexity", "simple", None, 10.0, True, None),
    ("mdg.instability", "composable", 0.3, 0.7, False, "unused entrypoint"),
    ("mdg.main_sequence_distance", "composable", None, 0.5, False, "stable leaf"),
    ("mdg.fan_in", "composable", None, 15.0, False, None),
    ("mdg.fan_out", "composable", None, 10.0, True, None),
    ("cpg.dangerous_calls", "secure", None, 0.0, True, None),
    ("cpg.taint_flows", "secure", None, 0.0, True, None),
    ("nav.max_function_divergence", "navigable", None, 10.0, True, None),
)
#: What a gate is measured on, and the operations that mend a value below and above its band.
REMEDIES = {
    "cfg.cyclomatic": ("function", (), ("extract_helper", "split_decision_logic")),
    "ast.entropy": ("module", ("consolidate_boilerplate",), ("decompose_dense_logic",)),
    "ast.max_function_complexity": ("function", (), ("extract_helper", "split_decision_logic")),
    "mdg.instability": ("module", ("rebalance_dependencies", "extract_boundary"), ("rebalance_dependencies", "extract_boundary")),
    "mdg.main_sequence_distance": ("module", (), ("rebalance_dependencies", "extract_boundary")),
    "mdg.fan_in": ("file", (), ("split_module",)),
    "mdg.fan_out": ("file", (), ("reduce_fanout", "invert_dependency")),
    "cpg.dangerous_calls": ("module", (), ()),
    "cpg.taint_flows": ("module", (), ()),
    "nav.max_function_divergence": ("function", (), ("extract_helper", "split_decision_logic")),
}
#: The lines on a gate result, by outcome; "*" stands for the outcomes that are not listed.
LINES = {
    "cfg.cyclomatic": {"pass": "cyclomatic complexity (%.0f) within threshold (<= 15)", "*": "cyclomatic complexity (%.0f) exceeds threshold (> 15)"},
    "ast.entropy": {
        "pass": "entropy (%.2f) within structured range [0.2, 0.8]",
        "exempt_low": "entropy (%.2f) is low, but tolerated for import/export-only entrypoint modules",
        "exempt_high": "entropy (%.2f) is high, but tolerated for import/export-only entrypoint modules",
        "fail_low": "entropy (%.2f) is too low; code may be repetitive or trivial",
        "fail_high": "entropy (%.2f) is too high; code may be unstructured",
    },
    "ast.max_function_complexity": {"pass": "max function complexity (%.0f) within threshold (<= 10)", "*": "max function complexity (%.0f) exceeds threshold (> 10)"},
    "mdg.instability": {
        "pass": "instability (%.2f) within balanced range [0.3, 0.7]",
        "fail_low": "instability (%.2f) is too low (module is too stable)",
        "exempt_high": "instability (%.2f) is high, but tolerated for import/export-only entrypoint modules",
        "*": "instability (%.2f) is too high (module depends on too many things)",
    },
    "mdg.main_sequence_distance": {
        "pass": "main-sequence distance (%.2f) within tolerance (<= 0.5) -- instability and abstractness are balanced",
        "exempt_high": "main-sequence distance (%.2f) is high, but tolerated for frozen, declarations-only leaf modules",
        "*": "main-sequence distance (%.2f) exceeds threshold (> 0.5) -- module is too concrete-and-stable (rigid) or too abstract-and-unstable (speculative) for its role",
    },
    "mdg.fan_in": {"pass": "fan-in (%.0f) within advisory reference (<= 15)", "*": "fan-in (%.0f) exceeds advisory reference (> 15)"},
    "mdg.fan_out": {"pass": "fan-out (%.0f) within threshold (<= 10)", "*": "fan-out (%.0f) exceeds threshold (> 10)"},
    "cpg.dangerous_calls": {"pass": "no reachable dangerous-API calls (%.0f <= 0)", "*": "%.0f dangerous-API call site(s) exceeds threshold (0)"},
    "cpg.taint_flows": {"pass": "no source→sink taint paths (%.0f <= 0)", "*": "%.0f taint flow path(s) exceeds threshold (0)"},
    "nav.max_function_divergence": {
        "pass": "worst-function nesting divergence (%.1f) within threshold (<= 10)",
        "*": "worst-function nesting divergence (%.1f) exceeds threshold (> 10); flatten the deepest nested block",
    },
}
#: Fixed values of the scores, of the exemptions, and the least coupling that makes instability a measurement.
CYCLOMATIC_CAP, COMPLEXITY_CAP, FAN_CAP, DIVERGENCE_CAP, DECAY, DISTANCE_MAX = 40.0, 20.0, 40.0, 12.0, 3.0, 0.5
INSTABILITY_LOW, INSTABILITY_HIGH, SMALL_BYTES, IDEAL_ENTROPY = 0.3, 0.7, 200, 0.5
ENTRYPOINT_INSTABILITY, LEAF_INSTABILITY, LEAST_COUPLING = 0.95, 0.05, 2
#: Score floors of an older verdict.
SCORE_FLOORS = {"simple": 0.40, "composable": 0.80, "secure": 1.00, "navigable": 0.40}
MEASURES = tuple(g[0] for g in GATES if g[0] != "mdg.main_sequence_distance")
HELPERS = ("mdg.coupling", "mdg.abstractness", "ast.n_bytes")


def gate_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GATES, "metric string, pillar string, low double, high double, deciding boolean, exemption string")


def pillar_of(metric: Column) -> Column:
    """By the metric's prefix; simple for an unknown one."""
    prefix = F.split(metric, "\\.")[0]
    return F.when(prefix == "mdg", "composable").when(prefix == "cpg", "secure").when(prefix == "nav", "navigable").otherwise("simple")


def column(metric: str) -> Column:
    return F.col(metric.replace(".", "_"))


def wide(metrics: DataFrame) -> DataFrame:
    """One row a file, a column a metric (dots as underscores)."""
    return metrics.groupBy("file_id").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m.replace(".", "_")) for m in (*MEASURES, *HELPERS)])


def by_distance() -> Column:
    """Whether the distance from the main sequence stands in for instability: abstractness and coupling carry a signal."""
    return column("mdg.instability").isNotNull() & F.coalesce(column("mdg.abstractness") > 0, F.lit(False)) & F.coalesce(column("mdg.coupling") >= LEAST_COUPLING, F.lit(False))


def gate_value(metric: str) -> Column:
    """What a gate sees of a wide row: the distance or the instability, never both."""
    distance = F.abs(column("mdg.abstractness") + column("mdg.instability") - 1)
    if metric == "mdg.main_sequence_distance":
        return F.when(by_distance(), distance)
    return F.when(~by_distance(), column(metric)) if metric == "mdg.instability" else column(metric)


def _exempt(kind: str | None, value: Column) -> Column:
    """An unmeasured metric never grants an exemption."""
    entry, leaf = F.coalesce("is_entrypoint", F.lit(False)), F.coalesce("is_stable_leaf", F.lit(False))
    if kind == "entrypoint":
        return entry
    if kind == "unused entrypoint":
        return entry & (value >= ENTRYPOINT_INSTABILITY) & F.coalesce(column("mdg.fan_in") == 0, F.lit(False))
    if kind == "stable leaf":
        return leaf & F.coalesce(column("mdg.instability") <= LEAF_INSTABILITY, F.lit(False))
    return F.lit(False)


def _gate(metric: str, pillar: str, low: float | None, high: float | None, deciding: bool, exemption: str | None) -> Column:
    """The gate's result as a struct; null where the metric is not there. NaN fails, at the high bound where there is one."""
    v = gate_value(metric)
    below = v < low if low is not None else F.lit(False)
    above = v > high if high is not None else F.lit(False)
    side = F.when(below, "low").when(above, "high")
    outcome = F.when(F.isnan(v), "fail_high" if high is not None else "fail_low").when(side.isNull(), "pass")
    outcome = outcome.when(_exempt(exemption, v), F.concat(F.lit("exempt_"), side)).otherwise(F.concat(F.lit("fail_"), side))
    fields = F.struct(F.lit(metric).alias("metric"), F.lit(pillar).alias("pillar"), v.alias("value"), F.lit(deciding).alias("deciding"), outcome.alias("outcome"), (~outcome.startswith("fail")).alias("passed"))
    return F.when(v.isNotNull(), fields)


def _rows(metrics: DataFrame, files: DataFrame | None, pillar: str | None, listed: bool = False) -> DataFrame:
    """One row for each file that has metrics, or that is ``listed`` in files: files' columns, the wide metrics, gates (array of results).

    A file that files does not list has no role and parses.
    """
    flags = {"is_entrypoint": False, "is_stable_leaf": False, "is_parseable": True}
    own = wide(metrics)
    if files is not None:
        roles = files if listed else files.select("file_id", *[c for c in flags if c in files.columns])
        own = files.join(own, "file_id", "left") if listed else own.join(roles, "file_id", "left")
    own = own.withColumns({n: F.coalesce(n, F.lit(False if listed else usual)) if n in own.columns else F.lit(usual) for n, usual in flags.items()})
    own = own.withColumns({m.replace(".", "_"): F.when(F.col("is_parseable"), column(m)) for m in (*MEASURES, *HELPERS)})
    return own.withColumn("gates", F.filter(F.array(*[_gate(*g) for g in GATES if pillar in (None, g[1])]), lambda x: x.isNotNull()))


def outcomes(metrics: DataFrame, roles: DataFrame | None = None, pillar: str | None = None) -> DataFrame:
    """(file_id, metric, pillar, value, deciding, outcome, passed) of every metric that has a gate, or of one pillar's."""
    return _rows(metrics, roles, pillar).select("file_id", F.explode("gates").alias("g")).select("file_id", "g.*")


def interpretation() -> Column:
    """The line on an outcome row."""
    out = None
    for metric, lines in LINES.items():
        said = F.lit(None).cast("string")
        for outcome, text in reversed(lines.items()):
            line = formatted(text, F.col("value"))
            said = line if outcome == "*" else F.when(F.col("outcome") == outcome, line).otherwise(said)
        own = F.col("metric") == metric
        out = F.when(own, said) if out is None else out.when(own, said)
    return out


def operations() -> Column:
    """The operations that an outcome row recommends; none within the band."""
    out = F.array().cast("array<string>")
    for metric, (_, low, high) in REMEDIES.items():
        listed = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
        own = F.when(F.col("outcome") == "pass", F.array().cast("array<string>")).when(F.col("outcome").endswith("low"), listed(low)).otherwise(listed(high))
        out = F.when(F.col("metric") == metric, own).otherwise(out)
    return out


def threshold() -> Column:
    """The bound on the violated side of an outcome row; null within the band."""
    out = F.lit(None).cast("double")
    for metric, _, low, high, _, _ in GATES:
        own = F.when(F.col("outcome") == "pass", F.lit(None).cast("double")).when(F.col("outcome").endswith("low"), F.lit(low).cast("double")).otherwise(F.lit(high).cast("double"))
        out = F.when(F.col("metric") == metric, own).otherwise(out)
    return out


def _score_columns() -> dict[str, Column]:
    c = column
    cap = lambda v, most: F.when(v.isNotNull(), 1 - F.least(v / most, F.lit(1.0)))
    off = c("ast.entropy") - IDEAL_ENTROPY
    entropy = F.when(F.coalesce(c("ast.n_bytes") < SMALL_BYTES, F.lit(False)) & (off > 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 2 * F.abs(off)))
    i = c("mdg.instability")
    tent = F.when(i.between(INSTABILITY_LOW, INSTABILITY_HIGH), 1.0).when(i < INSTABILITY_LOW, i / INSTABILITY_LOW).otherwise(F.greatest(F.lit(0.0), (1 - i) / (1 - INSTABILITY_HIGH)))
    shape = F.when(by_distance(), 1 - F.least(gate_value("mdg.main_sequence_distance") / DISTANCE_MAX, F.lit(1.0))).otherwise(tent)
    decay = lambda v: F.when(v.isNotNull(), F.exp(-F.greatest(v, F.lit(0.0)) / DECAY))
    return {
        "simple": F.least(cap(c("cfg.cyclomatic"), CYCLOMATIC_CAP), F.when(c("ast.entropy").isNotNull(), entropy), cap(c("ast.max_function_complexity"), COMPLEXITY_CAP)),
        "composable": F.least(F.when(i.isNotNull(), shape), cap(c("mdg.fan_in"), FAN_CAP), cap(c("mdg.fan_out"), FAN_CAP)),
        "secure": F.least(decay(c("cpg.dangerous_calls")), decay(c("cpg.taint_flows"))),
        "navigable": cap(c("nav.max_function_divergence"), DIVERGENCE_CAP),
    }


def scores(metrics: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row a file: simple, composable, secure, navigable; null where a pillar is not measured. Each is its weakest quality."""
    return _rows(metrics, files, None).select("file_id", *[s.alias(p) for p, s in _score_columns().items()])


def meets_floor(pillar: str, score: Column) -> Column:
    """Whether a score reaches the pillar's floor (an older verdict than the gates')."""
    return score >= SCORE_FLOORS[pillar]


def _of(pillar: str):
    return lambda g: g["pillar"] == pillar


def _results() -> Column:
    """Of a row with gates: an array of (pillar, achieved), one for each pillar that has a gate's metric. Deciding gates must pass."""
    out = []
    for p in PILLARS:
        own = F.filter("gates", _of(p))
        out.append(F.when(F.size(own) > 0, F.struct(F.lit(p).alias("pillar"), F.forall(own, lambda g: ~g["deciding"] | g["passed"]).alias("achieved"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def classify(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """files' columns, mask, the four scores, gates (array of results) and results (array of pillar, achieved): one row a file."""
    rows = _rows(metrics, files, None, listed=True).withColumn("results", _results())
    kept = F.transform(F.filter("results", lambda r: r["achieved"]), lambda r: r["pillar"])
    mask = sum((F.when(F.array_contains(kept, p), b).otherwise(0) for p, b in BITS.items()), F.lit(0)).cast("int")
    return rows.select(*files.columns, mask.alias("mask"), *[s.alias(p) for p, s in _score_columns().items()], "gates", "results")


def pillars(metrics: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """(file_id, pillar, achieved) of measured pillars: all deciding gates that are present pass."""
    return _rows(metrics, roles, None).select("file_id", F.explode(_results()).alias("r")).select("file_id", "r.*")


def bit(pillar: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in BITS.items() for x in kv]), pillar)


def verdicts(files: DataFrame, metrics: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """files' columns and mask: the OR of achieved bits; 0 for a file that does not parse. ``roles`` adds its columns where files lacks them."""
    if roles is not None:
        more = [c for c in ("is_entrypoint", "is_stable_leaf") if c in roles.columns and c not in files.columns]
        own = files.join(roles.select("file_id", *more), "file_id", "left") if more else files
        return classify(own, metrics).select(*files.columns, "mask")
    return classify(files, metrics).select(*files.columns, "mask")


def weakest(score_row: DataFrame) -> Column:
    """The smallest of a row's scores; 0 without any."""
    return F.coalesce(F.least(*[F.col(p) for p in PILLARS]), F.lit(0.0))
