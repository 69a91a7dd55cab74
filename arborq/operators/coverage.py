"""Structural test coverage: how much of each declaration's shape the tests' declarations share.

Fingerprints are (unit, decl, kind, n).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rounding import formatted
from .module_graph import cut
from .tree import CALLABLES

#: Kinds of the statement and expression recalls, thresholds.
STATEMENTS = ("IfStmt", "ForStmt", "WhileStmt", "MatchStmt", "TryStmt", "WithStmt", "ReturnStmt", "ThrowStmt", "ExprStmt", "AssertStmt")
EXPRESSIONS = ("AssignExpr", "BinaryExpr", "UnaryExpr", "CallExpr", "MemberExpr")
COVERED, STRONG, PARTIAL, K = 0.5, 0.25, 0.5, 3


def declarations(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*CALLABLES))


def fingerprints(nodes: DataFrame, include_unknown: bool = True) -> DataFrame:
    """(file_id, decl, kind, n): kinds in each declaration's subtree, less one of its own; without those of no known kind where asked.

    Each declaration asks the running count of each kind of its file at its two ends: linear in declarations times kinds.
    """
    nodes = nodes if include_unknown else nodes.filter("kind <> 'Unknown'")
    d = declarations(nodes).select("file_id", F.col("node_id").alias("decl"), F.col("kind").alias("own"), F.col("pre").alias("a"), F.col("last").alias("b"))
    kinds = nodes.groupBy("file_id").agg(F.collect_set("kind").alias("kinds"))
    end = lambda place, sign: F.struct(place.alias("place"), F.lit(sign).alias("sign"))
    ask = d.join(kinds, "file_id").withColumn("kind", F.explode("kinds")).withColumn("e", F.explode(F.array(end(F.col("a") - 1, -1), end(F.col("b"), 1))))
    ask = ask.select("file_id", "kind", "decl", "own", "e.place", "e.sign")
    none = F.lit(None).cast("string")
    have = nodes.select("file_id", "kind", F.lit(None).cast(d.schema["decl"].dataType).alias("decl"), none.alias("own"), F.col("pre").alias("place"), F.lit(0).alias("sign"))
    w = W.partitionBy("file_id", "kind").orderBy("place", F.abs("sign")).rowsBetween(W.unboundedPreceding, 0)
    met = have.unionByName(ask).withColumn("met", F.sum((F.col("sign") == 0).cast("long")).over(w) * F.col("sign")).filter("sign <> 0")
    h = met.groupBy("file_id", "decl", "own", "kind").agg(F.sum("met").alias("n"))
    return h.select("file_id", "decl", "kind", (F.col("n") - (F.col("kind") == F.col("own")).cast("int")).alias("n")).filter("n > 0")


def _profiles(fingerprint: DataFrame) -> DataFrame:
    """(unit, decl, p, size): each declaration's fingerprint as one sorted array, and its total."""
    return fingerprint.groupBy("unit", "decl").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("p"), F.sum("n").alias("size"))


def best_matches(put_decls: DataFrame, put: DataFrame, test_decls: DataFrame, test: DataFrame) -> DataFrame:
    """(unit, decl, recall): the best multiset recall of each declaration by a test declaration of its unit.

    1 for a declaration with an empty fingerprint whose unit has a test declaration, 0 where nothing matches. Declarations of equal fingerprints
    count as one. A shape that a test declaration has too is met in full and is found by equality; only the others are compared with the different shapes of their unit that
    share a kind with them.
    """
    own = cut(_profiles(put))
    shapes = own.select("unit", "p", "size").distinct()
    others = cut(_profiles(test).select("unit", "p").distinct())
    full = shapes.join(others, ["unit", "p"], "left_semi").select("unit", "p", F.lit(1.0).alias("best"))
    kinds = lambda p: F.transform(p, lambda x: x["kind"])
    left = shapes.join(others, ["unit", "p"], "left_anti").withColumn("kinds", kinds(F.col("p")))
    right = others.select("unit", kinds(F.col("p")).alias("q_kinds"), F.map_from_entries("p").alias("q"))
    common = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.least(x["n"], F.coalesce(F.try_element_at("q", x["kind"]), F.lit(0))).cast("long"))
    near = left.join(right, "unit").filter(F.arrays_overlap("kinds", "q_kinds")).groupBy("unit", "p").agg(F.max(common / F.col("size")).alias("best"))
    with_best = own.join(full.unionByName(near), ["unit", "p"]).select("unit", "decl", "best")
    bare = put_decls.join(put.select("unit", "decl").distinct(), ["unit", "decl"], "left_anti").join(test_decls.select("unit").distinct(), "unit", "left_semi").select("unit", "decl", F.lit(1.0).alias("bare"))
    out = put_decls.select("unit", "decl").join(with_best, ["unit", "decl"], "left").join(bare, ["unit", "decl"], "left")
    return out.select("unit", "decl", F.coalesce("best", "bare", F.lit(0.0)).alias("recall"))


def coverage(put_decls: DataFrame, put: DataFrame, test_decls: DataFrame, test: DataFrame) -> DataFrame:
    """(unit, mean, precision, rate, f2): mean best recall of the declarations and of the test declarations, and the covered share."""
    r = best_matches(put_decls, put, test_decls, test).groupBy("unit").agg(F.avg("recall").alias("mean"), F.avg((F.col("recall") >= COVERED).cast("double")).alias("rate"))
    p = best_matches(test_decls, test, put_decls, put).groupBy("unit").agg(F.avg("recall").alias("precision"))
    out = r.join(p, "unit", "full_outer").na.fill({"mean": 1.0, "rate": 1.0, "precision": 0.0})
    return out.select("unit", "mean", "precision", "rate", f2(F.col("precision"), F.col("mean")).alias("f2"))


def f2(precision, recall):
    return F.when(4 * precision + recall == 0, 0.0).otherwise(5 * precision * recall / (4 * precision + recall))


def multiset_recall(put: DataFrame, test: DataFrame, item: list[str], kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(unit, recall) of all of a unit's items together, of some kinds where given; 1 without any."""
    own = lambda d: (d.filter(F.col("kind").isin(*kinds)) if kinds else d).groupBy("unit", *item).agg(F.sum("n").alias("n"))
    a, b = own(put), own(test).withColumnRenamed("n", "m")
    met = a.join(b, ["unit", *item], "left").na.fill(0, ["m"]).groupBy("unit").agg((F.sum(F.least("n", "m")) / F.sum("n")).alias("recall"))
    return put.select("unit").distinct().join(met, "unit", "left").na.fill(1.0, ["recall"])


def kgrams(sequences: DataFrame, k: int = K) -> DataFrame:
    """(unit, decl, gram, n) of the sliding k-grams of (unit, decl, kinds)."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    starts = F.when(F.size("kinds") >= k, F.sequence(F.lit(1), F.size("kinds") - (k - 1))).otherwise(F.expr("CAST(array() AS array<int>)"))
    g = sequences.select("unit", "decl", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("kinds", i, k), ">"))).alias("gram"))
    return g.groupBy("unit", "decl", "gram").agg(F.count(F.lit(1)).alias("n"))


#: What a decision says.
SAID = ("coverage is strong", "coverage meets the policy threshold", "coverage is partial", "coverage is weak")
RATE, SCORE = "%.0f%% of declarations meet the %.2f threshold", "F2 score is %.3f"


def decision(found: DataFrame, threshold: float = COVERED) -> DataFrame:
    """Adds achieved, threshold and what is said of the mean coverage, of the covered share and of the F2 score."""
    mean = F.col("mean")
    word = F.when(mean >= threshold + STRONG, SAID[0]).when(mean >= threshold, SAID[1]).when(mean >= threshold * PARTIAL, SAID[2]).otherwise(SAID[3])
    out = found.withColumn("achieved", mean >= threshold).withColumn("threshold", F.lit(threshold)).withColumn("interpretation", word)
    return out.withColumn("rate_line", formatted(RATE, F.col("rate") * 100, F.lit(threshold))).withColumn("f2_line", formatted(SCORE, F.col("f2")))


def uncovered(matches: DataFrame, threshold: float = COVERED) -> DataFrame:
    return matches.filter(F.col("recall") < threshold)
