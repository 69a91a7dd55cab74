"""Data and control dependence, and the property graph of all four edge families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .compare import jaccard
from .module_graph import cut, sorted_join
from .tree import ancestors

FAMILIES = ("ast", "cfg", "ddg", "cdg")


def defs_and_uses(nodes: DataFrame, statements: DataFrame) -> DataFrame:
    """(file_id, stmt, var, is_def): the names that each statement's subtree defines and uses.

    ``nodes`` is a syntax table with name (or text) of identifiers; ``statements`` has (file_id, stmt). An identifier below the first child of the
    nearest assignment within the statement is a definition, any other one a use.
    """
    chosen = statements.select("file_id", F.col("stmt").alias("node_id")).distinct().withColumn("_stmt", F.lit(True))
    own = sorted_join(nodes, chosen, ["file_id", "node_id"], "left").withColumn("_stmt", F.coalesce("_stmt", F.lit(False)))
    ident, assign = F.col("kind") == "Identifier", F.col("kind") == "AssignExpr"
    # the last place of an assignment's first child, which is the node right behind it
    follows = F.lead(F.struct("pre", "last")).over(W.partitionBy("file_id").orderBy("pre"))
    own = own.withColumn("_first", F.when(assign & (follows["pre"] <= F.col("last")), follows["last"]))
    text = F.trim("text") if "text" in nodes.columns else F.lit("")
    var = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.when(text != "", text), F.col("node_id")) if "name" in nodes.columns else F.coalesce(F.when(text != "", text), F.col("node_id"))
    keep = ("node_id", "_var", "_first", "_stmt")
    named = own.withColumn("_var", F.when(ident, var))
    at = ancestors(named, F.col("_stmt") | assign, ident, keep, strict=False).select("file_id", "pre", F.col("node_id").alias("id"), "_var", "level", "anc")
    # assignments between a statement and the identifier: the innermost decides
    inner = W.partitionBy("file_id", "id").orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, 0)
    near = F.first(F.when(F.col("anc._first").isNotNull(), F.struct(F.col("anc.pre").alias("pre"), F.col("anc._first").alias("first"))), ignorenulls=True).over(inner)
    found = at.withColumn("near", near).filter("anc._stmt")
    is_def = F.coalesce((F.col("near.pre") < F.col("pre")) & (F.col("pre") <= F.col("near.first")), F.lit(False))
    return found.select("file_id", F.col("anc.node_id").alias("stmt"), F.col("_var").alias("var"), is_def.alias("is_def")).distinct()


def accesses(nodes: DataFrame, procedures: DataFrame) -> DataFrame:
    """(file_id, proc, stmt, ord, var, is_def) of the statements by procedure: what reaching_definitions takes."""
    return sorted_join(procedures, defs_and_uses(nodes, procedures), ["file_id", "stmt"]).select("file_id", "proc", "stmt", "ord", "var", "is_def")


def reaching_definitions(accesses: DataFrame) -> DataFrame:
    """(file_id, proc, src, dst, var) of accesses (file_id, proc, stmt, ord, var, is_def): the last definition before a use, in textual order.

    The frame ends one place before the use, so a statement's own definition never reaches its own use.
    """
    one = accesses.groupBy("file_id", "proc", "stmt", "ord", "var").agg(F.bool_or("is_def").alias("defs"), F.bool_or(~F.col("is_def")).alias("uses"))
    w = W.partitionBy("file_id", "proc", "var").orderBy("ord").rangeBetween(W.unboundedPreceding, -1)
    src = F.last(F.when(F.col("defs"), F.col("stmt")), ignorenulls=True).over(w)
    return one.withColumn("src", src).filter("uses AND src IS NOT NULL AND src <> stmt").select("file_id", "proc", "src", F.col("stmt").alias("dst"), "var")


def control_dependence(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, src, dst): for each branching edge the last statement of its source block to every statement of its target block."""
    own = edges.filter(F.col("kind").isin("true", "false", "switch_case"))
    src = blocks.filter(F.size("stmts") > 0).select("file_id", F.col("block_id").alias("src"), F.try_element_at("stmts", F.lit(-1)).alias("s"))
    dst = blocks.select("file_id", F.col("block_id").alias("dst"), F.explode("stmts").alias("t"))
    return sorted_join(sorted_join(own, src, ["file_id", "src"]), dst, ["file_id", "dst"]).select("file_id", F.col("s").alias("src"), F.col("t").alias("dst"))


def metrics(data: DataFrame, control: DataFrame, statements: DataFrame) -> DataFrame:
    """(file_id, statements, data_deps, control_deps, density)."""
    n = statements.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    d = data.groupBy("file_id").agg(F.count(F.lit(1)).alias("data_deps"))
    c = control.groupBy("file_id").agg(F.count(F.lit(1)).alias("control_deps"))
    out = n.join(d, "file_id", "left").join(c, "file_id", "left").na.fill(0, ["data_deps", "control_deps"])
    return out.select("file_id", F.col("n").alias("statements"), "data_deps", "control_deps", ((F.col("data_deps") + F.col("control_deps")) / F.greatest("n", F.lit(1))).alias("density"))


def property_graph(nodes: DataFrame, blocks: DataFrame, flow: DataFrame, data: DataFrame, control: DataFrame) -> DataFrame:
    """(file_id, src, dst, family, label): the syntax, flow, data and control families in one table."""
    ast = nodes.filter("parent_id IS NOT NULL").select("file_id", F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.lit("ast").alias("family"), F.lit("").alias("label"))
    full = blocks.filter(F.size("stmts") > 0)
    a = full.select("file_id", F.col("block_id").alias("src"), F.try_element_at("stmts", F.lit(-1)).alias("s"))
    b = full.select("file_id", F.col("block_id").alias("dst"), F.try_element_at("stmts", F.lit(1)).alias("t"))
    cfg = sorted_join(sorted_join(flow, a, ["file_id", "src"]), b, ["file_id", "dst"]).select("file_id", F.col("s").alias("src"), F.col("t").alias("dst"), F.lit("cfg").alias("family"), F.col("kind").alias("label"))
    ddg = data.select("file_id", "src", "dst", F.lit("ddg").alias("family"), F.col("var").cast("string").alias("label"))
    cdg = control.select("file_id", "src", "dst", F.lit("cdg").alias("family"), F.lit("").alias("label"))
    return ast.unionByName(cfg).unionByName(ddg).unionByName(cdg)


def property_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.dropDuplicates(["file_id", "node_id"])


def _family_jaccard(before: DataFrame, after: DataFrame, family: str, items: tuple[str, ...], rows: int) -> DataFrame:
    """(file_id, jaccard) of one family's edges, written: of tables that are no files yet only this family is made, and what it sent is gone before the next one."""
    own = lambda df: df.filter(F.col("family") == family)
    return cut(jaccard(own(before), own(after), ["file_id"], list(items)), rows, spread_already=True)


def compare_dependence(before: DataFrame, after: DataFrame, metrics_before: DataFrame, metrics_after: DataFrame, rows: int = 0) -> DataFrame:
    """(file_id, data_jaccard, control_jaccard, statement_delta, density_delta): edges (file_id, family, src, dst, label) and metrics of two versions.

    Data edges are equal with their variable, control edges without; two versions without an edge of a family agree (1). ``rows`` is for ``cut``.
    """
    side = lambda m, s: m.select("file_id", F.col("density").alias("d" + s), F.col("statements").alias("n" + s))
    out = side(metrics_before, "x").join(side(metrics_after, "y"), "file_id", "full_outer")
    for family, items, name in (("ddg", ("src", "dst", "label"), "data_jaccard"), ("cdg", ("src", "dst"), "control_jaccard")):
        out = out.join(_family_jaccard(before, after, family, items, rows).withColumnRenamed("jaccard", name), "file_id", "left")
    delta = lambda c, zero: F.coalesce(c + "y", F.lit(zero)) - F.coalesce(c + "x", F.lit(zero))
    return out.na.fill(1.0, ["data_jaccard", "control_jaccard"]).select("file_id", "data_jaccard", "control_jaccard", delta("n", 0).alias("statement_delta"), F.round(delta("d", 0.0), 6).alias("density_delta"))


def compare_property_graphs(before: DataFrame, after: DataFrame, nodes_before: DataFrame, nodes_after: DataFrame, counts_before: DataFrame | None = None, counts_after: DataFrame | None = None, rows: int = 0) -> DataFrame:
    """(file_id, node_jaccard, ast_jaccard, cfg_jaccard, ddg_jaccard, cdg_jaccard) of two versions; 1 where both lack a family.

    With counts (file_id, dangerous_calls, taint_flows) of both versions also dangerous_delta and taint_delta; a file without a row has none of either.
    Families are compared one behind the other. ``rows`` is for ``cut``.
    """
    out = cut(jaccard(nodes_before, nodes_after, ["file_id"], ["node_id"]).withColumnRenamed("jaccard", "node_jaccard"), rows, spread_already=True)
    for family in FAMILIES:
        out = out.join(_family_jaccard(before, after, family, ("src", "dst", "label"), rows).withColumnRenamed("jaccard", f"{family}_jaccard"), "file_id", "left")
    out = out.na.fill(1.0)
    if counts_before is None or counts_after is None:
        return out
    x, y = (c.select("file_id", *[F.col(n).alias(n + side) for n in ("dangerous_calls", "taint_flows")]) for c, side in ((counts_before, "_x"), (counts_after, "_y")))
    delta = lambda n, name: (F.coalesce(n + "_y", F.lit(0)) - F.coalesce(n + "_x", F.lit(0))).alias(name)
    return out.join(x, "file_id", "left").join(y, "file_id", "left").select(*out.columns, delta("dangerous_calls", "dangerous_delta"), delta("taint_flows", "taint_delta"))
