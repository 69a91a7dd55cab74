"""Metrics of syntax trees in interval encoding.

A node's subtree is the nodes of its file whose ``pre`` lies in [pre, last]. Sums over subtrees are differences of one running sum
in ``pre`` order, read at two places; enclosing nodes are what a level opened last. Both put the nodes and the places that are asked about in one
sequence a file, so they take one shuffle by file: no range join, no recursion, and no second read of the nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CALLABLES = ("FunctionDecl", "MethodDecl")
SCOPES = ("IfStmt", "ForStmt", "WhileStmt", "MatchStmt", "TryStmt", "WithStmt", "FunctionDecl", "MethodDecl")
NAMED = ("FunctionDecl", "MethodDecl", "TypeDecl")
PLUS_ONE = ("IfStmt", "ForStmt", "WhileStmt", "ConditionalExpr", "WithStmt", "AssertStmt")
#: Kinds of the control-flow profile, in their fixed order.
PROFILE = ("IfStmt", "ForStmt", "WhileStmt", "MatchStmt", "TryStmt", "ReturnStmt", "BreakStmt", "ContinueStmt", "ThrowStmt", "CallExpr")
#: Kinds that keep a module from being a stable leaf, as far as the profile counts them; the last two it does not count.
NOT_LEAF, NOT_LEAF_STRICT = ("IfStmt", "ForStmt", "WhileStmt", "MatchStmt", "TryStmt", "CallExpr"), ("FunctionDecl", "MethodDecl")
#: Kinds that branch, without calls: of a leaf whose calls do not count.
BRANCHES = ("IfStmt", "ForStmt", "WhileStmt", "TryStmt")
ABSTRACT_KINDS = ("trait", "interface", "abstractClass", "protocol")
CONCRETE_KINDS = ("class", "struct", "enum", "union", "typeAlias")
#: Languages whose type declarations say what they are.
ABSTRACTNESS_LANGUAGES = ("python", "rust", "go", "typescript", "cpp")
ANONYMOUS = "<anonymous>"
#: Grammar nodes that are arms of a match, and clauses of a comprehension.
ARMS = ("match_arm", "case_clause", "expression_case", "type_case", "default_case", "communication_case", "switch_case", "switch_default", "case_statement")
CLAUSES = ("for_in_clause", "for_clause", "if_clause")


def of_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*kinds))


def _sequence(*order: str):
    """Rows of a file in the order of their places, up to each row."""
    return W.partitionBy("file_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def subtree_sums(nodes: DataFrame, at: Column, weights: dict[str, Column], keep: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """(file_id, pre, keep..., the names of ``weights``): sums over the strict descendants of the nodes that fulfil ``at``.

    A node's row counts at its place; the nodes asked about are read again right behind it and behind their last descendant.
    """
    own = nodes.select("file_id", "pre", "last", at.alias("_at"), *keep, *[w.cast("double").alias(n) for n, w in weights.items()])
    here = F.struct(F.col("pre").alias("place"), F.lit(0).alias("side"))
    ask = F.array(here, F.struct(F.col("pre").alias("place"), F.lit(-1).alias("side")), F.struct(F.col("last").alias("place"), F.lit(1).alias("side")))
    rows = own.withColumn("e", F.explode(F.when(F.col("_at"), ask).otherwise(F.array(here)))).select("*", "e.place", "e.side")
    w = _sequence("place", F.abs(F.col("side")), "pre")
    for n in weights:
        rows = rows.withColumn(n, F.sum(F.when(F.col("side") == 0, F.col(n)).otherwise(0.0)).over(w) * F.col("side"))
    return rows.filter("side <> 0").groupBy("file_id", "pre", *keep).agg(*[F.sum(n).alias(n) for n in weights])


def ancestors(nodes: DataFrame, of: Column, at: Column, keep: tuple[str, ...], strict: bool = True, nearest: bool = False) -> DataFrame:
    """(file_id, pre, keep..., level, anc): for the nodes that fulfil ``at`` the enclosing nodes that fulfil ``of``, outermost at level 0.

    anc is a struct of pre, last and keep of the enclosing node. ``strict`` leaves the node itself out; ``nearest`` gives the innermost only.
    Nodes that nothing encloses have no row. Columns of ``keep`` are of any type.
    """
    own = nodes.filter(of | at).select("file_id", "pre", "last", of.alias("_of"), at.alias("_at"), *keep)
    event = lambda place, turn, step, ask: F.struct(place.alias("place"), F.lit(turn).alias("turn"), F.lit(step).alias("step"), F.lit(ask).alias("ask"))
    pre, end = F.col("pre"), F.col("last") + 1
    parts = F.array_compact(F.array(F.when(F.col("_of"), event(pre, 2, 1, False)), F.when(F.col("_of"), event(end, 0, -1, False)), F.when(F.col("_at"), event(pre, 1 if strict else 3, 0, True))))
    rows = own.withColumn("e", F.explode(parts)).select("file_id", "pre", "last", *keep, "e.*")
    rows = rows.withColumn("d", F.sum("step").over(_sequence("place", "turn", F.desc("pre")))).filter("step >= 0")
    # an opened node is found at its own level by the questions below it
    first = F.greatest(F.col("d") - 1, F.lit(0)) if nearest else F.lit(0)
    levels = F.when(F.col("ask"), F.when(F.col("d") > 0, F.sequence(first, F.col("d") - 1))).otherwise(F.array(F.col("d") - 1))
    rows = rows.withColumn("level", F.explode(levels))
    anc = F.when(~F.col("ask"), F.struct("pre", "last", *keep))
    w = W.partitionBy("file_id", "level").orderBy("place", "turn").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("anc", F.last(anc, ignorenulls=True).over(w)).filter("ask").select("file_id", "pre", *keep, "level", "anc")


def children_counted(nodes: DataFrame) -> DataFrame:
    """Nodes with n_arms, n_handlers and n_clauses where these columns are not there.

    Arms and handlers are children; clauses are all of a comprehension's subtree, so a nested comprehension's count for the outer one too.
    """
    if "n_handlers" in nodes.columns:
        return nodes
    native = F.col("native_kind") if "native_kind" in nodes.columns else F.lit("")
    arm, handler = native.isin(*ARMS), F.col("kind") == "CatchClause"
    count = nodes.filter(arm | handler).groupBy("file_id", F.col("parent_id").alias("node_id")).agg(F.count_if(arm).alias("n_arms"), F.count_if(handler).alias("n_handlers"))
    out = nodes.join(count, ["file_id", "node_id"], "left").na.fill(0, ["n_arms", "n_handlers"])
    if "native_kind" not in nodes.columns:
        return out.withColumn("n_clauses", F.lit(0).cast("long"))
    clauses = subtree_sums(nodes, F.col("kind") == "Comprehension", {"n_clauses": native.isin(*CLAUSES).cast("int")}).select("file_id", "node_id", F.col("n_clauses").cast("long").alias("n_clauses"))
    return out.join(clauses, ["file_id", "node_id"], "left").na.fill(0, ["n_clauses"])


def complexity_weight(nodes: DataFrame) -> Column:
    kind = F.col("kind")
    logical = F.col("operator").isin("and", "or", "&&", "||") if "operator" in nodes.columns else F.lit(False)
    w = F.when(kind.isin(*PLUS_ONE), 1).when(kind == "MatchStmt", F.greatest(F.lit(0), F.col("n_arms") - 1))
    w = w.when(kind == "TryStmt", 1 + F.greatest(F.lit(0), F.col("n_handlers") - 1)).when(kind == "Comprehension", F.col("n_clauses"))
    return w.when((kind == "BinaryExpr") & logical, 1).otherwise(0)


def function_complexity(nodes: DataFrame) -> DataFrame:
    """(file_id, node_id, complexity) of each callable: 1 and its whole subtree's contributions, nested callables included."""
    own = children_counted(nodes)
    out = subtree_sums(own, F.col("kind").isin(*CALLABLES), {"s": complexity_weight(own)})
    return out.select("file_id", "node_id", (F.col("s") + 1).cast("long").alias("complexity"))


def _per_file(nodes: DataFrame, found: DataFrame, value: str, name: str, empty) -> DataFrame:
    best = found.groupBy("file_id").agg(F.max(value).alias(name))
    return nodes.select("file_id").distinct().join(best, "file_id", "left").na.fill(empty, [name])


def max_function_complexity(nodes: DataFrame) -> DataFrame:
    return _per_file(nodes, function_complexity(nodes), "complexity", "max_complexity", 0)


def scopes(nodes: DataFrame) -> DataFrame:
    """Scope nodes (file_id, node_id, kind, pre, last) with d, the strict scope ancestors, and fanout, the nearest scopes below."""
    s = of_kind(nodes, *SCOPES).select("file_id", "node_id", "kind", "pre", "last")
    event = lambda place, turn, step: F.struct(place.alias("place"), F.lit(turn).alias("turn"), F.lit(step).alias("step"))
    rows = s.withColumn("e", F.explode(F.array(event(F.col("pre"), 1, 1), event(F.col("last") + 1, 0, -1)))).select("file_id", "node_id", "kind", "pre", "last", "e.*")
    open_ = F.sum("step").over(_sequence("place", "turn", F.desc("pre")))  # of nodes that end together the innermost ends first
    rows = rows.withColumn("d", (open_ - (F.col("step") == 1).cast("int")).cast("long"))
    # scopes opened one level below between a scope's start and its end are its fanout
    part = lambda level, child, side: F.struct(level.alias("level"), F.lit(child).alias("child"), F.lit(side).alias("side"))
    parts = F.when(F.col("step") == 1, F.array(part(F.col("d"), 1, 0), part(F.col("d") + 1, 0, -1))).otherwise(F.array(part(F.col("d") + 1, 0, 1)))
    rows = rows.withColumn("p", F.explode(parts)).select("*", "p.level", "p.child", "p.side")
    met = F.sum("child").over(W.partitionBy("file_id", "level").orderBy("place", "turn", "side").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("met", met * F.col("side")).groupBy("file_id", "node_id", "kind", "pre", "last", "d").agg(F.sum("met").cast("long").alias("fanout"))


def function_divergence(nodes: DataFrame) -> DataFrame:
    """(file_id, node_id, divergence): the sum of depth * ln(1 + fanout) over the scopes within a callable."""
    s = scopes(nodes)
    g = F.log1p("fanout")
    both = subtree_sums(s, F.col("kind").isin(*CALLABLES), {"sum_g": g, "sum_dg": g * F.col("d")}, ("node_id", "d"))
    return both.select("file_id", "node_id", (F.col("sum_dg") - F.col("d") * F.col("sum_g")).alias("divergence"))


def max_function_divergence(nodes: DataFrame) -> DataFrame:
    return _per_file(nodes, function_divergence(nodes), "divergence", "max_divergence", 0.0)


def function_scopes(nodes: DataFrame) -> DataFrame:
    """(file_id, node_id, name, qualified_name, kind, start_line, end_line) of each callable.

    ``nodes`` have name, text and the lines. A callable without a name is called after its line; types without a name do not take
    part. kind: method in a type, closure in a callable, else method, async_function (the text before the name says async) or function.
    """
    shown = F.when(F.col("kind").isin(*CALLABLES), F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat(F.lit(ANONYMOUS + "@"), F.col("start_line")))).otherwise(F.when(F.col("name") != "", F.col("name")))
    head = F.when(F.col("name") != "", F.expr("substring_index(text, name, 1)")).otherwise(F.regexp_extract("text", "^[^({]*", 0)) if "text" in nodes.columns else F.lit("")
    is_async = F.array_contains(F.split(head, "[^\\p{L}\\p{N}_]"), "async")
    own = of_kind(nodes, *NAMED).withColumn("shown", shown).filter("shown IS NOT NULL").withColumn("is_async", F.coalesce(is_async, F.lit(False)))
    keep = ("node_id", "kind", "shown", "is_async", "start_line", "end_line")
    above = ancestors(own, F.lit(True), F.col("kind").isin(*CALLABLES), keep, strict=False)
    chain = above.groupBy("file_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("level", F.col("anc.shown").alias("shown"), F.col("anc.kind").alias("kind")))).alias("chain"), *[F.first(c).alias(c) for c in keep[1:]])
    outer = F.when(F.size("chain") > 1, F.element_at("chain", -2)["kind"])
    kind = F.when(outer == "TypeDecl", "method").when(outer.isNotNull(), "closure").when(F.col("kind") == "MethodDecl", "method").when(F.col("is_async"), "async_function").otherwise("function")
    return chain.select("file_id", "node_id", F.col("shown").alias("name"), F.array_join(F.transform("chain", lambda x: x["shown"]), ".").alias("qualified_name"), kind.alias("kind"), "start_line", "end_line")


def located_complexities(nodes: DataFrame) -> DataFrame:
    """function_scopes with complexity."""
    return function_scopes(nodes).join(function_complexity(nodes), ["file_id", "node_id"])


def located_divergences(nodes: DataFrame) -> DataFrame:
    """function_scopes with divergence."""
    return function_scopes(nodes).join(function_divergence(nodes), ["file_id", "node_id"])


def qualified_names(nodes: DataFrame, name: Column) -> DataFrame:
    """(file_id, node_id, qualified): names of the enclosing callables and types, joined by dots."""
    own = of_kind(nodes, *NAMED).withColumn("_name", name)
    above = ancestors(own, F.lit(True), F.col("kind").isin(*CALLABLES), ("node_id", "_name"), strict=False)
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", F.col("anc._name").alias("n")))), lambda x: x["n"]), ".")
    return above.groupBy("file_id", "node_id").agg(path.alias("qualified"))


def abstractness(nodes: DataFrame) -> DataFrame:
    """(file_id, abstractness): abstract over all type declarations of a known kind; 0 without any. Files in other languages have no row."""
    if "language" in nodes.columns:
        nodes = nodes.filter(F.col("language").isin(*ABSTRACTNESS_LANGUAGES))
    abstract, known = F.col("type_kind").isin(*ABSTRACT_KINDS), F.col("type_kind").isin(*ABSTRACT_KINDS, *CONCRETE_KINDS)
    t = nodes.groupBy("file_id").agg(F.count_if((F.col("kind") == "TypeDecl") & abstract).alias("a"), F.count_if((F.col("kind") == "TypeDecl") & known).alias("n"))
    return t.select("file_id", F.when(F.col("n") == 0, 0.0).otherwise(F.col("a") / F.col("n")).alias("abstractness"))


def kind_histogram(nodes: DataFrame, drop_unknown: bool = False) -> DataFrame:
    own = nodes.filter("kind <> 'Unknown'") if drop_unknown else nodes
    return own.groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def kind_sequence(nodes: DataFrame, include_unknown: bool = True) -> DataFrame:
    """(file_id, kinds): kinds in pre-order; a file of unknown nodes alone has an empty sequence where they are left out."""
    place = F.struct("pre", "kind")
    own = F.collect_list(place if include_unknown else F.when(F.col("kind") != "Unknown", place))
    return nodes.groupBy("file_id").agg(F.transform(F.array_sort(own), lambda x: x["kind"]).alias("kinds"))


def control_flow_profile(nodes: DataFrame) -> DataFrame:
    """One row a file: a count for each kind of the profile, zeros included."""
    return nodes.groupBy("file_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in PROFILE])


def structural_summary(nodes: DataFrame) -> DataFrame:
    ends = lambda x: F.count_if(F.col("kind").endswith(x))
    return nodes.groupBy("file_id").agg(F.count(F.lit(1)).alias("node_count"), F.max("depth").alias("depth"), ends("Decl").alias("decls"), ends("Expr").alias("exprs"), ends("Stmt").alias("stmts"))


def valid_files(nodes: DataFrame) -> DataFrame:
    """(file_id, is_valid): no syntax error in the tree."""
    return nodes.groupBy("file_id").agg((~F.bool_or("is_error")).alias("is_valid"))


def stable_leaf(nodes: DataFrame, strict: bool = False, kinds: tuple[str, ...] = NOT_LEAF) -> DataFrame:
    """(file_id, is_stable_leaf): no node of ``kinds``, which are branchings and calls. ``strict`` also asks for no callable, which the usual profile does not count."""
    kinds += NOT_LEAF_STRICT if strict else ()
    return nodes.groupBy("file_id").agg((F.count_if(F.col("kind").isin(*kinds)) == 0).alias("is_stable_leaf"))


def node_text(source: Column, start: Column, end: Column) -> Column:
    """The text between byte offsets; empty where they lie outside."""
    raw = F.encode(source, "UTF-8")
    ok = (start >= 0) & (end >= start) & (end <= F.octet_length(source))
    part = F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")
    return F.when(ok, F.make_valid_utf8(part)).otherwise("")  # offsets within a character leave replacement characters
