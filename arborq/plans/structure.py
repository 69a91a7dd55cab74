"""Queries over graphs of files and flow: hot spots, two versions' dependence and property graphs, taint findings, coverage decisions, floors, laws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lattice as L
from ..operators import compare as K
from ..operators import coverage as T
from ..operators import curvature as V
from ..operators import dependence as P
from ..operators import flow as C
from ..operators import gates as G
from ..operators import module_graph as M
from ..operators import process as S
from ..operators import report as R
from ..operators import security as X
from ..operators import targets as H
from ..sources import fixtures as D
from .catalog import COVER, CURVATURE, METRICS_CTE, ORACLES, OUTCOMES, OWNER, SUGGEST, VERDICTS, WIDE, _accesses, _cover, _exported, _files, _flow, _graph, _parts, _taint, _trees, query, r6

# Hot spots ------------------------------------------------------------------------------------------------------------------


@query("hotspots_dependencies", CURVATURE.replace("REL", "IMPORTS") + """, sides AS (SELECT a AS file, a, b, curvature FROM curved UNION ALL SELECT b, a, b, curvature FROM curved),
r AS (SELECT file, concat(a, ' -> ', b) AS label, curvature AS score, row_number() OVER (PARTITION BY file ORDER BY curvature, concat(a, ' -> ', b)) AS n FROM sides)
SELECT file, 'dependency_edge' AS kind, label, score, score < 0 AS negative FROM r WHERE n <= 5""", D.MODULE_CTE)
def _(spark, d):
    nodes, edges, owner = _graph(spark, d)
    curved = V.module_curvature(edges, owner).select("a", "b", r6("curvature"))
    found = H.dependency_hotspots(curved, M.by_label(nodes, "File").select(F.col("id").alias("file")))
    return found.select("file", "kind", "label", "score", (F.col("suggestion") == H.EDGE[0]).alias("negative"))


@query("hotspots_processes", OWNER + """, t AS (SELECT process_id, node_id AS src, lead(node_id) OVER (PARTITION BY process_id ORDER BY step) AS dst FROM order_steps),
near AS (SELECT DISTINCT o.file, s.process_id FROM order_steps s JOIN owner o ON o.id = s.node_id),
w AS (SELECT n.file, t.src, t.dst, CAST(count(*) AS DOUBLE) AS weight FROM near n JOIN t USING (process_id) WHERE t.dst IS NOT NULL AND t.src <> t.dst GROUP BY ALL),
i AS (SELECT file, dst AS src, sum(1 / sqrt(weight)) AS x FROM w GROUP BY ALL), o AS (SELECT file, src AS dst, sum(1 / sqrt(weight)) AS y FROM w GROUP BY ALL),
c AS (SELECT w.file, concat(w.src, ' -> ', w.dst) AS label, round(2 - sqrt(weight) * (coalesce(x, 0) + coalesce(y, 0)), 6) AS score FROM w LEFT JOIN i ON i.file = w.file AND i.src = w.src LEFT JOIN o ON o.file = w.file AND o.dst = w.dst),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score, label) AS n FROM c)
SELECT file, 'process_transition' AS kind, label, score, score < 0 AS negative FROM r WHERE n <= 5""", D.MODULE_CTE + "," + D.STEPS_CTE)
def _(spark, d):
    _, _, owner = _graph(spark, d)
    rows = D.lines(spark, d)
    arcs = M.cut(S.transitions_by_file(D.order_steps(spark, d), owner, rows), 4 * rows)
    curved = V.lowest_forman(arcs, H.HOTSPOTS, ("file",), 4 * rows).withColumn("curvature", F.round("curvature", 6))
    return H.process_hotspots(curved).select("file", "kind", "label", "score", (F.col("suggestion") == H.TRANSITION[0]).alias("negative"))


@query("hotspots_cycles")
def _(spark, d):
    nodes = _exported(spark, d)
    graph = M.cut(C.build(nodes), D.lines(spark, d))
    blocks, edges = C.blocks_of(graph), C.edges_of(graph)
    found = M.cut(C.cycles(blocks, edges, _parts(spark, d)))
    return H.cycle_hotspots(C.cycle_spans(found, blocks, nodes), found)


@query("mdg_import_curvature", CURVATURE.replace("REL", "IMPORTS") + " SELECT * FROM curved", D.MODULE_CTE)
def _(spark, d):
    _, edges, owner = _graph(spark, d)
    return V.module_curvature(edges, owner).select("a", "b", r6("curvature"))


# Two versions: the second lacks each ninth statement and the true branches ------------------------------------------------------

VERSIONS = """+ acc1 AS (SELECT file_id, fn, node_id, pre, k, var, kind = 'AssignExpr' AS is_def FROM uast_nodes WHERE k > 0), acc2 AS (SELECT * FROM acc1 WHERE k % 9 <> 4),
rd1 AS (SELECT DISTINCT u.file_id, (SELECT arg_max(x.node_id, x.pre) FROM acc1 x WHERE x.fn = u.fn AND x.var = u.var AND x.is_def AND x.pre < u.pre) AS src, u.node_id AS dst, u.var FROM acc1 u WHERE NOT u.is_def),
rd2 AS (SELECT DISTINCT u.file_id, (SELECT arg_max(x.node_id, x.pre) FROM acc2 x WHERE x.fn = u.fn AND x.var = u.var AND x.is_def AND x.pre < u.pre) AS src, u.node_id AS dst, u.var FROM acc2 u WHERE NOT u.is_def),
cd1 AS (SELECT file_id, src, dst, kind FROM cfg_edges WHERE kind IN ('true', 'false') AND src > 1 AND dst > 1), cd2 AS (SELECT * FROM cd1 WHERE kind <> 'true'),
side AS (SELECT file_id, 'ast' AS family, parent_id AS src, node_id AS dst, '' AS label, 1 AS v FROM uast_nodes WHERE parent_id IS NOT NULL UNION ALL SELECT file_id, 'ast', parent_id, node_id, '', 2 FROM uast_nodes WHERE parent_id IS NOT NULL AND k % 9 <> 4
  UNION ALL SELECT file_id, 'cfg', concat('B', src), concat('B', dst), kind, 1 FROM cfg_edges WHERE src > 1 AND dst > 1 UNION ALL SELECT file_id, 'cfg', concat('B', src), concat('B', dst), kind, 2 FROM cfg_edges WHERE src > 1 AND dst > 1 AND kind <> 'true'
  UNION ALL SELECT file_id, 'ddg', src, dst, CAST(var AS VARCHAR), 1 FROM rd1 WHERE src IS NOT NULL UNION ALL SELECT file_id, 'ddg', src, dst, CAST(var AS VARCHAR), 2 FROM rd2 WHERE src IS NOT NULL
  UNION ALL SELECT file_id, 'cdg', concat('B', src), concat('B', dst), '', 1 FROM cd1 UNION ALL SELECT file_id, 'cdg', concat('B', src), concat('B', dst), '', 2 FROM cd2),
pooled AS (SELECT file_id, family, src, dst, label, bool_or(v = 1) AND bool_or(v = 2) AS shared FROM side GROUP BY ALL),
jac AS (SELECT file_id, family, count(*) FILTER (shared) / CAST(count(*) AS DOUBLE) AS j FROM pooled GROUP BY ALL),
counted AS (SELECT file_id, family, v, count(*) AS n FROM side GROUP BY ALL),
nodes1 AS (SELECT file_id, count(*) AS n, count(*) FILTER (k > 0) AS st, count(*) FILTER (kind = 'CallExpr' AND var % 5 = 0) AS dang FROM uast_nodes GROUP BY file_id),
nodes2 AS (SELECT file_id, count(*) AS n, count(*) FILTER (k > 0) AS st, count(*) FILTER (kind = 'CallExpr' AND var % 5 = 0) AS dang FROM uast_nodes WHERE k % 9 <> 4 GROUP BY file_id)"""
PICK = "(SELECT j FROM jac WHERE jac.file_id = n1.file_id AND family = '{}')"
NUMBER = "coalesce((SELECT c.n FROM counted c WHERE c.file_id = n1.file_id AND c.family = '{}' AND v = {}), 0)"


def _versions(spark, d):
    """nodes, edges of all four families and dependence of each version. Trees and flow graphs are spread by file once, so windows, joins and comparisons of files send
    nothing; data and control dependence are written, the other families are made where they are compared."""
    rows = 2 * D.lines(spark, d)
    trees = _trees(spark, d)
    blocks, edges = (M.spread(x, rows) for x in _flow(spark, d, trees))
    nodes = M.spread(trees, rows)
    out = []
    for own, flow in ((nodes, edges), (nodes.filter("k % 9 <> 4"), edges.filter("kind <> 'true'"))):
        data, control = (M.cut(x, rows, spread_already=True) for x in (P.reaching_definitions(_accesses(own)), P.control_dependence(blocks, flow)))
        graph = P.property_graph(own, blocks, flow, M.spread(data, rows), M.spread(control, rows))
        out.append((own, graph, P.metrics(data, control, own.filter("k > 0"))))
    return out


@query("pdg_compare", VERSIONS + f""", d AS (SELECT n1.file_id, coalesce({PICK.format('ddg')}, 1.0) AS data_jaccard, coalesce({PICK.format('cdg')}, 1.0) AS control_jaccard, n1.st AS s1, coalesce(n2.st, 0) AS s2,
  {NUMBER.format('ddg', 1)} + {NUMBER.format('cdg', 1)} AS e1, {NUMBER.format('ddg', 2)} + {NUMBER.format('cdg', 2)} AS e2 FROM nodes1 n1 LEFT JOIN nodes2 n2 ON n2.file_id = n1.file_id WHERE n1.st > 0)
SELECT file_id, round(data_jaccard, 6) AS data_jaccard, round(control_jaccard, 6) AS control_jaccard, s2 - s1 AS statement_delta, round(CASE WHEN s2 = 0 THEN 0 ELSE e2 / CAST(s2 AS DOUBLE) END - e1 / CAST(s1 AS DOUBLE), 6) AS density_delta FROM d""", D.FLOW_CTE)
def _(spark, d):
    (_, e1, m1), (_, e2, m2) = _versions(spark, d)
    return P.compare_dependence(e1, e2, m1, m2, D.lines(spark, d)).select("file_id", r6("data_jaccard"), r6("control_jaccard"), "statement_delta", "density_delta")


@query("property_graph_compare", VERSIONS + f""" SELECT n1.file_id, round(n2.n / CAST(n1.n AS DOUBLE), 6) AS node_jaccard, {", ".join(f"round(coalesce({PICK.format(x)}, 1.0), 6) AS {x}_jaccard" for x in ("ast", "cfg", "ddg", "cdg"))},
  n2.dang - n1.dang AS dangerous_delta, {NUMBER.format('ddg', 2)} - {NUMBER.format('ddg', 1)} AS taint_delta FROM nodes1 n1 JOIN nodes2 n2 ON n2.file_id = n1.file_id""", D.FLOW_CTE)
def _(spark, d):
    (n1, e1, _), (n2, e2, _) = _versions(spark, d)

    def counts(nodes, edges):
        calls = nodes.groupBy("file_id").agg(F.count_if((F.col("kind") == "CallExpr") & (F.col("var") % 5 == 0)).alias("dangerous_calls"))
        return calls.join(edges.filter("family = 'ddg'").groupBy("file_id").agg(F.count(F.lit(1)).alias("taint_flows")), "file_id", "left")

    out = P.compare_property_graphs(e1, e2, n1, n2, counts(n1, e1), counts(n2, e2), D.lines(spark, d))
    return out.select("file_id", *[r6(f"{x}_jaccard") for x in ("node", "ast", "cfg", "ddg", "cdg")], "dangerous_delta", "taint_delta")


@query("cpg_nodes", "SELECT file_id, count(DISTINCT node_id) AS nodes FROM uast_nodes GROUP BY file_id", D.TREE_CTE)
def _(spark, d):
    nodes = _trees(spark, d)
    return P.property_nodes(nodes.unionByName(nodes.filter("kind = 'CallExpr'"))).groupBy("file_id").agg(F.count(F.lit(1)).alias("nodes"))


KINDED = "string_agg(CASE kind WHEN 'FunctionDecl' THEN 'F' WHEN 'TypeDecl' THEN 'Y' WHEN 'AssignExpr' THEN 'A' WHEN 'CallExpr' THEN 'C' WHEN 'IfStmt' THEN 'I' WHEN 'ForStmt' THEN 'L' WHEN 'TryStmt' THEN 'T' WHEN 'WhileStmt' THEN 'W' WHEN 'WithStmt' THEN 'X' WHEN 'Identifier' THEN 'N' WHEN 'Unknown' THEN 'U' ELSE 'O' END, '' ORDER BY pre)"


@query("uast_compare", f"""+ x AS (SELECT true AS unknown, * FROM rich_nodes UNION ALL SELECT false, * FROM rich_nodes WHERE kind <> 'Unknown'), y AS (SELECT * FROM x WHERE k % 9 <> 4),
a AS (SELECT unknown, file_id, {KINDED} AS s FROM x GROUP BY ALL), b AS (SELECT unknown, file_id, {KINDED} AS t FROM y GROUP BY ALL),
p AS (SELECT unknown, file_id, kind, count(*) / CAST(sum(count(*)) OVER (PARTITION BY unknown, file_id) AS DOUBLE) AS v FROM x GROUP BY unknown, file_id, kind),
q AS (SELECT unknown, file_id, kind, count(*) / CAST(sum(count(*)) OVER (PARTITION BY unknown, file_id) AS DOUBLE) AS w FROM y GROUP BY unknown, file_id, kind),
d AS (SELECT unknown, file_id, sum(abs(coalesce(v, 0) - coalesce(w, 0))) / 2 AS kd FROM p FULL JOIN q USING (unknown, file_id, kind) GROUP BY ALL)
SELECT a.unknown, a.file_id, round(kd, 6) AS kind_distance, levenshtein(s, t) AS raw, round(levenshtein(s, t) / CAST(greatest(length(s), length(t)) AS DOUBLE), 6) AS edit_distance
FROM a JOIN b ON a.unknown = b.unknown AND a.file_id = b.file_id JOIN d ON d.unknown = a.unknown AND d.file_id = a.file_id""", D.RICH_CTE)
def _(spark, d):
    nodes = _exported(spark, d)
    other = nodes.filter("k % 9 <> 4")
    one = lambda flag: K.compare_trees(nodes, other, flag).select(F.lit(flag).alias("unknown"), "file_id", r6("kind_distance"), F.col("raw").cast("long").alias("raw"), r6("edit_distance"))
    return one(True).unionByName(one(False))


# Flow -----------------------------------------------------------------------------------------------------------------------


@query("cfg_neighbours", "SELECT file_id, 'next' AS side, dst AS block FROM cfg_edges WHERE src = 2 UNION ALL SELECT file_id, 'prior', src FROM cfg_edges WHERE dst = 1", D.FLOW_CTE)
def _(spark, d):
    _, edges = D.flow_graphs(spark, d)
    after, before = C.successors(edges, 2), C.predecessors(edges, 1)
    return after.select("file_id", F.lit("next").alias("side"), F.col("dst").alias("block")).unionByName(before.select("file_id", F.lit("prior").alias("side"), F.col("src").alias("block")))


@query("cfg_cycle_spans")
def _(spark, d):
    nodes = _exported(spark, d)
    graph = M.cut(C.build(nodes), D.lines(spark, d))
    blocks = C.blocks_of(graph)
    return C.cycle_spans(C.cycles(blocks, C.edges_of(graph), _parts(spark, d)), blocks, nodes)


# Taint, floors, coverage, results -------------------------------------------------------------------------------------------------


@query("taint_findings", ORACLES["taint_flows"].replace("SELECT DISTINCT a.file_id, a.node_id AS source, b.node_id AS sink FROM br a", ", fl AS (SELECT DISTINCT a.file_id, a.node_id AS source, b.node_id AS sink FROM br a") + """)
SELECT fl.file_id, fl.source AS source_id, fl.sink AS sink_id, 'taint_flow' AS kind, CAST(s.pre + 1 AS INT) AS line, concat('call.v', s.var, ' (x)') AS snippet, concat('call.v', s.var) AS callee, concat('v', o.var) AS source, concat('call.v', s.var, ' (x)') AS sink
FROM fl JOIN uast_nodes s ON s.file_id = fl.file_id AND s.node_id = fl.sink JOIN uast_nodes o ON o.file_id = fl.file_id AND o.node_id = fl.source""")
def _(spark, d):
    nodes, edges, statements = _taint(spark, d)
    flows = X.taint_flows(nodes.filter("kind = 'AssignExpr'"), nodes.filter("kind = 'CallExpr'"), statements, edges, parts=_parts(spark, d))
    text = F.when(F.col("kind") == "CallExpr", F.concat(F.lit("call.v"), F.col("var"), F.lit(" (x)"))).otherwise(F.concat(F.lit(" v"), F.col("var"), F.lit(" ")))
    placed = nodes.withColumn("text", text).withColumn("start_line", (F.col("pre") + 1).cast("int"))
    return X.taint_findings(flows, placed).select("file_id", "source_id", "sink_id", "kind", "line", "snippet", "callee", "source", "sink")


@query("score_floors", OUTCOMES + WIDE + " SELECT file_id, " + ", ".join(f"CASE WHEN {p} IS NULL THEN 'unmeasured' WHEN {p} >= {G.SCORE_FLOORS[p]} THEN 'met' ELSE 'missed' END AS {p}" for p in L.PILLARS) + " FROM scores", METRICS_CTE)
def _(spark, d):
    files, metrics = _files(spark, d)
    said = lambda p: F.when(F.col(p).isNull(), "unmeasured").when(G.meets_floor(p, F.col(p)), "met").otherwise("missed")
    return G.scores(metrics, files).select("file_id", *[said(p).alias(p) for p in L.PILLARS])


@query("coverage_decision", COVER + """, u AS (SELECT unit, coalesce(avg(recall) FILTER (NOT is_test), 1.0) AS mean, coalesce(avg(recall) FILTER (is_test), 0.0) AS precision, coalesce(avg(CASE WHEN recall >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (NOT is_test), 1.0) AS rate FROM best GROUP BY unit),
r AS (SELECT unit, round(mean, 6) AS mean, round(rate, 6) AS rate, round(CASE WHEN 4 * precision + mean = 0 THEN 0 ELSE 5 * precision * mean / (4 * precision + mean) END, 6) AS f2 FROM u)
SELECT unit, mean >= 0.5 AS achieved, CASE WHEN mean >= 0.75 THEN 'coverage is strong' WHEN mean >= 0.5 THEN 'coverage meets the policy threshold' WHEN mean >= 0.25 THEN 'coverage is partial' ELSE 'coverage is weak' END AS interpretation,
  printf('%.0f%% of declarations meet the 0.50 threshold', rate * 100) AS rate_line, printf('F2 score is %.3f', f2) AS f2_line FROM r""", D.TREE_CTE)
def _(spark, d):
    found = T.coverage(*_cover(spark, d)).select("unit", *[r6(c) for c in ("mean", "rate", "f2")])  # rounded as in the SQL, so the lines say the same
    return T.decision(found).select("unit", "achieved", "interpretation", "rate_line", "f2_line")


@query("structured_results", VERDICTS + f"""{SUGGEST}, ns AS (SELECT file_id, count(*) AS n FROM sg GROUP BY file_id), ng AS (SELECT file_id, count(*) AS n, count(*) FILTER (NOT passed) AS failed FROM outcomes GROUP BY file_id), nr AS (SELECT file_id, count(*) AS n FROM results GROUP BY file_id)
SELECT v.file_id, path, CAST(mask AS INT) AS mask, round(simple, 6) AS simple, coalesce(ng.n, 0) AS gates, coalesce(ng.failed, 0) AS failed, coalesce(nr.n, 0) AS pillars, coalesce(ns.n, 0) AS suggestions
FROM verdicts v JOIN scores s ON s.file_id = v.file_id LEFT JOIN ns ON ns.file_id = v.file_id LEFT JOIN ng ON ng.file_id = v.file_id LEFT JOIN nr ON nr.file_id = v.file_id""", METRICS_CTE)
def _(spark, d):
    files, metrics = _files(spark, d)
    classified = M.cut(G.classify(files, metrics))
    outcomes = classified.select("file_id", F.explode("gates").alias("g")).select("file_id", "g.*")
    rows = R.structured(classified, R.suggestions(files, outcomes))
    failed = F.size(F.filter("gates", lambda g: ~g["passed"])).cast("long")
    long = lambda c: F.size(c).cast("long").alias(c)
    return rows.select("file_id", "path", F.col("verdict.mask").alias("mask"), F.round("scores.simple", 6).alias("simple"), long("gates"), failed.alias("failed"), long("pillars"), long("suggestions"))
