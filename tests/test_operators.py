"""Operators against hand-written values and plain Python."""

import itertools
import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborq.functions import lattice as L
from arborq.operators import assess, compare, curvature, dependence, flow, gates, module_graph, process, report, security, tree
from arborq.operators.entropy import entropy_ratio
from arborq.sources import discovery, frontends, graph_json

LOOP = "def f(xs):\n    for x in xs:\n        if x > 0:\n            break\n        else:\n            continue\n    return 0\n"
MATCH = "def f(x):\n    match x:\n        case 0:\n            return 0\n        case _:\n            return 1\n"
TRY = "def f(x):\n    try:\n        return 1\n    except E:\n        return 2\n    finally:\n        g()\n"


def shape(source):
    nodes = pd.DataFrame(frontends.parse_python(source))
    t = flow.Tree(nodes)
    g = flow.Graph(t)
    name = lambda b: f"{g.labels[b]}[{','.join(t.kind[s] for s in g.stmts[b])}]"
    return len(g.labels), sorted(f"{name(a)} {k} {name(b)}" for a, b, k in g.edges)


def test_flow_of_a_loop():
    blocks, edges = shape(LOOP)
    assert blocks == 9 and edges == [
        "call_FunctionDecl[] unconditional loop_header[ForStmt]", "entry[] unconditional call_FunctionDecl[]", "if_else[] continue loop_header[ForStmt]",
        "if_join[] loop_back loop_header[ForStmt]", "if_then[] break loop_after[ReturnStmt]", "loop_after[ReturnStmt] return exit[]",
        "loop_body[IfStmt] false if_else[]", "loop_body[IfStmt] true if_then[]", "loop_header[ForStmt] false loop_after[ReturnStmt]", "loop_header[ForStmt] true loop_body[IfStmt]",
    ]


def test_flow_of_a_match_and_a_try():
    blocks, edges = shape(MATCH)
    assert blocks == 8 and len(edges) == 10 and edges.count("match_arm[] unconditional nested[ReturnStmt]") == 2
    blocks, edges = shape(TRY)
    assert "try_body[ReturnStmt] unconditional try_finally[ExprStmt]" in edges and "try_finally[ExprStmt] return exit[]" in edges


def test_module_without_callables_and_broken_source():
    assert shape("")[1] == ["entry[] unconditional exit[]"]
    assert frontends.parse_python("def (")[0]["is_error"]
    deep = "x = " + "(" * 50 + "1" + ")" * 50
    assert frontends.parse_python(deep)[0]["last"] > 0


def test_intervals_cover_subtrees():
    for source in (LOOP, MATCH, TRY):
        rows = frontends.parse_python(source)
        by = {r["node_id"]: r for r in rows}
        for r in rows:
            inside = {x["pre"] for x in rows if r["pre"] <= x["pre"] <= r["last"]}
            below = {r["pre"]}
            for x in rows:
                p = by.get(x["parent_id"])
                if p and p["pre"] in below:
                    below.add(x["pre"])
            assert inside == below
    assert len({r["node_id"] for r in frontends.parse_python(LOOP)}) == len(frontends.parse_python(LOOP))


def test_complexity_of_parsed_python(spark):
    source = "def f(a, b):\n    if a and b:\n        return 1\n    for x in [y for y in a if y]:\n        while x:\n            pass\n    return a if b else 0\n\ndef g():\n    pass\n"
    nodes = frontends.parse(spark.createDataFrame([("p", "python", source), ("q", "cobol", "x"), ("r", "python", None)], "file_id string, language string, source string"))
    got = {r.node_id: r.complexity for r in tree.function_complexity(nodes).collect()}
    names = {r.node_id: r.name for r in tree.of_kind(nodes, "FunctionDecl").collect()}
    assert {names[k]: v for k, v in got.items()} == {"f": 8, "g": 1}  # if, and, for, two clauses, while, conditional
    assert {r.file_id for r in tree.valid_files(nodes).filter("is_valid").collect()} == {"p", "r"}


def test_divergence_by_walk(spark):
    rnd = random.Random(3)
    rows = []
    for f in range(6):
        parents = [-1] + [rnd.randrange(i) for i in range(1, 25)]
        kids = {i: [j for j in range(25) if parents[j] == i] for i in range(25)}
        order, last = [], {}

        def visit(i, order=order, last=last, kids=kids):
            order.append(i)
            at = len(order) - 1
            for k in kids[i]:
                visit(k)
            last[i] = len(order) - 1
            return at

        visit(0)
        pre = {n: i for i, n in enumerate(order)}
        for i in range(25):
            kind = "File" if i == 0 else rnd.choice(["FunctionDecl", "IfStmt", "CallExpr", "ForStmt"])
            rows.append((f, f"{f}.{i}", f"{f}.{parents[i]}" if i else None, pre[i], last[i], kind))
    nodes = spark.createDataFrame(rows, "file_id int, node_id string, parent_id string, pre long, last long, kind string")
    by = {r[1]: r for r in rows}
    scope = lambda r: r[5] in tree.SCOPES

    def nearest(r):
        p = by.get(r[2])
        while p and not scope(p):
            p = by.get(p[2])
        return p[1] if p else None

    near = {r[1]: nearest(r) for r in rows if scope(r)}

    def walk(n, depth):
        own = [k for k, v in near.items() if v == n]
        return depth * math.log(1 + len(own)) + sum(walk(k, depth + 1) for k in own)

    got = {r.node_id: r.divergence for r in tree.function_divergence(nodes).collect()}
    want = {r[1]: walk(r[1], 0) for r in rows if r[5] == "FunctionDecl"}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_lattice_laws(spark):
    pairs = L.masks(spark).select(F.col("mask").alias("a")).join(L.masks(spark).select(F.col("mask").alias("b")))
    a, b = F.col("a"), F.col("b")
    for r in pairs.select("a", "b", L.implies(a, b).alias("i"), L.meet(a, b).alias("m"), L.join(a, b).alias("j"), L.leq(a, b).alias("le")).collect():
        best = [c for c in range(16) if (r.a & c) & ~r.b == 0]
        assert r.i == max(best) and r.m == r.a & r.b and r.j == r.a | r.b and r.le == (r.a & ~r.b == 0)
        assert all((c & ~r.i == 0) == (c in best) for c in range(16))


def test_all_rankings_are_total_orders(spark):
    j = L.rankings(spark).join(L.masks(spark))
    rows = j.select("ranking_id", "ranking", "mask", L.score_by(F.col("mask"), F.col("ranking")).alias("s")).collect()
    assert len(rows) == 24 * 16
    for _, own in itertools.groupby(sorted(rows, key=lambda r: r.ranking_id), key=lambda r: r.ranking_id):
        own = list(own)
        assert sorted(r.s for r in own) == list(range(16))
        assert all(r.s == sum(8 >> i for i, p in enumerate(r.ranking) if r.mask & L.BITS[p]) for r in own)


def test_gate_edges(spark):
    rows = [("a", "ast.entropy", 0.2), ("b", "ast.entropy", 0.8), ("c", "ast.entropy", 0.81), ("d", "ast.entropy", 0.1), ("e", "ast.entropy", float("nan")), ("f", "mdg.instability", 1.0), ("f", "mdg.fan_in", 0.0)]
    roles = spark.createDataFrame([("c", True, False), ("f", True, False)], "file_id string, is_entrypoint boolean, is_stable_leaf boolean")
    got = {(r.file_id, r.metric): r.outcome for r in gates.outcomes(spark.createDataFrame(rows, "file_id string, metric string, value double"), roles).collect()}
    assert [got[x, "ast.entropy"] for x in "abcde"] == ["pass", "pass", "exempt_high", "fail_low", "fail_high"]
    assert got["f", "mdg.instability"] == "exempt_high" and got["f", "mdg.fan_in"] == "pass"


def test_verdict_of_a_file_that_does_not_parse(spark):
    files = spark.createDataFrame([("a", False), ("b", True), ("c", True)], "file_id string, is_parseable boolean")
    metrics = spark.createDataFrame([("a", "cpg.taint_flows", 0.0), ("b", "cpg.taint_flows", 0.0)], "file_id string, metric string, value double")
    assert {r.file_id: r.mask for r in gates.verdicts(files, metrics).collect()} == {"a": 0, "b": 4, "c": 0}


def test_balanced_curvature_on_small_graphs(spark):
    def value(edges):
        df = spark.createDataFrame(edges, "src string, dst string")
        return {(r.a, r.b): round(r.curvature, 6) for r in curvature.balanced_forman(df).collect()}

    assert value([("a", "b")]) == {("a", "b"): 0.0}
    # a triangle: degrees 2, one triangle; each end counts the other end and the shared neighbour
    near = {"a": {"b", "c"}, "b": {"a", "c"}, "c": {"a", "b"}}
    got = value([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("a", "a")])
    sharp = lam = 0
    for i, j in (("a", "b"), ("b", "a")):
        for k in near[j]:
            v = len(near[i] & near[k]) - (k in near[i])
            sharp, lam = sharp + (v > 0), max(lam, v)
    assert got[("a", "b")] == round(1 + 1 - 2 + 1.5 + sharp / (2 * lam), 6)


def test_directed_curvature(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "b", 1.0), ("b", "b", 1.0), ("c", "d", 0.0)], "src string, dst string, weight double")
    got = {(r.src, r.dst): r.curvature for r in curvature.directed_forman(df).collect()}
    assert got == {("a", "b"): 1.0, ("x", "b"): 1.0, ("b", "c"): 0.0, ("c", "d"): 0.0}


def test_containment_with_a_cycle(spark):
    nodes = spark.createDataFrame([("f", "File"), ("c", "Class"), ("m", "Method"), ("p", "Class"), ("q", "Class")], "id string, label string")
    edges = spark.createDataFrame([("f", "c", "DEFINES"), ("c", "m", "HAS_METHOD"), ("p", "q", "CONTAINS"), ("q", "p", "CONTAINS")], "src string, dst string, rel_type string")
    assert {r.id: r.file for r in module_graph.owning_file(nodes, edges).collect()} == {"f": "f", "c": "f", "m": "f", "p": None, "q": None}
    below = module_graph.contained_symbols(nodes, edges, nodes.filter("id IN ('f', 'p')"))
    assert sorted((r.root, r.id) for r in below.collect()) == [("f", "c"), ("f", "m"), ("p", "q")]


def test_process_steps_that_are_no_numbers(spark):
    nodes = spark.createDataFrame([("p", "Process"), ("x", "Function")], "id string, label string")
    edges = spark.createDataFrame([("1", "p", "a", "STEP_IN_PROCESS", "2"), ("2", "p", "b", "STEP_IN_PROCESS", "1.0"), ("3", "p", "c", "STEP_IN_PROCESS", "later"), ("4", "x", "d", "STEP_IN_PROCESS", "0")], "id string, src string, dst string, rel_type string, step string")
    got = process.paths_from_graph(nodes, edges)
    assert sorted((r.step, r.node_id) for r in got.collect()) == [(1, "b"), (2, "a"), (2, "c")]
    assert {(r.src, r.dst) for r in process.transitions(got).collect()} == {("b", "a"), ("a", "c")}


def test_edit_operations_and_distance(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"]), ([], ["a"]), (["a"], ["a"]), ([], [])], "x array<string>, y array<string>")
    raw, share = compare.edit_distance(F.col("x"), F.col("y"), ["a", "b", "c", "d", "x"])
    rows = df.select(raw.alias("raw"), share.alias("share"), compare.edit_operations("x", "y").alias("o")).collect()
    assert [(r.raw, r.share, tuple(r.o)) for r in rows] == [(2, 0.5, (2, 1, 1, 0)), (1, 1.0, (0, 0, 1, 0)), (0, 0.0, (1, 0, 0, 0)), (0, 0.0, (0, 0, 0, 0))]


def test_gw_is_zero_on_equal_trees_and_symmetric():
    path, star = [-1, 0, 1, 2], [-1, 0, 0, 0]
    assert compare.gw_distance(path, path) == 0 and compare.gw_distance([], []) == 0 and compare.gw_distance(path, []) == 1
    assert math.isclose(compare.gw_distance(path, star), compare.gw_distance(star, path), abs_tol=1e-6) and 0 <= compare.gw_distance(path, star) <= 1


def test_clones(spark):
    rows = [(1, ["a"] * 20), (2, ["a"] * 19 + ["b"]), (3, ["b"] * 20), (4, ["a"] * 20), (5, ["a"] * 21)]
    got = {(r.a, r.b) for r in compare.clones(spark.createDataFrame(rows, "file_id int, kinds array<string>"), ["a", "b"]).collect()}
    assert {(1, 2), (1, 4), (1, 5)} <= got and not any(3 in p for p in got)


def test_cycle_basis_and_nesting():
    edges = [(0, 2, "unconditional"), (2, 3, "true"), (2, 4, "false"), (3, 4, "unconditional"), (4, 5, "true"), (5, 4, "loop_back"), (4, 1, "return")]
    parts, nesting, longest, cycles = flow.graph_metrics([0, 1, 2, 3, 4, 5], edges)
    assert (parts, nesting, longest, cycles) == (1, 1, 4, 2)
    assert {frozenset(c) for c in flow.cycle_basis([0, 1, 2, 3, 4, 5], [(a, b) for a, b, _ in edges])} == {frozenset((2, 3, 4)), frozenset((4, 5))}
    nested = [(0, 2, "x"), (2, 3, "true"), (2, 5, "false"), (3, 4, "true"), (3, 5, "false"), (4, 5, "x"), (5, 1, "return")]
    assert flow.graph_metrics([0, 1, 2, 3, 4, 5], nested)[1] == 2


def test_suffix_matching_is_plain(spark):
    calls = spark.createDataFrame([("medieval(x)",), ("re.compile(x)",), ("a::b(x)",), ("exec (1)",), ("my_exec(x)",), ("os.system(y)",)], "text string").withColumn("callee", security.callee(F.col("text")))
    registry = security.table_of(spark, {"python": security.DANGER["python"]})
    got = {r.text: r.key for r in security.match_registry(calls, registry).collect()}
    assert got == {"medieval(x)": "eval", "re.compile(x)": "compile", "exec (1)": "exec", "my_exec(x)": "exec", "os.system(y)": "os.system"}


def test_taint_through_statements(spark):
    span = "file_id int, node_id string, pre long, last long"
    stmts = spark.createDataFrame([(1, "s", 0, 5), (1, "inner", 1, 3), (1, "t", 6, 9)], span)
    edges = spark.createDataFrame([(1, "inner", "t"), (1, "t", "inner")], "file_id int, src string, dst string")
    src, sink = spark.createDataFrame([(1, "in", 2, 2)], span), spark.createDataFrame([(1, "out", 7, 7), (1, "same", 3, 3)], span)
    assert {r.sink for r in security.taint_flows(src, sink, stmts, edges).collect()} == {"out", "same"}
    assert security.taint_flows(src, sink, stmts, edges, bridged=False).count() == 0


def test_entropy():
    assert entropy_ratio("") == entropy_ratio(None) == 0.0
    assert entropy_ratio("a\r\n" * 500) == entropy_ratio("a\n" * 500) < 0.2
    assert 0.5 < entropy_ratio("q9!") < 0.6


def test_assess_status(spark):
    cols = "file_id string, mask int, simple double, composable double, secure double, navigable double"
    before = spark.createDataFrame([("a", 1, 0.5, None, 1.0, 1.0), ("b", 3, 0.5, 0.5, 1.0, 1.0), ("c", 1, 0.5, None, 1.0, 1.0), ("d", 1, 0.5, None, 1.0, 1.0)], cols)
    after = spark.createDataFrame([("a", 3, 0.6, None, 1.0, 1.0), ("b", 1, 0.4, 0.5, 1.0, 1.0), ("c", 2, 0.5, None, 1.0, 1.0), ("d", 1, 0.6, None, 1.0, 1.0)], cols)
    close = spark.createDataFrame([("a", 0.01)], "file_id string, distance double")
    got = {r.file_id: r.status for r in assess.status(assess.score_deltas(before, after), close).collect()}
    assert got == {"a": "suspicious", "b": "regression", "c": "lateral", "d": "score_up"}


def test_scan_and_ignore(spark, tmp_path):
    for name, text in {"a.py": b"x = 1\n", "b.rs": b"fn a() {}", "node_modules/c.js": b"x", "gen/d.py": b"y", "e.py": b"\xff\xfe", "f.txt": b"no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    rows = {r.path: r for r in discovery.scan(spark, [f"file://{tmp_path}"], ignore=["# note", "", "gen/"]).collect()}
    assert set(rows) == {"a.py", "b.rs", "e.py"} and rows["b.rs"].language == "rust"
    assert not rows["e.py"].is_parseable and rows["e.py"].source is None and rows["a.py"].source == "x = 1\n"
    with pytest.raises(ValueError):
        discovery.resolve("../x", "/root/a")


def test_graph_json(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"id": "a", "label": "File", "properties": {"filePath": "p/a"}}, {"sourceId": "a", "targetId": "b", "type": "CALLS"}, {"id": "bad"}]))
    (tmp_path / "held.json").write_text(json.dumps({"nodes": [{"id": "b", "label": "Class"}], "relationships": [{"id": "r", "sourceId": "b", "targetId": "a", "type": "IMPORTS", "confidence": 0.5, "reason": "x"}]}))
    nodes, edges = graph_json.read_graph(spark, f"file://{tmp_path}")
    assert sorted((r.id, r.label, r.file_path) for r in nodes.collect()) == [("a", "File", "p/a"), ("b", "Class", None)]
    assert sorted((r.id, r.confidence, r.reason) for r in edges.collect()) == [("a->b", 1.0, ""), ("r", 0.5, "x")]


def test_config_and_snapshots(spark, tmp_path):
    (tmp_path / ".arborq.toml").write_text('priority = ["secure", "simple"]\n[[allow]]\npattern = "eval"\nreason = "tested"\n[[allow]]\npattern = "x"\n')
    (tmp_path / "sub").mkdir()
    found = graph_json.load_config(str(tmp_path / "sub"))
    assert found["ranking"] == ["secure", "simple"] and [r["pattern"] for r in found["allow"]] == ["eval"]
    files = spark.createDataFrame([("a.py", "x")], "path string, source string")
    graph_json.write_snapshot(files, f"file://{tmp_path}/snap", "p")
    assert [r.status for r in graph_json.read_snapshot(spark, f"file://{tmp_path}/snap", "p").collect()] == ["ok"]
    assert [r.status for r in graph_json.read_snapshot(spark, f"file://{tmp_path}/snap", "p", "0 seconds").collect()] == ["snapshot_stale"]


def test_html_is_closed_at_the_end():
    rows = frontends.parse_html("<div><p>a<br>b<ul><li>c</div>tail")
    assert [r["native_kind"] for r in rows] == ["document", "div", "p", "text", "br", "text", "ul", "li", "text", "text"]
    assert rows[0]["last"] == len(rows) - 1 and rows[1]["last"] == 8


def test_reassess_stream(spark, tmp_path):
    from arborq.streaming.reassess import reassess

    cols = "file_id string, mask int, simple double, composable double, secure double, navigable double"
    src = f"file://{tmp_path}/in"
    go = lambda: reassess(spark.readStream.schema(cols).parquet(src), lambda b: b, f"file://{tmp_path}/state", f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    spark.createDataFrame([("a", 1, 0.5, 0.5, 0.5, 0.5)], cols).write.mode("append").parquet(src)
    go()
    spark.createDataFrame([("a", 3, 0.6, 0.5, 0.5, 0.5)], cols).write.mode("append").parquet(src)
    go()
    assert [r.status for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == ["improvement"]
    for i in range(4):  # other files come between, and old versions of a bucket go
        spark.createDataFrame([("a" if i % 2 else "b", 3, 0.6 - i / 10, 0.5, 0.5, 0.5)], cols).write.mode("append").parquet(src)
        go()
    assert sorted((r.file_id, r.status) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("a", "improvement"), ("a", "score_down"), ("a", "score_down"), ("b", "score_down")]
    assert max(len(list(p.iterdir())) for p in (tmp_path / "state").iterdir() if p.is_dir()) <= 2


def test_gw_covers_whole_tables(spark):
    from arborq.plans import catalog
    from arborq.sources import fixtures

    from .conftest import SF

    files = {r.file_id for r in fixtures.statement_trees(spark, SF).select("file_id").distinct().collect()}
    assert {r.file_id for r in catalog.QUERIES["gw_distance"](spark, SF).collect()} == {f for f in files if f + 1 in files}


def test_node_text_cuts_bytes(spark):
    docs = spark.createDataFrame([(0, "aé東京b"), (1, "ab"), (2, None)], "i int, text string")
    got = {r.i: r.t for r in docs.select("i", tree.node_text(F.col("text"), F.lit(1), F.lit(6)).alias("t")).collect()}
    assert got == {0: "é東", 1: "", 2: ""}
    got = docs.select("i", tree.node_text(F.col("text"), F.lit(2), F.lit(3)).alias("t")).collect()
    assert got[0].t == "\ufffd" and got[1].t == ""


def test_closures_have_no_last_round(spark):
    """Chains deeper than any fixed number of rounds, and a cycle behind them."""
    n = 80
    nodes = spark.createDataFrame([(str(i), "File" if i == 0 else "Class", "f") for i in range(n)] + [("x", "Class", ""), ("y", "Class", "")], "id string, label string, file_path string")
    edges = spark.createDataFrame([(str(i), str(i + 1), "CONTAINS") for i in range(n - 1)] + [("x", "y", "CONTAINS"), ("y", "x", "CONTAINS")], "src string, dst string, rel_type string")
    below = module_graph.contained_symbols(nodes, edges, nodes.filter("id = '0'")).collect()
    assert sorted(r.level for r in below) == list(range(1, n))
    owner = {r.id: r.file for r in module_graph.owning_file(nodes, edges).collect()}
    assert owner == {**{str(i): "0" for i in range(n)}, "x": None, "y": None}
    arcs = spark.createDataFrame([(1, i, i + 1) for i in range(300)] + [(1, 300, 0), (2, 5, 6)], "file_id int, src long, dst long")
    starts = spark.createDataFrame([(1, 0), (2, 0)], "file_id int, start long")
    ends = spark.createDataFrame([(1, 300), (2, 6), (1, 0)], "file_id int, at long")
    assert {tuple(r) for r in security.reached(starts, ends, arcs).collect()} == {(1, 0, 300), (1, 0, 0)}


def test_gates_of_the_composable_pillar(spark):
    """An unmeasured fan-in exempts nothing; the distance stands in for instability only where abstractness and coupling say something."""
    rows = [("a", "mdg.instability", 1.0), ("b", "mdg.instability", 1.0), ("b", "mdg.abstractness", 0.5), ("b", "mdg.coupling", 4.0), ("c", "mdg.instability", 0.0), ("c", "mdg.abstractness", 0.25), ("c", "mdg.coupling", 2.0), ("d", "mdg.instability", 0.9), ("d", "mdg.abstractness", 0.5), ("d", "mdg.coupling", 1.0)]
    files = spark.createDataFrame([(x, True, True, True) for x in "abcd"], "file_id string, is_parseable boolean, is_entrypoint boolean, is_stable_leaf boolean")
    metrics = spark.createDataFrame(rows, "file_id string, metric string, value double")
    got = {(r.file_id, r.metric): r.outcome for r in gates.outcomes(metrics, files).collect()}
    assert got == {("a", "mdg.instability"): "fail_high", ("b", "mdg.main_sequence_distance"): "pass", ("c", "mdg.main_sequence_distance"): "exempt_high", ("d", "mdg.instability"): "fail_high"}
    scores = {r.file_id: r.composable for r in gates.scores(metrics, files).collect()}
    assert scores["a"] == 0 and scores["b"] == 0 and scores["c"] == 0 and math.isclose(scores["d"], 1 / 3)
    lines = {r.file_id: r.line for r in gates.outcomes(metrics, files).select("file_id", gates.interpretation().alias("line")).collect()}
    assert lines["a"] == "instability (1.00) is too high (module depends on too many things)" and lines["c"].endswith("declarations-only leaf modules")
    assert {r.file_id: (r.mask, len(r.results)) for r in gates.classify(files, metrics).collect()} == dict.fromkeys("abcd", (2, 1))


def test_files_that_do_not_parse_have_nothing(spark):
    from arborq.operators import report

    files = spark.createDataFrame([("a", "p/a", False), ("b", "p/b", True)], "file_id string, path string, is_parseable boolean")
    metrics = spark.createDataFrame([("a", "cfg.cyclomatic", 50.0), ("b", "cfg.cyclomatic", 50.0), ("a", "cpg.taint_flows", 3.0)], "file_id string, metric string, value double")
    c = {r.file_id: r for r in gates.classify(files, metrics).collect()}
    assert c["a"].mask == 0 and not c["a"].gates and not c["a"].results and c["a"].simple is None and c["b"].mask == 1
    keyed = {r.file_id: r for r in report.with_sort_key(gates.classify(files, metrics), gates.outcomes(metrics, files)).collect()}
    assert keyed["a"].hard_fail and keyed["a"].failures == 0 and keyed["b"].giant and not keyed["b"].hard_fail
    said = {r.file_id: (r.severity, r.metric, r.message) for r in report.suggestions(files, gates.outcomes(metrics, files)).collect()}
    assert said["a"] == ("fix", None, report.PARSE_ERROR) and said["b"][:2] == ("improve", "cfg.cyclomatic")


SCOPED = "class A:\n    def m(self):\n        def inner(x):\n            if x:\n                return x\n        return inner\nasync def go():\n    y = 1\n    z = y + w\n"


def test_located_functions_and_names(spark):
    files = spark.createDataFrame([(1, "python", SCOPED)], "file_id int, language string, source string")
    nodes = frontends.parse(files).cache()
    got = {r.qualified_name: (r.name, r.kind, r.start_line, r.end_line, r.complexity) for r in tree.located_complexities(nodes).collect()}
    assert got == {"A.m": ("m", "method", 2, 6, 2), "A.m.inner": ("inner", "closure", 3, 5, 2), "go": ("go", "async_function", 7, 9, 1)}
    graph = flow.build(nodes)
    procs = flow.procedures(flow.blocks_of(graph), flow.edges_of(graph))
    text = {r.node_id: r.text for r in nodes.collect()}
    acc = {(text[r.stmt], r.var, r.is_def) for r in dependence.defs_and_uses(nodes, procs).collect() if text[r.stmt] in ("y = 1", "z = y + w")}
    assert acc == {("y = 1", "y", True), ("z = y + w", "z", True), ("z = y + w", "y", False), ("z = y + w", "w", False)}
    reached = {(text[r.src], text[r.dst], r["var"]) for r in dependence.reaching_definitions(dependence.accesses(nodes, procs)).collect()}
    assert ("y = 1", "z = y + w", "y") in reached
    nodes.unpersist()


def test_deep_nesting_builds_a_graph(spark):
    depth = 2000
    rows = [("f", "FunctionDecl", "", None)] + [(f"i{k}", "IfStmt" if k % 2 == 0 else "Unknown", "" if k % 2 == 0 else "block", f"i{k - 1}" if k else "f") for k in range(depth)]
    nodes = pd.DataFrame([(n, p, i, k, t) for i, (n, k, t, p) in enumerate(rows)], columns=["node_id", "parent_id", "pre", "kind", "native_kind"])
    assert len(flow.Graph(flow.Tree(nodes)).edges) > depth


def test_entry_points_and_environments(spark):
    import_only = "from a import (\n    b,\n    c,\n)\n__all__ = [\n'b',\n]\n# x\n"
    cases = [
        ("p/__init__.py", import_only, "python", True), ("p/__init__.py", "x = 1\n", "python", False), ("p/__init__.py", " \n", "python", False), ("p/__main__.py", import_only, "python", False),
        ("src/lib.rs", "#![x]\npub mod a;\n// c\n", "rust", True), ("src/main.rs", "mod a;", "rust", False), ("Index.TS", "export * from 'a'\n", "typescript", True), ("index.ts", "export const a = 1", "typescript", False),
        ("index.mjs", "/* a\n* b */\nimport x", "javascript", True), ("a.HPP", "#pragma once\n#include <a>", "cpp", True), ("doc.go", "package a", "go", False),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, path string, source string, language string")
    got = {r.i: r.e for r in df.select("i", discovery.entrypoint(F.col("path"), F.col("source"), F.col("language")).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]
    paths = spark.createDataFrame([(p,) for p in ("a/x.py", "e/pyvenv.cfg", "e/lib/y.py", "q/bin/python3", "q/z.py", "qq/z.py", "top.py")], "path string")
    left = {r.path for r in discovery.outside(paths, discovery.environments(paths)).collect()}
    assert left == {"a/x.py", "qq/z.py", "top.py"}
    kept = spark.createDataFrame([(p,) for p in ("vendor/a.py", ".gitnexus/a.py", "htmlcov/a.py", ".cache/a.py", "venv.bak/a.py")], "path string")
    assert {r.path for r in kept.filter(~discovery.pruned(F.col("path"))).collect()} == {"vendor/a.py", ".cache/a.py"}
    one = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, source string")
    other = spark.createDataFrame([("b", "y"), ("a", "x")], "path string, source string").repartition(3)
    assert discovery.fingerprint(one) == discovery.fingerprint(other) != discovery.fingerprint(one.limit(1))


def test_status_needs_a_clear_direction(spark):
    rows = [(1, 1, 1, 5.0, -1.0, 0.0, 0.0), (2, 1, 1, 5.0, 0.0, 0.0, 0.0), (3, 1, 1, -2.0, 0.0, 0.0, 0.0), (4, 1, 3, 4.0, 0.0, 0.0, 0.0), (5, 3, 5, 0.0, 0.0, 0.0, 0.0)]
    deltas = spark.createDataFrame(rows, "file_id int, mask_before int, mask_after int, d_simple double, d_composable double, d_secure double, d_navigable double")
    assert [r.status for r in assess.status(deltas).orderBy("file_id").collect()] == ["lateral", "score_up", "score_down", "improvement", "lateral"]
    near = spark.createDataFrame([(2, 0.01), (3, 0.0), (4, 0.019), (5, 0.0)], "file_id int, distance double")
    assert [r.status for r in assess.status(deltas, near).orderBy("file_id").collect()] == ["lateral", "suspicious", "score_down", "suspicious", "lateral"]


def test_regression_report(spark):
    schema = "file_id int, name string, start_line int, complexity long, text string"
    before = spark.createDataFrame([(1, "f", 1, 2, "a\nb"), (1, "g", 5, 1, "x"), (2, "h", 1, 3, "q"), (3, "k", 1, 1, "\n".join(map(str, range(60))))], schema)
    after = spark.createDataFrame([(1, "f", 1, 4, "a\nc"), (1, "g", 5, 2, "y"), (2, "h", 1, 3, "q"), (3, "k", 1, 2, "\n".join(f"n{i}" for i in range(60)))], schema)
    got = {r.file_id: r for r in assess.regression_report(before, after).collect()}
    assert set(got) == {1, 3} and got[1].name == "f" and got[1].diff.split("\n")[:4] == ["# regression in `f`: cyclomatic complexity 2 -> 4 (+2)", "--- f (current)", "+++ f (proposed)", "@@ -1,2 +1,2 @@"]
    assert got[3].diff.split("\n")[-1].startswith("# ... (truncated, ") and len(got[3].diff.split("\n")) == 42


def test_hotspots(spark):
    from arborq.operators import targets

    cycles = spark.createDataFrame([(1, i, [i, i + 1]) for i in range(7)], "file_id int, cycle long, blocks array<long>")
    spans = spark.createDataFrame([(1, i, 10, 10 + i) for i in range(6)], "file_id int, cycle long, start_line int, end_line int")
    got = targets.cycle_hotspots(spans, cycles).orderBy(F.desc("score")).collect()
    assert [r.score for r in got] == [5.0, 4.0, 3.0, 2.0, 1.0] and got[0].label == "cycle over blocks [5, 6]"
    curved = spark.createDataFrame([("a", "b", -0.5), ("b", "c", 0.25), ("a", "c", -1.0)], "a string, b string, curvature double")
    files = spark.createDataFrame([("a",), ("c",)], "file string")
    got = sorted((r.file, r.score, r.suggestion[:4]) for r in targets.dependency_hotspots(curved, files, 2).collect())
    assert got == [("a", -1.0, "High"), ("a", -0.5, "High"), ("c", -1.0, "High"), ("c", 0.25, "Well")]
    steps = spark.createDataFrame([(p, i, n) for p, path in enumerate(("abc", "xbc", "xy")) for i, n in enumerate(path)], "process_id int, step int, node_id string")
    owner = spark.createDataFrame([("c", "F"), ("b", "F"), ("y", "G"), ("x", None)], "id string, file string")
    curved = curvature.directed_forman(process.transitions_by_file(steps, owner), ("file",))
    got = sorted((r.file, r.score, r.label) for r in targets.process_hotspots(curved).collect())
    # F: a -> b, x -> b once, b -> c twice; G: x -> y alone
    root = 2**0.5
    want = [("F", 2 - root * 2, "b -> c"), ("F", 2 - 1 / root, "a -> b"), ("F", 2 - 1 / root, "x -> b"), ("G", 2.0, "x -> y")]
    assert [(f, round(x, 9), n) for f, x, n in got] == [(f, round(x, 9), n) for f, x, n in want]


def test_kinds_outside_the_vocabulary_are_an_error(spark):
    df = spark.createDataFrame([(["a", "z"], ["a"])], "a array<string>, b array<string>")
    with pytest.raises(Exception, match="outside the vocabulary"):
        df.select(compare.edit_distance(F.col("a"), F.col("b"), ["a"])[0]).collect()
    x = spark.createDataFrame([(1, ["a", "z"]), (2, ["q"])], "file_id int, kinds array<string>")
    y = spark.createDataFrame([(1, ["a"])], "file_id int, kinds array<string>")
    assert {r.file_id: (r.raw, r.distance, r.similarity) for r in compare.ast_distance(x, y).collect()} == {1: (1, 0.5, 0.5), 2: (None, 1.0, 0.0)}


def test_verdict_texts(spark):
    got = {r.mask: r for r in L.masks(spark).select("mask", L.name(F.col("mask")).alias("n"), L.description(F.col("mask")).alias("d")).collect()}
    assert got[7].n == "SIMPLE_COMPOSABLE_SECURE" and got[9].d == "🥈 SILVER - Two of four quality pillars satisfied (SIMPLE_NAVIGABLE)" and got[0].d.startswith("❌ NO MEDAL")


def test_fan_counts_ends_without_a_node(spark):
    """Calls to and from identifiers that no file owns, or that are no node, are external calls."""
    nodes = spark.createDataFrame([("F", "File", "f"), ("A", "Class", None), ("B", "Class", None), ("L", "Class", None)], "id string, label string, file_path string")
    edges = spark.createDataFrame([("F", "A", "DEFINES"), ("F", "B", "DEFINES"), ("A", "B", "CALLS"), ("A", "ghost", "CALLS"), ("A", "L", "CALLS"), ("B", "ghost", "CALLS"), ("spirit", "A", "CALLS"), ("L", "A", "CALLS"), ("L", "B", "CALLS"), ("ghost", "spirit", "CALLS")], "src string, dst string, rel_type string")
    owner = module_graph.owning_file(nodes, edges)
    assert [tuple(r) for r in module_graph.fan(nodes, edges, owner).collect()] == [("F", 2, 2)]


def test_eccentricities_against_searches(spark):
    """More sources than a word has bits, cycles, nodes that reach nothing and nodes that are no source."""
    import random
    from collections import deque

    r = random.Random(4)
    arcs = [(r.randrange(150), r.randrange(150)) for _ in range(220)] + [(i, i + 1) for i in range(200, 230)] + [(230, 200)]
    sources = [*range(140), 200, 215, 999]
    got = {x.id: x.depth for x in module_graph.eccentricities(spark.createDataFrame([(i,) for i in sources], "id int").repartition(3), spark.createDataFrame(arcs, "src int, dst int")).collect()}

    def far(s):
        seen, todo = {s: 0}, deque([s])
        while todo:
            x = todo.popleft()
            for a, b in arcs:
                if a == x and b not in seen:
                    seen[b] = seen[x] + 1
                    todo.append(b)
        return max(seen.values())

    assert got == {s: far(s) for s in sources}


def test_balanced_curvature_against_sets(spark):
    """Random graphs by neighbour sets, and a star whose centre has more leaves than any list should hold."""
    import random

    def plain(edges):
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

        def squares(fixed, pivot):
            v = [len(near[fixed] & near[k]) - (k in near[fixed]) for k in near[pivot]]
            return sum(x > 0 for x in v), max([x for x in v if x > 0], default=0)

        out = {}
        for a, b in edges:
            x, y = max(len(near[a]), len(near[b])), min(len(near[a]), len(near[b]))
            (s1, l1), (s2, l2) = squares(a, b), squares(b, a)
            lam = max(l1, l2)
            out[a, b] = 0.0 if y <= 1 else 2 / x + 2 / y - 2 + (2 / x + 1 / y) * len(near[a] & near[b]) + ((s1 + s2) / (x * lam) if lam else 0)
        return out

    for seed, n, m in ((1, 12, 30), (2, 40, 60), (3, 9, 30)):
        r = random.Random(seed)
        edges = {tuple(sorted((r.randrange(n), r.randrange(n)))) for _ in range(m)}
        edges = sorted(e for e in edges if e[0] != e[1])
        got = {(x.a, x.b): x.curvature for x in curvature.balanced_forman(spark.createDataFrame(edges, "src int, dst int")).collect()}
        want = plain(edges)
        assert set(got) == set(want) and all(abs(got[e] - want[e]) < 1e-12 for e in want)
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).unionByName(spark.createDataFrame([(1, 2)], "src long, dst long"))
    top = curvature.balanced_forman(star).filter("curvature <> 0").orderBy("a", "b").collect()
    assert [(x.a, x.b) for x in top] == [(0, 1), (0, 2), (1, 2)]


@pytest.mark.parametrize("seed,limit", [(1, 0.1), (2, 0.25), (3, 0.45)])
def test_clones_against_all_pairs(spark, seed, limit):
    """Edited copies of a few sequences of three kinds; no pair within the limit is missed, and none is formed without a shared part."""
    import random

    r = random.Random(seed)

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, b in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        return row[-1]

    base = [[r.choice("abc") for _ in range(r.choice((1, 5, 12, 33)))] for _ in range(9)]
    rows = [(i, list(b)) for i, b in enumerate(base)]
    for i in range(60):
        x = list(r.choice(base))
        for _ in range(r.randrange(4)):
            at = r.randrange(len(x) + 1)
            x[at : at + r.randrange(2)] = r.choices("abc", k=r.randrange(2))
        rows.append((100 + i, x))
    got = {(x.a, x.b): x.distance for x in compare.clones(spark.createDataFrame(rows, "file_id int, kinds array<string>"), ["a", "b", "c"], limit).collect()}
    first = {}
    for i, x in sorted(rows):
        first.setdefault(tuple(x), i)
    want = {(first[tuple(x)], i): 0.0 for i, x in rows if first[tuple(x)] != i}
    for x, i in first.items():
        for y, j in first.items():
            if i < j and x and y and edits(x, y) <= limit * max(len(x), len(y)) + 1e-9:
                want[i, j] = edits(x, y) / max(len(x), len(y))
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_exact_rounding(spark):
    """As a formatter of the exact binary value rounds: halves to even, and values that only look like halves by what they are."""
    from arborq.functions.rounding import exact_round, formatted

    values = [0.125, 0.375, 0.145, 0.015, 0.045, 0.055, 1.005, 2.675, 0.285, 1e-9, 0.0, 12.5, -0.125, 0.995] + [i / 1000 for i in range(0, 3000, 5)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(F.format_string("%.2f", exact_round(F.col("v"), 2))).collect()]
    assert [g.replace("-0.00", "0.00") for g in got] == [f"{v:.2f}".replace("-0.00", "0.00") for v in values]
    assert df.limit(1).select(formatted("about %1$.1f (> %2$.0f)", F.col("v"), F.lit(3.0))).first()[0] == "about 0.1 (> 3)"


def test_rollup_keeps_files_without_a_language(spark):
    c = spark.createDataFrame([(1, None, True, 0.5), (2, None, False, 0.25), (3, "py", True, 0.75)], "file_id int, language string, is_parseable boolean, simple double")
    c = c.withColumns({p: F.lit(None).cast("double") for p in ("composable", "secure", "navigable")})
    results = spark.createDataFrame([(1, "simple", True), (2, "simple", True), (3, "simple", True)], "file_id int, pillar string, achieved boolean")
    got = {(r.grp, r.is_total): (r.holds, r.min_score) for r in report.rollup(c, results).collect()}
    assert got == {(None, False): (False, 25.0), (None, True): (False, 25.0), ("py", False): (True, 75.0)}
    assert {(r.grp, r.is_total): r.mask for r in report.floor_verdict(report.rollup(c, results)).collect()} == {(None, False): 0, (None, True): 0, ("py", False): 1}


def test_structured_results_are_written_once(spark, tmp_path):
    """Nested rows a file; a second write replaces the first, and a failed attempt of a task leaves nothing."""
    import json
    import os

    c = spark.createDataFrame([(1, "a.py", "python", True, 1), (2, "b.py", None, False, 0)], "file_id int, path string, language string, is_parseable boolean, mask int")
    c = c.withColumns({p: F.lit(0.5) for p in ("simple", "composable", "secure", "navigable")}).withColumn("gates", F.array(F.struct(F.lit("m").alias("metric"), F.lit(True).alias("passed")))).withColumn("results", F.array(F.lit("x")))
    s = spark.createDataFrame([(1, 1, "second"), (1, 0, "first")], "file_id int, place int, message string")
    for _ in range(2):
        report.write_structured(report.structured(c, s), f"{tmp_path}/out")
    read = [json.loads(line) for f in os.listdir(f"{tmp_path}/out") if f.endswith(".json") for line in open(f"{tmp_path}/out/{f}")]
    got = {r["path"]: r for r in read}
    assert len(read) == 2 and [x["message"] for x in got["a.py"]["suggestions"]] == ["first", "second"] and got["b.py"]["suggestions"] == []
    assert got["a.py"]["verdict"] == {"mask": 1, "name": "SIMPLE", "is_parseable": True} and got["b.py"]["language"] is None


def test_reach_bits_against_searches():
    """Random graphs with cycles, loops and ends outside the graph; a long chain needs no deep stack."""
    import random

    for seed in range(30):
        r = random.Random(seed)
        n = r.randrange(2, 25)
        near = {}
        for _ in range(r.randrange(3 * n)):
            near.setdefault(r.randrange(n), []).append(r.randrange(n))
        bit = {x: 1 << i for i, x in enumerate(r.sample(range(n + 2), r.randrange(1, n)))}

        def search(s):
            seen, todo = {s}, [s]
            while todo:
                for y in near.get(todo.pop(), ()):  # noqa: B023
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return sum(bit.get(x, 0) for x in seen)  # noqa: B023

        got = security.reach_bits(near, bit)
        assert all(got.get(x, 0) == search(x) for x in {*near, *bit, *(y for ys in near.values() for y in ys)})
    chain = {i: [i + 1] for i in range(200_000)}
    assert security.reach_bits(chain, {200_000: 1})[0] == 1
