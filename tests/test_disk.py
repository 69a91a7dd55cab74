"""What is sent and written grows no further than it must, and goes when it is read."""

import time

import numpy as np
from arborq.operators import compare, curvature, dependence, module_graph, process, targets
from arborq.plans import catalog, structure
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_shuffle_files_of_a_written_table_are_gone(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for n in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n and n.endswith(".data")}
    was = shuffled()
    out = module_graph.cut(spark.range(1000).repartition(3, "id"))
    end = time.time() + 10
    while shuffled() - was and time.time() < end:
        time.sleep(0.1)
    assert not shuffled() - was and out.count() == 1000


def test_compared_graphs_are_not_written_and_each_family_is_sent_once(spark, monkeypatch):
    written = []
    own = module_graph.cut
    keep = lambda df, *args, **kw: written.append(df) or own(df, *args, **kw)
    monkeypatch.setattr(module_graph, "cut", keep)
    monkeypatch.setattr(dependence, "cut", keep)
    (n1, e1, _), (n2, e2, _) = structure._versions(spark, SF)
    assert not [df for df in written if "family" in df.columns]
    written.clear()
    got = dependence.compare_property_graphs(e1, e2, n1, n2)
    assert [df.columns for df in written] == [["file_id", "node_jaccard"]] + [["file_id", "jaccard"]] * 4
    with module_graph.settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        for df in written:
            plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
            assert "ENSURE_REQUIREMENTS" not in plan and "REPARTITION_BY_NUM" in plan
    rows = got.collect()
    want = {r.file_id: r for r in catalog.QUERIES["property_graph_compare"](spark, SF).collect()}
    assert len(rows) == len(want) > 0 and all(round(r.cfg_jaccard, 6) == want[r.file_id].cfg_jaccard for r in rows)


def test_sets_of_edges_agree_on_nulls_and_repeats_and_graphs_without_a_family(spark):
    make = lambda rows: spark.createDataFrame(rows, "file_id long, family string, src string, dst string, label string")
    before = make([(1, "ddg", "a", "b", None), (1, "ddg", "a", "b", None), (1, "ddg", "a", "c", "x"), (2, "ast", "a", "b", ""), (3, "cdg", "a", "b", "")])
    after = make([(1, "ddg", "a", "b", None), (1, "ddg", "a", "c", "y"), (2, "ast", "a", "b", "")])
    pick = lambda df, f: df.filter(F.col("family") == f)
    got = compare.jaccard(pick(before, "ddg"), pick(after, "ddg"), ["file_id"], ["src", "dst", "label"]).collect()
    assert [(r.file_id, round(r.jaccard, 6)) for r in got] == [(1, round(1 / 3, 6))]
    nodes = spark.createDataFrame([(f, "a") for f in (1, 2, 3)], "file_id long, node_id string")
    got = {r.file_id: (r.node_jaccard, r.ast_jaccard, r.cfg_jaccard, round(r.ddg_jaccard, 6), r.cdg_jaccard) for r in dependence.compare_property_graphs(before, after, nodes, nodes).collect()}
    assert got == {1: (1.0, 1.0, 1.0, 0.333333, 1.0), 2: (1.0, 1.0, 1.0, 1.0, 1.0), 3: (1.0, 1.0, 1.0, 1.0, 0.0)}


def test_compared_dependence_makes_and_writes_no_other_family(spark, monkeypatch):
    written = []
    own = module_graph.cut
    keep = lambda df, *args, **kw: written.append((df, args)) or own(df, *args, **kw)
    monkeypatch.setattr(module_graph, "cut", keep)
    monkeypatch.setattr(dependence, "cut", keep)
    catalog.QUERIES["pdg_compare"](spark, SF)
    assert len(written) == 8 and not [df for df, _ in written if "family" in df.columns]  # trees, statements, two kinds of edges of each version, two comparisons
    for df, args in written[-2:]:
        assert df.columns == ["file_id", "jaccard"] and args[0] >= catalog.D.lines(spark, SF)
        assert "parent_id" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_lowest_arcs_of_graphs_are_those_of_all_arcs_and_others_are_not_sent(spark):
    rng = np.random.default_rng(3)
    rows = [("many", f"n{rng.integers(40)}", f"n{rng.integers(40)}", float(w)) for w in rng.geometric(0.4, 3000)]  # a few heavy ones
    rows += [("alike", f"a{i % 30}", f"a{i % 29}", 1.0) for i in range(800)] + [("few", "x", "y", 2.0), ("few", "y", "x", 0.5), ("few", "y", "y", 9.0)]
    rows += [("none", f"a{i}", "b", w) for i, w in enumerate((0.0, -1.0, None))] + [("odd", f"a{i % 9}", f"b{i % 7}", float(i % 5) - 1) for i in range(700)]
    rows += [("hub", "h", f"b{i}", 1.0 + (i == 5) * 3) for i in range(900)]
    edges = spark.createDataFrame(rows, "file string, src string, dst string, weight double")
    whole = curvature.directed_forman(edges, ("file",)).withColumn("curvature", F.round("curvature", 6))
    for n in (1, 5):
        low = curvature.lowest_forman(edges, n, ("file",))
        rows_of = lambda df: sorted((r.file, r.score, r.label) for r in targets.process_hotspots(df, n).collect())  # noqa: B023, E731
        assert rows_of(low.withColumn("curvature", F.round("curvature", 6))) == rows_of(whole)
        assert {r.file for r in low.select("file").distinct().collect()} == {"many", "alike", "few", "none", "odd", "hub"}
    assert low.filter("file = 'many'").count() < 0.6 * whole.filter("file = 'many'").count()


def test_transitions_become_rows_of_a_file_after_they_are_sent(spark):
    steps = spark.createDataFrame([(p, i, x) for p, path in ((1, "abab"), (2, "aab"), (3, "c"), (4, "cz")) for i, x in enumerate(path)], "process_id long, step long, node_id string")
    owner = spark.createDataFrame([("a", "F"), ("b", "F"), ("b", "G"), ("c", "H"), ("z", None)], "id string, file string")
    got = process.transitions_by_file(steps, owner)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(src" in plan and "Exchange hashpartitioning(file" not in plan
    assert sorted(tuple(r) for r in got.collect()) == [("F", "a", "b", 3.0), ("F", "b", "a", 1.0), ("G", "a", "b", 3.0), ("G", "b", "a", 1.0), ("H", "c", "z", 1.0)]


def test_gw_takes_whole_trees_and_large_plans_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    tree = lambda n, back: [-1, *(int(rng.integers(max(0, i - back), i)) for i in range(1, n))]
    same = tree(200, 5)
    tails = [same + [199 + i for i in range(100)], same + [0] * 100]  # alike in their first 200 nodes
    assert compare.gw_distance(*tails) > 0.01
    rows = [(1, f"n{i}", f"n{p}" if p >= 0 else None, i) for i, p in enumerate(tails[0])]
    nodes = spark.createDataFrame(rows, "file_id long, node_id string, parent_id string, pre long")
    assert compare.parent_places(nodes).collect()[0].parents == tails[0]
    trees = [tree(n, back) for n, back in ((1, 1), (2, 1), (40, 3), (70, 60), (55, 1))] + [[-1] + [0] * 50 + [1] * 3, [-1, 0, -1, 2, 2, 0], [-1, 3, 0, 0]]
    want = {(i, j): compare.gw_distance(a, b) for i, a in enumerate(trees) for j, b in enumerate(trees)}
    for room in (1, 37, 900):
        monkeypatch.setattr(compare, "GW_ROOM", room)
        compare._folded.cache_clear()
        compare._own_term.cache_clear()
        for (i, j), d in want.items():
            assert abs(compare.gw_distance(trees[i], trees[j]) - d) < 1e-9, (room, i, j)
    compare._folded.cache_clear()
    compare._own_term.cache_clear()
    for own in trees[:6]:
        hops, classes = compare._hops(own), compare._alike(own)
        folded, whole = compare.FoldedTree(own, classes), compare.Folded(np.array(hops), classes)
        x = rng.random((int(classes.max()) + 1, 3))
        first = np.unique(classes, return_index=True)[1]
        assert np.allclose(folded.times(x), hops[first] @ x[classes]) and folded.top == whole.top
        assert np.allclose(folded.square, (hops[first] ** 2).mean(1)) and np.isclose(folded.mean_square, (hops**2).mean())
