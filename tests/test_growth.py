"""Work and memory that grow with the input only, and a query whose rows once left its SQL."""

import os
import time

import numpy as np
from arborq.operators import compare, curvature, dependence, flow, module_graph, security, targets
from arborq.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_a_file_of_calls_alone_is_a_leaf_as_its_sql_says(spark, tmp_path):
    for name in os.listdir(SF):
        if name != "lineitem.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.withColumn("l_returnflag", F.lit("N")).withColumn("l_linestatus", F.lit("O")).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert catalog.QUERIES["stable_leaf"](spark, str(tmp_path)).filter("NOT is_stable_leaf").count() == 0


def test_tables_are_written_by_small_tasks_and_settings_stay(spark):
    seen = {}
    key = "spark.sql.shuffle.partitions"
    was = spark.conf.get(key)

    class Watched:
        """Notes the settings that a table is written under."""

        sparkSession = spark

        def __init__(self, df):
            self.df, self.schema = df, df.schema

        @property
        def write(self):
            seen.update({k: spark.conf.get(k) for k in (key, "spark.sql.adaptive.advisoryPartitionSizeInBytes")})
            return self.df.write

    out = module_graph.cut(Watched(spark.range(10)), rows=100 * module_graph.PARTITION_ROWS)
    assert out.count() == 10 and spark.conf.get(key) == was
    assert seen == {key: "100", "spark.sql.adaptive.advisoryPartitionSizeInBytes": module_graph.ADVISORY}


def test_no_table_that_grows_is_broadcast(spark):
    nodes = catalog._trees(spark, SF)
    blocks, edges = catalog._flow(spark, SF, nodes)
    control = dependence.control_dependence(blocks, edges)
    graph = dependence.property_graph(nodes, blocks, edges, dependence.reaching_definitions(catalog._accesses(nodes)), control)
    assert graph.count() > 0
    assert "Broadcast" not in graph._jdf.queryExecution().executedPlan().toString()


def test_files_pass_as_a_stream_and_long_ones_take_time_in_proportion(spark):
    n = 20_000
    ids = list(range(n + 2))
    edges = [(0, 2, "unconditional")]
    for b in range(2, n + 2):
        nxt = b + 1 if b < n + 1 else 1
        edges += [(b, nxt, "true"), (b, nxt, "false")]
    start = time.time()
    assert flow.graph_metrics(ids, edges) == (1, 0, n + 1, 2 * n + 1 - len(ids) + 1)
    assert time.time() - start < 5  # a walk to the exit from each head took minutes
    rows = spark.createDataFrame([(f, i) for f in (3, 1, None, 2) for i in (2, 1, 3)], "file_id int, place long")
    got = flow.by_file(rows, lambda own: [(len(own), [p for _, p in own])], {"n": flow.pa.int64(), "places": flow.pa.list_(flow.pa.int64())}, "place")
    assert sorted(map(str, got.collect())) == sorted(map(str, [got.collect()[0].__class__(file_id=f, n=3, places=[1, 2, 3]) for f in (3, 1, None, 2)]))


def test_gw_folds_alike_nodes_and_gives_what_the_whole_plan_gives():
    def whole(c1, c2):
        p, q = np.full(len(c1), 1 / len(c1)), np.full(len(c2), 1 / len(c2))
        t = np.outer(p, q)
        const = (c1**2 @ p)[:, None] + (c2**2 @ q)[None, :]
        for _ in range(compare.GW_OUTER):
            cost = const - 2 * c1 @ t @ c2.T
            k = np.exp(-(cost - cost.min()) / compare.GW_REGULAR)
            u = np.ones(len(p))
            for _ in range(compare.GW_SINKHORN):
                v = q / np.maximum(k.T @ u, 1e-300)
                u = p / np.maximum(k @ v, 1e-300)
            new = u[:, None] * k * v[None, :]
            moved, t = np.abs(new - t).max(), new
            if moved < compare.GW_TOLERANCE:
                break
        return float(((const - 2 * c1 @ t @ c2.T) * t).sum())

    rng = np.random.default_rng(5)
    trees = [[-1, *(int(rng.integers(max(0, i - 4), i)) for i in range(1, n))] for n in (1, 2, 9, 30, 60)] + [[-1] + [0] * 40, [-1, -1, 0, 1, 1], [-1, 3, 0, 0]]
    for a in trees:
        for b in trees:
            x, y = compare._hops(a), compare._hops(b)
            if a == b:
                assert compare.gw_distance(a, b) == 0
                continue
            scale = max(x.max(), y.max(), 1.0)
            x, y = x / scale, y / scale
            own = max((whole(x, x) + whole(y, y)) / 2, 0.0)
            want = np.clip((whole(x, y) - own) / max((x**2).mean(), (y**2).mean(), 1e-12), 0.0, 1.0)
            assert abs(compare.gw_distance(a, b) - want) < 1e-9
    assert len(set(compare._alike([-1] + [0] * 199))) == 2  # a plan of 4 entries, not of 40,000


def test_arcs_of_many_graphs_are_not_sorted_for_their_sums_and_ties_are_ranked_by_label(spark):
    arcs = [("f", f"a{i % 7}", f"b{i % 5}", 1.0 + i % 3) for i in range(200)] + [("g", f"a{i}", "b", 1.0) for i in range(12)]
    curved = curvature.directed_forman(spark.createDataFrame(arcs, "file string, src string, dst string, weight double"), ("file",))
    assert "SortMergeJoin" not in curved._jdf.queryExecution().executedPlan().toString()
    rows = curved.collect()
    for n in (1, 5, 300):
        want = {(f, *x) for f in "fg" for x in sorted((r.curvature, f"{r.src} -> {r.dst}") for r in rows if r.file == f)[:n]}
        got = targets.process_hotspots(curved, n).collect()
        assert {(r.file, r.score, r.label) for r in got} == want and len(got) == sum(min(n, sum(r.file == f for r in rows)) for f in "fg")


def test_one_pass_builds_graphs_with_their_procedures_and_metrics(spark):
    nodes = catalog._exported(spark, SF)
    graph, both = flow.build(nodes), module_graph.cut(flow.build_and_measure(nodes))
    blocks, edges = flow.blocks_of(graph), flow.edges_of(graph)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(blocks) == rows(flow.blocks_of(both)) and rows(edges) == rows(flow.edges_of(both))
    assert rows(flow.procedures(blocks, edges)) == rows(flow.procedures_of(both)) and rows(flow.metrics(blocks, edges)) == rows(flow.metrics_of(both))


def test_files_are_read_in_small_pieces_and_sorted_in_partitions_that_no_setting_merges(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = {}

    class Watched:
        sparkSession = spark
        schema = spark.range(1).schema

        @property
        def write(self):
            seen["split"] = spark.conf.get("spark.sql.files.maxPartitionBytes")
            return spark.range(1).write

    module_graph.cut(Watched())
    assert seen == {"split": module_graph.SPLIT} and spark.conf.get("spark.sql.files.maxPartitionBytes") == was
    rows = 40 * module_graph.PARTITION_ROWS
    nodes = spark.range(1000).selectExpr("id % 100 AS file_id", "id AS pre")
    assert module_graph.spread(nodes, rows).rdd.getNumPartitions() == 40
    got = flow.by_file(nodes, lambda own: [(len(own),)], {"n": flow.pa.int64()}, "pre", parts=module_graph.parts(spark, rows))
    assert got.rdd.getNumPartitions() == 40 and got.filter("n = 10").count() == 100
    for name in ("kind_sequence", "qualified_names", "reaching_defs", "kind_l1_distance", "taint_bridge"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name


def test_reached_ends_of_a_file_come_as_a_stream_with_numbers_too(spark):
    edges = spark.createDataFrame([(1, 5, 6), (1, 6, 5), (1, 6, 7), (2, 5, 7)], "file_id int, src int, dst int")
    starts = spark.createDataFrame([(1, 5), (1, 7), (2, 7), (None, 5)], "file_id int, start int")
    ends = spark.createDataFrame([(1, 7), (1, 5), (2, 5), (None, 5)], "file_id int, at int")
    got = security.reached(starts, ends, edges, 3)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 5, 5), (1, 5, 7), (1, 7, 7), (None, 5, 5)]


def test_blocks_and_edges_read_numbered_statements_without_a_shuffle(spark):
    nodes = catalog._trees(spark, SF)
    rows = lambda df: sorted(map(str, df.collect()))
    for got, whole in zip(catalog._flow_tables(spark, SF, nodes), catalog.D.flow_graphs(spark, SF), strict=True):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
        assert rows(got) == rows(whole)
