"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each figure is the smaller of two runs."""

from __future__ import annotations

import json
import os
import random
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from arborq.operators import curvature  # noqa: E402
from arborq.plans import catalog  # noqa: E402

HEADLINE = (
    "folder_floor mdg_metrics mdg_balanced_curvature process_transitions process_directed_curvature fn_complexity fn_divergence structural_summary reaching_defs "
    "cpg_edges cfg_edge_hist file_verdicts language_rollup project_page seq_edit_distance decl_coverage kgram_recall danger_match taint_flows entropy_ratio"
).split()


def graph(spark: SparkSession):
    """10,000 nodes and 50,000 edges."""
    rnd = random.Random(1)
    return spark.createDataFrame([(rnd.randrange(10_000), rnd.randrange(10_000)) for _ in range(50_000)], "src int, dst int").repartition(2)


_kept = []


def curvature_of_a_table(spark: SparkSession, _: str):
    """Directed curvature of the graph, made and cached before the timed runs, as an engine that holds it in memory has it."""
    return curvature.directed_forman(_kept[0])


def curvature_made(spark: SparkSession, _: str):
    """The same with making the graph."""
    return curvature.directed_forman(graph(spark))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(10).count()
    out = {}
    _kept.append(graph(spark).cache())
    _kept[0].count()
    own = {"directed_curvature_10k_50k": curvature_of_a_table, "directed_curvature_10k_50k_made": curvature_made}
    for name in [*HEADLINE, *own]:
        run = own.get(name) or catalog.QUERIES[name]
        took = []
        for _ in range(2):
            began = time.time()
            run(spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        out[name] = round(min(took), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
