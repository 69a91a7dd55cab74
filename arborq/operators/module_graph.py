"""Module graphs: containment closure, coupling, fan, instability, dependency depth.

Nodes are (id, label, file_path), edges (src, dst, rel_type). The closure from symbols to the file that owns them is
computed once by frontier joins and shared by every metric; edges are lifted to files by two equi-joins.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed order in which containment is climbed.
CONTAINMENT = ("CONTAINS", "DEFINES", "HAS_METHOD", "HAS_PROPERTY")
NEUTRAL_INSTABILITY = 0.5


def by_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.filter(F.col("label") == label)


def by_type(edges: DataFrame, rel_type: str) -> DataFrame:
    return edges.filter(F.col("rel_type") == rel_type)


def outgoing(edges: DataFrame, ids: DataFrame, rel_type: str | None = None) -> DataFrame:
    own = by_type(edges, rel_type) if rel_type else edges
    return own.join(ids.select(F.col("id").alias("src")), "src", "left_semi")


def incoming(edges: DataFrame, ids: DataFrame, rel_type: str | None = None) -> DataFrame:
    own = by_type(edges, rel_type) if rel_type else edges
    return own.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def file_lookup(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, id): the file node whose path equals ``path``, or of which one is a /-suffix of the other; the smallest id of several.

    Suffix candidates share their last segment, so that is the join key and no pair of unlike names is formed.
    """
    tail = lambda c: F.element_at(F.split(c, "/"), -1)
    files = by_label(nodes, "File").select("id", "file_path", tail(F.col("file_path")).alias("tail"))
    own = paths.select("path", tail(F.col("path")).alias("tail"))
    same = (F.col("path") == F.col("file_path")) | F.expr("endswith(path, concat('/', file_path))") | F.expr("endswith(file_path, concat('/', path))")
    return own.join(files, "tail").filter(same).groupBy("path").agg(F.min(F.struct(F.col("path") != F.col("file_path"), "id")).alias("m")).select("path", F.col("m.id").alias("id"))


_own_dirs: dict[str, str] = {}


def shared_dir(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets an own one that goes with
    the process; on a cluster that is an error, as executors would write to their own disks."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = sc.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="arborq-tables-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return "file://" + _own_dirs[app]


@contextmanager
def settings(spark, conf: dict[str, str]):
    """The session's settings with ``conf`` among them, until the block ends."""
    was = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: What a task of a table's writing reads of a shuffle (compressed, rows of a tree are about 12 bytes) and of a file, and rows that are a partition more.
ADVISORY, SPLIT, PARTITION_ROWS = "4m", "16m", 250_000
#: Shuffle files go when the query that wrote them has ended, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, rows: int = 0, spread_already: bool = False) -> DataFrame:
    """df with its lineage cut: written as a table to the shared folder and read again, so lost executors cost nothing.

    Its tasks are small whatever the size of the input: files are read in pieces of SPLIT, merged partitions end at ADVISORY, neither at a share of all that is there, and
    where df goes over ``rows`` rows there are as many partitions as they need. What it sends in shuffles is gone when it is written. With ``spread_already``
    joins of tables that are spread by a part of their keys run where the rows lie.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PARTITION_ROWS))
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": ADVISORY, "spark.sql.files.maxPartitionBytes": SPLIT, "spark.sql.shuffle.partitions": str(n), CLEANUP: "true"}
    if spread_already:
        conf["spark.sql.requireAllClusterKeysForCoPartition"] = "false"
    with settings(spark, conf):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def parts(spark, rows: int) -> int:
    """Partitions of a table over ``rows`` rows: one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // PARTITION_ROWS))


def spread(nodes: DataFrame, rows: int) -> DataFrame:
    """nodes by file, in partitions that are small whatever the size of the input. For what sorts all rows of a file: it runs in these partitions, which the
    session's settings neither number nor merge, as they do those of its own shuffle."""
    return nodes.repartition(parts(nodes.sparkSession, rows), "file_id")


def sorted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input: never by broadcast, as files of repeated values are far smaller than their rows in memory."""
    return left.join(right.hint("merge"), on, how)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._cut_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rounds of a closure after which their tables become one.
MERGED = 8


def closure(starts: DataFrame, arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., at, level): all that each start (keys..., at) reaches along arcs (src, dst), at its least number of hops.

    Each round joins the newest frontier only, and the rounds end when there is none, so cycles end and no chain is too long.
    A round's result is written as a table; every few rounds the tables become one.
    """
    arcs = cut(arcs.select("src", "dst").distinct())
    parts = [cut(starts.select(*keys, "at").distinct().withColumn("level", F.lit(0)))]
    level = 0
    while True:
        level += 1
        known = reduce(DataFrame.unionByName, parts).select(*keys, "at")
        nxt = parts[-1].select(*keys, F.col("at").alias("src")).join(arcs, "src").select(*keys, F.col("dst").alias("at")).distinct()
        nxt = cut(nxt.join(known, [*keys, "at"], "left_anti").withColumn("level", F.lit(level)))
        if nxt.isEmpty():
            drop(nxt, arcs)
            return reduce(DataFrame.unionByName, parts)
        if len(parts) >= MERGED:
            merged = cut(reduce(DataFrame.unionByName, parts))
            drop(*parts)
            parts = [merged]
        parts.append(nxt)


def contained_symbols(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, level): everything below each root by containment; cycles end where a node is met again."""
    down = edges.filter(F.col("rel_type").isin(*CONTAINMENT))
    found = closure(roots.select(F.col("id").alias("root"), F.col("id").alias("at")), down, ["root"])
    return found.filter("level > 0").select("root", F.col("at").alias("id"), "level")


def owning_file(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, file): the file that owns each node, climbing containment in its fixed order; null without one or on a cycle.

    A node's parent is fixed first (one per node), then paths are climbed by pointer doubling: after as many rounds as the number of nodes
    has binary digits every path has ended, and what has not runs in a cycle.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in CONTAINMENT]), F.col("rel_type"))
    up = edges.filter(F.col("rel_type").isin(*CONTAINMENT)).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(order, F.col("src"))).getField("src").alias("parent"))
    is_file = F.col("label") == "File"
    state = nodes.select("id", is_file.alias("is_file")).join(up, "id", "left")
    state = cut(state.select("id", F.when(F.col("is_file"), F.col("id")).alias("file"), F.when(~F.col("is_file"), F.col("parent")).alias("at")))
    for _ in range(state.count().bit_length() + 1):
        if state.filter("file IS NULL AND at IS NOT NULL").isEmpty():
            break
        above = state.select(F.col("id").alias("at"), F.col("file").alias("up_file"), F.col("at").alias("up_at"))
        after = cut(state.join(above, "at", "left").select("id", F.coalesce("file", "up_file").alias("file"), F.when(F.coalesce("file", "up_file").isNull(), F.col("up_at")).alias("at")))
        drop(state)
        state = after
    return state.select("id", "file")


def lifted(edges: DataFrame, owner: DataFrame, rel_type: str) -> DataFrame:
    """Edges of a type with the files that own both ends."""
    return (
        by_type(edges, rel_type)
        .join(owner.select(F.col("id").alias("src"), F.col("file").alias("src_file")), "src")
        .join(owner.select(F.col("id").alias("dst"), F.col("file").alias("dst_file")), "dst")
    )


def _files(nodes: DataFrame) -> DataFrame:
    return by_label(nodes, "File").select(F.col("id").alias("file"))


def coupling(nodes: DataFrame, edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(file, ca, ce): distinct other files that import it, and that it imports."""
    pairs = lifted(edges, owner, "IMPORTS").filter("src_file <> dst_file").select("src_file", "dst_file").distinct()
    ca = pairs.groupBy(F.col("dst_file").alias("file")).agg(F.count(F.lit(1)).alias("ca"))
    ce = pairs.groupBy(F.col("src_file").alias("file")).agg(F.count(F.lit(1)).alias("ce"))
    return _files(nodes).join(ca, "file", "left").join(ce, "file", "left").na.fill(0, ["ca", "ce"])


def instability(coupled: DataFrame) -> DataFrame:
    total = F.col("ca") + F.col("ce")
    return coupled.withColumn("instability", F.when(total < 2, NEUTRAL_INSTABILITY).otherwise(F.col("ce") / total))


def fan(nodes: DataFrame, edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(file, fan_in, fan_out): distinct external symbols that call into it, and that it calls. An end that no file owns, or that has no node, is external."""
    end = lambda c: owner.filter("file IS NOT NULL").select(F.col("id").alias(c), F.col("file").alias(c + "_file"))
    calls = by_type(edges, "CALLS").join(end("src"), "src", "left").join(end("dst"), "dst", "left").filter(~F.col("src_file").eqNullSafe(F.col("dst_file")))
    into = calls.groupBy(F.col("dst_file").alias("file")).agg(F.countDistinct("src").alias("fan_in"))
    out = calls.groupBy(F.col("src_file").alias("file")).agg(F.countDistinct("dst").alias("fan_out"))
    return _files(nodes).join(into, "file", "left").join(out, "file", "left").na.fill(0, ["fan_in", "fan_out"])


#: Sources that one word holds, and rounds after which the tables of a search become one.
WORD = 64


def eccentricities(sources: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, depth): the hops from each source (id) to the node that is furthest from it along arcs (src, dst).

    Breadth-first searches of 64 sources at once: a word has a bit for each, a round joins the words of the frontier with the arcs, ORs those that meet at a node,
    and takes away the bits that the node had. So there is a row for a node and 64 sources, not for each pair, and the rounds end when no word has a new bit; cycles end.
    """
    spark = sources.sparkSession
    arcs = cut(arcs.select("src", "dst").distinct())
    # consecutive numbers within a partition, so words are full but for each partition's last
    numbered = cut(sources.select("id").distinct().withColumn("number", F.monotonically_increasing_id()))
    numbered = numbered.select("id", F.shiftright("number", 6).alias("word"), F.expr("CAST(number & 63 AS INT)").alias("place"))
    bit = F.expr("shiftleft(1L, place)")
    parts = [cut(numbered.select("word", F.col("id").alias("at"), bit.alias("bits"), F.lit(0).alias("level")))]
    seen, level = [parts[0]], 0
    while True:
        level += 1
        known = reduce(DataFrame.unionByName, [p.select("word", "at", "bits") for p in seen]).groupBy("word", "at").agg(F.bit_or("bits").alias("had"))
        met = parts[-1].select("word", F.col("at").alias("src"), "bits").join(arcs, "src").groupBy("word", F.col("dst").alias("at")).agg(F.bit_or("bits").alias("bits"))
        new = met.join(known, ["word", "at"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0)))))
        fresh = cut(new.filter("bits <> 0").select("word", "at", "bits", F.lit(level).alias("level")))
        if fresh.isEmpty():
            break
        parts.append(fresh)
        seen.append(fresh)
        if len(seen) >= MERGED:
            merged = cut(reduce(DataFrame.unionByName, [p.select("word", "at", "bits") for p in seen]).groupBy("word", "at").agg(F.bit_or("bits").alias("bits")))
            seen = [merged]
    reached = reduce(DataFrame.unionByName, [p.groupBy("word", "level").agg(F.bit_or("bits").alias("bits")) for p in parts])
    places = spark.range(WORD).select(F.col("id").cast("int").alias("place"))
    last = reached.join(F.broadcast(places), F.expr("(shiftright(bits, place) & 1) = 1")).groupBy("word", "place").agg(F.max("level").alias("depth"))  # 64 rows
    return numbered.join(last, ["word", "place"]).select("id", "depth")


def dependency_depth(nodes: DataFrame, edges: DataFrame, owner: DataFrame) -> DataFrame:
    """(file, dep_depth): the eccentricity of each file over imports that leave file nodes, each hop lifted to the owning file."""
    files = by_label(nodes, "File").select(F.col("id").alias("src"))
    hops = lifted(edges.join(files, "src", "left_semi"), owner, "IMPORTS").filter("dst_file IS NOT NULL AND src_file <> dst_file")
    found = eccentricities(files.select(F.col("src").alias("id")), hops.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")))
    return found.select(F.col("id").alias("file"), F.col("depth").alias("dep_depth"))


def lift_to_files(edges: DataFrame, owner: DataFrame, rel_type: str) -> DataFrame:
    """Edges of a type between files instead of symbols: (src, dst, rel_type)."""
    own = lifted(edges, owner, rel_type).filter("src_file <> dst_file")
    return own.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"), "rel_type").distinct()


def metrics(nodes: DataFrame, edges: DataFrame, owner: DataFrame | None = None) -> DataFrame:
    """One row a file: coupling, instability, fan_in, fan_out, dep_depth; neutral values where the graph has nothing."""
    owner = cut(owning_file(nodes, edges)) if owner is None else owner
    coupled = instability(coupling(nodes, edges, owner)).select("file", (F.col("ca") + F.col("ce")).alias("coupling"), "instability")
    return coupled.join(fan(nodes, edges, owner), "file").join(dependency_depth(nodes, edges, owner), "file", "left").na.fill(0, ["dep_depth"])


def neutral_row(files: DataFrame, found: DataFrame) -> DataFrame:
    """Metrics for every requested file, neutral (0, 0.5, 0, 0, 0) where the graph lacks it."""
    return files.join(found, "file", "left").na.fill({"coupling": 0, "instability": NEUTRAL_INSTABILITY, "fan_in": 0, "fan_out": 0, "dep_depth": 0})


def ranked(df: DataFrame, by: list, within: list[str], k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*within).orderBy(*by))).filter(F.col("_n") <= k).drop("_n")
