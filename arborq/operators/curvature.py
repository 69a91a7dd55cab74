"""Forman curvature of undirected and directed graphs, by joins on the edges.

The undirected form is the balanced one for simple graphs. All it needs of an edge are the degrees of its ends and its triangles, so no list of
neighbours is ever gathered and a hub costs as much as its edges. The directed form needs sums only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .module_graph import cut, lift_to_files

#: Heavy arcs that a bound is taken from, for each of the lowest that are asked for, and more than a rounding to six places moves a value.
HEAVY, ROUNDED = 64, 1e-5


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: each unordered pair once, no self-loops."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(e: DataFrame) -> DataFrame:
    """(x, y, z): each triangle of the unordered pairs (a, b) once.

    Every edge is turned towards its end of the higher degree, so a node has at most the square root of twice the edges as successors; pairs of
    successors that are joined themselves close a triangle. A star has no such pair, whatever its size.
    """
    ends = e.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    with_degree = e.join(ends.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(ends.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    x, y = F.struct(F.col("da").alias("d"), F.col("a").alias("n")), F.struct(F.col("db").alias("d"), F.col("b").alias("n"))
    turned = with_degree.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    two = turned.select(F.col("u.n").alias("u"), F.col("v").alias("v")).join(turned.select(F.col("u.n").alias("u"), F.col("v").alias("w")), "u").filter("v < w")
    two = two.select("u", F.col("v.n").alias("v"), F.col("w.n").alias("w")).withColumn("a", F.least("v", "w")).withColumn("b", F.greatest("v", "w"))
    closed = two.join(e, ["a", "b"], "left_semi")
    t = F.array_sort(F.array("u", "v", "w"))
    return closed.select(t[0].alias("x"), t[1].alias("y"), t[2].alias("z"))


def balanced_forman(edges: DataFrame) -> DataFrame:
    """(a, b, curvature). 0 where an end has one neighbour; else 2/max + 2/min - 2 + (2/max + 1/min) * triangles, and
    sharp / (max * lambda) for four-cycles.

    For each end and the other end i, every neighbour k of the end, i itself included, has the value |N(k) & N(i)|, less one where k
    is a neighbour of i; sharp counts the positive values at both ends and lambda is the largest of them. Both follow from degrees and triangles:
    i itself has its degree as value, and no other k has more, so lambda is the larger degree; the end is a common neighbour of k and i, so a
    value is 0 only where k and i are joined and have no other one, that is where their edge is in one triangle.
    """
    e = cut(undirected(edges))
    degree = e.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    t = cut(triangles(e))
    sides = (("x", "y"), ("x", "z"), ("y", "z"))
    count = t.select(F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in sides])).alias("s")).groupBy("s.a", "s.b").agg(F.count(F.lit(1)).alias("tri"))
    count = cut(count)
    for a, b in sides:
        t = t.join(count.select(F.col("a").alias(a), F.col("b").alias(b), (F.col("tri") == 1).cast("int").alias(f"only_{a}{b}")), [a, b])
    others = {"xy": ("xz", "yz"), "xz": ("xy", "yz"), "yz": ("xy", "xz")}
    flat = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b"), sum(F.col(f"only_{o}") for o in others[a + b]).alias("flat")) for a, b in sides])
    zero = t.select(F.explode(flat).alias("s")).groupBy("s.a", "s.b").agg(F.sum("s.flat").alias("flat"))
    out = e.join(degree.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    out = out.join(count, ["a", "b"], "left").join(zero, ["a", "b"], "left").na.fill(0, ["tri", "flat"])
    most, least = F.greatest("da", "db"), F.least("da", "db")
    sharp = F.col("da") + F.col("db") - F.col("flat")
    value = 2 / most + 2 / least - 2 + (2 / most + 1 / least) * F.col("tri") + sharp / (most * most)
    return out.select("a", "b", F.when(least <= 1, 0.0).otherwise(value).alias("curvature"))


def _arcs(edges: DataFrame) -> DataFrame:
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    return edges.filter("src <> dst").withColumn("weight", weight)


def _into(e: DataFrame, within: tuple[str, ...]) -> DataFrame:
    return e.filter("weight > 0").groupBy(*within, F.col("dst").alias("src")).agg(F.sum(1 / F.sqrt("weight")).alias("into"))


def _out(e: DataFrame, within: tuple[str, ...]) -> DataFrame:
    return e.filter("weight > 0").groupBy(*within, F.col("src").alias("dst")).agg(F.sum(1 / F.sqrt("weight")).alias("out"))


def _directed(e: DataFrame, into: DataFrame, out: DataFrame, within: tuple[str, ...]) -> DataFrame:
    j = e.join(into.hint("shuffle_hash"), [*within, "src"], "left").join(out.hint("shuffle_hash"), [*within, "dst"], "left").na.fill(0.0, ["into", "out"])
    value = F.when(F.col("weight") <= 0, 0.0).otherwise(2.0 - F.sqrt("weight") * (F.col("into") + F.col("out")))
    return j.select(*within, "src", "dst", "weight", value.alias("curvature"))


def directed_forman(edges: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(within..., src, dst, weight, curvature) of weighted arcs; parallel arcs stay, self-loops go, weights of 0 or less give 0.

    w_u and w_v are 1. The sums over arcs into u and out of v are two aggregates, whatever the degrees. ``within`` names columns that tell graphs apart,
    so many graphs take one pass. They have a row a node, so they are hashed by parts and the arcs are never sorted.
    """
    e = _arcs(edges)
    return _directed(e, _into(e, within), _out(e, within), within)


def lowest_forman(edges: DataFrame, n: int, within: tuple[str, ...], rows: int = 0) -> DataFrame:
    """The rows of directed_forman that are among the ``n`` lowest of their graph, with all ties and what rounding may make one, and few others.

    No other arc is sent anywhere: with the largest sums of a graph's nodes an arc's weight alone tells how low it can be at most. The heaviest arcs, HEAVY for each
    of the n or all of an equal weight class, are computed first; the n-th of them is a bound, and what can't reach it is left where it is. Where weights tell nothing apart
    all arcs are heavy, and all are computed. ``edges`` is read several times, so it should be a written table.
    """
    e = _arcs(edges)
    into, out = cut(_into(e, within), rows), cut(_out(e, within), rows)
    top = into.groupBy(*within).agg(F.max("into").alias("_into")).join(out.groupBy(*within).agg(F.max("out").alias("_out")), [*within], "full_outer")
    top = top.select(*within, (F.coalesce("_into", F.lit(0.0)) + F.coalesce("_out", F.lit(0.0))).alias("_top"))
    e = e.withColumn("_class", F.when(F.col("weight") > 0, F.floor(F.log2("weight") * 4)))
    count = e.filter("_class IS NOT NULL").groupBy(*within, "_class").agg(F.count(F.lit(1)).alias("_n"))
    so_far = count.withColumn("_n", F.sum("_n").over(W.partitionBy(*within).orderBy(F.desc("_class"))))
    least = so_far.groupBy(*within).agg(F.coalesce(F.max(F.when(F.col("_n") >= HEAVY * n, F.col("_class"))), F.min("_class")).alias("_least"))
    known = cut(top.join(least, [*within], "left"), rows)
    e = e.join(known, [*within], "left").withColumn("_heavy", F.coalesce(F.col("_class") >= F.col("_least"), F.lit(False)))
    heavy = cut(_directed(e.filter("_heavy").select(*within, "src", "dst", "weight"), into, out, within), rows)
    place = F.row_number().over(W.partitionBy(*within).orderBy("curvature"))
    bound = heavy.select(*within, F.col("curvature").alias("_bound"), place.alias("_place")).filter(F.col("_place") == n).drop("_place")
    low = F.when(F.col("weight") <= 0, 0.0).otherwise(2.0 - F.sqrt("weight") * F.col("_top"))
    may = F.col("_bound").isNull() | F.col("_top").isNull() | F.isnan(low) | (low <= F.col("_bound") + ROUNDED)
    rest = e.filter("NOT _heavy").join(cut(bound, rows), [*within], "left").filter(may)
    return heavy.unionByName(_directed(rest.select(*within, "src", "dst", "weight"), into, out, within))


def module_curvature(edges: DataFrame, owner: DataFrame, rel_type: str = "IMPORTS", file: str | None = None) -> DataFrame:
    """(a, b, curvature): balanced curvature of the graph between files; of the edges at one file where it is given."""
    out = balanced_forman(lift_to_files(edges, owner, rel_type))
    return out if file is None else out.filter((F.col("a") == file) | (F.col("b") == file))
