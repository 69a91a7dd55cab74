"""Pairwise comparison: edit distances, histogram and set distances, metric deltas, Gromov-Wasserstein."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .module_graph import cut, sorted_join
from .tree import kind_histogram, kind_sequence

CLONE_LIMIT = 0.1
#: Fixed values of the Gromov-Wasserstein iteration.
GW_OUTER, GW_SINKHORN, GW_REGULAR, GW_TOLERANCE = 50, 100, 0.5, 1e-6
#: Relative change of the scaling factors that is rounding alone.
GW_STILL = 1e-14
#: Entries of a table that Gromov-Wasserstein holds in memory; a larger one is a file of the task, read in blocks of so many entries.
GW_ROOM = 1 << 21


def encoded(kinds: Column, vocabulary: list[str]) -> Column:
    """A sequence of kinds as a string, one character a kind, so that the built-in edit distance applies. Fails on a kind outside the vocabulary."""
    code = F.create_map(*[x for i, k in enumerate(vocabulary) for x in (F.lit(k), F.lit(chr(0x4E00 + i)))])
    one = lambda k: F.coalesce(F.element_at(code, k), F.raise_error(F.concat(F.lit("kind outside the vocabulary: "), F.coalesce(k, F.lit("null")))))
    return F.concat_ws("", F.transform(kinds, one))


def vocabulary(*sequences: DataFrame) -> list[str]:
    """All kinds of the tables' sequences (kinds), in order: grammars have a few hundred, so they come to the driver."""
    kinds = None
    for s in sequences:
        own = s.select(F.explode("kinds").alias("k"))
        kinds = own if kinds is None else kinds.unionByName(own)
    return sorted(r["k"] for r in kinds.distinct().collect())


def ast_distance(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, raw, distance, similarity) of the kind sequences (file_id, kinds) of two versions, over all nodes of the trees.

    distance is the share of the longer one; 1 where a version has no tree, as similarity is then 0.
    """
    words = vocabulary(before, after)
    j = before.select("file_id", F.col("kinds").alias("x")).join(after.select("file_id", F.col("kinds").alias("y")), "file_id", "full_outer")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    raw, share = edit_distance(F.col("x"), F.col("y"), words)
    out = j.select("file_id", F.when(both, raw).alias("raw"), F.when(both, share).otherwise(1.0).alias("distance"))
    return out.withColumn("similarity", 1 - F.col("distance"))


def compare_trees(before: DataFrame, after: DataFrame, include_unknown: bool = False) -> DataFrame:
    """(file_id, kind_distance, raw, edit_distance) of the node tables of two versions, with or without nodes of no known kind.

    kind_distance is half the L1 distance of the shares of kinds, edit_distance the share of the longer sequence; 1 where one version has no tree, 0 where neither has a node that counts.
    """
    hist = lambda n: kind_histogram(n, drop_unknown=not include_unknown)
    edits = ast_distance(kind_sequence(before, include_unknown), kind_sequence(after, include_unknown)).select("file_id", "raw", F.col("distance").alias("edit_distance"))
    j = edits.join(histogram_distance(hist(before), hist(after), ["file_id"], "kind").withColumnRenamed("distance", "kind_distance"), "file_id", "left")
    # half the distance to nothing is a half: a version without shares is as far as can be
    one = hist(before).select("file_id").distinct().join(hist(after).select("file_id").distinct(), "file_id").withColumn("_both", F.lit(True))
    j = j.join(one, "file_id", "left")
    kind = F.when(F.col("kind_distance").isNull(), 0.0).when(F.col("_both"), F.col("kind_distance")).otherwise(1.0)
    return j.select("file_id", kind.alias("kind_distance"), "raw", "edit_distance")


def compare_flow(hist_before: DataFrame, hist_after: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, cyclomatic_delta, edge_distance, longest_path_delta): of edge histograms (file_id, kind, n) and flow metrics of two versions."""
    edges = histogram_distance(hist_before, hist_after, ["file_id"], "kind").withColumnRenamed("distance", "edge_distance")
    x, y = (m.select("file_id", *[F.col(c).alias(c + s) for c in ("cyclomatic", "longest_path")]) for m, s in ((before, "_x"), (after, "_y")))
    delta = lambda c: (F.coalesce(c + "_y", F.lit(0)) - F.coalesce(c + "_x", F.lit(0))).alias(c + "_delta")
    j = x.join(y, "file_id", "full_outer").join(edges, "file_id", "left").na.fill(0.0, ["edge_distance"])
    return j.select("file_id", delta("cyclomatic"), "edge_distance", delta("longest_path"))


def edit_distance(a: Column, b: Column, vocabulary: list[str]) -> tuple[Column, Column]:
    """The Levenshtein distance of two sequences, and its share of the longer one (0 for two empty ones, 1 at most)."""
    raw = F.levenshtein(encoded(a, vocabulary), encoded(b, vocabulary))
    longest = F.greatest(F.size(a), F.size(b))
    return raw, F.when(longest == 0, 0.0).otherwise(F.least(raw / longest, F.lit(1.0)))


def _operations(a: list, b: list) -> tuple[int, int, int, int]:
    """(match, substitute, insert, delete) of one shortest edit, preferring them in this order from the end."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    table[:, 0], table[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = min(table[i - 1, j - 1] + (x != y), table[i, j - 1] + 1, table[i - 1, j] + 1)
    i, j, out = len(a), len(b), [0, 0, 0, 0]
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and table[i, j] == table[i - 1, j - 1]:
            out[0], i, j = out[0] + 1, i - 1, j - 1
        elif i and j and table[i, j] == table[i - 1, j - 1] + 1:
            out[1], i, j = out[1] + 1, i - 1, j - 1
        elif j and table[i, j] == table[i, j - 1] + 1:
            out[2], j = out[2] + 1, j - 1
        else:
            out[3], i = out[3] + 1, i - 1
    return tuple(out)


def edit_operations(a: Column | str, b: Column | str) -> Column:
    """A struct with the counts of the operations of one shortest edit between two arrays; null arrays are empty."""

    def count(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [_operations(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(rows, columns=["matches", "substitutions", "insertions", "deletions"])

    return F.pandas_udf(count, "matches long, substitutions long, insertions long, deletions long")(a, b)


def histogram_distance(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Half the L1 distance of normalised histograms (keys, item, n). Two empty ones are at 0."""
    share = lambda d, c: d.join(d.groupBy(*keys).agg(F.sum("n").alias("_t")), keys).select(*keys, item, (F.col("n") / F.col("_t")).alias(c))
    j = share(left, "p").join(share(right, "q"), [*keys, item], "full_outer").na.fill(0.0, ["p", "q"])
    return j.groupBy(*keys).agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("distance"))


def jaccard(left: DataFrame, right: DataFrame, keys: list[str], items: list[str]) -> DataFrame:
    """Intersection over union of two sets of items for each key; 1 where both are empty (the key is then absent).

    Both sets are put behind each other and grouped once, so sets that are spread by their key already are compared where they lie.
    """
    side = lambda df, n: df.select(*keys, *items, F.lit(n).alias("_side"))
    one = side(left, 1).unionByName(side(right, 2)).groupBy(*keys, *items).agg(F.bit_or("_side").alias("_sides"))
    return one.groupBy(*keys).agg((F.count_if(F.col("_sides") == 3) / F.count(F.lit(1))).alias("jaccard"))


def metric_deltas(before: DataFrame, after: DataFrame, digits: int = 3) -> DataFrame:
    """(file_id, metric, delta) over the union of metrics; a missing one is 0."""
    j = before.select("file_id", "metric", F.col("value").alias("x")).join(after.select("file_id", "metric", F.col("value").alias("y")), ["file_id", "metric"], "full_outer")
    return j.select("file_id", "metric", F.round(F.coalesce("y", F.lit(0.0)) - F.coalesce("x", F.lit(0.0)), digits).alias("delta"))


def clone_candidates(rep: DataFrame, limit: float) -> DataFrame:
    """(a, b): pairs of texts (a, s, n) that may be within ``limit`` edits of the longer one's length, each pair once.

    If d edits lead from the shorter text to the longer one, then of d + 1 parts into which the shorter is cut one is found in the longer, moved by at most d
    places. So the parts of every text are an index, by the number of edits that a partner may need, and each text looks up its own substrings of the parts' lengths
    for its number: a row for each place and two or three lengths. No pair is formed that shares no part. Parts that many texts share are the join's hot keys, which adaptive
    execution splits. Needs a limit below a half, so that a text has more places than edits.
    """
    if not 0 <= limit < 0.5:
        raise ValueError("limit must be at least 0 and below 0.5")
    most = lambda n: F.floor(n * limit + 1e-9).cast("int")
    longest = F.floor(F.col("n") / (1 - limit) + 1e-9).cast("int")
    own = rep.filter("n > 0")
    parts = own.withColumn("d", F.explode(F.sequence(most(F.col("n")), most(longest)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
    size, more = F.expr("n div (d + 1)").cast("int"), F.col("n") % (F.col("d") + 1)
    short = F.col("d") + 1 - more  # the first parts have the plain size, the last ones a place more
    place = F.col("i") * size + F.greatest(F.col("i") - short, F.lit(0))
    length = size + (F.col("i") >= short).cast("int")
    index = parts.select("d", F.expr("a").alias("x"), F.col("n").alias("nx"), place.cast("int").alias("p"), F.substring("s", place.cast("int") + 1, length.cast("int")).alias("part"))
    probe = own.withColumn("d", most(F.col("n")))
    lengths = F.sequence(F.greatest(F.lit(1), F.expr("(n - d) div (d + 1)")).cast("int"), F.least(F.col("n"), F.expr("n div (d + 1) + 1").cast("int")))
    probe = probe.withColumn("len", F.explode(lengths)).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("len"))))
    probe = probe.select("d", F.col("a").alias("y"), F.col("n").alias("ny"), "q", F.substring("s", F.col("q") + 1, F.col("len")).alias("part"))
    near = (F.abs(F.col("p") - F.col("q")) <= F.col("d")) & (F.col("nx") <= F.col("ny")) & (F.col("ny") - F.col("nx") <= F.col("d")) & ((F.col("nx") < F.col("ny")) | (F.col("x") < F.col("y")))
    return index.join(probe, ["d", "part"]).filter(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def clones(sequences: DataFrame, vocabulary: list[str], limit: float = CLONE_LIMIT) -> DataFrame:
    """(a, b, distance) with a < b: pairs of sequences (file_id, kinds) within ``limit`` of each other.

    Candidates share a part (see ``clone_candidates``); their edit distance decides. A group of equal sequences takes
    part as one, and is linked to its smallest member.
    """
    base = sequences.withColumn("s", encoded(F.col("kinds"), vocabulary))
    rep = cut(base.groupBy("s").agg(F.min("file_id").alias("a")).withColumn("n", F.length("s")))
    pairs = clone_candidates(rep, limit)
    j = pairs.join(rep.select("a", "s", "n"), "a").join(rep.select(F.col("a").alias("b"), F.col("s").alias("t"), F.col("n").alias("m")), "b")
    longest = F.greatest("n", "m")
    raw = F.levenshtein("s", "t")
    near = j.withColumn("distance", raw / longest).filter(F.col("distance") <= limit).select("a", "b", "distance")
    same = base.select("s", F.col("file_id").alias("b")).join(rep.select("s", "a"), "s").filter("a < b").select("a", "b", F.lit(0.0).alias("distance"))
    return near.unionByName(same)


def _room(rows: int, columns: int) -> np.ndarray:
    """A table of zeros, in memory or, beyond GW_ROOM entries, in a file that goes with it."""
    if rows * columns <= GW_ROOM:
        return np.zeros((rows, columns))
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, np.float64, "w+", shape=(rows, columns))


def _blocks(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows of ``width`` entries, GW_ROOM entries each at most."""
    step = max(1, GW_ROOM // max(width, 1))
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def _hops(parents: Sequence[int]) -> np.ndarray:
    """Hop distances within a tree, from each node's parent place (-1 for the root), parents first."""
    n = len(parents)
    d = _room(n, n)
    for i, p in enumerate(parents):
        if p >= 0:
            d[i, :i] = d[p, :i] + 1
            d[:i, i] = d[i, :i]
    return d


def _alike(parents: Sequence[int]) -> np.ndarray:
    """Class of each node: two nodes are alike if the tree can be laid on itself with the one on the other. Parents come first; what is no tree has a class a node."""
    n = len(parents)
    if sum(p < 0 for p in parents) != 1 or any(p >= i for i, p in enumerate(parents)):
        return np.arange(n)
    below: list[list[int]] = [[] for _ in parents]
    shapes: dict[tuple[int, ...], int] = {}
    shape = [0] * n
    for i in range(n - 1, -1, -1):
        shape[i] = shapes.setdefault(tuple(sorted(below[i])), len(shapes))
        if parents[i] >= 0:
            below[parents[i]].append(shape[i])
    classes: dict[tuple[int, int], int] = {}
    own: list[int] = []
    for i, p in enumerate(parents):
        own.append(classes.setdefault((own[p] if p >= 0 else -1, shape[i]), len(classes)))
    return np.array(own)


class Folded:
    """A distance matrix by classes of alike nodes: their sizes, hops summed from a class's node to those of each class, mean squared hops."""

    def __init__(self, hops: np.ndarray, classes: np.ndarray):
        first = np.unique(classes, return_index=True)[1]
        n = len(hops)
        self.full, self.size = hops, np.bincount(classes).astype(float)
        if n * n <= GW_ROOM:
            self.hops = hops[first] @ (classes[:, None] == np.arange(len(first)))
            self.square = (hops[first] ** 2).mean(1)
            self.mean_square = float((hops**2).mean())
        else:  # no tree, so each node is a class
            self.hops = hops
            self.square = np.concatenate([(hops[x] ** 2).mean(1) for x in _blocks(n, n)])
            self.mean_square = float(self.square.mean())
        self.top = float(hops.max())

    def times(self, x: np.ndarray) -> np.ndarray:
        """The summed hops by x (a row a class)."""
        return self.hops @ x


class FoldedTree:
    """The same of a tree that is too large for a matrix of its hops: all of it comes from sums over subtrees, carried up and down."""

    full = None

    def __init__(self, parents: Sequence[int], classes: np.ndarray):
        n, m = len(parents), int(classes.max()) + 1
        self.size = np.bincount(classes).astype(float)
        self.up = up = [-1] * m  # a class comes behind its parents' class
        depth = [0] * m
        for i, p in enumerate(parents):
            if p >= 0:
                up[classes[i]] = int(classes[p])
                depth[classes[i]] = depth[classes[p]] + 1
        self.depth = np.array(depth, float)
        self.many = many = [1] + [round(self.size[c] / self.size[up[c]]) for c in range(1, m)]  # children of this class below one node
        below = [[1, 0, 0] for _ in range(m)]  # nodes of the subtree, sums of their hops and squared hops, exact
        for c in range(m - 1, 0, -1):
            a, k, (s0, s1, s2) = below[up[c]], many[c], below[c]
            a[0], a[1], a[2] = a[0] + k * s0, a[1] + k * (s1 + s0), a[2] + k * (s2 + 2 * s1 + s0)
        every = [tuple(below[0])] + [(0, 0, 0)] * (m - 1)
        for c in range(1, m):
            (s0, s1, s2), (_, t1, t2) = below[c], every[up[c]]
            a0, a1, a2 = n - s0, t1 - s1 - s0, t2 - s2 - 2 * s1 - s0  # the rest of the tree, from the parent
            every[c] = (n, s1 + a1 + a0, s2 + a2 + 2 * a1 + a0)
        self.square = np.array([t2 / n for _, _, t2 in every])
        self.mean_square = float(self.size @ self.square / n)
        height, top = [0] * n, 0
        for i in range(n - 1, 0, -1):
            p = parents[i]
            top, height[p] = max(top, height[p] + height[i] + 1), max(height[p], height[i] + 1)
        self.top = float(top)

    def times(self, x: np.ndarray) -> np.ndarray:
        root = (self.size * self.depth) @ x
        out = np.array(x, float)
        for c in range(len(out) - 1, 0, -1):
            out[self.up[c]] += self.many[c] * out[c]
        every, out[0] = out[0].copy(), root
        for c in range(1, len(out)):
            out[c] = out[self.up[c]] + every - 2 * out[c]
        return out


def _gw(a: Folded | FoldedTree, b: Folded | FoldedTree, scale: float) -> float:
    """Entropic Gromov-Wasserstein discrepancy of two distance matrices, divided by ``scale``, under uniform weights.

    A plan starts alike for alike nodes and each step keeps it so, so one entry for each pair of classes has the whole plan. Scaling ends before
    its last round where a round changes nothing any more.
    """
    m, n = a.size, b.size
    if len(m) * len(n) > GW_ROOM or a.full is None or b.full is None:
        return _gw_by_blocks(a, b, scale)
    p, q = 1 / m.sum(), 1 / n.sum()
    s1, s2 = a.hops / scale, (b.hops / scale).T
    t = np.full((len(m), len(n)), p * q)
    const = (a.square[:, None] + b.square[None, :]) / scale**2
    for _ in range(GW_OUTER):
        cost = const - 2 * (s1 @ t @ s2)
        k = np.exp(-(cost - cost.min()) / GW_REGULAR)
        right, left = k * n, np.ascontiguousarray((k * m[:, None]).T)
        u = np.ones(len(m))
        for _ in range(GW_SINKHORN):
            v = q / np.maximum(left @ u, 1e-300)
            was, u = u, p / np.maximum(right @ v, 1e-300)
            if (np.abs(u - was) <= GW_STILL * u).all():
                break
        new = u[:, None] * k * v[None, :]
        moved, t = np.abs(new - t).max(), new
        if moved < GW_TOLERANCE:
            break
    return float(m @ ((const - 2 * (s1 @ t @ s2)) * t) @ n)


def _gw_by_blocks(a: Folded | FoldedTree, b: Folded | FoldedTree, scale: float) -> float:
    """The same steps over a plan of any size: the plan and its kernel are tables that may be files, and a step holds a block of rows or columns of them."""
    m, n = a.size, b.size
    p, q = 1 / m.sum(), 1 / n.sum()
    t, k = _room(len(m), len(n)), _room(len(m), len(n))
    rows, columns = list(_blocks(len(m), len(n))), list(_blocks(len(n), len(m)))
    for r in rows:
        t[r] = p * q

    def cost() -> float:
        """Leaves the costs of plan t in k and returns the least one."""
        for c in columns:
            k[:, c] = a.times(t[:, c]) / scale
        low = np.inf
        for r in rows:
            k[r] = (a.square[r, None] + b.square[None, :]) / scale**2 - 2 * (b.times(k[r].T) / scale).T
            low = min(low, float(k[r].min()))
        return low

    for _ in range(GW_OUTER):
        low = cost()
        for r in rows:
            k[r] = np.exp(-(k[r] - low) / GW_REGULAR)
        u = np.ones(len(m))
        for _ in range(GW_SINKHORN):
            v = q / np.maximum(sum((m[r] * u[r]) @ k[r] for r in rows), 1e-300)
            was, u = u, p / np.maximum(np.concatenate([k[r] @ (n * v) for r in rows]), 1e-300)
            if (np.abs(u - was) <= GW_STILL * u).all():
                break
        moved = 0.0
        for r in rows:
            new = u[r, None] * k[r] * v[None, :]
            moved = max(moved, float(np.abs(new - t[r]).max()))
            t[r] = new
        if moved < GW_TOLERANCE:
            break
    cost()
    return float(sum(m[r] @ (k[r] * t[r]) @ n for r in rows))


@lru_cache(maxsize=16)
def _folded(parents: tuple[int, ...]) -> Folded | FoldedTree:
    classes = _alike(parents)
    if len(parents) ** 2 > GW_ROOM and sum(p < 0 for p in parents) == 1 and all(p < i for i, p in enumerate(parents)):
        return FoldedTree(parents, classes)
    return Folded(_hops(parents), classes)


@lru_cache(maxsize=16)
def _own_term(parents: tuple[int, ...], scale: float) -> float:
    own = _folded(parents)
    return _gw(own, own, scale)


def gw_distance(parents_a: list[int], parents_b: list[int]) -> float:
    """In [0, 1]: 0 for equal trees; 1 where one is empty. All nodes take part; large trees take a plan of all pairs of their classes of alike nodes.

    A tree's own part is remembered for the next pairs, so pairs that share a tree go well behind each other.
    """
    own_a, own_b = (tuple(int(x) for x in own) for own in (parents_a, parents_b))
    if not own_a or not own_b:
        return 0.0 if len(own_a) == len(own_b) else 1.0
    if own_a == own_b:
        return 0.0
    a, b = _folded(own_a), _folded(own_b)
    # trees of other parents have other hops; what is no tree may have the same
    if len(own_a) == len(own_b) and a.full is not None and b.full is not None and all((a.full[r] == b.full[r]).all() for r in _blocks(len(own_a), len(own_a))):
        return 0.0
    scale = max(a.top, b.top, 1.0)
    self_term = max((_own_term(own_a, scale) + _own_term(own_b, scale)) / 2, 0.0)
    top = max(a.mean_square / scale**2, b.mean_square / scale**2, 1e-12)
    return float(np.clip((_gw(a, b, scale) - self_term) / top, 0.0, 1.0))


def tree_gw(a: Column | str, b: Column | str) -> Column:
    """gw_distance of two columns of parent places."""

    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([gw_distance(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return F.pandas_udf(distance, "double")(a, b)


def parent_places(nodes: DataFrame) -> DataFrame:
    """(file_id, parents): parent place of each node in pre-order."""
    up = nodes.select("file_id", F.col("node_id").alias("parent_id"), F.col("pre").alias("parent_pre"))
    j = sorted_join(nodes, up, ["file_id", "parent_id"], "left")
    return j.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", F.coalesce("parent_pre", F.lit(-1)).cast("int").alias("p")))), lambda x: x["p"]).alias("parents"))
