"""Vector code compression: product quantisation with codebooks trained on all vectors, nearest entries by kd-trees.

Components become integers floor(SCALE * x), so all sums and distances are exact and no order of addition matters. A vector is cut into
``PARTS`` equal parts; each part position has a codebook, which starts as that part of the vectors of the ``ENTRIES`` smallest identifiers.
Each round broadcasts one kd-tree per codebook (a few hundred entries: a bound that does not grow with the data). Every task
searches its vectors' parts in batches by branch and bound: a first descent to the leaf on the nearer side gives each part a bound, then the tree is
walked once for all parts together, and a node is entered by those whose distance to the node's box is at most their bound. Nodes of equal bound
are entered too, so of equally near entries the one of the lowest index is found. Tasks add up integer sums and counts per entry, Spark adds those up, and
the driver gets one row per entry.

Results for odd inputs: rows whose vector is null or holds null or non-finite components are dropped, as are those with a component beyond +-LARGEST (whose squares
would not fit) and those of another length than the vector of the smallest identifier; a length that PARTS doesn't divide is filled with zeros at its end;
of rows that share an identifier the one with the smaller bytes is the earlier one, null identifiers come last; with fewer rows than ENTRIES the codebooks are as small;
rows that repeat each get a row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 16
LEAF = 8
#: Vectors that are searched at once.
SEARCHED = 4096


class Tree:
    """A kd-tree over the entries of one codebook, with the tight box of each node."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.nodes: list[tuple] = []  # (low, high, axis, cut, left, right) or (low, high, rows)
        self._grow(np.arange(len(entries)))

    def _grow(self, rows: np.ndarray) -> int:
        own = self.entries[rows]
        low, high, k = own.min(axis=0), own.max(axis=0), len(self.nodes)
        self.nodes.append(())
        axis = int(np.argmax(high - low))
        if len(rows) <= LEAF or low[axis] == high[axis]:
            self.nodes[k] = (low, high, rows)  # ascending, so the first of equal distances has the lowest index
            return k
        cut = int(np.sort(own[:, axis])[(len(rows) - 1) // 2])
        if cut == high[axis]:
            cut = int(own[:, axis][own[:, axis] < cut].max())
        left, right = self._grow(rows[own[:, axis] <= cut]), self._grow(rows[own[:, axis] > cut])
        self.nodes[k] = (low, high, axis, cut, left, right)
        return k

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point and its squared distance; of equally near ones the lowest index."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        which = np.zeros(len(points), np.int64)
        self._descend(0, points, np.arange(len(points)), best, which)
        self._search(0, points, np.arange(len(points)), best, which)
        return which, best

    def _leaf(self, rows: np.ndarray, points: np.ndarray, at: np.ndarray, best: np.ndarray, which: np.ndarray) -> None:
        gap = points[at][:, None, :] - self.entries[rows][None, :, :]
        far = np.einsum("ijk,ijk->ij", gap, gap)
        first = far.argmin(axis=1)
        far, entry = far[np.arange(len(at)), first], rows[first]
        better = (far < best[at]) | ((far == best[at]) & (entry < which[at]))
        best[at[better]], which[at[better]] = far[better], entry[better]

    def _descend(self, node: int, points: np.ndarray, at: np.ndarray, best: np.ndarray, which: np.ndarray) -> None:
        if not len(at):
            return
        n = self.nodes[node]
        if len(n) == 3:
            self._leaf(n[2], points, at, best, which)
            return
        near = points[at, n[2]] <= n[3]
        self._descend(n[4], points, at[near], best, which)
        self._descend(n[5], points, at[~near], best, which)

    def _search(self, node: int, points: np.ndarray, at: np.ndarray, best: np.ndarray, which: np.ndarray) -> None:
        n = self.nodes[node]
        own = points[at]
        out = np.maximum(n[0] - own, 0) + np.maximum(own - n[1], 0)
        at = at[np.einsum("ij,ij->i", out, out) <= best[at]]
        if not len(at):
            return
        if len(n) == 3:
            self._leaf(n[2], points, at, best, which)
        else:
            self._search(n[4], points, at, best, which)
            self._search(n[5], points, at, best, which)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(C.column_bytes(column)[1].tobytes(), "<i4").reshape(-1, width)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """vec_id, label, ints (little-endian 32-bit integers), of the rows that are kept."""
    v = F.col("vector")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).filter(sound)

    def work(batches):
        for b in batches:
            n = pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(b.column(2).flatten().to_numpy(zero_copy_only=False) * SCALE).astype("<i4")
            ends = np.cumsum(n)
            body = [np.pad(flat[e - k : e], (0, -k % parts)).tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(body, pa.binary())], ["vec_id", "label", "n", "ints"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(work, f"vec_id {kind('vec_id')}, label {kind('label')}, n long, ints binary")


def assigned(ints: DataFrame, trees, width: int) -> DataFrame:
    """Sums and counts of the vectors' parts by part and entry: part, entry, n, sums."""

    def work(batches):
        own = trees.value
        size = width // len(own)
        sums = [np.zeros((len(t.entries), size), np.int64) for t in own]
        counts = [np.zeros(len(t.entries), np.int64) for t in own]
        for b in batches:
            rows = _matrix(b.column(0), width).astype(np.int64)
            for i in range(0, len(rows), SEARCHED):
                for p, t in enumerate(own):
                    points = np.ascontiguousarray(rows[i : i + SEARCHED, p * size : (p + 1) * size])
                    which, _ = t.nearest(points)
                    np.add.at(sums[p], which, points)
                    counts[p] += np.bincount(which, minlength=len(counts[p]))
        out = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(own)) for e in np.flatnonzero(counts[p]).tolist()]
        parts, entries, n, total = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(entries, pa.int64()), pa.array(n, pa.int64()), pa.array(total, pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = ints.select("ints").mapInArrow(work, "part long, entry long, n long, sums array<long>")
    size = width // len(trees.value)
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(size)))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(rows of vec_id, label, codes (an array of indexes by part), error), and the final codebooks (part, entry, component)."""
    spark = vectors.sparkSession
    stage = C.Stage(spark, "vector-codes")
    rows = stage.table(whole_vectors(vectors, id_col, vector_col, label_col, parts))
    seeds = rows.select("vec_id", "n", "ints").orderBy(F.col("vec_id").asc_nulls_last(), F.hex("ints")).limit(entries).collect()
    if not seeds:
        return rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")).limit(0), np.zeros((parts, 0, 0), np.int64)
    length = seeds[0].n
    rows = rows.filter(F.col("n") == length)
    width = len(seeds[0].ints) // 4
    first = np.array([np.frombuffer(r.ints, "<i4") for r in seeds if r.n == length], np.int64)
    books = [np.ascontiguousarray(x) for x in np.split(first, parts, axis=1)]
    plant = lambda: spark.sparkContext.broadcast([Tree(x) for x in books])
    for _ in range(rounds if width else 0):
        trees = plant()
        for r in assigned(rows, trees, width).collect():
            books[r.part][r.entry] = [r[f"s{k}"] // r.n for k in range(width // parts)]
        trees.unpersist()
    trees = plant()

    def work(batches):
        own = trees.value
        size = width // parts
        for b in batches:
            points = _matrix(b.column(2), width).astype(np.int64) if width else np.zeros((b.num_rows, 0), np.int64)
            codes, error = np.zeros((b.num_rows, parts), np.int32), np.zeros(b.num_rows, np.int64)
            for i in range(0, b.num_rows if width else 0, SEARCHED):
                for p, t in enumerate(own):
                    which, far = t.nearest(np.ascontiguousarray(points[i : i + SEARCHED, p * size : (p + 1) * size]))
                    codes[i : i + SEARCHED, p] = which
                    error[i : i + SEARCHED] += far
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array(error)], ["vec_id", "label", "codes", "error"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    coded = rows.select("vec_id", "label", "ints").mapInArrow(C.tidy(work), f"vec_id {kind('vec_id')}, label {kind('label')}, codes array<int>, error long")
    return stage.table(coded), np.array(books)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(C.documents(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    keyed = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    out = C.join_by_group(keyed, totals, ["_label"], "_n", keyed.count())
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
