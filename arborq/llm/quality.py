"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

A document's statistics are counts of its bytes by class, word and line lengths, byte entropy and its compressed
share, over the whole text. cos(Wx + b) with Gaussian W approximates a Gaussian kernel over the standardised
statistics. Tasks sum their part of the normal equations of two folds of the labelled rows; the ridge weights of one fold
score the other, these scores choose the penalty and fit the isotonic curve, and the weights of both folds together
score all documents.

Results for odd inputs: null text is the empty text and is scored like any other; without labelled rows every
score is 0.5; repeated label rows count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .labelled import FIT_ROWS, Isotonic, training_labels

WINDOW = 2 << 20
SYMBOLS = b".,;:!?|%$&*#@_-/\\<>()[]{}=+'\"~^`"
FEATURES = 256
PENALTIES = (1e-2, 1e-1, 1.0, 10.0)


def statistics(raw: bytes, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    which = np.repeat(np.arange(n) * 256, size) + data
    count = np.bincount(which, minlength=n * 256).reshape(n, 256).astype(float)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    start = ~blank
    start[1:] &= blank[:-1]
    first = (offsets[:-1] - offsets[0])[size > 0]
    start[first] = ~blank[first]
    words = C.segment_sums(start, offsets - offsets[0])
    length = np.maximum(size, 1).astype(float)
    p = count / length[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    zip_ = zstandard.ZstdCompressor(level=1)
    packed = np.fromiter((len(zip_.compress(raw[i:j])) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), float, n)
    lines = count[:, 10] + 1
    share = lambda lo, hi: count[:, lo:hi].sum(axis=1) / length
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), np.log1p(size / lines), (size - count[:, 32]) / np.maximum(words, 1), entropy, np.minimum(packed / length, 2),
        np.log1p(packed), share(97, 123), share(65, 91), share(48, 58), share(128, 256), count[:, 32] / length, count[:, 10] / length, share(0, 32), *(p[:, list(SYMBOLS)].T),
    ])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, stats of each row's whole text."""

    def work(batches):
        for b in batches:
            offsets, data = C.column_bytes(b.column(1))
            raw = data.tobytes()
            parts = [statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in C.windows(offsets, WINDOW)]
            if parts:
                flat = np.concatenate(parts)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), values], ["doc_id", "stats"])

    rows = C.id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(C.tidy(work), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, stats array<double>")


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, len(SYMBOLS) + 15))


class Model:
    """Scores of statistics; plain arrays, a few hundred KB."""

    def __init__(self, mean, scale, features: int = FEATURES, seed: int = 1):
        rng, d = np.random.default_rng(seed), len(mean)
        self.mean, self.scale = mean, scale
        self.w, self.b = rng.normal(0, 1 / np.sqrt(d), (d, features)), rng.uniform(0, 2 * np.pi, features)
        self.weights, self.curve = np.zeros(features + 1), Isotonic(np.zeros(0), np.zeros(0))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.curve(self.features(stats) @ self.weights), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES) -> Model | None:
    """``stats``: doc_id, stats; ``labels``: doc_id, y, fold (a bounded sample). None without labelled rows."""
    spark = stats.sparkSession
    stage = C.Stage(spark, "quality-fit")
    joined = stage.table(stats.join(labels, "doc_id").select("stats", "y", "fold"))
    rows = joined.coalesce(16)

    def moments(batches):
        for b in batches:
            m = _matrix(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([float(len(m))]), pa.array([m.sum(axis=0).tolist()]), pa.array([(m * m).sum(axis=0).tolist()])], ["n", "s", "q"])

    sums = rows.mapInArrow(moments, "n double, s array<double>, q array<double>").filter("n > 0").toPandas()
    n = sums["n"].sum()
    if not n:
        return None
    mean = np.sum(np.stack(sums["s"]), axis=0) / n
    scale = np.sqrt(np.maximum(np.sum(np.stack(sums["q"]), axis=0) / n - mean**2, 0)) + 1e-6
    model = Model(mean, scale, features)
    size = features + 1

    def equations(batches):
        total = np.zeros((2, size, size + 1))
        for b in batches:
            x, y, fold = model.features(_matrix(b.column(0))), b.column(1).to_numpy(), b.column(2).to_numpy()
            for f in (0, 1):
                own = fold == f
                total[f, :, :size] += x[own].T @ x[own]
                total[f, :, size] += x[own].T @ y[own]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    total = np.zeros((2, size, size + 1))
    for row in rows.mapInArrow(equations, "part binary").toLocalIterator():
        total += np.frombuffer(row[0]).reshape(total.shape)

    def solve(t, penalty):
        ridge = penalty * np.eye(size)
        ridge[0, 0] = 1e-6
        return np.linalg.solve(t[:, :size] + ridge, t[:, size])

    other = {p: (solve(total[1], p), solve(total[0], p)) for p in PENALTIES}  # by the fold that is scored

    def held_scores(batches):
        for b in batches:
            x, fold = model.features(_matrix(b.column(0))), b.column(2).to_numpy()
            s = np.column_stack([np.where(fold == 0, x @ other[p][0], x @ other[p][1]) for p in PENALTIES])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s.tolist(), pa.list_(pa.float64()))], ["y", "s"])

    held = rows.mapInArrow(held_scores, "y double, s array<double>").toPandas()
    s, y = np.stack(held["s"]), held["y"].to_numpy()
    best = int(np.argmin(((s - y[:, None]) ** 2).mean(axis=0)))
    model.weights = solve(total[0] + total[1], PENALTIES[best])
    model.curve = Isotonic(s[:, best], y)
    stage.drop(joined)
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted."""
    kind = f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double"
    if model is None:
        out = stats.select("doc_id", F.lit(0.5).alias("score"))
    else:
        held = stats.sparkSession.sparkContext.broadcast(model)

        def work(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.score(_matrix(b.column(1))))], ["doc_id", "score"])

        out = stats.select("doc_id", "stats").mapInArrow(C.tidy(work), kind)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score, predicted of each row; learned from labels with crc32(doc_id) mod 3 other than 1."""
    stage = C.Stage(docs.sparkSession, "quality")
    stats = stage.table(document_statistics(docs))
    return score(stats, fit(stats, training_labels(labels, target, 3, 1, fit_rows)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(C.documents(spark, sf_dir), C.documents(spark, sf_dir, "labels"))
    return out.select("doc_id", C.remainder(3).eqNullSafe(1).alias("held_out"), "score", "predicted")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: all rows of an identifier one of whose rows is rejected, null identifiers being one.

    All others stay with all their columns; null and empty texts are scored like any other; an empty table stays empty.
    """
    rejected = classify(docs, C.documents(spark, sf_dir, "labels")).filter("predicted = 0").select("doc_id").distinct()
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["doc_id"]), "left_anti")
