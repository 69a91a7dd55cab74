"""Toxicity by compression distance: two zstandard dictionaries, window lengths, calibrated thresholds.

The ordinary dictionary is trained by zstandard on ordinary texts. The toxic dictionary is the same content behind the
fragments that toxic texts repeat in many contexts and ordinary texts do not; the ordinary one has as many zero
bytes there, so the two differ in nothing else. Every text is cut at white space into short windows, twice with
the cuts half a window apart, and each window is compressed with both. How many windows the toxic dictionary makes
shorter by 1, 2, ... bytes is weighed by ridge regression on held-out folds and turned into a probability by an
isotonic curve: that calibrates the thresholds.

Dictionaries and calibration see a bounded sample of the labelled rows (``dictionary_docs`` a class, ``fit_rows``);
everything else sees whole texts of all rows.

Results for odd inputs: null text is the empty text, without windows, and is scored like any other; without toxic or
without ordinary labels every score is the share of toxic labels (0 without labels); repeated rows are scored alike; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .labelled import FIT_ROWS, Isotonic, training_labels

WINDOW = 48
LEVEL = 3
DICTIONARY_DOCS = 1500
BASE_BYTES = 32 << 10
FRAGMENT_BYTES = 3 << 10
GRAM, CONTEXT = 6, 4
#: A fragment's n-grams have contexts in at least this share of the toxic texts, this many times as often as in ordinary ones.
LEAST_SHARE, LEAST_RATIO = 0.035, 20
STEPS = 8


def cut(text: bytes, first: int, size: int = WINDOW) -> list[bytes]:
    """Windows of at most ``size`` bytes, ended at a blank where the second half has one; the first is ``first`` long at most."""
    out, i, n, step = [], 0, len(text), first
    while i < n:
        j = i + step
        if j < n:
            at = text.rfind(b" ", i + step // 2, j)
            j = at if at > i else j
        out.append(text[i:j])
        i, step = j, size
    return out


def _spelled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts; at each byte the number that the next GRAM bytes spell; a hash of it with the CONTEXT bytes before."""
    data = np.frombuffer((b" " * 8).join([b"", *texts, b""]), np.uint8)
    n = len(data) - GRAM - CONTEXT + 1
    code, before = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(GRAM):
        code = (code << np.uint64(8)) | data[CONTEXT + k : CONTEXT + k + n]
    for k in range(CONTEXT):
        before = (before << np.uint64(8)) | data[k : k + n]
    return data, code, (before * np.uint64(0x9E3779B97F4A7C15)) ^ (code * np.uint64(0xC2B2AE3D27D4EB4F))


def _contexts(texts: list[bytes], slices: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts, each with the number of distinct contexts it stands in (so copies count once)."""
    _, code, pair = _spelled(texts)
    found = []
    for s in range(slices):  # by slices of the n-grams, for memory
        own = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(slices) == s
        part = code[own]
        found.append(np.unique(part[np.unique(pair[own], return_index=True)[1]], return_counts=True))
    grams, n = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(grams)
    return grams[order], n[order]


def fragments(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """What toxic texts repeat and ordinary ones do not, the commonest last (nearest to the window)."""
    grams, n = _contexts(toxic)
    known, m = _contexts(ordinary)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    usual = np.where(known[at] == grams, m[at], 0)
    ratio = (n / sum(map(len, toxic))) / ((usual + 0.5) / sum(map(len, ordinary)))
    chosen = grams[(n >= max(4, LEAST_SHARE * len(toxic))) & (ratio >= LEAST_RATIO)]
    if not len(chosen):
        return b""
    data, code, _ = _spelled(toxic)
    place = np.flatnonzero(chosen[np.minimum(np.searchsorted(chosen, code), len(chosen) - 1)] == code) + CONTEXT
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + GRAM, -1)
    edge = np.flatnonzero(np.diff(np.r_[0, np.cumsum(change[:-1]) > 0, 0]))
    spans = Counter(data[a:b].tobytes() for a, b in zip(edge[::2], edge[1::2], strict=True))
    kept, seen, size = [], set(), 0
    for s, _ in sorted(spans.items(), key=lambda x: (-x[1], x[0])):
        own = {s[k : k + GRAM] for k in range(len(s) - GRAM + 1)}
        if own - seen and size + len(s) <= FRAGMENT_BYTES:
            kept.append(s)
            seen |= own
            size += len(s)
    return b"".join(reversed(kept))


class Model:
    """Both dictionaries, the weights of the window counts and the calibration."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.dictionaries = dictionaries
        self.weights, self.curve = None, None

    @staticmethod
    def train(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
        parts = [w for t in ordinary for w in cut(t, 256, 256)]
        try:
            base = zstandard.train_dictionary(BASE_BYTES, parts, k=16, d=6).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself
            base = b"".join(ordinary)[-BASE_BYTES:]
        special = fragments(toxic, ordinary)
        return special + base, bytes(len(special)) + base

    def compressors(self):
        out = []
        for content in self.dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return out


def _features(diffs: np.ndarray) -> np.ndarray:
    """Of one text: how many windows are shorter by 1, 2, ... bytes, the two largest gains, the number of windows."""
    if not len(diffs):
        return np.zeros(STEPS + 3)
    counts = np.log1p((diffs[:, None] >= np.arange(1, STEPS + 1)).sum(axis=0))
    top = np.sort(diffs)[-2:]
    return np.r_[counts, max(top[-1], 0), max(top.sum(), 0), np.log1p(len(diffs))]


def window_features(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f (features of all windows of the whole text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        toxic, ordinary = held.value.compressors()
        for b in batches:
            offsets, data = C.column_bytes(b.column(1))
            raw = data.tobytes().lower()
            rows = []
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = raw[i:j]
                parts = cut(text, WINDOW) + (cut(text, WINDOW // 2) if len(text) > WINDOW // 2 else [])
                long = np.fromiter(map(len, map(ordinary, parts)), np.int64, len(parts))
                rows.append(_features(long - np.fromiter(map(len, map(toxic, parts)), np.int64, len(parts))).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "f"])

    rows = C.id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(C.tidy(work), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, f array<double>")


def dictionaries(docs: DataFrame, labels: DataFrame, dictionary_docs: int = DICTIONARY_DOCS) -> Model | None:
    """Trained on up to ``dictionary_docs`` toxic and twice as many ordinary texts, in expectation, of fold 0, chosen by hash."""
    n = {r["y"]: r["count"] for r in labels.filter("fold = 0").groupBy("y").count().collect()}
    if not n.get(0.0) or not n.get(1.0):
        return None
    share = F.when(F.col("y") == 1, min(1.0, dictionary_docs / n[1.0])).otherwise(min(1.0, 2 * dictionary_docs / n[0.0]))
    chosen = labels.filter((F.col("fold") == 0) & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) <= share * (1 << 20)))
    # 3 * dictionary_docs identifiers are expected at any size: small enough to broadcast, so no other text moves
    rows = C.id_and_text(docs).join(F.broadcast(chosen), "doc_id").select(F.xxhash64("text").alias("h"), "y", "text")

    def train(table: pa.Table) -> pa.Table:  # the bounded sample in one task, off the driver
        table = table.sort_by([("h", "ascending"), ("text", "ascending")])
        texts: dict[float, dict[bytes, None]] = {0.0: {}, 1.0: {}}
        for y, t in zip(table.column("y").to_pylist(), table.column("text").to_pylist(), strict=True):
            texts[y].setdefault(t.encode().lower())
        toxic, ordinary = ([t for t in texts[y] if t] for y in (1.0, 0.0))
        found = [Model.train(toxic, ordinary)] if toxic and ordinary else []
        return pa.table([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["toxic", "ordinary"])

    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(train, "toxic binary, ordinary binary").collect()
    return Model((bytes(found[0][0]), bytes(found[0][1]))) if found else None


def classify(docs: DataFrame, labels: DataFrame, target: str = "toxic", fit_rows: int = FIT_ROWS, dictionary_docs: int = DICTIONARY_DOCS) -> DataFrame:
    """doc_id, score, predicted; learned from labels with crc32(doc_id) mod 5 other than 0."""
    spark = docs.sparkSession
    stage = C.Stage(spark, "toxicity")
    train = stage.table(training_labels(labels, target, 5, 0, fit_rows))
    model = dictionaries(docs, train, dictionary_docs)
    if model is None:
        share = train.agg(F.avg("y")).first()[0] or 0.0
        out = docs.select("doc_id", F.lit(float(share)).alias("score"))
        return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    features = stage.table(window_features(docs, model))
    # fold 1 never entered the dictionaries; its halves cross-validate the weights
    known = features.join(train.filter("fold = 1"), "doc_id").select("f", "y", F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(2)).alias("half")).toPandas()
    size = STEPS + 4
    solve = lambda x, y: np.linalg.solve(x.T @ x + np.diag([1e-6] + [1.0] * (size - 1)), x.T @ y)
    x = np.column_stack([np.ones(len(known)), np.stack(known["f"]) if len(known) else np.zeros((0, size - 1))])
    y, half = known["y"].to_numpy(float), known["half"].to_numpy()
    crossed = np.zeros(len(y))
    for h in (0, 1):
        crossed[half == h] = x[half == h] @ solve(x[half != h], y[half != h])
    model.weights, model.curve = solve(x, y), Isotonic(crossed, y)
    held = spark.sparkContext.broadcast(model)

    def work(batches):
        m = held.value
        for b in batches:
            f = b.column(1).flatten().to_numpy().reshape(b.num_rows, size - 1)
            s = m.curve(np.column_stack([np.ones(len(f)), f]) @ m.weights)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(s, 0, 1))], ["doc_id", "score"])

    out = features.mapInArrow(C.tidy(work), f"doc_id {features.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(C.documents(spark, sf_dir), C.documents(spark, sf_dir, "labels"))
    return out.select("doc_id", C.remainder(5).eqNullSafe(0).alias("held_out"), "score", "predicted")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: all rows of an identifier one of whose rows is rejected, null identifiers being one.

    All others stay with all their columns; null and empty texts are scored like any other; an empty table stays empty.
    """
    rejected = classify(docs, C.documents(spark, sf_dir, "labels")).filter("predicted = 1").select("doc_id").distinct()
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["doc_id"]), "left_anti")
