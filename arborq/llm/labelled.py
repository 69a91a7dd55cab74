"""Labelled rows for classifiers: a bounded, deterministic sample, and isotonic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows a classifier is fitted on, in expectation at most.
FIT_ROWS = 100_000


def training_labels(labels: DataFrame, target: str, modulus: int, excluded: int, fit_rows: int = FIT_ROWS, id_col: str = "doc_id") -> DataFrame:
    """doc_id, y, fold (0 or 1) of the labels that may be learned from.

    Rows with crc32(doc_id) mod ``modulus`` = ``excluded`` or without a label never enter. Of the others all stay while they
    number ``fit_rows`` or fewer; beyond that each stays by a hash of its identifier, so that ``fit_rows`` are expected.
    """
    rows = labels.filter(F.col(target).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(target).cast("double").alias("y"))
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != excluded)
    share = min(1.0, fit_rows / max(1, rows.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))
    return rows.filter(place < F.lit(int(share * (1 << 20)))).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(2)).cast("int"))


class Isotonic:
    """The least-squares non-decreasing fit of labels to scores, by pooling adjacent violators."""

    def __init__(self, scores: np.ndarray, labels: np.ndarray):
        self.x, self.y = np.zeros(1), np.full(1, 0.5)
        if not len(scores):
            return
        order = np.argsort(scores, kind="stable")
        xs, at = np.unique(scores[order], return_index=True)
        weight = np.diff(np.r_[at, len(scores)]).astype(float)
        total = np.add.reduceat(labels[order].astype(float), at)
        blocks: list[list[float]] = []  # sum of labels, weight, sum of weighted scores
        for t, w, x in zip(total.tolist(), weight.tolist(), xs.tolist(), strict=True):
            blocks.append([t, w, w * x])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.y = np.array([b[0] / b[1] for b in blocks])

    def __call__(self, scores: np.ndarray) -> np.ndarray:
        """Between the means of the pooled blocks by a straight line; a last share of 0.001 keeps the scores' own order."""
        rank = 0.5 + np.arctan(scores - np.median(self.x)) / np.pi
        return 0.999 * np.interp(scores, self.x, self.y) + 0.001 * rank
