"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to ``order`` bytes, learned from all training texts. Under its frozen
counts a byte costs -log2 n/(t+q) bits in the longest context that has seen it (n of the context's t bytes, q
distinct ones); each longer context of the tree that has not seen it costs an escape, -log2 q/(t+q) bits, and a byte
never seen costs 8 bits more. The language with the shortest code for the whole text is predicted; the score is its
share when the languages are weighted by 2 to the power of minus their code lengths.

A tree keeps every n-gram of its language's texts, however rare, so the code lengths are exact. The bytes before a text's start count as zeros.

Results for odd inputs: a text that is null or has no letter is ``und`` with score 0; without training rows every
text is ``und``; ties go to the name that sorts first; rows that repeat are scored alike; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .bytetrie import WINDOW, ContextCosts, Trie, count_grams, levels

UNDETERMINED = "und"
#: Contexts have up to so many bytes: a language's tree then has at most 2 ** 24 leaves at any input size, so all counts are kept.
ORDER = 2


class Ppm(ContextCosts):
    """Code lengths of texts under several languages' frozen context trees."""

    def __init__(self, trees: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        self.names = sorted(trees)
        size = len(next(iter(trees.values())))
        self.trie = Trie([np.unique(np.concatenate([trees[g][k][0] for g in self.names])) for k in range(size)])
        self.cost, self.escape = [], []  # by order: bits of the node's byte after its context; bits of an escape from the context
        for k in range(size):
            codes = self.trie.codes[k]
            count = np.zeros((len(codes), len(self.names)))
            for j, g in enumerate(self.names):
                own, n = trees[g][k]
                count[np.searchsorted(codes, own), j] = n
            above = 1 if k == 0 else len(self.trie.codes[k - 1]) + 1
            context = np.zeros(len(codes), np.int64) if k == 0 else self.trie.node(k - 1, codes >> np.uint64(8))
            total, kinds = np.zeros((above, len(self.names))), np.zeros((above, len(self.names)))
            np.add.at(total, context, count)
            np.add.at(kinds, context, count > 0)
            whole = np.log2(np.maximum(total + kinds, 1))
            escape = np.where(kinds > 0, whole - np.log2(np.maximum(kinds, 1)), 0)
            shorter = 8.0 if k == 0 else self.cost[k - 1][self.trie.suffix(k, codes)]
            found = whole[context] - np.log2(np.maximum(count, 1))
            cost = np.where(count > 0, found, escape[context] + shorter)
            missing = escape[:1] + 8.0 if k == 0 else np.zeros((1, len(self.names)))
            self.cost.append(np.concatenate([missing, cost]))
            self.escape.append(escape)


def train(docs: DataFrame, order: int = ORDER, lang_col: str = "lang", text_col: str = "text") -> Ppm | None:
    """The frozen model of all rows of ``docs`` with a language; None without such rows."""
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("grp"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    stage = C.Stage(docs.sparkSession, "ppm")
    counts = stage.table(count_grams(rows, order + 1))
    trees = levels(counts, order + 1)
    stage.drop(counts)
    return Ppm(trees) if trees else None


def identify(docs: DataFrame, model: Ppm | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, bits (the shortest code length of the text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("letters"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, bits double"
    if model is None:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    tables = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        ppm = tables.value
        names = np.array([*ppm.names, UNDETERMINED], object)
        for b in batches:
            offsets, data = C.column_bytes(b.column(1))
            raw = data.tobytes()
            bits = np.zeros((b.num_rows, len(ppm.names)))
            for i, j in C.windows(offsets, WINDOW):
                bits[i:j] = ppm.bits(raw, offsets[i : j + 1])
            letters = b.column(2).to_numpy(zero_copy_only=False)
            best = bits.argmin(axis=1)
            least = bits.min(axis=1)
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            best[~letters] = len(ppm.names)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best], pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(least)], ["doc_id", "lang_pred", "score", "bits"])

    return rows.mapInArrow(C.tidy(work), kind)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    held = F.coalesce(C.remainder(5) == 0, F.lit(False))
    model = train(docs.filter(~held))
    return identify(docs, model).select("doc_id", C.remainder(5).eqNullSafe(0).alias("held_out"), "lang_pred", "score", "bits")
