"""Benchmark passages in documents by Wu-Manber search over words.

A window is ``WINDOW`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Windows of equal
length form a class with its own tables:

* shifts: the last BLOCK words before a position are hashed; the table has the distance by which the search may move on, which is the
  whole length of a window less BLOCK - 1 where no window has that block. A text without shared blocks is read at every ninth word only;
* buckets: windows that end with the block, sorted by the hash of their first block within a bucket;
* what a bucket selects is compared word by word.

Positions are moved in step for all documents of an Arrow batch, so the search has no per-word Python. The tables of one block of items
are broadcast, at most BLOCK_BYTES of item text in expectation (items are dealt to blocks by hash). Larger benchmarks take one pass over the documents for each
block; each pass then yields the hit ranges of the documents, which are merged by document.

Results for odd inputs: a null or wordless text has no words and no hits; a null or wordless item has no window; items that share an
identifier are one item, and a null identifier counts as the empty string; rows that repeat each get a row; documents of any length are
searched whole; empty tables give no hits or no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, BLOCK = 10, 2
#: Bytes of item text whose tables are broadcast at once; the tables take about ten times as much.
BLOCK_BYTES = 4 << 20
#: Bytes of documents whose words are held at once.
TEXT_BYTES = 2 << 20
_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_STEP, _BACK = 0x100000001B3, pow(0x100000001B3, -1, 1 << 64)

#: A-Z lower-cased, bytes of no word to 0x20: digits, a-z and all bytes from 0x80 make words.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[48:58], _LETTERS[97:123], _LETTERS[128:] = range(48, 58), range(97, 123), range(128, 256)
_LETTERS[65:91] = range(97, 123)
_VALUES = (np.arange(1, 257, dtype=np.uint64) * _ODD) ^ (np.arange(256, dtype=np.uint64) << np.uint64(7))
_powers: dict[str, np.ndarray] = {}


def _power(step: int, n: int, name: str) -> np.ndarray:
    """step ** 0, 1, ..., n - 1 modulo 2 ** 64, kept for the next call."""
    have = _powers.get(name, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.r_[have, have * np.uint64(pow(step, len(have), 1 << 64))]
    _powers[name] = have
    return have[:n]


class Words:
    """The words of texts that lie one behind the other in ``data``: byte ranges, hashes, and the first word of each text."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.raw = _LETTERS[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = self.raw != 32
        starts = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        heads = offsets[:-1][np.diff(offsets) > 0]
        starts[heads] |= inside[1:-1][heads]  # a word never reaches over the end of a text
        ends[heads[1:] - 1] |= inside[1:-1][heads[1:] - 1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[self.raw] * _power(_STEP, len(data), "up"), out=total[1:])
        h = (total[self.ends] - total[self.starts]) * _power(_BACK, len(data) + 1, "down")[self.starts]
        self.hashes = (h ^ (h >> np.uint64(29))) * _ODD

    def blocks(self, at: np.ndarray, words: int) -> np.ndarray:
        """The hash of the words that end with those at the positions."""
        h = self.hashes[at - (words - 1)].copy()
        for k in range(words - 2, -1, -1):
            h = h * _MIX + self.hashes[at - k]
        return h

    def text(self, first: int, last: int) -> bytes:
        return b" ".join(self.raw[self.starts[first] : self.ends[last]].tobytes().split())


class Patterns:
    """Shift table and buckets of windows of ``size`` words each."""

    def __init__(self, words: Words, lasts: np.ndarray, owners: np.ndarray, size: int):
        """lasts: positions of the windows' last words; owners: the items they belong to, by number."""
        self.size, self.block = size, min(BLOCK, size)
        self.skip = size - self.block + 1
        self.shift = np.full(1 << _BITS, self.skip, np.uint8)
        for back in range(self.skip - 1, -1, -1):  # a block nearer to the end is the last to write
            self.shift[self._slot(words.blocks(lasts - back, self.block))] = back
        # equal windows once: the bucket's entry leads to all items that have it
        by_text: dict[bytes, tuple[int, set]] = {}
        for last, owner in zip(lasts.tolist(), owners.tolist(), strict=True):
            by_text.setdefault(words.text(last - size + 1, last), (last, set()))[1].add(owner)
        at = np.array([last for last, _ in by_text.values()], np.int64)
        suffix, prefix = words.blocks(at, self.block), words.blocks(at - (size - self.block), self.block)
        keys = self._key(suffix, prefix)
        order = np.argsort(keys, kind="stable")
        texts, owned = list(by_text), [sorted(own) for _, own in by_text.values()]
        self.keys, self.texts, self.owners = keys[order], [texts[i] for i in order], [owned[i] for i in order]

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * _ODD) >> np.uint64(64 - _BITS)

    @staticmethod
    def _key(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Buckets by the suffix's upper half, ordered by the prefix within."""
        return (suffix & np.uint64(0xFFFFFFFF00000000)) | (prefix >> np.uint64(32))

    def ends(self, words: Words) -> np.ndarray:
        """Positions of words at which the shift table allows a window to end."""
        n = np.diff(words.first)
        steps = np.maximum(0, (n - self.size) // self.skip + 1)
        steps[n < self.size] = 0
        text = np.repeat(np.arange(len(n)), steps)
        within = np.arange(len(text)) - np.repeat(np.cumsum(steps) - steps, steps)
        at = words.first[:-1][text] + self.size - 1 + within * self.skip
        until = np.minimum(at + self.skip, words.first[1:][text])
        found = []
        while len(at):
            shift = self.shift[self._slot(words.blocks(at, self.block))]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            still = at < until
            at, until = at[still], until[still]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def occurrences(self, words: Words) -> list[tuple[int, int]]:
        """(position of the last word, number of the window) of each occurrence."""
        at = self.ends(words)
        if not len(at):
            return []
        keys = self._key(words.blocks(at, self.block), words.blocks(at - (self.size - self.block), self.block))
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = []
        for k in np.flatnonzero(high > low).tolist():
            text = words.text(int(at[k]) - self.size + 1, int(at[k]))
            out += [(int(at[k]), w) for w in range(low[k], high[k]) if self.texts[w] == text]
        return out


class Searcher:
    """The tables of one block of items: (identifier as text, item text)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        bodies = [(t or "").encode() for _, t in items]
        self.names = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        words = Words(np.cumsum([0, *map(len, bodies)]), np.frombuffer(b"".join(bodies), np.uint8))
        parts = defaultdict(list)
        for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            if b > a:
                size = min(window, b - a)
                parts[size].append((np.arange(a + size - 1, b), number[items[k][0]]))
        self.classes = [
            Patterns(words, np.concatenate([x for x, _ in own]), np.concatenate([np.full(len(x), o) for x, o in own]), size) for size, own in sorted(parts.items())
        ]

    def search(self, offsets: np.ndarray, data: np.ndarray):
        """Number of words of each text; per text with hits, its hit ranges of words (from its start) and its items."""
        words = Words(offsets, data)
        ranges, items = defaultdict(list), defaultdict(set)
        for c in self.classes:
            found = c.occurrences(words)
            text = np.searchsorted(words.first, [at for at, _ in found], "right") - 1
            for (at, w), t in zip(found, text.tolist(), strict=True):
                last = at - int(words.first[t])
                own = ranges[t]
                if own and own[-1][0] <= last - c.size + 1 <= own[-1][1] + 1:
                    own[-1] = (own[-1][0], max(own[-1][1], last))
                else:
                    own.append((last - c.size + 1, last))
                items[t].update(c.owners[w])
        return np.diff(words.first), ranges, items


def covered(ranges: list[tuple[int, int]]) -> int:
    """Words in the union of ranges."""
    total, at = 0, -1
    for a, b in sorted(ranges):
        total += max(0, b - max(a, at + 1) + 1)
        at = max(at, b)
    return total


def _passes(docs: DataFrame, searcher, all_rows: bool) -> DataFrame:
    """doc_id, text_hash, n_words, ranges, items of each text, or of those with hits only."""

    def work(batches):
        s = searcher.value
        for b in batches:
            whole, data = C.column_bytes(b.column(2))
            for i, j in C.windows(whole, TEXT_BYTES):
                n, ranges, items = s.search(whole[i : j + 1] - whole[i], data[whole[i] : whole[j]])
                rows = range(j - i) if all_rows else sorted(ranges)
                take = pa.array([i + t for t in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array([int(n[t]) for t in rows], pa.int64()),
                     pa.array([[x for r in ranges.get(t, ()) for x in r] for t in rows], pa.list_(pa.int64())),
                     pa.array([[s.names[k] for k in sorted(items.get(t, ()))] for t in rows], pa.list_(pa.string()))],
                    ["doc_id", "text_hash", "n_words", "ranges", "items"],
                )

    return docs.mapInArrow(C.tidy(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_words long, ranges array<long>, items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, ranges (first and last word of each hit stretch, from 0), items (identifiers as text, sorted)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    rows = C.id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = []
    for k in range(n_blocks):
        own = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == k)
        tables = spark.sparkContext.broadcast(Searcher([(r.item, r.text) for r in own.collect()], window))
        found.append(_passes(rows, tables, all_rows=k == 0))
    if n_blocks == 1:
        return found[0].drop("text_hash")
    stage = C.Stage(spark, "decontaminate")
    # rows with one identifier and text have equal results: they are one group, repeated as often as the first pass met them
    every = stage.table(found[0].withColumn("copies", F.lit(1)))
    for x in found[1:]:
        every = every.unionByName(stage.table(x.dropDuplicates(["doc_id", "text_hash", "n_words"]).withColumn("copies", F.lit(0))))
    merged = every.groupBy("doc_id", "text_hash", "n_words").agg(F.collect_set("ranges").alias("ranges"), F.collect_set("items").alias("items"), F.sum("copies").alias("copies"))
    merged = merged.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return merged.select("doc_id", "n_words", F.flatten("ranges").alias("ranges"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(C.documents(spark, sf_dir), C.documents(spark, sf_dir, "benchmark"))

    def work(batches):
        for b in batches:
            pairs = [list(zip(x[::2], x[1::2], strict=True)) for x in b.column(2).to_pylist()]
            items = b.column(3).to_pylist()
            hit = [covered(p) for p in pairs]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                 pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]), pa.array([h > 0 for h in hit])],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return found.mapInArrow(work, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
