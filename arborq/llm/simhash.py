"""Near-duplicate classes of SimHash fingerprints by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most two bits agree in
the second segment, or differ in at most one bit of the first. So the table of first segments is probed with
the Hamming ball of radius one, and the table of second segments with the exact value; every pair that a
table returns has its complete distance checked. One-bit probes only set bits, as the other fingerprint of
a pair would clear the same one.

A bucket of more than ``bucket`` fingerprints returns no pairs. Fingerprints that probe it enumerate the rest of
their ball of radius two (at most 528 values) against the table of whole fingerprints instead, which is exact
too, so the work for a fingerprint is bounded whatever the size of its bucket, and no link is lost.

Results for odd inputs: a null text is the empty text, whose fingerprint is zero; zero links like any other
value; rows that repeat each get a row; the component of rows whose identifiers are all null is null; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

BUCKET = 512
_LOW = (1 << 32) - 1


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Bit j is 1 where over half of the shingles' XXH64 values have it; 0 without words."""
    w = text.lower().split()  # of bytes: lower-cases A-Z, splits at 09-0D and 20
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.r_[0, ends[:-words] + 1].tolist()
    parts = map(joined.__getitem__, map(slice, starts, ends[words - 1 :].tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(starts))
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        block = h[i : i + (1 << 16)]
        total += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row's whole text."""

    def work(batches):
        for b in batches:
            offsets, data = C.column_bytes(b.column(1))
            raw = data.tobytes()
            fp = np.fromiter((fingerprint(raw[i:j], words, seed) for i, j in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = C.id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(C.tidy(work), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _masks(bits: range, sizes: tuple[int, ...]) -> list[int]:
    """Words with as many bits set as ``sizes`` allows, as signed longs."""
    out = [sum(1 << b for b in c) for k in sizes for c in combinations(bits, k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _longs(values: list[int]):
    return F.expr("array(" + ",".join(f"{v}L" if v != -(1 << 63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v): all pairs of distinct values of ``fps.fp`` that differ in one or two bits, some of them twice."""
    f = fps.select("fp", F.shiftrightunsigned("fp", 32).alias("s1"), F.col("fp").bitwiseAND(F.lit(_LOW)).alias("s2"))

    def tables(seg: str) -> DataFrame:
        large = f.groupBy(seg).count().filter(F.col("count") > bucket).select(F.col(seg).alias("key"))
        small = f.select(F.col(seg).alias("key"), F.col("fp").alias("other")).join(large, "key", "left_anti")
        return small.unionByName(large.withColumn("other", F.lit(None).cast("long")))

    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    flip = lambda masks, keep=None: F.explode(F.transform(F.filter(_longs(masks), keep) if keep else _longs(masks), lambda m: F.col("fp").bitwiseXOR(m)))

    ball = F.filter(_longs([1 << j for j in range(32)]), lambda m: F.col("s1").bitwiseAND(m) == 0)
    probes = f.select("fp", "s1", F.explode(F.concat(F.array("s1"), F.transform(ball, lambda m: F.col("s1").bitwiseOR(m)))).alias("key"))
    one = probes.join(tables("s1"), "key")
    same = F.col("key") == F.col("s1")
    near_one = one.filter(F.col("other").isNotNull() & (~same | (F.col("other") > F.col("fp"))) & (distance <= 2)).select("fp", "other")
    step = F.shiftleft(F.col("key").bitwiseXOR(F.col("s1")), 32)  # the bit of the first segment that the probe has set
    whole_same = one.filter(F.col("other").isNull() & same).select("fp", flip(_masks(range(32), (1, 2))).alias("other")).filter("other > fp")
    whole_one = one.filter(F.col("other").isNull() & ~same).select("fp", F.explode(F.transform(_longs([0, *_masks(range(32), (1,))]), lambda m: F.col("fp").bitwiseXOR(step).bitwiseXOR(m))).alias("other"))

    two = f.select("fp", "s1", F.col("s2").alias("key")).join(tables("s2"), "key")
    apart = F.bit_count(F.col("s1").bitwiseXOR(F.shiftrightunsigned("other", 32))) == 2
    near_two = two.filter(F.col("other").isNotNull() & (F.col("other") > F.col("fp")) & apart).select("fp", "other")
    whole_two = two.filter(F.col("other").isNull()).select("fp", flip(_masks(range(32, 64), (2,))).alias("other")).filter("other > fp")

    whole = whole_same.unionByName(whole_one).unionByName(whole_two).join(f.select(F.col("fp").alias("other")), "other", "left_semi")
    found = near_one.unionByName(near_two).unionByName(whole.select("fp", "other"))
    return found.select(F.col("fp").alias("u"), F.col("other").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest doc_id that links of two bits or fewer reach)."""
    stage = C.Stage(docs.sparkSession, "simhash")
    rows = stage.table(fingerprints(docs, id_col, text_col, words, seed))
    fps = stage.table(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    labels = components(links(fps, bucket), stage)
    nodes = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    nodes = stage.table(nodes)
    linked = nodes.filter("label != fp").select("label").distinct()
    # fingerprints that stand alone need no further grouping
    least = nodes.join(linked, "label", "left_semi").groupBy("label").agg(F.min("first").alias("component_id"))
    classes = stage.table(nodes.join(least, "label", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")))
    return C.join_by_group(rows, classes, ["fp"], "n", rows.count()).select("doc_id", "fp", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The stage's contract: words of a shingle, least similarity. BANDS of ROWS minima each miss a pair of that similarity once in 300,000.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 4
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    parts = (b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys; two sets share one with probability 1 - (1 - J ** ROWS) ** BANDS."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 10):
        h = hashes[i : i + (1 << 10), None] * _FACTORS
        np.minimum(least, (h ^ (h >> np.uint64(29))).min(axis=0), out=least)
    return np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))), np.uint64, BANDS)


def jaccard_at_least(a: bytes, b: bytes, similarity: float = SIMILARITY) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= similarity * (len(x) + len(y) - common)


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, component_id (the smallest doc_id that links of Jaccard SIMILARITY or more reach).

    Equal sets are one node. Candidates are the sets whose SimHash fingerprints of the same shingles multi-index hashing links, and, as most pairs of that similarity differ in more bits
    than it reaches, those that share a band. All candidates are compared exactly. Of the sets with one fingerprint the smallest node stands for the others; a band that many different sets share is compared pair by pair.
    Null and empty texts and those without words have the empty set, and are one class; rows that repeat each get a row; a null identifier is larger than any other;
    an empty table gives no rows.
    """
    stage = C.Stage(docs.sparkSession, "similar")
    rows = C.id_and_text(docs, id_col, text_col)

    def work(batches):
        for b in batches:
            offsets, data = C.column_bytes(b.column(1))
            raw = data.tobytes()
            for i, j in C.windows(offsets, 4 << 20):
                sets = [shingles(raw[x:y]) for x, y in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                bodies = [x.tobytes() for x in sets]
                node = np.fromiter(map(xxhash.xxh64_intdigest, bodies), np.uint64, len(sets)).view(np.int64)
                keys = [bands(x).view(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets]
                fp = np.fromiter((fingerprint(raw[x:y], WORDS) for x, y in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)), np.uint64, len(sets)).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(node), pa.array(bodies, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(fp)], ["doc_id", "node", "body", "keys", "fp"])

    all_rows = stage.table(rows.mapInArrow(C.tidy(work), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node long, body binary, keys array<long>, fp long"))
    nodes = stage.table(all_rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    keyed = all_rows.select("node", F.explode("keys").alias("key")).distinct()
    shared = keyed.groupBy("key").count().filter("count > 1").select("key")
    keyed = stage.table(keyed.join(shared, "key", "left_semi"))
    pairs = keyed.withColumnRenamed("node", "u").join(keyed.withColumnRenamed("node", "v"), "key").filter("u < v").select("u", "v")
    marked = stage.table(all_rows.select("fp", "node").distinct())
    prints = stage.table(marked.groupBy("fp").agg(F.min("node").alias("head")))
    alone = marked.join(prints, "fp").filter("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    linked = links(prints.select("fp")).join(prints.select(F.col("fp").alias("u"), F.col("head").alias("x")), "u").join(prints.select(F.col("fp").alias("v"), F.col("head").alias("y")), "v")
    linked = linked.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    pairs = stage.table(pairs.unionByName(alone).unionByName(linked).distinct())
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    # of a node's rows only those of its smallest identifier move, so a large group of copies is no hot key
    chosen = wanted.join(nodes.select("node", "first"), "node").select(F.col("node").alias("_node"), "first")
    mine = (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("first"))
    bodies = stage.table(all_rows.select("node", "doc_id", "body").join(chosen, mine).select("node", "body").dropDuplicates(["node"]))
    alike = F.udf(jaccard_at_least, "boolean", useArrow=True)
    both = pairs.join(bodies.select(F.col("node").alias("u"), F.col("body").alias("a")), "u").join(bodies.select(F.col("node").alias("v"), F.col("body").alias("b")), "v")
    labels = components(both.filter(alike("a", "b")).select("u", "v"), stage)
    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = stage.table(labelled.join(least, "label").select("node", "n", "component_id"))
    out = C.join_by_group(all_rows.select("doc_id", "node"), classes, ["node"], "n", max(1, all_rows.count()))
    return out.select("doc_id", "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents with similar sets of five-word shingles the one with the smallest identifier stays.

    Rows that share that identifier all stay. Texts without words are one class. An empty table stays empty.
    """
    keep = similar_classes(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
