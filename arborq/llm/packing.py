"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Documents are tokenised once. What fills a whole sequence becomes one; the rest of each document, shorter than a sequence,
is packed: only the histogram of these lengths (one count a length) comes to the driver, where lengths are placed
longest first, each into the packs that are shortest so far, by moving counts between packing patterns. A document's
rest then finds its place by its rank among the rests of equal length. Every pack is a sequence of its own.

Ranks come from counts by length and hash bucket, so no task ranks all rests of one length.

Results for odd inputs: null text is the empty text, whose only token is the closing one; rows that repeat are packed
like any other; no row is dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

LENGTH = 1024
#: Rests that one task ranks together, about.
RANKED = 4000
_loaded: dict = {}


def byte_bpe(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...]):
    """The encoder of a byte-level BPE from its published ranks; one for each Python worker."""
    key = (ranks_path, pattern, special)
    if key not in _loaded:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[key] = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))
    return _loaded[key]


def default_tokenizer() -> dict:
    import public_tokenizers

    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "special": (("<|endoftext|>", 50256),)}


def tokenised(docs: DataFrame, tokenizer: dict, length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: part and row (its place), doc_id, tokens, the CRC-32 of each full sequence, and of the rest: length, CRC-32."""

    def work(batches):
        from pyspark import TaskContext

        encode = byte_bpe(**tokenizer).encode
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            tokens, full, rest, crc = [], [], [], []
            for text in b.column(1):
                a = np.array([*encode(text.as_py(), allowed_special="all"), end_id], "<u4")
                cut = len(a) // length * length
                tokens.append(len(a))
                full.append([zlib.crc32(a[i : i + length]) for i in range(0, cut, length)])
                rest.append(len(a) - cut)
                crc.append(zlib.crc32(a[cut:]))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), b.column(0), pa.array(tokens, pa.int64()),
                pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.int32()), pa.array(crc, pa.int64()),
            ], ["part", "row", "doc_id", "doc_tokens", "full", "rest", "rest_crc"])
            row += n

    rows = C.id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(C.tidy(work), f"part int, row long, doc_id {kind}, doc_tokens long, full array<long>, rest int, rest_crc long")


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and how many packs have each; every length of the histogram is used as often as it counts."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by total length
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        grown = []  # a pack takes a length once before the next shortest is looked for
        while left:
            total = min((t for t, packs in open_.items() if packs and t + size <= length), default=None)
            if total is None:
                grown.append((size, ((size,), left)))
                break
            pattern, count = open_[total].pop()
            take = min(left, count)
            if count > take:
                open_[total].append((pattern, count - take))
            open_[total + size].append(((*pattern, size), take))
            left -= take
        for t, pack in grown:
            fits = length // t  # new packs of one length take it as often as shortest-first would
            pattern, count = pack
            whole, over = divmod(count, fits)
            if whole:
                open_[t * fits].append((pattern * fits, whole))
            if over:
                open_[t * over].append((pattern * over, 1))
    return [p for t in sorted(open_) for p in open_[t]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, int]:
    """Rows (key, first rank, first sequence, offset) by length and rank, and how many sequences there are.

    The rest of length l and rank r lies in sequence first + r - first rank, at the offset.
    """
    rank: dict[int, int] = defaultdict(int)
    rows, at = [], 0
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            rows.append(((size << 40) | rank[size], rank[size], at, offset))
            rank[size] += count
            offset += size
        at += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4), at


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = 0, tokenizer: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    stage = C.Stage(spark, "packing")
    rows = stage.table(tokenised(docs, tokenizer or default_tokenizer(), length, end_id, id_col, text_col))
    rests = rows.filter("rest > 0").select("part", "row", "doc_id", "doc_tokens", "rest", "rest_crc")
    histogram = {r["rest"]: r["count"] for r in rests.groupBy("rest").count().collect()}  # less than ``length`` rows
    table, packed = places(shortest_pack_first(histogram, length))
    buckets = max(1, sum(histogram.values()) // RANKED)
    rests = rests.withColumn("bucket", F.pmod(F.xxhash64("part", "row"), F.lit(buckets)))
    before = rests.groupBy("rest", "bucket").count()
    before = before.select("rest", "bucket", (F.sum("count").over(W.partitionBy("rest").orderBy("bucket")) - F.col("count")).alias("before"))
    local = F.row_number().over(W.partitionBy("rest", "bucket").orderBy("part", "row")) - 1
    ranked = rests.withColumn("local", local).join(before, ["rest", "bucket"]).withColumn("rank", F.col("before") + F.col("local"))
    held = spark.sparkContext.broadcast(table)

    def locate(batches):
        keys = held.value[:, 0]
        for b in batches:
            size, rank = b.column(2).to_numpy().astype(np.int64), b.column(4).to_numpy()
            _, first, base, offset = held.value[np.searchsorted(keys, (size << 40) | rank, "right") - 1].T
            start = pa.array(b.column(1).to_numpy() - size)
            yield pa.RecordBatch.from_arrays([b.column(0), start, pa.array(size), b.column(3), b.column(1), pa.array(base + rank - first), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    packs = ranked.select("doc_id", "doc_tokens", "rest", "rest_crc", "rank").mapInArrow(locate, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    blocks = rows.filter(F.size("full") > 0).select("part", "row", "doc_id", "doc_tokens", "full")
    earlier = blocks.groupBy("part").agg(F.sum(F.size("full")).alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row a task of the first pass
    within = F.sum(F.size("full")).over(W.partitionBy("part").orderBy("row")) - F.size("full")
    full = blocks.withColumn("within", within).join(earlier, "part").select("doc_id", "doc_tokens", (F.lit(packed) + F.col("before") + F.col("within")).alias("base"), F.posexplode("full").alias("i", "crc"))
    full = full.select("doc_id", (F.col("i") * length).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("base") + F.col("i")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packs.unionByName(full)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each packed piece of each document.

    A null or empty text is one piece of the end token alone; rows that repeat are packed each on their own; columns other than identifier and text are not read; an empty
    table gives no pieces.
    """
    return pack(docs)
