"""Exact deduplication through a log-structured merge index of text digests.

Tasks fill bounded memtables with (digest, smallest identifier, count). A full memtable is flushed as a
sorted run, cut into FAN parts of the digest space. Level by level, FAN runs' cells of one part are merged into one run and cut
into FAN narrower parts, until as many parts as memtables are reached; so a level has FAN cells a run, however many runs there are. Every
cell has a filter: the sorted short fingerprints of its digests. The last compaction takes a part's runs, uses the filters to pass by digests
that only one run can hold, merges the rest and keeps the smallest identifier. Documents then look their digest up in the compacted index, and
those that hit another document have their bytes compared with the bytes of the row that stays.

Results for odd inputs: null text is the empty text; texts that differ in white space only are equal; of
equal texts the smallest non-null identifier stays (null when there is none); rows that repeat an identifier
each get a row; an empty table gives an empty result. Identifiers are longs, as runs hold them in eight bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SPACE_RUN = "[\\x20\\x09-\\x0D]+"
ENTRY = "part long, run long, filter binary, entries binary"
ENTRY_TYPE = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("id", "<i8"), ("n", "<i8")])
NO_ID = np.iinfo(np.int64).max
#: Runs that are merged into one, and parts that a run is cut into, at each level.
FAN = 64


def normalised(column):
    return F.regexp_replace(F.coalesce(column, F.lit("")), SPACE_RUN, " ")


def digest_words(sha, bits: int):
    """The leading bits of a hexadecimal SHA-256 as two signed 64-bit words."""
    word = lambda at, n: F.conv(F.rpad(F.substring(sha, at, n), 16, "0"), 16, -10).cast("long")
    hi = word(1, min(16, bits // 4))
    return hi.alias("hi"), (word(17, min(16, (bits - 64) // 4)) if bits > 64 else F.lit(0).cast("long")).alias("lo")


def _merge(entries: np.ndarray) -> np.ndarray:
    """Sorted by digest, one entry a digest: smallest identifier, summed count."""
    if not len(entries):
        return entries
    entries = entries[np.lexsort((entries["lo"], entries["hi"]))]
    new = np.r_[True, (entries["hi"][1:] != entries["hi"][:-1]) | (entries["lo"][1:] != entries["lo"][:-1])]
    at = np.flatnonzero(new)
    out = entries[at].copy()
    out["id"], out["n"] = np.minimum.reduceat(entries["id"], at), np.add.reduceat(entries["n"], at)
    return out


def _fingerprint(entries: np.ndarray) -> np.ndarray:
    return ((entries["hi"] ^ (entries["lo"] << np.uint64(1))) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _parts(entries: np.ndarray, parts: int) -> np.ndarray:
    """The part of the digest space of each entry; of more parts, each lies in one of fewer."""
    return ((entries["hi"] >> np.uint64(32)) & np.uint64(0x7FFFFFFF)) % np.uint64(parts)


def _cells(run: np.ndarray, name: int, parts: int) -> pa.RecordBatch:
    """A sorted run cut into parts, each with its filter."""
    part = _parts(run, parts)
    order = np.argsort(part, kind="stable")  # within a part still sorted by digest
    run, part = run[order], part[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(run)]
    own = [run[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([
        pa.array(part[cuts[:-1]].astype(np.int64)), pa.array([name] * len(own), pa.int64()),
        pa.array([np.unique(_fingerprint(p)).tobytes() for p in own], pa.binary()), pa.array([p.tobytes() for p in own], pa.binary()),
    ], ["part", "run", "filter", "entries"])


def flush_runs(keys: DataFrame, parts: int, memtable_rows: int) -> DataFrame:
    """Sorted runs with filters: one row for each run and part. ``keys`` has hi, lo, doc_id."""

    def work(batches):
        from pyspark import TaskContext

        held, rows, name = [], 0, TaskContext.get().partitionId() << 20
        for b in batches:
            if not b.num_rows:
                continue
            part = np.zeros(b.num_rows, ENTRY_TYPE)
            part["hi"], part["lo"] = (b.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            part["id"], part["n"] = b.column(2).fill_null(NO_ID).to_numpy(), 1
            held.append(part)
            rows += len(part)
            if rows >= memtable_rows:
                yield _cells(_merge(np.concatenate(held)), name, parts)
                held, rows, name = [], 0, name + 1
        if rows:
            yield _cells(_merge(np.concatenate(held)), name, parts)

    return keys.select("hi", "lo", F.col("doc_id").cast("long")).mapInArrow(work, ENTRY)


def merge_level(runs: DataFrame, merged: int, parts: int) -> DataFrame:
    """The runs of one part and one remainder modulo ``merged`` become one run, cut into ``parts`` parts."""

    def work(table: pa.Table) -> pa.Table:
        run = _merge(np.concatenate([np.frombuffer(x.as_py(), ENTRY_TYPE) for x in table.column("entries")]))
        return pa.Table.from_batches([_cells(run, table.column("lane")[0].as_py(), parts)])

    lanes = runs.select("part", F.pmod(F.xxhash64("run"), F.lit(merged)).alias("lane"), "entries")
    return lanes.groupBy("part", "lane").applyInArrow(work, ENTRY)


def compact(runs: DataFrame) -> DataFrame:
    """hi, lo, keep_id, n of the digests that more than one row has; others need no entry to be looked up."""

    def work(table: pa.Table) -> pa.Table:
        prints, counts = np.unique(np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("filter")]), return_counts=True)
        shared = prints[counts > 1]
        hits = []
        for x in table.column("entries"):
            run = np.frombuffer(x.as_py(), ENTRY_TYPE)
            hits.append(run[(run["n"] > 1) | np.isin(_fingerprint(run), shared)])
        out = _merge(np.concatenate(hits))
        out = out[out["n"] > 1]
        keep = pa.array(out["id"].copy(), mask=out["id"] == NO_ID)
        return pa.table([pa.array(out["hi"].view(np.int64).copy()), pa.array(out["lo"].view(np.int64).copy()), keep, pa.array(out["n"].copy())], ["hi", "lo", "keep_id", "n"])

    return runs.select("part", "filter", "entries").groupBy("part").applyInArrow(work, "hi long, lo long, keep_id long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 128, memtable_rows: int = 200_000, fan: int = FAN) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (see the module's text)."""
    spark = docs.sparkSession
    stage = C.Stage(spark, "exact")
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    with_sha = base.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    keys = stage.table(with_sha.select("doc_id", "sha", *digest_words(F.col("sha"), digest_bits)))
    total = keys.count()
    wanted = max(1, -(-total // memtable_rows))
    parts = min(wanted, fan)
    runs = stage.table(flush_runs(keys, parts, memtable_rows))
    while parts < wanted:  # a merged run of one part is as long as a memtable, about
        parts *= fan
        level = stage.table(merge_level(runs, max(1, -(-wanted * fan // parts)), parts))
        stage.drop(runs)
        runs = level
    index = stage.table(compact(runs))
    stage.drop(runs)
    found = stage.table(C.join_by_group(keys, index, ["hi", "lo"], "n", total))
    stage.drop(keys)
    held = spark.sparkContext.broadcast(C.filter_bits(index, "hi"))

    def hits(batches):
        for b in batches:
            hit = C.maybe_in(held.value, b.column(1).to_numpy())
            if hit.any():
                yield b.filter(pa.array(hit))

    # Only possible hits carry their text; a copy in a large group meets one of several salted rows of the text that stays.
    texts = with_sha.select("doc_id", *digest_words(F.col("sha"), digest_bits), "text").mapInArrow(hits, "doc_id long, hi long, lo long, text string")
    index_rows = index.withColumn("salts", F.ceil(F.col("n") / 1000).cast("int"))
    members = C.join_by_group(texts, index_rows, ["hi", "lo"], "n", total, "inner").withColumn("salt", F.pmod(F.xxhash64("doc_id", F.rand(7)), F.col("salts")).cast("int"))
    members = stage.table(members)
    first = members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("hi", "lo", "salts").agg(F.min("text").alias("kept_text"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    compared = members.join(first, ["hi", "lo", "salt"])
    wrong = compared.filter(F.col("text") != F.col("kept_text")).select("hi", "lo").distinct()
    wrong = stage.table(wrong)
    out = found.select("doc_id", "hi", "lo", "sha", F.coalesce("keep_id", F.when(F.col("n").isNull(), F.col("doc_id"))).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"))
    if wrong.count():  # digests that two texts share: these are grouped by the texts themselves
        again = members.join(wrong, ["hi", "lo"], "left_semi")
        exact = again.groupBy("hi", "lo", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        exact = stage.table(exact.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).drop("text"))
        fixed = out.drop("keep_id", "group_size").join(exact, ["hi", "lo", "sha"])
        out = out.join(exact.select("hi", "lo").distinct(), ["hi", "lo"], "left_anti").unionByName(fixed)
    held.unpersist()
    stage.drop(index, members)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(C.documents(spark, sf_dir))


OP1_SQL = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, g.text_sha256 FROM d JOIN g USING (t)
"""
