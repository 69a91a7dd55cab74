"""Shared pieces of the training-data operators: staged tables, Arrow text access, hot-key joins.

Conventions used by every operator of this subpackage
-----------------------------------------------------
* A null text counts as the empty text. A null identifier is an ordinary value that equals only null.
* Operators select the columns they name before they work, or give working columns free names, so further columns, whatever they are
  called, never clash with working columns.
* Rows that repeat are scored or grouped like any other row; nothing is dropped, capped or sampled.
* Intermediate results that are used twice are written as Parquet below ``spark.checkpoint.dir``
  (readable from every executor, so a lost executor costs no lineage). Those that only later steps read are removed after them; those that
  the result reads stay, as the result is lazy.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets an own temporary
    folder; on a cluster that is an error, as executors would write to their own disks."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="arborq-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return "file://" + _own_dirs[app]


#: Rows of one Arrow batch at most: with long texts a batch of the default 10,000 rows takes tens of MB in each process.
BATCH_ROWS = 2000


def tidy(work):
    """A function of Arrow batches that gives memory back to the system when its partition ends: workers live on for other stages."""

    def run(batches):
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # only the GNU library has it
            pass

    return run


class Stage:
    """Staged tables of one operator call; ``drop`` removes those that later steps do not read.

    Sets the session's rows of an Arrow batch to BATCH_ROWS.
    """

    def __init__(self, spark: SparkSession, name: str):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._staged_path)
            path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def remainder(n: int, id_col: str = "doc_id"):
    """crc32 of the identifier as text, modulo n; null for a null identifier."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column's (Spark ignores case)."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n = "_" + n
        out.append(n)
    return out


#: A Bloom filter has this many bits for each value, within these bounds (32 MiB): it can be broadcast. A fuller one lets more values pass,
#: and what passes is compared exactly.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
_PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _places(values: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte and bit of each value under each of the filter's hash functions."""
    for odd in _PROBES:
        at = (values.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - (size.bit_length() - 1))
        yield (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)


def filter_bits(df: DataFrame, column: str) -> np.ndarray:
    """The filter of a long column, gathered as one OR of a few partitions."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * max(1, df.count()) - 1).bit_length()))

    def work(batches):
        bits = np.zeros(size >> 3, np.uint8)
        for b in batches:
            for byte, bit in _places(b.column(0).to_numpy(), size):
                np.bitwise_or.at(bits, byte, np.uint8(1) << bit)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    total = np.zeros(size >> 3, np.uint8)
    for row in df.select(column).coalesce(2).mapInArrow(work, "bits binary").toLocalIterator():
        total |= np.frombuffer(row[0], np.uint8)
    return total


def maybe_in(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the filter has each value's bits."""
    out = np.ones(len(values), bool)
    for byte, bit in _places(values, len(bits) * 8):
        out &= ((bits[byte] >> bit) & 1).astype(bool)
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n+1, from 0) and bytes of a string or binary column without nulls, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]


def windows(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, of one row at least: bounds temporaries, cuts no text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments; empty segments give 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0, dtype=np.float64)
    return out


#: A key is hot when it holds more than one part in HOT_PARTS of the rows, so there are at most
#: HOT_PARTS hot keys at any size and broadcasting them is bounded.
HOT_PARTS = 1000


def join_by_group(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with one row per key of ``groups``; hot keys by a broadcast of at most HOT_PARTS rows.

    A key that is no hot key has at most total / HOT_PARTS rows, so no task of the shuffled part gets more for it. That part is joined by
    hash, which sorts neither side: a task holds one row for each of its keys.
    """
    hot = groups.filter(F.col(size_col) * HOT_PARTS > total)
    cold = groups.filter(F.col(size_col) * HOT_PARTS <= total)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    values = [c for c in groups.columns if c not in keys]
    in_hot = marked.filter(F.col("_hot")).drop("_hot")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot", *values).join(cold.hint("shuffle_hash"), keys, how)
    return in_hot.unionByName(rest)
