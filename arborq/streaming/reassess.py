"""Re-evaluating changed files as they arrive: each micro-batch is compared with the stored verdicts and becomes part of them.

Stored verdicts are a table of buckets of files, with a version of a bucket for each batch that touched it. A batch reads the newest version of the buckets that it touches,
writes their next one and deletes those that no run can need again; so it costs what those buckets hold, however many batches came before. ``verdicts`` keeps the same in the state of a
streaming operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.assess import score_deltas, status
from ..operators.module_graph import cut, drop

#: Buckets of files in the stored table.
BUCKETS = 256


def _versions(spark, path: str) -> dict[int, list[int]]:
    """The batches that have written each bucket: names of folders, at most three for a bucket."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    if fs.exists(root):
        glob = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*/batch=*")
        for s in fs.globStatus(glob):
            bucket, batch = (int(x.split("=")[1]) for x in s.getPath().toString().rsplit("/", 2)[1:])
            out.setdefault(bucket, []).append(batch)
    return out


def reassess(changes: DataFrame, evaluate: Callable[[DataFrame], DataFrame], state_path: str, out_path: str, checkpoint: str, once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Writes the status of every changed file against its last verdict.

    ``evaluate`` turns a batch of files into classified rows (file_id, mask and the scores), one a file. A batch that runs again reads the versions before it and overwrites its own
    output. A file that is met for the first time has nothing to compare with and no row.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = cut(evaluate(batch).withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int")))
        touched = [r["bucket"] for r in now.select("bucket").distinct().collect()]  # at most ``buckets``
        held = _versions(spark, state_path)
        newest = {b: max(v for v in held[b] if v < number) for b in touched if any(v < number for v in held.get(b, ()))}
        plain = now.drop("bucket")
        paths = [f"{state_path}/bucket={b}/batch={v}" for b, v in newest.items()]
        before = spark.read.schema(plain.schema).parquet(*paths) if paths else plain.limit(0)
        again = plain.join(before.select("file_id"), "file_id", "left_semi")
        known = before.join(plain.select("file_id"), "file_id", "left_semi")
        status(score_deltas(known, again)).write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        after = plain.unionByName(before.join(plain.select("file_id"), "file_id", "left_anti"))
        after = after.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int")).withColumn("batch", F.lit(number))
        after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(state_path)
        drop(now)
        # a run of this batch again needs the newest version before it, and nothing older
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for b, v in newest.items():
            for old in held[b]:
                if old < v:
                    path = jvm.org.apache.hadoop.fs.Path(f"{state_path}/bucket={b}/batch={old}")
                    path.getFileSystem(conf).delete(path, True)

    writer = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
