"""Session windows over out-of-order clicks, kept in keyed state and closed by event-time timers.

Clicks are cut into batches by their arrival and fed to one streaming query, which is started anew for each batch on one checkpoint.
Its state, by client, is a map from the start of each open session to its end, counts and merges, with one event-time timer per session. A batch's clicks join,
extend or bridge sessions: a bridge deletes the absorbed entries and their timers and registers the merged session. Timers that the
watermark has passed close their sessions.

* Two clicks of a client within one slot of GAP microseconds always share a session. So each task first sums its clicks by client and slot, and sends one row a client with all its
  sums. Batches are written by client and day, so the state operator gets about a row for each client and day: a client with a third of all clicks sends as many sums as its slots,
  however many clicks they hold, and no task gets all of them.
* Spark's watermark is in milliseconds and drops rows that equal it; the rule is in microseconds and keeps them. Rows are therefore dropped by a filter with
  the exact bound, and the state operator does not see the event time. A timer only says that a session can be closed, and its batch is found from the exact bounds.
* The last start carries a row without a client and with a far time, whose watermark fires all timers that are left.
* A session that the bound of its own batch closes is given out at once: its timer would be due when it is registered. Sessions that a batch leaves open, about those of its
  last two days, are kept with a timer each. Registering all of them takes 3,400 CPU seconds a GB, nearly all in Python's calls to the state server.
* Rows to and from the state operator, and its values, are packed, as Python takes and gives every cell of a row on its own.
* State stores are closed at the end of each task: every start is a run of its own, and the local files of the runs before would stay open.
* Timers fire in the next batch's run (runs without data are off but for the last), which saves a round of tasks and state commits per batch; a session that can be closed can not be met by later
  clicks, which are all behind the bound.

Results for odd inputs: rows without click_id, client_id or ts are left out; of rows that share a click_id the earliest to arrive stays (then the earliest ts, then the
smallest client); a row without arrived_at goes into the last batch; a table without rows gives no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from . import common as C

GAP = 30 * 60 * 1_000_000
DELAY = 48 * 3600 * 1_000_000
BATCHES = 10
HOUR = 3600 * 1_000_000
#: Clicks and sums that a task holds at most before it sums them up, or sends them on.
SLOTS = 200_000

#: What a task sends of a client: rows of first_us, last_us, n, crc as 64-bit integers, and the last time among them.
FRAGMENT = "client_id long, sums binary, event_time timestamp"
SESSION = "client_id long, first_us long, last_us long, n_clicks long, ids_crc32 long, n_merges long, close_batch long"


def micros(column: str, df: DataFrame):
    """Microseconds since 1970 of a time with or without a zone."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))
    return F.unix_micros(F.col(column).cast("timestamp"))


def hours_of(us):
    """Whole hours of microseconds since 1970, rounded down: the quotient of a multiple is exact, that of a time in a far year is not."""
    return ((us - F.pmod(us, F.lit(HOUR))) / HOUR).cast("long")


def clean_clicks(clicks: DataFrame) -> DataFrame:
    """click_id, client_id, us, arrived (microseconds): each click once."""
    rows = clicks.select(F.col("click_id").cast("long").alias("click_id"), micros("arrived_at", clicks).alias("arrived"), micros("ts", clicks).alias("us"), F.col("client_id").cast("long").alias("client_id"))
    rows = rows.filter("click_id is not null and client_id is not null and us is not null")
    # a copy without a time of arrival comes after those with one
    first = F.min(F.struct(F.col("arrived").isNull().alias("late"), "arrived", "us", "client_id")).alias("x")
    return rows.groupBy("click_id").agg(first).select("click_id", "x.arrived", "x.us", "x.client_id")


def batch_of(arrived, us, client, lo: int, hi: int, batches: int):
    """The number of a row's batch, from 0."""
    hour = hours_of(arrived)
    plain = F.floor((hour - lo) * batches / (hi - lo + 1)).cast("int")
    late = F.crc32(F.concat_ws(":", client.cast("string"), hours_of(us).cast("string")).cast("binary")) % 5 == 0
    return F.coalesce(F.least(plain + late.cast("int"), F.lit(batches - 1)), F.lit(batches - 1))


def slot_sums(batches):
    """Sums of clicks by client and slot of GAP, one row a client: of all that a task has read, or of as much as makes SLOTS rows."""
    held: list[np.ndarray] = []
    n = 0

    def fold(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        slot = rows[:, 1] // GAP
        at = np.flatnonzero(np.r_[True, (rows[1:, 0] != rows[:-1, 0]) | (slot[1:] != slot[:-1])])
        return np.column_stack([rows[at, 0], rows[at, 1], np.maximum.reduceat(rows[:, 2], at), np.add.reduceat(rows[:, 3], at), np.add.reduceat(rows[:, 4], at)])

    def record(rows: np.ndarray) -> pa.RecordBatch:
        """One row for each client of rows that are sorted by client."""
        cuts = np.r_[0, np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, len(rows)]
        packed = np.ascontiguousarray(rows[:, 1:5])
        sums = pa.array([packed[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
        at = np.ascontiguousarray(np.maximum.reduceat(rows[:, 2], cuts[:-1]))
        client = pa.array(np.ascontiguousarray(rows[cuts[:-1], 0]), mask=rows[cuts[:-1], 3] == 0)  # the closing row has no client
        return pa.RecordBatch.from_arrays([client, sums, pa.array(at).cast(pa.timestamp("us", tz="UTC"))], ["client_id", "sums", "event_time"])

    for b in batches:
        client = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        us = b.column(1).to_numpy(zero_copy_only=False)
        real = b.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.column_stack([client, us, us, real, b.column(2).to_numpy(zero_copy_only=False)])
        if not real.all():
            yield record(rows[real == 0])
            rows = rows[real == 1]
        held.append(rows)
        n += len(rows)
        if n >= SLOTS:  # many clicks fall together; what does not is sent on
            held = [fold(np.concatenate(held))]
            n = len(held[0])
            if n >= SLOTS // 2:
                yield record(held[0])
                held, n = [], 0
    if n:
        yield record(fold(np.concatenate(held)))


#: A sum of clicks: first, last, clicks, sum of hashes; an open session but for its start; a closed one: first, last, clicks, sum, merges, batch.
PART, VALUE, CLOSED = struct.Struct("<4q"), struct.Struct("<5q"), struct.Struct("<6q")


def unpacked(batches):
    """Closed sessions, one row each."""
    names = ["client_id", "first_us", "last_us", "n_clicks", "ids_crc32", "n_merges", "close_batch"]
    for b in batches:
        offsets, data = C.column_bytes(b.column(1))
        rows = np.frombuffer(data.tobytes(), "<i8").reshape(-1, 6)
        client = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(offsets) // CLOSED.size)
        yield pa.RecordBatch.from_arrays([pa.array(client, pa.int64()), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(6))], names)


class Sessions(StatefulProcessor):
    """Open sessions of a client: start -> (end, clicks, sum, merges, batch of the last change).

    bounds: W of each batch so far, None where there is none; the last run closes what is left as its own batch.
    """

    def __init__(self, bounds: list[int | None], batch: int, last: bool):
        self.bounds, self.batch, self.last = bounds, batch, last

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "first_us long", "packed binary")
        self.done: set = set()  # clients whose sessions this run has closed

    def _deadline(self, last_us: int) -> int:
        return (last_us + GAP) // 1000

    def handleInputRows(self, key, rows, timerValues):
        if key[0] is None:
            return
        new = [(*x, 0, None) for r in rows for x in PART.iter_unpack(r.sums)]
        old = [(k[0], *VALUE.unpack(v[0])) for k, v in self.open.iterator()]
        closed = bytearray()
        group: list[tuple] = []
        for s in [*sorted(new + old, key=lambda s: s[:2]), None]:
            if group and (s is None or s[0] - end > GAP):
                closed += self._joined(group)
                group = []
            if s is not None:
                end = max(end, s[1]) if group else s[1]
                group.append(s)
        if closed:
            yield Row(client_id=key[0], closed=bytes(closed))

    def _joined(self, group: list[tuple]) -> bytes:
        """One session of fragments and of sessions that were open before: kept with its timer, or closed at once where its timer would be due already."""
        old = [s for s in group if s[5] is not None]
        if len(old) == len(group):  # nothing new
            return b""
        first, last = group[0][0], max(s[1] for s in group)
        n, crc, merges = sum(s[2] for s in group), sum(s[3] for s in group), sum(s[4] for s in old) + max(0, len(old) - 1)
        by = self._closed_by(last, self.batch)
        for s in old:
            if s[0] != first or by is not None:
                self.open.removeKey((s[0],))
            if s[1] != last or by is not None:
                self.handle.deleteTimer(self._deadline(s[1]))
        if by is not None:
            return CLOSED.pack(first, last, n, crc, merges, by + 1)
        self.open.updateValue((first,), (VALUE.pack(last, n, crc, merges, self.batch),))
        if all(s[1] != last for s in old):
            self.handle.registerTimer(self._deadline(last))
        return b""

    def _closed_by(self, last_us: int, since: int) -> int | None:
        for b in range(since, len(self.bounds)):
            if self.bounds[b] is not None and last_us + GAP < self.bounds[b]:
                return b
        return len(self.bounds) - 1 if self.last else None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """All of the client's sessions that can be closed go at its first timer; its other timers find nothing left to do."""
        if key[0] in self.done:
            return
        self.done.add(key[0])
        fired = timerValues.getCurrentWatermarkInMs()
        ready = []
        for k, v in self.open.iterator():
            last, n, crc, merges, since = VALUE.unpack(v[0])
            deadline = self._deadline(last)
            by = self._closed_by(last, since)
            if by is not None:
                ready.append((k, CLOSED.pack(k[0], last, n, crc, merges, by + 1), deadline))
            elif deadline <= fired:  # the bound lies within the timer's millisecond
                self.handle.registerTimer(deadline + 1)
        for k, _, deadline in ready:
            self.open.removeKey(k)
            if deadline > fired:
                self.handle.deleteTimer(deadline)
        if ready:
            yield Row(client_id=key[0], closed=b"".join(x for _, x, _ in ready))

    def close(self) -> None:
        pass


_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sessions(clicks: DataFrame, batches: int = BATCHES, delay: int = DELAY) -> DataFrame:
    """The sessions of SESSION's columns, read from what the streaming query has written."""
    spark = clicks.sparkSession
    stage = C.Stage(spark, "sessions")
    rows = stage.table(clean_clicks(clicks))
    lo, hi = rows.select(hours_of(F.col("arrived")).alias("h")).agg(F.min("h"), F.max("h")).first()
    dealt = rows.withColumn("batch", batch_of(F.col("arrived"), F.col("us"), F.col("client_id"), lo or 0, hi or 0, batches))
    root = f"{stage.root}/{uuid.uuid4().hex}"
    # by client and day: a task's sums of a client then hold many clicks, and a client with many has many tasks
    day = F.floor(F.col("us") / (24 * HOUR))
    dealt = dealt.repartition("client_id", day)
    dealt.select("client_id", "us", F.crc32(F.col("click_id").cast("string").cast("binary")).alias("crc"), "batch").write.partitionBy("batch").parquet(f"{root}/batches")
    stage.drop(rows)
    cut = spark.read.schema("client_id long, us long, crc long, batch int").parquet(f"{root}/batches")
    highest = {r.batch: r.us for r in cut.groupBy("batch").agg(F.max("us").alias("us")).collect()}
    bounds, top = [], None
    for b in range(batches):
        top = max((x for x in (top, highest.get(b)) if x is not None), default=None)
        bounds.append(None if top is None else top - delay)

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(conf)
    files.mkdirs(path(f"{root}/fed"))
    was = {k: spark.conf.get(k, None) for k in _CONF}
    try:
        for k, v in _CONF.items():
            spark.conf.set(k, v)
        for b in range(batches):
            if highest.get(b) is not None:
                files.rename(path(f"{root}/batches/batch={b}"), path(f"{root}/fed/b{b}"))
            last = b == batches - 1
            if last:
                spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
                far = (bounds[b] or 0) + 2 * delay + 2 * GAP + 24 * HOUR
                spark.range(1).select(F.lit(None).cast("long").alias("client_id"), F.lit(far).alias("us"), F.lit(0).cast("long").alias("crc")).write.parquet(f"{root}/fed/end")
            _run(spark, root, bounds, b, last, delay)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for name in ("fed", "state", "batches"):
        files.delete(path(f"{root}/{name}"), True)
    return spark.read.schema(SESSION).parquet(f"{root}/closed")


def _run(spark: SparkSession, root: str, bounds: list[int | None], b: int, last: bool, delay: int) -> None:
    """One start of the query: it reads the folders that are new, and ends."""
    fed = spark.readStream.schema("client_id long, us long, crc long").parquet(f"{root}/fed/*")
    kept = fed.filter(F.col("us") >= bounds[b - 1]) if b and bounds[b - 1] is not None else fed
    fragments = kept.mapInArrow(slot_sums, FRAGMENT).withWatermark("event_time", f"{delay} microseconds").select("client_id", "sums")
    packed = fragments.groupBy("client_id").transformWithState(Sessions(bounds[: b + 1], b, last), "client_id long, closed binary", "Append", "EventTime")
    closed = packed.mapInArrow(unpacked, SESSION)
    query = closed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/closed")
    query.awaitTermination()


def op12_session_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(C.documents(spark, sf_dir, "clicks"))
