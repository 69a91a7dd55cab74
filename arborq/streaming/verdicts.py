"""Verdicts of changing files in keyed state: each file's last verdict, and its baselines, which expire.

Events are (file_id, at, seq, op, snapshot_id, mask, simple, composable, secure, navigable), op one of

* ``evaluate``: the file was evaluated; it is compared with its last verdict, and becomes it,
* ``begin``: its verdict is kept as a baseline under snapshot_id before it is edited,
* ``assess``: its verdict is compared with the baseline of snapshot_id.

The state of a file is its last verdict and a map of baselines, each with an event-time timer: when the watermark passes its time to live the baseline is swept.
So a batch costs what it holds, however many came before it. An assessment without a baseline is told snapshot_not_found, one with a baseline that is too
old but not yet swept snapshot_stale; the changeset of one snapshot_id is the assessments of all files that name it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.lattice import PILLARS
from ..operators.assess import status

#: Fixed value: milliseconds that a baseline lives.
TTL_MS = 24 * 3600 * 1000
SCORES = ", ".join(f"{p} double" for p in PILLARS)
BOTH = ", ".join(f"{side}_{p} double" for side in ("before", "after") for p in PILLARS)
RESULT = f"file_id string, at timestamp, seq long, op string, snapshot_id string, known boolean, blocked_by string, mask_before int, mask_after int, {BOTH}"


class Verdicts(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"mask int, {SCORES}")
        self.kept = handle.getMapState("kept", "snapshot_id string", f"taken_ms long, mask int, {SCORES}")

    def handleInputRows(self, key, rows, timerValues):
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            now = (r.mask, *(r[p] for p in PILLARS))
            at_ms = r.at_ms
            before, blocked = None, None
            if r.op == "evaluate":
                before = self.last.get() if self.last.exists() else None
                self.last.update(now)
            elif r.op == "begin":
                if self.kept.containsKey((r.snapshot_id,)):
                    self.handle.deleteTimer(self.kept.getValue((r.snapshot_id,))[0] + self.ttl_ms)
                self.kept.updateValue((r.snapshot_id,), (at_ms, *now))
                self.handle.registerTimer(at_ms + self.ttl_ms)
            else:
                held = self.kept.getValue((r.snapshot_id,)) if self.kept.containsKey((r.snapshot_id,)) else None
                blocked = "snapshot_not_found" if held is None else "snapshot_stale" if at_ms - held[0] > self.ttl_ms else None
                before = held[1:] if held is not None and blocked is None else None
            empty = (None,) * (1 + len(PILLARS))
            was = tuple(before) if before is not None else empty
            values = {"before_" + p: was[1 + i] for i, p in enumerate(PILLARS)} | {"after_" + p: now[1 + i] for i, p in enumerate(PILLARS)}
            yield Row(file_id=key[0], at=r.at, seq=r.seq, op=r.op, snapshot_id=r.snapshot_id, known=before is not None, blocked_by=blocked, mask_before=was[0], mask_after=now[0], **values)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Sweeps the baselines whose time has passed; several of one time go at once."""
        limit = expiredTimerInfo.getExpiryTimeInMs() - self.ttl_ms
        for name in [k for k, v in self.kept.iterator() if v[0] <= limit]:
            self.kept.removeKey(name)
        return iter(())

    def close(self) -> None:
        pass


def track(events: DataFrame, lateness: str = "1 hour", ttl_ms: int = TTL_MS) -> DataFrame:
    """One row an event of a stream: RESULT's columns. Needs the RocksDB state store (see ``state_store``)."""
    own = events.withColumn("file_id", F.col("file_id").cast("string")).withColumn("at_ms", F.unix_millis("at")).withWatermark("at", lateness)
    return own.groupBy("file_id").transformWithState(Verdicts(ttl_ms), RESULT, "Append", "EventTime")


def state_store(spark) -> None:
    """Sets the state store that keyed state needs; for the session that starts the query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def assessed(tracked: DataFrame) -> DataFrame:
    """Rows of ``track`` with status, as ``assess.status`` gives it: null for a begin, for a first evaluation, and where blocked_by says why."""
    zero = F.lit(0.0)
    deltas = tracked.withColumns({f"d_{p}": F.round(100 * (F.coalesce(f"after_{p}", zero) - F.coalesce(f"before_{p}", zero)), 1) for p in PILLARS})
    out = status(deltas.withColumn("mask_before", F.coalesce("mask_before", F.lit(0))).withColumn("mask_after", F.coalesce("mask_after", F.lit(0))))
    return out.withColumn("status", F.when(F.col("known"), F.col("status")))


def changesets(found: DataFrame) -> DataFrame:
    """(snapshot_id, files, blocked, regressions, status) of assessments (``assessed``): a changeset is blocked by any of its files, else as good as its worst."""
    own = found.filter("op = 'assess'").groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("blocked_by").isNotNull()).alias("blocked"), F.count_if(F.col("status").isin("regression", "score_down")).alias("regressions"), F.count_if(F.col("status").isin("improvement", "score_up")).alias("gains")
    )
    said = F.when(F.col("blocked") > 0, "blocked").when(F.col("regressions") > 0, "regression").when(F.col("gains") > 0, "improvement").otherwise("lateral")
    return own.withColumn("status", said).drop("gains")
