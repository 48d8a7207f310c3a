"""Alerts with state over a live log (L2, L5, L6): each opens, is raised and closes once, and late events correct it until then.

A key's events that follow within a gap are one alert. Its state is a row: first and last event, their number, and the times of
the first few, which say when it was raised. An event that comes late joins, extends or merges alerts that are open. Keys share
buckets by their hash: a bucket's open alerts are read and written together and have one timer, since each call to the state store
costs as much as many rows. A timer closes alerts when the watermark says that no event can join them any more; then their state
goes. So the closed alerts are those of a batch query over the events that were not later than the watermark allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Buckets of keys. A micro-batch rewrites the open alerts of the buckets that it has events for; a task holds those of one.
BUCKETS = 4_096

_STATE = "first long, last long, n long, head array<long>, told boolean"
_OUT = "kind string, opened long, raised long, last long, n long"


def joined(bursts: list[tuple], t: int, gap: int, least: int) -> tuple[list[tuple], list[tuple]]:
    """Open alerts ``(first, last, n, head, told)`` of a key with an event at ``t`` -> the alerts then, and those that were raised and are now part of another."""
    near = [b for b in bursts if b[0] - gap <= t <= b[1] + gap]
    head = sorted([t, *[x for b in near for x in b[3]]])[:least]
    told = [b for b in near if b[4]]
    one = (min([t, *[b[0] for b in near]]), max([t, *[b[1] for b in near]]), 1 + sum(b[2] for b in near), head, bool(told))
    return [b for b in bursts if b not in near] + [one], told[1:]


class Alerts(StatefulProcessor):
    """The state of one bucket of keys: their open alerts. Times are microseconds."""

    def __init__(self, gap: int, least: int, kind: str) -> None:
        self.gap, self.least, self.kind = gap, least, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("open", f"key {self.kind}, {_STATE}")

    def _due(self, burst: tuple) -> int:
        """The watermark, in milliseconds, that closes an alert."""
        return -(-(burst[1] + self.gap) // 1000)

    def _next(self, bursts: dict) -> int | None:
        """The first watermark that closes an alert of the bucket: its timer."""
        return min((self._due(b) for of_key in bursts.values() for b in of_key), default=None)

    def _row(self, key, kind: str, b: tuple) -> Row:
        raised = b[3][self.least - 1] if len(b[3]) == self.least else None
        return Row(key=key, kind=kind, opened=b[0], raised=raised, last=b[1], n=b[2])

    def _bursts(self) -> dict:
        """Open alerts of each key."""
        found: dict = {}
        for key, first, last, n, head, told in self.open.get():
            found.setdefault(key, []).append((first, last, n, list(head), told))
        return found

    def _keep(self, bursts: dict) -> None:
        rows = [(key, *b) for key, of_key in bursts.items() for b in of_key]
        if rows:
            self.open.put(rows)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        bursts = self._bursts()
        before = self._next(bursts)
        for r in rows:
            k = r["key"]
            of_key, swallowed = joined(bursts.get(k, []), r["_us"], self.gap, self.least)
            yield from [self._row(k, "merged", b) for b in swallowed]
            new = of_key[-1]
            if new[2] >= self.least and not new[4]:
                of_key[-1] = (*new[:4], True)
                yield self._row(k, "raised", new)
            bursts[k] = of_key
        after = self._next(bursts)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)
        self._keep(bursts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, bursts, left = timerValues.getCurrentWatermarkInMs(), self._bursts(), {}
        for k, of_key in bursts.items():
            yield from [self._row(k, "closed", b) for b in of_key if self._due(b) <= now and b[2] >= self.least]
            if open_yet := [b for b in of_key if self._due(b) > now]:
                left[k] = open_yet
        if left:
            self.handle.registerTimer(self._next(left))
        self._keep(left)

    def close(self) -> None:
        pass


def alerts(events: DataFrame, key: str, gap_seconds: int, least: int, critical: int, late: str = "1 hour", when: str = "event_type = 'error'", buckets: int = BUCKETS) -> DataFrame:
    """``key, kind, opened, raised, last, n, level`` of a stream with a column ``ts``.

    kind is ``raised`` once when an alert has ``least`` events, and at its end ``closed``, with the final times and number, or
    ``merged`` where a late event made it part of another that was raised. All events move the watermark, those that meet
    ``when`` count. Events without a time are left out; those later than ``late`` are dropped by the watermark. A checkpoint
    goes with its number of ``buckets``; more of them where batches are small and very many alerts are open.
    """
    # A plain filter would be pushed below the watermark, which then would see only what counts: this one depends on the time.
    us = F.when(F.expr(when), F.unix_micros("ts")).alias("_us")
    bucket, kind = F.pmod(F.hash(key), F.lit(buckets)).alias("bucket"), dict(events.dtypes)[key]
    e = events.where("ts IS NOT NULL").withWatermark("ts", late).select(bucket, F.col(key).alias("key"), "ts", us).where("_us IS NOT NULL")
    made = e.groupBy("bucket").transformWithState(Alerts(gap_seconds * 1_000_000, least, kind), f"key {kind}, {_OUT}", "Append", "EventTime")
    times = [F.timestamp_micros(c).alias(c) for c in ("opened", "raised", "last")]
    return made.select(F.col("key").alias(key), "kind", *times, "n", F.when(F.col("n") >= critical, "critical").otherwise("warning").alias("level"))


def run_alerts(found: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """All that is there now into a Parquet folder; state with timers needs the RocksDB store, which is set for this query alone."""
    spark, name = found.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    return q
