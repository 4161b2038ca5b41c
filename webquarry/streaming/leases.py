"""Stale locks released by event time: a keyed state with timers.

Tasks send events (id, status, at). A task that is ``running`` holds a lock from then on; if
nothing is heard of it for ``V.LOCK_SECONDS``, the lock is released and the task is pending again.
A new ``running`` event renews the lock.

The state of a task is its events that could still matter. Each sets a timer at the end of the
time that its lock would have; when the watermark passes it, no earlier event can come any more, so
the order in which events arrive doesn't matter. The timer also removes the event, so a task's
state is gone one lock's time after its last event.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webquarry import fixed_values as V

RELEASES = "id long, status string, was_locked_at timestamp"
#: The state store that keyed states with timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def _at(micros: int) -> datetime:
    return _EPOCH + timedelta(microseconds=micros)


class Leases(StatefulProcessor):
    """Events of one task: time in microseconds -> whether the task runs."""

    def __init__(self, seconds: int) -> None:
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "at long", "running boolean")

    def _due(self, at: int) -> int:
        # A lock is stale when it is older than its time, not as old; timers have milliseconds.
        return (at + self.micros) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        for row in rows:
            at = (row.micros,)
            # Of events of one moment any that ends the lock counts.
            running = row.running and (not self.events.containsKey(at) or self.events.getValue(at)[0])
            self.events.updateValue(at, (running,))
            self.handle.registerTimer(self._due(row.micros))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        events = sorted((at[0], value[0]) for at, value in self.events.iterator())
        for k, (at, running) in enumerate(events):
            if self._due(at) > now:
                break
            self.events.removeKey((at,))
            if running and (k + 1 == len(events) or events[k + 1][0] > at + self.micros):
                yield Row(id=key[0], status="pending", was_locked_at=_at(at))

    def close(self) -> None:
        pass


def released(events: DataFrame, late: str = "10 minutes", seconds: int = V.LOCK_SECONDS) -> DataFrame:
    """Releases (``RELEASES``) of a stream of task events (id, status, at); events later than the watermark are dropped.

    The session needs the settings ``STORE``.
    """
    rows = events.where("id IS NOT NULL AND at IS NOT NULL AND status IS NOT NULL").withWatermark("at", late)
    rows = rows.select("id", "at", F.unix_micros("at").alias("micros"), (F.col("status") == "running").alias("running"))
    return rows.groupBy("id").transformWithState(statefulProcessor=Leases(seconds), outputStructType=RELEASES, outputMode="append", timeMode="EventTime")


def released_until(events: DataFrame, as_of, seconds: int = V.LOCK_SECONDS) -> DataFrame:  # noqa: ANN001
    """The same of a table of events: all releases of locks that were stale at ``as_of``."""
    moments = events.where("id IS NOT NULL AND at IS NOT NULL AND status IS NOT NULL").groupBy("id", "at").agg(F.bool_and(F.col("status") == "running").alias("running"))
    later = F.lead("at").over(Window.partitionBy("id").orderBy("at"))
    end = F.col("at") + F.expr(f"INTERVAL '{seconds}' SECOND")
    rows = moments.withColumn("later", later).where(F.col("running") & (F.col("later").isNull() | (F.col("later") > end)) & (end < F.lit(as_of).cast("timestamp")))
    return rows.select("id", F.lit("pending").alias("status"), F.col("at").alias("was_locked_at"))
