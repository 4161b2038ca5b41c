"""What to do with search results as they arrive, one choice a host.

A host whose result has contacts in its text is extracted from that text and not crawled; of
several such results the first counts, and without one the host's first result is crawled. Results
of one search come in any order and some come late, so a host is held for ``hold`` from its first
result on. When the watermark has passed that, no result of that time is missing and one choice is
made among them; results of the ``rest`` after it are suppressed. All is decided by event time, so
the order of arrival doesn't matter. The state of a host is its results of the time that is held.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webquarry.operators import crawl

CHOICES = "host string, action string, seq long, url string"


class FirstOfHost(StatefulProcessor):
    """One host: its results by time and number, when a choice is due, and until when it rests."""

    def __init__(self, hold_ms: int, rest_ms: int) -> None:
        self.hold, self.rest = hold_ms, rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.results = handle.getMapState("results", "ms long, seq long", "url string, hit boolean")
        self.due = handle.getValueState("due", "ms long")
        self.resting = handle.getValueState("resting", "until long")

    def _set_due(self, first: int) -> None:
        if self.due.exists():
            if self.due.get()[0] <= first + self.hold:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.due.update((first + self.hold,))
        self.handle.registerTimer(first + self.hold)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        until = self.resting.get()[0] if self.resting.exists() else None
        for row in rows:
            if until is None or row.ms >= until:
                self.results.updateValue((row.ms, row.seq), (row.url, row.hit))
                if until is None:
                    self._set_due(row.ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        if self.resting.exists():
            self.resting.clear()
            left = [at[0] for at, _ in self.results.iterator()]
            if left:
                self._set_due(min(left))
            return
        due = self.due.get()[0]
        self.due.clear()
        held = [(at, value) for at, value in self.results.iterator() if at[0] < due + self.rest]
        for at, _ in held:
            self.results.removeKey(at)
        self.resting.update((due + self.rest,))
        self.handle.registerTimer(due + self.rest)
        missed, seq, url = min((not value[1], at[1], value[0]) for at, value in held if at[0] < due)
        yield Row(host=key[0], action="crawl" if missed else "extract", seq=seq, url=url)

    def close(self) -> None:
        pass


def _prepared(results: DataFrame) -> DataFrame:
    rows = results.where("host <> '' AND seq IS NOT NULL AND at IS NOT NULL")
    return rows.select("host", F.col("seq").cast("long").alias("seq"), F.coalesce("url", F.lit("")).alias("url"), "at", crawl.has_snippet_contacts().alias("hit"))


def arriving(results: DataFrame, late: str = "10 minutes", hold_seconds: int = 600, rest_seconds: int = 86_400) -> DataFrame:
    """Choices (``CHOICES``) of a stream of results (host, seq, url, title, snippet, at). The session needs ``leases.STORE``."""
    rows = _prepared(results).withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return rows.groupBy("host").transformWithState(statefulProcessor=FirstOfHost(1000 * hold_seconds, 1000 * rest_seconds), outputStructType=CHOICES, outputMode="append", timeMode="EventTime")


def chosen(results: DataFrame) -> DataFrame:
    """The same of a table of results of one search: one choice a host."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("hit"), "seq"))
    rows = _prepared(results).withColumn("_n", rank).where("_n = 1")
    return rows.select("host", F.when(F.col("hit"), "extract").otherwise("crawl").alias("action"), "seq", "url")
