"""Changes between quality reports as they arrive.

The state of a metric is its newest two values by the time of their files. Each report that
changes them emits the newest value against the one before, also if a file arrives late. The
last row of each metric is what ``metrics.newest_delta`` says of all reports so far.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REPORT = "with_contacts_rate double, zero_page_rate_in_run double, failures double"
#: Metrics and whether more of them is better.
SIGNS = {"with_contacts_rate": 1, "zero_page_rate_in_run": -1, "failures": -1}


def arriving(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """Values of the reports of a folder as a stream: metric, value, at, file."""
    rows = spark.readStream.schema(REPORT).option("maxFilesPerTrigger", most).json(path)
    rows = rows.select("*", F.unix_micros("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"))
    values = F.array(*[F.struct(F.lit(name).alias("metric"), F.coalesce(name, F.lit(0.0)).alias("value")) for name in SIGNS])
    return rows.select(F.explode(values).alias("m"), "at", "file").select("m.metric", "m.value", "at", "file")


class Newest(StatefulProcessor):
    """The newest two values of one metric, as (at, file, value) each; of files of one time the first by name is newer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.two = handle.getValueState("two", "at long, file string, value double, old_at long, old_file string, old_value double")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        # The oldest first, so that every report is told against the one before it.
        order = lambda x: (-x[0], x[1])
        new = sorted(((r.at, r.file, r.value) for r in rows), key=order, reverse=True)
        state = self.two.get() if self.two.exists() else None
        known = [(state[0], state[1], state[2])] if state else []
        if state and state[3] is not None:
            known.append((state[3], state[4], state[5]))
        for one in new:
            if any(one[:2] == k[:2] for k in known):
                continue
            best = sorted([*known, one], key=order)[:2]
            if best != known:
                known = best
                yield Row(metric=key[0], at=best[0][0], new=best[0][2], old=best[1][2] if len(best) > 1 else 0.0)
        if known:
            self.two.update((*known[0], *(known[1] if len(known) > 1 else (None, None, None))))

    def close(self) -> None:
        pass


def deltas(values: DataFrame) -> DataFrame:
    """metric, at, new, old, delta, trend of a stream of values; equal counts as improved."""
    rows = values.groupBy("metric").transformWithState(statefulProcessor=Newest(), outputStructType="metric string, at long, new double, old double", outputMode="append", timeMode="None")
    sign = F.element_at(F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair]), F.col("metric"))
    rows = rows.withColumn("delta", F.round(F.col("new") - F.col("old"), 2))
    return rows.select("metric", F.timestamp_micros("at").alias("at"), "new", "old", "delta", F.when(F.col("delta") * sign < 0, "regressed").otherwise("improved").alias("trend"))
