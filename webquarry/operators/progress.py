"""Progress rows of runs, a row for each run and keyword, from events in order.

Three kinds of events: ``progress`` writes websites, contacts and per cent, and starts the row if
there is none; ``completed`` and ``failed`` change a row that is there and are nothing
otherwise. The state after some events is found by aggregation alone, not event by event, so
events of one key needn't meet in one task before they are reduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("run_id", "keyword_id")
STATE = "run_id string, keyword_id int, status string, websites_processed int, contacts_found int, progress_percent int, error_message string, updated_at timestamp"


def percent(done: Column, total: Column) -> Column:
    """Whole per cent, 0 without a total."""
    return F.coalesce(F.when(total > 0, F.floor(done / total * 100)), F.lit(0)).cast("int")


def applied(state: DataFrame, events: DataFrame) -> DataFrame:
    """``state`` (``STATE``) after ``events`` (run_id, keyword_id, seq, kind, websites, contacts, total, error, at).

    ``seq`` orders the events of a key; null keys are keys of their own. Rows without events stay.
    """
    same = lambda a, b: [a[k].eqNullSafe(b[f"_{k}"]) for k in KEYS]
    renamed = lambda df: df.withColumnsRenamed({k: f"_{k}" for k in KEYS})
    there = renamed(state.select(*KEYS).withColumn("_there", F.lit(True)))
    first = renamed(events.where("kind = 'progress'").groupBy(*KEYS).agg(F.min("seq").alias("_first")))
    # What comes before a row's first progress is nothing, unless the row was there.
    rows = events.join(there, same(events, there), "left").drop(*[f"_{k}" for k in KEYS])
    rows = rows.join(first, same(rows, first), "left").drop(*[f"_{k}" for k in KEYS])
    rows = rows.where(F.col("_there") | (F.col("seq") >= F.col("_first")))
    kind, seq = F.col("kind"), F.col("seq")
    starts = F.col("_there").isNull() & (seq == F.col("_first"))

    def last(value: Column, when: Column) -> Column:
        """The value of the last event of some kinds, as a struct so that null values count."""
        return F.max_by(F.when(when, F.struct(value.alias("v"))), F.when(when, seq))

    progress, completed, failed = kind == "progress", kind == "completed", kind == "failed"
    done = F.when(completed, F.lit(100)).otherwise(percent(F.col("websites"), F.col("total")))
    changed = rows.groupBy(*KEYS).agg(
        last(F.col("websites"), progress).alias("websites"),
        last(F.col("contacts"), progress | completed).alias("contacts"),
        last(done, progress | completed).alias("done"),
        last(kind, completed | failed).alias("ended"),
        last(F.col("error"), failed).alias("error"),
        last(F.col("at"), ~starts).alias("at"),
    )
    new = renamed(changed)
    both = state.join(new, same(state, new), "full_outer")
    take = lambda e, old: F.when(F.col(e).isNotNull(), F.col(f"{e}.v")).otherwise(F.col(old))
    own = F.col("status").isNotNull()
    return both.select(
        *[F.when(own, F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in KEYS],
        F.coalesce("ended.v", "status", F.lit("processing")).alias("status"),
        take("websites", "websites_processed").cast("int").alias("websites_processed"),
        take("contacts", "contacts_found").cast("int").alias("contacts_found"),
        take("done", "progress_percent").cast("int").alias("progress_percent"),
        take("error", "error_message").alias("error_message"),
        take("at", "updated_at").alias("updated_at"),
    )


def summary(state: DataFrame) -> DataFrame:
    """Per run: keywords, completed, failed and processing ones, contacts, websites and overall per cent."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    rows = state.groupBy("run_id").agg(F.count("*").alias("total_keywords"), count("completed"), count("failed"), count("processing"), F.sum("contacts_found").alias("total_contacts"), F.sum("websites_processed").alias("total_websites"))
    return rows.withColumn("overall_progress", percent(F.col("completed"), F.col("total_keywords")))
