"""A whole run of the task table: from the first searches until nothing can start any more.

A run is a fixpoint. In each round all tasks that may start are run together: a task's outcome
is how often it fails before it succeeds, so its retries and its last status are known at once;
completed tasks start their children, which are the next round's. Only open tasks are joined with
the settled ones, and a round's result is kept, so a round costs what it settles. There are
as many rounds as the longest chain of tasks that wait for each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry import fixed_values as V
from webquarry.lineage import cut
from webquarry.operators import tasks as T

COLUMNS = ("id", "task_type", "status", "priority", "retry_count", "max_retries", "keyword_id", "depends_on_task_id")


def attempted(tasks: DataFrame, failures: DataFrame) -> DataFrame:
    """Tasks after all their attempts, given how often each fails (id, failures; absent: never): completed, or failed without retries left."""
    rows = tasks.join(failures.select("id", F.col("failures").alias("_f")), "id", "left").withColumn("_f", F.coalesce("_f", F.lit(0)))
    # A task that has no retry left still has the attempt that it waits for.
    left = F.greatest(F.col("max_retries") - F.col("retry_count"), F.lit(1))
    done = F.col("_f") < left
    return rows.select(*[c for c in tasks.columns if c not in ("status", "retry_count")], F.when(done, "completed").otherwise("failed").alias("status"), (F.col("retry_count") + F.least(F.col("_f"), left)).cast("int").alias("retry_count"))


def settled(tasks: DataFrame, failures: DataFrame, children: Callable[[DataFrame], DataFrame] | None = None, unblock: bool = False) -> DataFrame:
    """The tasks (``COLUMNS``) at the end of a run, with ``round``: 0 for those settled before, null for those that never start.

    Running tasks are taken as stale and start again. ``children`` gives the tasks that completed
    ones start. With ``unblock``, tasks that wait for a failed one in vain lose their
    dependency when nothing else can start.
    """
    final = F.col("status").isin("completed", "failed")
    done = cut(tasks.where(final).select(*COLUMNS, F.lit(0).alias("round")))
    live = cut(tasks.where(~final).select(*COLUMNS).withColumn("status", F.lit("pending")))
    k = 0
    while True:
        k += 1
        # The parents of open tasks only, whatever the number of settled ones.
        wanted = live.select(F.col("depends_on_task_id").alias("id")).where("id IS NOT NULL").distinct()
        parents = done.select(*COLUMNS).join(wanted, "id", "left_semi").union(live)
        p = parents.select(F.col("id").alias("depends_on_task_id"), F.col("task_type").alias("parent_type"), F.col("status").alias("parent_status"))
        rows = cut(live.join(p, "depends_on_task_id", "left").select(*COLUMNS, "parent_status", T.dependency_satisfied(F.col("parent_type"), F.col("parent_status"), F.col("task_type")).alias("ready")))
        if rows.where("ready").isEmpty():
            stuck = F.col("parent_status") == "failed"
            if not unblock or rows.where(stuck).isEmpty():
                break
            rows = rows.withColumn("depends_on_task_id", F.when(~F.coalesce(stuck, F.lit(False)), F.col("depends_on_task_id"))).withColumn("ready", F.coalesce(stuck, F.lit(False)))
        now = cut(attempted(rows.where("ready").select(*COLUMNS), failures).select(*COLUMNS, F.lit(k).alias("round")))
        done = done.union(now)
        live = rows.where("NOT ready").select(*COLUMNS)
        if children is not None:
            live = live.union(children(now.where("status = 'completed'")).select(*COLUMNS))
        live = cut(live)
    return done.union(live.select(*COLUMNS, F.lit(None).cast("int").alias("round")))


def keywords_after(tasks: DataFrame) -> DataFrame:
    """Keywords of settled tasks: tasks, completed, failed and open ones, the last round, and whether the keyword is processed."""
    count = lambda s: F.count_if(F.col("status") == s)
    rows = tasks.where("keyword_id IS NOT NULL").groupBy("keyword_id").agg(F.count("*").alias("tasks"), count("completed").alias("completed"), count("failed").alias("failed"), count("pending").alias("still_open"), F.max("round").alias("last_round"))
    return rows.withColumn("is_processed", F.col("still_open") == 0)


def whole_run(keywords: DataFrame, results: DataFrame, failures: DataFrame, n: int = V.KEYWORDS_A_RUN) -> DataFrame:
    """A run from the oldest open keywords: each search starts crawls of its results, or extractions for results (id, keyword_id, snippet_only) whose text has contacts; each crawl an extraction.

    Ids are the tasks' names: search_<keyword>, crawl_<result>, extract_<result>, extract_snippet_<result>.
    """
    retries = F.element_at(F.create_map(*[F.lit(x) for pair in V.MAX_RETRIES.items() for x in pair]), F.col("task_type"))

    def tasks(rows: DataFrame) -> DataFrame:
        return rows.select("id", "task_type", F.lit("pending").alias("status"), F.col("priority").cast("int").alias("priority"), F.lit(0).alias("retry_count"), F.coalesce(retries, F.lit(3)).cast("int").alias("max_retries"), "keyword_id", "depends_on_task_id")

    first = T.first_tasks(keywords, n).select(F.col("task_name").alias("id"), "task_type", "priority", F.col("keyword_id").cast("int").alias("keyword_id"), F.lit(None).cast("string").alias("depends_on_task_id"))

    def children(completed: DataFrame) -> DataFrame:
        searches = completed.where("task_type = 'search_keyword'").select("keyword_id", F.col("id").alias("depends_on_task_id"))
        found = results.select(F.col("id").alias("_result"), F.col("keyword_id").cast("int").alias("keyword_id"), "snippet_only").join(searches, "keyword_id")
        kind = F.when(F.col("snippet_only"), "extract_contacts").otherwise("crawl_domain")
        name = F.concat(F.when(F.col("snippet_only"), "extract_snippet_").otherwise("crawl_"), F.col("_result").cast("string"))
        started = found.select(name.alias("id"), kind.alias("task_type"), F.when(F.col("snippet_only"), 8).otherwise(5).alias("priority"), "keyword_id", "depends_on_task_id")
        crawls = completed.where("task_type = 'crawl_domain'")
        extracts = crawls.select(F.regexp_replace("id", "^crawl_", "extract_").alias("id"), F.lit("extract_contacts").alias("task_type"), F.lit(7).alias("priority"), "keyword_id", F.col("id").alias("depends_on_task_id"))
        return tasks(started.union(extracts))

    return settled(tasks(first), failures, children)
