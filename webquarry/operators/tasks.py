"""The task table as pure transitions: dependencies, runnable tasks, retries, recovery, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquarry import fixed_values as V


def dependency_satisfied(parent_type: Column, parent_status: Column, child_type: Column) -> Column:
    """Whether a task may start: no parent, a completed one, or a failed one whose failure doesn't matter."""
    search = (parent_type == "search_keyword") & child_type.isin("crawl_domain", "extract_contacts")
    crawl = (parent_type == "crawl_domain") & (child_type == "extract_contacts")
    ok = parent_status.isNull() | (parent_status == "completed") | ((parent_status == "failed") & (search | crawl))
    return F.coalesce(ok, F.lit(False))


def with_parents(tasks: DataFrame) -> DataFrame:
    """Tasks with their parent's type and status (a missing parent: null) and whether they may start."""
    p = tasks.select(F.col("id").alias("depends_on_task_id"), F.col("task_type").alias("parent_type"), F.col("status").alias("parent_status"))
    rows = tasks.join(p, "depends_on_task_id", "left")
    return rows.withColumn("satisfied", dependency_satisfied(F.col("parent_type"), F.col("parent_status"), F.col("task_type")))


def next_tasks(tasks: DataFrame, n: int, as_of: str | None = None) -> DataFrame:
    """The next n runnable tasks: pending, due, dependency satisfied; highest priority, then oldest, then least id."""
    rows = with_parents(tasks).where("status = 'pending' AND satisfied")
    if as_of is not None and "scheduled_for" in tasks.columns:
        rows = rows.where(F.col("scheduled_for").isNull() | (F.col("scheduled_for") <= F.expr(f"TIMESTAMP '{as_of}'")))
    return rows.orderBy(F.desc("priority"), "created_at", "id").limit(n)


def failed_once_more(tasks: DataFrame) -> DataFrame:
    """Running tasks after a failure: one more retry, pending again while retries are left."""
    again = F.col("retry_count") + 1 < F.col("max_retries")
    return tasks.where("status = 'running'").select("id", "task_type", (F.col("retry_count") + 1).alias("retry_count"), F.when(again, "pending").otherwise("failed").alias("status"))


def completed(tasks: DataFrame, as_of: str) -> DataFrame:
    """Running tasks after success: no lock, stamped."""
    return tasks.where("status = 'running'").select("id", F.lit("completed").alias("status"), F.lit(None).cast("timestamp").alias("locked_at"), F.expr(f"TIMESTAMP '{as_of}'").alias("completed_at"))


def stale(tasks: DataFrame, as_of: str, seconds: int = V.LOCK_SECONDS) -> DataFrame:
    """Running tasks whose lock is too old, as they are after recovery, with the old lock time."""
    rows = tasks.where((F.col("status") == "running") & (F.col("locked_at") < F.expr(f"TIMESTAMP '{as_of}' - INTERVAL '{seconds}' SECOND")))
    return rows.select("id", "task_type", F.lit("pending").alias("status"), F.col("locked_at").alias("was_locked_at"))


def finished_keywords(tasks: DataFrame) -> DataFrame:
    """Keywords with tasks, none of which is open."""
    counted = tasks.where("keyword_id IS NOT NULL").groupBy("keyword_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("status").isin("pending", "running")).alias("open"))
    return counted.where("open = 0").select("keyword_id", "tasks")


def keyword_drill_down(tasks: DataFrame) -> DataFrame:
    """Per keyword: tasks, open ones, and counts by status as text."""
    each = tasks.groupBy("keyword_id", "status").agg(F.count("*").alias("n"))
    shown = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", F.col("n").cast("string")))), ",")
    open_n = F.sum(F.when(F.col("status").isin("pending", "running"), F.col("n")).otherwise(0))
    return each.groupBy("keyword_id").agg(F.sum("n").alias("total"), open_n.alias("open"), shown.alias("by_status"))


def requeued(tasks: DataFrame, newest: int) -> DataFrame:
    """The newest failed tasks as pending ones; their retries stay counted."""
    rows = tasks.where("status = 'failed'").orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(newest, 200)))
    return rows.select("id", "task_type", F.lit("pending").alias("status"), "retry_count")


def reset_searches(tasks: DataFrame) -> DataFrame:
    """All failed searches as new: pending, without retries, lock and times."""
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("locked_at", "timestamp"), ("started_at", "timestamp"), ("completed_at", "timestamp"), ("error_message", "string"))]
    return tasks.where("task_type = 'search_keyword' AND status = 'failed'").select("id", F.lit("pending").alias("status"), F.lit(0).alias("retry_count"), *none)


def reset_keywords(keywords: DataFrame) -> DataFrame:
    """Processed keywords, to be processed again."""
    return keywords.where("is_processed").select("id", "keyword", F.lit(False).alias("is_processed"))


def longest_locked(tasks: DataFrame, n: int = 10) -> DataFrame:
    """Running tasks, the latest locks first."""
    return tasks.where("status = 'running'").orderBy(F.desc_nulls_last("locked_at"), F.desc("id")).limit(n)


def failures(tasks: DataFrame, chars: int = 80) -> DataFrame:
    """Failed tasks by type and the beginning of their error."""
    return tasks.where("status = 'failed'").groupBy("task_type", F.substring("error_message", 1, chars).alias("error")).agg(F.count("*").alias("n"))


def unblocked(tasks: DataFrame) -> DataFrame:
    """Pending tasks that wait for a failed parent in vain."""
    return with_parents(tasks).where("status = 'pending' AND parent_status = 'failed' AND NOT satisfied").select("id", "task_type", "depends_on_task_id")


def retained(tasks: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Tasks without the completed and failed ones that are older than some days."""
    old = F.col("status").isin("completed", "failed") & (F.col("created_at") < F.expr(f"TIMESTAMP '{as_of}' - INTERVAL '{days}' DAY"))
    return tasks.where(~F.coalesce(old, F.lit(False)))


def first_tasks(keywords: DataFrame, n: int = V.KEYWORDS_A_RUN) -> DataFrame:
    """The searches that a run starts with: the oldest keywords that aren't processed."""
    rows = keywords.where("NOT is_processed").orderBy("created_at", "id").limit(n)
    return rows.select(F.concat(F.lit("search_"), F.col("id").cast("string")).alias("task_name"), F.lit("search_keyword").alias("task_type"), F.col("id").alias("keyword_id"), F.lit(10).alias("priority"), F.lit(None).cast("int").alias("max_retries"))


def snippet_tasks(snippets: DataFrame) -> DataFrame:
    """The extractions that search results (id, keyword_id) with a contact in their text start, before any crawl's."""
    return snippets.select(F.concat(F.lit("extract_snippet_"), F.col("id").cast("string")).alias("task_name"), F.lit("extract_contacts").alias("task_type"), "keyword_id", F.lit(8).alias("priority"), F.lit(None).cast("int").alias("max_retries"))


def children(tasks: DataFrame) -> DataFrame:
    """Tasks that a completed task starts: a search starts crawls, a crawl an extraction; with priority and retries."""
    kind = F.when(F.col("task_type") == "search_keyword", "crawl_domain").when(F.col("task_type") == "crawl_domain", "extract_contacts")
    rows = tasks.where("status = 'completed'").select(F.col("id").alias("depends_on_task_id"), "keyword_id", kind.alias("task_type")).where("task_type IS NOT NULL")
    retries = F.element_at(F.create_map(*[F.lit(x) for pair in V.MAX_RETRIES.items() for x in pair]), F.col("task_type"))
    return rows.select("*", F.when(F.col("task_type") == "crawl_domain", 5).otherwise(7).alias("priority"), retries.alias("max_retries"))


def latest_per_key(rows: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
