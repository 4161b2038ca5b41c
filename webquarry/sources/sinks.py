"""Writers of exports and of the contact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webquarry import fixed_values as V
from webquarry.functions import contacts as C

# The headers of the flat export.
FLAT_HEADERS = ("№", "Ключевое слово", "Страна", "Язык", "Домен", "Email", "Telegram", "LinkedIn", "Телефон", "Предметная область")


def write_csv(rows: DataFrame, path: str, delimiter: str = ";") -> None:
    """Rows as CSV with a header and a byte-order mark in each file's header line, one file a partition."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.option("sep", delimiter).option("header", True).mode("overwrite").csv(path)


def append_new(rows: DataFrame, known: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows whose key isn't known yet, each key once: what an insert-if-absent adds.

    Of several rows of a key the least by ``order``, by default by all other columns, is added, so
    that a repeated run adds the same.
    """
    rest = [c for c in rows.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(*(order or rest))) if rest else F.lit(None)
    first = rows.groupBy(*keys).agg(least.alias("_rest")) if rest else rows.select(*keys).distinct()
    return first.join(known.select(*keys), keys, "left_anti").select(*[F.col(c) if c in keys else F.col(f"_rest.{c}").alias(c) for c in rows.columns])


def saved(found: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Extractions (info) that are stored: those with any contact but phones, or all."""
    if keep_empty:
        return found
    # As the row of a generator the contacts are computed once; the filter would else go below them and find them again for each kind.
    once = found.select(*[F.explode(F.array("info")).alias("info") if c == "info" else F.col(c) for c in found.columns])
    return once.where(C.has_contacts(F.col("info")))


def contact_rows(found: DataFrame) -> DataFrame:
    """Contact rows (domain_contact_id, contact_type, value) of found contacts (id, info); phones aren't stored."""
    plain = F.array(*[F.struct(F.lit(t).alias("contact_type"), F.col(f"info.{c}").alias("listed")) for t, c in (("email", "emails"), ("telegram", "telegram"), ("linkedin", "linkedin"))])
    social = F.transform(F.map_entries("info.social"), lambda e: F.struct(e["key"].alias("contact_type"), e["value"].alias("listed")))
    rows = found.select(F.col("id").alias("domain_contact_id"), F.explode(F.concat(plain, social)).alias("c"))
    return rows.select("domain_contact_id", "c.contact_type", F.explode("c.listed").alias("value"))


def crawl_log_rows(crawls: DataFrame) -> DataFrame:
    """Log rows of crawls (domain, pages_crawled, error, duration_seconds, crawled_at): the error only where no page came."""
    return crawls.select("domain", F.when(F.col("pages_crawled") > 0, 200).otherwise(0).alias("status_code"), F.when(F.col("pages_crawled") == 0, F.col("error")).alias("error_message"), "pages_crawled", "duration_seconds", "crawled_at")


def merged_hosts(known: DataFrame, new: DataFrame) -> DataFrame:
    """Host lists (pos, host) merged: known ones first, new ones not among them whatever their case."""
    fresh = new.select(F.lit(1).alias("part"), "pos", "host").join(known.select(F.lower("host").alias("k")), F.lower("host") == F.col("k"), "left_anti")
    return known.select(F.lit(0).alias("part"), "pos", "host").union(fresh)


def localised(rows: DataFrame) -> DataFrame:
    """The flat export's ten columns (n, keyword, country, language, domain, email, telegram, linkedin, phone, subject) under their headers."""
    own = ("n", "keyword", "country", "language", "domain", "email", "telegram", "linkedin", "phone", "subject")
    return rows.select(*[F.col(c).alias(h) for c, h in zip(own, FLAT_HEADERS, strict=True)])


def with_model_trace(logs: DataFrame, traces: DataFrame, *keys: str) -> DataFrame:
    """Logs (id, keys, crawled_at) with the traces (keys, llm_request, llm_response, llm_model) on the newest log of each key."""
    newest = logs.groupBy(*keys).agg(F.max_by("id", F.struct("crawled_at", "id")).alias("id"))
    marked = newest.join(traces.select(*keys, "llm_request", "llm_response", "llm_model"), list(keys)).drop(*keys)
    return logs.drop("llm_request", "llm_response", "llm_model").join(marked, "id", "left")


def env_text(text: Column, hosts: Column, name: str = "SERP_BLOCKED_HOST_SUFFIXES") -> Column:
    """A text of settings whose line of that name lists the hosts as JSON; the line is added if there is none."""
    line = F.concat(F.lit(f"{name}="), F.to_json(hosts))
    at = F.regexp_extract(text, rf"(?m)^{name}=.*$", 0)
    # Only the first such line is replaced, and as plain text.
    place = F.when(text.startswith(f"{name}="), 1).otherwise(F.locate(f"\n{name}=", text) + 1)
    replaced = F.concat(F.substring(text, F.lit(1), place - 1), line, F.substring(text, place + F.length(at), F.length(text)))
    ended = F.when((text != "") & ~text.endswith("\n"), F.concat(text, F.lit("\n"))).otherwise(text)
    return F.when(text.rlike(rf"(?m)^{name}="), replaced).otherwise(F.concat(ended, line, F.lit("\n")))


def denylist_outcome(suggested: Column, known: Column) -> tuple[Column, Column]:
    """The known hosts with the suggested ones behind them, whatever their case, and the exit code: 0 added, 1 no suggestion, 2 all known."""
    clean = F.array_distinct(F.transform(suggested, lambda h: F.trim(F.lower(h))))
    fresh = F.filter(clean, lambda h: ~F.exists(known, lambda k: F.lower(k) == h))
    return F.concat(known, fresh), F.when(F.size(suggested) == 0, 1).when(F.size(fresh) == 0, 2).otherwise(0)


def new_tasks(rows: DataFrame) -> DataFrame:
    """Task rows (task_name, task_type, keyword_id, priority, max_retries) as they are inserted: pending, with the type's retries by default."""
    known = F.create_map(*[F.lit(x) for pair in V.MAX_RETRIES.items() for x in pair])
    retries = F.coalesce("max_retries", F.element_at(known, F.col("task_type")), F.lit(3)).cast("int")
    return rows.select("task_name", "task_type", "keyword_id", F.coalesce("priority", F.lit(0)).alias("priority"), retries.alias("max_retries"), F.lit("pending").alias("status"), F.lit(0).alias("retry_count"))


def write_report(report: DataFrame, path: str) -> None:
    """A quality report of one row as a JSON file of its own."""
    report.coalesce(1).write.mode("append").json(path)


def newest_reports(spark: SparkSession, path: str, n: int = 2) -> DataFrame:
    """The newest reports of a folder by the time of their files, with their rank ``age`` from 1."""
    rows = spark.read.json(path).withColumn("_at", F.col("_metadata.file_modification_time")).withColumn("_file", F.col("_metadata.file_name"))
    # Reports are small files, a few a day.
    return rows.withColumn("age", F.row_number().over(Window.orderBy(F.desc("_at"), "_file"))).where(F.col("age") <= n).drop("_at", "_file")
