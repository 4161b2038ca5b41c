"""Rolling quality metrics, gates and report differences. ``as_of`` stands for now."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry import fixed_values as V

STATUSES = ("pending", "running", "completed", "failed")


def rate(part: Column, whole: Column, empty: float = 0.0, digits: int = 2) -> Column:
    """Per cent, rounded; ``empty`` if there is nothing to compare with."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), digits), F.lit(empty))


def is_timeout(error: Column) -> Column:
    """Whether an error text tells of a timeout."""
    return F.coalesce(error.ilike("%timeout%"), F.lit(False))


def _since(as_of: str, hours: int) -> Column:
    return F.expr(f"TIMESTAMP '{as_of}' - INTERVAL '{hours}' HOUR")


def queue_stats(tasks: DataFrame, logs: DataFrame, domains: DataFrame, contacts: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """One row: tasks by status and the quality of the last hours. ``contacts``: (domain_contact_id, contact_type)."""
    start = _since(as_of, hours)
    open_ids = F.when(F.col("status").isin("pending", "running"), F.col("keyword_id"))
    queue = tasks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"), F.countDistinct(open_ids).alias("keywords_in_progress"))
    crawl = logs.where(F.col("crawled_at") >= start).agg(F.count("*").alias("crawls"), F.count_if(F.col("pages_crawled") == 0).alias("zero_page_crawls"), F.count_if(is_timeout(F.col("error_message"))).alias("timeout_crawls"))
    recent = domains.where(F.col("created_at") >= start).select(F.col("id").alias("domain_contact_id"), "extraction_method")
    social = F.col("contact_type").isin("x", "facebook", "instagram", "youtube")
    mine = contacts.groupBy("domain_contact_id").agg(F.count("*").alias("n"), F.count_if(F.col("contact_type") != "phone").alias("reach"), F.count_if(social).alias("social"))
    found = recent.join(mine, "domain_contact_id", "left")
    yields = found.agg(F.count("*").alias("domains"), F.count_if(F.col("reach") > 0).alias("domains_with_contacts"), F.count_if(F.col("social") > 0).alias("domains_with_social"), F.coalesce(F.sum("n"), F.lit(0)).alias("contact_rows"), F.count_if(F.col("extraction_method") == "llm").alias("llm_extractions"))
    row = queue.crossJoin(crawl).crossJoin(yields)
    return row.select(
        "*",
        rate(F.col("crawls") - F.col("zero_page_crawls"), F.col("crawls"), 100.0).alias("crawl_success_rate"),
        rate(F.col("timeout_crawls"), F.col("crawls")).alias("timeout_rate"),
        rate(F.col("domains_with_contacts"), F.col("domains")).alias("domains_with_contacts_rate"),
        F.coalesce(F.round(F.try_divide(F.col("contact_rows").cast("double"), F.col("domains")), 2), F.lit(0.0)).alias("avg_contacts_per_domain"),
        rate(F.col("llm_extractions"), F.col("domains")).alias("llm_extraction_rate"),
        rate(F.col("domains_with_social"), F.col("domains")).alias("social_coverage_rate"),
    )


def alerts(stats: DataFrame) -> DataFrame:
    """``stats`` with the list of quality alerts and whether the gate passes."""
    tests = [
        ("failed_tasks", F.col("failed") > 0),
        ("timeout_rate", F.col("timeout_rate") >= V.ALERT_TIMEOUT_RATE),
        ("contacts_rate", F.col("domains_with_contacts_rate") <= V.ALERT_CONTACTS_RATE),
        ("avg_contacts", F.col("avg_contacts_per_domain") <= V.ALERT_AVERAGE),
        ("zero_pages", F.col("zero_page_crawls") >= V.ALERT_ZERO_PAGES),
    ]
    listed = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests]), lambda x: x.isNotNull())
    return stats.withColumn("alerts", listed).withColumn("passes", F.size("alerts") == 0)


def health(stats: DataFrame, services_ok: Column | None = None) -> DataFrame:
    """``stats`` with the verdict: unhealthy if a service isn't there, else degraded or healthy."""
    bad = (F.col("timeout_rate") >= V.ALERT_TIMEOUT_RATE) | ((F.col("domains_with_contacts_rate") <= V.ALERT_CONTACTS_RATE) & (F.col("total") > 0))
    return stats.withColumn("verdict", F.when(~F.coalesce(F.lit(True) if services_ok is None else services_ok, F.lit(False)), "unhealthy").when(bad, "degraded").otherwise("healthy"))


def zero_page_reasons(logs: DataFrame, as_of: str, days: int = 7, top: int = 8) -> DataFrame:
    """The most frequent error texts of crawls without pages; none is a text of its own."""
    rows = logs.where((F.col("crawled_at") >= _since(as_of, 24 * days)) & (F.col("pages_crawled") == 0))
    return rows.groupBy("error_message").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("error_message")).limit(top)


def denylist_candidates(logs: DataFrame, domains: DataFrame, as_of: str, days: int = V.DENYLIST_DAYS, least: int = V.DENYLIST_ZERO_CRAWLS, limit: int = V.DENYLIST_LIMIT, hosts: tuple[str, ...] = V.BLOCKED_HOSTS) -> DataFrame:
    """Hosts with repeated empty crawls, neither known for contacts nor blocked: (host, zero_count, reason).

    As in the rule that it follows, the list is cut to three times the limit before hosts with
    contacts are taken out.
    """
    rows = logs.where((F.col("crawled_at") >= _since(as_of, 24 * days)) & (F.col("pages_crawled") == 0))
    counted = rows.groupBy("domain").agg(F.count("*").alias("zero_count")).where(F.col("zero_count") >= least)
    top = counted.orderBy(F.desc("zero_count"), "domain").limit(3 * limit)
    top = top.withColumn("host", F.regexp_replace(F.lower("domain"), r"^www\.", ""))
    blocked = reduce(lambda a, b: a | b, [(F.col("host") == h) | F.col("host").endswith("." + h) for h in hosts])
    known = domains.select(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("host")).distinct()
    left = top.where((F.col("host") != "") & ~blocked).join(known, "host", "left_anti")
    reason = F.concat(F.col("zero_count").cast("string"), F.lit(f" zero-page crawls in {days}d, no domain_contacts"))
    return left.orderBy(F.desc("zero_count"), "host").limit(limit).select("host", "zero_count", reason.alias("reason"))


def window_counts(logs: DataFrame, domains: DataFrame, contacts: DataFrame, t0: str, t1: str) -> DataFrame:
    """Crawls, domains and distinct domains with e-mail before, in and after the time range, in rows."""
    phase = lambda c: F.when(F.col(c) < F.expr(f"TIMESTAMP '{t0}'"), "before").when(F.col(c) <= F.expr(f"TIMESTAMP '{t1}'"), "during").otherwise("after")
    crawls = logs.groupBy(phase("crawled_at").alias("phase")).agg(F.count("*").alias("crawls"), F.count_if(F.col("pages_crawled") == 0).alias("zero_page"))
    mailed = contacts.where("contact_type = 'email'").select("domain_contact_id").distinct()
    rows = domains.withColumnRenamed("id", "domain_contact_id").join(mailed.withColumn("mail", F.lit(True)), "domain_contact_id", "left")
    found = rows.groupBy(phase("created_at").alias("phase")).agg(F.count("*").alias("domain_rows"), F.countDistinct(F.when(F.col("mail"), F.col("domain"))).alias("domains_with_email"))
    names = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("crawls", "zero_page", "domain_rows", "domains_with_email")]
    return crawls.join(found, "phase", "full").select("phase", *names)


def run_summary(state: DataFrame) -> DataFrame:
    """Per run: keywords by status, sums and progress in whole per cent; header rows count as keywords."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "processing")]
    rows = state.groupBy("run_id").agg(F.count("*").alias("total"), *counts, F.sum("websites_processed").alias("websites"), F.sum("contacts_found").alias("contacts"))
    return rows.withColumn("progress", F.coalesce(F.try_divide(100 * F.col("completed"), F.col("total")), F.lit(0.0)).cast("int"))


def status_shares(tasks: DataFrame) -> DataFrame:
    """Tasks by status with their share of all, two decimals."""
    counted = tasks.groupBy("status").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("status", "n", rate(F.col("n"), F.col("total")).alias("share"))


def report_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(metric, value) of two reports: both values, the difference and a verdict; equal counts as improved."""
    rows = old.select("metric", F.col("value").alias("before")).join(new.select("metric", F.col("value").alias("after")), "metric")
    return rows.select("*", (F.col("after") - F.col("before")).alias("delta"), F.when(F.col("after") >= F.col("before"), "improved").otherwise("regressed").alias("verdict"))


def weekly_gate(runs: DataFrame, with_contacts: float = 20.0, zero_pages: float = 60.0) -> DataFrame:
    """Runs (with_contacts_pct, zero_page_pct, failures) with the exit code 0 or 2."""
    bad = (F.col("with_contacts_pct") < with_contacts) | (F.col("zero_page_pct") > zero_pages) | (F.col("failures") > 0)
    return runs.withColumn("exit_code", F.when(bad, 2).otherwise(0))


def quality_report(keywords: DataFrame, tasks: DataFrame, logs: DataFrame, domains: DataFrame, contacts: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(metric, value) of keywords, tasks, the crawls of the last days and contacts; rates with one decimal, only where there is a whole."""

    def rows(df: DataFrame, **columns: Column) -> DataFrame:
        return df.agg(*[c.cast("double").alias(k) for k, c in columns.items()])

    k = rows(keywords, keywords_total=F.count("*"), keywords_processed=F.count_if("is_processed"), keywords_pending=F.count_if(~F.col("is_processed")))
    by_status = {f"tasks_{s}": F.count_if(F.col("status") == s) for s in STATUSES}
    by_type = {f"failed_{t}": F.count_if((F.col("status") == "failed") & (F.col("task_type") == t)) for t in ("search_keyword", "crawl_domain", "extract_contacts")}
    t = rows(tasks, **by_status, **by_type)
    zero, late = F.count_if(F.col("pages_crawled") == 0), F.count_if(is_timeout(F.col("error_message")))
    part = lambda c: F.round(F.try_divide(100.0 * c, F.count("*")), 1)
    crawls = rows(logs.where(F.col("crawled_at") >= _since(as_of, 24 * days)), crawls=F.count("*"), zero_pages=zero, timeouts=late, zero_page_rate=part(zero), timeout_rate=part(late))
    mailed = contacts.where(F.lower("contact_type") == "email").select("domain_contact_id").distinct()
    c = rows(contacts, contact_rows=F.count("*"))
    m = rows(mailed, domains_with_email=F.count("*"))
    d = rows(domains, domain_contacts=F.count("*"), llm_domains=F.count_if(F.col("extraction_method") == "llm"))
    # Each side has one row.
    one = k.crossJoin(t).crossJoin(crawls).crossJoin(c).crossJoin(m).crossJoin(d)
    one = one.withColumn("email_yield", F.round(F.try_divide(100.0 * F.col("domains_with_email"), F.col("domain_contacts")), 1))
    return one.unpivot([], one.columns, "metric", "value").where("value IS NOT NULL")


def smoke_snapshot(logs: DataFrame, domains: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """One row: crawls and domains (created_at, has_social) of the last hours with success and social coverage."""
    start = _since(as_of, hours)
    crawls = logs.where(F.col("crawled_at") >= start).agg(F.count("*").alias("total_crawls"), F.count_if(F.col("pages_crawled") == 0).alias("zero_page_crawls"))
    found = domains.where(F.col("created_at") >= start).agg(F.count("*").alias("domain_contacts"), F.count_if("has_social").alias("domains_with_social"))
    success = rate(F.col("total_crawls") - F.col("zero_page_crawls"), F.col("total_crawls"), 100.0).alias("crawl_success_rate")
    return crawls.crossJoin(found).select(F.lit(hours).alias("window_hours"), "*", success, rate(F.col("domains_with_social"), F.col("domain_contacts")).alias("social_coverage_rate"))


def smoke_summary(runs: DataFrame, *keys: str) -> DataFrame:
    """Summary of sampled sites (pages_crawled, has_contacts, failed); a failed one has neither pages nor contacts."""
    ok = ~F.col("failed")
    n = [F.count("*").alias("processed"), F.count_if(ok & F.col("has_contacts")).alias("with_contacts"), F.count_if(ok & (F.col("pages_crawled") == 0)).alias("zero_page_in_run"), F.count_if("failed").alias("failures")]
    rows = runs.groupBy(*keys).agg(*n)
    return rows.select("*", rate(F.col("with_contacts"), F.col("processed")).alias("with_contacts_rate"), rate(F.col("zero_page_in_run"), F.col("processed")).alias("zero_page_rate_in_run"))


def newest_delta(reports: DataFrame) -> DataFrame:
    """(metric, new, old, delta, trend) of the newest two reports (age 1 and 2); equal counts as improved."""
    kinds = {"with_contacts_rate": 1, "zero_page_rate_in_run": -1, "failures": -1}
    value = lambda name, age: F.coalesce(F.max(F.when(F.col("age") == age, F.col(name).cast("double"))), F.lit(0.0))
    row = reports.where("age <= 2").agg(*[value(k, age).alias(f"{k}_{age}") for k in kinds for age in (1, 2)])
    listed = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"{k}_1").alias("new"), F.col(f"{k}_2").alias("old"), F.round(F.col(f"{k}_1") - F.col(f"{k}_2"), 2).alias("delta"), F.lit(sign).alias("sign")) for k, sign in kinds.items()])
    return row.select(F.explode(listed).alias("m")).select("m.metric", "m.new", "m.old", "m.delta", F.when(F.col("m.delta") * F.col("m.sign") < 0, "regressed").otherwise("improved").alias("trend"))


def hints(tasks: DataFrame, as_of: str) -> DataFrame:
    """One row: what an operator of the queue should look at."""
    old = F.count_if((F.col("status") == "running") & (F.col("locked_at") < F.expr(f"TIMESTAMP '{as_of}' - INTERVAL '{V.LOCK_SECONDS}' SECOND")))
    row = tasks.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "failed").alias("failed"), old.alias("stale"))
    tests = [("stale", F.col("stale") > 0), ("empty", F.col("total") == 0), ("busy", F.col("running") > V.HINT_RUNNING), ("failures", F.col("failed") > V.HINT_FAILED)]
    return row.withColumn("hints", F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests]), lambda x: x.isNotNull()))


def metrics_bundle(state: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: the summary of the run with the newest state (id) and the queue's statistics."""
    last = state.orderBy(F.desc("id")).limit(1).select("run_id")
    return run_summary(state.join(F.broadcast(last), "run_id", "left_semi")).select(*[F.col(c).alias(f"run_{c.removeprefix('run_')}") for c in ("run_id", "total", "completed", "failed", "processing", "websites", "contacts", "progress")]).crossJoin(stats)
