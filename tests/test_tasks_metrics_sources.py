import base64

import pytest
from pyspark.sql import functions as F

from webquarry.operators import metrics, tasks
from webquarry.sources import serp, sinks
from webquarry.streaming import rolling


@pytest.mark.parametrize(
    ("ptype", "pstatus", "child", "ok"),
    [("search_keyword", "running", "crawl_domain", False), ("search_keyword", "failed", "crawl_domain", True), ("crawl_domain", "failed", "extract_contacts", True), (None, None, "crawl_domain", True), ("crawl_domain", "completed", "extract_contacts", True), ("extract_contacts", "failed", "extract_contacts", False)],
)
def test_dependencies(spark, ptype, pstatus, child, ok):
    c = lambda v: F.lit(v).cast("string")
    assert spark.range(1).select(tasks.dependency_satisfied(c(ptype), c(pstatus), c(child))).first()[0] == ok


def test_empty_window_defaults(spark):
    t = spark.createDataFrame([], "status string, keyword_id int")
    logs = spark.createDataFrame([], "crawled_at timestamp, pages_crawled int, error_message string")
    d = spark.createDataFrame([], "id long, created_at timestamp, extraction_method string")
    c = spark.createDataFrame([], "domain_contact_id long, contact_type string")
    row = metrics.queue_stats(t, logs, d, c, "2024-01-31 00:00:00").first()
    assert row.crawl_success_rate == 100.0 and row.timeout_rate == 0.0 and row.avg_contacts_per_domain == 0.0 and row.contact_rows == 0


def test_gate(spark):
    row = spark.createDataFrame([(0, 35.0, 20.1, 0.51, 4)], "failed int, timeout_rate double, domains_with_contacts_rate double, avg_contacts_per_domain double, zero_page_crawls int")
    got = metrics.alerts(row).first()
    assert got.alerts == ["timeout_rate"] and not got.passes


def test_reports_and_weekly_gate(spark):
    old, new = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "metric string, value double"), spark.createDataFrame([("a", 1.0), ("b", 1.0)], "metric string, value double")
    assert {r.metric: r.verdict for r in metrics.report_delta(old, new).collect()} == {"a": "improved", "b": "regressed"}
    runs = spark.createDataFrame([(19.0, 10.0, 0), (30.0, 60.0, 0)], "with_contacts_pct double, zero_page_pct double, failures int")
    assert [r.exit_code for r in metrics.weekly_gate(runs).collect()] == [2, 0]


XML = "<yandexsearch><response><results><grouping><group><doc><url>https://a.example/</url><title>T</title><passages><passage>p</passage></passages></doc></group><group><doc><title>no</title></doc></group></grouping></results></response></yandexsearch>"


def test_xml(spark):
    answers = [(1, XML), (2, base64.b64encode(XML.encode()).decode()), (3, "<broken"), (4, None)]
    got = serp.xml_results(spark.createDataFrame(answers, "k int, x string"), "x").collect()
    assert sorted((r.k, r.url, r.title, r.snippet, r.position) for r in got) == [(1, "https://a.example/", "T", "p", 1), (2, "https://a.example/", "T", "p", 1)]


def test_robots(spark):
    text = "User-agent: *\n  Disallow: /private\nDisallow:\nAllow: /x\nCrawl-delay: not_a_number"
    row = spark.createDataFrame([(text,)], "t string").select(serp.robots_rules(F.col("t")).alias("r")).first().r
    # Empty paths say nothing, as in the rules that the engine follows.
    assert row.disallow == ["/private"] and row.allow == ["/x"] and row.crawl_delay is None
    rules = F.array(F.lit("/*.pdf$"), F.lit(""))
    assert spark.range(1).select(serp.is_allowed(F.lit("/document.pdf"), rules), serp.is_allowed(F.lit("/a"), rules)).first()[:] == (False, True)


def test_sitemaps_lists_and_replies(spark):
    row = spark.range(1).select(
        serp.sitemap_urls(F.lit("<loc>https://a.example/x</loc><loc>https://a.example/y.pdf</loc><loc>https://a.example/y.PDF</loc><loc>a\nb</loc>")).alias("s"),
        serp.llm_contacts(F.lit('text {"emails": ["a@acme.example"]} text')).alias("a"),
        serp.llm_contacts(F.lit("[1]")).alias("b"),
        serp.search_type(F.lit("zz")).alias("t"),
        serp.localisation(F.lit("en")).alias("l"),
    ).first()
    assert row.s == ["https://a.example/x", "https://a.example/y.PDF"] and row.a.emails == ["a@acme.example"] and row.b.emails == []
    assert row.t == "SEARCH_TYPE_RU" and row.l == "LOCALIZATION_EN"


def test_reports_are_written_and_the_newest_two_read(spark, tmp_path):
    import os

    for k, rate in enumerate((10.0, 30.0, 20.0)):
        sinks.write_report(spark.createDataFrame([(rate, 5.0, k)], "with_contacts_rate double, zero_page_rate_in_run double, failures int"), str(tmp_path / "r"))
        fresh = [p for p in (tmp_path / "r").glob("*.json") if os.path.getmtime(p) > 2_000_000]
        for p in fresh:
            os.utime(p, (1_000_000 + 1000 * k, 1_000_000 + 1000 * k))
    got = {r.metric: (r.new, r.old, r.delta, r.trend) for r in metrics.newest_delta(sinks.newest_reports(spark, str(tmp_path / "r"))).collect()}
    assert got == {"with_contacts_rate": (20.0, 30.0, -10.0, "regressed"), "zero_page_rate_in_run": (5.0, 5.0, 0.0, "improved"), "failures": (2.0, 1.0, 1.0, "regressed")}


def test_xml_with_entities_is_not_read():
    bomb = '<!DOCTYPE r [<!ENTITY a "x"><!ENTITY b "&a;&a;">]><r><doc><url>&b;</url></doc></r>'
    assert serp.xml_rows(bomb) == [] and serp.xml_rows("<r><doc><url>u</url></doc></r>")[0]["url"] == "u"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None),
        ("plain", "plain"),
        ("x" * 700, "x" * 500),
        ('{"a": "{\\"token\\": \\"x\\"}"}', '{"a": {"token": "***REDACTED***"}}'),
        ('{"Authorization": ["x"], "b": "12"}', '{"Authorization": "***REDACTED***", "b": 12}'),
        ("[" * 100_000, "[" * 500),
    ],
)
def test_secrets(text, want):
    from webquarry.functions import documents

    assert documents.sanitised(text) == want


def test_new_keywords(spark):
    forms = spark.createDataFrame([(1, "a\nb\n\n<a>\nc"), (2, "c\nd")], "form_id int, text string")
    got = serp.new_keywords(forms, spark.createDataFrame([("b",)], "keyword string")).collect()
    assert sorted((r.keyword, r.form_id, r.pos) for r in got) == [("a", 1, 0), ("c", 1, 4), ("d", 2, 1)]


def test_host_merge_keeps_order(spark):
    known, new = spark.createDataFrame([(0, "B.example"), (1, "a.example")], "pos int, host string"), spark.createDataFrame([(0, "b.example"), (1, "c.example")], "pos int, host string")
    assert [r.host for r in sinks.merged_hosts(known, new).orderBy("part", "pos").collect()] == ["B.example", "a.example", "c.example"]


def test_csv_has_mark_and_delimiter(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, "x")], "n int, v string").coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text(encoding="utf-8") == "﻿n;v\n1;x\n"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from webquarry.bridge import table

    logs = table(spark, sf_dir, "crawl_logs").withColumn("crawled_at", F.col("crawled_at").cast("timestamp"))
    logs.select("crawled_at", "pages_crawled", "error_message").orderBy("crawled_at").coalesce(1).write.parquet(str(tmp_path / "logs"))
    stored = spark.read.parquet(str(tmp_path / "logs"))
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "logs"))
    q = rolling.rolling_quality(stream).writeStream.format("memory").queryName("quality").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT * FROM quality").collect())) == sorted(map(tuple, rolling.rolling_quality(stored).collect()))


def test_the_least_row_of_a_new_key_is_added(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("a", 1, "y"), ("b", 5, "z")], "k string, n int, v string")
    known = spark.createDataFrame([("b",)], "k string")
    assert [tuple(r) for r in sinks.append_new(rows, known, ["k"]).collect()] == [("a", 1, None)]
    assert [tuple(r) for r in sinks.append_new(rows, known, ["k"], ["v", "n"]).collect()] == [("a", 1, None)]
    assert [tuple(r) for r in sinks.append_new(rows.select("k"), known, ["k"]).collect()] == [("a",)]
