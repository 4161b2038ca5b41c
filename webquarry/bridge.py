"""The seven logical tables of the engine, as views of the physical test tables.

Each is one SELECT that Spark and DuckDB read alike, so that the oracle SQL of a query is built
on the same mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "keywords": ("nation", """SELECT CAST(n_nationkey + 1 AS INT) AS id, lower(n_name) AS keyword,
 CASE n_regionkey WHEN 0 THEN 'ru' WHEN 1 THEN 'en' WHEN 2 THEN 'de' WHEN 3 THEN 'fr' ELSE 'kk' END AS language,
 CASE n_regionkey WHEN 0 THEN 'RU' WHEN 1 THEN 'US' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR' ELSE 'KZ' END AS country,
 n_nationkey % 3 <> 0 AS is_processed,
 TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * n_nationkey AS created_at FROM nation"""),
    "search_results": ("pages", """SELECT page_id AS id, CAST(page_id % 25 + 1 AS INT) AS keyword_id, url,
 regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
 CAST(floor(page_id / 25) AS INT) + 1 AS position FROM pages"""),
    "domain_contacts": ("documents", """SELECT doc_id AS id, doc_id % 40 AS search_result_id, concat(source, '.example.com') AS domain,
 CASE WHEN doc_id % 7 = 0 THEN 'llm' ELSE 'regex' END AS extraction_method,
 CAST((n_chars % 11) * 10 AS INT) AS confidence_score,
 TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (doc_id % 720) AS created_at FROM documents"""),
    "contacts": ("customer", """SELECT c_custkey AS id, c_custkey % 200 AS domain_contact_id,
 CASE c_custkey % 8 WHEN 0 THEN 'email' WHEN 1 THEN 'telegram' WHEN 2 THEN 'linkedin' WHEN 3 THEN 'phone'
   WHEN 4 THEN 'x' WHEN 5 THEN 'facebook' WHEN 6 THEN 'instagram' ELSE 'youtube' END AS contact_type,
 CASE c_custkey % 8 WHEN 0 THEN concat('c', CAST(c_custkey AS STRING), '@acme.example')
   WHEN 1 THEN concat('https://t.me/c', CAST(c_custkey AS STRING))
   WHEN 2 THEN concat('https://linkedin.com/company/c', CAST(c_custkey AS STRING))
   ELSE concat('v', CAST(c_custkey AS STRING)) END AS value,
 c_acctbal > 0 AS is_verified FROM customer"""),
    "crawl_logs": ("events", """SELECT event_id AS id, concat('src', CAST(user_id AS STRING), '.example.com') AS domain,
 CASE WHEN event_type = 'error' THEN 0 ELSE 200 END AS status_code,
 CASE WHEN event_type = 'error' THEN 0 ELSE CAST(event_id % 4 AS INT) END AS pages_crawled,
 CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'domain_timeout'
      WHEN event_type = 'error' THEN 'page_error:TimeoutError'
      WHEN event_id % 12 <> 0 AND event_id % 4 = 0 THEN 'http_fetch_empty' END AS error_message,
 CAST(floor(value) AS INT) AS duration_seconds, ts AS crawled_at FROM events"""),
    "task_queue": ("orders", """SELECT o_orderkey AS id,
 CASE o_orderkey % 3 WHEN 0 THEN 'search_keyword' WHEN 1 THEN 'crawl_domain' ELSE 'extract_contacts' END AS task_type,
 CASE WHEN o_orderpriority = '1-URGENT' OR o_custkey % 5 = 0 THEN 'completed' WHEN o_orderstatus = 'P' THEN 'pending'
      WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS status,
 CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority, CAST(o_orderkey % 4 AS INT) AS retry_count,
 3 AS max_retries, CAST(o_custkey % 25 + 1 AS INT) AS keyword_id,
 CASE WHEN o_orderkey % 100 = 1 THEN -1 WHEN o_orderkey % 3 <> 0 THEN o_orderkey - 1 END AS depends_on_task_id,
 CASE WHEN o_orderpriority <> '1-URGENT' AND o_custkey % 5 <> 0 AND o_orderstatus = 'O' THEN o_orderdate END AS locked_at,
 o_orderdate AS created_at FROM orders"""),
    "pipeline_state": ("conversations", """SELECT conv_id * 1000 + turn AS id, concat('run', CAST(conv_id % 10 AS STRING)) AS run_id,
 CASE WHEN turn = 0 THEN NULL ELSE CAST(conv_id % 25 + 1 AS INT) END AS keyword_id,
 CASE WHEN turn = 0 THEN 'started' WHEN length(text) % 3 = 0 THEN 'failed' WHEN length(text) % 3 = 1 THEN 'completed' ELSE 'processing' END AS status,
 CAST(length(text) % 5 AS INT) AS websites_processed, CAST(length(text) % 7 AS INT) AS contacts_found FROM conversations"""),
}


def physical(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table."""
    source, sql = TABLES[name]
    return spark.sql(sql.rsplit(" FROM ", 1)[0] + " FROM {source}", source=physical(spark, sf_dir, source))


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL over logical tables."""
    with_tables = ", ".join(f"{n} AS ({TABLES[n][1]})" for n in names)
    return f"WITH {with_tables} {sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {with_tables}, {sql.lstrip()[5:]}"
