"""Rolling crawl quality over a stream of crawl logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.operators.metrics import is_timeout, rate


def rolling_quality(logs: DataFrame, length: str = "24 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Crawls, empty crawls, timeouts and success rate in sliding windows of (crawled_at, pages_crawled, error_message).

    Works on streams and on batches alike; rows later than the watermark are dropped by streams.
    """
    rows = logs.withWatermark("crawled_at", late).groupBy(F.window("crawled_at", length, slide))
    counted = rows.agg(F.count("*").alias("crawls"), F.count_if(F.col("pages_crawled") == 0).alias("zero_page"), F.count_if(is_timeout(F.col("error_message"))).alias("timeouts"))
    success = rate(F.col("crawls") - F.col("zero_page"), F.col("crawls"), 100.0).alias("success_rate")
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "crawls", "zero_page", "timeouts", success)
