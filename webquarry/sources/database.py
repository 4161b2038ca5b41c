"""The seven tables in a relational database, read and written over JDBC.

Reads are cut into ranges of the integer key, between its least and greatest value, so that tasks
read side by side; conditions and columns go to the database as far as Spark's source can say
them. Schemas are declared, not inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_A_TASK = 1_000_000

#: Columns of the tables; texts that hold JSON are texts.
SCHEMAS = {
    "keywords": "id int, keyword string, language string, country string, is_processed boolean, last_crawled_at timestamp, created_at timestamp, updated_at timestamp",
    "search_results": "id int, keyword_id int, url string, title string, snippet string, position int, is_processed boolean, raw_search_query string, raw_search_response string, created_at timestamp",
    "domain_contacts": "id int, search_result_id int, domain string, tags string, metadata string, contacts_json string, extraction_method string, confidence_score int, is_verified boolean, created_at timestamp, updated_at timestamp",
    "contacts": "id int, domain_contact_id int, contact_type string, value string, is_verified boolean, verification_date timestamp, created_at timestamp",
    "crawl_logs": "id int, domain string, url string, status_code int, error_message string, pages_crawled int, duration_seconds int, llm_request string, llm_response string, llm_model string, crawled_at timestamp",
    "pipeline_state": "id int, run_id string, keyword_id int, status string, progress_percent int, websites_processed int, contacts_found int, started_at timestamp, updated_at timestamp, error_message string",
    "task_queue": "id int, task_name string, task_type string, payload string, status string, priority int, retry_count int, max_retries int, error_message string, result string, keyword_id int, depends_on_task_id int, created_at timestamp, started_at timestamp, completed_at timestamp, scheduled_for timestamp, locked_by string, locked_at timestamp",
}


def schema(table: str) -> T.StructType:
    """The declared schema of a table."""
    return T.StructType.fromDDL(SCHEMAS[table])


class Database:
    """A database by its JDBC address; ``options`` are those of Spark's source (driver, user, password, ...)."""

    def __init__(self, spark: SparkSession, url: str, **options: str) -> None:
        self.spark, self.url, self.options = spark, url, options

    def _reader(self):  # noqa: ANN202
        return self.spark.read.format("jdbc").option("url", self.url).options(**self.options)

    def bounds(self, table: str, key: str = "id") -> tuple[int | None, int | None, int]:
        """Least and greatest key and the number of rows, counted by the database."""
        return tuple(self._reader().option("dbtable", table).load().agg(F.min(key), F.max(key), F.count("*")).first())

    def read(self, table: str, key: str = "id", rows_a_task: int = ROWS_A_TASK, most: int = 1000) -> DataFrame:
        """A table in ranges of its key, of about ``rows_a_task`` rows, in its declared schema.

        The range of a key without order, such as that of random ids, is no worse than an ordered
        one. Rows without a key are in the first range.
        """
        low, high, count = self.bounds(table, key)
        reader = self._reader().option("dbtable", table).option("fetchsize", 10_000)
        tasks = max(1, min(most, -(-count // rows_a_task)))
        if low is not None and high > low and tasks > 1:
            reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high + 1).option("numPartitions", tasks)
        # One kind of casts for all databases, as each maps booleans and texts its own way.
        stored = reader.load()
        names = {c.lower(): c for c in stored.columns}
        return stored.select(*[stored[names[f.name.lower()]].cast(f.dataType).alias(f.name) if f.name.lower() in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(table).fields])

    def append(self, rows: DataFrame, table: str, tasks: int = 8) -> None:
        """Appends rows, by few connections."""
        rows.coalesce(tasks).write.format("jdbc").option("url", self.url).options(**self.options).option("dbtable", table).option("batchsize", 10_000).mode("append").save()
