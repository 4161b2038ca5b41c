"""Tables that are written together or not at all, with gapless ids.

Each commit writes a folder ``<table>/commit=<n>`` for every table and then one manifest
``_commits/<n>``; the manifest's appearance, a single rename that fails if the file is there, is the
commit. Readers see the folders that a manifest names and nothing else, so a writer that dies
between its tables leaves nothing behind that counts, and its next attempt writes the same
folders anew. A batch that has a manifest isn't written again.

Ids go on from the greatest id so far. Rows are sorted by ranges and the ranges' counts are
cumulated, so no task numbers all rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webquarry.lineage import cut
from webquarry.sources import sinks


def with_ids(rows: DataFrame, start: int, *order: Column, tasks: int | None = None, name: str = "id") -> DataFrame:
    """``rows`` with the numbers start + 1, start + 2, ... in a total order; in as many ranges as the session shuffles to, or as told."""
    ranges = rows.repartitionByRange(tasks, *order) if tasks else rows.repartitionByRange(*order)
    parts = cut(ranges.withColumn("_range", F.spark_partition_id()))
    # A row a range.
    counts = parts.groupBy("_range").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = parts.withColumn("_rank", rank).join(F.broadcast(starts), "_range")
    return numbered.select((F.col("_start") + F.col("_rank") + F.lit(start)).cast("long").alias(name), *rows.columns)


class PairedTables:
    """Tables under one path, read and committed together."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def commits(self) -> list[dict]:
        """The manifests in order: number, batch, greatest id of each table. One small file a commit."""
        system, at = self._file("_commits")
        if not system.exists(at):
            return []
        jvm, out = self.spark.sparkContext._jvm, []
        for status in system.listStatus(at):
            name = status.getPath().getName()
            if name.isdigit():
                stream = system.open(status.getPath())
                out.append(json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
                stream.close()
        return sorted(out, key=lambda m: m["number"])

    def read(self, table: str, schema: str) -> DataFrame:
        """The committed rows of a table."""
        numbers = [m["number"] for m in self.commits()]
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, commit int").parquet(f"{self.path}/{table}").where(F.col("commit").isin(numbers)).drop("commit")

    def commit(self, batch: str, make: Callable[[dict[str, int]], dict[str, DataFrame]]) -> bool:
        """Writes the tables that ``make(greatest ids so far)`` returns as one commit; False if the batch has one already."""
        done = self.commits()
        if any(m["batch"] == batch for m in done):
            return False
        number = 1 + max((m["number"] for m in done), default=0)
        last = dict(done[-1]["last"]) if done else {}
        for table, rows in make(dict(last)).items():
            at = f"{self.path}/{table}/commit={number}"
            rows.write.mode("overwrite").parquet(at)
            greatest = self.spark.read.schema(rows.schema).parquet(at).agg(F.max("id")).first()[0]
            last[table] = max(last.get(table, 0), greatest or 0)
        system, at = self._file(f"_commits/{number}")
        _, new = self._file(f"_commits/.{number}.new")
        stream = system.create(new, True)
        stream.write(bytearray(json.dumps({"number": number, "batch": batch, "last": last}).encode()))
        stream.close()
        # A rename onto a file that is there fails: another writer was first.
        if not system.rename(new, at):
            raise RuntimeError(f"commit {number} was made by another writer")
        return True


DOMAINS = "id long, search_result_id long, domain string, tags array<string>, confidence_score int, extraction_method string"
CONTACTS = "id long, domain_contact_id long, contact_type string, value string"


def contact_tables(found: DataFrame, last: dict[str, int]) -> dict[str, DataFrame]:
    """Both contact tables of extractions (search_result_id, domain, tags, confidence_score, extraction_method, info), with new ids; those without contacts aren't stored.

    Domains are numbered by search result and domain, contacts by domain id, type and value.
    """
    order = [F.col("search_result_id"), F.col("domain"), F.xxhash64("tags", "confidence_score", "extraction_method", F.to_json("info"))]
    kept = cut(with_ids(sinks.saved(found), last.get("domain_contacts", 0), *order))
    contacts = sinks.contact_rows(kept)
    numbered = with_ids(contacts, last.get("contacts", 0), F.col("domain_contact_id"), F.col("contact_type"), F.col("value"))
    return {"domain_contacts": kept.drop("info"), "contacts": numbered}


def contacts_sink(tables: PairedTables, name: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: each micro-batch of extractions as one commit, once however often it is tried."""

    def write(found: DataFrame, number: int) -> None:
        tables.commit(f"{name}-{number}", lambda last: contact_tables(found, last))

    return write
