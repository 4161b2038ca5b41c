"""A table in files whose rows are found by their key, changed batch by batch.

A key has one row, or several, as logs of a host have; what a batch does with them is its change.

Rows lie in folders by a hash of their key. A batch reads and writes only the folders of its own
keys (dynamic partition overwrite); the others' files stay as they are. It can be repeated after a
failure at any point:

1. The changed folders' whole new contents are written aside, under the batch's id.
2. They are copied over the table's folders. A failure in between leaves the contents aside, and
   the next attempt of the batch copies them again without computing them anew.
3. The batch's id goes into the ledger; an id in the ledger isn't applied again.

One writer at a time: batches of one table follow each other, as those of a stream do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.sources import sinks

FOLDER = "key_folder"


class KeyedTable:
    """A keyed table of a schema at a path, with its folders ``rows``, ``aside`` and ``ledger``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], folders: int = 256) -> None:
        self.spark, self.path, self.schema, self.keys, self.folders = spark, path.rstrip("/"), schema, keys, folders

    def _file(self, name: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _there(self, name: str) -> bool:
        system, at = self._file(name)
        return system.exists(at)

    def folder(self) -> Column:
        """The folder of a row."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.folders)).cast("int").alias(FOLDER)

    def _stored(self) -> DataFrame:
        if not self._there("rows"):
            return self.spark.createDataFrame([], f"{self.schema}, {FOLDER} int")
        return self.spark.read.schema(f"{self.schema}, {FOLDER} int").parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        """All rows."""
        return self._stored().drop(FOLDER)

    def is_applied(self, batch: str) -> bool:
        """Whether the ledger has the batch."""
        return self._there(f"ledger/{batch}")

    def apply(self, batch: str, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Applies a batch with an id of its own: ``change(old, rows)`` are the new rows of all keys in the touched folders.

        Returns False, and does nothing, if the batch was applied before.
        """
        if self.is_applied(batch):
            return False
        aside = f"aside/{batch}"
        if not self._there(f"{aside}/_SUCCESS"):
            # At most ``folders`` numbers.
            touched = sorted(r[0] for r in rows.select(self.folder()).distinct().collect())
            old = self._stored().where(F.col(FOLDER).isin(touched)).drop(FOLDER)
            new = change(old, rows).select("*", self.folder())
            # Files of a folder come from one task.
            new.repartition(max(1, len(touched)), FOLDER).write.mode("overwrite").partitionBy(FOLDER).parquet(f"{self.path}/{aside}")
        if any(s.isDirectory() for s in self._listed(aside)):
            copied = self.spark.read.schema(f"{self.schema}, {FOLDER} int").parquet(f"{self.path}/{aside}")
            copied.repartition(FOLDER).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(f"{self.path}/rows")
        system, at = self._file(f"ledger/{batch}")
        system.mkdirs(at.getParent())
        system.create(at, True).close()
        system.delete(self._file(aside)[1], True)
        return True

    def _listed(self, name: str) -> list:
        system, at = self._file(name)
        return list(system.listStatus(at))


def newest(keys: tuple[str, ...], *order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A change for ``KeyedTable.apply``: whole rows replace those of their key; of several in a batch the greatest by ``order`` counts."""

    def change(old: DataFrame, rows: DataFrame) -> DataFrame:
        named = lambda df, new: df.select(*keys, F.struct(F.lit(new).alias("_new"), *[F.col(c) if new else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order]).alias("_rank"), F.struct(*old.columns).alias("_row"))
        both = named(old, False).union(named(rows, True))
        return both.groupBy(*keys).agg(F.max_by("_row", "_rank").alias("_row")).select("_row.*")

    return change


def appended(old: DataFrame, rows: DataFrame) -> DataFrame:
    """A change for ``KeyedTable.apply``: the rows are added."""
    return old.unionByName(rows)


def traced(*keys: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A change of logs (id, keys, crawled_at, ...): traces of a model go to the newest log of their key, and stay there."""

    def change(old: DataFrame, traces: DataFrame) -> DataFrame:
        own = ("llm_request", "llm_response", "llm_model")
        new = sinks.with_model_trace(old, traces, *keys)
        # A log without a new trace keeps its own.
        marked = new.where("llm_model IS NOT NULL").select("id", *[F.col(c).alias(f"_{c}") for c in own])
        kept = [F.when(F.col("_llm_model").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in old.columns]
        return old.join(marked, "id", "left").select(*kept)

    return change
