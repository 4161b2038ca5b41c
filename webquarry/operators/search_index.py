"""Search for a text anywhere in values, domains and keywords, by posting lists of trigrams.

A pattern's plain stretches give trigrams that every hit must have in one of its fields. The index
has, for each trigram, the rows and fields with it, in folders by the trigram's hash, and how
many there are. A search reads the counts of its trigrams, then only the folders of the rarest
ones, intersects their lists, and compares what is left with the pattern itself, so the
result is that of comparing all rows. Patterns without a stretch of three characters compare all
rows. The rows themselves lie in folders by their ids, of which only those with candidates are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("value", "domain", "keyword")
FOLDERS = 256
#: Trigrams of a pattern whose lists are read.
RAREST = 3
#: Up to so many candidates, their rows are read by folder and by a broadcast.
FEW = 100_000


def trigrams(pattern: str) -> list[str]:
    """The distinct trigrams, in lower case, of a pattern's plain stretches; % and _ are wild and a backslash makes the next character plain."""
    stretches, now = [], ""
    for one in re.findall(r"\\.|.", pattern, re.S):
        if one in ("%", "_"):
            stretches.append(now)
            now = ""
        else:
            now += one[-1]
    stretches.append(now)
    low = [s.lower() for s in stretches]
    return sorted({s[i : i + 3] for s in low for i in range(len(s) - 2)})


def matches(pattern: str) -> Column:
    """Whether any field has the pattern."""
    wild = f"%{pattern}%"
    tests = [F.coalesce(F.col(f).ilike(wild), F.lit(False)) for f in FIELDS]
    return tests[0] | tests[1] | tests[2]


class SearchIndex:
    """An index of contact rows (contact_id and ``FIELDS`` at least) at a path.

    ``folders`` and ``files``, the files of a folder of rows, set how much a search reads and a
    task writes; a large table wants more of both.
    """

    def __init__(self, spark: SparkSession, path: str, folders: int = FOLDERS, files: int = 1) -> None:
        self.spark, self.path, self.folders, self.files = spark, path.rstrip("/"), folders, files

    def _folder(self, column: str) -> Column:
        kind = "long" if column == "contact_id" else "string"
        return F.pmod(F.xxhash64(F.col(column).cast(kind)), F.lit(self.folders)).cast("int").alias("folder")

    def build(self, rows: DataFrame) -> None:
        """Writes rows, lists and counts. A trigram that many rows have is written by several tasks."""
        own = F.pmod(F.xxhash64(F.lit(1), "contact_id"), F.lit(self.files))
        rows.select("*", self._folder("contact_id")).repartition("folder", own).write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/rows")
        fields = F.array(*[F.struct(F.lit(k).alias("field"), F.lower(f).alias("t")) for k, f in enumerate(FIELDS)])
        each = rows.select("contact_id", F.explode(fields).alias("f")).select("contact_id", "f.field", "f.t").where("length(t) >= 3")
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring(F.col("t"), i, F.lit(3))))
        lists = each.select(F.explode(grams).alias("gram"), "field", "contact_id").select("*", self._folder("gram"))
        salt = F.pmod(F.xxhash64("contact_id"), F.lit(16))
        lists.repartition("folder", salt).sortWithinPartitions("gram", "contact_id").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/lists")
        counts = self.spark.read.parquet(f"{self.path}/lists").groupBy("gram").agg(F.count("*").alias("n"))
        counts.select("*", self._folder("gram")).repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/counts")

    def _of(self, table: str, grams: list[str]) -> DataFrame:
        """Rows of a table of some trigrams, of their folders only."""
        own = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(self._folder("gram")).distinct().collect()]
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col("folder").isin(own) & F.col("gram").isin(grams))

    def candidates(self, pattern: str) -> DataFrame | None:
        """Ids of rows that may match; None if all may."""
        grams = trigrams(pattern)
        if not grams:
            return None
        # A row for each trigram of the pattern at most.
        known = {r.gram: r.n for r in self._of("counts", grams).select("gram", "n").collect()}
        if len(known) < len(grams):
            return self.spark.createDataFrame([], "contact_id long")
        rarest = sorted(grams, key=lambda g: (known[g], g))[:RAREST]
        found = self._of("lists", rarest).groupBy("contact_id", "field").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest))
        return found.select("contact_id").distinct()

    def search(self, pattern: str, contact_type: str | None = None) -> DataFrame:
        """The rows with the pattern in a field, of one type or of all."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        some = self.candidates(pattern)
        if some is not None:
            few = [r[0] for r in some.limit(FEW + 1).collect()]
            if len(few) <= FEW:
                ids = self.spark.createDataFrame([(i,) for i in few], "contact_id long")
                own = sorted(r[0] for r in ids.select(self._folder("contact_id")).distinct().collect())
                rows = rows.where(F.col("folder").isin(own)).join(F.broadcast(ids), "contact_id", "left_semi")
            else:
                rows = rows.join(some, "contact_id", "left_semi")
        kind = F.lit(True) if contact_type is None else F.col("contact_type") == contact_type.lower()
        return rows.where(matches(pattern) & kind).drop("folder")
