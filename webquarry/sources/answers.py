"""Folders of search answers in mixed formats, as tables and as streams, with a quarantine.

Files are read whole by Spark's binary source, so any file system that Spark reads will do; as
a stream, the source keeps the list of files that it has seen. Every file gets a kind and either
results or a reason: none is lost without one.

| Kind | What |
|---|---|
| ``json`` | an object with ``organic_results`` |
| ``list`` | a list of objects with ``href``, ``title``, ``body`` |
| ``xml`` | documents of an XML answer, plain, base64, or in an object's ``rawData`` |
| ``error`` | an object that carries an error and no data |

Empty results are results. A file that is no UTF-8, no JSON, no XML, of another form, or an
error is quarantined with its bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.sources import serp

FILES = "path string, modificationTime timestamp, length long, content binary"
RESULTS = "array<struct<url: string, title: string, snippet: string, position: int>>"


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All files below a folder: path, modificationTime, length, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def arriving(spark: SparkSession, path: str, most: int = 1000, glob: str | None = None) -> DataFrame:
    """The same as a stream, at most so many files in a micro-batch."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", most)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _xml(text: Column, most: int) -> Column:
    """Documents of XML answers; null where the text is no XML that is read."""

    @F.pandas_udf(RESULTS)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: serp.xml_documents(t, most))

    return parse(text)


def _items(text: Column, kind: str, names: tuple[str, str, str], most: int) -> Column:
    item = f"struct<{names[0]}: string, {names[1]}: string, {names[2]}: string>"
    listed = F.from_json(text, kind.format(item))
    listed = listed["organic_results"] if kind.startswith("struct") else listed
    return F.transform(F.slice(listed, 1, most), lambda x, i: F.struct(x[names[0]].alias("url"), x[names[1]].alias("title"), x[names[2]].alias("snippet"), (i + 1).cast("int").alias("position")))


def read(answers: DataFrame, most: int = 10) -> DataFrame:
    """Answers (path, content) with ``kind``, ``results`` (url, title, snippet, position) and ``reason``: of the latter two exactly one is null."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), r"^\x{FEFF}?\s+|^\x{FEFF}|\s+$", ""))
    rows = answers.withColumn("_text", text)
    first = F.substring("_text", 1, 1)
    data = F.coalesce(F.nullif(F.get_json_object("_text", "$.rawData"), F.lit("")), F.nullif(F.get_json_object("_text", "$.raw_data"), F.lit("")))
    form = (
        F.when(F.col("_text").isNull(), "other")
        .when(first == "{", F.when(F.try_parse_json("_text").isNull(), "broken").when(F.get_json_object("_text", "$.organic_results").startswith("["), "json").when(data.isNotNull(), "data").when(F.get_json_object("_text", "$.error").isNotNull(), "error").otherwise("other"))
        .when(first == "[", F.when(F.try_parse_json("_text").isNull(), "broken").otherwise("list"))
        .when(F.col("_text") == "", "other")
        .otherwise("xml")
    )
    rows = rows.withColumn("_form", form).withColumn("_data", F.when(F.col("_form") == "data", data).when(F.col("_form") == "xml", F.col("_text")))
    rows = rows.withColumn("_documents", _xml(F.col("_data"), most))
    found = F.when(F.col("_form") == "json", _items(F.col("_text"), "struct<organic_results: array<{}>>", ("link", "title", "snippet"), most)).when(F.col("_form") == "list", _items(F.col("_text"), "array<{}>", ("href", "title", "body"), most)).otherwise(F.col("_documents"))
    kind = F.when(F.col("_form").isin("xml", "data"), "xml").when(F.col("_form").isin("json", "list", "error"), F.col("_form"))
    told = F.coalesce(serp.answer_error(F.col("_text")), F.get_json_object("_text", "$.error"))
    reason = (
        F.when(F.col("_text").isNull(), F.when(F.col("content").isNull(), "no content").otherwise("no UTF-8"))
        .when(F.col("_text") == "", "empty")
        .when(F.col("_form") == "broken", "unreadable JSON")
        .when(F.col("_form") == "error", F.concat(F.lit("error: "), told))
        .when(F.col("_form") == "other", "no known form")
        .when(F.col("results").isNull(), "unreadable XML")
    )
    return rows.withColumn("results", found).withColumn("kind", kind).withColumn("reason", reason).drop("_text", "_form", "_data", "_documents")


def results(answers: DataFrame) -> DataFrame:
    """The results of read answers: path, kind, url, title, snippet, position."""
    return answers.where("reason IS NULL").select("path", "kind", F.explode("results").alias("r")).select("path", "kind", "r.url", "r.title", "r.snippet", "r.position")


def quarantined(answers: DataFrame) -> DataFrame:
    """Read answers without results, with their bytes: path, reason, content."""
    return answers.where("reason IS NOT NULL").select("path", "reason", "content")


def sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: results and quarantine of a micro-batch, in folders of its number, so that a repeated batch replaces its own."""

    def write(answers: DataFrame, number: int) -> None:
        rows = read(answers)
        results(rows).write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        quarantined(rows).write.mode("overwrite").parquet(f"{path}/quarantine/batch={number}")

    return write
