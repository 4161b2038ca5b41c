"""A training corpus from the documents, in five stages.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import bpe_prefix, decontaminate, icws_dedup, language_fusion, substring_dedup
from webquarry.llm.shared import cut, shared_folder, text_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Up to so many ids to drop are sent to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Tasks that a large class of near duplicates is dealt to.
SALTS = 16


def without(docs: DataFrame, gone: DataFrame, *key: Column) -> DataFrame:
    """The documents whose ``key`` isn't a row of ``gone`` (one column for each part of the key, nulls are equal)."""
    gone = cut(gone.distinct().toDF(*[f"gone{k}" for k in range(len(key))]))
    small = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    same = [part.eqNullSafe(F.col(f"gone{k}")) for k, part in enumerate(key)]
    return docs.join(F.broadcast(gone) if small else gone, reduce(and_, same), "left_anti").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or no language likely enough.

    Rows are told apart by 128 bits of hash of what the verdict depends on, not by their ids.
    """
    key = [F.xxhash64("text", "lang", "source").alias("h1"), F.xxhash64(F.lit(1), "text", "lang", "source").alias("h2")]
    found = language_fusion.identify(language_fusion.from_documents(docs, F.struct(*key)))
    return without(docs, found.where("NOT kept").select("id.h1", "id.h2"), *key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate class, of the document with the least id (null ids last).

    Classes are of texts (by 128 bits of hash), whatever their ids. Texts without a word are
    alike only with the same id and text.
    """
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.select("doc_id", *text_key(), worded.alias("worded")).groupBy("doc_id", "h1", "h2", "worded").agg(F.count("*").alias("n"))
    found = icws_dedup.text_classes(docs.where(worded)).select("h1", "h2", F.col("class_no").alias("class_id"))
    rows = cut(rows.join(found, ["h1", "h2"], "left"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    first = rows.where("worded").groupBy("class_id").agg(F.min(rank).alias("first"), F.count("*").alias("members")).where("members > 1")
    # A class may have a third of all rows, so the first of each is sent to several tasks.
    first = first.select("class_id", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    salted = rows.where("worded").withColumn("salt", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(SALTS)))
    gone = salted.join(first, ["class_id", "salt"]).where(rank != F.col("first")).select("doc_id", "h1", "h2")
    # Only rows that stand there several times are brought together with their texts.
    several = rows.where("n > 1").select("doc_id", "h1", "h2")
    key = [F.col("doc_id"), *text_key()]
    once = without(docs, gone.union(several), *key)
    kept = several.join(gone.toDF("g0", "g1", "g2"), F.col("doc_id").eqNullSafe(F.col("g0")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left_anti").toDF("k0", "k1", "k2")
    hashed = docs.select(*COLUMNS, *text_key())
    repeated = hashed.join(kept, F.col("doc_id").eqNullSafe(F.col("k0")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left_semi")
    return once.union(repeated.dropDuplicates(["doc_id", "h1", "h2"]).select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes windows of words that documents with smaller ids have; documents left without a word go."""
    kept = substring_dedup.dedup(docs, carried=("lang", "source")).where("NOT (n_removed > 0 AND n_removed = n_words)")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = decontaminate.contained(docs.withColumn("doc_id", F.struct(*text_key())), items)
    return without(docs, held.select("doc_id.h1", "doc_id.h2"), *text_key())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding them gives the text again."""
    return bpe_prefix.tokenized(docs, public_tokenizers.path(bpe_prefix.VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("contamination", contamination),
    ("tokens", tokens),
]

#: SQL expresses neither the language model nor the sampling of the near-duplicate stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's table goes when the next is written."""
    at, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            old = jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(conf).delete(old, True)
        before = f"{at}/{name}"
    return docs
