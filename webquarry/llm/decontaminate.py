"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

A document holds a test item if at least 0.8 of the item's distinct shingles, runs of five
words, are among the document's. Words are runs of letters and digits of the lower-cased text.

Items are partitioned by the size class of their shingle sets (powers of two). An item of q
shingles needs ceil(0.8 q) of them, so one of its q - ceil(0.8 q) + 1 shingles of least hash, its
bottom-k MinHash sketch, is in every document that holds it: however long the document is, the
search has no false negative, which a fixed-length signature of a long document could not
promise. Any one order of the shingles keeps that; shingles of more than COMMON items come behind all
others, as a template that many items share would make each document with it a candidate for
all of them. A document's shingles that are not above the highest sketch hash of a size class, and
are in a sketch, name the candidates, and the exact containment decides. Everything per
document stays in one row: the texts are never shuffled and shingles never exploded.

The sketches travel with the plan while there are at most SKETCH_MOST hashes (the items' sets,
at most five times as many, are then broadcast as well). Beyond that the documents' shingles are
joined with the sketches, which are sent to all tasks up to BROADCAST_HASHES, so that only hits
are shuffled; the shingles of documents with a hit are then counted by the same kind of join
with the items' sets. No row holds more than its own document's shingles in either way.

Defined results: null and short texts and items of fewer than five words match nothing;
repeated rows of a document or item give one row a pair; empty tables give an empty result;
further columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webquarry.llm.shared import cut

SHINGLE = 5
CONTAINMENT = 0.8
SKETCH_MOST = 20_000
#: Shingles of more items are the last to be in a sketch.
COMMON = 16
#: Rows of two longs each.
BROADCAST_HASHES = 4_000_000


def _words(text: str) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ", -1)


def shingled(table: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, more, shingles array<long>): hashes of the runs of five words, in text order; null texts have none. Keys are structs or longs."""
    own = F.col(key) if isinstance(table.schema[key].dataType, StructType) else F.col(key).cast("long")
    words = table.select(own.alias(key), *more, _words("text").alias("w"))
    runs = f"transform(sequence(1, size(w) - {SHINGLE - 1}), i -> xxhash64(slice(w, i, {SHINGLE})))"
    return words.select(key, *more, F.expr(f"IF(size(w) >= {SHINGLE}, {runs}, CAST(array() AS ARRAY<BIGINT>))").alias("shingles"))


def item_sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, own, q, needed, size_class, sketch) of every item with a shingle."""
    own = shingled(items, "item_id").select("item_id", F.array_sort(F.array_distinct("shingles")).alias("own")).where("size(own) > 0").distinct()
    q = F.size("own").alias("q")
    needed = F.ceil(F.size("own") * F.lit(containment) - 1e-9).cast("int").alias("needed")
    each = own.select("item_id", "own", F.explode("own").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("h", F.lit(1).alias("common"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("common", F.lit(0)).alias("common"), "h"))).alias("order")
    own = each.join(common, "h", "left").groupBy("item_id", "own").agg(order).select("item_id", "own", q, needed, "order")
    sketch = F.transform(F.expr("slice(order, 1, q - needed + 1)"), lambda x: x["h"]).alias("sketch")
    return own.select("item_id", "own", "q", "needed", F.floor(F.log2("q")).cast("int").alias("size_class"), sketch)


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, sketch_most: int = SKETCH_MOST) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every pair above the containment."""
    sketches = item_sketches(items, containment)
    classes = sketches.groupBy("size_class").agg(F.max(F.array_max("sketch")).alias("top"), F.min("needed").alias("least"), F.sum(F.size("sketch")).alias("hashes")).collect()
    few = sum(r["hashes"] for r in classes) <= sketch_most
    shared = (_in_rows if few else _by_joins)(docs, sketches, classes)
    best = shared.where("shared >= needed").groupBy("doc_id", "item_id").agg(F.max("q").alias("q"), F.max("shared").alias("shared"))
    return best.select("doc_id", "item_id", F.col("q").cast("long").alias("n_item_shingles"), F.col("shared").cast("long").alias("n_shared"), (F.col("shared") / F.col("q")).alias("containment"))


def _in_rows(docs: DataFrame, sketches: DataFrame, classes: list) -> DataFrame:
    """(doc_id, item_id, q, needed, shared) of the candidates, all work for a document in its row."""
    table = sketches.select(F.explode("sketch").alias("h"), "item_id")
    known = table.select("h").distinct().collect()
    texts = shingled(docs, "doc_id").select("doc_id", "shingles", _hits([r["h"] for r in known], classes).alias("hits"))
    # The outer form, and columns that can't be null: else the plan computes the hits once more to filter by them.
    none = F.expr("CAST(array() AS ARRAY<BIGINT>)")
    texts = texts.select("doc_id", F.coalesce(F.when(F.size("hits") > 0, F.col("shingles")), none).alias("shingles"), F.coalesce("hits", none).alias("hits"))
    rows = texts.select("*", F.explode_outer("hits").alias("h")).where("h IS NOT NULL")
    pairs = rows.join(F.broadcast(table), "h").join(F.broadcast(sketches.select("item_id", "own", "q", "needed", "sketch")), "item_id")
    # A pair once: at the least of the item's hashes that the document has.
    pairs = pairs.where(F.col("h") == F.array_min(F.array_intersect("sketch", "hits")))
    return pairs.select("doc_id", "item_id", "q", "needed", F.size(F.array_intersect("own", "shingles")).alias("shared"))


def _by_joins(docs: DataFrame, sketches: DataFrame, classes: list) -> DataFrame:
    """The same by joins of shingles; a document is known by its id and its text's hash."""

    def sent(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES else table

    texts = shingled(docs.withColumn("_text", F.xxhash64("text")), "doc_id", "_text")
    able = reduce(or_, [(F.size("shingles") >= r["least"]) for r in classes], F.lit(False))
    each = texts.where(able).select("doc_id", "_text", F.explode(F.array_distinct("shingles")).alias("h"))
    candidates = each.join(sent(sketches.select(F.explode("sketch").alias("h"), "item_id")), "h").select("doc_id", "_text", "item_id").distinct()
    candidates = cut(candidates.join(sketches.select("item_id", "q", "needed"), "item_id"))
    held = candidates.select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_of")).distinct()
    # Rows of one id and text are counted once.
    mine = each.join(held, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_of")), "left_semi").distinct()
    own = sent(sketches.select(F.explode("own").alias("h"), "item_id"))
    counted = mine.join(own, "h").groupBy(F.col("doc_id").alias("_doc"), F.col("_text").alias("_of"), F.col("item_id").alias("_item")).agg(F.count("*").cast("int").alias("shared"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_of")) & (F.col("item_id") == F.col("_item"))
    return candidates.join(counted, same).select("doc_id", "item_id", "q", "needed", "shared")


def _hits(hashes: list[int], classes: list) -> Column:
    """The distinct shingles of a document that are in a sketch of a size class it can hold."""
    if not hashes:
        return F.expr("CAST(array() AS ARRAY<BIGINT>)")

    def keep(x: Column) -> Column:
        tests = [(F.size("shingles") >= r["least"]) & (x <= r["top"]) for r in classes]
        return reduce(or_, tests) & x.isin(hashes)

    return F.array_distinct(F.filter("shingles", keep))


def op10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a test item that it holds."""
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
b AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
q AS (SELECT item_id, count(*) AS q FROM bs GROUP BY item_id)
SELECT doc_id, item_id, CAST(max(q) AS BIGINT) AS n_item_shingles, count(*) AS n_shared, count(*) / max(q) AS containment
FROM ds JOIN bs USING (s) JOIN q USING (item_id) GROUP BY doc_id, item_id
HAVING count(*) >= ceil(0.8 * max(q) - 1e-9)
"""

QUERIES = {"op10_containment": op10_containment}
ORACLES = {"op10_containment": ORACLE}
