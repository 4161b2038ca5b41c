"""Sharding by Hilbert-curve order.

Every row gets a position on a Hilbert curve over four quantised metadata dimensions
(language, source, size class, id range); runs of that order are the shards, so that a
shard's files cover a small box of the metadata space and can be pruned by min/max on any
of the dimensions.

The curve is never sorted in one place. A curve cell is one of at most 2**(4*bits) boxes,
whatever the input; the cells are counted, ordered and cumulated (a table of bounded size),
each cell is split by a hash of the row into chunks of about ``chunk_rows`` rows, and a row's
global position is: rows in earlier cells + rows in earlier chunks of its cell + its rank in
its chunk. A source that holds a third of all rows is thus only more chunks. Rows that are equal in
all that ``shard`` returns are one row with a number until they have their positions, and large
numbers of them are listed by several tasks. (``write``, which moves whole rows, chunks by
their contents only.)

Defined results: null ids, languages, sources and sizes have the code 0 of their own; ids are any
64-bit numbers; a null text has size 8 and the checksum of no bytes; repeated rows each get a
slot, rows of one id are ordered by their texts' checksum and size; an empty table gives an
empty result; other columns of the input are ignored, and kept by ``write``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webquarry.llm.shared import cut

BITS = 4
SHARDS = 24
CHUNK_ROWS = 20_000
FILE_ROWS = 1_000_000
#: Equal rows that one task lists.
COPIES = 10_000
DIMS = ("q_lang", "q_source", "q_size", "q_id")
KEYS = ("doc_id", "source", "lang", "n_chars", "text_crc32", "_bytes")


def _frequent_values(docs: DataFrame, name: str, codes: int) -> list[str]:
    """The most frequent values, at most ``codes``; ties by value."""
    counted = docs.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).count()
    return [r["v"] for r in counted.orderBy(F.desc("count"), "v").limit(codes).collect()]


def _category_code(name: str, values: list[str], codes: int) -> Column:
    """0 for null, 1.. by frequency, and the last code for all further values."""
    c = F.col(name)
    code = F.lit(codes - 1)
    for i, v in reversed(list(enumerate(values))):
        code = F.when(c == F.lit(v), F.lit(i + 1)).otherwise(code)
    return F.when(c.isNull(), F.lit(0)).otherwise(code).cast("int")


def quantised(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The documents with the four dimension codes, each in 0 .. 2**bits - 1."""
    codes = 1 << bits
    langs = _frequent_values(docs, "lang", codes - 2)
    sources = _frequent_values(docs, "source", codes - 2)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, 0) if low is None else (int(low), int(high))
    # As floating-point numbers, whose difference can't overflow; ranges are in order all the same.
    width = float((high - low) // (codes - 1) + 1)
    id_range = F.least(F.floor((F.col("doc_id").cast("double") - F.lit(float(low))) / F.lit(width)).cast("int") + 1, F.lit(codes - 1))
    size_class = F.length(F.bin(F.greatest(F.col("n_chars"), F.lit(0)).cast("long")))
    return docs.select(
        "*",
        _category_code("lang", langs, codes).alias("q_lang"),
        _category_code("source", sources, codes).alias("q_source"),
        F.when(F.col("n_chars").isNull(), 0).otherwise(F.least(size_class, F.lit(codes - 1))).cast("int").alias("q_size"),
        F.when(F.col("doc_id").isNull(), 0).otherwise(id_range).cast("int").alias("q_id"),
    )


def hilbert_index(dims: list[str], bits: int) -> Column:
    """The index on the Hilbert curve of the integer coordinates ``dims``.

    The published transpose algorithm as folds over an array of the coordinates: undo the
    excess work of each bit plane, Gray-encode, then interleave the bits.
    """
    n = len(dims)
    one_step = """
        transform(x, (v, j) ->
            CASE WHEN (x[s % {n}] & shiftleft(1, {top} - s div {n})) != 0
                 THEN IF(j = 0, v ^ (shiftleft(1, {top} - s div {n}) - 1), v)
                 WHEN j = 0 OR j = s % {n}
                 THEN v ^ ((x[0] ^ x[s % {n}]) & (shiftleft(1, {top} - s div {n}) - 1))
                 ELSE v END)""".format(n=n, top=bits - 1)
    unfolded = f"aggregate(sequence(0, {(bits - 1) * n - 1}), array({', '.join(dims)}), (x, s) -> {one_step})"
    xored = f"aggregate({unfolded}, array(0), (a, v) -> array_append(a, a[size(a) - 1] ^ v), a -> slice(a, 2, {n}))"
    flip = f"aggregate(sequence(1, {bits - 1}), 0, (t, p) -> IF((x[{n - 1}] & shiftleft(1, p)) != 0, t ^ (shiftleft(1, p) - 1), t))"
    flipped = f"transform(array({xored}), x -> transform(x, v -> v ^ {flip}))[0]"
    digit = f"shiftleft(CAST(shiftright(x[d % {n}], d div {n}) & 1 AS BIGINT), (d div {n}) * {n} + {n - 1} - d % {n})"
    return F.expr(f"transform(array({flipped}), x -> aggregate(sequence(0, {bits * n - 1}), 0L, (h, d) -> h + {digit}))[0]")


def positions(docs: DataFrame, bits: int = BITS, chunk_rows: int = CHUNK_ROWS, once: bool = False) -> tuple[DataFrame, int]:
    """The quantised documents (with text_crc32 and _bytes) with ``h`` and the gapless global position ``pos``, and the row count.

    ``once``: equal rows are one row, with their number ``_n`` and the position of the first.
    """
    rows = quantised(docs, bits).withColumn("_hash", F.xxhash64(*KEYS))
    rows = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))) if once else rows.withColumn("_n", F.lit(1).cast("long"))
    chunks = F.ceil(F.count("*") / chunk_rows).alias("chunks")
    cells = rows.groupBy(*DIMS).agg(F.sum("_n").alias("cell_rows"), chunks).withColumn("h", hilbert_index(list(DIMS), bits))
    # At most 2**(4*bits) rows, whatever the input.
    cells = cells.withColumn("cell_start", F.sum("cell_rows").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)))
    cells = cells.select(*DIMS, "h", "cell_rows", F.coalesce("cell_start", F.lit(0)).alias("cell_start"), "chunks")
    total = cells.agg(F.coalesce(F.sum("cell_rows"), F.lit(0))).first()[0]
    rows = rows.join(F.broadcast(cells.drop("cell_rows")), list(DIMS)).withColumn("chunk", F.pmod("_hash", F.col("chunks")))
    chunks = rows.groupBy("h", "chunk").agg(F.sum("_n").alias("chunk_rows"))
    before = Window.partitionBy("h").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("h", "chunk", F.coalesce(F.sum("chunk_rows").over(before), F.lit(0)).alias("chunk_start"))
    earlier = Window.partitionBy("h", "chunk").orderBy("_hash", *KEYS).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(chunks, ["h", "chunk"])
    return rows.withColumn("pos", F.col("cell_start") + F.col("chunk_start") + F.col("_before")), int(total)


def _listed(rows: DataFrame) -> DataFrame:
    """Each of ``_n`` equal rows, with positions from ``pos`` on."""
    zero = F.lit(0).cast("long")
    few = rows.where(F.col("_n") <= COPIES).withColumn("_k", F.explode(F.sequence(zero, F.col("_n") - 1)))
    ranges = rows.where(F.col("_n") > COPIES).withColumn("_from", F.explode(F.sequence(zero, F.col("_n") - 1, F.lit(COPIES).cast("long"))))
    ranges = ranges.repartition(F.xxhash64("_hash", "_from"))
    many = ranges.withColumn("_k", F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES, F.col("_n")) - 1))).drop("_from")
    return few.union(many).withColumn("pos", F.col("pos") + F.col("_k"))


def _placed(docs: DataFrame, shards: int, bits: int, chunk_rows: int, whole: bool) -> tuple[DataFrame, int]:
    """The rows of ``positions`` with ``shard`` and ``slot``, ``whole`` with all columns as ``_row``; and the row count."""
    own = [F.col(c) for c in ("doc_id", "lang", "source", "n_chars")]
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32")
    wanted = docs.select(*own, F.octet_length("text").alias("_bytes"), crc, *([F.struct("*").alias("_row")] if whole else []))
    rows, total = positions(wanted, bits, chunk_rows, once=not whole)
    rows = rows if whole else _listed(rows)
    base, larger = divmod(total, shards)
    edge = larger * (base + 1)
    pos = F.col("pos")
    number = F.when(pos < edge, F.floor(pos / (base + 1))).otherwise(larger + F.floor((pos - edge) / max(base, 1)))
    slot = F.when(pos < edge, pos % (base + 1)).otherwise((pos - edge) % max(base, 1))
    return rows.withColumn("shard", number.cast("int")).withColumn("slot", slot.cast("long")), total


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Runs of the Hilbert order as shards 0 .. shards-1 with counts at most one apart.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard, the four codes and the
    curve index ``hilbert``.
    """
    rows, _ = _placed(docs, shards, bits, chunk_rows, whole=False)
    size = (F.coalesce("_bytes", F.lit(0)).cast("long") + 8).alias("size")
    grown = F.lit(None).cast("int").alias("grown_shard")
    return rows.select("doc_id", size, "text_crc32", F.lit("rows").alias("law"), "shard", "slot", grown, *DIMS, F.col("h").alias("hilbert"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS, chunk_rows: int = CHUNK_ROWS, file_rows: int = FILE_ROWS) -> None:
    """Writes ``docs`` in curve order, a folder for each shard with files of about ``file_rows`` rows.

    Every file is a run of the curve, so the least and greatest values in its footer prune it. The
    folders are named after a new column ``shard``, with underlines behind it if the table has
    one of that name.
    """
    rows, total = _placed(docs, shards, bits, chunk_rows, whole=True)
    name = "shard"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    files = max(shards, -(-total // file_rows))
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    runs = rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    runs.select(*own, F.col("shard").alias(name)).write.partitionBy(name).parquet(path)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards along the Hilbert curve."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_hilbert_shards": op1_hilbert_shards}
ORACLES: dict[str, str] = {}
