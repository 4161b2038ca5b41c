"""Mixing sources to target weights.

The words of a source, its documents in the order of a hash, are a stream that is packed into
blocks of fixed length; only the last block of a source is shorter. A target of so many words of
a source is a number of slots: whole passes over its blocks, and a pass that ends within a block.
Each slot of an output shard draws its source at random, so that the counts of a shard are
multinomial; as free draws miss the targets, the slots that a source has drawn beyond its own go
to the sources that have drawn too few. The slots of a source are numbered, the number is mapped
through a pseudorandom permutation of the source's blocks (another one for each pass), and slots
and documents meet by the block's index.

Targets are the weights' shares of all words, but three times a source's words at most; what is
beyond that is shared again by weight. They are met to half a word, and no word is taken more
than three times.

The permutation is a swap-or-not shuffle, a bijection of 0 .. n-1 for any n. All numbers are
hashes of what the rows hold, so reruns and other partitionings agree.

No task gets all rows of a source: running sums go over chunks of ``CHUNK_ROWS`` rows by hash and
then over the chunks, equal rows are one row with a count, and the table of sources is summed by
ranges. It is broadcast if it has few rows only.

Defined results: a null text has size 0; rows of size 0 are in no block and are taken 0 times;
null sources are one source, the last; null ids are ids of their own; repeated rows each get a
result; sources without words have the target 0; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webquarry.llm.shared import cut, text_key

WEIGHTS = (1, 2, 3)
#: A target's most, in times of its source's size.
MOST = 3
BLOCK_WORDS = 1024
SHARD_SLOTS = 1 << 16
CHUNK_ROWS = 2_000
SEED = 20240229
#: Tables of so many rows are sent to all tasks.
BROADCAST_ROWS = 100_000
#: Copies that one task lists.
COPIES = 1_000
SWAPS = 40
WORD = r"[^\x20\x09-\x0D]+"


def permuted(x: Column, n: Column, key: Column, rounds: int = SWAPS, back: bool = False) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 .. n-1 (``back``: which number has the place ``x``).

    In each round a number and its mirror image at a random axis change places or don't, by a
    hash of the larger of both; each round is its own inverse.
    """
    steps = F.sequence(F.lit(rounds - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(rounds - 1))

    def step(v: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - v, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(v, other)), F.lit(2)) == 1, other).otherwise(v)

    return F.aggregate(steps, x.cast("long"), step)


def running(df: DataFrame, order: list[Column], tasks: int = 64, **values: Column) -> DataFrame:
    """``df`` with the sums of ``values`` over all rows before, in a total order; the ranges of the order are summed apart."""
    parts = df.select("*", *[v.alias(f"_{k}") for k, v in values.items()]).repartitionByRange(tasks, *order)
    parts = cut(parts.withColumn("_range", F.spark_partition_id()))
    sums = parts.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_all_{k}") for k in values])
    # A row a range.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", *[F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_at_{k}") for k in values])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.join(F.broadcast(starts), "_range")
    found = [(F.col(f"_at_{k}") + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0))).alias(k) for k in values]
    return rows.select(*df.columns, *found)


def _near(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def sized(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, source, text) without their texts: equal rows once with their number ``n``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return docs.select("doc_id", "source", size, *text_key()).groupBy("doc_id", "source", "size", "h1", "h2").agg(F.count("*").alias("n"))


def targets(rows: DataFrame) -> tuple[DataFrame, int]:
    """The sources of ``sized`` rows with rank, weight, words, groups (of equal rows) and target; and how many they are."""
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count("*").alias("groups"))
    ranked = running(sums, [F.asc_nulls_last("source")], rank=F.lit(1).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")
    ranked = cut(ranked.withColumn("weight", weight))
    count, total = ranked.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    # Each round some more sources are at their most; what they leave is shared by the weights of the others.
    level, full = 0.0, None
    while True:
        at_most = F.col("words") * MOST <= F.col("weight") * F.lit(level)
        now = ranked.agg(F.coalesce(F.sum(F.when(at_most, F.col("words") * MOST)), F.lit(0)), F.coalesce(F.sum(F.when(~at_most, F.col("weight"))), F.lit(0))).first()
        if not now[1] or now == full:
            break
        full, level = now, (total - now[0]) / now[1]
    target = F.least((F.col("words") * MOST).cast("double"), F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target), count


def plan(sources: DataFrame) -> DataFrame:
    """The sources with their blocks, the words wanted (``wanted``), slots, and the words of a last slot that ends early (``last``)."""
    b, words = F.lit(BLOCK_WORDS), F.col("words")
    rows = sources.where("words > 0").withColumn("wanted", F.round("target").cast("long"))
    rows = rows.select("*", F.expr("wanted div words").alias("passes"), F.expr(f"(words + {BLOCK_WORDS - 1}) div {BLOCK_WORDS}").alias("blocks"))
    rows = rows.select("*", (F.col("wanted") - F.col("passes") * words).alias("need"), (words - (F.col("blocks") - 1) * b).alias("tail"))
    rows = rows.withColumn("tail_at", permuted(F.col("blocks") - 1, F.col("blocks"), _key(F.col("rank"), F.col("passes")), back=True))
    plain = F.expr(f"(need + {BLOCK_WORDS - 1}) div {BLOCK_WORDS}")
    short = F.expr(f"(need + {BLOCK_WORDS} - tail + {BLOCK_WORDS - 1}) div {BLOCK_WORDS}")
    rows = rows.withColumn("rest", F.when(plain <= F.col("tail_at"), plain).otherwise(short))
    before = (F.col("rest") - 1) * b - F.when(F.col("tail_at") < F.col("rest") - 1, b - F.col("tail")).otherwise(0)
    rows = rows.withColumn("rest", F.when(F.col("need") == 0, 0).otherwise(F.col("rest")).cast("long")).withColumn("last", F.when(F.col("need") > 0, F.col("need") - before))
    return rows.select("rank", "source", "words", "target", "wanted", "blocks", "tail", "last", (F.col("passes") * F.col("blocks") + F.col("rest")).alias("slots"))


def _key(rank: Column, passes: Column) -> Column:
    return F.xxhash64(F.lit(SEED), rank, passes)


def drawn(sources: DataFrame, count: int) -> DataFrame:
    """Slots of all shards: shard, rank, number (of the slot among its source's), and the source's blocks, tail, last and slots."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    # Sources as intervals of 0 .. total-1. Draws find theirs by hash join: by the stretch of the line that both lie in.
    line = cut(running(sources.where("slots > 0"), [F.col("rank")], start=F.col("slots")))
    stretches = max(4096, count)
    width = -(-total // stretches) or 1
    places = line.select("rank", "start", "slots", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + slots - 1) div {width}"))).alias("stretch"))
    draws = spark.range(total).select(F.expr(f"id div {SHARD_SLOTS}").alias("shard"), F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(max(total, 1))).alias("x"))
    draws = draws.withColumn("stretch", F.expr(f"x div {width}"))
    counts = draws.join(_near(places, stretches + count), "stretch").where("x >= start AND x < start + slots").groupBy("shard", "rank").agg(F.count("*").alias("drawn"))
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select("*", F.coalesce(F.sum("drawn").over(earlier), F.lit(0)).alias("first")))
    own = ["rank", "blocks", "tail", "last", "slots"]
    numbers = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("drawn") - 1)).alias("number")
    slots = counts.join(_near(line.select(*own), count), "rank").select("shard", *own, numbers)
    # Draws beyond a source's slots, and slots that no draw has met: as many, joined one to one.
    got = counts.groupBy("rank").agg(F.sum("drawn").alias("got"))
    both = line.join(got, "rank", "left").select(*own, F.coalesce("got", F.lit(0)).alias("got"))
    both = cut(running(both, [F.col("rank")], over_at=F.greatest(F.col("got") - F.col("slots"), F.lit(0)), under_at=F.greatest(F.col("slots") - F.col("got"), F.lit(0))))
    over = slots.where("number >= slots").join(_near(both.where("got > slots").select("rank", "over_at"), count), "rank")
    over = over.select("shard", (F.col("over_at") + F.col("number") - F.col("slots")).alias("d"))
    under = both.where("got < slots").select(*own, F.posexplode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("k", "number"), "under_at")
    settled = under.select(*own, "number", (F.col("under_at") + F.col("k")).alias("d")).join(over, "d").select("shard", *own, "number")
    return slots.where("number < slots").union(settled)


def filled(slots: DataFrame) -> DataFrame:
    """Slots with the ``block`` that each takes and how many of its words (``taken``)."""
    passes = F.expr("number div blocks")
    rows = slots.withColumn("block", permuted(F.col("number") % F.col("blocks"), F.col("blocks"), _key(F.col("rank"), passes)))
    whole = F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(F.lit(BLOCK_WORDS))
    ends = (F.col("number") == F.col("slots") - 1) & F.col("last").isNotNull()
    return rows.select("shard", "rank", "number", "block", F.when(ends, F.col("last")).otherwise(whole).cast("long").alias("taken"))


def placed(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """Each copy of the ``sized`` rows with its source's rank and the place ``at`` of its first word in the source's stream."""
    known = sources.select(F.col("source").alias("_source"), "rank", F.ceil(F.col("groups") / CHUNK_ROWS).alias("chunks"))
    hashed = rows.withColumn("_hash", F.xxhash64(F.lit(SEED), "doc_id", "h1", "h2", "size"))
    found = hashed.join(_near(known, count), hashed["source"].eqNullSafe(known["_source"])).drop("_source")
    found = found.withColumn("chunk", F.pmod("_hash", F.col("chunks")))
    words = F.sum(F.col("size") * F.col("n"))
    earlier = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = found.groupBy("rank", "chunk").agg(words.alias("w")).select("rank", "chunk", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("chunk_at"))
    inside = Window.partitionBy("rank", "chunk").orderBy("_hash", "doc_id", "h1", "h2", "size").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("row_at", F.coalesce(words.over(inside), F.lit(0))).join(chunks, ["rank", "chunk"])
    own = ["doc_id", "source", "size", "h1", "h2", "rank", (F.col("chunk_at") + F.col("row_at")).alias("at")]
    # Many equal rows are listed by several tasks.
    few = found.where(F.col("n") <= COPIES).select(*own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    ranges = found.where(F.col("n") > COPIES).select(*own, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("c"))
    ranges = ranges.repartition(F.xxhash64("h1", "doc_id", "c"))
    many = ranges.select(*[c for c in few.columns if c != "copy"], F.explode(F.sequence("c", F.least(F.col("c") + COPIES, F.col("n")) - 1)).alias("copy"))
    return few.union(many).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))


def spans(copies: DataFrame) -> DataFrame:
    """The parts of each copy that lie in one block: block, the part's place in it (``inner``), its first word and words; copies of size 0 have one in no block."""
    b = F.lit(BLOCK_WORDS).cast("long")
    # Blocks that don't exist are many, so that no task gets all empty rows.
    none = F.array(-1 - F.pmod(F.xxhash64("doc_id", "h1", "copy"), F.lit(1 << 20)))
    listed = F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {BLOCK_WORDS}"), F.expr(f"(at + size - 1) div {BLOCK_WORDS}"))).otherwise(none)
    rows = copies.withColumn("block", F.explode(listed))
    first = F.greatest(F.col("at"), F.col("block") * b)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b)
    real = F.col("block") >= 0
    return rows.select("*", F.when(real, first - F.col("block") * b).otherwise(0).alias("inner"), F.when(real, first - F.col("at")).otherwise(0).alias("first"), F.when(real, end - first).otherwise(0).alias("span"))


class Mixture:
    """The mix of a table of documents (doc_id, source, text)."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs
        self.rows = cut(sized(docs))
        sources, self.count = targets(self.rows)
        self.sources = cut(sources)
        self.plan = cut(plan(self.sources))
        self.slots = filled(drawn(self.plan, self.count))
        self.copies = placed(self.rows, self.sources, self.count)

    def parts(self) -> DataFrame:
        """What the slots hold: shard, rank, number, place (in the slot), doc_id, h1, h2, copy, first, words."""
        own = spans(self.copies).where("span > 0").join(self.slots, ["rank", "block"]).where("inner < taken")
        return own.select("shard", "rank", "number", F.col("inner").alias("place"), "doc_id", "h1", "h2", "size", "copy", "first", F.least(F.col("span"), F.col("taken") - F.col("inner")).alias("words"))

    def taken(self) -> DataFrame:
        """Each row of the documents: doc_id, size, source_size, target, taken."""
        # A block's slots as a row: those that take all of it, and the one that ends early.
        whole = F.when(F.col("block") == F.col("blocks") - 1, F.col("tail")).otherwise(F.lit(BLOCK_WORDS))
        ends = self.slots.join(_near(self.plan.select("rank", "blocks", "tail"), self.count), "rank")
        blocks = ends.groupBy("rank", "block").agg(F.count_if(F.col("taken") == whole).alias("times"), F.coalesce(F.max(F.when(F.col("taken") < whole, F.col("taken"))), F.lit(0)).alias("early"))
        met = spans(self.copies).join(blocks, ["rank", "block"], "left")
        words = F.col("span") * F.col("times") + F.greatest(F.lit(0), F.least(F.col("span"), F.col("early") - F.col("inner")))
        each = met.groupBy("rank", "doc_id", "h1", "h2", "size", "copy").agg(F.sum(F.coalesce(words, F.lit(0))).alias("taken"))
        named = self.sources.select("rank", F.col("words").alias("source_size"), "target")
        return each.join(_near(named, self.count), "rank").select("doc_id", "size", "source_size", "target", "taken")

    def texts(self) -> DataFrame:
        """The slots' texts: shard, slot (its place in the shard), source, words, text (words joined by one space)."""
        key = [self.docs["doc_id"].alias("_id"), *[k.alias(f"_{n}") for k, n in zip(text_key(), ("h1", "h2"), strict=True)]]
        texts = self.docs.select("text", *key).dropDuplicates(["_id", "_h1", "_h2"]).withColumn("w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
        listed = self.parts().groupBy("doc_id", "h1", "h2").agg(F.collect_set(F.struct("first", "words")).alias("cuts"))
        own = listed.join(texts, listed["doc_id"].eqNullSafe(texts["_id"]) & (listed["h1"] == texts["_h1"]) & (listed["h2"] == texts["_h2"]))
        cuts = own.select("doc_id", "h1", "h2", "w", F.explode("cuts").alias("c")).select("doc_id", "h1", "h2", "c.first", "c.words", F.array_join(F.slice("w", (F.col("c.first") + 1).cast("int"), F.col("c.words").cast("int")), " ").alias("t"))
        keys = ["doc_id", "h1", "h2", "first", "words"]
        cuts = cuts.toDF(*[f"c_{k}" for k in keys], "t")
        parts = self.parts()
        same = [parts[k].eqNullSafe(cuts[f"c_{k}"]) for k in keys]
        joined = parts.join(cuts, same[0] & same[1] & same[2] & same[3] & same[4])
        # A slot has at most BLOCK_WORDS parts.
        slots = joined.groupBy("shard", "rank", "number").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("place", "t"))).alias("p"))
        place = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED), "rank", "number"), "rank", "number")) - 1
        named = self.sources.select("rank", "source")
        rows = slots.select("shard", place.cast("long").alias("slot"), "rank", "words", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"))
        return rows.join(_near(named, self.count), "rank").select("shard", "slot", "source", "words", "text")


def op12_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return Mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()


QUERIES = {"op12_source_mixture": op12_source_mixture}
#: SQL has none of the hashes; the sizes and targets are checked against SQL in the tests.
ORACLES: dict[str, str] = {}
