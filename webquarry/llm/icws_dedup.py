"""Near-duplicate classes by improved consistent weighted sampling (ICWS) of TF-IDF shingles.

A text is the weighted set of its runs of five lower-cased words (of all its words, if it has
fewer): weight = term frequency x mean inverse document frequency of the five words. Two texts
are linked if their weighted Jaccard similarity, sum of minima over sum of maxima, is 0.8 or
more. The document frequencies are counted over all documents in a table of 2**16 word buckets
(feature hashing), whose size does not grow. A shingle's own document frequency is not used: it
counts the very copies that are searched for, so it would take the weight off what large groups
of copies share, and leave only what differs.

Signatures: each shingle falls into one of 32 bins in each of 16 independent rounds; the ICWS
minimum of each bin is a sample (empty bins borrow from another bin of the round), so a
signature of 512 samples costs 16 evaluations a shingle. 64 bands of 8 samples make buckets.
Exact copies are one node; each node of a bucket is verified against the bucket's first node,
the links are joined to components, and then all pairs of a bucket whose ends are still in
different components and whose total weights allow the similarity are verified too. In
buckets of more than CROWD nodes these pairs come from an exact prefix filter instead: both
texts must share one of their rarest shingles, and what is not rarer than it must have the
weight of the overlap that the similarity needs. So a large group of near copies costs a star in each
bucket, and a link that joins two components isn't lost.

Defined results: null texts and texts without a word are classes of their own, never linked;
rows with the same doc_id and text count once in a class; rows of one id with two texts are two
texts of which the id is in both classes; an empty table gives an empty result; further columns are
ignored. Rows without an id take part: texts are told apart by 128 bits of hash and numbered
densely, whatever their ids, and ``class_no``, the class's least number, is exact. Where no row
of a text (or a class) has an id, ``rep`` (``class_id``) is a number of 2**62 or more by the text's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import textkit
from webquarry.llm.shared import components, cut, text_key
from webquarry.llm.source_mixture import running

SHINGLE = 5
THRESHOLD = 0.8
ROUNDS, BINS = 16, 32
BANDS, ROWS = 64, 8
IDF_BITS = 16
CROWD = 12
#: Pairs of one text in a task; the text of a centre of more pairs is sent to several tasks.
PART_PAIRS = 1000
BROADCAST_CENTRES = 1_000_000

_POOL_BITS = 16
_RNG = np.random.default_rng(5)
_U = _RNG.random((5, 1 << _POOL_BITS))
_R = (-np.log(_U[0] * _U[1])).astype(np.float32)
_LOG_C = np.log(-np.log(_U[2] * _U[3])).astype(np.float32)
_BETA = _U[4].astype(np.float32)
_SALT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
#: For each round and bin, the order in which other bins are asked.
_TRIES = np.array([[np.random.default_rng([k, b]).permutation(BINS) for b in range(BINS)] for k in range(ROUNDS)])


def _words(texts: pa.Array) -> textkit.Words:
    return textkit.words(pc.utf8_lower(texts))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - IDF_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(bucket, df): the number of documents with a word of the bucket; one row for each bucket seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << IDF_BITS, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for i, j in textkit.chunks(texts):
                w = _words(texts.slice(i, j - i))
                seen = np.unique(w.doc * (1 << IDF_BITS) + _bucket(w.hash))
                total += np.bincount(seen & ((1 << IDF_BITS) - 1), minlength=1 << IDF_BITS)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": at, "df": total[at]})

    return docs.select("text").transform(textkit.mapped, count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


def idf_table(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequencies by word bucket: 2**16 numbers."""
    n = docs.count()
    found = document_frequencies(docs).toArrow()
    df = np.zeros(1 << IDF_BITS)
    df[found.column("bucket").to_numpy()] = found.column("df").to_numpy()
    return (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)


def weighted_sets(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight), sorted by text and hash, each shingle of a text once."""
    w = _words(texts)
    value = idf[_bucket(w.hash)].astype(np.float64)
    h, at = textkit.ngrams(w.hash, w.doc, SHINGLE)
    summed = np.concatenate([[0.0], np.cumsum(value)])
    mean = (summed[at + SHINGLE] - summed[at]) / SHINGLE
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    if len(short):
        extra = np.array([textkit.ngrams(w.hash[f : f + c], w.doc[f : f + c], c)[0][0] for f, c in zip(w.first[short], w.count[short], strict=True)], np.uint64)
        h = np.concatenate([h, extra])
        mean = np.concatenate([mean, (summed[w.first[short] + w.count[short]] - summed[w.first[short]]) / w.count[short]])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc, mean = h[order], doc[order], mean[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    # Rounded, so that the same shingle has the same weight whatever stood before it.
    return doc[at], h[at], (np.round(mean[at], 4) * times).astype(np.float32)


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ICWS samples of n sets: uint64 (n, ROUNDS, BINS); sets without a shingle have zeros."""
    out = np.zeros((n, ROUNDS, BINS), np.uint64)
    log_w = np.log(weight)
    low, best = np.empty(n * BINS, np.float32), np.empty(n * BINS, np.int64)
    for k in range(ROUNDS):
        x = textkit.mix(h * _SALT[k])
        pool = (x >> np.uint64(64 - _POOL_BITS)).astype(np.int64)
        slot = doc * BINS + (x & np.uint64(BINS - 1)).astype(np.int64)
        r, beta = _R[pool], _BETA[pool]
        t = np.floor(log_w / r + beta)
        log_a = _LOG_C[pool] - r * (t - beta + 1)
        low.fill(np.inf)
        np.minimum.at(low, slot, log_a)
        # Of equal minima the first in the order of hashes, as the last one written here.
        hit = np.flatnonzero(log_a == low[slot])[::-1]
        best.fill(-1)
        best[slot[hit]] = hit
        full = np.flatnonzero(best >= 0)
        first = best[full]
        out[full // BINS, k, full % BINS] = textkit.mix(h[first] + t[first].astype(np.int64).view(np.uint64) * _SALT[32]) | np.uint64(1)
        _densify(out[:, k, :], _TRIES[k])
    return out


def _densify(flat: np.ndarray, tries: np.ndarray) -> None:
    """Empty bins take the sample of another bin, the first full one in the bin's own order ``tries``."""
    full = flat != 0
    some = np.flatnonzero(full.any(axis=1) & ~full.all(axis=1))
    for at in range(0, len(some), 1024):
        rows = some[at : at + 1024]
        source = flat[rows]
        row, empty = np.nonzero(source == 0)
        own = tries[empty]
        found = own[np.arange(len(row)), (source[row[:, None], own] != 0).argmax(axis=1)]
        flat[rows[row], empty] = textkit.mix(source[row, found] + (empty + 1).astype(np.uint64)) | np.uint64(1)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """uint64 (n, BANDS): each band joins eight samples of eight different rounds."""
    n = len(samples)
    out = np.zeros((n, BANDS), np.uint64)
    for band in range(BANDS):
        half, base = (band // BINS) % (ROUNDS // ROWS), band % BINS
        for j in range(ROWS):
            k = half * ROWS + j
            out[:, band] = textkit.mix(out[:, band] * _SALT[33] + samples[:, k, (base * (2 * j + 1) + 5 * j) % BINS])
        out[:, band] = textkit.mix(out[:, band] + np.uint64(band + 1))
    return out


def _shown(own: str, h1: Column) -> Column:
    """An id, or where there is none a number of 2**62 or more by the text's hash."""
    return F.coalesce(own, F.shiftrightunsigned(h1, 2) + F.lit(1 << 62))


def _signed_rows(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, h1, h2, weight of the whole set, and the band keys; texts without a word are left out."""
    table = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for i, j in textkit.chunks(texts):
                doc, h, weight = weighted_sets(texts.slice(i, j - i), table.value)
                if not len(doc):
                    continue
                keys = band_keys(signatures(doc, h, weight, j - i))
                total = np.bincount(doc, weight, minlength=j - i)
                at = np.flatnonzero(total > 0)
                flat = pa.array(textkit.signed(np.ascontiguousarray(keys[at]).reshape(-1)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS), flat)
                take = pa.array(i + at)
                yield pa.record_batch({"doc_id": batch.column("doc_id").take(take), "h1": batch.column("h1").take(take), "h2": batch.column("h2").take(take), "weight": pa.array(total[at]), "keys": lists})

    return docs.select(F.col("doc_id").cast("long"), "text", *text_key()).transform(textkit.mapped, sign, "doc_id long, h1 long, h2 long, weight double, keys array<long>")


def weighted_jaccard(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Similarity of left[i] and right[i]."""
    da, ha, wa = weighted_sets(left, idf)
    db, hb, wb = weighted_sets(right, idf)
    doc, h, w = np.concatenate([da, db]), np.concatenate([ha, hb]), np.concatenate([wa, wb]).astype(np.float64)
    order = np.lexsort((h, doc))
    doc, h, w = doc[order], h[order], w[order]
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]))
    low = np.bincount(doc[same], np.minimum(w[same], w[same + 1]), minlength=len(left))
    total = np.bincount(doc, w, minlength=len(left))
    return low / np.maximum(total - low, 1e-30)


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have at least the similarity, with it as ``sim``."""
    table = pairs.sparkSession.sparkContext.broadcast(idf)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("ta"), batch.column("tb")
            for i, j in textkit.chunks(pc.binary_join_element_wise(left, right, "")):
                sim = weighted_jaccard(left.slice(i, j - i), right.slice(i, j - i), table.value)
                at = np.flatnonzero(sim >= threshold)
                if len(at):
                    take = pa.array(i + at)
                    yield pa.record_batch({"a": batch.column("a").take(take), "b": batch.column("b").take(take), "sim": pa.array(sim[at])})

    # A row for each PART_PAIRS pairs at most.
    centres = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / PART_PAIRS).cast("int").alias("parts")).where("parts > 1"))
    centres = F.broadcast(centres) if centres.limit(BROADCAST_CENTRES + 1).count() <= BROADCAST_CENTRES else centres
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int").alias("part")
    split = pairs.join(centres, "a", "left").select("a", "b", part)
    b = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    a = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")).join(centres, "a", "left")
    a = a.select("a", "ta", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return split.join(b, "b").join(a, ["a", "part"]).select("a", "b", "ta", "tb").transform(textkit.mapped, verify, "a long, b long, sim double")


def rare_first_prefixes(texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(rep, h, before): of each text (rep, text) its rarest shingles, up to 1 - threshold of its weight.

    ``before`` is the weight of the text's shingles that are rarer than h.

    In any one order of all shingles, two sets of weighted Jaccard similarity t share a shingle
    of both prefixes: what stands before their first common one is not shared, so it has at most
    1 - t of the weight of each. The order is by the number of these texts with the shingle,
    counted in 2**18 buckets of its hash.
    """
    bits = 18
    sc = texts.sparkSession.sparkContext
    table = sc.broadcast(idf)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for i, j in textkit.chunks(batch.column(0)):
                _, h, _ = weighted_sets(batch.column(0).slice(i, j - i), table.value)
                total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": at, "n": total[at]})

    found = texts.select("text").transform(textkit.mapped, count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << bits, np.int64)
    often[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    order_of = sc.broadcast(often)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            for i, j in textkit.chunks(batch.column("text")):
                doc, h, w = weighted_sets(batch.column("text").slice(i, j - i), table.value)
                rank = order_of.value[(h >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((h, rank, doc))
                doc, h, w = doc[order], h[order], w[order].astype(np.float64)
                total = np.bincount(doc, w, minlength=j - i)
                before = np.cumsum(w) - w
                first = np.searchsorted(doc, np.arange(j - i))
                start = np.append(before, 0.0)[first]
                keep = before - start[doc] <= (1 - threshold) * total[doc] + 1e-6
                yield pa.record_batch({"rep": rep[i:j][doc[keep]], "h": textkit.signed(h[keep]), "before": (before - start[doc])[keep]})

    return texts.select("rep", "text").transform(textkit.mapped, prefix, "rep long, h long, before double")


def text_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate classes of the distinct texts with words of ``docs`` (doc_id, text): (h1, h2, least, no, class_no, n_links).

    h1 and h2 are ``text_key()``, ``least`` is the least id of the text (null if no row has one). Texts
    are numbered by ``least``, those without one last; ``class_no`` is the least number of the class.
    """
    idf = idf_table(docs)
    signed = _signed_rows(docs, idf)
    texts_of = cut(signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.first("weight").alias("weight"), F.first("keys").alias("keys")))
    numbers = running(texts_of.select("h1", "h2", "least"), [F.asc_nulls_last("least"), F.col("h1"), F.col("h2")], rep=F.lit(1).cast("long"))
    reps = cut(texts_of.join(numbers.select("h1", "h2", "rep"), ["h1", "h2"]))
    rows = reps.select("rep", "weight", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = cut(rows.join(buckets, "key"))
    pairs = cut(members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct())
    # The row of the least id has the text; copies under other ids don't move far.
    wanted = reps.select("rep", F.col("least").alias("_least"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).join(members.select("rep").distinct(), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("own"), "text", *text_key())
    texts = texts.join(wanted, F.col("own").eqNullSafe(F.col("_least")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    texts = cut(texts.select("rep", "text").dropDuplicates(["rep"]))
    links = cut(verified(pairs, texts, idf, threshold))
    first = components(links.select("a", "b"))

    # Pairs of the buckets whose ends are in different components so far.
    mixed = members.where("n > 2").join(first.withColumnRenamed("id", "rep"), "rep", "left")
    mixed = cut(mixed.select("key", "n", "first", "rep", "weight", F.coalesce("label", "rep").alias("label")))
    several = mixed.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("key")
    mixed = cut(mixed.join(several, "key"))

    def across(rows: DataFrame, by: str) -> DataFrame:
        """Pairs of different components under one key.

        Both texts have what they share behind ``before`` at the latest, and that must reach
        the overlap that the similarity needs.
        """
        a, b = (rows.select(by, F.col("rep").alias(x), F.col("weight").alias(f"w{x}"), F.col("label").alias(f"l{x}"), F.col("before").alias(f"p{x}")) for x in "ab")
        needed = (F.col("wa") + F.col("wb")) * (threshold / (1 + threshold) - 1e-6)
        fits = F.least(F.col("wa") - F.col("pa"), F.col("wb") - F.col("pb")) >= needed
        return a.join(b, (a[by] == b[by]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & fits).select("a", "b")

    small = across(mixed.where(f"n <= {CROWD} AND rep <> first").withColumn("before", F.lit(0.0)), "key")
    crowd = cut(mixed.where(f"n > {CROWD}").select("rep", "weight", "label").distinct())
    marks = rare_first_prefixes(texts.join(crowd, "rep", "left_semi"), idf, threshold)
    rest = small.union(across(marks.join(crowd, "rep"), "h")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = cut(verified(rest, texts, idf, threshold))

    all_links = links.select("a", "b").union(more.select("a", "b"))
    labels = first if more.isEmpty() else components(all_links)
    counted = all_links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = reps.select("h1", "h2", "least", F.col("rep").alias("no")).join(labels.withColumnRenamed("id", "no"), "no", "left").join(counted.withColumnRenamed("rep", "no"), "no", "left")
    return out.select("h1", "h2", "least", "no", F.coalesce("label", "no").alias("class_no"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate classes: (doc_id, rep, class_id, n_links, class_no), one row per id and distinct text.

    ``rep`` is the least id with exactly this text, ``class_id`` the least id of the class,
    ``n_links`` the number of verified links of the text to other texts that the search made;
    texts without a word have no ``class_no``.
    """
    ids = docs.select(F.col("doc_id").cast("long"), *text_key(), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    found = cut(text_classes(docs, threshold))
    # Only classes of several texts are named after another text.
    firsts = found.join(found.where("no <> class_no").select("class_no").distinct(), "class_no", "left_semi").where("no = class_no")
    firsts = cut(firsts.select("class_no", _shown("least", F.col("h1")).alias("first_id")))
    firsts = F.broadcast(firsts) if firsts.limit(BROADCAST_CENTRES + 1).count() <= BROADCAST_CENTRES else firsts
    named = found.join(firsts, "class_no", "left").withColumn("rep", _shown("least", F.col("h1")))
    named = named.select("h1", "h2", "rep", F.coalesce("first_id", "rep").alias("class_id"), "n_links", "class_no")
    member = ids.where("worded").join(named, ["h1", "h2"]).select("doc_id", "rep", "class_id", "n_links", "class_no")
    alone = ids.where("NOT worded").withColumn("rep", _shown("doc_id", F.col("h1")))
    alone = alone.select("doc_id", "rep", F.col("rep").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("class_no"))
    return member.union(alone).distinct()


def op5_icws_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_icws_dedup": op5_icws_dedup}
ORACLES: dict[str, str] = {}
