"""Language identification by Bayesian fusion of evidence.

The posterior of a language is proportional to: the likelihood of the text under a naive Bayes
model of byte trigrams inside words (tempered, as neighbouring trigrams aren't independent) x
the likelihood of the language that the markup or the source declares x that of the address
suffix x the prior of the host. Host priors are sums of text-only posteriors over all rows of
the host, smoothed towards those of its domain, and these towards the whole corpus's, all by
grouped aggregation.

The languages are the MOST_LANGS tags that most rows with a text declare (ties by name), by their
primary subtag of two or three letters; a tag beyond these has too few rows to be a class, and
says nothing as a declaration. Crawls declare some two hundred languages besides mistyped tags, so
the model has a bounded size. It is fitted on whole texts of about TRAIN_CHARS characters a
language (all of a rare one): the rows whose hash is below a share of all hashes, each text
once. Only chosen texts leave their tasks. Everything else covers all rows and whole texts.

Evidence, posteriors and priors are arrays over the languages, so the plan is the same for
four languages and for all. Masses of a host's language below LEAST_MASS a row count as none.

A row is rejected if its text has no letter in any word, or if no language reaches MIN_POSTERIOR.

Defined results: null and empty texts are rejected with a null language; unknown declarations
and suffixes say nothing; rows without a host share the host ''; repeated rows are judged each;
an empty table gives an empty result; without labelled rows every row is rejected; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import textkit
from webquarry.llm.ngram_quality import vocabulary
from webquarry.llm.shared import cut

#: Classes at most.
MOST_LANGS = 256
#: Characters of each language that the model is fitted on, about.
TRAIN_CHARS = 2_000_000
LEAST_MASS = 2.0**-60
BUCKET_BITS = 15
TEMPER = 0.1
P_DECLARED = 0.9
P_SUFFIX = 0.8
HOST_STRENGTH = 10.0
MIN_POSTERIOR = 0.5
#: Numbers of priors that are sent to all tasks at most, one for each host and language.
BROADCAST_HOSTS = 1_000_000
#: Languages of address suffixes.
SUFFIXES = {"at": "de", "au": "en", "de": "de", "es": "es", "fr": "fr", "mx": "es", "uk": "en", "us": "en"}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0x100)]] = True


def _buckets(texts: pa.Array) -> tuple[textkit.Words, object, np.ndarray]:
    w = textkit.words(texts)
    v = vocabulary(w, np.zeros(len(texts), np.int64))
    return w, v, (textkit.mix(v.grams & np.uint64(0xFFFFFF)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (bucket, language) of the bounded samples of (id, text, declared)."""
    labelled = rows.where((F.length("text") > 0) & (F.col("declared") != "")).select("declared", "text")
    sizes = labelled.groupBy("declared").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    sizes = {r["declared"]: r["chars"] for r in sizes.orderBy(F.desc("n"), "declared").limit(MOST_LANGS).collect()}
    langs = sorted(sizes)
    # Rows whose hash is at most this: about TRAIN_CHARS of each language, all of a rare one.
    limits = {lang: min((1 << 63) - 1, round((1 << 64) * min(1.0, TRAIN_CHARS / chars)) - (1 << 63)) for lang, chars in sizes.items()}
    # A literal: a table of the driver's rows would start a second set of Python workers on every executor.
    limit = F.create_map(*[x for lang, most in limits.items() for x in (F.lit(lang), F.lit(most).cast("long"))]) if limits else F.create_map().cast("map<string,bigint>")
    chosen = labelled.withColumn("h", F.xxhash64("text")).where(F.col("h") <= F.element_at(limit, F.col("declared")))
    sample = chosen.select("declared", "text", "h", F.xxhash64(F.lit(1), "text").alias("h2")).groupBy("declared", "h", "h2").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            declared = batch.column("declared")
            for lang in declared.unique().to_pylist():
                texts = batch.column("text").filter(pc.equal(declared, lang))
                total = np.zeros(1 << BUCKET_BITS)
                for i, j in textkit.chunks(texts):
                    _, v, bucket = _buckets(texts.slice(i, j - i))
                    total += np.bincount(bucket, np.repeat(v.times, v.size), minlength=1 << BUCKET_BITS)
                at = np.flatnonzero(total)
                yield pa.record_batch({"lang": pa.array(np.full(len(at), langs.index(lang), np.int32)), "bucket": pa.array(at.astype(np.int32)), "c": pa.array(total[at])})

    # Of bounded size: at most a row for each bucket and class.
    found = sample.select("declared", "text").transform(textkit.mapped, count, "lang int, bucket int, c double").groupBy("lang", "bucket").agg(F.sum("c").alias("c")).toArrow()
    counts = np.full((1 << BUCKET_BITS, max(1, len(langs))), 0.1)
    if langs:
        counts[found.column("bucket").to_numpy(), found.column("lang").to_numpy()] += found.column("c").to_numpy()
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def text_evidence(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(id, declared, host, suffix, lettered, evidence array<double>): tempered log likelihoods, the best 0."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for i, j in textkit.chunks(texts):
                n, part = j - i, batch.slice(i, j - i)
                w, v, bucket = _buckets(texts.slice(i, n))
                total = np.zeros((n, len(langs)))
                lettered = np.zeros(n, bool)
                if len(w.hash):
                    ends = np.cumsum(v.size)
                    for k in range(len(langs)):
                        edges = np.concatenate([[0.0], np.cumsum(shared.value[bucket, k], dtype=np.float64)])
                        total[:, k] = np.bincount(w.doc, (edges[ends] - edges[ends - v.size])[v.inverse], minlength=n)
                    seen = np.concatenate([[0], np.cumsum(_LETTER[w.data])])
                    lettered = np.bincount(w.doc, seen[w.end] - seen[w.start], minlength=n) > 0
                total = TEMPER * (total - total.max(axis=1, keepdims=True))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(langs)), pa.array(total.reshape(-1)))
                yield pa.record_batch({**{c: part.column(c) for c in ("id", "declared", "host", "suffix")}, "lettered": pa.array(lettered), "evidence": lists})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "declared", "host", "suffix", "text").transform(textkit.mapped, score, f"id {kind}, declared string, host string, suffix string, lettered boolean, evidence array<double>")


def host_priors(masses: DataFrame, n: int) -> DataFrame:
    """(host, prior array<double>): smoothed over host, domain and corpus; ``masses`` are (host, k, m), sums of posteriors by language number."""
    hosts = masses.groupBy("host", "k").agg(F.sum("m").alias("m"))
    hosts = cut(hosts.withColumn("domain", F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0)))
    domains = hosts.groupBy("domain", "k").agg(F.sum("m").alias("m"))
    # A row a language.
    whole = {r["k"]: r["m"] for r in domains.groupBy("k").agg(F.sum("m").alias("m")).collect()}
    corpus = [(whole.get(k, 0.0) + 1) / (sum(whole.values()) + n) for k in range(n)]

    def dense(rows: DataFrame, key: str, name: str) -> DataFrame:
        """The masses of each key as an array, and their sum."""
        listed = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("_m"), F.sum("m").alias(f"{name}_mass"))
        return listed.select(key, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.element_at("_m", k), F.lit(0.0))).alias(name), f"{name}_mass")

    both = dense(hosts, "host", "own").withColumn("domain", F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0)).join(dense(domains, "domain", "above"), "domain")
    smoothed = F.transform(F.array(*map(F.lit, corpus)), lambda c, k: (F.col("above")[k] + F.lit(HOST_STRENGTH) * c) / (F.col("above_mass") + HOST_STRENGTH))
    both = both.select("host", "own", "own_mass", smoothed.alias("domain_prior"))
    return both.select("host", F.zip_with("own", "domain_prior", lambda m, d: (m + F.lit(HOST_STRENGTH) * d) / (F.col("own_mass") + HOST_STRENGTH)).alias("prior"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def identify(rows: DataFrame) -> DataFrame:
    """Every row of ``rows`` (id, text, declared, host, suffix): id, declared, lang, posterior, kept.

    The id may be of any type.
    """
    langs, table = fit(rows)
    if not langs:
        none = F.lit(None)
        return rows.select("id", "declared", none.cast("string").alias("lang"), none.cast("double").alias("posterior"), F.lit(False).alias("kept"))
    n = len(langs)
    seen = cut(text_evidence(rows, langs, table))
    # The best evidence is 0.
    alone = _bound(F.transform("evidence", F.exp), lambda e: _bound(_sum(e), lambda total: F.transform(e, lambda x: x / total)))
    masses = seen.where("lettered").select("host", F.posexplode(alone).alias("k", "m")).where(F.col("m") >= LEAST_MASS)
    priors = host_priors(masses, n)

    number = F.create_map(*[x for k, lang in enumerate(langs) for x in (F.lit(lang), F.lit(k))])

    def told(known: Column, k: Column, sure: float) -> Column:
        return F.when(known.isNull(), F.lit(0.0)).when(known == k, F.lit(float(np.log(sure)))).otherwise(F.lit(float(np.log((1 - sure) / max(1, n - 1)))))

    flat = F.array_repeat(F.lit(1 / n), n)
    # Few hosts are sent to all tasks; many are joined by a shuffle, in which Spark splits hot hosts.
    priors = cut(priors)
    small = priors.limit(BROADCAST_HOSTS // n + 1).count() <= BROADCAST_HOSTS // n
    joined = seen.join(F.broadcast(priors) if small else priors, "host", "left")
    given = F.struct(F.element_at(number, F.col("declared")).alias("d"), F.element_at(number, F.col("suffix")).alias("s"), F.coalesce("prior", flat).alias("p"))
    scores = _bound(given, lambda g: F.transform("evidence", lambda e, k: e + told(g["d"], k, P_DECLARED) + told(g["s"], k, P_SUFFIX) + F.log(g["p"][k])))
    best = _bound(scores, lambda s: _bound(F.array_max(s), lambda top: F.struct(F.array_position(s, top).cast("int").alias("at"), (F.lit(1.0) / _sum(F.transform(s, lambda x: F.exp(x - top)))).alias("posterior"))))
    found = joined.select("id", "declared", "lettered", best.alias("b"))
    lang = F.element_at(F.array(*map(F.lit, langs)), F.col("b.at"))
    out = found.select("id", "declared", F.when(F.col("lettered"), lang).alias("lang"), F.when(F.col("lettered"), F.col("b.posterior")).alias("posterior"))
    return out.withColumn("kept", F.coalesce(F.col("posterior") >= MIN_POSTERIOR, F.lit(False)))


def primary_subtag(tag: Column) -> Column:
    """The language of a tag like ``en`` or ``en-GB`` in lower case; '' for anything else."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(tag)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def from_documents(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """Documents as rows to identify: the column lang is the declaration, the source the host; the id is ``key``, by default doc_id."""
    host = F.lower(F.coalesce("source", F.lit("")))
    own = F.col("doc_id").cast("long") if key is None else key
    return docs.select(own.alias("id"), "text", primary_subtag(F.col("lang")).alias("declared"), host.alias("host"), _suffix(host).alias("suffix"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Pages as rows to identify: text without tags, the lang attribute of the root, host and suffix of the url."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[^:/?#]+://([^/?#:]*)", 1), F.lit("")))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = primary_subtag(F.regexp_extract("html", r"(?i)<html[^>]*?\blang\s*=\s*[\"']?([a-z_-]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), declared.alias("declared"), host.alias("host"), _suffix(host).alias("suffix"))


def _suffix(host: Column) -> Column:
    top = F.regexp_extract(host, r"\.([a-z]+)$", 1)
    return F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair]), top)


def op4_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language, the posterior and whether it is kept."""
    return identify(from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("id", "doc_id")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its language by text, markup, address suffix and the priors of host and domain."""
    return identify(from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))).withColumnRenamed("id", "page_id")


QUERIES = {"op4_language_fusion": op4_language_fusion, "page_languages": page_languages}
ORACLES: dict[str, str] = {}
