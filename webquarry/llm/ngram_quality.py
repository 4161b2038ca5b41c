"""Quality rules and n-gram perplexity.

The language model is an interpolated modified Kneser-Ney model of byte 5-grams, one for each
declared language. The 5-grams of the query run over the whole text with one space between
words, so that the order of words counts; ``across=False`` gives those inside single words
(each between spaces). Each task sums its packed 5-grams before anything is shuffled, and takes
several input splits for that; Spark sums the counts, derives continuation counts of the lower
orders, discounts and interpolated probabilities with joins and windows in which no key has more
than 256 rows. All n-grams of the corpus are in the model, so a text is scored with one lookup for
each of its bytes; a 5-gram that the model hasn't has the least probability of its language.

The probabilities are kept as arrays sorted by hash. Tasks build them in shards of about
MODEL_ROWS entries; the driver passes one shard after the other to the shared folder, from which
Spark brings them to every executor, and tasks map them into memory. So neither the driver nor a
worker holds the model, and the texts are read once, whatever the number of shards.

A document is rejected if its log perplexity is outside the band of its language: from the
first quartile less a reach to the third quartile plus it. The quartiles are those of the
documents that pass the base rules; the reach is 3 interquartile ranges (MARGIN at least),
times 1.5 at 50 words and falling to a half with the root of the text's length, as the
scatter of a mean does.

Defined results: a null text is an empty one; an empty text has zero counts, fails the base
rules and is not kept; a null language is the language ``und``; repeated rows are scored each;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webquarry.llm import textkit
from webquarry.llm.shared import cut, hand_out

ORDER = 5
MODEL_ROWS = 1_000_000
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
FENCE = 3.0
MARGIN = 0.15
PENDING = 2_000_000
#: The counting tasks take splits together, down to so many tasks a core: fewer tasks have more to sum.
TASKS_A_CORE = 4
#: Bands of up to so many languages are sent to all tasks.
BANDS_MOST = 100_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WHITE = " \t\n\x0b\x0c\r"


@dataclass
class Vocabulary:
    """The distinct words of some texts by language: their 5-grams, and where each word of the texts is."""

    grams: np.ndarray  # packed 5-grams of word 0, then of word 1, ..
    size: np.ndarray  # 5-grams of each word
    group: np.ndarray  # language number of each word
    times: np.ndarray  # occurrences of each word
    inverse: np.ndarray  # number of the distinct word at each place


def vocabulary(w: textkit.Words, group: np.ndarray) -> Vocabulary:
    """``group``: a small number for the language of each text."""
    its = group[w.doc]
    _, at, inverse, times = np.unique(textkit.mix(w.hash + its.astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
    start, length = w.start[at], w.end[at] - w.start[at]
    # Each word between ORDER - 1 spaces and one space; a 5-gram ends at each byte and at the last space.
    room = length + ORDER
    begin = np.cumsum(room) - room
    padded = np.full(int(room.sum()), 0x20, np.uint64)
    inside = np.repeat(begin + ORDER - 1 - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    source = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    padded[inside] = w.data[source]
    size = length + 1
    ends = np.repeat(begin + ORDER - 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    grams = np.zeros(len(ends), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        grams = grams << np.uint64(8) | padded[ends - back]
    return Vocabulary(grams, size, its[at], times, inverse)


def running(w: textkit.Words, group: np.ndarray) -> Vocabulary:
    """Every word at its place, its 5-grams reaching into the words before it in the same text."""
    length = w.end - w.start
    size = length + 1
    # Each text begins with ORDER - 1 spaces; a 5-gram ends at each byte of a word and at the space after it.
    fresh = np.ones(len(w.doc), bool)
    fresh[1:] = w.doc[1:] != w.doc[:-1]
    begin = np.cumsum(size) - size + (ORDER - 1) * np.cumsum(fresh)
    padded = np.full(int(size.sum()) + (ORDER - 1) * int(fresh.sum()), 0x20, np.uint8)
    before = np.cumsum(length) - length
    each = np.arange(int(length.sum()))
    padded[np.repeat(begin - before, length) + each] = w.data[np.repeat(w.start - before, length) + each]
    ends = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    grams = np.zeros(len(ends), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        grams = grams << np.uint64(8) | padded[ends - back]
    return Vocabulary(grams, size, group[w.doc], np.ones(len(length), np.int64), np.arange(len(length)))


def _groups(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = langs.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def counted_grams(docs: DataFrame, across: bool = False) -> DataFrame:
    """(lang, gram, c): occurrences of every packed 5-gram in the documents (lang, text)."""
    split = running if across else vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def summed() -> Iterator[pa.RecordBatch]:
            for lang, parts in pending.items():
                keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(where, np.concatenate([p[1] for p in parts]))
                yield pa.record_batch({"lang": pa.array([lang] * len(keys), pa.string()), "gram": textkit.signed(keys), "c": total.astype(np.int64)})

        for batch in batches:
            group, names = _groups(batch.column("lang"))
            texts = batch.column("text")
            for i, j in textkit.chunks(texts):
                w = textkit.words(texts.slice(i, j - i))
                if not len(w.hash):
                    continue
                v = split(w, group[i:j])
                of, times = np.repeat(v.group, v.size), np.repeat(v.times, v.size)
                for g in np.unique(of):
                    keys, where = np.unique(v.grams[of == g], return_inverse=True)
                    pending.setdefault(names[g], []).append((keys, np.bincount(where, times[of == g])))
                    waiting += len(keys)
                if waiting > PENDING:
                    merged = {r.column(0)[0].as_py(): [(r.column(1).to_numpy().view(np.uint64), r.column(2).to_numpy())] for r in summed()}
                    waiting = sum(len(x[0][0]) for x in merged.values())
                    if waiting > PENDING // 2:
                        yield from summed()
                        merged, waiting = {}, 0
                    pending.clear()
                    pending.update(merged)
        yield from summed()

    tasks = TASKS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism
    return docs.select("lang", "text").coalesce(tasks).mapInArrow(textkit.lean(count), "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discount(level: DataFrame, discounts: DataFrame) -> DataFrame:
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    return level.join(F.broadcast(discounts), "lang").withColumn("d", d)


def _discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) by the counts of counts; the usual half steps where they say nothing."""
    n = level.groupBy("lang").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def step(k: int) -> Column:
        d = F.lit(float(k)) - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.when(d.isNull() | (d <= 0) | (d >= k), F.lit(k - 0.5)).otherwise(d).alias(f"d{k}")

    return n.select("lang", *[step(k) for k in (1, 2, 3)])


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(lang, gram, logp): interpolated modified Kneser-Ney log probabilities of all 5-grams.

    The key of an n-gram is its bytes packed into a long, so its context is the key shifted by a
    byte and its suffix the key without the highest byte.
    """
    levels = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1))
        # Read for the discounts, the contexts and the next level: computed once.
        levels[n] = cut(levels[n + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("c")))
    lower = None
    same = Window.partitionBy("lang", "context")
    for n in range(1, ORDER + 1):
        level = _discount(levels[n], _discounts(levels[n])).withColumn("context", F.shiftright("gram", 8)).withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1)))
        # A context has at most 256 rows, one for each byte behind it.
        level = level.withColumn("total", F.sum("c").over(same)).withColumn("mass", F.sum("d").over(same))
        level = level.withColumn("below", F.lit(1 / 256)) if lower is None else level.join(lower, ["lang", "suffix"])
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("mass") / F.col("total") * F.col("below")
        lower = cut(level.select("lang", F.col("gram").alias("suffix"), p.alias("below")))
    return lower.select("lang", F.col("suffix").alias("gram"), F.log("below").alias("logp"))


def shard_files(model: DataFrame, most: int) -> list[str]:
    """The model as files of about ``most`` rows by the rest of the packed 5-gram, handed out to all executors.

    A file has a line of JSON with the place, size and least value of each language, then hashes
    and log probabilities of each, sorted by hash. The number of files is odd, so that all bytes
    of a 5-gram count for the rest.
    """
    sizes = model.groupBy("lang").agg(F.count("*").alias("n"), F.min("logp").alias("least")).collect()
    n = -(-sum(r["n"] for r in sizes) // most) | 1
    least = {r["lang"]: r["least"] for r in sizes}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches, pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("gram", pa.int64()), ("logp", pa.float32())]))
        for shard in pc.unique(got.column("shard")).to_pylist():
            own = got.filter(pc.equal(got.column("shard"), shard))
            places, parts, at = {}, [], 0
            # Every head has all languages, as any file may be asked for a 5-gram that it hasn't.
            for lang in sorted(least):
                rows = own.filter(pc.equal(own.column("lang"), lang))
                h = textkit.mix(rows.column("gram").to_numpy().view(np.uint64))
                order = np.argsort(h)
                places[lang] = (at, len(h), least[lang])
                for array in (h[order], rows.column("logp").to_numpy()[order].astype(np.float64)):
                    parts.append(array.tobytes())
                    at += 8 * len(h)
            head = json.dumps(places).encode()
            # Arrays begin at a multiple of eight bytes.
            head += b" " * (-(len(head) + 1) % 8) + b"\n"
            yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "data": pa.array([b"".join([head, *parts])], pa.binary())})

    keyed = model.select(F.pmod("gram", F.lit(n)).cast("int").alias("shard"), "lang", "gram", F.col("logp").cast("float"))
    built = cut(keyed.repartition(n, "shard").mapInArrow(textkit.lean(build), "shard int, data binary"))
    names = [""] * n
    # One shard at a time: each is a row of a partition of its own, as a rule.
    for row in built.toLocalIterator():
        names[row["shard"]] = hand_out(model.sparkSession, bytes(row["data"]), "ngrams")
    return names


@lru_cache(maxsize=512)
def _opened(name: str) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    data = np.memmap(SparkFiles.get(name), np.uint8, "r")
    line = int(np.flatnonzero(data[: 1 << 20] == 0x0A)[0]) + 1
    body = data[line:]
    out = {}
    for lang, (at, n, least) in json.loads(data[:line].tobytes()).items():
        out[lang] = (body[at : at + 8 * n].view(np.uint64), body[at + 8 * n : at + 16 * n].view(np.float64), least)
    return out


def _lookup(names: list[str], lang: str, grams: np.ndarray) -> np.ndarray:
    """Log probabilities of packed 5-grams: the language's least for those that the model hasn't, NaN for languages that it hasn't."""
    keys, back = np.unique(grams, return_inverse=True)
    out = np.full(len(keys), next((_opened(name)[lang][2] for name in names if name and lang in _opened(name)), np.nan))
    rest = (keys % np.uint64(max(1, len(names)))).astype(np.int64)
    order = np.argsort(rest, kind="stable")
    edges = np.searchsorted(rest[order], np.arange(len(names) + 1))
    for shard, name in enumerate(names):
        mine = order[edges[shard] : edges[shard + 1]]
        if not len(mine):
            continue
        h, logp, least = _opened(name).get(lang, (None, None, 0.0)) if name else (None, None, 0.0)
        if h is None or not len(h):
            continue
        wanted = textkit.mix(keys[mine])
        at = np.minimum(np.searchsorted(h, wanted), len(h) - 1)
        out[mine] = np.where(h[at] == wanted, logp[at], least)
    return out[back]


def base_counts(texts: pa.Array, w: textkit.Words) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text."""
    n = len(texts)
    letters = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    chars = np.bincount(w.doc, letters[w.end] - letters[w.start], minlength=n) if len(w.doc) else np.zeros(n)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
    marks = np.bincount(w.doc, symbols[w.end] - symbols[w.start], minlength=n) if len(w.doc) else np.zeros(n)
    repeated = np.zeros(n)
    h, at = textkit.ngrams(w.hash, w.doc, 3)
    if len(h):
        key = textkit.mix(h + w.doc[at].astype(np.uint64))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        edge = np.zeros(len(w.hash) + 1, np.int64)
        first = at[order[twice]]
        np.add.at(edge, first, 1)
        np.add.at(edge, first + 3, -1)
        repeated = np.bincount(w.doc, np.cumsum(edge[:-1]) > 0, minlength=n)
    lines = np.zeros(n, np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if text and "\n" in text:
            full = [x for x in text.split("\n") if x.strip(_WHITE)]
            lines[i] = len(full) - len(set(full))
    return {"n_words": w.count, "word_chars": chars, "n_symbols": marks, "n_dup_lines": lines, "n_repeat_words": repeated}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(docs: DataFrame, names: list[str], across: bool = False) -> DataFrame:
    """Every document (doc_id, lang, text) with the base counts and its log perplexity a byte (null: no word, or a language that the model hasn't)."""
    split = running if across else vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            group, langs = _groups(batch.column("lang"))
            for i, j in textkit.chunks(texts):
                part, own = batch.slice(i, j - i), texts.slice(i, j - i)
                w = textkit.words(own)
                total, size = np.zeros(j - i), np.zeros(j - i)
                if len(w.hash):
                    v = split(w, group[i:j])
                    of, value = np.repeat(v.group, v.size), np.zeros(len(v.grams))
                    for g in np.unique(of):
                        value[of == g] = _lookup(names, langs[g], v.grams[of == g])
                    edges = np.concatenate([[0.0], np.cumsum(value)])
                    ends = np.cumsum(v.size)
                    total = np.bincount(w.doc, (edges[ends] - edges[ends - v.size])[v.inverse], minlength=j - i)
                    size = np.bincount(w.doc, w.end - w.start + 1, minlength=j - i)
                counts = {k: pa.array(x.astype(np.int64)) for k, x in base_counts(own, w).items()}
                log_ppl = pa.array(-total / np.maximum(size, 1), mask=(size == 0) | np.isnan(total))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "lang": part.column("lang"), **counts, "log_ppl": log_ppl})

    kind = "doc_id long, lang string, " + ", ".join(f"{k} long" for k in COUNTS) + ", log_ppl double"
    return docs.select("doc_id", "lang", "text").mapInArrow(textkit.lean(run), kind)


def quality(docs: DataFrame, model_rows: int = MODEL_ROWS, across: bool = False) -> DataFrame:
    """Every document: doc_id, the base counts, base_failed, log_ppl, the band of its language and kept."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    model = kneser_ney(cut(counted_grams(own, across)))
    rows = scored(own, shard_files(model, model_rows), across)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    rows = cut(rows.withColumn("base_failed", failed))
    q = rows.where("NOT base_failed").groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.75], 10000).alias("q"))
    reach = F.greatest(FENCE * (F.col("q")[1] - F.col("q")[0]), F.lit(MARGIN))
    bands = cut(q.select("lang", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), reach.alias("reach")))
    # As many rows as there are languages: sent to all tasks, so that no task gets all rows of a language.
    bands = F.broadcast(bands) if bands.limit(BANDS_MOST + 1).count() <= BANDS_MOST else bands
    own_reach = F.col("reach") * (0.5 + F.sqrt(F.try_divide(F.lit(MIN_WORDS), F.col("n_words"))))
    inside = F.col("log_ppl").between(F.col("low"), F.col("high"))
    rows = rows.join(bands, "lang", "left").withColumn("low", F.col("q1") - own_reach).withColumn("high", F.col("q3") + own_reach)
    return rows.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "lang", "log_ppl", "low", "high")


def op3_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the base counts and the verdict of rules and model."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), across=True)


QUERIES = {"op3_ngram_quality": op3_ngram_quality}
ORACLES: dict[str, str] = {}
