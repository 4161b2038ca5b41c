"""Training-data operators against brute force, and on nulls, empty and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webquarry.llm import bpe_prefix, decontaminate, hilbert_shards, icws_dedup, language_fusion, licence_digests, ngram_quality, substring_dedup, textkit
from webquarry.llm.shared import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, key string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, texts, lang="en", source="a"):
    rows = [(i, t, lang, source, len(t) if t is not None else None, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(r, n):
    return " ".join("".join(r.choice("abcdef") for _ in range(r.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    copy = sentence(r, 40)
    texts = [None, "", " \n\t", "one", copy, copy, copy + " more", sentence(r, 3000), "x " * 100, "Ωμέγα 漢字 🙂", "a b c"]
    docs = table(spark, texts).union(spark.createDataFrame([(4, copy, None, None, None, None, None), (None, "no id here", "en", "a", 1, None, None)], SCHEMA))
    return docs.cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return SPLIT.findall(text or "")


def test_word_hashes_agree_with_words():
    texts = ["a b a", None, "", "  b\ta c ", "b"]
    w = textkit.words(pa.array(texts))
    assert w.count.tolist() == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    assert len(set(zip(flat, w.hash.tolist(), strict=True))) == len(set(flat)) == len(set(w.hash.tolist()))
    assert w.text(0, 3) == "a b a"
    spaced = textkit.words(pa.array(["é b  c\td e", "f g\n", "h"]))
    flat = ["é", "b", "c", "d", "e", "f", "g", "h"]
    assert all(spaced.text(i, j) == " ".join(flat[i:j]) for i in range(8) for j in range(i, 9))
    sliced = textkit.words(pa.array(["zz", *texts]).slice(1))
    assert (sliced.hash == w.hash).all()


def test_hilbert_neighbours_touch(spark):
    n, bits = 3, 2
    cells = spark.range(1 << n * bits).select(*[F.shiftright("id", bits * i).bitwiseAND(F.lit(3)).cast("int").alias(f"d{i}") for i in range(n)])
    rows = cells.withColumn("h", hilbert_shards.hilbert_index([f"d{i}" for i in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << n * bits))
    assert all(sum(abs(a[f"d{i}"] - b[f"d{i}"]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("chunk", [1, 3, 20_000])
def test_shards_are_even_and_gapless(spark, odd, chunk):
    big = odd.union(table(spark, [sentence(random.Random(i), 5) for i in range(90)]))
    rows = hilbert_shards.shard(big, chunk_rows=chunk).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == big.count() and set(by) == set(range(24))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    texts = {(r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8) for r in big.collect()}
    assert {(r.doc_id, r.text_crc32, r.size) for r in rows} == texts
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in rows)


def curve_index(x, bits):
    """The published transpose algorithm, for one point."""
    x, n = list(x), len(x)
    q = 1 << bits - 1
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << bits - 1
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    return sum(((v ^ t) >> b & 1) << b * n + n - 1 - i for i, v in enumerate(x) for b in range(bits))


def test_shards_equal_brute_force(spark):
    r = random.Random(12)
    ids = [None, -(2**63), 2**63 - 1, 0, 0, 5, *(r.randint(-(2**63), 2**63 - 1) for _ in range(150))]
    langs, sources = [None, "en", "en", "fr"], [None, *(f"s{i}" for i in range(20))]
    rows = [(i, r.choice([None, "", "tex t", sentence(r, 9)]), r.choice(langs), r.choice(sources), r.choice([None, 0, -3, 7, 900, 2**40])) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = [x for x in ids if x is not None]
    low, width = min(known), float((max(known) - min(known)) // 15 + 1)

    def code(values):
        order = sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))
        places = {v: i + 1 for i, (v, _) in enumerate(order[:14])}
        return lambda v: 0 if v is None else places.get(v, 15)

    lang_code, source_code = code([x[2] for x in rows]), code([x[3] for x in rows])

    def point(row):
        size = 0 if row[4] is None else min(15, len(f"{max(row[4], 0):b}"))
        return lang_code(row[2]), source_code(row[3]), size, 0 if row[0] is None else min(15, int((float(row[0]) - float(low)) // width) + 1)

    want = Counter((x[0], len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode()), *point(x), curve_index(point(x), 4)) for x in rows)
    got = hilbert_shards.shard(docs, chunk_rows=7).collect()
    assert Counter((x.doc_id, x.size, x.text_crc32, x.q_lang, x.q_source, x.q_size, x.q_id, x.hilbert) for x in got) == want
    base, more = divmod(len(rows), 24)
    sizes = Counter(x.shard for x in got)
    assert [sizes[i] for i in range(24)] == [base + (i < more) for i in range(24)]
    order = [x.hilbert for x in sorted(got, key=lambda x: (x.shard, x.slot))]
    assert order == sorted(order)


def test_equal_rows_are_one_until_they_have_slots(spark, monkeypatch):
    monkeypatch.setattr(hilbert_shards, "COPIES", 100)
    docs = table(spark, ["x"] * 3).where("doc_id = 0").withColumn("doc_id", F.lit(7).cast("long"))
    hot = docs.crossJoin(spark.range(3000).select(F.lit(1).alias("one"))).drop("one")
    rows, total = hilbert_shards.positions(hot.select("doc_id", "source", "lang", "n_chars", F.crc32(F.lit("x")).alias("text_crc32"), F.lit(1).alias("_bytes")), chunk_rows=50, once=True)
    assert total == 3000 and [r["_n"] for r in rows.collect()] == [3000]
    got = hilbert_shards.shard(hot.union(table(spark, ["y", None])), chunk_rows=50).collect()
    assert Counter(r.doc_id for r in got) == {7: 3000, 0: 1, 1: 1}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sorted(map(len, slots.values())) == [125] * 22 + [126] * 2


def test_written_shards_are_whole_and_prunable(spark, odd, tmp_path):
    docs = odd.withColumn("shard", F.lit("mine")).union(odd.withColumn("shard", F.lit("again")))
    hilbert_shards.write(docs, str(tmp_path / "out"), shards=4, file_rows=3)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert {x.shard_ for x in got.select("shard_").collect()} == set(range(4))
    assert len(list((tmp_path / "out").rglob("*.parquet"))) >= docs.count() // 3


def test_empty_tables(spark, none):
    assert hilbert_shards.shard(none).count() == 0
    assert licence_digests.scan(none, licence_digests.known_digests(spark)).count() == 0
    assert ngram_quality.quality(none).count() == 0
    assert language_fusion.identify(language_fusion.from_documents(none)).count() == 0
    assert icws_dedup.classes(none).count() == 0
    assert substring_dedup.dedup(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(none, items).count() == 0
    assert bpe_prefix.digests(none, *vocabulary()).count() == 0


def test_licences(spark):
    mit = next(t for n, t in licence_digests.TEXTS if n == "MIT")
    docs = table(spark, [mit, "Copyright (c) 2001 Someone\n" + mit.upper().replace(",", ";"), "Released under the MIT LICENCE!\nx", mit + " more", None, "© 2020 only"])
    got = {r.doc_id: r for r in licence_digests.scan(docs, licence_digests.known_digests(spark)).collect()}
    assert got[0].licence == got[1].licence == "MIT" and got[0].digest == got[1].digest
    assert got[2].licence is None and got[2].n_notices == 1 and got[2].notices == "MIT"
    assert got[3].licence is None and got[4].digest is None and got[5].digest is None


def test_published_licence_files(spark):
    import textwrap

    files = []
    for name, title in licence_digests.TITLES:
        text = next(t for n, t in licence_digests.TEXTS if n == name)
        for width in (40, 60, 72, 79, 100):
            body = "\n\n".join(textwrap.fill(part, width, break_long_words=False) for part in text.split("\n\n"))
            files += [(name, f"{title}\n\nCopyright (c) 2024 Acme Inc.\nCopyright Jane Doe <j@acme.example>\n© 2020-2024, Others. All rights reserved.\n\n{body}\n"), (name, f"Copyright 2001 Acme\r\n\r\n{body}"), (name, body)]
    docs = table(spark, [t for _, t in files])
    got = {r.doc_id: r.licence for r in licence_digests.scan(docs, licence_digests.known_digests(spark)).collect()}
    assert [got[i] for i in range(len(files))] == [n for n, _ in files]


def test_notices_of_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "x\nReleased under the MIT License."), (1, "y"), (None, "z")], "doc_id long, text string")
    got = licence_digests.scan(docs, licence_digests.known_digests(spark)).collect()
    assert sorted((str(r.doc_id), r.n_notices) for r in got) == [("1", 0), ("None", 1), ("None", 1)]


def base_rules(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def kneser_ney(texts):
    """A dictionary version of the model: log probability of the last byte of each 5-gram."""
    counts = {5: Counter()}
    for t in texts:
        for w in words(t):
            b = b"    " + w.encode() + b" "
            counts[5].update(b[i - 4 : i + 1] for i in range(4, len(b)))
    for n in range(4, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    p = {b"": 1 / 256}
    for n in range(1, 6):
        m = Counter(counts[n].values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] + 2 * m[2] else None
        d = {}
        for k in (1, 2, 3):
            value = k - (k + 1) * y * m[k + 1] / m[k] if y is not None and m[k] else None
            d[k] = value if value is not None and 0 < value < k else k - 0.5
        total, mass = Counter(), Counter()
        for g, c in counts[n].items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[min(c, 3)]
        p = {g: (c - d[min(c, 3)]) / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * p[g[1:]] for g, c in counts[n].items()}
    return {g: math.log(x) for g, x in p.items()}


@pytest.mark.parametrize("model_rows", [ngram_quality.MODEL_ROWS, 200])
def test_quality_equals_brute_force(spark, odd, model_rows):
    docs = odd.withColumn("lang", F.lit("en"))
    model = kneser_ney([r.text for r in docs.collect()])
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in ngram_quality.quality(docs, model_rows).collect():
        text = texts[r.doc_id]
        want = base_rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
        scores = [model[b[i - 4 : i + 1]] for w in words(text) for b in [b"    " + w.encode() + b" "] for i in range(4, len(b))]
        assert (r.log_ppl is None) == (not scores)
        if scores:
            assert math.isclose(r.log_ppl, -sum(scores) / len(scores), rel_tol=1e-4)


def test_bands_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = ngram_quality.quality(docs, across=True).collect()
    assert len(rows) == docs.count()
    scores: dict[str, list[float]] = {}
    for r in rows:
        if not r.base_failed:
            scores.setdefault(r.lang, []).append(r.log_ppl)
    for r in rows:
        mine = sorted(scores.get(r.lang, []))
        if r.base_failed or not mine:
            assert not r.kept
            continue
        q1, q3 = (mine[math.ceil(q * len(mine)) - 1] for q in (0.25, 0.75))
        reach = max(3.0 * (q3 - q1), 0.15) * (0.5 + math.sqrt(50 / r.n_words))
        assert math.isclose(r.low, q1 - reach, rel_tol=1e-9) and math.isclose(r.high, q3 + reach, rel_tol=1e-9)
        assert r.kept == (q1 - reach <= r.log_ppl <= q3 + reach)


def test_unknown_grams_are_unlikely(spark):
    docs = table(spark, [sentence(random.Random(1), 200)])
    own = docs.select("doc_id", "lang", "text")
    names = ngram_quality.shard_files(ngram_quality.kneser_ney(ngram_quality.counted_grams(own, True)), 1000)
    other = table(spark, ["QXZ JKW " * 30]).select("doc_id", "lang", "text")
    known, unknown = (ngram_quality.scored(x, names, True).first().log_ppl for x in (own, other))
    assert unknown > known + 0.5


@pytest.mark.parametrize("most", [1_000_000, 300, 40])
def test_unknown_grams_in_any_shard_and_language(spark, most):
    """A language of few 5-grams has none in some of the files; an unknown one has no score."""
    docs = table(spark, [sentence(random.Random(1), 200)]).union(table(spark, ["abcabcab"], lang="fi"))
    own = docs.select("doc_id", "lang", "text")
    model = ngram_quality.kneser_ney(ngram_quality.counted_grams(own, True))
    least = {r["lang"]: r["least"] for r in model.groupBy("lang").agg(F.min("logp").alias("least")).collect()}
    names = ngram_quality.shard_files(model, most)
    assert most > 40 or len(names) > 3
    for lang, floor in least.items():
        junk = table(spark, ["QXZJKW" * 9], lang=lang).select("doc_id", "lang", "text")
        assert ngram_quality.scored(junk, names, True).first().log_ppl > -floor * 0.8
    assert ngram_quality.scored(table(spark, ["QXZ JKW"], lang="xx").select("doc_id", "lang", "text"), names, True).first().log_ppl is None


def test_probabilities_sum_to_one():
    model = kneser_ney(["abc abd abe xyz xya"] * 2)
    for context in {g[:-1] for g in model}:
        assert sum(math.exp(x) for g, x in model.items() if g[:-1] == context) <= 1 + 1e-9


def test_unlikely_text_is_rejected(spark):
    r = random.Random(1)
    known = sentence(r, 300).split()
    good = [" ".join(r.choice(known) for _ in range(120)) for _ in range(60)]
    junk = " ".join("".join(r.choice("QXZJKW0123456789%$") for _ in range(6)) for _ in range(80))
    docs = table(spark, [*good, junk])
    kept = {x.doc_id: x.kept for x in ngram_quality.quality(docs).collect()}
    assert not kept[60] and all(kept[i] for i in range(60))


def kneser_ney_runs(texts):
    """The model over whole texts: the brute-force one, fed each text as one run between spaces."""
    import sys

    joined = [" ".join(words(t)) for t in texts]
    own = sys.modules[__name__]
    inside, own.words = own.words, lambda t: [t] if t else []
    try:
        return kneser_ney(joined)
    finally:
        own.words = inside


@pytest.mark.parametrize("model_rows", [ngram_quality.MODEL_ROWS, 200])
def test_running_quality_equals_brute_force(spark, odd, model_rows):
    docs = odd.withColumn("lang", F.lit("en"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = kneser_ney_runs([r.text for r in docs.collect()])
    rows = ngram_quality.quality(docs, model_rows, across=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        run = " ".join(words(texts[r.doc_id]))
        b = b"    " + run.encode() + b" "
        scores = [model[b[i - 4 : i + 1]] for i in range(4, len(b))] if run else []
        assert (r.log_ppl is None) == (not scores)
        if scores:
            assert math.isclose(r.log_ppl, -sum(scores) / len(scores), rel_tol=1e-4)


def test_query_scores_shuffled_words_worse(spark, tmp_path):
    r = random.Random(8)
    known = sentence(r, 1000).split()
    follows = {w: r.sample(known, 2) for w in known}
    texts = []
    for _ in range(60):
        run = [r.choice(known)]
        while len(run) < 120:
            run.append(r.choice(follows[run[-1]]))
        texts.append(" ".join(run))
    salad = texts[0].split()
    r.shuffle(salad)
    table(spark, [*texts, " ".join(salad)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in ngram_quality.op3_ngram_quality(spark, str(tmp_path)).collect()}
    assert got[0].kept
    assert got[60].log_ppl > got[0].log_ppl + 0.05


def test_language(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language_fusion.identify(language_fusion.from_documents(docs)).collect()
    assert sum(r.lang == r.declared for r in found) >= 0.98 * len(found)
    got = {r.id: r for r in language_fusion.identify(language_fusion.from_documents(odd)).collect()}
    assert not got[0].kept and not got[1].kept and got[0].lang is None and got[4].kept


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars > 200").withColumn("odd", F.col("doc_id") % 2)
    rows = language_fusion.from_documents(docs)
    langs, model = language_fusion.fit(rows.where("id % 2 = 0"))
    seen = language_fusion.text_evidence(rows.where("id % 2 = 1"), langs, model).collect()
    assert np.mean([langs[int(np.argmax(r.evidence))] == r.declared for r in seen]) > 0.95


def test_host_prior_decides_short_texts(spark):
    r = random.Random(2)
    texts = [("fr", "le la et de la ville " * 5, f"h{i % 3}.example.fr") for i in range(30)] + [("en", "the and of the town " * 5, f"e{i % 3}.example.org") for i in range(30)]
    rows = [(i, t, lang, host, None) for i, (lang, t, host) in enumerate(texts)] + [(100, "zqx", None, "h0.example.fr", None), (101, "zqx", None, "e0.example.org", None)]
    got = {x.id: x.lang for x in language_fusion.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")).collect()}
    assert got[100] == "fr" and got[101] == "en" and r


def weighted(text, idf):
    w = [x.lower() for x in words(text)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    value = {x: float(idf[icws_dedup._bucket(textkit.words(pa.array([x])).hash)[0]]) for x in set(w)}
    return {g: n * round(sum(value[x] for x in g) / len(g), 4) for g, n in Counter(grams).items()}


def similarity(a, b):
    return sum(min(v, b.get(k, 0)) for k, v in a.items()) / max(1e-9, sum(a.values()) + sum(b.values()) - sum(min(v, b.get(k, 0)) for k, v in a.items()))


def test_near_duplicates_equal_brute_force(spark, odd):
    r = random.Random(5)
    texts, common = [], sentence(r, 60)
    for _ in range(12):
        base = sentence(r, 120).split()
        for edits in (0, 1, 2, 4, 9):
            x = list(base)
            for _ in range(edits):
                x[r.randrange(len(x))] = sentence(r, 1)
            texts.append(" ".join(x))
    texts += [common + " " + sentence(r, 30) for _ in range(40)] + ["a b c", "A b  c", "", None]
    docs = table(spark, texts)
    idf = icws_dedup.idf_table(docs)
    sets = [weighted(t, idf) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {x.doc_id: x.class_id for x in icws_dedup.classes(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    rows = icws_dedup.classes(odd).collect()
    assert {x.class_id for x in rows if x.doc_id in (4, 5)} == {4} and {x.class_id for x in rows if x.doc_id in (0, 1, 2)} == {0, 1, 2}


def test_weighted_jaccard_equals_brute_force():
    idf = np.linspace(1, 9, 1 << icws_dedup.IDF_BITS).astype(np.float32)
    r = random.Random(4)
    left = [sentence(r, n) for n in (0, 3, 5, 40, 200)]
    right = [x + " " + sentence(r, 3) for x in left]
    got = icws_dedup.weighted_jaccard(pa.array(left), pa.array(right), idf)
    want = [similarity(weighted(a, idf), weighted(b, idf)) for a, b in zip(left, right, strict=True)]
    assert np.allclose(got, want, rtol=1e-4)


def test_sample_collisions_follow_weighted_jaccard():
    r = random.Random(6)
    a = [sentence(r, 1) for _ in range(400)]
    b = a[:300] + [sentence(r, 1) for _ in range(100)]
    idf = np.ones(1 << icws_dedup.IDF_BITS, np.float32)
    doc, h, w = icws_dedup.weighted_sets(pa.array([" ".join(a), " ".join(b)]), idf)
    s = icws_dedup.signatures(doc, h, w, 2)
    sim = icws_dedup.weighted_jaccard(pa.array([" ".join(a)]), pa.array([" ".join(b)]), idf)[0]
    assert abs((s[0] == s[1]).mean() - sim) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[102] == 100 and 200 not in got


def brute_windows(rows, n=13):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < doc for j in range(i, i + n)}
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2, 500])
def test_substrings_equal_brute_force(spark, hot):
    r = random.Random(8)
    passages = [sentence(r, n) for n in (12, 13, 14, 30, 80)]
    texts = []
    for _ in range(60):
        parts = [sentence(r, r.randint(0, 30)) for _ in range(3)]
        texts.append(r.choice([" ", "\n", "\t "]).join(x for p in parts for x in (p, r.choice([*passages, ""]))))
    texts += [texts[3], texts[3] + " x", None, "", "the " * 70, "the " * 60, " ".join(texts[5].split())]
    docs = table(spark, texts)
    kept = substring_dedup.dedup(docs, hot=hot)
    got = kept.select("doc_id", "n_words", "n_removed", F.sha2(F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), 256).alias("s")).collect()
    assert sorted(map(tuple, got)) == brute_windows(list(enumerate(texts)))


def test_a_common_passage_is_few_spans_of_a_document(spark):
    """Windows of common passages are cut from the distinct spans only, so a document has a row a span and not a row a window."""
    r = random.Random(31)
    passage = sentence(r, 150)
    docs = table(spark, [f"{sentence(r, 10)} {passage} {sentence(r, 10)}" for _ in range(12)])
    rows = docs.select("doc_id", F.col("doc_id").alias("h1"), "text")
    found = {x.doc_id: x.spans for x in substring_dedup.removed_windows(rows, hot=3).collect()}
    assert sorted(found) == list(range(1, 12))
    assert all(sum(bin(s.mask).count("1") for s in spans) == 138 for spans in found.values())
    assert max(map(len, found.values())) < 138 / 2


def test_hot_spans_grow_with_the_table(spark, monkeypatch):
    """A phrase in one of 200 documents is as hot in a large table as in a small one, so windows are cut of no larger share of its spans."""
    r = random.Random(37)
    phrases = [sentence(r, 7) for _ in range(200)]
    texts = [f"{sentence(r, 12)} {phrases[i % 200]} {sentence(r, 12)}" for i in range(3000)]
    hot = []
    marked = substring_dedup._marked

    def counted(references, window):
        hot.append(references.where("hot").count())
        return marked(references, window)

    monkeypatch.setattr(substring_dedup, "_marked", counted)
    for n in (600, 3000):
        substring_dedup.dedup(table(spark, texts[:n]), hot=3)
    assert hot[1] <= 5 * hot[0] + 50


def test_marks_of_many_spans_equal_those_of_one_automaton():
    """A group of spans larger than a shard is dealt to several, and its windows have the marks of one automaton over all."""
    r = random.Random(41)
    phrase, passage = sentence(r, 6).split(), sentence(r, 21).split()
    spans = [(r.randint(0, 90), " ".join(r.choice([["a"], [], phrase]) + r.choice(["b c", "d e f", "g"]).split() + phrase + r.choices(["h", "i", "j"], k=r.randint(8, 30)))) for _ in range(200)]
    spans += [(k % 7, " ".join(passage[k % 5 : 14 + k % 8])) for k in range(40)] + [(5, "the " * 40 + "the"), (9, "the " * 20 + "the"), (9, "the " * 59 + "the")]
    spans = [(doc, span) for doc, span in spans if span.count(" ") >= 12]
    whole = substring_dedup._marks(spans, 13)
    assert any(whole)
    for most in (0, 50, 500, 5000):
        assert substring_dedup._bounded_marks(spans, 13, most=most) == whole


def test_substrings_of_a_large_group_equal_brute_force(spark):
    """A phrase of more words of context than a shard may have, in documents that aren't enough to make it hot."""
    r = random.Random(43)
    phrase = sentence(r, 6)
    texts = [f"{r.choice('abc')} {sentence(r, 9)} {phrase} {sentence(r, 9)}" for _ in range(5000)]
    texts += [" ".join(text.split()[k % 3 : 17 + k % 9]) for k, text in enumerate(texts[:60])]
    docs = table(spark, texts)
    kept = substring_dedup.dedup(docs, hot=10_000)
    got = kept.select("doc_id", "n_words", "n_removed", F.sha2(F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), 256).alias("s")).collect()
    assert sorted(map(tuple, got)) == brute_windows(list(enumerate(texts)))


def test_substrings_of_odd_rows(spark, odd):
    rows = substring_dedup.dedup(odd).collect()
    assert len(rows) == odd.count()
    assert {r.n_removed for r in rows if r.doc_id == 4} == {0} and {r.n_removed for r in rows if r.doc_id == 5} == {40}


def test_automaton_matching_statistics():
    r = random.Random(9)
    auto, known = substring_dedup.SuffixAutomaton(), []
    for _ in range(12):
        seq = [r.choice("ab") for _ in range(r.randint(1, 12))]
        auto.add(seq)
        known.append("".join(seq))
    for _ in range(40):
        seq = [r.choice("abc") for _ in range(15)]
        for i, got in enumerate(auto.matching(seq)):
            want = max(n for n in range(i + 2) if any("".join(seq[i + 1 - n : i + 1]) in k for k in known))
            assert got == want


@pytest.mark.parametrize("most", [decontaminate.SKETCH_MOST, 0])
def test_a_template_of_many_items_names_no_candidates(spark, most):
    r = random.Random(17)
    template = "which of the following is the best answer to the question about "
    items = [template + sentence(r, 9) for _ in range(500)] + [template]
    docs = [template + sentence(r, 30) for _ in range(40)] + ["x " + items[k] + " y" for k in (3, 77)]
    table_of_items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    sketches = decontaminate.item_sketches(table_of_items).collect()
    seen = Counter(h for x in sketches for h in x.sketch)
    assert all(n == 1 for h, n in seen.items()) or max(seen.values()) <= decontaminate.COMMON
    assert all(len(x.sketch) == x.q - x.needed + 1 for x in sketches)
    got = {(x.doc_id, x.item_id) for x in decontaminate.contained(table(spark, docs), table_of_items, sketch_most=most).collect()}
    assert got == {(40, 3), (41, 77)} | {(k, 500) for k in range(42)}


@pytest.mark.parametrize("most", [decontaminate.SKETCH_MOST, 0])
def test_containment_equals_brute_force(spark, odd, most):
    r = random.Random(10)
    items = [sentence(r, n) for n in (4, 5, 6, 12, 40, 41)] + [None, ""]
    docs = []
    for k in range(40):
        w = r.choice(items[:6]).split()
        for _ in range(k % 4):
            w[r.randrange(len(w))] = "zz"
        docs.append(sentence(r, r.choice([0, 50, 2000])) + " " + " ".join(w).upper() + ", " + sentence(r, 10))

    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = set()
    for d, text in enumerate(docs):
        for i, item in enumerate(items):
            q = shingles(item)
            if q and len(q & shingles(text)) >= math.ceil(0.8 * len(q) - 1e-9):
                want.add((d, i, len(q), len(q & shingles(text))))
    table_of_items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contained(table(spark, docs), table_of_items, sketch_most=most).collect()
    assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got} == want and len(got) == len(want)
    assert decontaminate.contained(odd, table_of_items, sketch_most=most).count() == 0


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path(bpe_prefix.VOCABULARY), public_tokenizers.PATTERN


def reference_encoding():
    import tiktoken

    path, pattern = vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe_prefix.load(path).ranks, special_tokens={})


def test_encoding_equals_the_library(spark, odd, sf_dir):
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 1000, "text")).union(spark.createDataFrame([(7777, "a<|endoftext|>'ll  \n\n x")], "doc_id long, text string"))
    texts, library = {r.doc_id: r.text or "" for r in docs.collect()}, reference_encoding()
    for r in bpe_prefix.tokenized(docs, *vocabulary()).collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.round_trip and r.n_tokens == len(r.ids)
    for r in bpe_prefix.digests(docs, *vocabulary()).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_prefix_tables_append_and_edit():
    bpe, r = bpe_prefix.load(vocabulary()[0]), random.Random(11)
    library = reference_encoding()._core_bpe
    for _ in range(300):
        data = bytes(r.choice(b"abcdeth in\xc3\xa9\xff") for _ in range(r.randint(1, 120)))
        table_of = bpe.extend(data, [])
        assert bpe.tokens(table_of) == library.encode_single_piece(data)
        more = bytes(r.choice(b"abcdeth") for _ in range(5))
        assert bpe.extend(data + more, list(table_of)) == bpe.extend(data + more, [])
        i = r.randrange(len(data))
        new, edited = bpe.replace(data, table_of, i, min(len(data), i + 3), b"th")
        assert edited == bpe.extend(new, [])
        assert bpe.decode(bpe.tokens(edited)) == new


@pytest.mark.parametrize("run", ["a" * 300_000, " " * 300_000 + "b"])
def test_long_runs_are_encoded_in_linear_space(run):
    path, pattern = vocabulary()
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe_prefix.load(path).ranks, special_tokens={})
    pieces = bpe_prefix.Pieces(bpe_prefix.load(path))
    got = [i for group in bpe_prefix.matches(iter([run]), pattern) for _, part in group for p in part for i in pieces.of([part])[p]]
    assert got == library.encode_ordinary(run)
    # A long piece is forgotten with the next texts, and its table is one number a byte.
    assert not any(len(p) > bpe_prefix.SHORT_CHARS for p in pieces.of([["a"]]))
    assert len(pieces.bpe.extend(run.encode(), [])) == len(run)


def test_remembered_pieces_are_bounded():
    bpe, r = bpe_prefix.load(vocabulary()[0]), random.Random(5)
    pieces = bpe_prefix.Pieces(bpe, most=50)
    for _ in range(40):
        part = ["".join(r.choice("abcxyz") for _ in range(r.randint(1, bpe_prefix.SHORT_CHARS + 9))) for _ in range(20)]
        known = pieces.of([part, part[:3]])
        assert all(list(known[p]) == bpe.encode(p.encode()) for p in part)
        assert len(known) <= 50 + 20


def test_texts_in_several_parts_are_encoded_as_one(spark, monkeypatch):
    monkeypatch.setattr(bpe_prefix, "CHUNK_CHARS", 40)
    r, (path, pattern) = random.Random(7), vocabulary()
    texts = [None, "", "a", *(sentence(r, n) for n in (3, 30, 1, 400, 2)), "", sentence(r, 90)]
    got: dict[int, list[str]] = {}
    for group in bpe_prefix.matches(iter(texts), pattern):
        for row, part in group:
            got.setdefault(row, []).extend(part)
    assert [got.get(i, []) for i in range(len(texts))] == [bpe_prefix.regex.findall(pattern, t or "") for t in texts]


def test_long_texts_equal_the_library(spark):
    r, library = random.Random(8), reference_encoding()
    long = sentence(r, 700_000)
    docs = table(spark, ["a b", long, None, "c", long[:2_500_000]])
    texts = {x.doc_id: x.text or "" for x in docs.collect()}
    for x in bpe_prefix.tokenized(docs, *vocabulary()).collect():
        assert x.ids == library.encode_ordinary(texts[x.doc_id]) and x.round_trip and x.n_tokens == len(x.ids)
    for x in bpe_prefix.digests(docs, *vocabulary()).collect():
        ids = library.encode_ordinary(texts[x.doc_id])
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest()


def test_rare_and_long_languages_have_a_class(spark):
    kind = "id long, text string, declared string, host string, suffix string"
    many = spark.range(9000).selectExpr("id", "concat('the town and ', id) AS text", "'en' AS declared", "'a' AS host", "CAST(NULL AS STRING) AS suffix")
    rare = spark.createDataFrame([(9001, "kaupunki ja talo " * 3, "fi", "b", None), (9002, "la ville et le pays " * 400, "fr", "c", None)], kind)
    langs, table_of = language_fusion.fit(many.union(rare))
    assert langs == ["en", "fi", "fr"] and table_of.shape[1] == 3
    got = {r.id: r for r in language_fusion.identify(many.union(rare)).where("id > 9000").collect()}
    assert got[9001].lang == "fi" and got[9002].lang == "fr" and got[9001].kept and got[9002].kept
    assert language_fusion.identify(rare.where("id = 9002")).first().kept


def test_two_hundred_languages(spark):
    """Plans don't grow with the languages; tags beyond the largest classes say nothing."""
    import time

    r, letters = random.Random(11), "abcdefghijklmnopqrstuvwxyz"
    tags = [a + b for a in letters[:8] for b in letters[:25]]
    own = {t: ["".join(r.choice(letters) for _ in range(r.randint(3, 7))) for _ in range(25)] for t in tags}
    rows = [(i, " ".join(r.choice(own[t]) for _ in range(25)), t, f"{t}.example.org", None) for i, t in enumerate(tags * 4)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    start = time.time()
    found = language_fusion.identify(df)
    found._jdf.queryExecution().executedPlan()
    assert len(tags) == 200 and time.time() - start < 60
    start = time.time()
    assert found.select("lang")._jdf.queryExecution().executedPlan() is not None and time.time() - start < 2
    got = found.collect()
    assert sum(x.lang == x.declared for x in got) >= 0.99 * len(rows) and all(x.kept for x in got)


def test_classes_are_the_largest_tags(spark, monkeypatch):
    monkeypatch.setattr(language_fusion, "MOST_LANGS", 2)
    kind = "id long, text string, declared string, host string, suffix string"
    rows = [(i, "the town and the country", "en", "a", None) for i in range(4)] + [(10 + i, "la ville et le pays", "fr", "a", None) for i in range(3)] + [(20 + i, "kaupunki ja talo", "fi", "a", None) for i in range(2)]
    langs, _ = language_fusion.fit(spark.createDataFrame(rows, kind))
    assert langs == ["en", "fr"]
    got = {x.id: x for x in language_fusion.identify(spark.createDataFrame(rows, kind)).collect()}
    assert all(got[i].lang == "en" for i in range(4)) and all(got[10 + i].lang == "fr" for i in range(3)) and got[20].declared == "fi" and got[20].lang in langs


def fused(rows):
    """Languages and posteriors by plain loops, given the text evidence (id, declared, host, suffix, lettered, evidence)."""
    seen, langs = rows
    n = len(langs)
    norm = lambda s: [math.exp(x - max(s)) / sum(math.exp(y - max(s)) for y in s) for x in s]
    domain = lambda h: re.search(r"[^.]*\.?[^.]*$", h).group(0)
    own, above, whole = {}, {}, [0.0] * n
    for x in seen:
        if x.lettered:
            for k, m in enumerate(norm(x.evidence)):
                own.setdefault(x.host, [0.0] * n)[k] += m
                above.setdefault(domain(x.host), [0.0] * n)[k] += m
                whole[k] += m
    corpus = [(m + 1) / (sum(whole) + n) for m in whole]
    out = []
    for x in seen:
        prior = [1 / n] * n
        if x.host in own:
            a, h = above[domain(x.host)], own[x.host]
            over = [(a[k] + 10 * corpus[k]) / (sum(a) + 10) for k in range(n)]
            prior = [(h[k] + 10 * over[k]) / (sum(h) + 10) for k in range(n)]
        score = [x.evidence[k] + math.log(prior[k]) for k in range(n)]
        for tag, sure in ((x.declared, 0.9), (x.suffix, 0.8)):
            if tag in langs:
                score = [s + math.log(sure if lang == tag else (1 - sure) / max(1, n - 1)) for s, lang in zip(score, langs, strict=True)]
        best = max(norm(score))
        out.append((x.id, langs[norm(score).index(best)] if x.lettered else None, round(best, 9) if x.lettered else None, x.lettered and best >= 0.5))
    return out


def test_fusion_is_that_of_plain_loops(spark, sf_dir, odd):
    docs, pages = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "pages"))
    mixed = language_fusion.from_documents(docs).where("id % 3 = 0").withColumn("declared", F.when(F.col("id") % 2 == 0, F.col("declared")).otherwise("xx"))
    for rows in (mixed.union(language_fusion.from_documents(odd)), language_fusion.from_pages(pages)):
        langs, model = language_fusion.fit(rows)
        want = fused((language_fusion.text_evidence(rows, langs, model).collect(), langs))
        got = [(x.id, x.lang, None if x.posterior is None else round(x.posterior, 9), x.kept) for x in language_fusion.identify(rows).collect()]
        assert Counter(got) == Counter(want)


def rows_of(df, *columns):
    return Counter(tuple(x) for x in df.select(*columns).collect())


@pytest.mark.parametrize(
    ("module", "switches", "query", "columns"),
    [
        (licence_digests, {"KNOWN_MOST": 0}, lambda s, d, i: licence_digests.scan(d, licence_digests.known_digests(s)), ("doc_id", "digest", "licence", "n_notices", "notices")),
        (language_fusion, {"BROADCAST_HOSTS": 0}, lambda s, d, i: language_fusion.identify(language_fusion.from_documents(d)), ("id", "lang", "kept")),
        (icws_dedup, {"CROWD": 2, "PART_PAIRS": 1, "BROADCAST_CENTRES": 0}, lambda s, d, i: icws_dedup.classes(d), ("doc_id", "rep", "class_id")),
        (ngram_quality, {"BANDS_MOST": 0}, lambda s, d, i: ngram_quality.quality(d, across=True), ("doc_id", "kept", "n_words")),
        (decontaminate, {"SKETCH_MOST": 0}, lambda s, d, i: decontaminate.contained(d, i, sketch_most=decontaminate.SKETCH_MOST), ("doc_id", "item_id", "n_shared")),
        (decontaminate, {"SKETCH_MOST": 0, "BROADCAST_HASHES": 0}, lambda s, d, i: decontaminate.contained(d, i, sketch_most=decontaminate.SKETCH_MOST), ("doc_id", "item_id", "n_shared")),
    ],
)
def test_other_plans_give_the_same_rows(spark, sf_dir, monkeypatch, module, switches, query, columns):
    docs, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    usual = rows_of(query(spark, docs, items), *columns)
    for name, value in switches.items():
        monkeypatch.setattr(module, name, value)
    assert rows_of(query(spark, docs, items), *columns) == usual


def test_crowded_buckets_are_reached(spark, monkeypatch):
    r = random.Random(21)
    base = sentence(r, 200).split()
    texts = []
    for _ in range(60):
        x = list(base)
        for _ in range(3):
            x[r.randrange(len(x))] = sentence(r, 1)
        texts.append(" ".join(x))
    docs = table(spark, texts)
    called = []
    prefixes = icws_dedup.rare_first_prefixes
    monkeypatch.setattr(icws_dedup, "rare_first_prefixes", lambda *a: called.append(a[0].count()) or prefixes(*a))
    got = {x.doc_id: x.class_id for x in icws_dedup.classes(docs).collect()}
    assert called and called[0] > icws_dedup.CROWD
    idf = icws_dedup.idf_table(docs)
    sets = [weighted(t, idf) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                a, b = min(label[i], label[j]), max(label[i], label[j])
                label = [a if x == b else x for x in label]
    assert got == dict(enumerate(label))


def test_texts_and_ids_never_meet(spark):
    """Ids over the whole range of a long, rows without one and texts whose hashes agree in 64 bits stay apart."""
    r = random.Random(31)
    texts = [sentence(r, 60) for _ in range(5)]
    hashes = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t)").collect()]
    rows = [(-(2**63), texts[0]), (2**63 - 1, texts[1]), (None, texts[2]), ((1 << 62) + ((hashes[2] % 2**64) >> 2), texts[3]), (None, texts[4]), (5, texts[4] + " x"), (6, texts[0])]
    got = icws_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_no = {}
    for x in got:
        by_no.setdefault(x.class_no, set()).add(x.doc_id)
    assert sorted(map(str, by_no.values())) == sorted(map(str, [{-(2**63), 6}, {2**63 - 1}, {None}, {rows[3][0]}, {None, 5}]))
    assert {x.doc_id: x.class_id for x in got if x.doc_id is not None} == {-(2**63): -(2**63), 6: -(2**63), 2**63 - 1: 2**63 - 1, rows[3][0]: rows[3][0], 5: 5}


def test_rows_without_an_id(spark):
    r = random.Random(22)
    one, two = sentence(r, 80), sentence(r, 80)
    near = one + " " + sentence(r, 2)
    docs = spark.createDataFrame([(None, one), (None, one), (7, near), (None, two), (9, two), (None, None), (None, " ")], "doc_id long, text string")
    got = icws_dedup.classes(docs).collect()
    classes = {}
    for x in got:
        classes.setdefault(x.class_id, set()).add(x.doc_id)
    assert classes[7] == {7, None} and classes[9] == {9, None} and all(x.rep is not None for x in got)
    kept = substring_dedup.dedup(docs).collect()
    assert sorted((str(x.doc_id), x.n_removed) for x in kept) == sorted([("None", 0), ("None", 0), ("7", 80), ("None", 0), ("9", 80), ("None", 0), ("None", 0)])
