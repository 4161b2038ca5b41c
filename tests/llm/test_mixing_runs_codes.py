"""Periodic runs, the mix of sources and vector codes against brute force."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from webquarry.llm import periodic_runs, source_mixture, textkit, vector_codes


def brute_runs(w, shortest):
    """All maximal stretches of equal words at each distance, the shorter periods first."""
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(2 * q, shortest) and not any(a <= start and b >= i + q for a, b, p in found):
                found.append((start, i + q, q))
            i += i == start or i + q < len(w)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("base", [periodic_runs._BASE, 1, 0])
def test_runs_are_those_of_brute_force_with_good_and_bad_hashes(base):
    r = random.Random(base)
    for _ in range(700):
        n, k = r.randint(0, 40), r.choice([1, 2, 2, 3, 4])
        w = [r.randint(1, k) for _ in range(n)]
        if n and r.random() < 0.3:
            a = r.randrange(n)
            p = 1 + r.randrange(max(1, (n - a) // 2))
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        shortest = r.choice([1, 2, 4, 12])
        two = np.array([*w, 0, *w[::-1], -1], np.int64)
        want = brute_runs(w, shortest) + [(s + n + 1, e + n + 1, q) for s, e, q in brute_runs(w[::-1], shortest)]
        assert list(map(tuple, periodic_runs.find(two, shortest, base).tolist())) == want


def test_long_words_of_runs():
    fibonacci = [1], [1, 2]
    while len(fibonacci[1]) < 3000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    for w in ([1] * 3000, [1, 2] * 1500, [1 + bin(i).count("1") % 2 for i in range(3000)]):
        assert list(map(tuple, periodic_runs.find(np.array(w, np.int64)).tolist())) == brute_runs(w, 12)
    # Runs theorem: fewer runs than words.
    assert 100 < len(periodic_runs.find(np.array(fibonacci[1], np.int64))) < len(fibonacci[1])


TEXTS = [None, "", " \n\t", "a", "a " * 30, "x a b c a b c a b c a b c y", "é\tü " * 9, " ".join(f"w{i}" for i in range(300)), ("p q r s t u v " * 4) + "z", "a " * 11, "a b " * 6 + "c " * 12]


def test_repetitions_of_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i // 2 if i != 4 else None, t, t) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, runs string")
    want = []
    for i, t in enumerate(TEXTS * 2):
        w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        runs = brute_runs(w, 12)
        gone = {k for s, e, q in runs for k in range(s + q, e)}
        want.append((i // 2 if i != 4 else None, [(s, e - s, q) for s, e, q in runs], " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.kept_text) for r in periodic_runs.repetitions(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs.repetitions(docs.limit(0)).collect() == []


def test_words_with_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    texts = pa.array([t for t in TEXTS] + ["ab ba " * 7 + "ab ab " * 7])
    true = periodic_runs.of_words(textkit.words(texts))
    w = textkit.words(texts)
    w.hash = (w.end - w.start).astype(np.uint64)
    for a, b in zip(periodic_runs.of_words(w), true, strict=True):
        assert np.array_equal(a, b)


def test_planted_ends(spark):
    import zlib

    texts = [None, "", "a b c d e f g h i j", " ".join(f"w{i}" for i in range(97))]
    docs = spark.createDataFrame([(i, texts[i % 4], 1) for i in range(200)] + [(None, "x y", 1)], "doc_id long, text string, a int")
    for r in periodic_runs.planted(docs).collect():
        t = "x y" if r.doc_id is None else texts[r.doc_id % 4]
        w, h = (t or "").split(), zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            assert r.text == " ".join(w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w)))
        else:
            assert r.text == t


def test_digests_are_those_of_sql(spark, sf_dir):
    for module, name in ((periodic_runs, "op11_periodic_runs"), (vector_codes, "op13_vector_codes")):
        df = module.QUERIES[name](spark, sf_dir)
        columns = sorted(df.columns)
        db = duckdb.connect()
        for table in ("documents", "embeddings"):
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        want = db.sql(module.ORACLES[name]).select(*[f'"{c}"' for c in columns]).fetchall()
        assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def brute_codes(rows, entries, rounds, parts=4):
    """Codes, errors and codebooks with Python's integers alone."""
    kept = [(i, label, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, label, v in rows if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))
    m = len(kept[0][2]) // parts
    cut = [[v[p * m : (p + 1) * m] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            for k in set(own):
                mine = [c[p] for c, o in zip(cut, own, strict=True) if o == k]
                books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return [(i, label, bytes(k for _, k in f), sum(d for d, _ in f)) for (i, label, _), f in zip(kept, found, strict=True)], books


def test_vector_codes_are_those_of_brute_force(spark):
    r = random.Random(3)
    rows = [(i if i % 17 else None, r.choice([None, 1, 2]), [r.choice([0.5, -0.25, 0.001, -0.0009, r.gauss(0, 1)]) for _ in range(8)]) for i in range(120)]
    rows += [(5, 1, [0.5] * 8)] * 30 + [(7, 2, None), (8, 2, []), (9, 2, [1.0, None] * 4), (10, 2, [float("nan")] * 8), (11, 2, [float("inf")] * 8), (12, 2, [1.0] * 3)]
    df = spark.createDataFrame([(i, label, v, "x") for i, label, v in rows], "vec_id long, label int, embedding array<float>, error string")
    got, books = vector_codes.compressed(df, entries=16)
    want, want_books = brute_codes(rows, 16, 4)
    assert books.tolist() == want_books
    total = Counter()
    for _, label, _, e in want:
        total[label] += e
    assert sorted(((x.vec_id, x.label, bytes(x.codes), x.error, x.label_error) for x in got.collect()), key=repr) == sorted(((*w, total[w[1]]) for w in want), key=repr)
    near = {(x.vec_id, bytes(x.codes)): x.approximate for x in vector_codes.decoded(got, books).collect()}
    for i, _, codes, _ in want:
        assert near[i, codes] == [c / 1024 for p in range(4) for c in want_books[p][codes[p]]]


def test_screening_never_loses_a_tie_or_a_near_entry():
    r = np.random.default_rng(1)
    for scale in (3, 1000, 1 << 20, 1 << 27):
        book = r.integers(-scale, scale, (200, 16))
        book[50], book[60] = book[10], book[10]
        x = np.concatenate([r.integers(-scale, scale, (300, 16)), book[50:61], book[:50] + r.integers(-1, 2, (50, 16)), (book[:40] + book[40:80]) // 2])
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        index, error = vector_codes.nearest(x, book)
        assert np.array_equal(index, d.argmin(1)) and np.array_equal(error, d.min(1))


def test_huge_components_and_empty_tables(spark):
    kind = "vec_id long, label int, embedding array<float>"
    got, _ = vector_codes.compressed(spark.createDataFrame([(1, None, [3e38, -3e38, 0.0, 1.0]), (2, None, [0.0] * 4), (3, None, [0.0] * 8)], kind))
    # The vector of another length than the first's isn't coded.
    assert [(x.vec_id, bytes(x.codes), x.error) for x in got.orderBy("vec_id").collect()] == [(1, b"\0" * 4, 0), (2, b"\1\1\0\1", 0)]
    got, books = vector_codes.compressed(spark.createDataFrame([], kind))
    assert got.collect() == [] and vector_codes.books_text(books) == ""


def wanted(rows):
    """Words of each source and its target, by filling up to the most of each."""
    size = Counter()
    for _, source, text in rows:
        size[source] += len((text or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        more = {s for s, t in share.items() if t > 3 * size[s]}
        if not more:
            return {s: (size[s], 3.0 * size[s] if s in full else share[s]) for s in order}
        full |= more


@pytest.mark.parametrize("small", [True, False])
def test_mix_takes_what_it_should(spark, monkeypatch, small):
    # Many blocks, shards, chunks and copies, and tables that aren't broadcast.
    monkeypatch.setattr(source_mixture, "BLOCK_WORDS", 7)
    monkeypatch.setattr(source_mixture, "SHARD_SLOTS", 50)
    monkeypatch.setattr(source_mixture, "CHUNK_ROWS", 5)
    monkeypatch.setattr(source_mixture, "COPIES", 10)
    if not small:
        monkeypatch.setattr(source_mixture, "BROADCAST_ROWS", 0)
    r = random.Random(7)
    rows = [(i if i % 9 else None, r.choice(["a", "b", "b", "b", "é", "\U00010000", "￿", None]), " ".join(f"w{i}x{k}" for k in range(r.choice([0, 1, 3, 7, 20, 90])))) for i in range(200)]
    rows += [(5, "b", "one two three")] * 35 + [(6, "b", ""), (7, "b", None), (8, "tiny", "x"), (9, "none", None)]
    docs = spark.createDataFrame([(i, s, t, 1) for i, s, t in rows], "doc_id long, source string, text string, taken int")
    mix = source_mixture.Mixture(docs)
    got = mix.taken().collect()
    want = wanted(rows)
    assert Counter((x.doc_id, x.size, x.source_size, round(x.target, 6)) for x in got) == Counter((i, len((t or "").split()), want[s][0], round(want[s][1], 6)) for i, s, t in rows)
    assert all(0 <= x.taken <= 3 * x["size"] for x in got)
    sums = Counter()
    for x in got:
        sums[x.source_size, round(x.target, 6)] += x.taken
    for size, target in set(want.values()):
        alike = sum(v == (size, target) for v in want.values())
        assert abs(sums[size, round(target, 6)] - alike * target) <= alike * 0.5
    # Another partitioning gives the same rows.
    again = source_mixture.Mixture(docs.repartition(7).sortWithinPartitions(F.desc("text"))).taken()
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
    # The texts of the slots have the words that are counted, each source's own ones.
    texts = mix.texts().collect()
    words = Counter((x.source, w) for x in texts for w in x.text.split())
    assert sum(words.values()) == sum(x.words for x in texts) == sum(x.taken for x in got)
    own = Counter((s, w) for _, s, t in rows for w in (t or "").split())
    assert all(words[k] <= 3 * own[k] for k in words)
    assert sorted((x.shard, x.slot) for x in texts) == [(s, k) for s, n in sorted(Counter(x.shard for x in texts).items()) for k in range(n)]
    assert all(n == 50 for n in sorted(Counter(x.shard for x in texts).values())[1:])


def test_mix_of_nothing(spark):
    assert source_mixture.Mixture(spark.createDataFrame([], "doc_id long, source string, text string")).taken().collect() == []
    rows = source_mixture.Mixture(spark.createDataFrame([(1, None, None)], "doc_id long, source string, text string")).taken().collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, 0.0, 0)]


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutations(spark, n):
    x = lambda **k: source_mixture.permuted(F.col("id"), F.lit(n), F.lit(5).cast("long"), **k)
    rows = spark.range(n).select("id", x().alias("there")).select("id", "there", source_mixture.permuted(F.col("there"), F.lit(n), F.lit(5).cast("long"), back=True).alias("back")).collect()
    assert sorted(r.there for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    assert n < 100 or sum(r.there == r.id for r in rows) < 10
