"""Page operators and the pipeline."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webquarry.llm import crf_extract, language_fusion, url_digests

PAGE = '<!DOCTYPE html><html lang="fr"><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy it now.</div><article><h1>Big  title</h1><p>Fish &amp; chips<br>today.<p><b>More</b> of it.</p><script>x="<p>no</p>"</script></article><footer>&copy; x.example</footer></body></html>'


def test_blocks_and_text():
    assert [b.text for b in crf_extract.blocks(PAGE)] == ["A", "Buy it now.", "Big title", "Fish & chips", "today.", "More of it.", "© x.example"]
    assert crf_extract.main_text(PAGE, crf_extract.trained()).startswith("Big title Fish & chips")


BROKEN = [("", []), ("<", ["<"]), ("<p", ["<p"]), ("a < b", ["a < b"]), ("<!-- open", []), ("<script>", []), ("</div></p>", []), ("<p>a<div>b</p>c</div>", ["a", "b", "c"]), ("&#0; &bogus; &lt;p&gt;", ["\ufffd &bogus; <p>"]), ("<a href='x>y'>z</a>", ["z"])]


@pytest.mark.parametrize(("page", "texts"), BROKEN)
def test_broken_markup_is_read_as_stated(page, texts):
    assert [b.text for b in crf_extract.blocks(page)] == texts
    assert set(crf_extract.main_text(page, crf_extract.trained()).split()) <= set(" ".join(texts).split())


def test_deep_pages_take_time_by_their_length():
    import time

    took = []
    for n in (2_000, 16_000):
        start = time.process_time()
        found = crf_extract.blocks("".join(f'<div class="c{i}">t{i} ' for i in range(n)))
        took.append(time.process_time() - start)
        assert [b.text for b in found] == [f"t{i}" for i in range(n)]
        assert all(len(b.path) <= (1 << crf_extract.HASH_BITS) + 3 for b in found)
    assert took[1] < 30 * took[0] + 1


OPEN_ENDS = ["<!" * 9, "a<!b<!-- c", "<p>a<!b", "<p>x<!-- y > z", "<!-->a", "<!--->a<p>b", "<!-- a --><p>b<!-- c --", "<?x<?y", "a<b <!--c<p>d", "<p>a</p><!", "<p>t<x"]


@pytest.mark.parametrize("page", OPEN_ENDS)
def test_open_ends_are_read_as_by_one_pattern(page):
    """Tokens are those that the pattern finds from left to right in the whole page."""
    want, at = [], 0
    for token in crf_extract._TOKEN.finditer(page):
        want.append(page[at : token.start()])
        at = token.end()
    want.append(page[at:])
    assert "".join("".join(b.text for b in crf_extract.blocks(page)).split()) == "".join("".join(want).split())


def test_open_brackets_take_time_by_their_number():
    import time

    for piece in ("<!", "<?", "<", "<!-", "<a "):
        for page in (piece * 1_000_000, "<p>x</p>" + piece * 1_000_000):
            start = time.process_time()
            crf_extract.blocks(page)
            assert time.process_time() - start < 10


def test_held_out_pages():
    r, crf = random.Random(12345), crf_extract.trained()
    right = total = exact = 0
    for _ in range(150):
        page, text = crf_extract.labelled_page(r)
        found = crf_extract.blocks(page)
        labels = crf_extract._labels(found, text)
        right += sum(a == b for a, b in zip(labels, crf.viterbi(crf_extract.features(found)), strict=True))
        total += len(labels)
        exact += crf_extract.main_text(page, crf) == text
    assert right / total > 0.98 and exact / 150 > 0.85


def test_given_pages_are_read_as_by_their_rule(sf_dir):
    import duckdb

    for at in (sf_dir, "/root/testdata/sf0.01"):
        db = duckdb.connect()
        db.sql(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet'")
        want = {r[0]: r[2:] for r in db.sql(crf_extract.ORACLES["op7_crf_extract"]).fetchall()}
        pages = db.sql("SELECT page_id, html FROM pages").fetchall()
        got = {i: crf_extract.main_text(html, crf_extract.trained()) for i, html in pages}
        assert {i: (t, len(t)) for i, t in got.items()} == want


def test_viterbi_is_the_best_of_all_labellings():
    r, crf = random.Random(1), crf_extract.trained()
    page, _ = crf_extract.labelled_page(r)
    rows = crf_extract.features(crf_extract.blocks(page))[:9]
    s = crf.scores(rows)

    def score(labels):
        return crf.start[labels[0]] + sum(s[i][x] for i, x in enumerate(labels)) + sum(crf.pair[a][b] for a, b in zip(labels, labels[1:], strict=False))

    best = max(([n >> i & 1 for i in range(len(rows))] for n in range(1 << len(rows))), key=score)
    assert abs(score(crf.viterbi(rows)) - score(best)) < 1e-9


def test_extraction_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, "", "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in crf_extract.extracted(pages).collect())
    assert len(got) == 4 and got[0] == got[1] and got[2][1] == "" and got[0][2] == len(got[0][1])
    assert crf_extract.extracted(pages.limit(0)).count() == 0


RULES = list(url_digests.RULES)


def brute(url, rules, listed):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:at], rest[at:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h + p), h + p, k) for h, p, k in rules if host and under(h) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(host and under(h) for h in listed) else "allow"


@pytest.mark.parametrize("most", [url_digests.FILE_BYTES, 100])
def test_url_verdicts_equal_brute_force(spark, most):
    urls = [None, "", "x", "http://", "http://a.org", "http://a.org/", "HTTP://EXAMPLE.ORG/es/x?y#z", "http://example.org/en/12", "http://b.example.org/es", "http://c.com/fr/a", "http://c.com/de/", "http://c.com:80/de/", "http://www.spam-farm.example.net/", "http://notspam-farm.example.net/", "http://spam-farm.example.org/es/", "http://É.com/fr/é", "://org/", "http:///de/", "http://..com/de/"]
    rows = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate([*urls, *urls])], "page_id long, url string, host string, rest string, verdict string")
    listed = spark.createDataFrame([(h, None) for h in url_digests.BLOCKED_HOSTS] + [("", None), (None, None)], "host string, path string")
    for blocked in (list(url_digests.BLOCKED_HOSTS), listed):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_digests.judged(rows, RULES, blocked, most).collect()}
        assert got == {i: brute(u, RULES, url_digests.BLOCKED_HOSTS) for i, u in enumerate([*urls, *urls])}
    assert url_digests.judged(rows, RULES, listed.limit(0)).count() == rows.count()
    assert url_digests.judged(rows.limit(0), RULES, []).count() == 0


def test_rules_of_equal_length_and_of_one_key(spark):
    rules = [("b.org", "/xy", "allow"), ("a.b.org", "/", "block"), ("c.org", "/", "allow"), ("c.org", "/", "block"), ("c.org", "/", "allow")]
    rows = spark.createDataFrame([(1, "http://a.b.org/xyz"), (2, "http://c.org/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_digests.judged(rows, rules, []).collect()}
    assert got == {1: ("a.b.org/", "block"), 2: ("c.org/", "block")}


def test_collisions_are_confirmed(monkeypatch):
    import numpy as np

    monkeypatch.setattr(url_digests.xxhash, "xxh64_intdigest", lambda b: 7)
    data = np.frombuffer(url_digests.digest_array([("a", "", "block"), ("b", "/x", "allow")]), np.uint8)
    array = url_digests.DigestArray(data)
    found = array.find([b"a", b"c", b"b/x"])
    assert [[array.key(j) for j in f] for f in found] == [[b"a"], [], [b"b/x"]]


def test_page_languages(spark, sf_dir):
    found = language_fusion.identify(language_fusion.from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))).collect()
    assert sum(r.lang == r.declared for r in found) >= 0.9 * len(found)


def test_page_languages_without_and_against_declarations(spark, sf_dir):
    rows = language_fusion.from_pages(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).cache()
    true = {r.id: r.declared for r in rows.collect()}
    # Every fifth declaration is withheld, every seventh is wrong: text, suffix and host decide.
    wrong = F.when(F.col("declared") == "en", "de").otherwise("en")
    given = F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 7 == 0, wrong).otherwise(F.col("declared"))
    got = {r.id: r.lang for r in language_fusion.identify(rows.withColumn("declared", given)).collect()}
    withheld, lied = [i for i in true if i % 5 == 0], [i for i in true if i % 7 == 0 and i % 5]
    assert sum(got[i] == true[i] for i in withheld) >= 0.9 * len(withheld)
    assert sum(got[i] == true[i] for i in lied) >= 0.9 * len(lied)


@pytest.mark.parametrize(("tag", "want"), [("en", "en"), ("EN-gb", "en"), ("pt_BR", "pt"), ("deu", "deu"), ("x", ""), ("english", ""), ("", ""), (None, "")])
def test_primary_subtags(spark, tag, want):
    row = spark.createDataFrame([(tag,)], "t string").select(language_fusion.primary_subtag(F.col("t")).alias("p")).first()
    assert row.p == want


def test_long_hosts_and_paths_have_few_probes(spark, monkeypatch):
    import tracemalloc

    host, path = "a." * 200_000 + "example.org", "/es/" + "x/" * 200_000
    lengths = {11: [1, 4, 5], 3: [1], 4: [1, 300_000]}
    tracemalloc.start()
    found = sorted(url_digests._probes(host.encode(), path.encode(), lengths), key=len)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [p for p in found if len(p) < 99] == [b"org/", b"example.org/", b"example.org/es/", b"example.org/es/x"] and len(found) == 4 and peak < 5_000_000
    monkeypatch.setattr(url_digests, "PROBES", 3)
    urls = [f"http://{host}{path}", "http://" + "." * 100_000 + "org/es/", "http://ÀB.example.org/es/q", "http://org/", None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_digests.judged(rows, RULES, ["Àb.EXAMPLE.org", "àb.example.org"]).collect()}
    assert got == {0: ("example.org/es/", "block"), 1: ("org/", "allow"), 2: ("example.org/es/", "block"), 3: ("org/", "allow"), 4: (None, "allow")}
    plain = [(0, "http://ÀB.x.org"), (1, "http://àb.x.org"), (2, "http://ÀB.X.ORG")]
    got = {r.page_id: r.verdict for r in url_digests.judged(spark.createDataFrame(plain, "page_id long, url string"), [], spark.createDataFrame([("ÀB.x.ORG", None)], "host string, path string")).collect()}
    assert got == {0: "block", 1: "allow", 2: "block"}


def test_pipeline(spark, sf_dir):
    from webquarry.llm import decontaminate, icws_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and all(r.round_trip for r in out)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "substrings", "contamination", "tokens"]
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    classes = icws_dedup.classes(docs).collect()
    assert {r.doc_id for r in kept.collect()} == {r.class_id for r in classes}
    bad = {r.doc_id for r in decontaminate.contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    clean = corpus_pipeline.contamination(spark, docs, sf_dir)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad


def test_pipeline_of_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    items = spark.createDataFrame([], "item_id long, text string")
    for name, docs in (("none", []), ("blank", [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "12", "en", "s", 2, "x")])):
        at = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
        items.write.parquet(f"{at}/benchmark.parquet")
        assert corpus_pipeline.run(spark, at).count() == 0


def test_pipeline_keeps_clean_documents_without_a_benchmark(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text_", F.lit(1))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.contamination(spark, docs, str(tmp_path)).count() == docs.count()


def test_stages_on_null_repeated_and_shared_ids(spark, sf_dir):
    r = random.Random(4)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    copy, lone, other, hidden, blank = text(), text(), text(), text(), " "
    rows = [(1, copy), (1, copy), (2, copy), (2, lone), (None, copy), (None, other), (None, other), (3, hidden), (3, hidden), (4, blank), (5, blank), (4, blank)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", f"s{i}", len(t)) for i, t in rows], schema)
    order = lambda pairs: sorted(pairs, key=str)
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert order((x.doc_id, x.text) for x in got) == order([(1, copy), (2, lone), (None, other), (3, hidden), (4, blank), (5, blank)])
    plain = [(1, copy), (2, lone), (None, other), (3, hidden), (3, hidden), (3, hidden)]
    got = corpus_pipeline.substrings(spark, spark.createDataFrame([(i, t, "en", f"s{i}", len(t)) for i, t in plain], schema), sf_dir).collect()
    assert order((x.doc_id, x.text, x.lang, x.source) for x in got) == order((i, t, "en", f"s{i}") for i, t in plain)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    mixed = [(None, item), (7, item), (7, lone), (None, lone)]
    got = corpus_pipeline.contamination(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in mixed], schema), sf_dir).collect()
    assert order((x.doc_id, x.text) for x in got) == order([(7, lone), (None, lone)])
    mixed = [(8, "12 34"), (8, lone), (None, "12 34"), (None, lone)]
    got = corpus_pipeline.language(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in mixed], schema), sf_dir).collect()
    assert order((x.doc_id, x.text) for x in got) == order([(8, lone), (None, lone)])


def test_tasks_of_the_pipeline_hold_batches_of_bounded_bytes(spark, tmp_path, monkeypatch):
    """30 MB of texts in one task: no worker is sent more than a part of them, and no second set of workers starts."""
    from webquarry.llm import textkit

    r, lean = random.Random(9), textkit.lean
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows = [(i, " ".join(r.choices(words, k=1400)), "en", "s", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def weighed(work):
        def sized(batches):
            for batch in batches:
                if batch.nbytes > 8_000_000:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield batch

        return lean(lambda batches: work(sized(batches)))

    def refused(*_, **__):
        raise ValueError("rows of the driver")

    monkeypatch.setattr(textkit, "lean", weighed)
    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    for name in ("language", "near_duplicates", "substrings", "tokens"):
        assert dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).count() == 3000, name


def test_a_session_may_say_how_large_batches_are(spark):
    from webquarry.llm import textkit

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": [batch.num_rows]})

    rows = spark.range(4000).select(F.repeat(F.lit("ab "), 1000).alias("text")).coalesce(1)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "64m")
        assert [r.n for r in rows.transform(textkit.mapped, sizes, "n long").collect()] == [4000]
        spark.conf.unset(name)
        parts = [r.n for r in rows.transform(textkit.mapped, sizes, "n long").collect()]
        assert sum(parts) == 4000 and max(parts) < 1500
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
