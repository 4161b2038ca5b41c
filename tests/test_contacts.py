import pytest
from pyspark.sql import functions as F

from webquarry.functions import contacts as C
from webquarry.operators import crawl
from webquarry.sources import sinks


def info(spark, text, html=""):
    return spark.createDataFrame([(text, html)], "t string, h string").select(C.contact_info(F.col("t"), F.col("h")).alias("i")).first().i


def test_all_kinds(spark):
    got = info(spark, "info@acme.example Telegram: @acme_team +1 555 010 1234 linkedin.com/in/x_y twitter.com/acme", '<a href="mailto:Sales@acme.example?subject=Hi">m</a><a href="https://telegram.me/t2">t</a>')
    assert got.emails == ["info@acme.example", "sales@acme.example"]
    assert got.telegram == ["https://t.me/acme_team"]
    assert got.linkedin == ["https://linkedin.com/in/x_y"]
    assert got.phones == ["+1 555 010 1234"]
    assert got.social == {"x": ["https://twitter.com/acme"]}


def test_nulls_and_empty(spark):
    for text in (None, ""):
        got = info(spark, text, None)
        assert got.emails == [] and got.telegram == [] and got.social == {}


@pytest.mark.parametrize(("mail", "ok"), [("support@acme.example", False), ("user@gmail.com", False), ("info@acme.example", True), ("a..b@acme.example", False), (".a@acme.example", False), ("a@acme.test", False), (None, False)])
def test_business_addresses(spark, mail, ok):
    assert spark.createDataFrame([(mail,)], "m string").select(C.is_business_email(F.col("m"))).first()[0] == ok


def test_short_telegram_names_do_not_count(spark):
    assert info(spark, "TG: @abc").telegram == []


def test_unbounded_social_pattern_is_kept(spark):
    assert info(spark, "https://netflix.com/a").social == {"x": ["https://x.com/a"]}


@pytest.mark.parametrize(("counts", "score"), [((2, 1, 1, 0), 100), ((1, 0, 0, 0), 40), ((0, 0, 0, 1), 10), ((2, 1, 1, 1), 100), ((0, 0, 0, 0), 0)])
def test_confidence(spark, counts, score):
    assert spark.range(1).select(C.confidence(*map(F.lit, counts))).first()[0] == score


def test_html_text(spark):
    html = "<style>p{}</style><script>var a='</p>'</script><p>Hello <b>big</b>\n world</p>"
    assert spark.createDataFrame([(html,)], "h string").select(C.html_text(F.col("h"))).first()[0] == "Hello big world"


@pytest.mark.parametrize("text", ["a &amp; b", "&amp;lt;", "&#64;&#x41;&#X1F600;", "&#0;&#xD800;", "&unknown; &eacute;&Eacute;", "no", "&", "&&amp;&", "&quot;&apos;&copy;"])
def test_references_are_decoded_as_the_standard_library_does(spark, text):
    from html import unescape

    assert spark.createDataFrame([(text,)], "t string").select(C.decoded_references(F.col("t"))).first()[0] == unescape(text)


def test_linked_data_is_part_of_the_contacts(spark):
    html = '<script type="application/ld+json">{"email": "Info@acme.example", "sameAs": ["telegram.me/acme", "https://www.linkedin.com/company/acme?utm_source=a"]}</script>'
    pages = spark.createDataFrame([(1, "https://a.example/", html), (2, "https://b.example/", "x"), (3, "https://c.example/", None)], "id int, url string, html string")
    got = {r.host: r for r in crawl.host_contacts(pages).collect()}
    one = got["a.example"]
    assert one.emails == ["info@acme.example"] and one.telegram == ["https://t.me/acme"] and one.linkedin == ["https://www.linkedin.com/company/acme"] and one.confidence == 90
    assert got["b.example"].emails == [] and got["c.example"].pages == 1


def test_tags_and_subjects(spark):
    row = spark.range(1).select(C.subject_area(F.array(*map(F.lit, ["fintech co", "B2B", "saas", "ai", "iot"]))).alias("s"), C.merged_tags(F.lit("Ai"), F.array(*map(F.lit, ["AI", "x", "y", "z"]))).alias("t")).first()
    assert row.s == "fintech co, saas, ai" and row.t == ["Ai", "x", "y"]


def test_keywords(spark):
    row = spark.range(1).select(C.clean_keyword(F.lit(" <a>'\"b ")).alias("k"), C.language_or_default(F.lit("EN1")).alias("l"), C.country_or_default(F.lit("de")).alias("c"), C.keyword_variations(F.lit("Startup x")).alias("v")).first()
    assert row.k == "ab" and row.l == "ru" and row.c == "DE" and row.v == ["Startup x", "company x", "business x", "venture x"]


def test_host_contacts_and_rows(spark):
    pages = spark.createDataFrame([(1, "https://a.example/contact", "a@acme.example b@acme.example"), (2, "https://a.example/x", "a@acme.example"), (3, "https://b.example/", None)], "id int, url string, html string")
    got = {r.host: r for r in crawl.host_contacts(pages).collect()}
    assert got["a.example"].emails == ["a@acme.example", "b@acme.example"] and got["a.example"].confidence == 50 and got["a.example"].contact_pages == 1
    assert got["b.example"].pages == 1 and got["b.example"].confidence == 0
    rows = sinks.contact_rows(crawl.page_contacts(pages)).collect()
    assert sorted((r.domain_contact_id, r.value) for r in rows) == [(1, "a@acme.example"), (1, "b@acme.example"), (2, "a@acme.example")]


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_the_contacts_does_not_find_them_again(spark):
    """The filter stays above the patterns, so none is in the plan more often than without it."""
    pages = spark.createDataFrame([(1, "https://a.example/", "a@acme.example"), (2, "https://b.example/", "+1 555 010 1234"), (3, "https://c.example/", None)], "id int, url string, html string")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        found = crawl.page_contacts(pages)
        kept, every = sinks.saved(found), sinks.saved(found, keep_empty=True)
        assert _plan(kept).count("regexp_extract_all") == _plan(every).count("regexp_extract_all") > 0
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert kept.columns == every.columns
    assert [(r.id, r.info.emails) for r in kept.collect()] == [(1, ["a@acme.example"])] and every.count() == 3


def test_pages_of_one_file_are_read_for_contacts_by_several_tasks(spark):
    pages = spark.range(400).select("id", F.lit("https://a.example/").alias("url"), F.expr("concat('a', id, '@acme.example ', repeat(sha2(cast(id as string), 256), 500))").alias("html")).coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        rows = crawl.page_contacts(pages).groupBy(F.spark_partition_id().alias("p")).agg(F.count("info").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 4 and sum(r.n for r in rows) == 400 and max(r.n for r in rows) < 200


def test_text_of_a_page_is_computed_once(spark):
    """The optimizer turns the names of references into one map, and no step of the text is repeated."""
    rows = spark.createDataFrame([("<p>a &amp; b&copy;</p><NOSCRIPT>x</noscript>",), (None,)], "html string").select(C.html_text(F.col("html")).alias("t"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "str_to_map" not in plan and plan.lower().count("noscript") <= 2
    assert [r.t for r in rows.collect()] == ["a & b©", ""]
