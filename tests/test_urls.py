import pytest
from pyspark.sql import functions as F

from webquarry.functions import urls as U
from webquarry.operators import crawl


def value(spark, column, url):
    return spark.createDataFrame([(url,)], "u string").select(column(F.col("u"))).first()[0]


@pytest.mark.parametrize(
    ("f", "url", "expected"),
    [
        (U.host, "https://WWW.Acme.example:8080/x", "acme.example:8080"),
        (U.host, "acme.example/x", ""),
        (U.host, None, ""),
        (U.host, "https://e.example/a b", "e.example"),
        (U.is_blocked, "acme.example/x", True),
        (U.is_blocked, "https://en.wikipedia.org/wiki/X", True),
        (U.is_blocked, "https://notwikipedia.org/", False),
        (U.crawl_score, "https://a.example/contacts", 200),
        (U.crawl_score, "https://a.example/about-us", 120),
        (U.crawl_score, "https://a.example/our-team", 60),
        (U.crawl_score, "https://a.example/", 25),
        (U.crawl_score, "https://a.example/brochure.pdf", -1000),
        (U.crawl_score, "https://a.example/a/b/c/d", -15),
        (U.crawl_score, "https://a.example/contact/b/c/d", 100),
        (U.contact_url, "//acme.example/a#top", "https://acme.example/a"),
        (U.contact_url, "acme.example/a?utm_source=x", "https://acme.example/a"),
        (U.contact_url, "https://acme.example/p?utm_source=a&b=2", "https://acme.example/p&b=2"),
        (U.contact_url, None, ""),
        (U.telegram_url, "telegram.me/acme", "https://t.me/acme"),
        (U.link_priority, "https://a.example/x?y=/contact", 10),
        (U.link_priority, "https://a.example/legal", 6),
        (U.link_priority, "https://a.example/", 1),
        (U.crawl_delay, None, 0.5),
        (U.crawl_delay, "0.01", 0.1),
    ],
)
def test_functions(spark, f, url, expected):
    if f is U.crawl_delay:
        assert spark.range(1).select(f(F.lit(url).cast("double"))).first()[0] == expected
    else:
        assert value(spark, f, url) == expected


def test_internal_links(spark):
    rows = spark.createDataFrame([("/a", True), ("https://x.example/a", True), ("https://y.example/a", False), ("/", False), ("/a.pdf", False), (None, False)], "u string, ok boolean")
    for r in rows.select("ok", U.is_internal_link(F.col("u"), F.lit("x.example")).alias("got")).collect():
        assert r.got == r.ok


def test_targets_prefer_contact_pages(spark):
    rows = spark.createDataFrame([(0, "https://acme.example/blog/post-1"), (1, "https://www.acme.example/about"), (2, None), (3, "https://x.com/a")], "seq int, url string")
    assert [r.url for r in crawl.crawl_targets(rows).collect()] == ["https://www.acme.example/about"]


def test_targets_use_roots_of_articles(spark):
    rows = spark.createDataFrame([(0, "https://b.example/news/item"), (1, "https://a.example/contact-us")], "seq int, url string")
    got = crawl.crawl_targets(rows).orderBy(F.desc("score"), "first_seq").collect()
    assert [(r.host, r.url) for r in got] == [("a.example", "https://a.example/contact-us"), ("b.example", "https://b.example/")]


def test_search_queries(spark):
    rows = spark.createDataFrame([("kw", "en", "DE", "kw kontakt impressum"), ("kw", "en", "US", "kw contact email"), ("kw", "ru", "RU", "kw контакты email"), (" ", "ru", "RU", "")], "k string, l string, c string, want string")
    for r in rows.select("want", U.search_query(F.col("k"), F.col("l"), F.col("c")).alias("got")).collect():
        assert r.got == r.want


def test_suffix_join_equals_the_test_by_column(spark):
    rows = spark.createDataFrame([(f"https://{h}/",) for h in ("a.b.example", "b.example", "ab.example", "c.example")], "url string")
    left = crawl.not_blocked(rows, "url", spark.createDataFrame([("b.example",)], "host string"))
    assert {r.url for r in left.collect()} == {"https://ab.example/", "https://c.example/"}


@pytest.mark.parametrize("base", ["https://a.example/x/y?q=1#f", "http://a.example", "https://a.example/", "https://a.example/d/"])
@pytest.mark.parametrize("link", ["", "/c", "c.html", "../about", "./t/../u/", "..", ".", "?p=1", "#f", "//b.example/c", "https://b.example/x", "mailto:a@b.example", "a//b/c", "/a/./b/../c?d=../e", "../../../x"])
def test_links_are_joined_as_the_standard_library_does(spark, base, link):
    from urllib.parse import urljoin

    assert spark.range(1).select(U.joined(F.lit(base), F.lit(link))).first()[0] == urljoin(base, link)


def test_frontier_and_links(spark):
    front = {r.url: r.priority for r in crawl.frontier(spark.createDataFrame([("https://a.example/",)], "base string")).collect()}
    assert front["https://a.example/contact"] == 10 and front["https://a.example/about"] == 7 and front["https://a.example/"] == 7 and front["https://a.example/our-story"] == 5
    pages = spark.createDataFrame([("https://a.example/x", '<a href="/contact">c</a><a href="/blog">b</a><a href="https://b.example/contact">o</a>')], "url string, html string")
    assert [(r.link, r.priority) for r in crawl.links(pages).collect()] == [("https://a.example/contact", 10)]
