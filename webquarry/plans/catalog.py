"""All queries of the analytics engine with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry import fixed_values as V
from webquarry.bridge import TABLES, oracle, physical, table
from webquarry.functions import contacts as C
from webquarry.functions import documents as D
from webquarry.functions import urls as U
from webquarry.operators import crawl, metrics, reports, tasks
from webquarry.sources import serp, sinks
from webquarry.streaming import rolling

AS_OF = "2024-01-31 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *names: str):  # noqa: ANN201
    """Registers a query under its function's name, with oracle SQL over logical tables."""

    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *names) if names else sql
        return f

    return register


class _Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name) if name in TABLES else physical(self.spark, self.sf_dir, name)


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _any(text: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in parts) + ")"


def _ends(text: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"ends_with({text}, '{p}')" for p in parts) + ")"


def _host(url: str) -> str:
    return f"regexp_replace(lower(coalesce(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')), '^www\\.', '')"


def _path(url: str) -> str:
    return f"regexp_replace(coalesce(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), ';[^/]*$', '')"


def _root(url: str) -> str:
    return f"(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || '/')"


def _score(url: str) -> str:
    p = f"lower({_path(url)})"
    marks = " + ".join(f"CASE WHEN contains({p}, '{m}') THEN {w} ELSE 0 END" for ms, w in ((V.HIGH_MARKERS, 100), (V.MEDIUM_MARKERS, 60), (V.LOW_MARKERS, -45)) for m in ms)
    base = f"({marks} + CASE WHEN regexp_matches({p}, '^/*$') THEN 25 ELSE 0 END)"
    deep = f"len(list_filter(string_split({p}, '/'), lambda s: s <> '')) >= 4"
    return f"CAST(CASE WHEN {_ends(p, V.SKIPPED_ENDINGS)} THEN -1000 ELSE {base} - CASE WHEN {deep} AND {base} < 60 THEN 15 ELSE 0 END END AS INTEGER)"


def _blocked(host: str) -> str:
    return f"({host} = '' OR {host} IN ({_in(V.BLOCKED_HOSTS)}) OR {_ends(host, tuple('.' + h for h in V.BLOCKED_HOSTS))})"


def _text(html: str) -> str:
    out = f"coalesce({html}, '')"
    for tag in ("script", "style", "noscript"):
        out = f"regexp_replace({out}, '<{tag}[^>]*>.*?</{tag}>', ' ', 'gis')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'gs')"
    # The references that the test pages have; the ampersand is the last, so that none is decoded twice.
    for ref, character in (("&#64;", "@"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{ref}', '{character}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def _contact_url(u: str) -> str:
    with_scheme = f"CASE WHEN starts_with(trim({u}), '//') THEN 'https:' || trim({u}) WHEN regexp_matches(trim({u}), '^https?://', 'i') THEN trim({u}) ELSE 'https://' || regexp_replace(trim({u}), '^/+', '') END"
    plain = f"regexp_replace(regexp_replace({with_scheme}, '#.*$', ''), '(\\?|&)(utm_[^=&]+|fbclid|gclid)=[^&]*', '', 'gi')"
    return f"(CASE WHEN trim(coalesce({u}, '')) = '' THEN '' ELSE regexp_replace(replace({plain}, '?&', '?'), '[?&]+$', '') END)"


_SHAPE = "^[a-z0-9_%+-]+(\\.[a-z0-9_%+-]+)*@([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\\.)+[a-z]{2,63}$"


def _business(e: str) -> str:
    low = f"lower({e})"
    return f"(regexp_matches({low}, '{_SHAPE}') AND length({low}) <= 254 AND length(split_part({low}, '@', 1)) <= 64 AND split_part({low}, '.', -1) NOT IN ({_in(V.RESERVED_TOPS)}) AND split_part({low}, '@', 1) NOT IN ({_in(V.BLOCKED_MAILBOXES)}) AND split_part({low}, '@', -1) NOT IN ({_in(V.FREE_PROVIDERS)}))"


#: Pages with contacts of every kind, on both engines: none of the test pages has any of most kinds.
_SUFFIX = "concat(html, '<a href=\"mailto:sales', CAST(page_id AS STRING), '@acme.example?subject=x\">m</a><a href=\"https://t.me/team', CAST(page_id AS STRING), '\">t</a> Telegram: @acme_team', CAST(page_id % 7 AS STRING), ' linkedin.com/company/acme', CAST(page_id % 5 AS STRING), ' +1 555 010 ', CAST(1000 + page_id % 900 AS STRING), ' twitter.com/acme', CAST(page_id % 3 AS STRING), ' join.chat/Inv_', CAST(page_id % 4 AS STRING), ' t.me/plain', CAST(page_id % 6 AS STRING), ' write to hr&#64;acme', CAST(page_id % 3 AS STRING), '.example <a href=\"https://www.linkedin.com/company/Acme?utm_source=a&b=2\">l</a> www.facebook.com/acme.', CAST(page_id % 5 AS STRING), ' instagram.com/acme_ youtube.com/@acme', CAST(page_id % 2 AS STRING), CASE WHEN page_id % 3 = 0 THEN concat('<script type=\"application/ld+json\">{\"@graph\": [{\"a\": {\"email\": \"LD', CAST(page_id AS STRING), '@acme.example\"}}, {\"sameAs\": [\"https://telegram.me/ld', CAST(page_id % 5 AS STRING), '\", 7, \"www.linkedin.com/company/ld', CAST(page_id % 5 AS STRING), '#x\"]}]}</script>') ELSE '' END)"


def _rich(t: _Tables) -> DataFrame:
    return t.pages.select("page_id", "url", F.expr(_SUFFIX).alias("html"))


_RICH = f"rich AS MATERIALIZED (SELECT page_id, url, html, {_text('html')} AS content FROM (SELECT page_id, url, {_SUFFIX} AS html FROM pages))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(text: str, pattern: str, group: int = 0) -> str:
    return f"unnest(regexp_extract_all({text}, {_quoted(pattern)}, {group}))"


#: Every contact of the enriched pages: (page_id, url, kind, value), kinds as in the contact lists.
_FOUND = f"""{_RICH}, raw_mails AS (
  SELECT page_id, {_matches('content', V.EMAIL)} AS e FROM rich
  UNION ALL SELECT page_id, split_part(trim({_matches('content', V.MAILTO, 1)}), '?', 1) FROM rich
  UNION ALL SELECT page_id, split_part(trim({_matches('html', V.MAILTO, 1)}), '?', 1) FROM rich
  UNION ALL SELECT page_id, 'LD' || page_id || '@acme.example' FROM rich WHERE page_id % 3 = 0),
raw_telegram AS (
  SELECT page_id, 'https://t.me/' || {_matches('content', V.TELEGRAM, 1)} AS u FROM rich
  UNION ALL SELECT page_id, 'https://t.me/' || {_matches('content', V.TELEGRAM_NAME, 1)} FROM rich
  UNION ALL SELECT page_id, 'https://join.chat/' || {_matches('content', V.TELEGRAM_INVITE, 1)} FROM rich
  UNION ALL SELECT page_id, {_matches('html', V.TELEGRAM_HREF, 1)} FROM rich
  UNION ALL SELECT page_id, 'https://telegram.me/ld' || page_id % 5 FROM rich WHERE page_id % 3 = 0),
raw_linkedin AS (
  SELECT page_id, 'https://linkedin.com/' || {_matches('content', V.LINKEDIN, 1)} AS u FROM rich
  UNION ALL SELECT page_id, 'https://linkedin.com/' || {_matches('content', V.LINKEDIN_NAME, 1)} FROM rich
  UNION ALL SELECT page_id, {_matches('html', V.LINKEDIN_HREF, 1)} FROM rich
  UNION ALL SELECT page_id, 'www.linkedin.com/company/ld' || page_id % 5 || '#x' FROM rich WHERE page_id % 3 = 0),
raw_social AS ({" UNION ALL ".join(f"SELECT page_id, '{name}' AS kind, {_matches('content || chr(10) || html', pattern)} AS u FROM rich" for name, pattern in V.SOCIAL.items())}),
raw_phones AS (SELECT page_id, {_matches('content', V.PHONE)} AS p FROM rich),
found AS (
  SELECT page_id, 'emails' AS kind, lower(trim(e)) AS value FROM raw_mails WHERE {_business('e')}
  UNION SELECT page_id, 'telegram', replace({_contact_url('u')}, 'telegram.me/', 't.me/') FROM raw_telegram WHERE {_contact_url('u')} <> ''
  UNION SELECT page_id, 'linkedin', {_contact_url('u')} FROM raw_linkedin WHERE {_contact_url('u')} <> ''
  UNION SELECT page_id, kind, {_contact_url('u')} FROM raw_social
  UNION SELECT page_id, 'phones', p FROM raw_phones WHERE length(regexp_replace(p, '[^\\d+]', '', 'g')) >= 10)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact yield per crawled host: pages, contact pages, contacts by kind and confidence."""
    found = crawl.host_contacts(physical(spark, sf_dir, "pages"))
    return found.select("host", "pages", "contact_pages", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("emails", "telegram", "linkedin", "phones")], "confidence")


# URLs


@query(f"SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_root('url')} AS root FROM pages")
def u1_host(spark, sf_dir):  # noqa: ANN001, ANN201
    """Host, path and root of every URL."""
    return _Tables(spark, sf_dir).pages.select("page_id", U.host(F.col("url")).alias("host"), U.path(F.col("url")).alias("path"), U.root(F.col("url")).alias("root"))


_VARIED = "concat(split_part(url, '?', 1), CASE page_id % 9 WHEN 0 THEN '/contacts' WHEN 1 THEN '/about-us' WHEN 2 THEN '/our-team' WHEN 3 THEN '/brochure.pdf' WHEN 4 THEN '/blog/post/2024/x' WHEN 5 THEN '/news/item.html' WHEN 6 THEN '/a/b/c/d' WHEN 7 THEN '' ELSE '/Impressum;v=1' END)"


@query(f"SELECT page_id, {_score('u')} AS score, CAST(CASE {' '.join(f'WHEN {_any("lower(u)", parts)} THEN {w}' for w, parts in V.LINK_PRIORITIES)} ELSE 1 END AS INTEGER) AS priority, {_any('lower(u)', V.CONTACT_PAGE_PARTS)} AS contact_page, (length({_path('u')}) > 1 AND {_any(f'lower({_path("u")})', V.ARTICLE_MARKERS)}) AS needs_root FROM (SELECT page_id, {_VARIED} AS u FROM pages)")
def u3_crawl_score(spark, sf_dir):  # noqa: ANN001, ANN201
    """Crawl score, link priority and page kind of URLs with varied paths."""
    u = F.col("u")
    return _Tables(spark, sf_dir).pages.select("page_id", F.expr(_VARIED).alias("u")).select("page_id", U.crawl_score(u).alias("score"), U.link_priority(u).alias("priority"), U.is_contact_page(u).alias("contact_page"), U.needs_root(u).alias("needs_root"))


@query(
    f"""WITH cand AS (
  SELECT page_id AS seq, 0 AS cand, trim(url) AS u FROM pages WHERE trim(url) <> ''
  UNION ALL SELECT page_id, 1, {_root('trim(url)')} FROM pages WHERE trim(url) <> '' AND length({_path('trim(url)')}) > 1 AND {_any(f'lower({_path("trim(url)")})', V.ARTICLE_MARKERS)}),
scored AS (SELECT seq, cand, u, {_host('u')} AS host, {_score('u')} AS score FROM cand),
ok AS (SELECT * FROM scored WHERE NOT {_blocked('host')} AND score > -1000),
ranked AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, seq, cand) AS n, min(seq) OVER (PARTITION BY host) AS first_seq FROM ok)
SELECT host, u AS url, score, first_seq FROM ranked WHERE n = 1"""
)
def u4_crawl_targets(spark, sf_dir):  # noqa: ANN001, ANN201
    """The best URL of every host."""
    return crawl.crawl_targets(_Tables(spark, sf_dir).pages.select(F.col("page_id").alias("seq"), "url"))


@query(
    f"SELECT page_id, {_contact_url('u')} AS url FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?:', '') ELSE concat(regexp_replace(url, '^https?://', ''), '?utm_source=a&b=2&gclid=3') END AS u FROM pages)"
)
def u6_contact_url(spark, sf_dir):  # noqa: ANN001, ANN201
    """URLs as contacts keep them."""
    u = F.expr("CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?:', '') ELSE concat(regexp_replace(url, '^https?://', ''), '?utm_source=a&b=2&gclid=3') END")
    return _Tables(spark, sf_dir).pages.select("page_id", U.contact_url(u).alias("url"))


@query("SELECT id, CASE WHEN language = 'de' OR country = 'DE' THEN keyword || ' kontakt impressum' WHEN language = 'en' OR country IN ('US', 'GB') THEN keyword || ' contact email' ELSE keyword || ' контакты email' END AS query FROM keywords", "keywords")
def u12_search_query(spark, sf_dir):  # noqa: ANN001, ANN201
    """Search queries of the keywords."""
    return _Tables(spark, sf_dir).keywords.select("id", U.search_query(F.col("keyword"), F.col("language"), F.col("country")).alias("query"))


_LISTED = "VALUES ('cheap-pills.example.com'), ('spam-farm.example.org'), ('example.net')"


@query(f"SELECT page_id FROM (SELECT page_id, {_host('url')} AS h FROM pages) WHERE h <> '' AND NOT EXISTS (SELECT 1 FROM ({_LISTED}) l(s) WHERE h = s OR ends_with(h, '.' || s))")
def f10_not_blocked(spark, sf_dir):  # noqa: ANN001, ANN201
    """Pages whose host is under no listed host, by an equi-join on host suffixes."""
    listed = spark.createDataFrame([("cheap-pills.example.com",), ("spam-farm.example.org",), ("example.net",)], "host string")
    return crawl.not_blocked(_Tables(spark, sf_dir).pages, "url", listed).select("page_id")


_ROOTS = f"SELECT DISTINCT {_root('url')} AS base FROM pages"
_PLACES = ", ".join(f"('{p[1:]}', {w}, {i})" for i, (p, w) in enumerate([*[(p, 10) for p in V.PRIMARY_PATHS], *[(p, 7) for p in V.CONTACT_PATHS], ("/@map", 9), ("/", 7), *[(p, 5) for p in V.EXTRA_PATHS]]))


@query(
    f"""WITH roots AS ({_ROOTS}), places(p, w, i) AS (VALUES {_PLACES}),
listed AS (SELECT base, CASE WHEN p = '@map' THEN base || 'about/legal' ELSE base || p END AS url, w, i FROM roots, places),
firsts AS (SELECT *, row_number() OVER (PARTITION BY base, url ORDER BY i) AS n FROM listed)
SELECT base, url, CAST(w AS INTEGER) AS priority FROM firsts WHERE n = 1"""
)
def u8_frontier(spark, sf_dir):  # noqa: ANN001, ANN201
    """URLs to visit for every root, with the contact pages of its sitemap."""
    bases = _Tables(spark, sf_dir).pages.select(U.root(F.col("url")).alias("base")).distinct()
    listed = bases.select("base", F.explode(F.array(F.concat("base", F.lit("about/legal")), F.concat("base", F.lit("item/7")))).alias("loc"))
    return crawl.frontier(bases, listed)


_MORE_LINKS = "concat(html, '<a href=\"/contact\">c</a><a class=\"x\" href=\"team.html?x=1\">s</a><a href=\"../about\">b</a><a href=\"/blog\">b</a><a href=\"#top\">t</a><A HREF=\"?/legal=', CAST(page_id % 3 AS STRING), '\">q</A><a href=\"//other.example/contact\">o</a><a href=\"mailto:a@acme.example\">m</a><a href=\"', url, '/./x/../privacy\">p</a>')"
_LINK_PARTS = f"""SELECT page_id, url, html, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS top, {_path('url')} AS own FROM pages"""
#: The anchors of the pages themselves are absolute paths; those that are added are resolved one by one.
_LINKS_SQL = f"""WITH parts AS ({_LINK_PARTS}), dirs AS (SELECT *, regexp_replace(own, '[^/]*$', '') AS dir FROM parts),
own_links AS (SELECT url, top || h AS link FROM (SELECT url, top, unnest(list_slice(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), 1, 50)) AS h FROM dirs)),
added AS (
  SELECT url, top || '/contact' AS link FROM dirs
  UNION ALL SELECT url, top || CASE WHEN dir = '' THEN '/' ELSE dir END || 'team.html?x=1' FROM dirs
  UNION ALL SELECT url, top || regexp_replace(regexp_replace(dir, '/$', ''), '[^/]*$', '') || CASE WHEN dir IN ('', '/') THEN '/' ELSE '' END || 'about' FROM dirs
  UNION ALL SELECT url, top || own || '?/legal=' || page_id % 3 FROM dirs
  UNION ALL SELECT url, regexp_replace(url, '#.*$', '') || '#top' FROM dirs
  UNION ALL SELECT url, url || '/./x/../privacy' FROM dirs),
every_link AS (SELECT DISTINCT * FROM (SELECT * FROM own_links UNION ALL SELECT * FROM added)),
scored AS (SELECT url, link, CAST(CASE {' '.join(f'WHEN {_any("lower(link)", parts)} THEN {w}' for w, parts in V.LINK_PRIORITIES)} ELSE 1 END AS INTEGER) AS priority, {_path('link')} AS p FROM every_link)
SELECT url, link, priority FROM scored WHERE priority >= 3 AND length(p) > 1 AND NOT {_ends('p', V.INTERNAL_LINK_ENDINGS)}"""


@query(_LINKS_SQL)
def u9_links(spark, sf_dir):  # noqa: ANN001, ANN201
    """Internal links worth following of pages with some more links."""
    pages = _Tables(spark, sf_dir).pages
    return crawl.links(pages.select("url", F.expr(_MORE_LINKS).alias("html")))


# Contacts


@query(f"SELECT page_id, {_text('html')} AS content FROM pages")
def x19_html_text(spark, sf_dir):  # noqa: ANN001, ANN201
    """Text of every page."""
    return _Tables(spark, sf_dir).pages.select("page_id", C.html_text(F.col("html")).alias("content"))


@query(f"WITH {_FOUND} SELECT page_id, string_agg(value, ' ' ORDER BY value) AS emails FROM found WHERE kind = 'emails' GROUP BY page_id")
def x1_emails(spark, sf_dir):  # noqa: ANN001, ANN201
    """Business addresses of every page that has one."""
    # As the row of a generator, so that the filter doesn't find them a second time.
    rows = crawl.page_contacts(_rich(_Tables(spark, sf_dir))).select("page_id", F.explode(F.array(F.array_join("info.emails", " "))).alias("emails"))
    return rows.where("emails <> ''")


@query(f"WITH f AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(text, '{V.PHONE}'), lambda p: length(regexp_replace(p, '[^\\d+]', '', 'g')) >= 10))) AS p FROM documents) SELECT doc_id, array_to_string(p, '|') AS phones FROM f WHERE len(p) > 0")
def x10_phones(spark, sf_dir):  # noqa: ANN001, ANN201
    """Phone numbers of every document that has one."""
    return _Tables(spark, sf_dir).documents.select("doc_id", F.array_join(C.phones(F.col("text")), "|").alias("phones")).where("phones <> ''")


_HOST_LISTS = ", ".join(f"coalesce(string_agg(value, ' ' ORDER BY value) FILTER (k = '{k}'), '') AS {k}, count(*) FILTER (k = '{k}') AS n_{k}" for k in ("emails", "telegram", "linkedin", "phones", "social"))


@query(
    f"""WITH {_FOUND}, h AS (SELECT page_id, {_host('url')} AS host, CASE WHEN {_any('lower(url)', V.CONTACT_PAGE_PARTS)} THEN 1 ELSE 0 END AS contact_page FROM pages),
hosts AS (SELECT host, count(*) AS pages, CAST(sum(contact_page) AS BIGINT) AS contact_pages FROM h GROUP BY host),
each_value AS (SELECT DISTINCT host, CASE WHEN kind IN ({_in(tuple(V.SOCIAL))}) THEN 'social' ELSE kind END AS k, value FROM found JOIN h USING (page_id)),
lists AS (SELECT host, {_HOST_LISTS} FROM each_value GROUP BY host)
SELECT host, pages, contact_pages, emails, telegram, linkedin, phones, social,
  CAST(least(100, CASE WHEN n_emails > 0 THEN 40 ELSE 0 END + CASE WHEN n_emails > 1 THEN 10 ELSE 0 END + CASE WHEN n_telegram > 0 THEN 25 ELSE 0 END + CASE WHEN n_linkedin > 0 THEN 25 ELSE 0 END + CASE WHEN n_phones > 0 THEN 10 ELSE 0 END) AS INTEGER) AS confidence
FROM hosts JOIN lists USING (host)"""
)
def x16_host_contacts(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts and confidence per host of the enriched pages."""
    found = crawl.host_contacts(_rich(_Tables(spark, sf_dir)))
    return found.select("host", "pages", "contact_pages", *[F.array_join(k, " ").alias(k) for k in ("emails", "telegram", "linkedin", "phones", "social")], "confidence")


@query(f"WITH {_FOUND} SELECT page_id, kind, value FROM found")
def x3_page_contacts(spark, sf_dir):  # noqa: ANN001, ANN201
    """Every contact of every enriched page, of all kinds."""
    rows = crawl.page_contacts(_rich(_Tables(spark, sf_dir)))
    lists = F.map_concat(F.create_map(*[x for k in ("emails", "telegram", "linkedin", "phones") for x in (F.lit(k), F.col(f"info.{k}"))]), F.col("info.social"))
    return rows.select("page_id", F.explode(lists).alias("kind", "values")).select("page_id", "kind", F.explode("values").alias("value"))


@query("SELECT doc_id, coalesce(regexp_matches(text, '\\[at\\]|\\(at\\)| at |\\[dot\\]|\\(dot\\)| dot |\\{@\\}', 'i'), false) AS obfuscated FROM documents")
def f25_obfuscated(spark, sf_dir):  # noqa: ANN001, ANN201
    """Documents in which addresses may be spelt out."""
    return _Tables(spark, sf_dir).documents.select("doc_id", C.is_obfuscated(F.col("text")).alias("obfuscated"))


@query(f"WITH {_FOUND} SELECT page_id AS domain_contact_id, CASE kind WHEN 'emails' THEN 'email' ELSE kind END AS contact_type, value FROM found WHERE kind <> 'phones'")
def k6_contact_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contact rows of the enriched pages that are stored."""
    return sinks.contact_rows(sinks.saved(crawl.page_contacts(_rich(_Tables(spark, sf_dir))).withColumnRenamed("page_id", "id")))


@query(f"SELECT page_id, url, substr(html, 1, {V.PAYLOAD_HTML}) AS html, substr(content, 1, {V.PAYLOAD_TEXT}) AS content FROM (SELECT page_id, url, html, {_text('html')} AS content, row_number() OVER (PARTITION BY {_host('url')} ORDER BY page_id) AS n FROM pages) WHERE n <= {V.PAYLOAD_PAGES}")
def k12_payload(spark, sf_dir):  # noqa: ANN001, ANN201
    """The pages of each host that the queue carries."""
    return crawl.payload(_Tables(spark, sf_dir).pages.withColumn("host", U.host(F.col("url"))), "host", "page_id").select("page_id", "url", "html", "content")


@query(
    f"WITH p AS (SELECT page_id, {_host('url')} AS host, CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS hit FROM pages), w AS (SELECT *, row_number() OVER o AS n, coalesce(max(hit) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p WINDOW o AS (PARTITION BY host ORDER BY page_id)) SELECT page_id, host FROM w WHERE b = 0 AND n <= 3"
)
def w7_early_stop(spark, sf_dir):  # noqa: ANN001, ANN201
    """Pages of a host up to the first hit."""
    items = _Tables(spark, sf_dir).pages.select("page_id", U.host(F.col("url")).alias("host"), F.expr("page_id % 4 = 0").alias("hit"))
    return crawl.early_stop(items, "host", "page_id", "hit", 3).select("page_id", "host")


# Reports

_ALL = ("keywords", "search_results", "domain_contacts", "contacts")
_FLAT = "flat AS (SELECT c.id AS contact_id, c.contact_type, c.value, c.is_verified, d.id AS domain_contact_id, d.domain, d.confidence_score, d.created_at AS domain_at, k.id AS keyword_id, k.keyword, k.country, k.language FROM contacts c JOIN domain_contacts d ON c.domain_contact_id = d.id JOIN search_results r ON d.search_result_id = r.id JOIN keywords k ON r.keyword_id = k.id)"


def _flat(t: _Tables) -> DataFrame:
    return reports.flat_rows(t.domain_contacts, t.search_results, t.keywords, t.contacts)


@query(f"WITH {_FLAT} SELECT contact_id, contact_type, value, domain, keyword, country, language FROM flat", *_ALL)
def j1_flat_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts with domain, result and keyword."""
    return _flat(_Tables(spark, sf_dir)).select("contact_id", "contact_type", "value", "domain", "keyword", "country", "language")


_LISTS_SQL = ", ".join(f"coalesce(string_agg(value, '; ' ORDER BY contact_id) FILTER (contact_type = '{k}'), '') AS {k}" for k in reports.LISTS)


@query(f"WITH {_FLAT} SELECT keyword, country, language, domain, {_LISTS_SQL} FROM flat GROUP BY keyword, country, language, domain", *_ALL)
def a12_flat_export(spark, sf_dir):  # noqa: ANN001, ANN201
    """The flat export."""
    return reports.flat_export(_flat(_Tables(spark, sf_dir)))


@query(
    f"WITH {_FLAT}, firsts AS (SELECT keyword_id, keyword, country, language, domain, contact_type, value, min(contact_id) AS contact_id FROM flat GROUP BY ALL) SELECT keyword_id, keyword, country, language, domain, {_LISTS_SQL} FROM firsts GROUP BY keyword_id, keyword, country, language, domain",
    *_ALL,
)
def a12b_flat_export_once(spark, sf_dir):  # noqa: ANN001, ANN201
    """The flat export by keyword id, each value once."""
    return reports.flat_export(_flat(_Tables(spark, sf_dir)), ("keyword_id", "keyword", "country", "language", "domain"), once=True)


@query(
    f"WITH {_FLAT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY confidence_score DESC, domain_contact_id, contact_id) AS n FROM flat) SELECT domain, max(keyword) FILTER (n = 1) AS keyword, max(confidence_score) AS confidence_score, strftime(max(domain_at) FILTER (n = 1), '%Y-%m-%d %H:%M:%S') AS extracted_at, {_LISTS_SQL} FROM ranked GROUP BY domain",
    *_ALL,
)
def a12c_domain_export(spark, sf_dir):  # noqa: ANN001, ANN201
    """The export by domain."""
    return reports.domain_export(_flat(_Tables(spark, sf_dir)))


@query(f"WITH {_FLAT} SELECT contact_id FROM flat WHERE country = 'DE' AND contact_type = 'email' AND domain ILIKE '%SRC1%'", *_ALL)
def f2_export_filters(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts by country, type and domain."""
    return reports.filtered(_flat(_Tables(spark, sf_dir)), country="DE", contact_type="email", domain="SRC1").select("contact_id")


@query(f"WITH {_FLAT} SELECT contact_id, contact_type, value, domain, keyword FROM flat WHERE contact_type = 'email' AND (value ILIKE '%c1%' OR domain ILIKE '%c1%' OR keyword ILIKE '%c1%')", *_ALL)
def f3_contact_search(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts that match a type and a text."""
    return reports.search(_flat(_Tables(spark, sf_dir)), "email", "c1").select("contact_id", "contact_type", "value", "domain", "keyword")


@query(f"WITH {_FLAT} SELECT contact_id, value, domain_at FROM flat ORDER BY domain_at DESC, contact_id DESC LIMIT 50 OFFSET 50", *_ALL)
def o3_search_page(spark, sf_dir):  # noqa: ANN001, ANN201
    """The second page of the contacts, newest first."""
    return reports.page(_flat(_Tables(spark, sf_dir)), 2, 50, F.desc("domain_at"), F.desc("contact_id")).select("contact_id", "value", "domain_at")


@query(f"WITH {_FLAT} SELECT contact_id, keyword_id, domain, row_number() OVER (ORDER BY keyword_id, domain, contact_id) AS n FROM flat", *_ALL)
def w2_row_number(spark, sf_dir):  # noqa: ANN001, ANN201
    """The running number of the whole export."""
    return reports.numbered(_flat(_Tables(spark, sf_dir)), "keyword_id", "domain", "contact_id").select("contact_id", "keyword_id", "domain", "n")


@query("SELECT c.id, c.value, d.domain, d.created_at FROM contacts c JOIN domain_contacts d ON c.domain_contact_id = d.id ORDER BY d.created_at DESC, c.id DESC LIMIT 20", "contacts", "domain_contacts")
def j4_recent_contacts(spark, sf_dir):  # noqa: ANN001, ANN201
    """The newest contacts."""
    t = _Tables(spark, sf_dir)
    d = t.domain_contacts.select(F.col("id").alias("domain_contact_id"), "domain", "created_at")
    return t.contacts.join(d, "domain_contact_id").orderBy(F.desc("created_at"), F.desc("id")).limit(20).select("id", "value", "domain", "created_at")


@query("SELECT r.keyword_id, r.position, d.id AS domain_contact_id, d.domain, count(c.id) AS n_contacts FROM search_results r JOIN domain_contacts d ON d.search_result_id = r.id LEFT JOIN contacts c ON c.domain_contact_id = d.id GROUP BY ALL", "search_results", "domain_contacts", "contacts")
def j5_keyword_tree(spark, sf_dir):  # noqa: ANN001, ANN201
    """Domains of the keywords with the number of their contacts."""
    t = _Tables(spark, sf_dir)
    return reports.keyword_tree(t.search_results, t.domain_contacts, t.contacts).select("keyword_id", "position", "domain_contact_id", "domain", F.col("n_contacts").cast("long").alias("n_contacts"))


@query("SELECT k.id AS keyword_id, k.keyword, count(DISTINCT r.id) AS results, count(DISTINCT d.id) AS domains FROM keywords k LEFT JOIN search_results r ON r.keyword_id = k.id LEFT JOIN domain_contacts d ON d.search_result_id = r.id GROUP BY ALL", "keywords", "search_results", "domain_contacts")
def j8_keyword_progress(spark, sf_dir):  # noqa: ANN001, ANN201
    """Progress of every keyword."""
    t = _Tables(spark, sf_dir)
    return reports.keyword_progress(t.keywords, t.search_results, t.domain_contacts)


@query("SELECT d.id FROM domain_contacts d WHERE EXISTS (SELECT 1 FROM search_results r WHERE r.id = d.search_result_id AND r.keyword_id = 3)", "domain_contacts", "search_results")
def j6_keyword_semi(spark, sf_dir):  # noqa: ANN001, ANN201
    """Domains of one keyword by a semi-join."""
    t = _Tables(spark, sf_dir)
    wanted = t.search_results.where("keyword_id = 3").select(F.col("id").alias("search_result_id"))
    return t.domain_contacts.join(wanted, "search_result_id", "left_semi").select("id")


@query("SELECT domain, id, error_message FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY crawled_at DESC, id DESC) AS n FROM crawl_logs) WHERE n = 1", "crawl_logs")
def j15_latest_log(spark, sf_dir):  # noqa: ANN001, ANN201
    """The newest log of each domain."""
    return tasks.latest_per_key(_Tables(spark, sf_dir).crawl_logs, ("domain",), F.desc("crawled_at"), F.desc("id")).select("domain", "id", "error_message")


@query("SELECT language, count(*) AS n FROM keywords GROUP BY language", "keywords")
def a1_keywords_by_language(spark, sf_dir):  # noqa: ANN001, ANN201
    """Keywords by language."""
    return _Tables(spark, sf_dir).keywords.groupBy("language").agg(F.count("*").alias("n"))


@query("SELECT t.contact_type, count(c.id) AS n FROM (VALUES " + ", ".join(f"('{t}')" for t in V.CONTACT_TYPES) + ") t(contact_type) LEFT JOIN contacts c ON c.contact_type = t.contact_type GROUP BY t.contact_type", "contacts")
def a3_contact_types(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts by type, zeros too."""
    return reports.contact_type_counts(_Tables(spark, sf_dir).contacts)


@query("SELECT (SELECT count(DISTINCT domain) FROM domain_contacts) AS domains, email, telegram, linkedin, email + telegram + linkedin AS total FROM (SELECT count(*) FILTER (contact_type = 'email') AS email, count(*) FILTER (contact_type = 'telegram') AS telegram, count(*) FILTER (contact_type = 'linkedin') AS linkedin FROM contacts)", "domain_contacts", "contacts")
def a5_export_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    """The export's summary."""
    t = _Tables(spark, sf_dir)
    return reports.export_summary(t.domain_contacts, t.contacts)


@query("SELECT (SELECT count(*) FROM keywords) AS keywords, (SELECT count(*) FROM keywords WHERE is_processed) AS processed, (SELECT count(*) FROM domain_contacts) AS domains, (SELECT count(*) FROM contacts) AS contacts, (SELECT max(created_at) FROM domain_contacts) AS last_at", "keywords", "domain_contacts", "contacts")
def a6_dashboard(spark, sf_dir):  # noqa: ANN001, ANN201
    """Counters of the dashboard."""
    t = _Tables(spark, sf_dir)
    k = t.keywords.agg(F.count("*").alias("keywords"), F.count_if("is_processed").alias("processed"))
    d = t.domain_contacts.agg(F.count("*").alias("domains"), F.max("created_at").alias("last_at"))
    return k.crossJoin(d).crossJoin(t.contacts.agg(F.count("*").alias("contacts")))


@query(f"WITH {_FLAT} SELECT keyword_id, domain, count(*) AS contacts, count(*) FILTER (contact_type = 'email') AS emails FROM flat GROUP BY ROLLUP (keyword_id, domain)", *_ALL)
def a23_totals_rollup(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contact totals on three levels."""
    return reports.totals_rollup(_flat(_Tables(spark, sf_dir)))


@query("SELECT id, keyword, created_at FROM keywords WHERE NOT is_processed ORDER BY created_at, id LIMIT 50", "keywords")
def f1_pending_keywords(spark, sf_dir):  # noqa: ANN001, ANN201
    """The next keywords to process."""
    return _Tables(spark, sf_dir).keywords.where("NOT is_processed").orderBy("created_at", "id").limit(50).select("id", "keyword", "created_at")


@query("SELECT DISTINCT language AS value FROM keywords UNION SELECT * FROM (VALUES ('ru'), ('en'), ('uk'))", "keywords")
def so2_options(spark, sf_dir):  # noqa: ANN001, ANN201
    """Default and stored languages."""
    defaults = spark.createDataFrame([("ru",), ("en",), ("uk",)], "value string")
    return defaults.union(_Tables(spark, sf_dir).keywords.select("language")).distinct()


# Metrics

_R = "coalesce(round({0} * 100.0 / nullif({1}, 0), 2), {2})"


def _stats_sql(hours: int) -> str:
    since = f"TIMESTAMP '{AS_OF}' - INTERVAL {hours} HOUR"
    statuses = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in metrics.STATUSES)
    return f"""q AS (SELECT {statuses}, count(*) AS total, count(DISTINCT keyword_id) FILTER (status IN ('pending', 'running')) AS keywords_in_progress FROM task_queue),
l AS (SELECT count(*) AS crawls, count(*) FILTER (pages_crawled = 0) AS zero_page_crawls, count(*) FILTER (error_message ILIKE '%timeout%') AS timeout_crawls FROM crawl_logs WHERE crawled_at >= {since}),
m AS (SELECT domain_contact_id, count(*) AS n, count(*) FILTER (contact_type <> 'phone') AS reach, count(*) FILTER (contact_type IN ('x', 'facebook', 'instagram', 'youtube')) AS social FROM contacts GROUP BY ALL),
y AS (SELECT count(*) AS domains, count(*) FILTER (reach > 0) AS domains_with_contacts, count(*) FILTER (social > 0) AS domains_with_social, CAST(coalesce(sum(n), 0) AS BIGINT) AS contact_rows, count(*) FILTER (extraction_method = 'llm') AS llm_extractions FROM domain_contacts d LEFT JOIN m ON m.domain_contact_id = d.id WHERE created_at >= {since}),
stats AS (SELECT *, CAST({_R.format('(crawls - zero_page_crawls)', 'crawls', '100.0')} AS DOUBLE) AS crawl_success_rate, CAST({_R.format('timeout_crawls', 'crawls', '0.0')} AS DOUBLE) AS timeout_rate, CAST({_R.format('domains_with_contacts', 'domains', '0.0')} AS DOUBLE) AS domains_with_contacts_rate, CAST(coalesce(round(contact_rows / nullif(domains, 0), 2), 0.0) AS DOUBLE) AS avg_contacts_per_domain, CAST({_R.format('llm_extractions', 'domains', '0.0')} AS DOUBLE) AS llm_extraction_rate, CAST({_R.format('domains_with_social', 'domains', '0.0')} AS DOUBLE) AS social_coverage_rate FROM q, l, y)"""


_STAT_TABLES = ("task_queue", "crawl_logs", "contacts", "domain_contacts")


def _stats(spark: SparkSession, sf_dir: str, hours: int) -> DataFrame:
    t = _Tables(spark, sf_dir)
    return metrics.queue_stats(t.task_queue, t.crawl_logs, t.domain_contacts, t.contacts.select("domain_contact_id", "contact_type"), AS_OF, hours)


@query(f"WITH {_stats_sql(48)} SELECT * FROM stats", *_STAT_TABLES)
def a7_queue_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    """Queue and quality metrics of the last hours."""
    return _stats(spark, sf_dir, 48)


@query(
    f"WITH {_stats_sql(48)} SELECT array_to_string(list_filter([CASE WHEN failed > 0 THEN 'failed_tasks' END, CASE WHEN timeout_rate >= 35.0 THEN 'timeout_rate' END, CASE WHEN domains_with_contacts_rate <= 20.0 THEN 'contacts_rate' END, CASE WHEN avg_contacts_per_domain <= 0.5 THEN 'avg_contacts' END, CASE WHEN zero_page_crawls >= 5 THEN 'zero_pages' END], lambda x: x IS NOT NULL), ',') AS alerts, (failed = 0 AND timeout_rate < 35.0 AND domains_with_contacts_rate > 20.0 AND avg_contacts_per_domain > 0.5 AND zero_page_crawls < 5) AS passes, CASE WHEN timeout_rate >= 35.0 OR (domains_with_contacts_rate <= 20.0 AND total > 0) THEN 'degraded' ELSE 'healthy' END AS verdict FROM stats",
    *_STAT_TABLES,
)
def g1_alerts(spark, sf_dir):  # noqa: ANN001, ANN201
    """The nightly gate's alerts and the health verdict."""
    return metrics.health(metrics.alerts(_stats(spark, sf_dir, 48))).select(F.array_join("alerts", ",").alias("alerts"), "passes", "verdict")


@query(f"SELECT error_message, count(*) AS n FROM crawl_logs WHERE crawled_at >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR AND pages_crawled = 0 GROUP BY error_message ORDER BY n DESC, error_message NULLS FIRST LIMIT 8", "crawl_logs")
def a10_zero_page_reasons(spark, sf_dir):  # noqa: ANN001, ANN201
    """Why crawls were empty."""
    return metrics.zero_page_reasons(_Tables(spark, sf_dir).crawl_logs, AS_OF)


@query(
    f"""WITH z AS (SELECT domain, count(*) AS zero_count FROM crawl_logs WHERE crawled_at >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR AND pages_crawled = 0 GROUP BY domain HAVING count(*) >= 3 ORDER BY zero_count DESC, domain LIMIT 75),
h AS (SELECT regexp_replace(lower(domain), '^www\\.', '') AS host, zero_count FROM z)
SELECT host, zero_count, zero_count || ' zero-page crawls in 7d, no domain_contacts' AS reason FROM h WHERE NOT {_blocked('host')} AND host NOT IN (SELECT regexp_replace(lower(domain), '^www\\.', '') FROM domain_contacts) ORDER BY zero_count DESC, host LIMIT 25""",
    "crawl_logs",
    "domain_contacts",
)
def a11_denylist(spark, sf_dir):  # noqa: ANN001, ANN201
    """Hosts to block."""
    t = _Tables(spark, sf_dir)
    return metrics.denylist_candidates(t.crawl_logs, t.domain_contacts, AS_OF)


@query("SELECT run_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'processing') AS processing, CAST(sum(websites_processed) AS BIGINT) AS websites, CAST(sum(contacts_found) AS BIGINT) AS contacts, CAST(floor(100 * count(*) FILTER (status = 'completed') / count(*)) AS INTEGER) AS progress FROM pipeline_state GROUP BY run_id", "pipeline_state")
def a13_run_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    """Summary of every run."""
    return metrics.run_summary(_Tables(spark, sf_dir).pipeline_state)


@query("SELECT status, count(*) AS n, CAST(round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS DOUBLE) AS share FROM task_queue GROUP BY status", "task_queue")
def a16_status_shares(spark, sf_dir):  # noqa: ANN001, ANN201
    """Shares of the task statuses."""
    return metrics.status_shares(_Tables(spark, sf_dir).task_queue)


@query("SELECT task_type, status, count(*) AS n, avg(retry_count) AS avg_retries FROM task_queue GROUP BY task_type, status", "task_queue")
def a18_retries(spark, sf_dir):  # noqa: ANN001, ANN201
    """Tasks and mean retries by type and status."""
    return _Tables(spark, sf_dir).task_queue.groupBy("task_type", "status").agg(F.count("*").alias("n"), F.avg("retry_count").alias("avg_retries"))


@query("SELECT substr(error_message, 1, 12) AS error, count(*) AS n FROM crawl_logs WHERE error_message IS NOT NULL GROUP BY 1", "crawl_logs")
def a17_error_prefixes(spark, sf_dir):  # noqa: ANN001, ANN201
    """Errors by their beginning."""
    return _Tables(spark, sf_dir).crawl_logs.where("error_message IS NOT NULL").groupBy(F.substring("error_message", 1, 12).alias("error")).agg(F.count("*").alias("n"))


_PHASE = "CASE WHEN {0} < TIMESTAMP '2024-01-10' THEN 'before' WHEN {0} <= TIMESTAMP '2024-01-20' THEN 'during' ELSE 'after' END"


@query(
    f"WITH a AS (SELECT {_PHASE.format('crawled_at')} AS phase, count(*) AS crawls, count(*) FILTER (pages_crawled = 0) AS zero_page FROM crawl_logs GROUP BY 1), b AS (SELECT {_PHASE.format('created_at')} AS phase, count(*) AS domain_rows, count(DISTINCT domain) FILTER (id IN (SELECT domain_contact_id FROM contacts WHERE contact_type = 'email')) AS domains_with_email FROM domain_contacts GROUP BY 1) SELECT coalesce(a.phase, b.phase) AS phase, coalesce(crawls, 0) AS crawls, coalesce(zero_page, 0) AS zero_page, coalesce(domain_rows, 0) AS domain_rows, coalesce(domains_with_email, 0) AS domains_with_email FROM a FULL JOIN b ON a.phase = b.phase",
    "crawl_logs",
    "domain_contacts",
    "contacts",
)
def a9_window_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    """Counts before, in and after a time range."""
    t = _Tables(spark, sf_dir)
    return metrics.window_counts(t.crawl_logs, t.domain_contacts, t.contacts, "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query(
    "WITH h AS (SELECT generate_series AS s FROM generate_series(TIMESTAMP '2023-12-31 00:00:00', TIMESTAMP '2024-02-01 00:00:00', INTERVAL 1 HOUR)) SELECT s AS window_start, s + INTERVAL 24 HOUR AS window_end, count(*) AS crawls, count(*) FILTER (pages_crawled = 0) AS zero_page, count(*) FILTER (error_message ILIKE '%timeout%') AS timeouts, CAST(round((count(*) - count(*) FILTER (pages_crawled = 0)) * 100.0 / count(*), 2) AS DOUBLE) AS success_rate FROM h JOIN crawl_logs ON crawled_at >= s AND crawled_at < s + INTERVAL 24 HOUR GROUP BY s",
    "crawl_logs",
)
def t1_rolling_quality(spark, sf_dir):  # noqa: ANN001, ANN201
    """Quality in sliding windows of a day."""
    return rolling.rolling_quality(_Tables(spark, sf_dir).crawl_logs)


# Tasks

_PARENTS = "p AS (SELECT t.*, q.task_type AS parent_type, q.status AS parent_status, (q.id IS NULL OR q.status = 'completed' OR (q.status = 'failed' AND ((q.task_type = 'search_keyword' AND t.task_type IN ('crawl_domain', 'extract_contacts')) OR (q.task_type = 'crawl_domain' AND t.task_type = 'extract_contacts')))) AS satisfied FROM task_queue t LEFT JOIN task_queue q ON t.depends_on_task_id = q.id)"


@query(f"WITH {_PARENTS} SELECT id, satisfied FROM p", "task_queue")
def f18_dependencies(spark, sf_dir):  # noqa: ANN001, ANN201
    """Whether each task may start."""
    return tasks.with_parents(_Tables(spark, sf_dir).task_queue).select("id", "satisfied")


@query(f"WITH {_PARENTS} SELECT id, priority, created_at FROM p WHERE status = 'pending' AND satisfied ORDER BY priority DESC, created_at, id LIMIT 20", "task_queue")
def o6_next_tasks(spark, sf_dir):  # noqa: ANN001, ANN201
    """The next tasks to run."""
    return tasks.next_tasks(_Tables(spark, sf_dir).task_queue, 20).select("id", "priority", "created_at")


@query("SELECT id, task_type, retry_count + 1 AS retry_count, CASE WHEN retry_count + 1 < max_retries THEN 'pending' ELSE 'failed' END AS status FROM task_queue WHERE status = 'running'", "task_queue")
def t3_retry(spark, sf_dir):  # noqa: ANN001, ANN201
    """Running tasks after a failure."""
    return tasks.failed_once_more(_Tables(spark, sf_dir).task_queue)


@query("SELECT id, task_type, 'pending' AS status, locked_at AS was_locked_at FROM task_queue WHERE status = 'running' AND locked_at < TIMESTAMP '1998-01-01' - INTERVAL 300 SECOND", "task_queue")
def t5_stale(spark, sf_dir):  # noqa: ANN001, ANN201
    """Tasks with a stale lock after recovery."""
    return tasks.stale(_Tables(spark, sf_dir).task_queue, "1998-01-01 00:00:00")


@query("SELECT keyword_id, count(*) AS tasks FROM task_queue WHERE keyword_id IS NOT NULL GROUP BY keyword_id HAVING count(*) FILTER (status IN ('pending', 'running')) = 0", "task_queue")
def t6_finished_keywords(spark, sf_dir):  # noqa: ANN001, ANN201
    """Keywords whose tasks are all done."""
    return tasks.finished_keywords(_Tables(spark, sf_dir).task_queue)


@query("SELECT id, task_type, 'pending' AS status, retry_count FROM task_queue WHERE status = 'failed' ORDER BY created_at DESC, id DESC LIMIT 100", "task_queue")
def t7_requeued(spark, sf_dir):  # noqa: ANN001, ANN201
    """The newest failed tasks, queued again."""
    return tasks.requeued(_Tables(spark, sf_dir).task_queue, 100)


#: Searches that wait for the task before them, an extraction: its failure matters.
_WAITING = "SELECT id, task_type, status, CASE WHEN id % 3 = 0 THEN id - 1 ELSE depends_on_task_id END AS depends_on_task_id FROM task_queue"


@query(f"WITH tq AS ({_WAITING}) SELECT t.id, t.task_type, t.depends_on_task_id FROM tq t JOIN tq q ON t.depends_on_task_id = q.id WHERE t.status = 'pending' AND q.status = 'failed' AND NOT ((q.task_type = 'search_keyword' AND t.task_type IN ('crawl_domain', 'extract_contacts')) OR (q.task_type = 'crawl_domain' AND t.task_type = 'extract_contacts'))", "task_queue")
def t8_unblocked(spark, sf_dir):  # noqa: ANN001, ANN201
    """Tasks that wait for a failed parent."""
    waiting = F.expr("CASE WHEN id % 3 = 0 THEN id - 1 ELSE depends_on_task_id END")
    return tasks.unblocked(_Tables(spark, sf_dir).task_queue.withColumn("depends_on_task_id", waiting))


@query("SELECT id AS depends_on_task_id, keyword_id, CASE task_type WHEN 'search_keyword' THEN 'crawl_domain' ELSE 'extract_contacts' END AS task_type, CASE task_type WHEN 'search_keyword' THEN 5 ELSE 7 END AS priority, CASE task_type WHEN 'search_keyword' THEN 2 ELSE 1 END AS max_retries FROM task_queue WHERE status = 'completed' AND task_type IN ('search_keyword', 'crawl_domain')", "task_queue")
def t11_children(spark, sf_dir):  # noqa: ANN001, ANN201
    """Tasks that completed ones start."""
    return tasks.children(_Tables(spark, sf_dir).task_queue)


@query("WITH e AS (SELECT keyword_id, status, count(*) AS n FROM task_queue GROUP BY ALL) SELECT keyword_id, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (status IN ('pending', 'running')), 0) AS BIGINT) AS open, string_agg(status || '=' || n, ',' ORDER BY status) AS by_status FROM e GROUP BY keyword_id", "task_queue")
def a22_drill_down(spark, sf_dir):  # noqa: ANN001, ANN201
    """Tasks of each keyword by status."""
    return tasks.keyword_drill_down(_Tables(spark, sf_dir).task_queue)


@query("SELECT id FROM task_queue WHERE NOT (status IN ('completed', 'failed') AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 7 DAY)", "task_queue")
def k14_retained(spark, sf_dir):  # noqa: ANN001, ANN201
    """Tasks that stay after the retention rule."""
    return tasks.retained(_Tables(spark, sf_dir).task_queue, "1998-01-01 00:00:00").select("id")


# Sources and sinks


_SNIPPET = "concat('\"', title, '\" \\\\ ', url)"
_LISTED_RESULTS = "SELECT keyword_id, url, title, snippet, CAST(n AS INTEGER) AS position FROM (SELECT keyword_id, url, title, '\"' || title || '\" \\ ' || url AS snippet, row_number() OVER (PARTITION BY keyword_id ORDER BY position) AS n FROM search_results) WHERE n <= 10"


def _answers(t: _Tables, *names: str) -> DataFrame:
    """The search results of each keyword as a list of (url, title, snippet) under other names."""
    rows = t.search_results.withColumn("snippet", F.concat(F.lit('"'), "title", F.lit('" \\ '), "url"))
    item = F.struct(*[F.col(c).alias(n) for c, n in zip(("url", "title", "snippet"), names, strict=True)])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", item.alias("item")))), lambda x: x["item"])
    return rows.groupBy("keyword_id").agg(listed.alias("listed"))


@query(_LISTED_RESULTS, "search_results")
def s6_json_results(spark, sf_dir):  # noqa: ANN001, ANN201
    """Results of JSON answers."""
    answers = _answers(_Tables(spark, sf_dir), "link", "title", "snippet")
    return serp.json_results(answers.select("keyword_id", F.to_json(F.struct(F.col("listed").alias("organic_results"))).alias("answer")), "answer")


@query(_LISTED_RESULTS, "search_results")
def s7_list_results(spark, sf_dir):  # noqa: ANN001, ANN201
    """Results of JSON lists."""
    answers = _answers(_Tables(spark, sf_dir), "href", "title", "body")
    return serp.list_results(answers.select("keyword_id", F.to_json("listed").alias("answer")), "answer")


#: XML answers of seven kinds: plain, by headline, without a url, base64, broken, with a long passage, with a declared entity.
_CLEAN = "translate(title, '&<>', '')"
_XML = f"""CASE id % 7
 WHEN 0 THEN concat('<r xmlns="u"><doc><url>https://a.example/', CAST(id AS STRING), '</url><title>', {_CLEAN}, '</title><passages><passage>p</passage><passage> q </passage></passages></doc></r>')
 WHEN 1 THEN concat('<r><g><doc><url>https://a.example/', CAST(id AS STRING), '</url><headline>', {_CLEAN}, '</headline><passages><passage>a</passage><passage>b</passage><passage>c</passage><passage>d</passage></passages></doc></g></r>')
 WHEN 2 THEN '<r><doc><title>none</title></doc><doc><url>https://b.example/</url></doc></r>'
 WHEN 3 THEN 'x'
 WHEN 4 THEN '<r><doc><url>https://c.example/</url>'
 WHEN 5 THEN concat('<r><doc><url>https://d.example/</url><title>T</title><passages><passage>', repeat('y', 600), '</passage></passages></doc></r>')
 ELSE '<!DOCTYPE r [<!ENTITY e "x">]><r><doc><url>https://e.example/&e;</url></doc></r>' END"""


@query(
    f"""SELECT id, 'https://a.example/' || id AS url, trim({_CLEAN}) AS title, CASE WHEN id % 7 = 1 THEN 'a b c' ELSE 'p q' END AS snippet, 1 AS position FROM search_results WHERE id % 7 < 2 OR id % 7 = 3
UNION ALL SELECT id, 'https://b.example/', '', '', 1 FROM search_results WHERE id % 7 = 2
UNION ALL SELECT id, 'https://d.example/', 'T', repeat('y', 500) || '…', 1 FROM search_results WHERE id % 7 = 5""",
    "search_results",
)
def s10_xml_results(spark, sf_dir):  # noqa: ANN001, ANN201
    """Results of XML answers, plain and base64; a document without a url doesn't count."""
    rows = _Tables(spark, sf_dir).search_results
    coded = F.base64(F.encode(F.expr(_XML.replace("CASE id % 7", "CASE 0")), "UTF-8"))
    answer = F.when(F.col("id") % 7 == 3, coded).otherwise(F.expr(_XML))
    return serp.xml_results(rows.select("id", answer.alias("answer")), "answer")


@query("SELECT s.id, s.url FROM (SELECT keyword_id, url, min(id) AS id FROM search_results GROUP BY ALL) s WHERE NOT EXISTS (SELECT 1 FROM search_results k JOIN domain_contacts d ON d.search_result_id = k.id WHERE k.keyword_id = s.keyword_id AND k.url = s.url)", "search_results", "domain_contacts")
def k5_append_new(spark, sf_dir):  # noqa: ANN001, ANN201
    """Search results that no stored domain belongs to yet."""
    t = _Tables(spark, sf_dir)
    stored = t.search_results.join(t.domain_contacts.select(F.col("search_result_id").alias("id")), "id", "left_semi")
    return sinks.append_new(t.search_results, stored, ["keyword_id", "url"]).select("id", "url")


# More of the inventory: each a short plan over the logical tables


@query("SELECT form_id, keyword, pos FROM (SELECT form_id, pos, keyword, row_number() OVER (PARTITION BY keyword ORDER BY form_id, pos) AS n FROM (SELECT form_id, pos, substr(trim(translate(line, '<>\"''', '')), 1, 500) AS keyword FROM (SELECT conv_id * 1000 + turn AS form_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS pos FROM conversations)) WHERE keyword <> '') WHERE n = 1 AND keyword NOT IN (SELECT lower(n_name) FROM nation)")
def s3_new_keywords(spark, sf_dir):  # noqa: ANN001, ANN201
    """Lines of forms as new keywords, each once at its first place."""
    t = _Tables(spark, sf_dir)
    forms = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("form_id"), "text")
    return serp.new_keywords(forms, t.keywords)


#: Robots texts of five kinds; the rules of each, and whether /private/x1.pdf is allowed.
_ROBOTS = """CASE page_id % 5
 WHEN 0 THEN concat('User-agent: *\n  Disallow: /private', CAST(page_id AS STRING), '\nDisallow:\nAllow: /x\ncrawl-delay: not_a_number')
 WHEN 1 THEN concat('USER-AGENT: *\r\nDISALLOW: /PRIVATE/\r\nCrawl-Delay: 2\r\nAllow:\r\nallow:/y', CAST(page_id AS STRING))
 WHEN 2 THEN 'Disallow: /*.pdf\n\tDisallow:   /b \nCrawl-delay: 0.05\nCrawl-delay: x'
 WHEN 3 THEN 'nothing: here\nDisallow /a'
 ELSE '' END"""


@query(
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/x' WHEN 1 THEN '/y' || page_id ELSE '' END AS allow,
 CASE page_id % 5 WHEN 0 THEN '/private' || page_id WHEN 1 THEN '/private/' WHEN 2 THEN '/*.pdf /b' ELSE '' END AS disallow,
 CAST(CASE page_id % 5 WHEN 1 THEN 2 WHEN 2 THEN 0.1 ELSE 0.5 END AS DOUBLE) AS delay, page_id % 5 NOT IN (1, 2) AS allowed FROM pages"""
)
def s18_robots(spark, sf_dir):  # noqa: ANN001, ANN201
    """Rules, delay and verdict of robots texts."""
    r = F.col("r")
    rules = _Tables(spark, sf_dir).pages.select("page_id", serp.robots_rules(F.expr(_ROBOTS.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\\n WHEN", " WHEN").replace("\\n ELSE", " ELSE"))).alias("r"))
    return rules.select("page_id", F.array_join(r["allow"], " ").alias("allow"), F.array_join(r["disallow"], " ").alias("disallow"), U.crawl_delay(r["crawl_delay"]).alias("delay"), serp.is_allowed(F.lit("/private/x1.pdf"), r["disallow"]).alias("allowed"))


@query("SELECT page_id, url || '/s' AS loc FROM pages UNION ALL SELECT page_id, 'https://a.example/y.PDF' FROM pages UNION ALL SELECT page_id, 'https://m.example/' FROM pages, generate_series(1, 98) WHERE page_id % 10 = 0")
def s17_sitemaps(spark, sf_dir):  # noqa: ANN001, ANN201
    """Locations of sitemaps without media, a hundred at most."""
    xml = F.expr("concat('<urlset><url><loc>', url, '/s</loc></url><url><loc>', url, 'x.pdf</loc></url><loc>https://a.example/y.PDF</loc><loc>\\n</loc>', CASE WHEN page_id % 10 = 0 THEN repeat('<loc>https://m.example/</loc>', 120) ELSE '' END, '</urlset>')")
    return _Tables(spark, sf_dir).pages.select("page_id", F.explode(serp.sitemap_urls(xml)).alias("loc"))


#: Replies of a model: plain, with words around, two objects, a list, nested, broken, with one object inside, no JSON.
_REPLY = """CASE (conv_id + turn) % 8
 WHEN 0 THEN concat('{"emails": ["a', CAST(conv_id AS STRING), '@acme.example", "b@acme.example"], "telegram": []}')
 WHEN 1 THEN concat('Sure: {"emails": ["a', CAST(conv_id AS STRING), '@acme.example"]} done')
 WHEN 2 THEN '{"a": 1} then {"emails": ["x@acme.example"]}'
 WHEN 3 THEN '[1]'
 WHEN 4 THEN concat('{"meta": {"k": {"l": {}}}, "emails": ["n', CAST(conv_id AS STRING), '@acme.example"]}')
 WHEN 5 THEN '{"emails": ["x@acme.example"'
 WHEN 6 THEN concat('see {"m": {"a": 1}, "emails": ["m', CAST(conv_id AS STRING), '@acme.example"]} {"emails": []}')
 ELSE text END"""


@query(
    """SELECT conv_id, turn, CASE (conv_id + turn) % 8 WHEN 0 THEN 'a' || conv_id || '@acme.example b@acme.example' WHEN 1 THEN 'a' || conv_id || '@acme.example'
 WHEN 4 THEN 'n' || conv_id || '@acme.example' WHEN 6 THEN 'm' || conv_id || '@acme.example' ELSE '' END AS emails FROM conversations"""
)
def x22_model_replies(spark, sf_dir):  # noqa: ANN001, ANN201
    """E-mails in replies of a model, some of them no JSON."""
    return _Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.array_join(serp.llm_contacts(F.expr(_REPLY))["emails"], " ").alias("emails"))


#: Linked data: deep, as a text, broken beside good, with an address of a free provider, in capitals.
_LINKED = """CASE page_id % 6
 WHEN 0 THEN concat(html, '<script type="application/ld+json">{"@graph": [[{"a": {"b": {"email": " LD', CAST(page_id AS STRING), '@acme.example"}}}], {"sameAs": ["telegram.me/x", 3, {"sameAs": "https://www.linkedin.com/in/q?gclid=1"}]}]}</script>')
 WHEN 1 THEN concat(html, '<SCRIPT id="a" TYPE="application/ld+json" >{"sameAs": "https://t.me/telegram', CAST(page_id AS STRING), '#a"}</SCRIPT>')
 WHEN 2 THEN concat(html, '<script type="application/ld+json">{"email": </script><script type="application/ld+json">[{"email": "ok@acme.example"}, {"email": "x@gmail.com"}, {"email": 5}]</script>')
 WHEN 3 THEN concat(html, '<script>{"email": "no@acme.example"}</script>')
 ELSE html END"""


@query(
    """SELECT page_id, 'telegram' AS contact_type, 'https://t.me/x' AS value FROM pages WHERE page_id % 6 = 0
 UNION ALL SELECT page_id, 'linkedin', 'https://www.linkedin.com/in/q' FROM pages WHERE page_id % 6 = 0
 UNION ALL SELECT page_id, 'telegram', 'https://t.me/telegram' || page_id FROM pages WHERE page_id % 6 = 1
 UNION ALL SELECT page_id, 'email', 'ok@acme.example' FROM pages WHERE page_id % 6 = 2"""
)
def x17_linked_data(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts in linked-data scripts, at any depth."""
    return crawl.linked_data_contacts(_Tables(spark, sf_dir).pages.select("page_id", F.expr(_LINKED).alias("html")))


#: Stored texts: with a secret, a secret in a text inside, long plain text, a long text inside, a long list, a number as text.
_STORED = """CASE event_id % 6
 WHEN 0 THEN concat('{"k": ', CAST(event_id AS STRING), ', "API_KEY": {"x": 1}, "a": [{"password2": "p"}]}')
 WHEN 1 THEN concat('{"a": "{\\"token\\": \\"x\\", \\"n\\": ', CAST(event_id AS STRING), '}"}')
 WHEN 2 THEN concat(event_type, ' ', repeat('t', 600))
 WHEN 3 THEN concat('{"long": "', event_type, repeat('z', 600), '"}')
 WHEN 4 THEN concat('[', repeat('1,', 59), CAST(event_id AS STRING), ']')
 ELSE CAST(event_id AS STRING) END"""


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"API_KEY": "***REDACTED***", "a": [{"password2": "***REDACTED***"}], "k": ' || event_id || '}'
 WHEN 1 THEN '{"a": {"n": ' || event_id || ', "token": "***REDACTED***"}}' WHEN 2 THEN substr(event_type || ' ' || repeat('t', 600), 1, 500)
 WHEN 3 THEN '{"long": "' || substr(event_type || repeat('z', 600), 1, 500) || '"}' WHEN 4 THEN '[' || repeat('1, ', 49) || '1]' ELSE CAST(event_id AS VARCHAR) END AS clean FROM events"""
)
def p4_sanitised(spark, sf_dir):  # noqa: ANN001, ANN201
    """Stored texts without secrets."""
    return _Tables(spark, sf_dir).events.select("event_id", D.sanitise(F.expr(_STORED.replace("\\", "\\\\"))).alias("clean"))


@query("SELECT keyword_id, count(*) AS results FROM search_results GROUP BY keyword_id", "search_results")
def a19_results_per_keyword(spark, sf_dir):  # noqa: ANN001, ANN201
    """Results of each keyword."""
    return _Tables(spark, sf_dir).search_results.groupBy("keyword_id").agg(F.count("*").alias("results"))


_MINUTES = "date_diff('second', locked_at, TIMESTAMP '1998-12-01') // 60"


@query(f"SELECT CAST(max({_MINUTES}) AS BIGINT) AS oldest_minutes, count(*) AS locked FROM task_queue WHERE locked_at IS NOT NULL AND status = 'running'", "task_queue")
def a20_oldest_lock(spark, sf_dir):  # noqa: ANN001, ANN201
    """Age of the oldest lock."""
    minutes = F.expr("timestampdiff(MINUTE, locked_at, TIMESTAMP '1998-12-01')")
    return _Tables(spark, sf_dir).task_queue.where("locked_at IS NOT NULL AND status = 'running'").agg(F.max(minutes).alias("oldest_minutes"), F.count("*").alias("locked"))


@query("SELECT count(DISTINCT keyword_id) AS keywords FROM task_queue WHERE status IN ('pending', 'running')", "task_queue")
def a21_keywords_in_progress(spark, sf_dir):  # noqa: ANN001, ANN201
    """Keywords with open tasks."""
    return _Tables(spark, sf_dir).task_queue.where(F.col("status").isin("pending", "running")).agg(F.countDistinct("keyword_id").alias("keywords"))


@query("SELECT count(DISTINCT d.domain) AS domains, count(DISTINCT d.domain) FILTER (c.contact_type = 'email') AS with_email, CAST(round(count(DISTINCT d.domain) FILTER (c.contact_type = 'email') * 100.0 / count(DISTINCT d.domain), 1) AS DOUBLE) AS yield_pct FROM domain_contacts d LEFT JOIN contacts c ON c.domain_contact_id = d.id", "domain_contacts", "contacts")
def a25_email_yield(spark, sf_dir):  # noqa: ANN001, ANN201
    """Domains with e-mail and their share."""
    t = _Tables(spark, sf_dir)
    rows = t.domain_contacts.select(F.col("id").alias("domain_contact_id"), "domain").join(t.contacts.select("domain_contact_id", "contact_type"), "domain_contact_id", "left")
    out = rows.agg(F.countDistinct("domain").alias("domains"), F.countDistinct(F.when(F.col("contact_type") == "email", F.col("domain"))).alias("with_email"))
    return out.withColumn("yield_pct", metrics.rate(F.col("with_email"), F.col("domains"), digits=1))


@query("SELECT task_type, count(*) FILTER (status = 'failed') AS failed FROM task_queue GROUP BY task_type", "task_queue")
def a26_failed_by_type(spark, sf_dir):  # noqa: ANN001, ANN201
    """Failed tasks by type."""
    return _Tables(spark, sf_dir).task_queue.groupBy("task_type").agg(F.count_if(F.col("status") == "failed").alias("failed"))


@query("SELECT max(id) + 1 AS next_id FROM contacts", "contacts")
def a27_next_id(spark, sf_dir):  # noqa: ANN001, ANN201
    """The next free id."""
    return _Tables(spark, sf_dir).contacts.agg((F.max("id") + 1).alias("next_id"))


@query("SELECT count(*) FILTER (contact_type = 'email') AS emails, count(*) FILTER (contact_type = 'email' AND is_verified) AS verified, CAST(coalesce(round(count(*) FILTER (contact_type = 'email' AND is_verified) * 100.0 / nullif(count(*) FILTER (contact_type = 'email'), 0), 2), 0.0) AS DOUBLE) AS verified_pct FROM contacts", "contacts")
def a29_verified(spark, sf_dir):  # noqa: ANN001, ANN201
    """Verified e-mail addresses and their share."""
    mail = F.col("contact_type") == "email"
    out = _Tables(spark, sf_dir).contacts.agg(F.count_if(mail).alias("emails"), F.count_if(mail & F.col("is_verified")).alias("verified"))
    return out.withColumn("verified_pct", metrics.rate(F.col("verified"), F.col("emails")))


@query("SELECT count(*) AS contact_rows FROM contacts c WHERE c.domain_contact_id IN (SELECT id FROM domain_contacts WHERE created_at >= TIMESTAMP '2024-01-29')", "contacts", "domain_contacts")
def j13_recent_contact_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts of recent domains."""
    t = _Tables(spark, sf_dir)
    recent = t.domain_contacts.where("created_at >= TIMESTAMP '2024-01-29'").select(F.col("id").alias("domain_contact_id"))
    return t.contacts.join(recent, "domain_contact_id", "left_semi").agg(F.count("*").alias("contact_rows"))


@query(f"WITH r AS (SELECT id, url, {_root('url')} AS root FROM search_results), c AS (SELECT id AS cand, CASE WHEN id % 2 = 0 THEN url ELSE {_root('url')} END AS u FROM search_results), x AS (SELECT url, max(id) AS id FROM r GROUP BY url), y AS (SELECT root, min(id) AS id FROM r GROUP BY root) SELECT c.cand, coalesce(x.id, y.id) AS result_id FROM c LEFT JOIN x ON c.u = x.url LEFT JOIN y ON c.u = y.root", "search_results")
def j14_candidate_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    """The stored result of each candidate URL: the last with this URL, else the first with this root."""
    r = _Tables(spark, sf_dir).search_results.select("id", "url", U.root(F.col("url")).alias("root"))
    cand = r.select(F.col("id").alias("cand"), F.when(F.col("id") % 2 == 0, F.col("url")).otherwise(F.col("root")).alias("u"))
    exact = r.groupBy(F.col("url").alias("u")).agg(F.max("id").alias("exact"))
    roots = r.groupBy(F.col("root").alias("u")).agg(F.min("id").alias("by_root"))
    return cand.join(exact, "u", "left").join(roots, "u", "left").select("cand", F.coalesce("exact", "by_root").alias("result_id"))


@query("SELECT id, error_message, duration_seconds FROM crawl_logs WHERE error_message ILIKE '%timeout%' AND crawled_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'", "crawl_logs")
def f5_timeouts(spark, sf_dir):  # noqa: ANN001, ANN201
    """Timeouts in a closed range of time."""
    logs = _Tables(spark, sf_dir).crawl_logs.where("crawled_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
    return logs.where(metrics.is_timeout(F.col("error_message"))).select("id", "error_message", "duration_seconds")


@query(f"SELECT id, CAST({_MINUTES} AS BIGINT) AS minutes FROM task_queue WHERE status = 'running' ORDER BY minutes DESC, id LIMIT 10", "task_queue")
def o9_longest_running(spark, sf_dir):  # noqa: ANN001, ANN201
    """The longest running tasks."""
    minutes = F.expr("timestampdiff(MINUTE, locked_at, TIMESTAMP '1998-12-01')")
    return _Tables(spark, sf_dir).task_queue.where("status = 'running'").select("id", minutes.alias("minutes")).orderBy(F.desc("minutes"), "id").limit(10)


@query("SELECT run_id, keyword_id, status, websites_processed, contacts_found FROM (SELECT *, row_number() OVER (PARTITION BY run_id, keyword_id ORDER BY id DESC) AS n FROM pipeline_state) WHERE n = 1", "pipeline_state")
def t12_progress(spark, sf_dir):  # noqa: ANN001, ANN201
    """The last state of each keyword in each run."""
    return tasks.latest_per_key(_Tables(spark, sf_dir).pipeline_state, ("run_id", "keyword_id"), F.desc("id")).select("run_id", "keyword_id", "status", "websites_processed", "contacts_found")


@query("SELECT run_id, with_contacts_pct, zero_page_pct, failures, CAST(CASE WHEN with_contacts_pct < 20 OR zero_page_pct > 60 OR failures > 0 THEN 2 ELSE 0 END AS INTEGER) AS exit_code FROM (SELECT run_id, CAST(round(count(*) FILTER (contacts_found > 0) * 100.0 / count(*), 2) AS DOUBLE) AS with_contacts_pct, CAST(round(count(*) FILTER (websites_processed = 0) * 100.0 / count(*), 2) AS DOUBLE) AS zero_page_pct, count(*) FILTER (status = 'failed') AS failures FROM pipeline_state GROUP BY run_id)", "pipeline_state")
def g3_weekly_gate(spark, sf_dir):  # noqa: ANN001, ANN201
    """The weekly gate of every run."""
    n = F.count("*")
    counts = [metrics.rate(F.count_if(F.expr(test)), n).alias(name) for name, test in (("with_contacts_pct", "contacts_found > 0"), ("zero_page_pct", "websites_processed = 0"))]
    failures = F.count_if(F.col("status") == "failed").alias("failures")
    return metrics.weekly_gate(_Tables(spark, sf_dir).pipeline_state.groupBy("run_id").agg(*counts, failures))


@query("WITH v AS (SELECT event_type AS metric, CAST(count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS DOUBLE) AS b, CAST(count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS DOUBLE) AS a FROM events GROUP BY event_type) SELECT metric, b AS before, a AS after, a - b AS delta, CASE WHEN a >= b THEN 'improved' ELSE 'regressed' END AS verdict FROM v")
def g4_report_delta(spark, sf_dir):  # noqa: ANN001, ANN201
    """Differences of two reports."""
    e = _Tables(spark, sf_dir).events
    early = F.expr("ts < TIMESTAMP '2024-01-15'")
    old, new = (e.groupBy(F.col("event_type").alias("metric")).agg(F.count_if(test).cast("double").alias("value")) for test in (early, ~early))
    return metrics.report_delta(old, new)


@query("SELECT doc_id, array_to_string(list_slice(list_filter([source, 'B2B', 'saas', lang, 'iot'], lambda t: lower(t) NOT IN ('b2b', 'company', 'business', 'website')), 1, 3), ', ') AS subject FROM documents")
def p8_subject_area(spark, sf_dir):  # noqa: ANN001, ANN201
    """Subject areas from tags."""
    tags = F.array("source", F.lit("B2B"), F.lit("saas"), "lang", F.lit("iot"))
    return _Tables(spark, sf_dir).documents.select("doc_id", C.subject_area(tags).alias("subject"))


@query("SELECT domain, CASE WHEN pages_crawled > 0 THEN 200 ELSE 0 END AS status_code, CASE WHEN pages_crawled = 0 THEN error_message END AS error_message, pages_crawled, duration_seconds, crawled_at FROM crawl_logs", "crawl_logs")
def k7_crawl_log_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    """Log rows with the error only where no page came."""
    return sinks.crawl_log_rows(_Tables(spark, sf_dir).crawl_logs.withColumnRenamed("error_message", "error"))


@query("SELECT id FROM crawl_logs WHERE crawled_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY", "crawl_logs")
def k16_log_retention(spark, sf_dir):  # noqa: ANN001, ANN201
    """Logs that the retention rule keeps."""
    return _Tables(spark, sf_dir).crawl_logs.where("crawled_at >= TIMESTAMP '2024-01-31' - INTERVAL '7' DAY").select("id")
