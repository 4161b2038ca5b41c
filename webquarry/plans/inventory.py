"""Further queries of the inventory, registered beside those of the catalog.

Inputs that the tables don't have (JSON, settings, statuses) are built from their columns in
several forms; the oracle SQL computes the result from the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webquarry import fixed_values as V
from webquarry.functions import contacts as C
from webquarry.functions import urls as U
from webquarry.operators import crawl, metrics, reports, tasks
from webquarry.plans.catalog import _ALL, _FLAT, _LISTS_SQL, _R, _STAT_TABLES, AS_OF, _any, _blocked, _flat, _host, _path, _root, _score, _stats, _stats_sql, _Tables, _text, query
from webquarry.sources import serp, sinks

# Keywords


@query("SELECT id, keyword, language FROM (SELECT id, lower(keyword) AS keyword, CASE WHEN id % 2 = 0 THEN language ELSE 'xx' END AS language FROM keywords) n WHERE NOT EXISTS (SELECT 1 FROM keywords k WHERE k.keyword = n.keyword AND k.language = n.language)", "keywords")
def s2_add_keywords(spark, sf_dir):  # noqa: ANN001, ANN201
    """Keywords that aren't stored in their language yet."""
    known = _Tables(spark, sf_dir).keywords
    new = known.select("id", F.lower("keyword").alias("keyword"), F.when(F.col("id") % 2 == 0, F.col("language")).otherwise("xx").alias("language"))
    return sinks.append_new(new, known, ["keyword", "language"]).select("id", "keyword", "language")


_FORM_TEXT = "CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN concat(' <b>', role, '\"s ') WHEN 2 THEN repeat(text, 40) ELSE '  ' END"


@query(
    f"""WITH forms AS (SELECT conv_id * 1000 + turn AS form_id, trim(coalesce({_FORM_TEXT}, '')) AS t FROM conversations),
clean AS (SELECT form_id, CASE WHEN t = '' THEN 'empty' WHEN length(t) > 500 THEN 'too_long' END AS bad, trim(translate(t, '<>"''', '')) AS keyword FROM forms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bad IS NULL, keyword ORDER BY form_id) AS n FROM clean)
SELECT form_id, CASE WHEN bad IS NULL THEN keyword END AS keyword, coalesce(bad, CASE WHEN n = 1 AND keyword NOT IN (SELECT keyword FROM keywords) THEN 'added' ELSE 'exists' END) AS outcome FROM ranked""",
    "keywords",
)
def s4_single_forms(spark, sf_dir):  # noqa: ANN001, ANN201
    """What becomes of single keyword forms."""
    t = _Tables(spark, sf_dir)
    forms = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("form_id"), F.expr(_FORM_TEXT).alias("text"))
    return serp.single_forms(forms, t.keywords)


@query("SELECT id, keyword, language, country, is_processed, CAST(NULL AS VARCHAR) AS last_crawled_at, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM keywords ORDER BY created_at DESC", "keywords")
def p2_keywords_api(spark, sf_dir):  # noqa: ANN001, ANN201
    """The keywords as the API lists them, newest first."""
    k = _Tables(spark, sf_dir).keywords.orderBy(F.desc("created_at"), "id")
    return k.select("id", "keyword", "language", "country", "is_processed", F.lit(None).cast("string").alias("last_crawled_at"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


@query("SELECT id, keyword, language, country, is_processed FROM keywords", "keywords")
def p5_keyword_list(spark, sf_dir):  # noqa: ANN001, ANN201
    """The keywords of the service."""
    return _Tables(spark, sf_dir).keywords.select("id", "keyword", "language", "country", "is_processed")


@query("SELECT id, keyword, created_at FROM keywords ORDER BY created_at DESC, id LIMIT 20 OFFSET 20", "keywords")
def o4_keyword_page(spark, sf_dir):  # noqa: ANN001, ANN201
    """The second page of the keywords."""
    return reports.page(_Tables(spark, sf_dir).keywords, 2, 20, F.desc("created_at"), F.col("id")).select("id", "keyword", "created_at")


@query("SELECT id, keyword FROM keywords WHERE NOT is_processed ORDER BY created_at DESC, id", "keywords")
def f27_unprocessed(spark, sf_dir):  # noqa: ANN001, ANN201
    """Keywords to process, newest first."""
    return _Tables(spark, sf_dir).keywords.where("NOT is_processed").orderBy(F.desc("created_at"), "id").select("id", "keyword")


@query("SELECT id, keyword, false AS is_processed FROM keywords WHERE is_processed", "keywords")
def t9_reset_keywords(spark, sf_dir):  # noqa: ANN001, ANN201
    """Processed keywords, to be processed again."""
    return tasks.reset_keywords(_Tables(spark, sf_dir).keywords)


_RAW_LOCALE = "CASE id % 4 WHEN 0 THEN upper(language) WHEN 1 THEN concat(' ', language, ' ') WHEN 2 THEN concat(language, '1') ELSE country END"


@query(
    f"SELECT id, CASE WHEN regexp_full_match(lower(trim(x)), '[a-z]{{2,8}}') THEN lower(trim(x)) ELSE 'ru' END AS language, CASE WHEN regexp_full_match(upper(trim(x)), '[A-Z]{{2,3}}') THEN upper(trim(x)) ELSE 'RU' END AS country, trim(translate('<' || keyword || ' \"', '<>\"''', '')) AS keyword FROM (SELECT id, keyword, {_RAW_LOCALE} AS x FROM keywords)",
    "keywords",
)
def x27_locales(spark, sf_dir):  # noqa: ANN001, ANN201
    """Languages, countries and keywords of forms, with their defaults."""
    rows = _Tables(spark, sf_dir).keywords.select("id", "keyword", F.expr(_RAW_LOCALE).alias("x"))
    return rows.select("id", C.language_or_default(F.col("x")).alias("language"), C.country_or_default(F.col("x")).alias("country"), C.clean_keyword(F.concat(F.lit("<"), "keyword", F.lit(' "'))).alias("keyword"))


_TERM = "CASE id % 3 WHEN 0 THEN concat('Startup ', keyword) WHEN 1 THEN concat(keyword, ' финтех') ELSE keyword END"


@query(
    "SELECT id, CASE id % 3 WHEN 0 THEN 'Startup ' || keyword || '|company ' || keyword || '|business ' || keyword || '|venture ' || keyword WHEN 1 THEN keyword || ' финтех|' || keyword || ' financial technology|' || keyword || ' fintech' ELSE keyword END AS variations FROM keywords",
    "keywords",
)
def x28_variations(spark, sf_dir):  # noqa: ANN001, ANN201
    """Keywords with their known terms replaced."""
    return _Tables(spark, sf_dir).keywords.select("id", F.array_join(C.keyword_variations(F.expr(_TERM)), "|").alias("variations"))


@query("SELECT id, keyword || CASE WHEN lower(country) <> lower(keyword) THEN '|' || country ELSE '' END || '|x' AS tags FROM keywords", "keywords")
def p7_tags(spark, sf_dir):  # noqa: ANN001, ANN201
    """Tags: the keyword, then categories that aren't there yet."""
    categories = F.array(F.upper("keyword"), F.col("country"), F.lit("x"), F.lit("y"))
    return _Tables(spark, sf_dir).keywords.select("id", F.array_join(C.merged_tags(F.col("keyword"), categories), "|").alias("tags"))


# Search answers


def _map_sql(column: str, known: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in known.items()) + f" ELSE '{default}' END"


@query(
    f"SELECT id, {_map_sql('upper(c)', serp.SEARCH_TYPES, 'SEARCH_TYPE_RU')} AS search_type, {_map_sql('lower(language)', serp.LOCALISATIONS, 'LOCALIZATION_RU')} AS l10n, {_map_sql('c', serp.REGIONS, 'ru-ru')} AS region, substr(repeat(keyword || ' ', 80), 1, 400) AS query, CAST(greatest(1, least(id - 3, 20)) AS INTEGER) AS results, CAST(least(3, greatest(1, least(id - 3, 20))) AS INTEGER) AS passages FROM (SELECT *, CASE WHEN id % 5 = 0 THEN lower(country) WHEN id % 7 = 0 THEN 'BY' ELSE country END AS c FROM keywords)",
    "keywords",
)
def s8_search_requests(spark, sf_dir):  # noqa: ANN001, ANN201
    """Bounded search requests of long keywords; with it search types, localisations and regions."""
    country = F.expr("CASE WHEN id % 5 = 0 THEN lower(country) WHEN id % 7 = 0 THEN 'BY' ELSE country END")
    rows = _Tables(spark, sf_dir).keywords.withColumn("c", country)
    request = serp.search_request(F.repeat(F.concat("keyword", F.lit(" ")), 80), F.col("c"), F.col("language"), F.col("id") - 3)
    return rows.select("id", serp.region(F.col("c")).alias("region"), request.alias("r")).select("id", "region", "r.*")


_ENVELOPE = """CASE id % 5 WHEN 0 THEN concat('{"rawData": "', CAST(id AS STRING), '"}') WHEN 1 THEN concat('{"error": {"message": "no quota ', CAST(id AS STRING), '", "code": 8}}')
 WHEN 2 THEN '{"error": {"code": 7}, "rawData": ""}' WHEN 3 THEN '<html>' ELSE '{}' END"""


@query("SELECT id, CASE id % 5 WHEN 1 THEN 'no quota ' || id WHEN 2 THEN '{\"code\":7}' WHEN 3 THEN 'unreadable answer' END AS error FROM search_results", "search_results")
def s11_answer_errors(spark, sf_dir):  # noqa: ANN001, ANN201
    """Why answers have no results."""
    return _Tables(spark, sf_dir).search_results.select("id", serp.answer_error(F.expr(_ENVELOPE)).alias("error"))


_ENV = """CASE id % 5 WHEN 0 THEN concat('A=1\\nSERP_BLOCKED_HOST_SUFFIXES=["a', CAST(id AS STRING), '.example", "B.example"]\\nC=2') WHEN 1 THEN concat('SERP_BLOCKED_HOST_SUFFIXES=" x.example , y', CAST(id AS STRING), '.example,, "')
 WHEN 2 THEN 'SERP_BLOCKED_HOST_SUFFIXES=' WHEN 3 THEN 'OTHER=a.example' ELSE '' END"""
_ENV_PLAIN = _ENV.replace("\\n", "' || chr(10) || '")
_ENV_HOSTS_SQL = "CASE id % 5 WHEN 0 THEN ['a' || id || '.example', 'B.example'] WHEN 1 THEN ['x.example', 'y' || id || '.example'] ELSE CAST([] AS VARCHAR[]) END"


@query(f"SELECT id, array_to_string({_ENV_HOSTS_SQL}, ' ') AS hosts FROM keywords", "keywords")
def s19_env_hosts(spark, sf_dir):  # noqa: ANN001, ANN201
    """Hosts of settings, as JSON or between commas."""
    return _Tables(spark, sf_dir).keywords.select("id", F.array_join(serp.env_hosts(F.expr(_ENV)), " ").alias("hosts"))


@query(
    f"""WITH e AS (SELECT id, {_ENV_PLAIN.replace('STRING', 'VARCHAR')} AS env, {_ENV_HOSTS_SQL} AS hosts, CASE WHEN id % 4 = 0 THEN CAST([] AS VARCHAR[]) WHEN id % 4 = 1 THEN ['X.example', 'b.example', 'new.example'] ELSE ['a' || id || '.example', 'x.example', 'b.example'] END AS s FROM keywords),
m AS (SELECT *, list_filter(list_transform(s, lambda h: lower(h)), lambda h: NOT list_contains(list_transform(hosts, lambda k: lower(k)), h)) AS fresh FROM e),
j AS (SELECT *, '[' || array_to_string(list_transform(list_concat(hosts, fresh), lambda h: '"' || h || '"'), ',') || ']' AS js FROM m)
SELECT id, CAST(CASE WHEN len(s) = 0 THEN 1 WHEN len(fresh) = 0 THEN 2 ELSE 0 END AS INTEGER) AS exit_code,
  CASE WHEN len(fresh) = 0 THEN env WHEN id % 5 = 0 THEN 'A=1' || chr(10) || 'SERP_BLOCKED_HOST_SUFFIXES=' || js || chr(10) || 'C=2' WHEN id % 5 IN (1, 2) THEN 'SERP_BLOCKED_HOST_SUFFIXES=' || js
    ELSE env || CASE WHEN env <> '' THEN chr(10) ELSE '' END || 'SERP_BLOCKED_HOST_SUFFIXES=' || js || chr(10) END AS env FROM j""",
    "keywords",
)
def k10_denylist_settings(spark, sf_dir):  # noqa: ANN001, ANN201
    """Settings with suggested hosts added, and the exit code."""
    rows = _Tables(spark, sf_dir).keywords.select("id", F.expr(_ENV).alias("env"))
    one = F.concat(F.lit("a"), F.col("id").cast("string"), F.lit(".example"))
    suggested = F.when(F.col("id") % 4 == 0, F.array().cast("array<string>")).when(F.col("id") % 4 == 1, F.array(*map(F.lit, ("X.example", "b.example", "new.example")))).otherwise(F.array(one, F.lit("x.example"), F.lit("b.example")))
    hosts, code = sinks.denylist_outcome(suggested, serp.env_hosts(F.col("env")))
    return rows.select("id", code.alias("exit_code"), F.when(code == 0, sinks.env_text(F.col("env"), hosts)).otherwise(F.col("env")).alias("env"))


_CATEGORIES = """CASE id % 5 WHEN 0 THEN '["fintech", "ai", "saas", "iot"]' WHEN 1 THEN concat('Tags: ["k', CAST(id AS STRING), '"] and ["x"]') WHEN 2 THEN '{"a": ["b"]}' WHEN 3 THEN 'none' ELSE 'see ["a", ' END"""


@query("SELECT id, CASE id % 5 WHEN 0 THEN 'fintech|ai|saas' WHEN 1 THEN 'k' || id ELSE '' END AS categories FROM search_results", "search_results")
def x23_categories(spark, sf_dir):  # noqa: ANN001, ANN201
    """Categories in replies of a model."""
    return _Tables(spark, sf_dir).search_results.select("id", F.array_join(serp.llm_categories(F.expr(_CATEGORIES)), "|").alias("categories"))


# Pages and links


@query(f"SELECT page_id, length(content) AS chars FROM (SELECT page_id, trim(h) AS h, {_text('trim(h)')} AS content FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN substr(html, 1, 79) WHEN 2 THEN ' ' || substr(html, 1, 900) ELSE html END AS h, CASE page_id % 5 WHEN 0 THEN 404 ELSE 200 END AS status FROM pages) WHERE status < 400) WHERE length(h) >= 80 AND length(content) >= 200")
def s13_usable_pages(spark, sf_dir):  # noqa: ANN001, ANN201
    """Fetched pages that are worth reading."""
    html = F.expr("CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN substring(html, 1, 79) WHEN 2 THEN concat(' ', substring(html, 1, 900)) ELSE html END")
    rows = _Tables(spark, sf_dir).pages.select("page_id", html.alias("html"), F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("status"))
    return crawl.usable_pages(rows).select("page_id", F.length("content").cast("long").alias("chars"))


#: Pages under few hosts, some of them contact pages.
_SITE_URL = "concat('https://site', CAST(page_id % 20 AS STRING), '.example', CASE page_id % 3 WHEN 0 THEN '/contact/' WHEN 1 THEN '/about;v=1?x=' ELSE '/item/' END, CAST(page_id AS STRING))"


def _sites(t: _Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.expr(_SITE_URL).alias("url"))
    return rows.withColumn("host", U.host(F.col("url")))


_SITES = f"sites AS (SELECT page_id, {_SITE_URL} AS url, 'site' || page_id % 20 || '.example' AS host FROM pages), c AS (SELECT host, page_id, {_path('url')} AS path, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM sites WHERE {_any('lower(url)', V.CONTACT_PAGE_PARTS)})"


@query(f"WITH {_SITES} SELECT host, string_agg(path, ' ' ORDER BY page_id) AS paths FROM c WHERE n <= 5 GROUP BY host")
def p10_contact_paths(spark, sf_dir):  # noqa: ANN001, ANN201
    """Paths of the first contact pages of each host."""
    return crawl.contact_paths(_sites(_Tables(spark, sf_dir)), "host", "page_id").select("host", F.array_join("paths", " ").alias("paths"))


@query(f"WITH {_SITES} SELECT page_id FROM sites s WHERE EXISTS (SELECT 1 FROM c WHERE n <= 5 AND c.host = s.host AND c.path = {_path('s.url')})")
def s16_contact_pages(spark, sf_dir):  # noqa: ANN001, ANN201
    """Pages that a visit of contact pages only reads."""
    sites = _sites(_Tables(spark, sf_dir))
    return crawl.listed_pages(sites, crawl.contact_paths(sites, "host", "page_id"), "host").select("page_id")


@query(f"SELECT page_id, regexp_matches(c, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') OR regexp_matches(c, '(?:t\\.me|telegram\\.me)[/\\w]+') AS quick FROM (SELECT page_id, {_text('html')} || CASE page_id % 4 WHEN 0 THEN ' t.me/a' WHEN 1 THEN ' a@b.example' ELSE '' END AS c FROM pages)")
def f15_quick_contacts(spark, sf_dir):  # noqa: ANN001, ANN201
    """Pages with contacts at first sight."""
    more = F.expr("CASE page_id % 4 WHEN 0 THEN ' t.me/a' WHEN 1 THEN ' a@b.example' ELSE '' END")
    return _Tables(spark, sf_dir).pages.select("page_id", C.has_quick_contacts(F.concat(C.html_text(F.col("html")), more)).alias("quick"))


_SNIPPETS = "SELECT id, url, keyword_id, trim(title) AS title, CASE id % 4 WHEN 0 THEN 'write to a' || id || '@acme.example ' WHEN 1 THEN '' WHEN 2 THEN 'TG: @acme_team' ELSE 'nothing' END AS snippet FROM search_results"
_SNIPPET_TEXT = "CASE id % 4 WHEN 0 THEN concat('write to a', CAST(id AS STRING), '@acme.example ') WHEN 1 THEN '' WHEN 2 THEN 'TG: @acme_team' ELSE 'nothing' END"


def _snippets(t: _Tables) -> DataFrame:
    rows = t.search_results.select("id", "keyword_id", "url", "title", F.col("id").alias("seq"), F.expr(_SNIPPET_TEXT).alias("snippet"))
    return rows.withColumn("host", U.host(F.col("url")))


@query(f"SELECT id, 'serp_snippet' AS type, 10 AS priority, url, '' AS html, CASE WHEN title = '' THEN trim(snippet) ELSE title || chr(10) || trim(snippet) END AS content FROM ({_SNIPPETS}) WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY {_host('url')} ORDER BY id) = 1", "search_results")
def p14_snippet_items(spark, sf_dir):  # noqa: ANN001, ANN201
    """Items for extraction of each host's first search result with a contact in its text."""
    return crawl.snippet_items(crawl.best_snippets(_snippets(_Tables(spark, sf_dir)))).select("id", "item.*")


@query(f"WITH s AS (SELECT *, {_host('url')} AS h FROM ({_SNIPPETS})) SELECT id, url FROM s WHERE NOT EXISTS (SELECT 1 FROM s k WHERE k.h = s.h AND k.id % 2 = 0)", "search_results")
def w10_still_to_crawl(spark, sf_dir):  # noqa: ANN001, ANN201
    """Search results of hosts without a contact in any result's text."""
    rows = _snippets(_Tables(spark, sf_dir))
    return rows.join(crawl.best_snippets(rows).select("host"), "host", "left_anti").select("id", "url")


@query(
    f"""WITH cand AS (SELECT page_id AS seq, 0 AS cand, trim(url) AS u FROM pages WHERE trim(url) <> '' UNION ALL SELECT page_id, 1, {_root('trim(url)')} FROM pages WHERE trim(url) <> '' AND length({_path('trim(url)')}) > 1 AND {_any(f'lower({_path("trim(url)")})', V.ARTICLE_MARKERS)}),
scored AS (SELECT seq, cand, u, {_host('u')} AS host, {_score('u')} AS score FROM cand), ok AS (SELECT * FROM scored WHERE NOT {_blocked('host')} AND score > -1000),
best AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, seq, cand) AS n, min(seq) OVER (PARTITION BY host) AS first_seq FROM ok)
SELECT host, u AS url, row_number() OVER (ORDER BY score DESC, first_seq) AS place FROM best WHERE n = 1 ORDER BY place LIMIT 200"""
)
def o7_ranked_targets(spark, sf_dir):  # noqa: ANN001, ANN201
    """The first two hundred crawl targets with their place."""
    targets = crawl.ranked(crawl.crawl_targets(_Tables(spark, sf_dir).pages.select(F.col("page_id").alias("seq"), "url"))).limit(200)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "first_seq")).cast("long")
    return targets.select("host", "url", place.alias("place"))


@query(f"SELECT base, url, CAST(priority AS INTEGER) AS priority, row_number() OVER (PARTITION BY base ORDER BY priority DESC, i) AS place FROM (SELECT base, base || p AS url, w AS priority, i FROM (SELECT DISTINCT {_root('url')} AS base FROM pages) r, (VALUES " + ", ".join(f"('{p[1:]}', {w}, {i})" for i, (p, w) in enumerate([*[(p, 10) for p in V.PRIMARY_PATHS], *[(p, 7) for p in V.CONTACT_PATHS if p not in V.PRIMARY_PATHS], ("/", 7), *[(p, 5) for p in V.EXTRA_PATHS if p not in V.CONTACT_PATHS]])) + ") v(p, w, i))")
def o8_visit_order(spark, sf_dir):  # noqa: ANN001, ANN201
    """The URLs of each site in the order of their visit."""
    rows = crawl.frontier(_Tables(spark, sf_dir).pages.select(U.root(F.col("url")).alias("base")).distinct(), keep_order=True)
    place = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("priority"), "seq")).cast("long")
    return rows.select("base", "url", "priority", place.alias("place"))


@query(f"SELECT id, regexp_replace(replace(u, 'telegram.me/', 't.me/'), '#.*$', '') AS url FROM (SELECT id, 'https://' || CASE id % 2 WHEN 0 THEN 'telegram.me/a' ELSE 't.me/b' END || id || '#x' AS u FROM search_results)", "search_results")
def u7_telegram_urls(spark, sf_dir):  # noqa: ANN001, ANN201
    """Telegram links in their short form."""
    u = F.concat(F.when(F.col("id") % 2 == 0, "telegram.me/a").otherwise("//t.me/b"), F.col("id").cast("string"), F.lit("#x"))
    return _Tables(spark, sf_dir).search_results.select("id", U.telegram_url(u).alias("url"))


@query("SELECT url FROM pages ORDER BY page_id DESC LIMIT 20")
def o12_newest_urls(spark, sf_dir):  # noqa: ANN001, ANN201
    """The newest search results' URLs, twenty at most."""
    return _Tables(spark, sf_dir).search_results.orderBy(F.desc("id")).limit(max(1, min(25, 20))).select("url")


# Stored contacts

_JSON = """CASE id % 7 WHEN 0 THEN concat('{"emails": ["a', CAST(id AS STRING), '@acme.example"]}') WHEN 1 THEN '{"emails": [], "telegram": [], "social": {"x": []}}' WHEN 2 THEN '{"social": {"x": [], "youtube": ["u"]}}' WHEN 3 THEN NULL WHEN 4 THEN 'null' WHEN 5 THEN '[]' ELSE '{"linkedin": ["l"], "phones": ["1"]}' END"""
_LEN = "coalesce(json_array_length(j, '$.{0}'), 0) > 0"
_SOCIAL_SQL = "coalesce(json_array_length(j, '$.social.x'), 0) + coalesce(json_array_length(j, '$.social.youtube'), 0) > 0"


@query(
    f"SELECT id, {_LEN.format('emails')} OR {_LEN.format('telegram')} OR {_LEN.format('linkedin')} OR {_SOCIAL_SQL} AS has_data, {_LEN.format('emails')} OR {_LEN.format('telegram')} AS has_mail, {_SOCIAL_SQL} AS has_social, j IS NOT NULL AS stored FROM (SELECT id, CAST({_JSON.replace('STRING', 'VARCHAR')} AS JSON) AS j FROM domain_contacts)",
    "domain_contacts",
)
def f21_stored_data(spark, sf_dir):  # noqa: ANN001, ANN201
    """Whether stored contacts hold anything, of several kinds; a null column isn't the JSON null."""
    j = F.expr(_JSON)
    return _Tables(spark, sf_dir).domain_contacts.select("id", C.stored_has_data(j).alias("has_data"), C.stored_has_data(j, ("emails", "telegram"), social=False).alias("has_mail"), C.stored_has_data(j, (), social=True).alias("has_social"), j.isNotNull().alias("stored"))


@query(f"SELECT count(*) FILTER ({_LEN.format('emails')} OR {_LEN.format('telegram')}) AS sample_with_data FROM (SELECT CAST({_JSON.replace('STRING', 'VARCHAR')} AS JSON) AS j FROM domain_contacts ORDER BY id LIMIT 200)", "domain_contacts")
def f22_sample_with_data(spark, sf_dir):  # noqa: ANN001, ANN201
    """Of the first 200 domains, those whose stored contacts have an e-mail or Telegram."""
    sample = _Tables(spark, sf_dir).domain_contacts.orderBy("id").limit(200)
    return sample.agg(F.count_if(C.stored_has_data(F.expr(_JSON), ("emails", "telegram"), social=False)).alias("sample_with_data"))


_TRACE = "CASE WHEN extraction_method = 'llm' THEN 'model-a' END"


@query("SELECT 'domain' AS kind, id, domain AS name FROM (SELECT id, domain FROM domain_contacts WHERE id % 7 <> 3 ORDER BY id DESC LIMIT 50) UNION ALL SELECT 'log', id, domain FROM (SELECT id, domain FROM crawl_logs WHERE error_message IS NOT NULL ORDER BY id DESC LIMIT 50) UNION ALL SELECT 'result', id, url FROM (SELECT id, url FROM search_results ORDER BY id DESC LIMIT 50) UNION ALL SELECT 'stat', 1, CAST(count(*) AS VARCHAR) FROM search_results UNION ALL SELECT 'stat', 2, CAST(count(*) AS VARCHAR) FROM crawl_logs UNION ALL SELECT 'stat', 3, CAST(count(*) FILTER (error_message IS NOT NULL) AS VARCHAR) FROM crawl_logs UNION ALL SELECT 'stat', 4, CAST(count(*) FILTER (id % 7 <> 3) AS VARCHAR) FROM domain_contacts", "domain_contacts", "crawl_logs", "search_results")
def p3_trace_api(spark, sf_dir):  # noqa: ANN001, ANN201
    """The newest fifty of three tables and four counts, of rows whose optional column isn't null."""
    t = _Tables(spark, sf_dir)
    stored = t.domain_contacts.where(F.expr(_JSON).isNotNull())
    logs = t.crawl_logs.where("error_message IS NOT NULL")
    newest = lambda df, kind, name: df.orderBy(F.desc("id")).limit(50).select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.col(name).alias("name"))
    out = newest(stored, "domain", "domain").union(newest(logs, "log", "domain")).union(newest(t.search_results, "result", "url"))
    for n, df in enumerate((t.search_results, t.crawl_logs, logs, stored), 1):
        out = out.union(df.agg(F.count("*").alias("n")).select(F.lit("stat"), F.lit(n).cast("long"), F.col("n").cast("string")))
    return out


@query("SELECT c.id, coalesce(d.domain, 'Unknown') AS domain FROM contacts c LEFT JOIN domain_contacts d ON c.domain_contact_id + 150 = d.id", "contacts", "domain_contacts")
def j18_domain_names(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts with the name of their domain, if it is known."""
    t = _Tables(spark, sf_dir)
    d = t.domain_contacts.select((F.col("id") - 150).alias("domain_contact_id"), "domain")
    return t.contacts.join(d, "domain_contact_id", "left").select("id", F.coalesce("domain", F.lit("Unknown")).alias("domain"))


@query("SELECT d.id, r.keyword_id, d.domain FROM domain_contacts d JOIN search_results r ON d.search_result_id = r.id WHERE r.keyword_id = 3", "domain_contacts", "search_results")
def j12_domains_of_keyword(spark, sf_dir):  # noqa: ANN001, ANN201
    """Domains with the search result that led to them, of one keyword."""
    t = _Tables(spark, sf_dir)
    r = t.search_results.where("keyword_id = 3").select(F.col("id").alias("search_result_id"), "keyword_id")
    return t.domain_contacts.join(r, "search_result_id").select("id", "keyword_id", "domain")


@query("SELECT d.id, d.domain, r.url FROM domain_contacts d JOIN search_results r ON d.search_result_id = r.id ORDER BY d.id LIMIT 3", "domain_contacts", "search_results")
def j19_domain_sample(spark, sf_dir):  # noqa: ANN001, ANN201
    """The first three domains with their URL."""
    t = _Tables(spark, sf_dir)
    return t.domain_contacts.join(t.search_results.select(F.col("id").alias("search_result_id"), "url"), "search_result_id").orderBy("id").limit(3).select("id", "domain", "url")


@query("SELECT r.id, k.keyword FROM search_results r JOIN (SELECT url, min(id) AS id FROM search_results GROUP BY url) f ON r.url = f.url JOIN search_results s ON s.id = f.id JOIN keywords k ON k.id = s.keyword_id", "search_results", "keywords")
def j17_keyword_by_url(spark, sf_dir):  # noqa: ANN001, ANN201
    """The keyword of each URL's first search result, whatever keyword that was for."""
    t = _Tables(spark, sf_dir)
    first = t.search_results.groupBy("url").agg(F.min_by("keyword_id", "id").alias("kid"))
    return t.search_results.select("id", "url").join(first, "url").join(t.keywords.select(F.col("id").alias("kid"), "keyword"), "kid").select("id", "keyword")


@query("SELECT r.keyword_id, r.position, d.id AS domain_contact_id, coalesce(string_agg(c.contact_type || '=' || c.value, ',' ORDER BY c.id), '') AS listed FROM search_results r JOIN domain_contacts d ON d.search_result_id = r.id LEFT JOIN contacts c ON c.domain_contact_id = d.id WHERE r.keyword_id = 3 GROUP BY ALL ORDER BY position, domain_contact_id", "search_results", "domain_contacts", "contacts")
def o10_keyword_page(spark, sf_dir):  # noqa: ANN001, ANN201
    """One keyword's domains with their contacts, by position."""
    t = _Tables(spark, sf_dir)
    tree = reports.keyword_tree(t.search_results.where("keyword_id = 3"), t.domain_contacts, t.contacts)
    listed = F.array_join(F.transform("contacts", lambda c: F.concat(c["contact_type"], F.lit("="), c["value"])), ",")
    return tree.orderBy("position", "domain_contact_id").select("keyword_id", "position", "domain_contact_id", F.coalesce(listed, F.lit("")).alias("listed"))


_INSERTS = "SELECT concat('crawl_', CAST(id AS STRING)) AS task_name, CASE id % 5 WHEN 4 THEN 'other' WHEN 3 THEN 'save_results' ELSE task_type END AS task_type, keyword_id, CASE WHEN id % 2 = 0 THEN priority END AS priority, CASE WHEN id % 7 = 0 THEN 9 END AS max_retries FROM {0}"


@query(
    f"SELECT task_name, task_type, keyword_id, coalesce(priority, 0) AS priority, coalesce(max_retries, CAST({_map_sql('task_type', {k: str(v) for k, v in V.MAX_RETRIES.items()}, '3')} AS INTEGER)) AS max_retries, 'pending' AS status, 0 AS retry_count FROM ({_INSERTS.format('task_queue')})",
    "task_queue",
)
def k11_new_tasks(spark, sf_dir):  # noqa: ANN001, ANN201
    """Tasks as they are inserted."""
    return sinks.new_tasks(spark.sql(_INSERTS.format("{t}"), t=_Tables(spark, sf_dir).task_queue))


_PAYLOAD = """CASE id % 4 WHEN 0 THEN concat('[{"url": "u', CAST(id AS STRING), '", "content": "a", "priority": 3}, {"url": "v"}]') WHEN 1 THEN '{"url": "x"}' WHEN 2 THEN '' ELSE NULL END"""


@query("SELECT id, 'u' || id AS url, 'a' AS content, 3 AS priority FROM task_queue WHERE id % 4 = 0 UNION ALL SELECT id, 'v', NULL, NULL FROM task_queue WHERE id % 4 = 0", "task_queue")
def k13_payload_pages(spark, sf_dir):  # noqa: ANN001, ANN201
    """Pages in tasks' payloads; what is no list has none."""
    rows = _Tables(spark, sf_dir).task_queue.select("id", F.explode(serp.unpacked(F.expr(_PAYLOAD))).alias("p"))
    return rows.select("id", "p.url", "p.content", "p.priority")


@query("SELECT l.id, CASE WHEN n = 1 AND l.domain IN (SELECT domain FROM domain_contacts WHERE extraction_method = 'llm') THEN 'model-a' END AS llm_model FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY crawled_at DESC, id DESC) AS n FROM crawl_logs) l", "crawl_logs", "domain_contacts")
def k8_model_traces(spark, sf_dir):  # noqa: ANN001, ANN201
    """Logs with the model's trace on the newest of each domain."""
    t = _Tables(spark, sf_dir)
    traces = t.domain_contacts.where("extraction_method = 'llm'").select("domain").distinct()
    traces = traces.select("domain", F.lit("q").alias("llm_request"), F.lit("a").alias("llm_response"), F.lit("model-a").alias("llm_model"))
    return sinks.with_model_trace(t.crawl_logs, traces, "domain").select("id", "llm_model")


@query("SELECT id, CASE WHEN extraction_method = 'llm' THEN 'llm' ELSE 'regex' END AS method FROM domain_contacts", "domain_contacts")
def x25_method_label(spark, sf_dir):  # noqa: ANN001, ANN201
    """How contacts were found."""
    return _Tables(spark, sf_dir).domain_contacts.select("id", C.method_label(F.expr(_TRACE)).alias("method"))


# Exports

_TAGS = "CASE id % 3 WHEN 0 THEN array('b2b', 'saas') WHEN 1 THEN array('Company') ELSE array('ai', 'iot', 'x', 'y') END"
_FLAT_KEYS = "keyword_id, keyword, country, language, domain"


def _tags(t: _Tables) -> DataFrame:
    """The tags of each domain, those of its first row."""
    return t.domain_contacts.groupBy("domain").agg(F.min("id").alias("id")).select("domain", F.expr(_TAGS).alias("tags"))


_SUBJECT_SQL = "CASE t.id % 3 WHEN 0 THEN 'saas' WHEN 1 THEN {0} ELSE 'ai, iot, x' END"


def _flat_csv_sql(other: str, once: bool) -> str:
    source = f"(SELECT {_FLAT_KEYS}, contact_type, value, min(contact_id) AS contact_id FROM flat GROUP BY ALL)" if once else "flat"
    return f"""WITH {_FLAT}, g AS (SELECT {_FLAT_KEYS}, {_LISTS_SQL} FROM {source} GROUP BY {_FLAT_KEYS}), t AS (SELECT domain, min(id) AS id FROM domain_contacts GROUP BY domain)
SELECT row_number() OVER (ORDER BY keyword_id, g.domain) AS "№", keyword AS "Ключевое слово", country AS "Страна", language AS "Язык", g.domain AS "Домен", email AS "Email", telegram AS "Telegram", linkedin AS "LinkedIn", phone AS "Телефон", {_SUBJECT_SQL.format(other)} AS "Предметная область" FROM g JOIN t USING (domain)"""


@query(_flat_csv_sql("''", False), *_ALL)
def k1_localised_export(spark, sf_dir):  # noqa: ANN001, ANN201
    """The flat export's ten columns under their headers."""
    t = _Tables(spark, sf_dir)
    return sinks.localised(reports.flat_export_rows(_flat(t), _tags(t)))


@query(_flat_csv_sql("CASE WHEN keyword IN ('b2b', 'company', 'business', 'website') THEN '' ELSE keyword END", True), *_ALL)
def k2_export_with_fallback(spark, sf_dir):  # noqa: ANN001, ANN201
    """The flat export with each value once, and the keyword where no tag says anything."""
    t = _Tables(spark, sf_dir)
    once = reports.flat_export(_flat(t), ("keyword_id", "keyword", "country", "language", "domain"), once=True).join(_tags(t), "domain", "left")
    subject = C.subject_or_keyword(F.col("tags"), F.col("keyword"))
    return sinks.localised(reports.numbered(once.withColumn("subject", subject), "keyword_id", "domain"))


@query(f"WITH {_FLAT} SELECT contact_id FROM flat WHERE keyword_id = 3 AND confidence_score >= 40 AND domain_at >= TIMESTAMP '2024-01-05' AND domain_at <= TIMESTAMP '2024-01-25'", *_ALL)
def f4_dated_export(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts of one keyword by confidence and date."""
    return reports.filtered(_flat(_Tables(spark, sf_dir)), keyword_id=3, min_confidence=40, start="2024-01-05 00:00:00", end="2024-01-25 00:00:00").select("contact_id")


@query(f"WITH {_FLAT} SELECT contact_id, confidence_score FROM flat ORDER BY confidence_score DESC, contact_id LIMIT 100", *_ALL)
def o2_by_confidence(spark, sf_dir):  # noqa: ANN001, ANN201
    """The first contacts by confidence."""
    return _flat(_Tables(spark, sf_dir)).orderBy(F.desc("confidence_score"), "contact_id").limit(100).select("contact_id", "confidence_score")


@query(f"WITH {_FLAT}, s AS (SELECT * FROM flat ORDER BY contact_id LIMIT 20) SELECT domain, {_LISTS_SQL} FROM s GROUP BY domain", *_ALL)
def a12d_domain_sample(spark, sf_dir):  # noqa: ANN001, ANN201
    """Domains of the first twenty contacts with their values."""
    return reports.domain_sample(_flat(_Tables(spark, sf_dir)))


@query("SELECT id FROM contacts WHERE contact_type = 'linkedin'", "contacts")
def f26_by_type(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts of one type."""
    return _Tables(spark, sf_dir).contacts.where("contact_type = 'linkedin'").select("id")


@query("SELECT t.contact_type, count(c.id) AS n FROM (VALUES " + ", ".join(f"('{t}')" for t in V.CONTACT_TYPES) + ") t(contact_type) LEFT JOIN contacts c ON c.contact_type = t.contact_type GROUP BY t.contact_type UNION ALL SELECT 'total', count(*) FROM contacts", "contacts")
def a3b_types_with_total(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts by type and their total."""
    contacts = _Tables(spark, sf_dir).contacts
    return reports.contact_type_counts(contacts).union(contacts.agg(F.count("*").alias("n")).select(F.lit("total"), "n"))


# Reports and gates


@query(
    f"""WITH l AS (SELECT * FROM crawl_logs WHERE crawled_at >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR), v AS (
SELECT 'keywords_total' AS metric, CAST(count(*) AS DOUBLE) AS value FROM keywords UNION ALL SELECT 'keywords_processed', count(*) FILTER (is_processed) FROM keywords UNION ALL SELECT 'keywords_pending', count(*) FILTER (NOT is_processed) FROM keywords
{" ".join(f"UNION ALL SELECT 'tasks_{s}', count(*) FILTER (status = '{s}') FROM task_queue" for s in metrics.STATUSES)}
{" ".join(f"UNION ALL SELECT 'failed_{t}', count(*) FILTER (status = 'failed' AND task_type = '{t}') FROM task_queue" for t in ("search_keyword", "crawl_domain", "extract_contacts"))}
UNION ALL SELECT 'crawls', count(*) FROM l UNION ALL SELECT 'zero_pages', count(*) FILTER (pages_crawled = 0) FROM l UNION ALL SELECT 'timeouts', count(*) FILTER (error_message ILIKE '%timeout%') FROM l
UNION ALL SELECT 'zero_page_rate', round(100.0 * count(*) FILTER (pages_crawled = 0) / nullif(count(*), 0), 1) FROM l UNION ALL SELECT 'timeout_rate', round(100.0 * count(*) FILTER (error_message ILIKE '%timeout%') / nullif(count(*), 0), 1) FROM l
UNION ALL SELECT 'contact_rows', count(*) FROM contacts UNION ALL SELECT 'domains_with_email', count(DISTINCT domain_contact_id) FILTER (contact_type = 'email') FROM contacts
UNION ALL SELECT 'domain_contacts', count(*) FROM domain_contacts UNION ALL SELECT 'llm_domains', count(*) FILTER (extraction_method = 'llm') FROM domain_contacts
UNION ALL SELECT 'email_yield', round(100.0 * (SELECT count(DISTINCT domain_contact_id) FILTER (contact_type = 'email') FROM contacts) / (SELECT count(*) FROM domain_contacts), 1))
SELECT metric, value FROM v WHERE value IS NOT NULL""",
    "keywords",
    "task_queue",
    "crawl_logs",
    "contacts",
    "domain_contacts",
)
def a8_quality_report(spark, sf_dir):  # noqa: ANN001, ANN201
    """The quality report of a week."""
    t = _Tables(spark, sf_dir)
    return metrics.quality_report(t.keywords, t.task_queue, t.crawl_logs, t.domain_contacts, t.contacts, AS_OF)


@query(
    f"SELECT 48 AS window_hours, total_crawls, zero_page_crawls, domain_contacts, domains_with_social, CAST({_R.format('(total_crawls - zero_page_crawls)', 'total_crawls', '100.0')} AS DOUBLE) AS crawl_success_rate, CAST({_R.format('domains_with_social', 'domain_contacts', '0.0')} AS DOUBLE) AS social_coverage_rate FROM (SELECT count(*) AS total_crawls, count(*) FILTER (pages_crawled = 0) AS zero_page_crawls FROM crawl_logs WHERE crawled_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR), (SELECT count(*) AS domain_contacts, count(*) FILTER (id % 7 = 2) AS domains_with_social FROM domain_contacts WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR)",
    "crawl_logs",
    "domain_contacts",
)
def a14_smoke_snapshot(spark, sf_dir):  # noqa: ANN001, ANN201
    """The snapshot before and after a smoke run."""
    t = _Tables(spark, sf_dir)
    return metrics.smoke_snapshot(t.crawl_logs, t.domain_contacts.withColumn("has_social", C.stored_has_data(F.expr(_JSON), (), social=True)), AS_OF, 48)


_RUNS = "SELECT run_id, websites_processed AS pages_crawled, contacts_found > 2 AS has_contacts, status = 'failed' AS failed FROM pipeline_state"
_SUMMARY = f"SELECT run_id, count(*) AS processed, count(*) FILTER (NOT failed AND has_contacts) AS with_contacts, count(*) FILTER (NOT failed AND pages_crawled = 0) AS zero_page_in_run, count(*) FILTER (failed) AS failures FROM ({_RUNS}) GROUP BY run_id"
_RATES = f"SELECT *, CAST({_R.format('with_contacts', 'processed', '0.0')} AS DOUBLE) AS with_contacts_rate, CAST({_R.format('zero_page_in_run', 'processed', '0.0')} AS DOUBLE) AS zero_page_rate_in_run FROM ({_SUMMARY})"


def _runs(t: _Tables) -> DataFrame:
    return t.pipeline_state.select("run_id", F.col("websites_processed").alias("pages_crawled"), (F.col("contacts_found") > 2).alias("has_contacts"), (F.col("status") == "failed").alias("failed"))


@query(_RATES, "pipeline_state")
def a15_smoke_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    """Rates of each run's sites."""
    return metrics.smoke_summary(_runs(_Tables(spark, sf_dir)), "run_id")


@query(
    f"WITH r AS ({_RATES}), a AS (SELECT *, row_number() OVER (ORDER BY run_id DESC) AS age FROM r), p AS (UNPIVOT (SELECT age, with_contacts_rate, zero_page_rate_in_run, CAST(failures AS DOUBLE) AS failures FROM a WHERE age <= 2) ON with_contacts_rate, zero_page_rate_in_run, failures INTO NAME metric VALUE v) SELECT metric, new, old, delta, CASE WHEN (metric = 'with_contacts_rate' AND delta < 0) OR (metric <> 'with_contacts_rate' AND delta > 0) THEN 'regressed' ELSE 'improved' END AS trend FROM (SELECT metric, new, old, CAST(round(new - old, 2) AS DOUBLE) AS delta FROM (SELECT metric, max(v) FILTER (age = 1) AS new, max(v) FILTER (age = 2) AS old FROM p GROUP BY metric))",
    "pipeline_state",
)
def w6_newest_delta(spark, sf_dir):  # noqa: ANN001, ANN201
    """How the newest report differs from the one before."""
    rows = metrics.smoke_summary(_runs(_Tables(spark, sf_dir)), "run_id")
    # As many rows as there are runs.
    return metrics.newest_delta(rows.withColumn("age", F.row_number().over(Window.orderBy(F.desc("run_id")))))


@query(f"WITH {_stats_sql(48)}, s AS (SELECT *, (id % 2 = 0) AS ok FROM stats, (VALUES (0), (1)) v(id)) SELECT id, CASE WHEN NOT ok THEN 'unhealthy' WHEN timeout_rate >= 35.0 OR (domains_with_contacts_rate <= 20.0 AND total > 0) THEN 'degraded' ELSE 'healthy' END AS verdict FROM s", *_STAT_TABLES)
def g5_health(spark, sf_dir):  # noqa: ANN001, ANN201
    """The verdict with and without a service."""
    services = spark.createDataFrame([(0, True), (1, False)], "id int, ok boolean")
    return metrics.health(_stats(spark, sf_dir, 48).crossJoin(F.broadcast(services)), F.col("ok")).select("id", "verdict")


@query("SELECT array_to_string(list_filter([CASE WHEN stale > 0 THEN 'stale' END, CASE WHEN total = 0 THEN 'empty' END, CASE WHEN running > 15 THEN 'busy' END, CASE WHEN failed > 20 THEN 'failures' END], lambda x: x IS NOT NULL), ',') AS hints, total, running, failed, stale FROM (SELECT count(*) AS total, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running' AND locked_at < TIMESTAMP '1998-01-01' - INTERVAL 300 SECOND) AS stale FROM task_queue)", "task_queue")
def g6_hints(spark, sf_dir):  # noqa: ANN001, ANN201
    """What an operator of the queue should look at."""
    return metrics.hints(_Tables(spark, sf_dir).task_queue, "1998-01-01 00:00:00").withColumn("hints", F.array_join("hints", ","))


@query(f"WITH {_stats_sql(48)}, r AS (SELECT run_id AS run_run_id, count(*) AS run_total, count(*) FILTER (status = 'completed') AS run_completed, count(*) FILTER (status = 'failed') AS run_failed FROM pipeline_state WHERE run_id = (SELECT run_id FROM pipeline_state ORDER BY id DESC LIMIT 1) GROUP BY run_id) SELECT run_run_id, run_total, run_completed, run_failed, total, crawls, timeout_rate, domains_with_contacts_rate FROM r, stats", *_STAT_TABLES, "pipeline_state")
def g7_metrics_bundle(spark, sf_dir):  # noqa: ANN001, ANN201
    """The last run and the queue in one row."""
    out = metrics.metrics_bundle(_Tables(spark, sf_dir).pipeline_state, _stats(spark, sf_dir, 48)).withColumnRenamed("run_id", "run_run_id")
    return out.select("run_run_id", "run_total", "run_completed", "run_failed", "total", "crawls", "timeout_rate", "domains_with_contacts_rate")


# Tasks

_TASK_ERRORS = "CASE id % 3 WHEN 0 THEN repeat(task_type, 8) WHEN 1 THEN concat('timeout of ', CAST(id % 2 AS STRING)) END"


@query(f"SELECT task_type, substr(e, 1, 80) AS error, count(*) AS n FROM (SELECT *, {_TASK_ERRORS} AS e FROM task_queue) WHERE status = 'failed' GROUP BY 1, 2", "task_queue")
def a17_failures(spark, sf_dir):  # noqa: ANN001, ANN201
    """Failed tasks by type and the beginning of their error."""
    return tasks.failures(_Tables(spark, sf_dir).task_queue.withColumn("error_message", F.expr(_TASK_ERRORS)))


@query("SELECT id, 'completed' AS status, CAST(NULL AS TIMESTAMP) AS locked_at, TIMESTAMP '1998-12-01' AS completed_at FROM task_queue WHERE status = 'running'", "task_queue")
def t4_completed(spark, sf_dir):  # noqa: ANN001, ANN201
    """Running tasks after success."""
    return tasks.completed(_Tables(spark, sf_dir).task_queue, "1998-12-01 00:00:00")


@query("SELECT id, 'pending' AS status, 0 AS retry_count, CAST(NULL AS TIMESTAMP) AS locked_at, CAST(NULL AS VARCHAR) AS error_message FROM task_queue WHERE task_type = 'search_keyword' AND status = 'failed'", "task_queue")
def t7_reset_searches(spark, sf_dir):  # noqa: ANN001, ANN201
    """All failed searches as new."""
    return tasks.reset_searches(_Tables(spark, sf_dir).task_queue).select("id", "status", "retry_count", "locked_at", "error_message")


@query("SELECT id, locked_at FROM task_queue WHERE status = 'running' ORDER BY locked_at DESC NULLS LAST, id DESC LIMIT 10", "task_queue")
def o14_latest_locks(spark, sf_dir):  # noqa: ANN001, ANN201
    """Running tasks with the latest locks."""
    return tasks.longest_locked(_Tables(spark, sf_dir).task_queue).select("id", "locked_at")


@query(
    f"SELECT 'search_' || id AS task_name, 'search_keyword' AS task_type, id AS keyword_id, 10 AS priority, 3 AS max_retries, 'pending' AS status, 0 AS retry_count FROM (SELECT * FROM keywords WHERE NOT is_processed ORDER BY created_at, id LIMIT 50) UNION ALL SELECT 'extract_snippet_' || id, 'extract_contacts', keyword_id, 8, 1, 'pending', 0 FROM ({_SNIPPETS}) WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY {_host('url')} ORDER BY id) = 1",
    "keywords",
    "search_results",
)
def t11_first_tasks(spark, sf_dir):  # noqa: ANN001, ANN201
    """The searches of a run, and the extractions that need no crawl, as they are inserted."""
    t = _Tables(spark, sf_dir)
    return sinks.new_tasks(tasks.first_tasks(t.keywords).union(tasks.snippet_tasks(crawl.best_snippets(_snippets(t)))))


_SCHEDULED = "CASE id % 4 WHEN 0 THEN created_at + INTERVAL '400' DAY WHEN 1 THEN created_at END"


@query(f"WITH q AS (SELECT *, {_SCHEDULED} AS scheduled_for FROM task_queue) SELECT t.id, t.priority FROM q t LEFT JOIN q p ON t.depends_on_task_id = p.id WHERE t.status = 'pending' AND (t.scheduled_for IS NULL OR t.scheduled_for <= TIMESTAMP '1997-01-01') AND (p.id IS NULL OR p.status = 'completed' OR (p.status = 'failed' AND ((p.task_type = 'search_keyword' AND t.task_type IN ('crawl_domain', 'extract_contacts')) OR (p.task_type = 'crawl_domain' AND t.task_type = 'extract_contacts')))) ORDER BY t.priority DESC, t.created_at, t.id LIMIT 20", "task_queue")
def t10_due_tasks(spark, sf_dir):  # noqa: ANN001, ANN201
    """The next tasks of those that are due."""
    rows = _Tables(spark, sf_dir).task_queue.withColumn("scheduled_for", F.expr(_SCHEDULED))
    return tasks.next_tasks(rows, 20, "1997-01-01 00:00:00").select("id", "priority")


@query("SELECT keyword_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY id) AS n FROM task_queue WHERE status IN ('pending', 'running')) WHERE n <= 20", "task_queue")
def a22_open_tasks(spark, sf_dir):  # noqa: ANN001, ANN201
    """The first twenty open tasks of each keyword."""
    rows = _Tables(spark, sf_dir).task_queue.where(F.col("status").isin("pending", "running"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("keyword_id").orderBy("id"))).where("_n <= 20").select("keyword_id", "id", "status")


@query("SELECT id, keyword, false AS is_processed FROM keywords k WHERE is_processed AND NOT EXISTS (SELECT 1 FROM crawl_logs l WHERE l.id = k.id AND l.crawled_at >= TIMESTAMP '2024-01-15')", "keywords", "crawl_logs")
def k16_keyword_reset(spark, sf_dir):  # noqa: ANN001, ANN201
    """Processed keywords without a recent log, to be processed again."""
    t = _Tables(spark, sf_dir)
    recent = t.crawl_logs.where("crawled_at >= TIMESTAMP '2024-01-15'").select("id")
    return tasks.reset_keywords(t.keywords.join(recent, "id", "left_anti"))
