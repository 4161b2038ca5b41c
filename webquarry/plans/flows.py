"""Queries of operators that keep a state, walk a graph or run to a fixpoint, registered beside those of the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry import fixed_values as V
from webquarry.functions import contacts as C
from webquarry.functions import tables
from webquarry.functions import urls as U
from webquarry.lineage import shared_folder
from webquarry.operators import crawl, linked, linkgraph, progress, runs, search_index
from webquarry.plans.catalog import _ALL, _FLAT, _FOUND, _LINKED, _any, _flat, _host, _rich, _Tables, query
from webquarry.sources import answers, paired, serp
from webquarry.streaming import choices, leases

# Links

_NAMES = ("contact", "about", "team", "services", "blog")


def _site(s: str, k: str) -> str:
    """The address of page k of a site s, on both engines."""
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES))
    return f"concat('https://s', CAST({s} AS STRING), '.example.com/', CASE {k} % 5 {names} END, '/', CAST({k} AS STRING))"


#: Ten sites: page k links to 2k+1 and 2k+2, back to k-1 and to itself, to a file, the root and another host. Some begin with fifty foreign anchors.
_ANCHORS = "".join(f"""'<a href="', {a}, '">x</a>', """ for a in (_site("s", "(2 * k + 1)"), _site("s", "(2 * k + 2)"), _site("s", "abs(k - 1)"), _site("s", "k")))
_GRAPH = f"SELECT s, k, {_site('s', 'k')} AS url, concat(CASE WHEN k % 11 = 5 THEN repeat('<a href=\"https://far.example/contact\">f</a>', 50) ELSE '' END, {_ANCHORS} '<a href=\"/\">r</a><a href=\"/files/contact.pdf\">p</a><a href=\"//other.example/team/1\">o</a>') AS html FROM (SELECT page_id % 10 AS s, CAST(floor(page_id / 10) AS BIGINT) AS k FROM {{pages}})"


@query(
    f"""WITH RECURSIVE p AS (SELECT page_id % 10 AS s, page_id // 10 AS k FROM pages),
e AS (SELECT DISTINCT s, k, t FROM (SELECT s, k, unnest([2 * k + 1, 2 * k + 2, abs(k - 1), k]) AS t FROM p WHERE k % 11 <> 5) WHERE t % 5 <> 4),
seeds AS (SELECT s, k FROM p WHERE k IN (0, 2, 4)),
r AS (SELECT s, k, 0 AS depth FROM seeds UNION SELECT e.s, e.t, r.depth + 1 FROM r JOIN e ON e.s = r.s AND e.k = r.k WHERE r.depth < 2),
best AS (SELECT s, k, min(depth) AS depth FROM r GROUP BY s, k),
via AS (SELECT e.s, e.t AS k, min({_site('e.s', 'e.k').replace('STRING', 'VARCHAR')}) AS found_on FROM e JOIN best b ON b.s = e.s AND b.k = e.k JOIN best c ON c.s = e.s AND c.k = e.t AND c.depth = b.depth + 1 GROUP BY e.s, e.t)
SELECT {_site('b.s', 'b.k').replace('STRING', 'VARCHAR')} AS url, b.depth, v.found_on, CAST(CASE b.k % 5 WHEN 0 THEN 10 WHEN 1 THEN 9 WHEN 2 THEN 8 WHEN 3 THEN 4 ELSE 2 END AS INTEGER) AS priority, p.k IS NOT NULL AS stored
FROM best b LEFT JOIN via v ON v.s = b.s AND v.k = b.k LEFT JOIN p ON p.s = b.s AND p.k = b.k"""
)
def u9_link_depths(spark, sf_dir):  # noqa: ANN001, ANN201
    """Addresses within two links of some pages, in graphs with cycles and pages that two depths reach."""
    pages = spark.sql(_GRAPH, pages=_Tables(spark, sf_dir).pages)
    return linkgraph.reachable(pages.unionAll(pages.where("k % 7 = 3")), pages.where("k IN (0, 2, 4)"))


# State

_PROGRESS = """SELECT concat('run', CAST(conv_id % 10 AS STRING)) AS run_id, CAST(conv_id % 25 + 1 AS INT) AS keyword_id, conv_id * 1000 + turn AS seq,
 CASE turn % 4 WHEN 0 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'progress' END AS kind, CAST(length(text) % 7 AS INT) AS websites, CAST(length(text) % 5 AS INT) AS contacts,
 CAST(length(text) % 9 AS INT) AS total, CASE WHEN length(text) % 2 = 0 THEN role END AS error, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * (conv_id * 10 + turn) AS at FROM conversations"""


def _progress(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return spark.sql(_PROGRESS.replace("FROM conversations", "FROM {conversations}"), conversations=_Tables(spark, sf_dir).conversations)


_STATE_SQL = f"""WITH events AS MATERIALIZED ({_PROGRESS.replace(" AS at FROM", " AS moment FROM")}), firsts AS (SELECT run_id, keyword_id, min(seq) AS f FROM events WHERE kind = 'progress' GROUP BY ALL),
after AS (SELECT *, CASE WHEN kind = 'completed' THEN 100 WHEN total > 0 THEN CAST(floor(websites / total * 100) AS INTEGER) ELSE 0 END AS done FROM events JOIN firsts USING (run_id, keyword_id) WHERE seq >= f),
state AS (SELECT run_id, keyword_id, coalesce(arg_max(kind, seq) FILTER (kind <> 'progress'), 'processing') AS status, arg_max(websites, seq) FILTER (kind = 'progress') AS websites_processed,
 arg_max(contacts, seq) FILTER (kind <> 'failed') AS contacts_found, arg_max(done, seq) FILTER (kind <> 'failed') AS progress_percent, arg_max_null(error, seq) FILTER (kind = 'failed') AS error_message, max(moment) FILTER (seq > f) AS updated_at FROM after GROUP BY ALL)"""


@query(f"{_STATE_SQL} SELECT * FROM state")
def t12_progress_upserts(spark, sf_dir):  # noqa: ANN001, ANN201
    """Progress rows after events in two batches, the second on top of the first."""
    events = _progress(spark, sf_dir)
    first = progress.applied(spark.createDataFrame([], progress.STATE), events.where("seq < 30000"))
    return progress.applied(first, events.where("seq >= 30000"))


@query(f"{_STATE_SQL} SELECT run_id, count(*) AS total_keywords, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'processing') AS processing, CAST(sum(contacts_found) AS BIGINT) AS total_contacts, CAST(sum(websites_processed) AS BIGINT) AS total_websites, CAST(floor(count(*) FILTER (status = 'completed') / count(*) * 100) AS INTEGER) AS overall_progress FROM state GROUP BY run_id")
def t12_run_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    """Counts of the progress rows of every run."""
    return progress.summary(progress.applied(spark.createDataFrame([], progress.STATE), _progress(spark, sf_dir)))


@query(f"WITH {_FOUND}, d AS (SELECT page_id, 1000 + row_number() OVER (ORDER BY page_id) AS id FROM (SELECT DISTINCT page_id FROM found WHERE kind <> 'phones')), c AS (SELECT d.id AS domain_contact_id, CASE kind WHEN 'emails' THEN 'email' ELSE kind END AS contact_type, value FROM found JOIN d USING (page_id) WHERE kind <> 'phones') SELECT CAST(5000 + row_number() OVER (ORDER BY domain_contact_id, contact_type, value) AS BIGINT) AS id, domain_contact_id, contact_type, value FROM c")
def k6_numbered_contacts(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contact rows with new ids in both tables, behind those that are there."""
    rows = crawl.page_contacts(_rich(_Tables(spark, sf_dir)))
    found = rows.select(F.col("page_id").alias("search_result_id"), F.lit("d").alias("domain"), F.array(F.lit("t")).alias("tags"), F.lit(1).alias("confidence_score"), F.lit("regex").alias("extraction_method"), "info")
    return paired.contact_tables(found, {"domain_contacts": 1000, "contacts": 5000})["contacts"]


_LEASE_SECONDS = 6 * 3600
_EVENTS = "SELECT user_id AS id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS status, ts AS moment FROM events"


@query(
    f"""WITH e AS ({_EVENTS}), m AS (SELECT id, moment, bool_and(status = 'running') AS running FROM e GROUP BY id, moment),
n AS (SELECT *, lead(moment) OVER (PARTITION BY id ORDER BY moment) AS later FROM m)
SELECT id, 'pending' AS status, CAST(moment AS TIMESTAMP) AS was_locked_at FROM n WHERE running AND (later IS NULL OR later > moment + INTERVAL {_LEASE_SECONDS} SECOND) AND moment + INTERVAL {_LEASE_SECONDS} SECOND < TIMESTAMP '2024-01-25 00:00:00'"""
)
def t5_released_locks(spark, sf_dir):  # noqa: ANN001, ANN201
    """Every lock that was released for being stale."""
    events = _Tables(spark, sf_dir).events.select(F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("running").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    return leases.released_until(events, "2024-01-25 00:00:00", _LEASE_SECONDS)


# Runs

_FAILS = "id % 5"
_SETTLED_SQL = f"""WITH RECURSIVE live AS (SELECT * FROM task_queue WHERE status IN ('pending', 'running')),
rounds AS (
  SELECT o.id, 1 AS round FROM live o LEFT JOIN live p ON p.id = o.depends_on_task_id WHERE p.id IS NULL
  UNION ALL SELECT o.id, r.round + 1 FROM live o JOIN rounds r ON r.id = o.depends_on_task_id),
ended AS (SELECT o.*, r.round, greatest(max_retries - retry_count, 1) AS tries FROM live o JOIN rounds r USING (id)),
settled AS (SELECT id, keyword_id, CASE WHEN {_FAILS} < tries THEN 'completed' ELSE 'failed' END AS status, CAST(retry_count + least({_FAILS}, tries) AS INTEGER) AS retry_count, CAST(round AS INTEGER) AS round FROM ended
  UNION ALL SELECT id, keyword_id, status, retry_count, 0 FROM task_queue WHERE status NOT IN ('pending', 'running'))"""


def _settled(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    queue = _Tables(spark, sf_dir).task_queue
    return runs.settled(queue, queue.select("id", F.expr(_FAILS).alias("failures")))


@query(f"SELECT * FROM ({_SETTLED_SQL} SELECT id, status, retry_count, round FROM settled)", "task_queue")
def t3_settled_tasks(spark, sf_dir):  # noqa: ANN001, ANN201
    """All tasks at the end of a run, with the round in which each settled."""
    return _settled(spark, sf_dir).select("id", "status", "retry_count", "round")


@query(f"SELECT * FROM ({_SETTLED_SQL} SELECT keyword_id, count(*) AS tasks, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS still_open, max(round) AS last_round, count(*) FILTER (status = 'pending') = 0 AS is_processed FROM settled WHERE keyword_id IS NOT NULL GROUP BY keyword_id)", "task_queue")
def t6_keywords_after(spark, sf_dir):  # noqa: ANN001, ANN201
    """Keywords at the end of a run."""
    return runs.keywords_after(_settled(spark, sf_dir))


@query(
    f"""WITH searches AS (SELECT id AS keyword_id, 'search_' || id AS id, id % 4 AS fails FROM keywords WHERE NOT is_processed ORDER BY created_at, id LIMIT {V.KEYWORDS_A_RUN}),
found AS (SELECT r.id AS r, s.keyword_id, s.id AS parent, r.id % 3 = 0 AS snippet FROM search_results r JOIN searches s USING (keyword_id) WHERE s.fails < 3),
crawls AS (SELECT r, keyword_id, 'crawl_' || r AS id, parent, r % 4 AS fails FROM found WHERE NOT snippet),
extracts AS (SELECT r, keyword_id, 'extract_snippet_' || r AS id, parent, 8 AS priority, 2 AS round, r % 2 AS fails FROM found WHERE snippet
  UNION ALL SELECT r, keyword_id, 'extract_' || r, id, 7, 3, r % 2 FROM crawls WHERE fails < 2)
SELECT id, 'search_keyword' AS task_type, 10 AS priority, CAST(keyword_id AS INTEGER) AS keyword_id, CAST(NULL AS VARCHAR) AS depends_on_task_id, CASE WHEN fails < 3 THEN 'completed' ELSE 'failed' END AS status, CAST(least(fails, 3) AS INTEGER) AS retry_count, 1 AS round FROM searches
UNION ALL SELECT id, 'crawl_domain', 5, keyword_id, parent, CASE WHEN fails < 2 THEN 'completed' ELSE 'failed' END, CAST(least(fails, 2) AS INTEGER), 2 FROM crawls
UNION ALL SELECT id, 'extract_contacts', priority, keyword_id, parent, CASE WHEN fails < 1 THEN 'completed' ELSE 'failed' END, CAST(fails AS INTEGER), round FROM extracts""",
    "keywords",
    "search_results",
)
def t11_whole_run(spark, sf_dir):  # noqa: ANN001, ANN201
    """A run from the open keywords to the last extraction, with failing tasks of all types."""
    t = _Tables(spark, sf_dir)
    results = t.search_results.select("id", "keyword_id", F.expr("id % 3 = 0").alias("snippet_only"))
    named = lambda name, fails: F.struct(F.concat(F.lit(name), F.col("id").cast("string")).alias("id"), F.expr(fails).alias("failures"))
    each = results.select(F.explode(F.array(named("crawl_", "id % 4"), named("extract_", "id % 2"), named("extract_snippet_", "id % 2"))).alias("f")).select("f.*")
    failures = each.union(t.keywords.select(named("search_", "id % 4").alias("f")).select("f.*"))
    return runs.whole_run(t.keywords, results, failures).select("id", "task_type", "priority", "keyword_id", "depends_on_task_id", "status", "retry_count", "round")


# Sources and table functions


@query(
    f"""WITH {_FOUND}, ranked AS (SELECT page_id, {_host('url')} AS host, CASE WHEN {_any("lower(url)", V.CONTACT_PAGE_PARTS)} AND page_id IN (SELECT page_id FROM found WHERE kind <> 'phones') THEN 1 ELSE 0 END AS hit FROM pages),
w AS (SELECT *, row_number() OVER o AS n, coalesce(max(hit) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ranked WINDOW o AS (PARTITION BY host ORDER BY page_id))
SELECT host, page_id, CASE kind WHEN 'emails' THEN 'email' ELSE kind END AS contact_type, value FROM w JOIN found USING (page_id) WHERE b = 0 AND n <= {tables.PAGES} AND kind <> 'phones'"""
)
def w7_contacts_of_hosts(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts of each host's pages up to the first contact page, by the table function."""
    tables.register(spark)
    tables.found(_rich(_Tables(spark, sf_dir))).createOrReplaceTempView("found_pages")
    return spark.sql("SELECT * FROM contacts_of(TABLE(found_pages) PARTITION BY host ORDER BY page_id)")


_CLEAN = "translate(title, '&<>\"\\\\', '')"
#: Answers of twelve forms: lists and objects with results, XML plain and packed, errors, and what can't be read.
_FORMS = f"""CASE id % 12
 WHEN 0 THEN concat('{{"organic_results": [{{"link": "https://a.example/', CAST(id AS STRING), '", "title": "', {_CLEAN}, '", "snippet": "s"}}, {{"link": "https://b.example/", "title": "B"}}]}}')
 WHEN 1 THEN concat('[{{"href": "https://c.example/', CAST(id AS STRING), '", "title": "', {_CLEAN}, '", "body": "b"}}]')
 WHEN 2 THEN concat('<r><doc><url>https://d.example/', CAST(id AS STRING), '</url><title>D</title></doc></r>')
 WHEN 3 THEN concat('{{"rawData": "', CAST(id AS STRING), '"}}')
 WHEN 4 THEN concat('{{"error": {{"message": "no quota ', CAST(id AS STRING), '", "code": 8}}}}')
 WHEN 5 THEN '{{"organic_results": ['
 WHEN 6 THEN '<r><doc>'
 WHEN 7 THEN '  '
 WHEN 8 THEN '{{"other": 1}}'
 WHEN 9 THEN '[]'
 WHEN 10 THEN '{{"error": "plain"}}'
 ELSE NULL END"""


def _answer_files(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    rows = _Tables(spark, sf_dir).search_results
    packed = F.concat(F.lit('{"rawData": "'), F.regexp_replace(F.base64(F.encode(F.concat(F.lit("<x:r xmlns:x='u'><x:doc><x:url>https://e.example/"), F.col("id").cast("string"), F.lit("</x:url></x:doc></x:r>")), "UTF-8")), r"\s", ""), F.lit('"}'))
    text = F.when(F.col("id") % 12 == 3, packed).otherwise(F.expr(_FORMS))
    content = F.when(F.col("id") % 24 == 11, F.unhex(F.lit("FFFE7B"))).otherwise(F.encode(text, "UTF-8"))
    return rows.select(F.col("id").cast("string").alias("path"), content.alias("content"))


@query(
    f"""SELECT CAST(id AS VARCHAR) AS path, CASE id % 12 WHEN 0 THEN 'json' WHEN 1 THEN 'list' ELSE 'xml' END AS kind, CASE id % 12 WHEN 0 THEN 'https://a.example/' WHEN 1 THEN 'https://c.example/' WHEN 2 THEN 'https://d.example/' ELSE 'https://e.example/' END || id AS url,
 CASE WHEN id % 12 < 2 THEN {_CLEAN} WHEN id % 12 = 2 THEN 'D' ELSE '' END AS title, CASE id % 12 WHEN 0 THEN 's' WHEN 1 THEN 'b' ELSE '' END AS snippet, 1 AS position FROM search_results WHERE id % 12 < 4
UNION ALL SELECT CAST(id AS VARCHAR), 'json', 'https://b.example/', 'B', NULL, 2 FROM search_results WHERE id % 12 = 0""",
    "search_results",
)
def s7_answers_read(spark, sf_dir):  # noqa: ANN001, ANN201
    """Results of answers in mixed formats."""
    return answers.results(answers.read(_answer_files(spark, sf_dir)))


@query(
    """SELECT CAST(id AS VARCHAR) AS path, CASE id % 12 WHEN 4 THEN 'error: no quota ' || id WHEN 5 THEN 'unreadable JSON' WHEN 6 THEN 'unreadable XML' WHEN 7 THEN 'empty' WHEN 8 THEN 'no known form' WHEN 10 THEN 'error: plain' ELSE CASE WHEN id % 24 = 11 THEN 'no UTF-8' ELSE 'no content' END END AS reason
FROM search_results WHERE id % 12 IN (4, 5, 6, 7, 8, 10, 11)""",
    "search_results",
)
def s11_quarantine(spark, sf_dir):  # noqa: ANN001, ANN201
    """Why answers are kept apart."""
    return answers.quarantined(answers.read(_answer_files(spark, sf_dir))).select("path", "reason")


@query(
    """SELECT page_id, 'telegram' AS contact_type, 'https://t.me/x' AS value FROM pages WHERE page_id % 6 = 0
 UNION ALL SELECT page_id, 'linkedin', 'https://www.linkedin.com/in/q' FROM pages WHERE page_id % 6 = 0
 UNION ALL SELECT page_id, 'telegram', 'https://t.me/telegram' || page_id FROM pages WHERE page_id % 6 = 1
 UNION ALL SELECT page_id, 'email', 'ok@acme.example' FROM pages WHERE page_id % 6 = 2"""
)
def x17_linked_levels(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts in linked-data scripts, walked level by level without Python."""
    pages = _Tables(spark, sf_dir).pages.select("page_id", F.expr(_LINKED).alias("html"))
    return crawl.normal_contacts(linked.linked_contacts(pages))


_SNIPPETS = "CASE WHEN id % 3 = 0 THEN concat('write to a', CAST(id AS STRING), '@acme.example') WHEN id % 3 = 1 THEN 'see t.me/' ELSE 'nothing' END"


@query(
    f"""WITH r AS (SELECT {_host('url')} AS host, id, url, id % 3 = 0 AS hit FROM search_results), n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY hit DESC, -id) AS n FROM r WHERE host <> '')
SELECT host, CASE WHEN hit THEN 'extract' ELSE 'crawl' END AS action, -id AS seq, url FROM n WHERE n = 1""",
    "search_results",
)
def w10_choices(spark, sf_dir):  # noqa: ANN001, ANN201
    """One choice a host: extract from a text with contacts, or crawl."""
    rows = _Tables(spark, sf_dir).search_results
    made = rows.select(U.host(F.col("url")).alias("host"), (-F.col("id")).alias("seq"), "url", F.lit("t").alias("title"), F.expr(_SNIPPETS).alias("snippet"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    return choices.chosen(made)


@query(f"WITH {_FLAT} SELECT contact_id, contact_type, value, domain, keyword FROM flat WHERE value ILIKE '%c1_@ACME%' OR domain ILIKE '%c1_@ACME%' OR keyword ILIKE '%c1_@ACME%' OR value ILIKE '%src1%mple%' OR domain ILIKE '%src1%mple%' OR keyword ILIKE '%src1%mple%'", *_ALL)
def f3_search_by_index(spark, sf_dir):  # noqa: ANN001, ANN201
    """Contacts with either of two texts, found by the lists of their trigrams."""
    index = search_index.SearchIndex(spark, f"{shared_folder(spark)}/search-{uuid.uuid4().hex}", folders=32)
    index.build(_flat(_Tables(spark, sf_dir)).select("contact_id", "contact_type", "value", "domain", "keyword"))
    return index.search("c1_@ACME").union(index.search("src1%mple")).distinct()


# Stored texts, settings and replies made of the tables' own values


@query(
    """WITH c AS (SELECT domain_contact_id AS id, bool_or(contact_type = 'email') AS e, bool_or(contact_type = 'telegram') AS t, bool_or(contact_type = 'linkedin') AS l, bool_or(contact_type IN ('x', 'facebook', 'instagram', 'youtube')) AS s FROM contacts WHERE is_verified GROUP BY 1)
SELECT d.id, coalesce(e OR t OR l OR s, false) AS has_data, coalesce(e OR t, false) AS has_mail, coalesce(s, false) AS has_social, e IS NOT NULL AS stored FROM domain_contacts d LEFT JOIN c USING (id)""",
    "domain_contacts",
    "contacts",
)
def f21_stored_contacts(spark, sf_dir):  # noqa: ANN001, ANN201
    """Whether the stored form of each domain's verified contacts holds anything."""
    t = _Tables(spark, sf_dir)
    of = lambda kind: F.collect_list(F.when(F.col("contact_type") == kind, F.col("value")))
    social = F.create_map(*[x for kind in ("x", "facebook", "instagram", "youtube") for x in (F.lit(kind), of(kind))]).alias("social")
    stored = t.contacts.where("is_verified").groupBy(F.col("domain_contact_id").alias("id")).agg(F.to_json(F.struct(of("email").alias("emails"), of("telegram").alias("telegram"), of("linkedin").alias("linkedin"), of("phone").alias("phones"), social)).alias("j"))
    j = F.col("j")
    rows = t.domain_contacts.select("id").join(stored, "id", "left")
    return rows.select("id", C.stored_has_data(j).alias("has_data"), C.stored_has_data(j, ("emails", "telegram"), social=False).alias("has_mail"), C.stored_has_data(j, (), social=True).alias("has_social"), j.isNotNull().alias("stored"))


@query("SELECT id, url, title AS content, position AS priority FROM search_results", "search_results")
def k13_payload_results(spark, sf_dir):  # noqa: ANN001, ANN201
    """Search results packed as payloads and unpacked again."""
    item = F.struct("url", F.col("title").alias("content"), F.col("position").alias("priority"))
    rows = _Tables(spark, sf_dir).search_results.select("id", F.to_json(F.array(item)).alias("packed"))
    return rows.select("id", F.explode(serp.unpacked(F.col("packed"))).alias("p")).select("id", "p.url", "p.content", "p.priority")


@query(f"SELECT keyword_id, string_agg(host, ' ' ORDER BY host) AS hosts FROM (SELECT DISTINCT keyword_id, {_host('url')} AS host FROM search_results) WHERE host <> '' GROUP BY keyword_id", "search_results")
def s19_hosts_of_settings(spark, sf_dir):  # noqa: ANN001, ANN201
    """The hosts of each keyword's results through a line of settings, as JSON or between commas."""
    rows = _Tables(spark, sf_dir).search_results.select("keyword_id", U.host(F.col("url")).alias("host")).where("host <> ''")
    listed = rows.groupBy("keyword_id").agg(F.array_sort(F.collect_set("host")).alias("h"))
    value = F.when(F.col("keyword_id") % 2 == 0, F.to_json("h")).otherwise(F.array_join("h", " , "))
    env = F.concat(F.lit("A=1\nSERP_BLOCKED_HOST_SUFFIXES="), value, F.lit("\nB=2"))
    return listed.select("keyword_id", F.array_join(serp.env_hosts(env), " ").alias("hosts"))


_TITLE_WORDS = "regexp_extract_all(title, '[A-Za-z]{4,}')"


@query(f"SELECT id, array_to_string(list_slice({_TITLE_WORDS}, 1, 3), '|') AS categories FROM search_results", "search_results")
def x23_categories_of_titles(spark, sf_dir):  # noqa: ANN001, ANN201
    """Categories in replies that list words of the results' titles among other text."""
    words = F.regexp_extract_all("title", F.lit("[A-Za-z]{4,}"), F.lit(0))
    rows = _Tables(spark, sf_dir).search_results.select("id", F.concat(F.lit("The site is about "), F.coalesce(F.translate("title", "[]", ""), F.lit("")), F.lit(": "), F.to_json(F.slice(F.coalesce(words, F.array()), 1, 5)), F.lit(' or ["x"].')).alias("reply"))
    return rows.select("id", F.array_join(serp.llm_categories(F.col("reply")), "|").alias("categories"))
