"""Operators on search results, pages and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquarry import fixed_values as V
from webquarry.functions import contacts as C
from webquarry.functions import urls as U


def crawl_targets(results: DataFrame, hosts: tuple[str, ...] = V.BLOCKED_HOSTS) -> DataFrame:
    """The best URL of each host: (host, url, score, first_seq) of results (seq, url).

    Candidates are the URL and, for articles, its root; the highest score wins, the earlier of
    equals. ``ranked`` sorts the hosts.
    """
    both = F.array(F.struct(F.lit(0).alias("cand"), F.trim("url").alias("u")), F.struct(F.lit(1).alias("cand"), U.root(F.trim("url")).alias("u")))
    rows = results.where(F.trim("url") != "").select("seq", "url", F.explode(both).alias("c")).select("seq", "c.cand", F.col("c.u").alias("u"), U.needs_root(F.trim("url")).alias("fallback"))
    # The path is computed once, as the score reads it for each of its marks.
    rows = rows.where("cand = 0 OR fallback").select("*", U.host(F.col("u")).alias("host"), F.lower(U.path(F.col("u"))).alias("p"))
    rows = rows.select("*", U.path_score(F.col("p")).alias("score"))
    rows = rows.where(~U.is_blocked(F.col("u"), hosts) & (F.col("score") > -1000))
    best = rows.groupBy("host").agg(F.max(F.struct("score", (-F.col("seq")).alias("s"), (-F.col("cand")).alias("k"), "u")).alias("b"), F.min("seq").alias("first_seq"))
    return best.select("host", F.col("b.u").alias("url"), F.col("b.score").alias("score"), "first_seq")


def ranked(targets: DataFrame) -> DataFrame:
    """Crawl targets sorted by score, those of hosts that were accepted earlier before equals."""
    return targets.orderBy(F.desc("score"), "first_seq")


def not_blocked(rows: DataFrame, url: str, listed: DataFrame) -> DataFrame:
    """Rows whose host is no subdomain of a listed host: an equi-join of the host's suffixes with ``listed`` (host)."""
    keyed = rows.withColumn("_host", U.host(F.col(url)))
    hosts = keyed.select("_host").distinct().select("_host", F.explode(U.host_suffixes(F.col("_host"))).alias("host"))
    bad = hosts.join(listed.select("host"), "host", "left_semi").select("_host").distinct()
    return keyed.where("_host <> ''").join(bad, "_host", "left_anti").drop("_host")


def page_contacts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the text of the HTML and the contacts of text, HTML and linked data as ``info``.

    Patterns take far longer than reading, and a file of pages may be one row group, which one task
    reads; so the pages are dealt by a hash of the row, to a number of tasks that Spark chooses by their size.
    """
    texts = pages.repartition(F.xxhash64(*pages.columns)).withColumn("content", C.html_text(F.col(html))).withColumn("_linked", C.linked_contacts(F.col(html)))
    found = texts.withColumn("info", C.contact_info(F.col("content"), F.col(html)))
    return found.withColumn("info", C.with_linked(F.col("info"), F.col("_linked"))).drop("_linked")


def linked_data_contacts(pages: DataFrame) -> DataFrame:
    """(page_id, contact_type, value) of linked-data scripts, normalised, each once; only pages with one reach Python."""
    rows = pages.where(C.has_linked_data(F.col("html"))).select("page_id", F.explode(C.linked_contacts(F.col("html"))).alias("c"))
    return normal_contacts(rows.select("page_id", "c.contact_type", "c.value"))


def normal_contacts(rows: DataFrame) -> DataFrame:
    """Contacts (contact_type, value and others) as they are stored, each once, without those that aren't."""
    kind, value = F.col("contact_type"), F.col("value")
    normal = F.when(kind == "email", C.normal_email(value)).when(kind == "telegram", U.telegram_url(value)).otherwise(U.contact_url(value))
    kept = rows.where((kind != "email") | C.is_business_email(value)).withColumn("value", normal)
    return kept.where("value <> ''").distinct()


def host_contacts(pages: DataFrame) -> DataFrame:
    """Contacts per host over all its pages (url, html): lists, sorted and each once, and the confidence.

    ``social`` lists the links of all other platforms.
    """
    rows = page_contacts(pages).select(U.host(F.col("url")).alias("host"), U.is_contact_page(F.col("url")).cast("long").alias("contact_page"), "info")
    kinds = ("emails", "telegram", "linkedin", "phones", "social")

    # One row a contact and one a page: partial aggregation keeps each contact once before the shuffle.
    def typed(kind: str):  # noqa: ANN202
        values = F.flatten(F.map_values("info.social")) if kind == "social" else F.col(f"info.{kind}")
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    page = F.array(F.struct(F.lit("page").alias("kind"), F.lit(None).cast("string").alias("value")))
    each = rows.select("host", "contact_page", F.explode(F.concat(page, *map(typed, kinds))).alias("c"))
    first = F.col("c.kind") == "page"
    counts = [F.count_if(first).alias("pages"), F.sum(F.when(first, F.col("contact_page")).otherwise(0)).alias("contact_pages")]
    lists = [F.array_sort(F.collect_set(F.when(F.col("c.kind") == k, F.col("c.value")))).alias(k) for k in kinds]
    found = each.groupBy("host").agg(*counts, *lists)
    return found.withColumn("confidence", C.confidence(*[F.size(k) for k in kinds[:4]]))


def early_stop(items: DataFrame, host: str, order: str, hit: str, most: int) -> DataFrame:
    """Per host, pages in order up to the first hit, ``most`` at most.

    Pages are ranked first: a limit by rank leaves few rows of each host in every task.
    """
    w = Window.partitionBy(host).orderBy(order)
    first = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    before = F.coalesce(F.max(F.col(hit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("_hit", before).where("_hit = 0").drop("_n", "_hit")


def payload(pages: DataFrame, host: str, order: str) -> DataFrame:
    """The first pages (order, host, html) of each host, texts and HTML cut to the sizes that the queue carries.

    Pages are ranked without their HTML, which is joined to the few that stay.
    """
    rank = F.row_number().over(Window.partitionBy(host).orderBy(order))
    first = pages.select(order, host).withColumn("_n", rank).where(F.col("_n") <= V.PAYLOAD_PAGES).select(order)
    rows = pages.join(first, order, "left_semi")
    return rows.withColumn("content", F.substring(C.html_text(F.col("html")), 1, V.PAYLOAD_TEXT)).withColumn("html", F.substring("html", 1, V.PAYLOAD_HTML))


def frontier(bases: DataFrame, sitemap: DataFrame | None = None, keep_order: bool = False) -> DataFrame:
    """URLs to visit for each base URL (base): contact paths, sitemap pages (base, loc), the base and some more, each once at its first priority.

    ``keep_order``: with ``seq``, their place in the list.
    """
    base = U.root(F.col("base"))
    known = [(p, 10) for p in V.PRIMARY_PATHS] + [(p, 7) for p in V.CONTACT_PATHS]
    late = [("/", 7)] + [(p, 5) for p in V.EXTRA_PATHS]
    places = [(p, w, i) for i, (p, w) in enumerate(known)] + [(p, w, len(known) + 1 + i) for i, (p, w) in enumerate(late)]
    listed = F.array(*[F.struct(F.lit(p[1:]).alias("p"), F.lit(w).alias("w"), F.lit(i).alias("i")) for p, w, i in places])
    rows = bases.select("base", F.explode(listed).alias("c")).select("base", F.concat(base, F.col("c.p")).alias("url"), F.col("c.w").alias("priority"), F.col("c.i").alias("seq"))
    if sitemap is not None:
        rows = rows.union(sitemap.where(U.is_contact_page(F.col("loc"))).select("base", F.col("loc").alias("url"), F.lit(9), F.lit(len(known))))
    first = F.row_number().over(Window.partitionBy("base", "url").orderBy("seq"))
    rows = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    return rows if keep_order else rows.drop("seq")


def links(pages: DataFrame) -> DataFrame:
    """Internal links of pages (url, html) worth following: (url, link, priority), of the first fifty anchors, resolved by the page's URL."""
    hrefs = F.filter(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*)["']"""), F.lit(1)), lambda h: h != "")
    link = F.transform(F.slice(hrefs, 1, 50), lambda h: U.joined(F.col("url"), C.decoded_references(F.trim(h))))
    rows = pages.select("url", U.location(F.col("url")).alias("own"), F.explode(F.array_distinct(link)).alias("link"))
    rows = rows.where(U.is_internal_link(F.col("link"), F.col("own"))).select("url", "link", U.link_priority(F.col("link")).alias("priority"))
    return rows.where("priority >= 3").distinct()


def contact_paths(pages: DataFrame, host: str, order: str) -> DataFrame:
    """(host, paths): the paths of each host's first five contact pages (url), in order."""
    rows = pages.where(U.is_contact_page(F.col("url"))).select(host, order, U.path(F.col("url")).alias("path"))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(host).orderBy(order))).where("_n <= 5")
    return ranked.groupBy(host).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "path"))), lambda x: x["path"]).alias("paths"))


def listed_pages(pages: DataFrame, paths: DataFrame, host: str) -> DataFrame:
    """The pages that a visit of contact pages only reads: those of the listed paths (host, paths)."""
    wanted = paths.select(host, F.explode("paths").alias("_path")).distinct()
    return pages.withColumn("_path", U.path(F.col("url"))).join(wanted, [host, "_path"], "left_semi").drop("_path")


def usable_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages (status, html) with their text: no error status, no short HTML, no short text."""
    rows = pages.where(F.col("status") < V.ERROR_STATUS).withColumn("html", F.trim("html")).where(F.length("html") >= V.MIN_HTML)
    return rows.withColumn("content", C.html_text(F.col("html"))).where(F.length("content") >= V.MIN_TEXT)


def snippet_items(rows: DataFrame) -> DataFrame:
    """Items for extraction of search results (url, blob): text only, of the highest priority."""
    url = F.when(F.coalesce("url", F.lit("")) == "", F.lit("serp://snippet")).otherwise(F.col("url"))
    return rows.withColumn("item", F.struct(url.alias("url"), F.col("blob").alias("content"), F.lit("").alias("html"), F.lit("serp_snippet").alias("type"), F.lit(10).alias("priority")))


def _snippet_text() -> Column:
    return F.array_join(F.filter(F.array(F.trim("title"), F.trim("snippet")), lambda x: x != ""), "\n")


def _has_contacts(blob: Column) -> Column:
    return F.size(C.emails(blob, F.lit(""))) + F.size(C.telegrams(blob, F.lit(""))) > 0


def has_snippet_contacts() -> Column:
    """Whether the text of a search result (title, snippet) has a contact."""
    return F.coalesce(_has_contacts(_snippet_text()), F.lit(False))


def best_snippets(rows: DataFrame) -> DataFrame:
    """Search results (host, seq, title, snippet) whose text has a contact: the first of each host."""
    hits = rows.withColumn("blob", _snippet_text()).where(_has_contacts(F.col("blob")))
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("host").orderBy("seq"))).where("_n = 1").drop("_n")
