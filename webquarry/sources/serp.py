"""Readers of search-engine answers, robots rules, sitemaps and lists, from columns of text."""

from __future__ import annotations

import base64
import xml.etree.ElementTree as ET
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry import fixed_values as V

# Search types by country and localisations by language.
SEARCH_TYPES = {"RU": "SEARCH_TYPE_RU", "KZ": "SEARCH_TYPE_KK", "UZ": "SEARCH_TYPE_UZ", "BY": "SEARCH_TYPE_BE", "TR": "SEARCH_TYPE_TR", "US": "SEARCH_TYPE_COM", "GB": "SEARCH_TYPE_COM", "DE": "SEARCH_TYPE_COM"}
LOCALISATIONS = {"ru": "LOCALIZATION_RU", "uk": "LOCALIZATION_UK", "be": "LOCALIZATION_BE", "kk": "LOCALIZATION_KK", "tr": "LOCALIZATION_TR", "en": "LOCALIZATION_EN"}
# Regions of list answers by country, and bounds of a search request.
REGIONS = {"RU": "ru-ru", "KZ": "kz-en", "UZ": "uz-en", "KG": "kg-en", "AZ": "az-en", "BY": "by-en", "UA": "ua-uk", "GE": "ge-en", "US": "us-en", "GB": "uk-en", "DE": "de-de", "FR": "fr-fr"}
MOST_RESULTS, QUERY_CHARS, MOST_PASSAGES = 20, 400, 3
# The first object or list in a model's reply.
REPLY_OBJECT = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
REPLY_LIST = r"\[[^\]]*\]"


def json_results(answers: DataFrame, column: str, most: int = 10) -> DataFrame:
    """Organic results of JSON answers: key columns, url, title, snippet, position from 1."""
    kind = "struct<organic_results: array<struct<link: string, title: string, snippet: string>>>"
    rows = answers.withColumn("_r", F.slice(F.from_json(column, kind)["organic_results"], 1, most))
    keys = [c for c in answers.columns if c != column]
    return rows.select(*keys, F.posexplode("_r").alias("_p", "r")).select(*keys, F.col("r.link").alias("url"), F.col("r.title").alias("title"), F.col("r.snippet").alias("snippet"), (F.col("_p") + 1).alias("position"))


def list_results(answers: DataFrame, column: str, most: int = 10) -> DataFrame:
    """Results of JSON lists of href, title and body."""
    rows = answers.withColumn("_r", F.slice(F.from_json(column, "array<struct<href: string, title: string, body: string>>"), 1, most))
    keys = [c for c in answers.columns if c != column]
    return rows.select(*keys, F.posexplode("_r").alias("_p", "r")).select(*keys, F.col("r.href").alias("url"), F.col("r.title").alias("title"), F.col("r.body").alias("snippet"), (F.col("_p") + 1).alias("position"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _tree(text: str | None) -> ET.Element | None:
    """The root of an XML answer, plain or base64; None if it can't be read."""
    text = (text or "").strip()
    if text and not text.startswith("<"):
        try:
            text = base64.b64decode(text).decode("utf-8")
        except ValueError:
            return None
    # No answer declares entities; one that does could grow without bound.
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        return None
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return None


def _documents(tree: ET.Element, most: int) -> list[dict]:
    rows: list[dict] = []
    for doc in (e for e in tree.iter() if _local(e.tag) == "doc"):
        found = {name: next(((e.text or "").strip() for e in doc if _local(e.tag) == name and e.text), "") for name in ("url", "title", "headline")}
        passages = [e.text.strip() for part in doc if _local(part.tag) in ("passage", "passages") for e in part.iter() if _local(e.tag) == "passage" and e.text]
        snippet = " ".join(passages[:3]).strip()
        if found["url"] and len(rows) < most:
            rows.append({"url": found["url"], "title": found["title"] or found["headline"], "snippet": snippet if len(snippet) <= 500 else snippet[:500] + "…", "position": len(rows) + 1})
    return rows


def xml_documents(text: str | None, most: int = 10) -> list[dict] | None:
    """url, title, snippet and position of the documents of one XML answer, plain or base64; None if it can't be read."""
    tree = _tree(text)
    return None if tree is None else _documents(tree, most)


def xml_rows(text: str | None, most: int = 10) -> list[dict]:
    """The same; [] if it can't be read."""
    return xml_documents(text, most) or []


def xml_results(answers: DataFrame, column: str, most: int = 10) -> DataFrame:
    """Documents of XML answers, whatever their namespace; unreadable answers have none."""

    @F.pandas_udf("array<struct<url: string, title: string, snippet: string, position: int>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: xml_rows(t, most))

    keys = [c for c in answers.columns if c != column]
    return answers.select(*keys, F.explode(parse(column)).alias("r")).select(*keys, "r.url", "r.title", "r.snippet", "r.position")


def answer_error(answer: Column) -> Column:
    """Why a JSON answer has no results: the message of its error where it carries no data; null if it carries some."""
    kind = "struct<rawData: string, raw_data: string, error: struct<message: string>>"
    found = F.from_json(answer, kind)
    raw = F.coalesce(F.nullif(found["rawData"], F.lit("")), F.nullif(found["raw_data"], F.lit("")))
    error = F.coalesce(found["error"]["message"], F.get_json_object(answer, "$.error"))
    unread = F.when(F.try_parse_json(answer).isNull(), "unreadable answer")
    return F.when(raw.isNull(), F.coalesce(unread, F.when(F.get_json_object(answer, "$.error").startswith("{"), error)))


def search_request(keyword: Column, country: Column, language: Column, wanted: Column) -> Column:
    """The bounded values of a search request: query text, search type, localisation, results and passages."""
    n = F.greatest(F.lit(1), F.least(wanted, F.lit(MOST_RESULTS))).cast("int")
    return F.struct(F.substring(keyword, 1, QUERY_CHARS).alias("query"), search_type(country).alias("search_type"), localisation(language).alias("l10n"), n.alias("results"), F.least(F.lit(MOST_PASSAGES), n).alias("passages"))


def robots_rules(text: Column) -> Column:
    """Allow and disallow paths, in lower case, and the last readable delay of a robots text; empty paths don't count."""
    lines = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def values(name: str) -> Column:
        own = F.filter(lines, lambda x: x.startswith(name + ":"))
        return F.transform(own, lambda x: F.regexp_replace(x, rf"^{name}:\s*", ""))

    def paths(name: str) -> Column:
        return F.filter(values(name), lambda x: x != "").alias(name)

    delays = F.filter(F.transform(values("crawl-delay"), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.struct(paths("allow"), paths("disallow"), F.try_element_at(delays, F.lit(-1)).alias("crawl_delay"))


def is_allowed(path: Column, disallow: Column) -> Column:
    """Whether no rule matches the start of the path; * stands for anything, empty rules match nothing."""
    return ~F.coalesce(F.exists(F.filter(disallow, lambda r: r != ""), lambda r: F.regexp_like(path, F.concat(F.lit("^"), F.replace(r, F.lit("*"), F.lit(".*"))))), F.lit(False))


def sitemap_urls(xml: Column) -> Column:
    """The first hundred locations of a sitemap that aren't media files."""
    found = F.regexp_extract_all(xml, F.lit("<loc>(.*?)</loc>"), F.lit(1))
    return F.slice(F.filter(found, lambda u: ~reduce(or_, [u.endswith(e) for e in V.SITEMAP_SKIPPED])), 1, 100)


def region(country: Column) -> Column:
    """Region of list answers for a country, the Russian one by default."""
    known = F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair])
    return F.coalesce(F.element_at(known, country), F.lit("ru-ru"))


def search_type(country: Column) -> Column:
    """Search type of a country, the Russian one by default."""
    known = F.create_map(*[F.lit(x) for pair in SEARCH_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.upper(country)), F.lit("SEARCH_TYPE_RU"))


def localisation(language: Column) -> Column:
    """Localisation of a language, the Russian one by default."""
    known = F.create_map(*[F.lit(x) for pair in LOCALISATIONS.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(language)), F.lit("LOCALIZATION_RU"))


def new_keywords(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Keywords of forms (form_id, text), one a line: cleaned, cut to 500, each once at its first place, known ones left out."""
    rows = lines.select("form_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    rows = rows.select("form_id", "pos", F.substring(F.trim(F.translate("line", "<>\"'", "")), 1, 500).alias("keyword")).where("keyword <> ''")
    first = rows.groupBy("keyword").agg(F.min(F.struct("form_id", "pos")).alias("at"))
    return first.join(known.select("keyword"), "keyword", "left_anti").select("keyword", F.col("at.form_id").alias("form_id"), F.col("at.pos").alias("pos"))


def single_forms(forms: DataFrame, known: DataFrame) -> DataFrame:
    """(form_id, keyword, outcome) of single forms (form_id, text): added, exists, empty or too_long.

    A keyword exists if it is stored or an earlier form has added it.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = forms.select("form_id", text.alias("text"), F.trim(F.translate(text, "<>\"'", "")).alias("keyword"))
    bad = F.when(F.col("text") == "", "empty").when(F.length("text") > 500, "too_long")
    rows = rows.select("form_id", F.when(bad.isNull(), F.col("keyword")).alias("keyword"), bad.alias("bad"))
    first = rows.where("bad IS NULL").groupBy("keyword").agg(F.min("form_id").alias("first_form"))
    stored = known.select("keyword", F.lit(True).alias("stored")).distinct()
    rows = rows.join(first, "keyword", "left").join(stored, "keyword", "left")
    added = F.when(F.col("stored").isNull() & (F.col("form_id") == F.col("first_form")), "added").otherwise("exists")
    return rows.select("form_id", "keyword", F.coalesce("bad", added).alias("outcome"))


def _in_reply(reply: Column, pattern: str) -> Column:
    """The reply itself if it is JSON, else what the pattern finds in it."""
    return F.when(F.try_parse_json(reply).isNotNull(), F.trim(reply)).otherwise(F.regexp_extract(reply, "(?s)" + pattern, 0))


def llm_contacts(reply: Column) -> Column:
    """Lists of e-mails, telegram and linkedin of a model's reply: the JSON, else the first object in it, else empty lists."""
    kind = "struct<emails: array<string>, telegram: array<string>, linkedin: array<string>>"
    found = _in_reply(reply, REPLY_OBJECT)
    parsed = F.from_json(F.when(found.startswith("{"), found), kind)
    none = F.array().cast("array<string>")
    return F.struct(*[F.coalesce(parsed[k], none).alias(k) for k in ("emails", "telegram", "linkedin")])


def llm_categories(reply: Column) -> Column:
    """The first three categories of a model's reply: the JSON list, else the first list in it, else none."""
    found = _in_reply(reply, REPLY_LIST)
    return F.slice(F.coalesce(F.from_json(F.when(found.startswith("["), found), "array<string>"), F.array().cast("array<string>")), 1, 3)


def env_hosts(text: Column, name: str = "SERP_BLOCKED_HOST_SUFFIXES") -> Column:
    """The hosts of a setting in a text of settings: a JSON list or names between commas."""
    raw = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(text, rf"(?m)^{name}=(.*)$", 1)), '^"+|"+$', ""), "^'+|'+$", "")
    plain = F.filter(F.transform(F.split(raw, ","), lambda h: F.trim(h)), lambda h: h != "")
    listed = F.when(raw.startswith("[") & F.try_parse_json(raw).isNotNull(), F.from_json(raw, "array<string>"))
    return F.coalesce(listed, plain, F.array().cast("array<string>"))


def unpacked(payload: Column) -> Column:
    """The pages of a task's payload; what is no list has none."""
    kind = "array<struct<url: string, content: string, html: string, type: string, priority: int>>"
    pages = F.from_json(F.when(F.trim(payload).startswith("["), payload), kind)
    return F.coalesce(pages, F.array().cast(kind))
