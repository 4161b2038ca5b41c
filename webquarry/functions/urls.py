"""URL functions on columns. All are null-safe: a null or unusable URL has the host ''."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from webquarry import fixed_values as V

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def _any_part(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(p) for p in parts])


def host(url: Column) -> Column:
    """Network location in lower case without one leading ``www.``; port and user stay."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, _SCHEME + r"([^/?#]*)", 1), F.lit(""))), r"^www\.", "")


def path(url: Column) -> Column:
    """Path without query, fragment and the parameters of its last segment."""
    found = F.coalesce(F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.regexp_replace(found, r";[^/]*$", "")


def root(url: Column) -> Column:
    """``scheme://location/``; '' without a scheme."""
    found = F.coalesce(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1), F.lit(""))
    return F.when(found == "", "").otherwise(F.concat(found, F.lit("/")))


def location(url: Column) -> Column:
    """Network location as written, with ``www.`` and port; '' without a scheme."""
    return F.coalesce(F.regexp_extract(url, _SCHEME + r"([^/?#]*)", 1), F.lit(""))


def _without_dots(segments: Column) -> Column:
    """Path segments without ``.`` and ``..``; what ends in one of them ends in a slash."""
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(s == ".", out).otherwise(F.concat(out, F.array(s))),
    )
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)


def joined(base: Column, link: Column) -> Column:
    """A link resolved by the absolute URL of its page: other schemes as they are, dots taken out of paths."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    top = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    own = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    path_of, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    # All but the last segment of the page's path, then the link's; empty ones inside don't count.
    both = F.concat(F.slice(F.split(own, "/"), 1, F.greatest(F.size(F.split(own, "/")) - 1, F.lit(0))), F.split(path_of, "/"))
    inner = F.slice(both, 1, F.size(both) - 1)
    relative = F.concat(F.filter(inner, lambda s: s != ""), F.array(F.element_at(both, -1)))
    absolute = F.slice(F.split(path_of, "/"), 2, F.size(F.split(path_of, "/")))
    segments = F.when(path_of.startswith("/"), absolute).otherwise(relative)
    resolved = F.concat(top, F.lit("/"), F.array_join(_without_dots(segments), "/"), rest)
    same_page = F.concat(top, own, F.when(link.startswith("?"), link).otherwise(F.concat(query, link)))
    return (
        F.when(F.coalesce(link, F.lit("")) == "", base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(path_of == "", same_page)
        .otherwise(resolved)
    )


def is_blocked(url: Column, hosts: tuple[str, ...] = V.BLOCKED_HOSTS) -> Column:
    """Whether the host is empty, listed, or a subdomain of a listed one."""
    own = host(url)
    return reduce(or_, [(own == h) | own.endswith("." + h) for h in hosts], own == "")


def host_suffixes(own: Column) -> Column:
    """All suffixes of a host at its dots, the host first: the keys of an equi-join with listed hosts."""
    labels = F.split(own, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def crawl_score(url: Column) -> Column:
    """How likely a URL leads to contacts; -1000 for files."""
    return path_score(F.lower(path(url)))


def path_score(p: Column) -> Column:
    """The score of a path in lower case."""
    marks = [(V.HIGH_MARKERS, 100), (V.MEDIUM_MARKERS, 60), (V.LOW_MARKERS, -45)]
    score = reduce(add, [F.when(p.contains(m), weight).otherwise(0) for markers, weight in marks for m in markers])
    score = score + F.when(p.rlike("^/*$"), 25).otherwise(0)
    depth = F.size(F.filter(F.split(p, "/"), lambda s: s != ""))
    score = score - F.when((depth >= 4) & (score < 60), 15).otherwise(0)
    skipped = reduce(or_, [p.endswith(e) for e in V.SKIPPED_ENDINGS])
    return F.when(skipped, -1000).otherwise(score).cast("int")


def needs_root(url: Column) -> Column:
    """Whether the path looks like an article, so that the root is a better start."""
    p = F.lower(path(url))
    return (F.length(p) > 1) & _any_part(p, V.ARTICLE_MARKERS)


def link_priority(url: Column) -> Column:
    """1 to 10 by the first group of parts found in the URL."""
    low = F.lower(F.coalesce(url, F.lit("")))
    out = F.lit(1)
    for value, parts in reversed(V.LINK_PRIORITIES):
        out = F.when(_any_part(low, parts), value).otherwise(out)
    return out.cast("int")


def is_contact_page(url: Column) -> Column:
    """Whether any part of the URL looks like a contact page."""
    return _any_part(F.lower(F.coalesce(url, F.lit(""))), V.CONTACT_PAGE_PARTS)


def is_internal_link(url: Column, domain: Column) -> Column:
    """Whether a link stays on the domain and leads to a page."""
    location = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    own = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    own = F.regexp_replace(own, r";[^/]*$", "")
    files = reduce(or_, [own.endswith(e) for e in V.INTERNAL_LINK_ENDINGS])
    return F.coalesce(((location == "") | (location == domain)) & (F.length(own) > 1) & ~files, F.lit(False))


def contact_url(url: Column) -> Column:
    """A contact's URL with a scheme and without fragment and tracking parameters."""
    u = F.trim(F.coalesce(url, F.lit("")))
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.rlike(r"(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), F.regexp_replace(u, "^/+", "")))
    u = F.regexp_replace(u, "#.*$", "")
    u = F.regexp_replace(u, r"(?i)(\?|&)(utm_[^=&]+|fbclid|gclid)=[^&]*", "")
    u = F.regexp_replace(F.replace(u, F.lit("?&"), F.lit("?")), "[?&]+$", "")
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "").otherwise(u)


def telegram_url(url: Column) -> Column:
    """A contact's URL with the short Telegram host."""
    return F.replace(contact_url(url), F.lit("telegram.me/"), F.lit("t.me/"))


def search_query(keyword: Column, language: Column, country: Column) -> Column:
    """The keyword with a hint that contacts are wanted, by language and country."""
    kw = F.trim(F.coalesce(keyword, F.lit("")))
    hint = F.when((language == "de") | (country == "DE"), " kontakt impressum").when((language == "en") | country.isin("US", "GB"), " contact email").otherwise(" контакты email")
    return F.when(kw == "", "").otherwise(F.concat(kw, hint))


def crawl_delay(delay: Column) -> Column:
    """Seconds between requests: at least 0.1, else 0.5 if none is told."""
    return F.when(delay.isNull(), F.lit(0.5)).otherwise(F.greatest(delay, F.lit(0.1)))
