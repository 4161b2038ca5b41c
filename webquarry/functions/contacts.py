"""Contact extraction from text and HTML with column expressions."""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from webquarry import fixed_values as V
from webquarry.functions import documents as D
from webquarry.functions.urls import contact_url, telegram_url


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    # Letters of all scripts have a case.
    pattern = pattern.replace("(?i)", "(?iu)")
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _character(ref: Column) -> Column:
    """The character of a reference; names that HTML 4 doesn't have stay as they are."""
    number = F.when(ref.rlike("^&#[xX]"), F.conv(F.regexp_extract(ref, "^&#[xX]([0-9A-Fa-f]+)", 1), 16, 10)).when(ref.startswith("&#"), F.regexp_extract(ref, "^&#([0-9]+)", 1)).cast("long")
    wrong = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    code = F.when(wrong, F.lit(0xFFFD)).otherwise(number)
    # One literal, which the optimizer turns into a map.
    names = "\n".join(f"{name}\t{chr(n)}" for name, n in {**name2codepoint, "apos": 39}.items())
    named = F.element_at(F.str_to_map(F.lit(names), F.lit("\n"), F.lit("\t")), F.regexp_extract(ref, "^&([A-Za-z0-9]+);", 1))
    return F.coalesce(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), named, ref)


def decoded_references(text: Column) -> Column:
    """A text with its character references decoded, each once."""

    def decoded(t: Column) -> Column:
        pieces = F.split(t, _REFERENCE, -1)
        found = F.transform(_all(t, _REFERENCE), _character)
        whole = F.array_join(F.zip_with(pieces, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(t.contains("&"), whole).otherwise(t)

    # As a bound variable the text is computed once, however often it is named.
    return F.transform(F.array(text), decoded)[0]


def html_text(html: Column) -> Column:
    """Text of a page: no scripts, styles and tags, references decoded, white space collapsed."""
    out = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    # Also the no-break space that a reference may have left.
    return F.trim(F.regexp_replace(decoded_references(F.regexp_replace(out, r"(?s)<[^>]+>", " ")), r"[\s\x{A0}]+", " "))


def is_business_email(email: Column) -> Column:
    """Whether an address is well-formed, no service mailbox and not at a free provider."""
    low = F.lower(email)
    shape = r"^[a-z0-9_%+-]+(\.[a-z0-9_%+-]+)*@([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"
    well = low.rlike(shape) & (F.length(low) <= 254) & (F.length(F.substring_index(low, "@", 1)) <= 64)
    top = F.substring_index(low, ".", -1)
    return F.coalesce(well & ~top.isin(*V.RESERVED_TOPS) & ~F.substring_index(low, "@", 1).isin(*V.BLOCKED_MAILBOXES) & ~F.substring_index(low, "@", -1).isin(*V.FREE_PROVIDERS), F.lit(False))


def normal_email(email: Column) -> Column:
    """Trimmed and in lower case."""
    return F.lower(F.trim(email))


def emails(text: Column, html: Column) -> Column:
    """Sorted business addresses in text and in mailto links of both."""
    plain = _all(text, V.EMAIL)
    linked = F.transform(F.concat(_all(text, V.MAILTO, 1), _all(html, V.MAILTO, 1)), lambda m: F.substring_index(F.trim(m), "?", 1))
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.concat(plain, linked), is_business_email), normal_email)))


def telegrams(text: Column, html: Column) -> Column:
    """Sorted Telegram links from links, names and invites in the text and from hrefs."""
    names = F.concat(_all(text, V.TELEGRAM, 1), _all(text, V.TELEGRAM_NAME, 1))
    found = F.concat(
        F.transform(names, lambda x: F.concat(F.lit("https://t.me/"), x)),
        F.transform(_all(text, V.TELEGRAM_INVITE, 1), lambda x: F.concat(F.lit("https://join.chat/"), x)),
        _all(html, V.TELEGRAM_HREF, 1),
    )
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, telegram_url), lambda x: x != "")))


def linkedins(text: Column, html: Column) -> Column:
    """Sorted LinkedIn profiles from text and hrefs."""
    found = F.transform(F.concat(_all(text, V.LINKEDIN, 1), _all(text, V.LINKEDIN_NAME, 1)), lambda x: F.concat(F.lit("https://linkedin.com/"), x))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(found, _all(html, V.LINKEDIN_HREF, 1)), contact_url), lambda x: x != "")))


def phones(text: Column) -> Column:
    """Sorted phone numbers as written, with ten digits at least."""
    return F.array_sort(F.array_distinct(F.filter(_all(text, V.PHONE), lambda p: F.length(F.regexp_replace(p, r"[^\d+]", "")) >= 10)))


def social(text: Column, html: Column, platform: str) -> Column:
    """Sorted profile links of one platform."""
    both = F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), F.coalesce(html, F.lit("")))
    return F.array_sort(F.array_distinct(F.transform(_all(both, V.SOCIAL[platform]), contact_url)))


def has_linked_data(html: Column) -> Column:
    """Whether a page has a linked-data script."""
    return F.coalesce(html.rlike(r"(?i)application/ld\+json"), F.lit(False))


def linked_contacts(html: Column) -> Column:
    """E-mail addresses and links (contact_type, value) of a page's linked-data scripts, of any depth."""
    scripts = F.when(has_linked_data(html), F.regexp_extract_all(html, F.lit(D.LINKED_DATA), F.lit(1)))
    none = F.array().cast("array<struct<contact_type: string, value: string>>")
    return F.coalesce(D.linked_data(scripts), none)


def with_linked(info: Column, linked: Column) -> Column:
    """The contacts of a page together with those of its linked data, normalised, sorted, each once."""

    def of(kind: str) -> Column:
        return F.transform(F.filter(linked, lambda c: c["contact_type"] == kind), lambda c: c["value"])

    def both(name: str, more: Column) -> Column:
        return F.array_sort(F.array_distinct(F.concat(info[name], F.filter(more, lambda x: x != "")))).alias(name)

    mails = F.transform(F.filter(of("email"), is_business_email), normal_email)
    return F.struct(both("emails", mails), both("telegram", F.transform(of("telegram"), telegram_url)), both("linkedin", F.transform(of("linkedin"), contact_url)), info["phones"].alias("phones"), info["social"].alias("social"))


def has_contacts(info: Column) -> Column:
    """Whether a page has any contact but phones."""
    return (F.size(info["emails"]) > 0) | (F.size(info["telegram"]) > 0) | (F.size(info["linkedin"]) > 0) | (F.size(info["social"]) > 0)


def contact_info(text: Column, html: Column) -> Column:
    """All contacts of one page's text and HTML as a struct."""
    platforms = F.create_map(*[x for p in V.SOCIAL for x in (F.lit(p), social(text, html, p))])
    return F.struct(emails(text, html).alias("emails"), telegrams(text, html).alias("telegram"), linkedins(text, html).alias("linkedin"), phones(text).alias("phones"), F.map_filter(platforms, lambda _, v: F.size(v) > 0).alias("social"))


def confidence(n_emails: Column, n_telegram: Column, n_linkedin: Column, n_phones: Column) -> Column:
    """0 to 100 by the kinds of contacts found."""
    parts = [F.when(n_emails > 0, 40).otherwise(0), F.when(n_emails > 1, 10).otherwise(0), F.when(n_telegram > 0, 25).otherwise(0), F.when(n_linkedin > 0, 25).otherwise(0), F.when(n_phones > 0, 10).otherwise(0)]
    return F.least(F.lit(100), reduce(add, parts)).cast("int")


def is_obfuscated(text: Column) -> Column:
    """Whether addresses may be written in words."""
    return F.coalesce(text.rlike(V.OBFUSCATION), F.lit(False))


def has_quick_contacts(text: Column) -> Column:
    """Whether a text has an e-mail address or a Telegram link."""
    return F.coalesce(text.rlike(V.EMAIL) | text.rlike(r"(?:t\.me|telegram\.me)[/\w]+"), F.lit(False))


def subject_area(tags: Column) -> Column:
    """The first three tags that say something, joined by a comma."""
    return F.array_join(F.slice(F.filter(tags, lambda t: ~F.lower(t).isin(*V.GENERIC_TAGS)), 1, 3), ", ")


def subject_or_keyword(tags: Column, keyword: Column) -> Column:
    """The subject area, else the keyword if any of its words says something, else ''."""
    words = F.filter(F.split(F.trim(F.lower(keyword)), r"\s+"), lambda w: ~w.isin("", *V.GENERIC_TAGS))
    own = subject_area(F.coalesce(tags, F.array().cast("array<string>")))
    return F.when(own != "", own).when(F.size(words) > 0, keyword).otherwise("")


def merged_tags(keyword: Column, categories: Column) -> Column:
    """The keyword, then the categories that aren't in the list yet, whatever their case."""
    return F.aggregate(F.slice(categories, 1, 3), F.array(keyword), lambda out, c: F.when(F.exists(out, lambda t: F.lower(t) == F.lower(c)), out).otherwise(F.concat(out, F.array(c))))


def clean_keyword(keyword: Column) -> Column:
    """Without angle brackets and quotes, trimmed."""
    return F.trim(F.translate(keyword, "<>\"'", ""))


def language_or_default(language: Column) -> Column:
    """Two to eight small letters, else ru."""
    return F.when(F.lower(F.trim(language)).rlike("^[a-z]{2,8}$"), F.lower(F.trim(language))).otherwise("ru")


def country_or_default(country: Column) -> Column:
    """Two or three capital letters, else RU."""
    return F.when(F.upper(F.trim(country)).rlike("^[A-Z]{2,3}$"), F.upper(F.trim(country))).otherwise("RU")


def keyword_variations(keyword: Column) -> Column:
    """The keyword, then those with a known term replaced by each of its synonyms."""
    low = F.lower(keyword)
    found = [F.when(low.contains(term), F.array(*[F.replace(low, F.lit(term), F.lit(s)) for s in synonyms])).otherwise(F.array().cast("array<string>")) for term, synonyms in V.KEYWORD_SYNONYMS.items()]
    return F.array_distinct(F.concat(F.array(keyword), *found))


def has_any(*counts: Column) -> Column:
    """Whether any count is above zero."""
    return reduce(or_, [c > 0 for c in counts])


def stored_has_data(stored: Column, kinds: tuple[str, ...] = ("emails", "telegram", "linkedin"), social: bool = True) -> Column:
    """Whether stored contacts, a JSON text, have any value; what is no object has none."""
    kind = "struct<emails: array<string>, telegram: array<string>, linkedin: array<string>, social: map<string, array<string>>>"
    found = F.from_json(stored, kind)
    tests = [F.coalesce(F.size(found[k]) > 0, F.lit(False)) for k in kinds]
    if social:
        tests.append(F.coalesce(F.exists(F.map_values(found["social"]), lambda v: F.size(v) > 0), F.lit(False)))
    return F.coalesce(reduce(or_, tests), F.lit(False))


def method_label(model_reply: Column) -> Column:
    """How contacts were found: by a model if there is a reply of one, else by patterns."""
    return F.when(model_reply.isNotNull(), "llm").otherwise("regex")
