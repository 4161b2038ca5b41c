"""Exports, searches and counts over keywords, results, domains and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquarry import fixed_values as V
from webquarry.functions import contacts as C

LISTS = ("email", "telegram", "linkedin", "phone")


def flat_rows(domains: DataFrame, results: DataFrame, keywords: DataFrame, contacts: DataFrame) -> DataFrame:
    """One row a contact with its domain, search result and keyword (inner joins)."""
    k = keywords.select(F.col("id").alias("keyword_id"), "keyword", "country", "language", F.col("created_at").alias("keyword_at"))
    r = results.select(F.col("id").alias("search_result_id"), "keyword_id")
    d = domains.select(F.col("id").alias("domain_contact_id"), "search_result_id", "domain", "confidence_score", "extraction_method", F.col("created_at").alias("domain_at"))
    c = contacts.select(F.col("id").alias("contact_id"), "domain_contact_id", F.lower("contact_type").alias("contact_type"), "value", "is_verified")
    return c.join(d, "domain_contact_id").join(r, "search_result_id").join(k, "keyword_id")


def filtered(rows: DataFrame, keyword_id: int | None = None, country: str | None = None, contact_type: str | None = None, domain: str | None = None, min_confidence: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The export's optional filters; the domain is matched anywhere, whatever its case; dates are of the domain, both inclusive."""
    at = F.col("domain_at") if "domain_at" in rows.columns else F.lit(None).cast("timestamp")
    tests = [(start, at >= F.lit(start).cast("timestamp")), (end, at <= F.lit(end).cast("timestamp")), (keyword_id, F.col("keyword_id") == keyword_id), (country, F.col("country") == country), (contact_type, F.col("contact_type") == contact_type), (domain, F.col("domain").ilike(f"%{domain}%")), (min_confidence, F.col("confidence_score") >= (min_confidence or 0))]
    for value, test in tests:
        rows = rows.where(test) if value is not None else rows
    return rows


def _joined(kind: str, once: bool) -> Column:
    """Values of one type in the order of contact ids, joined by '; '."""
    listed = F.array_sort(F.collect_list(F.when(F.col("contact_type") == kind, F.struct("contact_id", "value"))))
    values = F.transform(listed, lambda x: x["value"])
    return F.array_join(F.array_distinct(values) if once else values, "; ").alias(kind)


def flat_export(rows: DataFrame, keys: tuple[str, ...] = ("keyword", "country", "language", "domain"), once: bool = False) -> DataFrame:
    """One row a key with its values per type joined; ``once`` keeps each value once."""
    return rows.groupBy(*keys).agg(*[_joined(kind, once) for kind in LISTS])


def domain_export(rows: DataFrame) -> DataFrame:
    """One row a domain with the attributes of its row of highest confidence (least id of equals)."""
    best = F.max_by(F.struct("keyword", "confidence_score", "domain_at"), F.struct("confidence_score", -F.col("domain_contact_id"), -F.col("contact_id"))).alias("b")
    out = rows.groupBy("domain").agg(best, *[_joined(kind, False) for kind in LISTS])
    return out.select("domain", F.col("b.keyword").alias("keyword"), F.col("b.confidence_score").alias("confidence_score"), F.date_format("b.domain_at", "yyyy-MM-dd HH:mm:ss").alias("extracted_at"), *LISTS)


def numbered(rows: DataFrame, first: str, second: str, *order: str) -> DataFrame:
    """Rows with a running number ``n`` in a total order of columns.

    Groups of ``first`` and ``second`` are counted and the counts cumulated, so that no task gets
    more rows than one such group has, or groups than one value of ``first`` has.
    """
    groups = rows.groupBy(first, second).agg(F.count("*").alias("_c"))
    within = Window.partitionBy(first).orderBy(second).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(first, second, F.coalesce(F.sum("_c").over(within), F.lit(0)).alias("_before"), "_c")
    tops = groups.groupBy(first).agg(F.sum("_c").alias("_t"))
    tops = tops.select(first, F.coalesce(F.sum("_t").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(first, second).orderBy(*(order or (first,))))
    joined = rows.withColumn("_k", rank).join(groups.drop("_c"), [first, second]).join(tops, first)
    return joined.withColumn("n", F.col("_start") + F.col("_before") + F.col("_k")).drop("_start", "_before", "_k")


def flat_export_rows(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """The numbered flat export by keyword id and domain with the subject of the domain's tags (domain, tags)."""
    keys = ("keyword_id", "keyword", "country", "language", "domain")
    out = flat_export(rows, keys).join(tags, "domain", "left").withColumn("subject", C.subject_area(F.coalesce("tags", F.array().cast("array<string>"))))
    return numbered(out.drop("tags"), "keyword_id", "domain")


def domain_sample(rows: DataFrame, n: int = 20) -> DataFrame:
    """Domains of the first ``n`` contact rows with their values per type."""
    return flat_export(rows.orderBy("contact_id").limit(n), ("domain",))


def search(rows: DataFrame, contact_type: str | None, text: str) -> DataFrame:
    """Contacts of a type (any) with the text in value, domain or keyword; % and _ are wild."""
    pattern = f"%{text}%"
    hit = F.col("value").ilike(pattern) | F.col("domain").ilike(pattern) | F.col("keyword").ilike(pattern)
    return rows.where(hit if contact_type is None else hit & (F.col("contact_type") == contact_type.lower()))


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of a sorted result."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def contact_type_counts(contacts: DataFrame) -> DataFrame:
    """All known types with their counts, zeros too, and their total."""
    known = contacts.sparkSession.createDataFrame([(t,) for t in V.CONTACT_TYPES], "contact_type string")
    counts = contacts.groupBy(F.lower("contact_type").alias("contact_type")).agg(F.count("*").alias("n"))
    return known.join(counts, "contact_type", "left").select("contact_type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def export_summary(domains: DataFrame, contacts: DataFrame) -> DataFrame:
    """Distinct domains and contacts by type; the total is of e-mail, Telegram and LinkedIn."""
    d = domains.agg(F.countDistinct("domain").alias("domains"))
    counts = [F.count_if(F.lower("contact_type") == t).alias(t) for t in ("email", "telegram", "linkedin")]
    return d.crossJoin(contacts.agg(*counts)).withColumn("total", F.col("email") + F.col("telegram") + F.col("linkedin"))


def keyword_tree(results: DataFrame, domains: DataFrame, contacts: DataFrame) -> DataFrame:
    """Domains of every keyword with their contacts as a list; domains without contacts stay."""
    listed = contacts.groupBy("domain_contact_id").agg(F.array_sort(F.collect_list(F.struct("id", "contact_type", "value"))).alias("contacts"))
    rows = results.select(F.col("id").alias("search_result_id"), "keyword_id", "position").join(domains.withColumnRenamed("id", "domain_contact_id"), "search_result_id")
    return rows.join(listed, "domain_contact_id", "left").select("keyword_id", "position", "domain_contact_id", "domain", F.coalesce(F.size("contacts"), F.lit(0)).alias("n_contacts"), "contacts")


def keyword_progress(keywords: DataFrame, results: DataFrame, domains: DataFrame) -> DataFrame:
    """Distinct results and domains of every keyword (left joins)."""
    r = results.select(F.col("id").alias("rid"), "keyword_id")
    d = domains.select(F.col("id").alias("did"), F.col("search_result_id").alias("rid"))
    rows = keywords.select(F.col("id").alias("keyword_id"), "keyword").join(r, "keyword_id", "left").join(d, "rid", "left")
    return rows.groupBy("keyword_id", "keyword").agg(F.countDistinct("rid").alias("results"), F.countDistinct("did").alias("domains"))


def totals_rollup(rows: DataFrame) -> DataFrame:
    """Contact totals per keyword and domain, per keyword, and overall."""
    return rows.rollup("keyword_id", "domain").agg(F.count("*").alias("contacts"), F.count_if(F.col("contact_type") == "email").alias("emails"))
