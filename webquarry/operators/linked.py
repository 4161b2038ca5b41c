"""Linked data walked level by level as VARIANT values, without a Python worker.

A round takes the objects and lists of a level, reads what an object says itself, and goes on with
those values that are objects or lists again, until none is left. ``STEPS`` levels make one
plan; what is left behind them is kept and starts the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.functions import contacts as C
from webquarry.functions import documents as D
from webquarry.lineage import cut

STEPS = 4
_NONE = "CAST(array() AS ARRAY<VARIANT>)"


def _object(v: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$', 'map<string, variant>')")


def _list(v: str) -> Column:
    return F.expr(f"try_variant_get({v}, '$', 'array<variant>')")


def _text(v: str) -> Column:
    """The string that a value is; null for all others."""
    return F.expr(f"CASE WHEN schema_of_variant({v}) = 'STRING' THEN CAST({v} AS STRING) END")


def _step(level: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What the containers ``v`` of a level say, (key, name, value), and the containers in them."""
    rows = level.select(key, _object("v").alias("o"), _list("v").alias("l"))
    said = F.array(F.struct(F.lit("email").alias("name"), F.expr("o['email']").alias("x")), F.struct(F.lit("sameAs").alias("name"), F.expr("o['sameAs']").alias("x")))
    own = rows.where("o IS NOT NULL").select(key, F.explode(said).alias("s")).select(key, "s.name", "s.x").where("x IS NOT NULL")
    # A list of addresses doesn't count, one of links does.
    own = own.select(key, "name", F.explode(F.when(F.col("name") == "sameAs", F.coalesce(_list("x"), F.expr("array(x)"))).otherwise(F.expr("array(x)"))).alias("x"))
    texts = own.where(_object("x").isNull() & _list("x").isNull()).select(key, "name", _text("x").alias("value")).where("value IS NOT NULL")
    inner = rows.select(key, F.explode(F.expr(f"concat(coalesce(map_values(o), {_NONE}), coalesce(l, {_NONE}))")).alias("v"))
    return texts, inner.where(_object("v").isNotNull() | _list("v").isNotNull())


def linked_contacts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, contact_type, value) of linked-data scripts as written there, at any depth, each once.

    Scripts that are no JSON, or that have one name twice in an object, say nothing.
    """
    scripts = pages.where(C.has_linked_data(F.col(html))).select(key, F.explode(F.regexp_extract_all(html, F.lit(D.LINKED_DATA), F.lit(1))).alias("s"))
    level = cut(scripts.select(key, F.try_parse_json("s").alias("v")).where(_object("v").isNotNull() | _list("v").isNotNull()))
    found: list[DataFrame] = []
    while not level.isEmpty():
        for _ in range(STEPS):
            texts, level = _step(level, key)
            found.append(texts)
        level = cut(level)
    if not found:
        return pages.select(key).limit(0).select(key, F.lit("").alias("contact_type"), F.lit("").alias("value"))
    value = F.col("value")
    links = F.array(F.when(value.contains("t.me") | value.contains("telegram"), "telegram"), F.when(value.contains("linkedin.com"), "linkedin"))
    kinds = F.when(F.col("name") == "email", F.array(F.lit("email"))).otherwise(F.array_compact(links))
    return reduce(DataFrame.union, found).select(key, F.explode(kinds).alias("contact_type"), "value").distinct()
