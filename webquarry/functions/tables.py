"""Table functions for SQL.

``contacts_of`` takes pages with their contacts, a partition for each host and in order, and gives
contact rows of each host until it has seen enough:

    SELECT * FROM contacts_of(TABLE(found) PARTITION BY host ORDER BY page_id)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.udtf import SkipRestOfInputTableException

from webquarry.functions import contacts as C
from webquarry.functions import urls as U
from webquarry.operators import crawl

#: Kinds of contacts that are stored, by their names in the contacts of a page.
KINDS = (("email", "emails"), ("telegram", "telegram"), ("linkedin", "linkedin"))
PAGES = 3


class ContactsOf:
    """Rows (host, page_id, contact_type, value) of the pages of one host up to the first contact page with contacts, ``PAGES`` at most.

    The rest of a host's pages isn't read. A page has ``hit`` and ``stored``, its contact rows.
    """

    def __init__(self) -> None:
        self.pages, self.done = 0, False

    def eval(self, page: Row) -> Iterator[tuple]:
        if self.done or self.pages == PAGES:
            raise SkipRestOfInputTableException
        self.pages += 1
        self.done = page["hit"]
        for contact in page["stored"]:
            yield page["host"], page["page_id"], contact["contact_type"], contact["value"]


contacts_of = F.udtf(ContactsOf, returnType="host: string, page_id: bigint, contact_type: string, value: string")


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL."""
    spark.udtf.register("contacts_of", contacts_of)


def stored_contacts(info: Column) -> Column:
    """The contact rows of a page's contacts as an array (contact_type, value); phones aren't stored."""

    def rows(kind: Column, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(kind.alias("contact_type"), v.alias("value")))

    plain = [rows(F.lit(kind), info[name]) for kind, name in KINDS]
    social = F.flatten(F.transform(F.map_entries(info["social"]), lambda e: rows(e["key"], e["value"])))
    return F.concat(*plain, social)


def found(pages: DataFrame) -> DataFrame:
    """The table for ``contacts_of``: host, page_id, hit, stored of the first pages (page_id, url, html) of every host.

    More pages than a host's first ones can't be asked for; they go before their contacts are
    looked for, so a large host is no large partition.
    """
    ranked = pages.select("page_id", U.host(F.col("url")).alias("host")).withColumn("_n", F.row_number().over(Window.partitionBy("host").orderBy("page_id")))
    first = ranked.where(F.col("_n") <= PAGES).select("page_id", "host")
    rows = crawl.page_contacts(pages.join(first, "page_id"))
    hit = U.is_contact_page(F.col("url")) & C.has_contacts(F.col("info"))
    return rows.select("host", "page_id", hit.alias("hit"), stored_contacts(F.col("info")).alias("stored"))
