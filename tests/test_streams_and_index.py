"""Reports, choices, linked data, the search index and the database against their plain forms."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webquarry.functions import documents as D
from webquarry.operators import linked, metrics, search_index
from webquarry.sources import database, sinks
from webquarry.streaming import choices, deltas, leases


@pytest.fixture(autouse=True)
def store(spark):
    for k, v in leases.STORE.items():
        spark.conf.set(k, v)


def put_report(folder, name, at, values):
    folder.mkdir(exist_ok=True)
    path = folder / f".{name}"
    path.write_text(json.dumps(values))
    os.utime(path, (at, at))
    path.rename(folder / name)


def test_changes_of_reports_as_they_arrive(spark, tmp_path):
    source, out = tmp_path / "r", str(tmp_path / "out")
    report = lambda a, b, c: {"with_contacts_rate": a, "zero_page_rate_in_run": b, "failures": c}
    # Two at once, one late, two of one time, one without a value.
    arrivals = [[("a", 1000, report(10.0, 5.0, 1))], [("b", 2000, report(30.0, 5.0, 0)), ("c", 3000, report(20.0, 4.0, 2))], [("late", 2500, report(25.0, 1.0, 2))], [("older", 500, report(1.0, 1.0, 1))], [("e", 4000, report(2.005, 9.0, 2)), ("d", 4000, {"failures": 3})]]
    seen = {}
    for k, reports in enumerate(arrivals):
        for name, at, values in reports:
            put_report(source, f"{name}.json", 1_000_000 + at, values)
        stream = deltas.deltas(deltas.arriving(spark, str(source))).withColumn("batch", F.lit(k)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        stream.awaitTermination()
        rows = [r for r in spark.read.parquet(out).where(f"batch = {k}").collect()]
        for r in sorted(rows, key=lambda r: (r.at, r.new)):
            seen[r.metric] = (r.new, r.old, r.delta, r.trend)
        if k == 1:
            assert sorted((r.new, r.old) for r in rows if r.metric == "failures") == [(0.0, 1.0), (2.0, 0.0)]
        if k == 3:
            assert rows == []
        if k != 4:
            want = {r.metric: (r.new, r.old, r.delta, r.trend) for r in metrics.newest_delta(sinks.newest_reports(spark, str(source))).collect()}
            assert seen == want
    newest = {r.metric: (r.new, r.old) for r in metrics.newest_delta(sinks.newest_reports(spark, str(source))).collect()}
    last = {r.metric: (r.new, r.old) for r in rows if (r.new, r.old) == newest[r.metric]}
    assert last == newest


def test_choices_of_a_stream_are_those_of_the_table(spark, tmp_path):
    r, start = random.Random(5), datetime(2024, 1, 1)
    rows = []
    for k in range(200):
        host = r.choice(["a.example", "b.example", "c.example", "d.example", "e.example", ""])
        text = r.choice(["mail m%d@acme.example" % k, "t.me/abcde", "none", None])
        rows.append((host if k % 40 else None, k, f"https://{host}/{k}", "t", text if host != "e.example" else "none", start + timedelta(seconds=r.randint(0, 500))))
    schema = "host string, seq int, url string, title string, snippet string, at timestamp"
    # A result of the time of rest, one after it, and what moves the watermark.
    rest = [("a.example", -5, "https://a.example/rest", "t", "mail x@acme.example", start + timedelta(seconds=4000))]
    later = [("a.example", 999, "https://a.example/later", "t", "none", start + timedelta(days=2))]
    end = [("z.example", 1, "https://z.example/", "t", "none", start + timedelta(days=9))]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    r.shuffle(rows)
    for part in (rows[:70], rows[70:140] + rest, rows[140:], later, end):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = choices.arriving(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        stream.awaitTermination()
    got = sorted((x.host, x.action, x.seq, x.url) for x in spark.read.schema(choices.CHOICES).parquet(out).collect())
    want = sorted((x.host, x.action, x.seq, x.url) for x in choices.chosen(spark.createDataFrame(rows, schema)).collect())
    assert got == sorted([*want, ("a.example", "crawl", 999, "https://a.example/later")])
    assert {x[0]: x[1] for x in want}["e.example"] == "crawl" and {x[1] for x in want} == {"crawl", "extract"}


def script(value):
    return f'<script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script>'


def nested(depth):
    v = {"email": "deep@acme.example"}
    for k in range(depth):
        v = [v] if k % 2 else {"x": v}
    return v


LINKED = [
    None,
    "",
    "<p>x</p>",
    script({"email": "a@acme.example"}),
    script([{"email": "b@acme.example", "sameAs": "https://t.me/b"}, {"sameAs": ["https://linkedin.com/in/c", 3, None, {"sameAs": "telegram.me/d"}, ["t.me/no"], "https://t.me/x?linkedin.com"]}]),
    script("{broken") + script({"@graph": [[{"a": {"email": "é@acme.example"}}]]}),
    script({"email": 5, "sameAs": {"sameAs": "t.me/inner"}}) + script('"text"') + script("7") + script("null") + script("[]"),
    script({"email": {"email": "in@acme.example"}, "EMAIL": "no@acme.example"}),
    script({"email": ["list@acme.example", {"email": "inlist@acme.example"}], "sameAs": ""}),
    script(nested(9)) + script(nested(30)),
    script("[" * 300 + "]" * 300),
]


def test_linked_data_by_levels_is_that_of_the_walk(spark):
    df = spark.createDataFrame(list(enumerate(LINKED)), "page_id int, html string")
    import re

    want = sorted((k, c["contact_type"], c["value"]) for k, h in enumerate(LINKED) for c in D.linked_data_contacts(re.findall(D.LINKED_DATA, h or "")))
    found = linked.linked_contacts(df)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 9
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert linked.linked_contacts(df.limit(3)).collect() == []


PATTERNS = ["c1", "ACME", "acme_ex", "%", "", "a%e", "zz%acme", "c10@acme.example", "me.ex%ple", "src1", "b_lg", "ÉTÉ", "no such text", "\\%x%", "x_y", "100\\%"]


@pytest.mark.parametrize("few", [100_000, 0])
def test_search_by_index_is_that_of_a_scan(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(search_index, "FEW", few)
    r = random.Random(6)
    words = ["acme.example", "été", "C10@acme.example", "100%x", "a", "", "src1.example.com", "belgium", "BULGARIA", "x_y z", "%x%"]
    rows = [(k, r.choice(["email", "x"]), r.choice([*words, f"c{k}@acme.example", None]), r.choice(words), r.choice([*words, None])) for k in range(300)]
    df = spark.createDataFrame(rows, "contact_id long, contact_type string, value string, domain string, keyword string")
    index = search_index.SearchIndex(spark, str(tmp_path / "i"), folders=16)
    index.build(df)
    for p in PATTERNS:
        want = sorted(map(tuple, df.where(search_index.matches(p)).collect()), key=repr)
        assert sorted(map(tuple, index.search(p).select(*df.columns).collect()), key=repr) == want, p
    assert index.search("acme", "EMAIL").count() == df.where(search_index.matches("acme") & (F.col("contact_type") == "email")).count()
    assert search_index.trigrams("ab%cd_") == [] and search_index.trigrams("AbCd%\\%ef") == ["%ef", "abc", "bcd"]


def test_a_search_reads_the_listed_folders_only(spark, tmp_path):
    df = spark.range(2000).selectExpr("id AS contact_id", "'x' AS contact_type", "concat('v', id) AS value", "'d.example' AS domain", "CAST(NULL AS STRING) AS keyword")
    index = search_index.SearchIndex(spark, str(tmp_path / "i"), folders=64)
    index.build(df)
    found = index.search("v1999")
    scan = next(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "folder" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(set(found.inputFiles())) <= 64 and [x.contact_id for x in found.collect()] == [1999]


def test_tables_in_a_database(spark):
    db = database.Database(spark, "jdbc:derby:memory:contacts;create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    now = datetime(2024, 1, 2, 3, 4, 5)
    rows = [(k, k % 7, "email", f"v{k}", k % 2 == 0, None, now) for k in range(1, 1001)]
    schema = database.schema("contacts")
    db.append(spark.createDataFrame(rows, schema), "contacts")
    assert db.bounds("contacts") == (1, 1000, 1000)
    got = db.read("contacts", rows_a_task=200)
    assert got.schema.simpleString() == schema.simpleString() and got.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, got.collect())) == rows
    some = got.where("domain_contact_id = 3 AND id > 900").select("value")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.value for r in some.collect()) == sorted(f"v{k}" for k in range(901, 1001) if k % 7 == 3)
    scan = next(line for line in plan.splitlines() if "Scan JDBC" in line)
    assert "PushedFilters: [" in scan and "GreaterThan" in scan and "EqualTo" in scan and "contact_type" not in scan.lower().split("readschema")[1]
    assert db.read("contacts", rows_a_task=5000).rdd.getNumPartitions() == 1
    db.append(spark.createDataFrame([], "id int, keyword string"), "keywords")
    empty = db.read("keywords")
    assert empty.collect() == [] and empty.schema.simpleString() == database.schema("keywords").simpleString()
