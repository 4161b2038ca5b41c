"""Operators that keep a state, walk a graph or run to a fixpoint: files, streams, restarts and brute force."""

import base64
import json
import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webquarry.functions import tables
from webquarry.operators import linkgraph, progress, runs, tasks
from webquarry.sources import answers, keyed, paired
from webquarry.streaming import leases


def anchors(*urls):
    return "".join(f'<a href="{u}">x</a>' for u in urls)


def test_walk_of_a_cycle_and_a_page_at_two_depths(spark):
    at = lambda name: f"https://a.example/team/{name}"
    pages = [
        (at("1"), anchors("/team/2", "3", "/team/2", "/blog/x", "https://b.example/team/9", "/team/f.pdf")),
        (at("2"), anchors("/team/3", "/team/1")),
        (at("3"), anchors("/team/4", "/team/1", "/team/3")),
        (at("3"), anchors("/team/5")),
        (at("4"), anchors("/team/6")),
        (None, anchors("/team/7")),
    ]
    df = spark.createDataFrame([(u, h, 0) for u, h in pages], "url string, html string, depth int")
    seeds = spark.createDataFrame([(at("1"),), (at("1"),), (None,)], "url string")
    walk = lambda depth: {r.url[len(at("")) :]: (r.depth, r.found_on and r.found_on[len(at("")) :], r.stored) for r in linkgraph.reachable(df, seeds, depth).collect()}
    two = {"1": (0, None, True), "2": (1, "1", True), "3": (1, "1", True), "4": (2, "3", True), "5": (2, "3", False)}
    assert walk(2) == two and walk(9) == two | {"6": (3, "4", False)} and walk(0) == {"1": (0, None, True)}
    assert sorted(r.depth for r in linkgraph.visited_pages(df.drop("depth"), seeds).collect()) == [0, 1, 1, 1, 2]
    assert linkgraph.reachable(df.limit(0), seeds).count() == 1 and linkgraph.reachable(df, seeds.limit(0)).collect() == []


def test_first_fifty_anchors_only(spark):
    html = anchors(*["https://far.example/team/1"] * 49, "/team/50", "/team/51")
    df = spark.createDataFrame([("https://a.example/", html)], "url string, html string")
    assert [r.url for r in linkgraph.reachable(df, df.select("url")).where("depth = 1").collect()] == ["https://a.example/team/50"]


EVENTS = "run_id string, keyword_id int, seq long, kind string, websites int, contacts int, total int, error string, at timestamp"


def replayed(state, events):
    """The state after events, one by one."""
    for run, kw, _, kind, websites, contacts, total, error, at in sorted(events, key=lambda e: e[2]):
        row = state.get((run, kw))
        if kind == "progress":
            done = int(websites / total * 100) if total and total > 0 else 0
            state[run, kw] = ["processing", websites, contacts, done, None, None] if row is None else [row[0], websites, contacts, done, row[4], at]
        elif row is not None:
            state[run, kw] = ["completed", row[1], contacts, 100, row[4], at] if kind == "completed" else ["failed", row[1], row[2], row[3], error, at]
    return state


def random_events(r, n, seq):
    start = datetime(2024, 1, 1)
    return [(r.choice(["a", "b", None]), r.choice([1, 2, None]), seq + i, r.choice(["progress", "progress", "completed", "failed"]), r.randint(0, 9), r.choice([None, 1, 5]), r.choice([0, 4, 9, None]), r.choice([None, "e"]), start + timedelta(seconds=seq + i)) for i in range(n)]


def states(df):
    return {(r.run_id, r.keyword_id): list(r[2:]) for r in df.collect()}


def test_upserts_are_those_of_a_replay(spark, tmp_path):
    r = random.Random(1)
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), progress.STATE, progress.KEYS, folders=8)
    want = {}
    assert table.read().collect() == []
    for k in range(4):
        batch = random_events(r, r.choice([0, 1, 6, 20]) if k else 12, 100 * k)
        want = replayed(want, batch)
        rows = spark.createDataFrame(batch, EVENTS)
        assert table.apply(f"b{k}", rows, progress.applied) and not table.apply(f"b{k}", rows, progress.applied)
        assert states(table.read()) == want and table.is_applied(f"b{k}")
    totals = {r.run_id: (r.total_keywords, r.completed, r.overall_progress) for r in progress.summary(table.read()).collect()}
    for run in {k[0] for k in want}:
        own = [v for k, v in want.items() if k[0] == run]
        done = sum(v[0] == "completed" for v in own)
        assert totals[run] == (len(own), done, int(done / len(own) * 100))


def times(path):
    return {p: os.stat(p).st_mtime_ns for p in map(str, path.rglob("*.parquet"))}


def test_only_touched_folders_are_written(spark, tmp_path):
    schema = "k int, v string, n int"
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), schema, ("k",), folders=16)
    change = keyed.newest(("k",), "n")
    table.apply("1", spark.createDataFrame([(k, "old", 0) for k in range(100)], schema), change)
    before = times(tmp_path / "t" / "rows")
    rows = spark.createDataFrame([(3, "a", 1), (3, "b", 2), (3, None, 0), (200, "new", 0)], schema)
    touched = {r[0] for r in rows.select(table.folder()).distinct().collect()}
    table.apply("2", rows, change)
    after = times(tmp_path / "t" / "rows")
    of = lambda p: int(p.split(f"{keyed.FOLDER}=")[1].split("/")[0])
    assert {p: t for p, t in before.items() if of(p) not in touched} == {p: t for p, t in after.items() if of(p) not in touched}
    assert {(r.k, r.v) for r in table.read().collect()} == {(k, "b" if k == 3 else "old") for k in range(100)} | {(200, "new")}


@pytest.mark.parametrize("step", ["aside", "rows", "ledger"])
def test_a_batch_that_died_is_repeated(spark, tmp_path, monkeypatch, step):
    """Dies while it writes aside, while it copies (the old folder is gone already), or before the ledger."""
    import shutil

    schema = "k int, v string, n int"
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), schema, ("k",), folders=4)
    add = lambda old, rows: old.unionByName(rows).groupBy("k").agg(F.max("v").alias("v"), F.sum("n").cast("int").alias("n")).select("k", "v", "n")
    table.apply("1", spark.createDataFrame([(k, "old", 1) for k in range(20)], schema), add)
    rows = spark.createDataFrame([(1, "new", 10), (21, "new", 10)], schema)

    class Died(Exception):
        pass

    def dies(*_):
        if step == "aside":
            raise Died
        return add(*_)

    real = table._file

    def failing(name):
        if step == "rows" and name == "aside/2" and (tmp_path / "t/aside/2/_SUCCESS").exists():
            for part in (tmp_path / "t/aside/2").glob(f"{keyed.FOLDER}=*"):
                shutil.rmtree(tmp_path / "t/rows" / part.name, ignore_errors=True)
            raise Died
        if step == "ledger" and name == "ledger/2" and (tmp_path / "t/aside/2/_SUCCESS").exists():
            raise Died
        return real(name)

    monkeypatch.setattr(table, "_file", failing)
    with pytest.raises(Died):
        table.apply("2", rows, dies)
    monkeypatch.undo()
    again = keyed.KeyedTable(spark, table.path, schema, ("k",), folders=4)
    assert again.apply("2", rows, add) and not again.apply("2", rows, add)
    assert {(r.k, r.n) for r in again.read().collect()} == {(k, 11 if k == 1 else 1) for k in range(20)} | {(21, 10)}
    assert not list((tmp_path / "t/aside").iterdir())


def test_traces_go_to_the_newest_log_of_a_host(spark, tmp_path):
    schema = "id long, domain string, crawled_at timestamp, llm_request string, llm_response string, llm_model string"
    at = lambda d: datetime(2024, 1, d)
    logs = keyed.KeyedTable(spark, str(tmp_path / "t"), schema, ("domain",), folders=16)
    first = [(1, "a", at(1), None, None, None), (2, "a", at(3), None, None, None), (3, "a", at(3), "old", "old", "m0"), (4, "b", at(2), "q", "r", "m0"), (5, "b", at(1), None, None, None), (6, "c", at(1), None, None, None)]
    logs.apply("logs", spark.createDataFrame(first, schema), keyed.appended)
    before = times(tmp_path / "t" / "rows")
    traces = spark.createDataFrame([("a", "Q", "R", "m1"), ("x", "Q", "R", "m1")], "domain string, llm_request string, llm_response string, llm_model string")
    touched = {r[0] for r in traces.select(logs.folder()).distinct().collect()}
    assert logs.apply("traces", traces, keyed.traced("domain")) and not logs.apply("traces", traces, keyed.traced("domain"))
    got = {r.id: (r.llm_request, r.llm_response, r.llm_model) for r in logs.read().collect()}
    none = (None, None, None)
    assert got == {1: none, 2: none, 3: ("Q", "R", "m1"), 4: ("q", "r", "m0"), 5: none, 6: none}
    of = lambda p: int(p.split(f"{keyed.FOLDER}=")[1].split("/")[0])
    assert {p: t for p, t in before.items() if of(p) not in touched}.items() <= times(tmp_path / "t" / "rows").items()
    logs.apply("more", spark.createDataFrame([(7, "a", at(9), None, None, None)], schema), keyed.appended)
    assert {r.id: r.llm_model for r in logs.read().collect()} == {1: None, 2: None, 3: "m1", 4: "m0", 5: None, 6: None, 7: None}


INFO = "struct<emails: array<string>, telegram: array<string>, linkedin: array<string>, phones: array<string>, social: map<string, array<string>>>"
FOUND = f"search_result_id long, domain string, tags array<string>, confidence_score int, extraction_method string, info {INFO}"


def extraction(i, mails, social=None):
    return (i, f"d{i}.example", ["t"], 50, "regex", (mails, [], [], ["1234567890"], social or {}))


def test_two_tables_in_one_commit(spark, tmp_path, monkeypatch):
    store = paired.PairedTables(spark, str(tmp_path / "c"))
    assert store.read("contacts", paired.CONTACTS).collect() == []
    first = spark.createDataFrame([extraction(2, ["b@x.example", "a@x.example"]), extraction(1, []), extraction(3, [], {"x": ["https://x.com/a"]})], FOUND)
    sink = paired.contacts_sink(store, "s")
    sink(first, 0)
    sink(first, 0)
    second = spark.createDataFrame([extraction(k, [f"m{k}@x.example"]) for k in range(10, 30)], FOUND)
    made = paired.contact_tables

    def half(found, last):
        out = made(found, last)
        # The first table is written, the second dies.
        return out | {"contacts": out["contacts"].withColumn("value", F.raise_error(F.lit("died")))}

    monkeypatch.setattr(paired, "contact_tables", half)
    with pytest.raises(Exception, match="died"):
        sink(second, 1)
    assert (tmp_path / "c/domain_contacts/commit=2").exists()
    assert paired.PairedTables(spark, store.path).read("domain_contacts", paired.DOMAINS).count() == 2
    monkeypatch.setattr(paired, "contact_tables", made)
    sink(second, 1)
    sink(second, 1)
    domains = {r.id: r.search_result_id for r in store.read("domain_contacts", paired.DOMAINS).collect()}
    assert domains == {1: 2, 2: 3} | {3 + k: 10 + k for k in range(20)}
    contacts = [(r.id, r.domain_contact_id, r.contact_type, r.value) for r in store.read("contacts", paired.CONTACTS).orderBy("id").collect()]
    assert contacts[:3] == [(1, 1, "email", "a@x.example"), (2, 1, "email", "b@x.example"), (3, 2, "x", "https://x.com/a")]
    assert [c[0] for c in contacts] == list(range(1, 24)) and all(c[3] == f"m{domains[c[1]]}@x.example" for c in contacts[3:])
    assert [m["last"] for m in store.commits()] == [{"domain_contacts": 2, "contacts": 3}, {"domain_contacts": 22, "contacts": 23}]


def test_a_second_writer_is_refused(spark, tmp_path):
    a, b = (paired.PairedTables(spark, str(tmp_path / "c")) for _ in range(2))
    rows = spark.createDataFrame([(1,)], "id long")

    def meanwhile(last):
        b.commit("b", lambda _: {"t": rows})
        return {"t": rows}

    with pytest.raises(RuntimeError):
        a.commit("a", meanwhile)
    assert [m["batch"] for m in a.commits()] == ["b"]


def test_contact_tables_of_a_stream_survive_a_restart(spark, tmp_path, monkeypatch):
    store, source = paired.PairedTables(spark, str(tmp_path / "c")), str(tmp_path / "in")
    made, tries = paired.contact_tables, []

    def dies_once(found, last):
        tries.append(1)
        out = made(found, last)
        return out | {"contacts": out["contacts"].withColumn("value", F.raise_error(F.lit("died")))} if len(tries) == 2 else out

    monkeypatch.setattr(paired, "contact_tables", dies_once)
    for k in range(3):
        spark.createDataFrame([extraction(10 * k + j, [f"m{k}{j}@x.example"]) for j in range(4)], FOUND).coalesce(1).write.mode("append").parquet(source)
        for attempt in range(2):
            stream = spark.readStream.schema(FOUND).parquet(source).writeStream.foreachBatch(paired.contacts_sink(store, "q")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            try:
                stream.awaitTermination()
            except Exception as e:
                assert "died" in str(e) and attempt == 0 and k == 1
                assert store.read("domain_contacts", paired.DOMAINS).count() == 4
    assert [r.id for r in store.read("contacts", paired.CONTACTS).orderBy("id").collect()] == list(range(1, 13))
    assert Counter(r.domain_contact_id for r in store.read("contacts", paired.CONTACTS).collect()) == Counter(range(1, 13))


def test_ids_are_gapless_whatever_the_ranges(spark):
    rows = spark.createDataFrame([(k % 7, f"v{k}") for k in range(500)], "a int, b string")
    got = [(r.id, r.a, r.b) for r in paired.with_ids(rows, 40, F.col("a"), F.col("b"), tasks=9).orderBy("id").collect()]
    want = sorted((k % 7, f"v{k}") for k in range(500))
    assert got == [(41 + i, a, b) for i, (a, b) in enumerate(want)]


def test_locks_released_by_a_stream_are_those_of_the_table(spark, tmp_path):
    for k, v in leases.STORE.items():
        spark.conf.set(k, v)
    r, start = random.Random(2), datetime(2024, 1, 1)
    events = [(r.randint(1, 12) if r.random() > 0.03 else None, r.choice(["running", "running", "completed", "pending", None]), start + timedelta(seconds=30 * k + r.choice([0, 0, 1, 299, -299]), microseconds=r.choice([0, 1, 999]))) for k in range(300)]
    events += [(99, "running", start), (99, "completed", start), (98, "running", start), (98, "running", start + timedelta(seconds=300)), (97, "running", start), (97, "running", start + timedelta(seconds=301))]
    events.sort(key=lambda e: e[2] + timedelta(seconds=r.choice([0, 0, 400])))
    schema, source, out = "id long, status string, at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    late = datetime(2024, 1, 3)
    parts = [events[k : k + 60] for k in range(0, len(events), 60)] + [[(1000, "completed", late)]]
    for part in parts:
        # Each part is a run of its own: the state comes from the checkpoint.
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = leases.released(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        stream.awaitTermination()
    got = sorted((x.id, x.was_locked_at) for x in spark.read.schema(leases.RELEASES).parquet(out).collect())
    table = spark.createDataFrame(events, schema)
    want = sorted((x.id, x.was_locked_at) for x in leases.released_until(table, late - timedelta(minutes=10)).collect())
    assert got == want and len(want) > 20
    assert not [x for x in want if x[0] == 99] and [x for x in want if x[0] == 98] == [(98, start + timedelta(seconds=300))] and len([x for x in want if x[0] == 97]) == 2
    # A lock of which nothing more is heard is what the table's recovery finds.
    last = table.where("id <> 99 AND status IS NOT NULL").groupBy("id").agg(F.max(F.struct("at", "status")).alias("e")).select("id", F.lit("t").alias("task_type"), "e.status", F.col("e.at").alias("locked_at"))
    stale = {(x.id, x.was_locked_at) for x in tasks.stale(last, str(late - timedelta(minutes=10))).collect()}
    assert stale and stale <= set(want)


TASK = "id long, task_type string, status string, priority int, retry_count int, max_retries int, keyword_id int, depends_on_task_id long"


def replayed_run(rows, fails, unblock):
    """The run task by task, as a worker would do it; rounds by the round of what a task waits for."""
    t = {r[0]: dict(zip(["id", "type", "status", "priority", "retry", "most", "kw", "dep"], r, strict=True)) for r in rows}
    for x in t.values():
        x["round"] = 0 if x["status"] in ("completed", "failed") else None
        x["status"] = "pending" if x["round"] is None else x["status"]

    def ready(x):
        p = t.get(x["dep"])
        if p is None or p["status"] == "completed":
            return True
        return p["status"] == "failed" and ((p["type"], x["type"]) in {("search_keyword", "crawl_domain"), ("search_keyword", "extract_contacts"), ("crawl_domain", "extract_contacts")})

    k = 0
    while True:
        k += 1
        now = [x for x in t.values() if x["status"] == "pending" and ready(x)]
        if not now:
            now = [x for x in t.values() if x["status"] == "pending" and t.get(x["dep"], {}).get("status") == "failed"] if unblock else []
            if not now:
                return t
            for x in now:
                x["dep"] = None
        for x in now:
            f = fails.get(x["id"], 0)
            while True:
                if f == 0:
                    x["status"] = "completed"
                    break
                f -= 1
                x["retry"] += 1
                if x["retry"] >= x["most"]:
                    x["status"] = "failed"
                    break
            x["round"] = k


@pytest.mark.parametrize("unblock", [True, False])
def test_a_run_is_that_of_a_replay(spark, unblock):
    r = random.Random(4)
    kinds = ["search_keyword", "crawl_domain", "extract_contacts"]
    rows = []
    for i in range(80):
        dep = r.choice([None, 1000, *range(i)] if i else [None])
        rows.append((i, r.choice(kinds), r.choice(["pending", "pending", "running", "completed", "failed"]), 5, r.randint(0, 2), 3, r.choice([None, 1, 2]), dep))
    # Two that wait for each other never start.
    rows += [(80, kinds[0], "pending", 5, 0, 3, 3, 81), (81, kinds[0], "pending", 5, 0, 3, 3, 80)]
    fails = {i: r.randint(0, 4) for i in range(80) if r.random() < 0.6}
    got = runs.settled(spark.createDataFrame(rows, TASK), spark.createDataFrame(list(fails.items()), "id long, failures int"), unblock=unblock)
    want = replayed_run(rows, fails, unblock)
    assert {x.id: (x.status, x.retry_count, x.round, x.depends_on_task_id) for x in got.collect()} == {i: (x["status"], x["retry"], x["round"], x["dep"]) for i, x in want.items()}
    settled = {x.keyword_id: (x.tasks, x.still_open, x.is_processed) for x in runs.keywords_after(got).collect()}
    for kw in (1, 2, 3):
        own = [x for x in want.values() if x["kw"] == kw]
        left = sum(x["status"] == "pending" for x in own)
        assert settled[kw] == (len(own), left, left == 0)
    assert settled[3] == (2, 2, False)


def test_a_run_of_nothing(spark):
    none = spark.createDataFrame([], TASK)
    assert runs.settled(none, spark.createDataFrame([], "id long, failures int")).collect() == []


def test_table_function_stops_at_the_first_hit(spark):
    page = lambda i, hit: ("h", i, hit, [("email", f"m{i}@x.example"), ("email", f"n{i}@x.example")])
    schema = "host string, page_id long, hit boolean, stored array<struct<contact_type: string, value: string>>"
    rows = [page(3, True), page(1, False), page(2, True), ("i", 5, False, []), *[("j", k, False, [("x", f"v{k}")]) for k in range(9)]]
    got = tables.contacts_of(spark.createDataFrame(rows, schema).asTable().partitionBy("host").orderBy("page_id")).collect()
    assert sorted((r.host, r.page_id) for r in got) == [("h", 1), ("h", 1), ("h", 2), ("h", 2), ("j", 0), ("j", 1), ("j", 2)]
    assert sorted({r.value for r in got if r.host == "h"}) == ["m1@x.example", "m2@x.example", "n1@x.example", "n2@x.example"]


FILES = {
    "a/1.json": json.dumps({"organic_results": [{"link": "u1", "title": "t1", "snippet": "s1"}, {"link": "u2"}]}).encode(),
    "a/2.json": ("﻿" + json.dumps([{"href": "u3", "title": "é", "body": "b"}])).encode(),
    "b/3.xml": b"<?xml version='1.0' encoding='utf-8'?><r><doc><url>u4</url><title>x</title></doc></r>",
    "b/4": base64.b64encode(b"<r><doc><url>u5</url></doc></r>"),
    "5.json": json.dumps({"rawData": base64.b64encode(b"<r><doc><url>u6</url></doc></r>").decode()}).encode(),
    "6.json": b'{"organic_results": []}',
    "7.json": b'{"organic_results": [',
    "8.json": b'{"error": {"message": "quota"}}',
    "9.bin": b"\xff\xfe\x00",
    "10.txt": b"  \n",
    "11.xml": b"<r><doc>",
    "12.xml": b'<!DOCTYPE r [<!ENTITY a "x">]><r/>',
    "13.json": b'"text"',
}
REASONS = {"7.json": "unreadable JSON", "8.json": "error: quota", "9.bin": "no UTF-8", "10.txt": "empty", "11.xml": "unreadable XML", "12.xml": "unreadable XML", "13.json": "unreadable XML"}


def put(folder, names):
    for name in names:
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(FILES[name])


def test_a_folder_of_answers(spark, tmp_path):
    put(tmp_path, FILES)
    name = lambda p: p.split(f"{tmp_path.name}/", 1)[1]
    rows = answers.read(answers.files(spark, str(tmp_path))).cache()
    assert {name(r.path): r.reason for r in rows.collect() if r.reason} == REASONS
    assert rows.where("(results IS NULL) = (reason IS NULL)").count() == 0
    assert sorted((name(r.path), r.url, r.title, r.position) for r in answers.results(rows).collect()) == [("5.json", "u6", "", 1), ("a/1.json", "u1", "t1", 1), ("a/1.json", "u2", None, 2), ("a/2.json", "u3", "é", 1), ("b/3.xml", "u4", "x", 1), ("b/4", "u5", "", 1)]
    assert {name(r.path): bytes(r.content) for r in answers.quarantined(rows).collect()} == {n: FILES[n] for n in REASONS}


def test_answers_that_arrive_equal_those_of_the_folder(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    names = list(FILES)
    for k in range(0, len(names), 5):
        put(source, names[k : k + 5])
        stream = answers.arriving(spark, str(source), most=2).writeStream.foreachBatch(answers.sink(str(out))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        stream.awaitTermination()
    rows = answers.read(answers.files(spark, str(source)))
    drop = lambda df: sorted(map(tuple, df.drop("batch", "content").collect()), key=repr)
    assert drop(spark.read.parquet(str(out / "results"))) == drop(answers.results(rows))
    assert drop(spark.read.parquet(str(out / "quarantine"))) == drop(answers.quarantined(rows))
