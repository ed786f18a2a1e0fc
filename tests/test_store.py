"""Tables that are swapped together, flat rows, newest inputs, alerts with state, and orders without a sort of all rows."""

import os
import time

import pytest
from pyspark.sql import functions as F

from textforge.operators import cascade, replay, reports
from textforge.sources import store
from textforge.sources.tables import ranked_sources, unify
from textforge.streaming.alerts import run_alerts, stream_alerts

SCHEMA = "url string, text string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), f"{SCHEMA}, at int")


def test_cache(spark, tmp_path):
    cache = store.Cache(spark, f"file://{tmp_path}/c", SCHEMA, "url", buckets=4)
    held = lambda: {r["url"]: r["text"] for r in cache.read().collect()}
    assert held() == {}
    first = {f"u{i}": "one" for i in range(40)}
    assert cache.upsert(rows(spark, *[(k, "older", 0) for k in first], *[(k, v, 1) for k, v in first.items()], (None, "no key", 9)), "at") == 1
    assert held() == first
    before = cache.manifest.read()[1]
    assert cache.upsert(rows(spark, ("u3", "two", 1), ("new", "two", 1)), "at") == 2
    assert held() == first | {"u3": "two", "new": "two"}
    after = cache.manifest.read()[1]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2  # other buckets are the same files
    cache.upsert(rows(spark, ("u3", None, 2), ("u4", "three", 2)), "at", removed=F.col("text").isNull())
    assert held() == {k: v for k, v in (first | {"new": "two", "u4": "three"}).items() if k != "u3"}
    cache.upsert(rows(spark, *[(k, "four", 3) for k in held()]), "at")
    assert cache.manifest.vacuum() == 3 and set(held().values()) == {"four"} and cache.manifest.read()[0] == 4
    cache.upsert(rows(spark), "at")
    assert len(held()) == 40


def test_crash_between_two_upserts(spark, tmp_path, monkeypatch):
    cache = store.Cache(spark, f"file://{tmp_path}/c", SCHEMA, "url", buckets=4)
    cache.upsert(rows(spark, ("a", "one", 1), ("b", "one", 1)), "at")

    def crash(self, seen, parts):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.Manifest, "commit", crash)
        with pytest.raises(RuntimeError):
            cache.upsert(rows(spark, ("a", "two", 2)), "at")
    assert {tuple(r) for r in cache.read().collect()} == {("a", "one"), ("b", "one")}
    cache.upsert(rows(spark, ("b", "three", 3)), "at")
    assert {tuple(r) for r in cache.read().collect()} == {("a", "one"), ("b", "three")}


def test_two_writers(spark, tmp_path, monkeypatch):
    cache = store.Cache(spark, f"file://{tmp_path}/c", SCHEMA, "url", buckets=2)
    commit, seen_by = store.Manifest.commit, []

    def late(self, seen, parts):
        if not seen_by:  # another run commits first
            seen_by.append(seen)
            store.Cache(spark, f"file://{tmp_path}/c", SCHEMA, "url", buckets=2).upsert(rows(spark, ("b", "other", 1)), "at")
        return commit(self, seen, parts)

    monkeypatch.setattr(store.Manifest, "commit", late)
    assert cache.upsert(rows(spark, ("a", "mine", 1)), "at") == 2
    assert {tuple(r) for r in cache.read().collect()} == {("a", "mine"), ("b", "other")}
    with pytest.raises(store.Conflict):
        commit(cache.manifest, 1, {})


def test_split_is_seen_whole_or_not(spark, tmp_path):
    root, names = f"file://{tmp_path}/s", ("ready", "review", "out")
    df = spark.createDataFrame([(1, "ready"), (2, "out"), (3, "ready")], "i int, split string")
    read = lambda n: sorted(r[0] for r in store.read_split(spark, root, "split", n, df.schema).collect())
    assert read("ready") == []
    store.write_split(df, root, "split", names)
    assert (read("ready"), read("review"), read("out")) == ([1, 3], [], [2])
    for wrong in ([(4, "else")], [(4, None)]):
        with pytest.raises(Exception, match="no table for"):
            store.write_split(spark.createDataFrame(wrong, "i int, split string"), root, "split", names)
    assert read("ready") == [1, 3]
    store.write_split(df.where("i = 2"), root, "split", names)
    assert (read("ready"), read("out")) == ([], [2])


def test_newest_input(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("old.csv", "empty.csv", "new.csv", "missing.csv")}
    for n, text in (("old.csv", "a\n1\n"), ("empty.csv", ""), ("new.csv", "a\n2\n")):
        (tmp_path / n).write_text(text)
    now = time.time()
    for n, age in (("old.csv", 100), ("empty.csv", 0), ("new.csv", 50)):
        os.utime(paths[n], (now - age, now - age))
    choose = lambda *names: store.newest(spark, [paths[n] for n in names])
    assert choose("old.csv", "empty.csv", "new.csv", "missing.csv") == paths["new.csv"]
    assert choose("missing.csv", "old.csv", "empty.csv") == paths["old.csv"] and choose("empty.csv", "missing.csv") is None and store.newest(spark, []) is None
    os.utime(paths["old.csv"], (now - 50, now - 50))
    assert choose("old.csv", "new.csv") == paths["old.csv"]
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "part-0.csv").write_text("a\n")
    assert store.newest(spark, [paths["new.csv"], str(tmp_path / "folder")]) == str(tmp_path / "folder")


NESTED = "id long, company struct<display_name: string, more: struct<a: int, tags: map<string, array<string>>>>, `dotted.name` string, extra map<string, struct<x: int, y: string>>, at timestamp, list array<struct<k: string>>"


def test_flat_rows_and_back(spark, tmp_path):
    import datetime

    day = datetime.datetime(2024, 2, 3, 4, 5, 6, 123456)
    df = spark.createDataFrame([
        (1, ("Acme, \"the\" firm\n", (7, {"a": ["x", None], "b": []})), "d", {"k": (1, "é"), "n": None}, day, [("q",), (None,)]),
        (2, (None, None), None, {}, None, []), (3, None, "", None, day, None), (4, ("", (None, None)), " ", {"": (None, "")}, day, [None]),
    ], NESTED)
    flat = replay.flattened(df)
    assert flat.columns[:5] == ["id", "company.?", "company.display_name", "company.more.?", "company.more.a"] and "dotted\\.name" in flat.columns
    assert flat.schema.fieldNames() == replay.flat_schema(df.schema).fieldNames()
    assert replay.restored(flat, df.schema).orderBy("id").collect() == df.orderBy("id").collect()
    replay.write_flat(df, str(tmp_path / "flat"))
    assert replay.read_flat(spark, str(tmp_path / "flat"), df.schema).orderBy("id").collect() == df.orderBy("id").collect()


EVENTS = "event_id long, user_id long, ts timestamp"


def events(spark, folder, *values):
    spark.createDataFrame([(i, u, f"2024-01-{d:02d} 00:00:00") for i, u, d in values], "event_id long, user_id long, t string").select("event_id", "user_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def test_alert_stream_forgets_and_restarts(spark, tmp_path):
    given, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    go = lambda: stream_alerts(spark, given, EVENTS, out, check, key="user_id", horizon="5 days")
    alerted = lambda: sorted(r[0] for r in spark.read.schema(EVENTS).parquet(out).select("user_id").collect())
    size = lambda q: q.lastProgress["stateOperators"][0]["numRowsTotal"]
    events(spark, given, (1, 1, 1), (2, 1, 1), (3, 2, 2))
    assert size(go()) == 2 and alerted() == [1, 2]
    go()  # nothing new
    assert alerted() == [1, 2]
    events(spark, given, (4, 1, 3), (5, 3, 3))  # 1 is known still
    go()
    assert alerted() == [1, 2, 3]
    events(spark, given, (6, 4, 25))
    go()
    events(spark, given, (7, 1, 26), (8, 5, 1))  # 1 is forgotten, 5 comes too late
    q = go()
    assert alerted() == [1, 1, 2, 3, 4] and size(q) <= 2


def test_alert_state_that_cannot_be_read_is_an_error(spark, tmp_path):
    given, state = str(tmp_path / "in"), tmp_path / "state"
    events(spark, given, (1, 1, 1))
    run = lambda: run_alerts(spark, given, EVENTS, str(state), str(tmp_path / "out"), str(tmp_path / "check"), key="user_id")
    (state / "batch=0").mkdir(parents=True)
    (state / "batch=0" / "part-0.parquet").write_bytes(b"broken")
    events(spark, given, (2, 2, 1))
    run()  # a batch does not read its own earlier try
    events(spark, given, (3, 3, 1))
    (state / "batch=0" / "part-1.parquet").write_bytes(b"broken")
    with pytest.raises(Exception, match="."):
        run()


def test_sources_in_one_scan(spark):
    df = spark.createDataFrame([(1, "b", " "), (2, "a", "t"), (3, None, None), (4, "b", "u")], "id int, source string, search_term string")
    names = ["a", "b", None]
    want = unify({n: df.where(F.col("source").eqNullSafe(F.lit(n))) for n in names}, "none").select("id", "source", "source_rank", "search_term")
    got = ranked_sources(df, "none").select("id", "source", "source_rank", "search_term")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_places_in_orders(spark):
    df = spark.createDataFrame([(i, ("apply_now", "review")[i % 2], i * 7 % 10, None if i % 5 == 0 else f"2024-01-{1 + i % 9:02d}", "Firm " + "aBcD"[i % 4]) for i in range(60)], "row_id long, action string, priority int, created string, company string")
    sort = lambda name: [r["row_id"] for r in df.orderBy(*reports.order_by(name)).collect()]
    orders = {n: {r: k + 1 for k, r in enumerate(sort(n))} for n in ("priority", "created", "company")}
    got = {r["row_id"]: r for r in reports.places(df, tuple(orders), 12).collect()}
    assert set(got) == set(sort("priority")[:12])
    assert all(r[f"by_{n}"] == orders[n][i] for i, r in got.items() for n in orders)
    assert reports.places(df.limit(0), tuple(orders), 12).count() == 0


def test_two_lists_part_at_a_step(spark):
    df = spark.range(6)
    a = [("even", F.col("id") % 2 == 0), ("small", F.col("id") < 4)]
    b = [("small", F.col("id") < 5), ("even", F.col("id") % 2 == 0)]
    assert {tuple(r) for r in cascade.differing(df, a, b).collect()} == {("small", "", 1)}
    assert cascade.differing(df, a, a).count() == 0
