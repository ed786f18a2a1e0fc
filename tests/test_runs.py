"""Runs from raw rows to alerts; companies and texts are invented."""

import pytest
from pyspark.sql import functions as F

from textforge import runs
from textforge.markets import MARKETS
from textforge.operators import state
from textforge.sources import store

PACKS = [MARKETS["be"], MARKETS["ma"]]
FILL = "We keep things in good order, mostly with Kubernetes and Linux, and like to work in small groups every day of the week. "


def raw(spark, *rows):
    """Rows of (market, title, company, location, url, description, created)."""
    df = spark.createDataFrame(list(rows), "market string, title string, company string, location string, url string, description string, created string")
    return df.withColumns({"search_term": F.lit("devops"), "source": F.lit("one")})


def day_one(spark):
    return raw(
        spark, ("be", "Junior DevOps engineer", "Hillside", "Gent", "https://x.example/details/1?a=1", FILL, "2024-02-27T08:00:00Z"), ("be", "Junior DevOps engineer", "Hillside", "Gent", "https://x.example/details/1?a=2", FILL, "2024-02-27T08:00:00Z"),
        ("ma", "Cloud engineer", "Marble", "Rabat", "https://x.example/2", FILL, "2024-02-26"), ("ma", "Cloud engineer", "Lowland", "Lyon", "https://x.example/3", FILL, "2024-02-26"), ("be", "Clerk", "Marble", "", "https://x.example/4", FILL, "2024-02-26"),
        ("be", "Cloud engineer", "Quarry", "", "https://x.example/5", FILL + "Dutch is mandatory.", "2024-02-26"), ("be", "Cloud engineer", "Quarry", "", "https://x.example/6", FILL, "no date"),
    )


def test_two_days(spark, tmp_path):
    root = f"file://{tmp_path}/run"
    one = runs.daily_run(runs.with_ids(day_one(spark)), PACKS, root, "2024-03-01 00:00:00")
    assert one == {"strict": 2, "broad": 3, "near_miss": 0, "queue": 2, "alerts": 1}
    strict = spark.read.parquet(f"{root}/2024-03-01/filtered/filter_mode=strict")
    assert len(strict.columns) == 30 and {r["title"] for r in strict.collect()} == {"Junior DevOps engineer", "Cloud engineer"}
    assert {r["fail_strict"] for r in spark.read.parquet(f"{root}/2024-03-01/first_fail").collect()} == {"", "location", "role", "blocked_language", "not_recent"}
    more = raw(spark, ("be", "Junior DevOps administrator", "Orchard", "", "https://x.example/9", FILL, "2024-03-01")).union(day_one(spark))
    assert runs.daily_run(runs.with_ids(more), PACKS, root, "2024-03-02 00:00:00") == {"strict": 3, "broad": 4, "near_miss": 0, "queue": 3, "alerts": 1}
    tracker = spark.read.parquet(f"{root}/tracker/{store.Manifest(spark, root + '/tracker').read()[1]['all']}")
    seen = {r["company"]: (r["first_seen"], r["last_seen"], r["status"]) for r in tracker.collect()}
    assert seen["Hillside"] == ("2024-03-01 00:00:00", "2024-03-02 00:00:00", "to_apply") and seen["Orchard"][0] == "2024-03-02 00:00:00"
    counts, first = state.show_tracker(tracker, most=2)
    assert [tuple(r) for r in counts.collect()] == [("to_apply", 3)] and first.count() == 2 and state.show_tracker(tracker, "saved")[1].count() == 0


def test_queue_knows_outcomes_and_focus(spark, tmp_path):
    root = f"file://{tmp_path}/run"
    assert runs.filter_run(runs.with_ids(day_one(spark)), PACKS, "2024-03-01 00:00:00", root, near_min=60)["near_miss"] == 1
    kept = spark.read.parquet(f"{root}/filtered").where("filter_mode = 'strict'")
    tracker = runs.tracker_run(kept, spark.createDataFrame([], "job_id string, status string, applied_date string, notes string, first_seen string, last_seen string"), "t1")
    told = tracker.withColumn("status", F.when(F.col("company") == "Hillside", "applied").otherwise(F.col("status")))
    assert {r["company"] for r in runs.queue_run(kept, told, PACKS).collect()} == {"Marble"}
    assert {r["company"] for r in runs.queue_run(kept, told, PACKS, closed=True).collect()} == {"Marble", "Hillside"}
    assert {r["company"] for r in runs.queue_run(kept, tracker, PACKS, focus="Rabat").collect()} == {"Marble"} and runs.queue_run(kept, tracker, PACKS, focus="Tanger").count() == 0


def test_merge_takes_the_best(spark):
    schema = "title string, company string, location string, url string, description string, created string, salary_min double, search_term string"
    a = spark.createDataFrame([("DevOps engineer", "Hillside", "Gent", "u1", "same size", "2024-01-01", None, ""), ("Cook", "Inn", "Gent", "u2", "same size", "2024-01-01", None, "t")], schema)
    b = spark.createDataFrame([("DevOps engineer", "Hillside", "Gent", "u1", "same size", "2024-01-01", 9.0, ""), ("Cook", "Inn", "Gent", "u3", "same size", "2024-01-01", None, ""), ("Engineer DevOps", "Hillside", "Gent", "", "short", None, None, "")], schema)
    out = {r["title"]: r for r in runs.merge_run({"first": a, "second": b}, "devops").collect()}
    assert set(out) == {"DevOps engineer", "Cook"} and out["DevOps engineer"]["salary_min"] == 9.0 and out["Cook"]["source"] == "first" and out["DevOps engineer"]["search_term"] == "devops"


def test_command_line(spark, tmp_path):
    folder = str(tmp_path / "raw.parquet")
    day_one(spark).write.parquet(folder)
    made = runs.main([str(tmp_path / "none.csv"), folder, "--root", f"file://{tmp_path}/out", "--as-of", "2024-03-01 00:00:00"])
    assert made["strict"] == 2
    with pytest.raises(SystemExit):
        runs.main([str(tmp_path / "none.csv"), "--root", "x"])
    with pytest.raises(ValueError):
        runs.main([folder, "--root", "x", "--market", "zz"])
