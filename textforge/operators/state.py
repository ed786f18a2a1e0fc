"""State between runs: tracker, alerts, lookups. Each step returns a new table; none overwrites its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textforge.operators.dedup import keep_first

STATUSES = ("to_apply", "saved", "applied", "interview", "offer", "rejected", "withdrawn", "not_interested")


def valid_status(status: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(s.isin(*STATUSES), s).otherwise("to_apply")


def sync_tracker(jobs: DataFrame, tracker: DataFrame, now: str) -> DataFrame:
    """One row for each job: its attributes are new, status and dates kept; first_seen is set once, last_seen now. Absent jobs leave."""
    old = keep_first(tracker, ["job_id"], [F.desc_nulls_last("last_seen")]).select("job_id", "status", "applied_date", "notes", "first_seen")
    return jobs.drop("status", "applied_date", "notes", "first_seen").join(old, "job_id", "left").withColumns({
        "status": valid_status(F.col("status")), "first_seen": F.coalesce("first_seen", F.lit(now)), "last_seen": F.lit(now),
    })


def update_tracker(tracker: DataFrame, job_id: str, status: str, now: str, note: str = "", applied_date: str = "") -> DataFrame:
    """One job's status; 'applied' stamps the date unless one is given; a note is appended after ` | `."""
    if status not in STATUSES:
        raise ValueError(f"status {status!r} is none of {', '.join(STATUSES)}")
    here = F.col("job_id") == job_id
    date = F.lit(applied_date) if applied_date else F.coalesce("applied_date", F.lit(now[:10])) if status == "applied" else F.col("applied_date")
    notes = F.concat_ws(" | ", F.when(F.col("notes") != "", F.col("notes")), F.lit(note)) if note else F.col("notes")
    return tracker.withColumns({"status": F.when(here, status).otherwise(F.col("status")), "applied_date": F.when(here, date).otherwise(F.col("applied_date")), "notes": F.when(here, notes).otherwise(F.col("notes"))})


def tracker_order() -> list[Column]:
    """Last seen, first seen, priority and date, the latest and greatest first; the job's id makes it total."""
    return [F.desc_nulls_last("last_seen"), F.desc_nulls_last("first_seen"), F.desc_nulls_last("priority_score"), F.desc_nulls_last("created"), F.asc("job_id")]


def show_tracker(tracker: DataFrame, status: str = "", most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(status, n) by frequency, and the first rows of the tracker, of one status if it is given."""
    counts = tracker.groupBy(valid_status(F.col("status")).alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")
    rows = tracker.where(valid_status(F.col("status")) == status) if status else tracker
    return counts, rows.orderBy(*tracker_order()).limit(most)


def new_alerts(queue: DataFrame, alerted: DataFrame, key: str = "job_id") -> DataFrame:
    return queue.join(alerted.select(key), key, "left_anti")


def alert_state(alerted: DataFrame, queue: DataFrame, key: str = "job_id") -> DataFrame:
    return alerted.select(key).union(queue.select(key)).distinct()


def drop_either_key(df: DataFrame, gone: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """Rows none of whose keys is among gone's: an anti join for each, not one with OR."""
    out = df
    ids = gone.select(F.explode(F.array(*keys)).alias("_id")).where("_id <> ''").distinct()
    for k in keys:
        out = out.join(ids, out[k] == ids["_id"], "left_anti")
    return out


def first_valid(df: DataFrame, key: str, urls: Column, cache: DataFrame, order: str) -> DataFrame:
    """key, url, text: the first of each row's candidate urls that the cache (url, text) has a text for; of several texts the last by order."""
    tries = df.select(key, F.posexplode(urls).alias("pos", "url"))
    found = tries.join(keep_first(cache.where("text <> ''"), ["url"], [F.desc_nulls_last(order)]).select("url", "text"), "url")
    return found.groupBy(key).agg(F.min(F.struct("pos", "url", "text")).alias("m")).select(key, F.col("m.url").alias("url"), F.col("m.text").alias("text"))


def last_known(rows: DataFrame, known: DataFrame, column: str, order: str, keys: tuple[str, str] = ("canonical_url", "url")) -> DataFrame:
    """rows with the column of the last known row of the same key: the first of keys that is not blank, else the second."""
    key = lambda: F.coalesce(F.when(F.trim(keys[0]) != "", F.trim(keys[0])), F.trim(keys[1]))
    last = known.select(key().alias("_key"), order, column).where("_key <> ''").groupBy("_key").agg(F.max_by(column, order).alias(column))
    return rows.withColumn("_key", key()).join(last, "_key", "left").drop("_key")


def union_distinct(tables: list[DataFrame], key: str, order: str) -> DataFrame:
    """The rows of the tables, one for each key: that of the first table that has it, there the first by order. An empty key is one too."""
    tagged = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(tables)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    return keep_first(whole.withColumn("_key", F.coalesce(key, F.lit(""))), ["_key"], ["_table", order]).drop("_key", "_table")


def overlay(base: DataFrame, detail: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with each column taken from detail where that is not blank."""
    d = detail.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = base.join(d, key, "left")
    return out.withColumns({c: F.coalesce(F.when(F.trim(f"_{c}") != "", F.col(f"_{c}")), F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])
