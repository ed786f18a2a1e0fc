"""What a user starts: filter raw postings, merge sources, build the queue, keep the tracker, tell what is new.

Each run reads tables and writes others, none in place; a market's tables are named by markets.outputs(). Markets are
judged together, so one run can take a table of all of them.
"""

from __future__ import annotations

import argparse
import datetime
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge import markets, vocabularies
from textforge.functions import urls as U
from textforge.operators import cascade, dedup, gates, langid, market, queue, rules, state
from textforge.sources import store
from textforge.sources.tables import canonical, read_csv, unify

def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A raw table, CSV or Parquet by its name, in the canonical columns; a missing one is empty."""
    return canonical(read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path), ("market", "source"))


def with_ids(df: DataFrame, market_name: str = "") -> DataFrame:
    """Raw rows with what the rules need: row_id, the row's market, the date as a time. Rows of one text and place in the same order get the same ids again."""
    own = ["url", "title", "company", "location", "description", "created", "search_term"]
    named = df if "market" in df.columns else df.withColumn("market", F.lit(market_name))
    named = named if "source" in named.columns else named.withColumn("source", F.lit(""))
    return named.withColumn("row_id", F.xxhash64(*own)).withColumn("created", F.try_to_timestamp("created"))


def judged(df: DataFrame, r: rules.Rules, as_of: str, profiles: langid.Profiles | None) -> DataFrame:
    """with_ids() rows with every label and score, and the first step that each mode fails."""
    out = market.scored(market.labelled(r.read(df), r, profiles), r, as_of)
    return out.withColumns({f"fail_{m}": cascade.first_fail(market.steps(r, as_of, m)) for m in markets.MODES})


def filter_run(raw: DataFrame, packs: Sequence[markets.Market], as_of: str, out: str, profiles: langid.Profiles | None = None, near_min: int = 68) -> dict[str, int]:
    """Filters raw postings in both modes, judging each row once: out/filtered by mode, out/near_miss, out/first_fail. The rows of each."""
    r = rules.of(packs, vocabularies.EXCLUDED_EXCEPTIONS)
    rows = judged(raw, r, as_of, profiles or langid.built_in()).persist(StorageLevel.DISK_ONLY)
    made: dict[str, int] = {}
    for m in markets.MODES:
        kept = market.filtered(rows.where(F.col(f"fail_{m}") == ""), m, F.col("source"))
        kept = dedup.keep_first(kept, ["canonical_url", "title", "company"], ["row_id"])
        kept.write.mode("overwrite").parquet(f"{out}/filtered/filter_mode={m}")
        made[m] = raw.sparkSession.read.parquet(f"{out}/filtered/filter_mode={m}").count()
    near = market.near_misses(rows, r, as_of, near_min).select("row_id", "market", "title", "company", "location", "created", "url", "priority", "near_miss_reason")
    near.write.mode("overwrite").parquet(f"{out}/near_miss")
    rows.select("row_id", "market", "title", "company", "url", *[f"fail_{m}" for m in markets.MODES]).write.mode("overwrite").parquet(f"{out}/first_fail")
    made["near_miss"] = raw.sparkSession.read.parquet(f"{out}/near_miss").count()
    rows.unpersist()
    return made


def merge_run(sources: Mapping[str, DataFrame], default_term: str = "") -> DataFrame:
    """Raw tables of several sources, by name in the order of preference, as one: the best row of each posting by URL, then by key, then by likeness."""
    whole = with_ids(unify({n: canonical(d, ("market",)) for n, d in sources.items()}, default_term))
    return dedup.fuzzy_best(dedup.by_canonical_key(dedup.by_url(whole)))


def queue_run(kept: DataFrame, tracker: DataFrame, packs: Sequence[markets.Market], most: int = 20, cap: int = 3, apply_min: int = 68, closed: bool = False, focus: str = "") -> DataFrame:
    """The ranked queue of filtered rows: the tracker's status, feedback from its outcomes, gates, places in focus, few rows of a company."""
    r = rules.of(packs, vocabularies.EXCLUDED_EXCEPTIONS)
    df = kept.withColumnsRenamed({"language_fit_score": "language_fit", "hiring_likelihood_score": "hiring_score", "priority_score": "priority"})
    df = df.withColumn("job_id", U.job_id(F.col("canonical_url"), F.col("title"), F.col("company")))
    known = dedup.keep_first(tracker, ["job_id"], [F.desc_nulls_last("last_seen")]).select("job_id", F.col("status").alias("_status"))
    df = df.join(known, "job_id", "left").withColumn("status", state.valid_status(F.col("_status"))).drop("_status")
    if focus:
        strict = next((p for p in packs if p.clusters), packs[0])
        df = df.where(gates.in_focus(F.col("location"), F.col("is_remote"), focus, strict))
    df = gates.gated(queue.feedback_scored(df, tracker), r, apply_min)
    df = df if closed else df.where(~F.col("status").isin(*queue.CLOSED))
    return queue.capped(df, cap).orderBy(*queue.order()).limit(most)


def tracker_run(kept: DataFrame, tracker: DataFrame, now: str) -> DataFrame:
    """The tracker with this run's postings."""
    jobs = kept.withColumn("job_id", U.job_id(F.col("canonical_url"), F.col("title"), F.col("company")))
    return state.sync_tracker(dedup.keep_first(jobs, ["job_id"], ["row_id"]), tracker, now)


def alert_run(queued: DataFrame, root: str, now: str) -> DataFrame:
    """Rows to apply to now that no earlier run has told; their ids are kept in a cache below root."""
    told = store.Cache(queued.sparkSession, root, "job_id string, last_run string", "job_id", buckets=16)
    fresh = state.new_alerts(queued.where((F.col("action") == "apply_now") & F.col("status").isin("to_apply", "saved")), told.read()).persist()
    fresh.count()
    told.upsert(fresh.select("job_id", F.lit(now).alias("last_run")), "last_run")
    return fresh


def daily_run(raw: DataFrame, packs: Sequence[markets.Market], root: str, as_of: str) -> dict[str, int]:
    """One day: filter, tracker, queue, alerts, each in a folder of the day below root; the tracker of the day before is read from the last commit."""
    spark, day = raw.sparkSession, as_of[:10]
    made = filter_run(raw, packs, as_of, f"{root}/{day}")
    kept = spark.read.parquet(f"{root}/{day}/filtered").where("filter_mode = 'strict'")
    places = store.Manifest(spark, f"{root}/tracker")
    seen, parts = places.read()
    schema = "job_id string, title string, company string, search_term string, status string, applied_date string, notes string, first_seen string, last_seen string"
    tracker = spark.read.parquet(f"{root}/tracker/{parts['all']}") if parts else spark.createDataFrame([], schema)
    tracker_run(kept, tracker, as_of).write.mode("overwrite").parquet(f"{root}/tracker/data/{day}-{seen}")
    places.commit(seen, {"all": f"data/{day}-{seen}"})
    tracker = spark.read.parquet(f"{root}/tracker/data/{day}-{seen}")
    queue_run(kept, tracker, packs).write.mode("overwrite").parquet(f"{root}/{day}/queue")
    queued = spark.read.parquet(f"{root}/{day}/queue")
    made["queue"] = queued.count()
    made["alerts"] = alert_run(queued, f"{root}/alerted", as_of).count()
    return made


def main(arguments: Sequence[str] | None = None) -> dict[str, int]:
    """python -m textforge.runs: one day's run of a market, or of all markets that the rows name."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("input", nargs="+", help="raw tables (CSV or Parquet); the newest that has rows is taken")
    p.add_argument("--root", required=True, help="where the tables go")
    p.add_argument("--market", default="", help="market of rows that name none")
    p.add_argument("--focus", default="", help="region of market ch")
    p.add_argument("--job-mode", default="", help="strict or speed")
    p.add_argument("--as-of", default=datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%d %H:%M:%S"), help="the time of the run")
    given = p.parse_args(arguments)
    spark = SparkSession.builder.appName("textforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    pack, _ = markets.resolve(given.market, given.focus, job_mode=given.job_mode)
    path = store.newest(spark, given.input)
    if path is None:
        raise SystemExit("no input has rows")
    packs = [pack, *(m for n, m in markets.MARKETS.items() if n != pack.name)]
    made = daily_run(with_ids(read_raw(spark, path), pack.name), packs, given.root, given.as_of)
    print(", ".join(f"{k}: {n}" for k, n in made.items()))
    return made


if __name__ == "__main__":
    main()
