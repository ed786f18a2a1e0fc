"""The ranked queue: feedback from outcomes, recommended action, cap for each company, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textforge.functions import text as T
from textforge.functions import urls as U
from textforge.operators.scoring import clamp
from textforge.rulepack import RulePack

#: What an outcome says about its company and term. Fixed values.
OUTCOME = {"offer": 4, "interview": 3, "applied": 1, "rejected": -3, "not_interested": -2, "withdrawn": -2}
CLOSED = ("applied", "interview", "offer", "rejected", "withdrawn", "not_interested")


def outcome_weight(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, F.lit(w)) for s, w in OUTCOME.items()], F.lit(0))


def feedback_map(df: DataFrame, key: str) -> DataFrame:
    """key, feedback: the half-even rounded mean of the non-zero weights, within 4 of zero."""
    w = outcome_weight(F.col("status"))
    return df.withColumn("w", w).where("w <> 0").groupBy(key).agg(clamp(F.bround(F.avg("w"), 0).cast("int"), -4, 4).alias("feedback"))


def feedback_scored(df: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """df with feedback_score, company's plus term's, within 6 of zero. history (default df) has the outcomes; maps below Spark's size limit are broadcast."""
    history = df if history is None else history
    company = feedback_map(history, "company").withColumnRenamed("feedback", "by_company")
    term = feedback_map(history, "search_term").withColumnRenamed("feedback", "by_term")
    both = F.coalesce("by_company", F.lit(0)) + F.coalesce("by_term", F.lit(0))
    return df.join(company, "company", "left").join(term, "search_term", "left").withColumn("feedback_score", clamp(both, -6, 6)).drop("by_company", "by_term")


def queue_adjustment(title: Column, pack: RulePack) -> Column:
    """-10 for each class of title that is not aimed at, at least -30."""
    return F.greatest(F.lit(-30), -10 * T.count_substrings(title, pack.role_forbidden)).cast("int")


def recommended(df: DataFrame, pack: RulePack) -> DataFrame:
    adjusted = F.col("priority") + F.col("feedback_score") + queue_adjustment(F.col("title_n"), pack)
    df = df.withColumn("adjusted", adjusted.cast("int"))
    return df.withColumn("action", F.when(F.col("adjusted") < pack.apply_min, "review").otherwise("apply_now"))


def order() -> list[Column]:
    return [F.desc((F.col("action") == "apply_now").cast("int")), F.desc("adjusted"), F.desc("sponsorship_score"), F.desc("hiring_score"), F.desc("language_fit"), F.desc("junior_score"), F.desc_nulls_last("created"), F.asc("row_id")]


def capped(df: DataFrame, cap: int) -> DataFrame:
    """The first rows of each company; a task keeps no more than the cap of a company before the shuffle."""
    w = Window.partitionBy(T.company_key(F.col("company"))).orderBy(*order())
    return df.withColumn("company_rank", F.row_number().over(w)).where(F.col("company_rank") <= cap)


def queue(df: DataFrame, pack: RulePack, closed: bool = False) -> DataFrame:
    df = df if closed else df.where(~F.col("status").isin(*CLOSED))
    return capped(df, pack.company_cap).orderBy(*order()).limit(pack.queue_size).withColumn("job_id", U.job_id(F.col("url"), F.col("title"), F.col("company")))


def page_advice(raw: Column, kept: Column, pages: Column) -> tuple[Column, Column]:
    """(recommendation, suggested pages) of a search term from what it brought."""
    rate = F.when(raw > 0, 100.0 * kept / raw).otherwise(0.0)
    label = F.when(raw < 8, "insufficient_data").when(kept == 0, "drop").when((rate < 5) & (kept <= 1), "decrease").when((rate >= 22) & (kept >= 6), "increase").otherwise("keep")
    count = F.when(label == "drop", 1).when(label == "decrease", F.greatest(F.lit(1), pages - 1)).when(label == "increase", F.least(F.lit(8), pages + 1)).otherwise(pages)
    return label, count.cast("int")


def term_yield(df: DataFrame, kept: Column, pages: int = 3) -> DataFrame:
    """search_term, counts, rates and advice in one pass over df, which has priority and junior_score; kept tells the rows that stay."""
    of_kept = lambda c: F.avg(F.when(F.col("_kept"), F.col(c)))
    df = df.withColumn("_kept", kept).groupBy("search_term").agg(
        F.count("*").alias("raw_count"), F.count_if("_kept").alias("kept_count"), F.bround(of_kept("priority"), 1).alias("avg_priority"), F.bround(of_kept("junior_score"), 2).alias("avg_junior")
    )
    share = 100.0 * F.col("kept_count") / F.sum("kept_count").over(Window.partitionBy())
    label, suggested = page_advice(F.col("raw_count"), F.col("kept_count"), F.lit(pages))
    rate = F.when(F.col("raw_count") > 0, 100.0 * F.col("kept_count") / F.col("raw_count")).otherwise(0.0)
    return df.select(
        "search_term", "raw_count", "kept_count", (F.col("raw_count") - F.col("kept_count")).alias("filtered_out"), F.bround(rate, 2).alias("keep_rate"),
        F.bround(F.coalesce(share, F.lit(0.0)), 2).alias("share_of_kept"), "avg_priority", "avg_junior", label.alias("recommendation"), suggested.alias("suggested_pages"),
    )
