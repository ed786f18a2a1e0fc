"""Bounded integer scores of a posting with features()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textforge.functions import text as T
from textforge.functions import urls as U
from textforge.operators import classify as C
from textforge.rulepack import RulePack


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def junior(text: Column | T.Seen, pack: RulePack) -> Column:
    """Substrings, so one word may count for several."""
    return 2 * T.count_substrings(text, pack.junior_plus) - 2 * T.count_substrings(text, pack.junior_minus) - T.count_substrings(text, pack.junior_mild)


def hiring(text: Column | T.Seen, level: Column, language_label: Column, pack: RulePack) -> Column:
    plus = sum((T.keyword_hit(text, w).cast("int") for w in pack.hiring_plus), F.lit(0))
    minus = sum((T.keyword_hit(text, w).cast("int") for w in pack.hiring_minus), F.lit(0))
    language = F.when(language_label == "required", -6).when(language_label.isin("alternative", "plus"), -2).otherwise(0)
    return clamp(2 * plus - 2 * minus + F.when(level == "soft", 2).otherwise(0) + language, -20, 20)


def language_fit(text: Column, label: Column) -> Column:
    return F.when(label == "required", 0).when(label == "plus", 1).when(text != "", 2).otherwise(0)


def sponsorship(text: Column | T.Seen, pack: RulePack) -> Column:
    """Positive phrases count only where no negative one stands."""
    minus = T.count_substrings(text, pack.sponsor_minus)
    return clamp(F.when(minus > 0, -8 * minus).otherwise(5 * T.count_substrings(text, pack.sponsor_plus)), -10, 10)


def company_signal(company: Column, pack: RulePack) -> Column:
    return F.when(T.contains_any(T.normalise(company), pack.sponsor_companies), 3).otherwise(0)


def scored(df: DataFrame, pack: RulePack) -> DataFrame:
    """df, which has features(), with `seen`, every label and score; priority is the sum that ranks."""
    df, text = C.looked(df, pack), C.text()
    label, confidence = C.language_requirement(text, pack)
    name, signals = C.track(F.col("title_n"), pack)
    df = C.computed(df, {
        "work_mode": C.work_mode(text, pack), "experience_level": C.experience_level(text, pack), "language_label": label,
        "language_confidence": confidence, "track": name, "track_signals": signals,
    })
    df = C.computed(df, {
        "junior_score": junior(text, pack), "hiring_score": hiring(text, F.col("experience_level"), F.col("language_label"), pack),
        "language_fit": language_fit(F.col("text_n"), F.col("language_label")), "sponsorship_score": sponsorship(text, pack), "company_signal": company_signal(F.col("company"), pack),
    })
    bonus = sum((F.when(F.col("track") == t, b).otherwise(0) for t, b in pack.track_bonus), F.lit(0))
    terms = sum((F.when(T.contains(text, t), w).otherwise(0) for t, w in pack.term_weights), F.lit(0))
    mode = F.when(F.col("work_mode") == "remote", 5).when(F.col("work_mode") == "hybrid", 3).otherwise(0)
    priority = (
        50 + 2 * F.greatest(F.lit(0), F.col("junior_score")) + 2 * F.col("language_fit") + clamp(F.col("hiring_score"), -4, 6)
        + F.col("sponsorship_score") * pack.sponsor_factor + F.least(F.lit(5), F.col("company_signal")) + bonus + terms + mode + U.age_points(F.col("created"), pack.as_of)
    )
    return df.withColumn("priority", priority.cast("int"))
