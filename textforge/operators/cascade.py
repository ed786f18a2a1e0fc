"""One ordered list of predicates: the filter, the first failing step and the impact reports all come from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textforge.functions import text as T
from textforge.functions import urls as U
from textforge.operators import classify as C
from textforge.operators import language as L
from textforge.rulepack import RulePack


def steps(pack: RulePack) -> list[tuple[str, Column]]:
    """(name, passes) in order, over columns of scored()."""
    text, title = C.text(), F.col("title_n")
    hard, _ = C.excluded(title, C.bare(), pack)
    out = [
        ("description_short", F.length("plain") >= pack.min_description),
        ("bad_title", ~T.contains_any(title, pack.bad_titles)),
        ("not_recent", U.is_recent(F.col("created"), pack.as_of, pack.max_age_days)),
        ("location", C.location_ok(F.col("loc_n"), title, F.col("desc_n"), F.col("work_mode").isin("remote", "hybrid"), pack)),
        ("role", C.role_relevant(title, pack)),
        ("student_internship", ~C.student_only(text, pack)),
    ]
    if pack.market in ("ma", "fixture"):
        out.append(("generic_internship", ~T.any_hit(text, pack.internship_markers)))
    blocked = F.col("language_label") == "required" if pack.mode == "broad" else F.col("language_label").isin("required", "alternative")
    out += [
        ("excluded_word", F.size(hard) == 0),
        ("experience", F.col("experience_level") != "hard"),
        ("blocked_language", ~blocked),
    ]
    if pack.blocked_codes and pack.mode == "strict":
        out.append(("detected_language", ~L.blocked_text(F.col("plain"), C.language, pack.blocked_codes)))
    out += [
        ("junior_score", F.col("junior_score") >= (-1 if pack.mode == "broad" else 0)),
    ]
    return out


#: What a cascade runs: a pack's steps, or a list of them such as market.steps().
Steps = RulePack | list[tuple[str, Column]]


def _steps(given: Steps) -> list[tuple[str, Column]]:
    return steps(given) if isinstance(given, RulePack) else given


def first_fail(pack: Steps) -> Column:
    """The name of the first step that fails, or empty."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in _steps(pack)], F.lit(""))


def attributed(df: DataFrame, pack: Steps) -> DataFrame:
    return df.withColumn("first_fail", first_fail(pack))


def keep(df: DataFrame, pack: Steps) -> DataFrame:
    """Rows that pass every step, as one conjunction: cheap, prunable tests come first."""
    for _, ok in _steps(pack):
        df = df.where(ok)
    return df


def passes(pack: Steps) -> Column:
    """Whether a row passes every step, as one conjunction: what keep() filters by."""
    return reduce(lambda a, b: a & b, [F.coalesce(ok, F.lit(False)) for _, ok in _steps(pack)])


def near_misses(df: DataFrame, pack: RulePack) -> DataFrame:
    """Rows that fail the location step alone and have enough priority without sponsorship."""
    for name, ok in steps(pack.with_mode("strict")):
        df = df.where(~ok if name == "location" else ok)
    plain = F.col("priority") - F.col("sponsorship_score") * pack.sponsor_factor - F.least(F.lit(5), F.col("company_signal"))
    return df.withColumn("priority", plain.cast("int")).where(F.col("priority") >= pack.near_miss_min).withColumn("near_miss_reason", F.lit("location_only"))


def funnel(df: DataFrame, pack: Steps, by: tuple[str, ...] = ()) -> DataFrame:
    """step_no, step, before, removed, kept for each step in order, and for each group of the columns `by`: one pass, then sums over the few steps."""
    names = [name for name, _ in _steps(pack)]
    counts = attributed(df, pack).groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("first_fail") == n).alias(n) for n in names])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step_no"), F.lit(n).alias("step"), F.col(n).alias("removed"), F.col("total")) for i, n in enumerate(names)])
    out = counts.select(*by, F.inline(rows))
    gone = F.sum("removed").over(Window.partitionBy(*by).orderBy("step_no").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("kept", F.col("total") - gone).select(*by, "step_no", "step", (F.col("kept") + F.col("removed")).alias("before"), "removed", "kept")


def independent_impact(df: DataFrame, pack: Steps) -> DataFrame:
    """step, removed: rows that each step would remove on its own; all in one pass."""
    own = _steps(pack)
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(n) for n, ok in own])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("step"), F.col(n).alias("removed")) for n, _ in own])))


def global_hits(df: DataFrame, pack: RulePack) -> DataFrame:
    """word, n: rows that hit each excluded word, without stopping at the first."""
    return df.select(F.explode(T.hits(F.col("text_n"), pack.exclude)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def replay_steps(pack: RulePack) -> list[tuple[str, Column]]:
    """The list that reports replay: without general internships and experience, blind to the mode where a language is asked for, which counts again with the language found."""
    own, strict = dict(steps(pack)), dict(steps(pack.with_mode("strict")))
    asked = strict["blocked_language"]
    found = own.get("detected_language", F.lit(True))
    told = {**own, "blocked_language": asked, "detected_language": asked & found}
    return [(n, told[n]) for n in ("description_short", "bad_title", "not_recent", "location", "role", "student_internship", "excluded_word", "blocked_language", "detected_language", "junior_score")]


def differing(df: DataFrame, a: Steps, b: Steps) -> DataFrame:
    """step_a, step_b, n: rows that one list of steps keeps and the other does not, by the step where each list first fails them; empty where it keeps them."""
    told = df.select(first_fail(a).alias("step_a"), first_fail(b).alias("step_b")).where((F.col("step_a") == "") != (F.col("step_b") == ""))
    return told.groupBy("step_a", "step_b").agg(F.count("*").alias("n"))


#: How a reason is triaged: (beginning of the reason, hard exclusion, review reason). Fixed order.
TRIAGE = (
    ("description_short", False, "insufficient_text"), ("bad_title", True, ""), ("not_recent", True, ""), ("location", False, "check_location"),
    ("role", True, ""), ("student_internship", True, ""), ("generic_internship", False, "check_internship"), ("excluded_word", True, ""),
    ("experience", False, "check_experience"), ("blocked_language", False, "check_language"), ("detected_language", False, "check_language"),
    ("junior_score", False, "check_seniority"),
)


def triage(df: DataFrame) -> DataFrame:
    """split (apply_ready, manual_review or hard_excluded) and review_reason from first_fail."""
    hard = F.coalesce(*[F.when(F.startswith("first_fail", F.lit(p)), F.lit(h)) for p, h, _ in TRIAGE], F.lit(False))
    review = F.coalesce(*[F.when(F.startswith("first_fail", F.lit(p)), F.lit(r)) for p, _, r in TRIAGE], F.lit(""))
    split = F.when(F.col("first_fail") == "", "apply_ready").when(hard, "hard_excluded").otherwise("manual_review")
    return df.withColumn("split", split).withColumn("review_reason", review)
