"""The whole rule set over rows of many markets: labels, the cascade's steps, scores, near misses and the recheck.

Rows are read once by Rules.read(); everything here is a column over what that found, so one plan filters, scores and
triages a table of mixed markets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textforge import vocabularies as V
from textforge.functions import text as T
from textforge.functions import urls as U
from textforge.operators import language as L
from textforge.operators import langid, roles
from textforge.operators.classify import computed
from textforge.operators.rules import Rules
from textforge.operators.scoring import clamp

LANGUAGES = L.LanguageRules()


def work_mode(r: Rules) -> Column:
    hybrid, remote, onsite = (r.has("work", n) for n in ("hybrid_terms", "remote_terms", "onsite_terms"))
    return F.when(hybrid | (remote & onsite), "hybrid").when(remote, "remote").when(onsite, "onsite").otherwise("unknown")


def location_ok(r: Rules) -> Column:
    """No blocked place; in a market with the foreign rule, remote work and all work where places are free must not be abroad only; else an allowed place, if any is named."""
    abroad = r.has("every", "foreign_places") & ~r.has("every", "allowed_places")
    free = r.of("foreign_rule") & (F.col("work_mode").isin("remote", "hybrid") | ~r.of("enforce_places"))
    allowed = (F.size(r.of("allowed_places")) == 0) | (F.col("loc_n") == "") | r.has("loc", "allowed_places")
    return ~r.has("place", "blocked_places") & F.when(free, ~abroad).when(~r.of("enforce_places"), True).otherwise(allowed)


def track(r: Rules) -> Column:
    """Struct of the first track with words in the text, and up to four of them."""
    found = F.col("found.text")
    options = []
    for name, words in r.packs[0].tracks:
        hits = F.array_intersect(T.constant(r.book.ids("word", words), "array<int>"), found)
        options.append(F.when(F.size(hits) > 0, F.struct(F.lit(name).alias("track"), r.words(F.slice(hits, 1, 4), name).alias("signals"))))
    return F.coalesce(*options, F.struct(F.lit("other_it").alias("track"), F.array().cast("array<string>").alias("signals")))


def labelled(df: DataFrame, r: Rules, profiles: langid.Profiles | None = None) -> DataFrame:
    """df, which Rules.read() made, with work_mode, role_step, forbidden, student, general, level, need, hard, soft, track, detected.

    Without profiles no text's language is identified, and no row fails for it.
    """
    text = F.col("text_n")
    df = df.withColumn("asked", roles.years_required(text))
    student, general = roles.internship_details(r)
    df = computed(df, {"forbidden": roles.forbidden_reason(r)})
    df = computed(df, {
        "work_mode": work_mode(r), "role_step": roles.role_step(r, F.col("forbidden")), "student": student, "general": general,
        "level": roles.experience(r, F.col("asked")), "need": L.language_need(text, LANGUAGES, r.of("blocked_codes")), "_track": track(r),
    })
    hard, soft = roles.excluded(r, F.col("level.years"))
    detected = langid.language(F.concat_ws(" ", T.blank_null(F.col("plain_title")), T.blank_null(F.col("plain"))), profiles) if profiles else F.lit("")
    return computed(df, {"hard": hard, "soft": soft, "detected": detected}).withColumns({"track": F.col("_track.track"), "track_signals": F.col("_track.signals")}).drop("_track")


def junior_score(r: Rules) -> Column:
    return 2 * r.count("text", "junior_plus") - 2 * r.count("text", "junior_minus") - r.count("text", "junior_mild")


def steps(r: Rules, as_of: str, mode: str = "strict") -> list[tuple[str, Column]]:
    """(name, passes) in order, over labelled() rows of any market; created is a timestamp."""
    days = F.make_interval(days=r.of("max_age_days"))
    blocked = F.array_contains(r.of("blocked_codes"), F.col("detected"))
    return [
        ("known_market", F.array_contains(F.array(*[F.lit(p.name) for p in r.packs]), F.coalesce("market", F.lit("")))),
        ("description_short", F.length("plain") >= r.of("min_description")),
        ("bad_title", ~r.has("title", "bad_titles")),
        ("not_recent", F.coalesce(F.col("created") > F.lit(as_of).cast("timestamp") - days, F.lit(False))),
        ("location", location_ok(r)),
        ("role", roles.role_relevant(F.col("role_step"))),
        ("student_internship", F.col("student") == ""),
        ("generic_internship", ~r.of("drops_internships") | (F.col("general") == "")),
        ("excluded_word", F.size("hard") == 0),
        ("experience", F.col("level.level") != "hard"),
        ("blocked_language", L.blocked_reason(F.col("need"), mode) == ""),
        ("detected_language", ~blocked | F.col("need.main_or_learn") if mode == "strict" else F.lit(True)),
        ("junior_score", junior_score(r) >= (0 if mode == "strict" else -1)),
    ]


def hiring(r: Rules) -> Column:
    """Struct of the score, within 20 of zero, and up to eight reasons."""
    years, level, need = F.col("level.years"), F.col("level.level"), F.col("need")
    signed = lambda sign, name: F.transform(r.words(r.hits("text", name), name), lambda w: F.concat(F.lit(f"{sign}:"), w))
    parts = [
        (years <= 2, F.lit(4), "plus:years<=2"), (years == 3, F.when(level == "soft_junior_title", 1).otherwise(-1), "mixed:years=3"), (years == 4, F.lit(-3), "minus:years=4"),
        (years >= 5, F.lit(-8), "minus:years>=5"), (level == "soft_junior_title", F.lit(2), "plus:junior_signals_despite_experience"),
        (need["requires_blocked"], F.lit(-6), "minus:blocked_language_required"), (~need["requires_blocked"] & need["prefers_main"], F.lit(-2), f"minus:{LANGUAGES.main_name}_preferred"),
    ]
    score = 2 * r.count("text", "hiring_plus") - 2 * r.count("text", "hiring_minus") + sum((F.when(c, points).otherwise(0) for c, points, _ in parts), F.lit(0))
    told = F.array_compact(F.array(*[F.when(c, F.lit(reason)) for c, _, reason in parts]))
    return F.struct(clamp(score, -20, 20).alias("score"), F.slice(F.concat(signed("plus", "hiring_plus"), signed("minus", "hiring_minus"), told), 1, 8).alias("reasons"))


def sponsorship(r: Rules) -> Column:
    minus = r.count("text", "sponsor_minus")
    return clamp(F.when(minus > 0, -8 * minus).otherwise(5 * r.count("text", "sponsor_plus")), -10, 10)


def company_signal(r: Rules) -> Column:
    """3 for a known employer, or one that the description says it belongs to; 2 for signs of a global company; at most 5."""
    known = r.has("company", "sponsors") | (F.size("found.owner") > 0)
    return F.least(F.lit(5), F.when(known, 3).otherwise(0) + F.when(r.has("desc", "global_signals"), 2).otherwise(0))


def priority(r: Rules, as_of: str, sponsored: bool = True) -> Column:
    """The score that ranks, over junior_score, language_fit, hiring_score, sponsorship_score and company_signal; near misses leave out sponsorship."""
    bonus = sum((F.when(F.col("track") == t, b).otherwise(0) for t, b in r.packs[0].track_bonus), F.lit(0))
    terms = F.aggregate(r.of("term_weights"), F.lit(0), lambda n, t: n + F.when(F.array_contains(F.col("found.text"), t["id"]), t["weight"]).otherwise(0))
    places = F.when(T.contains_any(F.col("loc_n"), V.ROMANDIE), r.of("region_bonus")).otherwise(0)
    mode = F.when(F.col("work_mode") == "remote", 5).when(F.col("work_mode") == "hybrid", 3).otherwise(0)
    score = 50 + 2 * F.greatest(F.lit(0), F.col("junior_score")) + 2 * F.col("language_fit") + clamp(F.col("hiring_score"), -4, 6) + bonus + terms + 2 * r.count("text", "priority_training") + mode + places
    if sponsored:
        score = score + F.col("sponsorship_score") * r.of("sponsor_factor") + F.col("company_signal")
    return (score + U.age_points(F.col("created"), as_of)).cast("int")


def scored(df: DataFrame, r: Rules, as_of: str) -> DataFrame:
    """labelled() rows with junior_score, hiring_score, hiring_reasons, language_fit, sponsorship_score, company_signal, is_remote, priority."""
    df = computed(df, {"junior_score": junior_score(r), "_hiring": hiring(r), "language_fit": L.fit(F.col("text_n"), F.col("need"), LANGUAGES), "sponsorship_score": sponsorship(r), "company_signal": company_signal(r)})
    df = df.withColumn("detected_blocked", F.array_contains(r.of("blocked_codes"), F.col("detected")))
    df = df.withColumns({"hiring_score": F.col("_hiring.score"), "hiring_reasons": F.col("_hiring.reasons"), "is_remote": F.col("work_mode").isin("remote", "hybrid")}).drop("_hiring")
    return df.withColumn("priority", priority(r, as_of))


#: Characters of a description that a filtered table keeps.
SHOWN_CHARS = 400


def filtered(df: DataFrame, mode: str, source: str | Column = "") -> DataFrame:
    """scored() rows as a filtered table has them: lists as text, salaries where there are any, the description cut.

    blocked_language_reason is that of the strict mode whatever the mode, so a broad table tells what it let through.
    """
    need, told = F.col("need"), lambda c: F.array_join(c, " | ")
    strict = L.blocked_reason(need)
    return df.select(
        "row_id", "market", F.col("plain_title").alias("title"), F.col("plain_company").alias("company"), F.col("plain_place").alias("location"), "created", "url", U.canonical_url(F.col("url")).alias("canonical_url"),
        *[c for c in ("salary_min", "salary_max") if c in df.columns], F.substring("plain", 1, SHOWN_CHARS).alias("description"), "search_term", "junior_score", F.col("language_fit").alias("language_fit_score"), F.col("track").alias("it_track"),
        told(F.col("track_signals")).alias("it_track_signals"), F.col("hiring_score").alias("hiring_likelihood_score"), told(F.col("hiring_reasons")).alias("hiring_likelihood_reasons"), "sponsorship_score",
        F.col("company_signal").alias("company_sponsor_signal"), F.col("priority").alias("priority_score"), "is_remote", "work_mode", F.col("level.years").alias("years_required"),
        F.col("level.level").alias("experience_level"), T.normalise(F.col("level.detail")).alias("experience_detail"), F.when(strict != "", strict).otherwise(L.review_reason(need)).alias("blocked_language_reason"),
        L.need_label(need).alias("language_need_label"), told(need["signals"]).alias("language_need_signals"), F.coalesce(F.col("detected_blocked"), F.lit(False)).alias("disallowed_language_detected"),
        F.lit(mode).alias("filter_mode"), (source if isinstance(source, Column) else F.lit(source)).alias("source"),
    )


def near_misses(df: DataFrame, r: Rules, as_of: str, least: int = 68) -> DataFrame:
    """scored() rows that fail the location step alone, generic internships apart, and have enough priority without sponsorship."""
    for name, ok in steps(r, as_of):
        df = df if name == "generic_internship" else df.where(~ok if name == "location" else ok)
    return df.withColumn("priority", priority(r, as_of, sponsored=False)).where(F.col("priority") >= least).withColumn("near_miss_reason", F.lit("location_only"))


# The recheck of rows whose whole text is known: another order, with a reason for each row


def recheck_steps(r: Rules, as_of: str, mode: str = "strict") -> list[tuple[str, Column]]:
    """(name, reason or empty) in the order of the recheck: seniority and internships come first, words and language late."""
    of = {n: ok for n, ok in steps(r, as_of, "strict")}
    fails = lambda name, reason: F.when(of[name], F.lit("")).otherwise(reason if isinstance(reason, Column) else F.lit(reason))
    prefixed = lambda prefix, c: F.when(c != "", F.concat(F.lit(prefix), c)).otherwise("")
    least = 0 if mode == "strict" else -1
    word = F.coalesce(F.try_element_at("hard", F.lit(1)), F.try_element_at("soft", F.lit(1)), F.lit(""))
    return [
        ("senior", roles.senior_reason(r, F.col("level"))), ("student_internship", prefixed("non_target_role:student_internship_required:", F.col("student"))),
        ("non_target", roles.non_target_reason(r)), ("mid_experience", roles.mid_reason(F.col("level"))), ("generic_internship", prefixed("non_target_role:internship_generic:", F.col("general"))),
        ("description_short", fails("description_short", "description_too_short")), ("bad_title", prefixed("bad_title:", F.trim(r.first("title", "bad_titles")))),
        ("not_recent", fails("not_recent", "too_old")), ("location", fails("location", "location_blocked")),
        ("role", fails("role", F.when(F.col("forbidden") != "", F.concat(F.lit("role_forbidden:"), "forbidden")).otherwise("role_missing_required"))),
        ("excluded_word", prefixed("exclude_keyword:", word)), ("blocked_language", L.blocked_reason(F.col("need"))), ("language_choice", L.review_reason(F.col("need"))),
        ("detected_language", fails("detected_language", "blocked_language_detected") if mode == "strict" else F.lit("")),
        ("junior_score", F.when(junior_score(r) < least, F.lit(f"junior_score<{least}")).otherwise("")),
    ]


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for _, c in reasons], F.lit(""))


def triage(reason: Column, r: Rules) -> Column:
    """Struct of hard and review: whether a row that once passed is out for good, or what a human should look at."""
    starts = lambda *prefixes: F.coalesce(*[F.when(F.startswith(reason, F.lit(p)), True) for p in prefixes], F.lit(False))
    word = F.lower(F.trim(F.substring_index(reason, ":", -1)))
    lead = starts("exclude_keyword:") & word.isin("lead", "lead_soft")
    certain = ("senior", "principal", "staff engineer", "team lead", "tech lead", "director", "head of", *V.CERTAIN_EXCLUDED)
    forbidden = word.isin("commercial_sales", "delivery_role") | (~word.isin([w.strip() for w in V.DOUBTFUL_FORBIDDEN]) & F.contains(F.col("title_n"), word))
    hard = (
        F.when(lead, roles.title_leads(r)).when(starts("non_target_role:internship_generic:", "explicit_experience_requirement:soft", "language_alternative:"), False)
        .when(starts("non_target_role:", "explicit_senior_requirement:hard:", "title_senior_marker:", "blocked_language_req:", "junior_score<", "bad_title:"), True)
        .when(starts("exclude_keyword:"), word.isin(*certain)).when(starts("role_forbidden:"), forbidden)
        .otherwise(reason.isin("source_page_not_found", "description_too_short", "too_old", "location_blocked"))
    )
    shown = F.when(lead, "exclude_keyword:lead_soft").otherwise(reason)
    return F.struct(((reason != "") & hard).alias("hard"), F.when((reason != "") & ~hard, shown).otherwise("").alias("review"))
