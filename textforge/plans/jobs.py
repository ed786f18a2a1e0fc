"""Queries over postings of nine markets: every rule of the packs, the funnel by market, scores, the recheck and the queue's gates."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge import vocabularies as V
from textforge.functions import text as T
from textforge.markets import MARKETS, Market
from textforge.operators import cascade, classify, gates, langid, market, phrases, queue, reports, roles, rules
from textforge.operators import language as L
from textforge.plans import market_oracle as M
from textforge.plans import oracle as O
from textforge.plans.catalogue import docs, joined, query
from textforge.sources.jobs import job_postings
from textforge.sources.tables import postings, read_table

AS_OF = M.AS_OF
#: The nine packs, with a longer memory: the tables' dates span six years.
PACKS = tuple(dataclasses.replace(p, max_age_days=2000) for p in MARKETS.values())
RULES = rules.of(PACKS, V.EXCLUDED_EXCEPTIONS)


def read(spark, sf) -> DataFrame:
    return RULES.read(job_postings(spark, sf))


def labelled(spark, sf) -> DataFrame:
    return market.labelled(read(spark, sf), RULES)


def scored(spark, sf) -> DataFrame:
    return market.scored(labelled(spark, sf), RULES, AS_OF)


#: Vocabularies whose hits a query shows, with the part of a row where they are looked for.
SHOWN = (
    ("allowed_places", "loc", "loc_n"), ("blocked_places", "place", "place_n"), ("foreign_places", "every", "every_n"), ("required", "text", "text_n"), ("forbidden", "title", "title_n"),
    ("excluded", "bare", "bare_n"), ("bad_titles", "title", "title_n"), ("hiring_plus", "text", "text_n"), ("junior_plus", "text", "text_n"), ("sponsors", "company", "company_n"),
    ("training_subjects", "text", "text_n"), ("industrial", "desc", "desc_n"), ("internship_stage", "quiet", "quiet_n"), ("remote_terms", "work", "work_n"),
)


@query(f"WITH {M.read()} SELECT row_id, market, " + ", ".join(f"array_to_string({M.found(sql, name)}, '|') AS {name}" for name, _, sql in SHOWN) + " FROM marked")
def q_market_hits(spark, sf):
    """The phrases of the row's own pack in the parts of the row, from one pass over its text."""
    return read(spark, sf).select("row_id", "market", *[joined(RULES.words(RULES.hits(where, name), name)).alias(name) for name, where, _ in SHOWN])


COUNTED = ("training", "junior_minus", "excluded", "infra", "lead_titles")


@query(f"WITH {M.packs()} SELECT doc_id, " + ", ".join(f"len({M.found('t', n)})::INT AS {n}" for n in COUNTED) + f" FROM (SELECT doc_id, {O.norm('text')} AS t FROM documents), (SELECT pk_excluded FROM packs WHERE pack_name = 'ch')")
def q_market_document_hits(spark, sf):
    """How many phrases of five lists of market ch each document has."""
    book, pack = RULES.book, MARKETS["ch"]
    found = phrases.parts(book, T.normalise(F.col("text")))[0]
    count = lambda n: F.size(F.array_intersect(T.constant(book.ids(Market.vocabularies()[n], getattr(pack, n)), "array<int>"), F.col("found")))
    return docs(spark, sf).select("doc_id", found.alias("found")).select("doc_id", *[count(n).alias(n) for n in COUNTED])


# Language


@query(f"WITH {M.read()}, {M.asked()}, {M.leveled()}, {M.spoken()} SELECT row_id, array_to_string(required, '|') AS required, array_to_string(optional, '|') AS optional, {M.BLOCKED} AS blocked, {M.REVIEW} AS review, accepts AS acceptable, ladder.sure AS confidence, ladder.found AS main_evidence, array_to_string(list_sort(hindering), '|') AS hindering FROM spoken")
def q_language_need(spark, sf):
    need = L.language_need(F.col("text_n"), market.LANGUAGES, RULES.of("blocked_codes"))
    d = read(spark, sf).select("row_id", need.alias("need"))
    need = F.col("need")
    return d.select(
        "row_id", joined(need["required"]).alias("required"), joined(need["optional"]).alias("optional"), L.blocked_reason(need).alias("blocked"), L.review_reason(need).alias("review"),
        need["acceptable_without_main"].alias("acceptable"), need["main_confidence"].alias("confidence"), need["main_evidence"].alias("main_evidence"),
        joined(F.coalesce(need["blocked_required"], F.array().cast("array<string>"))).alias("hindering"),
    )


@query(f"WITH {M.read()}, {M.asked()}, {M.leveled()}, {M.spoken()} SELECT row_id, array_to_string(p_required, '|') AS required, array_to_string(p_optional, '|') AS optional, array_to_string(choice, '|') AS choice, array_to_string(evidence, '|') AS evidence, english_only FROM spoken")
def q_language_signals(spark, sf):
    d = classify.computed(read(spark, sf).select("row_id", "text_n"), {"s": L.signals(F.col("text_n"), market.LANGUAGES)})
    return d.select("row_id", *[joined(F.col("s")[k]).alias(n) for k, n in (("required", "required"), ("optional", "optional"), ("alternative", "choice"), ("evidence", "evidence"))], L.matches(F.col("text_n"), *market.LANGUAGES.english_only).alias("english_only"))


@query()
def q_blocked_text(spark, sf):
    """The language of each posting's text by its trigrams, and whether the row's market blocks it."""
    profiles = langid.learnt(docs(spark, sf))
    d = read(spark, sf).select("row_id", "lang", "market", RULES.of("blocked_codes").alias("codes"), langid.language(F.col("plain"), profiles).alias("detected"))
    return d.select("row_id", "lang", "market", "detected", F.coalesce(F.array_contains("codes", F.col("detected")), F.lit(False)).alias("blocked"))


# Roles, experience, internships, seniority


@query(f"WITH {M.rolled()} SELECT row_id, forbidden_reason AS forbidden, role_step, role_step NOT IN ('blocked_title', 'forbidden', 'none') AS relevant FROM rolled")
def q_role_steps(spark, sf):
    d = read(spark, sf).withColumn("forbidden", roles.forbidden_reason(RULES))
    d = d.select("row_id", "forbidden", roles.role_step(RULES, F.col("forbidden")).alias("role_step"))
    return d.withColumn("relevant", roles.role_relevant(F.col("role_step")))


@query(f"WITH {M.read()}, {M.asked()}, {M.leveled()} SELECT row_id, level, level_detail AS detail, coalesce(level_years, -1) AS years, coalesce(years, -1) AS asked FROM leveled")
def q_experience_steps(spark, sf):
    d = read(spark, sf).withColumn("asked", roles.years_required(F.col("text_n")))
    d = d.select("row_id", F.coalesce("asked.years", F.lit(-1)).alias("asked"), roles.experience(RULES, F.col("asked")).alias("e"))
    return d.select("row_id", "e.level", "e.detail", F.coalesce("e.years", F.lit(-1)).alias("years"), "asked")


@query(f"WITH {M.rolled()} SELECT row_id, student, general, CASE WHEN student <> '' THEN 'blocked_student' WHEN general <> '' THEN 'manual' ELSE 'none' END AS flag FROM rolled")
def q_internship_steps(spark, sf):
    student, general = roles.internship_details(RULES)
    d = read(spark, sf).select("row_id", student.alias("student"), general.alias("general"))
    return d.withColumn("flag", roles.internship_flag(F.col("student"), F.col("general"), F.lit("")))


TITLE = "title_n"
CORE, BRIDGE = M.has(TITLE, "core_titles"), M.has("text_n", "qa_bridge")
TARGET = (
    f"CASE WHEN {M.has('text_n', 'apprenticeship')} THEN 'apprenticeship' WHEN {M.has(TITLE, 'trainer')} THEN 'trainer' WHEN {M.any_pattern(TITLE, roles.SUPPORT_TITLES)} AND NOT {M.has(TITLE, 'infra_titles')} THEN 'support_only' "
    f"WHEN {M.has(TITLE, 'network_titles')} AND {M.has('text_n', 'senior_network')} THEN 'senior_network' WHEN {M.has(TITLE, 'finance')} AND NOT {CORE} THEN 'finance' WHEN {M.has(TITLE, 'business_analysis')} THEN 'business_analysis' "
    f"WHEN ({M.has(TITLE, 'manual')} AND {M.has(TITLE, 'tested')}) OR ({M.has(TITLE, 'manual_qa')} AND NOT {BRIDGE}) THEN 'manual_qa' WHEN {M.has(TITLE, 'industrial_titles')} AND NOT {M.has('text_n', 'infra')} AND NOT {BRIDGE} THEN 'industrial_automation' "
    f"WHEN {M.has(TITLE, 'broad_aliases')} AND NOT {M.has(TITLE, 'automation_qa')} AND NOT {CORE} THEN 'industrial_automation' ELSE '' END"
)
SENIORS = f"coalesce('title_senior_marker:' || {M.found(TITLE, 'senior_titles')}[1], CASE WHEN level = 'hard' THEN 'explicit_senior_requirement:hard:' || level_detail ELSE '' END)"
MID = "CASE WHEN starts_with(level, 'soft') THEN 'explicit_experience_requirement:' || level || ':' || level_detail ELSE '' END"


@query(f"WITH {M.read()}, {M.asked()}, {M.leveled()}, t AS (SELECT *, {SENIORS} AS senior, {MID} AS mid, {TARGET} AS target FROM leveled) SELECT row_id, senior, mid, CASE WHEN target <> '' THEN 'non_target_role:' || target ELSE '' END AS target, CASE WHEN senior <> '' THEN 'hard' WHEN mid <> '' THEN 'soft' ELSE 'none' END AS flag, {M.has(TITLE, 'lead_titles')} AS leads FROM t")
def q_seniority_steps(spark, sf):
    d = read(spark, sf).withColumn("asked", roles.years_required(F.col("text_n")))
    d = d.withColumn("level", roles.experience(RULES, F.col("asked")))
    d = d.withColumns({"senior": roles.senior_reason(RULES, F.col("level")), "mid": roles.mid_reason(F.col("level")), "target": roles.non_target_reason(RULES), "leads": roles.title_leads(RULES)})
    return d.select("row_id", "senior", "mid", "target", roles.seniority_flag(F.col("senior"), F.col("mid"), F.lit(""), F.col("level.level")).alias("flag"), "leads")


# The cascade, by market

STEPS = M.steps()
NUMBERED = ", ".join(f"({i + 1}, '{n}')" for i, (n, _) in enumerate(STEPS))


@query(f"WITH {M.rolled()} SELECT row_id, market, {M.first_fail()} AS first_fail FROM rolled")
def q_market_first_fail(spark, sf):
    return cascade.attributed(labelled(spark, sf), market.steps(RULES, AS_OF)).select("row_id", "market", "first_fail")


@query(f"WITH {M.rolled()}, f AS (SELECT market, {M.first_fail()} AS step FROM rolled), s(step_no, step) AS (VALUES {NUMBERED}), m AS (SELECT market, count(*) AS total FROM f GROUP BY market), c AS (SELECT m.market, s.step_no, s.step, m.total, count(f.step) AS removed FROM m CROSS JOIN s LEFT JOIN f ON f.market = m.market AND f.step = s.step GROUP BY ALL), r AS (SELECT *, total - sum(removed) OVER (PARTITION BY market ORDER BY step_no) AS kept FROM c) SELECT market, step_no, step, (kept + removed)::BIGINT AS before, removed, kept::BIGINT AS kept FROM r")
def q_market_funnel(spark, sf):
    """One funnel for each market, from one job over the mixed table."""
    return cascade.funnel(labelled(spark, sf), market.steps(RULES, AS_OF), by=("market",))


@query(f"WITH {M.scored()} SELECT row_id, junior_score, hiring_score, language_fit, sponsorship_score, company_signal, track.t AS track, array_to_string(track.s, '|') AS signals, plain_priority + sponsorship_score * coalesce(sponsor_factor, 0) + company_signal AS priority FROM valued WHERE pack_name IS NOT NULL")
def q_market_scores(spark, sf):
    d = scored(spark, sf).where(F.col("pack").isNotNull())
    return d.select("row_id", "junior_score", "hiring_score", "language_fit", "sponsorship_score", "company_signal", "track", joined("track_signals").alias("signals"), "priority")


NEAR = " AND ".join(f"NOT ({ok})" if n == "location" else f"({ok})" for n, ok in STEPS if n != "generic_internship")


@query(f"WITH {M.scored()} SELECT row_id, market, plain_priority AS priority, 'location_only' AS near_miss_reason FROM valued WHERE {NEAR} AND plain_priority >= 50")
def q_market_near_miss(spark, sf):
    return market.near_misses(scored(spark, sf), RULES, AS_OF, 50).select("row_id", "market", "priority", "near_miss_reason")


PLUS = lambda sign, name: f"list_transform({M.found('text_n', name)}, lambda w: '{sign}:' || w)"
HINDERED = "(len(hindering) > 0 AND NOT accepts)"
NOTES = [
    ("level_years <= 2", "plus:years<=2"), ("level_years = 3", "mixed:years=3"), ("level_years = 4", "minus:years=4"), ("level_years >= 5", "minus:years>=5"),
    ("level = 'soft_junior_title'", "plus:junior_signals_despite_experience"), (HINDERED, "minus:blocked_language_required"), (f"NOT {HINDERED} AND prefers", "minus:dutch_preferred"),
]
WHY_HIRE = f"({PLUS('plus', 'hiring_plus')} || {PLUS('minus', 'hiring_minus')} || list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in NOTES) + "], lambda v: v IS NOT NULL))[1:8]"
SAID = [
    ("ladder.found <> ''", "'dutch_signal:' || ladder.found"), ("prefers", "'dutch_preferred_not_required'"), ("learn", "'dutch_preferred_or_learn'"), ("accepts", "'fr_or_nl_alternative'"),
    ("english_only AND NOT must_main", "'english_only_or_english_required'"), ("must_main", "'dutch_explicitly_required'"),
]
SIGNALS = "(evidence || list_filter([" + ", ".join(f"CASE WHEN {c} THEN {n} END" for c, n in SAID) + "], lambda v: v IS NOT NULL))[1:8]"
LABEL = f"CASE WHEN {HINDERED} THEN 'requires_blocked_language' WHEN prefers THEN 'prefers_dutch' WHEN accepts THEN 'acceptable_without_dutch' ELSE 'fr_en_ok' END"
BROAD_FAIL = "CASE " + " ".join(f"WHEN NOT coalesce({'junior_score >= -1' if n == 'junior_score' else 'true' if n == 'blocked_language' else ok}, false) THEN '{n}'" for n, ok in STEPS) + " ELSE '' END"


@query(f"WITH {M.scored()} SELECT row_id, market, {O.flat(O.decoded('title'))} AS title, company, location, created, url, trim(split_part(url, '?', 1)) AS canonical_url, substring(plain, 1, 400) AS description, search_term, junior_score, language_fit AS language_fit_score, track.t AS it_track, array_to_string(track.s, ' | ') AS it_track_signals, hiring_score AS hiring_likelihood_score, array_to_string({WHY_HIRE}, ' | ') AS hiring_likelihood_reasons, sponsorship_score, company_signal AS company_sponsor_signal, (plain_priority + sponsorship_score * sponsor_factor + company_signal)::INT AS priority_score, work_mode IN ('remote', 'hybrid') AS is_remote, work_mode, coalesce(level_years, -1) AS years_required, level AS experience_level, {O.norm('level_detail')} AS experience_detail, CASE WHEN ({M.BLOCKED}) <> '' THEN {M.BLOCKED} ELSE {M.REVIEW} END AS blocked_language_reason, {LABEL} AS language_need_label, array_to_string({SIGNALS}, ' | ') AS language_need_signals, false AS disallowed_language_detected, 'broad' AS filter_mode, search_term AS source FROM valued WHERE {BROAD_FAIL} = ''")
def q_market_filtered(spark, sf):
    """The filtered table of the broad mode, as a run writes it."""
    kept = cascade.keep(scored(spark, sf), market.steps(RULES, AS_OF, "broad"))
    return market.filtered(kept, "broad", F.col("search_term")).withColumn("years_required", F.coalesce("years_required", F.lit(-1)))


# The recheck: the rows that a preview of the text kept, judged by the whole text

OK = dict(STEPS)
WORD = "coalesce(hard[1], soft[1], '')"
RECHECK = [
    f"nullif({SENIORS}, '')", "CASE WHEN student <> '' THEN 'non_target_role:student_internship_required:' || student END", f"'non_target_role:' || nullif({TARGET}, '')", f"nullif({MID}, '')",
    "CASE WHEN general <> '' THEN 'non_target_role:internship_generic:' || general END", f"CASE WHEN NOT ({OK['description_short']}) THEN 'description_too_short' END",
    f"'bad_title:' || trim({M.found(TITLE, 'bad_titles')}[1])", f"CASE WHEN NOT ({OK['not_recent']}) THEN 'too_old' END", f"CASE WHEN NOT ({OK['location']}) THEN 'location_blocked' END",
    f"CASE WHEN NOT ({OK['role']}) THEN CASE WHEN forbidden_reason <> '' THEN 'role_forbidden:' || forbidden_reason ELSE 'role_missing_required' END END",
    f"'exclude_keyword:' || nullif({WORD}, '')", f"nullif({M.BLOCKED}, '')", f"nullif({M.REVIEW}, '')", "CASE WHEN junior_score < 0 THEN 'junior_score<0' END",
]
CERTAIN = ", ".join(map(O.q, ("senior", "principal", "staff engineer", "team lead", "tech lead", "director", "head of", *V.CERTAIN_EXCLUDED)))
TAIL = "lower(trim(regexp_extract(reason, '[^:]*$')))"
HARD = (
    f"CASE WHEN reason = 'exclude_keyword:lead' THEN {M.has(TITLE, 'lead_titles')} WHEN regexp_matches(reason, '^(non_target_role:internship_generic:|explicit_experience_requirement:soft|language_alternative:)') THEN false "
    "WHEN regexp_matches(reason, '^(non_target_role:|explicit_senior_requirement:hard:|title_senior_marker:|blocked_language_req:|junior_score<|bad_title:)') THEN true "
    f"WHEN starts_with(reason, 'exclude_keyword:') THEN {TAIL} IN ({CERTAIN}) WHEN starts_with(reason, 'role_forbidden:') THEN {TAIL} IN ('commercial_sales', 'delivery_role') OR ({TAIL} NOT IN ({', '.join(map(O.q, V.DOUBTFUL_FORBIDDEN))}) AND contains(title_n, {TAIL})) "
    "ELSE reason IN ('description_too_short', 'too_old', 'location_blocked') END"
)


@query(f"WITH {M.rolled()}, r AS (SELECT *, coalesce({', '.join(RECHECK)}, '') AS reason FROM rolled WHERE pack_name IS NOT NULL), h AS (SELECT *, {HARD} AS out FROM r) SELECT row_id, reason, reason <> '' AND out AS hard, CASE WHEN reason = '' OR out THEN '' WHEN reason = 'exclude_keyword:lead' THEN 'exclude_keyword:lead_soft' ELSE reason END AS review, trim(regexp_extract(reason, '[^:]*$')) AS detail FROM h")
def q_recheck_reasons(spark, sf):
    d = labelled(spark, sf).where(F.col("pack").isNotNull())
    d = d.withColumn("reason", market.first_reason(market.recheck_steps(RULES, AS_OF)))
    return d.select("row_id", "reason", market.triage(F.col("reason"), RULES).alias("t"), roles.reason_detail(F.col("reason")).alias("detail")).select("row_id", "reason", "t.hard", "t.review", "detail")


@query(f"WITH {O.POSTING}, p AS (SELECT row_id, substring(description, 1, 400) AS original, CASE WHEN row_id % 3 = 0 THEN NULL ELSE substring(description, 1, (100 + row_id * 7 % 900)::INT) END AS scraped FROM posting), w AS (SELECT *, CASE WHEN length(coalesce(scraped, '')) > length(original) THEN scraped ELSE original END AS whole FROM p) SELECT row_id, length(trim(original)) >= 390 AND length(trim(whole)) <= 420 AND (length(trim(coalesce(scraped, ''))) = 0 OR length(trim(scraped)) <= length(trim(original))) AS preview, length(whole)::INT AS text_len FROM w")
def q_preview_only(spark, sf):
    p = postings(spark, sf)
    scraped = F.when(F.col("row_id") % 3 != 0, F.substr("description", F.lit(1), (100 + F.col("row_id") * 7 % 900).cast("int")))
    d = p.select("row_id", F.substring("description", 1, 400).alias("original"), scraped.alias("scraped"))
    d = d.withColumn("whole", roles.longer(F.col("scraped"), F.col("original")))
    return d.select("row_id", roles.preview_only(F.col("original"), F.col("whole"), F.col("scraped")).alias("preview"), F.length("whole").alias("text_len"))


# The queue's gates

MATCH = lambda *cols: O.flat("regexp_replace(lower(strip_accents(concat_ws(' ', " + ", ".join(f"nullif(trim({c}), '')" for c in cols) + "))), '[^\\x00-\\x7F]', '', 'g')")
COSTS = [(f"language:{c}", 12, O.contains_any("match_text", w)) for c, w in V.MA_QUEUE_LANGUAGES if c not in MARKETS["ma"].allowed_codes] + [(n, 10, O.contains_any("match_title", w)) for n, w in V.MA_QUEUE_TITLES]
REASONS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {O.q(n)} END" for n, _, c in COSTS) + "], lambda v: v IS NOT NULL)"
PENALTY = "greatest(-30, " + " ".join(f"- CASE WHEN {c} THEN {p} ELSE 0 END" for _, p, c in COSTS) + ")"
WHY = f"CASE WHEN market <> 'ma' THEN '' WHEN match_title = '' THEN 'empty_title' WHEN {O.contains_any('match_title', V.MA_GENERIC_TITLES)} THEN 'generic_language_title' WHEN {O.contains_any('match_title', (*V.MA_CLEAR_TITLES, 'junior'))} THEN '' ELSE 'title_not_specific_enough' END"
GATED = f"m AS (SELECT *, {MATCH('title')} AS match_title, {MATCH('title', 'description', 'company')} AS match_text FROM jobs), g AS (SELECT *, CASE WHEN market = 'ma' THEN {PENALTY} ELSE 0 END AS penalty, CASE WHEN market = 'ma' THEN array_to_string({REASONS}[1:4], ' | ') ELSE '' END AS reasons, market = 'ma' AND len({REASONS}) > 0 AS forced, {WHY} AS why FROM m)"


@query(f"WITH {O.POSTING}, {M.JOBS_SQL}, {GATED} SELECT row_id, penalty, reasons, forced, why = '' AS allowed, why FROM g")
def q_queue_gates(spark, sf):
    d = job_postings(spark, sf).withColumns({"t": gates.match_text(F.col("title")), "x": gates.match_text(F.col("title"), F.col("description"), F.col("company"))})
    strict = MARKETS["ma"]
    a = F.when(F.col("market") == "ma", gates.adjustment(F.col("t"), F.col("x"), strict)).otherwise(gates.adjustment(F.col("t"), F.col("x"), MARKETS["be"]))
    d = d.select("row_id", a.alias("a"), gates.apply_now(F.col("t"), F.col("market") == "ma").alias("g"))
    return d.select("row_id", "a.penalty", "a.reasons", "a.forced", "g.allowed", "g.why")


PLACE = MATCH("location")
RABAT = O.contains_any(PLACE, [gates.plain(w) for w in dict(V.MA_CLUSTERS)["rabat"]])


@query(f"WITH {O.POSTING}, {M.JOBS_SQL} SELECT row_id, {RABAT} AS rabat, {RABAT} OR row_id % 4 = 0 AS rabat_or_remote, contains({PLACE}, 'geneve') AS other, market || '_q_rabat' AS path FROM jobs")
def q_location_focus(spark, sf):
    d, remote = job_postings(spark, sf), F.col("row_id") % 4 == 0
    found = {n: gates.in_focus(F.col("location"), remote, f, MARKETS["ma"]) for n, f in (("rabat", "Rabat"), ("rabat_or_remote", "rabat_or_remote"), ("other", "Genève"))}
    return d.select("row_id", *[c.alias(n) for n, c in found.items()], F.concat("market", F.lit(gates.focus_path("_q", "Rabat"))).alias("path"))


REGION = O.contains_any("lower(location)", gates.REGION_PLACES)
LABELS = f"[CASE WHEN row_id % 4 = 0 THEN 'remote/hybrid' END, CASE WHEN row_id % 5 = 1 THEN 'sponsors-visa' END, CASE WHEN row_id % 3 > 0 THEN 'language-fit' END, CASE WHEN row_id % 7 >= 2 THEN 'junior-friendly' END, 'term:' || nullif(trim(search_term), ''), CASE WHEN {REGION} THEN 'romandie' END, CASE WHEN NOT {REGION} AND market = 'ch' THEN 'swiss-wide' END, CASE WHEN row_id % 6 = 0 THEN 'historical-fit+' WHEN row_id % 6 = 1 THEN 'historical-fit-' END]"


@query(f"WITH {O.POSTING}, {M.JOBS_SQL}, l AS (SELECT row_id, list_filter({LABELS}, lambda v: v IS NOT NULL)[1:4] AS told FROM jobs) SELECT row_id, CASE WHEN len(told) = 0 THEN 'priority-ranked' ELSE array_to_string(told, ', ') END AS reason FROM l")
def q_reason_text(spark, sf):
    n = F.col("row_id")
    d = job_postings(spark, sf).withColumns({
        "is_remote": n % 4 == 0, "sponsorship_score": F.when(n % 5 == 1, 5).otherwise(-8), "language_fit": (n % 3).cast("int"), "junior_score": (n % 7).cast("int"),
        "feedback_score": F.when(n % 6 == 0, 2).when(n % 6 == 1, -2).otherwise(0),
    })
    return d.select("row_id", gates.reason_text(F.when(F.col("market") == "ch", "romandie").otherwise("all")).alias("reason"))


FED = f"fed AS (SELECT v.*, greatest(-6, least(6, coalesce(a.feedback, 0) + coalesce(b.feedback, 0)))::INT AS feedback_score FROM valued v LEFT JOIN ({O.feedback('company').replace('FROM scored', 'FROM valued')}) a USING (company) LEFT JOIN ({O.feedback('search_term').replace('FROM scored', 'FROM valued')}) b USING (search_term))"
READY = "adjusted >= 68 AND NOT forced AND why = ''"


@query(f"WITH {M.scored()}, {FED}, {GATED.replace('FROM jobs', 'FROM fed')}, a AS (SELECT *, (plain_priority + sponsorship_score * sponsor_factor + company_signal + feedback_score + penalty)::INT AS adjusted FROM g WHERE pack_name IS NOT NULL AND {M.first_fail()} = '') SELECT row_id, market, adjusted, penalty AS queue_adjustment, reasons AS penalty_reasons, why AS gate, CASE WHEN {READY} THEN 'apply_now' ELSE 'review' END AS action FROM a")
def q_market_queue(spark, sf):
    """The rows that their market's cascade keeps, with the queue's adjustment, gate and action."""
    d = scored(spark, sf)
    d = queue.feedback_scored(cascade.keep(d, market.steps(RULES, AS_OF)), job_postings(spark, sf))
    return gates.gated(d, RULES, 68).select("row_id", "market", "adjusted", "queue_adjustment", "penalty_reasons", "gate", "action")


# Small functions over tables


@query("SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS told, n, flag, strftime(ts, '%Y-%m-%d') AS day FROM (SELECT event_id, ts, user_id * 37 % 9000 AS s, CASE WHEN event_id % 4 = 0 THEN 0 ELSE trunc((event_id % 50 - 20) + 0.5)::INT END AS n, event_id % 3 = 0 AS flag FROM events)")
def q_small_casts(spark, sf):
    e = read_table(spark, sf, "events")
    number = F.when(F.col("event_id") % 4 == 0, "none").otherwise((F.col("event_id") % 50 - 20 + 0.5).cast("string"))
    flag = F.when(F.col("event_id") % 3 == 0, " TRUE ").otherwise("0")
    day = reports.iso_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", reports.duration(F.col("user_id") * 37 % 9000).alias("told"), reports.whole_number(number).alias("n"), reports.is_true(flag).alias("flag"), F.date_format(day, "yyyy-MM-dd").alias("day"))
