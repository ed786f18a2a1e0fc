"""Pieces of DuckDB SQL that say independently what the operators compute."""

from __future__ import annotations

import re
from html.entities import codepoint2name

from textforge.functions.text import COMPANY_ENDINGS, GENDER_MARK, TOKEN_STOP
from textforge.operators.classify import VOTES
from textforge.operators.dedup import NOISE
from textforge.operators.queue import CLOSED, OUTCOME
from textforge.rulepack import FIXTURE, RulePack


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '\\s+', ' ', 'g'))"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


#: Entities that SQL decodes one after another, the ampersand last: those of Latin-1, by name and number, and the marks of markup.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    *((f"&{n};", chr(c)) for c, n in sorted(codepoint2name.items()) if 0xA0 <= c <= 0xFF), *((f"&#{c};", chr(c)) for c in range(0xA0, 0x100)),
    ("&amp;", "&"),
)


def decoded(x: str) -> str:
    out = given = f"coalesce({x}, '')"
    for a, b in ENTITIES:
        out = f"replace({out}, {q(a)}, {q(b)})"
    return f"(CASE WHEN contains({given}, '&') THEN {out} ELSE {given} END)"


def plain_html(x: str) -> str:
    return flat(f"regexp_replace(regexp_replace({decoded(x)}, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')")


def language(x: str) -> str:
    """The code with most function words; ties go to the first, no vote is 'unknown'."""
    words = f"string_split_regex(lower(coalesce({x}, '')), '[^\\p{{L}}]+')"
    votes = ", ".join(f"len(list_filter({words}, lambda w: list_contains({listed(v)}, w)))" for v in VOTES.values())
    order = listed(VOTES)
    return f"(CASE WHEN list_max([{votes}]) > 0 THEN {order}[list_position([{votes}], list_max([{votes}]))] ELSE 'unknown' END)"


def html_like(x: str) -> str:
    return f"(regexp_matches({x}, '(?i)<(p|br|div|ul|li|b|strong|span|h[1-6])[\\s>/]') OR len(regexp_extract_all({x}, '<[^>]+>')) >= 4)"


def hit(x: str, w: str) -> str:
    if not re.fullmatch("[a-z0-9 ]+", w):
        return f"contains({x}, {q(w)})"
    return f"regexp_matches({x}, '(^|[^a-z0-9])" + "\\s+".join(w.split()) + "([^a-z0-9]|$)')"


def any_of(parts: list[str]) -> str:
    return "(" + " OR ".join(parts or ["false"]) + ")"


def contains_any(x: str, words) -> str:
    return any_of([f"contains({x}, {q(w)})" for w in words])


def hit_any(x: str, words) -> str:
    return any_of([hit(x, w) for w in words])


def count_in(x: str, words) -> str:
    return "(" + " + ".join([f"contains({x}, {q(w)})::INT" for w in words] or ["0"]) + ")"


def hits(x: str, words) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {hit(x, w)} THEN {q(w)} END" for w in words) + "], lambda v: v IS NOT NULL)"


def listed(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def company_key(x: str) -> str:
    """One nested CASE for each ending, written as a chain of subqueries' expressions."""
    out = f"trim(lower(coalesce({x}, '')))"
    for e in COMPANY_ENDINGS:
        out = f"trim(regexp_replace({out}, '{e}$', ''))"
    return out


def simple(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({norm(x)}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def no_noise(x: str) -> str:
    out = f"regexp_replace(lower(coalesce({x}, '')), '{GENDER_MARK}', ' ', 'g')"
    for t in NOISE:
        out = f"replace({out}, {q(t)}, ' ')"
    return flat(out)


def token_set(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split_regex({norm(x)}, '[^a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({listed(TOKEN_STOP)}, t))))"


POSTING = """posting AS (
  SELECT d.doc_id AS row_id, p.p_name AS title, s.s_name AS company, n.n_name AS location, d.text AS description, g.url, g.html,
         o.o_orderdate AS created, d.source AS search_term, d.lang,
         CASE WHEN quality = 1 AND toxic = 0 THEN 'interview' WHEN quality = 1 AND toxic = 1 THEN 'applied' WHEN quality = 0 AND toxic = 0 THEN 'rejected'
              WHEN quality = 0 AND toxic = 1 THEN 'withdrawn' ELSE 'to_apply' END AS status
  FROM documents d
  JOIN part p ON p.p_partkey = d.doc_id % (SELECT count(*) FROM part)
  JOIN supplier s ON s.s_suppkey = d.doc_id % (SELECT count(*) FROM supplier)
  JOIN nation n ON n.n_nationkey = s.s_nationkey
  JOIN pages g ON g.page_id = d.doc_id % (SELECT count(*) FROM pages)
  JOIN orders o ON o.o_orderkey = d.doc_id % (SELECT count(*) FROM orders)
  LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def scored(pack: RulePack = FIXTURE) -> str:
    """CTEs posting, feat, labelled, scored."""
    age = f"floor((epoch(TIMESTAMP {q(pack.as_of)}) - epoch(created)) / 86400)"
    tracks = " ".join(f"WHEN len({hits('title_n', w)}) > 0 THEN {q(n)}" for n, w in pack.tracks)
    signals = " ".join(f"WHEN len({hits('title_n', w)}) > 0 THEN {hits('title_n', w)}[1:4]" for n, w in pack.tracks)
    opt, req = contains_any("text_n", pack.optional_language), hit_any("text_n", pack.blocked_language)
    hy, re_, on = (hit_any("text_n", w) for w in (pack.hybrid_terms, pack.remote_terms, pack.onsite_terms))
    plus, minus = (" + ".join(f"{hit('text_n', w)}::INT" for w in ws) for ws in (pack.hiring_plus, pack.hiring_minus))
    neg = count_in("text_n", pack.sponsor_minus)
    bonus = " + ".join(f"CASE WHEN track = {q(t)} THEN {b} ELSE 0 END" for t, b in pack.track_bonus)
    terms = " + ".join(f"CASE WHEN contains(text_n, {q(t)}) THEN {w} ELSE 0 END" for t, w in pack.term_weights)
    return f"""{POSTING},
plain AS (SELECT *, CASE WHEN {html_like(decoded('description'))} OR regexp_matches({decoded('description')}, '(?s)<[^>]+>') THEN {plain_html('description')} ELSE {flat(decoded('description'))} END AS plain FROM posting),
feat0 AS (SELECT *, {norm('title')} AS title_n, {norm('plain')} AS desc_n, {norm('location')} AS loc_n FROM plain),
feat AS (SELECT *, concat_ws(' ', nullif(title_n, ''), nullif(desc_n, '')) AS text_n FROM feat0),
labelled0 AS (SELECT *,
  CASE WHEN {hy} OR ({re_} AND {on}) THEN 'hybrid' WHEN {re_} THEN 'remote' WHEN {on} THEN 'onsite' ELSE 'unknown' END AS work_mode,
  CASE WHEN {contains_any('text_n', pack.hard_experience)} THEN 'hard' WHEN {contains_any('text_n', pack.soft_experience)} THEN 'soft' ELSE 'none' END AS experience_level,
  CASE WHEN {req} AND NOT {opt} THEN 'required' WHEN {req} THEN 'alternative' WHEN {opt} THEN 'plus' ELSE 'none' END AS language_label,
  CASE {tracks} ELSE 'other' END AS track, CASE {signals} ELSE [] END AS track_signals FROM feat),
labelled AS (SELECT *, CASE language_label WHEN 'required' THEN 0.95::DOUBLE WHEN 'alternative' THEN 0.15 WHEN 'plus' THEN 0.1 ELSE 0.0 END AS language_confidence FROM labelled0),
parts AS (SELECT *,
  (2 * {count_in('text_n', pack.junior_plus)} - 2 * {count_in('text_n', pack.junior_minus)} - {count_in('text_n', pack.junior_mild)})::INT AS junior_score,
  greatest(-20, least(20, 2 * ({plus}) - 2 * ({minus}) + CASE WHEN experience_level = 'soft' THEN 2 ELSE 0 END
    + CASE WHEN language_label = 'required' THEN -6 WHEN language_label IN ('alternative', 'plus') THEN -2 ELSE 0 END))::INT AS hiring_score,
  CASE WHEN language_label = 'required' THEN 0 WHEN language_label = 'plus' THEN 1 WHEN text_n <> '' THEN 2 ELSE 0 END AS language_fit,
  greatest(-10, least(10, CASE WHEN {neg} > 0 THEN -8 * {neg} ELSE 5 * {count_in('text_n', pack.sponsor_plus)} END))::INT AS sponsorship_score,
  CASE WHEN {contains_any(norm('company'), pack.sponsor_companies)} THEN 3 ELSE 0 END AS company_signal FROM labelled),
scored AS (SELECT *, (50 + 2 * greatest(0, junior_score) + 2 * language_fit + greatest(-4, least(6, hiring_score)) + sponsorship_score * {pack.sponsor_factor}
  + least(5, company_signal) + {bonus} + {terms} + CASE work_mode WHEN 'remote' THEN 5 WHEN 'hybrid' THEN 3 ELSE 0 END
  + CASE WHEN created IS NULL THEN 0 WHEN {age} <= 3 THEN 8 WHEN {age} <= 7 THEN 6 WHEN {age} <= 14 THEN 4 WHEN {age} <= 30 THEN 2 ELSE 0 END)::INT AS priority FROM parts)"""


def hard_soft(pack: RulePack = FIXTURE) -> tuple[str, str]:
    bare = "text_n"
    for p in pack.exclude_exceptions:
        bare = f"replace({bare}, {q(p)}, ' ')"
    found, titled = hits(bare, pack.exclude), hits("title_n", pack.exclude)
    soft = f"list_filter({found}, lambda w: list_contains({listed(pack.soft_outside_title)}, w) AND NOT list_contains({titled}, w))"
    hard = f"list_filter({found}, lambda w: NOT (list_contains({listed(pack.soft_outside_title)}, w) AND NOT list_contains({titled}, w)))"
    return hard, soft


def location(pack: RulePack = FIXTURE) -> str:
    return f"(NOT {contains_any(chr(40) + 'loc_n || chr(32) || title_n)', pack.blocked_locations)} AND (loc_n = '' OR {contains_any('loc_n', pack.allowed_locations)}))"


def steps(pack: RulePack = FIXTURE) -> list[tuple[str, str]]:
    blocked = "language_label = 'required'" if pack.mode == "broad" else "language_label IN ('required', 'alternative')"
    return [
        ("description_short", f"length(plain) >= {pack.min_description}"),
        ("bad_title", f"NOT {contains_any('title_n', pack.bad_titles)}"),
        ("not_recent", f"coalesce(created > TIMESTAMP {q(pack.as_of)} - INTERVAL {pack.max_age_days} DAY, false)"),
        ("location", location(pack)),
        ("role", f"(NOT {contains_any('title_n', pack.role_forbidden)} AND {hit_any('title_n', pack.role_required)})"),
        ("student_internship", f"NOT (NOT {contains_any('text_n', pack.student_allowed)} AND {contains_any('text_n', pack.student_markers)})"),
        ("generic_internship", f"NOT {hit_any('text_n', pack.internship_markers)}"),
        ("excluded_word", f"len({hard_soft(pack)[0]}) = 0"),
        ("experience", "experience_level <> 'hard'"),
        ("blocked_language", f"NOT ({blocked})"),
        *([("detected_language", f"{language('substring(plain, 1, 800)')} NOT IN ({', '.join(map(q, pack.blocked_codes))})")] if pack.blocked_codes and pack.mode == "strict" else []),
        ("junior_score", f"junior_score >= {-1 if pack.mode == 'broad' else 0}"),
    ]


def first_fail(pack: RulePack = FIXTURE) -> str:
    return "CASE " + " ".join(f"WHEN NOT ({ok}) THEN '{n}'" for n, ok in steps(pack)) + " ELSE '' END"


def passes(pack: RulePack = FIXTURE) -> str:
    return " AND ".join(f"({ok})" for _, ok in steps(pack))


def outcome(x: str = "status") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in OUTCOME.items()) + " ELSE 0 END"


def feedback(key: str) -> str:
    return f"SELECT {key}, greatest(-4, least(4, round_even(avg(w), 0)::INT)) AS feedback FROM (SELECT {key}, {outcome()} AS w FROM scored) WHERE w <> 0 GROUP BY {key}"


def queued(pack: RulePack = FIXTURE) -> str:
    """CTEs up to `ranked`, open rows with action and company_rank."""
    adj = f"greatest(-30, -10 * {count_in('title_n', pack.role_forbidden)})"
    order = "(action = 'apply_now')::INT DESC, adjusted DESC, sponsorship_score DESC, hiring_score DESC, language_fit DESC, junior_score DESC, created DESC NULLS LAST, row_id"
    return f"""{scored(pack)},
by_company AS ({feedback('company')}), by_term AS ({feedback('search_term')}),
fed AS (SELECT s.*, greatest(-6, least(6, coalesce(c.feedback, 0) + coalesce(t.feedback, 0)))::INT AS feedback_score
        FROM scored s LEFT JOIN by_company c USING (company) LEFT JOIN by_term t USING (search_term)),
adj AS (SELECT *, (priority + feedback_score + {adj})::INT AS adjusted FROM fed),
acted AS (SELECT *, CASE WHEN adjusted < {pack.apply_min} THEN 'review' ELSE 'apply_now' END AS action FROM adj),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {company_key('company')} ORDER BY {order})::INT AS company_rank FROM acted WHERE status NOT IN ({', '.join(map(q, CLOSED))})),
top AS (SELECT * FROM ranked WHERE company_rank <= {pack.company_cap} ORDER BY {order} LIMIT {pack.queue_size})"""
