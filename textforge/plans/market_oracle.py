"""DuckDB SQL that says independently what the market rules compute, over the job view: regular expressions and list functions, row by row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from textforge import vocabularies as V
from textforge.functions.text import normalised
from textforge.markets import MARKETS, Market
from textforge.operators import language, roles, rules
from textforge.plans import oracle as O
from textforge.sources.jobs import JOBS_SQL

KINDS = Market.vocabularies()
AS_OF = "1999-01-01 00:00:00"
_PLAIN = re.compile("[a-z0-9 ]+")


def _shaped(kind: str, words: Sequence[str]) -> list[str]:
    out = [w if kind in ("bounded", "part") else normalised(w) for w in words]
    return list(dict.fromkeys(w for w in out if w))


def _words(pack: Market, name: str) -> list[str]:
    out = _shaped(KINDS[name], getattr(pack, name))
    return [w for w in out if w not in _shaped("word", pack.forbidden_skip)] if name == "forbidden" else out


#: Lists and values that differ between the packs, as columns of the table `packs`.
DIFFERING = [n for n in KINDS if any(_words(p, n) != _words(MARKETS["be"], n) for p in MARKETS.values())]
VALUES = ("enforce_places", "foreign_rule", "drops_internships", "sponsor_factor", "region_bonus")


def _list(words: Sequence[str]) -> str:
    return "[" + ", ".join(map(O.q, words)) + "]::VARCHAR[]"


def packs() -> str:
    rows = []
    for p in MARKETS.values():
        terms = "[" + ", ".join(f"{{'w': {O.q(normalised(t))}, 'n': {w}}}" for t, w in p.term_weights) + "]"
        rows.append("(" + ", ".join([O.q(p.name), *(_list(_words(p, n)) for n in DIFFERING), *(str(getattr(p, v)).lower() for v in VALUES), _list(p.blocked_codes), terms]) + ")")
    return f"packs(pack_name, {', '.join(f'pk_{n}' for n in DIFFERING)}, {', '.join(VALUES)}, blocked_codes, term_weights) AS (VALUES {', '.join(rows)})"


def _test(kind: str, where: str, w: str = "w") -> str:
    """Whether the phrase w, which is contained in `where`, matches as its kind says."""
    around = lambda c: f"regexp_matches({where}, '(^|{c})' || regexp_escape({w}) || '({c}|$)')"
    return {
        "word": f"(NOT regexp_full_match({w}, '[a-z0-9 ]+') OR {around('[^a-z0-9]')})", "lone": around("[^a-z0-9_]"),
        "token": f"(NOT regexp_full_match({w}, '[\\p{{L}}\\p{{N}}_]+') OR {around('[^\\p{L}\\p{N}_]')})",
        "bounded": f"regexp_matches({where}, '\\b' || regexp_escape({w}) || '\\b')", "inside": "true", "part": "true",
    }[kind]


def found(where: str, name: str) -> str:
    """The list's phrases that stand there, in the list's order."""
    words = f"pk_{name}" if name in DIFFERING else _list(_words(MARKETS["be"], name))
    return f"coalesce(list_filter(list_filter({words}, lambda w: contains({where}, w)), lambda w: {_test(KINDS[name], where)}), [])"


def has(where: str, name: str) -> str:
    return f"(len({found(where, name)}) > 0)"


def any_pattern(where: str, patterns: Sequence[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({where}, {O.q(p)})" for p in patterns) + ")"


def first_pattern(where: str, patterns: Sequence[str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({where}, {O.q(p)}) THEN {O.q(p)}" for p in patterns) + " ELSE '' END"


def named() -> str:
    """Forbidden words that the description names as the role: each place of a word by splitting the text at it."""
    start = "(list_sum(list_transform(string_split(desc_n, w)[1:k], lambda x: length(x))) + (k - 1) * length(w))"
    at = f"list_transform(range(1, len(string_split(desc_n, w))), lambda k: {start}::BIGINT)"
    left, near = "substring(desc_n, greatest(0, s - 160) + 1, s - greatest(0, s - 160))", "substring(desc_n, greatest(0, s - 90) + 1, s + length(w) + 120 - greatest(0, s - 90))"
    alone = "(s = 0 OR NOT regexp_matches(substring(desc_n, s, 1), '[a-z0-9]')) AND NOT regexp_matches(substring(desc_n, s + length(w) + 1, 1), '[a-z0-9]')"
    counts = f"NOT {any_pattern(near, rules.PEOPLE)} AND (s <= 360 OR {any_pattern(left, rules.HEADINGS)})"
    return f"list_filter(list_filter(coalesce(pk_forbidden, []), lambda w: contains(desc_n, w)), lambda w: len(list_filter({at}, lambda s: ({alone}) AND ({counts}))) > 0)"


def _spans(pattern: str) -> str:
    """{m, s, e} of each match of a pattern in text_n: what stands between the matches tells their places."""
    p = O.q(pattern)
    s = f"(list_sum(list_transform(string_split_regex(text_n, {p})[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(text_n, {p})[1:k-1], lambda x: length(x))), 0))::BIGINT"
    return f"list_transform(range(1, len(regexp_extract_all(text_n, {p})) + 1), lambda k: {{'m': regexp_extract_all(text_n, {p})[k], 's': {s}, 'e': {s} + length(regexp_extract_all(text_n, {p})[k])}})"


def asked() -> str:
    """CTEs spans, ranged, asked: years, told, is_range of each row."""
    near = lambda x: f"contains(substring(text_n, greatest(0, {x}.s - 40) + 1, {x}.e + 40 - greatest(0, {x}.s - 40)), 'experience')"
    low, high = (f"regexp_extract(x.m, {O.q(roles.YEAR_RANGE)}, {k})::INT" for k in (1, 2))
    singles = [f"list_transform({_spans(p)}, lambda x: {{'y': regexp_extract(x.m, {O.q(p)}, 1)::INT, 'm': x.m, 's': x.s, 'e': x.e}})" for p in roles.YEARS]
    return f"""spans AS (
  SELECT *, CASE WHEN contains(text_n, 'experience') THEN list_filter({_spans(roles.YEAR_RANGE)}, lambda x: {low} <= {high} AND {high} <= 15 AND {near('x')}) ELSE [] END AS ranges,
    CASE WHEN contains(text_n, 'experience') THEN flatten([{', '.join(singles)}]) ELSE [] END AS singles FROM marked),
ranged AS (
  SELECT *, list_transform(ranges, lambda x: {{'y': {low}, 'r': 1, 'm': x.m}})
    || list_transform(list_filter(singles, lambda x: x.y <= 15 AND {near('x')} AND len(list_filter(ranges, lambda g: x.e > g.s AND g.e > x.s)) = 0), lambda x: {{'y': x.y, 'r': 0, 'm': x.m}}) AS told FROM spans),
chosen AS (SELECT *, list_max(list_transform(range(1, len(told) + 1), lambda i: {{'y': told[i].y, 'r': told[i].r, 'i': -i}})) AS best FROM ranged),
asked AS (SELECT * EXCLUDE (spans_), best.y AS years, coalesce(told[-best.i].m, '') AS detail, coalesce(best.r = 1, false) AS is_range FROM (SELECT *, NULL AS spans_ FROM chosen))"""


def _number(x: str) -> str:
    return f"try_cast(nullif(regexp_extract({x}, '\\b(\\d{{1,2}})\\b', 1), '') AS INT)"


def leveled() -> str:
    """CTE leveled: level, level_detail, level_years."""
    conflict = O.q(roles.CONFLICT)
    soft = lambda detail, years: f"CASE WHEN junior THEN {{'l': 'soft_junior_title', 'd': {conflict}, 'y': {years}}} ELSE {{'l': 'soft', 'd': {detail}, 'y': {years}}} END"
    answer = lambda level, detail, years: f"{{'l': '{level}', 'd': {detail}, 'y': {years}}}"
    return f"""signs AS (
  SELECT *, ({has('title_n', 'junior_titles')} OR {has('text_n', 'junior_contexts')}) AS junior, {found('text_n', 'hard_experience')}[1] AS hard_phrase, {found('text_n', 'soft_experience')}[1] AS soft_phrase,
    {found('text_n', 'soft_signals')}[1] AS signal FROM asked),
numbered AS (SELECT *, {_number('hard_phrase')} AS hard_years, {_number('soft_phrase')} AS soft_years FROM signs),
judged AS (SELECT *, CASE WHEN years >= 5 THEN {answer('hard', 'detail', 'years')} WHEN years >= 3 OR (years IS NOT NULL AND is_range) THEN {soft('detail', 'years')} WHEN years IS NOT NULL THEN {answer('none', "''", 'years')}
    WHEN hard_phrase IS NOT NULL THEN CASE WHEN coalesce(hard_years >= 5, false) OR NOT junior THEN {answer('hard', 'hard_phrase', 'hard_years')} ELSE {answer('soft_junior_title', conflict, 'hard_years')} END
    WHEN soft_phrase IS NOT NULL THEN CASE WHEN soft_years <= 2 THEN {answer('none', "''", 'soft_years')} WHEN soft_years >= 5 THEN {answer('hard', 'soft_phrase', 'soft_years')} ELSE {soft('soft_phrase', 'soft_years')} END
    WHEN signal IS NOT NULL THEN {soft('signal', 'NULL::INT')} ELSE {answer('none', "''", 'NULL::INT')} END AS answer FROM numbered),
leveled AS (SELECT *, answer.l AS level, answer.d AS level_detail, answer.y AS level_years FROM judged)"""


def spoken() -> str:
    """CTEs clauses to spoken: what the text says of languages."""
    r = language.LanguageRules()
    names = dict(r.names)
    lang = lambda c, code: f"regexp_matches({c}, '(^|[^a-z0-9])(?:{'|'.join(names[code])})([^a-z0-9]|$)')"
    picked = lambda pairs: "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in pairs) + "], lambda v: v IS NOT NULL)"
    every = "\\b(?:" + "|".join(n for code, ns in r.names for n in (*ns, code)) + ")\\b"
    context = language.near(language.any_word([n for c in r.blocked for n in names[c]]), r.near_cues)
    main = language.near(language.any_word(names[r.main]), r.main_cues)
    snip = "CASE WHEN length(c.c) > 140 THEN rtrim(substring(c.c, 1, 137)) || '...' ELSE c.c END"
    rungs = [("title", 0.99, "'title:'", "''"), ("learn", 0.65, "'learn:'", first_pattern("text_n", r.learn)), ("strong", 0.95, "'required:'", first_pattern("text_n", r.strong)),
             ("choice", 0.15, "'alternative:'", first_pattern("text_n", r.choice)), ("plus", 0.1, "'plus:'", first_pattern("text_n", r.plus)),
             ("context", 0.8, "'required:'", f"CASE WHEN regexp_matches(text_n, {O.q(main)}) THEN 'context_window' ELSE '' END")]
    ladder = "CASE " + " ".join(f"WHEN ({p}) <> '' THEN {{'rung': '{n}', 'sure': {sure}::DOUBLE, 'found': {kind} || ({p})}}" for n, sure, kind, p in rungs[1:]) + " ELSE {'rung': 'none', 'sure': 0.0::DOUBLE, 'found': ''} END"
    union = lambda field: f"list_sort(list_distinct(flatten(list_transform(said, lambda s: s.{field}))))"
    return f"""clauses AS (
  SELECT *, list_filter(list_transform(list_filter(list_transform(string_split_regex(text_n, '[;,\\n.|]+'), lambda x: trim(x)), lambda x: x <> ''),
    lambda x: {{'c': x, 'langs': {picked([(c, lang('x', c)) for c in names])}}}), lambda x: len(x.langs) > 0) AS clauses FROM leveled),
cued AS (SELECT *, list_transform(clauses, lambda x: {{'c': x.c, 'langs': x.langs,
    'must0': list_filter({picked([(code, any_pattern('x.c', p)) for code, p in r.required_patterns])}, lambda v: list_contains(x.langs, v)),
    'nice': list_filter({picked([(code, any_pattern('x.c', p)) for code, p in r.optional_patterns])}, lambda v: list_contains(x.langs, v)),
    'cue': regexp_matches(x.c, {O.q(r.required_cues)}), 'plus': regexp_matches(x.c, {O.q(r.optional_cues)}) OR {any_pattern('x.c', [p for _, ps in r.optional_patterns for p in ps])},
    'blocked': CASE WHEN regexp_matches(x.c, {O.q(context)}) THEN list_filter(x.langs, lambda v: v IN ('nl', 'de')) ELSE [] END,
    'several': len(x.langs) > 1, 'both': regexp_matches(x.c, {O.q(r.both)}), 'three': len(x.langs) > 1 AND regexp_matches(x.c, {O.q(r.trilingual)}),
    'choice': len(x.langs) > 1 AND regexp_matches(x.c, {O.q(every + '\\s*' + r.either + '\\s*' + every)})}}) AS cued FROM clauses),
weighed AS (SELECT *, list_transform(cued, lambda x: {{'x': x, 'must': list_distinct(x.must0 || x.blocked), 'cue': (x.cue AND NOT (x.plus AND len(x.must0) = 0)) OR len(x.blocked) > 0}}) AS weighed FROM cued),
said AS (SELECT *, list_transform(weighed, lambda w: {{
    'required': CASE WHEN (w.x.several AND w.x.both AND w.cue) OR w.x.three THEN w.x.langs ELSE [] END
      || CASE WHEN w.x.choice THEN [] WHEN len(w.must) > 0 THEN w.must WHEN w.x.plus AND NOT w.cue AND NOT w.x.three THEN [] WHEN w.cue OR w.x.three THEN w.x.langs ELSE [] END,
    'optional': w.x.nice || CASE WHEN NOT w.x.choice AND len(w.must) = 0 AND w.x.plus AND NOT w.cue AND NOT w.x.three THEN w.x.langs ELSE [] END,
    'choice': CASE WHEN w.x.choice THEN w.x.langs ELSE [] END,
    'evidence': CASE WHEN w.x.choice OR len(w.must) > 0 OR w.x.plus OR w.cue OR w.x.three THEN [{snip.replace('c.c', 'w.x.c')}] ELSE [] END}}) AS said, {ladder} AS ladder FROM weighed),
parsed AS (SELECT *, {union('required')} AS p_required, {union('optional')} AS p_optional, {union('choice')} AS choice,
    list_filter(flatten(list_transform(said, lambda s: s.evidence)), lambda e, i: list_position(flatten(list_transform(said, lambda s: s.evidence)), e) = i)[1:5] AS evidence,
    ladder.rung IN ('title', 'strong', 'context') AS must_main, ladder.rung = 'learn' AS learn, {any_pattern('text_n', r.english_only)} AS english_only FROM said),
needed AS (SELECT *, list_sort(CASE WHEN must_main THEN list_distinct(p_required || ['nl']) ELSE list_filter(p_required, lambda v: v <> 'nl') END) AS required,
    list_sort(CASE WHEN must_main THEN list_filter(p_optional, lambda v: v <> 'nl') WHEN learn OR ladder.rung = 'plus' THEN list_distinct(p_optional || ['nl']) ELSE p_optional END) AS optional,
    NOT must_main AND (ladder.rung = 'choice' OR (list_contains(choice, 'fr') AND list_contains(choice, 'nl')) OR {any_pattern('text_n', r.acceptable)}) AS accepts FROM parsed),
spoken AS (SELECT *, list_filter(required, lambda v: list_contains(coalesce(blocked_codes, []), v)) AS hindering, list_contains(optional, 'nl') AND NOT must_main AS prefers FROM needed)"""


BLOCKED = "CASE WHEN learn OR len(hindering) = 0 THEN '' WHEN list_contains(hindering, 'nl') THEN 'blocked_language_req:dutch_required' WHEN list_contains(hindering, 'de') THEN 'blocked_language_req:german_required' ELSE 'blocked_language_req:' || list_sort(hindering)[1] || '_required' END"
REVIEW = "CASE WHEN learn THEN 'language_alternative:dutch_preferred_or_learn' WHEN len(choice) > 0 AND list_has_any(choice, ['nl', 'de']) AND NOT list_contains(choice, 'fr') THEN 'language_alternative:blocked_language_option' ELSE '' END"


def read() -> str:
    """CTEs jobs to marked: normalised texts, the row's pack, and the texts that some rules look at instead."""
    plain = f"CASE WHEN {O.html_like(O.decoded('description'))} OR regexp_matches({O.decoded('description')}, '(?s)<[^>]+>') THEN {O.plain_html('description')} ELSE {O.flat(O.decoded('description'))} END"
    bare = "(' ' || text_n || ' ')"
    for e in map(normalised, V.EXCLUDED_EXCEPTIONS):
        bare = f"replace(replace({bare}, {O.q(f' {e} ')}, ' '), {O.q(e)}, ' ')"
    quiet = "text_n"
    for p in rules.INTERNSHIP_NOISE:
        quiet = f"regexp_replace({quiet}, {O.q(p)}, ' ', 'g')"
    return f"""{O.POSTING},
{JOBS_SQL},
{packs()},
plained AS (SELECT *, {plain} AS plain FROM jobs),
normal AS (SELECT *, {O.norm('title')} AS title_n, {O.norm('plain')} AS desc_n, {O.norm('location')} AS loc_n, {O.norm('company')} AS company_n FROM plained),
texted AS (SELECT *, concat_ws(' ', nullif(title_n, ''), nullif(desc_n, '')) AS text_n, concat_ws(' ', nullif(loc_n, ''), nullif(title_n, '')) AS place_n,
  concat_ws(' ', nullif(loc_n, ''), nullif(title_n, ''), nullif(desc_n, '')) AS every_n, concat_ws(' ', nullif(title_n, ''), nullif(desc_n, ''), nullif(loc_n, '')) AS work_n FROM normal),
marked AS (SELECT *, {O.flat(bare)} AS bare_n, {O.flat(quiet)} AS quiet_n FROM texted LEFT JOIN packs ON market = pack_name)"""


def rolled() -> str:
    """CTEs to `rolled`: labels of every row."""
    hy, re_, on = (has("work_n", n) for n in ("hybrid_terms", "remote_terms", "onsite_terms"))
    named_words = "list_filter(coalesce(pk_forbidden, []), lambda w: list_contains(title_words, w) OR list_contains(named_words, w))[1]"
    commercial = f"{has('text_n', 'commercial')} AND NOT {has('text_n', 'commercial_harmless')} AND {has('text_n', 'commercial_markers')}"
    title, text = "title_n", "text_n"
    role = (
        f"CASE WHEN {has(title, 'title_blockers')} THEN 'blocked_title' WHEN forbidden_reason <> '' THEN 'forbidden' WHEN {has(title, 'primary_titles')} THEN 'primary_title' "
        f"WHEN {has(text, 'required')} AND NOT {has('desc_n', 'industrial')} AND ({has(title, 'required')} OR {has('desc_n', 'infra_evidence')}) THEN 'required' "
        f"WHEN {has(text, 'training')} AND ({has(title, 'training_titles')} OR {has(text, 'training_subjects')}) THEN 'training' "
        f"WHEN {has(title, 'aliases')} AND NOT {has(text, 'industrial')} AND (NOT {has(title, 'broad_aliases')} OR {has(text, 'alias_signals')}) THEN 'alias' "
        f"WHEN {has(title, 'fallback_titles')} OR {any_pattern(title, roles.FALLBACK_TITLES)} THEN 'fallback' ELSE 'none' END"
    )
    student = f"CASE WHEN open_to THEN '' WHEN {has('quiet_n', 'internship_agreement')} THEN 'internship_agreement_required' WHEN {has('quiet_n', 'internship_student')} THEN 'student_only_keyword' WHEN {has('quiet_n', 'internship_thesis')} THEN 'thesis_keyword' ELSE '' END"
    speaks = f"(regexp_matches(lower(title), '\\b(senior|sr\\.?|lead|principal)\\b') OR coalesce(level_years >= 5, false) OR {any_pattern(text, roles.SENIOR_CONTEXT)})"
    return f"""{read()}, {asked()}, {leveled()}, {spoken()},
words AS (SELECT *, {found(title, 'forbidden')} AS title_words, {named()} AS named_words, {has('quiet_n', 'internship_allowed')} AS open_to,
  CASE WHEN {hy} OR ({re_} AND {on}) THEN 'hybrid' WHEN {re_} THEN 'remote' WHEN {on} THEN 'onsite' ELSE 'unknown' END AS work_mode FROM spoken),
reasoned AS (SELECT *, coalesce({named_words}, CASE WHEN {any_pattern(text, roles.DELIVERY)} THEN 'delivery_role' WHEN {commercial} THEN 'commercial_sales' ELSE '' END) AS forbidden_reason,
  {student} AS student, list_filter({found('bare_n', 'excluded')}, lambda w: w <> 'senior' OR {speaks}) AS excluded_words FROM words),
softened AS (SELECT *, list_filter(excluded_words, lambda w: list_contains({_list(_shaped('token', MARKETS['be'].title_only))}, w) AND NOT list_contains({found(title, 'excluded')}, w)) AS soft FROM reasoned),
rolled AS (SELECT *, {role} AS role_step, list_filter(excluded_words, lambda w: NOT list_contains(soft, w)) AS hard,
  CASE WHEN open_to OR student <> '' THEN '' WHEN {has('quiet_n', 'internship_stage')} THEN 'stage_keyword' WHEN {has('quiet_n', 'internship_intern')} THEN 'internship_keyword' ELSE '' END AS general,
  (2 * len({found(text, 'junior_plus')}) - 2 * len({found(text, 'junior_minus')}) - len({found(text, 'junior_mild')}))::INT AS junior_score FROM softened)"""


def steps() -> list[tuple[str, str]]:
    """(name, passes) in order over `rolled`, but for the language that is identified."""
    abroad = f"({has('every_n', 'foreign_places')} AND NOT {has('every_n', 'allowed_places')})"
    place = (
        f"(NOT {has('place_n', 'blocked_places')} AND CASE WHEN foreign_rule AND (work_mode IN ('remote', 'hybrid') OR NOT enforce_places) THEN NOT {abroad} "
        f"WHEN NOT enforce_places THEN true ELSE loc_n = '' OR {has('loc_n', 'allowed_places')} END)"
    )
    return [
        ("known_market", "pack_name IS NOT NULL"), ("description_short", "length(plain) >= 60"), ("bad_title", f"NOT {has('title_n', 'bad_titles')}"),
        ("not_recent", f"coalesce(created > TIMESTAMP '{AS_OF}' - INTERVAL 2000 DAY, false)"), ("location", place), ("role", "role_step NOT IN ('blocked_title', 'forbidden', 'none')"),
        ("student_internship", "student = ''"), ("generic_internship", "(NOT drops_internships OR general = '')"), ("excluded_word", "len(hard) = 0"), ("experience", "level <> 'hard'"),
        ("blocked_language", f"({BLOCKED}) = ''"), ("detected_language", "true"), ("junior_score", "junior_score >= 0"),
    ]


def first_fail() -> str:
    return "CASE " + " ".join(f"WHEN NOT coalesce({ok}, false) THEN '{n}'" for n, ok in steps()) + " ELSE '' END"


def scored() -> str:
    """CTEs to `valued`: the scores of every row."""
    text = "text_n"
    tracks = " ".join(f"WHEN len({_track(ws)}) > 0 THEN {{'t': {O.q(n)}, 's': {_track(ws)}[1:4]}}" for n, ws in MARKETS["be"].tracks)
    bonus = "CASE track.t " + " ".join(f"WHEN {O.q(t)} THEN {b}" for t, b in MARKETS["be"].track_bonus) + " ELSE 0 END"
    age = f"floor((epoch(TIMESTAMP '{AS_OF}') - epoch(created)) / 86400)"
    owner = f"len(list_filter(list_filter(regexp_extract_all(desc_n, {O.q(rules.BELONGS)} || '(.{{0,60}})', 1), lambda a: a <> ''), lambda a: {has('a', 'sponsors')})) > 0"
    own = "(len(list_filter(required, lambda v: v IN ('fr', 'en'))) > 0 OR english_only OR accepts OR regexp_matches(text_n, '(^|[^a-z0-9])(?:french|francais|francophone|english|anglais|anglophone)([^a-z0-9]|$)') OR len(list_filter(optional, lambda v: v IN ('fr', 'en'))) > 0)"
    hindered = "(len(hindering) > 0 AND NOT accepts)"
    years = "CASE WHEN level_years <= 2 THEN 4 WHEN level_years = 3 THEN CASE WHEN level = 'soft_junior_title' THEN 1 ELSE -1 END WHEN level_years = 4 THEN -3 WHEN level_years >= 5 THEN -8 ELSE 0 END"
    return f"""{rolled()},
parts AS (SELECT *, CASE {tracks} ELSE {{'t': 'other_it', 's': []::VARCHAR[]}} END AS track,
  greatest(-20, least(20, 2 * len({found(text, 'hiring_plus')}) - 2 * len({found(text, 'hiring_minus')}) + {years} + CASE WHEN level = 'soft_junior_title' THEN 2 ELSE 0 END
    + CASE WHEN {hindered} THEN -6 WHEN prefers THEN -2 ELSE 0 END))::INT AS hiring_score,
  CASE WHEN {hindered} THEN 0 WHEN prefers THEN 1 WHEN {own} THEN 2 WHEN text_n <> '' THEN 1 ELSE 0 END AS language_fit,
  greatest(-10, least(10, CASE WHEN {has(text, 'sponsor_minus')} THEN -8 * len({found(text, 'sponsor_minus')}) ELSE 5 * len({found(text, 'sponsor_plus')}) END))::INT AS sponsorship_score,
  least(5, CASE WHEN {has('company_n', 'sponsors')} OR {owner} THEN 3 ELSE 0 END + CASE WHEN {has('desc_n', 'global_signals')} THEN 2 ELSE 0 END)::INT AS company_signal FROM rolled),
valued AS (SELECT *, (50 + 2 * greatest(0, junior_score) + 2 * language_fit + greatest(-4, least(6, hiring_score)) + {bonus} + list_sum(list_transform(list_prepend({{'w': '', 'n': 0}}, term_weights), lambda t: CASE WHEN contains(text_n, t.w) THEN t.n ELSE 0 END))
    + 2 * len({found(text, 'priority_training')}) + CASE work_mode WHEN 'remote' THEN 5 WHEN 'hybrid' THEN 3 ELSE 0 END + CASE WHEN {O.contains_any('loc_n', V.ROMANDIE)} THEN region_bonus ELSE 0 END
    + CASE WHEN created IS NULL THEN 0 WHEN {age} <= 3 THEN 8 WHEN {age} <= 7 THEN 6 WHEN {age} <= 14 THEN 4 WHEN {age} <= 30 THEN 2 ELSE 0 END)::INT AS plain_priority FROM parts)"""


def _track(words: Sequence[str]) -> str:
    return f"list_filter(list_filter({_list(_shaped('word', words))}, lambda w: contains(text_n, w)), lambda w: {_test('word', 'text_n')})"
