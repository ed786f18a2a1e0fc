"""Rule packs of the nine markets, and which of them a run takes.

A pack's vocabularies are fields that say how their words match (operators.phrases.KINDS). Packs of other markets are made
from JSON or with dataclasses.replace().
"""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping
from typing import Any

from textforge import vocabularies as V

Words = tuple[str, ...]

DEFAULT_MARKET, FOCUSES, MODES, JOB_MODES = "be", ("all", "romandie"), ("strict", "broad"), ("strict", "speed")


def words(kind: str, given: Words = ()) -> Any:
    return dataclasses.field(default=given, metadata={"kind": kind})


@dataclasses.dataclass(frozen=True)
class Market:
    """One market's rules. The defaults hold for every market."""

    name: str = ""
    focus: str = "all"
    #: Wider search for support and release roles.
    speed: bool = False
    min_description: int = 60
    max_age_days: int = 45
    #: Places must be among the allowed ones; or foreign ones fail, unless an allowed one is named as well.
    enforce_places: bool = False
    foreign_rule: bool = False
    #: Internships fail, whoever they are for.
    drops_internships: bool = False
    #: The small queue takes clear titles only, and penalises languages and titles that are not aimed at.
    gated: bool = False
    sponsor_factor: int = 1
    region_bonus: int = 0
    allowed_codes: Words = ("fr", "en")
    blocked_codes: Words = ()
    country: str = ""
    place_name: str = ""
    sources: Words = ()
    search_terms: Words = ()
    term_pages: tuple[tuple[str, int], ...] = V.TERM_PAGES
    term_weights: tuple[tuple[str, int], ...] = V.TERM_WEIGHTS
    tracks: tuple[tuple[str, Words], ...] = (
        ("infra_ops", V.TRACK_INFRA_OPS), ("web_backend", V.TRACK_WEB_BACKEND), ("data_ai", V.TRACK_DATA_AI), ("qa_test", V.TRACK_QA_TEST), ("business_apps", V.TRACK_BUSINESS_APPS),
    )
    track_bonus: tuple[tuple[str, int], ...] = V.TRACK_BONUS
    clusters: tuple[tuple[str, Words], ...] = ()
    queue_languages: tuple[tuple[str, Words], ...] = ()
    queue_titles: tuple[tuple[str, Words], ...] = ()

    bad_titles: Words = words("part", V.BAD_TITLES)
    allowed_places: Words = words("inside")
    blocked_places: Words = words("inside")
    foreign_places: Words = words("inside")
    region_places: Words = words("part", V.ROMANDIE)
    remote_terms: Words = words("word", ("remote", "fully remote", "teletravail", "telework", "work from home", "home office", "wfh", "distributed"))
    hybrid_terms: Words = words("word", ("hybrid", "hybride", "2 days onsite", "3 days onsite"))
    onsite_terms: Words = words("word", ("on site", "on-site", "onsite", "presentiel", "office based", "site based"))
    title_blockers: Words = words("part", V.TITLE_BLOCKERS)
    forbidden: Words = words("word", V.FORBIDDEN_ROLES)
    #: Forbidden words that only count in context of their own rules.
    forbidden_skip: Words = words("word", ("keycloak", "commercial", "delivery"))
    commercial: Words = words("word", ("commercial",))
    commercial_markers: Words = words("word", V.COMMERCIAL)
    commercial_harmless: Words = words("part", ("commercial sector", "commercial vessels", "commercial operations"))
    primary_titles: Words = words("word", V.PRIMARY_TITLES)
    required: Words = words("word", V.ROLES)
    infra_evidence: Words = words("word", V.INFRA_EVIDENCE)
    industrial: Words = words("word", V.INDUSTRIAL)
    speed_roles: Words = words("word", V.SPEED_ROLES)
    training: Words = words("word", V.TRAINING)
    training_titles: Words = words("word", V.TRAINING_TITLES)
    training_subjects: Words = words("word", V.TRAINING_SUBJECTS)
    aliases: Words = words("word", V.ALIASES)
    #: Aliases that need one of the signals.
    broad_aliases: Words = words("word", ("automation engineer",))
    alias_signals: Words = words("word", V.ALIAS_SIGNALS)
    fallback_titles: Words = words("word", V.FALLBACK_TITLES)
    internship_allowed: Words = words("word", ("graduate program", "early careers", "new grad", "entry-level program", "entry level program", "no internship agreement required", "open to graduates", "open to graduate"))
    internship_agreement: Words = words("word", ("internship agreement", "convention de stage", "stage agreement", "school contract"))
    internship_student: Words = words("word", ("must be enrolled", "currently enrolled", "student", "etudiant", "universite", "campus"))
    internship_thesis: Words = words("word", ("master thesis", "thesis", "memoire"))
    internship_stage: Words = words("lone", ("stage", "stagiaire"))
    internship_intern: Words = words("lone", ("internship", "intern"))
    excluded: Words = words("token", V.EXCLUDED)
    #: Of the excluded words those that are soft outside the title, and the one that counts in a role's context only.
    title_only: Words = words("token", V.TITLE_ONLY)
    contextual: Words = words("token", ("senior",))
    hard_experience: Words = words("word", V.HARD_EXPERIENCE)
    soft_experience: Words = words("word", V.SOFT_EXPERIENCE)
    soft_signals: Words = words("word", ("experience confirmee", "experience significative", "experience solide", "profil confirme", "confirmed experience", "strong experience", "solid experience", "proven experience"))
    junior_titles: Words = words("word", ("junior", "graduate", "entry level", "entry-level", "trainee", "new grad", "early careers"))
    junior_contexts: Words = words("word", (
        "junior", "graduate", "entry level", "entry-level", "trainee", "traineeship", "starter", "will be trained", "training provided", "we hire for potential", "hire for potential",
        "no prior experience required", "no experience required", "open to graduates", "young talent",
    ))
    lead_titles: Words = words("word", V.LEAD_TITLES)
    senior_titles: Words = words("bounded", V.SENIOR_TITLES)
    apprenticeship: Words = words("word", V.APPRENTICESHIP)
    trainer: Words = words("word", V.TRAINER)
    network_titles: Words = words("word", ("network engineer", "ingenieur reseau"))
    senior_network: Words = words("part", V.SENIOR_NETWORK)
    infra: Words = words("word", V.INFRA)
    infra_titles: Words = words("word", V.INFRA_TITLES)
    qa_bridge: Words = words("word", V.QA_BRIDGE)
    core_titles: Words = words("word", V.CORE_TITLES)
    finance: Words = words("word", V.FINANCE)
    business_analysis: Words = words("word", V.BUSINESS_ANALYSIS)
    manual: Words = words("word", ("manual",))
    tested: Words = words("word", ("test",))
    manual_qa: Words = words("word", V.MANUAL_QA)
    industrial_titles: Words = words("word", V.INDUSTRIAL_TITLES)
    automation_qa: Words = words("word", ("qa automation", "test automation"))
    junior_plus: Words = words("part", V.JUNIOR_PLUS)
    junior_minus: Words = words("part", V.JUNIOR_MINUS)
    junior_mild: Words = words("part", V.JUNIOR_MILD)
    hiring_plus: Words = words("word", V.HIRING_PLUS)
    hiring_minus: Words = words("word", V.HIRING_MINUS)
    priority_training: Words = words("part", V.PRIORITY_TRAINING)
    sponsor_plus: Words = words("inside", V.SPONSOR_PLUS)
    sponsor_minus: Words = words("inside", V.SPONSOR_MINUS)
    sponsors: Words = words("bounded", V.SPONSORS)
    global_signals: Words = words("part", V.GLOBAL_SIGNALS)

    @classmethod
    def vocabularies(cls) -> dict[str, str]:
        """Each vocabulary's kind."""
        return {f.name: f.metadata["kind"] for f in dataclasses.fields(cls) if "kind" in f.metadata}

    @classmethod
    def from_json(cls, text: str) -> Market:
        """A pack from an object of plain lists, numbers and names; what it leaves out is as in every market."""
        tuples = lambda v: tuple(tuples(x) for x in v) if isinstance(v, list) else v
        return cls(**{k: tuples(v) for k, v in json.loads(text).items()})

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), ensure_ascii=False)


def _weights(*lists: tuple[tuple[str, int], ...]) -> tuple[tuple[str, int], ...]:
    """Lists of weights as one, where a later weight of a term replaces an earlier one."""
    return tuple({t: w for pairs in lists for t, w in pairs}.items())


#: What differs by market. Fixed values.
MARKETS = {
    m.name: m
    for m in (
        Market("be", country="be", sources=("adzuna", "jooble"), allowed_places=V.BE_PLACES, blocked_codes=("nl", "de"), search_terms=V.BE_TERMS),
        Market(
            "ch", country="ch", place_name="Switzerland", sources=("adzuna", "jooble"), foreign_rule=True, region_bonus=5, allowed_places=V.CH_PLACES, blocked_places=V.CH_BLOCKED_PLACES,
            foreign_places=V.CH_FOREIGN_PLACES, blocked_codes=("de", "it", "nl"), search_terms=V.CH_TERMS, required=V.CH_ROLES, forbidden=V.FORBIDDEN_ROLES + V.CH_FORBIDDEN_ROLES,
            excluded=V.EXCLUDED + V.CH_EXCLUDED, bad_titles=V.BAD_TITLES + V.CH_BAD_TITLES, term_weights=_weights(V.TERM_WEIGHTS, V.CH_TERM_WEIGHTS),
        ),
        Market(
            "ma", country="ma", place_name="Morocco", sources=("emploi_ma", "rekrute", "marocannonces"), enforce_places=True, drops_internships=True, gated=True, allowed_codes=("fr", "en", "ar"),
            allowed_places=V.MA_PLACES, search_terms=V.MA_TERMS, required=V.MA_ROLES, forbidden=V.FORBIDDEN_ROLES + V.MA_FORBIDDEN_ROLES, clusters=V.MA_CLUSTERS,
            queue_languages=V.MA_QUEUE_LANGUAGES, queue_titles=V.MA_QUEUE_TITLES,
        ),
        Market("nl", country="nl", place_name="Netherlands", sources=("adzuna", "jooble"), sponsor_factor=2, allowed_places=V.NL_PLACES, blocked_codes=("nl", "de"), search_terms=V.NL_TERMS),
        Market("de", country="de", place_name="Germany", sources=("adzuna", "jooble"), sponsor_factor=2, allowed_places=V.DE_PLACES, blocked_places=V.DE_BLOCKED_PLACES, blocked_codes=("de",), search_terms=V.DE_TERMS),
        Market(
            "fr", country="fr", place_name="France", sources=("adzuna", "jooble"), allowed_places=V.FR_PLACES, search_terms=V.FR_TERMS, excluded=V.EXCLUDED + V.FR_EXCLUDED,
            bad_titles=V.BAD_TITLES + V.FR_BAD_TITLES,
        ),
        Market("gb", country="gb", place_name="United Kingdom", sources=("adzuna", "jooble"), allowed_places=V.GB_PLACES, blocked_codes=("nl", "de"), search_terms=V.GB_TERMS),
        Market("ie", country="ie", place_name="Ireland", sources=("jooble",), allowed_places=V.IE_PLACES, blocked_codes=("nl", "de"), search_terms=V.GB_TERMS),
        Market("ae", country="ae", place_name="Dubai", sources=("jooble",), allowed_codes=("fr", "en", "ar"), allowed_places=V.AE_PLACES, search_terms=V.AE_TERMS),
    )
}


def _chosen(what: str, given: str, variable: str, default: str, known: tuple[str, ...], environment: Mapping[str, str]) -> str:
    value = (given or environment.get(variable) or default).strip().lower()
    if value not in known:
        raise ValueError(f"{what} {value!r} is none of {', '.join(known)}")
    return value


def resolve(market: str = "", focus: str = "", mode: str = "", job_mode: str = "", environment: Mapping[str, str] | None = None) -> tuple[Market, str]:
    """The pack and the filter mode of a run: what is given comes before the environment, that before the default.

    The environment's names are JOB_MARKET, JOB_CH_FOCUS, JOB_FILTER_MODE and JOB_MODE; a focus holds in market ch only.
    """
    env = os.environ if environment is None else environment
    pack = MARKETS[_chosen("market", market, "JOB_MARKET", DEFAULT_MARKET, tuple(MARKETS), env)]
    if pack.name == "ch" and _chosen("focus", focus, "JOB_CH_FOCUS", "all", FOCUSES, env) == "romandie":
        pack = dataclasses.replace(pack, focus="romandie", enforce_places=True, allowed_places=V.CH_ROMANDIE_PLACES, blocked_places=())
    pack = dataclasses.replace(pack, speed=_chosen("job mode", job_mode, "JOB_MODE", "strict", JOB_MODES, env) == "speed")
    return pack, _chosen("mode", mode, "JOB_FILTER_MODE", "strict", MODES, env)


#: The stages of a market's run by source, and those without one. Fixed values.
SOURCE_STAGES = ("jobs_raw", "jobs_filtered", "jobs_filtered_strict", "jobs_filtered_broad")
STAGES = (
    "all_jobs_merged", "all_jobs_merged_raw", "all_jobs_merged_filtered", "all_jobs_merged_filtered_strict", "all_jobs_merged_filtered_broad",
    "apply_queue", "applications_tracker", "daily_alert_state", "near_miss_jobs", "term_performance",
)
SOURCES = ("adzuna", "emploi_ma", "rekrute", "marocannonces", "jooble")


def outputs(market: str, root: str = "data") -> dict[str, str]:
    """The path of each of a market's tables; the default market's names have no prefix."""
    prefix = "" if market == DEFAULT_MARKET else f"{market}_"
    names = [f"{s}_{stage}" for s in SOURCES for stage in SOURCE_STAGES] + list(STAGES)
    return {n: f"{root}/{prefix}{n}" for n in names}
