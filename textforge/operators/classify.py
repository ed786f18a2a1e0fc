"""Labels of a posting: work mode, location gate, excluded words, track, language requirement, experience."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textforge.functions import text as T
from textforge.operators import phrases
from textforge.rulepack import RulePack


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are evaluated once for each row.

    As a plain projection Catalyst would copy each expression into every later use of it; a generator of one row
    is a boundary that it leaves in place. It is not pruned either, so ask for the columns that are needed only.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def features(df: DataFrame) -> DataFrame:
    """Normalised columns that every rule uses, made once: title_n, desc_n, text_n, loc_n and the plain description."""
    out = computed(df, {"plain": T.rule_plain(F.col("description"))})
    out = computed(out, {"title_n": T.normalise(F.col("title")), "desc_n": T.normalise_flat(F.col("plain")), "loc_n": T.normalise(F.col("location"))})
    return computed(out, {"text_n": F.concat_ws(" ", T.blank_null(F.col("title_n")), T.blank_null(F.col("desc_n")))})


def looked(df: DataFrame, pack: RulePack) -> DataFrame:
    """df, which has features(), with `seen`: each of the pack's words looked for in the text; text() and bare() stand for the text then."""
    p = pack
    whole = (*p.remote_terms, *p.hybrid_terms, *p.onsite_terms, *p.blocked_language, *p.internship_markers, *p.hiring_plus, *p.hiring_minus)
    part = (
        *p.hard_experience, *p.soft_experience, *p.optional_language, *p.student_allowed, *p.student_markers, *p.junior_plus, *p.junior_minus, *p.junior_mild,
        *p.sponsor_plus, *p.sponsor_minus, *(t for t, _ in p.term_weights),
    )
    phrases.bounded(df.sparkSession)
    return df.withColumn("seen", phrases.looked(F.col("text_n"), {"hit": whole, "part": part, "bare": p.exclude}, p.exclude_exceptions))


def text() -> T.Seen:
    """The text of looked() rows, in which any of the pack's words can be asked for."""
    return T.Seen(F.col("seen"))


def bare() -> T.Seen:
    """The same without benign phrases, in which excluded words can be asked for."""
    return T.Seen(F.col("seen"), "bare")


def job_text(df: DataFrame) -> Column:
    """Title, description, company and location as one normalised text."""
    parts = [T.blank_null(T.rule_plain(F.col(c))) for c in ("title", "description", "company", "location")]
    return T.normalise(F.concat_ws(" ", *parts))


def work_mode(text: Column | T.Seen, pack: RulePack) -> Column:
    hybrid, remote, onsite = (T.any_hit(text, w) for w in (pack.hybrid_terms, pack.remote_terms, pack.onsite_terms))
    return F.when(hybrid | (remote & onsite), "hybrid").when(remote, "remote").when(onsite, "onsite").otherwise("unknown")


def location_ok(location: Column, title: Column, text: Column, remote: Column, pack: RulePack) -> Column:
    """Blocked places fail; in market ch remote work fails only if foreign; else one of the allowed places, if any are named, or none given."""
    place = F.concat_ws(" ", location, title)
    foreign = T.contains_any(F.concat_ws(" ", place, text), pack.foreign_locations) & ~T.contains_any(F.concat_ws(" ", place, text), pack.allowed_locations)
    blocked = T.contains_any(place, pack.blocked_locations)
    if not pack.enforce_location:
        rest = ~foreign if pack.market == "ch" else F.lit(True)
    else:
        rest = (location == "") | T.contains_any(location, pack.allowed_locations) if pack.allowed_locations else F.lit(True)
        if pack.market == "ch":
            rest = F.when(remote, ~foreign).otherwise(rest)
    return ~blocked & rest


def excluded(title: Column, bare: T.Seen, pack: RulePack) -> tuple[Column, Column]:
    """(hard, soft): words hit after benign phrases are taken out; leadership words outside the title are soft."""
    found = T.hits(bare, pack.exclude)
    in_title = T.hits(title, pack.exclude)
    soft = lambda f: F.array_except(F.array_intersect(f, F.array(*map(F.lit, pack.soft_outside_title))), in_title) if pack.soft_outside_title else F.array().cast("array<string>")
    both = T.once(found, lambda f: T.once(soft(f), lambda s: F.struct(F.array_except(f, s).alias("hard"), s.alias("soft"))))
    return both["hard"], both["soft"]


def track(text: Column, pack: RulePack) -> tuple[Column, Column]:
    """The first track with hits, and up to four of them."""
    name, signals = F.lit("other"), F.array().cast("array<string>")
    for label, words in reversed(pack.tracks):
        found = T.hits(text, words)
        signals = F.when(F.size(found) > 0, F.slice(found, 1, 4)).otherwise(signals)
        name = F.when(F.size(found) > 0, label).otherwise(name)
    return name, signals


def role_relevant(title: Column, pack: RulePack) -> Column:
    return ~T.contains_any(title, pack.role_forbidden) & T.any_hit(title, pack.role_required)


def student_only(text: Column | T.Seen, pack: RulePack) -> Column:
    return ~T.contains_any(text, pack.student_allowed) & T.contains_any(text, pack.student_markers)


def experience_level(text: Column | T.Seen, pack: RulePack) -> Column:
    return F.when(T.contains_any(text, pack.hard_experience), "hard").when(T.contains_any(text, pack.soft_experience), "soft").otherwise("none")


def language_requirement(text: Column | T.Seen, pack: RulePack) -> tuple[Column, Column]:
    """(label, confidence): an optional mention weakens a required one."""
    optional, required = T.contains_any(text, pack.optional_language), T.any_hit(text, pack.blocked_language)
    label = F.when(required & ~optional, "required").when(required, "alternative").when(optional, "plus").otherwise("none")
    return label, F.when(label == "required", 0.95).when(label == "alternative", 0.15).when(label == "plus", 0.1).otherwise(0.0)


#: Function words that vote for a language. Fixed values.
VOTES = {
    "en": "the of and to in is that it for with as was are this".split(),
    "fr": "le la les de des et en un une du que qui dans pour".split(),
    "de": "der die das und den von zu mit nicht ein eine ist im auf".split(),
    "es": "el los las del y que en una por con para su al se".split(),
    "nl": "het een van niet met zijn voor naar bij ook wij worden deze wordt aan".split(),
}


def language(text: Column) -> Column:
    """The language with most function words among the text's tokens; ties go by order of VOTES, no vote is 'unknown'."""
    count = lambda tokens, words: F.size(F.filter(tokens, lambda t: t.isin(words)))
    votes = lambda tokens: F.array(*[F.struct(count(tokens, words).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("code")) for i, (code, words) in enumerate(VOTES.items())])
    best = T.once(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda tokens: F.array_max(votes(tokens)))
    return T.once(best, lambda b: F.when(b["n"] > 0, b["code"]).otherwise("unknown"))
