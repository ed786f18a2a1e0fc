"""What stands between a scored row and the small bucket to apply to now: penalties, gates, place focus and the reasons told."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textforge import vocabularies as V
from textforge.functions import text as T
from textforge.markets import Market
from textforge.operators.classify import computed
from textforge.operators.rules import Rules

#: Titles that a gated market takes at once, and those it never takes. Fixed values.
CLEAR_TITLES, GENERIC_TITLES = V.MA_CLEAR_TITLES, V.MA_GENERIC_TITLES
#: Places whose region a reason names, and the focus under which other places are called by the second name. Fixed values.
REGION, REGION_PLACES, REGION_FOCUS, ELSEWHERE = "romandie", V.ROMANDIE + V.ROMANDIE_MORE, "romandie", "swiss-wide"
#: The focus that takes remote work anywhere. Fixed value.
REMOTE_FOCUS = "rabat_or_remote"


def match_text(*values: Column) -> Column:
    """Values joined, compatibility forms as plain letters, other characters beyond ASCII left out, lower case, single blanks."""
    return T.collapse(F.lower(T.to_ascii(F.concat_ws(" ", *[T.blank_null(v) for v in values]))))


def plain(word: str) -> str:
    """match_text() of a word of a rule."""
    return " ".join(unicodedata.normalize("NFKD", word).encode("ascii", "ignore").decode().lower().split())


def adjustment(title: Column, text: Column, pack: Market) -> Column:
    """Struct of penalty (at least -30), reasons (up to four) and forced, whether the row must be reviewed, under one pack.

    A language that is not the pack's costs 12, a class of titles that is not aimed at 10; a row without text costs nothing.
    """
    found = [(f"language:{code}", 12, T.contains_any(text, words)) for code, words in pack.queue_languages if code not in pack.allowed_codes]
    found += [(label, 10, T.contains_any(title, words)) for label, words in pack.queue_titles]
    nothing = F.struct(F.lit(0).alias("penalty"), F.lit("").alias("reasons"), F.lit(False).alias("forced"))
    if not found or not pack.gated:
        return nothing
    labels = F.array_compact(F.array(*[F.when(c, F.lit(label)) for label, _, c in found]))
    total = sum((F.when(c, -points).otherwise(0) for _, points, c in found), F.lit(0))
    made = F.struct(F.greatest(F.lit(-30), total).alias("penalty"), F.array_join(F.slice(labels, 1, 4), " | ").alias("reasons"), (F.size(labels) > 0).alias("forced"))
    return F.when(text != "", made).otherwise(nothing)


def apply_now(title: Column, gated: Column) -> Column:
    """Struct of allowed and why not: in a gated market the title itself must be on target."""
    why = (
        F.when(~gated, "").when(title == "", "empty_title").when(T.contains_any(title, GENERIC_TITLES), "generic_language_title")
        .when(T.contains_any(title, CLEAR_TITLES) | F.contains(title, F.lit("junior")), "").otherwise("title_not_specific_enough")
    )
    return F.struct((why == "").alias("allowed"), why.alias("why"))


def in_focus(location: Column, remote: Column, focus: str, pack: Market) -> Column:
    """Whether a place is one of a focus: a cluster's places, or the focus itself as a substring; no focus takes all."""
    key = plain(focus)
    if not key:
        return F.lit(True)
    found = T.contains_any(match_text(location), tuple(map(plain, dict(pack.clusters).get(key, (key,)))))
    return found | remote if pack.clusters and key == REMOTE_FOCUS else found


def focus_path(path: str, focus: str) -> str:
    """A path with the focus before its ending."""
    key = plain(focus).replace(" ", "_")
    stem, dot, ending = path.rpartition(".")
    return path if not key else f"{stem}_{key}.{ending}" if dot and "/" not in ending else f"{path}_{key}"


def reason_text(focus: Column) -> Column:
    """Up to four labels of why a row ranks: is_remote, sponsorship_score, language_fit, junior_score, search_term, location, feedback_score."""
    term = F.trim(F.coalesce("search_term", F.lit("")))
    there = T.contains_any(F.lower(F.coalesce("location", F.lit(""))), REGION_PLACES)
    labels = [
        F.when(F.col("is_remote"), F.lit("remote/hybrid")), F.when(F.col("sponsorship_score") > 0, F.lit("sponsors-visa")),
        F.when(F.col("language_fit") > 0, F.lit("language-fit")), F.when(F.col("junior_score") >= 2, F.lit("junior-friendly")),
        F.when(term != "", F.concat(F.lit("term:"), term)), F.when(there, F.lit(REGION)), F.when(~there & (focus == REGION_FOCUS), F.lit(ELSEWHERE)),
        F.when(F.col("feedback_score") > 0, F.lit("historical-fit+")).when(F.col("feedback_score") < 0, F.lit("historical-fit-")),
    ]
    told = F.array_join(F.slice(F.array_compact(F.array(*labels)), 1, 4), ", ")
    return F.when(told == "", "priority-ranked").otherwise(told)


def gated(df: DataFrame, r: Rules, apply_min: int) -> DataFrame:
    """df (market, priority, feedback_score, title, description, company) with adjusted, action, penalty_reasons, gate and apply_reason."""
    df = computed(df, {"_title": match_text(F.col("title")), "_text": match_text(F.col("title"), F.col("description"), F.col("company"))})
    strict = [p for p in r.packs if p.gated]
    costs = F.coalesce(*[F.when(F.col("market") == p.name, adjustment(F.col("_title"), F.col("_text"), p)) for p in strict], adjustment(F.col("_title"), F.col("_text"), Market()))
    df = computed(df, {"_a": costs, "_g": apply_now(F.col("_title"), F.col("market").isin([p.name for p in strict]) if strict else F.lit(False))})
    adjusted = F.col("priority") + F.col("feedback_score") + F.col("_a.penalty")
    ready = (adjusted >= apply_min) & ~F.col("_a.forced") & F.col("_g.allowed")
    focus = F.coalesce(*[F.when(F.col("market") == p.name, F.lit(p.focus)) for p in r.packs], F.lit(""))
    return df.withColumns({
        "adjusted": adjusted.cast("int"), "queue_adjustment": F.col("_a.penalty"), "action": F.when(ready, "apply_now").otherwise("review"), "penalty_reasons": F.col("_a.reasons"),
        "gate": F.col("_g.why"), "apply_reason": reason_text(focus),
    }).drop("_a", "_g", "_title", "_text")


def demoted(queue: DataFrame, manual: DataFrame, keys: tuple[str, ...] = ("url", "canonical_url")) -> DataFrame:
    """The queue with action review where a row is to be applied to now and either key is in the table of rows checked by hand."""
    gone = manual.select(F.explode(F.array(*keys)).alias("key")).where("key <> ''").distinct()
    for i, k in enumerate(keys):
        queue = queue.join(gone.select(F.col("key").alias(k), F.lit(True).alias(f"_m{i}")), k, "left")
    hit = F.coalesce(*[F.col(f"_m{i}") for i in range(len(keys))], F.lit(False))
    return queue.withColumn("action", F.when((F.col("action") == "apply_now") & hit, "review").otherwise(F.col("action"))).drop(*[f"_m{i}" for i in range(len(keys))])


def reused(rows: DataFrame, earlier: DataFrame, columns: tuple[str, ...], order: str = "row_id") -> DataFrame:
    """rows with columns of the last earlier row of the same posting: url (canonical first), title and company, trimmed, lower case."""
    key = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    identity = [key(F.coalesce(T.blank_null(F.col("canonical_url")), F.col("url"))).alias("_u"), key(F.col("title")).alias("_t"), key(F.col("company")).alias("_c")]
    last = earlier.select(*identity, order, *columns).groupBy("_u", "_t", "_c").agg(*[F.max_by(c, order).alias(c) for c in columns])
    return rows.select("*", *identity).join(last, ["_u", "_t", "_c"], "left").drop("_u", "_t", "_c")
