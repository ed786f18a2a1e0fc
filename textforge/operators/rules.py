"""Rows of many markets read once: normalised texts, the phrases found in them, and each row's pack beside it.

Rules ask whether a list of the row's pack has a phrase in some part of the row. Lists that are the same in all packs are
literals in the plan; those that differ come with a broadcast table of one row for each pack, so one plan judges all markets.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.functions import text as T
from textforge.markets import Market
from textforge.operators import phrases
from textforge.operators.classify import computed
from textforge.operators.phrases import BATCH  # noqa: F401  what bounds a batch

#: In a description, what tells that a word names people worked with, and the headings behind which a word names the role. Fixed values.
PEOPLE = (
    r"\bcollaborat\w*\s+with\b", r"\bwork\w*\s+with\b", r"\bteam\s+includes?\b", r"\bteam\s+consists?\s+of\b", r"\bstakeholders?\s+include\b",
    r"\bin\s+collaboration\s+with\b", r"\balongside\b",
)
HEADINGS = (
    r"\brole\b", r"\bposition\b", r"\bjob\s+title\b", r"\bwe\s+are\s+looking\s+for\b", r"\blooking\s+for\s+(?:a|an)\b", r"\byour\s+role\b",
    r"\bresponsibilities\b", r"\byour\s+mission\b", r"\bmission\b",
)
#: Technical words that only look like internships. Fixed values.
INTERNSHIP_NOISE = (r"\bstage[_-]?live\b", r"\bstage[_-]env\b", r"\bstaging\b", r"\bgtm\b")
INTERNSHIP_NOISE_WORDS = ("stage", "staging", "gtm")
#: What stands before the name of a company that another one belongs to. Fixed value.
BELONGS = r"\b(?:part\s+of|subsidiary\s+of|owned\s+by|acquired\s+by|a\s+division\s+of|member\s+of)\s+"

QUIET = ("internship_allowed", "internship_agreement", "internship_student", "internship_thesis", "internship_stage", "internship_intern")


@dataclasses.dataclass(frozen=True)
class Rules:
    """The packs that one table's rows can have; names are unique."""

    packs: tuple[Market, ...]
    exceptions: tuple[str, ...] = ()

    @cached_property
    def book(self) -> phrases.Book:
        """Every phrase of every pack."""
        lists = [(kind, getattr(p, name)) for p in self.packs for name, kind in Market.vocabularies().items()]
        lists += [("inside", [t for t, _ in p.term_weights]) for p in self.packs]
        return phrases.Book.of([*lists, *(("word", w) for p in self.packs for _, w in p.tracks)])

    def _ids(self, pack: Market, name: str) -> list[int]:
        out = self.book.ids(Market.vocabularies()[name], getattr(pack, name))
        skip = set(self.book.ids("word", pack.forbidden_skip)) if name == "forbidden" else ()
        return [i for i in out if i not in skip]

    def _union(self, *names: str) -> tuple[int, ...]:
        return tuple(sorted({i for p in self.packs for n in names for i in self._ids(p, n)}))

    @cached_property
    def context(self) -> phrases.Context:
        return phrases.Context(
            exceptions=tuple(T.normalised(e) for e in self.exceptions), bare=self._union("excluded"), noise=INTERNSHIP_NOISE, noise_words=INTERNSHIP_NOISE_WORDS, quiet=self._union(*QUIET), roles=self._union("forbidden"),
            people=PEOPLE, headings=HEADINGS, employers=self._union("sponsors"), belongs=BELONGS,
        )

    def _of(self, pack: Market, name: str) -> Any:
        """A field of a pack as a column's value: ids of a vocabulary, pairs of ids and weights, or the value itself."""
        if name in Market.vocabularies():
            return self._ids(pack, name)
        if name == "term_weights":
            return [(i, w) for t, w in pack.term_weights for i in self.book.ids("inside", [t])]
        return getattr(pack, name)

    @cached_property
    def _fields(self) -> dict[str, str]:
        """What a rule can ask of a pack, and its type."""
        plain = {"name": "string", "focus": "string", "speed": "boolean", "min_description": "int", "max_age_days": "int", "enforce_places": "boolean", "foreign_rule": "boolean", "drops_internships": "boolean", "gated": "boolean", "sponsor_factor": "int", "region_bonus": "int"}
        lists = dict.fromkeys(("allowed_codes", "blocked_codes"), "array<string>") | dict.fromkeys(Market.vocabularies(), "array<int>")
        return plain | lists | {"term_weights": "array<struct<id: int, weight: int>>"}

    @cached_property
    def _differing(self) -> list[str]:
        return [n for n in self._fields if n == "name" or any(self._of(p, n) != self._of(self.packs[0], n) for p in self.packs)]

    def dimension(self, spark: SparkSession) -> DataFrame:
        """market, pack: one row for each pack, with what differs between them."""
        rows = [(p.name, tuple(self._of(p, n) if not isinstance(self._of(p, n), tuple) else list(self._of(p, n)) for n in self._differing)) for p in self.packs]
        return spark.createDataFrame(rows, f"market string, pack struct<{', '.join(f'{n}: {self._fields[n]}' for n in self._differing)}>")

    def of(self, name: str) -> Column:
        """A field of the row's pack."""
        if name in self._differing:
            return F.col(f"pack.{name}")
        value, kind = self._of(self.packs[0], name), self._fields[name]
        if kind.startswith("array<struct"):
            value = [{"id": i, "weight": w} for i, w in value]
        return T.constant(list(value), kind) if kind.startswith("array") else F.lit(value)

    def has(self, where: str, name: str) -> Column:
        """Whether a phrase of the list stands in a part of the row."""
        return F.coalesce(F.arrays_overlap(F.col(f"found.{where}"), self.of(name)), F.lit(False))

    def hits(self, where: str, name: str) -> Column:
        """Ids of the list's phrases that stand there, in the list's order."""
        return F.coalesce(F.array_intersect(self.of(name), F.col(f"found.{where}")), F.array().cast("array<int>"))

    def count(self, where: str, name: str) -> Column:
        return F.size(self.hits(where, name))

    def words(self, ids: Column, name: str) -> Column:
        """The phrases of ids of a list, which may be a track's."""
        ways = [i for p in self.packs for n, ws in p.tracks if n == name for i in self.book.ids("word", ws)]
        known = T.constant({str(i): self.book.entries[i][1] for i in ways or self._union(name)}, "map<string, string>")
        return F.transform(ids, lambda i: F.try_element_at(known, i.cast("string")))

    def first(self, where: str, name: str) -> Column:
        """The first phrase of the list that stands there, or empty."""
        return F.coalesce(F.try_element_at(self.words(F.slice(self.hits(where, name), 1, 1), name), F.lit(1)), F.lit(""))

    def read(self, df: DataFrame) -> DataFrame:
        """df (market, title, description, company, location) with plain, title_n, desc_n, loc_n, company_n, text_n, found and pack.

        Markup and broken encodings are taken out first. A market without a pack leaves pack null, and its rows fail the
        cascade's first step.
        """
        phrases.bounded(df.sparkSession)
        plain = ("plain_title", "plain", "plain_place", "plain_company")
        normal = ("title_n", "desc_n", "loc_n", "company_n")
        # the four texts go through one expression, so the plan holds it once
        df = computed(df, {"_plain": F.transform(F.array("title", "description", "location", "company"), T.rule_plain)})
        df = computed(df, {"_normal": F.transform("_plain", T.normalise_flat)})
        df = df.withColumns({n: F.col("_plain")[i] for i, n in enumerate(plain)} | {n: F.col("_normal")[i] for i, n in enumerate(normal)}).drop("_plain", "_normal")
        df = computed(df, {"text_n": F.concat_ws(" ", T.blank_null(F.col("title_n")), T.blank_null(F.col("desc_n")))})
        look = phrases.found(self.book, self.context, F.col("loc_n"), F.col("title_n"), F.col("desc_n"))
        firms = phrases.parts(self.book, F.col("company_n"))
        df = df.withColumns({"found": look, "_firm": firms})
        df = df.withColumn("found", F.col("found").withField("company", F.col("_firm")[0])).drop("_firm")
        return df.join(F.broadcast(self.dimension(df.sparkSession)), "market", "left")


def of(packs: Sequence[Market], exceptions: Sequence[str] = ()) -> Rules:
    return Rules(tuple(packs), tuple(exceptions))
