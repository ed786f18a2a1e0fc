"""Rules as data. Every operator takes the pack it works with; nothing reads globals or the environment."""

from __future__ import annotations

import dataclasses
import json
from typing import Any

MODES = ("strict", "broad")


@dataclasses.dataclass(frozen=True)
class RulePack:
    """Vocabularies, weights and thresholds of one market and mode. Words are matched on normalised text."""

    market: str = "fixture"
    mode: str = "strict"
    as_of: str = "1999-01-01 00:00:00"
    max_age_days: int = 45
    min_description: int = 60
    bad_titles: tuple[str, ...] = ()
    blocked_locations: tuple[str, ...] = ()
    allowed_locations: tuple[str, ...] = ()
    foreign_locations: tuple[str, ...] = ()
    enforce_location: bool = True
    remote_terms: tuple[str, ...] = ()
    hybrid_terms: tuple[str, ...] = ()
    onsite_terms: tuple[str, ...] = ()
    role_required: tuple[str, ...] = ()
    role_forbidden: tuple[str, ...] = ()
    tracks: tuple[tuple[str, tuple[str, ...]], ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_exceptions: tuple[str, ...] = ()
    soft_outside_title: tuple[str, ...] = ()
    student_markers: tuple[str, ...] = ()
    student_allowed: tuple[str, ...] = ()
    internship_markers: tuple[str, ...] = ()
    hard_experience: tuple[str, ...] = ()
    soft_experience: tuple[str, ...] = ()
    blocked_language: tuple[str, ...] = ()
    optional_language: tuple[str, ...] = ()
    #: Languages of whole texts that the strict mode drops.
    blocked_codes: tuple[str, ...] = ()
    junior_plus: tuple[str, ...] = ()
    junior_minus: tuple[str, ...] = ()
    junior_mild: tuple[str, ...] = ()
    hiring_plus: tuple[str, ...] = ()
    hiring_minus: tuple[str, ...] = ()
    sponsor_plus: tuple[str, ...] = ()
    sponsor_minus: tuple[str, ...] = ()
    sponsor_companies: tuple[str, ...] = ()
    sponsor_factor: int = 1
    term_weights: tuple[tuple[str, int], ...] = ()
    track_bonus: tuple[tuple[str, int], ...] = ()
    near_miss_min: int = 68
    apply_min: int = 68
    company_cap: int = 3
    queue_size: int = 20

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> RulePack:
        """A pack from plain lists and numbers, as JSON has them; unknown names are refused."""
        tuples = lambda v: tuple(tuples(x) for x in v) if isinstance(v, list | tuple) else v
        pack = cls(**{k: tuples(v) for k, v in values.items()})
        if pack.mode not in MODES:
            raise ValueError(f"mode {pack.mode!r} is none of {', '.join(MODES)}")
        return pack

    @classmethod
    def from_json(cls, text: str) -> RulePack:
        return cls.from_dict(json.loads(text))

    def with_mode(self, mode: str) -> RulePack:
        return dataclasses.replace(self, mode=mode)


#: Words that occur in the driver's invented prose, so that each rule both passes and fails some rows.
FIXTURE = RulePack(
    as_of="1999-01-01 00:00:00",
    max_age_days=1000,
    bad_titles=("anvil", " old "),
    blocked_locations=("nation_19", "nation_24"),
    allowed_locations=("nation_1", "nation_2", "nation_5", "nation_7", "nation_9"),
    foreign_locations=("nation_3",),
    remote_terms=("that", "une"),
    hybrid_terms=("token", "password"),
    onsite_terms=("from", "avec"),
    role_required=("widget", "bolt", "gear", "ring", "plate"),
    role_forbidden=("hot", "small gizmo"),
    tracks=(("rings", ("ring",)), ("bolts", ("bolt", "gear")), ("flat", ("plate", "widget"))),
    exclude=("idiot", "worthless", "with", "scum", "das", "license", "lead in"),
    exclude_exceptions=("with the", "and with"),
    soft_outside_title=("with", "das"),
    student_markers=("moron", "clown"),
    student_allowed=("the clown",),
    internship_markers=("trash", "loser"),
    hard_experience=("disgusting", "stupid"),
    soft_experience=("pathetic", "was"),
    blocked_language=("nicht", "keiten"),
    optional_language=("auch", "nicht der"),
    blocked_codes=("es",),
    junior_plus=("the", "ring", "red", "por"),
    junior_minus=("nicht", "idiot", "token"),
    junior_mild=("avec", "for"),
    hiring_plus=("and", "les", "con", "red"),
    hiring_minus=("not", "nicht", "ring", "sur"),
    sponsor_plus=("of the", "et de"),
    sponsor_minus=("license", "without"),
    sponsor_companies=("supplier#000000001", "supplier#000000005"),
    term_weights=(("bolt", 6), ("red", 4), ("src1", 3), ("ing", 1)),
    track_bonus=(("rings", 5), ("bolts", 3)),
)
