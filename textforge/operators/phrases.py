"""Many vocabularies looked up in one pass: an automaton finds every phrase of every list, and rules compare sets of ids.

A pattern for each phrase costs a search of the text for each of them; here the text is read once, however many lists and
rule packs there are. A row's hits are small arrays of phrase ids, so a pack's list can be a column, and rows of many
packs are judged by one plan.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from textforge.functions.text import normalised

#: How a phrase matches. word: not inside a longer run of a-z, 0-9, but a substring if it has other characters than these and blanks.
#: token: one word between word boundaries, else a substring. lone: not beside a-z, 0-9 or _. inside: a substring.
#: bounded: between word boundaries, as it stands. part: a substring as it stands, so blanks at its ends count.
KINDS = ("word", "token", "lone", "inside", "bounded", "part")
#: Where in a row: its place, place and title, title, description, title and description, all three, and the last with the place behind.
WHERE = ("loc", "place", "title", "desc", "text", "every", "work")
#: Rows and bytes of a batch that a Python worker holds: texts are long, and rows by the ten thousand would fill its memory.
BATCH = (("maxRecordsPerBatch", 512), ("maxBytesPerBatch", 1 << 24))
EVERY = (*WHERE, "bare", "quiet", "named", "owner")


def bounded(spark: SparkSession) -> None:
    """Has the workers handed no more than BATCH at once."""
    for name, most in BATCH:
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shaped(kind: str, phrase: str) -> str:
    """The phrase as it is compared: normalised, unless the kind takes it as it stands."""
    return phrase if kind in ("bounded", "part") else normalised(phrase)


@dataclasses.dataclass(frozen=True)
class Book:
    """Phrases with their kinds; an id is a place in the tuple."""

    entries: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, lists: Iterable[tuple[str, Sequence[str]]]) -> Book:
        """A book of (kind, phrases) lists; equal entries share an id."""
        return cls(tuple(dict.fromkeys((kind, shaped(kind, p)) for kind, phrases in lists for p in phrases if shaped(kind, p))))

    def ids(self, kind: str, phrases: Sequence[str]) -> list[int]:
        """The ids of the phrases, in their order."""
        at = _places(self)
        return list(dict.fromkeys(at[kind, shaped(kind, p)] for p in phrases if shaped(kind, p)))


@lru_cache(maxsize=32)
def _places(book: Book) -> dict[tuple[str, str], int]:
    return {e: i for i, e in enumerate(book.entries)}


def _plain(text: str) -> bool:
    return re.fullmatch("[a-z0-9 ]+", text) is not None


def _open(text: str, start: int, end: int, way: str) -> bool:
    """Whether a place in the text stands apart: between boundaries of words, or beside no a-z, 0-9 (low), nor _ (lone)."""
    before, first, last, behind = text[start - 1] if start else " ", text[start], text[end - 1], text[end] if end < len(text) else " "
    if way == "words":
        word = lambda c: c.isalnum() or c == "_"
        return word(before) != word(first) and word(last) != word(behind)
    return not any("a" <= c <= "z" or "0" <= c <= "9" or (way == "lone" and c == "_") for c in (before, behind))


@lru_cache(maxsize=8)
def automaton(book: Book):
    """The automaton of a book; each word of it leads to (length, [(id, way of matching)])."""
    import ahocorasick

    words: dict[str, list[tuple[int, str]]] = {}
    for i, (kind, phrase) in enumerate(book.entries):
        whole = kind == "bounded" or (kind == "token" and re.fullmatch(r"\w+", phrase) is not None)
        way = "words" if whole else "lone" if kind == "lone" else "low" if kind == "word" and _plain(phrase) else "any"
        words.setdefault(phrase, []).append((i, way))
    out = ahocorasick.Automaton()
    for word, entries in words.items():
        out.add_word(word, (len(word), entries))
    out.make_automaton()
    return out


def occurrences(book: Book, text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, id) of every phrase in a normalised text, overlapping ones too."""
    return _occurrences(automaton(book), text) if book.entries else iter(())


def _occurrences(machine, text: str) -> Iterator[tuple[int, int, int]]:
    for last, (size, entries) in machine.iter(text):
        start, end = last + 1 - size, last + 1
        whole: dict[str, bool] = {"any": True}
        for i, way in entries:
            if way not in whole:
                whole[way] = _open(text, start, end, way)
            if whole[way]:
                yield start, end, i


@dataclasses.dataclass(frozen=True)
class Context:
    """What more is looked at where some phrases stand; patterns are on normalised text."""

    #: Phrases that are taken out of title and description before the words of `bare` are looked for.
    exceptions: tuple[str, ...] = ()
    bare: tuple[int, ...] = ()
    #: Patterns that are taken out before the words of `quiet` are looked for.
    noise: tuple[str, ...] = ()
    #: Words one of which stands wherever such a pattern does; none: texts are not tried by words first.
    noise_words: tuple[str, ...] = ()
    quiet: tuple[int, ...] = ()
    #: Ids that count as named in the description: at its beginning or behind a heading, and not among people worked with.
    roles: tuple[int, ...] = ()
    people: tuple[str, ...] = ()
    headings: tuple[str, ...] = ()
    early: int = 360
    #: Ids that count where one of these beginnings stands up to `reach` characters before.
    employers: tuple[int, ...] = ()
    belongs: str = ""
    reach: int = 60


def without(text: str, phrases: Sequence[str]) -> str:
    """The text without the phrases, taken out in order, as words of their own first."""
    if not any(p in text for p in phrases):
        return text
    text = f" {text} "
    for p in phrases:
        text = text.replace(f" {p} ", " ").replace(p, " ")
    return " ".join(text.split())


class Reader:
    """Looks rows up in a book; made once for each batch of them."""

    def __init__(self, book: Book, context: Context):
        self.context, self.machine = context, automaton(book) if book.entries else None
        self.bare, self.quiet, self.roles, self.employers = map(frozenset, (context.bare, context.quiet, context.roles, context.employers))

    def _all(self, text: str) -> Iterator[tuple[int, int, int]]:
        return _occurrences(self.machine, text) if self.machine is not None and text else iter(())

    def _ids(self, text: str, among: frozenset[int]) -> set[int]:
        return {i for _, _, i in self._all(text) if i in among}

    def row(self, loc: str, title: str, desc: str) -> dict[str, list[int]]:
        """Ids by WHERE, and bare, quiet, named and owner (see Context), of one row's normalised texts."""
        context, parts, spans, at = self.context, (loc, title, desc, loc), [], 0
        for x in parts:
            spans.append((at, at + len(x)))
            at += len(x) + (1 if x else 0)
        whole = " ".join(x for x in parts if x)
        (_, loc_end), (title_at, title_end), (desc_at, desc_end), _ = spans
        last = desc_end if desc else title_end if title else loc_end
        limits = {"loc": (0, loc_end), "place": (0, title_end if title else loc_end), "title": (title_at, title_end), "desc": (desc_at, desc_end), "text": (title_at, last), "every": (0, last), "work": (title_at, len(whole))}
        found: dict[str, set[int]] = {k: set() for k in EVERY}
        for start, end, i in self._all(whole):
            for k, (low, high) in limits.items():
                if low <= start and end <= high:
                    found[k].add(i)
            if i in self.roles and i not in found["named"] and desc_at <= start and end <= desc_end and _open(whole, start, end, "low") and names_role(desc, start - desc_at, end - desc_at, context):
                found["named"].add(i)
        text = " ".join(x for x in (title, desc) if x)
        less, still = without(text, context.exceptions), text
        found["bare"] = found["text"] & self.bare if less == text else self._ids(less, self.bare)
        if any(w in text for w in context.noise_words) or not context.noise_words:
            for p in context.noise:
                still = re.sub(p, " ", still)
        found["quiet"] = found["text"] & self.quiet if still == text else self._ids(" ".join(still.split()), self.quiet)
        if context.belongs:
            for m in re.finditer(context.belongs, desc):
                found["owner"] |= self._ids(desc[m.end() : m.end() + context.reach], self.employers)
        return {k: sorted(v) for k, v in found.items()}


def names_role(desc: str, start: int, end: int, context: Context) -> bool:
    """Whether the phrase at this place is what the description is about."""
    if any(re.search(p, desc[max(0, start - 90) : end + 120]) for p in context.people):
        return False
    return start <= context.early or any(re.search(p, desc[max(0, start - 160) : start]) for p in context.headings)


def found(book: Book, context: Context, loc: Column, title: Column, desc: Column) -> Column:
    """Struct of arrays of ids: WHERE, bare, quiet, named, owner. The texts are normalised; null counts as empty."""

    def look(locs: pd.Series, titles: pd.Series, descs: pd.Series) -> pd.DataFrame:
        read = Reader(book, context).row
        rows = [read(a or "", b or "", c or "") for a, b, c in zip(locs, titles, descs, strict=True)]
        return pd.DataFrame({k: [r[k] for r in rows] for k in EVERY})

    return F.pandas_udf(look, ", ".join(f"{k} array<int>" for k in EVERY))(loc, title, desc)


def parts(book: Book, *texts: Column) -> Column:
    """Array of ids for each of the texts, which are matched as they are; null counts as empty."""

    def look(*columns: pd.Series) -> pd.Series:
        machine = automaton(book) if book.entries else None
        ids = lambda t: sorted({i for _, _, i in _occurrences(machine, t)}) if machine is not None and t else []
        return pd.Series([[ids(t) for t in row] for row in zip(*columns, strict=True)], dtype=object)

    return F.pandas_udf(look, "array<array<int>>")(*texts)


LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def standing(texts: Sequence[str], word: str) -> list[bool]:
    """text.keyword_hit() of normalised texts."""
    if not _plain(word):
        return [word in t for t in texts]
    word, out = " ".join(word.split()), []
    for t in texts:
        at = t.find(word)
        while at >= 0 and (t[at + len(word) : at + len(word) + 1] in LETTERS or t[max(at - 1, 0) : at] in LETTERS):
            at = t.find(word, at + 1)
        out.append(at >= 0)
    return out


def looked(text: Column, words: Mapping[str, Sequence[str]], exceptions: Sequence[str] = ()) -> Column:
    """Struct of booleans `way:word`, whether the normalised text has the word: one pass, however many words; null counts as empty.

    The ways are hit, text.keyword_hit(); bare, the same after the exceptions, one after another, became blanks; and part, a substring.
    """
    asked = list(dict.fromkeys((way, w) for way, ws in words.items() for w in ws))
    kind = StructType([StructField(f"{way}:{w}", BooleanType()) for way, w in asked])

    def look(given: pa.Array) -> pa.Array:
        texts = [t or "" for t in given.to_pylist()]
        bare = texts
        for e in exceptions:
            bare = [t.replace(e, " ") for t in bare]
        found = [[w in t for t in texts] if way == "part" else standing(bare if way == "bare" else texts, w) for way, w in asked]
        return pa.StructArray.from_arrays([pa.array(f, pa.bool_()) for f in found], names=kind.names)

    return F.arrow_udf(look, kind)(text)
