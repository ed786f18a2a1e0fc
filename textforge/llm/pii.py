"""Operator 7, PII: format-preserving Feistel pseudonyms.

A value is found by its pattern, checked (Luhn, mod 97, calendar, octet range), mapped to an integer below the
number of values of its format, permuted there by a keyed Feistel network with cycle walking and written back in
the same layout. The same value gets the same pseudonym wherever it stands and however its digits are grouped,
and a pseudonym passes the same check as the value, so equal values stay linked across documents.
"""

from __future__ import annotations

import contextlib
import datetime
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm import common

ROUNDS = 8
#: The setting that holds the secret, and what tests and the queries on invented data take where it is not set.
KEY_SETTING, DEMO_KEY = "spark.textforge.pii.key", b"textforge demonstration key"


def key_of(spark: SparkSession, demo: bool = False) -> bytes:
    """The secret of this run; without one, an error, or with demo the public key of the examples."""
    if given := spark.conf.get(KEY_SETTING, None):
        return hashlib.blake2b(given.encode(), digest_size=32).digest()
    if not demo:
        raise ValueError(f"no secret is set in {KEY_SETTING}")
    warnings.warn(f"{KEY_SETTING} is not set: these pseudonyms are made with a public key and can be undone", stacklevel=2)
    return DEMO_KEY


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size); inverse() undoes it."""
    return _walk(value, size, key, tweak, range(ROUNDS))


def inverse(value: int, size: int, key: bytes, tweak: bytes) -> int:
    return _walk(value, size, key, tweak, range(ROUNDS - 1, -1, -1))


def _walk(value: int, size: int, key: bytes, tweak: bytes, rounds: range) -> int:
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask, forward = (1 << half) - 1, rounds.step > 0
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in rounds:
            held = right if forward else left
            mix = int.from_bytes(_digest(tweak + bytes((r,)) + held.to_bytes(width, "big"), key, width + 8), "big") & mask
            left, right = (right, left ^ mix) if forward else (right ^ mix, left)
        value = left << half | right
        if value < size:  # else walk on along the cycle, which returns into the range
            return value


def _digest(given: bytes, key: bytes, size: int) -> bytes:
    """A keyed digest of at least size bytes, so that it covers the whole half: as many numbered blocks as that needs."""
    first = hashlib.blake2b(given, key=key[:64], digest_size=min(64, size)).digest()
    more = (hashlib.blake2b(given + b"more%d" % i, key=key[:64]).digest() for i in range(1, -(-size // 64)))
    return b"".join([first, *more])


#: Characters that are permuted together; longer values are cut into equal blocks, each with the one before it as its tweak.
BLOCK = 200


def _blocks(text: str, change: Callable[[str, bytes], str], tweak: bytes) -> str:
    """change() of a value, block by block where it is long: time grows with its length, and no part stays as it is."""
    if len(text) <= BLOCK:
        return change(text, tweak)
    count = -(-len(text) // BLOCK)
    cuts = [i * len(text) // count for i in range(count + 1)]
    out, held = [], b"%d:" % len(text)
    for low, high in zip(cuts, cuts[1:], strict=False):
        out.append(change(text[low:high], tweak + held))
        held = hashlib.blake2b(held + out[-1].encode(), digest_size=16).digest()
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that follows these digits."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _laid_out(digits: str, layout: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def _card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or str(luhn(digits[:-1])) != digits[-1]:
        return None
    n = len(digits) - 1
    new = f"{permute(int(digits[:-1]), 10**n, key, b'card%d' % n):0{n}d}"
    return _laid_out(new + str(luhn(new)), m[0])


def _number(kind: bytes) -> Callable[[re.Match, bytes], str | None]:
    """Digits without a check of their own; a leading country code stays, and a (0) behind it."""

    def run(m: re.Match, key: bytes) -> str | None:
        head = m.groupdict().get("head") or ""
        rest = m[0][len(head) :]
        digits = re.sub(r"\D", "", rest)
        new = f"{permute(int(digits), 10 ** len(digits), key, kind + b'%d' % len(digits) + re.sub(r'\(0\)|\D', '', head).encode()):0{len(digits)}d}"
        return head + _laid_out(new, rest)

    return run


def _ip(m: re.Match, key: bytes) -> str | None:
    octets = [int(x) for x in m[0].split(".")]
    if max(octets) > 255:
        return None
    return ".".join(str(b) for b in permute(int.from_bytes(bytes(octets), "big"), 2**32, key, b"ip").to_bytes(4, "big"))


def _iban(m: re.Match, key: bytes) -> str | None:
    compact = m[0].replace(" ", "")
    if not 15 <= len(compact) <= 34 or int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 != 1:
        return None
    body = _mixed(compact[4:], key, b"iban" + compact[:2].encode())
    check = 98 - int("".join(str(int(c, 36)) for c in body + compact[:2] + "00")) % 97
    it = iter(f"{compact[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in m[0])


def _date(m: re.Match, key: bytes) -> str | None:
    """A valid day, written back in its layout. nn/nn/nnnn is month first and else day first, the other marks day first and else month first."""
    parts, names = m.groupdict(), None
    if parts["named"] or parts["month_first"]:
        word = parts["month"] or parts["month2"]
        names = next(n for n in MONTHS if word.lower() in n)
        readings = [("y", "m", "d")]
        fields = (parts["year"] or parts["year2"], str(names.index(word.lower()) + 1), parts["day"] or parts["day2"])
    else:
        fields = tuple(re.findall(r"\d+", m[0]))
        readings = [("y", "m", "d")] if parts["ymd"] else [("m", "d", "y"), ("d", "m", "y")] if parts["mark"] == "/" else [("d", "m", "y"), ("m", "d", "y")]
    for order in readings:
        at = dict(zip(order, map(int, fields), strict=True))
        with contextlib.suppress(ValueError):
            value = datetime.date(at["y"], at["m"], at["d"])
            break
    else:
        return None
    era = (value.year - 100) // 200  # 1900 to 2099 is one range of days, and so on
    low = datetime.date(max(1, 200 * era + 100), 1, 1).toordinal()
    high = datetime.date(min(9999, 200 * era + 299), 12, 31).toordinal()
    new = datetime.date.fromordinal(low + permute(value.toordinal() - low, high - low + 1, key, b"date"))
    number = "{:02d}" if all(len(f) > 1 for f in (fields if names is None else fields[2:])) else "{}"
    text = {"y": f"{new.year:04d}", "m": number.format(new.month), "d": number.format(new.day)}
    if names is None:
        it = iter([text[k] for k in order])
        return re.sub(r"\d+", lambda _: next(it), m[0])
    name = names[new.month - 1]
    text["m"] = name.upper() if word.isupper() and len(word) > 1 else name.capitalize() if word[0].isupper() else name
    kinds = {"day": "d", "month": "m", "year": "y", "day2": "d", "month2": "m", "year2": "y"}
    out, end = [], m.start()
    for s, e, k in sorted((*m.span(g), k) for g, k in kinds.items() if parts[g]):
        out += [m.string[end:s], text[k]]
        end = e
    return "".join([*out, m.string[end : m.end()]])


def _mixed(text: str, key: bytes, tweak: bytes) -> str:
    """Letters and digits permuted within their own class; other characters stay."""
    return _blocks(text, lambda part, own: _mixed_block(part, key, own), tweak)


def _mixed_block(text: str, key: bytes, tweak: bytes) -> str:
    radix = [10 if c in "0123456789" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 0 for c in text]
    value, size = 0, 1
    for c, r in zip(text, radix, strict=True):
        if r:
            value = value * r + (int(c) if r == 10 else ord(c.lower()) - 97)
            size *= r
    layout = "".join("9" if r == 10 else "a" if c.islower() else "A" if r else c for c, r in zip(text, radix, strict=True))
    value, out = permute(value, size, key, tweak + layout.encode()), []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        if not r:
            out.append(c)
            continue
        value, k = divmod(value, r)
        out.append(str(k) if r == 10 else chr((97 if c.islower() else 65) + k))
    return "".join(reversed(out))


def _hex(text: str, key: bytes) -> str:
    return _blocks(text, lambda part, own: f"{permute(int(part, 16), 16 ** len(part), key, own + b'hex%d' % len(part)):0{len(part)}x}", b"")


def _email(m: re.Match, key: bytes) -> str | None:
    name, _, host = m[0].lower().rpartition("@")
    labels, _, top = host.rpartition(".")
    return f"{_mixed(name, key, b'mail' + host.encode())}@{_mixed(labels, key, b'host')}.{top}"


def _secret(m: re.Match, key: bytes) -> str | None:
    value = m["value"]
    new = _hex(value, key) if re.fullmatch("[0-9a-f]{6,}", value) else _mixed(value, key, b"secret")
    return m[0][: m.start("value") - m.start()] + new + m[0][m.end("value") - m.start() :]


#: Names of the months in the languages of the corpus, long and short. Fixed values.
MONTHS = tuple(tuple(x.split()) for x in (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
))
_NAME = "|".join(sorted({n for names in MONTHS for n in names}, key=lambda n: (-len(n), n)))
_DATE = re.compile(
    r"(?i)(?<![\d/.\-])(?:(?P<ymd>\d{4}(?P<first>[\-/])\d{1,2}(?P=first)\d{1,2})|\d{1,2}(?P<mark>[./\-])\d{1,2}(?P=mark)\d{4})(?![\d/\-]|\.\d)"
    rf"|(?P<named>(?<![\w/.\-])(?P<day>\d{{1,2}})(?:\.|st|nd|rd|th|er)?[ \-](?:de |of )?(?P<month>{_NAME})\b\.?,?[ \-](?:de |del )?(?P<year>\d{{4}})(?!\d))"
    rf"|(?P<month_first>\b(?P<month2>{_NAME})\b\.? (?P<day2>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<year2>\d{{4}})(?!\d))"
)
#: Digits behind the country code, for codes with one length; numbers of other codes end where their groups do. Fixed values.
NATIONAL = {10: "1|7|44|91", 9: "31|33|34|41|48|212|351", 8: "45|47"}
_NO_CODE = "".join(rf"(?<!\+{'[0-9]' * n}[ .\-])" for n in (1, 2, 3))
#: In this order; each rule searches the gaps between the values that those before it have found.
RULES: list[tuple[str, re.Pattern, Callable[[re.Match, bytes], str | None]]] = [
    ("secret", re.compile(r"(?i)\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?(?P<value>eyJ[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+){1,4}|[A-Za-z0-9+/_\-]{6,})"), _secret),
    ("email", re.compile(r"(?<![\w.%+\-])[\w.%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"), _email),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _iban),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"), _ip),
    ("date", _DATE, _date),
    *(("phone", re.compile(rf"(?P<head>\+(?:{codes})[ .\-]?(?:\(0\)[ .\-]?)?)\(?\d(?:[ .\-()]{{0,2}}\d){{{n - 1}}}(?!\d)"), _number(b"phone")) for n, codes in NATIONAL.items()),
    ("ssn", re.compile(rf"(?<![\d\-]){_NO_CODE}\d{{3}}-\d{{2}}-\d{{4}}(?![\d\-])"), _number(b"ssn")),
    ("phone", re.compile(rf"(?<![\d.\-+(]){_NO_CODE}\(?\d{{3}}\)?[ .\-]\d{{3}}[ .\-]\d{{4}}(?!\d)"), _number(b"phone")),
    ("card", re.compile(r"(?<!\d)(?:\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{4}([ \-])\d{6}\2\d{5}|\d{13,19})(?!\d)"), _card),
    ("phone", re.compile(r"(?P<head>\+\d{1,3}[ .\-]?)\(?\d{1,4}\)?(?:[ .\-]?\d{2,5}){1,5}(?!\d)"), _number(b"phone")),
]
_DIGIT = re.compile("[0-9]")


def _values(text: str, low: int, high: int, pattern: re.Pattern, change: Callable[[re.Match, bytes], str | None], key: bytes) -> Iterator[tuple[re.Match, str]]:
    """Matches in text[low:high] that pass their check, with the new text; one that fails may hold another at its start or inside."""
    while m := pattern.search(text, low, high):
        low = m.start() + 1
        ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " ")]
        for end in ends:
            part = m if end == m.end() else pattern.match(text, m.start(), end)
            if part and part.end() == end and (new := change(part, key)) is not None:
                yield part, new
                low = end
                break


def pseudonymise(text: str, key: bytes = DEMO_KEY) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each value found in the text as given."""
    numbers = _DIGIT.search(text) is not None
    may = {"secret": "=" in text or ":" in text, "email": "@" in text}
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern, change in RULES:
        if not may.get(kind, numbers):
            continue
        gaps = zip([0, *(e for _, e, _, _ in found)], [*(s for s, _, _, _ in found), len(text)], strict=True)
        found += [(m.start(), m.end(), kind, new) for low, high in gaps for m, new in _values(text, low, high, pattern, change, key)]
        found.sort()
    out, at = [], 0
    for s, e, _, new in found:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), [(kind, s, e) for s, e, kind, _ in found]


def pseudonymise_documents(df: DataFrame, key: bytes | None = None) -> DataFrame:
    """df's columns with the values in `text` replaced; a null text stays null, an empty one empty, rows without values as they are.

    Without a key, the secret is read from KEY_SETTING.
    """
    key = key_of(df.sparkSession) if key is None else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = pa.array([None if (t := x.as_py()) is None else pseudonymise(t, key)[0] for x in batch.column(i)], pa.string())
            yield batch.set_column(i, batch.schema.field(i), texts.cast(batch.schema.field(i).type))

    common.prepare(df.sparkSession)
    return df.mapInArrow(common.task(run), df.schema)


def pseudonyms(df: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, the new text, n_found and kinds ('card:2 email:1') for each row of df.

    A null text gives a null text and 0; repeated rows give equal results; an empty table no rows. Only doc_id
    and text are read, so other columns may have any name. Without a key, the secret is read from KEY_SETTING.
    """
    key = key_of(df.sparkSession) if key is None else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = [], [], []
            for x in batch.column(1):
                text, found = (None, []) if x.as_py() is None else pseudonymise(x.as_py(), key)
                names = [k for k, _, _ in found]
                texts.append(text)
                counts.append(len(found))
                kinds.append(" ".join(f"{k}:{names.count(k)}" for k in sorted(set(names))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "text", "n_found", "kinds"])

    common.prepare(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.task(run), "doc_id long, text string, n_found long, kinds string")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(common.documents(spark, sf_dir), key_of(spark, demo=True))
