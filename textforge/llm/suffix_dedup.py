"""Operator 3, suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts anywhere else.

The suffixes of a whole corpus are never moved. Each string of LENGTH bytes is filed under an anchor, the place in
it whose GRAM bytes have the least hash; equal strings have their anchors at the same place, so they meet under the
same hash, and only about one position in 70 is an anchor.

* An anchor's hull is all bytes of all strings filed under it. Anchors whose gram occurs once are done: nothing is
  repeated there. Hulls that occur twice are repeated as a whole; 128 bits of a cryptographic digest of all their bytes
  tell them apart, which stands for comparing the bytes.
* The few anchors with a repeated gram but a hull of their own lie at the ends of repeats. Their hulls, one of each
  kind, are sorted gram by gram: the suffixes from each start are merge-sorted by comparisons that find the common
  extension by binary search over prefix polynomial hashes, so a comparison costs log2(LENGTH) steps. Neighbours
  that agree in LENGTH bytes are repeats; these are verified byte by byte.
* A gram with more than HOT kinds of hull is not gathered in one task: each of its strings is dealt by such a digest of
  its own bytes, and equal ones meet there. The result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm import common
from textforge.llm.fingerprint import _powers, blocks, mix

LENGTH, GRAM, HOT = 200, 48, 20_000
#: Bits for the place in a block of texts: blocks of up to 16 GB.
PLACE_BITS = np.uint64(34)
_RNG = np.random.default_rng(3)
_TABLE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class PrefixHashes:
    """Polynomial hashes of every prefix of some bytes: of any slice in a few operations."""

    def __init__(self, data: np.ndarray):
        powers, self.inverses = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * powers[:-1], out=self.sums[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverses[starts]


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of width values, by doubling."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The anchors of each text: text number, place of the anchor, first and last start of its strings (places in the text), hashes of gram and hull."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    bases = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return {k: none for k in ("text", "place", "low", "high", "gram", "hull", "hull2")}
    hashes = PrefixHashes(data)
    at = np.arange(n - gram + 1)
    grams = mix(hashes.slices(at, at + gram))
    # the upper bits of the hash, the same number in every block, then the place: of equal ones the first in the string
    least = _window_least((grams >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64), length - gram + 1)
    place = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)  # of the string at each start
    text = np.repeat(np.arange(len(texts)), np.maximum(0, sizes - length + 1))
    start = np.concatenate([np.arange(b, b + max(0, s - length + 1)) for b, s in zip(bases, sizes, strict=True)]) if len(text) else np.zeros(0, dtype=np.int64)
    place = place[start]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    heads = np.flatnonzero(first)
    low, high = start[heads], start[np.concatenate([heads[1:], [len(start)]]) - 1] if len(heads) else start[:0]
    text, place = text[heads], place[heads]
    raw = data.tobytes()
    hull = digests((raw[a : b + length] + bytes((c,)) for a, b, c in zip(low.tolist(), high.tolist(), (place - low).tolist(), strict=True)), len(low))
    base = bases[text]
    return {"text": text, "place": place - base, "low": low - base, "high": high - base, "gram": grams[place].view(np.int64), "hull": hull[:, 0], "hull2": hull[:, 1]}


def digests(pieces: Iterable[bytes], count: int) -> np.ndarray:
    """128 bits of a cryptographic digest of each piece, as two numbers."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in pieces]), dtype=np.int64).reshape(count, 2)


def suffix_sort(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders the suffixes of data at starts inside each group by their first length bytes, by a bottom-up mergesort.

    group ascends. Returns the order and, for each but the last of it, whether it and the next agree in all length
    bytes (and in group). All merges of a level are done at once: an element's place is its own rank plus the number
    of smaller elements in the partner run, found by binary search with hash comparisons.
    """
    hashes = PrefixHashes(data)
    n = len(starts)
    order = np.arange(n)
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.concatenate([bounds, [n]])) if n else bounds
    base, size = np.repeat(bounds, sizes), np.repeat(sizes, sizes)
    rank = np.arange(n) - base
    run = 1
    while n and run < sizes.max():
        half = rank // run
        left = half % 2 == 0
        partner = base + (half ^ 1) * run  # where the partner run begins
        lo = np.minimum(partner, base + size)
        hi = np.minimum(partner + run, base + size)
        begin = lo.copy()
        # the number of partner elements before this one; on ties the left run's come first
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            middle = (lo[live] + hi[live]) // 2
            c = _compare(data, hashes, starts[order[middle]], starts[order[live]], length)
            below = (c < 0) | ((c == 0) & ~left[live])
            lo[live[below]] = middle[below] + 1
            hi[live[~below]] = middle[~below]
        target = base + half // 2 * 2 * run + rank % run + (lo - begin)
        moved = np.empty_like(order)
        moved[target] = order
        order, run = moved, 2 * run
    same = np.zeros(max(0, n - 1), dtype=bool)
    if n > 1:
        a, b = starts[order[:-1]], starts[order[1:]]
        same = (group[order[:-1]] == group[order[1:]]) & (hashes.slices(a, a + length) == hashes.slices(b, b + length))
        for at in range(0, n - 1, 1 << 14):  # the hashes are verified
            pairs = np.flatnonzero(same[at : at + (1 << 14)]) + at
            span = np.arange(length)
            same[pairs] = (data[a[pairs][:, None] + span] == data[b[pairs][:, None] + span]).all(axis=1)
    return order, same


def _compare(data: np.ndarray, hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """The sign of the comparison of the suffixes at a and b, up to length bytes: the common extension by binary search, then one byte."""
    low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), length)
    for _ in range(int(length).bit_length()):
        middle = (low + high + 1) // 2
        equal = hashes.slices(a, a + middle) == hashes.slices(b, b + middle)
        low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
    at = np.minimum(low, length - 1)
    return np.where(low >= length, 0, data[a + at].astype(np.int64) - data[b + at])


def _spans(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(keep.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for a, b in blocks(texts):
                found = anchors(texts[a:b], length, gram)
                at = found["text"] + a
                packed = found["place"] << 16 | (found["place"] - found["low"]) << 8 | (found["high"] - found["low"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(marks[at]), pa.array(packed), pa.array(found["gram"]), pa.array(found["hull"]), pa.array(found["hull2"])], names=["doc_id", "mark", "spot", "gram", "hull", "hull2"])

    return run


def _hull_rows(length: int):
    """(doc_id, mark, text, spots) to a row for each spot: gram, hot, lone, doc_id, mark, spot and hull's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc_id, mark, text, spots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s in spots:
                    low, high = _range(s["spot"])
                    out.append((s["gram"], s["hot"], s["lone"], doc_id, mark, s["spot"], text[low : high + length]))
                    size += high - low + length
                if size > 1 << 22:
                    yield _batch(out, _HULL)
                    out, size = [], 0
            if out:
                yield _batch(out, _HULL)

    return run


_HULL = pa.schema([("gram", pa.int64()), ("hot", pa.bool_()), ("lone", pa.bool_()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("spot", pa.int64()), ("hull", pa.binary())])
_PART = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_STRING = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("lone", pa.bool_()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _range(spot: int) -> tuple[int, int]:
    """First and last start of the strings of an anchor."""
    low = (spot >> 16) - (spot >> 8 & 255)
    return low, low + (spot & 255)


def repeated_starts(rows: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """(doc_id, mark, low, high): ranges of bytes covered by repeats, for lone rows (gram, hot, lone, doc_id, mark, spot, hull) that come gram by gram."""
    data = np.frombuffer(b"".join(r[6] for r in rows), dtype=np.uint8)
    sizes = np.array([len(r[6]) for r in rows], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    strings = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), strings)
    inner = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(strings)[:-1]]), strings)
    starts = base[row] + inner
    before = np.array([r[5] >> 8 & 255 for r in rows], dtype=np.int64)  # bytes of the hull before the anchor
    grams = np.array([r[0] for r in rows], dtype=np.int64)
    number = np.cumsum(np.concatenate([[0], grams[1:] != grams[:-1]]))
    group = number[row] * 512 + (inner - before[row] + 256)  # strings are compared at the same place before the anchor
    by_group = np.argsort(group, kind="stable")
    group, row, inner, starts = group[by_group], row[by_group], inner[by_group], starts[by_group]
    order, same = suffix_sort(data, starts, group, length)
    twice = np.zeros(len(starts), dtype=bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    lone = np.array([r[2] for r in rows], dtype=bool)
    out = []
    covered = np.zeros(len(data) + 1, dtype=np.int64)
    picked = starts[twice & lone[row]]
    np.add.at(covered, picked, 1)
    np.add.at(covered, picked + length, -1)
    keep = np.cumsum(covered[:-1]) > 0
    limits = np.concatenate([base, [len(data)]])
    for i in np.unique(row[twice & lone[row]]):
        low, _ = _range(rows[i][5])
        for s, e in zip(*_spans(keep[limits[i] : limits[i + 1]]), strict=True):
            out.append((rows[i][3], rows[i][4], low + int(s), low + int(e)))
    return out


def _sorted_grams(length: int, most: int = 1 << 19):
    """Whole grams at a time, several together up to `most` bytes of hulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        open_gram: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_gram and row[0] != open_gram[0][0]:
                    held += open_gram if len(open_gram) > 1 else []
                    open_gram = []
                    if size > most:
                        yield _batch(repeated_starts(held, length), _PART)
                        held, size = [], 0
                open_gram.append(row)
                size += len(row[6])
        held += open_gram if len(open_gram) > 1 else []
        if held:
            yield _batch(repeated_starts(held, length), _PART)

    return run


def _hot_strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, _, lone, doc_id, mark, spot, hull in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(hull) - length + 1
                at, found = np.arange(n), digests((hull[i : i + length] for i in range(n)), n)
                low, _ = _range(spot)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array([lone] * n), pa.array([doc_id] * n, pa.int64()), pa.array([mark] * n, pa.int64()), pa.array(at + low)], schema=_STRING)

    return run


def _cut(payload: bool | str):
    """(doc_id, text, parts, ...) to the counts, the digest of what is kept, with payload these bytes, and the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = merged([(p["low"], p["high"]) for p in parts or []])
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                rest = b"".join(kept)
                rows.append((doc_id, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), (rest.decode("utf-8", "ignore").encode() if payload == "text" and spans else rest) if payload else None))
            out = _batch(rows, _RESULT)
            for k in range(3, batch.num_columns):
                out = out.append_column(batch.schema.field(k).name, batch.column(k))
            yield out

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges made one."""
    out: list[list[int]] = []
    for s, e in sorted(parts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, payload: bool | str = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with payload) kept, the remaining bytes, for each row of df.

    With payload "text", kept is valid UTF-8: bytes left over of a character that a cut parts are dropped.

    Null and empty texts have no bytes; texts shorter than length keep all. Repeated rows repeat each other and go
    as a whole if length or longer. A null doc_id is kept. An empty table gives no rows. Only doc_id and text are
    read, so other columns may have any name. length - gram must be below 256. Columns of df named in carry come too.
    """
    spark = common.prepare(df.sparkSession)
    text = common.text_of(df).cast("binary")
    # a row is known by its doc_id and a mark of its text, in case a doc_id is repeated
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), *common.row_key(df), text.alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    n = common.partitions(spark)
    schema = "doc_id long, mark long, spot long, gram long, hull long, hull2 long"
    folder = common.shared_dir(spark, "repeated-anchors")
    with common.scratch(spark):  # most anchors are not repeated, and are deleted here
        found, count = common.mapped(rows.select("id", "mark", "text"), _anchor_rows(length, gram), schema, "anchors")
        # tables of their own, so that Spark can split the partition of a very frequent gram or hull in the joins
        several = found.groupBy("gram").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in ("hull", "hull2") for k, f in (("least", F.min), ("most", F.max))]).where("n > 1")
        grams = common.saved(several.select("gram", F.expr("least_hull <> most_hull or least_hull2 <> most_hull2").alias("mixed")), "repeated-grams", count // 4)
        common.drop_shuffles(spark)
        known = common.saved(found.join(grams, "gram"), "repeated-anchors", count // 3, folder)
    start = F.shiftright("spot", 16) - F.shiftright("spot", 8).bitwiseAND(255)
    part = (F.col("doc_id"), F.col("mark"), start.alias("low"), (start + F.col("spot").bitwiseAND(255) + length).alias("high"))
    whole = known.where("not mixed").select(*part)
    mixed = known.where("mixed").drop("mixed")
    kinds = mixed.groupBy("gram", "hull", "hull2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "spot")).alias("one"))
    kinds = common.saved(kinds, "hulls", count // 4)
    repeated = mixed.join(kinds.where("n > 1").select("gram", "hull", "hull2"), ["gram", "hull", "hull2"]).select(*part)
    large = kinds.groupBy("gram").count().where(F.col("count") > hot).select("gram", F.lit(True).alias("hot"))
    spots = kinds.join(large, "gram", "left").select("one.doc_id", "one.mark", F.struct(F.col("one.spot").alias("spot"), "gram", F.coalesce("hot", F.lit(False)).alias("hot"), (F.col("n") == 1).alias("lone")).alias("at"))
    by_text = spots.groupBy("doc_id", "mark").agg(F.collect_list("at").alias("spots"))  # bounded by the text's length
    schema = "gram long, hot boolean, lone boolean, doc_id long, mark long, spot long, hull binary"
    by_text = common.saved(by_text.select(F.col("doc_id").alias("id"), "mark", "spots"), "spots", count // 40)
    texts = common.thinned(rows.select("id", "mark", "text"), by_text, "mark").join(by_text, ["id", "mark"]).dropDuplicates(["id", "mark"])
    hulls, _ = common.mapped(texts.select("id", "mark", "text", "spots"), _hull_rows(length), schema, "hull-bytes")
    common.drop_shuffles(spark)
    dealt = hulls.where("not hot").repartition(n, "gram").sortWithinPartitions("gram")
    sorted_parts = dealt.mapInArrow(common.task(_sorted_grams(length)), "doc_id long, mark long, low long, high long")
    strings = hulls.where("hot").mapInArrow(common.task(_hot_strings(length)), "one long, two long, lone boolean, doc_id long, mark long, start long")
    twice = strings.groupBy("one", "two").count().where("count > 1").select("one", "two")
    hot_parts = strings.where("lone").join(twice, ["one", "two"]).select("doc_id", "mark", F.col("start").alias("low"), (F.col("start") + length).alias("high"))
    parts = whole.unionAll(repeated).unionAll(sorted_parts).unionAll(hot_parts)
    spans = parts.groupBy(F.col("doc_id").alias("id"), "mark").agg(F.collect_list(F.struct("low", "high")).alias("parts"))  # bounded by the text's length
    result = rows.join(spans, ["id", "mark"], "left").select("doc_id", "text", "parts", *[f"carry_{c}" for c in carry])
    kinds_of = dict(rows.dtypes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary" + "".join(f", carry_{c} {kinds_of[f'carry_{c}']}" for c in carry)
    return result.mapInArrow(common.task(_cut(payload)), schema).withColumnsRenamed({f"carry_{c}": c for c in carry})


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir), payload=False).drop("kept")
