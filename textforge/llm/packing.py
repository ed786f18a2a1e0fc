"""Operator 4, packing: a cutting-stock linear program by column generation over the histogram of piece lengths.

A document's ids are cut into full sequences, one piece whose length is a multiple of STEP and a rest below
STEP. So there are few lengths (the program's size does not depend on the corpus) and all are exact: a
pattern of lengths says at which offset each piece starts. The dual prices of the program go to an unbounded
knapsack by dynamic programming, which returns the next pattern until none is worth more than one sequence.
Solved patterns are rounded down, what is left over is placed first-fit by decreasing length, and the
pieces of each length, ranked strip by strip of a hash, take the places of that length in turn.
"""

from __future__ import annotations

import struct
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textforge.llm import common
from textforge.llm.token_store import END_ID
from textforge.llm.word_ids import encoder, vocabulary

SEQUENCE, STEP = 2048, 16


def cuts(n: int, sequence: int = SEQUENCE, step: int = STEP) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    out = [(at, sequence) for at in range(0, n - sequence + 1, sequence)]
    at = len(out) * sequence
    if middle := (n - at) // step * step:
        out.append((at, middle))
        at += middle
    if n > at:
        out.append((at, n - at))
    return out


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int, step: int = STEP) -> tuple[float, np.ndarray]:
    """The dearest pattern of lengths within capacity and its worth: an unbounded knapsack by dynamic programming.

    Lengths that are multiples of step are solved in units of step, the others in units of 1, then both are joined.
    """
    large = lengths % step == 0
    units = [_knapsack((lengths[large] // step).tolist(), prices[large].tolist(), capacity // step), _knapsack(lengths[~large].tolist(), prices[~large].tolist(), capacity)]
    (worth_l, last_l), (worth_s, last_s) = units
    u = max(range(capacity // step + 1), key=lambda u: worth_l[u] + worth_s[capacity - step * u])
    pattern = np.zeros(len(lengths), dtype=np.int64)
    for own, last, c in ((np.flatnonzero(large), last_l, u), (np.flatnonzero(~large), last_s, capacity - step * u)):
        sizes = lengths[own] // step if last is last_l else lengths[own]
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                pattern[own[last[c]]] += 1
                c -= int(sizes[last[c]])
    return worth_l[u] + worth_s[capacity - step * u], pattern


def _knapsack(sizes: list[int], prices: list[float], capacity: int) -> tuple[list[float], list[int]]:
    """For each capacity the best worth, and the last item taken there (-1: none)."""
    worth, last = [0.0] * (capacity + 1), [-1] * (capacity + 1)
    items = sorted((s, p, k) for k, (s, p) in enumerate(zip(sizes, prices, strict=True)) if p > 0)
    kept, most = [], 0.0
    for s, p, k in items:  # a larger item that is no dearer is never needed
        if p > most:
            kept.append((s, p, k))
            most = p
    for c in range(1, capacity + 1):
        best, item = worth[c - 1], -1
        for s, p, k in kept:
            if s > c:
                break
            if (value := worth[c - s] + p) > best + 1e-12:
                best, item = value, k
        worth[c], last[c] = best, item
    return worth, last


def cutting_stock(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in the linear program's solution (revised simplex, column generation).

    It ends when the best pattern's worth shows the objective to be within 1 part in 10,000 of the optimum. If it has
    not come so far after the rounds, which a cycle of degenerate steps may cause, a warning tells how near it is.
    """
    m = len(lengths)
    if not m:
        return []
    basis = np.diag(capacity // lengths).astype(float)  # column j: as many of length j as fit
    inverse = np.diag(1.0 / np.diag(basis))
    use = inverse @ counts.astype(float)
    for turn in range(rounds):
        prices = inverse.sum(axis=0)  # the cost of each pattern is 1
        worth, pattern = best_pattern(lengths, prices, capacity)
        if worth <= 1 + 1e-4:
            break
        column = inverse @ pattern
        ok = column > 1e-10
        ratio = np.where(ok, use / np.where(ok, column, 1), np.inf)
        r = int(ratio.argmin())
        step = max(0.0, ratio[r])
        use = use - step * column
        use[r] = step
        basis[:, r] = pattern
        row = inverse[r] / column[r]
        inverse = inverse - np.outer(column, row)
        inverse[r] = row
        if turn % 50 == 49:  # rounding errors do not build up
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", basis, inverse))
            use = np.maximum(0, inverse @ counts)
    else:
        warnings.warn(f"the packing program is within a factor of {worth:.4f} of its bound", stacklevel=2)
    return [(basis[:, j].astype(np.int64), float(use[j])) for j in range(m) if use[j] > 1e-9]


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = SEQUENCE) -> list[tuple[np.ndarray, int]]:
    """Patterns (numbers of each length) and how often to use each; together they hold exactly the counts."""
    left, out = counts.astype(np.int64).copy(), []
    for pattern, use in cutting_stock(lengths, counts, capacity):
        times = int(use + 1e-6)
        fits = min([times, *(left[pattern > 0] // pattern[pattern > 0])])
        if fits > 0:
            out.append((pattern, int(fits)))
            left -= fits * pattern
    # What rounding left over: of at most one sequence for each pattern.
    order = np.argsort(-lengths)
    while left.any():
        pattern, room = np.zeros(len(lengths), dtype=np.int64), capacity
        for k in order:
            if n := int(min(left[k], room // lengths[k])):
                pattern[k], room = n, room - n * int(lengths[k])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


def places(lengths: np.ndarray, patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces in a sequence, first sequence, offset in the sequence, end rank) for each length and pattern."""
    taken, out, sequence = np.zeros(len(lengths), dtype=np.int64), [], 0
    order = np.argsort(-lengths)
    for pattern, times in patterns:
        offset = 0
        for k in order:
            if n := int(pattern[k]):
                end = int(taken[k]) + n * times
                out.append((int(lengths[k]), int(taken[k]), n, sequence, offset, end))
                taken[k] = end
                offset += n * int(lengths[k])
        sequence += times
    return out


def _pieces(vocab: str, sequence: int, step: int, payload: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, end = encoder(vocab).encode_all, struct.pack("<I", END_ID)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(x.as_py() for x in batch.column(1)), strict=True):
                ids += end
                n = len(ids) // 4
                for at, length in cuts(n, sequence, step):
                    own = ids[4 * at : 4 * (at + length)]
                    rows.append((doc_id, at, length, zlib.crc32(own), n, own if payload == "ids" else None))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def pack_documents(df: DataFrame, sequence: int = SEQUENCE, step: int = STEP, vocab: str | None = None, payload: str = "ids") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (null unless payload is 'ids').

    Null and empty texts are one piece, the end id. Repeated rows are packed each; a null doc_id is kept.
    An empty table gives no rows. Only doc_id and text are read, whatever other columns are called.
    """
    spark = common.prepare(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(df).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    pieces, _ = common.mapped(rows, _pieces(vocab or vocabulary(), sequence, step, payload), schema, "pieces", encoder=True)
    # The ranks of a length are given strip by strip, so a frequent length is not one task's work.
    pieces = pieces.withColumn("strip", F.pmod(F.xxhash64("doc_id", "start"), F.lit(2 * common.partitions(spark))))
    strips = pieces.groupBy("length", "strip").count()
    before = strips.select("length", "strip", (F.sum("count").over(Window.partitionBy("length").orderBy("strip")) - F.col("count")).alias("before"))
    histogram = sorted(map(tuple, pieces.groupBy("length").count().collect()))  # at most sequence / step + step rows
    lengths, counts = np.array([h[0] for h in histogram], dtype=np.int64), np.array([h[1] for h in histogram], dtype=np.int64)
    spots = spark.createDataFrame(
        [(*p, i) for i, p in enumerate(places(lengths, plan(lengths, counts, sequence)))],
        "length long, first long, each long, sequence long, at long, end long, spot int",
    )
    own = Window.partitionBy("length", "strip").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        pieces.withColumn("own", F.row_number().over(own))
        .join(before, ["length", "strip"])
        .withColumn("rank", F.col("before") + F.col("own") - 1)
    )
    here = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(spots), "length")
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            (F.col("sequence") + F.floor(here / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("at") + here % F.col("each") * F.col("length")).cast("long").alias("offset"), "ids",
        )
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir), payload="crc32").drop("ids")
