"""Operator 2, document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: at line ends, and inside a line at spaces whose preceding bytes hash to 0
modulo CUT, so that short texts and long lines have several and an edit moves few cuts. The set of their
64-bit digests goes into a sketch of cells (number, sum of digests, sum of checks), each digest into three
cells. Two sketches of one size are subtracted cell by cell; cells left with one digest are peeled until
nothing is left, which recovers the digests of either side alone. If that fails, sketches GROW times as large
are made from the texts and peeled again. Likeness is the share of digests that both sides have (Jaccard).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm import common

CUT, CELLS, GROW, HASHES, STRIPS = 2, 24, 4, 3, 4
_RNG = np.random.default_rng(2)
_LETTER = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SALTS = _RNG.integers(0, 2**63, HASHES + 1, dtype=np.uint64)
#: Bytes of text that are hashed at once.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _HELD
    if len(_HELD[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _HELD = tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)])) for b in (_BASE, inverse))
    return _HELD[0][:n], _HELD[1][:n]


_HELD: tuple[np.ndarray, np.ndarray] = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def paragraph_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct paragraph digests of each text: text numbers (ascending) and digests. Blank paragraphs do not count."""
    gap = b"\n\n\n\n"  # so that no cut depends on the text before
    sizes = np.array([len(t) + len(gap) for t in texts], dtype=np.int64)
    data = np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8)
    n = len(data)
    powers, inverses = _powers(n)
    values = _LETTER[data]
    # the three bytes before a space decide whether it cuts
    local = np.zeros(n, dtype=np.uint64)
    local[3:] = values[:-3] * np.uint64(3) + values[1:-2] * np.uint64(5) + values[2:-1] * np.uint64(7)
    cut = (data == 10) | ((data == 32) & (mix(local) % np.uint64(CUT) == 0))
    ends = np.flatnonzero(cut)
    starts = np.concatenate([[0], ends[:-1] + 1])
    visible = np.concatenate([[0], np.cumsum(data > 32)])
    solid = visible[ends] > visible[starts]
    starts, ends = starts[solid], ends[solid]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers)])
    digests = mix((sums[ends] - sums[starts]) * inverses[starts])
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    order = np.lexsort((digests, owner))
    owner, digests = owner[order], digests[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (digests[1:] != digests[:-1])
    return owner[new], digests[new]


def blocks(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if texts:
        yield first, len(texts)


def digest_lists(texts: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, b in blocks(texts):
        owner, digests = paragraph_digests(texts[a:b])
        out += np.split(digests, np.searchsorted(owner, np.arange(1, b - a)))
    return out


class Sketches:
    """Sketches of one size of many texts, as arrays of (text, cell)."""

    def __init__(self, lists: list[np.ndarray], cells: int):
        self.texts, self.cells = len(lists), cells
        self.number = np.zeros(self.texts * cells, dtype=np.int64)
        self.total = np.zeros(self.texts * cells, dtype=np.uint64)
        self.check = np.zeros(self.texts * cells, dtype=np.uint64)
        owner = np.repeat(np.arange(self.texts), [len(x) for x in lists])
        if len(owner):
            self.add(owner, np.concatenate(lists), 1)

    def places(self, owner: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """The cells of each digest: one in each third of the sketch."""
        third = np.uint64(self.cells // HASHES)
        own = [mix(digests + _SALTS[k]) % third + np.uint64(k) * third for k in range(HASHES)]
        return np.stack(own).astype(np.int64) + owner * self.cells

    def add(self, owner: np.ndarray, digests: np.ndarray, sign: int | np.ndarray) -> None:
        at = self.places(owner, digests).ravel()
        signs = np.broadcast_to(np.asarray(sign, dtype=np.int64), digests.shape)
        marks = mix(digests ^ _SALTS[HASHES])
        np.add.at(self.number, at, np.tile(signs, HASHES))
        np.add.at(self.total, at, np.tile(digests * signs.astype(np.uint64), HASHES))
        np.add.at(self.check, at, np.tile(marks * signs.astype(np.uint64), HASHES))

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches.__new__(Sketches)
        out.texts, out.cells = self.texts, self.cells
        out.number, out.total, out.check = self.number - other.number, self.total - other.total, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text how many digests only the left and only the right side has, and whether all were recovered."""
        left, right = np.zeros(self.texts, dtype=np.int64), np.zeros(self.texts, dtype=np.int64)
        for _ in range(64):
            at = np.flatnonzero(np.abs(self.number) == 1)
            sign = self.number[at]
            digests = self.total[at] * sign.astype(np.uint64)
            pure = mix(digests ^ _SALTS[HASHES]) * sign.astype(np.uint64) == self.check[at]
            at, sign, digests = at[pure], sign[pure], digests[pure]
            if not len(at):
                break
            owner = at // self.cells
            order = np.lexsort((digests, owner))  # a digest may be alone in several of its cells
            owner, sign, digests = owner[order], sign[order], digests[order]
            new = np.ones(len(owner), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (digests[1:] != digests[:-1])
            owner, sign, digests = owner[new], sign[new], digests[new]
            left += np.bincount(owner[sign > 0], minlength=self.texts)
            right += np.bincount(owner[sign < 0], minlength=self.texts)
            self.add(owner, digests, -sign)
        empty = ((self.number == 0) & (self.total == 0) & (self.check == 0)).reshape(self.texts, self.cells).all(axis=1)
        return left, right, empty

    def written(self) -> list[str]:
        """Each sketch as text: cell numbers, sums and checks in base64."""
        rows = np.zeros((self.texts, self.cells), dtype=np.dtype([("n", "<u2"), ("total", "<u8"), ("check", "<u4")]))
        rows["n"], rows["total"] = self.number.reshape(rows.shape), self.total.reshape(rows.shape)
        rows["check"] = self.check.reshape(rows.shape).astype(np.uint32)
        return [base64.b64encode(r.tobytes()).decode() for r in rows]


def likenesses(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard likeness of each pair of texts, from what their subtracted sketches recover, and the size of the sketches that did. Two empty texts are alike."""
    out, todo, used = np.ones(len(a)), np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    while len(todo):
        rest = []
        step = max(1, (1 << 18) // cells)
        for at in range(0, len(todo), step):
            own = todo[at : at + step]
            la, lb = [a[i] for i in own], [b[i] for i in own]
            left, right, done = Sketches(la, cells).minus(Sketches(lb, cells)).peel()
            total = np.array([len(x) + len(y) for x, y in zip(la, lb, strict=True)])
            both = (total - left - right) / 2
            out[own[done]] = np.where(total == 0, 1.0, both / np.maximum(1, total - both))[done]
            used[own[done]] = cells
            rest.append(own[~done])
        todo, cells = np.concatenate(rest), cells * GROW
    return out, used


def edited_text(text: str, following: str) -> str:
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by strip and place; each row's next row in its strip is its next document; rows marked `extra` only serve as such."""
    rest: list[tuple] = []
    for batch in batches:
        rows = rest + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        at = 0
        while len(rows) - at > 1:
            end, size = at, 0
            while end < len(rows) - 1 and size < BLOCK:
                size += len(rows[end][3])
                end += 1
            yield _answers(rows[at : end + 1])
            at = end
        rest = rows[at:]


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    own = [i for i in range(len(rows) - 1) if not rows[i][1]]
    texts = [r[3] for r in rows]
    edits = [edited_text(texts[i], texts[i + 1]) for i in own]
    raw, raw_edits = [t.encode() for t in texts], [t.encode() for t in edits]
    lists, edit_lists = digest_lists(raw), digest_lists(raw_edits)
    mine = [lists[i] for i in own]
    columns = [
        pa.array([rows[i][2] for i in own], pa.int64()),
        pa.array([len(texts[i]) for i in own], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in raw_edits], pa.string()),
        pa.array(Sketches(mine, CELLS).written() if own else [], pa.string()),
        pa.array(Sketches(edit_lists, CELLS).written() if own else [], pa.string()),
    ]
    for others in (edit_lists, [lists[i + 1] for i in own]):
        near, cells = likenesses(mine, others)
        columns += [pa.array(near, pa.float64()), pa.array(cells, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "edited_cells", "near_next", "next_cells"])


def fingerprint_documents(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next for each row of df.

    edited_cells and next_cells are the sizes of the sketches that were peeled for them: CELLS if the written
    fingerprints were enough, else larger ones made from the texts.

    Documents follow one another by descending doc_id, then text, null ids last, and the first follows the last;
    a single row follows itself. Null and empty texts have an empty sketch. An empty table gives no rows. Only
    doc_id and text are read, so other columns may have any name.

    The table is cut into strips at ids taken from it (STRIPS for each partition); the head of each strip is
    copied to the strip before, so each task sees the next document of every row of its own.
    """
    spark = common.prepare(df.sparkSession)
    rows = df.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), common.text_of(df).alias("text"))
    strips, (count, top) = STRIPS * common.partitions(spark), rows.agg(F.count("*"), F.max("id")).first()
    sample = rows.select("id").sample(min(1.0, 20 * strips / count), seed=2) if count else rows.select("id").limit(0)
    picked = sorted((r[0] for r in sample.collect()), reverse=True)  # about 20 ids for each strip
    heads = np.array(sorted({*picked[:: max(1, len(picked) // strips)], *([top] if count else [])}), dtype=np.int64)

    @F.pandas_udf("array<struct<strip: int, extra: boolean>>")
    def places(ids: pd.Series) -> pd.Series:
        """Strip 0 begins at the greatest id; a head also goes to the strip before its own, the greatest to the last."""
        at = np.searchsorted(heads, ids.to_numpy())
        own = len(heads) - 1 - at
        head = heads[at] == ids.to_numpy()
        return pd.Series([[(k, False), ((k - 1) % len(heads), True)] if h else [(k, False)] for k, h in zip(own.tolist(), head.tolist(), strict=True)])

    dealt = rows.withColumn("to", F.explode(places("id"))).select(F.col("to.strip").alias("strip"), F.col("to.extra").alias("extra"), "id", "text")
    ordered = dealt.repartition(common.partitions(spark), "strip").sortWithinPartitions("strip", "extra", F.desc("id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, edited_cells long, near_next double, next_cells long"
    return ordered.select("strip", "extra", F.when(F.col("id") > -(2**63), F.col("id")).alias("doc_id"), "text").mapInArrow(common.task(_fingerprinted), schema)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(common.documents(spark, sf_dir))
