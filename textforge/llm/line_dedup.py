"""Operator 13, line dedup: a long line that many documents share stays in one of them only.

Digests of the lines are range-partitioned together with the document, so that a line of very many documents is spread
over many tasks, and sorted by document and place. Each task streams its rows: the first document of a digest keeps its
lines, later ones lose theirs once enough documents are seen. A digest at the edge of a task is settled afterwards from
one summary of each task. What comes out is a compressed bitmap of kept lines for each document, not the text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textforge.llm import common

MIN_CHARS, MIN_DOCS = 40, 5
WHITE = b" \t\n\v\f\r"
LOWEST = -(2**63)
#: Rows that a stream looks at together, and undecided rows of one digest that it holds.
CHUNK_ROWS, PENDING_ROWS = 1 << 16, 1 << 20
#: Lines of one range.
RANGE_ROWS = 2_000_000

LINES = "h1 long, h2 long, id long, mark long, place int"
#: docs 0: a line that goes. docs -1: a line that goes if its digest's summaries say so. Else a summary: id and mark are
#: the first and the last document, docs their number.
FOUND = "h1 long, h2 long, id long, mark long, place int, docs long"


def line_digest(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128 bits of the line's key, or None where the key is too short: white space stripped at both ends, A-Z in lower case."""
    key = line.strip(WHITE)
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each long line, and one without digest for each document, whose place is its number of lines."""
        for batch in batches:
            digests, owner, place = [], [], []
            counts = np.zeros(batch.num_rows, np.int32)
            for i, text in enumerate(batch.column(2)):
                lines = text.as_py().split(b"\n")
                counts[i] = len(lines)
                for k, line in enumerate(lines):
                    if (d := line_digest(line, min_chars)) is not None:
                        digests.append(d)
                        owner.append(i)
                        place.append(k)
            ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            none = np.ones(len(ids), bool)
            known = [pa.array(np.concatenate([h[:, k], np.zeros(len(ids), np.int64)]), mask=np.concatenate([np.zeros(len(h), bool), none])) for k in (0, 1)]
            at = np.array(owner, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*known, pa.array(np.concatenate([ids[at], ids])), pa.array(np.concatenate([marks[at], marks])), pa.array(np.concatenate([np.array(place, np.int32), counts]))],
                names=["h1", "h2", "id", "mark", "place"],
            )

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_ROWS:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, n = [], 0
    if n:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


class _Digest:
    """The digest that a stream is in: its documents so far and its undecided rows."""

    def __init__(self, h: tuple[int, int], first: int, head: bool):
        self.h, self.first, self.last, self.docs, self.head, self.told = h, first, first, 1, head, head
        self.pending: list[np.ndarray] = []

    def summary(self) -> np.ndarray:
        return np.array([[*self.h, self.first, self.last, 0, self.docs]], np.int64)


def _rows(rows: np.ndarray, docs: int) -> np.ndarray:
    return np.column_stack([rows, np.full(len(rows), docs, np.int64)])


def _streamed(min_docs: int):
    """First occurrences over rows sorted by digest, document (largest first), text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        out: list[np.ndarray] = []

        def close(g: _Digest, tail: bool) -> None:
            """Rows still undecided: few documents, or more of them in the next task."""
            if g.pending and (tail or g.told):
                out.extend(_rows(p, -1) for p in g.pending)
                g.told = True
            if g.told or tail:
                out.append(g.summary())

        for columns in _chunks(batches):
            rows = np.column_stack([c.astype(np.int64) for c in columns])
            starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            ends = np.r_[starts[1:], len(rows)]
            new_doc = np.r_[True, rows[1:, 2] != rows[:-1, 2]]
            new_doc[starts] = True
            docs = np.add.reduceat(new_doc, starts)
            # digests that begin and end in this chunk and are no task's first: only those of enough documents matter
            inner = np.ones(len(starts), bool)
            inner[[0, -1]] = False
            many = np.flatnonzero(inner & (docs >= min_docs))
            if len(many):
                size = ends[many] - starts[many]
                at = np.repeat(starts[many], size)
                every = at + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                out.append(_rows(rows[every[rows[every, 2] != rows[at, 2]]], 0))
            for k in dict.fromkeys((0, len(starts) - 1)):
                own, n = rows[starts[k] : ends[k]], int(docs[k])
                h = (int(own[0, 0]), int(own[0, 1]))
                if now is not None and now.h == h:
                    now.docs += n - (int(own[0, 2]) == now.last)
                else:
                    if now is not None:
                        close(now, tail=False)
                    now = _Digest(h, int(own[0, 2]), head=now is None)
                    now.docs = n
                now.last = int(own[-1, 2])
                if now.head:  # the task before may hold a larger document
                    out.append(_rows(own, -1))
                    continue
                own = own[own[:, 2] != now.first]
                if now.docs >= min_docs:
                    out.extend(_rows(p, 0) for p in [*now.pending, own])
                    now.pending = []
                elif len(own):
                    now.pending.append(own)
                    if sum(map(len, now.pending)) > PENDING_ROWS:
                        out.extend(_rows(p, -1) for p in now.pending)
                        now.pending, now.told = [], True
            yield _batch(out)
            out = []
        if now is not None:
            close(now, tail=True)
            yield _batch(out)

    return run


def _batch(parts: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(parts) if parts else np.zeros((0, 6), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, k], pa.int32() if k == 4 else pa.int64()) for k in range(6)], names=["h1", "h2", "id", "mark", "place", "docs"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped, maps = [], []
        for n, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep = np.ones(n, np.uint8)
            keep[gone] = 0
            dropped.append(len(gone))
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=["id", "mark", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(df: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """id, mark, n_lines, n_dropped, keep: one row for each different (doc_id, text) of df, known by common.row_key().

    keep is zlib's compression of packed bits, one for each line, most significant first; kept_lines() reads it. A line's
    key has white space stripped and A-Z lower-cased; keys of at least min_chars code points in at least min_docs
    documents lose all their lines but those of the largest doc_id that has it. A null or empty text has one empty line.
    A null doc_id is the lowest; rows of one doc_id are one document, and all of them keep the line or lose it. Keys are
    compared by 128 bits of a cryptographic digest. An empty table gives no rows; only doc_id and text are read.
    """
    spark = common.prepare(df.sparkSession)
    lines, n = common.mapped(df.select(*common.row_key(df), common.text_of(df).cast("binary").alias("text")), _lines(min_chars), LINES, "lines")
    ranges = max(common.partitions(spark), n // RANGE_ROWS)
    order = ["h1", "h2", F.desc("id"), "mark"]
    dealt = lines.where("h1 is not null").repartitionByRange(ranges, *order).sortWithinPartitions(*order, "place")
    found, _ = common.mapped(dealt, _streamed(min_docs), FOUND, "streamed")
    # two summaries of a task at most, and one for each PENDING_ROWS undecided rows: a number of rows that is sent to all
    along = Window.partitionBy("h1", "h2").orderBy(F.desc("id"), F.desc("mark"))
    parts = found.where("docs > 0").select("h1", "h2", "id", "docs", (F.lag("mark").over(along) == F.col("id")).alias("again"))
    whole = parts.groupBy("h1", "h2").agg(F.max("id").alias("first"), (F.sum("docs") - F.count_if("again")).alias("all_docs")).where(F.col("all_docs") >= min_docs)
    settled = found.where("docs = -1").join(F.broadcast(whole), ["h1", "h2"]).where("id <> first")
    gone = found.where("docs = 0").select("id", "mark", "place").unionAll(settled.select("id", "mark", "place"))
    sizes = lines.where("h1 is null").select("id", "mark", F.col("place").alias("n_lines"), F.lit(None).cast("int").alias("place"))
    each = sizes.unionAll(gone.select("id", "mark", F.lit(None).cast("int"), "place")).groupBy("id", "mark").agg(F.max("n_lines").cast("long").alias("n_lines"), F.collect_set("place").alias("gone"))
    return each.mapInArrow(common.task(_bitmaps), "id long, mark long, n_lines long, n_dropped long, keep binary")


def kept_lines(keep: bytes, n: int) -> np.ndarray:
    """The bits of a bitmap of n lines."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n).astype(bool)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, text, n_lines, n_dropped, keep = (batch.column(k) for k in range(5))
        kept = []
        for t, n, d, bits in zip(text, n_lines.to_pylist(), n_dropped.to_pylist(), keep, strict=True):
            if d:
                t = "\n".join(line for line, stays in zip(t.as_py().split("\n"), kept_lines(bits.as_py(), n), strict=True) if stays)
            kept.append(t if isinstance(t, str) else t.as_py())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), n_lines, n_dropped], names=["doc_id", "text", "n_lines", "n_dropped"])


def kept_texts(df: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text (kept lines only), n_lines, n_dropped for each row of df, by the bitmaps of keep_bitmaps(df)."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(df).alias("text"), *common.row_key(df))
    joined = rows.join(bitmaps, ["id", "mark"]).select("doc_id", "text", "n_lines", "n_dropped", "keep")
    return joined.mapInArrow(common.task(_applied), "doc_id long, text string, n_lines long, n_dropped long")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = common.documents(spark, sf_dir)
    return kept_texts(df, keep_bitmaps(df)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, line, place, last IS NOT NULL AND last <> doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
