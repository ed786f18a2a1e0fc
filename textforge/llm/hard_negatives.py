"""Operator 11, hard negatives: for each anchor its best rows of the same label, and for each of these the best rows of other
labels whose score lies in a window below it.

Rows are dealt to blocks, and each block is a ball tree. A node's ball bounds every inner product in it from above and from
below, so a search skips nodes outside its window of scores, or strictly beneath the k-th best score found so far. The
anchors stream through each block's tree after its rows; the blocks' best are merged. Scores are whole numbers, so the result
is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from textforge.llm import common

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Most rows of a block, which is in memory as one tree; least rows, where there are few; rows of a leaf; searches that go
#: through a tree together.
BLOCK_ROWS, LEAST_ROWS, LEAF_ROWS, SEARCHES = 1 << 16, 1 << 11, 128, 512
LOWEST = -(2**63)
_NONE = np.iinfo(np.int64).min


class Tree:
    """A ball tree over rows of whole numbers: nodes are halves along the widest direction, down to LEAF_ROWS rows."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, np.ndarray, float, float]] = []
        self.children: list[tuple[int, int] | None] = []
        self._split(vectors, order, 0, len(order))
        self.vectors, self.ids, self.labels = vectors[order], ids[order], labels[order]
        self.most = float(np.abs(vectors).max(initial=0))

    def _split(self, vectors: np.ndarray, order: np.ndarray, start: int, end: int) -> int:
        own = vectors[order[start:end]]
        center = own.mean(axis=0) if len(own) else np.zeros(vectors.shape[1])
        away = own - center
        radius = float(np.sqrt((away * away).sum(axis=1).max(initial=0)))
        node = len(self.nodes)
        self.nodes.append((start, end, center, radius, float(np.sqrt(center @ center))))
        self.children.append(None)
        if end - start > LEAF_ROWS and radius > 0:  # equal rows need no parting: their bounds are exact
            far = away[np.argmax((away * away).sum(axis=1))]
            along = away @ far
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(along, middle)]
            self.children[node] = (self._split(vectors, order, start, start + middle), self._split(vectors, order, start + middle, end))
        return node

    def search(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, label: np.ndarray, own: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (n x k, best first, _NONE where fewer) of the rows with low <= score <= high.

        same: of the searching row's label and another id than its own; else of other labels.
        """
        n = len(q)
        scores, ids = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)
        size = np.sqrt((q * q).sum(axis=1))
        whole = self.most * float(np.abs(q).max(initial=0)) * q.shape[1]
        if whole >= 2.0**63:
            raise ValueError("scores do not fit 64 bits")
        exact = whole < 2.0**53
        q_whole, rows = (q, self.vectors) if exact else (q.astype(np.int64), self.vectors.astype(np.int64))

        def visit(node: int, active: np.ndarray) -> None:
            start, end, center, radius, length = self.nodes[node]
            middle, reach = q[active] @ center, size[active] * radius
            slack = 1e-9 * size[active] * (length + radius) + 1e-6
            top, bottom = middle + reach + slack, middle - reach - slack
            alive = (top >= low[active]) & (bottom <= high[active]) & (top >= scores[active, -1])
            if not alive.any():
                return
            if (below := self.children[node]) is not None:
                active, best = active[alive], float(middle[alive].sum())
                first = float((q[active] @ self.nodes[below[0]][2]).sum()) * 2 >= best * 2
                for child in below if first else below[::-1]:
                    visit(child, active)
                return
            for active in np.array_split(active[alive], 1 + alive.sum() * (end - start) // (1 << 20)):
                found = q_whole[active] @ rows[start:end].T
                found = found if found.dtype == np.int64 else found.astype(np.int64)
                fits = (found >= low[active, None]) & (found <= high[active, None]) & (found >= scores[active, -1:])
                fits &= (self.labels[start:end] == label[active, None]) == same
                if same:
                    fits &= self.ids[start:end] != own[active, None]
                some = fits.any(axis=1)
                if not some.any():
                    continue
                active, found, fits = active[some], found[some], fits[some]
                every = np.concatenate([scores[active], np.where(fits, found, _NONE)], axis=1)
                names = np.concatenate([ids[active], np.broadcast_to(self.ids[start:end], found.shape)], axis=1)
                names = np.where(every == _NONE, np.iinfo(np.int64).max, names)
                best = np.lexsort((names, np.where(every == _NONE, np.iinfo(np.int64).max, -every)), axis=1)[:, :k]
                scores[active], ids[active] = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1)

        if n and len(self.ids):
            visit(0, np.arange(n))
        return scores, ids


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of whole numbers; shorter vectors count as ending in zeros."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = np.floor(SCALE * column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64))
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _batches_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Runs of rows of one block and kind; a task has blocks one after another, each with its rows before its searches."""
    for batch in batches:
        block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
        for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(block)], strict=True):
            if end > start:
                yield int(block[start]), bool(kind[start]), batch.slice(start, end - start)


def _searched(negatives: bool, k: int, low: int, high: int):
    """For each search row its k best of this block. Positives: one search. Negatives: one for each positive's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, tree = None, [], None
        for b, is_search, batch in _batches_of_blocks(batches):
            if b != block:
                block, rows, tree = b, [], None
            if not is_search:
                rows.append(batch)
                continue
            if tree is None:
                if not rows:  # a block without rows
                    continue
                tree, rows = _grown(rows, k), []
            for at in range(0, batch.num_rows, SEARCHES):
                yield _found(tree, batch.slice(at, SEARCHES), negatives, k, low, high)

    return run


def _grown(batches: list[pa.RecordBatch], k: int) -> Tree:
    """The tree of a block's rows; of rows that are repeated as a whole, no more than k can be found."""
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, labels, copies = (table.column(c).to_numpy() for c in (2, 3, 5))
    each = np.repeat(np.arange(len(ids)), np.minimum(copies, k))
    return Tree(_matrix(table.column(4).chunk(0))[each], ids[each], labels[each])


def _found(tree: Tree, batch: pa.RecordBatch, negatives: bool, k: int, low: int, high: int) -> pa.RecordBatch:
    ids, labels, keys = (batch.column(c).to_numpy() for c in (2, 3, 5))
    q = _matrix(batch.column(4))
    width = max(q.shape[1], tree.vectors.shape[1])
    if tree.vectors.shape[1] < width:
        tree.vectors = _wide(tree.vectors, width)
        tree.nodes = [(s, e, _wide(c[None], width)[0], r, n) for s, e, c, r, n in tree.nodes]
    q = _wide(q, width)
    if negatives:
        offsets = batch.column(6).offsets.to_numpy()
        score = batch.column(6).values.to_numpy()[offsets[0] : offsets[-1]]
        owner = np.repeat(np.arange(len(ids)), np.diff(offsets))
        least, most = [-((-low * int(p)) // 100) for p in score], [high * int(p) // 100 for p in score]
        least, most = np.array(least, np.int64), np.array(most, np.int64)
        some = least <= most
        owner, score, least, most = owner[some], score[some], least[some], most[some]
    else:
        owner, score = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        least, most = np.full(len(ids), _NONE), np.full(len(ids), np.iinfo(np.int64).max)
    scores, names = tree.search(q[owner], least, most, labels[owner], ids[owner], not negatives, k)
    hit = scores != _NONE
    owner, score = np.broadcast_to(owner[:, None], hit.shape)[hit], np.broadcast_to(score[:, None], hit.shape)[hit]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[owner], keys[owner], score, names[hit], scores[hit])], names=["anchor", "key", "for_score", "found", "score"])


def _best(rows: DataFrame, anchors: DataFrame, blocks: int, k: int, negatives: bool, low: int = 0, high: int = 0) -> DataFrame:
    """anchor, key, for_score, found, score, place: the k best rows for each search of the anchors, over all blocks."""
    dealt = F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int")
    own = rows.select(dealt.alias("block"), F.lit(0).alias("kind"), "id", "label", "vector", F.col("copies").alias("key"), F.array().cast("array<long>").alias("scores"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "label", "vector", "key", "scores")
    both = own.unionAll(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    found = both.mapInArrow(common.task(_searched(negatives, k, low, high)), "anchor long, key long, for_score long, found long, score long")
    order = Window.partitionBy("anchor", "key", "for_score").orderBy(F.desc("score"), "found")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    df has vec_id, embedding, label; other columns are not read. Rows without label or vector, or with a component that
    is null or not finite, take no part. A component x becomes floor(256 * x); a vector that is shorter than another counts as
    ending in zeros. A score is the inner product with the anchor; ties go to the smaller vec_id. An anchor's positives are the
    first `positives` rows of its label with another vec_id; each gets the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. A null vec_id is the smallest. Repeated rows can each
    be found; an anchor that is repeated as a whole counts once. Scores beyond 64 bits are an error. An empty table
    gives no rows.

    Every anchor goes through every block's tree: the blocks have at most BLOCK_ROWS rows on average, so the anchors are copied
    once for each, and memory holds one tree and one batch of anchors.
    """
    spark = common.prepare(df.sparkSession)
    kind = df.schema["embedding"].dataType
    vector = F.col("embedding") if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col("embedding").cast("array<double>")
    rows = df.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(LOWEST)).alias("id"), F.col("label").cast("long").alias("label"), vector.alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = common.held(rows.groupBy("id", "label", "vector", "asks").agg(F.count("*").alias("copies")))
    n = rows.count()
    blocks = max(min(max(1, n // LEAST_ROWS), common.partitions(spark)), 1 + n // BLOCK_ROWS)
    anchors = rows.where("asks").withColumn("key", F.xxhash64("label", "vector")).dropDuplicates(["id", "key"])
    good = common.held(_best(rows.drop("asks"), anchors.withColumn("scores", F.array().cast("array<long>")), blocks, positives, False))
    scores = good.groupBy(F.col("anchor").alias("id"), "key").agg(F.collect_set("score").alias("scores"))
    bad = _best(rows.drop("asks"), anchors.join(scores, ["id", "key"]), blocks, negatives, True, low, high)
    pairs = good.select("anchor", "key", F.col("score").alias("for_score"), F.col("found").alias("positive"), F.col("place").alias("positive_rank")).join(bad, ["anchor", "key", "for_score"])
    given = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return pairs.select(
        given("anchor").alias("anchor_id"), given("positive").alias("positive_id"), "positive_rank", F.col("place").alias("rank"), given("found").alias("negative_id"),
        F.col("for_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    df = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(df, F.col("vec_id") % 50 == 0).drop("positive_rank")


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3
"""
