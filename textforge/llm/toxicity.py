"""Operator 9, toxicity: non-negative positive-unlabelled learning.

Known toxic texts are the positives; a sample of all texts, whatever their labels, is the unlabelled set.
With the class prior pi the risk is pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)): the
second term estimates the risk on clean texts and is kept from going below zero, where a flexible model
would otherwise fit the unlabelled set. Linear models over the words that set the positives apart are
trained in numpy and their scores averaged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm import common

#: Bounds of what is learnt from: rows of either set, words of the model, and how many standard errors a word's share must differ.
SAMPLE, FEATURES, LEAST_Z = 6000, 512, 4.5
LIMIT, MODELS, EPOCHS = 0.7, 3, 400
#: Letters to lower case; what is neither an ASCII letter nor part of a longer UTF-8 character to a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(_LETTERS).split())


class Rows:
    """Word numbers of rows, as a sparse 0/1 matrix."""

    def __init__(self, rows: list[list[int]], features: int):
        self.n, self.features = len(rows), features
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.column = np.array([c for r in rows for c in r], dtype=np.int64)

    def score(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.column], minlength=self.n) + weights[-1]

    def gradient(self, per_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.column, weights=per_row[self.row], minlength=self.features), per_row.sum()) / max(1, self.n)


def nnpu(positive: Rows, unlabelled: Rows, prior: float, seed: int, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 2e-5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model by the non-negative risk estimator and Adam."""
    rng = np.random.default_rng(seed)
    weights = np.append(rng.normal(0, 0.01, positive.features), np.log(prior / (1 - prior)))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for turn in range(1, epochs + 1):
        zp, zu = positive.score(weights), unlabelled.score(weights)
        sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_clean = unlabelled.gradient(su) - prior * positive.gradient(sp)
        # below zero, a step back from the fitted unlabelled set
        gradient = prior * positive.gradient(sp - 1) + as_clean if clean >= 0 else -as_clean
        gradient[:-1] += decay * weights[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        weights -= rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    return weights


class ToxicityModel:
    """Words, their weights in each model, and the score of a text."""

    def __init__(self, words: list[bytes], weights: np.ndarray):
        self.place, self.weights = {w: i for i, w in enumerate(words)}, weights

    def score(self, text: bytes | None) -> float:
        found = [self.place[w] for w in words_of(text) & self.place.keys()]
        z = self.weights[:, found].sum(axis=1) + self.weights[:, -1]
        likely = float((1 / (1 + np.exp(-np.clip(z, -30, 30)))).mean())
        # the models' boundary is at one half, the limit's at LIMIT: the odds are scaled so that they meet
        odds = likely / (1 - likely) * LIMIT / (1 - LIMIT)
        return odds / (1 + odds)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted(words_of(x.as_py())) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.binary()))], names=["positive", "words"])


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> ToxicityModel:
    """Learns from about `sample` toxic rows and `sample` rows of any kind, all with crc32(doc_id) mod 3 not 1.

    A hash of doc_id picks them, so the numbers are met up to chance. Without positives every text scores a low prior.
    """
    common.prepare(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(df).cast("binary").alias("text")).where(~held_out())
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out())
    n, toxic = marks.agg(F.count("toxic"), F.sum("toxic")).first()
    prior = min(max((toxic or 0) / max(1, n), 0.001), 0.5)
    # a hash of doc_id picks the rows: the ids of the positives are a bounded, broadcast set
    known = _some(marks.where("toxic = 1").select("doc_id").distinct(), toxic or 0, sample)
    chosen = rows.join(F.broadcast(known), "doc_id", "left_semi").select(F.lit(1).alias("positive"), "text")
    any_text = _some(rows, rows.select("doc_id").count(), sample).select(F.lit(0).alias("positive"), "text")
    table, _ = common.mapped(chosen.unionAll(any_text), _words, "positive int, words array<binary>", "toxic-words")
    n_u, n_p = table.agg(F.count("*") - F.sum("positive"), F.sum("positive")).first()
    if not n_p or not n_u:
        return ToxicityModel([], np.array([[np.log(prior / (1 - prior))]]))
    counts = table.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.sum("positive").alias("p"), F.count("*").alias("all"))
    share_p, share_u = F.col("p") / n_p, (F.col("all") - F.col("p")) / n_u
    pooled = F.col("all") / (n_p + n_u)
    z = (share_p - share_u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-9)
    words = [bytes(r[0]) for r in counts.where("all >= 5").select("word", F.abs(z).alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(features).collect()]
    place = {w: i for i, w in enumerate(words)}
    wanted = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<binary>")
    held = table.select("positive", F.array_intersect("words", wanted).alias("words")).collect()  # about 2 * sample rows of at most `features` words
    sets = [Rows([[place[bytes(w)] for w in r[1]] for r in held if r[0] == k], len(words)) for k in (1, 0)]
    return ToxicityModel(words, np.stack([nnpu(*sets, prior, seed) for seed in range(MODELS)]))


def _some(rows: DataFrame, n: int, sample: int) -> DataFrame:
    """About `sample` of n rows by a hash of doc_id; all of them if there are no more."""
    return rows if n <= sample else rows.where(F.xxhash64(F.lit(9), "doc_id") < int(-(2**63) + sample / n * 2**64))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(df: DataFrame, model: ToxicityModel, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of df; null and empty texts score by the bias alone.

    Repeated rows score alike, a null doc_id is not held out, an empty table gives no rows. Only doc_id and
    text are read, so other columns may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(x.as_py()) for x in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    common.prepare(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(df).cast("binary").alias("text"))
    return rows.mapInArrow(common.task(run), "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted")
    )


def keep_clean(df: DataFrame, model: ToxicityModel, limit: float = LIMIT) -> DataFrame:
    """df without the rows whose text scores limit or more; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            scores = [model.score((x.as_py() or "").encode()) for x in texts]
            yield batch.filter(pa.array([s < limit for s in scores], pa.bool_()))

    common.prepare(df.sparkSession)
    return df.mapInArrow(common.task(run), df.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
