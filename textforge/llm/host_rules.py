"""Operator 10, quality rules: rule failures of documents, shrunk failure rates of hosts, verdicts joined back.

A host's rate is shrunk to the mean of all hosts by a beta prior that is fitted to the hosts' own rates by
the method of moments, so a host with few documents is not condemned by one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm import common

WHITE, SYMBOLS, WINDOW = b" \t\n\v\f\r", b"#*$%&|<>", 8
MIN_WORDS, REPEAT_PERCENT, HOST_LIMIT = 20, 30, 0.5
_POWERS = np.random.default_rng(20).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words which occurs twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))
    if len(number) == len(words):
        return 0
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        sums += ids[k : k + n] * _POWERS[k]
    order = np.argsort(sums, kind="stable")
    same = sums[order][1:] == sums[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, WHITE).decode("utf-8", "replace"))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x.as_py() or b"") for x in batch.column(2)]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


#: Hosts whose verdicts are sent to every task: a few MB.
BROADCAST_HOSTS = 50_000


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Prior successes and failures from the mean and variance of the hosts' rates. Without variance the prior is strong."""
    mean, variance = hosts.select((F.col("failed") / F.col("docs")).alias("rate")).agg(F.avg("rate"), F.var_pop("rate")).first()
    mean = 0.0 if mean is None else mean
    strength = mean * (1 - mean) / variance - 1 if variance else 1e6
    strength = min(max(strength, 1.0), 1e6)
    return mean * strength, (1 - mean) * strength


def host_rules(df: DataFrame, host_column: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each row of df: doc_id, the counts, base_failed, host, host_rate (shrunk), kept.

    A host is the part of host_column after any scheme and before a path, in lower case; null and empty
    form one host. A null text has no words and fails. Repeated rows are counted each. An empty table gives
    no rows. Only doc_id, text and host_column are read, so other columns may have any name.
    """
    spark = common.prepare(df.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(host_column).cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), common.text_of(df).cast("binary").alias("text"))
    schema = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    measured, count = common.mapped(rows, _measured, schema, "measured")
    measured = measured.withColumn("base_failed", failed)
    hosts = measured.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = common.saved(hosts, "hosts", count // 100)
    a, b = beta_prior(hosts)
    verdicts = hosts.select("host", ((F.col("failed") + a) / (F.col("docs") + (a + b))).alias("host_rate"))
    if hosts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)  # else Spark splits the partitions of hosts with very many rows
    return measured.join(verdicts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host", "host_rate",
        (~F.col("base_failed") & (F.col("host_rate") <= host_limit)).alias("kept"),
    )


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(common.documents(spark, sf_dir)).drop("host", "host_rate")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, lower(regexp_extract(coalesce(source, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)', 1)) AS host,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT d.doc_id, host, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
h AS (SELECT host, count(*) AS docs, count(*) FILTER (base_failed) AS failed FROM f GROUP BY host),
s AS (SELECT avg(failed / docs) AS mu, var_pop(failed / docs) AS v FROM h),
p AS (SELECT mu, least(greatest(CASE WHEN v > 0 THEN mu * (1 - mu) / v - 1 ELSE 1e6 END, 1), 1e6) AS k FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND (failed + mu * k) / (docs + k) <= 0.5) AS kept
FROM f JOIN h USING (host), p
"""
