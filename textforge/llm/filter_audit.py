"""Operator 12, filter interaction audit: what each filter removes in each order, from the survivors of all subsets of filters.

A document is a row of failure flags. CUBE over the flags and the part counts every combination; a grouping set whose
selected flags are all false holds what those filters together let through. A step of an order is a pair of subsets,
before and after its filter, so 32 subsets answer all 120 orders.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm import common

WHITE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 2
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWEST = -(2**63)


def failure_flags(df: DataFrame) -> DataFrame:
    """One row for each row of df: doc_id, part (source, null as empty), A, B, C, D, E. Only doc_id, text and source are read.

    A null text is empty: no words, so A fails and B, C, D pass. E compares whole texts by a 256-bit digest; a null
    doc_id is the lowest one, and rows of one doc_id are no copies of each other.
    """
    text, blank = common.text_of(df), F.lit(" \t\n\x0b\f\r")
    rows = df.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.btrim(text, blank).alias("bare"),
    )
    rows = rows.select("doc_id", "part", "text", F.when(F.col("bare") != "", F.split("bare", WHITE)).otherwise(F.array().cast("array<string>")).alias("words"))
    upper = F.length("text") - F.length(F.translate("text", UPPER, ""))
    flags = rows.select(
        "doc_id", "part", F.coalesce("doc_id", F.lit(LOWEST)).alias("id"), F.unhex(F.sha2("text", 256)).alias("digest"),
        (F.size("words") < MIN_WORDS).alias("A"), (100 * F.size(F.array_distinct("words")) < DISTINCT_PERCENT * F.size("words")).alias("B"),
        (100 * upper > UPPER_PERCENT * F.length("text")).alias("C"), F.col("text").rlike(SYMBOLS).alias("D"),
    )
    flags = common.held(flags)  # without texts; read for the first ids and for the rows
    first = flags.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    joined = flags.join(first, "digest", "left")
    return joined.select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("E"))


def labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """flags with good and toxic: whether any label of the doc_id has quality 1, toxic 1. Without a label, or a doc_id, neither."""
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    given = flags.join(told, "doc_id", "left")
    return given.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def subset_survivors(flags: DataFrame, names: Sequence[str], marks: Sequence[str] = ()) -> DataFrame:
    """part, subset (bit i: names[i] is applied), n and a count for each of marks: the rows that every filter of the subset lets through.

    Rows are counted by part and flags before the CUBE, which therefore sees at most 2 ** len(names) rows for each part.
    A subset that lets nothing through has zeros.
    """
    counts = ["n", *marks]
    cells = flags.groupBy("part", *names).agg(F.count("*").alias("n"), *[F.count_if(m).alias(m) for m in marks])
    cube = cells.cube(*names, "part").agg(
        *[F.sum(c).alias(c) for c in counts], *[F.grouping(c).alias(f"_{i}") for i, c in enumerate(names)], F.grouping("part").alias("_part")
    )
    clear = [~F.coalesce(F.col(c), F.lit(False)) for c in names]  # a flag that is not selected is null
    subset = sum((F.when(F.col(f"_{i}") == 0, 1 << i).otherwise(0) for i in range(len(names))), F.lit(0))
    found = cube.where("_part = 0")
    for c in clear:
        found = found.where(c)
    found = found.select("part", subset.cast("int").alias("subset"), *counts)
    every = found.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def audit(flags: DataFrame, names: Sequence[str], marks: Sequence[str] = ()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, lost_<mark> for each of marks, shapley.

    One row for each part, order of names and step. shapley is a whole number: the filter's removed rows summed over all
    orders. An empty table gives no rows. The orders are a table of len(names)! * len(names) rows, 600 for five filters.
    """
    spark, size = flags.sparkSession, len(names)
    bit = {c: 1 << i for i, c in enumerate(names)}
    full = (1 << size) - 1
    subsets = common.held(subset_survivors(flags, names, marks))
    before = subsets.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in ("n", *marks)])
    after = subsets.withColumnRenamed("subset", "after")
    # a pair of subsets for each filter and each subset without it
    choices = F.array(*[F.struct(F.lit(c).alias("filter"), F.lit(b).alias("bit")) for c, b in bit.items()])
    pairs = before.select("*", F.inline(F.filter(choices, lambda x: F.col("before").bitwiseAND(x["bit"]) == 0)))
    pairs = pairs.withColumn("after", F.col("before").bitwiseOR(F.col("bit"))).join(after, ["part", "after"])
    pairs = pairs.select(
        "part", "filter", "bit", "before", F.col("n").alias("kept"), (F.col("n_before") - F.col("n")).alias("removed"), *[(F.col(f"{m}_before") - F.col(m)).alias(f"lost_{m}") for m in marks]
    )
    orders_with = F.element_at(F.array(*[F.lit(factorial(k) * factorial(size - 1 - k)) for k in range(size)]), F.bit_count("before") + 1)
    alone = pairs.groupBy("part", "filter").agg(
        F.sum(orders_with * F.col("removed")).alias("shapley"), F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("before") == full - F.col("bit"), F.col("removed"))).alias("unique_fails"),
    )
    steps = [("".join(order), k + 1, c, sum(bit[x] for x in order[:k])) for order in permutations(names) for k, c in enumerate(order)]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, before int"))
    return pairs.join(alone, ["part", "filter"]).join(steps, ["filter", "before"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *[f"lost_{m}" for m in marks], "shapley"
    )


FILTERS = ("A", "B", "C", "D", "E")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    flags = labelled(failure_flags(common.documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audit(flags, FILTERS, ("good", "toxic")).withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


_ORDERS = ", ".join("('" + "".join(p) + "')" for p in permutations(FILTERS))
#: Each order is applied to each document, without subsets.
OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
    [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t),
     regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails
  FROM d LEFT JOIN labels USING (doc_id)),
o(filter_order) AS (VALUES {_ORDERS}),
r AS (SELECT part, good, bad, fails, filter_order, list_transform(range(1, 6), lambda k: fails[ascii(filter_order[k]) - 64]) AS run FROM f, o),
w AS (SELECT part, good, bad, fails, filter_order, coalesce(list_position(run, true), 6) AS gone, unnest(range(1, 6)) AS step FROM r),
c AS (
  SELECT part, filter_order, step, ascii(filter_order[step]) - 64 AS own, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
    count(*) FILTER (gone < step AND fails[ascii(filter_order[step]) - 64]) AS redundant,
    count(*) FILTER (fails[ascii(filter_order[step]) - 64] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND bad) AS toxic_lost
  FROM w GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM c
"""
