"""The training-data pipeline: stages on documents; each writes what it keeps as Parquet, which the next reads.

Each stage function takes (spark, docs, sf_dir). All but the last return the columns of documents; n_chars follows
the text. Null texts count as empty; an empty table passes through.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm import common, jaccard_join, packing, pii, suffix_dedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Bytes of Parquet in one partition of what a stage returns: a small corpus is not a heap of tiny files.
PARTITION_BYTES = 8 << 20


def written(function):
    """A stage of several steps: its result is written as a table, and the tables that it made on the way are deleted."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        folder = common.shared_dir(spark, function.__name__)
        with common.scratch(spark):
            table = common.saved(function(spark, common.spread(docs), sf_dir), function.__name__, folder=folder)
        size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return table.coalesce(1 + size // PARTITION_BYTES)

    run.writes = True
    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below the toxicity limit."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs.select(COLUMNS), model)


@written
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with five-word shingle similarity 0.8 or more, the one with the least doc_id.

    A null doc_id is the lowest; among rows of one doc_id the least digest decides. Documents without words are in no
    group and stay. Rows of equal doc_id and text stay once, other rows of a repeated or null doc_id are documents of
    their own.
    """
    found = jaccard_join.jaccard_components(docs, words=5, percent=80, keyed=True)
    one = found.where("n_shingles > 0").groupBy("part").agg(F.min(F.struct("id", "mark")).alias("one")).select("one.*")
    kept = one.unionAll(found.where("n_shingles = 0").select("id", "mark"))
    own = docs.select(*COLUMNS, *common.row_key(docs)).join(kept, ["id", "mark"], "left_semi")
    return own.dropDuplicates(["id", "mark"]).select(COLUMNS)


@written
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 200 bytes that the corpus repeats; those with nothing left go.

    Where a cut parts a character, its bytes left over are dropped. Null and empty texts stay.
    """
    given = docs.select(*COLUMNS, F.col("text").isNull().alias("no_text"))
    cut = suffix_dedup.remove_repeats(given, payload="text", carry=("lang", "source", "no_text"))
    text = F.when(~F.col("no_text"), F.col("kept").cast("string"))
    left = cut.withColumn("text", text).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal values replaced by pseudonyms of the same format."""
    docs = pii.pseudonymise_documents(docs.select(COLUMNS), pii.key_of(spark, demo=True))
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 ids."""
    return packing.pack_documents(common.spread(docs), payload="crc32").drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("pii", pseudonymise),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, function in STAGES:
        docs = function(spark, docs, sf_dir)
        if not getattr(function, "writes", False):
            docs = common.saved(docs, name)
    return docs


#: A trained score, a key and library ids are not SQL's; tests/llm hold the stages against brute force.
ORACLE_SQL = None
