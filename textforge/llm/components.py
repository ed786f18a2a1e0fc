"""Connected components of a large set of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.llm import common


def connected_components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of links (a, b), root the least node of its component. rows: about how many links there are.

    Each round is written to the shared folder, so a lost executor costs one round; minima are taken per task
    before the shuffle, and Spark splits the partition of a node with very many links.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = common.saved(links.where("a <> b").select(a, b).distinct(), "links", rows)
    mark = _mark(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        # node a keeps its own least neighbour as well, so that nothing comes apart
        own = low.where("a > low").select("a", F.col("low").alias("b"))
        edges = common.saved(large.unionAll(own).distinct(), "large-star", mark[0])
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        small = edges.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = common.saved(small.unionAll(low.select("a", F.col("low").alias("b"))).distinct(), "small-star", mark[0])
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
