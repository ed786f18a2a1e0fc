"""Operator 1, sharding: Karmarkar-Karp differencing over indivisible groups of equal texts.

A group is a text with all its copies. Large groups go into the differencing one by one; the others
are first summed into GRAINS hash grains, so the driver handles at most 2 * GRAINS sizes however
large the corpus is. Differencing keeps partial partitions (one sum for each shard), takes the two
with the largest spread and adds them in opposite order until one partition is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textforge.llm import common

#: Sums that the driver differences: grains of small groups, and as many groups above a grain's mean.
GRAINS = 16384


def differencing(sizes: Sequence[int], shards: int) -> list[int]:
    """The shard of each size by the largest differencing method. Ties go by position."""
    if not sizes:
        return []
    heap: list[tuple] = []
    for i, size in enumerate(sizes):
        # sums ascending, and for each sum the tree of the items in it
        heap.append((-size, i, (0,) * (shards - 1) + (size,), (None,) * (shards - 1) + (i,)))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, sums_a, trees_a = heapq.heappop(heap)
        _, _, sums_b, trees_b = heapq.heappop(heap)
        merged = sorted(((a + b, k) for k, (a, b) in enumerate(zip(sums_a, reversed(sums_b), strict=True))))
        low = merged[0][0]  # only differences matter for what follows
        sums = tuple(s - low for s, _ in merged)
        trees = tuple(_joined(trees_a[k], trees_b[shards - 1 - k]) for _, k in merged)
        heapq.heappush(heap, (-sums[-1], serial, sums, trees))
        serial += 1
    where = [0] * len(sizes)
    for shard, tree in enumerate(heap[0][3]):
        stack = [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(node)
            elif node is not None:
                where[node] = shard
    return where


def _joined(a, b):
    return a if b is None else b if a is None else (a, b)


def shard_documents(df: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for every row of df.

    Size is the text's UTF-8 bytes plus 1. Equal texts share a shard, so a group larger than a mean
    shard makes its shard as large as itself and the others share the rest. Null and empty texts are one
    group (size 1 each, crc32 0). Repeated rows each get a slot of their own; a null doc_id is kept. An
    empty table gives no rows. Only doc_id and text are read, so other columns may have any name.
    """
    spark = common.prepare(df.sparkSession)
    text = common.text_of(df)
    slim = common.held(
        df.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit("second"), text).alias("g2"),
        )
    )
    groups = slim.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"))
    total = slim.agg(F.sum("size")).first()[0] or 0
    mean = max(1, -(-total // GRAINS))
    parts = (
        groups.select(
            F.when(F.col("bytes") > mean, F.col("g1")).alias("g1"),
            F.when(F.col("bytes") > mean, F.col("g2")).alias("g2"),
            F.when(F.col("bytes") <= mean, F.pmod(F.col("g1"), F.lit(GRAINS))).alias("grain"),
            "bytes",
        )
        .groupBy("g1", "g2", "grain")
        .agg(F.sum("bytes").alias("bytes"))
    )
    items = sorted(map(tuple, parts.collect()), key=lambda x: (-x[3], x[0] or 0, x[1] or 0, x[2] or 0))
    where = differencing([x[3] for x in items], shards)
    grains = spark.createDataFrame([(x[2], s) for x, s in zip(items, where, strict=True) if x[2] is not None], "grain long, grain_shard int")
    large = spark.createDataFrame([(x[0], x[1], s) for x, s in zip(items, where, strict=True) if x[2] is None], "g1 long, g2 long, large_shard int")
    placed = (
        slim.join(F.broadcast(large), ["g1", "g2"], "left")
        .withColumn("grain", F.pmod(F.col("g1"), F.lit(GRAINS)))
        .join(F.broadcast(grains), "grain", "left")
        .select(
            "doc_id", "size", "text_crc32", F.coalesce("large_shard", "grain_shard").alias("shard"),
            F.pmod(F.xxhash64("doc_id", "g1"), F.lit(4 * common.partitions(spark))).alias("strip"),
        )
    )
    # Slots: the rows of a shard are numbered strip by strip, so no task holds a whole shard.
    strips = placed.groupBy("shard", "strip").count()
    before = strips.select(
        "shard", "strip", (F.sum("count").over(Window.partitionBy("shard").orderBy("strip")) - F.col("count")).alias("before")
    )
    own = Window.partitionBy("shard", "strip").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("own", F.row_number().over(own))
        .join(before, ["shard", "strip"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.documents(spark, sf_dir), shards=16)
