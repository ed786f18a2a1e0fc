"""What the training-data operators share: folders, columns and batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textforge.sources.tables import spread

#: Rows and bytes of one Arrow batch handed to Python.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 24


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that keep Arrow batches of long documents small and let local workers import this package.

    On a cluster the package is installed on the nodes or given by --py-files.
    """
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.inMemoryColumnarStorage.batchSize", str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent on a single machine, as in tests, a temporary folder is made and set; on a cluster that
    is an error, as each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


#: For each scratch() that is open, the folders and held tables made in it.
_SCRATCH: list[list[str | DataFrame]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """On leaving, deletes the tables that were made inside; what was written of them to a folder made before stays."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        hadoop = spark._jsparkSession.sessionState().newHadoopConf()
        for made in _SCRATCH.pop():
            if isinstance(made, DataFrame):
                made.unpersist()
                continue
            path = spark._jvm.org.apache.hadoop.fs.Path(made)
            path.getFileSystem(hadoop).delete(path, True)
        drop_shuffles(spark)


#: Rows of one file of a table whose number of rows is known before.
FILE_ROWS = 200_000


def saved(df: DataFrame, name: str, rows: int | None = None, folder: str | None = None) -> DataFrame:
    """df written as a Parquet table in the shared folder, or in the one given, and read back: lineage ends here. rows: about how many there are."""
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    return mapped(df, lambda batches: batches, df.schema, name, encoder=True, folder=folder)[0]


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, name: str, encoder: bool = False, folder: str | None = None) -> tuple[DataFrame, int]:
    """df.mapInArrow(run, schema) as a Parquet table in the shared folder, and its number of rows.

    The workers write the files themselves, so the rows need not pass the JVM. Each task writes under a name of its own
    and then moves the file, so a repeated attempt replaces it. Folders that only Spark can reach are written by Spark.
    """
    spark = df.sparkSession
    folder = folder or shared_dir(spark, name)
    try:
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        df.mapInArrow(task(run, encoder), schema).write.parquet(folder)
        out = spark.read.schema(schema).parquet(folder)
        return out, out.count()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        files, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        own, n, writer, held = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}", 0, None, []

        def flush() -> None:
            nonlocal writer
            if held:
                writer = writer or parquet.ParquetWriter(own, held[0].schema, filesystem=files, compression="zstd", compression_level=1, use_dictionary=False)
                writer.write_table(pa.Table.from_batches(held))
                held.clear()

        try:
            for batch in run(batches):
                n += batch.num_rows
                if batch.num_rows:
                    held.append(batch)
                if sum(b.nbytes for b in held) > GROUP_BYTES:
                    flush()
            flush()
            if writer is not None:
                writer.close()
                files.move(own, f"{root}/part-{part:06d}.parquet")
        except BaseException:
            with contextlib.suppress(OSError):
                files.delete_file(own)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = df.mapInArrow(task(write, encoder), "n long").agg(F.sum("n")).first()[0]
    return spark.read.schema(schema).parquet(folder), rows or 0


def held(df: DataFrame) -> DataFrame:
    """df kept on the executors' disks for the steps of one operator that read it more than once.

    What a lost executor held is computed anew from its inputs; spark.catalog.clearCache() frees all of it. Loops use
    saved() instead, as plans would grow with each turn.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    if _SCRATCH:
        _SCRATCH[-1].append(df)
    return df


#: Bytes that a worker gathers for one row group.
GROUP_BYTES = 1 << 23
#: Buckets of 32,768 bits of the filter that thinned() broadcasts: 1 MB.
FILTER_BUCKETS = 256


def thinned(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """df without most rows whose 64-bit digest `key` is not in few: a filter of fixed size before a join, which alone decides.

    Where few has very many rows the filter lets more through, so the join's result is the same at every size.
    """
    bits = lambda c: F.pmod(c, F.lit(FILTER_BUCKETS * 32768))
    place = bits(F.col(key)) + 1  # positions count from 1
    known = few.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    held = df.withColumns({"_bucket": F.bitmap_bucket_number(place), "_at": F.bitmap_bit_position(place).cast("int")}).join(F.broadcast(known), "_bucket")
    return held.where("getbit(cast(conv(hex(substring(_bits, _at div 8 + 1, 1)), 16, 10) as int), _at % 8) = 1").select(df.columns)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy() -> None:
    """Gives memory that a task no longer needs back to the system: Spark keeps several idle Python workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], encoder: bool = False):
    """run for mapInArrow, in a Python worker that Spark uses again: starts without the words that an encoder of an earlier step has learnt, unless it is one itself, and tidies up."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encoder:
            for module, name in (("textforge.llm.word_ids", "encoder"), ("textforge.llm.byte_bpe", "codec")):
                if module in sys.modules:
                    getattr(sys.modules[module], name).cache_clear()
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def text_of(df: DataFrame) -> Column:
    """The text column, null as empty."""
    return F.coalesce(df["text"], F.lit(""))


def row_key(df: DataFrame) -> list[Column]:
    """id and mark, which know a row by its doc_id and a 64-bit digest of its text: a doc_id can be null (the lowest id) or repeated."""
    own, text = df["doc_id"].cast("long"), text_of(df).cast("binary")
    return [F.coalesce(own, F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("mark")]


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def filesystem(path: str):
    """The pyarrow file system of a path or URI, and the path in it; works on any node of the cluster."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = os.path.abspath(path)
    elif path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)
