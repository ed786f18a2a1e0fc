"""Operator 5, token-id output: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file holds, in this order:

* data frames: zstandard frames of at most FRAME_IDS ids (more if one document is longer), little-endian
  unsigned 32-bit; a document lies in one frame;
* an index in a skippable frame: for each document its id, its number of ids and its data frame;
* the seek table of the public seekable format, again a skippable frame: compressed size, decompressed
  size and the low 32 bits of xxh64 of the content for each data frame, then the footer.

Any zstandard reader can decompress the whole; read_documents() fetches only the frames it needs.
"""

from __future__ import annotations

import contextlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm import common
from textforge.llm.word_ids import encoder, vocabulary

FRAME_IDS = 1 << 16
END_ID = 1
#: Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_INDEX = np.dtype([("doc_id", "<i8"), ("present", "u1"), ("n_tokens", "<u4"), ("frame", "<u4")])


class FrameWriter:
    """Writes documents in the order given to a binary file object."""

    def __init__(self, out, level: int = 3):
        self.out, self.compressor = out, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.held: list[bytes] = []
        self.n_held = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if self.held and self.n_held + n > FRAME_IDS:
            self._flush()
        self.index.append((doc_id or 0, doc_id is not None, n, len(self.frames)))
        self.held.append(ids)
        self.n_held += n
        self.n_tokens += n

    def _flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        index = self.compressor.compress(np.array(self.index, dtype=_INDEX).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Reads a file of FrameWriter from any seekable binary file object."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2)
        source.seek(end - 9)
        n, flag, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        seek_at = end - 9 - 12 * n - 8
        source.seek(seek_at + 8)
        self.frames = list(struct.iter_unpack("<III", source.read(12 * n)))
        self.offsets = [0]
        for size, _, _ in self.frames:
            self.offsets.append(self.offsets[-1] + size)
        source.seek(self.offsets[-1])
        _, size = struct.unpack("<II", source.read(8))
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(source.read(size)) if size else b"", dtype=_INDEX)

    def frame(self, k: int) -> bytes:
        size, raw_size, checksum = self.frames[k]
        self.source.seek(self.offsets[k])
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(size), max_output_size=raw_size) if raw_size else b""
        if len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged: its checksum differs")
        return raw

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) in file order; with `wanted`, only frames that hold those documents are decompressed."""
        keep = np.ones(len(self.index), bool) if wanted is None else np.isin(self.index["doc_id"], list(wanted)) & (self.index["present"] == 1)
        frames = self.index["frame"]  # ascending
        for k in np.unique(frames[keep]):
            raw, at = self.frame(int(k)), 0
            for row in range(*np.searchsorted(frames, (k, k + 1))):
                size = 4 * int(self.index["n_tokens"][row])
                if keep[row]:
                    yield (int(self.index["doc_id"][row]) if self.index["present"][row] else None), raw[at : at + size]
                at += size


def _writer(folder: str, vocab: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, root = common.filesystem(folder)
        files.create_dir(root, recursive=True)
        own, final = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}", f"{root}/part-{part:06d}.ids.zst"
        encode_all, end = encoder(vocab).encode_all, struct.pack("<I", END_ID)
        try:
            with files.open_output_stream(own) as out:
                frames = FrameWriter(out)
                for batch in batches:
                    for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(x.as_py() for x in batch.column(1)), strict=True):
                        frames.add(doc_id, ids + end)
                frames.close()
            files.move(own, final)  # a repeated attempt replaces the same file with the same content
        except BaseException:
            with contextlib.suppress(OSError):
                files.delete_file(own)
            raise
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([final.rpartition("/")[2]]), pa.array([len(frames.index)], pa.int64()), pa.array([frames.n_tokens], pa.int64())],
            names=["part", "file", "n_docs", "n_tokens"],
        )

    return write


def write_tokens(df: DataFrame, folder: str, vocab: str | None = None) -> list[tuple[int, str, int, int]]:
    """Writes the ids of all of df's texts to folder in ascending doc_id order, one file for each range of ids.

    Returns (part, file, n_docs, n_tokens) of each file. Null doc_ids come first, rows that repeat a doc_id
    are ordered by text, null and empty texts are just the end id. An empty table gives files without rows.
    """
    spark = common.prepare(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(df).alias("text"))
    ranged = rows.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return sorted(map(tuple, ranged.mapInArrow(common.task(_writer(folder, vocab or vocabulary()), encoder=True), "part int, file string, n_docs long, n_tokens long").collect()))


def read_tokens(spark: SparkSession, folder: str, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document in the files."""
    starts, at = [], 0
    for part, name, n_docs, n_tokens in files:
        if n_docs:
            starts.append((part, name, at))
        at += n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, root = common.filesystem(folder)
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    start, held, size = row["start"], [], 0
                    for doc_id, ids in FrameReader(source).documents():
                        held.append((doc_id, start, len(ids) // 4, ids))
                        start += len(ids) // 4
                        size += len(ids)
                        if size > 1 << 22:
                            yield _rows(held)
                            held, size = [], 0
                    if held:
                        yield _rows(held)

    listed = spark.createDataFrame(starts, "part int, file string, start long").repartition(max(1, len(starts)))
    return listed.mapInArrow(common.task(read), "doc_id long, start long, n_tokens long, ids binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark, "token-files")
    files = write_tokens(common.documents(spark, sf_dir), folder)
    return read_tokens(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
