"""Operator 8, byte-level BPE encoding and decoding as a tree reduction.

Encoded pieces of text form a monoid: the encoding of a concatenation follows from the encodings of its two
halves by re-encoding only a window around the seam. The window grows on both sides until it is proven that
nothing outside changes; decoding is plain concatenation up the same tree. A whole text is reduced by halves: down to
LEAVES chunks the halves meet where every match of the pattern ends, so that their seam is stable without a window;
a match longer than LEAF bytes is halved inside and its halves are joined by windows.

Proof used at a seam. BPE merges the adjacent pair of lowest rank, leftmost first. A window that starts and
ends at token boundaries of the halves is re-encoded on its own. Its new tokens are accepted when the outermost
token on either side came out unchanged and the pair of the token outside and that token is stable: encoding
the bytes of the two together gives just those two tokens. For greedy BPE a token sequence is the encoding of
its bytes if and only if each adjacent pair of its tokens is the encoding of the pair's bytes, so with every
inner pair stable (each side is an encoding) and both seams of the window stable, the whole is the encoding.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm import common

#: Bytes up to which a piece is merged directly, and chunks up to which a text is not halved.
LEAF, LEAVES = 64, 1024
#: Pairs of tokens that a worker remembers, and bytes of chunks and of pieces in a generation of two, with ENTRY besides for each.
KNOWN, HELD, ENTRY = 400_000, 160 << 20, 200


def ranks_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splitter() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.stable: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.pieces: dict[str, list[int]] = {}
        self.older: tuple[dict, dict] = ({}, {})
        self.held = 0

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a short piece by greedy merging."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = ranks.get
        pair = [get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while pair:
            low = min(pair)
            if low == 1 << 30:
                break
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern, however long: halves first, then their join."""
        if len(piece) <= LEAF or piece in self.ranks:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def is_stable(self, a: int, b: int) -> bool:
        if (known := self.stable.get((a, b))) is None:
            if len(self.stable) > KNOWN:
                self.stable = {}
            known = self.stable[a, b] = self.merge_all(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def merge_all(self, piece: bytes) -> list[int]:
        return self.merge(piece)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of two encoded texts."""
        if not left or not right:
            return left + right
        if self.is_stable(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self._window(left[len(left) - a :], right[:b])
            ok_left = a == len(left) or self.is_stable(left[len(left) - a - 1], window[0])
            ok_right = b == len(right) or self.is_stable(window[-1], right[b])
            if ok_left and ok_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = a if ok_left else 2 * a, b if ok_right else 2 * b

    def _window(self, left: list[int], right: list[int]) -> list[int]:
        return self.merge_all(b"".join([self.bytes_of[t] for t in left + right]))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.find(text):
            if (ids := self.pieces.get(m)) is None:
                if (ids := self.older[1].get(m)) is None:
                    ids = self.encode_piece(m.encode())
                self.pieces[m] = ids
                self.held += len(m) + 8 * len(ids) + ENTRY
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree."""
        if len(ids) <= LEAF:
            return b"".join([self.bytes_of[t] for t in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def encode_text(self, text: str) -> tuple[list[bytes], list[bytes]]:
        """The ids of a whole text as decimal strings that each end in a comma, and their bytes, chunk by chunk.

        A chunk ends before a single space between other characters: every match starts there anew, since only
        the first optional space of a match may be one. So chunks are looked up as a whole.
        """
        chunks = text.split(" ")
        if not all(chunks) or _GAPS(text):
            chunks = _SEAM(text)
        chunks[1:] = [" " + c for c in chunks[1:]]
        return self._reduced(chunks)

    def _reduced(self, chunks: list[str]) -> tuple[list[bytes], list[bytes]]:
        if len(chunks) > LEAVES:
            half = len(chunks) // 2
            left, right = self._reduced(chunks[:half]), self._reduced(chunks[half:])
            return left[0] + right[0], left[1] + right[1]
        known = self.known
        try:
            found = [known[c] for c in chunks]
        except KeyError:
            get = known.get
            found = [get(c) or self._learn(c) for c in chunks]
            if self.held > HELD:
                self.older, self.known, self.pieces, self.held = (self.known, self.pieces), {}, {}, 0
        return [x[0] for x in found], [x[1] for x in found]

    def _learn(self, chunk: str) -> tuple[bytes, bytes]:
        """The entry of a chunk that this generation has not met."""
        if (x := self.known.get(chunk)) is None:
            if (x := self.older[0].get(chunk)) is None:
                ids = self.encode(chunk)
                x = b"".join(b"%d," % t for t in ids), self.decode(ids)
            self.known[chunk] = x
            self.held += len(chunk) + len(x[0]) + len(x[1]) + ENTRY
        return x


_GAPS = regex.compile(r" \s|\s ").search
_SEAM = regex.compile(r"(?<=\S) (?=\S)").split


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each Python worker."""
    return ByteBpe(path, pattern)


def _rows(path: str, pattern: str, payload: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            rows = [_row(bpe, doc_id, text.as_py() or "", payload) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()), strict=True)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"],
                )

    return run


def _row(bpe: ByteBpe, doc_id: int | None, text: str, payload: str) -> tuple:
    ids, decoded = bpe.encode_text(text)
    written, raw = b"".join(ids)[:-1], b"".join(decoded)
    n = written.count(b",") + 1 if written else 0
    kept = (list(map(int, written.split(b","))) if written else [], raw) if payload == "ids" else (None, None)
    return (doc_id, n, hashlib.sha256(written).hexdigest(), hashlib.sha256(raw).hexdigest(), *kept)


def encode_documents(df: DataFrame, path: str | None = None, pattern: str | None = None, payload: str = "ids") -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes they decode to, and with payload 'ids' both themselves.

    Null and empty texts have no tokens. Repeated rows give equal results, a null doc_id stays, an empty table
    gives no rows. Only doc_id and text are read, so other columns may have any name.
    """
    common.prepare(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(df).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded binary"
    return rows.mapInArrow(common.task(_rows(path or ranks_file(), pattern or splitter(), payload), encoder=True), schema)


def decode_ids(bpe: ByteBpe, parts: Iterable[list[int]]) -> bytes:
    """The bytes of consecutive lists of ids."""
    return b"".join(bpe.decode(p) for p in parts)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(common.documents(spark, sf_dir), payload="digests").drop("ids", "decoded")
