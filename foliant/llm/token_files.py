"""Token ids in directly addressable codes: any token can be read without decoding what stands before it.

An id is cut into chunks of CHUNK_BITS bits, lowest first. Level k has the k-th chunk of every id that has one, and a
bitmap that says which of them go on in level k + 1. A directory has the number of set bits before each BLOCK of the
bitmap, so the place in the next level is one look-up and a count within a block.

A file is a Parquet table with a row for each segment: its place (part, segment), its documents' ids and lengths, and
the codes. Parquet is the container since every store that Spark writes to has it, and its commit is atomic.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, text_or_empty
from foliant.llm.tokens import word_ids

CHUNK_BITS = 8
#: Bits of the bitmap for each entry of the directory.
BLOCK = 512
#: Tokens of a segment; one that a document ends in may have more.
SEGMENT = 1 << 20
MAGIC = b"FDC1"


def encode_codes(ids: np.ndarray) -> bytes:
    """Codes of unsigned 32-bit ids: magic, number of levels, then for each level its length, chunks, bitmap and directory."""
    rest = np.asarray(ids, np.uint32)
    levels = []
    while not levels or len(rest):
        high = rest >> np.uint32(CHUNK_BITS)
        goes_on = high > 0
        padded = np.zeros(-(-len(rest) // BLOCK) * BLOCK, bool)
        padded[: len(rest)] = goes_on
        before = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(1))])[:-1] if len(rest) else np.zeros(0)
        levels.append(struct.pack("<Q", len(rest)) + rest.astype(np.uint8).tobytes() + np.packbits(padded, bitorder="little").tobytes() + before.astype("<u4").tobytes())
        rest = high[goes_on]
    return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Codes:
    """Reads encode_codes()."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of token codes")
        (n,) = struct.unpack_from("<I", data, 4)
        at = 8
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", data, at)
            blocks = -(-size // BLOCK)
            chunks = np.frombuffer(data, np.uint8, size, at + 8)
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at + 8 + size)
            at += 8 + size + len(bits)
            self.levels.append((chunks, bits, np.frombuffer(data, "<u4", blocks, at)))
            at += 4 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The i-th id, from one chunk of each of its levels."""
        out = shift = 0
        for chunks, bits, before in self.levels:
            out |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            own = bits[block * BLOCK // 8 : (i >> 3) + 1]
            i = int(before[block]) + int(np.unpackbits(own, bitorder="little")[: i - block * BLOCK].sum())
            shift += CHUNK_BITS
        return out

    def all(self) -> np.ndarray:
        out, places = np.zeros(len(self), np.uint32), np.arange(len(self))
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[places] |= chunks.astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            places = places[np.unpackbits(bits, bitorder="little")[: len(chunks)].astype(bool)]
        return out


SEGMENTS = "part int, segment int, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, codes binary"


def _segments(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["part", "segment", "n_tokens", "doc_ids", "lengths", "codes"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, segment, end = word_ids(path, "loose"), TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        docs: list = []
        lengths: list[int] = []
        held: list[bytes] = []

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, segment, len(ids), docs, lengths, encode_codes(ids)), kinds, strict=True)], names)

        size = 0
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(x.as_py() for x in batch.column(1)), strict=True):
                ids += end
                docs.append(doc)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += lengths[-1]
                if size >= SEGMENT:
                    yield row()
                    docs, lengths, held, size, segment = [], [], [], 0, segment + 1
        if docs:
            yield row()

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts in ascending order of id, nulls first; each document ends with end_id. A null text is empty.

    Rows with the same id stand together, in the order of a hash of their texts. Other columns are not looked at.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ordered = own.orderBy("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(_segments(vocabulary, end_id), SEGMENTS).write.option("compression", "none").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = Codes(row["codes"]).all().astype("<u4")
            ends = np.cumsum(row["lengths"], dtype=np.int64)
            starts = ends - np.array(row["lengths"], np.int64)
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(starts)
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(starts), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "part", "segment", "at", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    order = Window.orderBy("part", "segment")  # a row for each 2^20 tokens, without the codes
    base = files.select("part", "segment", F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    docs = files.mapInArrow(_read, "doc_id long, part int, segment int, at long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark: SparkSession, path: str, place: int) -> int:
    """The token at a place counted over all files: one segment is read, one token decoded."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    order = Window.orderBy("part", "segment")
    ends = files.select("part", "segment", "n_tokens", F.sum("n_tokens").over(order).alias("end"))
    own = ends.where((F.col("end") > place) & (F.col("end") - F.col("n_tokens") <= place)).first()
    data = files.where((F.col("part") == own.part) & (F.col("segment") == own.segment)).select("codes").first().codes
    return Codes(bytes(data))[place - (own.end - own.n_tokens)]


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{Scratch(spark, 'token-files').path}/ids"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_documents(spark, path)
