"""Best-fit packing of tokenised documents into sequences: online, with a fixed number of open bins.

The open bins are kept by free space, with a bitset of the amounts of free space for which there is one. A piece goes
to the bin with the least room that is enough; if none has enough, a bin is opened, and if that makes too many, the
fullest is closed. Pieces come in the order of a hash, so each task sees a mix of lengths. A task holds the open bins
alone, whatever the number of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, text_or_empty
from foliant.llm.tokens import word_ids

#: Tokens of a sequence.
ROOM = 2048
#: Bins open at once in a task.
OPEN_BINS = 1024
#: Pieces for each packing task.
PIECES_PER_TASK = 200_000
#: Follows each document.
END_ID = 0


class BestFit:
    """put(length) gives (bin, offset). Bins are numbered from 0 as they open."""

    def __init__(self, room: int = ROOM, open_bins: int = OPEN_BINS):
        self.room, self.most = room, open_bins
        self.free: list[list[int]] = [[] for _ in range(room + 1)]  # open bins by free space
        self.bits = 0  # bit f: free[f] isn't empty
        self.open = self.opened = 0

    def _take(self, free: int) -> int:
        out = self.free[free].pop()
        if not self.free[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return out

    def put(self, length: int) -> tuple[int, int]:
        enough = self.bits >> length
        if enough:
            free = length + (enough & -enough).bit_length() - 1
            own = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            own, free = self.opened, self.room
            self.opened += 1
        left = free - length
        if left:
            self.free[left].append(own)
            self.bits |= 1 << left
            self.open += 1
        return own, self.room - free


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only a document longer than room is cut; its first piece may be shorter than room."""
    first = n % room or room
    return [(0, first), *((s, room) for s in range(first, n, room))] if n else []


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces_of(path: str, room: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_ids(path, "spaced"), END_ID.to_bytes(4, "little")
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(x.as_py() for x in batch.column(1)), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, room)):
                    own = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(cols, (doc, k, start, length, zlib.crc32(own), own if with_ids else None), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def _pack(room: int, open_bins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, task = BestFit(room, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.put(n) for n in batch.column("length").to_pylist()]
            ids, at = pa.array([task + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, at], [*batch.schema.names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids if asked for.

    A null text is empty: its one piece is the end id. Rows with the same id are packed each on its own. A null id stays
    null. Other columns of docs are not looked at. A whole sequence needs no packing and has a negative sequence_id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    pieces = scratch.table(own.mapInArrow(pieces_of(vocabulary, room, with_ids), PIECES), "pieces")
    pieces = pieces if with_ids else pieces.drop("ids")
    full, rest = pieces.where(F.col("length") == room), pieces.where(F.col("length") < room)
    tasks = max(1, -(-rest.count() // PIECES_PER_TASK))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    rest = rest.repartition(tasks, order).sortWithinPartitions(order, "doc_id", "piece")
    kinds = ", ".join(f"{n} {t}" for n, t in [*rest.dtypes, ("sequence_id", "bigint"), ("offset", "bigint")])
    packed = rest.mapInArrow(_pack(room, open_bins), kinds)
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
