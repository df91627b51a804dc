"""What the training-data operators share: scratch tables in the cluster's shared folder and joins that survive hot keys."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it has at least this share of all rows: there are at most 1 / HOT_SHARE of them, however large the input is.
HOT_SHARE = 1 / 256
#: ... and at least this many rows, so that small inputs take one path only.
HOT_ROWS = 2000


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; where it is unset (tests), a temporary one is set first."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = getattr(spark.sparkContext, "_foliant_shared", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors see")
        at = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext._foliant_shared = at
        atexit.register(_delete, spark, at)
    return at.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that later jobs read them again instead of computing them again.

    A lost executor loses none of them. They are deleted when the driver's process ends, since the lazy results read
    them; who knows that a result has been written can delete them before, see made_since().
    """

    made: list[Scratch] = []  # noqa: RUF012

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        Scratch.made.append(self)
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.path)

    def table(self, df: DataFrame, name: str, partition_by: Sequence[str] = (), options: dict[str, str] | None = None) -> DataFrame:
        """Write df and return what was written."""
        at = f"{self.path}/{name}"
        writer = df.write.option("compression", "zstd").options(**(options or {}))
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        """One of the tables, or all."""
        _delete(self.spark, f"{self.path}/{name}".rstrip("/"))
        if not name and self in Scratch.made:
            Scratch.made.remove(self)

    def free_shuffles(self) -> None:
        """Spark deletes the shuffle files of what is no longer referred to when the driver collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    @classmethod
    def made_since(cls, n: int) -> list[Scratch]:
        return cls.made[n:]


def numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(rid, row): rows of docs with a number that stays, each in a struct, so that no column's name clashes."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return scratch.table(docs.select(F.monotonically_increasing_id().alias("rid"), row.alias("row")), "numbered")


#: Numbers of rows that are sent to all tasks, at most (8 MB).
MOST_NUMBERS = 1_000_000


def without(rows: DataFrame, dropped: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of the rows (rid, row) whose numbers aren't in dropped (rid), which is broadcast if it is small."""
    small = dropped.limit(MOST_NUMBERS + 1).count() <= MOST_NUMBERS
    kept = rows.join(F.broadcast(dropped) if small else dropped, "rid", "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in columns))


def text_or_empty(col: str | Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def hot_keys(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """xxhash64 of the keys that hold HOT_SHARE of the rows or more: a short list whatever the input's size."""
    counted = df.groupBy(F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    least = F.greatest(F.lit(HOT_ROWS), F.col("total") * HOT_SHARE)
    return [r.h for r in counted.where(F.col("n") >= HOT_ROWS).crossJoin(F.broadcast(total)).where(F.col("n") >= least).select("h").collect()]


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: Sequence[int]) -> DataFrame:
    """Inner join with right, which has one row per key; no key is null. Rows of hot keys are joined by broadcast.

    The broadcast side has a row per hot key at most, so at most 1 / HOT_SHARE rows (and those that share a hash).
    """
    kept = [c for c in right.columns if c not in keys]

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*(F.col(k).alias(f"__{k}") for k in keys), *kept)
        return a.join(b, reduce(lambda x, y: x & y, (a[k] == b[f"__{k}"] for k in keys))).drop(*(f"__{k}" for k in keys))

    if not hot:
        return joined(left, right)
    is_hot = F.xxhash64(*keys).isin(list(hot))
    return joined(left.where(~is_hot), right.where(~is_hot)).unionByName(joined(left.where(is_hot), F.broadcast(right.where(is_hot))))


def as_bytes(words: pa.Array) -> list[bytes]:
    """Of strings or binaries without nulls."""
    words = words.cast(pa.large_binary())
    cuts = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    data = words.buffers()[2].slice(cuts[0], cuts[-1] - cuts[0]).to_pybytes() if len(words) and words.buffers()[2] else b""
    cuts = (cuts - cuts[0]).tolist()
    return list(map(data.__getitem__, map(slice, cuts, cuts[1:])))
