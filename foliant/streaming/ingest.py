"""Additions of this engine: new documents as a stream. Batch and stream use the same operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def new_packages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(doc_id, path, modified, content) of packages as they arrive in a folder."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").option("maxFilesPerTrigger", files_per_batch).load(path)
    return files.select(F.substring(F.sha2("content", 256), 1, 12).alias("doc_id"), "path", F.col("modificationTime").alias("modified"), "content")


def first_seen(stream: DataFrame, identity: str, time: str, delay: str = "1 day") -> DataFrame:
    """Each identity once within the delay: state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([identity])


def table_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tallies(stream: DataFrame, kind: str, time: str, width: str, delay: str) -> DataFrame:
    """(start, kind, occurrences) of tumbling windows."""
    w = F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("occurrences")).select(F.col("w.start").alias("start"), "kind", "occurrences")


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Applies a batch operator to all new rows and writes what it returns; a batch that is done again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
