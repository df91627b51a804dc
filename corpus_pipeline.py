"""The corpus pipeline: quality rules, exact dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and all rows that the stage before it kept, and returns rows with the columns of
documents; the last returns packed pieces. What a stage returns is written as Parquet before the next one reads it, so
the next one deletes the tables that it left in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import exact_dedup, near_dup, packing, quality
from foliant.llm.common import Scratch

_left: list[Scratch] = []


def _stage(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            _left.pop().drop()
        n = len(Scratch.made)
        out = f(docs)
        _left.extend(Scratch.made_since(n))
        return out

    return run


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", _stage(quality.passed)),
    ("exact_dedup", _stage(exact_dedup.deduplicated)),
    ("near_dup", _stage(near_dup.without_near_copies)),
    ("best_fit_packing", _stage(lambda docs: packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))),
]

#: SQL has no perplexity, signatures or best-fit packing: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    written = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
