"""Exact deduplication by deterministic block naming (native: DataFrame functions only).

Each normalised text is cut into blocks of BLOCK code points. Distinct blocks are sorted and numbered; from then on a
document is a list of integers. Adjacent pairs of names are sorted and numbered in turn, which halves the list, until
each document is one integer. Two texts get the same (number of blocks, last name) only if they are identical: names
stand for the blocks themselves, not for hashes of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, hot_keys, join_on, numbered, text_or_empty, without

#: Code points of a block.
BLOCK = 4096
#: The characters that don't count: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def without_blanks(text: Column) -> Column:
    """text without BLANKS, by copying what stands between them: translate() makes an object of each character, which fills the heap."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), BLANKS, F.make_valid_utf8(text))


def named(df: DataFrame, keys: list[str], hot: list[int]) -> DataFrame:
    """df with a column name: an integer for each distinct value of the keys, in their sorted order within each shuffle partition.

    Hot keys and the rest are numbered apart (odd and even), each in the one branch that joins them: a table of names
    that both branches read would be planned twice, and be numbered by other partitions each time.
    """

    def names(rows: DataFrame, odd: int) -> DataFrame:
        return rows.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", 2 * F.monotonically_increasing_id() + odd)

    if not hot:
        return join_on(df, names(df, 0), keys, [])
    is_hot = F.xxhash64(*keys).isin(list(hot))
    rest, common = df.where(~is_hot), df.where(is_hot)
    return join_on(rest, names(rest, 0), keys, []).unionByName(join_on(common, F.broadcast(names(common, 1)), keys, []))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical without BLANKS. Of equal texts the one with the most code points stays, then the one
    with the smallest id (a null id comes last), then any one of rows that agree in both. A null text is an empty one,
    and all empty texts are equal. Other columns of docs are not looked at, whatever their names.
    """
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return classes(Scratch(docs.sparkSession, "exact-dedup"), own, block).drop("rid")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, with all their columns; see text_classes()."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = numbered(scratch, docs)
    own = rows.select("rid", F.col("row").getField(id_col).alias("doc_id"), text_or_empty(F.col("row").getField(text_col)).alias("text"))
    return without(rows, scratch.table(classes(scratch, own, block).where(~F.col("kept")).select("rid"), "dropped"), docs.columns)


def classes(scratch: Scratch, own: DataFrame, block: int) -> DataFrame:
    """text_classes() of (rid, doc_id, text), with rid."""
    base = own.select("rid", "doc_id", F.length("text").cast("long").alias("n_chars"), without_blanks(F.col("text")).alias("norm"))
    base = base.select(
        "rid", "doc_id", "n_chars", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
        F.when(F.length("norm") <= block, F.array("norm")).otherwise(F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block), F.lit(0))).alias("blocks"),
    )
    base = base.select("rid", "doc_id", "n_chars", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    blocks = scratch.table(base, "blocks")  # row numbers are fixed from here on
    most = blocks.agg(F.max("n")).first()[0] or 1

    level = blocks.select("rid", "n", "pos", "block")
    level = scratch.table(named(level, ["block"], hot_keys(level, ["block"])).select("rid", "n", "pos", "name"), "level0")
    ended, width, k = [level.where(F.col("n") == 1)], 1, 0
    while width < most:  # each round halves the longest list: log2 of the blocks of the longest text
        k, before = k + 1, width
        width *= 2
        half = F.shiftright("pos", 1)
        pairs = level.where(F.col("n") > before).groupBy("rid", "n", half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = scratch.table(pairs, f"pairs{k}")
        level = scratch.table(named(pairs, ["a", "b"], hot_keys(pairs, ["a", "b"])).select("rid", "n", "pos", "name"), f"level{k}")
        ended.append(level.where((F.col("n") > before) & (F.col("n") <= width)))
    last = ended[0]
    for x in ended[1:]:
        last = last.union(x)
    heads = blocks.where(F.col("pos") == 0).select("rid", "doc_id", "n_chars", "sha")
    rows = scratch.table(heads.join(last.select("rid", "n", "name"), "rid"), "rows")
    first = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    groups = rows.groupBy("n", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("n", "name", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"))
    out = join_on(rows, groups, ["n", "name"], hot_keys(rows, ["n", "name"]))
    return out.select("rid", "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"), "n_chars")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_chars")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, row(-n, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
