"""Corpus analytics: censuses, tallies, gap ranks, changes between runs, covers, page verdicts, raster grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages are judged from so many cells; what a verdict takes as visible, as explained, as near.
JUDGED_CELLS, VISIBLE_PT, EXPLAINED, NEAR_PT, CLUSTER = 250, 3.0, 0.95, 1.0, 3


def distinct_documents(rows: DataFrame, identity: str, path: str) -> DataFrame:
    """The row of each identity with the least path, and copies. An aggregate: it combines before the shuffle."""
    others = [c for c in rows.columns if c not in (identity, path)]
    out = rows.groupBy(identity).agg(F.min_by(F.struct(path, *others), F.struct(path)).alias("__first"), F.count(F.lit(1)).alias("copies"))
    return out.select(identity, "__first.*", "copies")


def feature_census(rows: DataFrame, key: str, markup: str, pattern: str = "<([a-z0-9]+)") -> DataFrame:
    """key, feature, occurrences."""
    found = rows.select(key, F.explode(F.regexp_extract_all(markup, F.lit(pattern), F.lit(1))).alias("feature"))
    return found.groupBy(key, "feature").agg(F.count(F.lit(1)).alias("occurrences"))


def features_in(census: DataFrame) -> DataFrame:
    """feature, documents, occurrences."""
    return census.groupBy("feature").agg(F.count(F.lit(1)).alias("documents"), F.sum("occurrences").alias("occurrences"))


def tallied(rows: DataFrame, kind: str, document: str) -> DataFrame:
    """kind, documents, occurrences; two levels, so that a hot kind is combined by document first."""
    each = rows.groupBy(kind, document).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences"))


def rank_gaps(gaps: DataFrame, features: DataFrame, all_documents: int) -> DataFrame:
    """kind, documents, of: the documents that have the feature, or all."""
    of = features.select(F.col("feature").alias("kind"), F.col("documents").alias("of"))
    return gaps.join(of, "kind", "left").select("kind", "documents", F.coalesce("of", F.lit(all_documents)).alias("of"))


def changes_between(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """key, before, after where the state differs; documents of one run only aren't changes."""
    b = before.select(key, F.col(state).alias("before"))
    return b.join(after.select(key, F.col(state).alias("after")), key).where(F.col("before") != F.col("after"))


def covering_documents(census: DataFrame, at_least: int = 3) -> list[tuple[object, list[str]]]:
    """Greedy cover: documents, in order, until each feature is in at_least of them (or all that have it); ties by the least key.

    census: key, feature. Each step is one aggregation over what is still wanted; the driver holds the features only.
    """
    key = census.columns[0]
    left = census.select(key, "feature").distinct().cache()
    want = {r.feature: min(at_least, r.n) for r in left.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken: list[tuple[object, list[str]]] = []
    while wanted := [f for f, n in want.items() if n > 0]:
        rows = left.where(F.col("feature").isin(wanted)).where(~F.col(key).isin([k for k, _ in taken]) if taken else F.lit(True))
        best = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.collect_list("feature").alias("features")).orderBy(F.desc("n"), key).first()
        if best is None:
            break
        taken.append((best[0], sorted(best.features)))
        for f in best.features:
            want[f] -= 1
    left.unpersist()
    return taken


def grid_of(pixels: DataFrame, keys: list[str], x: str, y: str, ink: str, cell: int) -> DataFrame:
    """keys, row, col, ink: the sum over each cell's pixels, and n."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    return pixels.groupBy(*keys, at(y).alias("row"), at(x).alias("col")).agg(F.sum(ink).alias("ink"), F.count(F.lit(1)).alias("n"))


def grid_difference(ours: DataFrame, theirs: DataFrame, keys: list[str], blank: float, least: float) -> DataFrame:
    """keys, interesting, differing: cells that either has ink in, and those whose ink differs by more than least. A missing page is blank."""
    on = [*keys, "row", "col"]
    both = ours.select(*on, F.col("ink").alias("a")).join(theirs.select(*on, F.col("ink").alias("b")), on, "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return both.groupBy(*keys).agg(F.count_if((a > blank) | (b > blank)).alias("interesting"), F.count_if(((a > blank) | (b > blank)) & (F.abs(a - b) > least)).alias("differing"))


def worst_page(pages: DataFrame, key: str, judged: int = JUDGED_CELLS) -> DataFrame:
    """key, worst: the greatest share among pages with enough cells, else the document's own share."""
    share = F.when(F.col("interesting") == 0, 0.0).otherwise(F.col("differing") / F.col("interesting"))
    whole = F.when(F.sum("interesting") == 0, 0.0).otherwise(F.sum("differing") / F.sum("interesting"))
    return pages.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("interesting") >= judged, share)), whole).alias("worst"))


def page_shape(worst: Column, matched: Column, near_share: Column, kept_share: Column) -> Column:
    """agrees, shifted, drifting or deformed."""
    return F.when(worst <= VISIBLE_PT, "agrees").when((matched < CLUSTER) | (near_share >= EXPLAINED), "shifted").when(kept_share >= EXPLAINED, "drifting").otherwise("deformed")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Stable: the order must name a tie-break."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
