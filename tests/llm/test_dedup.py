import random
import re

import numpy as np
from helpers import SF, duck_rows, rows_of
from pyspark.sql import functions as F

from foliant.llm import exact_dedup, near_dup
from foliant.llm.common import Scratch
from foliant.llm.queries import ORACLE_SQL, QUERIES


def test_exact_equals_sql(spark, duck):
    assert rows_of(QUERIES["op6_exact_dedup"](spark, SF)) == duck_rows(duck, ORACLE_SQL["op6_exact_dedup"])


def test_exact_odd_rows(odd, empty):
    got = exact_dedup.text_classes(odd, block=64).collect()
    assert len(got) == odd.count() and exact_dedup.text_classes(empty).count() == 0
    assert sum(r.kept for r in got) == len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in odd.collect()})
    empties = [r for r in got if r.doc_id in (2, 3, 4)]
    assert {(r.keep_id, r.group_size) for r in empties} == {(4, 3)}  # most code points in the original
    same = [r for r in got if r.doc_id in (1, 5)]
    assert {(r.keep_id, r.group_size) for r in same} == {(1, 3)} and sum(r.kept for r in same) == 1
    assert {(r.keep_id, r.group_size, r.n_chars) for r in got if r.doc_id is None} == {(None, 2, 10), (None, 2, 11)}
    stay = exact_dedup.deduplicated(odd, block=64)
    assert stay.columns == odd.columns and stay.count() == sum(r.kept for r in got)


def test_block_names_tell_apart_any_place(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choice("ab") for _ in range(1000))
    texts = [text] + [text[:i] + ("a" if text[i] == "b" else "b") + text[i + 1 :] for i in range(0, 1000, 97)] + [text[:-1], text + "a", text]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sum(r.kept for r in exact_dedup.text_classes(df, block=16).collect()) == len(set(texts))


def test_exact_needs_less_memory_than_an_object_for_each_character(spark):
    jvm, counts = spark._jvm, {}
    at = jvm.org.apache.spark.metrics.ExecutorMetricType.metricToOffset().apply("MinorGCCount")

    def collections():
        return jvm.org.apache.spark.executor.ExecutorMetrics.getCurrentMetrics(jvm.org.apache.spark.SparkEnv.get().memoryManager())[at]

    class Watched(Scratch):
        def table(self, df, name):
            before = collections()
            out = super().table(df, name)
            counts[name] = collections() - before
            return out

    docs = spark.range(0, 20000, 1, 4).selectExpr("id AS rid", "id AS doc_id", "concat(repeat('wörter and blanks \\t', 190), id) AS text")  # 76 MB
    before = collections()
    docs.select(F.translate("text", exact_dedup.BLANKS, "")).write.format("noop").mode("overwrite").save()
    objects = collections() - before
    assert exact_dedup.classes(Watched(spark, "watched"), docs, exact_dedup.BLOCK).where("kept").count() == 20000
    assert 2 * counts["blocks"] < objects


def test_signatures_are_unbiased():
    rng, off = np.random.default_rng(1), []
    for _ in range(150):
        n = int(rng.integers(1, 150))
        el = np.sort(rng.integers(0, 2**63, n).astype(np.uint64))
        a = rng.integers(0, 9, n) ** int(rng.integers(1, 4))
        b = np.where(rng.random(n) < 0.6, a, rng.integers(0, 9, n))
        if not a.any() or not b.any():
            continue
        x, y = (el[a > 0], a[a > 0]), (el[b > 0], b[b > 0])
        j = near_dup.overlap(x, y)
        off.append(((near_dup.bag_min_hash(*x) == near_dup.bag_min_hash(*y)).mean() - j) / max(0.03, (j * (1 - j) / near_dup.SIZE) ** 0.5))
    assert abs(np.mean(off)) < 0.3 and np.std(off) < 1.3


def brute_classes(docs):
    bags = {i: near_dup.bag_of(t or "") for i, t in docs}
    up = {i: i for i in bags}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = [i for i in bags if len(bags[i][0])]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(np.intersect1d(bags[a][0], bags[b][0])) and near_dup.overlap(bags[a], bags[b]) >= near_dup.SIMILAR:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in bags}


def test_near_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    base = [rnd.choice(words) for _ in range(120)]
    for k in range(60):  # a chain: each differs from the one before in a word, the ends are far apart
        base[rnd.randrange(120)] = f"new{k}"
        docs.append((10_000 + k, " ".join(base)))
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in near_dup.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_classes(docs)
    assert {i: g[0] for i, g in got.items()} == want
    assert all(g[2] == (g[0] == i) and g[1] == sum(v == want[i] for v in want.values()) for i, g in got.items())


def test_links_across_classes_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**32, near_dup.SIZE).astype("<u4")
    rows = []
    for k in range(23):
        s = base.copy()
        s[: k % 5] = rng.integers(0, 2**32, k % 5)
        rows.append((7, k, 100 if k < 8 else 200 if k < 16 else k, bytearray(s.tobytes())))
    members = spark.createDataFrame([r[:3] for r in rows], "bucket long, rid long, class long")
    signed = spark.createDataFrame([(r[1], r[3]) for r in rows], "rid long, signature binary")
    share = lambda a, b: (np.frombuffer(bytes(rows[a][3]), "<u4") == np.frombuffer(bytes(rows[b][3]), "<u4")).mean()
    want = {(a, b) for a in range(23) for b in range(a + 1, 23) if rows[a][2] != rows[b][2] and share(a, b) >= 0.9}
    got = near_dup.still_apart(members, signed, 0.9).collect()
    assert {r.rid for r in got} == {k for p in want for k in p}
    groups = {}
    for r in got:
        groups.setdefault((r.bucket, r.low, r.high), set()).add(r.rid)
    assert all(any({a, b} <= g for g in groups.values()) for a, b in want)


def test_a_group_whose_members_are_near_to_one_of_them_only(spark):
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    docs = []
    for k in range(60):
        own = list(base)
        for i in rnd.sample(range(150), 2 + k % 4):
            own[i] = f"new{k}x{i}"
        docs.append((k, " ".join(own)))
    docs.append((1000, " ".join(base)))
    got = {r.doc_id: r.class_id for r in near_dup.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_classes(docs)


def test_near_odd_rows(odd, empty):
    got = near_dup.near_classes(odd).collect()
    assert len(got) == odd.count() and near_dup.near_classes(empty).count() == 0
    assert {r.class_size for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert {(r.class_id, r.class_size) for r in got if r.doc_id in (1, 5)} == {(1, 3)}
    stay = near_dup.without_near_copies(odd)
    assert stay.columns == odd.columns and stay.count() == sum(r.kept for r in got)


def test_names_are_one_to_one_with_hot_keys(spark):
    """Both branches of a join with hot keys must number alike, whatever partitions they are coalesced to."""
    from pyspark.sql import functions as F

    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        key = F.when(F.col("id") % 9 == 0, F.col("id") % 27).otherwise(F.col("id"))
        df = spark.range(90_000).select("id", F.concat(F.lit("block "), F.repeat(key.cast("string"), 9)).alias("block"))
        hot = exact_dedup.hot_keys(df, ["block"])
        assert len(hot) == 3
        got = exact_dedup.named(df, ["block"], hot).select("id", "block", "name").collect()
        pairs = {(r.block, r.name) for r in got}
        assert len(got) == 90_000 and len(pairs) == len({b for b, _ in pairs}) == len({n for _, n in pairs}) == 80_003
        docs = df.select(F.col("id").alias("doc_id"), F.col("block").alias("text"))
        assert exact_dedup.text_classes(docs).where("kept").count() == 80_003
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
