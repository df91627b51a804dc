import hashlib
import html
import re

import public_tokenizers
import pytest
from helpers import SF, duck_rows, rows_of
from pyspark.sql import functions as F

from foliant.llm import chat_format, html_text, shards
from foliant.llm.queries import ORACLE_SQL, QUERIES


def test_articles_of_the_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op4_html_text"](spark, SF).collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGE = """<html><head><title>T {0}</title></head><body><header><h2>Site</h2></header><div class="cookie-notice">We use cookies</div><nav><a href=/>Home</a></nav>
<main><h1>Head {0}</h1><p>First &amp; <i>best</i>{0}.<p>Second<br>line {0}</p>{1}<form><input><label>Mail</label></form><aside>Also</aside></main>
<section class="comments"><p>Nice {0}!</p></section><footer>End</footer></body></html>"""


def test_boilerplate_goes_and_optional_and_repeated_parts_stay(spark):
    extra = ["", "<h2>Sub</h2><p>Third</p><p>Fourth</p>", "<ul><li>a</li><li>b<li>c</ul>", "<h2>S</h2><p>x</p><h2>S</h2><p>y</p>"]
    rows = [(k, f"http://a.example/{k}", PAGE.format(k, extra[k % 4])) for k in range(12)]
    rows += [(90, None, None), (91, "http://a.example/x", ""), (92, "nothing", "plain text"), (93, "http://b.example/", "<p>cut &am"), (0, "http://a.example/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "'x' AS items")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert got[0] == "Head 0\n\nFirst & best0.\n\nSecond line 0"
    assert got[1] == "Head 1\n\nFirst & best1.\n\nSecond line 1\n\nSub\n\nThird\n\nFourth"
    assert got[2].endswith("Second line 2\n\na\n\nb\n\nc") and got[3].endswith("S\n\nx\n\nS\n\ny")
    assert (got[90], got[91], got[92], got[93]) == ("", "", "plain text", "cut &am")
    assert html_text.extract_text(df).count() == len(rows) and html_text.extract_text(df.limit(0)).count() == 0


def test_alignment_makes_groups_and_options():
    item = lambda *labels: [[n, False, False, []] for n in labels]
    assert html_text.fold(item("p", "p", "p")) == [["p", False, True, []]]
    assert html_text.fold(item("dt", "dd", "dt", "dd")) == [["()", False, True, item("dt", "dd")]]
    assert html_text.align(item("h1", "p"), item("h1", "img", "p")) == [["h1", False, False, []], ["img", True, False, []], ["p", False, False, []]]


def test_chats_equal_sql(spark, duck):
    assert rows_of(QUERIES["op7_chat_format"](spark, SF)) == duck_rows(duck, ORACLE_SQL["op7_chat_format"])


def test_chats_read_back(spark):
    rows = [(1, 0, "user", "</s>[INST] & &lt;| <|turn|> [/INST]"), (1, 1, "assistant", None), (1, 2, None, "x"), (2, None, "user", "b"), (2, None, "user", "a"), (None, 1, "assistant", "<|end|><|text|>"), (3, 1, "a<|text|>b", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "0 AS turns", "'s' AS segments")
    out = chat_format.format_chats(df)
    got = {r.conv_id: r for r in out.select("*", chat_format.read_turns(out.formatted).alias("read")).collect()}
    read = {i: [(t.role, t.text) for t in r.read] for i, r in got.items()}
    assert read == {1: [("user", rows[0][3]), ("assistant", ""), ("", "x")], 2: [("user", "a"), ("user", "b")], None: [("assistant", "<|end|><|text|>")], 3: [("a<|text|>b", "t")]}
    assert {i: (r.valid, r.error_turn) for i, r in got.items()} == {1: (False, 2), 2: (False, 1), None: (False, 0), 3: (False, 0)}
    assert all("".join(s.text for s in r.segments) == r.formatted for r in got.values()) and chat_format.format_chats(df.limit(0)).count() == 0
    probe = [r for r in QUERIES["op7_chat_format"](spark, SF).collect() if r.conv_id == -7][0]
    own = "</s>[INST] ok [/INST]"
    assert probe.turns_sha256 == hashlib.sha256(f"user\n{own}\nassistant\n{own}\n".encode()).hexdigest() and (probe.loss_chars, probe.valid) == (len(own), True)


def test_shards_keep_all_rows(spark, odd, empty, tmp_path):
    table = shards.ShardTable(spark, f"file://{tmp_path}/t", fan_in=2, target=4000)
    for k in range(9):
        table.append(spark.range(k * 100, k * 100 + 100).coalesce(1))
    assert table.version() == 9 and len(table.manifest()) == 9 and table.read(4).count() == 400
    table.compact()
    assert sorted(r.id for r in table.read().collect()) == list(range(900)) and table.read(9).count() == 900
    with pytest.raises(shards.Conflict):
        table.commit([], table.version() - 1)
    with pytest.raises(ValueError, match="nothing"):
        shards.ShardTable(spark, f"file://{tmp_path}/none").read()
    ids = lambda df: sorted((str(r.doc_id), r.n_chars) for r in df.collect())
    want = sorted((str(r.doc_id), len(r.text or "")) for r in odd.collect())
    own, rows = shards.sharded(odd.withColumn("shard", F.lit("mine")).withColumn("__arrival", F.lit(None).cast("int")), arrivals=3)
    assert ids(rows) == want and {"shard", "__arrival", "kept"} <= set(own.read(shard="file").columns)
    own.append(odd.withColumn("shard", F.lit("x")).withColumn("__arrival", F.when(F.col("doc_id") > 3, F.lit(-2))), "__arrival")
    assert own.read(shard="file").count() == 2 * len(want)
    assert shards.sharded(empty)[1].count() == 0


def test_a_run_is_a_file_of_about_the_target(spark, tmp_path):
    table = shards.ShardTable(spark, f"file://{tmp_path}/t", fan_in=4, target=20_000)
    for k in range(24):
        table.append(spark.range(k * 1000, k * 1000 + 1000).select("id", F.xxhash64("id").alias("h")).coalesce(1))
    table.compact()
    got = table.manifest()
    assert len(got) > 1 and max(s.bytes for s in got) <= shards.MOST_TARGETS * table.target and not table.plan(got)
    assert sum(s.bytes < table.target * shards.MOST_TARGETS / table.fan_in for s in got) < table.fan_in
    assert table.read().count() == 24_000 and table.read().select("id").distinct().count() == 24_000
    assert sum(s.bytes > table.target / 2 for s in got) > 1
    table.compact(last=True)
    assert max(s.bytes for s in table.manifest()) <= shards.MOST_TARGETS * table.target and table.read().count() == 24_000


def test_compaction_leaves_other_writers_alone(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    table, other = shards.ShardTable(spark, root, fan_in=2, target=50_000), shards.ShardTable(spark, root, fan_in=2, target=50_000)
    for k in range(4):
        table.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
    written = other._path("data/other")
    spark.range(40, 50).coalesce(1).write.parquet(f"{root}/data/other")  # written, not committed yet
    merge, todo = table._merge, [1]

    def slow(*args):
        out = merge(*args)
        if todo and todo.pop():
            other.append(spark.range(50, 60).coalesce(1))  # another writer commits while runs are merged
        return out

    monkeypatch.setattr(table, "_merge", slow)
    table.compact()
    table.vacuum()
    assert other.fs.exists(written)
    other.commit(other.manifest() + [shards.Shard(p, n, 9) for p, n in other._files("data/other")], other.version())
    assert sorted(r.id for r in table.read().collect()) == list(range(60))
    table.vacuum(orphan_s=0)
    assert table.read().count() == 60


def test_sharding_query(spark):
    got = QUERIES["op9_sharding"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted((r.doc_id, r.n_chars) for r in got) == sorted((r.doc_id, len(r.text or "")) for r in docs)


def test_pipeline(spark):
    import corpus_pipeline

    kept = [r.doc_id for r in QUERIES["op8_quality_rules"](spark, SF).where("kept").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from foliant.llm import exact_dedup, near_dup, packing

    want = docs.where(docs.doc_id.isin(kept))
    for f in (exact_dedup.deduplicated, near_dup.without_near_copies):
        want = f(want)
    want = packing.pack_documents(want, public_tokenizers.path("byte_bpe_50k.json"))
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(want)


def test_main_text_is_decided_for_each_page(spark):
    article = '<html><body class="{1}"><div class="{2}"><article><h1>Head {0}</h1><p>Text {0}</p></article></div><p>Read {0} more</p></body></html>'
    story = "<html><body><div class=story><p>Story {0}</p><p>goes on {0}</p></div></body></html>"
    for url in ("http://mixed.example/{}", "none {}"):
        rows = [(k, url.format(k), story.format(k) if k % 3 == 1 else article.format(k, *(("has-sidebar", "x"), ("x", "with-sidebar"))[k % 2])) for k in range(24)]
        got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {k: f"Story {k}\n\ngoes on {k}" if k % 3 == 1 else f"Head {k}\n\nText {k}" for k in range(24)}
    comments = "<html><body><main><p>Text</p></main><div class=comments><article>Nice!</article></div></body></html>"
    assert [r.text for r in html_text.extract_text(spark.createDataFrame([(1, None, comments)], "page_id long, url string, html string")).collect()] == ["Text"]


#: No element or class says what is what.
BARE = """<html><body><div><div>Acme Daily</div><div><a href=/a>World</a> <a href=/b>Sport</a></div></div><div>Subscribe to our letter!</div>
<div><div><div>Head {0}</div>{1}<div>More of it {0} and more words.</div></div></div><div><div><a href=/1>Other {0}</a></div><div><a href=/2>Next {0}</a></div></div><div>All rights reserved</div></body></html>"""


def test_wrappers_decide_where_no_name_does(spark, monkeypatch):
    para = lambda k, n: "".join(f"<div>Words {k} of paragraph {i} that say a thing or two.</div>" for i in range(n))
    rows = [(k, f"http://bare.example/{k}", BARE.format(k, para(k, 2 + k % 3))) for k in range(12)]
    rows += [(100 + k, "http://bare.example/0", rows[0][2]) for k in range(20)]  # copies
    rows += [(200, "http://bare.example/deep", "<div>" * 10_000 + "deep" + "</div>" * 10_000), (201, "http://wide.example/", "".join(f"<x{k}>{k}</x{k}>" for k in range(3000)))]
    rows += [(202, "http://wide.example/2", "".join(f"<x{k}>{k}</x{k}>" for k in range(0, 6000, 2)))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = lambda k: "\n\n".join([f"Head {k}", *(f"Words {k} of paragraph {i} that say a thing or two." for i in range(2 + k % 3)), f"More of it {k} and more words."])
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert all(got[k] == want(k) for k in range(12)) and all(got[100 + k] == want(0) for k in range(20))
    assert got[200] == "deep" and got[201].split("\n\n") == [str(k) for k in range(3000)] and got[202].count("\n\n") == 2999
    monkeypatch.setattr(html_text, "MOST_BYTES", 0)  # pages go to wrappers by host
    monkeypatch.setattr(html_text, "PART", 2)
    assert {r.page_id: r.text for r in html_text.extract_text(df.where("page_id < 200")).collect()} == {k: v for k, v in got.items() if k < 200}
    alone = html_text.Wrapper([])  # without what was inferred, the template stays
    assert "All rights reserved" in html_text.main_text(html_text.parse(rows[0][2]), alone, set())


def test_constant_parts_of_an_article_go(spark):
    page = "<html><body><article><h1>Head {0}</h1><p>Text {0} goes here.</p><div><p>Tell your friends</p></div><p>And on {0}.</p></article></body></html>"
    df = spark.createDataFrame([(k, "http://c.example/", page.format(k)) for k in range(9)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract_text(df).collect()} == {k: f"Head {k}\n\nText {k} goes here.\n\nAnd on {k}." for k in range(9)}
