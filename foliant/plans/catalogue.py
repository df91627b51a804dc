"""Queries on the driver's tables, each an operator of the library in its generic relational form, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import colour, numbers, text, units
from foliant.operators import cascade, corpus, intervals, lines, ordered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Width of a line in units of the synthetic face, lines of a page.
ROOM, PAGE_LINES = 90 * 1024, 46


@query()
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents to paragraphs to lines to pages; the lines of each page and how much of them is filled."""
    laid = lines.lay_out(table(spark, sf_dir, "documents"), "doc_id", "text", ROOM, PAGE_LINES)
    return laid.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("p_idx").alias("n_paragraphs"), F.sum("width_units").alias("width_units"))


@query("SELECT substr(sha256(text), 1, 12) AS id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def corpus_identity_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(text.identity_of(F.encode("text", "UTF-8")).alias("id"), "doc_id")
    return corpus.distinct_documents(docs, "id", "doc_id").select("id", "doc_id", "copies")


@query("SELECT page_id, feature, count(*) AS occurrences FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS feature FROM pages) GROUP BY ALL")
def feature_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.feature_census(table(spark, sf_dir, "pages"), "page_id", "html")


@query("""SELECT feature, count(*) AS documents, sum(n)::BIGINT AS occurrences FROM (SELECT page_id, feature, count(*) AS n FROM
(SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS feature FROM pages) GROUP BY ALL) GROUP BY feature""")
def features_documents_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.features_in(corpus.feature_census(table(spark, sf_dir, "pages"), "page_id", "html"))


@query("SELECT event_type AS kind, count(DISTINCT user_id) AS documents, count(*) AS occurrences FROM events GROUP BY 1")
def tally_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.tallied(table(spark, sf_dir, "events"), "event_type", "user_id")


@query("""WITH f AS (SELECT event_type, count(DISTINCT user_id) AS n FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT g.event_type AS kind, g.documents, coalesce(f.n, (SELECT count(DISTINCT user_id) FROM events)) AS "of"
FROM (SELECT event_type, count(DISTINCT user_id) AS documents FROM events WHERE value > 150 GROUP BY 1) g LEFT JOIN f USING (event_type)""")
def gap_rank_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    gaps = corpus.tallied(events.where("value > 150"), "event_type", "user_id")
    features = corpus.tallied(events.where("event_type <> 'error'"), "event_type", "user_id").withColumnRenamed("kind", "feature")
    return corpus.rank_gaps(gaps, features, events.select("user_id").distinct().count())


@query("""WITH s AS (SELECT o_custkey, year(o_orderdate) AS y, max(o_orderstatus) AS state FROM orders GROUP BY 1, 2)
SELECT a.o_custkey, a.state AS before, b.state AS after FROM s a JOIN s b USING (o_custkey) WHERE a.y = 1996 AND b.y = 1997 AND a.state <> b.state""")
def run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.max("o_orderstatus").alias("state"))
    return corpus.changes_between(states.where("y = 1996"), states.where("y = 1997"), "o_custkey", "state")


_LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_LINES_SQL = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""WITH g AS (SELECT l_orderkey, {_LINES_SQL}, l_linenumber % 3 AS lvl,
  count(*) FILTER (l_linenumber % 3 < 0) OVER w AS g0, count(*) FILTER (l_linenumber % 3 < 1) OVER w AS g1, count(*) FILTER (l_linenumber % 3 < 2) OVER w AS g2
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINES_SQL} ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, count(*) FILTER (lvl = 0) OVER (PARTITION BY l_orderkey, g0 ORDER BY {_LINES_SQL} ROWS UNBOUNDED PRECEDING) AS c0,
  count(*) FILTER (lvl = 1) OVER (PARTITION BY l_orderkey, g1 ORDER BY {_LINES_SQL} ROWS UNBOUNDED PRECEDING) AS c1,
  count(*) FILTER (lvl = 2) OVER (PARTITION BY l_orderkey, g2 ORDER BY {_LINES_SQL} ROWS UNBOUNDED PRECEDING) AS c2 FROM g)
SELECT l_orderkey, {_LINES_SQL}, CASE lvl WHEN 0 THEN c0 || '.' WHEN 1 THEN greatest(c0, 1) || '.' || c1 || '.' ELSE greatest(c0, 1) || '.' || greatest(c1, 1) || '.' || c2 || '.' END AS number FROM c""")
def list_numbers_multilevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE, (F.col("l_linenumber") % 3).alias("lvl"))
    counted = ordered.list_counters(rows, ["l_orderkey"], _LINE, "lvl", 3)
    shown = [F.greatest(f"count_{k}", F.lit(1)).cast("string") for k in range(3)]
    template = F.when(F.col("lvl") == 0, F.lit("%1.")).when(F.col("lvl") == 1, F.lit("%1.%2.")).otherwise(F.lit("%1.%2.%3."))
    return counted.select("l_orderkey", *_LINE, numbers.filled(template, shown).alias("number"))


@query("""SELECT p_partkey, repeat(chr(97 + (p_size - 1) % 26), (p_size - 1) // 26 + 1) AS letters,
  ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][p_size // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][p_size % 10 + 1] AS roman,
  lpad(p_size::VARCHAR, 2, '0') AS zeroed, upper(repeat(chr(97 + (p_size - 1) % 26), (p_size - 1) // 26 + 1)) AS upper_letters FROM part""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    form = lambda name: numbers.written(n, F.lit(name))
    return table(spark, sf_dir, "part").select("p_partkey", form("lowerLetter").alias("letters"), form("lowerRoman").alias("roman"), form("decimalZero").alias("zeroed"), form("upperLetter").alias("upper_letters"))


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 3 THEN p_partkey // 3 END AS up, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS size,
  p_partkey % 5 = 0 AS has_colour, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS colour FROM part),
c AS (SELECT id, up, 0 AS depth, size, has_colour, colour FROM s UNION ALL
  SELECT c.id, s.up, c.depth + 1, s.size, s.has_colour, s.colour FROM c JOIN s ON c.up = s.id)
SELECT id, arg_min(size, depth) FILTER (size IS NOT NULL) AS size, coalesce(max(has_colour), false) AS colour_stated,
  arg_min(struct_pack(v := colour), depth) FILTER (has_colour).v AS colour FROM c GROUP BY id""".replace("FILTER (has_colour).v", "FILTER (has_colour)['v']"))
def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as styles, each based on a third of its number; the colour may be stated as none."""
    n = F.col("p_partkey")
    styles = table(spark, sf_dir, "part").select(
        F.lit(0).alias("doc"), n.alias("id"), F.when(n >= 3, F.floor(n / 3)).alias("up"), F.when(n % 4 == 0, F.col("p_size")).alias("size"),
        F.when(n % 5 == 0, cascade.stated(F.when(n % 10 != 0, F.col("p_brand")))).alias("colour"),
    )
    out = cascade.style_chain(styles, ["doc"], "id", "up", ["size", "colour"])
    return out.select("id", "size", F.col("colour").isNotNull().alias("colour_stated"), F.col("colour.value").alias("colour"))


@query(f"""WITH g AS (SELECT l_orderkey, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINES_SQL})),
c AS (SELECT l_orderkey, r, n, unnest([0, 1, 2]) AS c FROM g)
SELECT l_orderkey, r AS row, c AS col, CASE WHEN r = n - 1 AND c = 2 THEN 'seCell' WHEN r = n - 1 AND c = 0 THEN 'swCell' WHEN r = 0 AND c = 2 THEN 'neCell' WHEN r = 0 AND c = 0 THEN 'nwCell'
  WHEN r = n - 1 THEN 'lastRow' WHEN r = 0 THEN 'firstRow' WHEN c = 2 THEN 'lastCol' WHEN c = 0 THEN 'firstCol' WHEN c % 2 = 1 THEN 'band1Vert' ELSE 'band2Vert' END AS format FROM c""")
def conditional_format_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of three columns: the strongest conditional format that reaches each cell."""
    w = Window.partitionBy("l_orderkey")
    grid = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.row_number().over(w.orderBy(*_LINE)) - 1).alias("row"), F.count(F.lit(1)).over(w).alias("rows"))
    cells = grid.select("l_orderkey", "row", "rows", F.explode(F.array(*map(F.lit, range(3)))).alias("col"))
    formats = cascade.conditional_formats(F.col("row"), F.col("col"), F.col("rows"), F.lit(3))
    return cells.select("l_orderkey", "row", "col", F.element_at(formats, -1).alias("format"))


@query("""WITH e AS (SELECT l_suppkey, l_partkey % 40 * 20 AS pos, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_returnflag = 'R' THEN 'clear' ELSE 'stop' END AS kind, l_extendedprice AS p FROM lineitem),
k AS (SELECT l_suppkey, pos, arg_max(kind, row(ord, p, kind)) AS kind FROM e GROUP BY ALL)
SELECT l_suppkey, coalesce(string_agg(pos, ',' ORDER BY pos) FILTER (kind <> 'clear'), '') AS stops FROM k GROUP BY 1""")
def tab_stop_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "clear").otherwise("stop")
    order = F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_extendedprice", kind)
    entries = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 40 * 20).alias("pos"), order.alias("ord"), kind.alias("kind"))
    out = cascade.settled_stops(entries, ["l_suppkey"], "ord", "pos", "kind")
    return out.select("l_suppkey", F.array_join(F.transform("stops", lambda s: s.cast("string")), ",").alias("stops"))


@query("""SELECT conv_id, turn, greatest(length(text) % 13 - coalesce(lag(length(text) % 7) OVER (PARTITION BY conv_id ORDER BY turn), 0), 0) AS space_before FROM conversations""")
def spacing_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (n % 13).alias("before"), (n % 7).alias("after"))
    return ordered.collapsed_spacing(rows, ["conv_id"], ["turn"], "before", "after").select("conv_id", "turn", "space_before")


@query("""WITH s AS (SELECT user_id, event_id, event_type, event_id % 13 AS b, event_id % 7 AS a FROM events),
o AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE b END AS ob, CASE WHEN lead(event_type) OVER w = event_type THEN 0 ELSE a END AS oa FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, greatest(ob - coalesce(lag(oa) OVER (PARTITION BY user_id ORDER BY event_id), 0), 0) AS space_before FROM o""")
def contextual_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 13).alias("b"), (F.col("event_id") % 7).alias("a"))
    return ordered.collapsed_spacing(rows, ["user_id"], ["event_id"], "b", "a", "event_type").select("user_id", "event_id", "space_before")


@query(f"SELECT l_orderkey, {_LINES_SQL}, coalesce(sum(1 + l_linenumber % 3) OVER (PARTITION BY l_orderkey ORDER BY {_LINES_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grid_at FROM lineitem")
def grid_prefix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE, (F.lit(1) + F.col("l_linenumber") % 3).cast("long").alias("span"))
    return ordered.running_before(rows, ["l_orderkey"], _LINE, "span", "grid_at").drop("span")


@query(f"""WITH b AS (SELECT l_orderkey, {_LINES_SQL}, CASE WHEN lag(l_linestatus) OVER w = l_linestatus THEN 0 ELSE 1 END AS begins FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINES_SQL})),
r AS (SELECT l_orderkey, sum(begins) OVER (PARTITION BY l_orderkey ORDER BY {_LINES_SQL} ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM b)
SELECT l_orderkey, run, count(*) AS rows FROM r GROUP BY ALL""")
def vertical_merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE, "l_linestatus")
    return ordered.runs(rows, ["l_orderkey"], _LINE, "l_linestatus").groupBy("l_orderkey", "run").agg(F.count(F.lit(1)).alias("rows"))


@query(f"SELECT l_orderkey, {_LINES_SQL}, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {_LINES_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM lineitem")
def row_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE, "l_quantity")
    return ordered.running_before(rows, ["l_orderkey"], _LINE, "l_quantity", "top").drop("l_quantity")


@query(f"""SELECT l_orderkey, {_LINES_SQL}, CASE WHEN lead(l_quantity) OVER w IS NULL OR l_quantity >= lead(l_quantity) OVER w THEN l_quantity ELSE lead(l_quantity) OVER w END AS below,
  CASE WHEN lag(l_quantity) OVER w IS NULL THEN l_quantity WHEN lag(l_quantity) OVER w >= l_quantity THEN lag(l_quantity) OVER w ELSE l_quantity END AS above
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINES_SQL})""")
def border_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE)
    own = F.col("l_quantity")
    above, below = F.lag(own).over(w), F.lead(own).over(w)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE, ordered.stronger_border(own, below).alias("below"), F.coalesce(ordered.stronger_border(above, own), own).alias("above"))


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents),
c AS (SELECT doc_id, list_sum(list_transform(list_filter(string_split(p, ''), lambda x: x <> ''), lambda x: 512 + 64 * (unicode(x) % 17))) AS w FROM p)
SELECT doc_id, count(*) AS paragraphs, coalesce(sum(w), 0)::BIGINT AS width_units, coalesce(max(w), 0)::BIGINT AS widest FROM c GROUP BY 1""")
def word_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of paragraphs in the synthetic face, folded within a row: no row for each character, no shuffle."""
    widths = F.transform(F.split("text", "\n"), text.width_units)
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", widths.alias("w"))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    return own.select("doc_id", F.size("w").cast("long").alias("paragraphs"), total.alias("width_units"), F.array_max("w").alias("widest"))


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents),
c AS (SELECT doc_id, p, length(p) - length(replace(p, ' ', '')) AS gaps, coalesce(list_sum(list_transform(list_filter(string_split(p, ''), lambda x: x <> ''), lambda x: 512 + 64 * (unicode(x) % 17))), 0) AS w FROM p)
SELECT doc_id, count(*) FILTER (gaps > 0 AND w < 92160) AS justified, coalesce(max(floor((92160 - w) / gaps)) FILTER (gaps > 0 AND w < 92160), 0)::BIGINT AS widest_share FROM c GROUP BY 1""")
def justify_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each gap of a paragraph of one line gets when the line is spread over the room."""
    parts = F.transform(F.split("text", "\n"), lambda p: F.struct((F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit("")))).alias("gaps"), text.width_units(p).alias("w")))
    fit = F.filter(parts, lambda p: (p["gaps"] > 0) & (p["w"] < ROOM))
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", fit.alias("fit"))
    shares = F.transform("fit", lambda p: F.floor((F.lit(ROOM) - p["w"]) / p["gaps"]))
    return own.select("doc_id", F.size("fit").cast("long").alias("justified"), F.coalesce(F.array_max(shares), F.lit(0)).cast("long").alias("widest_share"))


@query()
def greedy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each paragraph. A fold that SQL would take a step a word for: held against brute force in the tests."""
    laid = lines.lay_out(table(spark, sf_dir, "documents"), "doc_id", "text", ROOM, PAGE_LINES)
    return laid.groupBy("doc_id", "p_idx").agg(F.count(F.lit(1)).alias("n_lines"), F.max("width_units").alias("widest"))


@query("""WITH b AS (SELECT user_id, floor(value) AS l, floor(value) + event_id % 9 + 1 AS r FROM events WHERE value < 300),
c AS (SELECT user_id, greatest(l, 0) AS l, least(r, 300) AS r FROM b),
m AS (SELECT user_id, l, r, coalesce(max(r) OVER (PARTITION BY user_id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM c WHERE l < r)
SELECT user_id, reached AS span_left, l AS span_right FROM m WHERE l > reached
UNION ALL SELECT user_id, max(r), 300 FROM c WHERE l < r GROUP BY user_id HAVING max(r) < 300""")
def free_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.floor("value").cast("double")
    bands = table(spark, sf_dir, "events").where("value < 300").select("user_id", left.alias("l0"), (left + F.col("event_id") % 9 + 1).alias("r0"))
    return intervals.free_spans(bands, ["user_id"], "l0", "r0", 0.0, 300.0)


@query("""WITH i AS (SELECT l_orderkey, l_partkey * 100 + l_linenumber AS n, epoch(l_shipdate)::BIGINT // 86400 AS s, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS e FROM lineitem)
SELECT a.l_orderkey, count(*) AS overlaps, max(least(a.e, b.e) - greatest(a.s, b.s)) AS most FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.n < b.n AND a.s < b.e AND b.s < a.e GROUP BY 1""")
def line_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("n"), day.alias("s"), (day + F.col("l_quantity").cast("long")).alias("e"))
    return intervals.overlaps(rows, ["l_orderkey"], "n", "s", "e").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("overlaps"), F.max("shared").alias("most"))


_PAGES_SQL = """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p_idx FROM documents),
n AS (SELECT doc_id, p_idx, greatest(1, (length(p) + 79) // 80) AS lines FROM p),
a AS (SELECT *, sum(lines) OVER (PARTITION BY doc_id ORDER BY p_idx ROWS UNBOUNDED PRECEDING) - lines AS before FROM n),
g AS (SELECT doc_id, p_idx, lines, (before // 46)::BIGINT AS first_page, ((before + lines - 1) // 46)::BIGINT AS last_page FROM a) """


def _paragraph_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p_idx", "p"))
    counted = own.select("doc_id", "p_idx", F.greatest(F.lit(1), F.floor((F.length("p") + 79) / 80)).alias("lines"))
    placed = ordered.running_before(counted, ["doc_id"], ["p_idx"], "lines", "before")
    page = lambda c: F.floor(c / PAGE_LINES)
    return placed.select("doc_id", "p_idx", "lines", page(F.col("before")).alias("first_page"), page(F.col("before") + F.col("lines") - 1).alias("last_page"))


@query(_PAGES_SQL + "SELECT doc_id, max(last_page) + 1 AS pages, sum(lines)::BIGINT AS lines, count(*) FILTER (last_page > first_page) AS split FROM g GROUP BY 1")
def pages_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _paragraph_pages(spark, sf_dir)
    return placed.groupBy("doc_id").agg((F.max("last_page") + 1).alias("pages"), F.sum("lines").alias("lines"), F.count_if(F.col("last_page") > F.col("first_page")).alias("split"))


@query(_PAGES_SQL + "SELECT doc_id, first_page AS page, min(p_idx)::INT AS p_idx FROM g GROUP BY 1, 2")
def page_first_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paragraph that begins on each page."""
    return _paragraph_pages(spark, sf_dir).groupBy("doc_id", F.col("first_page").alias("page")).agg(F.min("p_idx").alias("p_idx"))


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events""")
def section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last section that opens at or before each row."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("section"))
    return cascade.forward_filled(rows, ["user_id"], ["ts", "event_id"], ["section"]).drop("ts")


@query("""WITH s AS (SELECT conv_id, turn, role, CASE WHEN role = 'system' OR turn % 3 = 0 THEN 1 END AS said, CASE WHEN role <> 'system' AND turn % 3 = 0 THEN length(text) END AS header FROM conversations)
SELECT conv_id, turn, last_value(CASE WHEN said = 1 THEN struct_pack(v := header) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)['v'] AS header FROM s""")
def header_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header that a section states, none included, holds until the next that states one."""
    third = F.col("turn") % 3 == 0
    header = F.when((F.col("role") == "system") | third, cascade.stated(F.when((F.col("role") != "system") & third, F.length("text").cast("long"))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", header.alias("header"))
    return cascade.forward_filled(rows, ["conv_id"], ["turn"], ["header"]).select("conv_id", "turn", F.col("header.value").alias("header"))


_INK = "abs(floor(v * 1000))::BIGINT"
_GRID_SQL = f"""WITH px AS (SELECT label, vec_id AS y, generate_subscripts(embedding, 1) - 1 AS x, unnest(embedding) AS v FROM embeddings),
g AS (SELECT label % 5 AS doc, label AS page, x // 12 AS col, y // 12 AS row, sum({_INK})::BIGINT AS ink, count(*) AS n FROM px WHERE y % 2 = 0 GROUP BY ALL),
h AS (SELECT label % 5 AS doc, label AS page, x // 12 AS col, y // 12 AS row, sum({_INK})::BIGINT AS ink, count(*) AS n FROM px WHERE y % 2 = 1 GROUP BY ALL),
d AS (SELECT doc, page, count(*) FILTER (coalesce(g.ink, 0) > 100 OR coalesce(h.ink, 0) > 100) AS interesting,
  count(*) FILTER ((coalesce(g.ink, 0) > 100 OR coalesce(h.ink, 0) > 100) AND abs(coalesce(g.ink, 0) - coalesce(h.ink, 0)) > 500) AS differing
  FROM g FULL JOIN h USING (doc, page, col, row) GROUP BY ALL) """


def _grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors as rows of pixels, labels as pages; even rows are ours, odd ones theirs."""
    px = table(spark, sf_dir, "embeddings").select((F.col("label") % 5).alias("doc"), F.col("label").alias("page"), F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v"))
    px = px.withColumn("ink", F.abs(F.floor(F.col("v") * F.lit(1000).cast("float"))))
    ours, theirs = (corpus.grid_of(px.where(F.col("y") % 2 == k), ["doc", "page"], "x", "y", "ink", 12) for k in (0, 1))
    return ours, theirs


@query(_GRID_SQL + "SELECT * FROM g")
def raster_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, sf_dir)[0]


@query(_GRID_SQL + "SELECT * FROM d")
def grid_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.grid_difference(*_grids(spark, sf_dir), ["doc", "page"], 100, 500)


@query(_GRID_SQL + """SELECT doc, coalesce(max(CASE WHEN interesting >= 60 THEN differing / interesting END), CASE WHEN sum(interesting) = 0 THEN 0.0 ELSE sum(differing) / sum(interesting) END) AS worst FROM d GROUP BY doc""")
def worst_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.worst_page(corpus.grid_difference(*_grids(spark, sf_dir), ["doc", "page"], 100, 500), "doc", 60)


@query("SELECT l_suppkey, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS middle FROM lineitem GROUP BY 1")
def median_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(ordered.upper_median("l_extendedprice").alias("middle"))


@query("SELECT l_suppkey, round(coalesce(regr_slope(l_extendedprice, l_quantity), 0), 4) AS drift FROM lineitem GROUP BY 1")
def drift_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.coalesce(F.regr_slope("l_extendedprice", "l_quantity"), F.lit(0.0)), 4).alias("drift"))


@query(f"""SELECT l_suppkey, count(*) FILTER (under) AS crossings FROM (SELECT l_suppkey, max(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, {_LINES_SQL} ROWS UNBOUNDED PRECEDING) - l_quantity > 3 AS under FROM lineitem) GROUP BY 1""")
def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.crossings(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", *_LINE], "l_quantity", 3)


@query("""WITH s AS (SELECT l_orderkey, max(l_discount * 40) AS worst, count(*) AS n, avg(CASE WHEN l_tax < 0.06 THEN 1 ELSE 0 END) AS near, avg(CASE WHEN l_quantity < 45 THEN 1 ELSE 0 END) AS kept FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN worst <= 3 THEN 'agrees' WHEN n < 3 OR near >= 0.95 THEN 'shifted' WHEN kept >= 0.95 THEN 'drifting' ELSE 'deformed' END AS shape FROM s""")
def page_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1).otherwise(0))
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_discount") * 40).alias("worst"), F.count(F.lit(1)).alias("n"), share(F.col("l_tax") < 0.06).alias("near"), share(F.col("l_quantity") < 45).alias("kept"))
    return own.select("l_orderkey", corpus.page_shape(F.col("worst"), F.col("n"), F.col("near"), F.col("kept")).alias("shape"))


@query("""WITH c AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 73) % 256 AS g, (p_partkey * 151) % 256 AS b FROM part),
m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM c)
SELECT p_partkey, printf('%02X%02X%02X', r, g, b) AS rgb, round((hi + lo) / 510.0, 6) AS luminance, round(CASE WHEN hi = lo THEN 0 ELSE ((hi - lo) / 255.0) / (1 - abs((hi + lo) / 255.0 - 1)) END, 6) AS saturation,
  printf('%02X%02X%02X', floor(r * 0.75 + (255 - r) * 0.25 + 0.5)::INT, floor(g * 0.75 + (255 - g) * 0.25 + 0.5)::INT, floor(b * 0.75 + (255 - b) * 0.25 + 0.5)::INT) AS blended FROM m""")
def theme_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda c: F.lpad(F.hex(c), 2, "0")
    rgb = F.concat(*(pair(F.col("p_partkey") * k % 256) for k in (37, 73, 151)))
    inverse = F.concat(*(pair(F.lit(255) - F.col("p_partkey") * k % 256) for k in (37, 73, 151)))
    own = table(spark, sf_dir, "part").select("p_partkey", rgb.alias("rgb"), inverse.alias("inverse"))
    hsl = colour.to_hsl(F.col("rgb"))
    return own.select("p_partkey", "rgb", F.round(hsl["luminance"], 6).alias("luminance"), F.round(hsl["saturation"], 6).alias("saturation"), colour.blend(F.col("rgb"), F.col("inverse"), F.lit(0.25)).alias("blended"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 72.0 + p_retailprice / 20 WHEN 1 THEN 72.0 + (468 - p_size) / 2.0 WHEN 2 THEN 72.0 + 468 - p_size ELSE p_retailprice / 20 END AS left_pt,
  floor(p_retailprice * 300 / 72 + 0.5) * 72 / 300 AS on_grid FROM part""")
def float_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anchored object's left edge: offset from the margin, centred, at the right, offset from the page."""
    kind, offset, size = F.col("p_partkey") % 4, units.twips_to_points(F.col("p_retailprice")), F.col("p_size")
    left = F.when(kind == 0, F.lit(72.0) + offset).when(kind == 1, F.lit(72.0) + (F.lit(468) - size) / 2).when(kind == 2, F.lit(72.0) + 468 - size).otherwise(offset)
    return table(spark, sf_dir, "part").select("p_partkey", left.alias("left_pt"), units.on_device_grid(F.col("p_retailprice")).alias("on_grid"))


@query("""WITH c AS (SELECT p_partkey, 1 AS rank, (p_partkey * 7) % 200 AS face FROM part UNION ALL SELECT p_partkey, 2, p_partkey % 50 FROM part UNION ALL SELECT p_partkey, 3, 0 FROM part)
SELECT p_partkey, arg_min(face, rank) AS face, min(rank) AS rank FROM c JOIN supplier ON face = s_suppkey GROUP BY 1""")
def substitution_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a part's candidate faces that is supplied: candidates exploded by rank, the least rank that joins."""
    n = F.col("p_partkey")
    asked = table(spark, sf_dir, "part").select(n, F.posexplode(F.array(n * 7 % 200, n % 50, F.lit(0).cast("long"))).alias("rank", "face"))
    found = asked.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("face")), "face")
    return found.groupBy("p_partkey").agg(F.min_by("face", "rank").alias("face"), (F.min("rank") + 1).alias("rank"))


@query(f"SELECT l_orderkey, {_LINES_SQL}, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, {_LINES_SQL})::INT AS z FROM lineitem")
def z_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE, "l_quantity")
    return corpus.ranked(rows, ["l_orderkey"], [F.col("l_quantity"), *map(F.col, _LINE)], "z").drop("l_quantity")


@query()
def covering_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few pages that have every tag three times, as often as there are pages that have it. Greedy: held against brute force."""
    census = corpus.feature_census(table(spark, sf_dir, "pages"), "page_id", "html")
    taken = corpus.covering_documents(census)
    return spark.createDataFrame([(i, int(k), len(f)) for i, (k, f) in enumerate(taken)], "step int, page_id long, features int")


@query("""SELECT d.doc_id, substr(sha256(d.text), 1, 12) AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def documents_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have no row in the other table yet."""
    done = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").join(done, "doc_id", "left_anti").select("doc_id", text.identity_of(F.encode("text", "UTF-8")).alias("id"))


@query("""SELECT l_shipdate IS NOT NULL AS swept, l_returnflag AS outcome, count(*) AS documents, count(*) FILTER (l_discount > 0.05) AS stood_in, sum(l_linenumber)::BIGINT AS pages FROM lineitem GROUP BY ALL""")
def sweep_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("swept", F.col("l_shipdate").isNotNull()).withColumnRenamed("l_returnflag", "outcome")
    return rows.groupBy("swept", "outcome").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("l_discount") > 0.05).alias("stood_in"), F.sum("l_linenumber").alias("pages"))


@query("""SELECT o.o_orderkey, coalesce(c.c_mktsegment, 'none') AS level, CASE WHEN o.o_custkey % 3 = 0 THEN 1 ELSE n.n_regionkey END AS start FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def level_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins with replacement: a row's own start beats what its level and the level's list state."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("level"), cascade.merged(F.col("n_regionkey"), F.when(F.col("o_custkey") % 3 == 0, 1)).alias("start"))


@query("""WITH d AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM d WHERE rank = 1""")
def worst_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst row of each document: an aggregate, so that no window sorts whole groups."""
    worst = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("n"))).alias("w")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(worst).select("o_custkey", (-F.col("w.n")).alias("o_orderkey"), F.col("w.o_totalprice").alias("o_totalprice"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def worst_forty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's forty worst rows."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40)


@query("""SELECT doc_id, length(replace(replace(text, ' ', ''), chr(10), '')) AS ink, upper(split_part(trim(text), ' ', 1)) IN ('PAGE', 'NUMPAGES', 'SECTIONPAGES', 'PAGEREF') AS recomputed FROM documents""")
def story_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink = F.length(F.replace(F.replace("text", F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", ink.alias("ink"), text.recomputed_page_field(F.col("text")).alias("recomputed"))
