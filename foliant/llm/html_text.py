"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of start tags, texts and end tags; missing end tags are supplied, so that brackets match. Adjacent
elements (or runs of elements) that repeat become a repeated group. Two streams are aligned level by level: what both
have is matched and aligned in turn, what only one has becomes an optional group, and texts become slots. Aligning all
streams of a host gives its wrapper. Streams that are equal after repeats are folded count once, and a host's streams
are aligned in parts of a bounded size, whose wrappers are aligned in parts again until one is left.

Then all pages are held against their wrapper, and each slot's texts are counted: how many, how many different, how much
of them in links. The counts give a slot its role: what hardly varies among the pages of a host is its template, however
it is tagged; what is mostly links is a menu. Of what is left a page's article is the part that its elements say, or
where most of its text is. Words of classes break ties only: they decide where counts and elements have nothing to say.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, hot_keys, join_on, text_or_empty

#: Streams that a task aligns, about; siblings in a repeated run, and bytes of wrappers sent to all tasks, at most.
PART, RUN, MOST_BYTES = 256, 6, 32_000_000
#: A slot is a template's if at least so many texts have at most this share of different ones, relative to the slot that varies most; outside an article, a menu's at that share of links.
TEMPLATE_TEXTS, TEMPLATE_SHARE, LINK_SHARE = 5, 0.2, 0.6
#: A container with this share of what its parent has is where the article is.
REGION = 0.75
#: Elements that are nested deeper are put beside each other there, as browsers do; levels with more pairs of siblings are aligned from left to right.
DEPTH, MOST_PAIRS = 128, 250_000

# Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {"script", "style", "head", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "noembed", "noframes"}
BESIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "textarea", "fieldset", "datalist"}
#: An element closes open ones of its set, up to the given parents.
CLOSES = {
    "p": ({"p"}, set()), "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
}
CLOSE_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
CONTAINERS = {"html", "body", "div", "section", "main", "article", "center", "table", "tbody", "tr", "td"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class, id and role that say what isn't the article.
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notices?|alert|newsletter|subscri\w*|popup|modal|sidebar|side|menu|breadcrumbs?|nav|navbar|navigation|pager|pagination|"
    r"share|sharing|social|related|recommend\w*|comments?|repl(?:y|ies)|disqus|footer|masthead|copyright|legal|login|signup|search|widget\w*|toolbar|skip|complementary|contentinfo|banner)(?:$|[\s_-])", re.I
)
MAIN = re.compile(r"^(?:article|main)(?:\.|$)|\.(?:main|article|post|entry)(?:-?(?:content|body|text))?(?:\.|$)")

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|$)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Element:
    """label: the tag's name and its class, id and role; children: elements, and texts as (text, in a link)."""

    __slots__ = ("children", "label", "name")

    def __init__(self, name: str, label: str):
        self.name, self.label, self.children = name, label, []


def label_of(name: str, attributes: str) -> str:
    words = sorted({w for m in _NAMES.finditer(attributes) for w in re.sub(r"\d+", "", m[2] or m[3] or m[4] or "").lower().split()}) if "=" in attributes else []
    return ".".join([name, *words])


def parse(page: str) -> Element:
    """Brackets of block elements with texts; inline tags leave no bracket, br leaves a blank."""
    root = Element("", "")
    open_: list[Element] = [root]
    at = links = 0

    def add(text: str) -> None:
        if text:
            open_[min(len(open_) - 1, DEPTH)].children.append((html.unescape(text), links > 0))

    def close(names: set[str], until: set[str]) -> None:
        i = len(open_) - 1
        while i > 0:
            if open_[i].name in names:
                del open_[i:]
            elif open_[i].name in until or (not until and open_[i].name not in INLINE and open_[i].name != "p"):
                return
            i -= 1

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name == "a":
            links = max(0, links + (-1 if m[1] else 1))
        if name in INLINE:
            if name == "br":
                add(" ")
            continue
        if m[1]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].name == name:
                    del open_[i:]
                    links = 0
                    break
            continue
        if name in CLOSE_P:
            close({"p"}, set())
        if name in CLOSES and name != "p":
            close(*CLOSES[name])
        own = Element(name, label_of(name, m[3]))
        open_[min(len(open_) - 1, DEPTH)].children.append(own)
        links = 0
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|$)", re.I).search(page, at)
            own.children.append((page[at : end.start() if end else len(page)], False))
            at = end.end() if end else len(page)
        elif name not in VOID and not m[3].endswith("/"):
            open_.append(own)
    return root


# Wrappers. An item is [label, optional, repeated, items]: a text slot has the label "#", a repeated run of siblings "()".


def labels(items: list) -> tuple:
    return tuple(i[0] if i[0] != "()" else labels(i[3]) for i in items)


def fold(items: list) -> list:
    """Adjacent runs of siblings with the same labels become one repeated item."""
    for width in range(1, RUN + 1):
        out, i = [], 0
        names = labels(items)
        while i < len(items):
            run, j = items[i : i + width], i + width
            if len(run) == width and (width == 1 or len(set(names[i:j])) > 1):
                while j + width <= len(items) and names[j : j + width] == names[i : i + width]:
                    run, j = [merged(a, b) for a, b in zip(run, items[j : j + width], strict=True)], j + width
            if len(run) == width and j > i + width:
                out.append([run[0][0], run[0][1], True, run[0][3]] if width == 1 else ["()", False, True, run])
                i = j
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def merged(a: list, b: list) -> list:
    """Two items with the same label."""
    return [a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3])]


def runs_as(items: list, other: list) -> list:
    """Runs of items that are a repeated run of the other side become such a run."""
    for group in (o for o in other if o[0] == "()"):
        names, width = labels(group[3]), len(group[3])
        out, i = [], 0
        while i < len(items):
            if labels(items[i : i + width]) == names:
                out.append(["()", False, True, items[i : i + width]])
                i += width
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def align(a: list, b: list) -> list:
    """What both have, in order, is matched (as much as can be); the rest is optional."""
    if a == b:
        return a
    a, b = runs_as(a, b), runs_as(b, a)
    x, y = [str(n) for n in labels(a)], [str(n) for n in labels(b)]
    if len(x) * len(y) > MOST_PAIRS:
        return fold(beside(a, b, x, y))
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], True, *b[j][2:]])
            j += 1
    return fold(out)


def beside(a: list, b: list, x: list[str], y: list[str]) -> list:
    """align() from left to right: each label of x is matched with its next place in y."""
    places: dict[str, list[int]] = {}
    for j, name in enumerate(y):
        places.setdefault(name, []).append(j)
    out, j = [], 0
    for i, name in enumerate(x):
        own = places.get(name, [])
        k = bisect_left(own, j)
        if k < len(own):
            out += [[b[n][0], True, *b[n][2:]] for n in range(j, own[k])]
            out.append(merged(a[i], b[own[k]]))
            j = own[k] + 1
        else:
            out.append([a[i][0], True, *a[i][2:]])
    return out + [[b[n][0], True, *b[n][2:]] for n in range(j, len(y))]


def skeleton(element: Element) -> list:
    """The items of an element's children, repeats folded."""
    out: list = []
    for c in element.children:
        if isinstance(c, tuple):
            if c[0].strip() and not (out and out[-1][0] == "#"):
                out.append(["#", False, False, []])
        elif c.name not in UNSEEN:
            out.append([c.label, False, False, skeleton(c)])
    return fold(out)


def flat(items: list, start: int = 0) -> list[tuple[str, list, int]]:
    """(label, item, place that a repeated run goes back to or -1)."""
    out: list[tuple[str, list, int]] = []
    for i in items:
        if i[0] == "()":
            back = start + len(out)
            out += [(n, k, back) for n, k, _ in flat(i[3], back)]
        else:
            out.append((i[0], i, -1))
    return out


class Wrapper:
    """slots: for each text slot, the labels above it. kinds: what they say, see kind_of()."""

    def __init__(self, items: list):
        self.slots: list[tuple[str, ...]] = []
        self.levels: dict[int, list[tuple[str, list, int]]] = {}
        self.number: dict[int, int] = {}
        self.items = items
        self._walk(items, ())
        self.kinds = [kind_of(above) for above in self.slots]

    def _walk(self, items: list, above: tuple[str, ...]) -> None:
        level = self.levels[id(items)] = flat(items)
        for name, item, _ in level:
            if name == "#":
                self.number[id(item)] = len(self.slots)
                self.slots.append(above)
            else:
                self._walk(item[3], (*above, name))

    def texts(self, page: Element) -> Iterator[tuple[int, tuple[Element, ...], str, bool]]:
        """(slot or -1, elements above, text, in a link) for each text of a page, (-2, ...) between blocks, (-3, ...) for blanks."""
        yield from self._texts(page, self.items, ())

    def _texts(self, element: Element, items: list | None, above: tuple[Element, ...]) -> Iterator[tuple[int, tuple[Element, ...], str, bool]]:
        level = self.levels[id(items)] if items is not None else []
        at = 0
        for c in element.children:
            name = "#" if isinstance(c, tuple) else c.label
            if name == "#" and not c[0].strip():
                yield (-3, above, c[0], c[1])
                continue
            if name != "#" and c.name in UNSEEN:
                continue
            found = next((k for k in range(at, len(level)) if level[k][0] == name), None)
            if found is None and at < len(level) and level[at][2] >= 0:
                found = next((k for k in range(level[at][2], at) if level[k][0] == name), None)
            item = None
            if found is not None:
                at, item = found, level[found][1]
            if name == "#":
                yield (self.number[id(item)] if item is not None else -1, above, *c)
            else:
                yield (-2, above, "", False)
                yield from self._texts(c, item[3] if item is not None else None, (*above, c))
                yield (-2, above, "", False)


OUTSIDE, WORDED, NEITHER, WRAPPED, ARTICLE = range(5)


def kind_of(above: tuple[str, ...]) -> int:
    """What elements and classes say of a text by the labels above it. OUTSIDE: menus, footers, forms and so on by their
    elements, and headers, but for the headings within an article; what classes call by such names inside an article too.

    What a class says of html, body and what is around an article may be meant for their other parts (has-sidebar). So
    html and body are not looked at, and an article in a wrapper of that kind is WRAPPED: it counts if there's no other.
    Without an article, a text whose classes have such names is WORDED: it counts if there's nothing else.
    """
    first = next((i for i, n in enumerate(above) if MAIN.search(n)), len(above))
    kind = ARTICLE if first < len(above) else NEITHER
    for i, n in enumerate(above):
        name, _, words = n.partition(".")
        if name in BESIDE:
            return OUTSIDE
        if words and name not in ("html", "body") and ASIDE_WORDS.search(words.replace(".", " ")):
            if i >= first:
                return OUTSIDE
            kind = WORDED if kind in (NEITHER, WORDED) else WRAPPED
        if name == "header" and not (i >= first and any(x.partition(".")[0] in HEADINGS for x in above[i:])):
            return OUTSIDE
    return kind


def content_slots(wrapper: Wrapper, counts: dict[int, tuple[int, int, int, int]]) -> list[int]:
    """Slots that may hold a page's article. counts: slot: texts, different ones, characters, characters in links.

    Copies of pages make all slots vary less, so a slot is held against the one that varies most.
    """
    varying = max((different / n for n, different, *_ in counts.values() if n >= TEMPLATE_TEXTS), default=1.0)
    out = []
    for slot, kind in enumerate(wrapper.kinds):
        n, different, chars, linked = counts.get(slot, (0, 0, 0, 0))
        template = n >= TEMPLATE_TEXTS and different <= TEMPLATE_SHARE * varying * n
        menu = kind < WRAPPED and linked > LINK_SHARE * chars
        if kind != OUTSIDE and not template and not menu:
            out.append(slot)
    return out


def region_of(texts: list[tuple[tuple[Element, ...], str]]) -> Element | None:
    """The innermost container that has most of the texts, going down from the page; None: the page."""
    here: Element | None = None
    depth = 0
    while True:
        total = sum(len(t) for _, t in texts)
        chars: dict[Element, int] = {}
        direct: dict[Element, int] = {}
        for above, t in texts:
            if len(above) > depth:
                chars[above[depth]] = chars.get(above[depth], 0) + len(t)
                if len(above) == depth + 1:
                    direct[above[depth]] = direct.get(above[depth], 0) + len(t)
        best = max(chars, key=chars.__getitem__, default=None)
        if best is None or best.name not in CONTAINERS or chars[best] < REGION * total or 2 * direct.get(best, 0) > chars[best]:
            return here
        here, texts = best, [(above, t) for above, t in texts if len(above) > depth and above[depth] is best]
        depth += 1


def main_text(page: Element, wrapper: Wrapper, content: set[int]) -> str:
    """Blocks joined by an empty line. Each page has its own best kind of text, whatever other pages of its host have;
    without an article it is where most of the page's content is, with the headings before it.

    A text that the wrapper has no slot for is judged by its elements and classes alone.
    """
    found = []
    for slot, above, text, _ in wrapper.texts(page):
        kind = slot
        if slot >= -1:
            kind = wrapper.kinds[slot] if slot >= 0 else kind_of(tuple(e.label for e in above))
            kind = kind if slot < 0 or slot in content else OUTSIDE
        found.append((kind, above, text))
    best = max((kind for kind, *_ in found), default=NEITHER)
    region = region_of([(above, text) for kind, above, text in found if kind == best]) if WORDED <= best < WRAPPED else None
    started = region is None
    blocks: list[str] = []
    own: list[str] = []
    for kind, above, text in found:
        if kind == -2:
            if own:
                blocks.append("".join(own))
                own = []
        elif kind == -3:
            if own:
                own.append(" ")
        elif kind == best:
            inside = region is None or region in above
            started = started or inside
            if inside or (not started and any(e.name in HEADINGS for e in above)):
                own.append(text)
    blocks.append("".join(own))
    return "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


# Spark's side


def host_of(url: str) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("")))


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, own = [], []
        seen = set()
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = json.dumps(skeleton(parse(page.as_py())))
            if (host, s) not in seen:
                seen.add((host, s))
                hosts.append(host)
                own.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(own, pa.string())], ["host", "items"])


def _align(table: pa.Table) -> pa.Table:
    """All rows of a group (host, ...) to one: host, items. Sorted, so that the result doesn't depend on the order of rows."""
    streams = sorted(table.column("items").to_pylist(), key=lambda s: (-len(s), s))
    items = json.loads(streams[0])
    for s in streams[1:]:
        items = align(items, json.loads(s))
    return pa.table({"host": pa.array([table.column("host")[0].as_py()], pa.string()), "items": pa.array([json.dumps(items)], pa.string())})


class Found:
    """Wrappers by host for a task: from a broadcast, or from a column of the rows."""

    def __init__(self, held):
        self.held, self.known = held, {}

    def of(self, batch: pa.RecordBatch, column: str) -> Iterator[tuple[Wrapper, set[int]]]:
        rows = batch.column("host").to_pylist() if self.held is not None else zip(batch.column("items").to_pylist(), batch.column(column).to_pylist() if column else [None] * batch.num_rows, strict=True)
        for key in rows:
            data, content = self.held.value[key] if self.held is not None else key
            at = key if self.held is not None else data
            if at not in self.known:
                if len(self.known) > 2000:
                    self.known.clear()
                self.known[at] = (Wrapper(json.loads(data)), set(content or ()))
            yield self.known[at]


def _slot_counts(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(held)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for host, page, (wrapper, _) in zip(batch.column("host").to_pylist(), batch.column("html"), found.of(batch, ""), strict=True):
                for slot, _, text, linked in wrapper.texts(parse(page.as_py())):
                    if slot >= 0:
                        for c, v in zip(cols, (host, slot, xxhash.xxh3_64_intdigest(text.strip()) >> 1, len(text), len(text) if linked else 0), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["host", "slot", "text", "chars", "linked"])

    return run


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for data, counts in zip(batch.column("items").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            out.append(content_slots(Wrapper(json.loads(data)), {c["slot"]: (c["n"], c["different"], c["chars"], c["linked"]) for c in counts or []}))
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("items"), pa.array(out, pa.list_(pa.int32()))], ["host", "items", "content"])


def _extract(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(held)
        for batch in batches:
            texts = [main_text(parse(p.as_py()), wrapper, content) for p, (wrapper, content) in zip(batch.column("html"), found.of(batch, "content"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def wrappers(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, items, content) of rows (page_id, url, host, html)."""
    found = scratch.table(pages.select("host", "html").mapInArrow(_skeletons, "host string, items string").distinct(), "streams-0")
    for k in range(1, 64):
        counts = found.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        if most <= PART:
            parts = found.withColumn("part", F.lit(0))
        else:  # hosts with many streams are spread over tasks; the counts are few and small
            parts = found.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("items", F.lit(k)), F.ceil(F.col("n") / PART).cast("long"))).drop("n")
        found = scratch.table(parts.groupBy("host", "part").applyInArrow(lambda t: _align(t), "host string, items string").distinct(), f"streams-{k}")
    texts = with_wrapper(pages, found, _slot_counts, "host string, slot int, text long, chars long, linked long")
    texts = texts.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    counts = texts.groupBy("host", "slot").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    counts = counts.groupBy("host").agg(F.collect_list(F.struct("slot", "n", "different", "chars", "linked")).alias("counts"))  # a wrapper's slots
    kinds = "host string, items string, content array<int>"
    return scratch.table(found.join(counts, "host", "left").select("host", "items", "counts").mapInArrow(_contents, kinds), "contents")


def with_wrapper(pages: DataFrame, found: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run() over pages. Wrappers are sent to all tasks once if their size, which is looked up first, allows it; else pages go to them by host."""
    size = found.agg(F.sum(F.octet_length("items"))).first()[0] or 0
    if size <= MOST_BYTES:
        held = {r.host: (r.items, r.content if "content" in found.columns else None) for r in found.toLocalIterator()}
        return pages.mapInArrow(run(pages.sparkSession.sparkContext.broadcast(held)), schema)
    return join_on(pages, found, ["host"], hot_keys(pages, ["host"])).mapInArrow(run(None), schema)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars.

    A null page is empty and has an empty text. Pages without a host in their url are those of one host. Repeated rows
    give the same text. No-break spaces and the like count as white space. Other columns of pages are not looked at.
    """
    scratch = Scratch(pages.sparkSession, "html")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), text_or_empty(html_col).alias("html"))
    found = wrappers(own, scratch)
    kinds = f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, text string"
    out = with_wrapper(own, found, _extract, kinds)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
