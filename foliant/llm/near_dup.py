"""Near-duplicate classes: BagMinHash signatures of the multisets of WORDS-word shingles, bands, and verified overlap.

A multiset is a weight for each shingle: its count. The weighted Jaccard similarity of two is the sum of the lesser
weights over the sum of the greater. BagMinHash draws, for every shingle, points of a Poisson process over (weight,
time), the same for every document. The weights are cut at 1, 2, 4, 8, ...: each level has a process of its own, whose
rate is the level's width, and a shingle takes part with the levels below its weight; in the level that its weight lies
in, with the points below its weight. Each point falls on one of SIZE registers, which keeps its earliest point. Two
documents agree in a register with a probability equal to their similarity.

Links between different texts are found without emitting the pairs of a group. Each bucket of a band has a head, the
member that meets most others in all its buckets (the text that the others are copies of, if it is there). Each text is
held against the head that its signature agrees with best; what these links join is a class. Then members of a bucket
that are still in different classes are held against each other in blocks, first by their signatures, then by their
shingles, within the task: it emits a link only if it joins two classes, so never more links than it has members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, hot_keys, join_on, numbered, text_or_empty, without

WORDS, SIMILAR = 5, 0.8
#: Registers of a signature; rows of a band. A pair at SIMILAR shares no band with probability (1 - 0.8^4)^32 = 5e-8.
SIZE, ROWS = 128, 4
#: Pairs whose signatures agree in a smaller share than this aren't held against each other: at SIMILAR the chance is 2e-5.
AGREE = 0.65
#: Members of a bucket's block.
BLOCK = 1000
#: Points drawn at once for a document, at least; names of documents that are sent to all tasks, at most.
DRAWN, MOST_NAMES = 700, 1_000_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


class Words:
    """64-bit hashes of words, remembered by a worker."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if len(self.known) > 500_000:
            self.known.clear()
        known = self.known
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their counts. A shorter text is one shingle; an empty one has none."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(words, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = mixed(h * _M1 + hashes[j : n - k + 1 + j])
    return np.unique(h, return_counts=True)


def bag_min_hash(elements: np.ndarray, weights: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The signature: for each register, 32 bits of the name of its earliest point."""
    names, rates, bounds = [mixed(elements * _M1)], [np.ones(len(elements))], [np.full(len(elements), np.inf)]
    many = np.flatnonzero(weights > 1)
    k = 0
    while len(many):  # level k + 1 is [2^k, 2^(k+1))
        width, w = float(1 << k), weights[many].astype(float) - float(1 << k)
        names.append(mixed(elements[many] * _M1 + np.uint64(k + 1)))
        rates.append(np.full(len(many), width))
        bounds.append(np.where(w >= width, np.inf, w))
        k += 1
        many = many[weights[many] > 1 << k]
    name, rate, bound = np.concatenate(names), np.concatenate(rates), np.concatenate(bounds)
    times, points = np.full(size, np.inf), np.zeros(size, np.uint64)
    at, turn, latest, cut = np.zeros(len(name)), 0, np.inf, bool(np.isfinite(bound).any())
    while len(name):
        turns = np.arange(turn + 1, turn + 1 + max(1, -(-DRAWN // len(name))), dtype=np.uint64)
        turn += len(turns)
        draw = mixed(name[:, None] + turns * _M1)
        t = at[:, None] + np.cumsum(-np.log1p(-(draw >> np.uint64(11)).astype(float) * 2.0**-53), 1) / rate[:, None]
        at = t[:, -1]
        other = mixed(draw ^ _M2)
        use = t < latest
        if cut:
            use &= (other >> np.uint64(32)).astype(float) * 2.0**-32 * rate[:, None] < bound[:, None]
        register, own_t, own_p = (other[use] & np.uint64(0xFFFFFFFF)) % np.uint64(size), t[use], draw[use]
        by = np.argsort(-own_t)  # the earliest is assigned last
        best_t, best_p = np.full(size, np.inf), np.zeros(size, np.uint64)
        best_t[register[by]], best_p[register[by]] = own_t[by], own_p[by]
        better = best_t < times
        times[better], points[better] = best_t[better], best_p[better]
        latest = times.max()
        on = at < latest
        name, rate, bound, at = name[on], rate[on], bound[on], at[on]
    return (points & np.uint64(0xFFFFFFFF)).astype("<u4")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (sorted elements, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / max(1, int(a[1].sum() + b[1].sum()) - least)


def packed(bag: tuple[np.ndarray, np.ndarray]) -> bytes:
    return len(bag[0]).to_bytes(4, "little") + bag[0].astype("<u8").tobytes() + bag[1].astype("<u4").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, "<u8", n, 4), np.frombuffer(data, "<u4", n, 4 + 8 * n).astype(np.int64)


_words = Words()


def bag_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    return shingles(_words.hashes(text.encode("utf-8", "surrogatepass").split()))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, text) to (rid, doc_id, n_shingles, bag_key, signature)."""
    import xxhash

    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            rows = batch.slice(i, 500)
            counts, keys, signatures = [], [], []
            for text in rows.column(2):
                bag = bag_of(text.as_py())
                counts.append(int(bag[1].sum()))
                keys.append(xxhash.xxh3_128_digest(packed(bag)))
                signatures.append(bag_min_hash(*bag).tobytes())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], ["rid", "doc_id", "n_shingles", "bag_key", "signature"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text) to (rid, bag)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            rows = batch.slice(i, 500)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([packed(bag_of(t.as_py())) for t in rows.column(1)], pa.binary())], ["rid", "bag"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, signature) to (bucket, rid), SIZE / ROWS for each document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        s = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(batch.num_rows, SIZE // ROWS, ROWS).astype(np.uint64)
        h = np.broadcast_to(np.arange(SIZE // ROWS, dtype=np.uint64), s.shape[:2])
        for j in range(ROWS):
            h = mixed(h * _M1 + s[:, :, j])
        yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), SIZE // ROWS))], ["bucket", "rid"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, signature_a, signature_b) to (a, b, agree)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, SIZE) for c in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x == y).mean(1))], ["a", "b", "agree"])


def _similar(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([overlap(unpacked(a.as_py()), unpacked(b.as_py())) >= least for a, b in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


GROUPED = "bucket long, low long, high long, rid long, class long, is_low boolean, same boolean, signature binary"


def _by_group(work: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs work on each group of rows that are sorted by (bucket, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = np.stack([held.column(c).to_numpy() for c in ("bucket", "low", "high")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
            for a, b in zip(edges, edges[1:], strict=False):
                yield work(held.slice(a, b - a))
            held = held.slice(edges[-1]).combine_chunks()
        if held is not None:
            yield work(held)

    return run


class Group:
    """Two blocks of a bucket, or one."""

    def __init__(self, rows: pa.Table):
        self.signature = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u4").reshape(-1, SIZE)
        self.rid, self.own = rows.column("rid").to_numpy(), rows.column("class").to_numpy()
        self.low, self.same = rows.column("is_low").to_numpy(zero_copy_only=False), bool(rows.column("same")[0].as_py())

    def candidates(self, i: int, agree: float) -> np.ndarray:
        """Members of another class, each pair once, whose signature agrees enough."""
        if self.same:
            there = np.flatnonzero(self.own[i + 1 :] != self.own[i]) + i + 1
        else:
            there = np.flatnonzero((self.own != self.own[i]) & ~self.low) if self.low[i] else np.zeros(0, np.int64)
        return there[(self.signature[there] == self.signature[i]).mean(1) >= agree] if len(there) else there


def _involved(agree: float) -> Callable[[pa.Table], pa.RecordBatch]:
    """The rows of a group that have a candidate."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        group = Group(rows)
        keep = np.zeros(rows.num_rows, bool)
        for i in range(rows.num_rows):
            found = group.candidates(i, agree)
            if len(found):
                keep[i] = keep[found] = True
        kept = rows.filter(pa.array(keep)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in kept.columns], kept.column_names)

    return work


def _joined(agree: float, least: float) -> Callable[[pa.Table], pa.RecordBatch]:
    """Links between members of a group whose multisets overlap enough, as long as they join two classes."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        group = Group(rows)
        bags = [unpacked(b.as_py()) for b in rows.column("bag")]
        sizes = np.array([len(b[0]) for b in bags])
        totals = np.array([int(b[1].sum()) for b in bags])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        elements, counts = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while up.get(c, c) != c:
                c = up[c]
            return c

        a, b = [], []
        for i in range(len(bags)):
            found = group.candidates(i, agree)
            mine = root(int(group.own[i]))
            found = np.array([j for j in found.tolist() if root(int(group.own[j])) != mine], np.int64)
            if not len(found):
                continue
            at = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in found])
            place = np.minimum(np.searchsorted(bags[i][0], elements[at]), sizes[i] - 1)
            shared = np.where(bags[i][0][place] == elements[at], np.minimum(bags[i][1][place], counts[at]), 0)
            both = np.add.reduceat(shared, np.concatenate([[0], np.cumsum(sizes[found])[:-1]]))
            for j in found[both >= least * (totals[i] + totals[found] - both)].tolist():
                x, y = root(int(group.own[i])), root(int(group.own[j]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    a.append(int(group.rid[i]))
                    b.append(int(group.rid[j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return work


def bags_of(scratch: Scratch, named: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """(rid, bag) of the documents in named (rid). Only those are read for their shingles."""
    named = scratch.table(named.distinct(), f"{name}-named")
    small = named.count() <= MOST_NAMES
    found = texts.select("rid", "text").join(F.broadcast(named) if small else named, "rid").mapInArrow(_bags, "rid long, bag binary")
    return scratch.table(found, f"{name}-bags")


def verified(scratch: Scratch, pairs: DataFrame, texts: DataFrame, least: float, name: str) -> DataFrame:
    """Of the pairs (a, b), those whose multisets overlap enough."""
    pairs = scratch.table(pairs, f"{name}-pairs")
    bags = bags_of(scratch, pairs.select(F.col("a").alias("rid")).union(pairs.select("b")), texts, name)
    with_a = pairs.join(bags.select(F.col("rid").alias("a"), F.col("bag").alias("bag_a")), "a")
    both = join_on(with_a, bags.select(F.col("rid").alias("b"), F.col("bag").alias("bag_b")), ["b"], hot_keys(pairs, ["b"]))
    links = scratch.table(both.select("a", "b", "bag_a", "bag_b").mapInArrow(_similar(least), "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-bags")
    return links


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(rid, class): the least number that links (a, b) lead to. Labels jump to their own labels, so that rounds grow with the logarithm of the longest path."""
    both = scratch.table(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    hot = hot_keys(both, ["b"])
    label = scratch.table(both.groupBy(F.col("a").alias("rid")).agg(F.least(F.min("b"), F.min("a")).alias("class")), f"{name}-0")
    k = 0
    while True:
        k += 1
        heard = join_on(both, label.select(F.col("rid").alias("b"), "class"), ["b"], hot).groupBy(F.col("a").alias("rid")).agg(F.min("class").alias("heard"))
        new = scratch.table(label.join(heard, "rid").select("rid", F.col("class").alias("old"), F.least("class", "heard").alias("class")), f"{name}-{k}")
        if not new.where(F.col("class") != F.col("old")).limit(1).count():
            return label
        up = new.select(F.col("rid").alias("class"), F.col("class").alias("root"))
        jumped = join_on(new.select("rid", "class"), up, ["class"], hot_keys(new, ["class"]))
        label = scratch.table(jumped.select("rid", F.least("class", "root").alias("class")), f"{name}-{k}-jumped")


def still_apart(members: DataFrame, signed: DataFrame, agree: float) -> DataFrame:
    """Rows (GROUPED) of members (bucket, rid, class) that agree with one of another class in their bucket, by pairs of blocks.

    A class with BLOCK members in a bucket or more has blocks of its own, which aren't held against each other.
    """
    n = members.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") >= BLOCK
    buckets = n.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("classes"), F.sum(F.when(~large, F.col("n")).otherwise(0)).alias("rest"),
        F.collect_list(F.when(large, F.struct("class", F.ceil(F.col("n") / BLOCK).alias("blocks")))).alias("large"),
    ).where(F.col("classes") > 1)
    rows = join_on(members, buckets.select("bucket", F.ceil(F.col("rest") / BLOCK).alias("rest"), "large"), ["bucket"], hot_keys(members, ["bucket"]))
    rows = rows.join(signed.select("rid", "signature"), "rid")
    spread = F.pmod(F.xxhash64("rid"), F.lit(1 << 30))
    mine = F.filter("large", lambda x: x["class"] == F.col("class"))
    block = lambda kind, k: F.struct(kind.cast("long").alias("kind"), k.cast("long").alias("k"))
    own = F.when(F.size(mine) > 0, block(F.col("class"), spread % mine[0]["blocks"])).otherwise(block(F.lit(-1), spread % F.col("rest")))
    until = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    others = F.concat(
        F.transform(until(F.col("rest")), lambda k: block(F.lit(-1), k)),
        F.flatten(F.transform(F.filter("large", lambda x: x["class"] != F.col("class")), lambda x: F.transform(until(x["blocks"]), lambda k: block(x["class"], k)))),
    )
    rows = rows.select("bucket", "rid", "class", "signature", own.alias("own"), F.explode(others).alias("other"))
    number = lambda x: F.xxhash64(x["kind"], x["k"])
    own, other = number(F.col("own")), number(F.col("other"))
    rows = rows.select("bucket", F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), "rid", "class", (own <= other).alias("is_low"), (own == other).alias("same"), "signature")
    return grouped(rows).mapInArrow(_by_group(_involved(agree)), GROUPED)


def grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "rid")


def joining(scratch: Scratch, apart: DataFrame, texts: DataFrame, agree: float, least: float) -> DataFrame:
    """Links (a, b) between the rows that still_apart() gives."""
    apart = scratch.table(apart, "apart")
    bags = bags_of(scratch, apart.select("rid"), texts, "apart")
    links = grouped(apart.join(bags, "rid").select(*apart.columns, "bag")).mapInArrow(_by_group(_joined(agree, least)), "a long, b long")
    return scratch.table(links.distinct(), "joining")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, class_size, kept, n_shingles.

    A class is what links of similarity least or more join; class_id is its least doc_id (a null one only if it has no
    other), and that row stays, or one of them. Rows with the same shingles are one text, whose copies are counted and
    not held against each other. A text of fewer than WORDS words is one shingle. A null or empty text is near to none:
    each such row is a class of its own. Other columns of docs are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "near-dup")
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return classes(scratch, scratch.table(own, "texts"), least).drop("rid")  # row numbers are fixed from here on


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR) -> DataFrame:
    """The row of each class that stays, with all its columns; see near_classes()."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    rows = numbered(scratch, docs)
    texts = rows.select("rid", F.col("row").getField(id_col).cast("long").alias("doc_id"), text_or_empty(F.col("row").getField(text_col)).alias("text"))
    return without(rows, scratch.table(classes(scratch, texts, least).where(~F.col("kept")).select("rid"), "dropped"), docs.columns)


def classes(scratch: Scratch, texts: DataFrame, least: float) -> DataFrame:
    """near_classes() of (rid, doc_id, text), with rid."""
    signed = scratch.table(texts.mapInArrow(_signed, "rid long, doc_id long, n_shingles long, bag_key binary, signature binary"), "signed")
    full = signed.where(F.col("n_shingles") > 0)
    same = full.groupBy("bag_key").agg(F.min("rid").alias("text_rid"))
    copies = scratch.table(join_on(full.select("rid", "bag_key"), same, ["bag_key"], hot_keys(full, ["bag_key"])).select("rid", "text_rid"), "copies")
    one = full.join(copies.where(F.col("rid") == F.col("text_rid")).select("rid"), "rid", "left_semi").select("rid", "signature")
    one = scratch.table(one, "one")  # a row for each distinct text
    bands = scratch.table(one.mapInArrow(_bands, "bucket long, rid long"), "bands")
    hot = hot_keys(bands, ["bucket"])
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = scratch.table(join_on(bands, shared, ["bucket"], hot), "shared")
    met_by = shared.groupBy("rid").agg(F.sum("n").alias("others"))
    heads = shared.join(met_by, "rid").groupBy("bucket").agg(F.max(F.struct("others", (-F.col("rid")).alias("name"))).alias("head"))
    met = join_on(shared.select("bucket", "rid"), heads.select("bucket", (-F.col("head.name")).alias("head")), ["bucket"], hot)
    met = met.where(F.col("rid") != F.col("head")).select(F.col("rid").alias("a"), F.col("head").alias("b")).distinct()
    met = scratch.table(met, "met")
    signature = lambda k: one.select(F.col("rid").alias(k), F.col("signature").alias(f"signature_{k}"))
    compared = join_on(met.join(signature("a"), "a"), signature("b"), ["b"], hot_keys(met, ["b"])).select("a", "b", "signature_a", "signature_b")
    compared = compared.mapInArrow(_agreement, "a long, b long, agree double").where(F.col("agree") >= AGREE)
    best = compared.groupBy("a").agg(F.max(F.struct("agree", -F.col("b"))).alias("best")).select("a", (-F.col("best.col2")).alias("b"))
    links = verified(scratch, best, texts, least, "first")
    label = components(scratch, links, "first")
    members = scratch.table(shared.join(label, "rid", "left").select("bucket", "rid", F.coalesce("class", "rid").alias("class")), "members")
    more = joining(scratch, still_apart(members, one, AGREE), texts, AGREE, least)
    label = components(scratch, links.union(more), "second")
    rows = signed.select("rid", "doc_id", "n_shingles").join(copies, "rid", "left")
    rows = rows.join(label.select(F.col("rid").alias("text_rid"), "class"), "text_rid", "left")
    rows = scratch.table(rows.select("rid", "doc_id", "n_shingles", F.coalesce("class", "text_rid", "rid").alias("class")), "rows")
    groups = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("class_size"))
    groups = groups.select("class", "class_size", F.col("first.doc_id").alias("class_id"), F.col("first.rid").alias("keep"))
    out = join_on(rows, groups, ["class"], hot_keys(rows, ["class"]))
    return out.select("rid", "doc_id", "class_id", "class_size", (F.col("rid") == F.col("keep")).alias("kept"), "n_shingles")


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
