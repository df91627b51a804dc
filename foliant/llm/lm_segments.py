"""Segments of texts in the context of the two tokens before them: what language-model scores know beyond a token.

A text is cut after each pair of tokens whose hash says so (about every 16 tokens), so equal passages have equal
segments wherever they stand. The context of a segment is a hash of the two tokens before it. Spark counts, over all
training documents, each segment in each context; these tables grow with the corpus and have no cap. Where a context
has been seen, a bit says whether the segment is one that has followed it. Several predictors of that bit (how often
the context went on with something new; what the bit before was, for such counts; the state alone) are mixed in the
logistic domain by weights that gates select, learnt online document by document, with adaptive maps. If the bit is
one, the segment's share of its context's occurrences follows; if not, or without a context, its tokens are spelled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, join_on

#: A pair of tokens whose hash has these bits ends a segment; most tokens of a segment; tokens of a context.
CUT, LONGEST, CONTEXT = np.uint64(15), 64, 2
#: States: no bit before, or what it was; places by the logarithm of occurrences; by the share of different followers.
STATES, SEEN, SHARES = 3, 6, 5
STEP, LEAST_RATE = 0.02, 0.002

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)
_END = np.uint64(0x5851F42D4C957F2D)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    return h ^ (h >> np.uint64(27))


def powers(n: int, base: np.uint64) -> np.ndarray:
    return np.multiply.accumulate(np.full(max(n, 1), base))


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of lower-case texts, the end of each text included, one after another; how many each text has."""
    return token_places(texts)[:2]


def is_blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data - np.uint8(9)) < 5)


def eights(data: bytes, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each start as one number, zeros behind the last of those that are left."""
    whole = np.frombuffer(data, "<u8", (len(data) >> 3))
    at, shift = starts >> 3, ((starts & 7) << 3).astype(np.uint64)
    out = whole[at] >> shift
    out |= whole[at + 1] << np.uint64(1) << (np.uint64(63) - shift)
    short = np.flatnonzero(left < 8)
    out[short] &= (np.uint64(1) << (left[short] << 3).astype(np.uint64)) - np.uint64(1)
    return out


def token_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What token_hashes gives; where words start in the bytes of all texts, each of which a blank follows; these bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    joined = b" ".join([*texts, bytes(24)])  # zeros behind, so that eight bytes can be read anywhere
    data = np.frombuffer(joined, np.uint8, int(sizes.sum()))
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(is_blank(data), out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, length = edges[::2], edges[1::2] - edges[::2]
    h = mixed((eights(joined, starts, length) + length.astype(np.uint64) * _M3) * _M1)
    at, done = np.flatnonzero(length > 8), 8
    while len(at):
        h[at] = mixed((eights(joined, starts[at] + done, length[at] - done) + h[at]) * _M1)
        done += 8
        at = at[length[at] > done]
    words = np.diff(np.searchsorted(starts, np.cumsum(sizes)), prepend=0)  # of each text
    out = np.full(len(h) + len(texts), _END)
    out[np.arange(len(h)) + np.repeat(np.arange(len(texts)), words)] = h
    return out, words + 1, starts, data


class Segments:
    """starts: of segments among all tokens; text and number (in its text) of each; hash and context."""

    def __init__(self, texts: list[bytes]):
        h, self.counts = token_hashes(texts)
        n = len(h)
        firsts = np.cumsum(self.counts) - self.counts
        before = np.concatenate([[np.uint64(0)], h[:-1]])
        before[firsts] = 0
        begins = np.zeros(n + 1, bool)
        begins[1:] = mixed(h + before * _M1) & CUT == CUT
        begins[firsts] = True
        starts = np.flatnonzero(begins[:n])
        place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        begins[:n] |= place % LONGEST == 0
        self.starts = np.flatnonzero(begins[:n])
        self.sizes = np.diff(np.append(self.starts, n))
        place = np.arange(n) - np.repeat(self.starts, self.sizes)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(LONGEST, _M3)[place])])
        self.hash = mixed((sums[self.starts + self.sizes] - sums[self.starts]) * _M1)
        self.text = np.searchsorted(firsts, self.starts, "right") - 1
        self.number = np.arange(len(self.starts)) - np.searchsorted(self.text, np.arange(len(texts)))[self.text] if n else self.starts
        self.context = np.full(len(self.starts), np.uint64(CONTEXT))
        for k in range(1, CONTEXT + 1):
            at = self.starts - k
            there = at >= firsts[self.text] if n else at >= 0
            self.context = mixed((self.context + np.where(there, h[np.maximum(at, 0)], np.uint64(0))) * _M1)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_key, train, text) to a row for each segment but the first of a text."""
    names = ["doc_key", "train", "number", "context", "segment"]
    for batch in batches:
        i = 0
        while i < batch.num_rows:
            texts, n = [], 0
            while i + len(texts) < batch.num_rows and n < 2_000_000:
                texts.append(batch.column(2)[i + len(texts)].as_py().encode("utf-8", "surrogatepass").lower())
                n += len(texts[-1])
            own = Segments(texts)
            at = np.flatnonzero(own.number > 0)
            rows = pa.array(own.text[at] + i)
            cols = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(own.number[at].astype(np.int32)), pa.array(own.context[at].view(np.int64)), pa.array(own.hash[at].view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names)
            i += len(texts)


class FlagMixer:
    def __init__(self):
        self.places = [0.3] * (STATES * SEEN * SHARES)
        self.counts = [0.0] * (STATES * SEEN * SHARES)
        self.states = [0.2, 0.8, 0.1]
        self.weights = [[0.1, 0.8, 0.1, 0.0] for _ in range(STATES * SEEN)]
        self.bits = 0.0

    def run(self, events: Iterator[tuple[int, int, int, int]], learn: bool) -> tuple[list[int], float]:
        """Numbers of a text's segments whose bit is one, and the log10 probability of all bits and shares. events: in order, (number, n, total, different)."""
        ones, score, last, state = [], 0.0, -2, 0
        log, exp = math.log, math.exp
        for number, n, total, different in events:
            state = state if number == last + 1 else 0
            seen, share = min(total.bit_length() - 1, SEEN - 1), (SHARES - 1) * different // total
            at = (state * SEEN + seen) * SHARES + min(share, SHARES - 1)
            place, alone, w = self.places[at], self.states[state], self.weights[state * SEEN + seen]
            x0, x1, x2 = log((total - different + 0.3) / (different + 0.3)), log(place / (1 - place)), log(alone / (1 - alone))
            dot = w[0] * x0 + w[1] * x1 + w[2] * x2 + w[3] * 0.3
            p = min(max(1 / (1 + exp(-max(-12.0, min(12.0, dot)))), 1e-4), 1 - 1e-4)
            bit = n > 0
            if learn:
                self.bits += 1
                error = STEP * (bit - p)
                w[0], w[1], w[2], w[3] = w[0] + error * x0, w[1] + error * x1, w[2] + error * x2, w[3] + error * 0.3
                self.counts[at] += 1
                self.places[at] = min(max(place + (bit - place) * max(1 / (self.counts[at] + 1.5), LEAST_RATE), 1e-3), 1 - 1e-3)
                self.states[state] = min(max(alone + (bit - alone) * LEAST_RATE, 1e-3), 1 - 1e-3)
            elif bit:
                ones.append(number)
                score += log(p * n / total)
            else:
                score += log(1 - p)
            last, state = number, 1 if bit else 2
        return ones, score / math.log(10)

    def packed(self) -> pa.RecordBatch:
        flat = np.concatenate([[self.bits], self.counts, self.places, self.states, *self.weights])
        return pa.RecordBatch.from_arrays([pa.array([flat.astype("<f8").tobytes()])], ["learnt"])

    @classmethod
    def average(cls, packed: list[bytes]) -> FlagMixer:
        """Of what tasks have learnt, each place by its own occurrences."""
        out = cls()
        all_ = [np.frombuffer(p, "<f8") for p in packed]
        bits = sum(a[0] for a in all_)
        if bits:
            n = len(out.places)
            counts = [a[1 : n + 1] for a in all_]
            total = sum(counts)
            places = sum(c * a[n + 1 : 2 * n + 1] for c, a in zip(counts, all_, strict=True)) / np.maximum(total, 1)
            out.places = np.where(total > 0, places, out.places).tolist()
            out.counts, out.bits = total.tolist(), bits
            out.states = sum(a[0] / bits * a[2 * n + 1 : 2 * n + 1 + STATES] for a in all_).tolist()
            out.weights = sum(a[0] / bits * a[2 * n + 1 + STATES :] for a in all_).reshape(-1, 4).tolist()
        return out


def _events(batch: pa.RecordBatch) -> Iterator[Iterator[tuple[int, int, int, int]]]:
    """The events of each text of a batch."""
    lists = batch.column("events")
    flat = lists.flatten()
    columns = [c.to_pylist() for c in flat.flatten()]
    cuts = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield zip(*(c[a:b] for c in columns), strict=True)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mixer = FlagMixer()
    for batch in batches:
        for train, events in zip(batch.column("train").to_pylist(), _events(batch), strict=True):
            if train:
                mixer.run(events, True)
    if mixer.bits:
        yield mixer.packed()


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packed = [p for batch in batches for p in batch.column(0).to_pylist()]
    if packed:
        yield FlagMixer.average(packed).packed()


def _apply(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.run(e, False) for e in _events(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.float64())], ["doc_key", "repeated", "repeated_score"])

    return run


def doc_key(id_col: Column, text_col: Column) -> Column:
    """Rows with the same id and text have the same results, so they may share a key."""
    return F.xxhash64(id_col, text_col)


def repeated_segments(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_key, repeated: numbers of the segments that aren't spelled, repeated_score: log10 probability of the bits and
    shares) of the texts with a segment whose context is known. docs: (doc_key, train, text).

    An occurrence in a training document doesn't count for itself. Contexts with many occurrences are joined by broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_key", "train", "text").mapInArrow(_occurrences, "doc_key long, train boolean, number int, context long, segment long")
    rows = scratch.table(rows, "occurrences")
    counts = scratch.table(rows.where("train").groupBy("context", "segment").agg(F.count(F.lit(1)).alias("n")), "segments")
    contexts = scratch.table(counts.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("different")), "contexts")
    total = contexts.agg(F.sum("total")).first()[0] or 0
    hot = [r.h for r in contexts.where(F.col("total") >= max(2000, total // 256)).select(F.xxhash64("context").alias("h")).collect()]  # 256 at most
    own = F.col("train").cast("long")
    known = join_on(rows, contexts, ["context"], hot).where(F.col("total") > own)
    key = F.xxhash64("context", "segment")
    counted = counts.select(F.col("context").alias("c"), F.col("segment").alias("s"), "n")
    often = counts.where(F.col("n") >= max(2000, total // 256)).select(key.alias("h"))
    often = [r.h for r in often.collect()]  # 256 at most
    on = (F.col("context") == F.col("c")) & (F.col("segment") == F.col("s"))
    if often:
        is_hot = key.isin(often)
        both = known.where(~is_hot).join(counted.where(~F.xxhash64("c", "s").isin(often)), on, "left").unionByName(known.where(is_hot).join(F.broadcast(counted.where(F.xxhash64("c", "s").isin(often))), on, "left"))
    else:
        both = known.join(counted, on, "left")
    n = F.coalesce("n", F.lit(0)) - own
    event = F.struct("number", n.alias("n"), (F.col("total") - own).alias("total"), F.greatest(F.col("different") - F.when((own == 1) & (n == 0), 1).otherwise(0), F.lit(1)).alias("different"))
    events = both.select("doc_key", "train", event.alias("e")).groupBy("doc_key").agg(F.max("train").alias("train"), F.sort_array(F.collect_set("e")).alias("events"))  # a text's segments
    events = scratch.table(events, "events")
    for name in ("occurrences", "segments", "contexts"):
        scratch.drop(name)
    del rows, counts, contexts, known, counted, both
    scratch.free_shuffles()
    learnt = events.mapInArrow(_learn, "learnt binary").repartition(8).mapInArrow(_average, "learnt binary").collect()
    held = spark.sparkContext.broadcast(FlagMixer.average([bytes(r.learnt) for r in learnt]))
    return events.mapInArrow(_apply(held), "doc_key long, repeated array<int>, repeated_score double")
