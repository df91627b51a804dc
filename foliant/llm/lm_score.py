r"""Language-model scores by logistic context mixing of bits.

A text is its tokens and its end. Frequent tokens have a Huffman code, whose bits are predicted in the contexts of the
tokens before them and mixed for every occurrence (see lm_contexts). Any other token has the code of an escape, and
unless its context tells it, it is spelled as bytes and closed by a blank, the text's end as a line feed.

Every bit of a spelled byte is predicted by six predictors, each with its own context. Four are hashed: the two, three
or five bytes before it in the token, some with the class of the text so far, which is the last character beyond
ASCII before the token. A context and the bits of the byte so far have a slot of a table, which holds the stretched
probability that the counts of zeros and ones there give. Two have the whole token so far, with and without the class,
and their counts are exact for every spelled training token: tokens that begin alike meet in one task in sorted order,
where the tokens with a common beginning are neighbours. So what is gathered grows with the corpus.

The mixer adds the predictions in the logistic domain with weights that gates select (how much the predictors have seen;
the bit's place), learnt online over all spelled training tokens. An adaptive map from what the mixer says and the byte
so far to the share of ones that followed refines the result. The bits' logarithms sum to the text's.

Given the class, a token's spelling has the same probability wherever it stands, so each (class, token) is spelled once.
Tokens are told apart by 64-bit hashes where texts are scored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import compress
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, as_bytes, text_or_empty
from foliant.llm.lm_contexts import Dictionary, pair_keys, scored
from foliant.llm.lm_segments import is_blank, token_places

#: Documents whose crc32(id as text) mod FOLDS is HELD_OUT are not learnt from.
FOLDS, HELD_OUT = 7, 2
END = b"\n"
CLASSES = 16
#: Hashed contexts: bytes of context before the bit's byte; whether the class counts; bits of the table's size, at least.
PREDICTORS = ((2, True, 18), (3, False, 19), (3, True, 19), (5, False, 20))
#: Bits that a table grows by at most: its size follows the number of different tokens, and tasks hold all tables.
MOST_GROWTH = 2
#: Whole prefixes are exact from the first byte that tokens are dealt to tasks without, up to a depth; before, three bytes are the whole.
FIRST, DEPTH = 4, 32
#: Places of the predictors: three bytes without and with the class, five bytes, the whole without and with the class; gates.
SHORT, SHORT_CLASS, FIVE, WHOLE, WHOLE_CLASS, GATES = 1, 2, 3, 4, 5, 8 * 4 * 4
#: Tokens with a code of their own, at most; the others have the code of an escape and are spelled.
FREQUENT = 262_144
#: Pairs whose prefixes are counted together, that are spelled together, that are learnt from together at first and later, and that are remembered before they are passed on; bytes of text whose tokens are counted together.
BLOCK, BATCH, ONLINE_BATCH, MOST_ONLINE, HELD, COUNTED = 65_536, 16_384, 2_048, 8_192, 1_000_000, 4_000_000
#: Slots of the tables that are summed together; it divides all tables' sizes.
SLOT_BLOCK = 16_384
#: Step of the mixer's weights, which falls with the batches seen; step of the map.
RATE, MAP_RATE = 0.01, 0.02
MAP_PLACES, MAP_RANGE = 33, 10.0
#: What is learnt from counts in its own slots: it is taken out of those that have been seen less often than this.
OWN_COUNTS = 32
#: How often contexts have been seen, for the gates: the whole prefix with the class, without it, five bytes.
LEVELS = tuple(np.array(x, np.float32) for x in ((0.5, 3.5, 15.5, 63.5, 255.5, 2047.5, 16383.5), (0.5, 31.5, 1023.5), (0.5, 7.5, 127.5)))
#: Averages of mixers that the driver gets.
AVERAGES = 8
#: Added to a slot's counts of ones and of zeros.
PRIOR = 0.1

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def lower(text: str) -> bytes:
    """Lower-case A-Z. Tokens are what stands between characters of [\\x20\\x09-\\x0D]."""
    return text.encode("utf-8", "surrogatepass").lower()


def classes_of(*lowered: bytes) -> np.ndarray:
    """The class of each token of lower-case texts, one text after another, the ends included, by the last character beyond ASCII before it in its text."""
    data = np.frombuffer(b"".join([t + b" " for t in lowered]), np.uint8)
    inside = ~is_blank(data)
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    words = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in lowered]))  # up to the end of each text
    firsts = np.append(0, words[:-1]) + np.arange(len(lowered))
    total = int(words[-1]) + len(lowered)
    high = data[data >= 0x80]
    if not len(high):
        return np.zeros(total, np.int64)
    characters = np.add.reduceat(high.astype(np.int64), np.flatnonzero(high >= 0xC2))  # what follows a lead byte is its own
    word = np.searchsorted(starts, np.flatnonzero(data >= 0xC2), "right") - 1
    token = word + np.searchsorted(words, word, "right")
    last = np.flatnonzero(np.append(token[1:] != token[:-1], True))
    at = np.concatenate([firsts, token[last] + 1])  # from here on, each is the class
    order = np.argsort(at)
    return np.repeat(np.append(np.zeros(len(firsts), np.int64), 1 + characters[last] % (CLASSES - 1))[order], np.diff(np.append(at[order], total)))


def different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different key, in their order; which of them each is."""
    order = np.argsort(keys)
    new = np.append(True, keys[order[1:]] != keys[order[:-1]])[: len(keys)]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


class Spelling:
    """The different (class, prefix, byte) of a batch of (class, token) pairs, with the hashes of each byte's contexts.

    Tokens that begin alike share what is computed for their beginnings: which says for each byte of the tokens, one
    after another, where it is among the different ones.
    """

    def __init__(self, tokens: list[bytes], classes: np.ndarray, exact: tuple[np.ndarray, np.ndarray] | None = None):
        """exact: for each byte of the spelled tokens, how often its prefix has been seen up to each of its bits, without and with the class."""
        spelled = [t if t == END else t + b" " for t in tokens]
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        data = np.frombuffer(b"".join(spelled), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.token = np.repeat(np.arange(len(tokens)), sizes)
        place = np.arange(len(data)) - self.starts[self.token]
        kind = (np.asarray(classes, np.uint64) + np.uint64(1))[self.token]
        wide = data.astype(np.uint64) + np.uint64(1)
        powers = np.full(int(sizes.max(initial=1)), _M2, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * powers[place])])
        first = before[self.starts][self.token]
        key = (before[1:] - first) * _M2 + kind * _M1
        keep, self.which = different(key ^ (key >> np.uint64(31)))
        self.data, self.place = data[keep], place[keep]
        self.contexts, h, done, kind = [], np.zeros(len(keep), np.uint64), 0, kind[keep]
        self.exact = tuple(np.ascontiguousarray(e[keep].T).T for e in exact) if exact is not None else (np.zeros((len(keep), 9), np.float32, "F"),) * 2  # a bit's together
        for i, (n, classed, _) in enumerate(PREDICTORS):  # a longer context adds to a shorter one
            for k in range(done + 1, n + 1):
                h = h + np.where(self.place >= k, wide[np.maximum(keep - k, 0)], np.uint64(0)) * powers_of(k)
            done = max(done, n)
            own = (h + (kind * _M1 if classed else np.uint64(0)) + np.uint64(i)) * _M3
            self.contexts.append(own ^ (own >> np.uint64(29)))

    def summed(self, weights: np.ndarray) -> np.ndarray:
        """Weights of the tokens, summed for each different byte."""
        return np.bincount(self.which, weights[self.token], len(self.data)).astype(np.float32)

    def bits(self, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For each bit of the bytes, highest first: its number, it, the byte so far, slots of each hashed predictor in tables of 2 ** sizes."""
        so_far = np.ones(len(self.data), np.uint64)
        offset = np.concatenate([[0], np.cumsum([1 << x for x in sizes])]).tolist()
        for k in range(7, -1, -1):
            bit = (self.data >> np.uint8(k)) & np.uint8(1)
            slots, node = [], so_far * _M2
            for size, own, context in zip(sizes, offset, self.contexts, strict=False):
                h = context + node
                h *= _M1
                slots.append((h >> np.uint64(64 - size)).view(np.int64) + own)
            yield k, bit, so_far, slots
            so_far = so_far * np.uint64(2) + bit


def powers_of(k: int) -> np.uint64:
    return np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64))


class Prefixes:
    """Exact counts of prefixes among sorted (token, class) pairs, which hold all that begin alike.

    Pairs with a common beginning of so many bits are neighbours, so their count is a difference of running sums.
    """

    def __init__(self, tokens: list[bytes], classes: np.ndarray, weights: np.ndarray):
        spelled = [(t if t == END else t + b" ")[:DEPTH] for t in tokens]
        self.sizes, self.weights = np.fromiter(map(len, spelled), np.int64, len(spelled)), weights
        matrix = np.zeros((len(spelled), DEPTH), np.uint8)
        starts = np.cumsum(self.sizes) - self.sizes
        row = np.repeat(np.arange(len(spelled)), self.sizes)
        matrix[row, np.arange(len(row)) - starts[row]] = np.frombuffer(b"".join(spelled), np.uint8)
        self.lanes = []
        for rows in [np.arange(len(spelled))] + [np.flatnonzero(classes == c) for c in np.unique(classes)]:
            differs = matrix[rows[1:]] ^ matrix[rows[:-1]]
            at = (differs != 0).argmax(1)
            byte = differs[np.arange(len(at)), at]
            common = np.where(byte == 0, DEPTH * 8, at * 8 + _LEADING[byte])  # bits that neighbours share
            self.lanes.append((rows, common, np.concatenate([[0.0], np.cumsum(weights[rows])])))

    def of(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For pairs a to b, see Spelling."""
        sizes = self.sizes[a:b]  # of what is no deeper than DEPTH
        return tuple(self._totals(lanes, a, b, sizes) for lanes in (self.lanes[:1], self.lanes[1:]))

    def _totals(self, lanes: list, a: int, b: int, sizes: np.ndarray) -> np.ndarray:
        """A pair that ends before a place shares no bit of it, nor all before it, with one that goes on: only those that
        go on are looked at. One that shares its beginning with no other keeps its own count from there on, and no other
        shares bits across it."""
        starts = np.cumsum(sizes) - sizes
        out = np.repeat(self.weights[a:b].astype(np.float32), sizes)[:, None].repeat(9, 1)
        out[np.arange(len(out)) - np.repeat(starts, sizes) < FIRST] = 0
        for rows, common, sums in lanes:
            i, j = np.searchsorted(rows, [a, b])
            if i == j:
                continue
            left, right = -np.minimum.accumulate(common[:i][::-1]), -np.minimum.accumulate(common[j - 1 :])
            deep = np.arange(i, j)  # places in the lane
            deep = deep[sizes[rows[deep] - a] > FIRST]
            above: np.ndarray | None = None
            place = FIRST
            while len(deep):
                shared = np.where(np.diff(deep) == 1, common[deep[:-1]], 0)
                counts = np.empty((len(deep), 9), np.float32)
                for k in range(9):
                    if k or above is None:
                        depth = 8 * place + k
                        cut = np.flatnonzero(shared < depth) + 1
                        ends = np.concatenate([[0], cut, [len(deep)]])
                        low, high = deep[ends[:-1]], deep[ends[1:] - 1] + 1
                        if low[0] == i:
                            low[0] -= np.searchsorted(left, -depth, "right")
                        if high[-1] == j:
                            high[-1] += np.searchsorted(right, -depth, "right")
                        above = np.repeat(sums[high] - sums[low], np.diff(ends))
                    counts[:, k] = above
                own = rows[deep] - a
                out[starts[own] + place] = counts
                place += 1
                longer = (sizes[own] > place) & np.repeat(high - low > 1, np.diff(ends))
                deep, above = deep[longer], above[longer]
        return out


_LEADING = np.array([8] + [8 - i.bit_length() for i in range(1, 256)])


class Tables:
    """What each slot of the hashed contexts predicts, stretched, and how often it has been seen."""

    def __init__(self, different_tokens: int):
        growth = min(max(different_tokens.bit_length() - 18, 0), MOST_GROWTH)
        self.sizes = [b + growth for *_, b in PREDICTORS]
        self.slots = np.zeros((sum(1 << b for b in self.sizes), 2), np.float16)  # stretched, total

    def __getstate__(self) -> dict:
        """Compressed: each executor keeps copies of what is sent to all tasks."""
        return {"sizes": self.sizes, "slots": zstandard.compress(np.ascontiguousarray(self.slots).view(np.uint8).reshape(len(self.slots), -1).T.tobytes(), 3)}

    def __setstate__(self, state: dict) -> None:
        self.sizes = state["sizes"]
        self.slots = np.ascontiguousarray(np.frombuffer(zstandard.decompress(state["slots"]), np.uint8).reshape(4, -1).T).view(np.float16)

    def predictions(self, spelling: Spelling, k: int, bit: np.ndarray, slots: list[np.ndarray], learning: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """What each predictor says and how often it has seen its context. learning: the bits' own occurrences don't count."""
        x, seen = np.zeros((INPUTS, len(bit)), np.float32), []
        whole = self.slots.view(np.uint32).reshape(-1)
        for i, s in enumerate(slots):
            both = whole[s].view(np.float16).reshape(-1, 2)
            x[i], n = both[:, 0], both[:, 1].astype(np.float32)
            if learning:
                few = np.flatnonzero((n > 0) & (n < OWN_COUNTS))
                m, own = n[few], bit[few].astype(np.float32)
                one = (m + 2 * PRIOR) / (1 + np.exp(-x[i, few])) - PRIOR
                one, zero = np.maximum(one - own, 0), np.maximum(m - one - (1 - own), 0)
                x[i, few] = np.log((one + PRIOR) / (zero + PRIOR))
                n[few] -= 1
            seen.append(n)
        early, sign = np.flatnonzero(spelling.place < FIRST), bit.astype(np.float32)
        sign *= 2
        sign -= 1
        for i, short, exact in ((WHOLE, SHORT, spelling.exact[0]), (WHOLE_CLASS, SHORT_CLASS, spelling.exact[1])):
            n, same, says = exact[:, 7 - k].copy(), exact[:, 8 - k], x[i]
            if learning:
                n, same = np.maximum(np.subtract(n, 1, out=n), 0, out=n), np.maximum(same - 1, 0)
            other = n - same
            other += PRIOR
            np.add(same, PRIOR, out=says)
            says /= other
            np.log(says, out=says)
            np.clip(says, -MAP_RANGE, MAP_RANGE, out=says)
            says *= sign
            says[early], n[early] = x[short, early], seen[short][early]
            seen.append(n)
        x[-1] = 0.3
        return x, seen


INPUTS = len(PREDICTORS) + 3


class Mixer:
    """Weights by gate, and the map that refines."""

    def __init__(self):
        n = INPUTS
        self.seen = np.tile(np.array([0.1, 0.05, 0.05, 0.1, 0.3, 0.6, 0], np.float32), (GATES, 1))  # a whole prefix that has been seen says most
        self.seen[:16] = [0.1, 0.1, 0.1, 0.3, 0.6, 0, 0]
        self.seen[:4] = [0.2, 0.15, 0.15, 0.5, 0, 0, 0]
        self.seen[0] = [0.4, 0.3, 0.3, 0, 0, 0, 0]
        self.where = np.zeros((32, n), np.float32)
        self.squares = {"seen": np.full((GATES, n), 1e-3), "where": np.full((32, n), 1e-3)}
        self.map = np.tile(1 / (1 + np.exp(-np.linspace(-MAP_RANGE, MAP_RANGE, MAP_PLACES))), (256, 1)).astype(np.float32)
        self.batches = 0

    def gates(self, k: int, place: np.ndarray, seen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        whole, other, five = seen[WHOLE_CLASS], seen[WHOLE], seen[FIVE]
        level = np.zeros(len(place), np.uint8)
        for bounds, n, step in zip(LEVELS, (whole, other, five), (16, 4, 1), strict=True):
            above = sum((n > b).view(np.uint8) for b in bounds)
            level += above * np.uint8(step)
        return level.astype(np.intp), k * 4 + np.minimum(place, 3)

    def mix(self, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mixed probability; place in the map and share of the next place."""
        first = int(b[0]) & ~3 if len(b) else 0  # a bit's places are four rows of where
        sums = np.ascontiguousarray((self.seen[:, None] + self.where[first : first + 4]).reshape(-1, len(x)).T)  # of each gate and place
        at = a * 4
        at += b
        at -= first
        dot = x[0] * sums[0].take(at)
        for i in range(1, len(x)):
            dot += x[i] * sums[i].take(at)
        dot = np.clip(dot, -MAP_RANGE + 1e-3, MAP_RANGE - 1e-3)
        at = (dot + np.float32(MAP_RANGE)) * np.float32((MAP_PLACES - 1) / (2 * MAP_RANGE))
        low = at.astype(np.int32)
        return 1 / (1 + np.exp(-dot)), low, at - low.astype(np.float32)

    def refine(self, p: np.ndarray, low: np.ndarray, share: np.ndarray, so_far: np.ndarray) -> np.ndarray:
        flat, at = self.map.reshape(-1), so_far.astype(np.int32) * np.int32(MAP_PLACES) + low
        here = flat[at]
        refined = here + (flat[at + 1] - here) * share
        return np.clip((p + refined) / 2, 1e-5, 1 - 1e-5)

    def learn(self, spelling: Spelling, tables: Tables, weight: np.ndarray) -> None:
        self.batches += 1
        rate = RATE / np.sqrt(self.batches)
        w = spelling.summed(weight)
        for k, bit, so_far, slots in spelling.bits(tables.sizes):
            x, seen = tables.predictions(spelling, k, bit, slots, True)
            a, b = self.gates(k, spelling.place, seen)
            p, low, share = self.mix(x, a, b)
            both, wide = a * len(self.where) + b, GATES * len(self.where)
            sums = [np.bincount(both, one, wide).reshape(GATES, -1) for one in (*(x * ((bit - p) * w)), w)]
            for axis, name in ((1, "seen"), (0, "where")):
                weights, squares = getattr(self, name), self.squares[name]
                slope = np.stack([one.sum(axis) for one in sums], 1)
                n = np.maximum(slope[:, -1:], 1e-9)
                slope = slope[:, :-1] / n
                squares += 0.05 * (slope * slope - squares) * (n > 1e-6)
                weights += rate * slope / np.sqrt(squares)
            at = so_far.astype(np.int32) * np.int32(MAP_PLACES) + low + (share > 0.5)
            flat = self.map.reshape(-1)
            n = np.bincount(at, w, len(flat))
            step = np.minimum(MAP_RATE * np.sqrt(n / w.mean()), 0.5)
            flat += step * (np.bincount(at, bit * w, len(flat)) / np.maximum(n, 1e-9) - flat)

    def score(self, spelling: Spelling, tables: Tables) -> np.ndarray:
        """log10 probability of each token."""
        total = np.zeros(len(spelling.data))
        for k, bit, so_far, slots in spelling.bits(tables.sizes):
            x, seen = tables.predictions(spelling, k, bit, slots)
            p = self.refine(*self.mix(x, *self.gates(k, spelling.place, seen)), so_far)
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return np.add.reduceat(total[spelling.which], spelling.starts)


def average(mixers: list[tuple[float, Mixer]]) -> Mixer:
    """Of what each task has learnt, by the bytes it learnt from."""
    out = Mixer()
    total = sum(n for n, _ in mixers)
    if total:
        for name in ("seen", "where", "map"):
            setattr(out, name, sum(n / total * getattr(m, name) for n, m in mixers))
    return out


# Spark's side


def _counted(texts: list[bytes], held: np.ndarray) -> tuple:
    """Different (token, class) of lower-case texts: keys, words, classes, occurrences in training documents and in all."""
    h, counts, starts, data = token_places(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    classes = np.zeros(len(h), np.int32)
    firsts = np.cumsum(counts) - counts
    beyond = [not t.isascii() for t in texts]
    if any(beyond):
        classes[np.repeat(beyond, counts)] = classes_of(*compress(texts, beyond))
    keys = pair_keys(h, classes)
    order = np.argsort(keys)
    new = np.flatnonzero(np.append(True, keys[order[1:]] != keys[order[:-1]]))
    train, every = np.add.reduceat((~held)[doc[order]].astype(np.int64), new), np.diff(np.append(new, len(keys)))
    one = order[new]
    is_end = one == (firsts + counts - 1)[doc[one]]
    offsets = pa.py_buffer(np.concatenate([starts, [len(data), len(data)]]).astype(np.int32))
    spans = pa.StringArray.from_buffers(len(starts) + 1, offsets, pa.py_buffer(data))
    words = spans.take(pa.array(np.where(is_end, len(starts), one - doc[one])))
    words = pc.if_else(pa.array(is_end), pa.scalar(END.decode()), pc.ascii_rtrim(words, " \t\n\x0b\x0c\r"))
    return keys[one], words, classes[one], train, every


def _merged(parts: list[tuple]) -> tuple:
    keys, classes, train, every = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4))
    order = np.argsort(keys)
    new = np.flatnonzero(np.append(True, keys[order[1:]] != keys[order[:-1]]))
    one = order[new]
    words = pa.concat_arrays([p[1] for p in parts]).take(pa.array(one))
    return keys[one], words, classes[one], np.add.reduceat(train[order], new), np.add.reduceat(every[order], new)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(held_out, text) to (word, cls, train, every)."""
    parts: list[tuple] = []
    texts: list[bytes] = []
    held: list[bool] = []
    n = 0

    def out(last: bool) -> Iterator[pa.RecordBatch]:
        if last or sum(len(p[0]) for p in parts) > HELD:
            parts[:] = [_merged(parts)] if parts else []
            if parts and (last or len(parts[0][0]) > HELD // 2):
                _, words, classes, train, every = parts.pop()
                yield pa.RecordBatch.from_arrays([words, pa.array(classes, pa.int32()), pa.array(train, pa.int64()), pa.array(every, pa.int64())], ["word", "cls", "train", "every"])

    for batch in batches:
        for is_held, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            texts.append(lower(text.as_py()))
            held.append(is_held)
            n += len(texts[-1]) + 1
            if n > COUNTED:
                parts.append(_counted(texts, np.array(held)))
                texts, held, n = [], [], 0
                yield from out(False)
    if texts:
        parts.append(_counted(texts, np.array(held)))
    yield from out(True)
    pa.default_memory_pool().release_unused()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, pa.RecordBatch]]:
    """Rows of the words table, whose files are sorted, as (tokens, classes, rows): BLOCK pairs or more, and all that begin alike."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out(parts: list[pa.RecordBatch]) -> tuple[list[bytes], np.ndarray, pa.RecordBatch]:
        own = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return as_bytes(own.column("word")), own.column("cls").to_numpy(zero_copy_only=False), own

    last = None
    for batch in batches:
        heads = pc.binary_slice(batch.column("word").cast(pa.binary()), 0, FIRST)
        changes = (np.flatnonzero(pc.not_equal(heads[1:], heads[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()
        if batch.num_rows and heads[0].as_py() != last:
            changes.insert(0, 0)
        start = 0
        for i in changes:
            if size + i - start >= BLOCK:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield out(held)
                held, size, start = [], 0, i
        if start < batch.num_rows:
            held.append(batch.slice(start))
            size += batch.num_rows - start
            last = heads[-1].as_py()
    if size:
        yield out(held)


def word_counts(tokens: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Of sorted tokens, equal ones together."""
    first = np.flatnonzero(np.fromiter(map(ne, tokens, [None, *tokens[:-1]]), bool, len(tokens)))
    return np.repeat(np.add.reduceat(weights, first), np.diff(np.append(first, len(tokens))))


def _words(batches: Iterator[pa.RecordBatch], least: int, train_only: bool) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(tokens, classes, training occurrences, rows) of the blocks' pairs whose tokens occur less than least times in training documents."""
    for tokens, classes, rows in _blocks(batches):
        train = rows.column("train").to_numpy(zero_copy_only=False)
        count = word_counts(tokens, train)
        keep = count < least
        if train_only:
            keep &= train > 0
        yield list(compress(tokens, keep)), classes[keep], train[keep], rows.append_column("count", pa.array(count)).filter(pa.array(keep))


def _slices(batches: Iterator[pa.RecordBatch], size: int, least: int, train_only: bool = True, exact: bool = True, most: int = 0) -> Iterator[tuple[Spelling, np.ndarray, pa.RecordBatch]]:
    """size pairs at a time as they are spelled, with their training occurrences and rows; up to most, an eighth more for each pair before."""
    done = 0
    for tokens, classes, train, rows in _words(batches, least, train_only):
        prefixes = Prefixes(tokens, classes, train) if exact and tokens else None
        for first in range(0, len(tokens), BLOCK):
            last = min(first + BLOCK, len(tokens))
            counts = padded(prefixes.of(first, last), prefixes.sizes[first:last], tokens[first:last]) if exact else None
            at = np.concatenate([[0], np.cumsum(spelled_sizes(tokens[first:last]))])
            b = first
            while b < last:
                a, b = b, min(b + max(size, min(most, size + done // 8)), last)
                done += b - a
                own = tuple(c[at[a - first] : at[b - first]] for c in counts) if exact else None
                yield Spelling(tokens[a:b], classes[a:b], own), train[a:b], rows.slice(a, b - a)


def spelled_sizes(tokens: list[bytes]) -> np.ndarray:
    out = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    out[[i for i, t in enumerate(tokens) if t == END]] = len(END)
    return out


def padded(exact: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the bytes beyond DEPTH, which are 0, put in."""
    whole = spelled_sizes(tokens)
    if (whole == sizes).all():
        return exact
    row = np.repeat(np.arange(len(tokens)), sizes)
    at = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row] + (np.cumsum(whole) - whole)[row]
    out = []
    for e in exact:
        wide = np.zeros((int(whole.sum()), 9), np.float32)
        wide[at] = e
        out.append(wide)
    return tuple(out)


def _count_bits(sizes: list[int], least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * sum(1 << b for b in sizes), np.float32)  # zeros and ones of each slot
        for spelling, train, _ in _slices(batches, BATCH, least, exact=False):
            n = spelling.summed(train)
            for _, bit, _, slots in spelling.bits(sizes):
                for s in slots:
                    np.add.at(counts, 2 * s + bit, n)
        for i in range(0, len(counts), 2 * SLOT_BLOCK):
            own = counts[i : i + 2 * SLOT_BLOCK]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // (2 * SLOT_BLOCK)], pa.int32()), pa.array([zstandard.compress(own.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)])], ["block", "counts"])

    return run


def _predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed counts of blocks of slots as packed predictions; all rows of a block are in one partition."""
    sums: dict[int, np.ndarray] = {}  # of the tables' size at most
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            own = np.ascontiguousarray(np.frombuffer(zstandard.decompress(counts), np.uint8).reshape(4, -1).T).view(np.float32).reshape(-1)
            if block in sums:
                sums[block] += own
            else:
                sums[block] = own.astype(np.float64)
    for block, own in sums.items():
        zero, one = own[::2], own[1::2]
        n = one + zero
        stretched = np.clip(np.log((one + PRIOR) / (zero + PRIOR)), -MAP_RANGE, MAP_RANGE).astype("<f2")
        total = np.minimum(n, 60_000).astype("<f2")
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zstandard.compress(stretched.tobytes(), 1)]), pa.array([zstandard.compress(total.tobytes(), 1)])], ["block", "stretched", "total"])


def _learn(tables, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, n = Mixer(), 0
        for spelling, train, _ in _slices(batches, ONLINE_BATCH, least, most=MOST_ONLINE):
            mixer.learn(spelling, tables.value, train)
            n += len(train)
        if n:
            yield _packed(n, mixer)

    return run


LEARNT = "n double, seen binary, gates binary, map binary"


def _packed(n: float, mixer: Mixer) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([float(n)]), *(pa.array([getattr(mixer, k).astype("<f4").tobytes()]) for k in ("seen", "where", "map"))], ["n", "seen", "gates", "map"])


def _unpacked(row: dict) -> tuple[float, Mixer]:
    m = Mixer()
    m.seen, m.where, m.map = (np.frombuffer(v, "<f4").reshape(s.shape) for v, s in ((row["seen"], m.seen), (row["gates"], m.where), (row["map"], m.map)))
    return row["n"], m


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a share of the tasks has learnt as one."""
    all_ = [_unpacked(r) for batch in batches for r in batch.to_pylist()]
    if all_:
        yield _packed(sum(n for n, _ in all_), average(all_))


def _score(tables, mixer, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spelling, _, rows in _slices(batches, BATCH, least, train_only=False):
            scores = mixer.value.score(spelling, tables.value)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("word", "cls", "count")), pa.array(scores)], ["word", "cls", "count", "log_prob"])

    return run


def _least(bars: list[Row]) -> int:
    """The least number of occurrences of a token with a code, 2 or more: at most FREQUENT tokens reach it. bars: (bar, n, least), the highest first."""
    total, least = 0, 1 << 62
    for b in bars:
        total += b.n
        if total > FREQUENT:
            break
        least = b.least
    return max(least, 2)


class Model:
    """n, v: N and V; frequent: the table of tokens with a code (word, n, total); spelled: of the others by class, with scores (word, cls, count, log_prob)."""

    def __init__(self, scratch: Scratch, own: DataFrame):
        spark = scratch.spark
        counted = own.select("held_out", "text").mapInArrow(_count, "word string, cls int, train long, every long")
        counted = counted.withColumn("prefix", F.substring(F.encode("word", "UTF-8"), 1, FIRST)).repartition("prefix")  # tokens that begin alike
        counted = counted.groupBy("prefix", "word", "cls").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))
        words = counted.select("word", "cls", "train", "every").sortWithinPartitions("word", "cls")
        words = scratch.table(words, "words", options={"parquet.block.size": str(1 << 30)})  # a file is one row group, so no task gets a part of those that begin alike
        totals = scratch.table(words.groupBy("word").agg(F.sum("train").alias("n"), F.sum("every").alias("total")), "totals")
        bars = totals.where(F.col("n") > 0).groupBy(F.floor(F.log2("n") * 16).alias("bar"))  # about 1,000
        bars = bars.agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least"), F.sum("n").alias("train")).orderBy(F.desc("bar")).collect()
        self.n, self.v, least = sum(b.train for b in bars), sum(b.n for b in bars), _least(bars)
        self.frequent = totals.where(F.col("n") >= least).toArrow()
        self.total = totals.agg(F.sum("total")).first()[0] or 0
        tables = Tables(self.v)
        slots = words.mapInArrow(_count_bits(tables.sizes, least), "block int, counts binary").repartition("block")
        for part in slots.mapInArrow(_predict, "block int, stretched binary, total binary").collect():  # the tables' slots at most
            at = slice(part.block * SLOT_BLOCK, (part.block + 1) * SLOT_BLOCK)
            tables.slots[at, 0], tables.slots[at, 1] = (np.frombuffer(zstandard.decompress(x), "<f2") for x in (part.stretched, part.total))
        held = spark.sparkContext.broadcast(tables)
        learnt = words.mapInArrow(_learn(held, least), LEARNT)
        learnt = learnt.repartition(AVERAGES).mapInArrow(_average, LEARNT)
        mixer = average([_unpacked(r.asDict()) for r in learnt.collect()])
        self.spelled = scratch.table(words.mapInArrow(_score(held, spark.sparkContext.broadcast(mixer), least), "word string, cls int, count long, log_prob double"), "spelled")
        for name in ("words", "totals"):
            scratch.drop(name)
        del counted, words, totals, slots, learnt
        scratch.free_shuffles()


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    A null text is empty: its one token is the end. A null id counts as the empty text when documents are dealt out.
    Without any training document all counts are 0. n_bytes: of the tokens and what closes them. Rows with the same id
    are scored each on its own. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    held_out = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % FOLDS == HELD_OUT
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text_or_empty(text_col).alias("text"))
    model = Model(scratch, own)
    denominator = math.log10(model.n + 1 * (model.v + 1))
    top = model.frequent.sort_by("word")
    tokens = [w.encode("utf-8", "surrogatepass") for w in top.column("word").to_pylist()]
    dictionary = Dictionary(tokens, top.column("n").to_pylist(), top.column("total").to_pylist(), model.n, model.total, denominator)
    out = scored(own, model.spelled, dictionary, classes_of)
    out = out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", "n_bytes")
    return out.withColumn("bits_per_byte", -F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
