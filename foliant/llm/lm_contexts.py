"""Bits of every token in the contexts of the tokens before it: what language-model scores know beyond a token.

Each frequent token has a Huffman code; any other has the code of an escape and is spelled as well (see lm_score). Every
bit of the code of every occurrence is predicted in three hashed contexts: none, the token before, the two tokens before.
Their counts are exact for the whole training corpus and grow with it: occurrences are dealt to buckets by the token
before, where those of a context stand together in the order of their codes, so that the occurrences whose codes begin
alike are neighbours. An occurrence in a training document doesn't count for itself.

The predictions are mixed in the logistic domain by weights that a gate selects (how much the contexts have seen, whether
they always went on alike, the bit's depth), and refined by an adaptive map. Both are learnt online in each bucket: a
batch of occurrences is scored with what has been learnt before it, then learnt from. Buckets depend on the
corpus alone, so the scores don't depend on Spark's partitions.

Occurrences travel as packed arrays, one for each bucket and block of documents. A token that precedes more than a
bucket's share of all has several buckets, by the token before it; each of them gets all its counts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import as_bytes
from foliant.llm.lm_segments import mixed, token_hashes

#: Occurrences of a bucket, about; bytes of text of a block; different occurrences that are scored together, about; at first.
BUCKET, BLOCK_BYTES, BATCH, FIRST_BATCH = 1 << 20, 4_000_000, 50_000, 5_000
#: Pairs that are dealt to buckets together.
DEALT_PAIRS = 300_000
#: Bounds of what contexts have seen, for the gates: two tokens, one token; of the bit's depth.
SEEN_TWO, SEEN_ONE, DEPTHS = (0.5, 1.5, 2.5, 4.5, 8.5, 32.5), (0.5, 2.5, 8.5, 32.5, 128.5, 1024.5), (0.5, 3.5, 8.5)
GATES = (len(SEEN_TWO) + 1) * 2 * (len(SEEN_ONE) + 1) * (len(DEPTHS) + 1)
#: Places of the map for spelled tokens: logarithms of how many have followed the context, shares of different ones.
FOLLOWED = (6, 5)
#: Step of the weights, which falls with the batches seen; step of the map; its places, four to a unit.
RATE, MAP_RATE, MAP_PLACES = 0.1, 0.05, 40
#: Added to the counts of both bits with no token, one and two tokens before.
PRIORS = (0.5, 0.3, 0.15)
END = b"\n"
_M1 = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0)  # stands before the first token


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, at the high end of 64 bits, and their lengths. A code is no longer than 48 bits below 1e10 occurrences."""
    n = len(weights)
    if n == 1:
        return np.zeros(1, np.uint64), np.zeros(1, np.int64)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    above = [0] * (2 * n - 1)
    side = [0] * (2 * n - 1)
    for k in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        above[i], above[j], side[j] = k, k, 1
        heapq.heappush(heap, (a + b, k))
    codes, sizes = [0] * (2 * n - 1), [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        up = above[k]
        sizes[k] = sizes[up] + 1
        codes[k] = codes[up] | side[k] << (64 - sizes[k])
    return np.array(codes[:n], np.uint64), np.array(sizes[:n], np.int64)


def hashes_of(tokens: list[bytes]) -> np.ndarray:
    """Hashes of tokens as in texts; the end is a line feed."""
    spelled, _ = token_hashes([b" ".join([t for t in tokens if t != END])])
    out = np.full(len(tokens), spelled[-1])
    out[[i for i, t in enumerate(tokens) if t != END]] = spelled[:-1]
    return out


class Dictionary:
    """Frequent tokens by their hashes, with codes, and counts of codes that begin alike. Leaves are numbered by code."""

    def __init__(self, tokens: list[bytes], train: list[int], every: list[int], learnt: int, total: int, denominator: float):
        """learnt: training occurrences of all tokens; total: all occurrences; denominator: logarithm of the base's."""
        self.denominator, rest = denominator, learnt - sum(train)
        hashes = hashes_of(tokens)
        codes, sizes = huffman([*train, rest + 1])
        order = np.argsort(codes, kind="stable")
        leaf = np.argsort(order)
        self.codes, self.sizes = codes[order], sizes[order]
        self.escape = int(leaf[-1])
        by_hash = np.argsort(hashes)
        self.hashes, self.leaves = hashes[by_hash], leaf[:-1][by_hash].astype(np.uint32)
        self.directory = np.searchsorted(self.hashes, np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.directory[-1] = len(self.hashes)  # 2 ** 64 is 0
        self.base = np.log10(np.array(train, np.float64)[by_hash] + 1) - denominator
        counts = np.array([*train, rest + 1], np.float64)[order]
        nodes = Nodes(np.zeros(len(counts), np.int64), self.codes, counts)
        self.starts = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        self.nodes = np.empty(int((self.sizes + 1).sum()), np.float32)  # of each leaf's code, from no bit on
        deep = np.arange(len(counts))
        for k in range(int(self.sizes.max()) + 1):
            deep = deep[self.sizes[deep] >= k]
            self.nodes[self.starts[deep] + k] = nodes.at(deep, k)
        self.buckets = max(1, -(-total // BUCKET))
        shares = np.append(np.array(every, np.int64)[by_hash], [n for t, n in zip(tokens, every, strict=True) if t == END] or [0])  # as many starts as ends
        parts = -(-shares * self.buckets // max(total, 1))
        hot = np.flatnonzero(parts > 1)
        keys = np.append(self.hashes, _START)[hot]
        order = np.argsort(keys)
        self.hot, self.parts = keys[order], parts[hot][order].astype(np.uint64)

    @cached_property
    def stretched(self) -> np.ndarray:
        """What each bit of each leaf's code says with no token before; then of occurrences that don't count for themselves. Where it is looked at, not sent."""
        n, same = self.nodes, np.append(self.nodes[1:], np.float32(0))  # what follows a leaf's last bit is another's
        rest = np.maximum(n - same, 0) + np.float32(PRIORS[0])
        return np.stack([np.log((np.maximum(same - np.float32(own), 0) + np.float32(PRIORS[0])) / rest) for own in (0, 1)])

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Place among hashes; -1 for others."""
        out = np.full(len(h), -1, np.int32)
        head = (h >> np.uint64(44)).astype(np.int32)
        at, end = self.directory[head], self.directory[head + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            right = self.hashes[at] == h[left]
            out[left[right]] = at[right]
            at = at + 1
            more = ~right & (at < end)
            left, at, end = left[more], at[more], end[more]
        return out


class Nodes:
    """Counts of codes that begin alike, among rows that are sorted by group and code."""

    def __init__(self, groups: np.ndarray, codes: np.ndarray, weights: np.ndarray):
        differs = codes[1:] ^ codes[:-1]
        common = np.full(len(differs), 64, np.int16)  # bits that neighbours share
        some = differs != 0
        high = (differs[some] >> np.uint64(11)).astype(np.float64)  # codes have no more than 53 bits that matter
        common[some] = 53 - np.frexp(high)[1]
        common[groups[1:] != groups[:-1]] = -1
        self.common, self.sums = common, np.concatenate([[0.0], np.cumsum(weights)])
        self.deep, self.shared = None, common  # the rows that were last asked for and what they share
        self.groups = self.totals = None  # sizes and counts of the groups of rows that were last found

    def at(self, deep: np.ndarray, k: int) -> np.ndarray:
        """Of the rows deep, all whose codes have k bits or more: the count of their first k bits. No code begins
        another, so what a row shares with a shorter neighbour is less than k bits. Whole groups that were found before
        may be left out."""
        if not len(deep):
            self.groups, self.totals = np.zeros(0, np.intp), np.zeros(0, np.float32)
            return self.totals
        if deep is not self.deep:
            self.deep, self.shared = deep, self.common if len(deep) == len(self.sums) - 1 else self.common[deep[:-1]]
        cut = np.flatnonzero(self.shared < k) + 1
        low, high = np.concatenate([[0], cut]), np.concatenate([cut, [len(deep)]])
        self.groups, self.totals = high - low, (self.sums[deep[high - 1] + 1] - self.sums[deep[low]]).astype(np.float32)
        return np.repeat(self.totals, self.groups)

    def split(self, least: float) -> np.ndarray:
        """Of the rows that were last asked for, those in a group of several rows or of a count above least. A row alone
        keeps its count from here on."""
        return np.repeat((self.groups > 1) | (self.totals > least), self.groups)


def _above(n: np.ndarray, bounds: tuple[float, ...], step: int) -> np.ndarray:
    """step times how many of the bounds are less than n."""
    out = (n > np.float32(bounds[0])).view(np.uint8)
    for b in bounds[1:]:
        out += (n > np.float32(b)).view(np.uint8)
    out *= np.uint8(step)
    return out


class Counts:
    """What has been seen before a bit, of so many rows. none: stretched, of what came with no token before; one: (n,
    same) after a token; two: rows that two tokens before have been seen for, or may have been, with their (n, same).
    Iterated: (n, same) of all rows with no, one and two tokens before."""

    __slots__ = ("none", "one", "own", "roots", "two")

    def __init__(self, none: np.ndarray, one: tuple, two: tuple, roots: tuple, own: np.ndarray):
        self.none, self.one, self.two, self.roots, self.own = none, one, two, roots, own

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nodes, at = self.roots
        yield nodes[at] - self.own, nodes[at + 1] - self.own
        yield self.one
        both = np.zeros((2, len(self.own)), np.float32)
        both[:, self.two[0]] = self.two[1:]
        yield both[0], both[1]


class BitMixer:
    """Weights by gate and the map that refines. All is symmetric: what is predicted is the bit that came."""

    def __init__(self):
        two = np.arange(GATES) // (2 * (len(SEEN_ONE) + 1) * (len(DEPTHS) + 1))
        one = np.arange(GATES) // (len(DEPTHS) + 1) % (len(SEEN_ONE) + 1)
        self.weights = np.stack([np.where(one > 0, 0.35, 1.0), np.where(one > 0, 0.6, 0.0), np.where(two > 0, 0.6, 0.0)]).astype(np.float32)
        self.squares = np.full((3, GATES), 1e-3)
        self.map = np.tile(1 / (1 + np.exp(-(np.arange(MAP_PLACES) + 0.5) / 4)), ((len(SEEN_TWO) + 1) * 2, 1)).astype(np.float32)
        self.batches = 0

    def run(self, events: Iterator[tuple], score: np.ndarray | None, weight: np.ndarray | None) -> None:
        """events: (rows, which are the first ones, depth, Counts). score gets the rows' log10 probabilities; weight: what is learnt from."""
        rate = RATE / math.sqrt(1 + self.batches / 2)
        self.batches += 1
        flat = self.map.reshape(-1)
        gates = len(flat) // MAP_PLACES * (len(SEEN_ONE) + 1)  # of a depth
        product = np.ones(len(score)) if score is not None else None  # of 64 factors of 2e-5 or more at most, so it is not 0
        for rows, depth, counts in events:
            level = sum(depth > b for b in DEPTHS)
            weights, squares = (a[:, level :: len(DEPTHS) + 1] for a in (self.weights, self.squares))
            w = np.ascontiguousarray(weights)
            n, same = counts.one
            one = same + np.float32(PRIORS[1])
            rest = n - same
            rest += np.float32(PRIORS[1])
            one /= rest
            np.log(one, out=one)
            above = _above(n, SEEN_ONE, 1)
            some, n, same = counts.two
            two = np.log((same + np.float32(PRIORS[2])) / (n - same + np.float32(PRIORS[2])))
            place = _above(n, SEEN_TWO, 2)
            place += ((same > 0) & (same < n)).view(np.uint8)
            above[some] += place * np.uint8(len(SEEN_ONE) + 1)
            gate = above.astype(np.intp)
            dot = w[0].take(gate)
            dot *= counts.none
            more = w[1].take(gate)
            more *= one
            dot += more
            own_gate = gate[some]
            dot[some] += two * w[2].take(own_gate)
            np.clip(dot, np.float32(-12), np.float32(12), out=dot)
            far = np.abs(dot)
            far *= np.float32(4)
            at = np.minimum(far, np.float32(MAP_PLACES - 1), out=far).astype(np.intp)
            at[some] += place * np.intp(MAP_PLACES)
            at += np.multiply(dot < 0, len(flat), dtype=np.intp)  # behind the places of what was right are those of what was wrong
            p = np.negative(dot)
            np.exp(p, out=p)
            p += np.float32(1)
            np.reciprocal(p, out=p)
            if score is not None:
                refined = np.concatenate([flat, 1 - flat]).take(at)
                refined[dot == 0] = 0.5
                refined += p
                refined *= np.float32(0.5)
                np.clip(refined, np.float32(2e-5), np.float32(1 - 2e-5), out=refined)
                product[rows] *= refined
            if weight is not None:
                own = weight[rows]
                error = np.subtract(np.float32(1), p, out=p)
                error *= own
                n = np.bincount(gate, own, gates)
                known = n > 0
                n = np.maximum(n, 1e-9)
                for i, g, x in ((0, gate, error * counts.none), (1, gate, np.multiply(one, error, out=one)), (2, own_gate, two * error[some])):
                    slope = np.bincount(g, x, gates) / n
                    squares[i] += 0.1 * (slope * slope - squares[i]) * known
                    weights[i] += (rate * slope / np.sqrt(squares[i] + 1e-6)).astype(np.float32)
                ones, zeros = np.bincount(at, own, 2 * len(flat)).reshape(2, -1)
                n = zeros + ones
                flat += (np.minimum(MAP_RATE, n / 1000) * (ones / np.maximum(n, 1e-9) - flat)).astype(np.float32)
        if score is not None:
            score += np.log10(product)


class Occurrences:
    """Different (context, leaf, held out) of a bucket, sorted; rows: which of them each occurrence is."""

    def __init__(self, context: np.ndarray, leaf: np.ndarray, held: np.ndarray):
        kind = leaf.astype(np.int64) * 2 + held
        order = np.argsort(context)
        context = context[order]
        group = np.cumsum(np.append(False, context[1:] != context[:-1])[: len(order)])
        again = np.argsort((group << 24) + kind[order])  # context stays as it is
        order = order[again]
        kind = kind[order]
        first = np.ones(len(order), bool)
        first[1:] = (context[1:] != context[:-1]) | (kind[1:] != kind[:-1])
        self.rows = np.empty(len(order), np.int32)
        self.rows[order] = np.cumsum(first, dtype=np.int32) - 1
        at = np.flatnonzero(first)
        self.context, self.leaf, self.held = context[at], (kind[at] >> 1).astype(np.uint32), (kind[at] & 1).astype(bool)
        self.n = np.diff(np.append(at, len(order)))


def scores_of(d: Dictionary, own: Occurrences, hot_one: np.ndarray, hot_n: np.ndarray) -> np.ndarray:
    """log10 probability of each different occurrence of a bucket. hot_one: (token before, leaf) of tokens with several
    buckets, sorted, with their training occurrences in all of them."""
    mixer, score = BitMixer(), np.zeros(len(own.context))
    one = (own.context >> np.uint64(32) << np.uint64(32)) | own.leaf
    head = own.context >> np.uint64(32)
    starts = np.append(np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])), len(head))
    hot_heads = np.unique(hot_one >> np.uint64(32))
    a = 0
    while a < len(head):
        b = int(starts[min(np.searchsorted(starts, a + min(BATCH, FIRST_BATCH + a)), len(starts) - 1)])
        train = np.where(own.held[a:b], 0, own.n[a:b]).astype(np.float32)
        keys, which = np.unique(one[a:b], return_inverse=True)
        n = np.bincount(which, train, len(keys))
        heads = keys >> np.uint64(32)
        if len(hot_heads) and np.isin(heads, hot_heads).any():
            x, y = np.searchsorted(hot_one, [head[a] << np.uint64(32), (head[b - 1] + np.uint64(1)) << np.uint64(32)]) if head[b - 1] < 0xFFFFFFFF else (np.searchsorted(hot_one, head[a] << np.uint64(32)), len(hot_one))
            n[np.isin(heads, hot_heads)] = 0
            all_, at = np.unique(np.concatenate([keys, hot_one[x:y]]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, hot_n[x:y]]), len(all_))
            keys, which = all_, at[: len(keys)][which]
            heads = keys >> np.uint64(32)
        two = Nodes(own.context[a:b], d.codes[own.leaf[a:b]], train)
        first = Nodes(heads, d.codes[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)], n)
        events = Events(d, own.leaf[a:b], own.held[a:b], keys, which, two, first)
        out, train = np.zeros(b - a), train[events.order]
        if not mixer.batches:  # what is known before the first batch is learnt from it
            mixer.run(events.run(), None, train)
        mixer.run(events.run(), out, train)
        score[a:b][events.order] = out
        a = b
    return score


class Events:
    """Bits of a batch, whose rows are put into an order: the longest codes first, so those with so many bits are the first ones."""

    def __init__(self, d: Dictionary, leaf: np.ndarray, held: np.ndarray, keys: np.ndarray, which: np.ndarray, two: Nodes, first: Nodes):
        leaf, own = leaf.astype(np.int64), ~held
        self.d, self.two, self.first, self.own_two = d, two, first, own.astype(np.float32)
        self.sizes, self.one_sizes = d.sizes[leaf], d.sizes[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        self.order = np.argsort((64 - self.sizes) << 32 | leaf << 1 | own)  # equal leaves together, which look up the same
        self.place = np.empty(len(leaf), np.intp)
        self.place[self.order] = np.arange(len(leaf))
        self.which, self.own = which[self.order], self.own_two[self.order]
        self.base = d.starts[leaf[self.order]]
        self.longer = len(leaf) - np.cumsum(np.bincount(self.sizes, minlength=1))  # how many have more bits

    def run(self) -> Iterator[tuple]:
        d, two, first, own_two, place = self.d, self.two, self.first, self.own_two, self.place
        none = d.stretched.reshape(-1)
        at_none = self.base + len(d.nodes) * self.own.astype(np.intp)
        rows, ones = np.arange(len(self.order)), np.arange(len(self.one_sizes))
        at_one = first.at(ones, 0)
        n1, n2 = at_one[self.which] - self.own, two.at(rows, 0) - own_two
        for k, m in enumerate(self.longer.tolist()):
            if not m:
                return
            own = self.own[:m]
            ones = ones[first.split(np.inf) & (self.one_sizes[ones] > k)]
            at_one[ones] = first.at(ones, k + 1)
            same1 = at_one[self.which[:m]]
            same1 -= own
            keep = np.flatnonzero(two.split(1) & (self.sizes[rows] > k))
            if len(keep) < len(rows):
                rows, n2, own_two, place = rows[keep], n2[keep], own_two[keep], place[keep]
            same2 = two.at(rows, k + 1) - own_two
            base = self.base[:m]
            yield slice(0, m), k, Counts(none[k:].take(at_none[:m]), (n1[:m], same1), (place, n2, same2), (d.nodes[k:], base), own)
            n1, n2 = same1, same2


def followers(context: np.ndarray, keys: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of occurrences of spelled tokens, whether one after the same two tokens is the same, so that it needs no spelling;
    log10 probability of that bit, and of the token's share. The bit is predicted by a map that is learnt online."""
    order = np.lexsort((held, keys, context))
    c, k, h = context[order], keys[order], held[order]
    new_context = np.append(True, c[1:] != c[:-1])[: len(c)]
    new_pair = new_context | np.append(True, k[1:] != k[:-1])[: len(c)]
    new = np.flatnonzero(new_pair | np.append(True, h[1:] != h[:-1])[: len(c)])
    each = np.diff(np.append(new, len(c)))
    pair, group, own = (np.cumsum(new_pair) - 1)[new], (np.cumsum(new_context) - 1)[new], ~h[new]
    train = each * own
    n = np.bincount(pair, train)
    total = np.bincount(group, train)
    different = np.bincount(group[np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])], n > 0)
    n, total, different = n[pair] - own, total[group] - own, different[group]
    different = np.maximum(different - (own & (n == 0)), 1)
    seen = n > 0
    place = np.minimum(np.log2(np.maximum(total, 1)).astype(np.int64), FOLLOWED[0] - 1) * FOLLOWED[1]
    place += np.minimum((FOLLOWED[1] - 1) * different // np.maximum(total, 1), FOLLOWED[1] - 1).astype(np.int64)
    score, ones, all_ = np.zeros(len(new)), np.full(math.prod(FOLLOWED), 0.6), np.full(math.prod(FOLLOWED), 2.0)
    for a in range(0, len(new), BATCH):
        at = np.flatnonzero(total[a : a + BATCH] > 0) + a
        learnt = [np.bincount(place[at], train[at] * x, len(ones)) for x in (seen[at], 1)]
        if not a:  # what is known before the first batch is learnt from it
            ones, all_ = ones + learnt[0], all_ + learnt[1]
        p = (ones / all_)[place[at]]
        score[at] = np.log10(np.where(seen[at], p * n[at] / total[at], 1 - p))
        if a:
            ones, all_ = ones + learnt[0], all_ + learnt[1]
    out, told = np.empty(len(c)), np.empty(len(c), bool)
    out[order], told[order] = np.repeat(score, each), np.repeat(seen, each)
    return told, out


# Spark's side


def _packed(a: np.ndarray) -> bytes:
    """Bytes of the same place together, compressed."""
    own = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize)
    out = np.empty(own.shape[::-1], np.uint8)
    for i in range(a.itemsize):
        out[i] = own[:, i]
    return zstandard.compress(out.reshape(-1), 1)


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    own = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1)
    out = np.empty(own.shape[::-1], np.uint8)
    for i in range(size):
        out[:, i] = own[i]
    return out.view(kind).reshape(-1)


DEALT = "bucket int, block long, kind int, a binary, b binary, c binary, d binary"
_DEALT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcd")])
#: Occurrences (contexts, leaves, documents, keys of those with the escape); counts of tokens with several buckets;
#: occurrences of spelled tokens (keys, blocks, documents, whether a context told them); pairs (keys, counts, scores);
#: documents; sums of documents (documents, scores; for spelled tokens base scores and known ones).
CODED, COUNTS, SPELLED, PAIRS, DOCUMENTS, CODED_SUMS, SPELLED_SUMS = range(7)


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], f.type) for i, f in enumerate(_DEALT)], schema=_DEALT)


def pair_keys(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return mixed(h + classes.astype(np.uint64) * _M1)


def _cuts(d: Dictionary, bucket: np.ndarray, then: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets with the places of their rows, in the order of then."""
    order = np.argsort(then)
    order = order[np.argsort(bucket[order].astype(np.uint16 if d.buckets < 65536 else np.uint32), kind="stable")]
    cuts = np.searchsorted(bucket[order], np.arange(d.buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, order[cuts[k] : cuts[k + 1]]


def dealt(d: Dictionary, texts: list[bytes], ids: list, held: np.ndarray, block: int, classes_of: Callable[..., np.ndarray]) -> pa.RecordBatch:
    """Rows DEALT of a block of documents with lower-case texts."""
    h, counts = token_hashes(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint32), counts)
    firsts = np.cumsum(counts) - counts
    found = d.look_up(h)
    here = np.flatnonzero(found >= 0)
    leaf = np.full(len(h), d.escape, np.uint32)
    leaf[here] = d.leaves[found[here]]
    one = np.concatenate([[_START], h[:-1]])
    one[firsts] = _START
    two = np.concatenate([[_START], one[:-1]])
    two[firsts] = _START
    buckets = np.uint64(d.buckets)
    bucket = mixed(one * _M1 + np.uint64(1)) % buckets
    head = mixed(one + np.uint64(7)) >> np.uint64(32)
    rows: list[tuple] = []
    if len(d.hot):
        at = np.minimum(np.searchsorted(d.hot, one), len(d.hot) - 1)
        is_hot = np.flatnonzero(d.hot[at] == one)
        at = at[is_hot]
        own, train = head[is_hot] << np.uint64(32) | leaf[is_hot], ~held[doc[is_hot]]
        for i in np.unique(at).tolist():
            mine, n = np.unique(own[(at == i) & train], return_counts=True)
            if len(mine):
                first = int(mixed(d.hot[i : i + 1] * _M1 + np.uint64(1))[0] % buckets)
                a, b = _packed(mine), _packed(n.astype(np.uint32))
                rows += [((first + k) % d.buckets, block, COUNTS, a, b) for k in range(int(d.parts[i]))]
        bucket[is_hot] = (bucket[is_hot] + mixed(two[is_hot] * _M1) % d.parts[at]) % buckets
    context = head << np.uint64(32) | mixed(two + np.uint64(11)) >> np.uint64(32)
    leaf = leaf * np.uint32(2) + held[doc]
    others = np.flatnonzero(found < 0)
    classes = np.zeros(len(h), np.int64)
    beyond = [not t.isascii() for t in texts]
    if any(beyond):
        classes[np.repeat(beyond, counts)] = classes_of(*compress(texts, beyond))
    keys = np.zeros(len(h), np.uint64)
    keys[others] = pair_keys(h[others], classes[others])
    for k, own in _cuts(d, bucket, context):
        rows.append((k, block, CODED, _packed(context[own]), _packed(leaf[own]), _packed(doc[own]), _packed(keys[own[found[own] < 0]])))
    known = np.bincount(doc[here], minlength=len(texts))
    base = np.bincount(doc[here], d.base[found[here]], len(texts))
    sizes = np.array([len(t.translate(None, b" \t\n\x0b\x0c\r")) for t in texts], np.int64) + counts
    columns = {"doc_id": pa.array(ids, pa.int64()), "held_out": held, "n_tokens": counts.astype(np.int64), "n_bytes": sizes, "n_known": known.astype(np.int64), "base": base}
    own = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, own.schema) as out:
        out.write_batch(own)
    rows.append((block % d.buckets, block, DOCUMENTS, zstandard.compress(sink.getvalue(), 1)))
    return _dealt(rows)


def _deal(dictionary, classes_of: Callable[..., np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, held_out, text) to DEALT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        texts, ids, held, n = [], [], [], 0
        for batch in batches:
            for doc, is_held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                texts.append(text.as_py().encode("utf-8", "surrogatepass").lower())
                ids.append(doc)
                held.append(is_held)
                n += len(texts[-1]) + 1
                if n > BLOCK_BYTES:
                    yield dealt(dictionary.value, texts, ids, np.array(held), block, classes_of)
                    texts, ids, held, n, block = [], [], [], 0, block + 1
        if texts:
            yield dealt(dictionary.value, texts, ids, np.array(held), block, classes_of)

    return run


def _deal_pairs(dictionary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, cls, count, log_prob) to DEALT."""

    def out(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        d, own = dictionary.value, pa.Table.from_batches(batches)
        cls, count, log_prob = (own.column(c).to_numpy() for c in ("cls", "count", "log_prob"))
        keys = pair_keys(hashes_of(as_bytes(own.column("word").combine_chunks())), cls)
        return _dealt([(k, -1, PAIRS, _packed(keys[at]), _packed(count[at].astype(np.int64)), _packed(log_prob[at].astype(np.float64))) for k, at in _cuts(d, keys % np.uint64(d.buckets), keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0  # a batch alone has few pairs of each bucket
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= DEALT_PAIRS:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows with the same key, which follow one another."""
    held: list[dict] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and a < b and keys[a] != held[0][key]:
                yield held
                held = []
            held += batch.slice(a, b - a).to_pylist()
    if held:
        yield held


def context_sums(d: Dictionary, rows: list[dict]) -> Iterator[tuple]:
    """Of a bucket of contexts, rows DEALT: sums of documents; occurrences of spelled tokens, by their keys."""
    kinds: dict[int, list[dict]] = {CODED: [], COUNTS: [], DOCUMENTS: []}
    for r in sorted(rows, key=lambda r: r["block"]):
        kinds[r["kind"]].append(r)
    for r in kinds[DOCUMENTS]:
        yield r["block"] % d.buckets, r["block"], DOCUMENTS, r["a"]
    if not kinds[CODED]:
        return
    hot_one, at = np.unique(_whole(kinds[COUNTS], "a", np.uint64), return_inverse=True)
    hot_n = np.bincount(at, _whole(kinds[COUNTS], "b", np.uint32), len(hot_one))
    leaves = [_unpacked(r["b"], np.uint32) for r in kinds[CODED]]
    context, leaf, doc, sizes = _whole(kinds[CODED], "a", np.uint64), np.concatenate(leaves), _whole(kinds[CODED], "c", np.uint32), list(map(len, leaves))
    del leaves
    held = (leaf & np.uint32(1)).astype(bool)
    leaf >>= np.uint32(1)
    own = Occurrences(context, leaf, held)
    each = scores_of(d, own, hot_one, hot_n)[own.rows]
    del own
    block = np.repeat(np.array([r["block"] for r in kinds[CODED]], np.int64), sizes)
    spelled, keys = np.flatnonzero(leaf == d.escape), _whole(kinds[CODED], "d", np.uint64)
    told, more = followers(context[spelled], keys, held[spelled])
    each[spelled] += more
    a = 0
    for r, n in zip(kinds[CODED], sizes, strict=True):
        docs, which = np.unique(doc[a : a + n], return_inverse=True)
        yield r["block"] % d.buckets, r["block"], CODED_SUMS, _packed(docs), _packed(np.bincount(which, each[a : a + n], len(docs)).astype(np.float32))
        a += n
    block, doc = block[spelled], doc[spelled]
    for k, at in _cuts(d, keys % np.uint64(d.buckets), np.arange(len(keys))):
        yield k, -1, SPELLED, _packed(keys[at]), _packed(block[at]), _packed(doc[at]), _packed(told[at])


def spelled_sums(d: Dictionary, rows: list[dict]) -> Iterator[tuple]:
    """Of a bucket of spelled tokens, rows DEALT with sums of documents."""
    yield from ((r["bucket"], r["block"], r["kind"], r["a"], r["b"]) for r in rows if r["kind"] in (DOCUMENTS, CODED_SUMS))
    pairs, own = ([r for r in rows if r["kind"] == k] for k in (PAIRS, SPELLED))
    if not own:
        return
    keys, count, log_prob = _whole(pairs, "a", np.uint64), _whole(pairs, "b", np.int64), _whole(pairs, "c", np.float64)
    order = np.argsort(keys)
    found, block, doc, told = _whole(own, "a", np.uint64), _whole(own, "b", np.int64), _whole(own, "c", np.uint32), _whole(own, "d", np.bool_)
    at = order[np.searchsorted(keys[order], found)]
    by_doc = np.lexsort((found, doc, block))
    block, doc, at, told = block[by_doc], doc[by_doc], at[by_doc], told[by_doc]
    base, known, score = np.log10(count[at] + 1) - d.denominator, count[at] > 0, np.where(told, 0, log_prob[at])
    cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        docs, which = np.unique(doc[a:b], return_inverse=True)
        sums = [np.bincount(which, x[a:b], len(docs)) for x in (score, base, known)]
        yield int(block[a]) % d.buckets, int(block[a]), SPELLED_SUMS, _packed(docs), _packed(sums[0].astype(np.float32)), _packed(sums[1]), _packed(sums[2].astype(np.uint32))


def _whole(rows: list[dict], column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_unpacked(r[column], kind) for r in rows)])


def _by_bucket(sums: Callable, dictionary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "bucket"):
            yield _dealt(list(sums(dictionary.value, rows)))
            del rows
            pa.default_memory_pool().release_unused()

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, score double"


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches, "block"):
        own = next(pa.ipc.open_stream(zstandard.decompress(r["a"])).read_all() for r in rows if r["kind"] == DOCUMENTS)
        columns = {c: own.column(c).to_numpy().copy() for c in ("n_known", "base")}
        score = np.zeros(own.num_rows)
        for r in sorted((r for r in rows if r["kind"] != DOCUMENTS), key=lambda r: (r["kind"], r["a"], r["b"])):
            docs = _unpacked(r["a"], np.uint32)
            score[docs] += _unpacked(r["b"], np.float32)
            if r["kind"] == SPELLED_SUMS:
                columns["base"][docs] += _unpacked(r["c"], np.float64)
                columns["n_known"][docs] += _unpacked(r["d"], np.uint32)
        parts = [own.column(c).combine_chunks() for c in ("doc_id", "held_out", "n_tokens", "n_bytes")]
        yield pa.RecordBatch.from_arrays([*parts, pa.array(columns["n_known"]), pa.array(columns["base"]), pa.array(score)], [x.split()[0] for x in RESULT.split(", ")])


def scored(docs: DataFrame, pairs: DataFrame, dictionary: Dictionary, classes_of: Callable[..., np.ndarray]) -> DataFrame:
    """RESULT, a row for each of docs (doc_id, held_out, text). pairs: (word, cls, count, log_prob) of all tokens without a code."""
    held = docs.sparkSession.sparkContext.broadcast(dictionary)
    parts = 2 * dictionary.buckets  # few of them hold several buckets
    rows = docs.select("doc_id", "held_out", "text").mapInArrow(_deal(held, classes_of), DEALT)
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_by_bucket(context_sums, held), DEALT)
    rows = rows.unionAll(pairs.select("word", "cls", "count", "log_prob").mapInArrow(_deal_pairs(held), DEALT))
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_by_bucket(spelled_sums, held), DEALT)
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_totals, RESULT)
