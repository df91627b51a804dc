"""Quality rules and n-gram perplexity: a modified Kneser-Ney model counted by Spark, with bands for each language.

A text is its words with one blank after each. The model predicts each symbol from the ORDER - 1 symbols before it, so
its n-grams span words. It is counted over all trusted documents: those that pass the base rules and have few symbols.
Spark counts the n-grams and works out discounts, probabilities and back-off weights of all orders by joins. What comes
of it is sorted arrays of 64-bit hashes with their values. They are cut into pieces by ranges of hashes, no piece has
more than PIECE entries, and the driver and a task hold one piece at a time, however many there are. The order and the
verdicts don't depend on the number of pieces.

A document's statistic is its cross-entropy a symbol (the logarithm of its perplexity). Each language has a lower and an
upper band around the median of its trusted documents, each from that side's own spread, and wider for shorter texts,
as the mean of fewer symbols is; documents outside are rejected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, text_or_empty

ORDER = 5
#: Entries of a piece of the model, at most (18 bytes each).
PIECE = 8_000_000
#: Base rules: least words; most words in repeated 5-word windows, in hundredths.
LEAST_WORDS, MOST_REPEATED = 10, 20
SYMBOLS, BLANKS, WINDOW = "#*$%&|<>", " \t\n\x0b\x0c\r", 5
#: Trusted documents have at most one symbol for so many characters of words.
TRUSTED_CHARS = 50
#: A band is the median plus or minus this and so many times that side's spread (of 95 % of the trusted documents) over the root of the symbols.
BAND, SPREADS, TAIL = 0.05, 3.0, 0.05
#: Languages with fewer trusted documents have the band of all languages.
LEAST_DOCS = 50
#: Characters of texts handled together with one piece, and with more; different n-grams that a task holds before it passes them on.
CHUNK, LONG_CHUNK, HELD = 500_000, 8_000_000, 300_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    return h ^ (h >> np.uint64(27))


def hashed(codes: Sequence[np.ndarray], n: int) -> np.ndarray:
    """64-bit hash of n rows of columns, which are symbols from left to right."""
    h = np.full(n, len(codes) + 1, np.uint64)
    for c in codes:
        h = mixed((h + c.astype(np.uint64)) * _M1)
    return h


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def symbols_of(text: str, order: int) -> np.ndarray:
    """order - 1 blanks, then the words with a blank after each."""
    codes = code_points(f"{text} ")
    blank = (codes < 128) & _BLANK[np.minimum(codes, 255)]
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # a blank after a word
    own = codes[keep]
    return np.concatenate([np.full(order - 1, 32, np.uint32), np.where(blank[keep], np.uint32(32), own)])


class Texts:
    """Symbols of texts one after another: at are the places that are predicted, sizes how many of them each text has."""

    def __init__(self, texts: list[str], order: int):
        self.order = order
        own = [symbols_of(t, order) for t in texts]
        self.codes = np.concatenate(own) if own else np.zeros(0, np.uint32)
        self.sizes = np.array([len(x) - order + 1 for x in own], np.int64)
        self.at = np.arange(int(self.sizes.sum())) + np.repeat(np.arange(1, len(own) + 1), self.sizes) * (order - 1)

    def columns(self, k: int, at: np.ndarray) -> list[np.ndarray]:
        """The k symbols that end at each place."""
        return [self.codes[at - k + 1 + j] for j in range(k)]

    def sums(self, values: np.ndarray) -> list[float]:
        """Of each text; always in the same order of adding."""
        cuts = np.concatenate([[0], np.cumsum(self.sizes)])
        return [float(values[a:b].sum()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class Piece:
    """Entries whose hash is in a range. tables[2 * k]: sorted hashes of k-grams and their log probabilities; tables[2 * k + 1]: of the contexts of k-grams and their log back-off weights."""

    def __init__(self, rows: pa.Table):
        slot, h, value = (rows.column(c).to_numpy() for c in ("slot", "hash", "value"))
        h = h.view(np.uint64)
        by = np.lexsort((h, slot))
        slot, h, value = slot[by], h[by], value[by]
        self.tables = {int(k): self._table(h[a:b], value[a:b]) for k in np.unique(slot) for a, b in [np.searchsorted(slot, [k, k + 1])]}

    @staticmethod
    def _table(own: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
        """With where the hashes of each equal part of their range begin: as many parts as hashes, which are spread evenly."""
        width = int(own[-1]) - int(own[0])
        shift = np.uint64(max(0, width.bit_length() - len(own).bit_length()))
        parts = np.arange((width >> int(shift)) + 1, dtype=np.uint64)
        return own, values, np.searchsorted(own, own[0] + (parts << shift)).astype(np.int32), shift

    def find(self, slot: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and the values of those that are."""
        if slot not in self.tables:
            return np.zeros(len(keys), bool), np.zeros(0)
        own, values, first, shift = self.tables[slot]
        place = first[np.minimum((keys - own[0]) >> shift, np.uint64(len(first) - 1)).astype(np.int64)]
        behind = np.flatnonzero(own[place] < keys)
        while len(behind):
            behind = behind[place[behind] < len(own) - 1]
            place[behind] += 1
            behind = behind[own[place[behind]] < keys[behind]]
        found = own[place] == keys
        return found, values[place[found]]


class Model:
    """What tasks get: the pieces as broadcasts, in order of their ranges, which all have the same width."""

    def __init__(self, order: int, symbols: int, pieces: list):
        self.order, self.floor, self.pieces = order, -float(np.log(symbols + 1.0)), pieces
        self.loaded: Piece | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "loaded": None}

    def _piece(self, i: int) -> Piece:
        if len(self.pieces) == 1:
            self.loaded = self.loaded or self.pieces[0].value
            return self.loaded
        held = self.pieces[i].value
        self.pieces[i].__dict__.pop("_value", None)  # the next piece takes its memory
        return held

    def find(self, slot: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces) == 1:
            return self._piece(0).find(slot, keys)
        found, values = np.zeros(len(keys), bool), np.zeros(len(keys))
        which = piece_of(keys, len(self.pieces))
        for i in range(len(self.pieces)):
            at = np.flatnonzero(which == i)
            if len(at):
                good, own = self._piece(i).find(slot, keys[at])
                found[at[good]], values[at[good]] = True, own
        return found, values[found]

    def log_probs(self, texts: Texts) -> list[float]:
        """Of each text."""
        out, left = np.zeros(len(texts.at)), np.arange(len(texts.at))
        for k in range(self.order, 0, -1):
            columns = texts.columns(k, texts.at[left])
            found, p = self.find(2 * k, hashed(columns, len(left)))
            out[left[found]] += p
            left = left[~found]
            if not len(left):
                break
            found, gamma = self.find(2 * k + 1, hashed([c[~found] for c in columns[:-1]], len(left)))
            out[left[found]] += gamma
        out[left] += self.floor
        return texts.sums(out)


def piece_of(hashes: np.ndarray, pieces: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)


def repeated(text: bytes) -> tuple[int, int]:
    """Words, and words in WINDOW-word windows that occur twice or more in the text."""
    data = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], ~_BLANK[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if n < WINDOW + 1:
        return n, 0
    word = np.repeat(np.arange(n), ends - starts)
    at = np.flatnonzero(inside[1:-1])
    powers = np.full(int((ends - starts).max()), np.uint64(0xD6E8FEB86659FD93))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[at].astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(powers)[at - starts[word]])])
    cuts = np.concatenate([[0], np.cumsum(ends - starts)])
    numbers = mixed((sums[cuts[1:]] - sums[cuts[:-1]]) * _M1)
    h = hashed([numbers[j : n - WINDOW + 1 + j] for j in range(WINDOW)], n - WINDOW + 1)
    by = np.argsort(h)
    same = h[by][1:] == h[by][:-1]
    if not same.any():
        return n, 0
    twice = np.zeros(len(h), bool)
    twice[by[1:][same]] = twice[by[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return n, int((np.cumsum(edges)[:-1] > 0).sum())


def base_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    words, again = repeated(text.encode("utf-8", "surrogatepass"))
    return words, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words


def trusted(base: tuple[int, int, int, int, int]) -> bool:
    return not base_failed(base[0], base[4]) and TRUSTED_CHARS * base[2] <= base[1]


def _chunks(column: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """Place of the first and texts, which have about most characters together."""
    held: list[str] = []
    n = start = 0
    for i, t in enumerate(column):
        held.append(t.as_py() or "")
        n += len(held[-1])
        if n >= most:
            yield start, held
            held, n, start = [], 0, i + 1
    if held:
        yield start, held


def _count_grams(order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, codes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, at, which = np.unique(h, return_index=True, return_inverse=True)
        return h, codes[at], np.bincount(which, n, len(h)).astype(np.int64)

    def grams(parts: list) -> pa.RecordBatch:
        _, codes, n = merged(parts)
        text = np.ascontiguousarray(codes, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return pa.RecordBatch.from_arrays([pa.array([text[i : i + order] for i in range(0, len(text), order)], pa.string()), pa.array(n)], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for batch in batches:
            for _, texts in _chunks(batch.column(0), CHUNK):
                own = Texts([t for t in texts if trusted(base_rules(t))], order)
                columns = own.columns(order, own.at)
                h, at, n = np.unique(hashed(columns, len(own.at)), return_index=True, return_counts=True)
                parts.append((h, np.stack([c[at] for c in columns], 1), n))
                if sum(len(x[0]) for x in parts) > 2 * HELD:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > HELD:
                        yield grams(parts)
                        parts = []
        if parts:
            yield grams(parts)

    return run


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, key, value) to (slot, hash, value, range): key are the symbols."""
    for batch in batches:
        keys = batch.column("key").to_pylist()
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        codes, starts = code_points("".join(keys)), np.concatenate([[0], np.cumsum(lengths)])[:-1]
        out = np.zeros(len(keys), np.uint64)
        for k in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == k)
            out[rows] = hashed([codes[starts[rows] + j] for j in range(k)], len(rows))
        yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(out.view(np.int64)), batch.column("value")], ["slot", "hash", "value"])


def kneser_ney(grams: DataFrame, order: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(slot, key, value) of all orders as log probabilities and weights, see Piece, and the number of symbols. grams: (gram, n) of the highest order."""
    level = {order: scratch.table(grams.select("gram", "n"), f"grams-{order}")}
    for k in range(order - 1, 0, -1):  # a lower order counts the symbols before it
        level[k] = scratch.table(level[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams-{k}")
    symbols = level[1].count()
    out, below = None, None
    for k in range(1, order + 1):
        own = level[k]
        n = [max(x or 0, 1) for x in own.agg(*(F.count_if(F.col("n") == j) for j in (1, 2, 3, 4))).first()]
        y = n[0] / (n[0] + 2 * n[1])
        less = [min(max(x, 0.01), j) for j, x in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2]))]
        own = own.withColumn("d", F.when(F.col("n") == 1, less[0]).when(F.col("n") == 2, less[1]).otherwise(less[2])).withColumn("context", F.substring("gram", 1, k - 1))
        contexts = own.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("gamma"))
        contexts = scratch.table(contexts, f"contexts-{k}")
        joined = own.join(contexts, "context")
        if below is None:
            joined = joined.withColumn("low", F.lit(1.0 / (symbols + 1)))
        else:
            joined = joined.withColumn("short", F.substring("gram", 2, k - 1)).join(below.select(F.col("gram").alias("short"), F.col("p").alias("low")), "short")
        below = scratch.table(joined.select("gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("low")).alias("p")), f"p-{k}")
        rows = below.select(F.lit(2 * k).alias("slot"), F.col("gram").alias("key"), F.ln("p").alias("value"))
        rows = rows.unionAll(contexts.select(F.lit(2 * k + 1).alias("slot"), F.col("context").alias("key"), F.ln(F.greatest("gamma", F.lit(1e-12))).alias("value")))
        out = rows if out is None else out.unionAll(rows)
    return out, symbols


def fit_model(docs: DataFrame, text_col: str = "text", order: int = ORDER, piece: int = PIECE) -> Model:
    """Counts over all trusted documents. The driver holds one piece of at most about piece entries at a time."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "grams")
    grams = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(_count_grams(order), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows, symbols = kneser_ney(grams, order, scratch)
    rows = scratch.table(rows.mapInArrow(_hash_rows, "slot int, hash long, value double"), "hashed")
    pieces = max(-(-rows.count() // piece), 1)
    high = F.shiftrightunsigned("hash", 32)
    held = []
    for i in range(pieces):
        own = rows if pieces == 1 else rows.where(F.shiftrightunsigned(high * F.lit(pieces), 32) == i)
        held.append(spark.sparkContext.broadcast(Piece(own.toArrow())))
        held[-1].__dict__.pop("_value", None)  # its file holds it
    scratch.drop()
    return Model(order, symbols, held)


def _score(model: Model, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = CHUNK if len(model.pieces) == 1 else LONG_CHUNK
        for whole in batches:
            for start, texts in _chunks(whole.column(whole.num_columns - 1), most):
                batch = whole.slice(start, len(texts))
                own = Texts(texts, model.order)
                rows = [(*base_rules(t), p, n) for t, p, n in zip(texts, model.log_probs(own), own.sizes.tolist(), strict=True)]
                kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64()]
                kept = batch.num_columns if with_text else batch.num_columns - 1
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], [*batch.schema.names[:kept], *SCORED])

    return run


SCORED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_prob", "n_predicted"]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    cross_entropy, lower, upper, kept; and the columns named in keep.

    A null or empty text has no words, fails the base rules and has a null cross-entropy. A null language is one of its
    own. Without any trusted document there are no bands, and the base rules alone decide. Repeated rows are judged alike.
    """
    spark = docs.sparkSession
    model = fit_model(docs, text_col)
    lang = F.coalesce(F.col(lang_col), F.lit("")) if lang_col else F.lit("")
    keep = keep or []
    kept_as = {c: "__text" if c == text_col else f"__keep_{i}" for i, c in enumerate(keep)}
    own = docs.select(F.col(id_col).alias("__id"), lang.alias("__lang"), *(F.col(f"`{c}`").alias(n) for c, n in kept_as.items() if c != text_col), F.col(text_col).alias("__text"))
    kinds = ", ".join([*(f"`{n}` {t}" for n, t in own.dtypes[: None if text_col in keep else -1]), *(f"{c} {'double' if c == 'log_prob' else 'bigint'}" for c in SCORED)])
    scored = own.mapInArrow(_score(model, text_col in keep), kinds)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("cross_entropy", F.when(F.col("n_words") > 0, -F.col("log_prob") / F.col("n_predicted")))
    scored = Scratch(spark, "quality").table(scored, "scored")
    ok = scored.where(~F.col("base_failed") & (TRUSTED_CHARS * F.col("n_symbols") <= F.col("word_chars")))
    ok = ok.select("__lang", "cross_entropy", F.sqrt("n_predicted").alias("root"))

    def bands(rows: DataFrame, keys: list[str]) -> DataFrame:
        """middle, below, above: the median, and how far beside it 95 % of the documents are, times the root of their symbols."""
        middle = rows.groupBy(*keys).agg(F.percentile_approx("cross_entropy", 0.5, 10_000).alias("middle"), F.count(F.lit(1)).alias("docs"))
        middle = middle.withColumns({f"__{k}": F.col(k) for k in keys}).drop(*keys)
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] or [F.lit(True)]
        far = (F.col("cross_entropy") - F.col("middle")) * F.col("root")
        tails = rows.join(F.broadcast(middle) if small or not keys else middle, on[0])
        tails = tails.groupBy(*keys, "middle", "docs").agg(F.percentile_approx(far, [TAIL, 1 - TAIL], 10_000).alias("q"))
        return tails.select(*keys, "docs", F.struct("middle", F.greatest(-F.col("q")[0], F.lit(0.0)).alias("below"), F.greatest(F.col("q")[1], F.lit(0.0)).alias("above")).alias("band"))

    small = ok.select("__lang").distinct().limit(10_001).count() <= 10_000
    everywhere = bands(ok, []).first()
    own = bands(ok, ["__lang"]).select(F.col("__lang").alias("__band"), F.when(F.col("docs") >= LEAST_DOCS, F.col("band")).alias("band"))
    out = scored.join(F.broadcast(own) if small else own, F.col("__lang") == F.col("__band"), "left")
    band = F.coalesce("band", F.struct(*(F.lit(float(everywhere["band"][k])).alias(k) for k in ("middle", "below", "above")))) if everywhere else F.col("band")
    root = F.sqrt(F.greatest("n_predicted", F.lit(1)))
    out = out.withColumn("band", band).withColumn("lower", F.col("band.middle") - BAND - SPREADS * F.col("band.below") / root).withColumn("upper", F.col("band.middle") + BAND + SPREADS * F.col("band.above") / root)
    inside = F.coalesce(F.col("cross_entropy").between(F.col("lower"), F.col("upper")), F.lit(True))
    out = out.withColumn("kept", ~F.col("base_failed") & inside)
    return out.select(F.col("__id").alias(id_col), *(F.col(n).alias(c) for c, n in kept_as.items() if c != id_col), *SCORED[:5], "base_failed", "cross_entropy", "lower", "upper", "kept")


def passed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    hidden = docs.select(*(F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(docs.columns)))
    name = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    out = judge(hidden, name[id_col], name[text_col], name[lang_col] if lang_col else None, list(hidden.columns)).where("kept")
    return out.select(*(F.col(n).alias(c) for c, n in name.items()))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
