"""SentencePiece BPE with seeded merge-dropout.

A text is cut before each run of blanks; blanks become the piece set's mark, and one is put in front. Characters that
no piece has, and the mark itself, are spelled as bytes. Each chunk keeps an agenda of candidate merges, best score
first, then leftmost; a candidate is skipped if a hash of the seed, the document, the chunk's number in the text and
the candidate's place is below the dropout. So each occurrence of a word has its own draws. Any segmentation decodes
to the same text.

The agendas of many chunks of the same length are worked off together: a row of a matrix is a chunk, and each step
makes the best merge of each row. Nothing is remembered from one batch to the next, and no word is dealt with by rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import text_or_empty

DROPOUT, SEED = 0.1, 17
#: Code points of the longest chunk that goes to a matrix (longer ones have an agenda each), and of the texts handled together; rows of a batch that is passed on.
LONGEST, CHUNK, ROWS = 32, 500_000, 500
MARK = "▁"
_NONE = np.int32(2**31 - 1)
_M1, _M2, _ALL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 2**64 - 1
_U1, _U2 = np.uint64(_M1), np.uint64(_M2)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PieceModel:
    """Symbols are pieces by id; other characters are the number of pieces plus their code point."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dropout, self.seed, self.size = dropout, seed, sp.get_piece_size()
        self.least = np.uint64(int(dropout * 2**32))
        ids: dict[str, int] = {}
        self.spelled: list[bytes] = [b""] * self.size
        self.byte = np.zeros(256, "<u4")
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.spelled[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[piece] = i
                self.spelled[i] = piece.replace(MARK, " ").encode()
        if not self.byte.all():
            raise ValueError("the pieces lack bytes, so that not every text can be encoded")
        scores = np.array([-sp.get_score(i) for i in range(self.size)])
        self.rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)  # the best score's is 0
        symbol = lambda s: ids.get(s, self.size + ord(s) if len(s) == 1 else -1)
        pairs = {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                left, right = symbol(piece[:k]), symbol(piece[k:])
                if left >= 0 and right >= 0:
                    pairs[left << 32 | right] = i
        self.pairs = np.array(sorted(pairs), np.int64)
        self.into = np.array([pairs[k] for k in self.pairs.tolist()], np.int32)
        self.known_pairs = dict(zip(self.pairs.tolist(), self.into.tolist(), strict=True))
        #: What a pair's hash says before it is looked up.
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(self.pairs)] = True
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.symbol[ord(" ")] = symbol(MARK)
        self.symbol[ord(MARK)] = self.size + 0x110000  # a mark in the text, which no pair has
        left, end = np.meshgrid(np.arange(LONGEST + 1, dtype=np.uint64), np.arange(LONGEST + 1, dtype=np.uint64), indexing="ij")
        self.places = left * _U1 + end * _U2

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * _U1) >> np.uint64(42)

    def merges(self, left: np.ndarray, right: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each candidate, _NONE if there is no such piece or the candidate is skipped. key: of the chunk; place: of the candidate."""
        rank, into = np.full(left.shape, _NONE), np.zeros(left.shape, np.int32)
        pair = left.astype(np.int64) << np.int64(32) | right
        at = np.flatnonzero(self.maybe[self._slot(pair)])
        pair = pair.reshape(-1)[at]
        found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        good = self.pairs[found] == pair
        if self.least:
            good &= mixed(key.reshape(-1)[at] ^ place.reshape(-1)[at]) >> np.uint64(32) >= self.least
        at, found = at[good], self.into[found[good]]
        into.reshape(-1)[at] = found
        rank.reshape(-1)[at] = self.rank[found]
        return rank, into

    def together(self, symbols: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of rows, their final symbols) for the rows of a matrix, each a chunk."""
        m, n = symbols.shape
        rows = np.arange(m)
        starts = np.broadcast_to(np.arange(n + 1, dtype=np.int8), (m, n + 1))
        first = np.arange(n - 1)
        rank, into = self.merges(symbols[:, :-1], symbols[:, 1:], np.broadcast_to(keys[:, None], (m, n - 1)), np.broadcast_to(self.places[first, first + 2], (m, n - 1)))
        while symbols.shape[1] > 1:
            i = rank.argmin(1)
            open_ = np.take_along_axis(rank, i[:, None], 1)[:, 0] != _NONE
            if not open_.all():
                yield rows[~open_], symbols[~open_]
                rows, symbols, starts, rank, into, keys, i = (x[open_] for x in (rows, symbols, starts, rank, into, keys, i))
                if not len(rows):
                    return
            width, row, at = symbols.shape[1] - 1, np.arange(len(rows)), i[:, None]
            cols = np.arange(width + 1)
            new = into[row, i]
            symbols = np.take_along_axis(symbols, cols[:-1] + (cols[:-1] > at), 1)
            symbols[row, i] = new
            starts = np.take_along_axis(starts, cols + (cols > at), 1)
            keep = cols[: width - 1] + (cols[: width - 1] >= at)
            rank, into = np.take_along_axis(rank, keep, 1), np.take_along_axis(into, keep, 1)
            for shift in (-1, 0):  # the pairs before and after the new symbol
                r = np.flatnonzero(i > 0) if shift else np.flatnonzero(i < width - 1)
                j = i[r] + shift
                rank[r, j], into[r, j] = self.merges(symbols[r, j], symbols[r, j + 1], keys[r], self.places[starts[r, j], starts[r, j + 2]])
        yield rows, symbols

    def alone(self, symbols: list[int], key: int) -> list[int]:
        """The same for a chunk of any length."""
        n = len(symbols)
        own: list[int | None] = list(symbols)
        before, after, ends = list(range(-1, n - 1)), [*range(1, n), -1], list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []
        known, rank = self.known_pairs, self.rank

        def offer(pairs: list[tuple[int, int]]) -> None:
            found = [(left, right, i) for left, right in pairs if left >= 0 and right >= 0 and (i := known.get(own[left] << 32 | own[right])) is not None]
            if self.least and found:
                codes = np.array([(left * _M1 + ends[right] * _M2 & _ALL) ^ key for left, right, _ in found], np.uint64)
                found = [f for f, good in zip(found, mixed(codes) >> np.uint64(32) >= self.least, strict=True) if good]
            for left, right, i in found:
                heapq.heappush(agenda, (int(rank[i]), left, ends[right], right, i))

        offer([(k, k + 1) for k in range(n - 1)])
        while agenda:
            _, left, end, right, i = heapq.heappop(agenda)
            if own[left] is None or after[left] != right or own[right] is None or ends[right] != end or known.get(own[left] << 32 | own[right]) != i:
                continue
            own[left], ends[left], own[right] = i, end, None
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer([(before[left], left), (left, after[left])])
        return [s for s in own if s is not None]

    def encode(self, texts: Sequence[str], documents: Sequence[int]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. An empty text has none. documents: hashes of their ids."""
        out: list[bytes] = []
        held: list[int] = []
        n = 0
        for i, t in enumerate(texts):
            held.append(i)
            n += len(t)
            if n >= CHUNK or i == len(texts) - 1:
                out += self._encode([texts[k] for k in held], [documents[k] for k in held])
                held, n = [], 0
        return out

    def _encode(self, texts: list[str], documents: list[int]) -> list[bytes]:
        codes = np.frombuffer("".join(f" {t}" if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(t) + 1 if t else 0 for t in texts])
        begins = np.concatenate([[0], np.cumsum(sizes)])  # of texts
        blank = codes == ord(" ")
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[begins[:-1][sizes > 0]] = True
        starts = np.flatnonzero(start)
        lengths = np.diff(np.append(starts, len(codes)))
        firsts = np.searchsorted(starts, begins)  # chunks of texts
        text = np.repeat(np.arange(len(texts)), np.diff(firsts))
        seeds = mixed(np.array([(d * _M2 + self.seed) & _ALL for d in documents], np.uint64))
        keys = mixed(seeds[text] + (np.arange(len(starts)) - firsts[text] + 1).astype(np.uint64) * _U1)
        symbols = self.symbol[codes]
        counts = np.zeros(len(starts), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        kind = np.minimum(lengths, LONGEST + 1)
        by = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[by], np.arange(LONGEST + 2))
        for n in range(1, LONGEST + 1):
            own = by[ends[n] : ends[n + 1]]
            if len(own):
                matrix = symbols[starts[own][:, None] + np.arange(n)]
                for rows, found in self.together(matrix, keys[own]):
                    counts[own[rows]] = found.shape[1]
                    done.append((own[rows], found))
        for k in by[ends[LONGEST + 1] :].tolist():
            found = np.array([self.alone(symbols[starts[k] : starts[k] + lengths[k]].tolist(), int(keys[k]))], np.int32)
            counts[k] = found.shape[1]
            done.append((np.array([k]), found))
        at = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(int(at[-1]), np.int64)
        for rows, found in done:
            flat[at[rows][:, None] + np.arange(found.shape[1])] = found
        cuts = at[firsts]
        other = np.flatnonzero(flat >= self.size)
        if len(other):  # spelled as bytes
            points = flat[other] - self.size
            points[points == 0x110000] = ord(MARK)
            spelled = np.frombuffer("".join(map(chr, points.tolist())).encode("utf-8", "surrogatepass"), np.uint8)
            wide = np.ones(len(flat), np.int64)
            wide[other] = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            to = np.concatenate([[0], np.cumsum(wide)])
            ids = np.zeros(int(to[-1]), "<u4")
            ids[to[:-1]] = flat
            which = np.repeat(other, wide[other])
            ids[to[which] + np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(wide[other])[:-1]]), wide[other])] = self.byte[spelled]
            flat, cuts = ids, to[cuts]
        data = flat.astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> str:
        """The text; its first blank was put in front."""
        spelled = self.spelled
        return b"".join([spelled[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "surrogatepass")[1:]


_models: dict[tuple, PieceModel] = {}


def _model(*args) -> PieceModel:
    if args not in _models:
        _models[args] = PieceModel(*args)
    return _models[args]


def _encode(path: str, dropout: float, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, dropout, seed)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                ids = model.encode(batch.column("__text").to_pylist(), batch.column("__document").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_sha256"), pa.array(ids, pa.binary())], ["doc_id", "text_sha256", "ids"])

    return run


def encode_texts(docs: DataFrame, vocabulary: str, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, ids (little-endian unsigned 32-bit integers), text_sha256 of the text.

    A null text is empty and has no ids. A null id is hashed as such. Repeated rows segment alike. Other columns of docs
    are not looked at.
    """
    text = text_or_empty(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"), F.xxhash64(id_col).alias("__document"), text.alias("__text"))
    return own.mapInArrow(_encode(vocabulary, dropout, seed), "doc_id long, text_sha256 string, ids binary")


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded (with doc_id, text_sha256 and ids) with the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(vocabulary, 0.0, 0)
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                texts = [model.decode(x.as_py()) for x in batch.column("ids")]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return encoded.select("doc_id", "text_sha256", "ids").mapInArrow(run, "doc_id long, text_sha256 string, ids binary, text string")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, n_chars of the decoded text, lossless: it is the text that was encoded."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    decoded = decode_ids(encoded, path)
    lossless = F.sha2(F.encode("text", "UTF-8"), 256) == F.col("text_sha256")
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("n_chars"), lossless.alias("lossless"))
