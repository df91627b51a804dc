"""Token ids of whole texts by the tokenizers library, remembered by word within a worker.

The library takes microseconds a word. Both vocabularies split a text at white space before they merge anything, so a
word's ids don't depend on its neighbours, and each worker asks the library for each word once. What is remembered is
bounded and never changes an id: texts for which the split isn't certain go to the library whole.

The words of many texts are split and told apart in whole arrays; only different words are looked up one by one.
"""

from __future__ import annotations

import os
import re
import string
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from foliant.llm.common import as_bytes

#: Words remembered by a worker, at most (about 150 bytes each).
REMEMBERED = 1_000_000
#: After letters, a run of these is a piece of its own in both vocabularies, unless it begins with an apostrophe.
CLOSING = string.punctuation
#: Characters of the texts that are handled together.
CHUNK = 4_000_000

#: What is white space to str.isspace, and which of it _piece doesn't split at.
SPACES = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
OTHER_SPACES = [c for c in SPACES if c not in " \n"]
OTHER_ASCII = [c for c in OTHER_SPACES if c.isascii()]
#: Bytes of ASCII white space as blanks; bytes that are no white space to str.isspace, nor of a character that may be.
TO_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)
NO_SPACE = frozenset(i for i in range(128) if not chr(i).isspace())


def is_letters(text: str) -> bool:
    return text.isalpha() and text.lower().isalpha()


_open: dict[tuple[str, str], WordIds] = {}


class WordIds:
    """kind "spaced": byte-level BPE whose pieces may begin with one space. kind "loose": white space is dropped."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spaced = kind == "spaced"
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # what was known when words were last forgotten
        self.ends = frozenset(CLOSING.encode())
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if self.spaced:
            vocab = self.library.get_vocab()
            self.begins = np.zeros(max(vocab.values()) + 1, bool)
            self.begins[[i for s, i in vocab.items() if s.startswith("Ġ")]] = True
            (self.newline,) = self.whole("\n")
        else:
            (self.mark,) = self.whole("\x01")
            vocab = self.library.get_vocab()
            self.closes = np.zeros(max(vocab.values()) + 1, bool)
            self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.doubled = re.compile(r"\s\s")

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _piece(self, text: str) -> bytes | None:
        """The text with a blank before each word but the first: spaced: "\n\n" begins the text's first word, "\n" a later line's first word."""
        if not self.spaced:
            data = text.encode("utf-8", "surrogatepass").lower()  # the library lowers them too
            return None if b"<|" in data and any(s.encode() in data for s in self.special) else data
        if any(s in text for s in self.special):
            return None
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text:
            return None
        if any(c in text for c in (OTHER_ASCII if text.isascii() else OTHER_SPACES)) and self.doubled.search(text):
            return None
        return b"\n\n" + text.encode().replace(b"\n", b" \n")

    def _words(self, pieces: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The words of all pieces; how many there are up to the end of each."""
        data = b" ".join(pieces)
        if not self.spaced:
            data = data.translate(TO_BLANK)
        blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        sizes = np.diff(blanks, prepend=-1, append=len(data)) - 1
        there = np.ones(len(sizes), bool) if self.spaced else sizes > 0
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        ends = np.cumsum(there)[np.searchsorted(blanks, ends)]
        cuts = np.concatenate([[0], np.cumsum(sizes[there])]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data.translate(None, b" "))]), ends

    def _learn_together(self, keys: list, ends: np.ndarray, ids: np.ndarray) -> None:
        data = ids.tobytes()
        cuts = [0, *(4 * ends).tolist(), len(data)]
        if len(cuts) != len(keys) + 1:
            raise ValueError(f"{len(keys)} words became {len(cuts) - 1} in the library")
        self.known.update(zip(keys, map(data.__getitem__, map(slice, cuts, cuts[1:])), strict=False))

    def _find(self, key: bytes) -> bytes | None:
        """A word that was known before is known again."""
        ids = self.known.get(key)
        if ids is None:
            ids = self.before.get(key)
            if ids is not None:
                self.known[key] = ids
        return ids

    def learn(self, new: list[bytes]) -> None:
        """Ask the library for words that aren't known yet. Letters and closing marks are put together from both."""
        alone, both, closing = set(), [], CLOSING.encode()
        for k in new:
            if k and k[-1] in self.ends:
                stem = k.rstrip(closing)
                letters = stem.lstrip(b"\n") if self.spaced else stem
                if (letters.isalpha() or is_letters(letters.decode("utf-8", "surrogatepass"))) and k[len(stem)] != 39:
                    both.append((k, stem, k[len(stem) :]))
                    if self._find(stem) is None:
                        alone.add(stem)
                    continue
            alone.add(k)
        (self._learn_spaced if self.spaced else self._learn_loose)(alone)
        for k, stem, marks in both:
            name = (b"\n\n" if self.spaced else b"\0marks ") + marks
            if self._find(name) is None:
                self.known[name] = self.whole(marks.decode()).tobytes()
            self.known[k] = self.known[stem] + self.known[name]

    def ids_of(self, keys: list[bytes]) -> list[bytes]:
        """The ids of different words. When half of what is remembered at most is known, it becomes what was known
        before, of which those words stay that are met again until the next time."""
        if len(self.known) > REMEMBERED // 2:
            self.before, self.known = self.known, {}
        ids = list(map(self.known.get, keys))
        missing = [i for i, x in enumerate(ids) if x is None]
        self.learn([keys[i] for i in missing if self._find(keys[i]) is None])
        for i in missing:
            ids[i] = self.known[keys[i]]
        return ids

    def _learn_loose(self, new: set[bytes]) -> None:
        letters = [k for k in new if k.isalpha()]  # of ASCII
        plain = []
        for k in new.difference(letters):
            word = k.decode("utf-8", "surrogatepass")
            if word.isalpha():
                letters.append(k)
            elif b"\x01" in k or b"<|" in k:
                self.known[k] = self.whole(word).tobytes()
            else:
                plain.append(k)
        if letters:
            ids = self.whole(b" ".join(letters).decode("utf-8", "surrogatepass"))
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(letters):
                self._learn_together(letters, ends[:-1], ids)
            else:  # letters that become something else when normalised
                plain += letters
        if plain:
            ids = self.whole(b" \x01 ".join(plain).decode("utf-8", "surrogatepass"))
            marks = np.flatnonzero(ids == self.mark)
            keep = np.ones(len(ids), bool)
            keep[marks] = False
            self._learn_together(plain, marks - np.arange(len(marks)), ids[keep])

    def _learn_spaced(self, new: set[bytes]) -> None:
        rests, firsts = [], []
        for k in new:
            if k and k[0] in NO_SPACE and k[-1] in NO_SPACE:
                rests.append(k)
                continue
            key = k.decode()
            word = key.lstrip("\n")
            if not word or word[0].isspace() or word[-1].isspace():
                text = word if key.startswith("\n\n") else key if key.startswith("\n") else " " + key
                self.known[k] = self.whole(text).tobytes() if text else b""
            else:
                (firsts if key[0] == "\n" else rests).append(k)
        if rests:
            ids = self.whole(" " + b" ".join(rests).decode())
            self._learn_together(rests, np.flatnonzero(self.begins[ids])[1:], ids)
        if firsts:
            ids = self.whole(b"\n".join(k.lstrip(b"\n") for k in firsts).decode())
            at = np.flatnonzero(ids == self.newline)
            keep = np.ones(len(ids), bool)
            keep[at] = False
            self._learn_together(firsts, at - np.arange(len(at)), ids[keep])
            newline = np.array([self.newline], "<u4").tobytes()
            for k in firsts:
                if not k.startswith(b"\n\n"):
                    self.known[k] = newline + self.known[k]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        chunk: list[str] = []
        n = 0
        for text in texts:
            chunk.append(text)
            n += len(text)
            if n >= CHUNK:
                yield from self._encode(chunk)
                chunk, n = [], 0
        yield from self._encode(chunk)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        pieces = [self._piece(t) for t in texts]
        plain = [x for x in pieces if x is not None]
        parts: Iterator[bytes] = iter(())
        if plain:
            words, ends = self._words(plain)
            words = words.dictionary_encode()
            ids = pa.array(self.ids_of(as_bytes(words.dictionary)), pa.large_binary()).take(words.indices)
            cuts = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[np.append(0, ends)].tolist()
            data = memoryview(ids.buffers()[2] or b"")
            parts = (bytes(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        for text, piece in zip(texts, pieces, strict=True):
            yield next(parts) if piece is not None else self.whole(text).tobytes()


def word_ids(path: str, kind: str) -> WordIds:
    """One for each worker process and vocabulary file."""
    if (path, kind) not in _open:
        _open[path, kind] = WordIds(path, kind)
    return _open[path, kind]
