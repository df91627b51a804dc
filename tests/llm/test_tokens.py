import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import SF

from foliant.llm import packing, pieces, token_files, tokens
from foliant.llm.tokens import word_ids


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "loose")])
def test_word_ids_equal_the_library(spark, name, kind):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    rnd = random.Random(1)
    texts += ["", " ", "\n", " x", "x ", "a  b", "x,\ny, z", "ΣΑΣ, İ, İ", "a\x1cb \x85 \xa0c", "<|endoftext|> a", "<|ENDOFTEXT|>b", "it's don't", "a\x01b", "1, 2."]
    texts += ["".join(rnd.choice(" ab\n\t'sé1!,.\x1c\xa0Σİ<|") for _ in range(rnd.randint(1, 30))) for _ in range(800)]
    ids = word_ids(public_tokenizers.path(name), kind)
    for t, got in zip(texts, ids.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids.library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "loose")])
def test_common_words_are_asked_for_once(monkeypatch, name, kind):
    """Words that have been met again outlast the others, and marks behind a known word need no new look at the word."""
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    ids, rnd, asked = tokens.WordIds(public_tokenizers.path(name), kind), random.Random(2), []
    whole = ids.whole
    monkeypatch.setattr(ids, "whole", lambda text: asked.append(text) or whole(text))
    common = ["über", "rain", "été"]
    for i in range(30):
        rare = ["".join(rnd.choice("abcdeé") for _ in range(9)) for _ in range(8)]
        marks = ["!", "&&&", ".***", "'s", "'", "_"][i % 6]
        text = " ".join(["x", *common, *rare, *(w + marks for w in common), "\nx"]).replace(" \n", "\n")
        (got,) = ids.encode([text])
        assert np.frombuffer(got, "<u4").tolist() == ids.library.encode(text, add_special_tokens=False).ids
    assert len(ids.known) < 100
    assert sum(t.split().count("rain") for t in asked) == 1


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "loose")])
def test_a_word_is_looked_up_once_however_often_it_stands(name, kind):
    class Known(dict):
        looked = 0

        def __getitem__(self, key):
            Known.looked += 1
            return super().__getitem__(key)

        def get(self, *key):
            Known.looked += 1
            return super().get(*key)

    ids = tokens.WordIds(public_tokenizers.path(name), kind)
    ids.known = Known()
    texts = ["rain falls, été!\n" * 500 + "x", "", " ", "falls rain", "<|endoftext|>"]
    for own in ([], *([t] for t in texts), texts):
        got = [np.frombuffer(x, "<u4").tolist() for x in ids.encode(own)]
        assert got == [ids.library.encode(t, add_special_tokens=False).ids for t in own]
    assert Known.looked < 150


pieces_re = re.compile(" *[^ ]+| +")


def test_best_fit_and_its_bins():
    rnd = random.Random(4)
    bins, own = packing.BestFit(100, 8), {}
    lengths = [rnd.randint(1, 99) for _ in range(3000)]
    for n in lengths:
        b, at = bins.put(n)
        assert at == own.get(b, 0) and at + n <= 100 and bins.open <= 8
        own[b] = at + n
    assert len(own) <= 1.1 * sum(lengths) / 100


def check_packing(pieces_, room):
    for doc in {(p.doc_id) for p in pieces_}:
        assert doc is None or all(p.length <= room for p in pieces_ if p.doc_id == doc)
    by = {}
    for p in pieces_:
        by.setdefault(p.sequence_id, []).append(p)
    for ps in by.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= room


def test_packing_keeps_all_tokens(odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(odd, path, with_ids=True).collect()
    check_packing(got, packing.ROOM)
    library = word_ids(path, "spaced").library
    for r in odd.collect():
        want = [*library.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID]
        if r.doc_id not in (None, 5):
            own = sorted((p for p in got if p.doc_id == r.doc_id), key=lambda p: p.piece)
            assert np.frombuffer(b"".join(bytes(p.ids) for p in own), "<u4").tolist() == want and len(own) == -(-len(want) // packing.ROOM)
            assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 and p.start == sum(q.length for q in own[: p.piece]) for p in own)
    assert packing.pack_documents(empty, path).count() == 0


def test_codes_give_back_any_id():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([0, 255, 256, 2**32 - 1], np.uint32), rng.integers(0, 70000, 5000).astype(np.uint32)):
        codes = token_files.Codes(token_files.encode_codes(ids))
        assert (codes.all() == ids).all() and all(codes[i] == ids[i] for i in range(0, len(ids), 7))


def test_token_files_round_trip(spark, odd, empty, tmp_path):
    path, vocabulary = f"file://{tmp_path}/ids", public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(odd, path, vocabulary, 2)
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got][:2] == [None, None] and [r.doc_id for r in got][2:] == sorted(r.doc_id for r in got[2:])
    at = 0
    library, texts = word_ids(vocabulary, "loose").library, {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
            assert (len(ids), zlib.crc32(ids.tobytes())) == (r.n_tokens, r.ids_crc32)
            assert token_files.token_at(spark, path, r.start + r.n_tokens - 1) == 2
    token_files.write_token_files(empty, f"{path}2", vocabulary, 2)
    assert token_files.read_documents(spark, f"{path}2").count() == 0


def test_pieces_without_dropout_equal_sentencepiece_and_decode(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, plain, dropped = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceModel(path, 0.0), pieces.PieceModel(path)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]
    one = lambda m, t, v=0: m.encode([t], [v])[0]
    for t in texts:
        assert np.frombuffer(one(plain, t), "<u4").tolist() == sp.encode(t)
    for t in [*texts, "", " ", "  a  b ", "▁ x▁▁y", "日本語 😀\x00", "a" * 3000, "<s> </s> <0x41>"]:
        assert all(m.decode(one(m, t, v)) == t for m in (plain, dropped) for v in range(4))
    assert one(dropped, texts[0], 1) == one(pieces.PieceModel(path), texts[0], 1) and len({one(dropped, texts[0], v) for v in range(4)}) > 1


def test_pieces_odd_rows(odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.decode_ids(pieces.encode_texts(odd, path), path)
    assert sorted((r.text for r in got.collect())) == sorted(r.text or "" for r in odd.collect())
    assert pieces.encode_texts(empty, path).count() == 0


def agenda_of(model, vocabulary, chunk, skipped):
    """A chunk's pieces by looking through all candidates at every step."""
    parts = [("▁" if c == " " else c if c != "▁" else "\0", k, k + 1) for k, c in enumerate(chunk)]
    while True:
        found = [(model.rank[vocabulary[x[0] + y[0]]], x[1], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x[0] + y[0] in vocabulary and not skipped(x[1], y[2])]  # noqa: B905
        if not found:
            return [i for p, *_ in parts for i in ([vocabulary[p]] if p in vocabulary else model.byte[list(p.replace("\0", "▁").encode())].tolist())]
        i = min(found)[2]
        parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], parts[i][1], parts[i + 1][2])]


def test_each_occurrence_has_its_own_draws(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, n = pieces.PieceModel(path), 600
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    words = ["international", "documents", "a", "zürich", "😀x", "y" * 60, "", "w▁x", "abc" * 10 + "d"]
    rnd = random.Random(3)
    text = " ".join(rnd.choice(words) for _ in range(n))
    chunks = pieces_re.findall(" " + text)
    forms, share = set(), []
    for doc in (5, -(2**63)):  # matrices, agendas and looking through all candidates give the same
        first = pieces.mixed(np.array([(doc * pieces._M2 + model.seed) & pieces._ALL], np.uint64))
        keys = pieces.mixed(first + np.arange(1, len(chunks) + 1, dtype=np.uint64) * np.uint64(pieces._M1))
        want = []
        for c, key in zip(chunks, keys.tolist(), strict=True):
            draw = lambda left, end, key=key: int(pieces.mixed(np.array([key ^ (left * pieces._M1 + end * pieces._M2 & pieces._ALL)], np.uint64))[0] >> np.uint64(32)) < int(model.least)
            want.append(agenda_of(model, vocabulary, c, draw))
            share += [draw(i, i + 2) for i in range(20)]
            if c == " international":
                forms.add(tuple(want[-1]))
        want = [i for ids in want for i in ids]
        assert np.frombuffer(model.encode([text], [doc])[0], "<u4").tolist() == want
        monkeypatch.setattr(pieces, "LONGEST", 2)
        assert np.frombuffer(model.encode(["", text, "x"], [1, doc, 2])[1], "<u4").tolist() == want
        monkeypatch.undo()
    assert len(forms) > 8 and len(set(model.encode(["international documents"] * 500, range(500)))) > 20
    assert abs(np.mean(share) - pieces.DROPOUT) < 0.01
