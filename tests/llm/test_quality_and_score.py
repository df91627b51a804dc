import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from helpers import SF

from foliant.llm import lm_contexts, lm_score, lm_segments, quality
from foliant.llm.queries import QUERIES


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_base_rules_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op8_quality_rules"](spark, SF).collect():
        t, w = texts[r.doc_id], words_of(texts[r.doc_id])
        grams, again = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), [False] * len(w)
        for i in range(len(w) - 4):
            if grams[tuple(w[i : i + 5])] > 1:
                again[i : i + 5] = [True] * 5
        lines = [x for x in t.split("\n") if words_of(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * sum(again) > 20 * len(w)) and (not r.base_failed or not r.kept)


def test_perplexity_rejects_junk_and_keeps_the_rest(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [r for r in QUERIES["op8_quality_rules"](spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels and not r.base_failed]
    good, bad = [r for r in got if labels[r.doc_id]], [r for r in got if not labels[r.doc_id]]
    assert sum(not r.kept for r in good) <= 0.01 * len(good) and sum(not r.kept for r in bad) >= 0.9 * len(bad)


def brute_kneser_ney(counts, order):
    """Straight from the definition, with dictionaries."""
    level = {order: counts}
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    p, gamma = {}, {}
    for k in range(1, order + 1):
        n = [max(sum(c == j for c in level[k].values()), 1) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [0] + [min(max(x, 0.01), j) for j, x in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2]))]
        total = Counter()
        for g, c in level[k].items():
            total[g[:-1]] += c
        for x in total:
            gamma[k, x] = sum(d[min(c, 3)] for g, c in level[k].items() if g[:-1] == x) / total[x]
        for g, c in level[k].items():
            p[k, g] = (c - d[min(c, 3)]) / total[g[:-1]] + gamma[k, g[:-1]] * (p[k - 1, g[1:]] if k > 1 else 1 / (len(level[1]) + 1))
    return p, gamma, len(level[1]) + 1


TRUSTED = ["the cat sat on the mat with a hat and then it ran off again", "thé ü😀 cart and  the\ncat then sat in a cart of the old man by the sea", "a b c d e f g h i j k l m n"]


def test_model_equals_brute_force(spark):
    order, counts = 3, Counter()
    for t in TRUSTED:
        s = " " * (order - 1) + "".join(w + " " for w in t.split())
        counts.update(s[i : i + order] for i in range(len(s) - order + 1))
    p, gamma, v = brute_kneser_ney(counts, order)
    docs = spark.createDataFrame([(t,) for t in [*TRUSTED, "too short", None, "###### " * 30]], "text string")
    probes = [*TRUSTED, "zzz", "the\t cat  in the sea ", "x", "", "日本"]
    for piece in (10**6, 40):  # one piece or many
        model = quality.fit_model(docs, order=order, piece=piece)
        got = model.log_probs(quality.Texts(probes, order))
        assert (len(model.pieces) > 3) == (piece == 40)
        for t, one in zip(probes, got, strict=True):
            s, want = " " * (order - 1) + "".join(w + " " for w in t.split()), 0.0
            for i in range(len(s) - order + 1):
                g, k = s[i : i + order], order
                while k and (k, g[order - k :]) not in p:
                    want += math.log(gamma.get((k, g[order - k : -1]), 1))
                    k -= 1
                want += math.log(p[k, g[order - k :]] if k else 1 / v)
            assert abs(one - want) < 1e-9, t


def test_shuffled_and_too_predictable_texts_are_outside_the_bands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en' AND doc_id < 5000").repartition(8)
    good = [r.text for r in docs.where("length(text) > 9000").orderBy("doc_id").limit(12).collect()]
    rnd, planted = random.Random(5), []
    for k, t in enumerate(good[:3]):
        words = t.split()
        rnd.shuffle(words)
        planted.append((10**6 + k, " ".join(words), "en"))
    common = [w for w, _ in Counter(w for t in good for w in t.split()).most_common(25)]
    short = [w for w in common if w.isalpha() and w.islower() and len(w) > 1][:6]
    planted += [(3 * 10**6 + k, " ".join(rnd.choice(short) for _ in range(400)), "en") for k in range(3)]
    got = {r.doc_id: r for r in quality.judge(docs.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(planted, "doc_id long, text string, lang string"))).collect()}
    assert all(got[i].cross_entropy > got[i].upper and not got[i].kept for i, *_ in planted[:3])
    assert all(got[i].cross_entropy < got[i].lower for i, *_ in planted[3:])


def test_quality_odd_rows(odd, empty):
    got = quality.judge(odd).collect()
    assert len(got) == odd.count() and all(r.base_failed and not r.kept for r in got if r.doc_id in (2, 3, 4, 6, 7, 9, None))
    assert quality.judge(empty).count() == 0 and quality.passed(odd).columns == odd.columns


def test_verdicts_do_not_depend_on_the_number_of_pieces(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda df: sorted((r.doc_id, r.kept, r.cross_entropy or 0.0) for r in df.collect())
    want = key(quality.judge(docs))
    fit = quality.fit_model
    monkeypatch.setattr(quality, "fit_model", lambda *a: fit(*a, piece=20_000))
    assert key(quality.judge(docs)) == want


def test_base_scores_equal_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {i: [*words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t)), "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in QUERIES["op1_lm_score"](spark, SF).collect():
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r.score < 0 and math.isclose(r.bits_per_byte, -r.score / math.log10(2) / len(" ".join(own).encode()), rel_tol=1e-9)


def test_pairs_of_many_batches_are_dealt_together():
    words = [f"w{i}" for i in range(5000)]
    whole = pa.RecordBatch.from_pydict({"word": words, "cls": pa.array([i % 3 for i in range(5000)], pa.int32()), "count": list(range(5000)), "log_prob": [-i / 8 for i in range(5000)]})
    deal = lm_contexts._deal_pairs(SimpleNamespace(value=SimpleNamespace(buckets=16)))
    rows = [r for b in deal(whole.slice(i, 100) for i in range(0, 5100, 100)) for r in b.to_pylist()]
    assert len(rows) == 16  # not a row of each bucket for each batch
    keys, count, log_prob = (np.concatenate([lm_contexts._unpacked(r[c], kind) for r in rows]) for c, kind in (("a", np.uint64), ("b", np.int64), ("c", np.float64)))
    want = lm_contexts.pair_keys(lm_contexts.hashes_of([w.encode() for w in words]), np.arange(5000) % 3)
    assert {k: (n, p) for k, n, p in zip(keys, count, log_prob, strict=True)} == {k: (i, -i / 8) for i, k in enumerate(want)}


def test_bits_of_a_token_sum_to_one():
    """The probabilities of all bytes in a place sum to 1: the end of the text and all words of one byte, over 256."""
    tables, mixer = lm_score.Tables(100), lm_score.Mixer()
    rng = np.random.default_rng(1)
    tables.slots[:, 0] = rng.normal(0, 2, len(tables.slots))
    tables.slots[:, 1] = rng.integers(0, 300, len(tables.slots))
    for stem in (b"", b"the"):  # without and with exact counts
        words = sorted([stem + bytes([b]) + b"x" for b in range(256) if b != 32] + [stem])
        prefixes = lm_score.Prefixes(words, np.zeros(256, np.int64), rng.integers(0, 30, 256))
        exact = prefixes.of(0, 256)
        spelled = lm_score.Spelling(words, np.zeros(256, np.int64), exact)
        only = spelled.place == len(stem)
        spelled.data, spelled.place, spelled.contexts, spelled.exact = spelled.data[only], spelled.place[only], [c[only] for c in spelled.contexts], tuple(e[only] for e in spelled.exact)
        spelled.which, spelled.starts = np.arange(256), np.arange(256)
        first = 10 ** mixer.score(spelled, tables)
        assert len(first) == 256 and abs(first.sum() - 1) < 1e-5


def test_shared_beginnings_change_no_score():
    tables, mixer = lm_score.Tables(100), lm_score.Mixer()
    rng = np.random.default_rng(2)
    tables.slots[:, 0], tables.slots[:, 1] = rng.normal(0, 2, len(tables.slots)), rng.integers(0, 300, len(tables.slots))
    tokens, classes = [b"the", b"then", b"the", b"\n", b"t", b"\xc3\xbc", b"then"], np.array([0, 0, 3, 0, 0, 2, 3])
    together = mixer.score(lm_score.Spelling(tokens, classes), tables)
    alone = [mixer.score(lm_score.Spelling([t], np.array([c])), tables)[0] for t, c in zip(tokens, classes, strict=True)]
    assert np.allclose(together, alone)


def test_prefixes_equal_brute_force(monkeypatch):
    rnd = random.Random(4)
    pairs = sorted({("".join(rnd.choice("abü") for _ in range(rnd.randint(1, 12))).encode(), rnd.randint(0, 2)) for _ in range(300)} | {(b"a" * 60, 0), (b"a" * 61, 1), (lm_score.END, 0)})
    tokens, classes = [t for t, _ in pairs], np.array([c for _, c in pairs])
    weights = np.array([rnd.randint(0, 9) for _ in pairs])
    prefixes = lm_score.Prefixes(tokens, classes, weights)
    spelled = ["".join(f"{x:08b}" for x in (t if t == lm_score.END else t + b" ")) for t in tokens]
    for a, b in ((0, len(pairs)), (40, 90), (7, 8)):
        got = lm_score.padded(prefixes.of(a, b), prefixes.sizes[a:b], tokens[a:b])
        at = 0
        for i in range(a, b):
            for place in range(len(spelled[i]) // 8):
                for k in range(9) if lm_score.FIRST <= place < lm_score.DEPTH else ():
                    same = [j for j in range(len(pairs)) if spelled[j][: 8 * place + k] == spelled[i][: 8 * place + k]]
                    assert got[0][at][k] == weights[same].sum() and got[1][at][k] == weights[[j for j in same if classes[j] == classes[i]]].sum()
                at += 1
        assert at == len(got[0])


def test_blocks_hold_all_that_begin_alike(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm_score, "BLOCK", 10)
    words = sorted(f"{p}{k:03d}" for p, n in (("abcd", 35), ("abce", 3), ("b", 1), ("bcde", 22), ("bcdf", 9), ("zzzz", 12)) for k in range(n))
    for size in (1, 4, 7, 50, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(words[i : i + size]), pa.array([0] * len(words[i : i + size]))], ["word", "cls"]) for i in range(0, len(words), size)]
        blocks = [tokens for tokens, *_ in lm_score._blocks(iter(batches))]
        assert [t.decode() for b in blocks for t in b] == words and len(blocks) > 2
        groups = [{t[: lm_score.FIRST] for t in b} for b in blocks]
        assert all(not (x & y) for i, x in enumerate(groups) for y in groups[:i])


def test_classes_of_texts_together_equal_brute_force():
    rnd = random.Random(8)
    texts = ["", " ", "é", "a é", "é a", "abc", "日本 x\n\nüa b "] + ["".join(rnd.choice("ab é日\n\tü😀") for _ in range(rnd.randint(0, 20))) for _ in range(300)]
    want = []
    for t in texts:
        last = 0
        for w in [*re.findall(r"[^\x20\x09-\x0D]+", t), ""]:
            want.append(last)
            for c in w:
                if not c.isascii():
                    last = 1 + sum(c.encode()) % (lm_score.CLASSES - 1)
    assert lm_score.classes_of(*(lm_score.lower(t) for t in texts)).tolist() == want


def test_counted_tokens_equal_brute_force(monkeypatch):
    """A task gives each (token, class) once, for training and held-out documents together."""
    import pyarrow as pa

    rnd = random.Random(9)
    texts = ["", " \n\t", "A\x0bb\x0c", *("".join(rnd.choice("aB\u00fc\u4e2d  \n\r") for _ in range(rnd.randint(0, 40))) for _ in range(80))]
    held = [k % 5 == 1 for k in range(len(texts))]
    want: dict = {}
    for t, h in zip(texts, held, strict=True):
        own = lm_score.lower(t)
        for w, c in zip([*own.split(), lm_score.END], lm_score.classes_of(own).tolist(), strict=True):
            n = want.setdefault((w.decode(), c), [0, 0])
            n[0] += not h
            n[1] += 1
    for size in (4_000_000, 50):  # bytes that are counted together
        monkeypatch.setattr(lm_score, "COUNTED", size, raising=False)
        rows = [r for b in lm_score._count(iter([pa.RecordBatch.from_arrays([pa.array(held), pa.array(texts)], ["held_out", "text"])])) for r in b.to_pylist()]
        assert len(rows) == len(want) and {(r["word"], r["cls"]): [r["train"], r["every"]] for r in rows} == want


def test_segments_are_the_same_wherever_a_passage_stands():
    rnd = random.Random(6)
    words = lambda n: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randint(0, 99)) for _ in range(n))
    passage = words(300)
    texts = [f"{words(40)}\n{passage} {words(30)}", f"{words(5)} {passage}", "", "a", "| " * 500]
    own = lm_segments.Segments([t.lower().encode() for t in texts])
    assert own.counts.tolist() == [len(t.split()) + 1 for t in texts] and own.sizes.sum() == own.counts.sum() and own.sizes.max() <= lm_segments.LONGEST
    keys = [set(zip(own.context[own.text == i].tolist(), own.hash[own.text == i].tolist(), strict=True)) for i in range(5)]
    assert len(keys[0] & keys[1]) >= 0.7 * 300 / 16 * 0.8
    alone = lm_segments.Segments([texts[1].lower().encode()])
    assert (alone.hash == own.hash[own.text == 1]).all() and (alone.context == own.context[own.text == 1]).all()


def test_repeated_segments_equal_brute_force(spark, tmp_path):
    from foliant.llm.common import Scratch

    docs = [(k, k % 4 != 0, r.text or "") for k, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect())]
    docs += [(10_000 + k, k % 2 == 0, docs[k][2]) for k in range(0, 60, 3)]
    own = lm_segments.Segments([t.encode().lower() for *_, t in docs])
    seen: dict[int, Counter] = {}
    for t, k, c, h in zip(own.text.tolist(), own.number.tolist(), own.context.tolist(), own.hash.tolist(), strict=True):
        if k and docs[t][1]:
            seen.setdefault(c, Counter())[h] += 1
    want = {}
    for t, k, c, h in zip(own.text.tolist(), own.number.tolist(), own.context.tolist(), own.hash.tolist(), strict=True):
        train = docs[t][1]
        if k and c in seen and sum(seen[c].values()) > train:
            want.setdefault(docs[t][0], set())
            if seen[c][h] > train:
                want[docs[t][0]].add(k)
    df = spark.createDataFrame(docs, "doc_key long, train boolean, text string")
    got = {r.doc_key: r for r in lm_segments.repeated_segments(df, Scratch(spark, "test")).collect()}
    assert {k: set(r.repeated) for k, r in got.items()} == want and all(r.repeated_score < 0 for r in got.values())


def test_scores_beat_the_base_on_held_out_text(spark):
    rows = QUERIES["op1_lm_score"](spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert rows.s > 0.92 * rows.b  # both are below 0


def test_shuffled_words_score_less(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 500").select("doc_id", "text").orderBy("doc_id").limit(30).collect()
    held = [i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rnd = random.Random(8)
    rows = [(r.doc_id, r.text) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    probes = []
    for i, (_, text) in zip(held, rows[:12], strict=False):
        words = text.split()
        rnd.shuffle(words)
        probes += [(i, text), (i + 10**6, " ".join(words))]
    probes = [(i, t) for i, t in probes if i < 10**6] + [(next(j for j in range(i, i + 10**5) if zlib.crc32(str(j).encode()) % 7 == 2 and j % 1000 == i % 1000), t) for i, t in probes if i >= 10**6]
    got = {r.doc_id: r.score for r in lm_score.score_texts(spark.createDataFrame(rows + probes, "doc_id long, text string")).collect()}
    n = len(probes) // 2
    assert all(got[a] > 0.7 * got[b] for (a, _), (b, _) in zip(probes[:n], probes[n:], strict=True))


def test_bits_have_exact_counts_in_the_contexts_of_earlier_tokens(monkeypatch):
    """Each bit's counts after no, one and two tokens, held against brute force; the same whatever the number of buckets and blocks."""
    rnd = random.Random(10)
    words = [f"w{k}".encode() for k in range(40)]
    texts = [b" ".join(rnd.choice([b"the", b"of", rnd.choice(words), rnd.choice(words)]) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    tokens = [[*t.split(), b"\n"] for t in texts]
    held = np.array([k % 7 == 2 for k in range(60)])
    train, every = (Counter(w for k, ws in enumerate(tokens) if all_ or not held[k] for w in ws) for all_ in (False, True))
    coded = sorted(w for w, n in train.items() if n > 10)

    def checksum(self, events, score, weight):
        self.batches += 1
        for rows, depth, counts in events:
            if score is not None:
                score[rows] += sum((3 * n + 7 * same) * 5**i for i, (n, same) in enumerate(counts)) * (depth + 1)

    monkeypatch.setattr(lm_contexts.BitMixer, "run", checksum)
    monkeypatch.setattr(lm_contexts, "followers", lambda context, keys, held: (np.zeros(len(keys), bool), np.zeros(len(keys))))
    monkeypatch.setattr(lm_contexts, "BATCH", 50)
    want = None
    for size, blocks in ((1 << 21, 1), (100, 3), (37, 7)):
        monkeypatch.setattr(lm_contexts, "BUCKET", size)
        d = lm_contexts.Dictionary(coded, [train[w] for w in coded], [every[w] for w in coded], sum(train.values()), sum(every.values()), 1.0)
        assert (len(d.hot) > 1) == (size < 1000) and d.buckets == -(-sum(every.values()) // size)
        if want is None:
            found = d.look_up(lm_contexts.hashes_of(coded))
            code = dict(zip(coded, (f"{int(d.codes[i]):064b}"[: d.sizes[i]] for i in d.leaves[found].tolist()), strict=True))
            escape = f"{int(d.codes[d.escape]):064b}"[: d.sizes[d.escape]]
            seen: Counter = Counter()
            each = []
            for k, ws in enumerate(tokens):
                before = [b"", b"", *ws]
                for i, w in enumerate(ws):
                    bits = code.get(w, escape)
                    contexts = [(), (before[i + 1],), (before[i + 1], before[i])]
                    each.append((k, bits, contexts))
                    if not held[k]:
                        seen.update((c, bits[:j]) for c in contexts for j in range(len(bits) + 1))
            root = {(): {escape[:j] for j in range(len(escape) + 1)}}  # the escape has one occurrence more
            want = np.zeros(60)
            for k, bits, contexts in each:
                for j in range(len(bits)):
                    n = [[seen[c, bits[:x]] + (bits[:x] in root.get(c, ())) - (not held[k]) for x in (j, j + 1)] for c in contexts]
                    want[k] += sum((3 * a + 7 * b) * 5**i for i, (a, b) in enumerate(n)) * (j + 1)
        rows = []
        for b in range(blocks):
            own = list(range(b, 60, blocks))
            rows += lm_contexts.dealt(d, [texts[k] for k in own], own, held[own], b, lm_score.classes_of).to_pylist()
        got = np.zeros(60)
        for bucket in range(d.buckets):
            for out in lm_contexts.context_sums(d, [r for r in rows if r["bucket"] == bucket]):
                if out[2] == lm_contexts.CODED_SUMS:
                    docs = np.arange(out[1], 60, blocks)[lm_contexts._unpacked(out[3], np.uint32)]
                    got[docs] += lm_contexts._unpacked(out[4], np.float32)
        assert np.allclose(got, want, rtol=1e-5)


def test_rows_alone_in_their_context_are_not_looked_at_again(monkeypatch):
    """One of a context that nothing else has keeps its count, so deeper bits have no work with it; nor do spelled tokens with a beginning of their own."""
    n, looked = 64, []
    words = [f"w{k:02d}".encode() for k in range(n)]
    d = lm_contexts.Dictionary(words, [3] * n, [3] * n, 3 * n, 3 * n, 1.0)
    at = lm_contexts.Nodes.at
    monkeypatch.setattr(lm_contexts.Nodes, "at", lambda self, deep, k: looked.append((k, len(deep))) or at(self, deep, k))
    context = np.arange(n, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(5)
    leaves, held = np.arange(n, dtype=np.uint32), np.arange(n) % 4 == 0
    context[1], leaves[1] = context[0], leaves[0] + 1  # the only two of a context
    own = lm_contexts.Occurrences(context, leaves, held)
    score = lm_contexts.scores_of(d, own, np.zeros(0, np.uint64), np.zeros(0))
    assert len(score) == n and (score < 0).all()
    assert max(size for k, size in looked if k == 0) == n and max(size for k, size in looked if k > 0) <= 2
    tokens = sorted(bytes([97 + i, 97 + j]) * 15 for i in range(20) for j in range(20))
    spread, repeat = [], np.repeat
    prefixes = lm_score.Prefixes(tokens, np.zeros(400, np.int64), np.arange(400))
    monkeypatch.setattr(np, "repeat", lambda a, *b, **c: spread.append(np.size(a)) or repeat(a, *b, **c))
    whole, _ = prefixes.of(0, 400)
    assert (whole[lm_score.FIRST : 31] == 0).all() and (whole[-5:] == 399).all() and len(spread) < 30


def test_hashes_of_words_depend_on_the_word_alone():
    rnd = random.Random(13)
    words = sorted({bytes(rnd.choice(b"\0\0abc\xc3") for _ in range(n)) for n in (1, 2, 7, 8, 9, 15, 16, 17, 24, 40) for _ in range(60)})
    texts = [b" ".join(rnd.choices(words, k=30)) + rnd.choice([b"", b" ", b"\t\n"]) for _ in range(40)] + [b"", b" ", words[0]]
    h, counts = lm_segments.token_hashes(texts)
    known: dict = {}
    for w, x in zip([w for t in texts for w in [*t.split(), b"\n"]], h.tolist(), strict=True):
        assert known.setdefault(w, x) == x
    assert counts.tolist() == [len(t.split()) + 1 for t in texts] and len(set(known.values())) == len(known)


def test_followers_equal_brute_force():
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 30), rnd.randint(0, 5), rnd.random() < 0.2) for _ in range(300)]
    told, score = lm_contexts.followers(np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.uint64), np.array([r[2] for r in rows]))
    seen = Counter((c, k) for c, k, h in rows if not h)
    assert told.tolist() == [seen[c, k] > (not h) for c, k, h in rows]
    known = [sum(seen[c, x] for x in range(6)) > (not h) for c, _, h in rows]
    assert [s < 0 for s in score.tolist()] == known and len({(r, s) for r, s in zip(rows, score.tolist(), strict=True)}) == len(set(rows))


def test_tokens_are_predicted_from_the_ones_before_without_a_common_passage(spark):
    """Texts of a chain in which each word has three followers: its pairs are known, but no passage of 16 tokens occurs twice."""
    rnd = random.Random(12)
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ane", "ilo", "ust", "ery", "od")]
    after = {w: rnd.sample(words, 3) for w in words}

    def chain(n):
        out = [rnd.choice(words)]
        for _ in range(n):
            out.append(rnd.choice(after[out[-1]]))
        return out

    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows, pairs = [(i, " ".join(chain(150))) for i in train], []
    for a, b in zip(held[:40:2], held[1:40:2], strict=True):
        text = chain(150)
        pairs.append((a, b))
        rows += [(a, " ".join(text)), (b, " ".join(rnd.sample(text, len(text))))]
    got = {r.doc_id: r.score for r in lm_score.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[a] > 0.5 * got[b] for a, b in pairs)


def test_score_odd_rows(odd, empty):
    got = lm_score.score_texts(odd).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1} and lm_score.score_texts(empty).count() == 0
    assert len({r.score for r in got if r.doc_id == 5}) == 1
