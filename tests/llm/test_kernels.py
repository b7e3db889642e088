"""Kernels against plain versions of themselves."""

import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from intervale.llm import decontamination as dc
from intervale.llm import language as lg
from intervale.llm import jaccard, media, packing, quality, toxicity, urls
from intervale.llm.words import distinct_by_text, ngrams, words_of

TEXTS = ["", "one", " the  cat\tsat\non THE mat ", "é ü 漢字 x" * 3, "a b c d a b c d", "\x0b\x0c", "z" * 5000, "a\u00a0b"]


def plain_words(text):
    import re

    return re.findall(rb"[^\x20\x09-\x0D]+", text.encode())


def test_words_are_those_of_the_pattern():
    w = words_of(pa.array(TEXTS))
    found = [[bytes(w.data[a:b]) for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in itertools.pairwise(w.first)]
    assert found == [plain_words(t) for t in TEXTS]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    w = words_of(pa.array(TEXTS), lower=True)
    by = {}
    for h, a, b in zip(w.hashes(), w.start, w.end):
        by.setdefault(bytes(w.data[a:b]), set()).add(int(h))
    assert all(len(v) == 1 for v in by.values())
    assert len({v.copy().pop() for v in by.values()}) == len(by)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_ngrams_stay_inside_texts(n):
    w = words_of(pa.array(TEXTS))
    grams, at = ngrams(w.hashes(), w.first, n)
    want = sum(max(0, len(plain_words(t)) - n + 1) for t in TEXTS)
    assert len(grams) == want
    values, text = distinct_by_text(grams, w.text[at])
    assert len(values) == sum(len({tuple(p[k : k + n]) for k in range(len(p) - n + 1)}) for p in map(plain_words, TEXTS))


def test_images_round_trip():
    r = np.random.default_rng(1)
    for shape in ((1, 1), (5, 7), (4, 3, 3), (9, 64)):
        image = r.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_pgm(image)) == image).all()
        assert (media.decode(media.encode_bmp(image)) == image).all()
    assert (media.decode(b"P1 # c\n2 2\n1 0\n0 1\n") == [[0, 255], [255, 0]]).all()
    assert (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    assert (media.decode(b"P2\n2 1\n100\n0 100\n") == [[0, 255]]).all()
    for bad in (None, b"", b"P5\n2 2\n255\nx", b"BM123", b"P9"):
        assert media.decode(bad) is None


@pytest.mark.parametrize("shape", [(8, 9), (3, 5), (17, 64), (1, 1)])
def test_area_resize_is_the_mean_of_areas(shape):
    image = np.random.default_rng(2).integers(0, 256, shape).astype(np.uint8)
    big = np.kron(image.astype(float), np.ones((8, 9)))
    want = big.reshape(8, shape[0], 9, shape[1]).mean((1, 3))
    assert np.abs(media.area_resize(image, 8, 9).astype(float) - want).max() <= 0.5 + 1e-9


@pytest.mark.parametrize("seed", range(20))
def test_packing_covers_everything_without_padding(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 2, r.randrange(1, 200), r.randrange(1, 3000), 1024, 2048]) for _ in range(r.randrange(1, 60))]
    seen = [[] for _ in lengths]
    for s in packing.pack(lengths):
        n = sum(x[2] for x in s)
        assert n <= 1024 and n & (n - 1) == 0
        for doc, start, length in s:
            assert length > 0
            seen[doc].append((start, length))
    for n, parts in zip(lengths, seen):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode = packing.encoder(path)
    for text in [*TEXTS, "it's  we'll\n\n x 12,5 <|endoftext|> ...  ", "Ünïcode 漢字 \u200b 🙂 don't\t'S"]:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_document_ids_are_those_of_the_default_tokenizer():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    encode = packing.document_encoder(path)
    assert encode("hello <|endoftext|> world") == [31373, 220, 50256, 995]
    r = random.Random(8)
    bits = ["<|endoftext|>", "<|endoftext|", " ", "  ", "\n", "word", " it's", "漢", "12", "...", "\u3000", "\x85"]
    texts = [*TEXTS, *("".join(r.choices(bits, k=12)) for _ in range(300))]
    texts += [f"a{space * n}b <|endoftext|> {space * n}" for space in (" ", "\n", "\u3000") for n in (packing.LONG_RUN - 1, packing.LONG_RUN)]
    texts += [" " * 1_000_000, "a" + " \n" * 500_000 + "<|endoftext|>b"]
    for text in texts:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_step_groups_are_balanced():
    sizes = [1024] * 300 + [512] * 31 + [1] * 5
    groups = packing.step_groups(sizes, 65536)
    loads = [sum(s for s, g in zip(sizes, groups) if g == k) for k in set(groups)]
    assert max(loads) - min(loads) <= 1024


def test_alignment_scores():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        return max(map(max, h))

    r = random.Random(3)
    for _ in range(60):
        a, b = ([r.randrange(4) for _ in range(r.randrange(1, 12))] for _ in range(2))
        assert dc.smith_waterman(np.array(a), np.array(b))[0] == plain(a, b)


def test_seeds_miss_no_alignment():
    import pyarrow as pa

    r = random.Random(12)
    word = lambda: "w%d" % r.randrange(30)
    texts = [[word() for _ in range(r.randrange(4, 20))] for _ in range(40)]
    items = dc.Items(list(range(40)), [" ".join(t) for t in texts])
    rows = [[word() for _ in range(r.randrange(20))] + [x for x in texts[k % 40] if r.random() < 0.9] + [word() for _ in range(r.randrange(20))] for k in range(60)]
    part = pa.record_batch([pa.array([" ".join(t) for t in rows])], names=["text"])
    for threshold in (0.4, 0.7):
        got = {(t, i) for t, i, *_ in dc._matches(part, items, threshold)}
        number = {x: k for k, x in enumerate({x for t in texts + rows for x in t})}
        code = [[np.array([number[x] for x in t], np.int64) for t in side] for side in (rows, texts)]
        want = {(t, i) for t, a in enumerate(code[0]) for i, b in enumerate(code[1]) if dc.smith_waterman(b, a)[0] >= threshold * 2 * len(b)}
        assert got == want and want


def test_the_best_path_is_found():
    r = np.random.default_rng(4)
    for _ in range(20):
        first = np.array([0, 3, 3, 8, 9])
        scores = r.normal(size=(9, 3)).astype(np.float32)
        got = lg.viterbi(scores, first, 0.7)
        for a, b in itertools.pairwise(first):
            value = lambda path: sum(scores[a + k, s] for k, s in enumerate(path)) - 0.7 * sum(x != y for x, y in itertools.pairwise(path))  # noqa: B023, E731
            if b > a:
                assert value(got[a:b]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=b - a))), abs=1e-5)


def test_marginals_are_exact():
    r = np.random.default_rng(5)
    moves, emission, first = r.normal(size=(2, 2)), r.normal(size=8), np.array([0, 1, 1, 6, 8])
    odds = toxicity.forward_backward(emission, first, moves)[0]
    for a, b in itertools.pairwise(first):
        for t in range(a, b):
            mass = [0.0, 0.0]
            for path in itertools.product((0, 1), repeat=b - a):
                mass[path[t - a]] += math.exp(sum(emission[a + k] * s for k, s in enumerate(path)) + sum(moves[x, y] for x, y in itertools.pairwise(path)))
            assert odds[t] == pytest.approx(math.log(mass[1] / mass[0]))


def test_url_parts():
    for url, want in {"https://A.b/C/d?x#y": ("a.b", "/C/d"), "http://h?x/y": ("h", ""), "http://h#a://b": ("h", ""), "x": ("", ""), None: ("", ""), "s://": ("", ""), "a://É.x/p": ("É.x", "/p")}.items():
        assert urls.split_url(url) == want


def plain_kneser_ney(counts):
    """log-probabilities of a byte after four, straight from the definition."""
    tables = {5: counts}
    for n in (4, 3, 2, 1):
        t = {}
        for g in tables[n + 1]:
            t[g[1:]] = t.get(g[1:], 0) + 1
        tables[n] = t
    discounts = {}
    for n, t in tables.items():
        by = {k: sum(v == k for v in t.values()) for k in (1, 2, 3, 4)}
        discounts[n] = quality._discounts(by)

    def p(g):
        n = len(g)
        if not n:
            return 1 / 256
        mine = {h: c for h, c in tables[n].items() if h[:-1] == g[:-1]}
        if not mine:
            return p(g[1:])
        d = (0, *discounts[n])
        total = sum(mine.values())
        c = mine.get(g, 0)
        return (c - d[min(c, 3)]) / total + sum(d[min(x, 3)] for x in mine.values()) / total * p(g[1:])

    return p


@pytest.mark.parametrize("head", [0, 3, 1 << 19])
def test_quality_scores_follow_the_definition(spark, head, monkeypatch):
    monkeypatch.setattr(quality, "HEAD", head)
    monkeypatch.setattr(quality, "HEAD_LOWER", head)
    r = random.Random(6)
    trained = ["".join(r.choice("abca de") for _ in range(r.randrange(5, 40))) for _ in range(12)]
    asked = ["abcade abc", "zzz abc", "é漢", trained[0], "a", ""]
    counts = {}
    for t in trained:
        b = b"\n" * 4 + t.encode()
        for k in range(len(t.encode())):
            counts[b[k : k + 5]] = counts.get(b[k : k + 5], 0) + 1
    p = plain_kneser_ney(counts)
    model, sharded = quality.train(spark.createDataFrame([(t,) for t in trained], "text string"))
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(asked)], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["nll"] for x in quality.perplexities(docs, model, sharded).collect()}
    for k, t in enumerate(asked):
        b = b"\n" * 4 + t.encode()
        want = -sum(math.log(p(b[i : i + 5])) for i in range(len(t.encode())))
        assert got[k] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_payload_digest():
    raw = "é" * 40
    padded = media.payload_of(raw.encode())
    assert len(padded) == 128 and media.payload_of(b"") == bytes(64) and len(media.payload_of(b"x" * 64)) == 64
    assert zlib.crc32(media.decode(media.encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, 64))).tobytes()) == zlib.crc32(padded)


def test_broken_images_give_none():
    for data in (b"P1\n2 2\n0 1 2 1\n", b"P2\n2 1\n9\n1 99999999999999999999999\n", b"P2\n2 1\n9\n-1 3\n", b"P2\n2 1\n9\n3 10\n", b"P5\n9999999999 9999999999\n255\n", b"P1\n2 2\n0 9 8 1\n", b"P3\n1 1\n255\n1 2 x\n"):
        assert media.decode(data) is None
    assert media.decode(b"P2\n2 1\n9\n0 9\n").tolist() == [[0, 255]]


def test_both_stored_forms_give_the_payload_back():
    kinds = set()
    for n in (0, 1, 63, 64, 65, 128, 200, 1000):
        payload = media.payload_of(bytes(k % 251 for k in range(n)))
        form = media.stored_form(payload)
        kinds.add(form[:2])
        assert media.decode(form).tobytes() == payload and len(payload) % 64 == 0 and len(payload) >= max(n, 64)
    assert kinds == {b"BM", b"P5"}


def test_language_sums_stay_small_in_long_texts():
    scores = np.zeros((400_000, 2), np.float32)
    scores[:, 1] = -0.4
    scores[399_000:, 0], scores[399_000:, 1] = -0.4, 0
    labels = lg.viterbi(scores, np.array([0, len(scores)]), 25.0)
    assert (labels[:399_000] == 0).all() and (labels[399_000:] == 1).all()


def test_url_model_on_left_out_hosts():
    rows = urls.labelled_urls()
    right, listed, blocked = 0, 0, 0
    for part in range(5):
        held = [x for k, x in enumerate(rows) if k % 5 == part]
        weights = urls.train([x for k, x in enumerate(rows) if k % 5 != part])
        for url, label in held:
            buckets = urls.features(*urls.split_url(url))
            z = weights[-1] + sum(weights[b] for b in buckets) / len(buckets) ** 0.5
            hit = 1 / (1 + np.exp(-z)) >= urls.THRESHOLD
            right, listed, blocked = right + (hit and label), listed + label, blocked + hit
    assert right >= 0.95 * blocked and right >= 0.7 * listed, (right, listed, blocked)


def test_places_of_prefixes_keep_their_order():
    r = np.random.default_rng(8)
    values = np.sort(r.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2))
    text, ranks = np.zeros(400, np.int64), np.where(r.random(400) < 0.5, r.integers(1, 500, 400), 0).astype(np.uint64)
    for order in range(3):
        places = jaccard._prefix(values, text, ranks, np.array([0, 400]), np.array([400]), order)
        assert (np.diff(places.astype(object)) >= 0).all() and (places >= jaccard._TOP).sum() == (ranks > 0).sum()
        turned = places.view(np.int64) ^ np.int64(-1 << 63)
        short = ((places >> np.uint64(32)).astype(np.uint32) ^ np.uint32(1 << 31)).view(np.int32)
        assert (turned[1:] >= turned[:-1]).all() and (short[1:] >= short[:-1]).all()


def test_the_bound_of_a_pair_holds():
    """What the prefixes of two sets share, and the rest of the one that ends first, is never less than the overlap."""
    r = random.Random(12)
    for _ in range(400):
        whole = r.sample(range(10_000), 120)
        x = sorted(r.sample(whole, r.randrange(60, 110)))
        y = sorted(r.sample(whole, r.randrange(60, 110)))
        p = 85
        a, b = (s[: int(jaccard.prefix_length(np.array([len(s)]), p)[0])] for s in (x, y))
        beyond = [len(s) - len(t) for s, t in ((x, a), (y, b))]
        rest = beyond[0] if a[-1] < b[-1] else beyond[1] if b[-1] < a[-1] else max(beyond)
        overlap = len(set(x) & set(y))
        assert len(set(a) & set(b)) + rest >= overlap
        if 100 * overlap >= p * (len(x) + len(y) - overlap):
            assert jaccard._may_reach(np.array(a), np.array(b), len(x), len(y), p) and set(a) & set(b)
