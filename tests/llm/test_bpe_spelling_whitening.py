"""Byte-pair coding, spelling variants and whitening against tiktoken and brute force, with every edge case."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from hinode.llm import bpe, spelling, whitening
from hinode.llm.queries import tokenizer_file

RANKS = tokenizer_file("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, ids binary, x binary, word string, n long, key long"


@pytest.fixture(scope="module")
def encoder():
    return bpe.BytePairs.of(RANKS, PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def table(spark, rows):
    """The rows with columns whose names the operators use within."""
    return spark.createDataFrame([(k, t, "en", b"z", b"y", "w", 5, 7) for k, t in rows], SCHEMA).repartition(3)


def ids_of(coded):
    return np.frombuffer(coded, "<u4").tolist()


# --- 11 byte-level BPE ----------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_tokens_are_the_librarys(texts):
    encoder = bpe.BytePairs.of(RANKS, PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = encoder.encode(texts)
    assert [ids_of(g) for g in got] == [theirs.encode_ordinary(t) for t in texts]
    assert [encoder.decode(g).decode() for g in got] == texts


def random_text(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


LONG_TEXTS = {
    "one letter": lambda rng: "x" * 300_001,
    "run after letters": lambda rng: "abc" + "x" * 50_001 + "q" + "a" * 30_003,
    "period of three": lambda rng: "abc" * 60_000,
    "letters": lambda rng: random_text(rng, "etaoinshrdlu", 30_000),
    "base64": lambda rng: random_text(rng, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 100_000),
    "ideographs": lambda rng: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(10_000)),
    "blanks": lambda rng: " " * 100_001 + "a" + "\n" * 5_001 + "!" * 3_001,
    "newer letters": lambda rng: "a՘b ࢏\U00011de0c " * 50,
    "special": lambda rng: "<|endoftext|>'s 'S it's’s",
    "words": lambda rng: " ".join(random_text(rng, "abcdefé", rng.randrange(1, 12)) for _ in range(300_000)),
}


@pytest.mark.parametrize("name", LONG_TEXTS)
def test_long_texts(encoder, theirs, name):
    text = LONG_TEXTS[name](random.Random(7))
    coded = encoder.encode([text])[0]
    assert ids_of(coded) == theirs.encode_ordinary(text)
    assert encoder.decode(coded) == text.encode()


def test_blocks_of_one_turn_equal_the_leftmost_pair(encoder):
    rng = random.Random(3)
    words = [random_text(rng, "ab", rng.randrange(1, 60)).encode() for _ in range(200)]
    words += [random_text(rng, "the inga=-", rng.randrange(1, 90)).encode() for _ in range(200)]
    assert encoder._for_blocks() == bpe.ALL_LOWEST
    assert encoder.contract(words, bpe.ALL_LOWEST) == encoder.contract(words, bpe.LEFTMOST)


def test_ranks_out_of_order_go_one_by_one(tmp_path):
    """A vocabulary in which 'ab' comes after 'aba': all of one rank at once would be wrong, and isn't chosen."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"ba", b"aba", b"ab", b"abab"]
    tokens[256], tokens[257], tokens[258] = b"aba", b"ab", b"ba"
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    own = bpe.BytePairs(str(path), PATTERN)
    theirs = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(str(path)), special_tokens={})
    assert own._for_blocks() == bpe.LEFTMOST
    rng = random.Random(2)
    texts = [random_text(rng, "ab", n) for n in (5, 30, 63, 64, 65, 200, 500)]
    assert [ids_of(g) for g in own.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_documents_are_coded_and_decoded(spark, theirs):
    rows = [(1, "Hello world, it's 2024."), (2, None), (2, ""), (None, "é" * 500), (None, None), (7, " \n\t "), (7, "a b"), (7, "a b")]
    decoded = bpe.decode_documents(bpe.encode_documents(table(spark, rows), RANKS, PATTERN), RANKS, PATTERN)
    got = Counter(map(tuple, bpe.token_digest(decoded).collect()))
    expected = Counter()
    for key, text in rows:
        coded = np.array(theirs.encode_ordinary(text or ""), "<u4")
        digests = [hashlib.sha256(b).hexdigest() for b in (coded.tobytes(), (text or "").encode())]
        expected[key, len(coded), *digests] += 1
    assert got == expected
    assert not bpe.encode_documents(table(spark, []), RANKS, PATTERN).count()


def test_unknown_ids_fail(encoder):
    with pytest.raises(ValueError):
        encoder.decode(np.array([60_000], "<u4").tobytes())


# --- 12 spelling variants -------------------------------------------------------------------------------------------


def by_hand(rows, shortest=7, occurrences=2, ratio=10):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= shortest:
                counts[low] += 1
    words = {w: n for w, n in counts.items() if n >= occurrences}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    others = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, n in words.items():
        best = min(others[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return {(w, forms[w], root(w), n, len(others[w]), words[forms[w]] if forms[w] else None) for w, n in words.items()}


def corpus():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(6, 10))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "aabbaabb"]
    texts = []
    for n in range(400):
        words = []
        for _ in range(30):
            w = base[min(int(rng.expovariate(0.12)), len(base) - 1)]
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÿ") + w[k:], w[:k] + rng.choice("abÀ") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(rng.choice([" ", "-", "×1", "3"]).join(words))
    rows = [(n % 390, t) for n, t in enumerate(texts)]
    chain = "quintessa " * 2 + "quintessb " * 25 + "quintessbc " * 260
    return [*rows, (None, texts[0]), (None, None), (5, ""), (6, "÷×ß kk"), (1000, chain), (1001, "z" * 70_000 + " " + "z" * 69_999), (1002, "Z" * 70_000 + " " + "z" * 69_999)]


def test_spellings_against_all_pairs(spark):
    rows = corpus()
    got = spelling.group_spellings(table(spark, rows)).collect()
    assert {tuple(r) for r in got} == by_hand(rows) and len(got) == len({r.word for r in got})
    by = {r.word: r for r in got}
    assert by["quintessa"].root == by["quintessb"].form


def test_slices_don_t_cut_runs(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 3)
    text = "Abcdéf gh1ij ÀÉ x" * 3
    assert [w for some in spelling.runs(text) for w in some] == re.findall("[a-zÀ-ÿ]+", text.encode().lower().decode())


@pytest.mark.parametrize("bits", [1, 3, 64])
def test_keys_that_collide_link_nothing(spark, bits):
    """With keys of one bit nearly all rows meet; the strings still tell them apart."""
    words = ["abcdefg", "abcdefh", "abcdef", "bcdefga", "zzzzzzz", "abcdefgh", "abcdeg"]
    df = spark.createDataFrame([(k, w, k + 1) for k, w in enumerate(words)], "id long, word string, n long")
    got = {r.id: (r.n_near, r.form) for r in spelling.near_words(df, bits).collect()}
    assert got == {0: (4, "abcdeg"), 1: (3, "abcdefgh"), 2: (3, "abcdeg"), 5: (2, "abcdefh"), 6: (2, "abcdef")}


def test_no_words(spark):
    assert not spelling.group_spellings(table(spark, [])).count()
    assert not spelling.group_spellings(table(spark, [(1, None), (2, "short words only")])).count()


# --- 13 whitening ---------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x binary, entries string, vector string"


def vector_table(spark, rows):
    return spark.createDataFrame([(k, v, 1, b"q", "e", "v") for k, v in rows], VECTORS).repartition(5)


def embeddings(rng, n, d):
    mixed = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3
    return [[float(np.float32(c)) for c in row] for row in mixed]


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    vectors = embeddings(rng, 300, 20)
    rows = list(enumerate([*vectors, *vectors[:40], vectors[0], vectors[0]]))
    bad = [(900, None), (901, [1.0] * 19 + [None]), (902, [1.0] * 19 + [float("nan")]), (903, [float("inf")] + [0.0] * 19), (904, [1.0] * 3), (905, [])]
    got = whitening.whiten_embeddings(vector_table(spark, [*rows, *bad, (None, vectors[1])])).collect()
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, directions = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, directions = values[::-1], directions[:, ::-1]
    assert len(got) == (len(rows) + 1) * 16 and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    whitened = (x - sums / n) @ directions / np.sqrt(values)
    signs = {}
    for r in got:
        k = 1 if r.vec_id is None else r.vec_id
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums, strict=True))
        sign = signs.setdefault(r.component, np.sign(r.whitened * whitened[k, r.component - 1]))
        assert r.whitened == pytest.approx(sign * whitened[k, r.component - 1], abs=1e-8)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(8)
    rows = rng.integers(999_000, 1_001_000, size=(200, 6))
    parts = [whitening.Moments.of(rows[a:b]) for a, b in ((0, 1), (1, 1), (1, 90), (90, 200))]
    for order in ((0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)):
        whole = parts[order[0]]
        for k in order[1:]:
            whole = whole.merge(parts[k])
        assert whole.n == 200 and whole.sums == rows.sum(axis=0).tolist()
        assert np.allclose(whole.scatter / 200, np.cov(rows.T, bias=True), rtol=1e-12)


def test_large_numbers_stay_exact():
    rows = np.array([[2**61, -(2**61)], [5, 7]])
    far = whitening.exact_deviations(rows, 1000, [3, 4])
    assert far.tolist() == [[1000 * 2**61 - 3, -1000 * 2**61 - 4], [4997, 6996]]
    assert whitening.squared_length(np.array([[3, 4], [10**9, 10**9]])) == [25, 2 * 10**18]
    with pytest.raises(OverflowError):
        whitening.squared_length(far)


def test_what_doesn_t_vary(spark):
    rng = np.random.default_rng(5)
    flat = [[a, 0.5, a] for a in rng.normal(size=30).tolist()]  # one direction of variance in three dimensions
    got = whitening.whiten_embeddings(vector_table(spark, list(enumerate(flat)))).collect()
    assert {r.component for r in got} == {1} and len(got) == 30
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert not whitening.whiten_embeddings(vector_table(spark, rows)).count()
