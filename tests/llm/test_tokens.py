"""Token ids, token files, packing and unigram counts."""
import io
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from prudent.llm import packing, tokenfile, tokens, unigram

from llm_fixtures import fixture_docs  # noqa: F401

WEIRD = ["", " ", "  a  b ", "a\n b", "a \nb", " a", "a ", "it's  'll  don't", "<|endoftext|> x <|endoftext|>", "x<|endoftext|> y", "a\x1c b",
         "1 2 3  4", "é ñ\t\tz \n\n q", "　 x y", "\x00 a \x00b c", "Hi, you. a, b! x, ,y", "can't, won't. I, ", "a  b", "日本語 テスト、です", "x" * 5000,
         "a, a. a; a: a? a!", ". , ;", "\n", "a\n\nb c"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.vocabulary_path())


def test_ids_equal_the_library(plain):
    e = tokens.Encoder(tokens.vocabulary_path(), limit=3)  # a tiny cache turns over all the time
    for step in (1, 7, 512):
        assert [list(x) for x in e.encode_batch(WEIRD * 2 + [None], step)] == \
            [plain.encode(t, add_special_tokens=False).ids for t in WEIRD * 2] + [[]]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 65_536, 70_000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 50_257, n).astype(np.uint32)
    assert np.array_equal(tokenfile.from_planes(tokenfile.to_planes(ids, bits), n, bits), ids)


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(bits):
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 2 ** int(rng.integers(1, 33)), int(n)).astype(np.uint32)) for i, n in enumerate([1, 0, 3, 200_000, 5, 65_536])]
    sink = io.BytesIO()
    w = tokenfile.Writer(sink, bits)
    for name, ids in docs:
        w.add(name, ids)
    assert w.close() == len(sink.getvalue())
    r = tokenfile.Reader(pa.PythonFile(io.BytesIO(sink.getvalue()), mode="r"))
    back = [(name, np.concatenate(parts) if parts else np.empty(0, np.uint32)) for name, _, parts in r.documents()]
    assert len(back) == len(docs) and all(a == b and np.array_equal(x, y) for (a, x), (b, y) in zip(docs, back))
    with pytest.raises(ValueError):
        tokenfile.Reader(pa.PythonFile(io.BytesIO(sink.getvalue()[:-1]), mode="r"))


def _rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_equal_the_library(fixture_docs, plain, bits):
    got = tokenfile.token_files(fixture_docs, bits=bits).collect()
    ids = {}
    for name, text in _rows(fixture_docs):
        x = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        ids.setdefault(name, []).append((len(x), zlib.crc32(x.tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == \
        sorted(((name, *x) for name, xs in ids.items() for x in xs), key=str)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])


def test_token_files_empty_table(fixture_docs):
    assert tokenfile.token_files(fixture_docs.limit(0)).collect() == []


def best_fit_decreasing(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            i = min(fits, key=lambda i: free[i])
            free[i] -= n
        else:
            free.append(capacity - n)
    return len(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_every_piece_and_few_sequences(seed):
    rng = random.Random(seed)
    capacity = rng.choice([64, 100, 1024])
    lengths = [max(1, min(capacity, int(rng.lognormvariate(math.log(capacity / 3), 0.8)))) for _ in range(rng.choice([1, 30, 3000]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    patterns = packing.plan(counts, capacity)
    back: dict = {}
    for n, parts in patterns:
        assert n > 0 and 0 < sum(parts) <= capacity
        for p in parts:
            back[p] = back.get(p, 0) + n
    assert back == counts
    assert sum(n for n, _ in patterns) <= 1.02 * best_fit_decreasing(lengths, capacity) + 1
    taken: dict = {}
    for length, lo, hi, _, _ in packing.places(patterns):
        assert lo == taken.get(length, 0)
        taken[length] = hi
    assert taken == counts


def test_packing_equals_the_library_and_leaves_no_gap(fixture_docs, plain):
    old = packing.RANKED
    try:
        packing.RANKED = 3  # several windows per length
        got = packing.pack_documents(fixture_docs, capacity=64).collect()
    finally:
        packing.RANKED = old
    want = []
    for name, text in _rows(fixture_docs):
        x = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = (len(x) - 1) % 64 + 1
        cuts = [0, *range(first, len(x) + 1, 64)]
        want += [(name, p, a, b - a, zlib.crc32(x[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.pack_documents(fixture_docs.limit(0)).collect() == []


def test_packed_sequences_hold_the_ids(fixture_docs, plain):
    some = fixture_docs.where("doc_id < 5")
    parts = [p for r in packing.packed_sequences(some, capacity=64).collect() for p in r.parts]
    text = {r.doc_id: r.text for r in some.collect()}
    for name, t in text.items():
        want = plain.encode(t, add_special_tokens=False).ids + [2]
        got = [x for p in parts if p.doc_id == name for x in np.frombuffer(p.ids, "<u4").tolist()]
        assert sorted(got) == sorted(want)


def brute_unigram(word, model):
    """Best score and fewest tokens over all splits, word by word."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode("utf-8", "surrogatepass"))
        options = [(best[end - 1][0] + n * model.byte_score, best[end - 1][1] + n)]
        for start in range(end):
            if word[start:end] in model.scores:
                options.append((best[start][0] + model.scores[word[start:end]], best[start][1] + 1))
        top = max(s for s, _ in options)
        best.append((top, min(c for s, c in options if s == top)))
    return best[-1][1]


def test_unigram_counts_equal_word_by_word_scoring(fixture_docs):
    model = unigram.zipf_model(unigram.vocabulary_path())
    rng = random.Random(2)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 14))) for _ in range(500)] + ["naïve", "日本", "\U0001f600", "x" * 60]
    words = [unigram.MARK + w for w in words] + [unigram.MARK]
    assert unigram.trie_counts(words, model) == {w: brute_unigram(w, model) for w in words}
    got = {(r.doc_id, r.n_pretokens, r.n_tokens) for r in unigram.token_counts(fixture_docs).collect()}
    want = set()
    for name, text in _rows(fixture_docs):
        own = (text or "").split()
        counts = unigram.trie_counts([unigram.MARK + w for w in own], model)
        want.add((name, len(own), sum(counts[unigram.MARK + w] for w in own)))
    assert got == want
    assert unigram.token_counts(fixture_docs.limit(0)).collect() == []
