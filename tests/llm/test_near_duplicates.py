"""Near-duplicates of documents and vectors against brute force."""
import math
import random
import re

import pytest

from prudent.llm import embeddings, minhash, shingles

from llm_fixtures import fixture_docs  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, k):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def brute(rows, k, percent=80):
    sets = [(i, brute_set(t, k)) for i, t in rows]
    linked = [(a, b) for a, s in sets for b, t in sets
              if a is not None and b is not None and a < b and s and t and 100 * len(s & t) >= percent * len(s | t)]
    root = brute_components({i for i, _ in sets if i is not None}, linked)
    return sorted(((i, len(s), root.get(i), root.get(i) == i) for i, s in sets), key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_documents_equal_brute_force(fixture_docs, k):
    got = minhash.near_duplicates(fixture_docs, shingle_words=k)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = [(r.doc_id, r.text) for r in fixture_docs.select("doc_id", "text").collect()]
    expected = [(i, n, c, kept if i is not None else True) for i, n, c, kept in brute(rows, k)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(expected, key=str)


def test_a_group_around_the_threshold_is_split_as_brute_force_does(spark):
    """Many near copies whose similarities straddle 0.8: stars alone don't decide these."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    origin = [rng.choice(vocabulary) for _ in range(100)]
    rows = []
    for i in range(160):
        words = list(origin)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(100)] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old = minhash.SMALL_LABEL
    try:
        for minhash.SMALL_LABEL in (64, 3):  # either way of comparing open buckets
            got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle_words=2).collect()}
            assert got == {i: c for i, _, c, _ in brute(rows, 2)}
    finally:
        minhash.SMALL_LABEL = old


def test_documents_empty_table(fixture_docs):
    assert minhash.near_duplicates(fixture_docs.limit(0)).collect() == []


def test_signatures_estimate_the_similarity():
    import numpy as np
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.arange(200, 1200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s = shingles.min_max_signatures([np.unique(shingles._mix(a)), np.unique(shingles._mix(b))], 512, 3)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.05


def vectors(seed=3):
    rng = random.Random(seed)
    rows = []
    for label in (0, 1):
        for c in range(12):
            centre = [rng.gauss(0, 1) for _ in range(16)]
            for j in range(rng.randrange(1, 9)):
                noise = rng.choice([0.02, 0.1, 0.25])
                rows.append((len(rows), [float(f"{x + rng.gauss(0, noise):.4f}") for x in centre], label))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 1), (902, None, 0), (903, [0.0] * 16, 0), (904, [float("nan")] + [1.0] * 15, 0),
             (905, [None] + [1.0] * 15, 0), (906, rows[0][1], None), (907, rows[0][1][:8], 0), (908, [2 * x for x in rows[0][1]], 0), (909, [], 0)]
    return rows


def test_vectors_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, lab, 1, "c") for i, v, lab in rows],
                               "vec_id long, embedding array<double>, label int, component_id int, keys string")

    def cosine(a, b):
        return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))

    fine = [(i, v, lab) for i, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for a, v, l1 in fine for b, w, l2 in fine if a < b and l1 == l2 and len(v) == len(w) and cosine(v, w) >= 0.93]
    root = brute_components([r[0] for r in rows], links)
    expected = sorted((i, sum(i in p for p in links), root[i], root[i] == i) for i, _, _ in rows)
    old = embeddings.CHUNK
    try:
        for embeddings.CHUNK in (1024, 3):  # chunks of a large bucket give the same counts
            got = embeddings.near_duplicate_vectors(df, recall=0.9999)
            assert sorted(tuple(r) for r in got.collect()) == expected
    finally:
        embeddings.CHUNK = old
    assert embeddings.near_duplicate_vectors(df.limit(0)).collect() == []


def test_recall_of_the_table_plan():
    k, tables = embeddings.table_plan(10_000, 0.93)
    p = embeddings.collision(math.sqrt(2 - 2 * 0.93), embeddings.WIDTH) ** k
    assert 1 - (1 - p) ** tables >= embeddings.RECALL
