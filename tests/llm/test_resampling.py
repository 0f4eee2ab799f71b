"""Importance resampling against a plain count of every feature."""
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from prudent.llm import queries, resampling

from llm_fixtures import fixture_docs  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target, share=25, seed=7, min_words=20, buckets=10_000):
    def histogram(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in brute_features(t)[1])
    s, t = histogram([x for _, x in docs]), histogram(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, found = brute_features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // max(len(found), 1)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[:share * len(able) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, rows), key=str)


def taken(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return sorted(map(tuple, df.collect()), key=str)


ODD = [(900, "é" * 30 + " " + "x" * 200 + " y " + "x" * 200), (901, "ÀB cd　ef 12,34" * 9), (902, "a" * 47 + " " + "b" * 48 + " " + "c" * 49),
       (903, "\x00 \x7f !"), (904, "Word"), (905, "zwei wörter")]


@pytest.mark.parametrize("share", [0, 25, 100])
def test_equals_brute_force(spark, fixture_docs, share):
    more = spark.createDataFrame([(i, t) for i, t in ODD], "doc_id long, text string")
    docs = fixture_docs.unionByName(more, allowMissingColumns=True).withColumn("score", fixture_docs_constant()).withColumn("rank", fixture_docs_constant())
    target = spark.createDataFrame([("w1 w2 w3 W4",), (None,), ("",), ("w5, w6 w5. zwei wörter",)], "text string")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = taken(resampling.resample(docs, target, share=share))
    assert got == brute(rows, [r.text for r in target.collect()], share)
    if share == 100:  # all of the able rows stand in one order, ties by id
        ranks = sorted(r[4] for r in got if r[4] is not None)
        assert ranks == list(range(1, len(ranks) + 1))


def fixture_docs_constant():
    from pyspark.sql import functions as F
    return F.lit("clash")


def test_registered_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert taken(queries.QUERIES["op11_importance_resampling"](spark, sf)) == brute(docs, target)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(i, f"w{i} and more " * 10) for i in range(30)], "doc_id long, text string")
    assert taken(resampling.resample(empty, docs)) == []
    rows = [tuple(r) for r in docs.collect()]
    assert taken(resampling.resample(docs, empty)) == brute(rows, [])


def test_one_text_larger_than_a_chunk(monkeypatch):
    """Pieces of a long text give the counts of the whole, also where one word fills several pieces."""
    monkeypatch.setattr(resampling, "CHUNK", 64)
    for text in ("one two three " * 40, "x" * 500, "ab " + "y" * 300 + " cd" + " " * 200 + "ef gh", "  ..  " * 60, "é1 " * 99):
        words, counts = resampling.long_counts(np.frombuffer(text.encode(), np.uint8), 1000)
        n, found = brute_features(text)
        expected = np.bincount([zlib.crc32(f.encode()) % 1000 for f in found], minlength=1000) if found else np.zeros(1000)
        assert words == n and (counts == expected).all()


def test_bit_sliced_sums_are_exact():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 5, (40, 1003)) * rng.integers(0, 2, (40, 1003)) + (rng.random((40, 1003)) < 0.001) * 70_000
    counts[7] = 0
    gain = rng.integers(-9000, 9000, 1003)
    assert (resampling.sliced_sums(counts, resampling.gain_planes(gain)) == counts @ gain).all()
    assert (resampling.sliced_sums(counts, resampling.gain_planes(gain * 0)) == 0).all()
