"""Exact deduplication against plain groups of normalised texts."""
import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from prudent.llm import exact, queries

from llm_fixtures import fixture_docs  # noqa: F401


def brute(rows):
    def low(t):
        return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        stays = False
        for i in sorted(ids, key=str):
            kept = i == keep and not stays
            stays |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def taken(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def few():
    """A digest with seven values: nearly all texts collide."""
    return lambda text: str(zlib.crc32(text) % 7)


@pytest.fixture
def folder(spark, fixture_docs, tmp_path):
    odd = spark.createDataFrame([(400, "ÉTÉ"), (401, "été"), (402, "été"), (403, "Été"), (404, "a\x00b"), (405, "A\x00B"), (406, "x" * 300_000),
                                 (407, "X" * 300_000), (408, "x" * 299_999 + "y")], "doc_id long, text string")
    docs = fixture_docs.unionByName(odd, allowMissingColumns=True).withColumn("_metadata", F.lit("clash")).withColumn("file", F.lit(1))
    docs.repartition(5).write.parquet(str(tmp_path / "docs.parquet"))
    return str(tmp_path / "docs.parquet"), [(r.doc_id, r.text) for r in docs.collect()]


def test_equals_brute_force(spark, folder):
    path, rows = folder
    assert taken(exact.deduplicate(spark, path)) == brute(rows)


def test_over_several_micro_batches_hits_are_found_in_the_state(spark, folder, tmp_path):
    path, rows = folder
    state = str(tmp_path / "state")
    assert taken(exact.deduplicate(spark, path, state, maxFilesPerTrigger="1")) == brute(rows)
    batches = spark.read.parquet(f"{state}/keys").select("batch").distinct().count()
    assert batches >= 4


def test_colliding_digests_are_told_apart_by_their_bytes(spark, folder, few):
    path, rows = folder
    assert taken(exact.deduplicate(spark, path, digest=few)) == brute(rows)


def test_retained_texts_too_large_to_broadcast(spark, folder, few, monkeypatch):
    monkeypatch.setattr(exact, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact, "BROADCAST_ROWS", 0)
    path, rows = folder
    assert taken(exact.deduplicate(spark, path, digest=few)) == brute(rows)


def test_files_that_come_later_meet_the_state(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    first = [(i, f"text {i % 4}") for i in range(8)]
    later = [(i, f"TEXT {i % 6}") for i in range(100, 112)]
    spark.createDataFrame(first, "doc_id long, text string").write.parquet(path)
    assert taken(exact.deduplicate(spark, path, state)) == brute(first)
    spark.createDataFrame(later, "doc_id long, text string").write.mode("append").parquet(path)
    assert taken(exact.deduplicate(spark, path, state)) == brute(first + later)
    assert taken(exact.deduplicate(spark, path, state)) == brute(first + later)  # nothing new came


def test_registered_query_and_empty_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert taken(queries.QUERIES["op12_exact_dedup"](spark, sf)) == brute(rows)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none"))
    assert taken(exact.deduplicate(spark, str(tmp_path / "none"))) == []
