"""Scalable operators against brute force on small frames."""
import random

import pandas as pd
from pyspark.sql import functions as F

from prudent.operators import relational as R


def test_avg_rank_matches_pandas(spark):
    random.seed(1)
    rows = [(random.choice("ab"), float(random.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.v): r.rank for r in R.avg_rank(df, "v", ["g"], buckets=4).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "v"])
    pdf["rk"] = pdf.groupby("g")["v"].rank(method="average")
    for g, v, rk in pdf.itertuples(index=False):
        assert got[(g, v)] == rk


def test_peer_median_brute_force(spark):
    random.seed(2)
    rows = [(w, e, float(random.randint(0, 9))) for w in range(6) for e in range(random.randint(1, 7))]
    df = spark.createDataFrame(rows, "w int, e int, v double")
    got = {(r.w, r.e): r.peer_median for r in R.peer_median(df, ["w"], "e", "v").collect()}
    pdf = pd.DataFrame(rows, columns=["w", "e", "v"])
    for w, e, _ in rows:
        peers = pdf[(pdf.w == w) & (pdf.e != e)].v
        exp = None if peers.empty else float(peers.median())
        assert got[(w, e)] == exp


def test_range_join_brute_force(spark):
    random.seed(3)
    spans = [(k, i, random.randint(0, 5 * 86400), 0) for k in range(3) for i in range(5)]
    spans = [(k, i, s, s + random.randint(1, 3 * 86400)) for k, i, s, _ in spans]
    pts = [(k, random.randint(0, 9 * 86400)) for k in range(3) for _ in range(40)]
    sp = spark.createDataFrame(spans, "k int, span int, s long, e long") \
        .select("k", "span", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    pt = spark.createDataFrame(pts, "k int, t long").select("k", F.timestamp_seconds("t").alias("t"))
    got = sorted((r.k, r.span, r.t.timestamp() if hasattr(r.t, "timestamp") else r.t)
                 for r in R.range_join(pt, sp, "k", "t", "s", "e", 86400).collect())
    exp = sorted((k, i, t) for k, i, s, e in spans for k2, t in pts if k2 == k and s <= t < e)
    assert len(got) == len(exp)


def test_overlap_pairs_once(spark):
    rows = [("x", "f1", "r1", "2024-01-01", "2024-03-01"), ("x", "f2", "r2", "2024-02-15", "2024-02-20"),
            ("x", "f3", "r3", "2024-04-01", "2024-05-01"), ("y", "f4", "r1", "2024-01-01", "2024-12-01"),
            ("y", "f5", "r2", "2024-06-01", "2024-06-02")]
    df = spark.createDataFrame(rows, "entity string, finding_id string, run_id string, window_start string, "
                                     "window_end string") \
        .select("entity", "finding_id", "run_id", F.to_date("window_start").alias("window_start"),
                F.to_date("window_end").alias("window_end"))
    got = sorted((r.a_id, r.b_id) for r in R.overlap_pairs(df).collect())
    assert got == [("f1", "f2"), ("f4", "f5")]
    nc = sorted(r.finding_id for r in R.non_connections(df, R.overlap_pairs(df)).collect())
    assert nc == ["f3"]


def test_derived_metric_parsing():
    txt = "# c\n\na = sum(x) | note\nno equals here\nb = x = y\n"
    assert R.parse_derived_metrics(txt) == [("a", "sum(x)", "note"), ("b", "x = y", "")]


def test_running_cap(spark):
    df = spark.createDataFrame([(1, i, 10.0) for i in range(1, 11)], "k int, t int, v double")
    r = R.running_cap(df, ["k"], ["t"], "v", 80.0).first()
    assert (r.first_at_50, r.first_at_75, r.first_at_90, r.first_over_cap) == (4, 6, 8, 9)


def test_exact_hash_sample_equals_top_n(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    a = R.exact_hash_sample(li, key, 123, seed=7, buckets=64)
    h = F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit(7)), F.lit(1 << 40))
    b = li.withColumn("u", h).orderBy("u", *key).limit(123).drop("u")
    assert a.count() == 123 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
