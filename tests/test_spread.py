"""Steps that must leave the rows of one group, or the fits of one sweep, spread over the tasks."""
import bisect
import threading

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.sql import functions as F

from prudent.operators import benchmark as B
from prudent.operators import cluster as K
from prudent.operators import profile as Q
from prudent.operators import relational as R


def test_rows_of_one_group_stay_where_they_are(spark):
    df = spark.range(0, 40_000, 1, 6).select(F.lit("one").alias("g"), F.col("id").cast("double").alias("x"))
    groups = R.cut_lineage(df.groupBy("g").agg(F.max("x").alias("top")))
    kept = R.with_group(df, groups, ["g"]).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sorted(r["count"] for r in kept) == [6666, 6666, 6667, 6667, 6667, 6667]


@pytest.mark.parametrize("most", [R.MAX_GROUP_VALUES, 0])
def test_quantiles_and_mad_of_one_large_group(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MAX_GROUP_VALUES", most)  # 0: too many groups to broadcast
    x = np.random.default_rng(1).gamma(2.0, 3.0, 5000)
    rows = [("a", float(v)) for v in x] + [("b", 1.0)] * 3 + [("c", None), (None, 7.0)]
    got = {r.g: r for r in Q.distribution(spark.createDataFrame(rows, "g string, x double"), ["x"], ["g"]).collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert [a.p5, a.p25, a.median, a.p75, a.p95] == pytest.approx(list(np.quantile(x, [0.05, 0.25, 0.5, 0.75, 0.95])), rel=1e-12)
    assert a.mad == pytest.approx(np.median(abs(x - np.median(x))), rel=1e-12) and got["b"].mad == 0


@pytest.mark.parametrize("n", [1, 2, 63, 64, 130])
def test_count_below_of_every_length(spark, n):
    bounds = sorted([float(i // 2) for i in range(n - 1)] + [float("inf")])
    vs = [-1.0, 0.0, 0.5, 1.0, 20.0, n / 2.0, 1e9, float("inf")]
    df = spark.createDataFrame([(bounds, v) for v in vs] + [(bounds, None)], "b array<double>, v double").select("v", R.count_below(F.col("b"), F.col("v"), n).alias("k"))
    assert not df.schema["k"].nullable
    assert {r.v: r.k for r in df.collect()} == {**{v: bisect.bisect_left(bounds, v) for v in vs}, None: 0}


def test_gap_report_spreads_the_entities_of_a_group(spark):
    rng = np.random.default_rng(7)
    panel = spark.createDataFrame([("g", i, m, float(rng.normal(100 + i % 5, 3))) for i in range(1600) for m in range(4)], "g string, e long, m long, y double")
    assert B.gap_report(panel, ["g"], "e", "m", "y").rdd.getNumPartitions() == 4
    few = B.gap_report(panel.where("e < 4"), ["g"], "e", "m", "y").collect()
    levels = {r.e: r.level for r in few}
    for r in few:  # three peers: two degrees of freedom
        others = [v for e, v in levels.items() if e != r.e]
        assert r.bench_high - r.bench_low == pytest.approx(2 * 4.302652730 * np.std(others, ddof=1) / 3 ** 0.5, abs=1e-4)


def test_fits_of_a_sweep_run_at_once(spark):
    together = threading.Barrier(3, timeout=30)
    assert sorted(K._at_once(spark, [lambda i=i: (together.wait(), i)[1] for i in range(3)])) == [0, 1, 2]


def test_sweeps_equal_single_fits(spark):
    rng = np.random.default_rng(3)
    df = K.prepare(spark.createDataFrame([(float(x), float(y)) for m in (0, 8, 20) for x, y in rng.normal(m, 1, (60, 2))], "x double, y double"), ["x", "y"]).select("features").cache()
    got = {r.k: r for r in K.kmeans_sweep(df, [4, 2, 3]).collect()}
    assert list(got) == [4, 2, 3] and got[3].silhouette == max(r.silhouette for r in got.values())
    for k, r in got.items():
        assert r.cost == pytest.approx(KMeans(k=k, seed=42).fit(df).summary.trainingCost)
    mixtures = {r.k: r for r in K.gmm_sweep(df, range(2, 5)).collect()}
    for k, r in mixtures.items():
        assert r.log_likelihood == pytest.approx(GaussianMixture(k=k, seed=42).fit(df).summary.logLikelihood)
    assert [k for k, r in mixtures.items() if r.best] == [3]


def test_rows_of_a_sweep_are_kept_in_partitions_by_their_number(spark):
    kept = K._kept(spark.range(0, 5000, 1, 200))
    assert kept.rdd.getNumPartitions() == K.FIT_TASKS and sorted(r.id for r in kept.collect()) == list(range(5000))
    assert K._kept(spark.range(0, 5000, 1, 3)).rdd.getNumPartitions() == 3
