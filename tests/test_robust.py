"""Robust scatter and density clustering against planted cases and brute force."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prudent.operators import cluster as K
from prudent.operators import robust as B


def test_a_third_of_planted_rows_does_not_mask_itself(spark):
    rng = np.random.default_rng(1)
    clean = rng.multivariate_normal([100, -5, 0.1], [[9, 2, 0], [2, 1, 0], [0, 0, 0.01]], 700)
    bad = rng.multivariate_normal([125, 5, 0.9], np.diag([1, 0.2, 0.002]), 300)
    x = np.vstack([clean, bad])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(5000, None, 1.0, 1.0)], "id long, a double, b double, c double")
    got = B.robust_scatter(df, ["a", "b", "c"], keep=0.6).toPandas().set_index("id")
    assert len(got) == 1000 and got.loc[700:].is_outlier.all()
    assert got.loc[:699].is_outlier.mean() < 0.06
    plain = x - x.mean(0)
    d2 = np.einsum("ij,jk,ik->i", plain, np.linalg.inv(np.cov(x.T)), plain)
    assert (d2[700:] > B.chi2_quantile(3, 0.975)).mean() < 0.1  # masked for the classical fit
    again = B.robust_scatter(df.repartition(7), ["a", "b", "c"], keep=0.6).toPandas().set_index("id")
    assert (again.is_outlier.sort_index() == got.is_outlier.sort_index()).all()


def test_few_rows_have_no_fit(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 1.0)], "id long, a double, b double")
    assert [r.is_outlier for r in B.robust_scatter(df, ["a", "b"]).collect()] == [False, False]


def points(seed, n):
    rng = np.random.default_rng(seed)
    blob = rng.normal(0, 0.05, (n // 2, 2))
    ring = rng.uniform(-6, 6, (n // 3, 2))
    far = np.array([[300.0, 300.0], [301.0, 300.0], [-900.0, 4.0]])
    same = np.tile([[2.0, 2.0]], (9, 1))
    return np.vstack([blob, ring, far, same])


@pytest.mark.parametrize("k", [1, 4, 12])
def test_k_distance_equals_brute_force(spark, k):
    x = points(2, 240)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(9000, None, 1.0)], "id long, a double, b double")
    got = {r.id: r.k_dist for r in B.k_distance(df, "id", ["a", "b"], k).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(len(x)):
        assert got[i] == pytest.approx(np.sort(np.delete(d[i], i))[k - 1], abs=1e-12)
    assert len(got) == len(x)
    assert [r.k_dist for r in B.k_distance(df.where("id < 3"), "id", ["a", "b"], 5).collect()] == [None] * 3


def test_knee_is_farthest_from_the_chord(spark):
    v = np.sort(np.concatenate([np.linspace(0.1, 0.2, 90), np.array([0.5, 1.0, 2.0, 4.0, 4.0])]))
    got = B.knee(spark.createDataFrame([(float(a),) for a in v], "k_dist double")).first()
    ranks = pd.Series(v).rank().to_numpy()
    below = (ranks - ranks[0]) / (ranks[-1] - ranks[0]) - (v - v[0]) / (v[-1] - v[0])
    assert got.eps == pytest.approx(v[np.argmax(below)]) and got.n == len(v)


def brute_dbscan(x, eps, min_pts):
    d = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = d.sum(1) >= min_pts
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min(label[j] for j in np.flatnonzero(d[i] & core)) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    out = []
    for i in range(len(x)):
        if core[i]:
            out.append((int(label[i]), "core"))
        else:
            near = label[d[i] & core]
            out.append((int(near.min()), "border") if len(near) else (None, "noise"))
    return out


@pytest.mark.parametrize("dim,eps,min_pts", [(1, 0.15, 3), (2, 0.4, 4), (2, 0.05, 6), (3, 0.7, 5)])
def test_density_clusters_equal_brute_force(spark, dim, eps, min_pts):
    rng = np.random.default_rng(dim * 7 + min_pts)
    x = np.vstack([rng.normal(c, 0.25, (60, dim)) for c in (0, 1.2, 2.2)] + [rng.uniform(-3, 5, (80, dim)), np.full((7, dim), 1.7)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"f{i} double" for i in range(dim)))
    got = {r.id: (r.cluster, r.kind) for r in B.density_clusters(df, "id", [f"f{i}" for i in range(dim)], eps, min_pts).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(x, eps, min_pts)


def test_a_dense_place_is_not_compared_with_itself(spark):
    """Twenty thousand points within eps, beside a few: rows written stay linear (pairs would be 400 million)."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.01, (20_000, 2)), rng.uniform(2, 9, (50, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "a": x[:, 0], "b": x[:, 1]}))
    got = B.density_clusters(df, "id", ["a", "b"], 0.3, 8).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("c")).collect()
    kinds = {r.kind: (r.n, r.c) for r in got}
    assert kinds["core"][0] >= 20_000 and kinds["core"][1] >= 1
    assert B.density_clusters(df.where("false"), "id", ["a", "b"], 0.3, 8).count() == 0
    assert B.density_clusters(df.limit(1).withColumn("a", F.lit(None).cast("double")), "id", ["a", "b"], 0.3, 8).first().kind == "noise"


def test_old_and_new_fits_agree_without_contamination(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))], "id long, a double, b double")
    old = {r.id for r in K.mahalanobis(df, ["a", "b"]).where("is_outlier").collect()}
    new = {r.id for r in B.robust_scatter(df, ["a", "b"]).where("is_outlier").collect()}
    assert len(old ^ new) <= 12
