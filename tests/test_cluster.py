"""Clustering against plain computations, including the cases where fixed round counts go wrong."""
import random

import numpy as np

from prudent.operators import cluster as K
from prudent.operators import robust as B
from prudent.operators import relational as R
from prudent.operators.graph import connected_components


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1000, 1300)] + [(5, i) for i in range(6, 60)] + [(9, 9), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n for n, c in got.items() if c == 1000} == set(range(1000, 1301))
    assert {n for n, c in got.items() if c == 5} == set(range(5, 60))
    assert len(got) == 301 + 55
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_dbscan_follows_a_chain_of_300_points(spark):
    pts = [(i, 0.9 * i, 0.0) for i in range(300)] + [(1000 + i, 500.0 + 0.1 * i, 9.0) for i in range(5)] + [(2000, -50.0, 0.0)]
    got = B.density_clusters(spark.createDataFrame(pts, "id long, x double, y double"), "id", ["x", "y"], 1.0, 3).collect()
    assert {r.cluster for r in got if r.id < 300} == {1}
    assert {r.id: r.kind for r in got}[0] == "border" and {r.id: r.kind for r in got}[2000] == "noise"
    assert {r.cluster for r in got if 1000 <= r.id < 2000} == {1000}


def test_dbscan_equals_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, rng.gauss(rng.choice([0, 3, 6]), 0.6), rng.gauss(0, 0.6)) for i in range(250)]
    near = {a: [b for b, x2, y2 in pts if (x - x2) ** 2 + (y - y2) ** 2 <= 0.09] for a, x, y in pts}
    core = {a for a, n in near.items() if len(n) >= 5}
    label: dict = {}
    for a in sorted(core):
        if a in label:
            continue
        stack = [a]
        while stack:
            p = stack.pop()
            if p not in label:
                label[p] = a
                stack += [q for q in near[p] if q in core]
    want = {a: (label[a] if a in core else min((label[q] for q in near[a] if q in core), default=None)) for a, _, _ in pts}
    got = {r.id: r.cluster for r in B.density_clusters(spark.createDataFrame(pts, "id long, x double, y double"), "id", ["x", "y"], 0.3, 5).collect()}
    assert got == want


def test_dtw_clusters_follow_levels_at_unequal_lengths(spark):
    rows = [(k, t, float(level)) for k, (level, n) in enumerate([(0, 20), (0, 40), (100, 20), (100, 40), (500, 20), (500, 40)]) for t in range(n)]
    series = spark.createDataFrame(rows, "k long, t long, y double")
    for seed in range(40):  # a start with one centroid per level
        first = [r.k // 2 for r in series.select("k").distinct().selectExpr("k", f"xxhash64(k, {seed}) AS h").orderBy("h").limit(3).collect()]
        if len(set(first)) == 3:
            break
    got = {r.k: r.cluster for r in K.dtw_kmeans(series, "k", 3, band=3, seed=seed).collect()}
    assert got[0] == got[1] != got[2] == got[3] != got[4] == got[5] != got[0]


def test_kprototypes_reach_a_fixed_point(spark):
    rng = np.random.default_rng(4)
    rows = [(float(rng.normal(m, 1)), c) for m, c in [(0, "a"), (20, "b"), (40, "c")] for _ in range(60)]
    got = K.kprototypes(spark.createDataFrame(rows, "x double, c string"), ["x"], ["c"], 3, seed=5).toPandas()
    protos = got.groupby("cluster").agg(x=("x", "mean"), c=("c", lambda v: sorted(v.mode())[0]))
    gamma = float(np.std([r[0] for r in rows], ddof=1))
    for x, c, g in got[["x", "c", "cluster"]].itertuples(index=False):
        cost = (x - protos.x) ** 2 + gamma * (protos.c != c)
        assert cost[g] <= cost.min() + 1e-6


def test_hash_sample_of_more_rows_than_there_are(spark):
    df = spark.range(50)
    assert R.exact_hash_sample(df, ["id"], 100).count() == 50
    assert R.exact_hash_sample(df, ["id"], 50).count() == 50
    assert R.exact_hash_sample(df, ["id"], 49).count() == 49
    try:
        R.guard_rows(df, ["id"], 10)
        raise AssertionError("a guard without sampling must refuse")
    except ValueError:
        pass


def test_batch_path_lengths_equal_a_walk_per_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    tree = K._grow(x[:128], rng, 0, 7)

    def walk(node, row, depth=0):
        while node[0] == "node":
            _, f, cut, left, right = node
            node, depth = (left if row[f] < cut else right), depth + 1
        return depth + K._c_factor(node[1])

    assert np.allclose(K._path_lengths(tree, x), [walk(tree, r) for r in x])
    assert len(K._path_lengths(tree, x[:0])) == 0


def test_isolation_forest_and_mahalanobis_find_planted_outliers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(1000 + i, 9.0 + i, -9.0) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    scored = K.isolation_forest(df, ["x", "y"], "id", trees=40, sample=128, share=0.02)
    assert {r.id for r in scored.orderBy(scored.score.desc()).limit(8).collect()} == set(range(1000, 1008))
    flagged = {r.id for r in K.mahalanobis(df, ["x", "y"], id_col="id").where("is_outlier").collect()}
    assert set(range(1000, 1008)) <= flagged and len(flagged) < 60
