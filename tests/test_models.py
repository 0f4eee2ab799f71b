"""Fitted models and simulated tests against published values, enumeration and plain fits."""
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prudent.functions import studentized as Q
from prudent.operators import models as M


def test_studentised_range_equals_published_quantiles(spark):
    # upper five per cent points of the studentised range (k groups, df)
    table = [(2, 1, 17.97), (3, 10, 3.877), (5, 20, 4.232), (4, 8, 4.529), (10, 60, 4.646), (6, 120, 4.096), (5, 10**7, 3.858)]
    df = spark.createDataFrame([(float(q), k, d) for k, d, q in table], "q double, k int, df int")
    out = df.select("q", F.expr(Q.range_sf("q", "k", "df")).alias("p"), F.expr(Q.range_quantile(0.95, "k", "df")).alias("crit")).collect()
    for r in out:
        assert abs(r.p - 0.05) < 2e-4 and abs(r.crit - r.q) < 6e-3
    # two groups: the range of two means is sqrt(2) times a t statistic
    two = spark.createDataFrame([(2.5, 7.0)], "t double, df double").select(F.expr(Q.range_sf("t * sqrt(2.0D)", "2", "df")).alias("p")).first()
    from prudent.functions.dist import t_sf2
    t = spark.createDataFrame([(2.5, 7.0)], "t double, df double").select(F.expr(t_sf2("t", "df")).alias("p")).first()
    assert abs(two.p - t.p) < 1e-9


def test_tukey_pairs_nulls_and_families(spark):
    rng = np.random.default_rng(1)
    rows = [(f, g, float(rng.normal(g == "c", 1))) for f in ("x", "y", None) for g in "abc" for _ in range(12)] + [("x", None, 1.0), ("x", "a", None)]
    df = spark.createDataFrame(rows, "f string, g string, v double")
    out = M.tukey_hsd(df, "v", "g", by=["f"]).collect()
    assert len(out) == 9 and all(r.g1 < r.g2 and r.ci_low < r.mean_diff < r.ci_high for r in out)
    for r in out:  # an interval leaves zero out where the p-value is below five per cent
        assert (r.ci_low > 0 or r.ci_high < 0) == (r.p_value < 0.05)
    one = M.tukey_hsd(df.where("g = 'a'"), "v", "g").collect()
    assert one == []
    assert M.tukey_hsd(df.where("false"), "v", "g").collect() == []


def _rss(x, y):
    return float(np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2))


def test_two_way_anova_equals_nested_least_squares(spark):
    rng = np.random.default_rng(2)
    rows = [(a, b, float(a + 2 * b + a * b * 0.3 + rng.normal())) for a in range(3) for b in range(4)
            for _ in range(rng.integers(0, 9) if (a, b) != (2, 3) else 0)]
    df = spark.createDataFrame(rows + [(0, 0, None)], "a int, b int, y double")
    got = {r.source: r for r in M.two_way_anova(df, "y", "a", "b").collect()}
    d = pd.DataFrame(rows, columns=["a", "b", "y"])
    da, db = pd.get_dummies(d.a).to_numpy(float), pd.get_dummies(d.b).to_numpy(float)
    cells = pd.get_dummies(d.a.astype(str) + ":" + d.b.astype(str)).to_numpy(float)
    y = d.y.to_numpy()
    both, full = _rss(np.hstack([da, db]), y), _rss(cells, y)
    expected = {"a": _rss(db, y) - both, "b": _rss(da, y) - both, "a:b": both - full, "residual": full}
    for s, ss in expected.items():
        assert got[s].ss == pytest.approx(ss, abs=1e-5)
    k = cells.shape[1]
    assert [got[s].df for s in ("a", "b", "a:b", "residual")] == [2, 3, k - 6, len(d) - k]


def test_confounded_factors_take_degrees_of_freedom_away(spark):
    df = spark.createDataFrame([(i % 3, i % 3, float(i)) for i in range(12)], "a int, b int, y double")
    got = {r.source: r for r in M.two_way_anova(df, "y", "a", "b").collect()}
    assert got["a"].df == got["b"].df == got["a:b"].df == 0 and got["a"].p_value is None


def _newton(x, y, family):
    b = np.zeros(x.shape[1])
    for _ in range(60):
        e = x @ b
        mu = np.exp(e) if family == "poisson" else 1 / (1 + np.exp(-e))
        w = mu if family == "poisson" else mu * (1 - mu)
        b = b + np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (y - mu))
    return b, np.linalg.inv(x.T @ (x * w[:, None]))


@pytest.mark.parametrize("family", ["poisson", "binomial"])
def test_glm_equals_newton_and_its_score_is_zero(spark, family):
    rng = np.random.default_rng(3)
    n = 800
    a, b = rng.normal(1000, 3, n), rng.integers(0, 2, n)
    eta = -0.4 + 0.2 * (a - 1000) + 0.7 * b
    y = rng.poisson(np.exp(eta)) if family == "poisson" else (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    pdf = pd.DataFrame({"y": y.astype(float), "a": a, "b": b.astype(float)})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1.0, 1.0), (1.0, None, 1.0)], "y double, a double, b double"))
    fit = M.glm(df, "y", ["a", "b"], family)
    assert fit.converged and fit.n == n and np.abs(fit.score).max() < 1e-5 * n
    beta, cov = _newton(np.column_stack([np.ones(n), a - 1000, b]), y, family)
    assert fit.beta[1:] == pytest.approx(beta[1:], abs=1e-6)
    assert fit.beta[0] == pytest.approx(beta[0] - 1000 * beta[1], abs=1e-3)
    assert np.sqrt(np.diag(fit.cov))[1:] == pytest.approx(np.sqrt(np.diag(cov))[1:], rel=1e-5)
    lr = M.likelihood_ratio(df, "y", ["a"], ["b"], family).first()
    assert lr.df == 1 and lr.chi2 == pytest.approx(M.glm(df, "y", ["a"], family).deviance - fit.deviance, abs=1e-5)


def test_a_term_that_repeats_another_has_no_coefficient(spark):
    df = spark.createDataFrame([(float(i % 7), float(i), 2.0 * i + 3) for i in range(40)], "y double, a double, b double")
    t = {r.term: r for r in M.coefficients(spark, M.glm(df, "y", ["a", "b"])).collect()}
    assert t["b"].coefficient is None and t["a"].coefficient is not None


def test_separated_classes_are_told(spark):
    df = spark.createDataFrame([(float(i >= 10), float(i)) for i in range(20)], "y double, x double")
    assert not M.glm(df, "y", ["x"], "binomial", steps=8).converged


def _enumerated(table):
    """Exact probability that a table of these margins has a chi-square as large."""
    rows, columns = table.sum(1), table.sum(0)

    def fill(left, r):
        if r == len(rows) - 1:
            yield [left]
            return
        for first in itertools.product(*(range(c + 1) for c in left)):
            if sum(first) == rows[r]:
                for rest in fill(tuple(a - b for a, b in zip(left, first)), r + 1):
                    yield [first, *rest]

    def stat(t):
        return sum(o * o / (rows[i] * columns[j]) for i, line in enumerate(t) for j, o in enumerate(line))

    observed, total, extreme = stat(table.tolist()), 0.0, 0.0
    for t in fill(tuple(columns.tolist()), 0):
        p = math.exp(-sum(math.lgamma(o + 1) for line in t for o in line))
        total += p
        extreme += p * (stat(t) >= observed * (1 - 1e-12))
    return extreme / total


def test_monte_carlo_is_within_its_error_of_enumeration_on_any_partitioning(spark):
    table = np.array([[4, 0, 1], [1, 3, 0], [0, 1, 4]])
    rows = [(f"r{i}", f"c{j}") for i in range(3) for j in range(3) for _ in range(table[i, j])] + [(None, "c0"), ("r0", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = M.monte_carlo_chi2(df, "a", "b", replicates=4000).first()
    exact = _enumerated(table)
    assert abs(got.p_value - exact) < 4 * math.sqrt(exact * (1 - exact) / 4000) + 1 / 4000
    assert tuple(M.monte_carlo_chi2(df.repartition(7), "a", "b", replicates=4000).first()) == tuple(got)
    expected = table.sum(1)[:, None] * table.sum(0) / table.sum()
    assert got.chi2 == pytest.approx(((table - expected) ** 2 / expected).sum(), abs=1e-6)
