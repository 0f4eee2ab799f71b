"""Tests of groups: chosen by shape, pairing and number of groups, run, corrected; against their definitions."""
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prudent.operators import stats as X
from prudent.plans.q_extra import choose_test

SCHEMA = "l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_discount double"


def _norm2(z):
    return math.erfc(abs(z) / math.sqrt(2))


def _t2(t, df):
    x = np.linspace(0, abs(t), 20_001)
    y = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    return 1 - 2 * float(np.sum((y[1:] + y[:-1]) / 2) * (x[1] - x[0]))


def _f_sf(f, df2):  # two degrees of freedom above
    return (1 + 2 * f / df2) ** (-df2 / 2)


def _ties(v):
    return sum(t ** 3 - t for t in np.unique(v, return_counts=True)[1].tolist())


def _expected(test, d):
    """Statistic and p-value over the columns level, x (and s, a row per subject and level)."""
    groups = [g.x.to_numpy() for _, g in d.groupby("level")]
    n, rank = len(d), d.x.rank()
    if test == "welch_t":
        (a, b), se = groups, [g.var(ddof=1) / len(g) for g in groups]
        t = (a.mean() - b.mean()) / math.sqrt(sum(se))
        return t, _t2(t, sum(se) ** 2 / sum(s * s / (len(g) - 1) for s, g in zip(se, groups)))
    if test == "mann_whitney":
        n1, n2 = map(len, groups)
        u = rank[d.level == d.level.min()].sum() - n1 * (n1 + 1) / 2
        return u, _norm2((u - n1 * n2 / 2) / math.sqrt(n1 * n2 / 12 * (n + 1 - _ties(d.x) / (n * (n - 1)))))
    if test == "anova":
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        f = sum(len(g) * (g.mean() - d.x.mean()) ** 2 for g in groups) / 2 / (within / (n - 3))
        return f, _f_sf(f, n - 3)
    if test == "kruskal":
        h = 12 / (n * (n + 1)) * sum(r.sum() ** 2 / len(r) for _, r in rank.groupby(d.level)) - 3 * (n + 1)
        h /= 1 - _ties(d.x) / (n ** 3 - n)
        return h, math.exp(-h / 2)
    wide = d.pivot(index="s", columns="level", values="x")
    n, k = wide.shape
    assert not wide.isna().any(axis=None)
    diff = wide.iloc[:, 0] - wide.iloc[:, 1]
    if test == "paired_t":
        t = diff.mean() / (diff.std() / math.sqrt(n))
        return t, _t2(t, n - 1)
    if test == "wilcoxon":
        diff = diff[diff != 0]
        w, n = diff.abs().rank()[diff > 0].sum(), len(diff)
        return w, _norm2((w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - _ties(diff.abs()) / 48))
    if test == "friedman":
        r = wide.rank(axis=1).sum()
        chi2 = (12 / (n * k * (k + 1)) * (r ** 2).sum() - 3 * n * (k + 1)) / (1 - sum(map(_ties, wide.to_numpy())) / (n * k * (k * k - 1)))
        return chi2, math.exp(-chi2 / 2)
    rest = wide.sub(wide.mean(axis=1), axis=0).sub(wide.mean() - d.x.mean(), axis=1)
    f = n * ((wide.mean() - d.x.mean()) ** 2).sum() / 2 / ((rest ** 2).sum().sum() / ((n - 1) * 2))
    return f, _f_sf(f, (n - 1) * 2)


def _lines():
    rng = np.random.default_rng(5)
    rows = []
    for s in range(60):
        for i, (flag, status) in enumerate((f, o) for f in "ANR" for o in "FO"):
            for _ in range(2):
                q = float(rng.normal(25 + (flag == "R") + s % 3 / 4, 4))
                # quarters: many ties
                rows.append((s, flag, status, q, float(np.round(np.exp(rng.normal(status == "O", 1.2)) * 4) / 4), 0.1 * i))
    # left out of the comparison they are in: no level, no value, no subject, not in all levels
    return rows + [(1, None, "F", 27.0, 5.0, None), (2, "A", "O", float("nan"), None, 0.1), (None, "N", "F", 31.0, 2.5, 0.0), (99, "A", "F", 20.0, 7.25, None)]


def test_choice_by_shape_pairing_and_number_of_groups(spark):
    df = spark.createDataFrame([(s, n) for s in ("normal", "long_tail") for n in (0, 1, 2, 3, 9)], "s string, n int")
    for paired, names in ((False, ["welch_t", "anova", "mann_whitney", "kruskal"]), (True, ["paired_t", "rm_anova", "wilcoxon", "friedman"])):
        got = {(r.s, r.n): r.t for r in df.select("*", X.choose_test(F.col("s"), F.col("n"), paired).alias("t")).collect()}
        for s, (two, more) in (("normal", names[:2]), ("long_tail", names[2:])):
            assert [got[s, n] for n in (0, 1, 2, 3, 9)] == [None, None, two, more, more]


def test_query_runs_the_chosen_tests(spark, tmp_path):
    rows = _lines()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = choose_test(spark, str(tmp_path)).collect()
    by = {(r.metric, r.grouping, r.paired): r for r in got}
    assert len(got) == len(by) == 12 and {r.test for r in got} == {*X._REPORTED}
    data = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    for (metric, grouping, paired), r in by.items():
        d = data.rename(columns={"l_suppkey": "s", grouping: "level", metric: "x"})[["s", "level", "x"]].dropna(subset=["level", "x"])
        k = d.level.nunique()
        if paired:
            d = d.dropna().groupby(["s", "level"], as_index=False).x.mean().round(12)
            d = d[d.groupby("s").x.transform("size") == k]
        assert (r.n_groups, r.n) == (k, d.s.nunique() if paired else len(d))
        statistic, p = _expected(r.test, d)
        assert (r.statistic, r.p_value) == (pytest.approx(statistic, rel=1e-6, abs=2e-6), pytest.approx(p, abs=2e-6)), r
        assert r.effect_size is not None and r.tier is not None
        assert (r.ci_low is not None) == (r.test in ("welch_t", "paired_t"))
        assert [(x.g1, x.g2) for x in r.post_hoc or []] == ([("A", "N"), ("A", "R"), ("N", "R")] if r.test in ("anova", "kruskal") else [])
    ps = sorted(r.p_value for r in got)
    for r in got:
        assert r.p_bh == pytest.approx(min(12 * p / (i + 1) for i, p in enumerate(ps) if p >= r.p_value), abs=2e-6)
    price = data.rename(columns={"l_returnflag": "g", "l_extendedprice": "x"})[["g", "x"]].dropna()
    rank, n = price.x.rank(), len(price)
    size, mean = rank.groupby(price.g).size(), rank.groupby(price.g).mean()
    z = {(a, b): (mean[a] - mean[b]) / math.sqrt((n * (n + 1) / 12 - _ties(price.x) / (12 * (n - 1))) * (1 / size[a] + 1 / size[b])) for a, b in ("AN", "AR", "NR")}
    dunn = by["l_extendedprice", "l_returnflag", False].post_hoc
    assert [x.statistic for x in dunn] == pytest.approx([z[x.g1, x.g2] for x in dunn], abs=2e-6)
    holm = np.minimum(1, np.maximum.accumulate([m * p for m, p in zip((3, 2, 1), sorted(map(_norm2, z.values())))]))
    assert sorted(x.p_value for x in dunn) == pytest.approx(list(holm), abs=3e-6)


@pytest.mark.parametrize("rows", [[], [(1, "A", "F", 1.0, 2.0, 3.0)], [(s, "A", "F", float(s), None, 1.0) for s in range(9)],
                                  [(1, f, s, 5.0, float(i), 0.5) for i, (f, s) in enumerate(("AF", "AO", "NF", "NO", "RF", "RO"))],
                                  [(s, "ANR"[s % 3], "FO"[s % 2], float(s), 1.0, float("nan")) for s in range(12)]])
def test_too_little_to_test(spark, tmp_path, rows):
    """One level, one subject, one value, no whole block: a row without a result, no error."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = choose_test(spark, str(tmp_path)).collect()
    assert len({(r.metric, r.grouping, r.paired) for r in got}) == len(got)
    for r in got:
        assert (r.test is None) == (r.n_groups < 2)
        assert r.p_value is None or 0 <= r.p_value <= r.p_bh <= 1
        assert r.test is not None or r.statistic is None


def test_kruskal_over_millions_of_rows(spark):
    df = spark.range(0, 3_000_000, 1, 8).selectExpr("id % 7 AS x", "CAST(xxhash64(id) & 3 AS INT) AS g")
    cells = {(r.x, r.g): r["count"] for r in df.groupBy("x", "g").count().collect()}
    n, below, rank = sum(cells.values()), 0, {}
    for x in range(7):
        ties = sum(c for (v, _), c in cells.items() if v == x)
        rank[x], below = (below + Fraction(ties + 1, 2), ties), below + ties
    sums = {g: (sum(c * rank[x][0] for (x, v), c in cells.items() if v == g), sum(c for (_, v), c in cells.items() if v == g)) for g in range(4)}
    h = Fraction(12, n * (n + 1)) * sum(r * r / m for r, m in sums.values()) - 3 * (n + 1)
    h /= 1 - Fraction(sum(t ** 3 - t for _, t in rank.values()), n ** 3 - n)
    assert X.kruskal(df, "x", "g").first().h == pytest.approx(float(h), abs=2e-6)
