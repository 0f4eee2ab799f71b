"""Change points and lagged tests against plain loops over whole arrays."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prudent.operators import breaks as B


def frame(spark, series):
    rows = [(k, i, float(v)) for k, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "k string, t long, y double")


def contrast(y, lo, hi, b):
    """Places from 1; the split stands after b."""
    x = y[lo - 1:hi]
    n, n1 = len(x), b - lo + 1
    return abs(np.sqrt((n - n1) / (n * n1)) * x[:n1].sum() - np.sqrt(n1 / (n * (n - n1))) * x[n1:].sum())


def brute_segments(y, intervals, min_size, limit):
    found, open_ = [], [(1, len(y))]
    while open_:
        lo, hi = open_.pop()
        if hi - lo + 1 < 2 * min_size:
            continue
        best = (0.0, 0)
        for a, z in [(lo, hi)] + [i for i in intervals if i[0] >= lo and i[1] <= hi]:
            splits = [(contrast(y, a, z, b), -b) for b in range(a + min_size - 1, z - min_size + 1)]
            s, b = max(splits)
            if lo + min_size - 1 <= -b <= hi - min_size:
                best = max(best, (s, b))
        if best[0] > limit:
            found.append(-best[1])
            open_ += [(lo, -best[1]), (-best[1] + 1, hi)]
    return sorted(found)


@pytest.mark.parametrize("intervals", [0, 40])
def test_segmentation_equals_brute_force_and_finds_planted_shifts(spark, intervals):
    rng = np.random.default_rng(5)
    series = {"shifts": np.concatenate([rng.normal(m, 1, n) for m, n in ((0, 40), (6, 25), (1, 30), (8, 45))]), "noise": rng.normal(0, 1, 120),
              "constant": np.full(50, 3.0), "short": np.array([1.0, 2.0, 9.0])}
    df = frame(spark, series)
    got = B.wild_binary_segmentation(df, ["k"], intervals).toPandas()
    p = B._prefixes(df, ["k"], F.col("y"))
    drawn = B.random_intervals(p, ["k"], intervals, 42, 4).toPandas() if intervals else pd.DataFrame(columns=["k", "lo", "hi"])
    for k in ("shifts", "noise"):
        y = series[k]
        sigma = np.median(np.abs(np.diff(y))) * 1.4826 / np.sqrt(2)
        pairs = list(drawn[drawn.k == k][["lo", "hi"]].itertuples(index=False, name=None))
        assert sorted(got[got.k == k].position) == brute_segments(y, pairs, 4, sigma * np.sqrt(2 * np.log(len(y))))
    assert set(got.k) <= {"shifts", "noise"}
    places = sorted(got[got.k == "shifts"].position)
    assert all(min(abs(p - x) for p in places) <= 1 for x in (40, 65, 95))
    assert (got.split_t == got.position - 1).all()


def test_segmentation_of_nothing(spark):
    assert B.wild_binary_segmentation(frame(spark, {}), ["k"]).count() == 0
    assert B.wild_binary_segmentation(frame(spark, {"a": [1.0, 2.0]}), ["k"]).count() == 0
    assert B.variance_shifts(frame(spark, {}), ["k"]).count() == 0


def brute_icss(y, min_size, critical):
    e = (y - y.mean()) ** 2

    def best(lo, hi):
        x = e[lo - 1:hi]
        n, c = len(x), np.cumsum(x)
        k = np.arange(1, n + 1)
        d = np.sqrt(n / 2) * np.abs(c / c[-1] - k / n)
        inside = range(min_size - 1, n - min_size)
        return max(((d[i], -(lo + i)) for i in inside), default=(0.0, 0))

    found, open_ = [], [(1, len(y))]
    while open_:
        lo, hi = open_.pop()
        s, b = best(lo, hi) if hi - lo + 1 >= 2 * min_size else (0, 0)
        if s > critical:
            found.append(-b)
            open_ += [(lo, -b), (-b + 1, hi)]
    seen, points = [], sorted(found)
    while points not in seen:
        seen.append(points)
        edges = [0, *points, len(y)]
        again = [best(a + 1, z) for a, z in zip(edges, edges[2:])]
        points = sorted({-b for s, b in again if s > critical})
    return points


def test_variance_shifts_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    series = {"three": np.concatenate([rng.normal(5, s, n) for s, n in ((1, 90), (4, 70), (1.2, 110))]), "noise": rng.normal(0, 1, 200),
              "flat": np.full(40, 2.0)}
    got = B.variance_shifts(frame(spark, series), ["k"]).toPandas()
    for k, y in series.items():
        if k != "flat":
            assert sorted(got[got.k == k].position) == brute_icss(y, 8, B.ICSS_95)
    three = got[got.k == "three"].sort_values("position")
    assert len(three) == 2 and abs(three.position.iloc[0] - 90) <= 8 and abs(three.position.iloc[1] - 160) <= 8
    assert three.ratio.iloc[0] > 5 and three.ratio.iloc[1] < 0.3
    assert "noise" not in set(got.k) and "flat" not in set(got.k)


def brute_adf(y, max_lag, fixed):
    dy = np.diff(y)
    rows = range(max_lag, len(dy))
    x = np.array([[1, y[i]] + [dy[i - j] for j in range(1, max_lag + 1)] for i in rows])
    z, best = dy[max_lag:], None
    for lag in range(max_lag + 1):
        a = x[:, :lag + 2]
        b = np.linalg.lstsq(a, z, rcond=None)[0]
        rss = np.sum((z - a @ b) ** 2)
        n = len(z)
        aic = n * np.log(rss / n) + 2 * (lag + 2)
        tau = b[1] / np.sqrt(rss / (n - lag - 2) * np.linalg.inv(a.T @ a)[1, 1])
        if (lag == max_lag) if fixed else (best is None or aic < best[0]):
            best = (aic, lag, tau)
    return best[1], best[2]


@pytest.mark.parametrize("fixed", [True, False])
def test_lagged_unit_root_tests_equal_least_squares(spark, fixed):
    rng = np.random.default_rng(9)
    walk = np.cumsum(rng.normal(0, 1, 200)) + 500
    ar = np.zeros(200)
    for i in range(2, 200):
        ar[i] = 0.3 * ar[i - 1] - 0.4 * ar[i - 2] + rng.normal()
    df = frame(spark, {"walk": walk, "ar": ar, "flat": np.full(30, 1.0), "short": [1.0, 2.0]})
    got = {r.k: r for r in B.adf(df, ["k"], 3, fixed).collect()}
    for k, y in (("walk", walk), ("ar", ar)):
        lag, tau = brute_adf(y, 3, fixed)
        assert got[k].lag == lag and got[k].tau == pytest.approx(tau, rel=1e-7)
    assert got["ar"].unit_root_rejected_at == "1%" and got["walk"].unit_root_rejected_at == "not_rejected"
    assert got["flat"].tau is None and "short" not in got


def test_level_stationarity_with_a_bartlett_window(spark):
    rng = np.random.default_rng(10)
    walk = np.cumsum(rng.normal(0, 1, 150))
    noise = rng.normal(0, 1, 150)
    df = frame(spark, {"walk": walk, "noise": noise})
    for lags in (None, 0, 3):
        got = {r.k: r for r in B.kpss(df, ["k"], lags).collect()}
        for k, y in (("walk", walk), ("noise", noise)):
            e = y - y.mean()
            q = int(4 * (len(y) / 100) ** 0.25) if lags is None else lags
            s2 = sum((1 if j == 0 else 2 * (1 - j / (q + 1))) * np.sum(e[j:] * e[:len(e) - j]) for j in range(q + 1)) / len(y)
            assert got[k].eta == pytest.approx(np.sum(np.cumsum(e) ** 2) / len(y) ** 2 / s2, rel=1e-9)
    assert got["walk"].stationarity_rejected_at == "1%"


def test_clustered_interval_is_wider_than_the_plain_one(spark):
    rng = np.random.default_rng(11)
    rows = []
    for c in range(60):
        own = rng.normal(0, 3, 2)
        rows += [(c, c % 2 == 0, bool(p), float(1 + 2 * (c % 2 == 0) * p + own[p] + rng.normal())) for p in (0, 1) for _ in range(20)]
    df = spark.createDataFrame(rows + [(None, True, True, 1.0), (1, True, True, None)], "c long, tr boolean, post boolean, y double")
    r = B.did_clustered(df, F.col("tr"), F.col("post"), "y", "c").first()
    d = pd.DataFrame(rows, columns=["c", "tr", "post", "y"])
    x = np.column_stack([np.ones(len(d)), d.tr, d.post, d.tr & d.post]).astype(float)
    b = np.linalg.lstsq(x, d.y, rcond=None)[0]
    u = x * (d.y.to_numpy() - x @ b)[:, None]
    s = np.array([u[d.c == c].sum(0) for c in range(60)])
    bread = np.linalg.inv(x.T @ x)
    v = bread @ s.T @ s @ bread * 60 / 59 * (len(d) - 1) / (len(d) - 4)
    assert r.did == pytest.approx(b[3], abs=1e-6) and r.se == pytest.approx(np.sqrt(v[3, 3]), abs=1e-6)
    plain = np.sqrt(np.sum((d.y - x @ b) ** 2) / (len(d) - 4) * bread[3, 3])
    assert r.se > 1.5 * plain and r.ci_low < r.did < r.ci_high
