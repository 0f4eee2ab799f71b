"""Several change points per series, lagged unit-root tests, and clustered difference-in-differences.

Series are long tables (key..., t, y) at period grain.  Segmentation works on prefix sums: a candidate
segment costs one join of its bounds with the prefix table.  The recursion runs by rounds over all
open segments of all series at once, so the number of Spark jobs follows the depth of the splits,
not the number of series.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prudent.functions import dist as D
from prudent.functions.scalar import safe_div
from prudent.operators.stats import finalize, nz
from prudent.session import cut_lineage

#: median absolute deviation to standard deviation; 95 % point of the largest |D_k| of a cumulated sum of squares
MAD, ICSS_95 = 1.4826, 1.358


def _by_time(key: list[str]):
    return Window.partitionBy(*key).orderBy("t")


def _prefixes(df: DataFrame, key: list[str], value: Column) -> DataFrame:
    """``i`` (place in the series from 1), ``t``, ``s`` (sum of the values up to there), ``n`` (length); one row a period."""
    w = _by_time(key).rowsBetween(Window.unboundedPreceding, 0)
    d = df.where(F.col("y").isNotNull())
    return cut_lineage(d.select(*key, "t", F.row_number().over(_by_time(key)).alias("i"), F.sum(value).over(w).alias("s"),
                                F.count("*").over(Window.partitionBy(*key)).alias("n")))


def _best_inside(bounds: DataFrame, p: DataFrame, key: list[str], stat, min_size: int) -> DataFrame:
    """For each row of bounds (key, lo, hi) the split after place ``b`` with the largest statistic.

    ``stat`` gets the sums of the part up to b and of the whole, their lengths, and returns a column.  Bounds are joined with the
    prefix sums before ``lo``, at ``hi`` and at every place between.
    """
    ends = p.select(*key, F.col("i").alias("lo0"), F.col("s").alias("s0"))
    tops = p.select(*key, F.col("i").alias("hi"), F.col("s").alias("s1"))
    b = bounds.withColumn("lo0", F.col("lo") - 1).join(ends, [*key, "lo0"], "left").fillna({"s0": 0.0}).join(tops, [*key, "hi"])
    inside = p.select(*[F.col(c).alias(f"__{c}") for c in key], F.col("i").alias("b"), F.col("s").alias("sb"), F.col("t").alias("split_t"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    j = b.join(inside, [*same, F.col("b") >= F.col("lo") + (min_size - 1), F.col("b") <= F.col("hi") - min_size])
    left, whole = F.col("sb") - F.col("s0"), F.col("s1") - F.col("s0")
    n1, n = (F.col("b") - F.col("lo") + 1).cast("double"), (F.col("hi") - F.col("lo") + 1).cast("double")
    j = j.withColumn("stat", stat(left, whole, n1, n)).withColumn("gap", (whole - left) / (n - n1) - left / n1)
    # of equal statistics the earliest place
    return j.groupBy(*key, "lo", "hi").agg(F.max(F.struct("stat", (-F.col("b")).alias("order"), "b", "split_t", "gap")).alias("m")) \
        .select(*key, "lo", "hi", "m.stat", "m.b", "m.split_t", "m.gap")


def _segment(p: DataFrame, key: list[str], stat, threshold: DataFrame, min_size: int, drawn: DataFrame | None = None) -> DataFrame:
    """Split open segments at their largest statistic while it exceeds the series' ``limit``; one round a depth.

    ``drawn`` are candidates (key, lo, hi, stat, b, split_t, gap) that count for every segment they lie in.
    """
    open_ = cut_lineage(p.where("i = n").select(*key, F.lit(1).alias("lo"), F.col("n").alias("hi")).where(F.col("hi") >= 2 * min_size))
    found: list[DataFrame] = []
    while True:
        own = _best_inside(open_, p, key, stat, min_size)
        if drawn is not None:
            seg = open_.select(*[F.col(c).alias(f"__{c}") for c in key], F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
            within = drawn.join(seg, [*[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], F.col("lo") >= F.col("__lo"), F.col("hi") <= F.col("__hi"),
                                      F.col("b") >= F.col("__lo") + (min_size - 1), F.col("b") <= F.col("__hi") - min_size])
            own = own.unionByName(within.select(*key, F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), "stat", "b", "split_t", "gap"))
        top = own.groupBy(*key, "lo", "hi").agg(F.max(F.struct("stat", (-F.col("b")).alias("order"), "b", "split_t", "gap")).alias("m")) \
            .select(*key, "lo", "hi", "m.stat", "m.b", "m.split_t", "m.gap")
        hit = cut_lineage(top.join(threshold, key).where(F.col("stat") > F.col("limit")).withColumn("depth", F.lit(len(found))))
        found.append(hit)
        parts = hit.select(*key, F.col("lo"), F.col("b").alias("hi")).unionByName(hit.select(*key, (F.col("b") + 1).alias("lo"), F.col("hi")))
        open_ = cut_lineage(parts.where(F.col("hi") - F.col("lo") + 1 >= 2 * min_size))
        if open_.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)


def _mean_stat(left: Column, whole: Column, n1: Column, n: Column) -> Column:
    """Contrast of the two means: |sqrt(n2 / (n n1)) sum1 - sqrt(n1 / (n n2)) sum2|."""
    n2 = n - n1
    return F.abs(F.sqrt(n2 / (n * n1)) * left - F.sqrt(n1 / (n * n2)) * (whole - left))


def random_intervals(p: DataFrame, key: list[str], intervals: int, seed: int, min_size: int) -> DataFrame:
    """``intervals`` pairs of places per series, from a hash of the series, the interval's number and the seed."""
    last = p.where("i = n").select(*key, "n").where(F.col("n") >= 2 * min_size)
    m = last.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(intervals))))

    def place(end: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(end), "m", *key), F.col("n")) + 1).cast("int")

    d = m.select(*key, F.least(place(0), place(1)).alias("lo"), F.greatest(place(0), place(1)).alias("hi"))
    return d.where(F.col("hi") - F.col("lo") + 1 >= 2 * min_size).distinct()


def wild_binary_segmentation(df: DataFrame, key: list[str], intervals: int = 100, min_size: int = 4, scale: float = 1.0, seed: int = 42) -> DataFrame:
    """Change points in the mean by wild binary segmentation (``intervals=0``: plain binary segmentation).

    Each open segment takes the largest contrast of two means over all splits of itself and of the random intervals inside it; it is split
    there while that exceeds ``scale * sigma * sqrt(2 ln n)``, sigma from the median absolute first difference.  The
    intervals' largest contrasts are found once.  Returns a row per change: ``split_t`` is the last period before it, ``shift`` the
    difference of means across it in the interval that showed it.  Null values are left out; a constant series has none.
    """
    p = _prefixes(df, key, F.col("y").cast("double"))
    diff = df.where("y IS NOT NULL").withColumn("__d", F.abs(F.col("y") - F.lag("y").over(_by_time(key))))
    sigma = diff.groupBy(*key).agg((F.percentile("__d", 0.5) * MAD / np.sqrt(2)).alias("sigma"), F.count("*").alias("n"))
    limit = cut_lineage(sigma.select(*key, (scale * F.col("sigma") * F.sqrt(2 * F.log("n"))).alias("limit")).where("limit > 0"))
    drawn = cut_lineage(_best_inside(random_intervals(p, key, intervals, seed, min_size), p, key, _mean_stat, min_size)) if intervals else None
    f = _segment(p, key, _mean_stat, limit, min_size, drawn)
    return f.select(*key, "split_t", F.col("b").alias("position"), "stat", "limit", F.col("gap").alias("shift"), "depth")


def _square_stat(left: Column, whole: Column, n1: Column, n: Column) -> Column:
    """Centred cumulated sum of squares: sqrt(n / 2) |C_k / C_n - k / n|."""
    return F.sqrt(n / 2) * F.abs(F.coalesce(safe_div(left, whole), n1 / n) - n1 / n)


def variance_shifts(df: DataFrame, key: list[str], min_size: int = 8, critical: float = ICSS_95) -> DataFrame:
    """Changes of variance by iterated cumulative sums of squares of the deviations from the series' mean.

    Segments are split by rounds; then every change is tested again between its two neighbours and moves or goes, until
    nothing changes.  Returns ``split_t, position, stat, ratio`` (variance after over before, between the neighbours).
    """
    centred = df.where("y IS NOT NULL").withColumn("__e", F.col("y") - F.avg("y").over(Window.partitionBy(*key)))
    p = _prefixes(centred, key, F.col("__e") * F.col("__e"))
    limit = cut_lineage(p.where("i = n").select(*key, F.lit(float(critical)).alias("limit")))
    points = cut_lineage(_segment(p, key, _square_stat, limit, min_size).select(*key, "b"))
    w = Window.partitionBy(*key).orderBy("b")
    length = p.where("i = n").select(*key, "n")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*").alias("c"), F.sum(F.xxhash64(*key, "b").cast("decimal(38,0)")).alias("h")).first())

    previous = {mark(points)}
    while True:
        bounds = points.join(length, key).select(*key, (F.coalesce(F.lag("b").over(w), F.lit(0)) + 1).alias("lo"),
                                                 F.coalesce(F.lead("b").over(w), F.col("n")).alias("hi"))
        again = cut_lineage(_best_inside(bounds, p, key, _square_stat, min_size).where(F.col("stat") > critical))
        moved = cut_lineage(again.select(*key, "b").distinct())
        now = mark(moved)
        if now in previous:  # settled, or states in turn
            break
        previous.add(now)
        points = moved
    # variances on both sides, between the neighbours
    s = p.select(*key, F.col("i").alias("x"), F.col("s").alias("sx"))
    at = again
    for name, place in (("s0", F.col("lo") - 1), ("sb", F.col("b")), ("s1", F.col("hi"))):
        at = at.withColumn("x", place).join(s, [*key, "x"], "left").withColumn(name, F.coalesce("sx", F.lit(0.0))).drop("sx", "x")
    before, after = (F.col("sb") - F.col("s0")) / (F.col("b") - F.col("lo") + 1), (F.col("s1") - F.col("sb")) / (F.col("hi") - F.col("b"))
    return at.select(*key, "split_t", F.col("b").alias("position"), "stat", safe_div(after, before).alias("ratio"))


# ---------------------------------------------------------------------------
# Lagged stationarity tests
# ---------------------------------------------------------------------------
# Response surfaces of the Dickey-Fuller t with a constant (MacKinnon 2010, one series):
# critical value = b0 + b1 / n + b2 / n**2 + b3 / n**3
_DF_SURFACE = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}
# Critical values of the level-stationarity statistic (Kwiatkowski et al. 1992)
_KPSS = {"1%": 0.739, "5%": 0.463, "10%": 0.347}


def _adf_solve(max_lag: int, fixed: bool):
    from prudent.operators.models import sweep

    def solve(products: pd.Series, n: pd.Series) -> pd.DataFrame:
        size = max_lag + 3  # constant, level before, lagged differences, difference
        out = []
        for row, count in zip(products, n):
            a = np.zeros((size, size))
            a[np.triu_indices(size)] = row
            a = a + np.triu(a, 1).T
            scale = a.diagonal().copy()
            best = None
            usable = sweep(a, 0, scale) and sweep(a, 1, scale)
            for lag in range(max_lag + 1):
                if lag and not sweep(a, 1 + lag, scale):
                    continue
                df = count - lag - 2
                rss = a[-1, -1]
                if not usable or df < 1 or rss <= 0:
                    continue
                aic = count * np.log(rss / count) + 2 * (lag + 2)
                if (lag == max_lag) if fixed else (best is None or aic < best[0]):
                    best = (aic, lag, a[1, -1], np.sqrt(rss / df * a[1, 1]))
            out.append((None, None, None) if best is None else (best[1], best[2], best[2] / best[3]))
        return pd.DataFrame(out, columns=["lag", "gamma", "tau"]).astype({"lag": "Int64", "gamma": "float64", "tau": "float64"})
    return solve


def adf(df: DataFrame, key: list[str], max_lag: int = 4, fixed: bool = False) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant; the number of lagged differences by the information criterion.

    A series gives the products of its constant, level, ``max_lag`` lagged differences and difference as one aggregate; sweeping the
    terms one after another gives the regressions with 0, 1, ... lags on the same rows.  ``fixed`` takes ``max_lag`` lags.  Critical
    values are those of the sample size.  A constant or too short series has no statistic.
    """
    w = _by_time(key)
    d = df.where("y IS NOT NULL").withColumn("__l", F.lag("y").over(w)).withColumn("__d", F.col("y") - F.col("__l"))
    for j in range(1, max_lag + 1):
        d = d.withColumn(f"__d{j}", F.lag("__d", j).over(w))
    d = d.where(F.col(f"__d{max_lag}" if max_lag else "__d").isNotNull())
    # level and difference around their means: the constant takes them up, and products stay small
    middle = Window.partitionBy(*key)
    d = d.withColumn("__l", F.col("__l") - F.avg("__l").over(middle))
    terms = [F.lit(1.0), F.col("__l"), *[F.col(f"__d{j}") for j in range(1, max_lag + 1)], F.col("__d")]
    products = [F.sum((terms[i] * terms[j]).cast("double")) for i in range(len(terms)) for j in range(i, len(terms))]
    g = d.groupBy(*key).agg(F.count("*").alias("n"), F.array(*products).alias("p"))
    solve = F.pandas_udf(_adf_solve(max_lag, fixed), "lag long, gamma double, tau double")
    g = g.withColumn("r", solve("p", "n")).select(*key, "n", "r.lag", "r.gamma", "r.tau")
    n = F.col("n").cast("double")
    out = F.lit("not_rejected")
    for level in reversed(_DF_SURFACE):
        b = _DF_SURFACE[level]
        out = F.when(F.col("tau") < b[0] + b[1] / n + b[2] / (n * n) + b[3] / (n * n * n), level).otherwise(out)
    return g.withColumn("unit_root_rejected_at", F.when(F.col("tau").isNotNull(), out))


def kpss(df: DataFrame, key: list[str], lags: int | None = None) -> DataFrame:
    """Level-stationarity statistic with a long-run variance (Bartlett weights).

    ``lags`` is the window; by default ``4 (n / 100) ** 0.25`` of each series (64 at six million periods, the most that a row looks back).  Autocovariances of a series are sums over its rows with the
    value that many periods before, one aggregate for all lags.
    """
    m = Window.partitionBy(*key)
    d = df.where("y IS NOT NULL").withColumn("__e", F.col("y") - F.avg("y").over(m)).withColumn("__n", F.count("*").over(m))
    window = F.lit(lags) if lags is not None else F.floor(4 * F.pow(F.col("__n") / 100, 0.25)).cast("int")
    d = d.withColumn("__q", window)
    before = F.collect_list("__e").over(_by_time(key).rowsBetween(-1 * (lags if lags is not None else 64), -1))  # the newest last
    d = d.withColumn("__S", F.sum("__e").over(_by_time(key).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", before)
    weighted = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("__q"), F.size("__b")))), F.lit(0.0), lambda a, j: a + F.coalesce(
        (1 - j / (F.col("__q") + 1)) * F.try_element_at("__b", (-j).cast("int")), F.lit(0.0)))
    long_run = F.col("__e") * F.col("__e") + 2 * F.col("__e") * F.when((F.size("__b") > 0) & (F.col("__q") > 0), weighted).otherwise(0.0)
    g = d.groupBy(*key).agg(F.count("*").alias("n"), F.first("__q").alias("lags"), F.sum(F.col("__S") * F.col("__S")).alias("ss"), F.avg(long_run).alias("s2"))
    eta = safe_div("ss", F.col("n") * F.col("n") * F.col("s2"))
    out = F.lit("not_rejected")
    for level in reversed(_KPSS):
        out = F.when(eta > _KPSS[level], level).otherwise(out)
    return g.select(*key, "n", F.col("lags").cast("long").alias("lags"), eta.alias("eta"), F.when(eta.isNotNull(), out).alias("stationarity_rejected_at"))


# ---------------------------------------------------------------------------
# Difference in differences
# ---------------------------------------------------------------------------
def did_clustered(df: DataFrame, treated: Column, post: Column, y: str, cluster: str) -> DataFrame:
    """Difference in differences with a cluster-robust (sandwich) variance.

    The four cell means are one aggregate; the score of a cluster is the sum of its residuals in each cell over the cell's size, with the cell's sign,
    from per-cluster sums and counts.  The variance is the sum of squared scores with the usual small-sample
    factor, the interval from t with (clusters - 1) degrees of freedom.  Rows with a null are left out.
    """
    cells = {"t1": (treated & post, 1), "t0": (treated & ~post, -1), "c1": (~treated & post, -1), "c0": (~treated & ~post, 1)}
    rows = df.where(F.col(y).isNotNull() & F.col(cluster).isNotNull() & treated.isNotNull() & post.isNotNull())
    sums = []
    for name, (inside, _) in cells.items():
        sums += [F.coalesce(F.sum(F.when(inside, F.col(y))), F.lit(0.0)).cast("double").alias(f"s_{name}"), F.count_if(inside).alias(f"n_{name}")]
    c = cut_lineage(rows.groupBy(cluster).agg(*sums))
    total = c.agg(*[F.sum(f"{p}_{name}").alias(f"all_{p}_{name}") for name in cells for p in "sn"], F.count("*").alias("G"))
    joined = c.withColumn("__t", total.select(F.struct(*total.columns)).scalar()).select("*", "__t.*")
    score = sum((sign * (F.col(f"s_{name}") - F.col(f"n_{name}") * F.col(f"all_s_{name}") / F.col(f"all_n_{name}")) / F.col(f"all_n_{name}")
                 for name, (_, sign) in cells.items()), F.lit(0.0))
    meat = joined.agg(F.sum(score * score).alias("meat"), *[F.first(f"all_{p}_{name}").alias(f"all_{p}_{name}") for name in cells for p in "sn"], F.first("G").alias("G"))
    n = " + ".join(f"all_n_{name}" for name in cells)
    est = " + ".join(f"({sign}) * all_s_{name} / {nz(f'all_n_{name}')}" for name, (_, sign) in cells.items())
    se = f"sqrt(meat * G / {nz('(G - 1)')} * (({n}) - 1) / {nz(f'(({n}) - 4)')})"
    crit = D.t_ppf(0.975, "(G - 1)")
    return finalize(meat, {"did": est, "se": se, "n_clusters": "G", "t": f"({est}) / {nz(se)}", "p_value": f"CASE WHEN G > 1 THEN {D.t_sf2(f'(({est}) / {nz(se)})', '(G - 1)')} END",
                           "ci_low": f"({est}) - {crit} * {se}", "ci_high": f"({est}) + {crit} * {se}"})
