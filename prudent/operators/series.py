"""Time-series operators (inventory family G).

Series are long DataFrames (key..., t, y) with an integer period index t.
Window operators are partitioned by the series key, so each series is one
window partition and series run in parallel; a series is bounded by its
number of periods (weeks, days), not by the raw row count, because facts are
aggregated to the series grain first (G01).  Per-series algorithms with
sequential state (STL, PELT, BOCPD, exponential smoothing) run in
``applyInPandas`` on those bounded series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prudent.functions.scalar import safe_div


def _w(key, order="t"):
    return Window.partitionBy(*key).orderBy(order)


def regularize(df: DataFrame, key: list[str], ts: str, value: str, grain: str = "week",
               fill: float | None = 0.0, agg: str = "sum") -> DataFrame:
    """Bucket to the grain, aggregate, and fill every missing period
    between each series' first and last period (``fill=None`` keeps NULL).
    The calendar is generated per series with ``sequence`` (no cross join)."""
    step = 7 if grain == "week" else 1
    p = F.to_date(F.date_trunc("WEEK" if grain == "week" else "DAY", F.col(ts)))
    a = df.groupBy(*key, p.alias("period")).agg(getattr(F, agg)(value).alias("y"))
    span = a.groupBy(*key).agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    cal = span.select(*key, F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step} DAYS"))).alias("period"))
    out = cal.join(a, key + ["period"], "left")
    if fill is not None:
        out = out.fillna({"y": fill})
    return out.withColumn("t", (F.unix_date("period") / step).cast("bigint"))


def classical_decompose(df: DataFrame, key: list[str], period: int, mode: str = "additive") -> DataFrame:
    """G02 (window form): centred moving-average trend (2 x m-MA for an even
    period), seasonal index = mean detrended value per season position,
    centred to zero (or to one, multiplicative), residual = rest.  Series
    shorter than two full cycles are refused (no rows)."""
    w = _w(key)
    n = F.count("*").over(Window.partitionBy(*key))
    d = df.withColumn("__n", n).where(F.col("__n") >= 2 * period).drop("__n")
    h = period // 2
    if period % 2 == 0:
        full = F.sum("y").over(w.rowsBetween(-h, h))
        ends = F.first("y").over(w.rowsBetween(-h, -h)) + F.first("y").over(w.rowsBetween(h, h))
        cnt = F.count("y").over(w.rowsBetween(-h, h))
        trend = F.when(cnt == 2 * h + 1, (full - ends / 2.0) / period)
    else:
        cnt = F.count("y").over(w.rowsBetween(-h, h))
        trend = F.when(cnt == 2 * h + 1, F.avg("y").over(w.rowsBetween(-h, h)))
    d = d.withColumn("trend", trend).withColumn("season", F.pmod(F.col("t"), F.lit(period)))
    det = (F.col("y") - F.col("trend")) if mode == "additive" else safe_div("y", "trend")
    d = d.withColumn("__det", det)
    si = F.avg("__det").over(Window.partitionBy(*key, "season"))
    d = d.withColumn("__si", si)
    # centre the seasonal indices: mean over the distinct season positions
    d = d.withColumn("__first", F.row_number().over(Window.partitionBy(*key, "season").orderBy("t")) == 1)
    d = d.withColumn("__pm", F.avg(F.when(F.col("__first"), F.col("__si"))).over(Window.partitionBy(*key)))
    seas = (F.col("__si") - F.col("__pm")) if mode == "additive" else safe_div("__si", "__pm")
    d = d.withColumn("seasonal", seas)
    resid = (F.col("y") - F.col("trend") - F.col("seasonal")) if mode == "additive" else \
        safe_div("y", F.col("trend") * F.col("seasonal"))
    return d.withColumn("resid", resid).drop("__det", "__si", "__first", "__pm")


def strengths(dec: DataFrame, key: list[str]) -> DataFrame:
    """Trend strength max(0, 1 - var(R)/var(T+R)), seasonal strength
    max(0, 1 - var(R)/var(S+R)), residual mean / variance / lag-1
    autocorrelation and count of |z| > 3."""
    d = dec.where(F.col("resid").isNotNull())
    d = d.withColumn("__lag", F.lag("resid").over(_w(key)))
    g = d.groupBy(*key).agg(
        F.var_samp("resid").alias("vr"), F.var_samp(F.col("trend") + F.col("resid")).alias("vtr"),
        F.var_samp(F.col("seasonal") + F.col("resid")).alias("vsr"), F.avg("resid").alias("resid_mean"),
        F.corr("resid", "__lag").alias("resid_acf1"), F.stddev_samp("resid").alias("__sd"),
        F.count("*").alias("n"))
    z = d.join(g.select(*key, "resid_mean", "__sd"), key) \
        .groupBy(*key).agg(F.count_if(F.abs(safe_div(F.col("resid") - F.col("resid_mean"), F.col("__sd"))) > 3)
                           .alias("n_resid_outliers"))
    g = g.join(z, key)
    return g.select(*key, "n", F.greatest(F.lit(0.0), 1 - safe_div("vr", "vtr")).alias("trend_strength"),
                    F.greatest(F.lit(0.0), 1 - safe_div("vr", "vsr")).alias("seasonal_strength"),
                    "resid_mean", F.col("vr").alias("resid_var"), "resid_acf1", "n_resid_outliers")


def detect_period(acf_df: DataFrame, key: list[str], min_lag: int = 2) -> DataFrame:
    """The lag with the highest autocorrelation at or above ``min_lag``."""
    a = acf_df.where(F.col("lag") >= min_lag)
    return a.groupBy(*key).agg(F.max_by("lag", F.struct("acf", -F.col("lag"))).alias("period"),
                               F.max("acf").alias("acf_at_period"))


def cusum(df: DataFrame, key: list[str], k: float = 0.5, h: float = 5.0) -> DataFrame:
    """Two-sided tabular CUSUM on the standardised series, as an ordered
    fold over each (bounded) series: first alarm index, alarm count, peaks."""
    st = df.groupBy(*key).agg(F.avg("y").alias("__m"), F.stddev_samp("y").alias("__s"))
    d = df.join(st, key).withColumn("x", safe_div(F.col("y") - F.col("__m"), F.col("__s")))
    g = d.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("__a"))
    init = ("named_struct('sp', 0D, 'sn', 0D, 'i', 0, 'first', CAST(NULL AS BIGINT), 'alarms', 0, "
            "'maxp', 0D, 'maxn', 0D)")
    step = (f"named_struct('sp', greatest(0D, s.sp + coalesce(e.x, 0D) - {k}D), "
            f"'sn', greatest(0D, s.sn - coalesce(e.x, 0D) - {k}D), 'i', s.i + 1, "
            f"'first', CASE WHEN s.first IS NULL AND (greatest(0D, s.sp + coalesce(e.x, 0D) - {k}D) > {h}D "
            f"OR greatest(0D, s.sn - coalesce(e.x, 0D) - {k}D) > {h}D) THEN e.t ELSE s.first END, "
            f"'alarms', s.alarms + CASE WHEN greatest(0D, s.sp + coalesce(e.x, 0D) - {k}D) > {h}D "
            f"OR greatest(0D, s.sn - coalesce(e.x, 0D) - {k}D) > {h}D THEN 1 ELSE 0 END, "
            f"'maxp', greatest(s.maxp, greatest(0D, s.sp + coalesce(e.x, 0D) - {k}D)), "
            f"'maxn', greatest(s.maxn, greatest(0D, s.sn - coalesce(e.x, 0D) - {k}D)))")
    r = g.select(*key, F.expr(f"aggregate(__a, {init}, (s, e) -> {step})").alias("r"))
    return r.select(*key, F.col("r.i").alias("n"), F.col("r.first").alias("first_alarm_t"),
                    F.col("r.alarms").alias("n_alarms"), F.round("r.maxp", 6).alias("max_pos"),
                    F.round("r.maxn", 6).alias("max_neg"))


def best_split(df: DataFrame, key: list[str], min_size: int = 4) -> DataFrame:
    """G07 (one level): the split minimising SSE(left) + SSE(right), from
    prefix sums of y and y^2 (windows over each series)."""
    w = _w(key).rowsBetween(Window.unboundedPreceding, 0)
    wa = Window.partitionBy(*key)
    d = (df.withColumn("__i", F.row_number().over(_w(key))).withColumn("__n", F.count("*").over(wa))
         .withColumn("__p1", F.sum("y").over(w)).withColumn("__p2", F.sum(F.col("y") * F.col("y")).over(w))
         .withColumn("__a1", F.sum("y").over(wa)).withColumn("__a2", F.sum(F.col("y") * F.col("y")).over(wa)))
    nl, nr = F.col("__i"), F.col("__n") - F.col("__i")
    sse_l = F.col("__p2") - F.col("__p1") * F.col("__p1") / nl
    sr1, sr2 = F.col("__a1") - F.col("__p1"), F.col("__a2") - F.col("__p2")
    sse_r = sr2 - sr1 * sr1 / nr
    total = F.col("__a2") - F.col("__a1") * F.col("__a1") / F.col("__n")
    d = d.where((nl >= min_size) & (nr >= min_size)).withColumn("cost", sse_l + sse_r).withColumn("__tot", total) \
        .withColumn("shift", sr1 / nr - F.col("__p1") / nl)
    return d.groupBy(*key).agg(F.min_by("t", F.struct("cost", "t")).alias("split_t"),
                               F.min("cost").alias("cost"), F.first("__tot").alias("sse_total"),
                               F.min_by("shift", F.struct("cost", "t")).alias("mean_shift"))


def two_segment(df: DataFrame, key: list[str], min_size: int = 6) -> DataFrame:
    """Best two-segment linear regression (slope and level may change
    at the split) against one line, by BIC, from prefix regression sums."""
    w = _w(key).rowsBetween(Window.unboundedPreceding, 0)
    wa = Window.partitionBy(*key)
    cols = {"n": F.lit(1.0), "x": F.col("t").cast("double"), "y": F.col("y"),
            "xx": F.col("t") * F.col("t"), "xy": F.col("t") * F.col("y"), "yy": F.col("y") * F.col("y")}
    d = df
    for c, e in cols.items():
        d = d.withColumn(f"__l{c}", F.sum(e).over(w)).withColumn(f"__a{c}", F.sum(e).over(wa))

    def rss(p):
        n, x, y, xx, xy, yy = [F.col(f"{p}{c}") for c in ("n", "x", "y", "xx", "xy", "yy")]
        sxx, sxy, syy = xx - x * x / n, xy - x * y / n, yy - y * y / n
        return syy - F.when(sxx > 0, sxy * sxy / sxx).otherwise(0.0)

    for c in cols:
        d = d.withColumn(f"__r{c}", F.col(f"__a{c}") - F.col(f"__l{c}"))
    d = d.where((F.col("__ln") >= min_size) & (F.col("__rn") >= min_size))
    d = d.withColumn("rss2", rss("__l") + rss("__r")).withColumn("rss1", rss("__a"))
    n = F.col("__an")
    bic1 = n * F.log(F.greatest(F.col("rss1") / n, F.lit(1e-300))) + 2 * F.log(n)
    bic2 = n * F.log(F.greatest(F.col("rss2") / n, F.lit(1e-300))) + 5 * F.log(n)
    d = d.withColumn("bic1", bic1).withColumn("bic2", bic2)
    return d.groupBy(*key).agg(F.min_by("t", F.struct("rss2", "t")).alias("split_t"),
                               F.min("bic2").alias("bic_two"), F.first("bic1").alias("bic_one")) \
        .withColumn("prefer_split", F.col("bic_two") < F.col("bic_one"))


def adf0(df: DataFrame, key: list[str]) -> DataFrame:
    """Dickey-Fuller test with a constant and no lagged differences:
    regress dy_t on y_{t-1}; tau = slope / SE against the tabulated
    critical values (-3.43 / -2.86 / -2.57 at 1 / 5 / 10 %)."""
    d = df.withColumn("__y1", F.lag("y").over(_w(key))).withColumn("__dy", F.col("y") - F.col("__y1")) \
        .where(F.col("__y1").isNotNull())
    g = d.groupBy(*key).agg(F.regr_count("__dy", "__y1").alias("n"), F.regr_sxx("__dy", "__y1").alias("sxx"),
                            F.regr_syy("__dy", "__y1").alias("syy"), F.regr_sxy("__dy", "__y1").alias("sxy"))
    b = safe_div("sxy", "sxx")
    se = F.sqrt(safe_div(F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)),
                         (F.col("n") - 2) * F.col("sxx")))
    tau = safe_div(b, se)
    return g.select(*key, "n", tau.alias("tau"),
                    F.when(tau < -3.43, "1%").when(tau < -2.86, "5%").when(tau < -2.57, "10%")
                    .otherwise("not_rejected").alias("unit_root_rejected_at"))


def kpss0(df: DataFrame, key: list[str]) -> DataFrame:
    """KPSS level-stationarity statistic with the lag-0 variance:
    eta = sum(S_t^2) / (n^2 * s^2) of partial sums of deviations from the
    mean; critical values 0.347 / 0.463 / 0.739 at 10 / 5 / 1 %."""
    m = Window.partitionBy(*key)
    d = df.withColumn("__e", F.col("y") - F.avg("y").over(m))
    d = d.withColumn("__S", F.sum("__e").over(_w(key).rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("__S") * F.col("__S")).alias("ss"),
                            F.avg(F.col("__e") * F.col("__e")).alias("s2"))
    eta = safe_div("ss", F.col("n") * F.col("n") * F.col("s2"))
    return g.select(*key, "n", eta.alias("eta"),
                    F.when(eta > 0.739, "1%").when(eta > 0.463, "5%").when(eta > 0.347, "10%")
                    .otherwise("not_rejected").alias("stationarity_rejected_at"))


# ---------------------------------------------------------------------------
# per-series algorithms in applyInPandas (series are bounded by periods)
# ---------------------------------------------------------------------------
def _loess(x: np.ndarray, y: np.ndarray, xq: np.ndarray, span: int, w: np.ndarray | None = None) -> np.ndarray:
    """Local linear regression with tricube weights over the ``span``
    nearest points (robustness weights ``w`` optional), vectorised over all
    query points at once (an n x m weight matrix; series are bounded)."""
    n = len(x)
    span = max(2, min(span, n))
    rw = np.ones(n) if w is None else w
    dist = np.abs(x[:, None] - xq[None, :])
    h = np.partition(dist, span - 1, axis=0)[span - 1]
    h = np.maximum(h, 1e-12) * (1.0 if span < n else (1 + (span - n) / (2 * n)))
    u = np.clip(dist / h, 0, 1)
    ww = (1 - u ** 3) ** 3 * rw[:, None]
    sw = ww.sum(axis=0)
    safe = np.where(sw > 0, sw, 1.0)
    xm = (ww * x[:, None]).sum(axis=0) / safe
    ym = (ww * y[:, None]).sum(axis=0) / safe
    dx = x[:, None] - xm
    sxx = (ww * dx * dx).sum(axis=0)
    sxy = (ww * dx * (y[:, None] - ym)).sum(axis=0)
    b = np.where(sxx > 1e-12, sxy / np.where(sxx > 1e-12, sxx, 1.0), 0.0)
    return np.where(sw > 0, ym + b * (xq - xm), np.nan)


def stl_numpy(y: np.ndarray, period: int, robust: bool = True, inner: int = 2, outer: int = 1):
    """Seasonal-trend decomposition by LOESS (Cleveland et al. 1990):
    cycle-subseries smoothing, low-pass filter of the seasonal, trend
    smoothing of the deseasonalised series; optional robustness passes."""
    n = len(y)
    t = np.arange(n, dtype=float)
    ns = 7
    nt = int(np.ceil(1.5 * period / (1 - 1.5 / ns)))
    nt += (nt % 2 == 0)
    nl = period + (period % 2 == 0)
    trend = np.zeros(n)
    rw = np.ones(n)
    seasonal = np.zeros(n)
    for _ in range(outer + (1 if robust else 0)):
        for _ in range(inner):
            detr = y - trend
            cyc = np.full(n + 2 * period, np.nan)
            for s in range(period):
                idx = np.arange(s, n, period)
                xs = idx.astype(float)
                ext = np.concatenate([[idx[0] - period], idx, [idx[-1] + period]]).astype(float)
                sm = _loess(xs, detr[idx], ext, ns, rw[idx])
                pos = (ext + period).astype(int)
                cyc[pos] = sm
            c = pd.Series(cyc).interpolate(limit_direction="both").to_numpy()
            lp = pd.Series(c).rolling(period, center=False).mean()
            lp = lp.rolling(period, center=False).mean().rolling(3, center=False).mean().to_numpy()
            lp = lp[2 * period: 2 * period + n] if len(lp) >= 2 * period + n else np.resize(lp[~np.isnan(lp)], n)
            lp = _loess(t, np.nan_to_num(lp), t, nl)
            seasonal = c[period: period + n] - lp
            trend = _loess(t, y - seasonal, t, nt, rw)
        if robust:
            r = np.abs(y - seasonal - trend)
            h = 6 * max(np.median(r), 1e-12)
            u = np.clip(r / h, 0, 1)
            rw = (1 - u ** 2) ** 2
    return trend, seasonal, y - trend - seasonal


def stl(df: DataFrame, key: list[str], period: int, mode: str = "additive") -> DataFrame:
    """G02 (STL): per series in ``applyInPandas``; series with fewer than two
    full cycles are refused (no rows); ``mode='log'`` decomposes log(y)."""
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in key]) + \
        ", t bigint, y double, trend double, seasonal double, resid double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = pdf["y"].astype(float).to_numpy()
        if len(y) < 2 * period:
            return pd.DataFrame(columns=key + ["t", "y", "trend", "seasonal", "resid"])
        yy = np.log(np.maximum(y, 1e-12)) if mode == "log" else y
        tr, se, re = stl_numpy(yy, period)
        out = pdf[key + ["t"]].copy()
        out["y"], out["trend"], out["seasonal"], out["resid"] = y, tr, se, re
        return out

    return df.select(*key, "t", F.col("y").cast("double").alias("y")).groupBy(*key).applyInPandas(run, schema)


def pelt_numpy(y: np.ndarray, penalty: float | None = None, min_size: int = 2) -> list[int]:
    """PELT (Killick et al. 2012) with an L2 (mean-change) cost; BIC-type
    penalty 2 * sigma^2 * log(n) by default (sigma^2 from differences)."""
    n = len(y)
    if n < 2 * min_size:
        return []
    if penalty is None:
        sig2 = np.median(np.abs(np.diff(y))) ** 2 / (2 * 0.6745 ** 2) if n > 2 else np.var(y)
        sig2 = sig2 if sig2 > 0 else max(np.var(y), 1e-12)
        penalty = 2 * sig2 * np.log(n)
    s1 = np.concatenate([[0.0], np.cumsum(y)])
    s2 = np.concatenate([[0.0], np.cumsum(y * y)])

    def cost(a, b):
        m = b - a
        return s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / m

    f = np.full(n + 1, np.inf)
    f[0] = -penalty
    last = np.zeros(n + 1, dtype=int)
    cands = [0]
    for t in range(min_size, n + 1):
        vals = [(f[s] + cost(s, t) + penalty, s) for s in cands if t - s >= min_size]
        if not vals:
            cands.append(t - min_size + 1) if t - min_size + 1 > 0 else None
            continue
        best, arg = min(vals)
        f[t], last[t] = best, arg
        cands = [s for s in cands if t - s < min_size or f[s] + cost(s, t) <= f[t]] + [t - min_size + 1]
    cps, t = [], n
    while t > 0:
        s = last[t]
        if s > 0:
            cps.append(s)
        t = s
    return sorted(cps)


def pelt(df: DataFrame, key: list[str], penalty: float | None = None, min_size: int = 2) -> DataFrame:
    """Change points per series (index of the first period of each new
    segment), with the mean shift across each change."""
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in key]) + \
        ", cp_t bigint, shift double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = pdf["y"].astype(float).to_numpy()
        cps = pelt_numpy(y, penalty, min_size)
        bounds = [0] + cps + [len(y)]
        rows = []
        for i, c in enumerate(cps):
            before = y[bounds[i]:c].mean()
            after = y[c:bounds[i + 2]].mean()
            rows.append({**{k: pdf[k].iloc[0] for k in key}, "cp_t": int(pdf["t"].iloc[c]), "shift": after - before})
        return pd.DataFrame(rows, columns=key + ["cp_t", "shift"])

    return df.select(*key, "t", F.col("y").cast("double").alias("y")).groupBy(*key).applyInPandas(run, schema)


def bocpd_numpy(y: np.ndarray, hazard: float = 1 / 100, mu0: float | None = None, kappa0: float = 1.0,
                alpha0: float = 1.0, beta0: float | None = None):
    """Bayesian online change-point detection (Adams & MacKay 2007) with a
    normal-inverse-gamma prior; returns P(run length = 0 | data) growth-based
    change probability and the MAP run length per step (no truncation: the
    series is bounded by its periods)."""
    n = len(y)
    mu0 = float(np.mean(y[: min(n, 10)])) if mu0 is None else mu0
    beta0 = float(np.var(y)) if beta0 is None else beta0
    beta0 = beta0 if beta0 > 0 else 1.0
    R = np.array([1.0])
    mu, kappa, alpha, beta = np.array([mu0]), np.array([kappa0]), np.array([alpha0]), np.array([beta0])
    cp_prob, map_rl = np.zeros(n), np.zeros(n, dtype=int)
    from math import lgamma, pi
    for i, x in enumerate(y):
        df_ = 2 * alpha
        scale2 = beta * (kappa + 1) / (alpha * kappa)
        lg = np.array([lgamma((d + 1) / 2) - lgamma(d / 2) for d in df_])
        logp = lg - 0.5 * np.log(df_ * pi * scale2) - (df_ + 1) / 2 * np.log1p((x - mu) ** 2 / (df_ * scale2))
        pred = np.exp(logp)
        growth = R * pred * (1 - hazard)
        cp = (R * pred * hazard).sum()
        Rn = np.concatenate([[cp], growth])
        Rn /= Rn.sum()
        # the posterior that a change happened at this step: mass moved to short runs
        cp_prob[i] = Rn[: 2].sum() if i > 0 else 0.0
        map_rl[i] = int(np.argmax(Rn))
        mu_n = (kappa * mu + x) / (kappa + 1)
        kappa_n, alpha_n = kappa + 1, alpha + 0.5
        beta_n = beta + kappa * (x - mu) ** 2 / (2 * (kappa + 1))
        mu = np.concatenate([[mu0], mu_n])
        kappa = np.concatenate([[kappa0], kappa_n])
        alpha = np.concatenate([[alpha0], alpha_n])
        beta = np.concatenate([[beta0], beta_n])
        R = Rn
    return cp_prob, map_rl


def bocpd(df: DataFrame, key: list[str], hazard: float = 1 / 100) -> DataFrame:
    """Per-step change probability and MAP run length per series."""
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in key]) + \
        ", t bigint, cp_prob double, map_run_length int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        p, r = bocpd_numpy(pdf["y"].astype(float).to_numpy(), hazard)
        out = pdf[key + ["t"]].copy()
        out["cp_prob"], out["map_run_length"] = p, r.astype("int32")
        return out

    return df.select(*key, "t", F.col("y").cast("double").alias("y")).groupBy(*key).applyInPandas(run, schema)


def holt_winters_numpy(y: np.ndarray, period: int, alpha=0.3, beta=0.05, gamma=0.2):
    """Additive Holt-Winters smoothing; returns one-step-ahead fitted values
    and the final (level, trend, seasonal) state."""
    n = len(y)
    level = y[:period].mean()
    trend = (y[period:2 * period].mean() - y[:period].mean()) / period if n >= 2 * period else 0.0
    season = list(y[:period] - level)
    fitted = np.empty(n)
    for i in range(n):
        s = season[i % period]
        fitted[i] = level + trend + s
        new_level = alpha * (y[i] - s) + (1 - alpha) * (level + trend)
        trend = beta * (new_level - level) + (1 - beta) * trend
        season[i % period] = gamma * (y[i] - new_level) + (1 - gamma) * s
        level = new_level
    return fitted, level, trend, season


def forecast_gap(df: DataFrame, key: list[str], cut_t: int, period: int, z: float = 1.959963984540054) -> DataFrame:
    """Fit on t < cut, forecast t >= cut with a prediction interval from
    the in-sample one-step residual spread; flag actuals outside it.  Needs
    at least one full cycle before the cut (else no rows)."""
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in key]) + \
        ", t bigint, y double, forecast double, pi_low double, pi_high double, outside boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        pre = pdf[pdf["t"] < cut_t]
        post = pdf[pdf["t"] >= cut_t]
        if len(pre) < 2 * period or post.empty:
            return pd.DataFrame(columns=key + ["t", "y", "forecast", "pi_low", "pi_high", "outside"])
        y = pre["y"].astype(float).to_numpy()
        fitted, level, trend, season = holt_winters_numpy(y, period)
        sd = float(np.std(y[period:] - fitted[period:], ddof=1))
        h = np.arange(1, len(post) + 1)
        idx = (len(y) + h - 1) % period
        fc = level + h * trend + np.array(season)[idx]
        half = z * sd * np.sqrt(h)
        out = post[key + ["t"]].copy()
        out["y"] = post["y"].astype(float).to_numpy()
        out["forecast"], out["pi_low"], out["pi_high"] = fc, fc - half, fc + half
        out["outside"] = (out["y"] < out["pi_low"]) | (out["y"] > out["pi_high"])
        return out

    return df.select(*key, "t", F.col("y").cast("double").alias("y")).groupBy(*key).applyInPandas(run, schema)


def pre_post(df: DataFrame, key: list[str], event_t: int, w: int) -> DataFrame:
    """Symmetric windows of ``w`` periods before / after the event:
    means, Welch-style gap with 95% normal CI."""
    pre = (F.col("t") >= event_t - w) & (F.col("t") < event_t)
    post = (F.col("t") >= event_t) & (F.col("t") < event_t + w)
    g = df.groupBy(*key).agg(F.avg(F.when(pre, F.col("y"))).alias("pre_mean"),
                             F.avg(F.when(post, F.col("y"))).alias("post_mean"),
                             F.var_samp(F.when(pre, F.col("y"))).alias("v0"),
                             F.var_samp(F.when(post, F.col("y"))).alias("v1"),
                             F.count(F.when(pre, F.col("y"))).alias("n0"),
                             F.count(F.when(post, F.col("y"))).alias("n1"))
    se = F.sqrt(safe_div("v0", "n0") + safe_div("v1", "n1"))
    gap = F.col("post_mean") - F.col("pre_mean")
    return g.select(*key, "pre_mean", "post_mean", gap.alias("gap"), (gap - 1.959963984540054 * se).alias("ci_low"),
                    (gap + 1.959963984540054 * se).alias("ci_high"), safe_div(gap, se).alias("z"))


def did(df: DataFrame, treated: Column, post: Column, y: str) -> DataFrame:
    """Difference in differences of four cell means, normal CI from
    the cell variances."""
    cells = {"t1": treated & post, "t0": treated & ~post, "c1": ~treated & post, "c0": ~treated & ~post}
    aggs = []
    for k, c in cells.items():
        aggs += [F.avg(F.when(c, F.col(y))).alias(f"m_{k}"), F.var_samp(F.when(c, F.col(y))).alias(f"v_{k}"),
                 F.count(F.when(c, F.col(y))).alias(f"n_{k}")]
    s = df.agg(*aggs)
    est = (F.col("m_t1") - F.col("m_t0")) - (F.col("m_c1") - F.col("m_c0"))
    se = F.sqrt(sum([safe_div(f"v_{k}", f"n_{k}") for k in cells], F.lit(0.0)))
    return s.select(est.alias("did"), se.alias("se"), (est - 1.959963984540054 * se).alias("ci_low"),
                    (est + 1.959963984540054 * se).alias("ci_high"))
