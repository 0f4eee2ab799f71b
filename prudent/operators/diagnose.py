"""Diagnostics, business metrics and benchmarking (inventory family D).

Everything is aggregate-first: rates are ratios of sums, two-period
comparisons are conditional aggregates in one pass, and benchmarks exclude
the focal entity by arithmetic on group totals or by order statistics, never
by pairing entities.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prudent.functions.scalar import safe_div


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def two_period_rates(df: DataFrame, num, den, period: str, p0, p1, stratum: str | None = None) -> DataFrame:
    keys = [stratum] if stratum else []
    in0, in1 = F.col(period) == F.lit(p0), F.col(period) == F.lit(p1)
    return df.groupBy(*keys).agg(
        F.sum(F.when(in0, _c(num))).alias("num0"), F.sum(F.when(in0, _c(den))).alias("den0"),
        F.sum(F.when(in1, _c(num))).alias("num1"), F.sum(F.when(in1, _c(den))).alias("den1"))


def simpson(df: DataFrame, num, den, period: str, p0, p1, stratum: str, tol: float = 1e-3) -> DataFrame:
    """Aggregate change vs within-stratum changes ->
    reversal / vanishing / strengthening / heterogeneous / consistent."""
    s = two_period_rates(df, num, den, period, p0, p1, stratum) \
        .withColumn("delta", safe_div("num1", "den1") - safe_div("num0", "den0"))
    a = two_period_rates(df, num, den, period, p0, p1) \
        .select((safe_div("num1", "den1") - safe_div("num0", "den0")).alias("agg_delta"))
    agg = a.scalar()
    c = s.agg(F.count_if(F.col("delta") > tol).alias("n_up"), F.count_if(F.col("delta") < -tol).alias("n_down"),
              F.count_if(F.abs("delta") <= tol).alias("n_flat"), F.min(F.abs("delta")).alias("min_abs"),
              F.count("*").alias("n_strata"))
    up, down, flat = F.col("n_up"), F.col("n_down"), F.col("n_flat")
    cls = (F.when((up > 0) & (down > 0), "heterogeneous")
           .when((agg > tol) & (down > 0) & (up == 0), "reversal")
           .when((agg < -tol) & (up > 0) & (down == 0), "reversal")
           .when((F.abs(agg) > tol) & (up == 0) & (down == 0), "vanishing")
           .when((F.abs(agg) > tol) & (F.col("min_abs") > F.abs(agg)), "strengthening")
           .otherwise("consistent"))
    return c.select(F.round(agg, 6).alias("agg_delta"), "n_up", "n_down", "n_flat", "n_strata", cls.alias("pattern"))


def mix_shift(df: DataFrame, num, den, period: str, p0, p1, stratum: str) -> DataFrame:
    """Total change of a ratio = rate effect sum(w0 * (r1 - r0)) + mix
    effect sum((w1 - w0) * r1); the two add up exactly (w = denominator share)."""
    s = two_period_rates(df, num, den, period, p0, p1, stratum)
    # shares of the (small) stratum table: totals by scalar subquery, not a window
    t0 = s.select(F.sum("den0")).scalar()
    t1 = s.select(F.sum("den1")).scalar()
    s = s.select(stratum, (F.col("den0") / t0).alias("w0"), (F.col("den1") / t1).alias("w1"),
                 safe_div("num0", "den0").alias("r0"), safe_div("num1", "den1").alias("r1"))
    s = s.withColumn("rate_effect", F.col("w0") * (F.col("r1") - F.col("r0"))) \
        .withColumn("mix_effect", (F.col("w1") - F.col("w0")) * F.col("r1"))
    return s


def confounding(raw: Column, adjusted: Column, vanish: float = 0.05) -> tuple[Column, Column]:
    """Attenuation % and verdict (>= 50% -> weaker language; sign flip
    or |adjusted| below ``vanish`` -> reject)."""
    att = safe_div((raw - adjusted) * 100.0, raw)
    verdict = (F.when((F.signum(raw) != F.signum(adjusted)) | (F.abs(adjusted) < vanish), "reject")
               .when(att >= 50, "weaker_language").otherwise("robust"))
    return att, verdict


def business_days(a, b) -> Column:
    """Weekdays in [a, b) by closed form on days since a Monday
    (1970-01-05); negative when b < a."""
    def f(x):
        d = F.datediff(F.to_date(_c(x)), F.lit("1970-01-05").cast("date"))
        return F.floor(d / 7) * 5 + F.least(F.pmod(d, F.lit(7)), F.lit(5))
    return f(b) - f(a)


def peer_quantile(df: DataFrame, group: list[str], entity: str, value: str, q: float,
                  out: str) -> DataFrame:
    """Leave-one-out quantile (linear interpolation) of the *other*
    entities in the group, from order statistics around the target rank."""
    w = Window.partitionBy(*group).orderBy(F.col(value), F.col(entity))
    wg = Window.partitionBy(*group)
    d = df.withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count("*").over(wg))
    m = F.col("__n") - 1
    h = F.lit(q) * (m - 1) + 1                               # 1-based position among peers
    lo = F.floor(h)
    base = F.floor(F.lit(q) * (F.col("__n") - 2) + 1)       # same for every row of the group
    d = d.withColumn("__base", base)
    for k in range(3):
        d = d.withColumn(f"__v{k}", F.max(F.when(F.col("__r") == F.col("__base") + k, F.col(value))).over(wg))

    def peer_at(pos):
        orig = F.when(pos < F.col("__r"), pos).otherwise(pos + 1)
        off = orig - F.col("__base")
        return F.when(off == 0, F.col("__v0")).when(off == 1, F.col("__v1")).when(off == 2, F.col("__v2"))

    frac = h - lo
    val = peer_at(lo) + F.when(frac > 0, frac * (peer_at(lo + 1) - peer_at(lo))).otherwise(F.lit(0.0))
    return d.withColumn(out, F.when(m <= 0, None).otherwise(val)) \
        .drop("__r", "__n", "__base", "__v0", "__v1", "__v2")


def shapley_subsets(spark, k: int) -> DataFrame:
    """The 2^k subsets of k factors with Shapley weights, as a literal
    table (k <= 6, so at most 64 rows x k marginal rows)."""
    rows = []
    for i in range(k):
        others = [j for j in range(k) if j != i]
        for size in range(k):
            for s in combinations(others, size):
                wgt = factorial(size) * factorial(k - size - 1) / factorial(k)
                rows.append((i, [1 if j in s else 0 for j in range(k)], wgt))
    return spark.createDataFrame(rows, "factor int, mask array<int>, weight double")


def shapley_gap(df: DataFrame, entity: str, factors: list[str], bench: dict[str, Column]) -> DataFrame:
    """Shapley split of a multiplicative gap value(E) - value(B) where
    value = product of factors; each factor's share is its weighted average
    marginal contribution over subsets of the other factors."""
    k = len(factors)
    subs = F.broadcast(shapley_subsets(df.sparkSession, k))
    d = df.select(entity, *[F.col(f).alias(f"e{i}") for i, f in enumerate(factors)],
                  *[bench[f].alias(f"b{i}") for i, f in enumerate(factors)])
    # every entity row meets the (at most 6 * 32 row) literal subset table
    j = d.withColumn("__s", F.lit(1)).join(subs.withColumn("__s", F.lit(1)), "__s")

    def val(with_i):
        terms = []
        for i in range(k):
            use_e = (F.col("mask")[i] == 1) | (F.lit(with_i) & (F.col("factor") == i))
            terms.append(F.when(use_e, F.col(f"e{i}")).otherwise(F.col(f"b{i}")))
        out = terms[0]
        for t in terms[1:]:
            out = out * t
        return out

    j = j.withColumn("contrib", F.col("weight") * (val(True) - val(False)))
    return j.groupBy(entity, "factor").agg(F.sum("contrib").alias("contribution"))
