"""Statistical tests (inventory family X) as Spark jobs.

Every test has two layers:

1. *sufficient statistics* computed by Spark aggregates (counts, sums,
   moments, rank sums, contingency counts) — partial aggregation before the
   shuffle, one small row per test or per group;
2. *the formula layer*: SQL expression text over those columns (statistic,
   degrees of freedom, p-value, effect size, confidence interval), written
   once in ``formulas(dialect)`` and evaluated by Spark with ``F.expr``.  The
   same text runs in DuckDB for the oracle, so a query's oracle re-derives
   the sufficient statistics independently and shares only the arithmetic.

Ranks never use a global window: ``relational.avg_rank`` works on
value-range buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prudent.functions import dist as D
from prudent.functions.dist import SPARK
from prudent.operators.relational import avg_rank
from prudent.session import cut_lineage

Z975 = D.Z975


def nz(x: str) -> str:
    return f"nullif({x}, 0)"


NON_NUMERIC = {"tier", "expected_ok", "flag", "inconclusive", "outcome"}


def finalize(df: DataFrame, exprs: dict[str, str], keep: list[str] = (), digits: int = 6) -> DataFrame:
    """Evaluate formula texts over a sufficient-statistics frame; numeric
    outputs are doubles rounded to ``digits`` (flags and tiers are not)."""
    cols = [F.col(k) for k in keep]
    for name, e in exprs.items():
        c = F.expr(e)
        cols.append(c.alias(name) if name in NON_NUMERIC else F.round(c.cast("double"), digits).alias(name))
    return df.select(*cols)


def finalize_sql(inner: str, exprs: dict[str, str], keep: list[str] = (), digits: int = 6) -> str:
    """The same formula layer as SQL text over an inner statement."""
    cols = list(keep) + [f"{e} AS {n}" if n in NON_NUMERIC else f"round(CAST({e} AS DOUBLE), {digits}) AS {n}"
                         for n, e in exprs.items()]
    return f"SELECT {', '.join(cols)} FROM ({inner}) AS s"


# ---------------------------------------------------------------------------
# formula texts (dialect-neutral apart from the distribution functions)
# ---------------------------------------------------------------------------
def r_tier(r: str) -> str:
    return (f"CASE WHEN {r} IS NULL THEN NULL WHEN abs({r}) < 0.10 THEN 'trivial' WHEN abs({r}) < 0.30 THEN 'small' "
            f"WHEN abs({r}) < 0.50 THEN 'moderate' ELSE 'large' END")


def d_tier(d: str) -> str:
    return (f"CASE WHEN {d} IS NULL THEN NULL WHEN abs({d}) < 0.2 THEN 'trivial' WHEN abs({d}) < 0.5 THEN 'small' "
            f"WHEN abs({d}) < 0.8 THEN 'medium' ELSE 'large' END")


def eta_tier(e: str) -> str:
    return (f"CASE WHEN {e} IS NULL THEN NULL WHEN {e} < 0.01 THEN 'trivial' WHEN {e} < 0.06 THEN 'small' "
            f"WHEN {e} < 0.14 THEN 'medium' ELSE 'large' END")


def v_tier(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} < 0.1 THEN 'trivial' WHEN {v} < 0.3 THEN 'small' "
            f"WHEN {v} < 0.5 THEN 'medium' ELSE 'large' END")


def corr_exprs(d: str = SPARK, r: str = "r", n: str = "n", k_controls: int = 0) -> dict[str, str]:
    """T test of a correlation, Fisher-z 95% CI, tier."""
    df = f"({n} - 2 - {k_controls})"
    rc = f"least(greatest({r}, -0.9999999999), 0.9999999999)"
    t = f"({r} * sqrt({df} / {nz(f'(1 - {r} * {r})')}))"
    se = f"(1.0 / sqrt({nz(f'greatest({n} - 3 - {k_controls}, 0)')}))"
    return {
        "n": n, "r": r, "df": df, "t": t,
        "p_value": f"CASE WHEN {df} > 0 AND abs({r}) < 1 THEN {D.t_sf2(t, df, d)} END",
        "ci_low": f"tanh(atanh({rc}) - {Z975!r} * {se})",
        "ci_high": f"tanh(atanh({rc}) + {Z975!r} * {se})",
        "tier": r_tier(r),
    }


def welch_exprs(d: str = SPARK) -> dict[str, str]:
    """X07 over (n1, m1, v1, n2, m2, v2)."""
    se2 = "(v1 / n1 + v2 / n2)"
    dfw = f"(pow({se2}, 2) / {nz('pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)')})"
    t = f"((m1 - m2) / {nz(f'sqrt({se2})')})"
    sp = f"sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / {nz('(n1 + n2 - 2)')})"
    dd = f"((m1 - m2) / {nz(sp)})"
    tc = D.t_ppf(0.975, dfw, d)
    return {
        "n1": "n1", "n2": "n2", "mean_diff": "(m1 - m2)", "t": t, "df": dfw,
        "p_value": D.t_sf2(t, dfw, d),
        "ci_low": f"(m1 - m2) - {tc} * sqrt({se2})", "ci_high": f"(m1 - m2) + {tc} * sqrt({se2})",
        "cohens_d": dd, "hedges_g": f"{dd} * (1 - 3.0 / (4 * (n1 + n2) - 9))", "tier": d_tier(dd),
    }


def paired_exprs(d: str = SPARK) -> dict[str, str]:
    """X08 over (n, md, sd) of the differences."""
    t = f"(md / {nz('(sd / sqrt(n))')})"
    tc = D.t_ppf(0.975, "(n - 1)", d)
    return {"n": "n", "mean_diff": "md", "t": t, "df": "(n - 1)", "p_value": D.t_sf2(t, "(n - 1)", d),
            "ci_low": f"md - {tc} * sd / sqrt(n)", "ci_high": f"md + {tc} * sd / sqrt(n)",
            "d_z": f"(md / {nz('sd')})", "tier": d_tier(f"(md / {nz('sd')})")}


def mann_whitney_exprs(d: str = SPARK) -> dict[str, str]:
    """X09 over (n1, n2, r1, tie_term = sum(t^3 - t), m1, m2, sd2)."""
    N = "(n1 + n2)"
    u1 = "(r1 - n1 * (n1 + 1) / 2.0)"
    sigma = f"sqrt(n1 * n2 / 12.0 * (({N} + 1) - tie_term / {nz(f'({N} * ({N} - 1))')}))"
    z = f"(({u1} - n1 * n2 / 2.0) / {nz(sigma)})"
    return {"n1": "n1", "n2": "n2", "u": u1, "z": z, "p_value": D.norm_sf2(z, d),
            "rank_biserial": f"(2.0 * {u1} / {nz('(n1 * n2)')} - 1)",
            "glass_delta": f"((m1 - m2) / {nz('sd2')})", "tier": r_tier(f"(2.0 * {u1} / {nz('(n1 * n2)')} - 1)")}


def wilcoxon_exprs(d: str = SPARK) -> dict[str, str]:
    """X10 over (n, w_plus, tie_term) of the non-zero differences."""
    mean = "(n * (n + 1) / 4.0)"
    var = "(n * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0)"
    z = f"((w_plus - {mean}) / {nz(f'sqrt({var})')})"
    return {"n": "n", "w_plus": "w_plus", "z": z, "p_value": D.norm_sf2(z, d),
            "effect_r": f"({z} / sqrt({nz('n')}))", "tier": r_tier(f"({z} / sqrt({nz('n')}))")}


def anova_exprs(d: str = SPARK) -> dict[str, str]:
    """X11 over (k, N, ssb, ssw)."""
    msw = f"(ssw / {nz('(N - k)')})"
    f = f"((ssb / {nz('(k - 1)')}) / {nz(msw)})"
    eta = f"(ssb / {nz('(ssb + ssw)')})"
    return {"k": "k", "n": "N", "f": f, "df1": "(k - 1)", "df2": "(N - k)",
            "p_value": D.f_sf(f, "(k - 1)", "(N - k)", d), "eta_sq": eta,
            "omega_sq": f"((ssb - (k - 1) * {msw}) / {nz(f'(ssb + ssw + {msw})')})", "tier": eta_tier(eta)}


def kruskal_exprs(d: str = SPARK) -> dict[str, str]:
    """X13 over (k, N, s = sum(R_i^2 / n_i), tie_term)."""
    h = "(12.0 / (N * (N + 1)) * s - 3 * (N + 1))"
    c = f"(1 - tie_term / {nz('(pow(N, 3) - N)')})"
    hc = f"({h} / {nz(c)})"
    eta = f"(({hc} - k + 1) / {nz('(N - k)')})"
    return {"k": "k", "n": "N", "h": hc, "df": "(k - 1)", "p_value": D.chi2_sf(hc, "(k - 1)", d),
            "eta_sq": eta, "tier": eta_tier(eta)}


def chi2_exprs(d: str = SPARK) -> dict[str, str]:
    """X16/X20 over (chi2, n, r, c, min_expected, share_low_expected)."""
    v = f"sqrt(chi2 / {nz('(n * (least(r, c) - 1))')})"
    return {"chi2": "chi2", "df": "((r - 1) * (c - 1))", "n": "n",
            "p_value": D.chi2_sf("chi2", "((r - 1) * (c - 1))", d),
            "cramers_v": v, "min_expected": "min_expected", "share_low_expected": "share_low_expected",
            "expected_ok": "(share_low_expected <= 0.2 AND min_expected >= 1)", "tier": v_tier(v)}


def odds_exprs() -> dict[str, str]:
    """X22 over a 2x2 (a, b, c, d): exposed/outcome counts."""
    lor = "ln((a * d) / (b * c))"
    se = "sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)"
    lrr = "ln((a / (a + b)) / (c / (c + d)))"
    ser = "sqrt(1.0 / a - 1.0 / (a + b) + 1.0 / c - 1.0 / (c + d))"
    ok = "(a > 0 AND b > 0 AND c > 0 AND d > 0)"
    return {"odds_ratio": f"CASE WHEN {ok} THEN exp({lor}) END",
            "or_ci_low": f"CASE WHEN {ok} THEN exp({lor} - {Z975!r} * {se}) END",
            "or_ci_high": f"CASE WHEN {ok} THEN exp({lor} + {Z975!r} * {se}) END",
            "risk_ratio": f"CASE WHEN {ok} THEN exp({lrr}) END",
            "rr_ci_low": f"CASE WHEN {ok} THEN exp({lrr} - {Z975!r} * {ser}) END",
            "rr_ci_high": f"CASE WHEN {ok} THEN exp({lrr} + {Z975!r} * {ser}) END"}


def slope_exprs(d: str = SPARK) -> dict[str, str]:
    """X23 over (n, sxx, syy, sxy): OLS slope, SE, t-based 95% CI, R^2."""
    b = f"(sxy / {nz('sxx')})"
    sse = f"greatest(syy - sxy * sxy / {nz('sxx')}, 0)"
    se = f"sqrt({sse} / {nz('(n - 2)')} / {nz('sxx')})"
    t = f"({b} / {nz(se)})"
    tc = D.t_ppf(0.975, "(n - 2)", d)
    return {"n": "n", "slope": b, "slope_se": se, "t": t,
            "p_value": f"CASE WHEN n > 2 THEN {D.t_sf2(t, '(n - 2)', d)} END",
            "ci_low": f"CASE WHEN n > 2 THEN {b} - {tc} * {se} END",
            "ci_high": f"CASE WHEN n > 2 THEN {b} + {tc} * {se} END",
            "r_squared": f"(sxy * sxy / {nz('(sxx * syy)')})"}


# ---------------------------------------------------------------------------
# sufficient statistics (Spark)
# ---------------------------------------------------------------------------
def _by(by):
    return [by] if isinstance(by, str) else list(by or [])


def pearson(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    """Pearson r per group with p-value, Fisher-z CI and tier."""
    by = _by(by)
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    s = df.where(ok).groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    return finalize(s, corr_exprs(), keep=by)


def spearman(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    """Spearman rho = Pearson r of average ranks, over the distinct pairs with their counts.

    Both ranks have the mean (n + 1) / 2, so sums are taken around it.
    """
    by = _by(by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = cut_lineage(d.groupBy(*by, x, y).agg(F.count("*").alias("__c")))
    for c, out in ((x, "__rx"), (y, "__ry")):
        pairs = pairs.join(avg_rank(pairs, c, by, out=out, weight="__c").drop("ties"), by + [c])
    total = pairs.groupBy(*by).agg(F.sum("__c").alias("n"))
    middle = (F.col("n") + 1) / 2.0
    pairs = pairs.join(total, by) if by else pairs.withColumn("n", total.select("n").scalar())
    u, v = F.col("__rx") - middle, F.col("__ry") - middle
    s = pairs.groupBy(*by).agg(F.first("n").alias("n"), (F.sum(F.col("__c") * u * v) / F.sqrt(F.nullif(F.sum(F.col("__c") * u * u) * F.sum(F.col("__c") * v * v), F.lit(0.0)))).alias("r"))
    return finalize(s, corr_exprs(), keep=by)


def partial_corr(df: DataFrame, x: str, y: str, z: str, by=None) -> DataFrame:
    """First-order partial correlation r_xy.z (raw r_xy beside it)."""
    by = _by(by)
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("rxy"), F.corr(x, z).alias("rxz"),
                            F.corr(y, z).alias("ryz"))
    s = s.withColumn("r", F.expr("(rxy - rxz * ryz) / sqrt(nullif((1 - rxz * rxz) * (1 - ryz * ryz), 0))"))
    e = corr_exprs(k_controls=1)
    e["raw_r"] = "rxy"
    return finalize(s, e, keep=by)


def group_moments(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))


def welch_t(df: DataFrame, value: str, group: str, g1, g2, by=None) -> DataFrame:
    """Welch t between two levels of ``group``, CI on the difference,
    Cohen's d and Hedges' g."""
    by = _by(by)
    m = group_moments(df.where(F.col(group).isin(g1, g2)), value, group, by)
    s = m.groupBy(*by).agg(*[F.max(F.when(F.col(group) == g, F.col(c))).alias(f"{c}{i}")
                             for i, g in ((1, g1), (2, g2)) for c in ("n", "m", "v")])
    return finalize(s, welch_exprs(), keep=by)


def paired_t(df: DataFrame, a: str, b: str, by=None) -> DataFrame:
    """Paired t on a - b."""
    by = _by(by)
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("__d", F.col(a) - F.col(b))
    s = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__d").alias("md"), F.stddev_samp("__d").alias("sd"))
    return finalize(s, paired_exprs(), keep=by)


def _tie_sum() -> Column:
    """Sum of t^3 - t over the groups of equal values."""
    return F.sum(F.pow(F.col("ties"), 3) - F.col("ties")).alias("tie_term")


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Two aggregates of the same groups side by side (one row each without groups)."""
    if by:
        return left.join(right, by)
    return left.withColumn("__one", right.select(F.struct(*right.columns)).scalar()).select("*", "__one.*").drop("__one")


def mann_whitney(df: DataFrame, value: str, group: str, g1, g2, by=None) -> DataFrame:
    """Mann-Whitney U with tie-corrected normal p, rank-biserial r and
    Glass's delta (group 2 as the reference).  Rank sums come from the distinct values and their counts."""
    by = _by(by)
    d = df.where(F.col(group).isin(g1, g2) & F.col(value).isNotNull())
    first, second = F.col(group) == g1, F.col(group) == g2
    r = avg_rank(d, value, by, out="__rk", extra={"__c1": F.count_if(first), "__c2": F.count_if(second)})
    ranks = r.groupBy(*by).agg(F.sum("__c1").alias("n1"), F.sum("__c2").alias("n2"), F.sum(F.col("__c1") * F.col("__rk")).alias("r1"), _tie_sum())
    moments = d.groupBy(*by).agg(F.avg(F.when(first, F.col(value))).alias("m1"), F.avg(F.when(second, F.col(value))).alias("m2"),
                                 F.stddev_samp(F.when(second, F.col(value))).alias("sd2"))
    # a row a family: else the tail's expressions are planned anew after every stage
    return finalize(cut_lineage(_beside(ranks, moments, by)), mann_whitney_exprs(), keep=by)


def wilcoxon(df: DataFrame, a: str, b: str, by=None) -> DataFrame:
    """Wilcoxon signed-rank (zeros dropped, average ranks of |d|)."""
    by = _by(by)
    d = df.withColumn("__d", F.col(a) - F.col(b)).where(F.col("__d").isNotNull() & (F.col("__d") != 0)) \
        .withColumn("__ad", F.abs("__d"))
    r = avg_rank(d, "__ad", by, out="__rk", extra={"__up": F.count_if(F.col("__d") > 0)})
    # a double, as the variance takes the cube of n
    s = r.groupBy(*by).agg(F.sum("ties").cast("double").alias("n"), F.sum(F.col("__up") * F.col("__rk")).alias("w_plus"), _tie_sum())
    return finalize(s, wilcoxon_exprs(), keep=by)


def _group_ranks(d: DataFrame, value: str, group: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and rank sum of every level of ``group``, and the tie term, from the distinct values with their levels' counts."""
    counts = d.groupBy(*by, value, group).agg(F.count("*").alias("__c"))
    r = cut_lineage(avg_rank(counts, value, by, out="__rk", weight="__c", extra={"__g": F.collect_list(F.struct(F.col(group).alias("g"), "__c"))}))
    e = r.select(*by, "__rk", F.explode("__g").alias("__e")).select(*by, F.col("__e.g").alias(group), F.col("__e.__c").alias("__c"), "__rk")
    g = e.groupBy(*by, group).agg(F.sum("__c").alias("ni"), F.sum(F.col("__c") * F.col("__rk")).alias("ri"))
    return g, r.groupBy(*by).agg(_tie_sum())


def anova(df: DataFrame, value: str, group: str, by=None) -> DataFrame:
    """X11: one-way ANOVA from per-group n / mean / variance; eta^2, omega^2."""
    by = _by(by)
    m = group_moments(df, value, group, by)
    w = Window.partitionBy(*by)
    gm = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    m = m.withColumn("__gm", gm)
    s = m.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("N"),
                           F.sum(F.col("n") * F.pow(F.col("m") - F.col("__gm"), 2)).alias("ssb"),
                           F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0))).alias("ssw"))
    return finalize(s, anova_exprs(), keep=by)


#: groups up to which the table of a family's groups is broadcast to itself
MAX_GROUPS = 100_000


def group_pairs(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Unordered pairs of *groups* (rows of a k-row aggregate, never raw
    rows), ``g1 < g2`` within a family.  The result has a row a pair; the second side is broadcast behind a check of its size."""
    if b.count() > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups: the pairs are the result")
    b = b.select(*[F.col(c).alias(f"__{c}") if c in by else F.col(c) for c in b.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return a.join(F.broadcast(b), [*same, F.col("g1") < F.col("g2")]).drop(*[f"__{c}" for c in by])


def pairwise_welch(df: DataFrame, value: str, group: str, by=None) -> DataFrame:
    """X12 (substitute for Tukey HSD): Welch t for every pair of groups on
    the k-row group-moment table, Holm-adjusted within the family."""
    by = _by(by)
    m = group_moments(df, value, group, by)
    a = m.select(*by, F.col(group).alias("g1"), F.col("n").alias("n1"), F.col("m").alias("m1"), F.col("v").alias("v1"))
    b = m.select(*by, F.col(group).alias("g2"), F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("v").alias("v2"))
    p = group_pairs(a, b, by)
    out = finalize(p, {k: v for k, v in welch_exprs().items() if k in ("mean_diff", "t", "df", "p_value")},
                   keep=by + ["g1", "g2"])
    return adjust_p(out, by, "p_value", "holm", out="p_holm")


def kruskal(df: DataFrame, value: str, group: str, by=None, ranks: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Kruskal-Wallis H with tie correction, eta^2.  ``ranks`` are the caller's ``_group_ranks``."""
    by = _by(by)
    g, ties = ranks or _group_ranks(df.where(F.col(value).isNotNull()), value, group, by)
    # a double: 12.0 / (N * (N + 1)) of longs is a decimal of 22 places, 8 digits of it at 36 million rows
    s = g.groupBy(*by).agg(F.count("*").alias("k"), F.sum("ni").cast("double").alias("N"),
                           F.sum(F.col("ri") * F.col("ri") / F.col("ni")).alias("s"))
    return finalize(_beside(s, ties, by), kruskal_exprs(), keep=by)


def dunn(df: DataFrame, value: str, group: str, method: str = "holm", by=None, ranks: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Dunn pairwise z on mean ranks (tie-corrected), adjusted p.  ``ranks`` are the caller's ``_group_ranks``."""
    by = _by(by)
    g, ties = ranks or _group_ranks(df.where(F.col(value).isNotNull()), value, group, by)
    g = cut_lineage(g.withColumn("mr", F.col("ri") / F.col("ni")))
    both = _beside(g.groupBy(*by).agg(F.sum("ni").alias("N")), ties, by)
    g = g.join(both, by) if by else g.withColumn("__one", both.select(F.struct("N", "tie_term")).scalar()).select("*", "__one.*")
    a = g.select(*by, F.col(group).alias("g1"), F.col("ni").alias("n1"), F.col("mr").alias("mr1"), "N", "tie_term")
    b = g.select(*by, F.col(group).alias("g2"), F.col("ni").alias("n2"), F.col("mr").alias("mr2"))
    p = group_pairs(a, b, by)
    z = ("((mr1 - mr2) / sqrt(nullif((N * (N + 1) / 12.0 - tie_term / (12.0 * (N - 1))) * (1.0 / n1 + 1.0 / n2), 0)))")
    out = finalize(p, {"z": z, "p_value": D.norm_sf2(z)}, keep=by + ["g1", "g2"])
    return adjust_p(out, by, "p_value", method, out=f"p_{method}")


def friedman(df: DataFrame, subject: str, cond: str, value: str, by=None) -> DataFrame:
    """Friedman chi-square over complete blocks, corrected for ties (ranks within subject,
    a window bounded by the number of conditions)."""
    by = _by(by)
    w = Window.partitionBy(*by, subject, value)
    ws = Window.partitionBy(*by, subject).orderBy(value)
    d = df.withColumn("__lo", F.rank().over(ws)).withColumn("__t", F.count("*").over(w))
    d = d.withColumn("__rk", F.col("__lo") + (F.col("__t") - 1) / 2.0)
    # over rows, t^2 - 1 sums to t^3 - t over the groups of equal values
    rj = d.groupBy(*by, cond).agg(F.sum("__rk").alias("rj"), F.sum(F.col("__t") * F.col("__t") - 1).alias("tj"))
    n = df.groupBy(*by).agg(F.count_distinct(subject).alias("n"))
    s = rj.groupBy(*by).agg(F.count("*").alias("k"), F.sum(F.col("rj") * F.col("rj")).alias("srj"), F.sum("tj").alias("ties"))
    chi = "((12.0 / (n * k * (k + 1)) * srj - 3 * n * (k + 1)) / nullif(1 - ties / (n * k * (k * k - 1.0)), 0))"
    return finalize(_beside(s, n, by), {"n": "n", "k": "k", "chi2": chi, "df": "(k - 1)", "p_value": D.chi2_sf(chi, "(k - 1)"),
                                        "kendall_w": f"({chi} / {nz('(n * (k - 1))')})"}, keep=by)


def rm_anova(df: DataFrame, subject: str, cond: str, value: str, by=None) -> DataFrame:
    """One-way repeated-measures ANOVA (complete blocks)."""
    by = _by(by)
    gm = df.groupBy(*by).agg(F.avg(value).alias("__gm"))

    def squares(rows: DataFrame, mean: str, times: Column, *more: Column) -> DataFrame:
        rows = rows.join(F.broadcast(gm), by) if by else rows.withColumn("__gm", gm.scalar())
        return rows.groupBy(*by).agg(F.sum(times * F.pow(F.col(mean) - F.col("__gm"), 2)).alias("ss"), *more)

    subj = df.groupBy(*by, subject).agg(F.avg(value).alias("ms"), F.count("*").alias("kk"))
    cnd = df.groupBy(*by, cond).agg(F.avg(value).alias("mc"), F.count("*").alias("nn"))
    s = squares(df, value, F.lit(1)).withColumnRenamed("ss", "sst")
    s = _beside(s, squares(subj, "ms", F.col("kk"), F.count(subject).alias("n")).withColumnRenamed("ss", "sss"), by)
    s = _beside(s, squares(cnd, "mc", F.col("nn"), F.count(cond).alias("k")).withColumnRenamed("ss", "ssc"), by)
    s = cut_lineage(s)  # as in mann_whitney
    f = "((ssc / nullif(k - 1, 0)) / nullif((sst - sss - ssc) / nullif((n - 1) * (k - 1), 0), 0))"
    return finalize(s, {"f": f, "df1": "(k - 1)", "df2": "((n - 1) * (k - 1))",
                        "p_value": D.f_sf(f, "(k - 1)", "((n - 1) * (k - 1))"),
                        "partial_eta_sq": "(ssc / nullif(sst - sss, 0))"}, keep=by)


# -- contingency tables ----------------------------------------------------
def crosstab(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """Observed, margins and expected counts per cell (margins by window
    over the small cell table)."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("o"))
    wa, wb, wt = Window.partitionBy(*by, a), Window.partitionBy(*by, b), Window.partitionBy(*by)
    c = c.withColumn("ra", F.sum("o").over(wa)).withColumn("cb", F.sum("o").over(wb)).withColumn("N", F.sum("o").over(wt))
    return c.withColumn("e", F.col("ra") * F.col("cb") / F.col("N"))


def chi2(df: DataFrame, a: str, b: str, by=None, yates: bool = True) -> DataFrame:
    """Chi-square independence (Yates for 2x2), df, expected-count
    check, Cramer's V.

    Only observed cells and the margins are used: sum((O-E)^2/E) equals
    sum(O^2/E) - N over all cells, and a zero cell adds nothing to sum(O^2/E);
    in a 2x2 table |O-E| is the same in every cell, so the Yates form is
    (|O11-E11| - 0.5)^2 * N * (1/r1 + 1/r2) * (1/c1 + 1/c2).  No level grid
    (and so no cross product) is ever built."""
    by = _by(by)
    c = crosstab(df, a, b, by)
    rows = c.groupBy(*by, a).agg(F.first("ra").alias("ra"))
    cols = c.groupBy(*by, b).agg(F.first("cb").alias("cb"))
    cm = cols.groupBy(*by).agg(F.count("*").alias("c"), F.min("cb").alias("min_cb"),
                               F.sum(F.lit(1.0) / F.col("cb")).alias("inv_cb"),
                               F.collect_list("cb").alias("__cbs"))    # one entry per level of b
    N = c.groupBy(*by).agg(F.first("N").alias("n"), F.sum(F.col("o") * F.col("o") / F.col("e")).alias("soe"),
                           F.first(F.abs(F.col("o") - F.col("e"))).alias("dev"))
    rj = rows.join(cm, by) if by else rows.withColumn("__cbs", cm.select("__cbs").scalar())
    rj = rj.join(N, by) if by else rj.withColumn("n", N.select("n").scalar())
    rj = rj.withColumn("__low", F.size(F.filter("__cbs", lambda x: F.col("ra") * x < 5 * F.col("n"))))
    rm = rj.groupBy(*by).agg(F.count("*").alias("r"), F.min("ra").alias("min_ra"),
                             F.sum(F.lit(1.0) / F.col("ra")).alias("inv_ra"), F.sum("__low").alias("n_low"))
    st = rm.join(cm.drop("__cbs"), by).join(N, by) if by else \
        rm.withColumn("c", cm.select("c").scalar()).withColumn("min_cb", cm.select("min_cb").scalar()) \
          .withColumn("inv_cb", cm.select("inv_cb").scalar()).withColumn("n", N.select("n").scalar()) \
          .withColumn("soe", N.select("soe").scalar()).withColumn("dev", N.select("dev").scalar())
    general = F.col("soe") - F.col("n")
    yat = F.pow(F.greatest(F.col("dev") - 0.5, F.lit(0.0)), 2) * F.col("n") * F.col("inv_ra") * F.col("inv_cb")
    st = st.withColumn("chi2", F.when((F.col("r") == 2) & (F.col("c") == 2) & F.lit(yates), yat).otherwise(general))
    st = st.withColumn("min_expected", F.col("min_ra") * F.col("min_cb") / F.col("n")) \
        .withColumn("share_low_expected", F.col("n_low") / (F.col("r") * F.col("c")))
    return finalize(st, chi2_exprs(), keep=by)


def crosstab_grid(df: DataFrame, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """Every (a, b) cell including empty ones, without a cross join: each
    a-level row carries the list of b-levels of its group (bounded by the
    number of levels of b) and explodes it."""
    by = list(by)
    c = crosstab(df, a, b, by)
    blv = c.groupBy(*by, b).agg(F.first("cb").alias("cb")) \
        .groupBy(*by).agg(F.collect_list(F.struct(F.col(b).alias("lvl"), "cb")).alias("__bl"))
    alv = c.groupBy(*by, a).agg(F.first("ra").alias("ra"), F.first("N").alias("N"))
    g = alv.join(blv, by) if by else alv.withColumn("__bl", blv.select("__bl").scalar())
    g = g.select(*by, a, "ra", "N", F.explode("__bl").alias("__b")) \
        .select(*by, a, F.col("__b.lvl").alias(b), "ra", F.col("__b.cb").alias("cb"), "N")
    g = g.join(c.select(*by, a, b, "o"), by + [a, b], "left").fillna({"o": 0})
    return g.withColumn("e", F.col("ra") * F.col("cb") / F.col("N"))


def residuals(df: DataFrame, a: str, b: str, by=None) -> DataFrame:
    """Standardised and adjusted residuals per cell, |adjusted| > 2 flagged."""
    by = _by(by)
    g = crosstab_grid(df, a, b, by)
    e = {"o": "o", "e": "e", "std_resid": "((o - e) / sqrt(nullif(e, 0)))",
         "adj_resid": "((o - e) / sqrt(nullif(e * (1 - ra / N) * (1 - cb / N), 0)))",
         "flag": "(abs((o - e) / sqrt(nullif(e * (1 - ra / N) * (1 - cb / N), 0))) > 2)"}
    return finalize(g, e, keep=by + [a, b])


def two_by_two(df: DataFrame, exposed, outcome, by: list[str] = ()) -> DataFrame:
    """Counts of the four cells as doubles: tests multiply up to four margins, which overflows a long from some 50,000 rows a margin."""
    ex, oc = F.expr(exposed) if isinstance(exposed, str) else exposed, F.expr(outcome) if isinstance(outcome, str) else outcome
    cells = {"a": ex & oc, "b": ex & ~oc, "c": ~ex & oc, "d": ~ex & ~oc}
    return df.groupBy(*by).agg(*[F.count_if(c).cast("double").alias(n) for n, c in cells.items()])


def odds_ratio(df: DataFrame, exposed, outcome, by=None) -> DataFrame:
    """Odds ratio and risk ratio with log-scale 95% CIs."""
    by = _by(by)
    t = two_by_two(df, exposed, outcome, by)
    e = {"a": "a", "b": "b", "c": "c", "d": "d", **odds_exprs()}
    return finalize(t, e, keep=by)


def fisher_exprs(d: str = SPARK) -> dict[str, str]:
    """Two-sided Fisher exact p over (a, b, c, d): sum of hypergeometric
    probabilities not above the observed one.  The support is clipped to
    mode +/- 40 sd, beyond which every term underflows double precision, so
    the sum is exact to the precision of the result."""
    def lchoose(n, k):
        return f"({D.lgamma(f'({n}) + 1', d)} - {D.lgamma(f'({k}) + 1', d)} - {D.lgamma(f'({n}) - ({k}) + 1', d)})"

    r1, r2, c1, n = "(a + b)", "(c + d)", "(a + c)", "(a + b + c + d)"
    lo = f"greatest(0, {c1} - {r2})"
    hi = f"least({r1}, {c1})"
    sd = f"sqrt(greatest({r1} * {r2} * {c1} * ({n} - {c1}) / ({n} * {n} * greatest({n} - 1, 1)), 1))"
    mode = f"floor(({r1} + 1) * ({c1} + 1) / ({n} + 2.0))"
    lo2 = f"CAST(greatest({lo}, floor({mode} - 40 * {sd})) AS BIGINT)"
    hi2 = f"CAST(least({hi}, ceil({mode} + 40 * {sd})) AS BIGINT)"
    pmf = lambda x: f"exp({lchoose(r1, x)} + {lchoose(r2, f'{c1} - ({x})')} - {lchoose(n, c1)})"
    vobs = D._fresh("zo")

    def step(st, k):
        x = f"({lo2} + {k} - 1)"
        return {"s": f"{st}.s + CASE WHEN {pmf(x)} <= {vobs} * (1 + 1e-7) THEN {pmf(x)} ELSE 0 END"}

    total = D.fold(d, f"({hi2} - {lo2} + 1)", {"s": "0.0"}, step, "s")
    return {"a": "a", "b": "b", "c": "c", "d": "d",
            "p_value": D.let(d, vobs, pmf("a"), f"least(1.0, {total})")}


def fisher(df: DataFrame, exposed, outcome, by=None) -> DataFrame:
    by = _by(by)
    return finalize(two_by_two(df, exposed, outcome, by), fisher_exprs(), keep=by)


def cmh(df: DataFrame, exposed, outcome, stratum: str) -> DataFrame:
    """Cochran-Mantel-Haenszel test (continuity corrected) and the
    Mantel-Haenszel pooled odds ratio over strata."""
    t = two_by_two(df, exposed, outcome, [stratum]).withColumn("n", F.expr("a + b + c + d"))
    s = t.agg(F.sum(F.expr("a * d / n")).alias("num"), F.sum(F.expr("b * c / n")).alias("den"),
              F.sum("a").alias("sa"), F.sum(F.expr("(a + b) * (a + c) / n")).alias("ea"),
              F.sum(F.expr("(a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))")).alias("va"),
              F.count("*").alias("k"))
    chi = "(pow(greatest(abs(sa - ea) - 0.5, 0), 2) / nullif(va, 0))"
    return finalize(s, {"k": "k", "mh_odds_ratio": "(num / nullif(den, 0))", "cmh_chi2": chi,
                        "p_value": D.chi2_sf(chi, "1")})


def trend_chi2(df: DataFrame, a_score: str, b_score: str) -> DataFrame:
    """Linear-by-linear association M^2 = (N - 1) r^2, 1 df."""
    s = df.agg(F.count("*").alias("n"), F.corr(a_score, b_score).alias("r"))
    m2 = "((n - 1) * r * r)"
    return finalize(s, {"n": "n", "r": "r", "m2": m2, "p_value": D.chi2_sf(m2, "1")})


def regr_stats(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"),
                               F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))


def slope(df: DataFrame, x: str, y: str, by=None) -> DataFrame:
    """OLS slope per entity with SE, t-based 95% CI (t critical, not z)
    and R^2, from regression sums (one pass, partial aggregation)."""
    by = _by(by)
    return finalize(regr_stats(df, x, y, by), slope_exprs(), keep=by)


def interaction(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Do slopes differ across strata of z?  Separate-slopes vs
    common-slope (separate intercepts) F test from per-stratum sums."""
    s = regr_stats(df, x, y, [z])
    t = s.agg(F.count("*").alias("k"), F.sum("n").alias("n"),
              F.sum(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")).alias("rss_sep"),
              F.sum("syy").alias("syy"), F.sum("sxy").alias("sxy"), F.sum("sxx").alias("sxx"))
    f = "(((syy - sxy * sxy / sxx) - rss_sep) / (k - 1)) / nullif(rss_sep / (n - 2 * k), 0)"
    return finalize(t, {"k": "k", "n": "n", "common_slope": "(sxy / nullif(sxx, 0))", "f": f, "df1": "(k - 1)",
                        "df2": "(n - 2 * k)", "p_value": D.f_sf(f, "(k - 1)", "(n - 2 * k)")})


def heterogeneity(effects: DataFrame, est: str, var: str) -> DataFrame:
    """Cochran's Q, I^2 and DerSimonian-Laird tau^2 over effect estimates."""
    w = F.lit(1.0) / F.col(var)
    s = effects.where(F.col(var) > 0).agg(F.count("*").alias("k"), F.sum(w).alias("sw"),
                                          F.sum(w * w).alias("sw2"), F.sum(w * F.col(est)).alias("swt"),
                                          F.sum(w * F.col(est) * F.col(est)).alias("swt2"))
    q = "(swt2 - swt * swt / sw)"
    return finalize(s, {"k": "k", "pooled": "(swt / sw)", "q": q, "df": "(k - 1)",
                        "p_value": D.chi2_sf(q, "(k - 1)"),
                        "i_squared": f"CASE WHEN {q} > 0 THEN greatest(0, ({q} - (k - 1)) / {q}) ELSE 0 END",
                        "tau_squared": f"greatest(0, ({q} - (k - 1)) / nullif(sw - sw2 / sw, 0))"})


def adjust_p(stats: DataFrame, family: list[str], p: str = "p_value", method: str = "bh",
             out: str | None = None) -> DataFrame:
    """Benjamini-Hochberg (step-up, reverse cumulative min), Holm
    (step-down, cumulative max) or Bonferroni within each family."""
    out = out or f"p_{method}"
    fam = list(family) or [F.lit(1)]
    m = F.count("*").over(Window.partitionBy(*fam))
    i = F.row_number().over(Window.partitionBy(*fam).orderBy(F.col(p).asc()))
    d = stats.withColumn("__m", m).withColumn("__i", i)
    if method == "bonferroni":
        adj = F.least(F.lit(1.0), F.col("__m") * F.col(p))
    elif method == "holm":
        w = Window.partitionBy(*fam).orderBy(F.col("__i")).rowsBetween(Window.unboundedPreceding, 0)
        adj = F.least(F.lit(1.0), F.max((F.col("__m") - F.col("__i") + 1) * F.col(p)).over(w))
    else:
        w = Window.partitionBy(*fam).orderBy(F.col("__i").desc()).rowsBetween(Window.unboundedPreceding, 0)
        adj = F.least(F.lit(1.0), F.min(F.col("__m") * F.col(p) / F.col("__i")).over(w))
    return d.withColumn(out, F.round(adj, 6)).drop("__m", "__i")


def power_exprs(d: str = SPARK, alpha: float = 0.05) -> dict[str, str]:
    """X29 over (d_eff, n1, n2, p_value): normal-approximation power of a
    two-sample comparison, minimum detectable effect, inconclusive flag."""
    from statistics import NormalDist
    za, zb = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(0.8)
    nh = "(2.0 * n1 * n2 / nullif(n1 + n2, 0))"
    ncp = f"(abs(d_eff) * sqrt({nh} / 2.0))"
    pw = f"({D.norm_cdf(f'{ncp} - {za!r}', d)} + {D.norm_cdf(f'-{ncp} - {za!r}', d)})"
    return {"power": pw, "mde": f"({za + zb!r} * sqrt(2.0 / {nh}))",
            "inconclusive": f"(p_value >= {alpha} AND {pw} < 0.8)"}


def steiger_exprs(d: str = SPARK) -> dict[str, str]:
    """Steiger's Z for two dependent correlations sharing one variable
    (r_xy vs r_xz, with r_yz), over (n, rxy, rxz, ryz)."""
    rb = "((rxy + rxz) / 2.0)"
    psi = f"(ryz * (1 - 2 * {rb} * {rb}) - 0.5 * {rb} * {rb} * (1 - 2 * {rb} * {rb} - ryz * ryz))"
    c = f"({psi} / pow(1 - {rb} * {rb}, 2))"
    z = f"((atanh(rxy) - atanh(rxz)) * sqrt(n - 3.0) / sqrt(nullif(2 - 2 * {c}, 0)))"
    return {"n": "n", "rxy": "rxy", "rxz": "rxz", "ryz": "ryz", "z": z, "p_value": D.norm_sf2(z, d)}


def steiger(df: DataFrame, x: str, y: str, z: str, by=None) -> DataFrame:
    by = _by(by)
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("rxy"), F.corr(x, z).alias("rxz"),
                            F.corr(y, z).alias("ryz"))
    return finalize(s, steiger_exprs(), keep=by)


def outcome_expr(p: str = "p_value", tier: str = "tier", power: str = "power", alpha: float = 0.05) -> str:
    """Supported / rejected / inconclusive."""
    return (f"CASE WHEN {p} < {alpha} AND {tier} <> 'trivial' THEN 'supported' "
            f"WHEN {p} >= {alpha} AND {power} >= 0.8 THEN 'rejected' ELSE 'inconclusive' END")


def mutual_info(df: DataFrame, x: str, y: str, bins: int = 10, by=None) -> DataFrame:
    """Mutual information (nats) of equal-width binned x and y, with
    the normalised form MI / sqrt(H(x) H(y)).  Ranges are aggregated and
    joined back; windows run over the bins^2 cells of a group only."""
    by = _by(by)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = d.groupBy(*by).agg(*[f(c).alias(f"__{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))])
    if by:
        ends = ends.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(by)], *[c for c in ends.columns if c not in by])
        d = d.join(ends, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(by)])
    else:
        for c in ends.columns:
            d = d.withColumn(c, ends.select(c).scalar())
    for c in (x, y):
        lo, hi = F.col(f"__lo{c}"), F.col(f"__hi{c}")
        d = d.withColumn(f"__b{c}", F.least(F.lit(bins - 1), F.floor(
            F.coalesce(F.try_divide(F.col(c) - lo, hi - lo), F.lit(0.0)) * bins)).cast("int"))
    bx, by_ = f"__b{x}", f"__b{y}"
    j = d.groupBy(*by, bx, by_).agg(F.count("*").alias("nxy"))
    wt = Window.partitionBy(*by)
    j = (j.withColumn("n", F.sum("nxy").over(wt)).withColumn("nx", F.sum("nxy").over(Window.partitionBy(*by, bx)))
         .withColumn("ny", F.sum("nxy").over(Window.partitionBy(*by, by_))))
    s = j.groupBy(*by).agg(
        F.sum(F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))).alias("mi"),
        F.first("n").alias("n"))
    hx = j.groupBy(*by, bx).agg(F.first("nx").alias("c"), F.first("n").alias("n")).groupBy(*by).agg(
        (-F.sum(F.col("c") / F.col("n") * F.log(F.col("c") / F.col("n")))).alias("hx"))
    hy = j.groupBy(*by, by_).agg(F.first("ny").alias("c"), F.first("n").alias("n")).groupBy(*by).agg(
        (-F.sum(F.col("c") / F.col("n") * F.log(F.col("c") / F.col("n")))).alias("hy"))
    s = s.join(hx, by).join(hy, by) if by else s.withColumn("hx", hx.scalar()).withColumn("hy", hy.scalar())
    return finalize(s, {"n": "n", "mi": "mi", "nmi": "(mi / nullif(sqrt(hx * hy), 0))"}, keep=by)


def bootstrap_mean(df: DataFrame, value: str, replicates: int = 200, seed: int = 42,
                   cluster: str | None = None, key: list[str] | None = None) -> DataFrame:
    """Percentile bootstrap CI of a mean with Poisson(1) weights drawn
    from a seeded hash (of the row key, or of the cluster key for a cluster
    bootstrap), so replicates do not depend on partitioning.  Each task
    pre-aggregates its rows into one row per replicate before the shuffle."""
    ids = [F.col(cluster)] if cluster else [F.col(k) for k in (key or df.columns)]
    b = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("__b")
    d = df.where(F.col(value).isNotNull()).select(F.col(value).alias("x"), *ids, b)
    u = (F.abs(F.xxhash64(*ids, F.col("__b"), F.lit(seed))) % 1000000007) / F.lit(1000000007.0)
    # Poisson(1) inverse CDF on u (cumulative probabilities e^-1 * sum 1/k!)
    cdf, acc, term = [], 0.0, 0.36787944117144233
    for k in range(12):
        acc += term
        cdf.append(acc)
        term /= (k + 1)
    w = F.lit(12)
    for k in reversed(range(12)):
        w = F.when(u < cdf[k], F.lit(k)).otherwise(w)
    d = d.withColumn("__w", w)
    reps = d.groupBy("__b").agg((F.sum(F.col("__w") * F.col("x")) / F.sum("__w")).alias("m"))
    est = df.select(F.avg(value)).scalar()
    ci = reps.agg(F.percentile(F.col("m"), F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("*").alias("B"))
    return ci.select(F.lit(value).alias("metric"), est.alias("estimate"), F.col("q")[0].alias("ci_low"),
                     F.col("q")[1].alias("ci_high"), "B")


def regress(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Multivariable OLS as a coefficient table, from one aggregate of cross products (``models.glm``, which also
    gives intervals and other families)."""
    from prudent.operators import models
    t = models.coefficients(df.sparkSession, models.glm(df, y, xs))
    return t.select("term", "coefficient", "std_error", F.col("statistic").alias("t"), "p_value", F.col("explained").alias("r2"))


def ipw_effect(df: DataFrame, y: str, treated: str, covariates: list[str]) -> DataFrame:
    """Inverse-propensity-weighted difference in means (logistic
    propensity from MLlib; weights applied in one aggregate)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    va = VectorAssembler(inputCols=covariates, outputCol="__f", handleInvalid="skip")
    d = va.transform(df.select(y, F.col(treated).cast("double").alias("__t"), *covariates))
    m = LogisticRegression(featuresCol="__f", labelCol="__t").fit(d)
    p = m.transform(d).withColumn("__p", vector_to_array("probability")[1])
    w = F.when(F.col("__t") == 1, 1 / F.col("__p")).otherwise(1 / (1 - F.col("__p")))
    s = p.agg(F.sum(F.when(F.col("__t") == 1, w * F.col(y))).alias("s1"), F.sum(F.when(F.col("__t") == 1, w)).alias("w1"),
              F.sum(F.when(F.col("__t") == 0, w * F.col(y))).alias("s0"), F.sum(F.when(F.col("__t") == 0, w)).alias("w0"))
    return s.select((F.col("s1") / F.col("w1") - F.col("s0") / F.col("w0")).alias("ipw_effect"))


def stratified_effect(df: DataFrame, y: str, treated: str, stratum: str) -> DataFrame:
    """Stratum-weighted difference in means (weights = stratum share)."""
    g = df.groupBy(stratum).agg(F.avg(F.when(F.col(treated), F.col(y))).alias("m1"),
                                F.avg(F.when(~F.col(treated), F.col(y))).alias("m0"), F.count("*").alias("n"))
    g = g.where(F.col("m1").isNotNull() & F.col("m0").isNotNull())
    return g.agg((F.sum((F.col("m1") - F.col("m0")) * F.col("n")) / F.sum("n")).alias("stratified_effect"),
                 F.count("*").alias("n_strata"))


# -- X34: the test for a metric and a grouping -------------------------------
PAIR = ["metric", "grouping"]

#: per test: statistic, effect size, tier, of the columns its operator returns
_REPORTED = {
    "welch_t": ("t", "cohens_d", "tier"), "mann_whitney": ("u", "rank_biserial", "tier"),
    "paired_t": ("t", "d_z", "tier"), "wilcoxon": ("w_plus", "effect_r", "tier"),
    "anova": ("f", "eta_sq", "tier"), "kruskal": ("h", "eta_sq", "tier"),
    "rm_anova": ("f", "partial_eta_sq", eta_tier("partial_eta_sq")), "friedman": ("chi2", "kendall_w", r_tier("kendall_w")),
}


def choose_test(shape: Column, n_groups: Column, paired: bool = False) -> Column:
    """The test for a metric of this shape over this number of groups, independent or paired (the same subjects
    in every group); NULL for fewer than two groups, which leave nothing to compare."""
    two, more = (("paired_t", "wilcoxon"), ("rm_anova", "friedman")) if paired else (("welch_t", "mann_whitney"), ("anova", "kruskal"))

    def by_shape(normal: str, other: str) -> Column:
        return F.when(shape == "normal", normal).otherwise(other)

    return F.when(n_groups == 2, by_shape(*two)).when(n_groups > 2, by_shape(*more))


def _stacked(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows (metric, grouping, level, x) of every pair that have a level and a value; NaN counts as null."""
    one = [F.struct(F.lit(m).alias("metric"), F.lit(g).alias("grouping"), F.col(g).cast("string").alias("level"),
                    F.nanvl(F.col(m).cast("double"), F.lit(None)).alias("x")) for m, g in pairs]
    s = df.select(F.explode(F.array(*one)).alias("__s")).select("__s.*")
    return s.where(F.col("level").isNotNull() & F.col("x").isNotNull())


def _blocks(df: DataFrame, metrics: list[str], groupings: list[str], subject: str) -> DataFrame:
    """Mean of every subject in every level, stacked as above, of the subjects that have all levels of the pair.

    Means are kept to 13 digits: equal ones stay ties in whatever order their rows were added.
    """
    levels = F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("level")) for g in groupings]))
    values = [F.nanvl(F.col(m).cast("double"), F.lit(None)).alias(f"__{i}") for i, m in enumerate(metrics)]
    d = df.select(F.col(subject).alias("subject"), levels.alias("__l"), *values).select("*", "__l.*")
    means = [F.when(F.count(c) > 0, F.format_string("%.12e", F.avg(c)).cast("double")).alias(c) for c in (f"__{i}" for i in range(len(metrics)))]
    keys = ["subject", "grouping", "level"]
    wide = d.where(F.col("subject").isNotNull() & F.col("level").isNotNull()).groupBy(*keys).agg(*means)
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"__{i}").alias("x")) for i, m in enumerate(metrics)]))
    m = cut_lineage(wide.select(*keys, one.alias("__s")).select(*keys, "__s.*").where(F.col("x").isNotNull()))
    k = m.groupBy(*PAIR).agg(F.count_distinct("level").alias("__k"))
    whole = m.groupBy("subject", *PAIR).agg(F.count("*").alias("__c")).join(F.broadcast(k), PAIR).where(F.col("__c") == F.col("__k"))
    return cut_lineage(m.join(whole.select("subject", *PAIR), ["subject", *PAIR]))


def _run_test(test: str, rows: DataFrame) -> DataFrame:
    """The operator of ``test`` over the rows of its pairs, its post-hoc pairs beside it: Tukey's after an ANOVA, Dunn's after Kruskal-Wallis."""
    after = None
    if test in ("welch_t", "mann_whitney"):
        r = (welch_t if test == "welch_t" else mann_whitney)(rows, "x", "first", True, False, PAIR)
    elif test in ("paired_t", "wilcoxon"):
        sides = [F.max(F.when(c, F.col("x"))).alias(n) for n, c in (("a", F.col("first")), ("b", ~F.col("first")))]
        r = (paired_t if test == "paired_t" else wilcoxon)(rows.groupBy("subject", *PAIR).agg(*sides), "a", "b", PAIR)
    elif test == "anova":
        from prudent.operators.models import tukey_hsd
        r = anova(rows, "x", "level", PAIR)
        after = tukey_hsd(rows, "x", "level", PAIR, confidence=None).withColumnRenamed("q", "statistic")
    elif test == "kruskal":
        ranks = tuple(cut_lineage(t) for t in _group_ranks(rows, "x", "level", PAIR))  # a row a level, read by both
        r = kruskal(rows, "x", "level", PAIR, ranks=ranks)
        after = dunn(rows, "x", "level", "holm", PAIR, ranks=ranks).drop("p_value").withColumnsRenamed({"z": "statistic", "p_holm": "p_value"})
    else:
        r = (rm_anova if test == "rm_anova" else friedman)(rows, "subject", "level", "x", PAIR)
    statistic, effect, tier = _REPORTED[test]
    numbers = {"statistic": statistic, "p_value": "p_value", "ci_low": "ci_low", "ci_high": "ci_high", "effect_size": effect}
    r = r.select(*PAIR, *[(F.nanvl(F.col(c), F.lit(None)) if c in r.columns else F.lit(None).cast("double")).alias(n) for n, c in numbers.items()],
                 F.expr(tier).alias("tier"))
    if after is None:
        return r.withColumn("post_hoc", F.lit(None).cast("array<struct<g1:string,g2:string,statistic:double,p_value:double>>"))
    after = after.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("g1", "g2", "statistic", "p_value"))).alias("post_hoc"))
    return r.join(after, PAIR, "left")


def compare_groups(df: DataFrame, metrics: list[str], groupings: list[str], subject: str | None = None) -> DataFrame:
    """Every metric compared over the groups of every grouping by the test chosen for it, which is run.

    Without ``subject`` the rows are independent; with it, the means of a subject in the groups are paired.  The shape
    is that of the values compared (Q07).  One row a pair: the choice, ``n`` rows (subjects) compared, statistic,
    p-value, interval of the difference where the test has one, effect size, tier and the post-hoc pairs.  Of two
    groups the difference is that of the first level in order less the second.  A pair without values (whole subjects) has no row.
    """
    from prudent.operators import profile as Q
    pairs = [(m, g) for m in metrics for g in groupings]
    if subject is None:
        rows, n = _stacked(df, pairs), F.sum("__c")
        shapes, on = Q.shape(Q.distribution(df, metrics)).select("metric", "shape"), ["metric"]
    else:
        rows, n = _blocks(df, metrics, groupings, subject), F.max("__c")  # a subject has one row a level
        of = rows.withColumnRenamed("metric", "__metric")
        shapes, on = Q.shape(Q.distribution(of, ["x"], ["__metric", "grouping"])).select(F.col("__metric").alias("metric"), "grouping", "shape"), PAIR
    sizes = rows.groupBy(*PAIR, "level").agg(F.count("*").alias("__c")).groupBy(*PAIR).agg(
        F.count("*").cast("int").alias("n_groups"), n.alias("n"), F.min("level").alias("g1"))
    chosen = df.sparkSession.createDataFrame(pairs, "metric string, grouping string").join(shapes, on).join(sizes, PAIR, "left") \
        .fillna(0, ["n_groups", "n"])
    chosen = cut_lineage(chosen.withColumn("test", choose_test(F.col("shape"), F.col("n_groups"), subject is not None)))
    todo: dict[str, list[tuple[str, str]]] = {}
    for r in chosen.where("test IS NOT NULL").collect():    # one row per metric and grouping
        todo.setdefault(r["test"], []).append((r["metric"], r["grouping"]))
    done = []
    for test, of in sorted(todo.items()):
        mine = (_stacked(df, of) if subject is None else rows).join(F.broadcast(chosen.where(F.col("test") == test).select(*PAIR, "g1")), PAIR)
        done.append(cut_lineage(_run_test(test, mine.withColumn("first", F.col("level") == F.col("g1")))))
    empty = df.sparkSession.createDataFrame([], "metric string, grouping string, statistic double, p_value double, ci_low double, ci_high double, "
                                                "effect_size double, tier string, post_hoc array<struct<g1:string,g2:string,statistic:double,p_value:double>>")
    return chosen.drop("g1").join(reduce(DataFrame.unionByName, done, empty), PAIR, "left")
