"""Queries of fitted models and pairwise or simulated comparisons.

The oracles don't share formulas with the operators: Tukey's tail is integrated over a grid of rows,
regressions are solved by determinants, and the models whose maximum has a closed form use it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prudent.functions.dist import DUCK, chi2_sf, f_sf, norm_sf2, t_ppf, t_sf2
from prudent.operators import models as M
from prudent.plans.registry import Tables, query

# Phi on a grid of hundredths by Simpson's rule, with the density for a cubic between grid points;
# z in tenths from -9 to 9 (trapezoid), chi in 240 panels (Simpson)
_TUKEY_SQL = """
WITH g AS (SELECT o_orderpriority AS grp, count(o_totalprice) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v
           FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1),
 fam AS (SELECT CAST(count(*) AS DOUBLE) AS k, CAST(sum(n) - count(*) AS DOUBLE) AS df, sum((n - 1) * v) / (sum(n) - count(*)) AS mse FROM g),
 p AS (SELECT a.grp AS g1, b.grp AS g2, a.m - b.m AS mean_diff, k, df, abs(a.m - b.m) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)) AS q
       FROM g a JOIN g b ON a.grp < b.grp, fam),
 step AS (SELECT i, -20 + i * 0.01 AS a, exp(-0.5 * pow(-20 + i * 0.01, 2)) / sqrt(2 * pi()) AS d,
                 (exp(-0.5 * pow(-20 + i * 0.01, 2)) + 4 * exp(-0.5 * pow(-19.995 + i * 0.01, 2)) + exp(-0.5 * pow(-19.99 + i * 0.01, 2)))
                   / sqrt(2 * pi()) * 0.01 / 6 AS part FROM range(0, 3000) AS r(i)),
 phi AS (SELECT i, a, d, sum(part) OVER (ORDER BY i) - part AS c FROM step),
 z AS (SELECT -9 + i * 0.1 AS z, exp(-0.5 * pow(-9 + i * 0.1, 2)) / sqrt(2 * pi()) * 0.1 AS w FROM range(0, 181) AS r(i)),
 x AS (SELECT greatest(sqrt(df) - 7, 0) + i * (sqrt(df) + 7 - greatest(sqrt(df) - 7, 0)) / 240 AS x,
              (sqrt(df) + 7 - greatest(sqrt(df) - 7, 0)) / 720 * (CASE WHEN i IN (0, 240) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) AS w
       FROM fam, range(0, 241) AS r(i)),
 cell AS (SELECT g1, g2, k, x.x, x.w AS wx, z.w AS wz, z.z AS z, z.z - q * x.x / sqrt(df) AS low FROM p, x, z),
 lows AS (SELECT cell.*, b.c + 0.01 * (t * (1 - t) * (1 - t) * b.d + t * t * (t - 1) * b1.d) + (3 * t * t - 2 * t * t * t) * (b1.c - b.c) AS c_low
          FROM (SELECT *, CAST(floor((greatest(low, -19.9) + 20) * 100) AS BIGINT) AS il,
                       (greatest(low, -19.9) + 20) * 100 - floor((greatest(low, -19.9) + 20) * 100) AS t FROM cell) AS cell
          JOIN phi b ON b.i = il JOIN phi b1 ON b1.i = il + 1),
 w AS (SELECT g1, g2, k, x, any_value(wx) AS wx, sum(wz * pow(greatest(phi.c - c_low, 0), k - 1)) * k AS w
       FROM lows JOIN phi ON phi.i = CAST(round((z + 20) * 100) AS BIGINT) GROUP BY 1, 2, 3, 4),
 s AS (SELECT g1, g2, sum(wx * w * exp((1 - df / 2) * ln(2) + (df - 1) * ln(greatest(x, 1e-300)) - x * x / 2 - lgamma(df / 2))) AS inside
       FROM w, (SELECT df FROM fam) GROUP BY 1, 2)
SELECT g1, g2, round(mean_diff, 6) AS mean_diff, round(q, 6) AS q, round(df, 6) AS df,
       round(least(1, greatest(0, 1 - inside)), 6) AS p_value FROM p JOIN s USING (g1, g2)"""


@query("x12_tukey_hsd", _TUKEY_SQL)
def tukey(spark, sf):
    """Tukey-Kramer p-value of every pair of order priorities."""
    return M.tukey_hsd(Tables(spark, sf).orders, "o_totalprice", "o_orderpriority", confidence=None)


@query("x12_tukey_intervals")
def tukey_intervals(spark, sf):
    """Simultaneous intervals of the differences between order priorities within each order status."""
    return M.tukey_hsd(Tables(spark, sf).orders, "o_totalprice", "o_orderpriority", by=["o_orderstatus"])


# two by two normal equations of the status levels after the priorities are taken out
_TWO_WAY_SQL = f"""
WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) * (count(*) - 1) AS m2
           FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1, 2),
 t AS (SELECT sum(n) AS n, sum(coalesce(m2, 0)) AS sse, sum(n * m) / sum(n) AS gm, count(*) AS cells, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM c),
 d AS (SELECT a, b, c.n, m - gm AS y FROM c, t),
 wa AS (SELECT a, sum(n) AS na, sum(n * y) / sum(n) AS ya FROM d GROUP BY a), wb AS (SELECT b, sum(n) AS nb, sum(n * y) AS tb FROM d GROUP BY b),
 r AS (SELECT (SELECT sse FROM t) + (SELECT sum(n * pow(y - ya, 2)) FROM d JOIN wa USING (a)) AS rss_a,
              (SELECT sse FROM t) + (SELECT sum(n * pow(y - tb / nb, 2)) FROM d JOIN wb USING (b)) AS rss_b),
 e AS (SELECT b, nb, tb, coalesce(max(CASE WHEN a = 'F' THEN n END), 0) AS nf, coalesce(max(CASE WHEN a = 'O' THEN n END), 0) AS no,
              coalesce(max(CASE WHEN a = 'F' THEN n * y END), 0) AS tf, coalesce(max(CASE WHEN a = 'O' THEN n * y END), 0) AS to_
       FROM d JOIN wb USING (b) GROUP BY 1, 2, 3),
 q AS (SELECT sum(nf - nf * nf / nb) AS s11, -sum(nf * no / nb) AS s12, sum(no - no * no / nb) AS s22, sum(tf - nf * tb / nb) AS r1, sum(to_ - no * tb / nb) AS r2 FROM e),
 h AS (SELECT rss_a, rss_b, rss_b - (r1 * r1 * s22 - 2 * r1 * r2 * s12 + r2 * r2 * s11) / (s11 * s22 - s12 * s12) AS rss_ab, sse, n, cells, ka, kb FROM r, q, t),
 s AS (SELECT 'o_orderstatus' AS source, rss_b - rss_ab AS ss, ka - 1 AS df, sse, n - cells AS dfe FROM h
       UNION ALL SELECT 'o_orderpriority', rss_a - rss_ab, kb - 1, sse, n - cells FROM h
       UNION ALL SELECT 'o_orderstatus:o_orderpriority', rss_ab - sse, cells - ka - kb + 1, sse, n - cells FROM h
       UNION ALL SELECT 'residual', sse, n - cells, sse, n - cells FROM h),
 f AS (SELECT *, CASE WHEN source <> 'residual' THEN (ss / df) / (sse / dfe) END AS f FROM s)
SELECT source, round(ss, 6) AS ss, round(CAST(df AS DOUBLE), 6) AS df, round(ss / df, 6) AS ms, round(f, 6) AS f,
       round(CASE WHEN f IS NOT NULL THEN {f_sf('f', 'df', 'dfe', DUCK)} END, 6) AS p_value,
       round(CASE WHEN source <> 'residual' THEN ss / (ss + sse) END, 6) AS partial_eta_sq FROM f"""


@query("x25_two_way_anova", _TWO_WAY_SQL)
def two_way(spark, sf):
    """Order price by status and priority, unbalanced cells, type II."""
    t = M.two_way_anova(Tables(spark, sf).orders, "o_totalprice", "o_orderstatus", "o_orderpriority")
    # sums of squares of prices have thirteen digits before the point
    return t


def _det3(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"(({a}) * (({e}) * ({i}) - ({f}) * ({h})) - ({b}) * (({d}) * ({i}) - ({f}) * ({g})) + ({c}) * (({d}) * ({h}) - ({e}) * ({g})))"


def ols_sql() -> str:
    """Three predictors by cofactors of their centred cross products."""
    x = ["l_quantity", "l_discount", "l_tax"]
    s = [[f"s{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]

    def cofactor(i: int, j: int) -> str:
        m = [[s[r][c] for c in range(3) if c != j] for r in range(3) if r != i]
        return f"{'-' if (i + j) % 2 else ''}(({m[0][0]}) * ({m[1][1]}) - ({m[0][1]}) * ({m[1][0]}))"

    inverse = ", ".join(f"{cofactor(i, j)} / {_det3(s)} AS v{i}{j}" for i in range(3) for j in range(3))
    slopes = ", ".join("(" + " + ".join(f"v{i}{j} * r{j}" for j in range(3)) + f") AS b{i}" for i in range(3))
    quad = " + ".join(f"m{i} * v{i}{j} * m{j}" for i in range(3) for j in range(3))
    rows = " UNION ALL ".join(["SELECT '(intercept)' AS term, my - (b0 * m0 + b1 * m1 + b2 * m2) AS b, sqrt(rss / df * (1.0 / n + " + quad + ")) AS se, * FROM e"]
                              + [f"SELECT '{c}', b{i}, sqrt(rss / df * v{i}{i}), * FROM e" for i, c in enumerate(x)])
    return f"""
WITH d AS (SELECT l_extendedprice AS y, {', '.join(f'CAST({c} AS DOUBLE) AS x{i}' for i, c in enumerate(x))} FROM lineitem),
 c AS (SELECT count(*) AS n, avg(y) AS my, var_pop(y) * count(*) AS syy, {', '.join(f'avg(x{i}) AS m{i}' for i in range(3))},
              {', '.join(f'covar_pop(x{i}, x{j}) * count(*) AS s{i}{j}' for i in range(3) for j in range(i, 3))},
              {', '.join(f'covar_pop(x{i}, y) * count(*) AS r{i}' for i in range(3))} FROM d),
 v AS (SELECT *, {inverse} FROM c), b AS (SELECT *, {slopes} FROM v),
 e AS (SELECT *, syy - (b0 * r0 + b1 * r1 + b2 * r2) AS rss, CAST(n - 4 AS DOUBLE) AS df FROM b),
 t AS ({rows}), u AS (SELECT *, {t_ppf(0.975, 'df', DUCK)} AS crit FROM t)
SELECT term, round(b, 6) AS coefficient, round(se, 6) AS std_error, round(b / se, 6) AS statistic, round({t_sf2('(b / se)', 'df', DUCK)}, 6) AS p_value,
       round(b - crit * se, 6) AS ci_low, round(b + crit * se, 6) AS ci_high, round(rss, 4) AS deviance, round(1 - rss / syy, 6) AS explained,
       true AS converged FROM u"""


@query("x24_ols_intervals", ols_sql())
def ols(spark, sf):
    """Extended price on quantity, discount and tax, with t intervals."""
    li = Tables(spark, sf).lineitem
    return M.coefficients(spark, M.glm(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))


_POISSON_SQL = f"""
WITH d AS (SELECT o_orderkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, count(l_orderkey) AS y
           FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
 g AS (SELECT sum(y) FILTER (f = 0) AS s0, count(*) FILTER (f = 0) AS n0, sum(y) FILTER (f = 1) AS s1, count(*) FILTER (f = 1) AS n1 FROM d),
 dev AS (SELECT sum(CASE WHEN y > 0 THEN 2 * y * ln(y / m) ELSE 0 END - 2 * (y - m)) AS deviance, sum(CASE WHEN y > 0 THEN 2 * y * ln(y / a) ELSE 0 END - 2 * (y - a)) AS null_dev
         FROM (SELECT y, CASE WHEN f = 1 THEN s1 / n1 ELSE s0 / n0 END AS m, (s0 + s1) / (n0 + n1) AS a FROM d, g)),
 t AS (SELECT '(intercept)' AS term, ln(s0 / n0) AS b, sqrt(1 / s0) AS se FROM g UNION ALL SELECT 'filled', ln((s1 / n1) / (s0 / n0)), sqrt(1 / s0 + 1 / s1) FROM g)
SELECT term, round(b, 6) AS coefficient, round(se, 6) AS std_error, round(b / se, 6) AS statistic, round({norm_sf2('(b / se)', DUCK)}, 6) AS p_value,
       round(b - 1.959963984540054 * se, 6) AS ci_low, round(b + 1.959963984540054 * se, 6) AS ci_high, round(deviance, 4) AS deviance,
       round(1 - deviance / null_dev, 6) AS explained, true AS converged FROM t, dev"""


@query("x24_glm_poisson", _POISSON_SQL)
def poisson(spark, sf):
    """Lines of an order on whether it is filled: log link."""
    t = Tables(spark, sf)
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    d = t.orders.join(lines, "o_orderkey", "left").select(F.coalesce("lines", F.lit(0)).alias("lines"),
                                                          (F.col("o_orderstatus") == "F").cast("int").alias("filled"))
    return M.coefficients(spark, M.glm(d, "lines", ["filled"], "poisson"))


def _logit_sql() -> str:
    """Additive logit of two binary factors by Newton steps over their four cells; the full model is saturated."""
    cells = [(a, b) for a in (0, 1) for b in (0, 1)]
    p = {c: f"(1 / (1 + exp(-(b0 + {c[0]} * b1 + {c[1]} * b2))))" for c in cells}
    w = {c: f"(n{c[0]}{c[1]} * {p[c]} * (1 - {p[c]}))" for c in cells}
    g = {c: f"(y{c[0]}{c[1]} - n{c[0]}{c[1]} * {p[c]})" for c in cells}
    x = {c: (1, c[0], c[1]) for c in cells}
    hess = [["(" + " + ".join(f"{x[c][i] * x[c][j]} * {w[c]}" for c in cells) + ")" for j in range(3)] for i in range(3)]
    grad = ["(" + " + ".join(f"{x[c][i]} * {g[c]}" for c in cells) + ")" for i in range(3)]
    names = [[f"h{i}{j}" for j in range(3)] for i in range(3)]

    def cramer(k: int) -> str:
        return f"{_det3([[f'g{i}' if j == k else names[i][j] for j in range(3)] for i in range(3)])} / {_det3(names)}"

    inner = ", ".join([f"{hess[i][j]} AS h{i}{j}" for i in range(3) for j in range(3)] + [f"{grad[i]} AS g{i}" for i in range(3)])
    loglik = " + ".join(f"y{a}{b} * ln({p[a, b]}) + (n{a}{b} - y{a}{b}) * ln(1 - {p[a, b]})" for a, b in cells)
    full = " + ".join(f"y{a}{b} * ln(y{a}{b} / n{a}{b}) + (n{a}{b} - y{a}{b}) * ln(1 - y{a}{b} / n{a}{b})" for a, b in cells)
    return f"""
WITH RECURSIVE d AS (SELECT CAST(l_discount >= 0.05 AS INTEGER) AS a, CAST(l_linestatus = 'F' AS INTEGER) AS b, CAST(l_quantity > 25 AS INTEGER) AS y FROM lineitem),
 c AS (SELECT {', '.join(f'CAST(count(*) FILTER (a = {a} AND b = {b}) AS DOUBLE) AS n{a}{b}, CAST(coalesce(sum(y) FILTER (a = {a} AND b = {b}), 0) AS DOUBLE) AS y{a}{b}' for a, b in cells)} FROM d),
 it AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2
        UNION ALL
        SELECT i + 1, b0 + {cramer(0)}, b1 + {cramer(1)}, b2 + {cramer(2)} FROM (SELECT i, b0, b1, b2, {inner} FROM it, c WHERE i < 12)),
 l AS (SELECT -2 * ({loglik}) AS d0, -2 * ({full}) AS d1 FROM it, c WHERE i = 12)
SELECT round(d0, 6) AS deviance_reduced, round(d1, 6) AS deviance_full, round(greatest(d0 - d1, 0), 6) AS chi2, round(CAST(1 AS DOUBLE), 6) AS df,
       round({chi2_sf('greatest(d0 - d1, 0)', '1', DUCK)}, 6) AS p_value, true AS converged FROM l"""


@query("x25_logistic_lr", _logit_sql())
def logistic_lr(spark, sf):
    """Large quantity on discount and line status: does their interaction add anything?"""
    d = Tables(spark, sf).lineitem.select((F.col("l_discount") >= 0.05).cast("int").alias("discounted"), (F.col("l_linestatus") == "F").cast("int").alias("filled"),
                                          (F.col("l_quantity") > 25).cast("int").alias("large"))
    return M.likelihood_ratio(d.withColumn("both", F.col("discounted") * F.col("filled")), "large", ["discounted", "filled"], ["both"])


@query("x17_monte_carlo")
def monte_carlo(spark, sf):
    """Brand by type of all parts: a sparse table, tested by simulation."""
    return M.monte_carlo_chi2(Tables(spark, sf).part, "p_brand", "p_type")
