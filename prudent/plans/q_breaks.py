"""Queries of several change points, lagged stationarity tests and clustered differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from prudent.functions.dist import DUCK, t_ppf, t_sf2
from prudent.operators import breaks as B
from prudent.operators import series as G
from prudent.plans.q_series import PERIOD, SEG_SQL, seg_orders, seg_series
from prudent.plans.registry import Tables, query

KEY = ["c_mktsegment"]


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _nation_series(spark, sf):
    """Weekly order value of every customer nation."""
    return G.regularize(seg_orders(Tables(spark, sf)), ["c_nationkey"], "o_orderdate", "o_totalprice", "week", 0.0)


@query("g07_wild_binseg")
def wild(spark, sf):
    """Shifts of the mean of every nation's weekly order value, 100 random intervals a series."""
    return _rounded(B.wild_binary_segmentation(_nation_series(spark, sf), ["c_nationkey"]), "stat", "limit", "shift")


@query("g07_binseg_recursive")
def recursive(spark, sf):
    """The same by plain binary segmentation, down to segments without a shift."""
    return _rounded(B.wild_binary_segmentation(_nation_series(spark, sf), ["c_nationkey"], intervals=0), "stat", "limit", "shift")


@query("g09_variance_shifts")
def variance(spark, sf):
    """Changes of variance of the seasonally adjusted weekly orders of every segment."""
    d = G.classical_decompose(seg_series(Tables(spark, sf)), KEY, PERIOD)
    return _rounded(B.variance_shifts(d.where("resid IS NOT NULL").select(*KEY, "t", F.col("resid").alias("y")), KEY), "stat", "ratio")


@query("g15_adf_lag1", f"""WITH {SEG_SQL},
 l AS (SELECT c_mktsegment, t, y, lag(y) OVER o AS y1, lag(y, 2) OVER o AS y2 FROM ss WINDOW o AS (PARTITION BY c_mktsegment ORDER BY t)),
 g AS (SELECT c_mktsegment, CAST(count(*) AS DOUBLE) AS n, regr_sxx(y - y1, y1) AS saa, regr_sxx(y - y1, y1 - y2) AS sbb, regr_sxy(y1 - y2, y1) AS sab,
              regr_sxy(y - y1, y1) AS say, regr_sxy(y - y1, y1 - y2) AS sby, regr_syy(y - y1, y1) AS syy FROM l WHERE y2 IS NOT NULL GROUP BY 1),
 b AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS gamma, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS phi FROM g),
 r AS (SELECT c_mktsegment, n, gamma, gamma / sqrt((syy - gamma * say - phi * sby) / (n - 3) * sbb / (saa * sbb - sab * sab)) AS tau FROM b)
SELECT c_mktsegment, CAST(n AS BIGINT) AS n, CAST(1 AS BIGINT) AS lag, round(gamma, 6) AS gamma, round(tau, 6) AS tau,
       CASE WHEN tau < -3.43035 - 6.5393 / n - 16.786 / (n * n) - 79.433 / (n * n * n) THEN '1%'
            WHEN tau < -2.86154 - 2.8903 / n - 4.234 / (n * n) - 40.040 / (n * n * n) THEN '5%'
            WHEN tau < -2.56677 - 1.5384 / n - 2.809 / (n * n) THEN '10%' ELSE 'not_rejected' END AS unit_root_rejected_at FROM r""")
def adf_lag1(spark, sf):
    """One lagged difference."""
    return _rounded(B.adf(seg_series(Tables(spark, sf)), KEY, 1, fixed=True), "gamma", "tau")


@query("g15_adf_auto")
def adf_auto(spark, sf):
    """Up to eight lagged differences, by the information criterion, for every nation."""
    return _rounded(B.adf(_nation_series(spark, sf), ["c_nationkey"], 8), "gamma", "tau")


@query("g15_kpss_bartlett", f"""WITH {SEG_SQL},
 e AS (SELECT c_mktsegment, t, y - avg(y) OVER (PARTITION BY c_mktsegment) AS e, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM ss),
 s AS (SELECT *, sum(e) OVER (PARTITION BY c_mktsegment ORDER BY t ROWS UNBOUNDED PRECEDING) AS S, floor(4 * pow(n / 100.0, 0.25)) AS q FROM e),
 c AS (SELECT a.c_mktsegment, k.j, any_value(a.q) AS q, sum(a.e * b.e) AS g FROM s a CROSS JOIN range(0, 20) AS k(j) JOIN s b ON a.c_mktsegment = b.c_mktsegment AND b.t = a.t - k.j
       WHERE k.j <= a.q GROUP BY 1, 2),
 v AS (SELECT c_mktsegment, sum(CASE WHEN j = 0 THEN g ELSE 2 * (1 - j / (q + 1)) * g END) AS lr FROM c GROUP BY 1),
 f AS (SELECT c_mktsegment, count(*) AS n, CAST(any_value(q) AS BIGINT) AS lags, sum(S * S) AS ss FROM s GROUP BY 1)
SELECT c_mktsegment, n, lags, round(ss / (n * lr), 6) AS eta,
       CASE WHEN ss / (n * lr) > 0.739 THEN '1%' WHEN ss / (n * lr) > 0.463 THEN '5%' WHEN ss / (n * lr) > 0.347 THEN '10%'
            ELSE 'not_rejected' END AS stationarity_rejected_at FROM f JOIN v USING (c_mktsegment)""")
def kpss_bartlett(spark, sf):
    return _rounded(B.kpss(seg_series(Tables(spark, sf)), KEY), "eta")


@query("g18_did_clustered", f"""
WITH j AS (SELECT o.o_custkey AS c, c.c_mktsegment = 'BUILDING' AS tr, o.o_orderdate >= TIMESTAMP '1998-01-01' AS post, o.o_totalprice AS y
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice IS NOT NULL),
 m AS (SELECT tr, post, avg(y) AS m, count(*) AS n FROM j GROUP BY 1, 2),
 u AS (SELECT c, sum((CASE WHEN tr = post THEN 1 ELSE -1 END) * (y - m) / n) AS u FROM j JOIN m USING (tr, post) GROUP BY c),
 s AS (SELECT (SELECT sum((CASE WHEN tr = post THEN 1 ELSE -1 END) * m) FROM m) AS did, CAST(count(*) AS DOUBLE) AS g, sum(u * u) AS meat, (SELECT sum(n) FROM m) AS n FROM u),
 r AS (SELECT did, g, sqrt(meat * g / (g - 1) * (n - 1) / (n - 4)) AS se FROM s),
 q AS (SELECT *, {t_ppf(0.975, '(g - 1)', DUCK)} AS crit FROM r)
SELECT round(did, 6) AS did, round(se, 6) AS se, round(g, 6) AS n_clusters, round(did / se, 6) AS t, round({t_sf2('(did / se)', '(g - 1)', DUCK)}, 6) AS p_value,
       round(did - crit * se, 6) AS ci_low, round(did + crit * se, 6) AS ci_high FROM q""")
def did_clustered(spark, sf):
    """BUILDING customers before and after 1998, customers as clusters."""
    o = seg_orders(Tables(spark, sf))
    return B.did_clustered(o, F.col("c_mktsegment") == "BUILDING", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), "o_totalprice", "o_custkey")
