"""Queries of benchmarks and gaps over monthly supplier volumes (D18, D19); the oracles pair entities, the operators don't."""

from __future__ import annotations

from pyspark.sql import functions as F

from prudent.functions.dist import DUCK, t_ppf
from prudent.operators import benchmark as B
from prudent.plans.registry import Tables, query

_PANEL = """panel AS (SELECT n.n_regionkey, l.l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) AS m, sum(l_quantity) AS qty, count(*) AS n_lines
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY 1, 2, 3)"""
_LAST = "(SELECT max(m) FROM panel)"


def _panel(spark, sf):
    t = Tables(spark, sf)
    j = (t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
         .join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")), "s_nationkey"))
    return j.groupBy("n_regionkey", "l_suppkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m")) \
        .agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n_lines"))


@query("d19_gap_report", f"""WITH {_PANEL},
 e AS (SELECT n_regionkey AS g, l_suppkey AS id, CAST(count(*) AS DOUBLE) AS t, avg(qty) AS x, stddev_samp(qty) AS noise,
              avg(CASE WHEN m > {_LAST} - 3 THEN qty END) AS x3, avg(CASE WHEN m > {_LAST} - 12 THEN qty END) AS x12 FROM panel GROUP BY 1, 2),
 o AS (SELECT a.g, a.id, any_value(a.t) AS t, any_value(a.x) AS x, any_value(a.noise) AS noise, any_value(a.x3) AS x3, any_value(a.x12) AS x12,
              CAST(count(b.id) AS DOUBLE) AS n, avg(b.x) AS bench, var_samp(b.x) AS v, avg(b.x3) AS b3, avg(b.x12) AS b12, max(b.x) AS hi, min(b.x) AS lo
       FROM e a LEFT JOIN e b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
 s AS (SELECT *, noise * noise / t AS a, v / n AS b, sign(x - bench) AS sg FROM o),
 q AS (SELECT *, pow(a + b, 2) / (a * a / (t - 1) + b * b / (n - 1)) AS df FROM s),
 c AS (SELECT *, {t_ppf(0.975, 'df', DUCK)} AS crit, {t_ppf(0.975, '(n - 1)', DUCK)} AS bcrit FROM q),
 r AS (SELECT g AS n_regionkey, id AS l_suppkey, coalesce(sign(x3 - b3) = sg, false) AND coalesce(sign(x12 - b12) = sg, false) AS windows_agree,
              coalesce(sign(x - (bench * n - hi) / (n - 1)) = sg AND sign(x - (bench * n - lo) / (n - 1)) = sg, false) AS drop_one_peer,
              round(x, 6) AS level, round(bench, 6) AS benchmark, round(bench - bcrit * sqrt(b), 6) AS bench_low, round(bench + bcrit * sqrt(b), 6) AS bench_high,
              round(n, 6) AS n_peers, round(x - bench, 6) AS gap, round((x - bench) * 100 / bench, 6) AS gap_pct, round(x - bench - crit * sqrt(a + b), 6) AS ci_low,
              round(x - bench + crit * sqrt(a + b), 6) AS ci_high, round(noise, 6) AS noise, coalesce(abs(x - bench) > noise, false) AS outside_noise, n >= 10 AS enough_peers FROM c)
SELECT *, CASE WHEN coalesce(ci_low > 0 OR ci_high < 0, false) AND outside_noise AND windows_agree AND drop_one_peer AND enough_peers
               THEN CASE WHEN gap > 0 THEN 'strength' ELSE 'gap' END ELSE 'not established' END AS verdict FROM r""")
def gap_report(spark, sf):
    """Monthly volume of every supplier against the others of its region."""
    return B.gap_report(_panel(spark, sf), ["n_regionkey"], "l_suppkey", "m", "qty")


@query("d18_own_trend", f"""WITH {_PANEL},
 s AS (SELECT n_regionkey, l_suppkey, avg(CASE WHEN m > {_LAST} - 12 THEN qty END) AS level, avg(CASE WHEN m > {_LAST} - 12 THEN m END) AS tm,
              regr_slope(qty, m) FILTER (m <= {_LAST} - 12) AS b, regr_intercept(qty, m) FILTER (m <= {_LAST} - 12) AS a, count(*) FILTER (m <= {_LAST} - 12) AS n FROM panel GROUP BY 1, 2)
SELECT n_regionkey, l_suppkey, round(level, 6) AS level, round(a + b * tm, 6) AS expected, round(level - (a + b * tm), 6) AS gap, round(CAST(n AS DOUBLE), 6) AS n_before FROM s""")
def own_trend(spark, sf):
    """The last twelve months of every supplier against its trend before."""
    return B.own_trend(_panel(spark, sf), ["n_regionkey"], "l_suppkey", "m", "qty")


@query("d18_regression_expected", f"""WITH {_PANEL},
 e AS (SELECT n_regionkey AS g, l_suppkey AS id, sum(qty) AS v, CAST(sum(n_lines) AS DOUBLE) AS c FROM panel GROUP BY 1, 2),
 o AS (SELECT a.g, a.id, any_value(a.v) AS v, any_value(a.c) AS c, regr_slope(b.v, b.c) AS b, regr_intercept(b.v, b.c) AS a, count(b.id) AS n
       FROM e a LEFT JOIN e b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2)
SELECT g AS n_regionkey, id AS l_suppkey, round(v, 6) AS level, CASE WHEN n > 2 THEN round(a + b * c, 6) END AS expected,
       CASE WHEN n > 2 THEN round(v - (a + b * c), 6) END AS gap FROM o""")
def regression_expected(spark, sf):
    """Volume that a supplier's number of lines lets expect, by the others of its region."""
    e = _panel(spark, sf).groupBy("n_regionkey", "l_suppkey").agg(F.sum("qty").alias("qty"), F.sum("n_lines").cast("double").alias("n_lines"))
    return B.regression_expected(e, ["n_regionkey"], "l_suppkey", "qty", "n_lines")
