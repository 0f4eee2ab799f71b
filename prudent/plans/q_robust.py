"""Queries of robust scatter and density clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from prudent.operators import robust as B
from prudent.plans.q_cluster import FEATURES, customer_features
from prudent.plans.registry import Tables, query

K = 8
_POINTS = """p AS (SELECT c.c_custkey AS id, c.c_acctbal / 1000.0 AS a, avg(o.o_totalprice) / 50000.0 AS b
  FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, c.c_acctbal)"""


def _points(spark, sf):
    c = customer_features(Tables(spark, sf))
    return c.select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("a"), (F.col("avg_value") / 50000.0).alias("b"))


_KD = f"""WITH {_POINTS},
 d AS (SELECT x.id, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) AS d FROM p x JOIN p y ON x.id <> y.id),
 k AS (SELECT id, list_sort(list(d))[{K}] AS k_dist FROM d GROUP BY 1)"""


@query("k06_k_distance", _KD + " SELECT p.id AS c_custkey, round(k_dist, 6) AS k_dist FROM p LEFT JOIN k USING (id)")
def k_distance(spark, sf):
    """Distance of every customer to the eighth nearest in balance and order value."""
    d = B.k_distance(_points(spark, sf), "c_custkey", ["a", "b"], K)
    return d.withColumn("k_dist", F.round("k_dist", 6))


@query("k06_k_distance_knee", _KD + """,
 r AS (SELECT k_dist AS v, rank() OVER (ORDER BY k_dist) + (count(*) OVER (PARTITION BY k_dist) - 1) / 2.0 AS rk FROM k),
 e AS (SELECT min(v) AS lo, max(v) AS hi, min(rk) AS first, max(rk) AS last, count(*) AS n FROM r),
 b AS (SELECT v, rk, n, (rk - first) / (last - first) - (v - lo) / (hi - lo) AS below FROM r, e)
SELECT round(v, 6) AS eps, CAST(rk AS DOUBLE) AS rank, n FROM b ORDER BY below DESC, rk LIMIT 1""")
def k_distance_knee(spark, sf):
    """The radius that the curve of these distances suggests: its knee."""
    k = B.knee(B.k_distance(_points(spark, sf), "c_custkey", ["a", "b"], K))
    return k.select(F.round("eps", 6).alias("eps"), F.col("rank").cast("double").alias("rank"), "n")


@query("k06_dbscan_knee")
def dbscan_knee(spark, sf):
    """Density clusters at that radius."""
    p = _points(spark, sf)
    eps = B.knee(B.k_distance(p, "c_custkey", ["a", "b"], K)).first()
    lab = B.density_clusters(p, "c_custkey", ["a", "b"], eps["eps"], K) if eps else p.select("c_custkey", F.lit(None).alias("cluster"), F.lit("noise").alias("kind"))
    return lab.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("n_clusters"))


@query("k10_robust_scatter")
def robust_scatter(spark, sf):
    """Customers far from the robust centre, from fifty random starts."""
    return B.robust_scatter(customer_features(Tables(spark, sf)), FEATURES).where("is_outlier").select("c_custkey", "d2", "threshold")
