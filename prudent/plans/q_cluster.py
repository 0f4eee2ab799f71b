"""Clustering and multivariate-outlier queries (K family) on customer
features derived from orders (count, mean value, account balance, urgent
share)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prudent.operators import cluster as K
from prudent.plans.q_series import seg_orders
from prudent.plans.registry import Tables, query

FEATURES = ["c_acctbal", "n_orders", "avg_value", "urgent_share"]


def customer_features(t: Tables):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("avg_value"),
        F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent_share"))
    c = t.customer.join(o, "c_custkey")
    return c.join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")), "c_nationkey")


_CF_SQL = """cf AS (SELECT c.c_custkey, c.c_mktsegment, c.c_acctbal, CAST(count(*) AS DOUBLE) AS n_orders,
                  avg(o.o_totalprice) AS avg_value,
                  avg(CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS urgent_share
           FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3)"""


@query("k01_prepare")
def prepare(spark, sf):
    return K.prepare(customer_features(Tables(spark, sf)), FEATURES, "robust").select("c_custkey", "features")


@query("k02_kmeans_sweep")
def kmeans_sweep(spark, sf):
    d = K.prepare(customer_features(Tables(spark, sf)), FEATURES)
    return K.kmeans_sweep(d, range(2, 11))


@query("k03_adjusted_rand", f"""WITH {_CF_SQL.replace('GROUP BY 1, 2, 3', 'GROUP BY 1, 2, 3').replace('cf AS', 'cf0 AS')},
 cf AS (SELECT cf0.*, n.n_regionkey FROM cf0 JOIN customer c USING (c_custkey) JOIN nation n ON c.c_nationkey = n.n_nationkey),
 ct AS (SELECT c_mktsegment, n_regionkey, count(*) AS nij FROM cf GROUP BY 1, 2),
 s AS (SELECT sum(nij * (nij - 1) / 2.0) AS sij, sum(nij) AS n FROM ct),
 a AS (SELECT sum(n * (n - 1) / 2.0) AS sa FROM (SELECT sum(nij) AS n FROM ct GROUP BY c_mktsegment)),
 b AS (SELECT sum(n * (n - 1) / 2.0) AS sb FROM (SELECT sum(nij) AS n FROM ct GROUP BY n_regionkey))
SELECT n, round((sij - sa * sb / (n * (n - 1) / 2.0)) / nullif((sa + sb) / 2.0 - sa * sb / (n * (n - 1) / 2.0), 0), 8) AS ari
FROM s, a, b""")
def adjusted_rand(spark, sf):
    r = K.adjusted_rand(customer_features(Tables(spark, sf)), "c_mktsegment", "n_regionkey")
    return r.withColumn("ari", F.round("ari", 8))


@query("k03_kmeans_stability")
def kmeans_stability(spark, sf):
    """Adjusted Rand index between k-means (k = 4) labelings from two seeds."""
    from pyspark.ml.clustering import KMeans
    d = K.prepare(customer_features(Tables(spark, sf)), FEATURES)
    a = KMeans(k=4, seed=1, predictionCol="la").fit(d).transform(d)
    b = KMeans(k=4, seed=2, predictionCol="lb").fit(a).transform(a)
    return K.adjusted_rand(b, "la", "lb")


@query("k04_hierarchical")
def hierarchical(spark, sf):
    d = K.prepare(customer_features(Tables(spark, sf)), FEATURES, center=False)
    return K.hierarchical(d, 4).groupBy("cluster").agg(F.count("*").alias("size"))


@query("k05_gmm_sweep")
def gmm(spark, sf):
    d = K.prepare(customer_features(Tables(spark, sf)), ["c_acctbal", "avg_value"])
    return K.gmm_sweep(d, range(2, 6))


@query("k07_kprototypes")
def kprototypes(spark, sf):
    c = customer_features(Tables(spark, sf))
    r = K.kprototypes(c, ["c_acctbal", "avg_value"], ["c_mktsegment"], 4)
    return r.groupBy("cluster").agg(F.count("*").alias("size"))


@query("k08_dtw_clusters")
def dtw(spark, sf):
    from prudent.operators import series as G
    t = Tables(spark, sf)
    s = G.regularize(seg_orders(t), ["c_nationkey"], "o_orderdate", "o_totalprice", "week", 0.0)
    s = s.groupBy("c_nationkey", (F.col("t") / 4).cast("bigint").alias("t")).agg(F.sum("y").alias("y"))
    return K.dtw_kmeans(s, "c_nationkey", k=3, band=3)


@query("k09_characterise", f"""WITH {_CF_SQL},
 pop AS (SELECT """ + ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in FEATURES) + f""", count(*) AS n FROM cf),
 g AS (SELECT c_mktsegment, count(*) AS size, """ + ", ".join(f"avg({f}) AS c_{f}" for f in FEATURES) + """ FROM cf GROUP BY 1)
SELECT c_mktsegment, size, round(size / n, 6) AS share, """ + ", ".join(
    f"round(c_{f}, 6) AS centroid_{f}, round((c_{f} - m_{f}) / nullif(s_{f}, 0), 6) AS effect_{f}" for f in FEATURES) + """,
       size / n < 0.05 AS tiny
FROM g, pop""")
def characterise(spark, sf):
    c = K.characterise(customer_features(Tables(spark, sf)), "c_mktsegment", FEATURES)
    return c.select("c_mktsegment", "size", F.round("share", 6).alias("share"),
                    *[F.round(x, 6).alias(x) for f in FEATURES for x in (f"centroid_{f}", f"effect_{f}")], "tiny")


@query("k10_mahalanobis")
def mahalanobis(spark, sf):
    c = customer_features(Tables(spark, sf))
    return K.mahalanobis(c, FEATURES).where("is_outlier").select("c_custkey", "d2", "threshold")


@query("k11_isolation_forest")
def iforest(spark, sf):
    c = customer_features(Tables(spark, sf))
    return K.isolation_forest(c, FEATURES, "c_custkey", trees=200, sample=256, share=0.05)


@query("k12_conditional_outliers", """
WITH j AS (SELECT o.o_orderkey, c.c_mktsegment, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
 s AS (SELECT *, (o_totalprice - avg(o_totalprice) OVER w) / nullif(stddev_samp(o_totalprice) OVER w, 0) AS score FROM j
       WINDOW w AS (PARTITION BY c_mktsegment))
SELECT o_orderkey, c_mktsegment, round(score, 6) AS score FROM s WHERE abs(score) > 2.5""")
def conditional(spark, sf):
    o = seg_orders(Tables(spark, sf))
    d = K.conditional_outliers(o, "o_totalprice", ["c_mktsegment"], 2.5)
    return d.where("is_outlier").select("o_orderkey", "c_mktsegment", F.round("score", 6).alias("score"))


@query("k12_model_residuals", """
WITH j AS (SELECT o.o_orderkey, c.c_mktsegment AS g, o.o_totalprice AS y, CAST(n AS DOUBLE) AS x FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
           JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey),
 m AS (SELECT g, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, avg(x) AS mx, var_pop(x) * count(*) AS sxx FROM j GROUP BY 1),
 e AS (SELECT j.*, n, y - a - b * x AS e, 1.0 / n + (x - mx) * (x - mx) / sxx AS h FROM j JOIN m USING (g)),
 s AS (SELECT g, sum(e * e) / (count(*) - 2) AS v FROM e GROUP BY 1)
SELECT o_orderkey, g AS c_mktsegment, round(e / sqrt(v * (1 - h)), 6) AS score FROM e JOIN s USING (g) WHERE abs(e / sqrt(v * (1 - h))) > 1.5""")
def model_residuals(spark, sf):
    """Orders whose price their number of lines doesn't explain, within a segment."""
    t = Tables(spark, sf)
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("n_lines"))
    d = K.model_outliers(seg_orders(t).join(lines, "o_orderkey"), "o_totalprice", "n_lines", ["c_mktsegment"], 1.5)
    return d.where("is_outlier").select("o_orderkey", "c_mktsegment", F.round("score", 6).alias("score"))


@query("k13_pca")
def pca(spark, sf):
    d = K.prepare(customer_features(Tables(spark, sf)), FEATURES)
    return K.pca(d, 3)
