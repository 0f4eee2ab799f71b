"""Profiling and data-quality queries (Q family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prudent.functions import scalar as S
from prudent.operators import profile as Q
from prudent.operators import relational as R
from prudent.operators.relational import canonical_dtype
from prudent.plans.q_window import NATION_WEEKLY_SQL, nation_weekly
from prudent.plans.registry import Tables, query

_LINEITEM_COLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
                  ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
                  ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"),
                  ("l_shipdate", "timestamp_ntz")]


def _profile_sql(tab: str, cols) -> str:
    parts = []
    for i, (c, t) in enumerate(cols, start=1):
        v = f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END" if t == "double" else c
        parts.append(f"SELECT {i} AS ordinal, '{c}' AS column_name, '{canonical_dtype(t)}' AS dtype, "
                     f"count_if(({v}) IS NULL) AS null_count, count(DISTINCT {v}) AS distinct_count FROM {tab}")
    return " UNION ALL ".join(parts)


@query("q01_profile", _profile_sql("lineitem", _LINEITEM_COLS))
def profile(spark, sf):
    return Q.profile(Tables(spark, sf).lineitem)


@query("q01_profile_approx")
def profile_approx(spark, sf):
    """Scale variant: HyperLogLog distinct counts (rsd 1%) in the same single scan."""
    return Q.profile(Tables(spark, sf).lineitem, approx=True)


@query("q02_profile_sample")
def profile_sample(spark, sf):
    return Q.profile_sample(Tables(spark, sf).orders, 500, seed=42)


def _joined_parts(t: Tables):
    p = t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return t.lineitem.join(p, "l_partkey", "left").withColumn("yr", F.year("l_shipdate"))


@query("q03_completeness", """
WITH j AS (SELECT year(l_shipdate) AS yr, p.p_brand FROM lineitem l
           LEFT JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size > 10),
 o AS (SELECT avg(CASE WHEN p_brand IS NULL THEN 1.0 ELSE 0.0 END) AS overall FROM j)
SELECT yr, count(*) AS n, count_if(p_brand IS NULL) AS n_null,
       round(count_if(p_brand IS NULL) / nullif(count(*), 0), 6) AS null_share,
       round((SELECT overall FROM o), 6) AS overall_share,
       round(round(count_if(p_brand IS NULL) / nullif(count(*), 0), 6) - round((SELECT overall FROM o), 6), 6) AS excess
FROM j GROUP BY yr""")
def completeness(spark, sf):
    return Q.completeness(_joined_parts(Tables(spark, sf)), "p_brand", "yr")


@query("q04_freshness", """
WITH d AS (SELECT DISTINCT o_orderpriority, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F'),
 g AS (SELECT *, d - lag(d) OVER (PARTITION BY o_orderpriority ORDER BY d) AS gap FROM d),
 a AS (SELECT o_orderpriority, max(d) AS latest, quantile_cont(gap, 0.5) AS cadence_days FROM g GROUP BY 1)
SELECT *, (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderstatus = 'F') - latest AS days_stale,
       (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderstatus = 'F') - latest > 2 * cadence_days AS is_stale
FROM a""")
def freshness(spark, sf):
    o = Tables(spark, sf).orders.where("o_orderstatus = 'F'")
    return Q.freshness(o, "o_orderdate", ["o_orderpriority"])


@query("q05_grain_check", """
SELECT sum(c) AS n_rows, count(*) AS n_keys, sum(c) - count(*) AS n_duplicates, count_if(c > 1) AS n_dup_keys
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def grain_check(spark, sf):
    return Q.grain_check(Tables(spark, sf).lineitem, ["l_orderkey", "l_linenumber"])


_METRICS = ["l_quantity", "l_extendedprice", "l_discount"]


def _dist_sql(by: str, metrics: list[str], extra_cols: str = "") -> str:
    parts = []
    for m in metrics:
        parts.append(f"""SELECT {by}, '{m}' AS metric, x FROM (SELECT {by}, CAST({m} AS DOUBLE) AS x FROM lineitem)
                         WHERE x IS NOT NULL AND NOT isnan(x)""")
    long = " UNION ALL ".join(parts)
    return f"""WITH long AS ({long}),
 st AS (SELECT {by}, metric, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd,
               (avg(x*x*x) - 3 * avg(x) * avg(x*x) + 2 * pow(avg(x), 3)) / pow(var_pop(x), 1.5) AS skewness,
               kurtosis_pop(x) AS kurtosis,
               quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS median,
               quantile_cont(x, 0.75) AS p75, quantile_cont(x, 0.95) AS p95 FROM long GROUP BY 1, 2),
 mad AS (SELECT l.{by}, l.metric, quantile_cont(abs(l.x - st.median), 0.5) AS mad
         FROM long l JOIN st ON l.{by} = st.{by} AND l.metric = st.metric GROUP BY 1, 2),
 d AS (SELECT st.*, mad.mad, p75 - p25 AS iqr FROM st JOIN mad ON st.{by} = mad.{by} AND st.metric = mad.metric)"""


_DIST_COLS = ["n", "mean", "sd", "skewness", "kurtosis", "p5", "p25", "median", "p75", "p95", "mad", "iqr"]


def _round_dist(d, keys):
    return d.select(*keys, "n", *[F.round(c, 6).alias(c) for c in _DIST_COLS if c != "n"])


@query("q06_distribution", _dist_sql("l_returnflag", _METRICS) + """
SELECT l_returnflag, metric, n, """ + ", ".join(f"round({c}, 6) AS {c}" for c in _DIST_COLS if c != "n") + " FROM d")
def distribution(spark, sf):
    d = Q.distribution(Tables(spark, sf).lineitem, _METRICS, by=["l_returnflag"])
    return _round_dist(d, ["l_returnflag", "metric"])


@query("q06_distribution_approx")
def distribution_approx(spark, sf):
    """Scale variant: sketch quantiles (percentile_approx, accuracy 10000)."""
    d = Q.distribution(Tables(spark, sf).lineitem, _METRICS, by=["l_returnflag"], approx=True)
    return _round_dist(d, ["l_returnflag", "metric"])


_SHAPE_SQL = """CASE WHEN n < 4 THEN 'other' WHEN bc > 0.555 THEN 'bimodal'
            WHEN abs(skewness) < 0.5 AND abs(kurtosis) < 1 THEN 'normal'
            WHEN abs(skewness) >= 0.5 AND kurtosis >= 3 THEN 'long_tail'
            WHEN skewness >= 0.5 THEN 'right_skewed' WHEN skewness <= -0.5 THEN 'left_skewed' ELSE 'other' END"""


@query("q07_shape", _dist_sql("l_returnflag", _METRICS) + f""",
 b AS (SELECT *, (skewness * skewness + 1) / nullif(kurtosis + 3.0 * (n - 1) * (n - 1) / nullif((n - 2) * (n - 3), 0), 0) AS bc
       FROM d)
SELECT l_returnflag, metric, round(bc, 6) AS bimodality, {_SHAPE_SQL} AS shape,
       ({_SHAPE_SQL}) <> 'normal' AS use_resistant_statistics
FROM b""")
def shape(spark, sf):
    d = Q.shape(Q.distribution(Tables(spark, sf).lineitem, _METRICS, by=["l_returnflag"]))
    return d.select("l_returnflag", "metric", "bimodality", "shape", "use_resistant_statistics")


@query("q08_outliers", """
WITH x AS (SELECT o_orderkey, o_totalprice AS v FROM orders),
 st AS (SELECT count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd, quantile_cont(v, 0.5) AS median,
               (avg(v*v*v) - 3 * avg(v) * avg(v*v) + 2 * pow(avg(v), 3)) / pow(var_pop(v), 1.5) AS skewness,
               kurtosis_pop(v) AS kurtosis FROM x),
 m AS (SELECT quantile_cont(abs(v - (SELECT median FROM st)), 0.5) AS mad FROM x),
 s AS (SELECT st.*, m.mad, (skewness * skewness + 1) / nullif(kurtosis + 3.0 * (n - 1) * (n - 1) / nullif((n - 2) * (n - 3), 0), 0) AS bc
       FROM st, m),
 c AS (SELECT s.*, """ + _SHAPE_SQL + """ AS shape FROM s),
 sc AS (SELECT x.o_orderkey, x.v AS value,
               CASE WHEN c.shape = 'normal' THEN (x.v - c.mean) / nullif(c.sd, 0)
                    ELSE 0.6745 * (x.v - c.median) / nullif(c.mad, 0) END AS score,
               CASE WHEN c.shape = 'normal' THEN abs((x.v - c.mean) / nullif(c.sd, 0)) > 3
                    ELSE c.mad > 0 AND abs(0.6745 * (x.v - c.median) / nullif(c.mad, 0)) > 3.5 END AS is_outlier,
               CASE WHEN c.shape = 'normal' THEN 'z' ELSE 'modified_z' END AS method
        FROM x, c)
SELECT o_orderkey, value, round(score, 6) AS score, is_outlier, method FROM sc WHERE is_outlier""")
def outliers(spark, sf):
    o = Tables(spark, sf).orders
    return Q.outliers(o, "o_orderkey", "o_totalprice")


@query("q09_tail_flag", """
SELECT count_if(o_totalprice > (SELECT quantile_cont(o_totalprice, 0.995) FROM orders)) AS n_tail,
       min(CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.995) FROM orders) THEN o_totalprice END)
         AS min_tail_value
FROM orders""")
def tail_flag(spark, sf):
    o = Tables(spark, sf).orders
    f = Q.tail_flag(o, "o_totalprice", 0.995)
    return o.agg(F.count_if(f).alias("n_tail"), F.min(F.when(f, F.col("o_totalprice"))).alias("min_tail_value"))


@query("q10_baselines", f"""
WITH {NATION_WEEKLY_SQL},
 r AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY qty, s_nationkey) AS rn FROM nw),
 pm AS (SELECT a.s_nationkey, a.week, quantile_cont(b.qty, 0.5) AS peer_median
        FROM nw a LEFT JOIN nw b ON a.week = b.week AND a.s_nationkey <> b.s_nationkey GROUP BY 1, 2)
SELECT a.s_nationkey, a.week, a.qty,
       round(avg(a.qty) OVER (PARTITION BY a.s_nationkey ORDER BY a.week ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING), 6)
         AS trail13_mean,
       y.qty AS qty_prior_year, round(pm.peer_median, 6) AS peer_median
FROM nw a LEFT JOIN nw y ON y.s_nationkey = a.s_nationkey AND y.week = a.week - INTERVAL 364 DAY
JOIN pm ON pm.s_nationkey = a.s_nationkey AND pm.week = a.week""")
def baselines(spark, sf):
    nw = nation_weekly(Tables(spark, sf))
    d = R.trailing(nw, ["s_nationkey"], "week", "qty", 13, "mean")
    y = nw.select("s_nationkey", F.date_add("week", 364).alias("week"), F.col("qty").alias("qty_prior_year"))
    d = d.join(y, ["s_nationkey", "week"], "left")
    d = R.peer_median(d, ["week"], "s_nationkey", "qty")
    return d.select("s_nationkey", "week", "qty", F.round("trail13_mean", 6).alias("trail13_mean"), "qty_prior_year",
                    F.round("peer_median", 6).alias("peer_median"))


@query("q11_trimmed_mean", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS lo, quantile_cont(l_extendedprice, 0.9) AS hi
           FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, round(avg(CASE WHEN l_extendedprice BETWEEN lo AND hi THEN l_extendedprice END), 6) AS trimmed_mean,
       count_if(l_extendedprice BETWEEN lo AND hi) AS n_kept, count(*) AS n
FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag GROUP BY 1""")
def trimmed(spark, sf):
    d = Q.trimmed_mean(Tables(spark, sf).lineitem, "l_extendedprice", ["l_returnflag"], 0.1)
    return d.withColumn("trimmed_mean", F.round("trimmed_mean", 6))


@query("q11_rare_levels", """
SELECT p_name, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share,
       round(count(*) / (SELECT count(*) FROM part), 6) < 0.01 AS is_rare
FROM part GROUP BY p_name""")
def rare(spark, sf):
    return Q.rare_levels(Tables(spark, sf).part, "p_name", 0.01).withColumn("is_rare", F.col("share") < 0.01)


_RULES = {
    "discount_in_range": "l_discount BETWEEN 0 AND 0.1",
    "quantity_positive": "l_quantity > 0",
    "tax_non_negative": "l_tax >= 0",
    "flag_domain": "l_returnflag IN ('A', 'N', 'R')",
    "price_at_least_quantity": "l_extendedprice >= l_quantity",
    "shipdate_present": "l_shipdate IS NOT NULL",
}


@query("q12_invariants", " UNION ALL ".join(
    f"SELECT '{k}' AS rule, count_if(NOT coalesce({v}, false)) AS n_violations, count(*) AS n_rows FROM lineitem"
    for k, v in _RULES.items()))
def invariants(spark, sf):
    return Q.check(Tables(spark, sf).lineitem, _RULES)


_SENT_COLS = ["l_quantity", "l_extendedprice", "l_suppkey", "l_partkey"]


@query("q13_sentinels", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count_if({c} IN (-9999, 9999, -999, 999999)) AS n_sentinel, "
    f"round(count_if({c} IN (-9999, 9999, -999, 999999)) / count(*), 6) AS share FROM lineitem" for c in _SENT_COLS))
def sentinels(spark, sf):
    return Q.sentinels(Tables(spark, sf).lineitem, _SENT_COLS)


@query("q14_readiness")
def readiness(spark, sf):
    """READY / READY_WITH_CAVEATS / INSUFFICIENT for orders from its profile,
    grain check on the order key and freshness."""
    o = Tables(spark, sf).orders
    p = Q.profile(o).agg(F.max("null_count").alias("max_nulls"))
    g = Q.grain_check(o, ["o_orderkey"])
    f = Q.freshness(o, "o_orderdate", []).select("days_stale", "cadence_days")
    n = o.select(F.count("*")).scalar()
    row = p.select(S.safe_div(F.col("max_nulls"), n).alias("null_rate")) \
        .withColumn("dup_share", S.safe_div(g.select("n_duplicates").scalar(), n)) \
        .withColumn("days_stale", f.select("days_stale").scalar()) \
        .withColumn("cadence_days", f.select("cadence_days").scalar())
    return row.withColumn("readiness", Q.readiness(F.col("null_rate"), F.col("dup_share"), F.col("days_stale"),
                                                   F.col("cadence_days")))


@query("q16_schema_diff")
def schema_diff(spark, sf):
    """Drift between lineitem as stored and the same table after the
    logical-type cast (retyped columns show up as 'retyped')."""
    a = Tables(spark, sf).lineitem
    b = R.cast_schema(a, {"l_linenumber": "integer", "l_quantity": "float"}).drop("l_tax") \
        .withColumn("l_note", F.lit(None).cast("string"))
    return Q.schema_diff(a, b)
