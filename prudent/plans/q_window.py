"""Window, top-k, sampling and set-operation queries (W, T, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prudent.functions import scalar as S
from prudent.operators import relational as R
from prudent.plans.registry import Tables, query


def nation_weekly(t: Tables):
    """Weekly quantity per supplier nation (the series used by W03-W06)."""
    j = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return j.groupBy("s_nationkey", S.week_start("l_shipdate").alias("week")).agg(F.sum("l_quantity").alias("qty"))


NATION_WEEKLY_SQL = """nw AS (
  SELECT s.s_nationkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS qty
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2)"""


@query("w02_pct_of_total", """
WITH g AS (SELECT r.r_name, n.n_name, sum(l_quantity) AS qty FROM lineitem l
           JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
           JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2)
SELECT r_name, n_name, qty, round(qty * 100.0 / sum(qty) OVER (PARTITION BY r_name), 4) AS pct_in_region,
       round(qty * 100.0 / (SELECT sum(qty) FROM g), 4) AS pct_of_all
FROM g""")
def pct_total(spark, sf):
    t = Tables(spark, sf)
    j = (t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
         .join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")),
               "s_nationkey")
         .join(F.broadcast(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")), "n_regionkey"))
    g = j.groupBy("r_name", "n_name").agg(F.sum("l_quantity").alias("qty"))
    g = R.pct_of_total(g, "qty", within=["r_name"], out="pct_in_region")
    return R.pct_of_total(g, "qty", out="pct_of_all")


@query("w03_trailing", f"""
WITH {NATION_WEEKLY_SQL}
SELECT s_nationkey, week, qty,
       round(avg(qty) OVER (PARTITION BY s_nationkey ORDER BY week ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING), 6)
         AS trail13_mean,
       round(quantile_cont(qty, 0.5) OVER (PARTITION BY s_nationkey ORDER BY week
                                           ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS trail4_median
FROM nw""")
def trailing(spark, sf):
    nw = nation_weekly(Tables(spark, sf))
    d = R.trailing(nw, ["s_nationkey"], "week", "qty", 13, "mean")
    d = R.trailing(d, ["s_nationkey"], "week", "qty", 4, "median")
    return d.select("s_nationkey", "week", "qty", F.round("trail13_mean", 6).alias("trail13_mean"),
                    F.round("trail4_median", 6).alias("trail4_median"))


@query("w04_period_change", """
WITH m AS (SELECT s.s_nationkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS qty
           FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
 r AS (SELECT *, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY month DESC) AS rk FROM m)
SELECT s_nationkey, sum(CASE WHEN rk <= 6 THEN qty END) AS last_k, sum(CASE WHEN rk > 6 THEN qty END) AS prev_k,
       round((sum(CASE WHEN rk <= 6 THEN qty END) - sum(CASE WHEN rk > 6 THEN qty END))
             / nullif(abs(sum(CASE WHEN rk > 6 THEN qty END)), 0), 6) AS rel_change
FROM r WHERE rk <= 12 GROUP BY s_nationkey""")
def period_change(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    m = j.groupBy("s_nationkey", F.to_date(F.date_trunc("MONTH", "l_shipdate")).alias("month")) \
        .agg(F.sum("l_quantity").alias("qty"))
    return R.period_change(m, ["s_nationkey"], "month", "qty", 6)


@query("w05_hampel", f"""
WITH {NATION_WEEKLY_SQL},
 r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY week) AS rn,
              quantile_cont(qty, 0.5) OVER (PARTITION BY s_nationkey ORDER BY week
                                            ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS roll_median FROM nw),
 m AS (SELECT a.s_nationkey, a.week, quantile_cont(abs(b.qty - a.roll_median), 0.5) AS roll_mad
       FROM r a JOIN r b ON a.s_nationkey = b.s_nationkey AND b.rn BETWEEN a.rn - 3 AND a.rn + 3
       GROUP BY a.s_nationkey, a.week)
SELECT r.s_nationkey, r.week, r.qty, round(r.roll_median, 6) AS roll_median, round(m.roll_mad, 6) AS roll_mad,
       m.roll_mad > 0 AND abs(r.qty - r.roll_median) > 3.0 * 1.4826 * m.roll_mad AS is_outlier
FROM r JOIN m ON r.s_nationkey = m.s_nationkey AND r.week = m.week""")
def hampel(spark, sf):
    d = R.hampel(nation_weekly(Tables(spark, sf)), ["s_nationkey"], "week", "qty", 3, 3.0)
    return d.select("s_nationkey", "week", "qty", F.round("roll_median", 6).alias("roll_median"),
                    F.round("roll_mad", 6).alias("roll_mad"), "is_outlier")


@query("w06_diff_z", f"""
WITH {NATION_WEEKLY_SQL},
 d AS (SELECT *, qty - lag(qty) OVER (PARTITION BY s_nationkey ORDER BY week) AS diff FROM nw)
SELECT s_nationkey, week, diff,
       round((diff - avg(diff) OVER (PARTITION BY s_nationkey)) / nullif(stddev_samp(diff) OVER (PARTITION BY s_nationkey), 0), 6) AS diff_z
FROM d""")
def diff_z(spark, sf):
    d = R.diff_z(nation_weekly(Tables(spark, sf)), ["s_nationkey"], "week", "qty")
    return d.select("s_nationkey", "week", "diff", F.round("diff_z", 6).alias("diff_z"))


@query("w07_peer_rank", """
WITH s AS (SELECT s.s_nationkey, l.l_suppkey, sum(l_quantity) AS qty FROM lineitem l
           JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2)
SELECT s_nationkey, l_suppkey, qty,
       round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY qty, l_suppkey), 6) AS pct_rank,
       ntile(4) OVER (PARTITION BY s_nationkey ORDER BY qty, l_suppkey) AS quartile,
       ntile(10) OVER (PARTITION BY s_nationkey ORDER BY qty, l_suppkey) AS decile
FROM s""")
def peer_rank(spark, sf):
    t = Tables(spark, sf)
    s = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey") \
        .groupBy("s_nationkey", "l_suppkey").agg(F.sum("l_quantity").alias("qty"))
    d = R.peer_rank(s, ["s_nationkey"], "qty", ["l_suppkey"])
    return d.withColumn("pct_rank", F.round("pct_rank", 6))


@query("w08_running_cap", """
WITH c AS (SELECT conv_id, turn,
                  CAST(floor((CASE WHEN trim(text) = '' THEN 0
                                   ELSE len(regexp_split_to_array(trim(text), '\\s+')) END) * 1.3) AS BIGINT) AS tokens
           FROM conversations),
 r AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
       FROM c)
SELECT conv_id, max(run) AS total,
       min(CASE WHEN run >= 0.5 * 400 THEN turn END) AS first_at_50,
       min(CASE WHEN run >= 0.75 * 400 THEN turn END) AS first_at_75,
       min(CASE WHEN run >= 0.9 * 400 THEN turn END) AS first_at_90,
       min(CASE WHEN run > 400 THEN turn END) AS first_over_cap
FROM r GROUP BY conv_id""")
def running_cap(spark, sf):
    c = Tables(spark, sf).conversations.withColumn("tokens", S.token_estimate("text"))
    return R.running_cap(c, ["conv_id"], ["turn"], "tokens", 400.0)


def segment_weekly(t: Tables):
    """Weekly order counts and value per customer segment, integer week index."""
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    wk = S.week_start("o_orderdate")
    return o.groupBy("c_mktsegment", wk.alias("week")).agg(
        F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("value")) \
        .withColumn("t", (F.unix_date("week") / 7).cast("bigint"))


SEGMENT_WEEKLY_SQL = """sw AS (
  SELECT c.c_mktsegment, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n_orders,
         sum(o_totalprice) AS value,
         CAST(floor((CAST(date_trunc('week', o_orderdate) AS DATE) - DATE '1970-01-01') / 7) AS BIGINT) AS t
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)"""


@query("w09_acf", f"""
WITH {SEGMENT_WEEKLY_SQL},
 mu AS (SELECT c_mktsegment, avg(n_orders) AS m FROM sw GROUP BY 1),
 d AS (SELECT sw.c_mktsegment, t, n_orders - m AS dv FROM sw JOIN mu USING (c_mktsegment)),
 den AS (SELECT c_mktsegment, sum(dv * dv) AS ss FROM d GROUP BY 1),
 lags AS (SELECT unnest(range(1, 9)) AS lag),
 num AS (SELECT a.c_mktsegment, lags.lag, sum(a.dv * b.dv) AS cov FROM d a CROSS JOIN lags
         JOIN d b ON a.c_mktsegment = b.c_mktsegment AND b.t = a.t + lags.lag GROUP BY 1, 2)
SELECT num.c_mktsegment, lag, round(cov / nullif(ss, 0), 6) AS acf FROM num JOIN den USING (c_mktsegment)""")
def acf(spark, sf):
    sw = segment_weekly(Tables(spark, sf))
    return R.acf(sw, ["c_mktsegment"], "t", "n_orders", 8)


@query("w10_cross_corr", f"""
WITH {SEGMENT_WEEKLY_SQL},
 lags AS (SELECT unnest(range(-3, 4)) AS lag),
 r AS (SELECT a.c_mktsegment, lags.lag, corr(a.n_orders, b.value) AS r
       FROM sw a CROSS JOIN lags JOIN sw b ON a.c_mktsegment = b.c_mktsegment AND b.t = a.t + lags.lag
       GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(r) DESC, abs(lag) ASC, lag ASC) AS rn
       FROM r)
SELECT c_mktsegment, lag AS best_lag, round(r, 6) AS best_r FROM k WHERE rn = 1""")
def cross_corr(spark, sf):
    sw = segment_weekly(Tables(spark, sf))
    return R.cross_corr(sw, ["c_mktsegment"], "t", "n_orders", "value", 3)


@query("w11_cohort_index", """
WITH o AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period FROM orders),
 c AS (SELECT o_custkey, period, min(period) OVER (PARTITION BY o_custkey) AS cohort FROM o)
SELECT cohort, CAST(datediff('month', cohort, period) / 3 AS INTEGER) AS age, count(*) AS n_orders,
       count(DISTINCT o_custkey) AS n_customers
FROM c GROUP BY 1, 2""")
def cohort_index(spark, sf):
    o = Tables(spark, sf).orders
    c = R.cohort_index(o, "o_custkey", "o_orderdate", "quarter")
    return c.groupBy("cohort", "age").agg(F.count("*").alias("n_orders"),
                                          F.count_distinct("o_custkey").alias("n_customers"))


@query("w12_runs", """
WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus,
                  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
                  - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS grp
           FROM orders),
 runs AS (SELECT o_custkey, o_orderstatus, grp, count(*) AS run_length FROM o GROUP BY 1, 2, 3)
SELECT o_orderstatus, run_length, count(*) AS n_runs FROM runs GROUP BY 1, 2""")
def runs(spark, sf):
    o = Tables(spark, sf).orders
    r = R.runs(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus")
    return r.groupBy("o_orderstatus", "run_length").agg(F.count("*").alias("n_runs"))


@query("w13_latest_run", """
SELECT max(o_orderpriority) AS latest_run FROM orders WHERE o_orderstatus = 'F'""")
def latest_run(spark, sf):
    return Tables(spark, sf).orders.where("o_orderstatus = 'F'").agg(F.max("o_orderpriority").alias("latest_run"))


@query("w14_avg_rank", """
WITH c AS (SELECT l_returnflag, l_extendedprice, count(*) AS ties FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_extendedprice,
       coalesce(sum(ties) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (ties + 1) / 2.0 AS rank,
       ties
FROM c""")
def avg_rank(spark, sf):
    li = Tables(spark, sf).lineitem
    return R.avg_rank(li, "l_extendedprice", ["l_returnflag"])


# -- T: top-k, sampling ----------------------------------------------------
@query("t06_top_k_per", """
WITH s AS (SELECT p.p_brand, l.l_partkey, sum(l_quantity) AS qty FROM lineitem l
           JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY qty DESC, l_partkey ASC) AS rank FROM s)
SELECT * FROM r WHERE rank <= 3""")
def top_k_per(spark, sf):
    t = Tables(spark, sf)
    s = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey") \
        .groupBy("p_brand", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return R.top_k_per(s, ["p_brand"], [F.col("qty").desc(), F.col("l_partkey").asc()], 3)


@query("t07_cap_candidates", """
WITH s AS (SELECT r.r_name, n.n_name, round(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END)
                                            / nullif(sum(l_quantity), 0), 6) AS rate
           FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
           JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY r_name ORDER BY rate ASC, n_name ASC) AS rank FROM s)
SELECT *, rank > 3 AS overflow FROM k""")
def cap_candidates(spark, sf):
    t = Tables(spark, sf)
    j = (t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
         .join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")),
               "s_nationkey")
         .join(F.broadcast(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")), "n_regionkey"))
    ok = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)
    s = j.groupBy("r_name", "n_name").agg(F.round(R.ratio(ok, "l_quantity"), 6).alias("rate"))
    return R.cap_candidates(s, ["r_name"], [F.col("rate").asc(), F.col("n_name").asc()], 3)


@query("t03_guard_rows")
def guard_rows(spark, sf):
    """Exact-n seeded sample of lineitem when it exceeds the threshold
    (threshold = 1% of the table, so the sampling path always runs)."""
    li = Tables(spark, sf).lineitem
    n = li.count()
    out, warnings = R.guard_rows(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                                 max(1, n // 100), seed=42, auto_sample=True)
    return out.withColumn("warning", F.lit("; ".join(f"{level}: {text}" for level, text in warnings)))


@query("t05_sample_rows")
def sample_rows(spark, sf):
    return R.sample_rows(Tables(spark, sf).orders, 500, seed=7, key=["o_orderkey"])


# -- U: dedup and set operations -------------------------------------------
@query("u03_dedup_first", """
SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id""")
def dedup_first(spark, sf):
    return R.dedup_first(Tables(spark, sf).events, "user_id", "event_id")


@query("u04_dedup_grain", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                        ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity,
                                                 l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem)
SELECT l_linestatus, count(*) AS n_rows, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS value
FROM r WHERE rn = 1 GROUP BY l_linestatus""")
def dedup_grain(spark, sf):
    li = Tables(spark, sf).lineitem
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                                "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    d = R.best_row(li, ["l_orderkey", "l_linenumber"], order)
    return d.groupBy("l_linestatus").agg(F.count("*").alias("n_rows"), F.sum("l_quantity").alias("qty"),
                                         F.round(F.sum("l_extendedprice"), 2).alias("value"))


@query("u05_churn", """
WITH s AS (SELECT l_partkey, CAST(min(l_shipdate) AS DATE) AS first_seen, CAST(max(l_shipdate) AS DATE) AS last_seen
           FROM lineitem GROUP BY 1)
SELECT CASE WHEN first_seen > DATE '1995-06-30' THEN 'appeared' WHEN last_seen < DATE '2001-06-30' THEN 'vanished'
            ELSE 'present' END AS status, count(*) AS n_entities
FROM s GROUP BY 1""")
def churn(spark, sf):
    li = Tables(spark, sf).lineitem.withColumn("d", F.to_date("l_shipdate"))
    c = R.churn(li, "l_partkey", "d", F.lit("1995-06-30").cast("date"), F.lit("2001-06-30").cast("date"))
    return c.groupBy("status").agg(F.count("*").alias("n_entities"))
