"""Time-series queries (G family) on weekly order series per customer
segment (period 52, ~6 yearly cycles) and weekly quantity per supplier
nation; cohorts of customers by first-order quarter."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prudent.operators import relational as R
from prudent.operators import series as G
from prudent.operators import stats as X
from prudent.plans.registry import Tables, query

PERIOD = 52


def seg_orders(t: Tables):
    return t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"),
                         "o_custkey")


def seg_series(t: Tables):
    """G01 on orders: weekly order counts per segment, gaps filled with 0."""
    return G.regularize(seg_orders(t), ["c_mktsegment"], "o_orderdate", "o_orderkey", "week", 0.0, "count") \
        .withColumn("y", F.col("y").cast("double"))


SEG_SQL = """so AS (SELECT c.c_mktsegment, CAST(date_trunc('week', o_orderdate) AS DATE) AS period, count(o_orderkey) AS y
            FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2),
 span AS (SELECT c_mktsegment, min(period) AS lo, max(period) AS hi FROM so GROUP BY 1),
 cal AS (SELECT c_mktsegment, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS period FROM span),
 ss AS (SELECT cal.c_mktsegment, cal.period, CAST(coalesce(so.y, 0) AS DOUBLE) AS y,
               CAST(floor((cal.period - DATE '1970-01-01') / 7) AS BIGINT) AS t
        FROM cal LEFT JOIN so USING (c_mktsegment, period))"""


@query("g01_regularize", f"WITH {SEG_SQL} SELECT c_mktsegment, period, y, t FROM ss")
def regularize(spark, sf):
    return seg_series(Tables(spark, sf)).select("c_mktsegment", "period", "y", "t")


_DECOMP_SQL = f"""{SEG_SQL},
 f AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM ss),
 tr AS (SELECT *, CASE WHEN count(y) OVER w = {PERIOD + 1}
                       THEN (sum(y) OVER w - (lag(y, {PERIOD // 2}) OVER o + lead(y, {PERIOD // 2}) OVER o) / 2.0) / {PERIOD}
                  END AS trend, t % {PERIOD} AS season
        FROM f WHERE n >= {2 * PERIOD}
        WINDOW w AS (PARTITION BY c_mktsegment ORDER BY t ROWS BETWEEN {PERIOD // 2} PRECEDING AND {PERIOD // 2} FOLLOWING),
               o AS (PARTITION BY c_mktsegment ORDER BY t)),
 si AS (SELECT *, avg(y - trend) OVER (PARTITION BY c_mktsegment, season) AS si,
               row_number() OVER (PARTITION BY c_mktsegment, season ORDER BY t) = 1 AS first FROM tr),
 dec AS (SELECT *, si - avg(CASE WHEN first THEN si END) OVER (PARTITION BY c_mktsegment) AS seasonal FROM si),
 dd AS (SELECT c_mktsegment, t, y, trend, seasonal, y - trend - seasonal AS resid FROM dec)"""


@query("g02_decompose_classical", f"""WITH {_DECOMP_SQL}
SELECT c_mktsegment, t, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(resid, 6) AS resid FROM dd""")
def decompose(spark, sf):
    d = G.classical_decompose(seg_series(Tables(spark, sf)), ["c_mktsegment"], PERIOD)
    return d.select("c_mktsegment", "t", *[F.round(c, 6).alias(c) for c in ("trend", "seasonal", "resid")])


@query("g02_decompose_stl")
def decompose_stl(spark, sf):
    """STL per (segment, nation) weekly order series in applyInPandas."""
    t = Tables(spark, sf)
    s = G.regularize(seg_orders(t), ["c_mktsegment", "c_nationkey"], "o_orderdate", "o_totalprice", "week", 0.0)
    return G.stl(s, ["c_mktsegment", "c_nationkey"], PERIOD)


@query("g04_strengths", f"""WITH {_DECOMP_SQL},
 r AS (SELECT *, lag(resid) OVER (PARTITION BY c_mktsegment ORDER BY t) AS lr FROM dd WHERE resid IS NOT NULL),
 g AS (SELECT c_mktsegment, var_samp(resid) AS vr, var_samp(trend + resid) AS vtr, var_samp(seasonal + resid) AS vsr,
              avg(resid) AS resid_mean, corr(resid, lr) AS resid_acf1, stddev_samp(resid) AS sd, count(*) AS n
       FROM r GROUP BY 1),
 z AS (SELECT r.c_mktsegment, count_if(abs((resid - resid_mean) / nullif(sd, 0)) > 3) AS n_resid_outliers
       FROM r JOIN g USING (c_mktsegment) GROUP BY 1)
SELECT c_mktsegment, n, round(greatest(0.0, 1 - vr / nullif(vtr, 0)), 6) AS trend_strength,
       round(greatest(0.0, 1 - vr / nullif(vsr, 0)), 6) AS seasonal_strength, round(resid_mean, 6) AS resid_mean,
       round(vr, 6) AS resid_var, round(resid_acf1, 6) AS resid_acf1, n_resid_outliers
FROM g JOIN z USING (c_mktsegment)""")
def strengths(spark, sf):
    d = G.classical_decompose(seg_series(Tables(spark, sf)), ["c_mktsegment"], PERIOD)
    s = G.strengths(d, ["c_mktsegment"])
    return s.select("c_mktsegment", "n", *[F.round(c, 6).alias(c) for c in
                                           ("trend_strength", "seasonal_strength", "resid_mean", "resid_var",
                                            "resid_acf1")], "n_resid_outliers")


@query("g03_detect_period", f"""WITH {SEG_SQL},
 mu AS (SELECT c_mktsegment, avg(y) AS m FROM ss GROUP BY 1),
 d AS (SELECT ss.c_mktsegment, t, y - m AS dv FROM ss JOIN mu USING (c_mktsegment)),
 den AS (SELECT c_mktsegment, sum(dv * dv) AS s FROM d GROUP BY 1),
 lags AS (SELECT unnest(range(1, 61)) AS lag),
 num AS (SELECT a.c_mktsegment, lags.lag, sum(a.dv * b.dv) AS cov FROM d a CROSS JOIN lags
         JOIN d b ON a.c_mktsegment = b.c_mktsegment AND b.t = a.t + lags.lag GROUP BY 1, 2),
 acf AS (SELECT num.c_mktsegment, lag, round(cov / nullif(s, 0), 6) AS acf FROM num JOIN den USING (c_mktsegment)),
 k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY acf DESC, lag ASC) AS rn FROM acf WHERE lag >= 2)
SELECT c_mktsegment, lag AS period, acf AS acf_at_period FROM k WHERE rn = 1""")
def detect_period(spark, sf):
    a = R.acf(seg_series(Tables(spark, sf)), ["c_mktsegment"], "t", "y", 60)
    return G.detect_period(a, ["c_mktsegment"])


@query("g06_cusum", f"""WITH {SEG_SQL},
 st AS (SELECT c_mktsegment, avg(y) AS m, stddev_samp(y) AS s FROM ss GROUP BY 1),
 x AS (SELECT ss.c_mktsegment, t, (y - m) / nullif(s, 0) AS x FROM ss JOIN st USING (c_mktsegment)),
 l AS (SELECT c_mktsegment, list({{'t': t, 'x': x}} ORDER BY t) AS a FROM x GROUP BY 1),
 r AS (SELECT c_mktsegment, list_reduce(a, lambda s, e: {{
          'sp': greatest(0.0, s.sp + coalesce(e.x, 0.0) - 0.5), 'sn': greatest(0.0, s.sn - coalesce(e.x, 0.0) - 0.5),
          'i': s.i + 1,
          'first': CASE WHEN s.first IS NULL AND (greatest(0.0, s.sp + coalesce(e.x, 0.0) - 0.5) > 5.0
                        OR greatest(0.0, s.sn - coalesce(e.x, 0.0) - 0.5) > 5.0) THEN e.t ELSE s.first END,
          'alarms': s.alarms + CASE WHEN greatest(0.0, s.sp + coalesce(e.x, 0.0) - 0.5) > 5.0
                        OR greatest(0.0, s.sn - coalesce(e.x, 0.0) - 0.5) > 5.0 THEN 1 ELSE 0 END,
          'maxp': greatest(s.maxp, greatest(0.0, s.sp + coalesce(e.x, 0.0) - 0.5)),
          'maxn': greatest(s.maxn, greatest(0.0, s.sn - coalesce(e.x, 0.0) - 0.5))}},
          {{'sp': 0.0::DOUBLE, 'sn': 0.0::DOUBLE, 'i': 0::INTEGER, 'first': NULL::BIGINT, 'alarms': 0::INTEGER,
            'maxp': 0.0::DOUBLE, 'maxn': 0.0::DOUBLE}}) AS r FROM l)
SELECT c_mktsegment, r.i AS n, r.first AS first_alarm_t, r.alarms AS n_alarms, round(r.maxp, 6) AS max_pos,
       round(r.maxn, 6) AS max_neg FROM r""")
def cusum(spark, sf):
    return G.cusum(seg_series(Tables(spark, sf)), ["c_mktsegment"], 0.5, 5.0)


@query("g07_binseg", f"""WITH {SEG_SQL},
 p AS (SELECT c_mktsegment, t, row_number() OVER o AS i, count(*) OVER a AS n,
              sum(y) OVER c AS s1, sum(y * y) OVER c AS s2, sum(y) OVER a AS a1, sum(y * y) OVER a AS a2 FROM ss
       WINDOW o AS (PARTITION BY c_mktsegment ORDER BY t),
              c AS (PARTITION BY c_mktsegment ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              a AS (PARTITION BY c_mktsegment)),
 c AS (SELECT c_mktsegment, t, (s2 - s1 * s1 / i) + ((a2 - s2) - (a1 - s1) * (a1 - s1) / (n - i)) AS cost,
              a2 - a1 * a1 / n AS tot, (a1 - s1) / (n - i) - s1 / i AS shift FROM p WHERE i >= 4 AND n - i >= 4),
 k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY cost, t) AS rn FROM c)
SELECT c_mktsegment, t AS split_t, round(cost, 4) AS cost, round(tot, 4) AS sse_total, round(shift, 6) AS mean_shift
FROM k WHERE rn = 1""")
def binseg(spark, sf):
    b = G.best_split(seg_series(Tables(spark, sf)), ["c_mktsegment"], 4)
    return b.select("c_mktsegment", "split_t", F.round("cost", 4).alias("cost"),
                    F.round("sse_total", 4).alias("sse_total"), F.round("mean_shift", 6).alias("mean_shift"))


@query("g05_pelt")
def pelt(spark, sf):
    """PELT (L2 cost, BIC-type penalty) per (segment, nation) weekly value series."""
    t = Tables(spark, sf)
    s = G.regularize(seg_orders(t), ["c_mktsegment", "c_nationkey"], "o_orderdate", "o_totalprice", "week", 0.0)
    return G.pelt(s, ["c_mktsegment", "c_nationkey"])


@query("g08_bocpd")
def bocpd(spark, sf):
    return G.bocpd(seg_series(Tables(spark, sf)), ["c_mktsegment"], 1 / 100)


@query("g09_two_segment")
def two_segment(spark, sf):
    return G.two_segment(seg_series(Tables(spark, sf)), ["c_mktsegment"], 6)


@query("g10_validate_cps")
def validate_cps(spark, sf):
    """PELT change points checked for magnitude vs the noise band (2 sd of
    week-to-week changes), persistence (>= 4 periods to the next change or
    end), end-of-series caution, and agreement with the best single split."""
    t = Tables(spark, sf)
    s = seg_series(t)
    cps = G.pelt(s, ["c_mktsegment"])
    noise = s.withColumn("d", F.col("y") - F.lag("y").over(Window.partitionBy("c_mktsegment").orderBy("t"))) \
        .groupBy("c_mktsegment").agg(F.stddev_samp("d").alias("noise"), F.max("t").alias("t_end"))
    split = G.best_split(s, ["c_mktsegment"]).select("c_mktsegment", "split_t")
    w = Window.partitionBy("c_mktsegment").orderBy("cp_t")
    c = cps.withColumn("next_t", F.lead("cp_t").over(w)).join(noise, "c_mktsegment").join(split, "c_mktsegment")
    persist = F.coalesce(F.col("next_t"), F.col("t_end") + 1) - F.col("cp_t")
    return c.select("c_mktsegment", "cp_t", F.round("shift", 6).alias("shift"),
                    (F.abs("shift") > 2 * F.col("noise")).alias("beyond_noise"), (persist >= 4).alias("persistent"),
                    (F.col("t_end") - F.col("cp_t") < 4).alias("near_series_end"),
                    (F.abs(F.col("cp_t") - F.col("split_t")) <= 4).alias("agrees_with_binseg"))


@query("g11_coincide", f"""WITH {SEG_SQL},
 p AS (SELECT c_mktsegment, t, row_number() OVER o AS i, count(*) OVER a AS n,
              sum(y) OVER c AS s1, sum(y * y) OVER c AS s2, sum(y) OVER a AS a1, sum(y * y) OVER a AS a2 FROM ss
       WINDOW o AS (PARTITION BY c_mktsegment ORDER BY t),
              c AS (PARTITION BY c_mktsegment ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              a AS (PARTITION BY c_mktsegment)),
 c AS (SELECT c_mktsegment, t, (s2 - s1 * s1 / i) + ((a2 - s2) - (a1 - s1) * (a1 - s1) / (n - i)) AS cost
       FROM p WHERE i >= 4 AND n - i >= 4),
 k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY cost, t) AS rn FROM c),
 cp AS (SELECT c_mktsegment, DATE '1970-01-01' + CAST(t * 7 AS INTEGER) AS cp_date FROM k WHERE rn = 1),
 yrs AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders),
 ev AS (SELECT make_date(y, 1, 1) AS event_date, 'new_year' AS event FROM yrs
        UNION ALL SELECT make_date(y, 12, 25), 'christmas' FROM yrs)
SELECT cp.c_mktsegment, cp.cp_date, ev.event, ev.event_date FROM cp JOIN ev
  ON ev.event_date BETWEEN cp.cp_date - INTERVAL 14 DAY AND cp.cp_date + INTERVAL 14 DAY""")
def coincide(spark, sf):
    """Change points (best split) within +/- 14 days of known calendar events
    generated for the years present in the data."""
    t = Tables(spark, sf)
    cp = G.best_split(seg_series(t), ["c_mktsegment"]).select(
        "c_mktsegment", F.date_add(F.lit("1970-01-01").cast("date"), (F.col("split_t") * 7).cast("int")).alias("cp_date"))
    yrs = t.orders.select(F.year("o_orderdate").alias("y")).distinct()
    ev = yrs.select(F.make_date("y", F.lit(1), F.lit(1)).alias("event_date"), F.lit("new_year").alias("event")) \
        .unionByName(yrs.select(F.make_date("y", F.lit(12), F.lit(25)).alias("event_date"),
                                F.lit("christmas").alias("event")))
    spans = cp.select("c_mktsegment", "cp_date", F.date_sub("cp_date", 14).alias("lo"),
                      F.date_add("cp_date", 15).alias("hi"), F.lit(1).alias("k"))
    pts = ev.select("event", "event_date", F.lit(1).alias("k"))
    j = R.range_join(pts, spans, "k", "event_date", "lo", "hi", bin_seconds=86400 * 7)
    return j.select("c_mktsegment", "cp_date", "event", "event_date")


@query("g12_temporal_outliers", f"""WITH {SEG_SQL},
 r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY t) AS rn,
              quantile_cont(y, 0.5) OVER (PARTITION BY c_mktsegment ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS med
       FROM ss),
 m AS (SELECT a.c_mktsegment, a.t, quantile_cont(abs(b.y - a.med), 0.5) AS mad FROM r a JOIN r b
       ON a.c_mktsegment = b.c_mktsegment AND b.rn BETWEEN a.rn - 3 AND a.rn + 3 GROUP BY 1, 2),
 pm AS (SELECT a.c_mktsegment, a.t, quantile_cont(b.y, 0.5) AS peer_median FROM ss a JOIN ss b
        ON a.t = b.t AND a.c_mktsegment <> b.c_mktsegment GROUP BY 1, 2)
SELECT r.c_mktsegment, r.t, r.y, m.mad > 0 AND abs(r.y - r.med) > 3.0 * 1.4826 * m.mad AS own_outlier,
       round(pm.peer_median, 6) AS peer_median,
       abs(r.y - pm.peer_median) > 0.5 * pm.peer_median AS peer_outlier
FROM r JOIN m USING (c_mktsegment, t) LEFT JOIN pm USING (c_mktsegment, t)""")
def temporal_outliers(spark, sf):
    s = seg_series(Tables(spark, sf))
    h = R.hampel(s, ["c_mktsegment"], "t", "y", 3, 3.0)
    p = R.peer_median(s, ["t"], "c_mktsegment", "y").select("c_mktsegment", "t", "peer_median")
    j = h.join(p, ["c_mktsegment", "t"], "left")
    return j.select("c_mktsegment", "t", "y", F.col("is_outlier").alias("own_outlier"),
                    F.round("peer_median", 6).alias("peer_median"),
                    (F.abs(F.col("y") - F.col("peer_median")) > 0.5 * F.col("peer_median")).alias("peer_outlier"))


def cohort_cells(t: Tables):
    c = R.cohort_index(t.orders, "o_custkey", "o_orderdate", "quarter")
    size = c.groupBy("cohort").agg(F.count_distinct("o_custkey").alias("cohort_size"))
    g = c.groupBy("cohort", "age").agg(F.count_distinct("o_custkey").alias("n_active"))
    q = R.exact_quantiles(c, ["cohort", "age"], "o_totalprice", [0.25, 0.5, 0.75], names=["q1", "q2", "q3"])
    return g.join(q, ["cohort", "age"]).join(size, "cohort").select(
        "cohort", "age", "n_active", F.round("q2", 6).alias("median_value"),
        F.round(F.col("q3") - F.col("q1"), 6).alias("iqr_value"),
        F.round(F.col("n_active") / F.col("cohort_size"), 6).alias("surviving"))


_COHORT_SQL = """o AS (SELECT o_custkey, o_totalprice, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period FROM orders),
 c AS (SELECT *, min(period) OVER (PARTITION BY o_custkey) AS cohort FROM o),
 c2 AS (SELECT *, CAST(datediff('month', cohort, period) / 3 AS INTEGER) AS age FROM c),
 sz AS (SELECT cohort, count(DISTINCT o_custkey) AS cohort_size FROM c2 GROUP BY 1),
 cells AS (SELECT c2.cohort, age, count(DISTINCT o_custkey) AS n_active,
                  round(quantile_cont(o_totalprice, 0.5), 6) AS median_value,
                  round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 6) AS iqr_value,
                  round(count(DISTINCT o_custkey) / first(cohort_size), 6) AS surviving
           FROM c2 JOIN sz USING (cohort) GROUP BY 1, 2)"""


@query("g13_cohort_matrix", f"WITH {_COHORT_SQL} SELECT * FROM cells")
def cohort_matrix(spark, sf):
    return cohort_cells(Tables(spark, sf))


@query("g14_cohort_patterns", f"""WITH {_COHORT_SQL},
 r AS (SELECT *, dense_rank() OVER (ORDER BY cohort) AS cohort_idx FROM cells)
SELECT age, count(*) AS n_cohorts, round(regr_slope(median_value, cohort_idx), 6) AS value_slope_by_cohort,
       round(regr_slope(surviving, cohort_idx), 6) AS survival_slope_by_cohort,
       CASE WHEN count(*) > 1 THEN regr_slope(surviving, cohort_idx) < 0 END AS later_worse
FROM r GROUP BY age""")
def cohort_patterns(spark, sf):
    """Later-worse-at-same-age: slope of survival and value across cohorts at
    each age (cohorts indexed in time order)."""
    cells = cohort_cells(Tables(spark, sf))
    idx = cells.select("cohort").distinct().withColumn("cohort_idx", F.dense_rank().over(Window.orderBy("cohort")))
    r = cells.join(idx, "cohort")
    return r.groupBy("age").agg(F.count("*").alias("n_cohorts"),
                                F.round(F.regr_slope("median_value", "cohort_idx"), 6).alias("value_slope_by_cohort"),
                                F.round(F.regr_slope("surviving", "cohort_idx"), 6).alias("survival_slope_by_cohort"),
                                (F.regr_slope("surviving", "cohort_idx") < 0).alias("later_worse"))


@query("g15_adf", f"""WITH {SEG_SQL},
 d AS (SELECT c_mktsegment, lag(y) OVER (PARTITION BY c_mktsegment ORDER BY t) AS y1, y FROM ss),
 g AS (SELECT c_mktsegment, regr_count(y - y1, y1) AS n, regr_sxx(y - y1, y1) AS sxx, regr_syy(y - y1, y1) AS syy,
              regr_sxy(y - y1, y1) AS sxy FROM d WHERE y1 IS NOT NULL GROUP BY 1),
 t AS (SELECT c_mktsegment, n, (sxy / nullif(sxx, 0)) / sqrt(greatest(syy - sxy * sxy / sxx, 0) / ((n - 2) * sxx)) AS tau FROM g)
SELECT c_mktsegment, n, round(tau, 6) AS tau,
       CASE WHEN tau < -3.43 THEN '1%' WHEN tau < -2.86 THEN '5%' WHEN tau < -2.57 THEN '10%' ELSE 'not_rejected' END
         AS unit_root_rejected_at FROM t""")
def adf(spark, sf):
    a = G.adf0(seg_series(Tables(spark, sf)), ["c_mktsegment"])
    return a.withColumn("tau", F.round("tau", 6))


@query("g15_kpss", f"""WITH {SEG_SQL},
 e AS (SELECT c_mktsegment, t, y - avg(y) OVER (PARTITION BY c_mktsegment) AS e FROM ss),
 s AS (SELECT *, sum(e) OVER (PARTITION BY c_mktsegment ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS S FROM e),
 g AS (SELECT c_mktsegment, count(*) AS n, sum(S * S) AS ss, avg(e * e) AS s2 FROM s GROUP BY 1)
SELECT c_mktsegment, n, round(ss / (n * n * s2), 6) AS eta,
       CASE WHEN ss / (n * n * s2) > 0.739 THEN '1%' WHEN ss / (n * n * s2) > 0.463 THEN '5%'
            WHEN ss / (n * n * s2) > 0.347 THEN '10%' ELSE 'not_rejected' END AS stationarity_rejected_at FROM g""")
def kpss(spark, sf):
    return G.kpss0(seg_series(Tables(spark, sf)), ["c_mktsegment"]).withColumn("eta", F.round("eta", 6))


_EVENT_T = "CAST(floor((DATE '1998-01-05' - DATE '1970-01-01') / 7) AS BIGINT)"


@query("g16_pre_post", f"""WITH {SEG_SQL},
 g AS (SELECT c_mktsegment,
              avg(CASE WHEN t >= {_EVENT_T} - 13 AND t < {_EVENT_T} THEN y END) AS pre_mean,
              avg(CASE WHEN t >= {_EVENT_T} AND t < {_EVENT_T} + 13 THEN y END) AS post_mean,
              var_samp(CASE WHEN t >= {_EVENT_T} - 13 AND t < {_EVENT_T} THEN y END) AS v0,
              var_samp(CASE WHEN t >= {_EVENT_T} AND t < {_EVENT_T} + 13 THEN y END) AS v1,
              count(CASE WHEN t >= {_EVENT_T} - 13 AND t < {_EVENT_T} THEN y END) AS n0,
              count(CASE WHEN t >= {_EVENT_T} AND t < {_EVENT_T} + 13 THEN y END) AS n1 FROM ss GROUP BY 1)
SELECT c_mktsegment, round(pre_mean, 6) AS pre_mean, round(post_mean, 6) AS post_mean, round(post_mean - pre_mean, 6) AS gap,
       round(post_mean - pre_mean - 1.959963984540054 * sqrt(v0 / n0 + v1 / n1), 6) AS ci_low,
       round(post_mean - pre_mean + 1.959963984540054 * sqrt(v0 / n0 + v1 / n1), 6) AS ci_high,
       round((post_mean - pre_mean) / nullif(sqrt(v0 / n0 + v1 / n1), 0), 6) AS z FROM g""")
def pre_post(spark, sf):
    import datetime
    ev = (datetime.date(1998, 1, 5) - datetime.date(1970, 1, 1)).days // 7
    p = G.pre_post(seg_series(Tables(spark, sf)), ["c_mktsegment"], ev, 13)
    return p.select("c_mktsegment", *[F.round(c, 6).alias(c) for c in
                                      ("pre_mean", "post_mean", "gap", "ci_low", "ci_high", "z")])


@query("g17_forecast_gap")
def forecast(spark, sf):
    import datetime
    cut = (datetime.date(2000, 1, 3) - datetime.date(1970, 1, 1)).days // 7
    return G.forecast_gap(seg_series(Tables(spark, sf)), ["c_mktsegment"], cut, PERIOD)


@query("g18_did", """
WITH j AS (SELECT c.c_mktsegment = 'BUILDING' AS tr, o.o_orderdate >= TIMESTAMP '1998-01-01' AS post, o.o_totalprice AS y
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
 s AS (SELECT avg(CASE WHEN tr AND post THEN y END) AS mt1, avg(CASE WHEN tr AND NOT post THEN y END) AS mt0,
              avg(CASE WHEN NOT tr AND post THEN y END) AS mc1, avg(CASE WHEN NOT tr AND NOT post THEN y END) AS mc0,
              var_samp(CASE WHEN tr AND post THEN y END) / count(CASE WHEN tr AND post THEN y END)
              + var_samp(CASE WHEN tr AND NOT post THEN y END) / count(CASE WHEN tr AND NOT post THEN y END)
              + var_samp(CASE WHEN NOT tr AND post THEN y END) / count(CASE WHEN NOT tr AND post THEN y END)
              + var_samp(CASE WHEN NOT tr AND NOT post THEN y END) / count(CASE WHEN NOT tr AND NOT post THEN y END) AS v
       FROM j)
SELECT round((mt1 - mt0) - (mc1 - mc0), 6) AS did, round(sqrt(v), 6) AS se,
       round((mt1 - mt0) - (mc1 - mc0) - 1.959963984540054 * sqrt(v), 6) AS ci_low,
       round((mt1 - mt0) - (mc1 - mc0) + 1.959963984540054 * sqrt(v), 6) AS ci_high FROM s""")
def did(spark, sf):
    o = seg_orders(Tables(spark, sf))
    d = G.did(o, F.col("c_mktsegment") == "BUILDING", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"),
              "o_totalprice")
    return d.select(*[F.round(c, 6).alias(c) for c in ("did", "se", "ci_low", "ci_high")])


_W0, _W1 = "DATE '1999-01-04'", "DATE '1999-12-27'"


@query("g19_cohort_gap", f"""WITH {SEG_SQL},
 w AS (SELECT c_mktsegment = 'BUILDING' AS focal, y FROM ss WHERE period BETWEEN {_W0} AND {_W1}),
 g AS (SELECT count(CASE WHEN focal THEN y END) AS n1, avg(CASE WHEN focal THEN y END) AS m1,
              var_samp(CASE WHEN focal THEN y END) AS v1, count(CASE WHEN NOT focal THEN y END) AS n2,
              avg(CASE WHEN NOT focal THEN y END) AS m2, var_samp(CASE WHEN NOT focal THEN y END) AS v2 FROM w)
SELECT round(m1 - m2, 6) AS gap, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t FROM g""")
def cohort_gap(spark, sf):
    s = seg_series(Tables(spark, sf)).where(F.col("period").between(F.lit("1999-01-04").cast("date"),
                                                                      F.lit("1999-12-27").cast("date")))
    s = s.withColumn("grp", F.when(F.col("c_mktsegment") == "BUILDING", "focal").otherwise("peers"))
    w = X.welch_t(s, "y", "grp", "focal", "peers")
    return w.select(F.col("mean_diff").alias("gap"), "t")


@query("g20_window_agree", """
WITH nw AS (SELECT s.s_nationkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS qty
            FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY week DESC) AS rk FROM nw),
 g AS (SELECT s_nationkey,
              sum(CASE WHEN rk <= 4 THEN qty END) - sum(CASE WHEN rk BETWEEN 5 AND 8 THEN qty END) AS d4,
              sum(CASE WHEN rk <= 13 THEN qty END) - sum(CASE WHEN rk BETWEEN 14 AND 26 THEN qty END) AS d13,
              sum(CASE WHEN rk <= 13 THEN qty END) - sum(CASE WHEN rk BETWEEN 53 AND 65 THEN qty END) AS dy
       FROM r GROUP BY 1)
SELECT s_nationkey, sign(d4) AS sign_4, sign(d13) AS sign_13, sign(dy) AS sign_prior_year,
       sign(d4) = sign(d13) AND sign(d13) = sign(dy) AS windows_agree FROM g""")
def window_agree(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    nw = j.groupBy("s_nationkey", F.to_date(F.date_trunc("WEEK", "l_shipdate")).alias("week")) \
        .agg(F.sum("l_quantity").alias("qty"))
    r = nw.withColumn("rk", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.col("week").desc())))

    def s(lo, hi):
        return F.sum(F.when(F.col("rk").between(lo, hi), F.col("qty")))
    g = r.groupBy("s_nationkey").agg((s(1, 4) - s(5, 8)).alias("d4"), (s(1, 13) - s(14, 26)).alias("d13"),
                                     (s(1, 13) - s(53, 65)).alias("dy"))
    sg = {c: F.signum(c).cast("int") for c in ("d4", "d13", "dy")}
    return g.select("s_nationkey", sg["d4"].alias("sign_4"), sg["d13"].alias("sign_13"),
                    sg["dy"].alias("sign_prior_year"),
                    ((sg["d4"] == sg["d13"]) & (sg["d13"] == sg["dy"])).alias("windows_agree"))
