"""Diagnostics, business-metric and benchmarking queries (D family).

Stand-ins: supplier = outlet / entity, part brand = item, p_type = stratum,
order priority = service class; discount >= 0.09 marks a promoted line.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prudent.functions import scalar as S
from prudent.operators import diagnose as DG
from prudent.operators import relational as R
from prudent.operators import stats as X
from prudent.plans.registry import Tables, query


def _lp(t: Tables):
    return t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand", "p_retailprice"),
                           "l_partkey").withColumn("yr", F.year("l_shipdate")) \
        .withColumn("ok_qty", F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0))


_LP_SQL = """lp AS (SELECT l.*, p.p_type, p.p_brand, p.p_retailprice, year(l_shipdate) AS yr,
                  CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END AS ok_qty
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

_TWO_PERIOD_SQL = """SELECT p_type, sum(CASE WHEN yr = 1996 THEN ok_qty END) AS num0, sum(CASE WHEN yr = 1996 THEN l_quantity END) AS den0,
       sum(CASE WHEN yr = 1997 THEN ok_qty END) AS num1, sum(CASE WHEN yr = 1997 THEN l_quantity END) AS den1
FROM lp GROUP BY p_type"""


@query("d01_simpson", f"""
WITH {_LP_SQL}, s AS ({_TWO_PERIOD_SQL}),
 d AS (SELECT num1 / nullif(den1, 0) - num0 / nullif(den0, 0) AS delta FROM s),
 a AS (SELECT sum(num1) / nullif(sum(den1), 0) - sum(num0) / nullif(sum(den0), 0) AS agg FROM s),
 c AS (SELECT count_if(delta > 0.001) AS n_up, count_if(delta < -0.001) AS n_down, count_if(abs(delta) <= 0.001) AS n_flat,
              min(abs(delta)) AS min_abs, count(*) AS n_strata, (SELECT agg FROM a) AS agg FROM d)
SELECT round(agg, 6) AS agg_delta, n_up, n_down, n_flat, n_strata,
       CASE WHEN n_up > 0 AND n_down > 0 THEN 'heterogeneous'
            WHEN agg > 0.001 AND n_down > 0 AND n_up = 0 THEN 'reversal'
            WHEN agg < -0.001 AND n_up > 0 AND n_down = 0 THEN 'reversal'
            WHEN abs(agg) > 0.001 AND n_up = 0 AND n_down = 0 THEN 'vanishing'
            WHEN abs(agg) > 0.001 AND min_abs > abs(agg) THEN 'strengthening' ELSE 'consistent' END AS pattern
FROM c""")
def simpson(spark, sf):
    return DG.simpson(_lp(Tables(spark, sf)), "ok_qty", "l_quantity", "yr", 1996, 1997, "p_type")


@query("d02_mix_shift", f"""
WITH {_LP_SQL}, s AS ({_TWO_PERIOD_SQL}),
 w AS (SELECT p_type, den0 / (SELECT sum(den0) FROM s) AS w0, den1 / (SELECT sum(den1) FROM s) AS w1,
              num0 / nullif(den0, 0) AS r0, num1 / nullif(den1, 0) AS r1 FROM s)
SELECT p_type, round(w0, 6) AS w0, round(w1, 6) AS w1, round(r0, 6) AS r0, round(r1, 6) AS r1,
       round(w0 * (r1 - r0), 8) AS rate_effect, round((w1 - w0) * r1, 8) AS mix_effect FROM w""")
def mix_shift(spark, sf):
    m = DG.mix_shift(_lp(Tables(spark, sf)), "ok_qty", "l_quantity", "yr", 1996, 1997, "p_type")
    return m.select("p_type", *[F.round(c, 6).alias(c) for c in ("w0", "w1", "r0", "r1")],
                    F.round("rate_effect", 8).alias("rate_effect"), F.round("mix_effect", 8).alias("mix_effect"))


@query("d03_confounding", """
WITH s AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS rxy, corr(l_quantity, l_tax) AS rxz,
                  corr(l_extendedprice, l_tax) AS ryz FROM lineitem GROUP BY 1),
 p AS (SELECT l_returnflag, rxy AS raw, (rxy - rxz * ryz) / sqrt(nullif((1 - rxz * rxz) * (1 - ryz * ryz), 0)) AS adj FROM s)
SELECT l_returnflag, round(raw, 6) AS raw_r, round(adj, 6) AS adjusted_r,
       round((raw - adj) * 100.0 / nullif(raw, 0), 6) AS attenuation_pct,
       CASE WHEN sign(raw) <> sign(adj) OR abs(adj) < 0.05 THEN 'reject'
            WHEN (raw - adj) * 100.0 / nullif(raw, 0) >= 50 THEN 'weaker_language' ELSE 'robust' END AS verdict
FROM p""")
def confounding(spark, sf):
    li = Tables(spark, sf).lineitem
    s = li.groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("rxy"),
                                       F.corr("l_quantity", "l_tax").alias("rxz"),
                                       F.corr("l_extendedprice", "l_tax").alias("ryz"))
    adj = F.expr("(rxy - rxz * ryz) / sqrt(nullif((1 - rxz * rxz) * (1 - ryz * ryz), 0))")
    att, verdict = DG.confounding(F.col("rxy"), adj)
    return s.select("l_returnflag", F.round("rxy", 6).alias("raw_r"), F.round(adj, 6).alias("adjusted_r"),
                    F.round(att, 6).alias("attenuation_pct"), verdict.alias("verdict"))


@query("d04_weekly_volume", """
SELECT s.s_nationkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week,
       sum(l_quantity) - sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS net_volume
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2""")
def weekly_volume(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return j.groupBy("s_nationkey", S.week_start("l_shipdate").alias("week")).agg(
        (F.sum("l_quantity") - F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)))
        .alias("net_volume"))


def _wdist(t: Tables):
    lp = _lp(t)
    w = lp.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("acv"))
    universe = w.select(F.sum("acv")).scalar()
    sold = lp.select("p_brand", "l_suppkey").distinct().join(w, "l_suppkey")
    return sold.groupBy("p_brand").agg(F.count("*").alias("n_outlets"),
                                       F.round(F.sum("acv") * 100.0 / universe, 6).alias("weighted_dist_pct"))


_WDIST_SQL = f"""{_LP_SQL},
 w AS (SELECT l_suppkey, sum(l_quantity) AS acv FROM lp GROUP BY 1),
 sold AS (SELECT DISTINCT p_brand, l_suppkey FROM lp),
 wd AS (SELECT p_brand, count(*) AS n_outlets, round(sum(acv) * 100.0 / (SELECT sum(acv) FROM w), 6) AS weighted_dist_pct
        FROM sold JOIN w USING (l_suppkey) GROUP BY 1)"""


@query("d05_weighted_distribution", f"WITH {_WDIST_SQL} SELECT * FROM wd")
def weighted_distribution(spark, sf):
    return _wdist(Tables(spark, sf))


@query("d06_velocity", f"""
WITH {_WDIST_SQL},
 v AS (SELECT lp.p_brand, min(lp.p_type) AS p_type, sum(l_quantity) AS volume FROM lp GROUP BY 1),
 b AS (SELECT v.p_brand, v.volume / nullif(wd.weighted_dist_pct, 0) AS velocity FROM v JOIN wd USING (p_brand))
SELECT p_brand, round(velocity, 6) AS velocity FROM b""")
def velocity(spark, sf):
    t = Tables(spark, sf)
    v = _lp(t).groupBy("p_brand").agg(F.sum("l_quantity").alias("volume"))
    return v.join(_wdist(t), "p_brand").select("p_brand", F.round(S.safe_div("volume", "weighted_dist_pct"), 6)
                                               .alias("velocity"))


@query("d07_instock_basket", """
WITH j AS (SELECT c.c_mktsegment, l.l_orderkey, l.l_quantity, l.l_linestatus FROM lineitem l
           JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey)
SELECT c_mktsegment, round(count_if(l_linestatus = 'F') / count(*), 6) AS instock_rate,
       round(sum(l_quantity) / count(DISTINCT l_orderkey), 6) AS basket_size FROM j GROUP BY 1""")
def instock_basket(spark, sf):
    t = Tables(spark, sf)
    j = (t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
         .join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"))
    return j.groupBy("c_mktsegment").agg(
        F.round(S.safe_div(F.count_if(F.col("l_linestatus") == "F"), F.count("*")), 6).alias("instock_rate"),
        F.round(S.safe_div(F.sum("l_quantity"), F.count_distinct("l_orderkey")), 6).alias("basket_size"))


_ON_TIME_DAYS = 60


@query("d08_fill_rate_otif", f"""
WITH j AS (SELECT o.o_orderpriority, l.l_quantity, l_returnflag <> 'R' AS in_full,
                  datediff('day', o.o_orderdate, l.l_shipdate) <= {_ON_TIME_DAYS} AS on_time
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity > 0)
SELECT o_orderpriority, round(sum(CASE WHEN in_full THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 6) AS fill_rate,
       round(count_if(on_time AND in_full) / count(*), 6) AS otif_joint,
       round((count_if(on_time) / count(*)) * (count_if(in_full) / count(*)), 6) AS otif_independent
FROM j GROUP BY 1""")
def fill_rate(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.where("l_quantity > 0").join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderdate"), "l_orderkey")
    in_full = F.col("l_returnflag") != "R"
    on_time = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")) <= _ON_TIME_DAYS
    n = F.count("*")
    return j.groupBy("o_orderpriority").agg(
        F.round(R.ratio(F.when(in_full, F.col("l_quantity")).otherwise(0.0), "l_quantity"), 6).alias("fill_rate"),
        F.round(F.count_if(on_time & in_full) / n, 6).alias("otif_joint"),
        F.round((F.count_if(on_time) / n) * (F.count_if(in_full) / n), 6).alias("otif_independent"))


@query("d10_cycle_time", """
WITH j AS (SELECT o.o_orderpriority,
                  (floor(datediff('day', DATE '1970-01-05', CAST(l.l_shipdate AS DATE)) / 7) * 5
                   + least(datediff('day', DATE '1970-01-05', CAST(l.l_shipdate AS DATE)) % 7, 5))
                - (floor(datediff('day', DATE '1970-01-05', CAST(o.o_orderdate AS DATE)) / 7) * 5
                   + least(datediff('day', DATE '1970-01-05', CAST(o.o_orderdate AS DATE)) % 7, 5)) AS bd
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
SELECT o_orderpriority, count(*) AS n, count_if(bd < 0) AS n_negative,
       round(quantile_cont(CASE WHEN bd >= 0 THEN bd END, 0.5), 6) AS median_bd,
       round(quantile_cont(CASE WHEN bd >= 0 THEN bd END, 0.75) - quantile_cont(CASE WHEN bd >= 0 THEN bd END, 0.25), 6) AS iqr_bd
FROM j GROUP BY 1""")
def cycle_time(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderdate"),
                        "l_orderkey").withColumn("bd", DG.business_days("o_orderdate", "l_shipdate"))
    g = j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("bd") < 0).alias("n_negative"))
    q = R.exact_quantiles(j.where(F.col("bd") >= 0).withColumn("bd", F.col("bd").cast("double")),
                          ["o_orderpriority"], "bd", [0.25, 0.5, 0.75], names=["q1", "q2", "q3"])
    g = g.join(q, "o_orderpriority", "left")
    return g.select("o_orderpriority", "n", "n_negative", F.round("q2", 6).alias("median_bd"),
                    F.round(F.col("q3") - F.col("q1"), 6).alias("iqr_bd"))


@query("d11_oee_fpy", """
WITH s AS (SELECT l_suppkey, count(DISTINCT date_trunc('week', l_shipdate)) AS active_weeks,
                  datediff('week', min(date_trunc('week', l_shipdate)), max(date_trunc('week', l_shipdate))) + 1 AS span_weeks,
                  avg(l_quantity) / 50.0 AS performance,
                  sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS quality
           FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(active_weeks / span_weeks, 6) AS availability, round(performance, 6) AS performance,
       round(quality, 6) AS quality, round(active_weeks / span_weeks * performance * quality, 6) AS oee FROM s""")
def oee(spark, sf):
    li = Tables(spark, sf).lineitem.withColumn("wk", F.date_trunc("WEEK", "l_shipdate"))
    s = li.groupBy("l_suppkey").agg(
        F.count_distinct("wk").alias("active"),
        (F.floor(F.datediff(F.max("wk"), F.min("wk")) / 7) + 1).alias("span"),
        (F.avg("l_quantity") / 50.0).alias("performance"),
        S.safe_div(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)),
                   F.sum("l_quantity")).alias("quality"))
    av = F.col("active") / F.col("span")
    return s.select("l_suppkey", F.round(av, 6).alias("availability"), F.round("performance", 6).alias("performance"),
                    F.round("quality", 6).alias("quality"),
                    F.round(av * F.col("performance") * F.col("quality"), 6).alias("oee"))


@query("d11_first_pass_yield", """
WITH o AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS passed, sum(l_quantity) AS units FROM lineitem GROUP BY 1),
 st AS (SELECT l_linenumber, avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END) AS y FROM lineitem GROUP BY 1)
SELECT round(count_if(passed) / count(*), 6) AS fpy_orders,
       round(sum(CASE WHEN passed THEN units ELSE 0 END) / sum(units), 6) AS fpy_units,
       round((SELECT exp(sum(ln(y))) FROM st), 6) AS rolled_throughput_yield FROM o""")
def fpy(spark, sf):
    li = Tables(spark, sf).lineitem
    o = li.groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") != "R").alias("passed"),
                                     F.sum("l_quantity").alias("units"))
    st = li.groupBy("l_linenumber").agg(F.avg(F.when(F.col("l_returnflag") != "R", 1.0).otherwise(0.0)).alias("y"))
    rty = st.select(F.exp(F.sum(F.log("y")))).scalar()
    return o.agg(F.round(F.count_if("passed") / F.count("*"), 6).alias("fpy_orders"),
                 F.round(F.sum(F.when(F.col("passed"), F.col("units")).otherwise(0.0)) / F.sum("units"), 6)
                 .alias("fpy_units"), F.round(rty, 6).alias("rolled_throughput_yield"))


def _brand_weekly(t: Tables):
    lp = _lp(t)
    return lp.groupBy("p_brand", S.week_start("l_shipdate").alias("week")).agg(
        F.sum("l_quantity").alias("qty"), (F.max("l_discount") >= 0.09).alias("promo"))


@query("d12_promo_lift", """
WITH lp AS (SELECT l.*, p.p_brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
 bw AS (SELECT p_brand, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS qty,
               max(l_discount) >= 0.09 AS promo FROM lp GROUP BY 1, 2),
 np AS (SELECT p_brand, week, avg(qty) OVER (PARTITION BY p_brand ORDER BY week ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS m13
        FROM bw WHERE NOT promo),
 a AS (SELECT bw.*, np.m13 FROM bw LEFT JOIN np USING (p_brand, week)),
 b AS (SELECT *, last_value(m13 IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY week
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM a)
SELECT p_brand, week, qty, round(baseline, 6) AS baseline, round(qty - baseline, 6) AS incremental_units,
       round(qty / nullif(baseline, 0) - 1, 6) AS lift FROM b WHERE promo""")
def promo_lift(spark, sf):
    b = _with_baseline(Tables(spark, sf))
    return b.where("promo").select("p_brand", "week", "qty", F.round("baseline", 6).alias("baseline"),
                                   F.round(F.col("qty") - F.col("baseline"), 6).alias("incremental_units"),
                                   F.round(S.safe_div("qty", "baseline") - 1, 6).alias("lift"))


def _with_baseline(t: Tables):
    """Weekly brand volume beside the mean of the thirteen weeks without promotion before it."""
    bw = _brand_weekly(t)
    np_ = bw.where(~F.col("promo")).withColumn(
        "m13", F.avg("qty").over(Window.partitionBy("p_brand").orderBy("week").rowsBetween(-12, 0)))
    a = bw.join(np_.select("p_brand", "week", "m13"), ["p_brand", "week"], "left")
    w = Window.partitionBy("p_brand").orderBy("week").rowsBetween(Window.unboundedPreceding, -1)
    return a.withColumn("baseline", F.last("m13", ignorenulls=True).over(w))


@query("d13_cannibalisation", """
WITH lw AS (SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_partkey,
                   sum(l_quantity) AS qty, max(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) AS promo
            FROM lineitem GROUP BY 1, 2, 3),
 pw AS (SELECT l_suppkey, week, count(*) AS n_promo FROM lw WHERE promo = 1 GROUP BY 1, 2),
 o AS (SELECT coalesce(n_promo, 0) > 0 AS other_promoted, qty FROM lw LEFT JOIN pw USING (l_suppkey, week) WHERE promo = 0)
SELECT round(avg(CASE WHEN other_promoted THEN qty END) / nullif(avg(CASE WHEN NOT other_promoted THEN qty END), 0) - 1, 6)
       AS cannibalisation_index FROM o""")
def cannibalisation(spark, sf):
    li = Tables(spark, sf).lineitem
    lw = li.groupBy("l_suppkey", S.week_start("l_shipdate").alias("week"), "l_partkey").agg(
        F.sum("l_quantity").alias("qty"), F.max(F.when(F.col("l_discount") >= 0.09, 1).otherwise(0)).alias("promo"))
    pw = lw.where("promo = 1").groupBy("l_suppkey", "week").agg(F.count("*").alias("n_promo"))
    o = lw.where("promo = 0").join(pw, ["l_suppkey", "week"], "left") \
        .withColumn("other_promoted", F.coalesce(F.col("n_promo"), F.lit(0)) > 0)
    return o.agg(F.round(S.safe_div(F.avg(F.when(F.col("other_promoted"), F.col("qty"))),
                                    F.avg(F.when(~F.col("other_promoted"), F.col("qty")))) - 1, 6)
                 .alias("cannibalisation_index"))


@query("d13_promo_return", """
WITH lp AS (SELECT l.*, p.p_brand, p.p_retailprice FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
 bw AS (SELECT p_brand, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS qty, max(l_discount) >= 0.09 AS promo FROM lp GROUP BY 1, 2),
 np AS (SELECT p_brand, week, avg(qty) OVER (PARTITION BY p_brand ORDER BY week ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS m13 FROM bw WHERE NOT promo),
 b AS (SELECT bw.*, last_value(m13 IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline
       FROM bw LEFT JOIN np USING (p_brand, week)),
 i AS (SELECT p_brand, sum(qty - baseline) AS units FROM b WHERE promo GROUP BY 1),
 m AS (SELECT p_brand, (sum(l_extendedprice * (1 - l_discount)) - sum(l_quantity * p_retailprice * 0.5)) / nullif(sum(l_quantity), 0) AS margin,
              sum(CASE WHEN l_discount >= 0.09 THEN l_extendedprice * l_discount ELSE 0 END) AS spend FROM lp GROUP BY 1)
SELECT p_brand, round(units, 4) AS incremental_units, round(units * margin, 4) AS incremental_profit, round(spend, 4) AS trade_spend,
       round(units * margin / nullif(spend, 0), 6) AS promo_return FROM m LEFT JOIN i USING (p_brand)""")
def promo_return(spark, sf):
    """Profit of the units above the baseline over the discounts given for them, per brand."""
    t = Tables(spark, sf)
    units = _with_baseline(t).where("promo").groupBy("p_brand").agg(F.sum(F.col("qty") - F.col("baseline")).alias("units"))
    given = F.col("l_extendedprice") * F.col("l_discount")
    lp = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice"), "l_partkey")
    m = lp.groupBy("p_brand").agg(
        S.safe_div(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) - F.sum(F.col("l_quantity") * F.col("p_retailprice") * 0.5), F.sum("l_quantity")).alias("margin"),
        F.sum(F.when(F.col("l_discount") >= 0.09, given).otherwise(0.0)).alias("spend"))
    profit = F.col("units") * F.col("margin")
    return m.join(units, "p_brand", "left").select("p_brand", F.round("units", 4).alias("incremental_units"), F.round(profit, 4).alias("incremental_profit"),
                                                   F.round("spend", 4).alias("trade_spend"), F.round(S.safe_div(profit, "spend"), 6).alias("promo_return"))


@query("d14_unit_margin", """
SELECT p.p_brand, round((sum(l_extendedprice * (1 - l_discount)) - sum(l_quantity * p.p_retailprice * 0.5)) / sum(l_quantity), 6)
       AS margin_per_unit,
       round(sum(l_extendedprice * l_discount), 4) AS deductions,
       round(sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice * l_discount ELSE 0 END)
             / nullif(sum(l_extendedprice * l_discount), 0), 6) AS recovery_rate
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1""")
def unit_margin(spark, sf):
    lp = _lp(Tables(spark, sf))
    ded = F.col("l_extendedprice") * F.col("l_discount")
    return lp.groupBy("p_brand").agg(
        F.round((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
                 - F.sum(F.col("l_quantity") * F.col("p_retailprice") * 0.5)) / F.sum("l_quantity"), 6)
        .alias("margin_per_unit"),
        F.round(F.sum(ded), 4).alias("deductions"),
        F.round(S.safe_div(F.sum(F.when(F.col("l_linestatus") == "F", ded).otherwise(0.0)), F.sum(ded)), 6)
        .alias("recovery_rate"))


def _nation_factors(t: Tables):
    j = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return j.groupBy("s_nationkey").agg(
        F.count("*").alias("lines"), (F.sum("l_quantity") / F.count("*")).alias("qty_per_line"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price_per_unit"),
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_extendedprice")).alias("net_share"))


_NF_SQL = """nf AS (SELECT s.s_nationkey, count(*) AS lines, sum(l_quantity) / count(*) AS qty_per_line,
                   sum(l_extendedprice) / sum(l_quantity) AS price_per_unit,
                   sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice) AS net_share
            FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1),
 bm AS (SELECT avg(qty_per_line) AS b_q, avg(price_per_unit) AS b_p, avg(net_share) AS b_n FROM nf)"""


@query("d15_log_gap", f"""
WITH {_NF_SQL}
SELECT s_nationkey, round(ln(qty_per_line / b_q), 8) AS ln_qty, round(ln(price_per_unit / b_p), 8) AS ln_price,
       round(ln(net_share / b_n), 8) AS ln_net,
       round(ln(qty_per_line * price_per_unit * net_share / (b_q * b_p * b_n)), 8) AS ln_total
FROM nf, bm""")
def log_gap(spark, sf):
    nf = _nation_factors(Tables(spark, sf))
    b = {c: nf.select(F.avg(c)).scalar() for c in ("qty_per_line", "price_per_unit", "net_share")}
    return nf.select("s_nationkey", F.round(F.log(F.col("qty_per_line") / b["qty_per_line"]), 8).alias("ln_qty"),
                     F.round(F.log(F.col("price_per_unit") / b["price_per_unit"]), 8).alias("ln_price"),
                     F.round(F.log(F.col("net_share") / b["net_share"]), 8).alias("ln_net"),
                     F.round(F.log(F.col("qty_per_line") * F.col("price_per_unit") * F.col("net_share")
                                   / (b["qty_per_line"] * b["price_per_unit"] * b["net_share"])), 8).alias("ln_total"))


@query("d16_swap_one", f"""
WITH {_LP_SQL},
 n AS (SELECT s.s_nationkey, lp.p_type, sum(ok_qty) AS num, sum(l_quantity) AS den FROM lp
       JOIN supplier s ON lp.l_suppkey = s.s_suppkey GROUP BY 1, 2),
 tot AS (SELECT s_nationkey, sum(den) AS td FROM n GROUP BY 1),
 b AS (SELECT p_type, sum(num) / sum(den) AS rb, sum(den) / (SELECT sum(den) FROM n) AS wb FROM n GROUP BY 1),
 x AS (SELECT n.s_nationkey, n.p_type, n.den / tot.td AS we, n.num / n.den AS re, b.wb, b.rb
       FROM n JOIN tot USING (s_nationkey) JOIN b USING (p_type))
SELECT s_nationkey, round(sum(we * re) - sum(wb * rb), 8) AS gap, round(sum(wb * re) - sum(wb * rb), 8) AS rate_part,
       round(sum(we * rb) - sum(wb * rb), 8) AS mix_part FROM x GROUP BY 1""")
def swap_one(spark, sf):
    t = Tables(spark, sf)
    lp = _lp(t).join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    n = lp.groupBy("s_nationkey", "p_type").agg(F.sum("ok_qty").alias("num"), F.sum("l_quantity").alias("den"))
    tot = n.groupBy("s_nationkey").agg(F.sum("den").alias("td"))
    all_den = n.select(F.sum("den")).scalar()
    b = n.groupBy("p_type").agg((F.sum("num") / F.sum("den")).alias("rb"), (F.sum("den") / all_den).alias("wb"))
    x = n.join(tot, "s_nationkey").join(b, "p_type") \
        .select("s_nationkey", (F.col("den") / F.col("td")).alias("we"), (F.col("num") / F.col("den")).alias("re"),
                "wb", "rb")
    base = F.sum(F.col("wb") * F.col("rb"))
    return x.groupBy("s_nationkey").agg(
        F.round(F.sum(F.col("we") * F.col("re")) - base, 8).alias("gap"),
        F.round(F.sum(F.col("wb") * F.col("re")) - base, 8).alias("rate_part"),
        F.round(F.sum(F.col("we") * F.col("rb")) - base, 8).alias("mix_part"))


@query("d17_shapley_gap", f"""
WITH {_NF_SQL},
 f AS (SELECT s_nationkey, qty_per_line AS e0, price_per_unit AS e1, net_share AS e2, b_q AS b0, b_p AS b1, b_n AS b2 FROM nf, bm)
SELECT s_nationkey, factor, round(contribution, 6) AS contribution FROM (
  SELECT s_nationkey, 0 AS factor,
         (1.0/3) * ((e0 - b0) * b1 * b2) + (1.0/6) * ((e0 - b0) * e1 * b2) + (1.0/6) * ((e0 - b0) * b1 * e2)
         + (1.0/3) * ((e0 - b0) * e1 * e2) AS contribution FROM f
  UNION ALL
  SELECT s_nationkey, 1, (1.0/3) * (b0 * (e1 - b1) * b2) + (1.0/6) * (e0 * (e1 - b1) * b2) + (1.0/6) * (b0 * (e1 - b1) * e2)
         + (1.0/3) * (e0 * (e1 - b1) * e2) FROM f
  UNION ALL
  SELECT s_nationkey, 2, (1.0/3) * (b0 * b1 * (e2 - b2)) + (1.0/6) * (e0 * b1 * (e2 - b2)) + (1.0/6) * (b0 * e1 * (e2 - b2))
         + (1.0/3) * (e0 * e1 * (e2 - b2)) FROM f)""")
def shapley(spark, sf):
    nf = _nation_factors(Tables(spark, sf))
    facs = ["qty_per_line", "price_per_unit", "net_share"]
    bench = {c: nf.select(F.avg(c)).scalar() for c in facs}
    s = DG.shapley_gap(nf, "s_nationkey", facs, bench)
    return s.select("s_nationkey", "factor", F.round("contribution", 6).alias("contribution"))


def _supplier_totals(t: Tables):
    j = (t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
         .join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")), "s_nationkey"))
    return j.groupBy("n_regionkey", "l_suppkey").agg(F.sum("l_quantity").alias("qty"))


@query("d18_benchmark", """
WITH s AS (SELECT n.n_regionkey, l.l_suppkey, sum(l_quantity) AS qty FROM lineitem l
           JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY 1, 2),
 pm AS (SELECT a.n_regionkey, a.l_suppkey, quantile_cont(b.qty, 0.5) AS peer_median, quantile_cont(b.qty, 0.75) AS peer_p75,
               count(b.qty) AS n_peers
        FROM s a LEFT JOIN s b ON a.n_regionkey = b.n_regionkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2)
SELECT s.n_regionkey, s.l_suppkey, s.qty, round(pm.peer_median, 6) AS peer_median, round(pm.peer_p75, 6) AS peer_top_quartile,
       pm.n_peers, pm.n_peers >= 10 AS enough_peers,
       round(percent_rank() OVER (PARTITION BY s.n_regionkey ORDER BY s.qty, s.l_suppkey), 6) AS pct_rank
FROM s JOIN pm USING (n_regionkey, l_suppkey)""")
def benchmark(spark, sf):
    s = _supplier_totals(Tables(spark, sf))
    d = R.peer_median(s, ["n_regionkey"], "l_suppkey", "qty")
    d = DG.peer_quantile(d, ["n_regionkey"], "l_suppkey", "qty", 0.75, "peer_top_quartile")
    d = d.withColumn("n_peers", F.count("*").over(Window.partitionBy("n_regionkey")) - 1)
    d = d.withColumn("pct_rank", F.percent_rank().over(Window.partitionBy("n_regionkey").orderBy("qty", "l_suppkey")))
    return d.select("n_regionkey", "l_suppkey", "qty", F.round("peer_median", 6).alias("peer_median"),
                    F.round("peer_top_quartile", 6).alias("peer_top_quartile"), "n_peers",
                    (F.col("n_peers") >= 10).alias("enough_peers"), F.round("pct_rank", 6).alias("pct_rank"))


@query("d19_gap", """
WITH s AS (SELECT n.n_regionkey, l.l_suppkey, sum(l_quantity) AS qty FROM lineitem l
           JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY 1, 2),
 pm AS (SELECT a.n_regionkey, a.l_suppkey, quantile_cont(b.qty, 0.5) AS peer_median, quantile_cont(b.qty, 0.75) AS peer_p75
        FROM s a LEFT JOIN s b ON a.n_regionkey = b.n_regionkey AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2)
SELECT s.l_suppkey, round(s.qty - pm.peer_median, 6) AS gap, round((s.qty - pm.peer_median) * 100.0 / pm.peer_median, 6) AS gap_pct,
       sign(s.qty - pm.peer_median) = sign(s.qty - pm.peer_p75) AS robust_to_benchmark,
       CASE WHEN s.qty >= pm.peer_median THEN 'strength' ELSE 'gap' END AS kind
FROM s JOIN pm USING (n_regionkey, l_suppkey)""")
def gap(spark, sf):
    s = _supplier_totals(Tables(spark, sf))
    d = R.peer_median(s, ["n_regionkey"], "l_suppkey", "qty")
    d = DG.peer_quantile(d, ["n_regionkey"], "l_suppkey", "qty", 0.75, "p75")
    g = F.col("qty") - F.col("peer_median")
    return d.select("l_suppkey", F.round(g, 6).alias("gap"), F.round(S.safe_div(g * 100.0, "peer_median"), 6)
                    .alias("gap_pct"),
                    (F.signum(g) == F.signum(F.col("qty") - F.col("p75"))).alias("robust_to_benchmark"),
                    F.when(F.col("qty") >= F.col("peer_median"), "strength").otherwise("gap").alias("kind"))


# limits table: a parameter (metric, concern below, target at or above)
LIMITS = [("rate", 0.6, 0.7), ("avg_discount", 0.04, 0.06)]


@query("d21_threshold_check", """
WITH m AS (SELECT r.r_name, 'rate' AS metric,
                  sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS value
           FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
           JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1
           UNION ALL
           SELECT r.r_name, 'avg_discount', avg(l_discount)
           FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
           JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1),
 lim AS (SELECT * FROM (VALUES ('rate', 0.6, 0.7), ('avg_discount', 0.04, 0.06)) t(metric, concern, target))
SELECT r_name, metric, round(value, 6) AS value,
       CASE WHEN value < concern THEN 'concern' WHEN value >= target THEN 'on_target' ELSE 'watch' END AS status
FROM m JOIN lim USING (metric)""")
def threshold_check(spark, sf):
    t = Tables(spark, sf)
    j = (t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
         .join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")), "s_nationkey")
         .join(F.broadcast(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")), "n_regionkey"))
    ok = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)
    g = j.groupBy("r_name").agg((F.sum(ok) / F.sum("l_quantity")).alias("rate"), F.avg("l_discount").alias("avg_discount"))
    m = g.unpivot("r_name", ["rate", "avg_discount"], "metric", "value")
    lim = spark.createDataFrame(LIMITS, "metric string, concern double, target double")
    j2 = m.join(F.broadcast(lim), "metric")
    return j2.select("r_name", "metric", F.round("value", 6).alias("value"),
                     F.when(F.col("value") < F.col("concern"), "concern")
                     .when(F.col("value") >= F.col("target"), "on_target").otherwise("watch").alias("status"))


@query("d22_model_ready", """
SELECT count(*) AS n_rows, 4 AS n_predictors, count(*) / 4.0 AS rows_per_predictor,
       least(count_if(l_returnflag = 'R'), count_if(l_returnflag <> 'R')) AS minority_class_rows,
       least(count_if(l_returnflag = 'R'), count_if(l_returnflag <> 'R')) / 4.0 >= 10 AS enough_events_per_predictor
FROM lineitem""")
def model_ready(spark, sf):
    li = Tables(spark, sf).lineitem
    k = 4
    minority = F.least(F.count_if(F.col("l_returnflag") == "R"), F.count_if(F.col("l_returnflag") != "R"))
    return li.agg(F.count("*").alias("n_rows"), F.lit(k).alias("n_predictors"),
                  (F.count("*") / float(k)).alias("rows_per_predictor"), minority.alias("minority_class_rows"),
                  (minority / float(k) >= 10).alias("enough_events_per_predictor"))


@query("d24_premise", """
WITH m AS (SELECT s.s_nationkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS qty
           FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
 r AS (SELECT *, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY month DESC) AS rk FROM m),
 g AS (SELECT s_nationkey, avg(CASE WHEN rk <= 6 THEN qty END) AS m1, var_samp(CASE WHEN rk <= 6 THEN qty END) AS v1,
              count(CASE WHEN rk <= 6 THEN qty END) AS n1, avg(CASE WHEN rk > 6 THEN qty END) AS m2,
              var_samp(CASE WHEN rk > 6 THEN qty END) AS v2, count(CASE WHEN rk > 6 THEN qty END) AS n2
       FROM r WHERE rk <= 12 GROUP BY 1),
 z AS (SELECT s_nationkey, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t FROM g)
SELECT s_nationkey, round(t, 6) AS t,
       CASE WHEN t > 1.959963984540054 THEN 'verified' WHEN t < -1.959963984540054 THEN 'refuted' ELSE 'undetermined' END
         AS premise
FROM z""")
def premise(spark, sf):
    """'Quantity rose over the last six months': verified / refuted /
    undetermined from a Welch statistic of last-6 vs previous-6 months."""
    t = Tables(spark, sf)
    j = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    m = j.groupBy("s_nationkey", F.to_date(F.date_trunc("MONTH", "l_shipdate")).alias("month")) \
        .agg(F.sum("l_quantity").alias("qty"))
    r = m.withColumn("rk", F.dense_rank().over(Window.partitionBy("s_nationkey").orderBy(F.col("month").desc()))) \
        .where("rk <= 12").withColumn("half", F.when(F.col("rk") <= 6, "last").otherwise("prev"))
    w = X.welch_t(r, "qty", "half", "last", "prev", "s_nationkey")
    z = X.Z975
    return w.select("s_nationkey", "t", F.when(F.col("t") > z, "verified").when(F.col("t") < -z, "refuted")
                    .otherwise("undetermined").alias("premise"))


@query("d25_conditional_profile", """
WITH b AS (SELECT CAST(least(9, floor(l_discount * 100)) AS INTEGER) AS bin, l_extendedprice, l_returnflag FROM lineitem)
SELECT bin, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS median_y,
       round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 6) AS iqr_y,
       round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS return_rate
FROM b GROUP BY bin""")
def conditional_profile(spark, sf):
    li = Tables(spark, sf).lineitem.withColumn("bin", F.least(F.lit(9), F.floor(F.col("l_discount") * 100)).cast("int"))
    g = li.groupBy("bin").agg(F.count("*").alias("n"),
                              F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("rr"))
    q = R.exact_quantiles(li, ["bin"], "l_extendedprice", [0.25, 0.5, 0.75], names=["q1", "q2", "q3"])
    g = g.join(q, "bin")
    return g.select("bin", "n", F.round("q2", 6).alias("median_y"),
                    F.round(F.col("q3") - F.col("q1"), 6).alias("iqr_y"), F.round("rr", 6).alias("return_rate"))


@query("d26_what_if")
def what_if(spark, sf):
    """Outcome change when each driver moves by one standard deviation,
    from multivariable OLS coefficients, ranked by absolute effect."""
    li = Tables(spark, sf).lineitem
    drivers = ["l_quantity", "l_discount", "l_tax"]
    coef = X.regress(li, "l_extendedprice", drivers).where("term <> '(intercept)'")
    sds = li.select(*[F.stddev_samp(c).alias(c) for c in drivers]) \
        .unpivot([], drivers, "term", "sd")
    j = coef.join(sds, "term").withColumn("effect_of_1sd", F.col("coefficient") * F.col("sd"))
    return j.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("effect_of_1sd").desc())))


@query("d23_rank_drivers")
def rank_drivers(spark, sf):
    """Drivers of return rate ranked by |effect| x tests surviving
    correction x lenses (correlation, group difference) agreeing."""
    li = Tables(spark, sf).lineitem.withColumn("ret", (F.col("l_returnflag") == "R").cast("double"))
    rows = []
    for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice"):
        p = X.pearson(li, c, "ret").select(F.lit(c).alias("driver"), F.col("r").alias("effect"), "p_value")
        rows.append(p)
    from functools import reduce
    st = reduce(lambda a, b: a.unionByName(b), rows)
    st = X.adjust_p(st, [], "p_value", "holm", "p_holm")
    return st.withColumn("score", F.abs("effect") * F.when(F.col("p_holm") < 0.05, 2).otherwise(1)) \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("driver"))))
