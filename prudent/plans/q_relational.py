"""Relational queries (P, J, A, W, T, U) over the driver tables.

Stand-ins (see SURVEY 7.4): ``lineitem`` is the entity x product x date fact
(supplier = entity, part = product, ship date = date); the first-pass rate is
sum(quantity not returned) / sum(quantity).  ``orders`` / ``customer`` give a
second fact and the cohorts; ``events`` gives stops / visits.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prudent.functions import scalar as S
from prudent.operators import relational as R
from prudent.plans.registry import Tables, query

CUTOFF = "1996-01-01"

# first-pass quantity rate, the ratio-of-sums metric used across queries
def ok_qty():
    return F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0)

RATE_SQL = ("round(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) "
            "/ nullif(sum(l_quantity), 0), 6)")


def rate():
    return F.round(R.ratio(ok_qty(), "l_quantity"), 6)


def scoped_lines(t: Tables):
    """Standard scope on the fact (date cutoff, sentinel supplier)."""
    return R.scope(t.lineitem, "l_shipdate", CUTOFF, "l_suppkey", (9999,))


SCOPE_SQL = f"l_shipdate >= TIMESTAMP '{CUTOFF}' AND l_suppkey <> 9999"


# -- the minimum slice: P01 + J01 + A01 + A06 + T01 -------------------------
@query("t01_worst_supplier_nations", f"""
SELECT n.n_name, {RATE_SQL} AS rate, sum(l_quantity) AS volume, count(*) AS n_lines
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
WHERE {SCOPE_SQL}
GROUP BY n.n_name HAVING sum(l_quantity) > 1000
ORDER BY rate ASC, n.n_name ASC LIMIT 20""")
def worst_supplier_nations(spark, sf):
    t = Tables(spark, sf)
    f = scoped_lines(t).select("l_suppkey", "l_quantity", "l_returnflag")
    j = R.join_dim(f, t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    j = R.join_dim(j, t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey",
                   bounded=True)
    g = (j.groupBy("n_name").agg(rate().alias("rate"), F.sum("l_quantity").alias("volume"),
                                 F.count("*").alias("n_lines"))
         .where(F.col("volume") > 1000))
    return R.top_k(g, [F.col("rate").asc(), F.col("n_name").asc()], 20)


@query("a01_overall_rate", f"""
SELECT {RATE_SQL} AS rate, sum(l_quantity) AS volume FROM lineitem WHERE {SCOPE_SQL}""")
def overall_rate(spark, sf):
    t = Tables(spark, sf)
    return scoped_lines(t).agg(rate().alias("rate"), F.sum("l_quantity").alias("volume"))


@query("a01_weekly_rate", f"""
SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, {RATE_SQL} AS rate,
       sum(l_quantity) AS volume
FROM lineitem WHERE {SCOPE_SQL} GROUP BY 1""")
def weekly_rate(spark, sf):
    t = Tables(spark, sf)
    return (scoped_lines(t).groupBy(S.week_start("l_shipdate").alias("week"))
            .agg(rate().alias("rate"), F.sum("l_quantity").alias("volume")))


@query("a06_rate_by_brand", f"""
SELECT p.p_brand, {RATE_SQL} AS rate, sum(l_quantity) AS volume
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE {SCOPE_SQL} GROUP BY p.p_brand HAVING sum(l_quantity) > 500""")
def rate_by_brand(spark, sf):
    t = Tables(spark, sf)
    j = R.join_dim(scoped_lines(t), t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return (j.groupBy("p_brand").agg(rate().alias("rate"), F.sum("l_quantity").alias("volume"))
            .where(F.col("volume") > 500))


@query("t01_worst_parts", f"""
SELECT p.p_partkey, p.p_name, {RATE_SQL} AS rate, sum(l_quantity) AS volume
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE {SCOPE_SQL} GROUP BY p.p_partkey, p.p_name HAVING sum(l_quantity) > 100
ORDER BY rate ASC, p.p_partkey ASC LIMIT 20""")
def worst_parts(spark, sf):
    t = Tables(spark, sf)
    j = R.join_dim(scoped_lines(t), t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    g = (j.groupBy(F.col("l_partkey").alias("p_partkey"), "p_name")
         .agg(rate().alias("rate"), F.sum("l_quantity").alias("volume")).where(F.col("volume") > 100))
    return R.top_k(g, [F.col("rate").asc(), F.col("p_partkey").asc()], 20)


@query("a03_attribution", f"""
SELECT l_linestatus,
       count_if(l_returnflag = 'R') AS returned_lines,
       count_if(l_returnflag = 'A') AS accepted_lines,
       round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 4) AS returned_qty,
       round(sum(CASE WHEN l_discount >= 0.05 THEN l_extendedprice ELSE 0 END), 4) AS discounted_value
FROM lineitem WHERE {SCOPE_SQL} GROUP BY l_linestatus""")
def attribution(spark, sf):
    t = Tables(spark, sf)
    return scoped_lines(t).groupBy("l_linestatus").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned_lines"),
        F.count_if(F.col("l_returnflag") == "A").alias("accepted_lines"),
        F.round(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)), 4)
        .alias("returned_qty"),
        F.round(F.sum(F.when(F.col("l_discount") >= 0.05, F.col("l_extendedprice")).otherwise(0.0)), 4)
        .alias("discounted_value"))


def _lines_region(t: Tables):
    sup = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nat = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    reg = t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    j = R.join_dim(scoped_lines(t), sup, "l_suppkey")
    j = R.join_dim(j, nat, "s_nationkey", bounded=True)
    return R.join_dim(j, reg, "n_regionkey", bounded=True)


_LINES_REGION_SQL = f"""lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE {SCOPE_SQL}"""


@query("a05_distinct_by_region", f"""
SELECT r.r_name, {RATE_SQL} AS rate, count(DISTINCT l.l_suppkey) AS n_suppliers,
       count(DISTINCT l.l_partkey) AS n_parts
FROM {_LINES_REGION_SQL} GROUP BY r.r_name""")
def distinct_by_region(spark, sf):
    j = _lines_region(Tables(spark, sf))
    return j.groupBy("r_name").agg(rate().alias("rate"), F.count_distinct("l_suppkey").alias("n_suppliers"),
                                   F.count_distinct("l_partkey").alias("n_parts"))


@query("a04_share_by_region", f"""
SELECT r.r_name,
       round(sum(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.05 THEN 1 ELSE 0 END)
             / nullif(sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END), 0), 6) AS share,
       sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) AS events
FROM {_LINES_REGION_SQL} GROUP BY r.r_name
HAVING sum(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END) > 100""")
def share_by_region(spark, sf):
    j = _lines_region(Tables(spark, sf))
    flag = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.05)
    base = F.col("l_discount") >= 0.05
    return (j.groupBy("r_name").agg(F.round(R.share_where(flag, base), 6).alias("share"),
                                    F.sum(F.when(base, 1).otherwise(0)).cast("bigint").alias("events"))
            .where(F.col("events") > 100))


@query("j07_chain_rate", f"""
SELECT r.r_name, p.p_type, {RATE_SQL} AS rate, sum(l_quantity) AS volume
FROM {_LINES_REGION_SQL.replace('WHERE', 'JOIN part p ON l.l_partkey = p.p_partkey WHERE')}
GROUP BY r.r_name, p.p_type""")
def chain_rate(spark, sf):
    t = Tables(spark, sf)
    j = R.join_dim(_lines_region(t), t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return j.groupBy("r_name", "p_type").agg(rate().alias("rate"), F.sum("l_quantity").alias("volume"))


@query("j06_align_facts", f"""
WITH li AS (
  SELECT s.s_nationkey AS nationkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         sum(l_quantity) AS qty, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS ok_qty
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE {SCOPE_SQL} GROUP BY 1, 2),
 od AS (
  SELECT c.c_nationkey AS nationkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         count(*) AS n_orders, round(sum(o_totalprice), 2) AS order_value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o_orderdate >= TIMESTAMP '{CUTOFF}' GROUP BY 1, 2)
SELECT coalesce(li.nationkey, od.nationkey) AS nationkey, coalesce(li.month, od.month) AS month,
       li.qty, round(li.ok_qty / nullif(li.qty, 0), 6) AS rate, od.n_orders, od.order_value
FROM li FULL OUTER JOIN od ON li.nationkey = od.nationkey AND li.month = od.month""")
def align(spark, sf):
    t = Tables(spark, sf)
    li = R.join_dim(scoped_lines(t), t.supplier.select(F.col("s_suppkey").alias("l_suppkey"),
                                                       F.col("s_nationkey").alias("nationkey")), "l_suppkey")
    li = li.withColumn("month", F.to_date(F.date_trunc("MONTH", "l_shipdate")))
    od = R.join_dim(t.orders.where(F.col("o_orderdate") >= F.lit(CUTOFF).cast("timestamp_ntz")),
                    t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nationkey")),
                    "o_custkey").withColumn("month", F.to_date(F.date_trunc("MONTH", "o_orderdate")))
    out = R.align_facts({
        "lines": (li, [F.sum("l_quantity").alias("qty"), F.sum(ok_qty()).alias("ok_qty")]),
        "orders": (od, [F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("order_value")]),
    }, ["nationkey", "month"])
    return out.select("nationkey", "month", "qty", F.round(S.safe_div("ok_qty", "qty"), 6).alias("rate"),
                      "n_orders", "order_value")


@query("j03_attach_activity", f"""
WITH base AS (
  SELECT s.s_nationkey AS nationkey, year(l_shipdate) AS yr, sum(l_quantity) AS qty
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE {SCOPE_SQL} GROUP BY 1, 2),
 act AS (
  SELECT c.c_nationkey AS nationkey, year(o_orderdate) AS yr, count(*) AS urgent_orders
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY 1, 2)
SELECT base.nationkey, base.yr, base.qty, coalesce(act.urgent_orders, 0) AS urgent_orders,
       CAST(act.urgent_orders IS NOT NULL AS INTEGER) AS has_activity
FROM base LEFT JOIN act ON base.nationkey = act.nationkey AND base.yr = act.yr""")
def attach(spark, sf):
    t = Tables(spark, sf)
    li = R.join_dim(scoped_lines(t), t.supplier.select(F.col("s_suppkey").alias("l_suppkey"),
                                                       F.col("s_nationkey").alias("nationkey")), "l_suppkey")
    base = li.groupBy("nationkey", F.year("l_shipdate").alias("yr")).agg(F.sum("l_quantity").alias("qty"))
    od = R.join_dim(t.orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")),
                    t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nationkey")),
                    "o_custkey")
    act = od.groupBy("nationkey", F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("urgent_orders"))
    return R.attach_activity(base, act, ["nationkey", "yr"], ["urgent_orders"])


@query("j08_calendar_rate", f"""
WITH cal AS (
  SELECT CAST(d AS DATE) AS cal_date,
         CAST(strftime(CAST(d AS DATE), '%Y%m%d') AS INTEGER) AS date_sid,
         isoyear(d) AS iso_year, week(d) AS iso_week
  FROM (SELECT unnest(generate_series(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)),
                                      INTERVAL 1 DAY)) AS d FROM lineitem))
SELECT cal.iso_year, cal.iso_week, {RATE_SQL} AS rate, sum(l_quantity) AS volume
FROM lineitem l JOIN cal ON CAST(strftime(CAST(l.l_shipdate AS DATE), '%Y%m%d') AS VARCHAR) = CAST(cal.date_sid AS VARCHAR)
WHERE {SCOPE_SQL} GROUP BY 1, 2""")
def calendar_rate(spark, sf):
    t = Tables(spark, sf)
    cal = R.calendar_from(t.lineitem, "l_shipdate")
    # the fact carries its date as text yyyymmdd (as warehouse facts do); the
    # calendar key is numeric: parse the text key with the safe parser
    f = scoped_lines(t).withColumn("date_txt", F.date_format("l_shipdate", "yyyyMMdd"))
    f = f.withColumn("cal_date", S.safe_date("date_txt"))
    j = R.join_dim(f, cal, "cal_date")
    return j.groupBy("iso_year", "iso_week").agg(rate().alias("rate"), F.sum("l_quantity").alias("volume"))


@query("a18_by_weekday", f"""
SELECT dayname(l_shipdate) AS weekday, count(*) AS n_lines, {RATE_SQL} AS rate
FROM lineitem WHERE {SCOPE_SQL} GROUP BY 1""")
def by_weekday(spark, sf):
    t = Tables(spark, sf)
    d = scoped_lines(t).withColumn("weekday", F.date_format("l_shipdate", "EEEE"))
    return d.groupBy("weekday").agg(F.count("*").alias("n_lines"), rate().alias("rate"))


@query("w01_best_row_bridge", """
WITH k AS (
  SELECT c.*, try_cast(nullif(regexp_extract(c_name, '#0*([0-9]+)$', 1), '') AS BIGINT) AS cust_no,
         CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS penalty
  FROM customer c),
 r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment
                                    ORDER BY penalty ASC, cust_no DESC) AS rn FROM k)
SELECT c_nationkey, c_mktsegment, cust_no, c_custkey, penalty FROM r WHERE rn = 1""")
def best_row_bridge(spark, sf):
    t = Tables(spark, sf)
    k = t.customer.withColumn("cust_no", S.extract_int("c_name", r"#0*([0-9]+)$")) \
        .withColumn("penalty", F.when(F.col("c_acctbal") < 0, 1).otherwise(0))
    b = R.best_row(k, ["c_nationkey", "c_mktsegment"], [F.col("penalty").asc(), F.col("cust_no").desc()])
    return b.select("c_nationkey", "c_mktsegment", "cust_no", "c_custkey", "penalty")


@query("u01_product_bridge", """
WITH keys AS (
  SELECT DISTINCT l_partkey AS key, 'l_partkey' AS key_source FROM lineitem
  UNION ALL SELECT DISTINCT p_partkey AS key, 'p_partkey' AS key_source FROM part),
 dedup AS (SELECT key, min(key_source) AS first_source, max(key_source) AS last_source, count(*) AS n_sources
           FROM keys GROUP BY key)
SELECT d.key, d.first_source, d.last_source, d.n_sources,
       coalesce(p.p_brand, 'UNKNOWN') AS brand, coalesce(p.p_type, 'UNKNOWN') AS ptype
FROM dedup d LEFT JOIN part p ON d.key = p.p_partkey""")
def product_bridge(spark, sf):
    t = Tables(spark, sf)
    keys = R.stack_keys(t.lineitem.select(F.col("l_partkey"), F.lit(None).cast("bigint").alias("p_partkey")),
                        ["l_partkey"]) \
        .unionByName(R.stack_keys(t.part, ["p_partkey"]))
    d = keys.groupBy("key").agg(F.min("key_source").alias("first_source"), F.max("key_source").alias("last_source"),
                                F.count("*").alias("n_sources"))
    j = d.join(t.part.select(F.col("p_partkey").alias("key"), "p_brand", "p_type"), "key", "left")
    return j.select("key", "first_source", "last_source", "n_sources",
                    R.coalesce_cols("p_brand", F.lit("UNKNOWN")).alias("brand"),
                    R.coalesce_cols("p_type", F.lit("UNKNOWN")).alias("ptype"))


@query("a08_dedup_minmax", """
SELECT l_partkey, CAST(min(l_shipdate) AS DATE) AS first_ship, CAST(max(l_shipdate) AS DATE) AS last_ship,
       min(l_returnflag) AS min_flag, max(l_extendedprice) AS max_price
FROM lineitem GROUP BY l_partkey""")
def dedup_minmax(spark, sf):
    t = Tables(spark, sf)
    d = t.lineitem.select("l_partkey", F.to_date("l_shipdate").alias("first_ship"),
                          F.to_date("l_shipdate").alias("last_ship"), F.col("l_returnflag").alias("min_flag"),
                          F.col("l_extendedprice").alias("max_price"))
    return R.dedup_minmax(d, ["l_partkey"], mins=["first_ship", "min_flag"], maxs=["last_ship", "max_price"])


@query("a08_dedup_maxby", """
SELECT l_partkey, max_by(l_orderkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS last_order,
       max_by(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS last_supplier
FROM lineitem GROUP BY l_partkey""")
def dedup_maxby(spark, sf):
    t = Tables(spark, sf)
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return R.dedup_maxby(t.lineitem, ["l_partkey"], order, ["l_orderkey", "l_suppkey"]) \
        .withColumnsRenamed({"l_orderkey": "last_order", "l_suppkey": "last_supplier"})


@query("j02_keep_known", f"""
SELECT count(*) AS n_lines, round(sum(l_quantity), 2) AS qty
FROM lineitem l WHERE {SCOPE_SQL} AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 25)""")
def keep_known(spark, sf):
    t = Tables(spark, sf)
    k = R.keep_known(scoped_lines(t), t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey")),
                     "l_partkey")
    return k.agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("j05_join_current", """
SELECT CAST(date_trunc('week', o.o_orderdate) AS DATE) AS week,
       count(*) AS n_orders,
       count(DISTINCT try_cast(nullif(regexp_extract(c.c_name, '#0*([0-9]+)$', 1), '') AS BIGINT)) AS n_customers
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING' AND c.c_acctbal > 0
GROUP BY 1""")
def join_current(spark, sf):
    t = Tables(spark, sf)
    j = R.join_current(t.orders, t.customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey",
                       ["c_mktsegment = 'BUILDING'", "c_acctbal > 0"])
    j = j.withColumn("cust_no", S.extract_int("c_name", r"#0*([0-9]+)$"))
    return j.groupBy(S.week_start("o_orderdate").alias("week")).agg(
        F.count("*").alias("n_orders"), F.count_distinct("cust_no").alias("n_customers"))


@query("u02_match_sample", """
WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT c.c_custkey, c.c_name, k.o_custkey IS NOT NULL AS matched
FROM customer c LEFT JOIN k ON c.c_custkey = k.o_custkey
ORDER BY c.c_custkey LIMIT 50""")
def match_sample(spark, sf):
    t = Tables(spark, sf)
    k = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct() \
        .withColumn("__m", F.lit(True))
    j = t.customer.select("c_custkey", "c_name").join(k, "c_custkey", "left")
    return R.top_k(j.select("c_custkey", "c_name", F.col("__m").isNotNull().alias("matched")),
                   [F.col("c_custkey").asc()], 50)


@query("j11_coverage_classes", """
WITH base AS (SELECT c_custkey, c_nationkey FROM customer),
 f AS (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_final
       FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_custkey),
 cls AS (
  SELECT CASE WHEN n.n_nationkey IS NULL THEN 'no_bridge'
              WHEN f.o_custkey IS NULL THEN 'no_rows'
              WHEN f.n_final = 0 THEN 'rows_all_zero'
              ELSE 'active' END AS coverage_class, b.c_custkey
  FROM base b LEFT JOIN nation n ON b.c_nationkey = n.n_nationkey AND n.n_regionkey <> 4
  LEFT JOIN f ON b.c_custkey = f.o_custkey)
SELECT coverage_class, count(DISTINCT c_custkey) AS n_entities,
       round(count(DISTINCT c_custkey) * 100.0 / sum(count(DISTINCT c_custkey)) OVER (), 4) AS pct
FROM cls GROUP BY coverage_class""")
def coverage_classes(spark, sf):
    t = Tables(spark, sf)
    base = t.customer.select("c_custkey", "c_nationkey")
    bridge = t.nation.where("n_regionkey <> 4").select(F.col("n_nationkey").alias("c_nationkey"),
                                                       F.lit(1).alias("__b"))
    f = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy(
        F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("n_final"))
    j = base.join(F.broadcast(bridge), "c_nationkey", "left").join(f, "c_custkey", "left")
    cls = R.classify([(F.col("__b").isNull(), "no_bridge"), (F.col("n").isNull(), "no_rows"),
                      (F.col("n_final") == 0, "rows_all_zero")], "active")
    g = j.withColumn("coverage_class", cls).groupBy("coverage_class").agg(
        F.count_distinct("c_custkey").alias("n_entities"))
    return R.pct_of_total(g, "n_entities", out="pct")


@query("j12_join_coverage", """
WITH l AS (SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IS NOT NULL),
 m AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')
SELECT (SELECT count(*) FROM l WHERE c_custkey IN (SELECT o_custkey FROM m)) AS matched,
       (SELECT count(*) FROM l) AS total,
       round((SELECT count(*) FROM l WHERE c_custkey IN (SELECT o_custkey FROM m)) * 100.0
             / nullif((SELECT count(*) FROM l), 0), 2) AS coverage_pct""")
def join_coverage(spark, sf):
    t = Tables(spark, sf)
    right = t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'") \
        .select(F.col("o_custkey").alias("c_custkey"))
    return R.join_coverage(t.customer, right, ["c_custkey"])


@query("j13_unmatched", """
SELECT c_mktsegment, count(*) AS n_unmatched FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT'
                  AND o.o_orderstatus = 'O')
GROUP BY c_mktsegment""")
def unmatched(spark, sf):
    t = Tables(spark, sf)
    right = t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'") \
        .select(F.col("o_custkey").alias("c_custkey"))
    return R.unmatched(t.customer, right, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n_unmatched"))


# -- J09: range join of error events with signup-to-next-signup spans ------
def _spans(ev):
    """From a signup to the user's next; the last one lasts to the end of the log."""
    s = ev.where("event_type = 'signup'").select("user_id", F.col("ts").alias("span_start"),
                                                 F.col("event_id").alias("span_id"))
    w = Window.partitionBy("user_id").orderBy("span_start", "span_id")
    end = ev.select(F.max("ts") + F.expr("INTERVAL 1 SECOND")).scalar()
    return s.withColumn("span_end", F.coalesce(F.lead("span_start").over(w), end))


@query("j09_range_join", """
WITH s AS (SELECT user_id, ts AS span_start, event_id AS span_id,
                  coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP 'infinity') AS span_end
           FROM events WHERE event_type = 'signup'),
 sp AS (SELECT * FROM s)
SELECT sp.span_id, sp.user_id, count(*) AS n_errors, round(sum(e.value), 4) AS error_value
FROM sp JOIN events e ON e.user_id = sp.user_id AND e.event_type = 'error'
 AND e.ts >= sp.span_start AND e.ts < sp.span_end
GROUP BY sp.span_id, sp.user_id""")
def range_join(spark, sf):
    t = Tables(spark, sf)
    pts = t.events.where("event_type = 'error'").select("user_id", "ts", "value")
    j = R.range_join(pts, _spans(t.events), "user_id", "ts", "span_start", "span_end", bin_seconds=86400)
    return j.groupBy("span_id", "user_id").agg(F.count("*").alias("n_errors"),
                                               F.round(F.sum("value"), 4).alias("error_value"))


@query("j10_relationship", """
WITH l AS (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey)),
 r AS (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM part GROUP BY p_partkey))
SELECT l.m AS left_max_per_key, r.m AS right_max_per_key,
       CASE WHEN l.m <= 1 AND r.m <= 1 THEN 'one_to_one' WHEN r.m <= 1 THEN 'many_to_one'
            WHEN l.m <= 1 THEN 'one_to_many' ELSE 'many_to_many' END AS kind,
       r.m <= 1 AS right_unique
FROM l, r""")
def relationship(spark, sf):
    t = Tables(spark, sf)
    return R.relationship_check(t.lineitem.select(F.col("l_partkey").alias("k")),
                                t.part.select(F.col("p_partkey").alias("k")), ["k"])


# -- findings-like windows from orders: run = priority, entity = nation ----
def order_findings(t: Tables):
    o = R.join_dim(t.orders, t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return (o.groupBy(F.col("o_orderpriority").alias("run_id"), F.col("c_nationkey").alias("entity"),
                      "o_orderstatus")
            .agg(F.to_date(F.min("o_orderdate")).alias("window_start"),
                 F.to_date(F.max("o_orderdate")).alias("window_end"))
            .withColumn("finding_id", F.concat_ws(":", "run_id", F.col("entity").cast("string"), "o_orderstatus")))


ORDER_FINDINGS_SQL = """findings AS (
  SELECT o_orderpriority AS run_id, c.c_nationkey AS entity, o_orderstatus,
         CAST(min(o_orderdate) AS DATE) AS window_start, CAST(max(o_orderdate) AS DATE) AS window_end,
         concat_ws(':', o_orderpriority, CAST(c.c_nationkey AS VARCHAR), o_orderstatus) AS finding_id
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3)"""


@query("j14_overlap_pairs", f"""
WITH {ORDER_FINDINGS_SQL}
SELECT a.entity, a.finding_id AS a_id, b.finding_id AS b_id, a.run_id AS a_run, b.run_id AS b_run
FROM findings a JOIN findings b ON a.entity = b.entity AND a.run_id < b.run_id
 AND a.window_start <= b.window_end AND b.window_start <= a.window_end""")
def overlap(spark, sf):
    p = R.overlap_pairs(order_findings(Tables(spark, sf)), bin_days=30)
    return p.select("entity", "a_id", "b_id", "a_run", "b_run")


@query("j15_non_connections", f"""
WITH {ORDER_FINDINGS_SQL},
 f2 AS (SELECT * FROM findings WHERE o_orderstatus <> 'P' OR run_id = '1-URGENT'),
 pairs AS (SELECT a.finding_id AS a_id, b.finding_id AS b_id FROM f2 a JOIN f2 b
           ON a.entity = b.entity AND a.run_id < b.run_id AND a.window_start <= b.window_end
           AND b.window_start <= a.window_end AND a.o_orderstatus = b.o_orderstatus)
SELECT finding_id, entity, run_id FROM f2
WHERE finding_id NOT IN (SELECT a_id FROM pairs UNION SELECT b_id FROM pairs)""")
def non_conn(spark, sf):
    f = order_findings(Tables(spark, sf)).where("o_orderstatus <> 'P' OR run_id = '1-URGENT'")
    p = R.overlap_pairs(f, bin_days=30)
    st = f.select(F.col("finding_id").alias("a_id"), F.col("o_orderstatus").alias("sa"))
    st2 = f.select(F.col("finding_id").alias("b_id"), F.col("o_orderstatus").alias("sb"))
    p = p.join(st, "a_id").join(st2, "b_id").where("sa = sb")
    return R.non_connections(f, p).select("finding_id", "entity", "run_id")


@query("j16_peers", """
WITH own AS (SELECT s.s_nationkey, l.l_suppkey, sum(l_quantity) AS qty
             FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2)
SELECT a.s_nationkey, a.l_suppkey, a.qty AS own_qty,
       coalesce((SELECT sum(b.qty) FROM own b WHERE b.s_nationkey = a.s_nationkey AND b.l_suppkey <> a.l_suppkey), 0)
         AS peer_qty,
       (SELECT count(*) FROM own b WHERE b.s_nationkey = a.s_nationkey) - 1 AS n_peers
FROM own a""")
def peers(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    p = R.peers(j, "l_suppkey", "s_nationkey", ["l_quantity"])
    return p.select("s_nationkey", "l_suppkey", F.col("own_l_quantity").alias("own_qty"),
                    F.col("peer_l_quantity").alias("peer_qty"), "n_peers")


@query("j17_cross_item", """
WITH lw AS (SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, l_partkey,
                   sum(l_quantity) AS qty, max(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) AS promo
            FROM lineitem GROUP BY 1, 2, 3),
 pw AS (SELECT DISTINCT l_suppkey, week, l_partkey AS promo_part FROM lw WHERE promo = 1)
SELECT CASE WHEN EXISTS (SELECT 1 FROM pw WHERE pw.l_suppkey = lw.l_suppkey AND pw.week = lw.week
                         AND pw.promo_part <> lw.l_partkey) THEN 1 ELSE 0 END AS other_promoted,
       count(*) AS n_cells, round(avg(qty), 6) AS avg_qty
FROM lw WHERE promo = 0 GROUP BY 1""")
def cross_item(spark, sf):
    t = Tables(spark, sf)
    lw = t.lineitem.groupBy("l_suppkey", S.week_start("l_shipdate").alias("week"), "l_partkey").agg(
        F.sum("l_quantity").alias("qty"), F.max(F.when(F.col("l_discount") >= 0.09, 1).otherwise(0)).alias("promo"))
    # promoted items per (entity, week): count them; an unpromoted row has a
    # promoted *other* item when the cell count is > 0 (it is not itself promoted)
    pw = lw.where("promo = 1").groupBy("l_suppkey", "week").agg(F.count("*").alias("n_promo"))
    j = lw.where("promo = 0").join(pw, ["l_suppkey", "week"], "left")
    return (j.withColumn("other_promoted", F.when(F.col("n_promo") > 0, 1).otherwise(0))
            .groupBy("other_promoted").agg(F.count("*").alias("n_cells"), F.round(F.avg("qty"), 6).alias("avg_qty")))


@query("j18_vs_prior", """
WITH wk AS (SELECT s.s_nationkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS qty
            FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2)
SELECT a.s_nationkey, a.week, a.qty, p.qty AS qty_prior, y.qty AS qty_prior_year
FROM wk a LEFT JOIN wk p ON p.s_nationkey = a.s_nationkey AND p.week = a.week - INTERVAL 7 DAY
LEFT JOIN wk y ON y.s_nationkey = a.s_nationkey AND y.week = a.week - INTERVAL 364 DAY""")
def vs_prior(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    wk = j.groupBy("s_nationkey", S.week_start("l_shipdate").alias("week")).agg(F.sum("l_quantity").alias("qty"))
    a = R.vs_prior(wk, ["s_nationkey"], "week", ["qty"], 7, "_prior")
    y = wk.select("s_nationkey", F.date_add("week", 364).alias("week"), F.col("qty").alias("qty_prior_year"))
    return a.join(y, ["s_nationkey", "week"], "left")


@query("a13_to_grain", """
SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS period, sum(l_quantity) AS l_quantity,
       round(sum(l_extendedprice), 2) AS l_extendedprice, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
FROM lineitem WHERE l_suppkey <> 9999 GROUP BY 1, 2""")
def to_grain(spark, sf):
    t = Tables(spark, sf)
    d = R.scope(t.lineitem, key_col="l_suppkey").withColumn("returned", F.when(F.col("l_returnflag") == "R", 1)
                                                             .otherwise(0))
    g = R.to_grain(d, ["l_suppkey"], "l_shipdate", "week", ["l_quantity", "l_extendedprice"], ["returned"])
    return g.withColumn("l_extendedprice", F.round("l_extendedprice", 2))


@query("a14_coverage_stats", """
WITH per AS (SELECT l_suppkey, max(CASE WHEN l_shipdate >= TIMESTAMP '2001-10-01' AND l_returnflag = 'N'
                                       THEN 1 ELSE 0 END) AS a
             FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1)
SELECT CAST(sum(a) AS BIGINT) AS active, count(*) AS total, coalesce(round(sum(a) / nullif(count(*), 0), 6), 0.0) AS ratio
FROM per""")
def coverage_stats(spark, sf):
    t = Tables(spark, sf)
    active = (F.col("l_shipdate") >= F.lit("2001-10-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "N")
    return R.coverage_stats(t.lineitem, "l_suppkey", active)


@query("q15_coverage_gate", """
WITH per AS (SELECT l_suppkey, max(CASE WHEN l_shipdate >= TIMESTAMP '2001-10-01' AND l_returnflag = 'N'
                                       THEN 1 ELSE 0 END) AS a
             FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1),
 s AS (SELECT CAST(sum(a) AS BIGINT) AS active, count(*) AS total, coalesce(round(sum(a) / nullif(count(*), 0), 6), 0.0) AS ratio FROM per)
SELECT active, total, ratio,
       CASE WHEN ratio < 0.60 THEN 'COVERAGE_LOW: ' || CAST(active AS VARCHAR) || '/' || CAST(total AS VARCHAR)
            ELSE NULL END AS warning
FROM s""")
def coverage_gate(spark, sf):
    s = coverage_stats(spark, sf)
    return s.withColumn("warning", F.when(F.col("ratio") < 0.60, F.concat(
        F.lit("COVERAGE_LOW: "), F.col("active").cast("string"), F.lit("/"), F.col("total").cast("string"))))


@query("a15_grid_coverage", """
WITH d AS (SELECT l_partkey, year(l_shipdate) AS yr, l_linestatus FROM lineitem)
SELECT count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT yr) AS n_yr,
       count(DISTINCT l_partkey) * count(DISTINCT yr) AS expected,
       (SELECT count(*) FROM (SELECT DISTINCT l_partkey, yr FROM d)) AS observed,
       round((SELECT count(*) FROM (SELECT DISTINCT l_partkey, yr FROM d))
             / nullif(count(DISTINCT l_partkey) * count(DISTINCT yr), 0), 6) AS completeness
FROM d""")
def grid_coverage(spark, sf):
    t = Tables(spark, sf)
    d = t.lineitem.select("l_partkey", F.year("l_shipdate").alias("yr"))
    return R.grid_coverage(d, ["l_partkey", "yr"])


@query("a16_multi_grain", f"""
SELECT r.r_name, n.n_name, year(l_shipdate) AS yr, sum(l_quantity) AS volume, {RATE_SQL} AS rate,
       grouping_id(n.n_name, r.r_name, year(l_shipdate)) AS level
FROM {_LINES_REGION_SQL}
GROUP BY GROUPING SETS ((), (r.r_name), (r.r_name, n.n_name), (year(l_shipdate)), (r.r_name, year(l_shipdate)))""")
def multi_grain(spark, sf):
    j = _lines_region(Tables(spark, sf)).withColumn("yr", F.year("l_shipdate"))
    g = R.multi_grain(j, [[], ["r_name"], ["r_name", "n_name"], ["yr"], ["r_name", "yr"]],
                      [F.sum("l_quantity").alias("volume"), rate().alias("rate")])
    return g.select("r_name", "n_name", "yr", "volume", "rate", "level")


@query("a17_grain_warning", """
SELECT count(*) AS n_rows, count(*) < 200 AS over_aggregated
FROM (SELECT s_nationkey, year(l_shipdate) FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2)""")
def grain_warning(spark, sf):
    t = Tables(spark, sf)
    g = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey") \
        .groupBy("s_nationkey", F.year("l_shipdate")).count()
    return R.grain_warning(g, 200)


# -- A09-A12: scoped / weighted sums, scoped means, lift ---------------------
_PROMO = "l_discount >= 0.05"


@query("a09_weighted_sums", f"""
SELECT p.p_type,
       round(sum(CASE WHEN {_PROMO} THEN l_quantity * p.p_size * l_extendedprice / l_quantity ELSE 0 END), 2) AS promo_value,
       round(sum(CASE WHEN {_PROMO} THEN l_quantity * p.p_size ELSE 0 END), 2) AS promo_units
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_type""")
def weighted_sums(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size"), "l_partkey")
    sc = F.expr(_PROMO)
    return j.groupBy("p_type").agg(
        F.round(F.sum(F.when(sc, F.col("l_quantity") * F.col("p_size") * F.col("l_extendedprice")
                             / F.col("l_quantity")).otherwise(0.0)), 2).alias("promo_value"),
        F.round(F.sum(F.when(sc, F.col("l_quantity") * F.col("p_size")).otherwise(0.0)), 2).alias("promo_units"))


@query("a10_scoped_mean", f"""
SELECT l_returnflag,
       round(sum(CASE WHEN {_PROMO} THEN CASE WHEN l_tax > 0.04 THEN l_tax END END)
             / nullif(sum(CASE WHEN {_PROMO} THEN 1 ELSE 0 END), 0), 8) AS scoped_mean_tax,
       round(avg(CASE WHEN {_PROMO} THEN CASE WHEN l_tax > 0.04 THEN l_tax END END), 8) AS scoped_avg_tax
FROM lineitem GROUP BY l_returnflag""")
def scoped_means(spark, sf):
    t = Tables(spark, sf)
    tax = F.when(F.col("l_tax") > 0.04, F.col("l_tax"))   # NULL where not recorded
    sc = F.expr(_PROMO)
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(R.scoped_mean(tax, sc), 8).alias("scoped_mean_tax"),
        F.round(R.scoped_avg(tax, sc), 8).alias("scoped_avg_tax"))


@query("a11_lift", f"""
WITH b AS (
  SELECT p.p_brand,
         sum(CASE WHEN {_PROMO} THEN l_quantity ELSE 0 END) AS actual_units,
         sum(CASE WHEN NOT ({_PROMO}) THEN l_quantity ELSE 0 END) AS base_units,
         sum(CASE WHEN {_PROMO} THEN l_extendedprice * (1 - l_discount) ELSE 0 END) AS promo_income
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand)
SELECT p_brand, actual_units, base_units, actual_units - base_units AS incremental_units,
       round((actual_units - base_units) / nullif(base_units, 0), 6) AS lift_rate,
       round(100.0 * (actual_units - base_units) / nullif(base_units, 0), 4) AS pct_lift,
       round(promo_income / nullif(actual_units - base_units, 0), 6) AS income_per_incremental_unit
FROM b""")
def lift(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    sc = F.expr(_PROMO)
    b = j.groupBy("p_brand").agg(
        F.sum(F.when(sc, F.col("l_quantity")).otherwise(0.0)).alias("actual_units"),
        F.sum(F.when(~sc, F.col("l_quantity")).otherwise(0.0)).alias("base_units"),
        F.sum(F.when(sc, F.col("l_extendedprice") * (1 - F.col("l_discount"))).otherwise(0.0)).alias("promo_income"))
    inc = F.col("actual_units") - F.col("base_units")
    return b.select("p_brand", "actual_units", "base_units", inc.alias("incremental_units"),
                    F.round(S.safe_div(inc, "base_units"), 6).alias("lift_rate"),
                    F.round(S.safe_div(inc * 100.0, "base_units"), 4).alias("pct_lift"),
                    F.round(S.safe_div("promo_income", inc), 6).alias("income_per_incremental_unit"))


@query("a07_avg_minutes", """
WITH e AS (SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts
           FROM events)
SELECT event_type, count(next_ts) AS n_visits,
       round(avg(CASE WHEN next_ts IS NOT NULL THEN datediff('minute', ts, next_ts) END), 6) AS avg_minutes
FROM e GROUP BY event_type""")
def avg_minutes(spark, sf):
    t = Tables(spark, sf)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("next_ts", F.lead("ts").over(w))
    return e.groupBy("event_type").agg(
        F.count("next_ts").alias("n_visits"),
        F.round(F.avg(F.when(F.col("next_ts").isNotNull(), S.minutes_between("ts", "next_ts"))), 6).alias("avg_minutes"))


# -- P: scope and predicates -----------------------------------------------
@query("p02_apply_scope", """
SELECT o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS value
FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus <> 'P' AND NOT (o_totalprice < 1000)
GROUP BY o_orderpriority""")
def apply_scope(spark, sf):
    t = Tables(spark, sf)
    d = R.apply_scope(t.orders, ["o_custkey IS NOT NULL", "o_orderstatus <> 'P'", "NOT (o_totalprice < 1000)"])
    return d.groupBy("o_orderpriority").agg(F.count("*").alias("n_orders"),
                                            F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("p03_classify", """
SELECT CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 1000 THEN 'low'
            WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS balance_class, count(*) AS n
FROM customer GROUP BY 1""")
def classify(spark, sf):
    t = Tables(spark, sf)
    c = R.classify([("c_acctbal < 0", "negative"), ("c_acctbal < 1000", "low"), ("c_acctbal < 5000", "mid")], "high")
    return t.customer.groupBy(c.alias("balance_class")).agg(F.count("*").alias("n"))


@query("p05_patterns", """
SELECT count_if(p_name LIKE '%bolt%') AS n_like, count_if(p_name ILIKE '%RED%') AS n_ilike,
       count_if(p_name NOT ILIKE '%small%') AS n_not_ilike, count_if(p_name NOT LIKE 'blue%') AS n_not_like,
       count_if(p_type <> 'ECONOMY') AS n_ne
FROM part""")
def patterns(spark, sf):
    p = Tables(spark, sf).part
    return p.agg(F.count_if(F.col("p_name").like("%bolt%")).alias("n_like"),
                 F.count_if(F.col("p_name").ilike("%RED%")).alias("n_ilike"),
                 F.count_if(~F.col("p_name").ilike("%small%")).alias("n_not_ilike"),
                 F.count_if(~F.col("p_name").like("blue%")).alias("n_not_like"),
                 F.count_if(F.col("p_type") != "ECONOMY").alias("n_ne"))


@query("p06_null_predicates", """
SELECT count_if(try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) IS NULL) AS n_no_id,
       count_if(try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) IS NOT NULL) AS n_with_id
FROM pages""")
def null_predicates(spark, sf):
    p = Tables(spark, sf).pages.withColumn("pid", S.extract_int("url", r"/([0-9]+)"))
    return p.agg(F.count_if(F.col("pid").isNull()).alias("n_no_id"),
                 F.count_if(F.col("pid").isNotNull()).alias("n_with_id"))


DERIVED = """
# user-defined metrics, one per line: NAME = EXPR | note
net_revenue = round(sum(l_extendedprice * (1 - l_discount)), 2) | revenue after discount
avg_qty = round(avg(l_quantity), 6)
not a metric line
return_rate = round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*), 6) | share of returned lines
"""


@query("p08_derived_metrics", """
SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net_revenue,
       round(avg(l_quantity), 6) AS avg_qty,
       round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*), 6) AS return_rate
FROM lineitem GROUP BY l_linestatus""")
def derived(spark, sf):
    return R.derived_metrics(Tables(spark, sf).lineitem, DERIVED, by=["l_linestatus"])


@query("p10_activity_flag", """
SELECT count_if(coalesce(CAST(l_discount AS DOUBLE), 0) > 0 OR coalesce(CAST(l_tax AS DOUBLE), 0) > 0.07) AS n_active,
       count(*) AS n_rows
FROM lineitem""")
def activity(spark, sf):
    li = Tables(spark, sf).lineitem.withColumn("tax_over", F.col("l_tax") - 0.07)
    flag = R.activity_flag(li, ["l_discount", "tax_over", "no_such_column"])
    return li.agg(F.count_if(flag).alias("n_active"), F.count("*").alias("n_rows"))


@query("p01_scope", f"""
SELECT count(*) AS n_lines, sum(l_quantity) AS volume FROM lineitem WHERE {SCOPE_SQL}""")
def scope_q(spark, sf):
    return scoped_lines(Tables(spark, sf)).agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("volume"))


@query("p04_coalesce", """
SELECT n.n_nationkey, coalesce(r.r_name, 'region ' || CAST(n.n_regionkey AS VARCHAR)) AS region_label
FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_name <> 'ASIA'""")
def coalesce_q(spark, sf):
    t = Tables(spark, sf)
    r = t.region.where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    j = t.nation.join(F.broadcast(r), "n_regionkey", "left")
    return j.select("n_nationkey", R.coalesce_cols("r_name", F.concat(F.lit("region "),
                                                                      F.col("n_regionkey").cast("string")))
                    .alias("region_label"))
