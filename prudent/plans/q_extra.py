"""Queries that exercise single inventory rows on their own (rows that the
composite queries also use inside larger plans)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prudent.functions import scalar as S
from prudent.operators import profile as Q
from prudent.operators import relational as R
from prudent.operators import stats as X
from prudent.plans.q_findings import GAPS_SQL
from prudent.plans.registry import Tables, query
from prudent.session import cut_lineage


@query("a02_plain_metrics", """
SELECT l_returnflag, sum(l_quantity) AS sum_qty, count(*) AS n_lines, round(avg(l_discount), 8) AS avg_disc,
       min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem GROUP BY 1""")
def plain(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n_lines"),
                                          F.round(F.avg("l_discount"), 8).alias("avg_disc"),
                                          F.min("l_extendedprice").alias("min_price"),
                                          F.max("l_extendedprice").alias("max_price"))


@query("a12_scoped_avg", """
SELECT p.p_type, round(avg(CASE WHEN l_discount >= 0.05 THEN l_extendedprice END), 6) AS promo_avg_price,
       round(avg(CASE WHEN l_discount < 0.05 THEN l_extendedprice END), 6) AS base_avg_price
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1""")
def scoped_avg(spark, sf):
    t = Tables(spark, sf)
    j = R.join_dim(t.lineitem, t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return j.groupBy("p_type").agg(
        F.round(R.scoped_avg("l_extendedprice", F.col("l_discount") >= 0.05), 6).alias("promo_avg_price"),
        F.round(R.scoped_avg("l_extendedprice", F.col("l_discount") < 0.05), 6).alias("base_avg_price"))


@query("j01_join_dim", """
SELECT p.p_brand, count(*) AS n_lines, sum(l_quantity) AS qty
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1""")
def join_dim(spark, sf):
    t = Tables(spark, sf)
    j = R.join_dim(t.lineitem, t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return j.groupBy("p_brand").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("qty"))


@query("j04_composite_key", """
WITH a AS (SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS qty
           FROM lineitem GROUP BY 1, 2),
 b AS (SELECT l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS returned
       FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT a.l_suppkey, a.week, a.qty, b.returned FROM a JOIN b ON a.l_suppkey = b.l_suppkey AND a.week = b.week""")
def composite(spark, sf):
    li = Tables(spark, sf).lineitem
    a = li.groupBy("l_suppkey", S.week_start("l_shipdate").alias("week")).agg(F.sum("l_quantity").alias("qty"))
    b = li.where("l_returnflag = 'R'").groupBy("l_suppkey", S.week_start("l_shipdate").alias("week")) \
        .agg(F.sum("l_quantity").alias("returned"))
    return a.join(b, ["l_suppkey", "week"])


@query("f01_extract_int", """
SELECT count_if(k IS NULL) AS n_missing, sum(k) AS sum_keys FROM (
  SELECT try_cast(nullif(regexp_extract(c_name, '#0*([0-9]+)$', 1), '') AS BIGINT) AS k FROM customer)""")
def extract_int(spark, sf):
    c = Tables(spark, sf).customer.select(S.extract_int("c_name", r"#0*([0-9]+)$").alias("k"))
    return c.agg(F.count_if(F.col("k").isNull()).alias("n_missing"), F.sum("k").alias("sum_keys"))


@query("f02_core_code", """
SELECT p_partkey, left(ltrim(lpad(CAST(p_partkey AS VARCHAR), 14, '0'), '0'), 10) AS core FROM part""")
def core_code(spark, sf):
    p = Tables(spark, sf).part
    return p.select("p_partkey", S.core_code(F.lpad(F.col("p_partkey").cast("string"), 14, "0")).alias("core"))


@query("f03_safe_date", """
SELECT count_if(try_strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') IS NOT NULL) AS n_parsed,
       count_if(try_strptime(o_orderpriority, '%Y%m%d') IS NULL) AS n_rejected,
       min(CAST(try_strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS DATE)) AS first_date FROM orders""")
def safe_date(spark, sf):
    o = Tables(spark, sf).orders
    d = S.safe_date(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.agg(F.count_if(d.isNotNull()).alias("n_parsed"),
                 F.count_if(S.safe_date("o_orderpriority").isNull()).alias("n_rejected"),
                 F.min(d).alias("first_date"))


@query("f04_week_day", """
SELECT year(o_orderdate) AS yr, count(DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE)) AS n_weeks,
       count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days FROM orders GROUP BY 1""")
def week_day(spark, sf):
    o = Tables(spark, sf).orders
    return o.groupBy(F.year("o_orderdate").alias("yr")).agg(F.count_distinct(S.week_start("o_orderdate")).alias("n_weeks"),
                                                            F.count_distinct(S.day_of("o_orderdate")).alias("n_days"))


@query("f05_day_name", "SELECT strftime(o_orderdate, '%a') AS day_name, count(*) AS n FROM orders GROUP BY 1")
def day_name(spark, sf):
    o = Tables(spark, sf).orders
    return o.groupBy(S.day_name("o_orderdate").alias("day_name")).agg(F.count("*").alias("n"))


@query("f06_minutes_between", """
WITH e AS (SELECT event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
SELECT event_type, sum(datediff('minute', ts, nx)) AS minutes FROM e WHERE nx IS NOT NULL GROUP BY 1""")
def minutes(spark, sf):
    e = Tables(spark, sf).events
    e = e.withColumn("nx", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.where(F.col("nx").isNotNull()).groupBy("event_type").agg(
        F.sum(S.minutes_between("ts", "nx")).alias("minutes"))


@query("f07_safe_div", """
SELECT o_orderstatus, round(count_if(o_orderpriority = '1-URGENT') * 100.0 / nullif(count(*), 0), 2) AS pct_urgent,
       coalesce(round(sum(CASE WHEN o_totalprice < 0 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN o_totalprice < 0 THEN 1 ELSE 0 END), 0), 4), 0.0)
         AS negative_share
FROM orders GROUP BY 1""")
def safe_div(spark, sf):
    o = Tables(spark, sf).orders
    neg = F.sum(F.when(F.col("o_totalprice") < 0, 1).otherwise(0))
    return o.groupBy("o_orderstatus").agg(S.pct(F.count_if(F.col("o_orderpriority") == "1-URGENT"), F.count("*"), 2)
                                          .alias("pct_urgent"),
                                          F.coalesce(F.round(S.safe_div(neg, neg), 4), F.lit(0.0)).alias("negative_share"))


def unwrap(col, levels: int = 3):
    """F16: strip single-key envelopes whose value is an object (<= levels)."""
    c = col
    for _ in range(levels):
        keys = F.json_object_keys(c)
        inner = F.call_function("get_json_object", c, F.concat(F.lit("$."), keys[0]))
        c = F.when((F.size(keys) == 1) & F.startswith(F.ltrim(inner), F.lit("{")), inner).otherwise(c)
    return c


@query("f16_unwrap", """
SELECT event_type, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS n_payload, count(*) AS n FROM events GROUP BY 1""")
def unwrap_q(spark, sf):
    """Envelopes of 0-2 levels around each event's props (depth from the
    event type) unwrapped back to the payload."""
    e = Tables(spark, sf).events
    depth = F.when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    one = F.concat(F.lit('{"data": '), F.col("props"), F.lit("}"))
    two = F.concat(F.lit('{"result": {"data": '), F.col("props"), F.lit("}}"))
    w = e.withColumn("wrapped", F.when(depth == 2, two).when(depth == 1, one).otherwise(F.col("props")))
    u = w.withColumn("unwrapped", unwrap(F.col("wrapped")))
    return u.groupBy("event_type").agg(F.count_if(F.get_json_object("unwrapped", "$.k").isNotNull()).alias("n_payload"),
                                       F.count("*").alias("n"))


@query("f17_norm_name", """
SELECT CASE role WHEN 'assistant' THEN 'assistant' WHEN 'user' THEN 'user-agent' WHEN 'system' THEN 'system-agent' ELSE role END AS name,
       count(*) AS n FROM conversations GROUP BY 1""")
def norm_name(spark, sf):
    c = Tables(spark, sf).conversations
    canon = ["user-agent", "assistant", "system-agent"]
    v = F.when(F.col("role") == "assistant", F.lit("Assistant_Agent")).otherwise(F.upper("role"))
    return c.groupBy(S.norm_name(v, canon).alias("name")).agg(F.count("*").alias("n"))


@query("f18_as_array", """
SELECT event_type, CAST(1 AS INTEGER) AS n_items, CAST(1 AS INTEGER) AS n_keys, count(*) AS n_rows FROM events GROUP BY 1""")
def as_array(spark, sf):
    """Scalar-or-list coercion: each event's props arrives either as a bare
    object or wrapped in a one-element list (by event type); both are read
    as an array of objects, and the list of records becomes a map keyed by
    the record's name."""
    e = Tables(spark, sf).events
    j = F.when(F.col("event_type").isin("click", "view"), F.concat(F.lit("["), F.col("props"), F.lit("]"))) \
        .otherwise(F.col("props"))
    arr = F.when(F.startswith(F.ltrim(j), F.lit("[")), F.from_json(j, "array<string>")).otherwise(F.array(j))
    recs = F.transform(arr, lambda x: F.struct(F.get_json_object(x, "$.k").alias("name"), x.alias("value")))
    return e.select("event_type", F.size(arr).alias("n_items"),
                    F.size(F.map_from_entries(recs)).alias("n_keys")) \
        .groupBy("event_type", "n_items", "n_keys").agg(F.count("*").alias("n_rows"))


@query("f28_match", """
WITH a AS (SELECT c.c_mktsegment, avg(o.o_totalprice) AS v FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1)
SELECT c_mktsegment, round(v, -3) AS stated, round(v, 6) AS recomputed,
       round(abs(v - round(v, -3)) / nullif(abs(v), 0), 8) AS rel_diff,
       v = round(v, -3) OR abs(round(v, -3) - v) / nullif(abs(v), 0) < 0.01 AS matches FROM a""")
def match(spark, sf):
    t = Tables(spark, sf)
    a = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey") \
        .groupBy("c_mktsegment").agg(F.avg("o_totalprice").alias("v"))
    st = F.round("v", -3)
    return a.select("c_mktsegment", st.alias("stated"), F.round("v", 6).alias("recomputed"),
                    F.round(S.rel_diff("v", st), 8).alias("rel_diff"), S.values_match("v", st).alias("matches"))


@query("p07_select_columns")
def select_columns(spark, sf):
    o = R.select_columns(Tables(spark, sf).orders, ["o_orderkey", "o_totalprice"],
                         {"o_totalprice": "order value incl. tax"})
    return R.schema_table(o).withColumn("comment", F.lit(o.schema["o_totalprice"].metadata.get("comment")))


@query("p09_apply_filters", """
SELECT count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def apply_filters(spark, sf):
    o = R.apply_filters(Tables(spark, sf).orders, ["o_orderdate >= TIMESTAMP '1997-01-01'",
                                                   "o_orderpriority IN ('1-URGENT', '2-HIGH')"])
    return o.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("p11_cast_schema")
def cast_schema(spark, sf):
    li = Tables(spark, sf).lineitem
    c = R.cast_schema(li.select("l_linenumber", "l_quantity", "l_returnflag"),
                      {"l_linenumber": "integer", "l_quantity": "float", "l_returnflag": "category"})
    return R.schema_table(c)


@query("p12_context_warnings")
def context_warnings(spark, sf):
    groups = {"CONTEXT_MISSING_TIME_COLUMNS": [["YEAR", "FISCAL_YEAR"], ["WEEK_NUM", "WEEK_NUMBER"]],
              "CONTEXT_MISSING_SCOPE_FLAG": [["IN_SCOPE", "SCOPE_FLAG", "SCOPE_APPLIED"]]}
    w = Tables(spark, sf).orders.withColumn("year", F.year("o_orderdate"))
    return R.context_warnings(w, groups)


@query("p13_missing_columns")
def missing_columns(spark, sf):
    return R.missing_columns(Tables(spark, sf).lineitem, ["l_quantity", "l_shipdate", "l_receiptdate", "l_comment"])


@query("q17_mix_risk", """
WITH lp AS (SELECT l.*, p.p_type, year(l_shipdate) AS yr, CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END AS ok
            FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
 s AS (SELECT 'p_type' AS dim, p_type AS lvl, sum(CASE WHEN yr = 1996 THEN l_quantity END) AS d0,
              sum(CASE WHEN yr = 1997 THEN l_quantity END) AS d1, sum(CASE WHEN yr = 1997 THEN ok END) AS n1 FROM lp GROUP BY 2
       UNION ALL
       SELECT 'l_linestatus', l_linestatus, sum(CASE WHEN yr = 1996 THEN l_quantity END), sum(CASE WHEN yr = 1997 THEN l_quantity END),
              sum(CASE WHEN yr = 1997 THEN ok END) FROM lp GROUP BY 2),
 w AS (SELECT *, d0 / sum(d0) OVER (PARTITION BY dim) AS w0, d1 / sum(d1) OVER (PARTITION BY dim) AS w1, n1 / d1 AS r1 FROM s)
SELECT dim, round(sum(abs(w1 - w0)), 8) AS mix_moved, round(max(r1) - min(r1), 8) AS rate_spread,
       round(sum(abs(w1 - w0)) * (max(r1) - min(r1)), 10) AS risk FROM w GROUP BY dim""")
def mix_risk(spark, sf):
    """Stratifiers whose group rates differ and whose mix moved (1996->1997)."""
    t = Tables(spark, sf)
    lp = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey") \
        .withColumn("yr", F.year("l_shipdate")) \
        .withColumn("ok", F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0.0))
    parts = []
    for dim in ("p_type", "l_linestatus"):
        s = lp.groupBy(F.col(dim).alias("lvl")).agg(
            F.sum(F.when(F.col("yr") == 1996, F.col("l_quantity"))).alias("d0"),
            F.sum(F.when(F.col("yr") == 1997, F.col("l_quantity"))).alias("d1"),
            F.sum(F.when(F.col("yr") == 1997, F.col("ok"))).alias("n1")).withColumn("dim", F.lit(dim))
        parts.append(s)
    s = parts[0].unionByName(parts[1])
    w = Window.partitionBy("dim")
    s = s.withColumn("w0", F.col("d0") / F.sum("d0").over(w)).withColumn("w1", F.col("d1") / F.sum("d1").over(w)) \
        .withColumn("r1", F.col("n1") / F.col("d1"))
    g = s.groupBy("dim").agg(F.sum(F.abs(F.col("w1") - F.col("w0"))).alias("m"), (F.max("r1") - F.min("r1")).alias("sp"))
    return g.select("dim", F.round("m", 8).alias("mix_moved"), F.round("sp", 8).alias("rate_spread"),
                    F.round(F.col("m") * F.col("sp"), 10).alias("risk"))


@query("s02_format_guard")
def format_guard(spark, sf):
    """The loader refuses an unknown suffix and a missing path."""
    import os
    from prudent.sources import io as IO
    rows = []
    for path in (os.path.join(sf, "orders.parquet"), os.path.join(sf, "orders.xlsx"), os.path.join(sf, "absent.csv")):
        try:
            n = IO.load_table(spark, path).count()
            rows.append((os.path.basename(path), "ok", n))
        except (ValueError, FileNotFoundError) as e:
            rows.append((os.path.basename(path), type(e).__name__, None))
    return spark.createDataFrame(rows, "path string, outcome string, n_rows bigint")


@query("s10_write_table")
def write_table(spark, sf):
    import os
    from prudent.sources import io as IO
    from prudent.streaming.stream import staging
    out = IO.write_table(Tables(spark, sf).nation, os.path.join(staging(spark, "sink"), "nation.csv"))
    return IO.load_table(spark, out, "csv").agg(F.count("*").alias("n_rows"))


@query("t02_rank_gaps", f"SELECT rank, severity, frequency, categories, text FROM ({GAPS_SQL})")
def rank_gaps(spark, sf):
    from prudent.plans.q_findings import aggregate_gaps
    return aggregate_gaps(spark, sf).select("rank", "severity", "frequency", "categories", "text")


@query("t04_block_sample")
def block_sample(spark, sf):
    """Quick profiling sample: the 500 rows of smallest key hash, from all partitions alike."""
    from prudent.operators.relational import exact_hash_sample
    return exact_hash_sample(Tables(spark, sf).lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 500, seed=3)


@query("x03_kendall", """
WITH d AS (SELECT CAST(left(o_orderpriority, 1) AS INTEGER) AS x,
                  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS y FROM orders),
 c AS (SELECT x, y, count(*) AS n FROM d GROUP BY 1, 2),
 p AS (SELECT sum(CASE WHEN a.y < b.y THEN a.n * b.n ELSE 0 END) AS conc, sum(CASE WHEN a.y > b.y THEN a.n * b.n ELSE 0 END) AS disc
       FROM c a JOIN c b ON a.x < b.x),
 t AS (SELECT (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) AS m FROM c GROUP BY x)) AS tx,
              (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) AS m FROM c GROUP BY y)) AS ty,
              (SELECT sum(n) FROM c) AS nn)
SELECT round((conc - disc) / sqrt((nn * (nn - 1) / 2.0 - tx) * (nn * (nn - 1) / 2.0 - ty)), 8) AS tau_b,
       round(3 * (conc - disc) / sqrt(nn * (nn - 1) * (2 * nn + 5) / 2.0), 6) AS z FROM p, t""")
def kendall(spark, sf):
    """Kendall tau-b for two ordinal variables from the joint-level cell
    table (levels x levels pairs of cells, never pairs of rows)."""
    o = Tables(spark, sf).orders.select(F.left("o_orderpriority", F.lit(1)).cast("int").alias("x"),
                                        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
                                        .otherwise(3).alias("y"))
    return kendall_tau(o)


def kendall_tau(o):
    """tau-b and z of the levels ``x`` and ``y``; counts are doubles, as z takes the cube of their sum."""
    c = o.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    a = c.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("n").alias("n1"), F.lit(1).alias("k"))
    b = c.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"), F.lit(1).alias("k"))
    p = a.join(b, "k").where(F.col("x1") < F.col("x2")).agg(
        F.sum(F.when(F.col("y1") < F.col("y2"), F.col("n1") * F.col("n2")).otherwise(0)).alias("conc"),
        F.sum(F.when(F.col("y1") > F.col("y2"), F.col("n1") * F.col("n2")).otherwise(0)).alias("disc"))
    tx = c.groupBy("x").agg(F.sum("n").alias("m")).select(F.sum(F.col("m") * (F.col("m") - 1) / 2.0)).scalar()
    ty = c.groupBy("y").agg(F.sum("n").alias("m")).select(F.sum(F.col("m") * (F.col("m") - 1) / 2.0)).scalar()
    nn = c.select(F.sum("n")).scalar()
    n0 = nn * (nn - 1) / 2.0
    return p.select(F.round((F.col("conc") - F.col("disc")) / F.sqrt((n0 - tx) * (n0 - ty)), 8).alias("tau_b"),
                    F.round(3 * (F.col("conc") - F.col("disc")) / F.sqrt(nn * (nn - 1) * (2 * nn + 5) / 2.0), 6)
                    .alias("z"))


@query("x31_practical", """
WITH nw AS (SELECT s.s_nationkey, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS qty
            FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY week DESC) AS rk,
              qty - lag(qty) OVER (PARTITION BY s_nationkey ORDER BY week) AS d FROM nw),
 g AS (SELECT s_nationkey, avg(CASE WHEN rk <= 13 THEN qty END) - avg(CASE WHEN rk BETWEEN 14 AND 26 THEN qty END) AS effect,
              stddev_samp(d) AS noise FROM r GROUP BY 1)
SELECT s_nationkey, round(effect, 6) AS effect, round(noise, 6) AS noise, abs(effect) > noise AS practical FROM g""")
def practical(spark, sf):
    """Is the last-13-week change larger than the usual week-to-week
    variation (sd of weekly changes)?"""
    from prudent.plans.q_window import nation_weekly
    nw = nation_weekly(Tables(spark, sf))
    w = Window.partitionBy("s_nationkey").orderBy("week")
    r = nw.withColumn("rk", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.col("week").desc()))) \
        .withColumn("d", F.col("qty") - F.lag("qty").over(w))
    g = r.groupBy("s_nationkey").agg(
        (F.avg(F.when(F.col("rk") <= 13, F.col("qty"))) - F.avg(F.when(F.col("rk").between(14, 26), F.col("qty"))))
        .alias("effect"), F.stddev_samp("d").alias("noise"))
    return g.select("s_nationkey", F.round("effect", 6).alias("effect"), F.round("noise", 6).alias("noise"),
                    (F.abs("effect") > F.col("noise")).alias("practical"))


@query("x34_choose_test")
def choose_test(spark, sf):
    """Test chosen per metric and grouping from the profiled shape, the
    pairing and the number of groups (2: Welch t or Mann-Whitney; more: ANOVA
    or Kruskal-Wallis; paired: paired t or Wilcoxon, repeated-measures ANOVA
    or Friedman), then run for the lineitem metrics, with the post-hoc pairs.
    Lines are independent; the means of a supplier's lines in each group are
    paired.  p_bh corrects for all comparisons of the run."""
    li = Tables(spark, sf).lineitem
    metrics, groupings = ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"]
    runs = [X.compare_groups(li, metrics, groupings, subject).withColumn("paired", F.lit(subject is not None))
            for subject in (None, "l_suppkey")]
    out = cut_lineage(runs[0].unionByName(runs[1]))
    known = F.col("p_value").isNotNull()
    out = X.adjust_p(out.where(known), []).unionByName(out.where(~known), allowMissingColumns=True)
    return out.select("metric", "grouping", "n_groups", "shape", "test", "paired", "n", "statistic", "p_value", "p_bh",
                      "ci_low", "ci_high", "effect_size", "tier", "post_hoc")


@query("d09_days_of_supply", """
WITH t AS (SELECT max(CAST(l_shipdate AS DATE)) - 30 AS as_of FROM lineitem),
 openq AS (SELECT l.l_suppkey, sum(l.l_quantity) AS open_qty FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
          WHERE CAST(o.o_orderdate AS DATE) <= (SELECT as_of FROM t) AND CAST(l.l_shipdate AS DATE) > (SELECT as_of FROM t)
          GROUP BY 1),
 usage_ AS (SELECT l_suppkey, sum(l_quantity) / 91.0 AS daily FROM lineitem
         WHERE CAST(l_shipdate AS DATE) > (SELECT as_of FROM t) - 91 AND CAST(l_shipdate AS DATE) <= (SELECT as_of FROM t) GROUP BY 1),
 s AS (SELECT DISTINCT l_suppkey FROM lineitem)
SELECT s.l_suppkey, coalesce(openq.open_qty, 0) AS open_qty, round(usage_.daily, 6) AS daily_use,
       round(coalesce(openq.open_qty, 0) / nullif(usage_.daily, 0), 6) AS days_of_supply, coalesce(openq.open_qty, 0) = 0 AS stockout
FROM s LEFT JOIN openq USING (l_suppkey) LEFT JOIN usage_ USING (l_suppkey)""")
def days_of_supply(spark, sf):
    """Order-book position (ordered by the as-of date, not yet shipped) per
    supplier divided by the 13-week average daily shipped quantity; NULL on
    zero use; stockout when nothing is open."""
    t = Tables(spark, sf)
    asof = t.lineitem.select(F.date_sub(F.max(F.to_date("l_shipdate")), 30)).scalar()
    j = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    ship = F.to_date("l_shipdate")
    open_ = j.where((F.to_date("o_orderdate") <= asof) & (ship > asof)).groupBy("l_suppkey") \
        .agg(F.sum("l_quantity").alias("open_qty"))
    use = t.lineitem.where((ship > F.date_sub(asof, 91)) & (ship <= asof)).groupBy("l_suppkey") \
        .agg((F.sum("l_quantity") / 91.0).alias("daily"))
    s = t.lineitem.select("l_suppkey").distinct()
    d = s.join(open_, "l_suppkey", "left").join(use, "l_suppkey", "left")
    oq = F.coalesce(F.col("open_qty"), F.lit(0.0))
    return d.select("l_suppkey", oq.alias("open_qty"), F.round("daily", 6).alias("daily_use"),
                    F.round(S.safe_div(oq, "daily"), 6).alias("days_of_supply"), (oq == 0).alias("stockout"))


# addressability labels: a parameter table (stratum -> label)
LABELS = [("ECONOMY", "controllable"), ("SMALL", "controllable"), ("STANDARD", "structural"),
          ("MEDIUM", "structural"), ("LARGE", "partly_controllable"), ("PROMO", "controllable")]


@query("d20_addressable", """
WITH lp AS (SELECT p.p_type, s.s_nationkey, sum(l_quantity) AS qty FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
            JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
 g AS (SELECT p_type, s_nationkey, qty - avg(qty) OVER (PARTITION BY p_type) AS gap FROM lp),
 lab AS (SELECT * FROM (VALUES ('ECONOMY', 'controllable'), ('SMALL', 'controllable'), ('STANDARD', 'structural'),
                               ('MEDIUM', 'structural'), ('LARGE', 'partly_controllable'), ('PROMO', 'controllable')) t(p_type, label))
SELECT coalesce(label, 'unlabelled') AS label, CASE WHEN gap >= 0 THEN 'strength' ELSE 'gap' END AS side,
       count(*) AS n, round(sum(gap), 6) AS total_gap
FROM g LEFT JOIN lab USING (p_type) GROUP BY 1, 2""")
def addressable(spark, sf):
    t = Tables(spark, sf)
    lp = (t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
          .join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
          .groupBy("p_type", "s_nationkey").agg(F.sum("l_quantity").alias("qty")))
    g = lp.withColumn("gap", F.col("qty") - F.avg("qty").over(Window.partitionBy("p_type")))
    lab = spark.createDataFrame(LABELS, "p_type string, label string")
    j = g.join(F.broadcast(lab), "p_type", "left")
    return j.groupBy(F.coalesce("label", F.lit("unlabelled")).alias("label"),
                     F.when(F.col("gap") >= 0, "strength").otherwise("gap").alias("side")) \
        .agg(F.count("*").alias("n"), F.round(F.sum("gap"), 6).alias("total_gap"))


@query("k06_dbscan")
def dbscan_q(spark, sf):
    from prudent.operators.robust import density_clusters as dbscan
    from prudent.plans.q_cluster import customer_features
    c = customer_features(Tables(spark, sf))
    c = c.select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("a"), (F.col("avg_value") / 50000.0).alias("b"))
    lab = dbscan(c, "c_custkey", ["a", "b"], eps=0.25, min_pts=8)
    return lab.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("n_clusters"))
