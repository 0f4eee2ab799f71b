"""Findings, validation, synthesis and observability queries (V family).

Findings come from the data: for each run (order priority) and entity
(customer segment), the change in mean order value from 1997 to 1998 with a
z statistic, p-value, Cohen's d and CI; the guardrail metric is the share of
finalised orders; the stated value is the rounded figure a report would
quote.  The validation layers grade every finding.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prudent.functions import dist as D
from prudent.functions import scalar as S
from prudent.operators import findings as V
from prudent.plans.registry import Tables, query
from prudent.session import cut_lineage

Z = 1.959963984540054


def findings(t: Tables):
    """The findings table (a row per run and entity), computed once per set of tables."""
    if "__findings" not in t._cache:
        t._cache["__findings"] = cut_lineage(_findings(t))
    return t._cache["__findings"]


def _findings(t: Tables):
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey") \
        .select(F.col("o_orderpriority").alias("run_id"), F.col("c_mktsegment").alias("entity"),
                F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo"), "o_totalprice",
                (F.col("o_orderstatus") == "F").cast("double").alias("fin"))

    def yv(y, e):
        return F.when(F.col("yr") == y, e)
    p = F.col("o_totalprice")
    g = o.groupBy("run_id", "entity").agg(
        F.count(yv(1998, p)).alias("n1"), F.avg(yv(1998, p)).alias("m1"), F.var_samp(yv(1998, p)).alias("v1"),
        F.count(yv(1997, p)).alias("n0"), F.avg(yv(1997, p)).alias("m0"), F.var_samp(yv(1997, p)).alias("v0"),
        F.avg(F.when((F.col("yr") == 1998) & (F.col("mo") > 6), p)).alias("h1"),
        F.avg(F.when((F.col("yr") == 1997) & (F.col("mo") > 6), p)).alias("h0"),
        F.avg(yv(1998, F.col("fin"))).alias("g1"), F.avg(yv(1997, F.col("fin"))).alias("g0"))
    from prudent.operators.relational import exact_quantiles
    med = exact_quantiles(o.where(F.col("yr").isin(1997, 1998)), ["run_id", "entity", "yr"], "o_totalprice", [0.5],
                          names=["md"])
    med = med.groupBy("run_id", "entity").agg(F.max(F.when(F.col("yr") == 1998, F.col("md"))).alias("md1"),
                                              F.max(F.when(F.col("yr") == 1997, F.col("md"))).alias("md0"))
    g = g.join(med, ["run_id", "entity"], "left")
    # history: year-on-year changes of the yearly mean outside the finding's own pair of years
    ym = o.groupBy("run_id", "entity", "yr").agg(F.avg("o_totalprice").alias("m"))
    ym = ym.withColumn("dm", F.col("m") - F.lag("m").over(Window.partitionBy("run_id", "entity").orderBy("yr")))
    hist = ym.where((F.col("yr") != 1998) & F.col("dm").isNotNull()).groupBy("run_id", "entity").agg(
        F.min("dm").alias("hist_lo"), F.max("dm").alias("hist_hi"))
    ent = o.groupBy("entity").agg((F.avg(yv(1998, p)) - F.avg(yv(1997, p))).alias("ent_diff"))
    f = g.join(hist, ["run_id", "entity"], "left").join(ent, "entity")
    diff = F.col("m1") - F.col("m0")
    se = F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    f = f.select("run_id", "entity", F.concat_ws(":", "run_id", "entity").alias("finding_id"),
                 F.lit("1997-01-01").cast("date").alias("window_start"), F.lit("1998-12-31").cast("date")
                 .alias("window_end"), "n1", "n0", diff.alias("diff"), se.alias("se"),
                 S.safe_div(diff, F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"))
                                         / (F.col("n1") + F.col("n0") - 2))).alias("d"),
                 F.signum(diff).alias("primary_dir"), F.signum(F.col("g1") - F.col("g0")).alias("paired_dir"),
                 "hist_lo", "hist_hi", F.col("m1").alias("level"),
                 (1 + (F.signum(F.col("md1") - F.col("md0")) == F.signum(diff)).cast("int")
                  + (F.signum("ent_diff") == F.signum(diff)).cast("int")
                  + (F.signum(F.col("h1") - F.col("h0")) == F.signum(diff)).cast("int")).alias("lenses"))
    f = f.withColumn("z", S.safe_div("diff", "se")).withColumn("p_value", F.expr(D.norm_sf2("z"))) \
        .withColumn("ci_low", F.col("diff") - Z * F.col("se")).withColumn("ci_high", F.col("diff") + Z * F.col("se")) \
        .withColumn("stated", F.round("diff", 0))
    f = f.withColumn("rigor", V.rigor(F.col("p_value"), F.col("d"), F.col("ci_low"), F.col("ci_high"),
                                      F.least("n1", "n0")))
    f = f.withColumn("recompute", V.recompute(F.col("stated"), F.col("diff")))
    f = f.withColumn("guardrail", V.guardrail(F.col("primary_dir"), F.col("paired_dir")))
    f = f.withColumn("plausibility", V.plausibility(F.col("diff"), F.col("hist_lo"), F.col("hist_hi"), F.lit(False),
                                                    F.col("level") > 0))
    f = f.withColumn("grade", V.grade(F.col("rigor"), F.col("recompute"), F.col("guardrail"), F.col("plausibility"),
                                      F.col("lenses"), S.rel_diff("diff", "stated")))
    cav = F.array_compact(F.array(
        F.when(F.col("rigor") == "partial", F.struct(F.lit("trivial effect behind a significant p").alias("text"),
                                                       F.lit("medium").alias("severity"))),
        F.when(F.col("guardrail") == "trade_off_present",
               F.struct(F.lit("completion share moved against order value").alias("text"), F.lit("high").alias("severity"))),
        F.when(F.col("plausibility") == "implausible",
               F.struct(F.lit("change outside the historical range").alias("text"), F.lit("high").alias("severity"))),
        F.when(F.col("lenses") < 3, F.struct(F.lit("fewer than three lenses agree").alias("text"),
                                              F.lit("medium").alias("severity")))))
    return f.withColumn("caveats", cav)


_NS = D.norm_sf2("(diff / nullif(se, 0))", D.DUCK)

FINDINGS_SQL = f"""o AS (SELECT o_orderpriority AS run_id, c.c_mktsegment AS entity, year(o_orderdate) AS yr,
                  month(o_orderdate) AS mo, o_totalprice AS p, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS fin
           FROM orders JOIN customer c ON o_custkey = c.c_custkey),
 g AS (SELECT run_id, entity, count(CASE WHEN yr = 1998 THEN p END) AS n1, avg(CASE WHEN yr = 1998 THEN p END) AS m1,
              var_samp(CASE WHEN yr = 1998 THEN p END) AS v1, count(CASE WHEN yr = 1997 THEN p END) AS n0,
              avg(CASE WHEN yr = 1997 THEN p END) AS m0, var_samp(CASE WHEN yr = 1997 THEN p END) AS v0,
              quantile_cont(CASE WHEN yr = 1998 THEN p END, 0.5) AS md1, quantile_cont(CASE WHEN yr = 1997 THEN p END, 0.5) AS md0,
              avg(CASE WHEN yr = 1998 AND mo > 6 THEN p END) AS h1, avg(CASE WHEN yr = 1997 AND mo > 6 THEN p END) AS h0,
              avg(CASE WHEN yr = 1998 THEN fin END) AS g1, avg(CASE WHEN yr = 1997 THEN fin END) AS g0
       FROM o GROUP BY 1, 2),
 ym AS (SELECT run_id, entity, yr, avg(p) AS m FROM o GROUP BY 1, 2, 3),
 ym2 AS (SELECT *, m - lag(m) OVER (PARTITION BY run_id, entity ORDER BY yr) AS dm FROM ym),
 hist AS (SELECT run_id, entity, min(dm) AS hist_lo, max(dm) AS hist_hi FROM ym2 WHERE yr <> 1998 AND dm IS NOT NULL GROUP BY 1, 2),
 ent AS (SELECT entity, avg(CASE WHEN yr = 1998 THEN p END) - avg(CASE WHEN yr = 1997 THEN p END) AS ent_diff FROM o GROUP BY 1),
 f0 AS (SELECT g.run_id, g.entity, g.run_id || ':' || g.entity AS finding_id, DATE '1997-01-01' AS window_start,
               DATE '1998-12-31' AS window_end, n1, n0, m1 - m0 AS diff,
               sqrt(v1 / n1 + v0 / n0) AS se,
               (m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 0) AS d,
               sign(m1 - m0) AS primary_dir, sign(g1 - g0) AS paired_dir, hist_lo, hist_hi, m1 AS level,
               1 + CAST(sign(md1 - md0) = sign(m1 - m0) AS INTEGER) + CAST(sign(ent_diff) = sign(m1 - m0) AS INTEGER)
                 + CAST(sign(h1 - h0) = sign(m1 - m0) AS INTEGER) AS lenses
        FROM g LEFT JOIN hist USING (run_id, entity) JOIN ent USING (entity)),
 f1 AS (SELECT *, diff / nullif(se, 0) AS z, {_NS} AS p_value, diff - {Z} * se AS ci_low, diff + {Z} * se AS ci_high,
               round(diff, 0) AS stated FROM f0),
 f2 AS (SELECT *,
          CASE WHEN least(n1, n0) < 30 THEN 'fail'
               WHEN p_value < 0.05 AND (d IS NULL OR ci_low IS NULL OR ci_high IS NULL) THEN 'partial'
               WHEN p_value < 0.05 AND abs(d) < 0.2 THEN 'partial' ELSE 'pass' END AS rigor,
          CASE WHEN diff IS NULL THEN 'unable_to_compute'
               WHEN diff = stated OR abs(stated - diff) / nullif(abs(diff), 0) < 0.01 THEN 'match' ELSE 'mismatch' END AS recompute,
          CASE WHEN primary_dir IS NULL OR paired_dir IS NULL THEN 'missing_data'
               WHEN primary_dir >= 0 AND paired_dir >= 0 THEN 'no_concern'
               WHEN primary_dir < 0 AND paired_dir < 0 THEN 'dual_concern' ELSE 'trade_off_present' END AS guardrail,
          CASE WHEN diff IS NULL THEN 'n/a'
               WHEN diff < hist_lo OR diff > hist_hi OR NOT (level > 0) THEN 'implausible' ELSE 'plausible' END AS plausibility
        FROM f1),
 f3 AS (SELECT *, CASE WHEN recompute = 'unable_to_compute' THEN 'F'
                       WHEN recompute = 'mismatch' THEN CASE WHEN abs(stated - diff) / nullif(abs(diff), 0) > 0.10 THEN 'F' ELSE 'D' END
                       WHEN rigor = 'fail' THEN 'D' WHEN plausibility = 'implausible' THEN 'C'
                       WHEN rigor = 'partial' THEN 'B' WHEN guardrail = 'trade_off_present' THEN 'B' ELSE 'A' END AS g_base FROM f2),
 f4 AS (SELECT *, CASE g_base WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END AS s0 FROM f3),
 f5 AS (SELECT *, CASE WHEN s0 >= 2 THEN least(s0, CASE WHEN lenses < 3 THEN 2 ELSE 4 END) ELSE s0 END AS s1 FROM f4),
 findings AS (SELECT *, CASE (CASE WHEN guardrail = 'missing_data' AND s1 > 3 THEN 3 ELSE s1 END)
                           WHEN 4 THEN 'A' WHEN 3 THEN 'B' WHEN 2 THEN 'C' WHEN 1 THEN 'D' ELSE 'F' END AS grade FROM f5)"""

# caveats of every finding, in the order in which they are listed
CAVEATS_SQL = """cav AS (SELECT run_id, finding_id, grade, unnest(list_filter([
    CASE WHEN rigor = 'partial' THEN {'t': 'trivial effect behind a significant p', 's': 'medium', 'c': 'rigor'} END,
    CASE WHEN guardrail = 'trade_off_present' THEN {'t': 'completion share moved against order value', 's': 'high', 'c': 'guardrail'} END,
    CASE WHEN plausibility = 'implausible' THEN {'t': 'change outside the historical range', 's': 'high', 'c': 'plausibility'} END,
    CASE WHEN lenses < 3 THEN {'t': 'fewer than three lenses agree', 's': 'medium', 'c': 'triangulation'} END], lambda x: x IS NOT NULL)) AS c FROM findings)"""

GAPS_SQL = f"""WITH {FINDINGS_SQL}, {CAVEATS_SQL},
 a AS (SELECT left(trim(regexp_replace(regexp_replace(lower(c.t), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')), 120) AS k, count(*) AS frequency,
              CASE WHEN bool_or(c.s = 'high') THEN 'high' ELSE 'medium' END AS severity, max(c.t) AS text, list_sort(list(DISTINCT c.c)) AS categories,
              ['findings-validator'] AS sources, list_sort(list(DISTINCT run_id)) AS runs FROM cav GROUP BY 1)
SELECT frequency, severity, text, categories, sources, runs,
       row_number() OVER (ORDER BY severity = 'high' DESC, frequency DESC, categories[1], k) AS rank FROM a"""



@query("v01_recompute", f"WITH {FINDINGS_SQL} SELECT finding_id, stated, round(diff, 6) AS recomputed, recompute FROM findings")
def recompute(spark, sf):
    return findings(Tables(spark, sf)).select("finding_id", "stated", F.round("diff", 6).alias("recomputed"), "recompute")


@query("v02_rigor", f"""WITH {FINDINGS_SQL}
SELECT finding_id, round(p_value, 6) AS p_value, round(d, 6) AS effect_size, rigor FROM findings""")
def rigor(spark, sf):
    return findings(Tables(spark, sf)).select("finding_id", F.round("p_value", 6).alias("p_value"),
                                              F.round("d", 6).alias("effect_size"), "rigor")


@query("v03_guardrails", f"WITH {FINDINGS_SQL} SELECT finding_id, primary_dir, paired_dir, guardrail FROM findings")
def guardrails(spark, sf):
    f = findings(Tables(spark, sf))
    return f.select("finding_id", F.col("primary_dir").cast("double").alias("primary_dir"),
                    F.col("paired_dir").cast("double").alias("paired_dir"), "guardrail")


@query("v04_plausibility", f"""WITH {FINDINGS_SQL}
SELECT finding_id, round(hist_lo, 6) AS hist_lo, round(hist_hi, 6) AS hist_hi, plausibility FROM findings""")
def plausibility(spark, sf):
    return findings(Tables(spark, sf)).select("finding_id", F.round("hist_lo", 6).alias("hist_lo"),
                                              F.round("hist_hi", 6).alias("hist_hi"), "plausibility")


@query("v05_grade", f"""WITH {FINDINGS_SQL}
SELECT finding_id, rigor, recompute, guardrail, plausibility, lenses, grade FROM findings""")
def grade(spark, sf):
    return findings(Tables(spark, sf)).select("finding_id", "rigor", "recompute", "guardrail", "plausibility",
                                              "lenses", "grade")


@query("v06_publishable", f"""WITH {FINDINGS_SQL}
SELECT grade, count(*) AS n, count_if(grade NOT IN ('D', 'F')) AS n_publishable FROM findings GROUP BY grade""")
def publishable(spark, sf):
    f = findings(Tables(spark, sf))
    return f.groupBy("grade").agg(F.count("*").alias("n"), F.count_if(~F.col("grade").isin("D", "F"))
                                  .alias("n_publishable"))


@query("v10_review_gate", f"""WITH {FINDINGS_SQL},
 c AS (SELECT *, CASE grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 WHEN 'F' THEN 0 ELSE -1 END >= 3 AS held
       FROM findings WHERE grade NOT IN ('D', 'F'))
SELECT run_id, finding_id, grade, held, max(CAST(held AS INTEGER)) OVER (PARTITION BY run_id) = 1 AS gated FROM c""")
def review_gate(spark, sf):
    cards = V.publishable(findings(Tables(spark, sf)))
    return V.review_gate(cards, "B").select("run_id", "finding_id", "grade", "held", "gated")


@query("v11_connect", f"""WITH {FINDINGS_SQL},
 p AS (SELECT a.entity, a.finding_id AS a_id, b.finding_id AS b_id, a.grade AS a_grade, b.grade AS b_grade,
              (SELECT count(DISTINCT entity) FROM findings x WHERE x.grade IN ('A', 'B', 'C') AND sign(x.diff) = sign(a.diff)) < 2
                AS single_entity
       FROM findings a JOIN findings b ON a.entity = b.entity AND a.run_id < b.run_id
        AND a.window_start <= b.window_end AND b.window_start <= a.window_end),
 s AS (SELECT *, least(CASE a_grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END,
                       CASE b_grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END) AS ceil,
              CASE a_grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END <= 2
              AND CASE b_grade WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END <= 2 AS cc FROM p),
 r AS (SELECT *, CASE WHEN cc THEN NULL ELSE greatest(ceil - CAST(single_entity AS INTEGER), 0) END AS sc FROM s)
SELECT a_id, b_id, a_grade, b_grade,
       CASE sc WHEN 4 THEN 'A' WHEN 3 THEN 'B' WHEN 2 THEN 'C' WHEN 1 THEN 'D' WHEN 0 THEN 'F' END AS connection_grade,
       NOT cc AND sc >= 2 AS is_connection
FROM r""")
def connect(spark, sf):
    from prudent.operators import relational as R
    f = findings(Tables(spark, sf))
    ents = f.where(F.col("grade").isin("A", "B", "C")).groupBy(F.signum("diff").alias("sg")) \
        .agg(F.count_distinct("entity").alias("n_ent"))
    pairs = R.overlap_pairs(f, bin_days=30).select("entity", "a_id", "b_id")
    ga = f.select(F.col("finding_id").alias("a_id"), F.col("grade").alias("a_grade"), F.signum("diff").alias("sg"))
    gb = f.select(F.col("finding_id").alias("b_id"), F.col("grade").alias("b_grade"))
    p = pairs.join(ga, "a_id").join(gb, "b_id").join(ents, "sg", "left")
    c = V.connect(p, single_entity=F.coalesce(F.col("n_ent"), F.lit(0)) < 2)
    return c.select("a_id", "b_id", "a_grade", "b_grade", "connection_grade", "is_connection")


@query("v13_carry_caveats", f"""WITH {FINDINGS_SQL},
 c AS (SELECT entity, run_id, unnest(list_filter([
          CASE WHEN rigor = 'partial' THEN 'trivial effect behind a significant p' END,
          CASE WHEN guardrail = 'trade_off_present' THEN 'completion share moved against order value' END,
          CASE WHEN plausibility = 'implausible' THEN 'change outside the historical range' END,
          CASE WHEN lenses < 3 THEN 'fewer than three lenses agree' END], lambda x: x IS NOT NULL)) AS text
       FROM findings)
SELECT e.entity, list_sort(list_distinct(list(c.text) FILTER (WHERE c.text IS NOT NULL))) AS caveats,
       count(DISTINCT f.run_id) AS n_runs
FROM (SELECT DISTINCT entity FROM findings) e JOIN findings f ON f.entity = e.entity LEFT JOIN c
  ON c.entity = f.entity AND c.run_id = f.run_id
GROUP BY e.entity""")
def carry(spark, sf):
    return V.carry_caveats(findings(Tables(spark, sf)))


@query("v15_aggregate_gaps", GAPS_SQL)
def aggregate_gaps(spark, sf):
    """Gaps = every caveat raised by validation (category = layer, source =
    validator), grouped by fuzzy text key and ranked (T02)."""
    f = findings(Tables(spark, sf))
    g = f.select("run_id", F.explode("caveats").alias("c")).select(
        "run_id", F.col("c.text").alias("text"), F.col("c.severity").alias("severity"),
        F.when(F.col("c.text").contains("lenses"), "triangulation").when(F.col("c.text").contains("historical"),
                                                                           "plausibility")
        .when(F.col("c.text").contains("completion"), "guardrail").otherwise("rigor").alias("category"),
        F.lit("findings-validator").alias("source"))
    return V.aggregate_gaps(g)


@query("v16_usage_rollup", """
WITH c AS (SELECT conv_id, role, CAST(floor(len(regexp_extract_all(text, '[^\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+')) * 1.3) AS BIGINT) AS tok
           FROM conversations),
 u AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'model-a' WHEN conv_id % 3 = 1 THEN 'model-b' ELSE 'model-x' END AS model,
              sum(CASE WHEN role = 'user' THEN tok ELSE 0 END) AS input_tokens,
              sum(CASE WHEN role = 'assistant' THEN tok ELSE 0 END) AS output_tokens,
              sum(CASE WHEN role = 'system' THEN tok ELSE 0 END) AS cache_read_tokens,
              max(CASE WHEN role = 'system' THEN tok ELSE 0 END) AS cache_write_tokens FROM c GROUP BY conv_id),
 p AS (SELECT * FROM (VALUES ('model-a', 3.0::DOUBLE, 15.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE),
                             ('model-b', 0.8::DOUBLE, 4.0::DOUBLE, 0.08::DOUBLE, 1.0::DOUBLE)) t(model, p_in, p_out, p_cr, p_cw)),
 k AS (SELECT u.*, coalesce((input_tokens * p_in + output_tokens * p_out + cache_read_tokens * coalesce(p_cr, p_in * 0.1)
                             + cache_write_tokens * coalesce(p_cw, p_in * 1.25)) / 1e6, 0.0) AS cost FROM u LEFT JOIN p USING (model))
SELECT model, sum(input_tokens + output_tokens) AS tokens, round(sum(cost), 4) AS cost_usd, count(*) AS n_runs
FROM k GROUP BY ROLLUP (model)""")
def usage_rollup(spark, sf):
    from prudent.plans.q_text import price_table, usage, usage_cost
    c = usage_cost(usage(Tables(spark, sf)), price_table(spark))
    return c.rollup("model").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
                                 F.round(F.sum("cost_usd"), 4).alias("cost_usd"), F.count("*").alias("n_runs"))


@query("v17_span_rollup")
def span_rollup(spark, sf):
    """Spans from the event log: a root span per user session (first to last
    event), a child span per event lasting until the user's next event;
    'error' events carry an error."""
    e = Tables(spark, sf).events
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    child = e.select(F.col("event_id").cast("string").alias("span_id"),
                     F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("parent_span_id"),
                     F.col("event_type").alias("name"), F.col("ts").alias("started_at"),
                     F.coalesce(F.lead("ts").over(w), F.col("ts")).alias("ended_at"),
                     F.when(F.col("event_type") == "error", F.lit("error")).alias("error"))
    root = e.groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"), F.lit("session").alias("name"), "started_at", "ended_at",
        F.lit(None).cast("string").alias("error"))
    return V.span_rollup(child.unionByName(root))


@query("v18_run_status", f"""WITH {FINDINGS_SQL},
 st AS (SELECT run_id, entity, CASE WHEN least(n1, n0) < 30 THEN 'failed' WHEN rigor = 'partial' THEN 'degraded' ELSE 'ok' END AS status,
               (n1 + n0) = max(n1 + n0) OVER (PARTITION BY run_id) AS critical FROM findings)
SELECT run_id, CASE WHEN bool_or(status = 'failed' AND critical) THEN 'failed'
                    WHEN bool_or(status = 'degraded' OR (status = 'failed' AND NOT critical)) THEN 'degraded' ELSE 'ok' END AS status
FROM st GROUP BY run_id""")
def run_status(spark, sf):
    f = findings(Tables(spark, sf))
    st = f.select("run_id", F.when(F.least("n1", "n0") < 30, "failed").when(F.col("rigor") == "partial", "degraded")
                  .otherwise("ok").alias("status"),
                  ((F.col("n1") + F.col("n0")) == F.max(F.col("n1") + F.col("n0")).over(Window.partitionBy("run_id")))
                  .alias("critical"))
    return V.run_status(st)


@query("v19_prior_context", f"""WITH {FINDINGS_SQL},
 r AS (SELECT run_id, count_if(grade NOT IN ('D', 'F')) AS n_cards FROM findings GROUP BY 1)
SELECT run_id, n_cards, lag(n_cards) OVER (ORDER BY run_id) AS prior_cards, lag(run_id) OVER (ORDER BY run_id) AS prior_run
FROM r""")
def prior_context(spark, sf):
    f = findings(Tables(spark, sf))
    r = f.groupBy("run_id").agg(F.count_if(~F.col("grade").isin("D", "F")).alias("n_cards"))
    w = Window.orderBy("run_id")   # one row per run: a tiny table
    return r.select("run_id", "n_cards", F.lag("n_cards").over(w).alias("prior_cards"),
                    F.lag("run_id").over(w).alias("prior_run"))


@query("v20_hypothesis_queue", f"""WITH {FINDINGS_SQL},
 r AS (SELECT finding_id, entity, abs(z) AS strength,
              row_number() OVER (PARTITION BY entity ORDER BY abs(z) DESC, finding_id) AS rank FROM findings)
SELECT finding_id, entity, round(strength, 6) AS strength, rank, rank > 3 AS overflow FROM r""")
def hypothesis_queue(spark, sf):
    from prudent.operators import relational as R
    f = findings(Tables(spark, sf)).withColumn("strength", F.abs("z"))
    q = R.cap_candidates(f, ["entity"], [F.col("strength").desc(), F.col("finding_id").asc()], 3)
    return q.select("finding_id", "entity", F.round("strength", 6).alias("strength"), "rank", "overflow")


@query("v21_lenses", f"WITH {FINDINGS_SQL} SELECT finding_id, lenses, lenses >= 3 AS triangulated FROM findings")
def lenses(spark, sf):
    return findings(Tables(spark, sf)).select("finding_id", "lenses", (F.col("lenses") >= 3).alias("triangulated"))


@query("v22_causal_label", f"""WITH {FINDINGS_SQL}
SELECT finding_id, CASE WHEN false THEN 'established_causal'
                        WHEN true AND lenses >= 3 AND plausibility = 'plausible' THEN 'strong_correlation'
                        ELSE 'associational' END AS causal_label FROM findings""")
def causal(spark, sf):
    f = findings(Tables(spark, sf))
    lab = V.causal_label(F.lit(False), F.col("lenses") >= 3, F.col("plausibility") == "plausible", F.lit(True))
    return f.select("finding_id", lab.alias("causal_label"))


@query("v23_status_vs_baseline", """
WITH m AS (SELECT c.c_mktsegment, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS value
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2),
 b AS (SELECT *, avg(value) OVER w AS base_mean, stddev_samp(value) OVER w AS base_sd FROM m
       WINDOW w AS (PARTITION BY c_mktsegment ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT c_mktsegment, month, CASE WHEN base_mean IS NULL OR base_sd IS NULL THEN 'no_baseline'
                                 WHEN value > base_mean + 2.0 * base_sd THEN 'elevated'
                                 WHEN value < base_mean - 2.0 * base_sd THEN 'depressed' ELSE 'stable' END AS status
FROM b""")
def status_vs_baseline(spark, sf):
    t = Tables(spark, sf)
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    m = o.groupBy("c_mktsegment", F.to_date(F.date_trunc("MONTH", "o_orderdate")).alias("month")) \
        .agg(F.sum("o_totalprice").alias("value"))
    w = Window.partitionBy("c_mktsegment").orderBy("month").rowsBetween(-12, -1)
    b = m.withColumn("bm", F.avg("value").over(w)).withColumn("bs", F.stddev_samp("value").over(w))
    return b.select("c_mktsegment", "month", V.status_vs_baseline(F.col("value"), F.col("bm"), F.col("bs"))
                    .alias("status"))


@query("v24_follow_up", f"""WITH {FINDINGS_SQL},
 cur AS (SELECT o_orderpriority AS run_id, c.c_mktsegment AS entity,
                avg(CASE WHEN year(o_orderdate) = 1999 THEN o_totalprice END)
                - avg(CASE WHEN year(o_orderdate) = 1998 THEN o_totalprice END) AS diff_now
         FROM orders JOIN customer c ON o_custkey = c.c_custkey GROUP BY 1, 2)
SELECT finding_id, CASE WHEN sign(diff_now) <> sign(diff) THEN 'resolved'
                        WHEN abs(diff_now) > 2 * abs(diff) THEN 'escalate' ELSE 'open' END AS follow_up
FROM findings JOIN cur USING (run_id, entity) WHERE grade NOT IN ('D', 'F')""")
def follow_up(spark, sf):
    """Prior cards (1997->1998 changes) checked on the next period
    (1998->1999): resolved if the direction reversed, escalate if the move
    more than doubled, else open."""
    t = Tables(spark, sf)
    f = V.publishable(findings(t))
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    cur = o.groupBy(F.col("o_orderpriority").alias("run_id"), F.col("c_mktsegment").alias("entity")).agg(
        (F.avg(F.when(F.year("o_orderdate") == 1999, F.col("o_totalprice")))
         - F.avg(F.when(F.year("o_orderdate") == 1998, F.col("o_totalprice")))).alias("diff_now"))
    j = f.join(cur, ["run_id", "entity"])
    return j.select("finding_id", F.when(F.signum("diff_now") != F.signum("diff"), "resolved")
                    .when(F.abs("diff_now") > 2 * F.abs("diff"), "escalate").otherwise("open").alias("follow_up"))


@query("v09_lineage", f"""WITH {FINDINGS_SQL},
 s AS (SELECT finding_id, unnest(['diff', 'z', 'p_value', 'effect_size']) AS statistic FROM findings)
SELECT statistic, count(*) AS n_findings FROM s GROUP BY statistic""")
def lineage(spark, sf):
    f = findings(Tables(spark, sf))
    s = f.select("finding_id", F.explode(F.array(*[F.lit(x) for x in ("diff", "z", "p_value", "effect_size")]))
                 .alias("statistic"))
    return s.groupBy("statistic").agg(F.count("*").alias("n_findings"))


@query("v08_consistency", f"""WITH {FINDINGS_SQL},
 ev AS (SELECT finding_id, unnest([finding_id || '#diff', finding_id || '#z', finding_id || '#ci']) AS evidence_id FROM findings),
 st AS (SELECT finding_id || '#diff' AS stat_id FROM findings WHERE diff IS NOT NULL
        UNION ALL SELECT finding_id || '#z' FROM findings WHERE z IS NOT NULL)
SELECT count(*) AS n_evidence, count_if(stat_id IS NULL) AS n_missing_evidence,
       (SELECT count_if(grade NOT IN ('D', 'F')) FROM findings) AS n_cards
FROM ev LEFT JOIN st ON ev.evidence_id = st.stat_id""")
def consistency(spark, sf):
    """Every evidence id cited by a finding must exist in the statistics
    table (the CI is cited but not registered as a statistic, so it is
    reported missing); card count beside it."""
    f = findings(Tables(spark, sf))
    ev = f.select(F.explode(F.array(*[F.concat("finding_id", F.lit(s)) for s in ("#diff", "#z", "#ci")]))
                  .alias("evidence_id"))
    st = f.where(F.col("diff").isNotNull()).select(F.concat("finding_id", F.lit("#diff")).alias("evidence_id")) \
        .unionByName(f.where(F.col("z").isNotNull()).select(F.concat("finding_id", F.lit("#z")).alias("evidence_id")))
    missing = ev.join(st, "evidence_id", "left_anti").select(F.count("*")).scalar()
    cards = f.select(F.count_if(~F.col("grade").isin("D", "F"))).scalar()
    return ev.agg(F.count("*").alias("n_evidence")).select("n_evidence", missing.alias("n_missing_evidence"),
                                                           cards.alias("n_cards"))


@query("v07_lost_caveats", f"""WITH {FINDINGS_SQL}, {CAVEATS_SQL}
SELECT finding_id, c.t AS text, c.s AS severity FROM cav WHERE c.s = 'high' AND grade IN ('D', 'F')""")
def lost(spark, sf):
    """High-severity caveats of findings that did not reach the cards."""
    f = findings(Tables(spark, sf))
    up = f.select("finding_id", F.explode("caveats").alias("c")).select("finding_id", "c.text", "c.severity")
    down = V.publishable(f).select("finding_id", F.explode("caveats").alias("c")).select("finding_id", "c.text")
    return V.lost_caveats(up, down)


@query("v12_require_runs", f"""WITH {FINDINGS_SQL}
SELECT count(DISTINCT run_id) FILTER (grade IN ('A', 'B', 'C')) AS usable_runs, count(DISTINCT run_id) FILTER (grade IN ('A', 'B', 'C')) >= 2 AS can_synthesise
FROM findings""")
def require_runs(spark, sf):
    """Synthesis needs at least two usable runs (runs with any A-C finding)."""
    f = findings(Tables(spark, sf))
    n = f.where(F.col("grade").isin("A", "B", "C")).select(F.count_distinct("run_id")).scalar()
    return spark.range(1).select(n.alias("usable_runs"), (n >= 2).alias("can_synthesise"))


@query("v14_extract_gaps", f"""WITH {FINDINGS_SQL}, {CAVEATS_SQL}
SELECT run_id, finding_id, c.t AS text, c.s AS severity, 'findings-validator' AS source, 'caveats' AS field FROM cav""")
def extract_gaps(spark, sf):
    """One row per gap: caveats of every finding, with category, severity,
    source and run; short strings (<= 5 chars) dropped."""
    f = findings(Tables(spark, sf))
    g = f.select("run_id", "finding_id", F.explode("caveats").alias("c"))
    return g.select("run_id", "finding_id", F.col("c.text").alias("text"), S.norm_severity("c.severity")
                    .alias("severity"), F.lit("findings-validator").alias("source"),
                    F.lit("caveats").alias("field")).where(F.length("text") > 5)
