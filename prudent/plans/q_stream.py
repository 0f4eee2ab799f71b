"""Streaming queries (R family): bounded replays of driver tables through
Structured Streaming (availableNow), compacted from the file sink."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from prudent.functions.scalar import safe_div
from prudent.plans.q_series import SEG_SQL, seg_series
from prudent.plans.registry import Tables, query
from prudent.streaming import stream as R


@query("r02_stream_ratio", """
SELECT CAST(date_trunc('day', ts) AS DATE) AS day,
       round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) / nullif(sum(value), 0), 6) AS ratio,
       round(sum(value), 4) AS volume
FROM events GROUP BY 1""")
def stream_ratio(spark, sf):
    return R.stream_ratio(spark, sf, "purchase", "1 day")


@query("r03_stream_event_log", """
SELECT user_id, round(sum(value), 4) AS total, count(*) AS n_events, sum(value) >= 250 AS crossed_50, sum(value) >= 375 AS crossed_75,
       sum(value) >= 450 AS crossed_90, sum(value) >= 500 AS crossed_100
FROM events GROUP BY 1""")
def stream_event_log(spark, sf):
    """The log holds torn and repeated lines; the totals must not."""
    log = R.write_event_log(Tables(spark, sf).events, os.path.join(R.staging(spark, "log"), "run.jsonl"), torn=True, repeated=True)
    return R.stream_event_log(spark, log, cap=500.0)


@query("r01_stream_cusum")
def stream_cusum(spark, sf):
    """The weekly order series per segment, standardised as in G06, lands
    as one file per year; the online CUSUM consumes one file per batch."""
    s = seg_series(Tables(spark, sf))
    st = s.groupBy("c_mktsegment").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd"))
    x = s.join(st, "c_mktsegment").select("c_mktsegment", "t", safe_div(F.col("y") - F.col("m"), F.col("sd")).alias("x"),
                                          F.year("period").alias("yr"))
    d = R.staging(spark, "series")
    x.write.mode("overwrite").partitionBy("yr").parquet(d)
    return R.stream_cusum(spark, d, "c_mktsegment", 0.5, 5.0)


# Four landings of the series, each row up to twenty weeks early or late by a rule on its period, every thirteenth 200 weeks later still.  A row is late when the
# watermark had passed it before the landing began: the latest time of all landings but the last one, less the delay.
_LANDING = "CAST(greatest(0, least(3, floor(((t - t0) + (t * 7919) % 41 - 20 + CASE WHEN t % 13 = 0 THEN 200 ELSE 0 END) * 4 / (t1 - t0 + 1)))) AS INT)"


@query("r01_cusum_event_time", f"""WITH {SEG_SQL},
 st AS (SELECT c_mktsegment, avg(y) AS m, stddev_samp(y) AS s FROM ss GROUP BY 1),
 x AS (SELECT ss.c_mktsegment, t, period, (y - m) / nullif(s, 0) AS x, (SELECT min(t) FROM ss) AS t0, (SELECT max(t) FROM ss) AS t1 FROM ss JOIN st USING (c_mktsegment)),
 f AS (SELECT *, {_LANDING} AS landing FROM x),
 mx AS (SELECT landing, max(period) AS top FROM f GROUP BY 1),
 wm AS (SELECT landing, max(top) OVER (ORDER BY landing ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 56 DAY AS mark FROM mx),
 o AS (SELECT c_mktsegment, t, x, coalesce(period <= mark, false) AS is_late FROM f JOIN wm USING (landing)),
 l AS (SELECT c_mktsegment, list({{'t': t, 'x': x}} ORDER BY t) FILTER (NOT is_late) AS a, count_if(is_late) AS n_late FROM o GROUP BY 1),
 r AS (SELECT c_mktsegment, n_late, list_reduce(a, lambda s, e: {{
          'sp': greatest(0.0, s.sp + coalesce(e.x, 0.0) - 0.5), 'sn': greatest(0.0, s.sn - coalesce(e.x, 0.0) - 0.5), 'i': s.i + 1,
          'first': CASE WHEN s.first IS NULL AND (greatest(0.0, s.sp + coalesce(e.x, 0.0) - 0.5) > 5.0 OR greatest(0.0, s.sn - coalesce(e.x, 0.0) - 0.5) > 5.0) THEN e.t ELSE s.first END,
          'alarms': s.alarms + CASE WHEN greatest(0.0, s.sp + coalesce(e.x, 0.0) - 0.5) > 5.0 OR greatest(0.0, s.sn - coalesce(e.x, 0.0) - 0.5) > 5.0 THEN 1 ELSE 0 END,
          'maxp': greatest(s.maxp, greatest(0.0, s.sp + coalesce(e.x, 0.0) - 0.5)), 'maxn': greatest(s.maxn, greatest(0.0, s.sn - coalesce(e.x, 0.0) - 0.5))}},
          {{'sp': 0.0::DOUBLE, 'sn': 0.0::DOUBLE, 'i': 0::BIGINT, 'first': NULL::BIGINT, 'alarms': 0::BIGINT, 'maxp': 0.0::DOUBLE, 'maxn': 0.0::DOUBLE}}) AS r FROM l)
SELECT c_mktsegment, r.i AS n, n_late, r.first AS first_alarm_t, r.alarms AS n_alarms, round(r.maxp, 6) AS max_pos, round(r.maxn, 6) AS max_neg FROM r""")
def cusum_event_time(spark, sf):
    """The weekly order series of every segment, landing out of order in four files."""
    s = seg_series(Tables(spark, sf))
    st = s.groupBy("c_mktsegment").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd"))
    ends = s.agg(F.min("t").alias("t0"), F.max("t").alias("t1")).first()
    x = s.join(st, "c_mktsegment").select("c_mktsegment", F.col("period").cast("timestamp").alias("ts"), "t", safe_div(F.col("y") - F.col("m"), F.col("sd")).alias("x"),
                                          F.expr(_LANDING.replace("t0", str(ends["t0"])).replace("t1", str(ends["t1"]))).alias("landing"))
    return R.ordered_cusum(spark, R.land(x, "landing", R.staging(spark, "series-unordered")), "c_mktsegment", late="56 days")


_EVENT_LANDING = "CAST(greatest(0, least(5, floor((d + (event_id * 37) % 9 - 4 + CASE WHEN event_id % 17 = 0 THEN 15 ELSE 0 END) * 6 / (d1 + 1)))) AS INT)"


@query("r02_ratio_closed_days", f"""
WITH e AS (SELECT event_id, ts, event_type, value, CAST(ts AS DATE) - (SELECT CAST(min(ts) AS DATE) FROM events) AS d,
                  (SELECT CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) FROM events) AS d1 FROM events),
 f AS (SELECT *, {_EVENT_LANDING} AS landing FROM e),
 mx AS (SELECT landing, max(ts) AS top FROM f GROUP BY 1),
 wm AS (SELECT landing, max(top) OVER (ORDER BY landing ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 2 DAY AS mark FROM mx),
 o AS (SELECT *, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS is_late FROM f JOIN wm USING (landing))
SELECT CAST(ts AS DATE) AS day, round(sum(CASE WHEN NOT is_late AND event_type = 'purchase' THEN value WHEN NOT is_late THEN 0 END)
         / nullif(sum(CASE WHEN NOT is_late THEN value END), 0), 6) AS ratio, round(sum(CASE WHEN NOT is_late THEN value END), 4) AS volume,
       count_if(NOT is_late) AS n, count_if(is_late) AS n_late FROM o GROUP BY 1""")
def ratio_closed_days(spark, sf):
    """Purchases' share of a day's value; events land in six files, up to four days early or late, every seventeenth fifteen days later still."""
    e = Tables(spark, sf).events
    ends = e.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).first()
    d = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.date_diff(F.to_date("ts"), F.lit(ends["a"])).alias("d"))
    d = d.withColumn("landing", F.expr(_EVENT_LANDING.replace("d1", str((ends["b"] - ends["a"]).days if ends["a"] else 0)))).drop("d")
    return R.closed_ratio(spark, R.land(d, "landing", R.staging(spark, "events-unordered")))
