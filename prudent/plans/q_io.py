"""Source / sink queries (S family)."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from prudent.sources import io as IO
from prudent.streaming.stream import staging
from prudent.plans.q_findings import FINDINGS_SQL
from prudent.plans.registry import Tables, query


@query("s01_csv_roundtrip", """
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS value
FROM lineitem GROUP BY 1""")
def csv_roundtrip(spark, sf):
    """Land lineitem as CSV (header) and scan it back with inferred types."""
    li = Tables(spark, sf).lineitem.select("l_returnflag", "l_quantity", "l_extendedprice")
    path = IO.write_table(li, os.path.join(staging(spark, "csv"), "lineitem.csv"), "csv")
    back = IO.load_table(spark, path, "csv")
    return back.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"),
                                            F.round(F.sum("l_extendedprice"), 2).alias("value"))


@query("s03_read_query", """
SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 10 GROUP BY 1""")
def read_query(spark, sf):
    Tables(spark, sf).lineitem.createOrReplaceTempView("prudent_lineitem")
    return IO.read_query(spark, "SELECT l_linestatus, count(*) AS n FROM prudent_lineitem "
                                "WHERE l_returnflag = :flag AND l_quantity >= :min_qty GROUP BY 1",
                         {"flag": "R", "min_qty": 10})


@query("s04_describe_columns")
def describe(spark, sf):
    return IO.describe_columns(Tables(spark, sf).orders)


def _artifact_root(spark, sf):
    """Stage artifacts derived from the data, written by Spark: one JSON
    object per run (order priority) and stage (segment, numbered in name
    order), a replay copy of stage 2, and stage 5 without a payload."""
    t = Tables(spark, sf)
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    g = o.groupBy("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"))
    stage = F.dense_rank().over(Window.orderBy("c_mktsegment"))       # 5 segments: a tiny table
    g = g.withColumn("stage", stage)
    name = F.concat(F.lpad(F.col("stage").cast("string"), 2, "0"), F.lit("-"), F.lower("c_mktsegment"))
    body = F.when(F.col("stage") != 5, F.to_json(F.struct(F.struct("n", "m").alias("payload")))) \
        .otherwise(F.lit('{"note": "no payload"}'))
    a = g.select(F.regexp_replace("o_orderpriority", " ", "_").alias("run_id"),
                 F.concat(name, F.lit(".json")).alias("artifact"), body.alias("body"))
    replay = g.where("stage = 2").select(F.regexp_replace("o_orderpriority", " ", "_").alias("run_id"),
                                         F.concat(name, F.lit("-replay.json")).alias("artifact"), body.alias("body"))
    return IO.write_stage_artifacts(a.unionByName(replay), staging(spark, "artifacts"))


_ART_SQL = """a AS (SELECT replace(o.o_orderpriority, ' ', '_') AS run_id, c.c_mktsegment AS seg, dense_rank() OVER (ORDER BY c.c_mktsegment) AS stage_index
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o.o_orderpriority, c.c_mktsegment),
 f AS (SELECT run_id, CAST(stage_index AS INTEGER) AS stage_index, lower(seg) AS agent, lpad(CAST(stage_index AS VARCHAR), 2, '0') || '-' || lower(seg) AS name FROM a WHERE stage_index <= 4)"""


@query("s05_read_artifacts", f"""WITH {_ART_SQL}
SELECT run_id, stage_index, agent, name || '.json' AS file_name FROM f UNION ALL SELECT run_id, stage_index, agent, name || '-replay.json' FROM f WHERE stage_index = 2""")
def read_artifacts(spark, sf):
    a = IO.read_artifacts(spark, _artifact_root(spark, sf), max_stage=4)
    return a.select("run_id", "stage_index", "agent", "file_name")


@query("s06_pick_primary", f"WITH {_ART_SQL} SELECT run_id, stage_index, name || '.json' AS file_name FROM f")
def pick_primary(spark, sf):
    a = IO.read_artifacts(spark, _artifact_root(spark, sf), max_stage=4)
    return IO.pick_primary(a).select("run_id", "stage_index", "file_name")


@query("s07_event_log", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def event_log(spark, sf):
    """A log with torn lines: they are dropped, the others are all read."""
    from prudent.streaming.stream import write_event_log
    path = write_event_log(Tables(spark, sf).events, os.path.join(staging(spark, "log"), "run.jsonl"), torn=True)
    e = IO.read_event_log(spark, path)
    return e.select(F.try_variant_get("e", "$.event_type", "string").alias("event_type")) \
        .groupBy("event_type").count()


@query("s08_spans", """
WITH s AS (SELECT event_type AS name, event_id, ts, lag(event_id) OVER w AS parent, lead(ts) OVER w AS nxt
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT name, count(*) AS n, count(parent) AS n_children, CAST(sum(floor(epoch(coalesce(nxt, ts))) - floor(epoch(ts))) * 1000 AS DOUBLE) AS ms
FROM s GROUP BY 1""")
def spans(spark, sf):
    """One span per event, under the user's event before it, until the user's next event; written and read back."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    end = F.coalesce(F.lead("ts").over(w), F.col("ts"))

    def millis(c):
        return F.unix_seconds(c.cast("timestamp")) * 1000  # whole seconds
    s = Tables(spark, sf).events.select(
        F.col("event_id").cast("string").alias("span_id"), F.lag("event_id").over(w).cast("string").alias("parent_span_id"),
        F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("started_at"), end.cast("timestamp").alias("ended_at"),
        (millis(end) - millis(F.col("ts"))).cast("double").alias("duration_ms"),
        F.when(F.col("event_type") == "error", F.lit("error")).alias("error"))
    path = os.path.join(staging(spark, "spans"), "spans.json")
    s.write.mode("overwrite").json(path)
    return IO.read_spans(spark, path).groupBy("name").agg(F.count("*").alias("n"), F.count("parent_span_id").alias("n_children"),
                                                          F.sum("duration_ms").alias("ms"))


@query("s09_write_artifacts", f"WITH {FINDINGS_SQL} SELECT run_id, count(*) AS n_findings FROM findings GROUP BY 1")
def write_artifacts(spark, sf):
    from prudent.plans.q_findings import findings
    f = findings(Tables(spark, sf)).select("run_id", "finding_id", "grade", "p_value")
    root = IO.write_artifacts(f, os.path.join(staging(spark, "out"), "artifacts"))
    return spark.read.json(root).groupBy("run_id").agg(F.count("*").alias("n_findings"))


@query("s11_capped", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def capped(spark, sf):
    d, _obs = IO.capped(Tables(spark, sf).orders.select("o_orderkey", "o_totalprice"), 1000, [F.col("o_orderkey")])
    return d


@query("s12_register_views", """
WITH supplier_bridge AS (SELECT s.s_suppkey, n.n_name, r.r_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
                         JOIN region r ON n.n_regionkey = r.r_regionkey),
 fact AS (SELECT * FROM lineitem l WHERE l_suppkey <> 9999 AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey))
SELECT b.r_name, count(*) AS n_lines, round(sum(f.l_quantity), 2) AS qty
FROM fact f JOIN supplier_bridge b ON f.l_suppkey = b.s_suppkey GROUP BY 1""")
def register_views(spark, sf):
    t = Tables(spark, sf)
    bridge = t.supplier.join(F.broadcast(t.nation), t.supplier.s_nationkey == t.nation.n_nationkey) \
        .join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select("s_suppkey", "n_name", "r_name")
    fact = t.lineitem.where("l_suppkey <> 9999").join(t.part.select(F.col("p_partkey").alias("l_partkey")),
                                                      "l_partkey", "left_semi")
    IO.register_views(spark, {"prudent_supplier_bridge": bridge, "prudent_fact": fact})
    return spark.sql("""SELECT b.r_name, count(*) AS n_lines, round(sum(f.l_quantity), 2) AS qty
                        FROM prudent_fact f JOIN prudent_supplier_bridge b ON f.l_suppkey = b.s_suppkey GROUP BY 1""")
