"""Grading decision table, review gate, connection ceilings, and the
streaming forms against their batch counterparts."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from prudent.operators import findings as V


def test_grade_table(spark):
    rows = [("pass", "match", "no_concern", "plausible", 3, "A"),
            ("pass", "match", "trade_off_present", "plausible", 3, "B"),
            ("partial", "match", "no_concern", "plausible", 3, "B"),
            ("pass", "match", "no_concern", "implausible", 3, "C"),
            ("fail", "match", "no_concern", "plausible", 3, "D"),
            ("pass", "unable_to_compute", "no_concern", "plausible", 3, "F"),
            ("pass", "match", "no_concern", "plausible", 2, "C"),          # fewer than 3 lenses caps at C
            ("pass", "match", "missing_data", "plausible", 3, "B")]        # missing guardrail: at most B
    df = spark.createDataFrame(rows, "r string, c string, g string, p string, l int, expect string")
    got = df.select("expect", V.grade(F.col("r"), F.col("c"), F.col("g"), F.col("p"), F.col("l")).alias("g")).collect()
    assert [x.g for x in got] == [x.expect for x in got]


def test_review_gate_and_connect(spark):
    cards = spark.createDataFrame([("r1", "A"), ("r1", "C"), ("r2", "C")], "run_id string, grade string")
    g = {(r.run_id, r.grade): (r.held, r.gated) for r in V.review_gate(cards, "B").collect()}
    assert g[("r1", "A")] == (True, True) and g[("r2", "C")] == (False, False)
    off = V.review_gate(cards, None).where("held").count()
    assert off == 0
    pairs = spark.createDataFrame([("A", "B"), ("C", "C"), ("A", "C")], "a_grade string, b_grade string")
    c = [(r.connection_grade, r.is_connection) for r in V.connect(pairs).collect()]
    assert c == [("B", True), (None, False), ("C", True)]


def test_stream_cusum_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    cols = ["c_mktsegment", "n", "first_alarm_t", "n_alarms", "max_pos", "max_neg"]
    a = sorted(tuple(r) for r in q["g06_cusum"](spark, SF_SMALL).select(*cols).collect())
    b = sorted(tuple(r) for r in q["r01_stream_cusum"](spark, SF_SMALL).select(*cols).collect())
    assert a == b


def test_stream_ratio_equals_batch(spark):
    import __spark_entry__ as E
    s = E.queries()["r02_stream_ratio"](spark, SF_SMALL)
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    b = ev.groupBy(F.to_date("ts").alias("day")).agg(
        F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)) / F.sum("value"), 6)
        .alias("ratio"))
    assert sorted(tuple(r) for r in s.select("day", "ratio").collect()) == sorted(tuple(r) for r in b.collect())


def test_rows_out_of_order_are_folded_in_order_and_late_ones_counted(spark):
    import __spark_entry__ as E
    q = E.queries()
    got = q["r01_cusum_event_time"](spark, SF_SMALL).collect()
    whole = {r.c_mktsegment: r.n for r in q["g06_cusum"](spark, SF_SMALL).collect()}
    assert {r.c_mktsegment: r.n + r.n_late for r in got} == whole and sum(r.n_late for r in got) > 0
    days = q["r02_ratio_closed_days"](spark, SF_SMALL).collect()
    assert sum(r.n + r.n_late for r in days) == spark.read.parquet(f"{SF_SMALL}/events.parquet").count() and sum(r.n_late for r in days) > 0
