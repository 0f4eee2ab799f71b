"""Structured Streaming forms of three batch operators (inventory R).

* R01 ``stream_cusum`` -- online two-sided CUSUM per entity with
  ``applyInPandasWithState`` (state: the two sums, counters, peaks);
* R02 ``stream_ratio`` -- daily tumbling ratio of sums with a watermark for
  late rows;
* R03 ``stream_event_log`` -- JSON-lines log tail: malformed lines dropped,
  duplicates removed within the watermark, running totals with threshold
  alarms.

Sinks are files in the shared staging folder (under the cluster's
``spark.checkpoint.dir``) written by ``foreachBatch`` with the batch id; the
result is the compacted latest row per key, so it is exactly-once across
restarts (the checkpoint records committed batches) and nothing is held on
the driver.  Bounded replays use ``trigger(availableNow=True)``.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from prudent.session import checkpoint_dir


def staging(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), "prudent-stage", f"{name}-{uuid.uuid4().hex[:12]}")


def table_stream(spark: SparkSession, sf_dir: str, name: str, **options):
    """A file stream over one driver table (the directory filtered to its file)."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    for k, v in options.items():
        r = r.option(k, v)
    return r.parquet(sf_dir)


def run_to_files(sdf: DataFrame, out: str, mode: str = "update") -> None:
    """Run a streaming query to the end of the available input, appending
    every micro-batch (tagged with its batch id) to parquet under ``out``."""
    def sink(batch: DataFrame, batch_id: int):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(os.path.join(out, "data"))

    q = (sdf.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", os.path.join(out, "_checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def latest(spark: SparkSession, out: str, key: list[str], schema_cols: list[str]) -> DataFrame:
    """Compact an update-mode changelog: the row of the latest batch per key."""
    path = os.path.join(out, "data")
    d = spark.read.parquet(path)
    w = Window.partitionBy(*key).orderBy(F.col("_batch").desc())
    return d.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*schema_cols)


# -- R02 ------------------------------------------------------------------
def stream_ratio(spark: SparkSession, sf_dir: str, num_type: str = "purchase", late: str = "1 day") -> DataFrame:
    """Daily tumbling windows over ``events``: sum(value of num_type events)
    / sum(value), late rows accepted within the watermark."""
    ev = table_stream(spark, sf_dir, "events", maxFilesPerTrigger=1)
    agg = (ev.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
           .agg(F.sum(F.when(F.col("event_type") == num_type, F.col("value")).otherwise(0.0)).alias("num"),
                F.sum("value").alias("den"))
           .select(F.to_date(F.col("w.start")).alias("day"), "num", "den"))
    out = staging(spark, "ratio")
    run_to_files(agg, out, "update")
    r = latest(spark, out, ["day"], ["day", "num", "den"])
    return r.select("day", F.round(F.try_divide("num", "den"), 6).alias("ratio"), F.round("den", 4).alias("volume"))


# -- R03 ------------------------------------------------------------------
def stream_event_log(spark: SparkSession, log_dir: str, cap: float, marks=(0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    """Tail a JSON-lines log: malformed lines dropped, duplicate events
    removed within the watermark, running total per user with the cap marks
    crossed."""
    raw = spark.readStream.text(log_dir)
    v = F.try_parse_json("value")
    ev = raw.select(v.alias("j")).where(F.col("j").isNotNull()).select(
        F.try_variant_get("j", "$.event_id", "bigint").alias("event_id"),
        F.try_variant_get("j", "$.user_id", "bigint").alias("user_id"),
        F.try_variant_get("j", "$.ts", "timestamp").alias("ts"),
        F.try_variant_get("j", "$.value", "double").alias("value")).where(
        F.col("event_id").isNotNull() & F.col("ts").isNotNull())
    dedup = ev.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    tot = dedup.groupBy("user_id").agg(F.sum("value").alias("total"), F.count("*").alias("n_events"))
    out = staging(spark, "eventlog")
    run_to_files(tot, out, "update")
    r = latest(spark, out, ["user_id"], ["user_id", "total", "n_events"])
    for m in marks:
        r = r.withColumn(f"crossed_{int(m * 100)}", F.col("total") >= F.lit(m * cap))
    return r.withColumn("total", F.round("total", 4))


def write_event_log(df: DataFrame, out: str, torn: bool = False, repeated: bool = False) -> str:
    """Land events as one JSON object per line (the log the tail reads).

    ``torn`` and ``repeated`` add what a log holds after a crash: lines that
    break off (every 50th event again, cut short) and lines written twice
    (every 70th event)."""
    line = F.to_json(F.struct("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
                              "event_type", "value"))
    lines = F.array(line,
                    F.when(F.lit(torn) & (F.col("event_id") % 50 == 0), F.substring(line, F.lit(1), F.length(line) - 3)),
                    F.when(F.lit(repeated) & (F.col("event_id") % 70 == 0), line))
    df.select(F.explode(F.array_compact(lines)).alias("value")).write.mode("overwrite").text(out)
    return out


# -- R01 ------------------------------------------------------------------
CUSUM_STATE = "sp double, sn double, n long, first_alarm long, alarms long, maxp double, maxn double"


def stream_cusum(spark: SparkSession, series_dir: str, key: str, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """Online two-sided CUSUM per entity over a stream of standardised
    observations (columns key, t, x) arriving in files; state survives across
    micro-batches and restarts (checkpointed)."""
    schema = spark.read.parquet(series_dir).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(series_dir)
    key_type = schema[key].dataType.simpleString()
    out_schema = f"{key} {key_type}, n long, first_alarm_t long, n_alarms long, max_pos double, max_neg double"

    def step(kv, pdfs, state):
        if state.exists:
            sp, sn, n, first, alarms, maxp, maxn = state.get
        else:
            sp, sn, n, first, alarms, maxp, maxn = 0.0, 0.0, 0, None, 0, 0.0, 0.0
        pdf = pd.concat(list(pdfs)).sort_values("t")
        for t, x in zip(pdf["t"], pdf["x"]):
            x = 0.0 if pd.isna(x) else float(x)
            sp, sn = max(0.0, sp + x - k), max(0.0, sn - x - k)
            n += 1
            if sp > h or sn > h:
                alarms += 1
                if first is None or pd.isna(first):
                    first = int(t)
            maxp, maxn = max(maxp, sp), max(maxn, sn)
        state.update((sp, sn, n, first, alarms, maxp, maxn))
        yield pd.DataFrame({key: [kv[0]], "n": [n], "first_alarm_t": [first], "n_alarms": [alarms],
                            "max_pos": [maxp], "max_neg": [maxn]})

    st = s.groupBy(key).applyInPandasWithState(step, out_schema, CUSUM_STATE, "update",
                                               GroupStateTimeout.NoTimeout)
    out = staging(spark, "cusum")
    run_to_files(st, out, "update")
    r = latest(spark, out, [key], [key, "n", "first_alarm_t", "n_alarms", "max_pos", "max_neg"])
    return r.withColumn("max_pos", F.round("max_pos", 6)).withColumn("max_neg", F.round("max_neg", 6))


# -- event-time order --------------------------------------------------------
#: settings for keyed state with timers: state on disk, no space taken ahead in every partition's store
_TIMED_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
                "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
                "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def land(df: DataFrame, order: str, out: str) -> str:
    """Write the rows of each value of ``order`` as files of their own, in that order (a file source reads them by their age)."""
    for r in df.select(order).distinct().orderBy(order).collect():  # one row a landing
        df.where(F.col(order) == F.lit(r[0])).drop(order).coalesce(1).write.mode("append").parquet(out)
    return out


def closing_row(spark: SparkSession, landing: str, ts: str, after: str) -> None:
    """Land one row far after all others, so that the watermark passes what is still open (its key and values are null)."""
    schema = spark.read.parquet(landing).schema
    last = spark.read.parquet(landing).agg((F.max(ts) + F.expr(f"INTERVAL {after}")).alias(ts))
    row = last.select(*[F.col(ts).cast(f.dataType) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    row.coalesce(1).write.mode("append").parquet(landing)


class _OrderedCusum(StatefulProcessor):
    """Buffers an entity's observations by time; a timer at each time releases them in order once the watermark has passed."""

    def __init__(self, key: str, k: float, h: float):
        self.key, self.k, self.h = key, k, h

    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", CUSUM_STATE)
        self.waiting = handle.getMapState("waiting", "ms long", "t long, x array<double>")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            for ms, t, x in zip(pdf["ms"], pdf["t"], pdf["x"]):
                if pd.isna(t):  # the closing row only moves the watermark
                    continue
                at = (int(ms),)
                more = list(self.waiting.getValue(at)[1]) if self.waiting.containsKey(at) else []
                if not more:
                    self.handle.registerTimer(int(ms))
                self.waiting.updateValue(at, (int(t), more + [0.0 if pd.isna(x) else float(x)]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # all that is due, oldest first: later timers of the same entity then find nothing
        due = sorted(int(ms[0]) for ms in self.waiting.keys() if int(ms[0]) <= timerValues.getCurrentWatermarkInMs())
        if not due:
            return
        sp, sn, n, first, alarms, maxp, maxn = self.sums.get() if self.sums.exists() else (0.0, 0.0, 0, None, 0, 0.0, 0.0)
        for ms in due:
            t, values = self.waiting.getValue((ms,))
            for x in sorted(values):
                sp, sn = max(0.0, sp + x - self.k), max(0.0, sn - x - self.k)
                n += 1
                if sp > self.h or sn > self.h:
                    alarms += 1
                    first = int(t) if first is None or pd.isna(first) else first
                maxp, maxn = max(maxp, sp), max(maxn, sn)
            self.waiting.removeKey((ms,))
        self.sums.update((sp, sn, n, first, alarms, maxp, maxn))
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "first_alarm_t": pd.array([first], "Int64"), "n_alarms": [alarms],
                            "max_pos": [maxp], "max_neg": [maxn]})

    def close(self) -> None:
        pass


def ordered_cusum(spark: SparkSession, landing: str, key: str, k: float = 0.5, h: float = 5.0, late: str = "8 weeks") -> DataFrame:
    """R01 in event-time order: two-sided CUSUM per entity over observations (key, ts, t, x) that land out of order.

    Rows wait in keyed state, on disk, until the watermark (latest time seen less ``late``) passes them, and are then folded in order of
    their time by a timer, whatever file or batch brought them.  A row behind the watermark is late: it is not folded, and
    counted in ``n_late``.  A closing row lets everything out at the end of a bounded replay.  Equal to the batch fold over all
    rows but the late ones; values of one entity at one time are folded in ascending order.
    """
    closing_row(spark, landing, "ts", "520 weeks")
    schema = spark.read.parquet(landing).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    s = s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    out_schema = f"{key} {schema[key].dataType.simpleString()}, n long, first_alarm_t long, n_alarms long, max_pos double, max_neg double"
    released = s.groupBy(key).transformWithStateInPandas(_OrderedCusum(key, k, h), out_schema, "Update", "EventTime")
    out = staging(spark, "ordered-cusum")
    before = {name: spark.conf.get(name, None) for name in _TIMED_STATE}
    for name, value in _TIMED_STATE.items():
        spark.conf.set(name, value)
    try:
        run_to_files(released, out, "update")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    r = latest(spark, out, [key], [key, "n", "first_alarm_t", "n_alarms", "max_pos", "max_neg"])
    arrived = spark.read.parquet(landing).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("arrived"))
    r = arrived.join(r, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return r.select(key, F.col("n").cast("long").alias("n"), (F.col("arrived") - F.col("n")).alias("n_late"), "first_alarm_t", "n_alarms",
                    F.round("max_pos", 6).alias("max_pos"), F.round("max_neg", 6).alias("max_neg"))


def closed_ratio(spark: SparkSession, landing: str, num_type: str = "purchase", late: str = "2 days") -> DataFrame:
    """R02 with windows that close: daily ratio of sums over events that land out of order, each day emitted once, when the watermark has passed it.

    A row of a day that is closed already is late: it changes nothing, and is counted in ``n_late`` of its day.  Days of which every row is
    late have no ratio.
    """
    closing_row(spark, landing, "ts", "520 weeks")
    schema = spark.read.parquet(landing).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    day = F.window("ts", "1 day").alias("w")
    agg = (s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(day)
           .agg(F.sum(F.when(F.col("event_type") == num_type, F.col("value")).otherwise(0.0)).alias("num"), F.sum("value").alias("den"), F.count("event_id").alias("n"))
           .select(F.to_date("w.start").alias("day"), "num", "den", "n"))
    out = staging(spark, "closed-ratio")
    run_to_files(agg, out, "append")
    closed = spark.read.parquet(os.path.join(out, "data"))
    arrived = spark.read.parquet(landing).where("event_id IS NOT NULL").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("arrived"))
    r = arrived.join(closed, "day", "left")
    return r.select("day", F.round(F.try_divide("num", "den"), 6).alias("ratio"), F.round("den", 4).alias("volume"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.col("arrived") - F.coalesce("n", F.lit(0))).alias("n_late"))
