"""Sources and sinks (inventory family S).

Everything reads into and writes from DataFrames; staging folders live under
the cluster's shared ``spark.checkpoint.dir`` (never a machine-local temp
folder).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from prudent.operators.relational import schema_table

_READERS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".txt": "text"}


def load_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Suffix-dispatched scan; CSV with a header row and inferred
    types.  An unknown suffix or a missing path is an error."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    fmt = fmt or _READERS.get(suffix)
    if fmt is None:
        raise ValueError(f"unsupported file type {suffix!r} for {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)  # a path without a scheme is on the default file system
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(path)
    r = spark.read
    if fmt == "csv":
        return r.csv(path, header=True, inferSchema=True)
    return getattr(r, fmt)(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Result sink (CSV with a header, or parquet / json)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        getattr(w, fmt)(path)
    return path


def read_query(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """Parametrised SQL (named parameter markers, no string splicing)."""
    return spark.sql(sql, args=args or {})


def describe_columns(df: DataFrame) -> DataFrame:
    """Column name, type, nullable, ordinal."""
    return schema_table(df)


def read_artifacts(spark: SparkSession, root: str, max_stage: int) -> DataFrame:
    """Stage artifacts named ``NN-agent.json`` under a run folder --
    either files ``<root>/<run>/NN-agent.json`` or the Spark-written layout
    ``<root>/run_id=<run>/artifact=NN-agent.json/part-*``.  Stage and agent
    come from the name; numeric prefix <= max_stage; unreadable files and
    objects without a payload are skipped."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root) \
        .select("value", F.col("_metadata.file_path").alias("path"))
    name = F.regexp_extract("path", r"(\d{2}-[^/=]+?\.json)(?:/[^/]*)?$", 1)
    run = F.coalesce(F.nullif(F.regexp_extract("path", r"run_id=([^/]+)", 1), F.lit("")),
                     F.regexp_extract("path", r"/([^/]+)/[^/]+\.json$", 1))
    d = raw.select(run.alias("run_id"), name.alias("file_name"),
                   F.regexp_extract(name, r"^(\d+)-", 1).alias("__stage"),
                   F.regexp_extract(name, r"^\d+-(.+?)(?:-replay)?\.json$", 1).alias("agent"),
                   F.try_parse_json("value").alias("artifact"))
    d = d.where((F.col("__stage") != "") & F.col("artifact").isNotNull()) \
        .withColumn("stage_index", F.col("__stage").cast("int")).drop("__stage")
    return d.where((F.col("stage_index") <= max_stage)
                   & F.try_variant_get("artifact", "$.payload", "string").isNotNull())


def write_stage_artifacts(df: DataFrame, root: str) -> str:
    """Land (run_id, artifact name, JSON text) rows as one artifact per run
    and name, written by Spark (works on any shared file system)."""
    df.select("run_id", "artifact", F.col("body").alias("value")).write.mode("overwrite") \
        .partitionBy("run_id", "artifact").text(root)
    return root


def pick_primary(artifacts: DataFrame) -> DataFrame:
    """Per run and stage, the primary artifact (first by name among
    those without 'replay'; replays only when nothing else exists)."""
    w = Window.partitionBy("run_id", "stage_index").orderBy(F.col("file_name").contains("replay"), "file_name")
    return artifacts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines event log; malformed lines are dropped, not fatal."""
    raw = spark.read.text(path)
    j = F.try_parse_json("value")
    return raw.select(j.alias("e")).where(F.col("e").isNotNull())


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per span."""
    return spark.read.schema("span_id string, parent_span_id string, name string, started_at timestamp, "
                             "ended_at timestamp, duration_ms double, error string").json(path)


def write_artifacts(df: DataFrame, root: str, partition: str = "run_id") -> str:
    """JSON artifacts / lineage manifest partitioned by run."""
    df.write.mode("overwrite").partitionBy(partition).json(root)
    return root


def capped(df: DataFrame, cap: int = 1_000_000, order: list | None = None):
    """Add a row cap when the query has none; warn when the result
    reaches it.  The count is observed on the same pass (Observation)."""
    obs = Observation("cap")
    d = (df.orderBy(*order) if order else df).limit(cap).observe(obs, F.count(F.lit(1)).alias("n"))
    return d, obs


def register_views(spark: SparkSession, views: dict[str, DataFrame]) -> None:
    """Named views; Catalyst inlines them into every query that uses them."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
