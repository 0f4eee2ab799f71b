"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prudent.session import checkpoint_dir

#: ids up to which a lookup of 64-bit ids is broadcast (16 bytes each in Spark's hash relation)
BROADCAST_IDS = 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder that ``spark.checkpoint.dir`` names."""
    return os.path.join(checkpoint_dir(spark), "prudent-llm", f"{label}-{uuid.uuid4().hex}")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage as a reliable checkpoint does (a lost executor repeats nothing before it), and
    later reads take only the columns they need.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_ids(df: DataFrame, ids: DataFrame, df_id: str, id_col: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose id is in ``ids`` (distinct, not null; ``how="left_anti"``: is not).

    The ids are broadcast only below a checked count; beyond it the join shuffles both sides.  They meet
    ``df`` under a name that none of its columns has.
    """
    free = free_name(df, "id")
    ids = ids.select(F.col(id_col).alias(free))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, F.col(f"`{df_id}`") == F.col(free), how)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with marks before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fraction_of(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) hashed from the columns: the same for equal values, whatever the partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))
