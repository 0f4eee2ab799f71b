"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudent.session import cut_lineage


def _distinct_edges(df: DataFrame) -> DataFrame:
    return df.where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _distinct_edges(sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return _distinct_edges(down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                           .unionByName(low.select("u", F.col("m").alias("v"))))


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """``(node, component)`` for every end of an edge; ``component`` is the smallest node reachable.

    Alternates large-star and small-star until the edges are one star per component (a logarithmic
    number of rounds; there is no cap).  A round is two aggregates and two joins over a table no
    longer than the edges; each round is checkpointed, so plans stay short and a lost executor
    costs one round.  Edges with a null end are left out; an empty table gives an empty result.
    """
    cur = cut_lineage(_distinct_edges(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")))

    def mark(df):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    seen = mark(cur)
    nodes = cur.select(F.col("u").alias("node")).unionByName(cur.select(F.col("v").alias("node")))
    while seen["n"]:
        cur = cut_lineage(_small_star(_large_star(cur)))
        now = mark(cur)
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
            if seen["n"] else nodes.select("node", F.col("node").alias("component")))
