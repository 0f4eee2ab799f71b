"""Profiling and data quality (inventory family Q) plus free-text
sanitising (F10, F11).

Profiles are one wide aggregate per table (one scan), reshaped with
``unpivot``; exact distinct counts are the default and an HLL sketch
(``approx=True``) is the scale variant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prudent.functions import scalar as S
from prudent.session import cut_lineage
from prudent.operators.relational import canonical_dtype

_FLOATS = (T.DoubleType, T.FloatType)


def _is_string(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.StringType)


def profile(df: DataFrame, approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """Q01: per column logical type, nulls (NaN counts as null) and distinct
    non-null values.  One aggregate, then an unpivot to one row per column."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        v = F.nanvl(c, F.lit(None)) if isinstance(f.dataType, _FLOATS) else c
        aggs.append(F.count_if(v.isNull()).alias(f"n__{f.name}"))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            aggs.append(F.lit(None).cast("bigint").alias(f"d__{f.name}"))
        else:
            aggs.append((F.approx_count_distinct(v, rsd) if approx else F.count_distinct(v)).alias(f"d__{f.name}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
                     F.lit(canonical_dtype(f.dataType.simpleString())).alias("dtype"),
                     F.col(f"`n__{f.name}`").alias("null_count"),
                     F.col(f"`d__{f.name}`").alias("distinct_count"))
            for i, f in enumerate(df.schema.fields)]
    return wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def profile_sample(df: DataFrame, n: int = 500, seed: int = 42, samples: int = 10) -> DataFrame:
    """Q02: profile of a seeded sample: null rate (4 dp), distinct, <= 10
    sample values as text."""
    s = df.orderBy(F.rand(seed)).limit(n)
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`").cast("string")
        aggs += [F.round(F.avg(c.isNull().cast("double")), 4).alias(f"r__{f.name}"),
                 F.count_distinct(c).alias(f"d__{f.name}"),
                 F.slice(F.array_sort(F.collect_set(c)), 1, samples).alias(f"s__{f.name}")]
    wide = s.agg(*aggs)
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.col(f"`r__{f.name}`").alias("null_rate"),
                     F.col(f"`d__{f.name}`").alias("distinct_count"), F.col(f"`s__{f.name}`").alias("samples"))
            for f in df.schema.fields]
    return wide.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def completeness(df: DataFrame, col: str, by: str) -> DataFrame:
    """Q03: null share per group vs the overall share, ranked by excess."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col(col).isNull()).alias("n_null"))
    overall = df.select(F.avg(F.col(col).isNull().cast("double"))).scalar()
    g = g.withColumn("null_share", F.round(S.safe_div("n_null", "n"), 6)) \
        .withColumn("overall_share", F.round(overall, 6)) \
        .withColumn("excess", F.round(F.col("null_share") - F.col("overall_share"), 6))
    return g


def freshness(df: DataFrame, ts: str, by: list[str], as_of=None) -> DataFrame:
    """Q04: latest record, cadence (median gap between distinct dates) and
    days stale vs ``as_of`` (default: the latest date in the data)."""
    d = df.select(*by, F.to_date(ts).alias("__d")).distinct()
    w = Window.partitionBy(*by).orderBy("__d")
    gaps = d.withColumn("__gap", F.datediff("__d", F.lag("__d").over(w)))
    g = gaps.groupBy(*by).agg(F.max("__d").alias("latest"),
                              F.percentile(F.col("__gap"), F.lit(0.5)).alias("cadence_days"))
    ref = F.lit(as_of).cast("date") if as_of is not None else df.select(F.max(F.to_date(ts))).scalar()
    g = g.withColumn("days_stale", F.datediff(ref, "latest"))
    return g.withColumn("is_stale", F.col("days_stale") > 2 * F.col("cadence_days"))


def grain_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q05: duplicate rows at the declared grain."""
    per = df.groupBy(*keys).count()
    return per.agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_keys"),
                   (F.sum("count") - F.count("*")).alias("n_duplicates"),
                   F.count_if(F.col("count") > 1).alias("n_dup_keys"))


def _long(df: DataFrame, metrics: list[str], by: list[str] = ()) -> DataFrame:
    """Stack metric columns into (by..., metric, x) with NaN as NULL."""
    return df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"),
                                                       F.nanvl(F.col(m).cast("double"), F.lit(None)).alias("x"))
                                              for m in metrics])).alias("__s")) \
        .select(*by, "__s.metric", "__s.x")


def distribution(df: DataFrame, metrics: list[str], by: list[str] = (), approx: bool = False) -> DataFrame:
    """Q06: n, mean, median, sd, IQR, MAD, p5/25/75/95, population skewness
    and excess kurtosis per metric; MAD from the weighted deviations of the distinct values.
    Exact quantiles use value-range buckets (no group is held in one buffer);
    ``approx=True`` uses sketches (``percentile_approx``)."""
    from prudent.operators.relational import exact_quantiles, weighted_values, with_group
    by = list(by)
    long = _long(df, metrics, by).where(F.col("x").isNotNull())
    qs = [0.05, 0.25, 0.5, 0.75, 0.95]
    qn = ["p5", "p25", "median", "p75", "p95"]
    keys = by + ["metric"]
    st = long.groupBy(*keys).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
        F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis"))
    if approx:
        q = long.groupBy(*keys).agg(F.percentile_approx("x", qs, 10000).alias("__q")) \
            .select(*keys, *[F.col("__q")[i].alias(nm) for i, nm in enumerate(qn)])
    else:
        values = weighted_values(long, keys, "x")
        q = cut_lineage(exact_quantiles(long, keys, "x", qs, names=qn, weighted=values))
    st = st.join(q, keys)
    if approx:
        dev = long.join(st.select(*keys, "median"), keys).select(*keys, F.abs(F.col("x") - F.col("median")).alias("d"))
        mad = dev.groupBy(*keys).agg(F.percentile_approx("d", 0.5, 10000).alias("mad"))
    else:
        # deviations of the distinct values keep their weights: no second pass over the rows
        dev = with_group(values, q.select(*keys, "median"), keys).select(*keys, F.abs(F.col("__v") - F.col("median")).alias("d"), "__w")
        mad = exact_quantiles(dev, keys, "d", [0.5], names=["mad"], weighted=weighted_values(dev, keys, "d", "__w"))
    return st.join(mad, keys).withColumn("iqr", F.col("p75") - F.col("p25"))


def shape(dist: DataFrame) -> DataFrame:
    """Q07: shape class and the resistant-statistics flag from Q06 output.

    normal: |skew| < 0.5 and |excess kurtosis| < 1; bimodal: Sarle's
    bimodality coefficient > 0.555; long_tail: |skew| >= 0.5 with excess
    kurtosis >= 3; otherwise right / left skewed by the sign of skew."""
    n = F.col("n").cast("double")
    g1, g2 = F.col("skewness"), F.col("kurtosis")
    bc = S.safe_div(g1 * g1 + 1, g2 + S.safe_div(3 * (n - 1) * (n - 1), (n - 2) * (n - 3)))
    cls = (F.when(n < 4, "other")
           .when(bc > 0.555, "bimodal")
           .when((F.abs(g1) < 0.5) & (F.abs(g2) < 1), "normal")
           .when((F.abs(g1) >= 0.5) & (g2 >= 3), "long_tail")
           .when(g1 >= 0.5, "right_skewed").when(g1 <= -0.5, "left_skewed").otherwise("other"))
    return dist.withColumn("bimodality", F.round(bc, 6)).withColumn("shape", cls) \
        .withColumn("use_resistant_statistics", F.col("shape") != "normal")


def outliers(df: DataFrame, id_col: str, metric: str, method: str = "auto", dist: DataFrame | None = None,
             top: int = 50) -> DataFrame:
    """Q08: |z| > 3 for normal metrics; modified z = 0.6745 (x - median) / MAD
    with |.| > 3.5 otherwise; MAD = 0 flags nothing.  The statistics are one
    row joined back (a scalar per metric); the id list is capped at ``top``
    per metric (the reference returns small id lists; counts are complete)."""
    d = dist if dist is not None else shape(distribution(df, [metric]))
    row = cut_lineage(d.where(F.col("metric") == metric).select("mean", "sd", "median", "mad", "shape"))  # read five times below
    x = F.col(metric).cast("double")
    mean, sd, med, mad, shp = [row.select(c).scalar() for c in ("mean", "sd", "median", "mad", "shape")]
    use_z = (shp == "normal") if method == "auto" else F.lit(method == "z")
    z = S.safe_div(x - mean, sd)
    mz = S.safe_div(F.lit(0.6745) * (x - med), mad)
    score = F.when(use_z, z).otherwise(mz)
    flag = F.when(use_z, F.abs(z) > 3).otherwise((mad > 0) & (F.abs(mz) > 3.5))
    s = df.select(F.col(id_col), x.alias("value"), F.round(score, 6).alias("score"), flag.alias("is_outlier"),
                  F.when(use_z, "z").otherwise("modified_z").alias("method"))
    return s.where("is_outlier")


def tail_flag(df: DataFrame, metric: str, q: float = 0.995) -> Column:
    """Q09: above the q-quantile (a scalar subquery)."""
    from prudent.operators.relational import exact_quantiles
    cut = exact_quantiles(df.select(F.col(metric).cast("double").alias(metric)), [], metric, [q],
                          names=["__cut"]).select("__cut").scalar()
    return F.col(metric) > cut


def trimmed_mean(df: DataFrame, metric: str, by: list[str], trim: float = 0.1) -> DataFrame:
    """Q11: mean of values between the trim and 1 - trim quantiles."""
    from prudent.operators.relational import exact_quantiles, with_group
    q = exact_quantiles(df.withColumn(metric, F.col(metric).cast("double")), by, metric, [trim, 1 - trim],
                        names=["__lo", "__hi"])
    q = cut_lineage(q)
    j = with_group(df, q, by) if by else df.withColumn("__lo", q.select("__lo").scalar()) \
        .withColumn("__hi", q.select("__hi").scalar())
    inside = (F.col(metric) >= F.col("__lo")) & (F.col(metric) <= F.col("__hi"))
    return j.groupBy(*by).agg(F.avg(F.when(inside, F.col(metric))).alias("trimmed_mean"),
                              F.count_if(inside).alias("n_kept"), F.count("*").alias("n"))


def rare_levels(df: DataFrame, col: str, min_share: float = 0.01) -> DataFrame:
    """Q11: category levels whose frequency share is below ``min_share``."""
    g = df.groupBy(col).agg(F.count("*").alias("n"))
    tot = df.select(F.count("*")).scalar()
    return g.withColumn("share", F.round(S.safe_div("n", tot), 6)).withColumn("is_rare", F.col("share") < min_share)


def check(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Q12: violations per invariant (rules are SQL predicates that must hold;
    NULL counts as a violation)."""
    aggs = [F.count_if(~F.coalesce(F.expr(r), F.lit(False))).alias(f"v{i}") for i, r in enumerate(rules.values())]
    wide = df.agg(*aggs, F.count("*").alias("__n"))
    rows = [F.struct(F.lit(name).alias("rule"), F.col(f"v{i}").alias("n_violations"), F.col("__n").alias("n_rows"))
            for i, name in enumerate(rules)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sentinels(df: DataFrame, cols: list[str], candidates=(-9999, 9999, -999, 999999)) -> DataFrame:
    """Q13: share of placeholder values per numeric column."""
    aggs = [F.count_if(F.col(c).isin(*candidates)).alias(f"s{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs, F.count("*").alias("__n"))
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("n_sentinel"),
                     F.round(S.safe_div(F.col(f"s{i}"), F.col("__n")), 6).alias("share")) for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def readiness(null_rate: Column, dup_share: Column, days_stale: Column, cadence: Column,
              caveat_null: float = 0.05, max_null: float = 0.5, max_dup: float = 0.01) -> Column:
    """Q14: READY / READY_WITH_CAVEATS / INSUFFICIENT.  The thresholds are
    ours (the reference gives none): more than half missing or duplicated
    grain above 1% is insufficient; any missingness above 5% or staleness
    beyond two cadences is a caveat."""
    return (F.when((null_rate > max_null) | (dup_share > max_dup), "INSUFFICIENT")
            .when((null_rate > caveat_null) | (days_stale > 2 * cadence), "READY_WITH_CAVEATS")
            .otherwise("READY"))


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q16: columns added / removed / retyped between two snapshots."""
    from prudent.operators.relational import schema_table
    sa = schema_table(a).select("column_name", F.col("data_type").alias("type_a"))
    sb = schema_table(b).select("column_name", F.col("data_type").alias("type_b"))
    j = sa.join(sb, "column_name", "full")
    return j.withColumn("change", F.when(F.col("type_a").isNull(), "added").when(F.col("type_b").isNull(), "removed")
                        .when(F.col("type_a") != F.col("type_b"), "retyped").otherwise("same"))


# -- F10 / F11: free-text detection and sanitising --------------------------
def free_text_columns(df: DataFrame, min_len: int = 40, min_share: float = 0.10) -> DataFrame:
    """string columns where >= 10% of non-null values exceed 40 chars
    (an all-null column is not free text).  One aggregate for all columns."""
    cols = [f.name for f in df.schema.fields if _is_string(f)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, long_share double, is_free_text boolean")
    wide = df.agg(*[S.long_share(F.col(f"`{c}`"), min_len).alias(f"s{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.round(F.col(f"s{i}"), 6).alias("long_share"),
                     F.coalesce(F.col(f"s{i}") >= min_share, F.lit(False)).alias("is_free_text"))
            for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sanitize(df: DataFrame, min_len: int = 40, min_share: float = 0.10):
    """sanitise every free-text column; return (clean_df, counts_df).

    Detection is one aggregate; the rewrite is a projection of native
    regexp_replace calls; counts of changed cells come from one more
    aggregate over the same expressions (no Python per row)."""
    ft = [r["column_name"] for r in free_text_columns(df, min_len, min_share).where("is_free_text").collect()]
    clean = df.select(*[S.redact(F.col(f"`{c}`")).alias(c) if c in ft else F.col(f"`{c}`") for c in df.columns])
    if ft:
        counts = df.agg(*[F.count_if(S.redact_changed(F.col(f"`{c}`"))).alias(c) for c in ft])
        counts = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                            F.col(f"`{c}`").alias("n_changed")) for c in ft]))
                               .alias("r")).select("r.*")
    else:
        counts = df.sparkSession.createDataFrame([], "column_name string, n_changed bigint")
    return clean, counts
