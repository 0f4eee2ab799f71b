"""Relational operators: scope filters (P), joins (J), aggregates (A),
windows (W), top-k / sampling (T) and set operations (U).

Scale rules applied throughout:
* a dimension is broadcast only when its size is bounded by construction
  (``bounded=True``); anything else is left to the optimizer's size check
  (``spark.sql.autoBroadcastJoinThreshold``) and AQE's runtime switch;
* facts are aggregated to the target grain before they meet another fact;
* no window without a partition key runs over raw rows; grand totals come
  from scalar subqueries, not from a single-partition window;
* ranks and cumulative counts run over value-range buckets (see
  ``bucketed_cumcount``) so no group, however hot, lands in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prudent.functions.scalar import safe_div
from prudent.session import cut_lineage


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _list(x):
    if x is None:
        return []
    return list(x) if isinstance(x, (list, tuple)) else [x]


# ---------------------------------------------------------------------------
# P: projections, filters, predicates
# ---------------------------------------------------------------------------
def scope(df: DataFrame, date_col: str | None = None, date_from=None,
          key_col: str | None = None, sentinels=(9999,)) -> DataFrame:
    """Date >= cutoff and key not a sentinel (both pushed to the scan)."""
    if date_col is not None and date_from is not None:
        df = df.where(F.col(date_col) >= F.lit(date_from).cast("timestamp_ntz"))
    if key_col is not None and sentinels:
        df = df.where(~F.col(key_col).isin(*sentinels))
    return df


def apply_scope(df: DataFrame, rules: list[str]) -> DataFrame:
    """Mandatory business rules, SQL text AND-ed together."""
    for r in rules:
        df = df.where(F.expr(r))
    return df


apply_filters = apply_scope


def classify(cases: list[tuple], default=None) -> Column:
    """Ordered CASE; first matching condition wins."""
    out = None
    for cond, label in cases:
        cond = F.expr(cond) if isinstance(cond, str) else cond
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def coalesce_cols(*cols) -> Column:
    """First non-null of several sources."""
    return F.coalesce(*[_c(c) for c in cols])


def select_columns(df: DataFrame, keep: list[str], comments: dict[str, str] | None = None) -> DataFrame:
    """Column subset with user descriptions stored as column metadata."""
    comments = comments or {}
    return df.select(*[F.col(c).alias(c, metadata={"comment": comments[c]}) if c in comments
                       else F.col(c) for c in keep])


def parse_derived_metrics(text: str) -> list[tuple[str, str, str]]:
    """Lines ``NAME = EXPR | note``; blank, '#' and '='-less lines skipped;
    the first '=' splits name from expression."""
    out = []
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        name, rest = line.split("=", 1)
        expr, _, note = rest.partition("|")
        name, expr = name.strip(), expr.strip()
        if name and expr:
            out.append((name, expr, note.strip()))
    return out


def derived_metrics(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """Evaluate user metric expressions (aggregate expressions when ``by``)."""
    defs = parse_derived_metrics(text)
    cols = [F.expr(e).alias(n) for n, e, _ in defs]
    if by is None:
        return df.select(*cols)
    return df.groupBy(*by).agg(*cols)


def activity_flag(df: DataFrame, cols: list[str]) -> Column:
    """P10: any present column > 0 (null as 0); absent columns are ignored."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > 0 for c in present])


# P11 -- logical types
_CANON = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean",
          "datetime": "timestamp", "category": "string"}


def canonical_dtype(spark_type: str) -> str:
    """Fold a Spark / pandas type spelling into one of six logical types."""
    t = spark_type.lower().strip()
    if t in _CANON:
        return t
    if t in ("category", "categorical"):
        return "category"
    if t.startswith(("bool",)):
        return "boolean"
    if t.startswith(("tinyint", "smallint", "int", "bigint", "long", "short", "byte", "uint", "i8", "i4", "i2", "i1")):
        return "integer"
    if t.startswith(("float", "double", "decimal", "real", "f4", "f8")):
        return "float"
    if t.startswith(("timestamp", "date", "datetime", "m8", "<m8", ">m8")):
        return "datetime"
    return "string"


def schema_table(df: DataFrame) -> DataFrame:
    """One row per column: ordinal, name, Spark type, logical type, nullable."""
    spark = df.sparkSession
    rows = [(i + 1, f.name, f.dataType.simpleString(), canonical_dtype(f.dataType.simpleString()), f.nullable)
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "ordinal int, column_name string, data_type string, "
                                       "logical_type string, nullable boolean")


def cast_schema(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast named columns to logical types; failures become NULL."""
    return df.select(*[F.col(c).try_cast(_CANON.get(types[c], types[c])).alias(c) if c in types
                       else F.col(c) for c in df.columns])


def context_warnings(df: DataFrame, groups: dict[str, list[list[str]]]) -> DataFrame:
    """Each named group lists alternatives (any alias, case-insensitive)
    for several required roles; a warning row per group with a missing role."""
    have = {c.upper() for c in df.columns}
    rows = []
    for code, roles in groups.items():
        missing = [r[0] for r in roles if not any(a.upper() in have for a in r)]
        if missing:
            rows.append((code, ",".join(missing)))
    return df.sparkSession.createDataFrame(rows, "code string, missing string")


def missing_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Columns named in the brief but absent from the data."""
    have = {c.lower() for c in df.columns}
    rows = [(w,) for w in wanted if w.lower() not in have]
    return df.sparkSession.createDataFrame(rows, "column_name string")


# ---------------------------------------------------------------------------
# J: joins
# ---------------------------------------------------------------------------
def join_dim(fact: DataFrame, dim: DataFrame, on, how: str = "inner", bounded: bool = False) -> DataFrame:
    """Fact to a unique-key dimension.  ``bounded`` marks a dimension whose
    row count is fixed by construction (nation, region, calendar); only then is
    it hinted for broadcast.  Others go through Catalyst's size check and AQE."""
    return fact.join(F.broadcast(dim) if bounded else dim, on, how)


def keep_known(fact: DataFrame, dim: DataFrame, on) -> DataFrame:
    """Semi join, never fans out."""
    return fact.join(dim, on, "left_semi")


def unmatched(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Anti join."""
    return left.join(right, on, "left_anti")


def attach_activity(base: DataFrame, act: DataFrame, on: list[str], value_cols: list[str],
                    flag: str = "has_activity") -> DataFrame:
    """Left join, zero default for measures, presence flag."""
    a = act.select(*on, *value_cols, F.lit(1).alias("__hit"))
    out = base.join(a, on, "left")
    return out.select(*[F.col(c) for c in base.columns if c not in value_cols],
                      *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in value_cols],
                      F.col("__hit").isNotNull().cast("int").alias(flag))


def join_current(fact: DataFrame, dim: DataFrame, on, dim_filters: list[str], how="inner") -> DataFrame:
    """Dimension predicates applied before the join (pushed to its scan)."""
    return fact.join(apply_scope(dim, dim_filters), on, how)


def align_facts(facts: dict[str, tuple[DataFrame, list[Column]]], keys: list[str],
                how: str = "full") -> DataFrame:
    """Aggregate every fact to the target grain, then join on the grain
    keys.  Each join input is unique on ``keys``, so nothing fans out."""
    parts = [df.groupBy(*keys).agg(*aggs) for df, aggs in facts.values()]
    return reduce(lambda a, b: a.join(b, keys, how), parts)


def calendar(spark, start: str, end: str, step: str = "1 day") -> DataFrame:
    """One row per day (or week) from a generated sequence."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)),
                                                      F.expr(f"interval {step}"))).alias("cal_date"))


def calendar_from(df: DataFrame, ts_col: str) -> DataFrame:
    """Calendar spanning the data, with ISO week and fiscal-like fields."""
    bounds = df.select(F.min(F.to_date(ts_col)).alias("lo"), F.max(F.to_date(ts_col)).alias("hi"))
    cal = bounds.select(F.explode(F.sequence("lo", "hi")).alias("cal_date"))
    return cal.select("cal_date",
                      (F.year("cal_date") * 10000 + F.month("cal_date") * 100 + F.dayofmonth("cal_date"))
                      .alias("date_sid"),
                      F.year(F.date_add("cal_date", 3 - ((F.dayofweek("cal_date") + 5) % 7))).alias("iso_year"),
                      F.weekofyear("cal_date").alias("iso_week"))


def range_join(points: DataFrame, spans: DataFrame, key: str, ts: str, start: str, end: str,
               bin_seconds: int = 86400) -> DataFrame:
    """Point-in-interval join without a nested loop.

    Spans are exploded into the fixed time bins they touch and points carry
    their own bin, so the join is an equi-join on (key, bin) followed by the
    exact ``start <= ts < end`` predicate.  Work is proportional to the
    number of (span, bin) pairs, not to points x spans.
    """
    b = F.lit(bin_seconds)
    sp = spans.withColumn("__bin", F.explode(F.sequence(
        F.floor(F.unix_timestamp(F.col(start).cast("timestamp")) / b),
        F.floor(F.unix_timestamp(F.col(end).cast("timestamp")) / b))))
    pt = points.withColumn("__bin", F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / b))
    j = pt.join(sp, [key, "__bin"], "inner")
    return j.where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("__bin")


def relationship_check(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Cardinality of a declared relationship from max rows per key on
    each side -> many_to_one / one_to_many / one_to_one / many_to_many, and
    whether the right side really is unique."""
    lmax = left.groupBy(*cols).count().agg(F.max("count").alias("left_max_per_key"))
    rmax = right.groupBy(*cols).count().agg(F.max("count").alias("right_max_per_key"))
    lm, rm = lmax.scalar(), rmax.scalar()
    kind = (F.when((lm <= 1) & (rm <= 1), "one_to_one").when(rm <= 1, "many_to_one")
            .when(lm <= 1, "one_to_many").otherwise("many_to_many"))
    return left.sparkSession.range(1).select(lm.alias("left_max_per_key"), rm.alias("right_max_per_key"),
                                             kind.alias("kind"), (rm <= 1).alias("right_unique"))


def join_coverage(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct left keys matched in right / distinct left keys, in %."""
    lk = left.select(*on).where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])).distinct()
    m = lk.join(right.select(*on).distinct(), on, "left_semi")
    total, matched = lk.select(F.count("*")).scalar(), m.select(F.count("*")).scalar()
    return left.sparkSession.range(1).select(
        matched.alias("matched"), total.alias("total"),
        F.round(safe_div(matched * F.lit(100.0), total), 2).alias("coverage_pct"))


def overlap_pairs(findings: DataFrame, entity: str = "entity", start: str = "window_start",
                  end: str = "window_end", run: str = "run_id", fid: str = "finding_id",
                  bin_days: int = 7) -> DataFrame:
    """Findings on the same entity whose windows overlap, from different
    runs, each unordered pair once (a.run < b.run).

    Two windows overlap when the later start lies in the earlier window, so
    only the earlier one is exploded into bins and the later one joins with
    the bin of its start: every overlapping pair meets exactly once."""
    cols = {"id": fid, "run": run, "start": start, "end": end}

    def side(p):
        return findings.select(F.col(entity).alias("entity" if p == "x" else "__entity"),
                               *[F.col(c).alias(f"{p}_{n}") for n, c in cols.items()])

    def bin_of(c):
        return F.floor(F.unix_date(F.to_date(c)) / bin_days).cast("bigint")

    x = side("x").withColumn("__bin", F.explode(F.sequence(bin_of("x_start"), bin_of("x_end"))))
    y = side("y").withColumn("__start_bin", bin_of("y_start"))
    j = x.join(y, (F.col("entity") == F.col("__entity")) & (F.col("__bin") == F.col("__start_bin"))
               & (F.col("x_run") != F.col("y_run")) & (F.col("y_start") <= F.col("x_end"))
               & ((F.col("x_start") < F.col("y_start"))
                  | ((F.col("x_start") == F.col("y_start")) & (F.col("x_run") < F.col("y_run")))))
    first = F.col("x_run") < F.col("y_run")
    return j.select("entity", *[F.when(first, F.col(f"{u}_{n}")).otherwise(F.col(f"{v}_{n}")).alias(f"{p}_{n}")
                                for p, u, v in (("a", "x", "y"), ("b", "y", "x")) for n in cols])


def non_connections(findings: DataFrame, pairs: DataFrame, fid: str = "finding_id") -> DataFrame:
    """Findings that have no overlapping partner in another run."""
    ids = pairs.select(F.col("a_id").alias(fid)).unionByName(pairs.select(F.col("b_id").alias(fid)))
    return findings.join(ids, fid, "left_anti")


def peers(df: DataFrame, entity: str, group: str, sums: list[str], counts: str | None = None) -> DataFrame:
    """Peer aggregates that exclude the focal entity, computed as
    group total minus own total (no self-join, no pairs)."""
    own = df.groupBy(group, entity).agg(*[F.sum(s).alias(s) for s in sums], F.count("*").alias("__n"))
    tot = own.groupBy(group).agg(*[F.sum(s).alias(f"__t_{s}") for s in sums],
                                 F.sum("__n").alias("__tn"), F.count("*").alias("__te"))
    j = own.join(tot, group)
    return j.select(group, entity, *[F.col(s).alias(f"own_{s}") for s in sums],
                    *[(F.col(f"__t_{s}") - F.col(s)).alias(f"peer_{s}") for s in sums],
                    (F.col("__te") - 1).alias("n_peers"))


def vs_prior(df: DataFrame, keys: list[str], period: str, value_cols: list[str],
             offset_days: int = 7, suffix: str = "_prior") -> DataFrame:
    """Equi-join on the period shifted by a calendar offset (a missing
    prior period stays NULL rather than silently taking an older one)."""
    prior = df.select(*keys, F.date_add(F.col(period), offset_days).alias(period),
                      *[F.col(v).alias(v + suffix) for v in value_cols])
    return df.join(prior, keys + [period], "left")


# ---------------------------------------------------------------------------
# A: aggregations
# ---------------------------------------------------------------------------
def ratio(num, den) -> Column:
    """Ratio of sums, NULL on a zero denominator; never a mean of rates."""
    return safe_div(F.sum(_c(num)), F.sum(_c(den)))


def share_where(flag, base) -> Column:
    """Rows with the flag / rows with the base event (may exceed 1)."""
    return safe_div(F.sum(F.when(_c(flag), 1).otherwise(0)), F.sum(F.when(_c(base), 1).otherwise(0)))


def scoped_mean(value, scope_cond) -> Column:
    """A10: sum over scope / rows in scope (nulls count in the denominator)."""
    return safe_div(F.sum(F.when(_c(scope_cond), _c(value))), F.sum(F.when(_c(scope_cond), 1).otherwise(0)))


def scoped_avg(value, scope_cond) -> Column:
    """AVG inside the scope (nulls ignored)."""
    return F.avg(F.when(_c(scope_cond), _c(value)))


def dedup_minmax(df: DataFrame, key: list[str], mins: list[str] = (), maxs: list[str] = ()) -> DataFrame:
    """Independent MIN / MAX per column (as the reference views do)."""
    return df.groupBy(*key).agg(*[F.min(c).alias(c) for c in mins], *[F.max(c).alias(c) for c in maxs])


def dedup_maxby(df: DataFrame, key: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """A08 (row-consistent): every column from the same best row via max_by."""
    o = F.struct(*order)
    return df.groupBy(*key).agg(*[F.max_by(c, o).alias(c) for c in cols])


def to_grain(df: DataFrame, keys: list[str], ts: str, grain: str, sums: list[str],
             flags: list[str] = ()) -> DataFrame:
    """Finest rows -> entity x week (or day); additive parts summed,
    activity flags by MAX."""
    period = F.to_date(F.date_trunc("WEEK" if grain == "week" else "DAY", F.col(ts))).alias("period")
    return (df.groupBy(*keys, period)
            .agg(*[F.sum(s).alias(s) for s in sums], *[F.max(f).alias(f) for f in flags]))


def coverage_stats(df: DataFrame, key: str, active: Column) -> DataFrame:
    """Per entity MAX(active) (null keys dropped) -> active, total, ratio."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(active.cast("int")).alias("a"))
    return per.agg(F.sum("a").cast("bigint").alias("active"), F.count("*").alias("total"),
                   F.coalesce(F.round(safe_div(F.sum("a"), F.count("*")), 6), F.lit(0.0)).alias("ratio"))


def grid_coverage(df: DataFrame, keys: list[str]) -> DataFrame:
    """Product of distinct key counts vs observed distinct combinations."""
    aggs = [F.count_distinct(k).alias(f"n_{k}") for k in keys]
    combos = df.select(*keys).distinct().select(F.count("*")).scalar()
    out = df.agg(*aggs)
    expected = reduce(lambda a, b: a * b, [F.col(f"n_{k}") for k in keys])
    return out.select("*", expected.alias("expected"), combos.alias("observed"),
                      F.round(safe_div(combos, expected), 6).alias("completeness"))


def multi_grain(df: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    """Several aggregation levels in one scan via GROUPING SETS."""
    dims = sorted({d for s in sets for d in s})
    return (df.groupingSets([[F.col(d) for d in s] for s in sets], *dims)
            .agg(*aggs, F.grouping_id().alias("level")))


def grain_warning(df: DataFrame, min_rows: int = 200) -> DataFrame:
    """Result too aggregated for an analytical question."""
    n = df.select(F.count("*")).scalar()
    return df.sparkSession.range(1).select(n.alias("n_rows"), (n < min_rows).alias("over_aggregated"))


# ---------------------------------------------------------------------------
# W: windows
# ---------------------------------------------------------------------------
def best_row(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per key under an explicit total order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def pct_of_total(df: DataFrame, value: str, within: list[str] | None = None, out: str = "pct") -> DataFrame:
    """Share of a total.  Within groups: a partitioned window.  Of the
    grand total: a scalar subquery (no single-partition window)."""
    if within:
        tot = F.sum(value).over(Window.partitionBy(*within))
    else:
        tot = df.select(F.sum(value)).scalar()
    return df.withColumn(out, F.round(safe_div(F.col(value) * F.lit(100.0), tot), 4))


def trailing(df: DataFrame, key: list[str], order: str, value: str, n: int, stat: str = "mean",
             out: str | None = None) -> DataFrame:
    """Trailing-n baseline excluding the current row (mean or median)."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-n, -1)
    agg = F.avg(value) if stat == "mean" else F.percentile(F.col(value), F.lit(0.5))
    return df.withColumn(out or f"trail{n}_{stat}", agg.over(w))


def period_change(df: DataFrame, key: list[str], period: str, value: str, k: int) -> DataFrame:
    """Last-k vs previous-k periods (sums and relative change)."""
    w = Window.partitionBy(*key).orderBy(F.col(period).desc())
    r = df.withColumn("__r", F.dense_rank().over(w))
    g = r.where(F.col("__r") <= 2 * k).groupBy(*key).agg(
        F.sum(F.when(F.col("__r") <= k, F.col(value))).alias("last_k"),
        F.sum(F.when(F.col("__r") > k, F.col(value))).alias("prev_k"))
    return g.withColumn("rel_change", F.round(safe_div(F.col("last_k") - F.col("prev_k"), F.abs("prev_k")), 6))


def hampel(df: DataFrame, key: list[str], order: str, value: str, k: int = 3, t: float = 3.0) -> DataFrame:
    """Rolling median and MAD over a centred window of 2k+1 rows; flag
    |x - med| > t * 1.4826 * MAD.  The window is bounded, so the collected
    array never grows with the data."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-k, k)
    arr = F.array_sort(F.collect_list(value).over(w))
    med = F.expr("(element_at(__a, cast(floor((size(__a) + 1) / 2.0) as int)) + "
                 "element_at(__a, cast(floor(size(__a) / 2.0) + 1 as int))) / 2.0")
    d = df.withColumn("__a", arr).withColumn("__m", med)
    d = d.withColumn("__dev", F.array_sort(F.transform("__a", lambda x: F.abs(x - F.col("__m")))))
    mad = F.expr("(element_at(__dev, cast(floor((size(__dev) + 1) / 2.0) as int)) + "
                 "element_at(__dev, cast(floor(size(__dev) / 2.0) + 1 as int))) / 2.0")
    d = d.withColumn("roll_median", F.col("__m")).withColumn("roll_mad", mad)
    d = d.withColumn("is_outlier", (F.col("roll_mad") > 0) &
                     (F.abs(F.col(value) - F.col("roll_median")) > F.lit(t * 1.4826) * F.col("roll_mad")))
    return d.drop("__a", "__m", "__dev")


def diff_z(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Z-score of the first difference within each series."""
    w = Window.partitionBy(*key).orderBy(order)
    d = df.withColumn("diff", F.col(value) - F.lag(value).over(w))
    wk = Window.partitionBy(*key)
    return d.withColumn("diff_z", safe_div(F.col("diff") - F.avg("diff").over(wk), F.stddev_samp("diff").over(wk)))


def peer_rank(df: DataFrame, group: list[str], metric: str, tiebreak: list[str] = ()) -> DataFrame:
    """Percentile rank, quartile and decile within peers."""
    w = Window.partitionBy(*group).orderBy(metric, *tiebreak)
    return (df.withColumn("pct_rank", F.percent_rank().over(w))
            .withColumn("quartile", F.ntile(4).over(w)).withColumn("decile", F.ntile(10).over(w)))


def running_cap(df: DataFrame, key: list[str], order: list[str], value: str, cap: float,
                marks=(0.5, 0.75, 0.9)) -> DataFrame:
    """Running total; the first row (by ``order``) at which each share
    mark of ``cap`` is reached and the first row above the hard cap."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__run", F.sum(value).over(w))
    o = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    aggs = [F.min(F.when(F.col("__run") >= F.lit(m * cap), o)).alias(f"first_at_{int(m * 100)}") for m in marks]
    aggs.append(F.min(F.when(F.col("__run") > F.lit(cap), o)).alias("first_over_cap"))
    return d.groupBy(*key).agg(F.max("__run").alias("total"), *aggs)


def lagged_pairs(df: DataFrame, key: list[str], t: str, value: str, max_lag: int) -> DataFrame:
    """Rows (key, lag, x_t, x_{t+lag}) on an integer time index, by equi-join
    on the shifted index (missing periods stay unmatched, not shifted)."""
    lags = F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag")
    a = df.select(*key, F.col(t).alias("__t"), F.col(value).alias("x"))
    b = df.select(*key, F.col(t).alias("__t2"), F.col(value).alias("y"))
    a = a.select("*", lags).withColumn("__t2", F.col("__t") + F.col("lag"))
    return a.join(b, key + ["__t2"])


def acf(df: DataFrame, key: list[str], t: str, value: str, max_lag: int) -> DataFrame:
    """Autocorrelation per lag (series mean / variance, standard ACF)."""
    mu = df.groupBy(*key).agg(F.avg(value).alias("__mu"), F.count(value).alias("__n"))
    c = df.join(mu, key).withColumn("__d", F.col(value) - F.col("__mu"))
    den = c.groupBy(*key).agg(F.sum(F.col("__d") * F.col("__d")).alias("__ss"))
    p = lagged_pairs(c, key, t, "__d", max_lag)
    num = p.groupBy(*key, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("__cov"))
    return num.join(den, key).select(*key, "lag", F.round(safe_div(F.col("__cov"), F.col("__ss")), 6).alias("acf"))


def cross_corr(df: DataFrame, key: list[str], t: str, a: str, b: str, max_lag: int) -> DataFrame:
    """corr(a_t, b_{t+lag}) for lag in [-max_lag, max_lag]; best lag by |r|."""
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    x = df.select(*key, F.col(t).alias("__t"), F.col(a).alias("x")).select("*", lags)
    y = df.select(*key, F.col(t).alias("__t2"), F.col(b).alias("y"))
    j = x.withColumn("__t2", F.col("__t") + F.col("lag")).join(y, key + ["__t2"])
    r = j.groupBy(*key, "lag").agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"))
    return r.groupBy(*key).agg(
        F.max_by("lag", F.struct(F.abs("r"), -F.abs("lag"), -F.col("lag"))).alias("best_lag"),
        F.round(F.max_by("r", F.struct(F.abs("r"), -F.abs("lag"), -F.col("lag"))), 6).alias("best_r"))


def cohort_index(df: DataFrame, entity: str, ts: str, grain: str = "month") -> DataFrame:
    """First-event period per entity and periods since it."""
    p = F.to_date(F.date_trunc(grain.upper(), F.col(ts)))
    d = df.withColumn("period", p)
    first = F.min("period").over(Window.partitionBy(entity))
    d = d.withColumn("cohort", first)
    months = F.months_between("period", "cohort").cast("int")
    age = months if grain == "month" else (months / 3).cast("int") if grain == "quarter" else \
        (F.datediff("period", "cohort") / (7 if grain == "week" else 1)).cast("int")
    return d.withColumn("age", age)


def runs(df: DataFrame, key: list[str], order: list[str], flag: str) -> DataFrame:
    """Gaps-and-islands run lengths of a state (``order`` is a total order)."""
    w = Window.partitionBy(*key).orderBy(*order)
    ws = Window.partitionBy(*key, flag).orderBy(*order)
    d = df.withColumn("__grp", F.row_number().over(w) - F.row_number().over(ws))
    return (d.groupBy(*key, flag, "__grp")
            .agg(F.min(order[0]).alias("run_start"), F.max(order[0]).alias("run_end"),
                 F.count("*").alias("run_length"))
            .drop("__grp"))


def range_buckets(rows: int) -> int:
    """Value ranges per group: about 200,000 distinct values each, 64 to 2,048 (the tree of comparisons stays small)."""
    return min(2048, max(64, -(-rows // 200_000)))


#: values in a table of groups (rows times values a row) up to which it is broadcast
MAX_GROUP_VALUES = 4_000_000


def with_group(df: DataFrame, groups: DataFrame, by: list[str], width: int = 1) -> DataFrame:
    """Rows with the one row of their group (``width`` values), inner.  ``groups`` is materialised by the caller and counted here.

    Shuffled by the group, all rows of a group would be sorted in one task; a broadcast table leaves the rows where they are.
    Where the groups are too many for that, the join is shuffled, and adaptive execution splits a skewed group.
    """
    return df.join(F.broadcast(groups) if groups.count() * width <= MAX_GROUP_VALUES else groups, by)


def bucketed_cumcount(df: DataFrame, by: list[str], value: str, weight: str | None = None,
                      buckets: int | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Cumulative weight strictly below each distinct value, per group, at scale.  ``extra`` are further aggregates of
    a value's rows, which pass along.

    1. aggregate to distinct (group, value) with their weight (a hot value is one row);
    2. cut each group's value range into ``buckets`` ranges at approximate
       quantiles (a small array per group);
    3. per (group, bucket) totals -> offsets by a window over at most
       ``buckets`` rows per group;
    4. within (group, bucket), a window over that bucket's distinct values.
    No task ever holds more than one bucket of one group.
    """
    w = F.sum(weight) if weight else F.count("*")
    # read three times below: materialised once, so the input is scanned once
    cnt = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*by, value)
                      .agg(w.alias("__w"), *[c.alias(n) for n, c in (extra or {}).items()]))
    buckets = buckets or range_buckets(cnt.count())
    qs = [i / buckets for i in range(1, buckets)]
    bounds = cnt.groupBy(*by).agg(F.percentile_approx(value, qs, 10000).alias("__b"))
    if by:
        c = with_group(cnt, cut_lineage(bounds), by, buckets)
    else:
        bv = bounds.select(F.col("__b")).scalar()
        c = cnt.withColumn("__b", bv)
    c = c.withColumn("__bk", count_below(F.col("__b"), F.col(value), buckets - 1)).drop("__b")
    tot = c.groupBy(*by, "__bk").agg(F.sum("__w").alias("__bw"))
    wo = Window.partitionBy(*by).orderBy("__bk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("__off", F.coalesce(F.sum("__bw").over(wo), F.lit(0)))
    c = c.join(tot.drop("__bw"), by + ["__bk"])
    wi = Window.partitionBy(*by, "__bk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("below", F.col("__off") + F.coalesce(F.sum("__w").over(wi), F.lit(0)))
    return c.select(*by, value, F.col("__w").alias("ties"), "below", *(extra or {}))


def avg_rank(df: DataFrame, value: str, by: list[str] | None = None, out: str = "rank",
             buckets: int | None = None, weight: str | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Average ranks with ties and tie-group sizes, per distinct value.

    Returns (by..., value, rank, ties, extra...).  Rank sums need no row: ``extra`` counts of a value's
    rows times its rank; join back on (by, value) only for the ranks of rows.
    """
    by = _list(by)
    c = bucketed_cumcount(df, by, value, weight, buckets, extra)
    return c.select(*by, value, (F.col("below") + (F.col("ties") + 1) / 2.0).alias(out), "ties", *(extra or {}))


# ---------------------------------------------------------------------------
# T: sort, limit, top-k, sampling
# ---------------------------------------------------------------------------
def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """ORDER BY ... LIMIT k (TakeOrderedAndProject: a k-row heap per task)."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """Per-group top-k (window group-limit pushdown trims before the shuffle)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def cap_candidates(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """Rank candidates and mark those beyond the cap as overflow (kept)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("overflow", F.col("rank") > k)


def exact_hash_sample(df: DataFrame, key: list[str], n: int, seed: int = 42, buckets: int | None = None) -> DataFrame:
    """Exactly ``n`` rows, the ones with the smallest seeded hash of the key
    (independent of partitioning), without a single-task top-n merge: count
    rows per hash bucket, find the bucket holding the n-th row, keep every
    lower bucket whole and rank only inside the one boundary bucket.  Buckets
    default to one per 50,000 rows; all rows come back if there are no more
    than ``n``."""
    rows = df.count()
    if rows <= n:
        return df
    buckets = buckets or max(64, -(-rows // 50_000))
    u = F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit(seed)), F.lit(1 << 40))
    d = df.withColumn("__u", u).withColumn("__b", (F.col("__u") * buckets / F.lit(float(1 << 40))).cast("int"))
    cnt = d.groupBy("__b").count()
    cum = cnt.withColumn("__cum", F.sum("count").over(Window.orderBy("__b")))   # <= buckets rows
    edge = cum.where(F.col("__cum") >= n).agg(F.min("__b").alias("b"))
    b_star = edge.scalar()
    before = cum.where(F.col("__b") < b_star).select(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    lower = d.where(F.col("__b") < b_star)
    w = Window.partitionBy("__b").orderBy("__u", *[F.col(k) for k in key])
    boundary = d.where(F.col("__b") == b_star).withColumn("__r", F.row_number().over(w)) \
        .where(F.col("__r") <= F.lit(n) - before).drop("__r")
    return lower.unionByName(boundary).drop("__u", "__b")


def guard_rows(df: DataFrame, key: list[str], threshold: int, seed: int = 42, auto_sample: bool = False):
    """Above ``threshold`` rows an error, or, with sampling asked for, an
    exact-n deterministic sample (the rows with the smallest seeded key hash)
    and a high-severity warning."""
    n = df.count()
    if n <= threshold:
        return df, []
    if not auto_sample:
        raise ValueError(f"{n} rows exceed the {threshold}-row threshold and sampling is off")
    out = exact_hash_sample(df, key, threshold, seed)
    return out, [("high", f"sampled {threshold} of {n} rows (seed {seed})")]


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """N rows in a seeded pseudo-random order."""
    order = F.xxhash64(*[F.col(k) for k in key], F.lit(seed)) if key else F.rand(seed)
    return df.orderBy(order).limit(n)


# ---------------------------------------------------------------------------
# U: set operations and dedup
# ---------------------------------------------------------------------------
def stack_keys(df: DataFrame, cols: list[str], out: str = "key") -> DataFrame:
    """UNION ALL of DISTINCT projections of several key columns."""
    parts = [df.select(F.col(c).alias(out), F.lit(c).alias("key_source")).distinct() for c in cols]
    return reduce(lambda a, b: a.unionByName(b), parts)


def dedup_first(df: DataFrame, key: str, position: str) -> DataFrame:
    """Order-preserving dedup: keep the first position of each id."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def churn(df: DataFrame, key: str, period: str, t0, t1) -> DataFrame:
    """Entities that appeared or vanished inside [t0, t1]."""
    span = df.groupBy(key).agg(F.min(period).alias("first_seen"), F.max(period).alias("last_seen"))
    return span.withColumn("status", F.when(F.col("first_seen") > F.lit(t0), "appeared")
                           .when(F.col("last_seen") < F.lit(t1), "vanished").otherwise("present"))


def peer_median(df: DataFrame, group: list[str], entity: str, value: str, out: str = "peer_median") -> DataFrame:
    """Exact median of the *other* entities in the group.

    Removing one value from a sorted group shifts the median only among the
    (at most four) order statistics around the middle, so each row picks its
    answer from those, chosen by its own rank.  One window per group, no
    pairs, no collected lists."""
    w = Window.partitionBy(*group).orderBy(F.col(value), F.col(entity))
    d = df.withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*group)))
    mid = F.floor(F.col("__n") / 2)
    picks = {f"__v{k}": F.max(F.when(F.col("__r") == mid + k, F.col(value))).over(Window.partitionBy(*group))
             for k in (-1, 0, 1, 2)}
    for name, c in picks.items():
        d = d.withColumn(name, c)
    m = F.col("__n") - 1                     # size of the peer set

    def peer_at(pos):                        # pos-th smallest peer (1-based), pos in mid-1 .. mid+1
        orig = F.when(pos < F.col("__r"), pos).otherwise(pos + 1)
        off = orig - mid
        return (F.when(off == -1, F.col("__v-1")).when(off == 0, F.col("__v0"))
                .when(off == 1, F.col("__v1")).when(off == 2, F.col("__v2")))

    lo = F.floor((m + 1) / 2)
    hi = F.floor(m / 2) + 1
    med = F.when(m <= 0, None).otherwise((peer_at(lo) + peer_at(hi)) / 2.0)
    return d.withColumn(out, med).drop("__r", "__n", *picks.keys())


def count_below(bounds: Column, v: Column, n: int) -> Column:
    """Number of elements of the ascending array ``bounds`` (length n) below ``v``: a binary search in log2 n steps, never null.

    A CASE tree of all bounds makes a generated method beyond the size that the JVM compiles, and a nullable join key is evaluated twice."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(n, 1).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= n) & (F.get(bounds, p + s - 1) < v), p + s).otherwise(p))
    return F.coalesce(found, F.lit(0))


def weighted_values(df: DataFrame, by: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct (group, value) rows with their weight ``__w``, materialised once: a hot value is one row."""
    w = F.sum(weight) if weight else F.count("*")
    return cut_lineage(df.select(*by, F.col(value).cast("double").alias("__v"), *([weight] if weight else []))
                       .where(F.col("__v").isNotNull()).groupBy(*by, "__v").agg(w.alias("__w")))


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], buckets: int | None = None,
                    names: list[str] | None = None, weighted: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (type 7, as ``percentile`` and
    ``quantile_cont``) per group, without holding a group in one buffer.

    1. cut each group's values at approximate quantiles into ``buckets``
       value ranges (a sketch per group);
    2. count rows per (group, bucket) and accumulate the counts over the
       buckets (a window over at most ``buckets`` rows per group);
    3. keep only the buckets that contain a target rank (at most two per
       quantile) and rank the rows inside those buckets alone.
    No task holds more than one bucket of one group, and buckets without a
    target rank are never sorted.  ``weighted`` is a table of
    ``weighted_values`` that the caller has already."""
    by = list(by)
    names = names or [f"q{i}" for i in range(len(qs))]
    x = weighted_values(df, by, value) if weighted is None else weighted
    buckets = buckets or range_buckets(x.count())
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = cut_lineage(x.groupBy(*by).agg(F.percentile_approx("__v", cuts, 10000).alias("__b"), F.sum("__w").alias("__n")))
    if by:
        xb = with_group(x, bounds, by, buckets)
    else:
        xb = x.withColumn("__b", bounds.select("__b").scalar()).withColumn("__n", bounds.select("__n").scalar())
    xb = xb.withColumn("__bk", count_below(F.col("__b"), F.col("__v"), buckets - 1)).drop("__b")
    cnt = xb.groupBy(*by, "__bk").agg(F.sum("__w").alias("__c"), F.first("__n").alias("__n"))
    w = Window.partitionBy(*by).orderBy("__bk").rowsBetween(Window.unboundedPreceding, 0)
    cnt = cnt.withColumn("__end", F.sum("__c").over(w)).withColumn("__start", F.col("__end") - F.col("__c"))
    targets = []
    for q in qs:
        h = (F.col("__n") - 1) * F.lit(float(q)) + 1
        targets += [F.floor(h), F.ceil(h)]
    need = reduce(lambda a, b: a | b, [(F.col("__start") < r) & (r <= F.col("__end")) for r in targets])
    # at most two buckets a quantile and group: the rows of all others go before the shuffle
    tb = cut_lineage(cnt.where(need).select(*by, "__bk", "__start"))
    sel = with_group(xb, tb, by + ["__bk"])
    wi = Window.partitionBy(*by, "__bk").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    sel = sel.withColumn("__hiR", F.sum("__w").over(wi) + F.col("__start")) \
        .withColumn("__loR", F.col("__hiR") - F.col("__w"))
    aggs = []
    for j, q in enumerate(qs):
        h = (F.col("__n") - 1) * F.lit(float(q)) + 1
        for tag, r in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("__loR") < r) & (r <= F.col("__hiR"))
            aggs.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{tag}{j}"))
    g = sel.groupBy(*by).agg(*aggs, F.first("__n").alias("__n"))
    out = []
    for j, q in enumerate(qs):
        h = (F.col("__n") - 1) * F.lit(float(q)) + 1
        lo, hi = F.floor(h), F.ceil(h)
        v = F.when(hi == lo, F.col(f"__lo{j}")).otherwise(
            (hi - h) * F.col(f"__lo{j}") + (h - lo) * F.col(f"__hi{j}"))
        out.append(v.alias(names[j]))
    return g.select(*by, *out)
