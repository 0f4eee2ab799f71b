"""Benchmarks of an entity against its peers, its own trend and a regression, and gaps that are worth reporting.

The focal entity is taken out of its group by arithmetic on the group's count, mean and squared deviations, so there
are no pairs of entities and no window over a group: one aggregate per entity, one per group, one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prudent.functions import dist as D
from prudent.operators.relational import MAX_GROUP_VALUES
from prudent.operators.stats import finalize, nz
from prudent.session import cut_lineage


#: rows in a task that evaluates a quantile of the t distribution, some milliseconds a row
SPREAD = 500


def _same(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Rows with the row of their group, nulls alike; ``right`` is materialised, and broadcast unless it is large, so that a group isn't one task."""
    few = right.count() * len(right.columns) <= MAX_GROUP_VALUES
    r = right.select(*[F.col(c).alias(f"__g{i}") if c in group else F.col(c) for i, c in enumerate(right.columns)])
    names = {c: f"__g{i}" for i, c in enumerate(right.columns)}
    return left.join(F.broadcast(r) if few else r, [F.col(c).eqNullSafe(F.col(names[c])) for c in group], "left").drop(*[names[c] for c in group])


def gap_report(panel: DataFrame, group: list[str], entity: str, period: str, value: str, windows: tuple[int, ...] = (3, 12), min_peers: int = 10) -> DataFrame:
    """The gap of every entity to its peers, with what it must survive.

    ``panel`` has a row per entity and period.  The level is the mean over the entity's periods; the benchmark the mean level of the other entities of its
    group.  Returned: ``level, benchmark, bench_low, bench_high, n_peers, gap, gap_pct, ci_low, ci_high`` (95 %, the entity's
    and the peers' errors together, Welch's degrees of freedom), ``noise`` (standard deviation of the entity's periods), and the checks
    ``outside_noise``, ``windows_agree`` (the gap has the same sign over the last periods of each window), ``drop_one_peer`` (also without
    the highest or the lowest peer), ``enough_peers``; ``verdict`` is gap or strength where all hold and the interval leaves zero out, else
    not established.  Null values are left out; an entity without peers has no benchmark.
    """
    p = panel.where(F.col(value).isNotNull())
    last = p.select(F.max(period)).scalar()
    recent = [F.avg(F.when(F.col(period) > last - w, F.col(value))).alias(f"x{w}") for w in windows]
    e = cut_lineage(p.groupBy(*group, entity).agg(F.count("*").alias("t"), F.avg(value).alias("x"), F.stddev_samp(value).alias("noise"), *recent))
    levels = ["x", *[f"x{w}" for w in windows]]
    sums = [a for c in levels for a in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"))]
    g = e.groupBy(*group).agg(*sums, (F.var_pop("x") * F.count("x")).alias("m2"), F.max(F.struct("x", entity)).alias("top"), F.min(F.struct("x", entity)).alias("bottom"))
    # an entity's peers are its group less itself: their quantile is the group's, not a row's
    g = cut_lineage(g.withColumn("__bcrit", F.expr(f"CASE WHEN n_x - 1 > 1 THEN {D.t_ppf(0.975, '(n_x - 2)')} END")))
    # the second from either end, for the entity that is the first itself
    inner = _same(e, g.select(*group, "top", "bottom"), group)
    second = cut_lineage(inner.groupBy(*group).agg(F.max(F.when(F.col(entity) != F.col(f"top.{entity}"), F.col("x"))).alias("top2"),
                                       F.min(F.when(F.col(entity) != F.col(f"bottom.{entity}"), F.col("x"))).alias("bottom2")))
    # spread by number, which adaptive execution leaves: a few MB of entities would else be one task
    j = _same(_same(e.repartition(-(-max(e.count(), 1) // SPREAD), entity), g, group), second, group)

    def others(c: str):
        """Mean of the others' level."""
        return F.try_divide(F.col(f"n_{c}") * F.col(f"m_{c}") - F.coalesce(F.col(c), F.lit(0.0)), F.col(f"n_{c}") - F.col(c).isNotNull().cast("int"))

    j = j.withColumn("n_peers", F.col("n_x") - 1).withColumn("bench", others("x"))
    m2 = F.col("m2") - (F.col("x") - F.col("m_x")) * (F.col("x") - F.col("m_x")) * F.try_divide(F.col("n_x"), F.col("n_x") - 1)
    j = j.withColumn("v_peers", F.try_divide(F.greatest(m2, F.lit(0.0)), F.col("n_peers") - 1))
    high = F.when(F.col(entity) == F.col(f"top.{entity}"), F.col("top2")).otherwise(F.col("top.x"))
    low = F.when(F.col(entity) == F.col(f"bottom.{entity}"), F.col("bottom2")).otherwise(F.col("bottom.x"))

    def without(one):
        return F.signum(F.col("x") - F.try_divide(F.col("bench") * F.col("n_peers") - one, F.col("n_peers") - 1))

    sign = F.signum(F.col("x") - F.col("bench"))
    agree = F.lit(True)
    for c in levels[1:]:
        agree = agree & F.coalesce(F.signum(F.col(c) - others(c)) == sign, F.lit(False))
    j = (j.withColumn("windows_agree", agree).withColumn("drop_one_peer", F.coalesce((without(high) == sign) & (without(low) == sign), F.lit(False)))
         .withColumn("a", F.col("noise") * F.col("noise") / F.col("t")).withColumn("b", F.try_divide("v_peers", "n_peers")))
    dfw = f"(pow(a + b, 2) / {nz('(a * a / ' + nz('(t - 1)') + ' + b * b / ' + nz('(n_peers - 1)') + ')')})"
    j = j.withColumn("__df", F.expr(dfw)).withColumn("__crit", F.expr(f"CASE WHEN __df > 0 THEN {D.t_ppf(0.975, '__df')} END"))
    j = cut_lineage(j)  # the quantile is evaluated once, not in every column that reads it
    out = finalize(j, {"level": "x", "benchmark": "bench", "bench_low": "bench - __bcrit * sqrt(b)", "bench_high": "bench + __bcrit * sqrt(b)", "n_peers": "n_peers",
                       "gap": "x - bench", "gap_pct": f"(x - bench) * 100 / {nz('bench')}", "ci_low": "x - bench - __crit * sqrt(a + b)",
                       "ci_high": "x - bench + __crit * sqrt(a + b)", "noise": "noise"}, keep=[*group, entity, "windows_agree", "drop_one_peer"])
    out = out.withColumn("outside_noise", F.coalesce(F.abs("gap") > F.col("noise"), F.lit(False))).withColumn("enough_peers", F.coalesce(F.col("n_peers") >= min_peers, F.lit(False)))
    clear = F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False))
    holds = clear & F.col("outside_noise") & F.col("windows_agree") & F.col("drop_one_peer") & F.col("enough_peers")
    return out.withColumn("verdict", F.when(holds & (F.col("gap") > 0), "strength").when(holds, "gap").otherwise("not established"))


def own_trend(panel: DataFrame, group: list[str], entity: str, period: str, value: str, recent: int = 12) -> DataFrame:
    """The mean of an entity's last ``recent`` periods against its own earlier trend, a line through the periods before, carried on to them."""
    p = panel.where(F.col(value).isNotNull())
    first = p.select(F.max(period)).scalar() - recent
    now = F.col(period) > first
    x, y = F.when(~now, F.col(period).cast("double")), F.when(~now, F.col(value))
    s = p.groupBy(*group, entity).agg(F.avg(F.when(now, F.col(value))).alias("level"), F.avg(F.when(now, F.col(period))).alias("at"), F.regr_slope(y, x).alias("slope"),
                                      F.avg(y).alias("my"), F.avg(x).alias("mx"), F.count(y).alias("n_before"))
    return finalize(s, {"level": "level", "expected": "my + slope * (at - mx)", "gap": "level - (my + slope * (at - mx))", "n_before": "n_before"}, keep=[*group, entity])


def regression_expected(df: DataFrame, group: list[str], entity: str, value: str, control: str) -> DataFrame:
    """The value that the other entities' regression on a control gives for the entity's own control.

    The fit without the entity needs no fit of its own: its residual is the residual of the whole fit over one less the
    entity's leverage.  A group of fewer than four entities has none.
    """
    d = df.where(F.col(value).isNotNull() & F.col(control).isNotNull())
    g = d.groupBy(*group).agg(F.count("*").alias("n"), F.regr_sxx(value, control).alias("sxx"), F.regr_sxy(value, control).alias("sxy"),
                              F.avg(control).alias("mc"), F.avg(value).alias("mv"))
    g = cut_lineage(g)
    j = _same(d.select(*group, entity, F.col(value).alias("v"), F.col(control).alias("c")), g, group)
    lever = f"(1.0D / n + (c - mc) * (c - mc) / {nz('sxx')})"
    resid = f"(v - mv - sxy / {nz('sxx')} * (c - mc))"
    gap = f"CASE WHEN n > 3 THEN {resid} / {nz('(1 - ' + lever + ')')} END"
    return finalize(j, {"level": "v", "expected": f"v - {gap}", "gap": gap}, keep=[*group, entity])
