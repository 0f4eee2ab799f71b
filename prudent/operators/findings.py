"""Findings, validation, synthesis and observability (inventory family V).

Findings and statistics are tables; every rule is a column expression or a
join over them, so validating a million findings is the same plan as
validating ten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prudent.functions import scalar as S

# Grade order used by the review gate and connection ceilings.
GRADE_SCORE = {"A": 4, "B": 3, "C": 2, "D": 1, "F": 0}
SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1, "n/a": 0}


def score(grade: Column) -> Column:
    m = F.create_map(*[x for k, v in GRADE_SCORE.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.upper(grade)], F.lit(-1))


def letter(score_col: Column) -> Column:
    m = F.create_map(*[x for k, v in GRADE_SCORE.items() for x in (F.lit(v), F.lit(k))])
    return m[score_col]


def rigor(p: Column, effect: Column, ci_low: Column, ci_high: Column, n_min: Column,
          kind: Column | None = None, alpha: float = 0.05, min_n: int = 30) -> Column:
    """Fail on too-small samples; a significant comparison without an
    effect size or CI -> 'partial' (one grade down, caveat); a trivial
    effect behind a significant p -> 'partial'; a null result passes."""
    significant = p < alpha
    missing = effect.isNull() | ci_low.isNull() | ci_high.isNull()
    return (F.when(n_min < min_n, "fail")
            .when(significant & missing, "partial")
            .when(significant & (F.abs(effect) < 0.2), "partial")
            .otherwise("pass"))


def recompute(stated: Column, recomputed: Column, kind: Column | None = None, tol: float = 0.01) -> Column:
    """Match / mismatch / unable_to_compute (recomputed value wins)."""
    close = S.values_match(recomputed, stated, kind, tol)
    return F.when(recomputed.isNull(), "unable_to_compute").when(close, "match").otherwise("mismatch")


def guardrail(primary_dir: Column, paired_dir: Column) -> Column:
    """Direction matrix -> no_concern / trade_off_present / dual_concern /
    missing_data (directions are -1, 0, +1; +1 is the desirable direction)."""
    return (F.when(primary_dir.isNull() | paired_dir.isNull(), "missing_data")
            .when((primary_dir >= 0) & (paired_dir >= 0), "no_concern")
            .when((primary_dir < 0) & (paired_dir < 0), "dual_concern")
            .otherwise("trade_off_present"))


def plausibility(value: Column, hist_lo: Column, hist_hi: Column, quirk: Column, invariant_ok: Column) -> Column:
    """Implausible when outside the historical range, on a known quirk
    date, or breaking an invariant."""
    bad = (value < hist_lo) | (value > hist_hi) | quirk | ~invariant_ok
    return F.when(value.isNull(), "n/a").when(bad, "implausible").otherwise("plausible")


def grade(rig: Column, rec: Column, guard: Column, plaus: Column, lenses: Column,
          rel_gap: Column | None = None) -> Column:
    """The four-layer decision table, then caps: fewer than three
    agreeing lenses -> at most C; missing guardrail data -> at most B."""
    gap = rel_gap if rel_gap is not None else F.lit(0.0)
    base = (F.when(rec == "unable_to_compute", "F")
            .when(rec == "mismatch", F.when(gap > 0.10, "F").otherwise("D"))
            .when(rig == "fail", "D")
            .when(plaus == "implausible", "C")
            .when(rig == "partial", "B")
            .when(guard == "trade_off_present", "B")
            .otherwise("A"))
    s = score(base)
    s = F.when(s >= 2, F.least(s, F.when(lenses < 3, 2).otherwise(4))).otherwise(s)
    s = F.when((guard == "missing_data") & (s > 3), 3).otherwise(s)
    return letter(s)


def publishable(reviewed: DataFrame, grade_col: str = "grade") -> DataFrame:
    """Drop D and F."""
    return reviewed.where(~F.col(grade_col).isin("D", "F"))


def review_gate(cards: DataFrame, threshold: str | None, run: str = "run_id", grade_col: str = "grade") -> DataFrame:
    """Cards at or above the threshold grade are held for review; a
    null or unknown threshold disables the gate.  Adds per-card ``held`` and
    run-level ``gated``."""
    t = GRADE_SCORE.get((threshold or "").upper(), -1)
    held = F.lit(False) if t < 0 else (score(F.col(grade_col)) >= t)
    d = cards.withColumn("held", held)
    return d.withColumn("gated", F.max(F.col("held").cast("int")).over(Window.partitionBy(run)) == 1)


def connect(pairs: DataFrame, ga: str = "a_grade", gb: str = "b_grade", single_entity: Column | None = None,
            missing_context: Column | None = None) -> DataFrame:
    """Connection grade = weaker source; C-C is not a connection; one
    grade down for a single-entity pattern or missing domain context."""
    ceiling = F.least(score(F.col(ga)), score(F.col(gb)))
    down = F.lit(0)
    if single_entity is not None:
        down = down + single_entity.cast("int")
    if missing_context is not None:
        down = down + missing_context.cast("int")
    cc = (score(F.col(ga)) <= 2) & (score(F.col(gb)) <= 2)
    s = F.when(cc, F.lit(None)).otherwise(F.greatest(ceiling - down, F.lit(0)))
    return pairs.withColumn("connection_grade", letter(s)).withColumn("is_connection", ~cc & (s >= 2))


def lost_caveats(up: DataFrame, down: DataFrame, key: str = "finding_id") -> DataFrame:
    """High-severity upstream caveats missing downstream (by normalised text)."""
    u = up.where(F.col("severity") == "high").withColumn("__k", S.norm_key("text"))
    d = down.withColumn("__k", S.norm_key("text")).select(key, "__k")
    return u.join(d, [key, "__k"], "left_anti").drop("__k")


def carry_caveats(findings: DataFrame, entity: str = "entity") -> DataFrame:
    """Caveats compound across runs (union per entity, never filtered)."""
    c = findings.select(entity, "run_id", F.explode_outer("caveats").alias("c"))
    return c.groupBy(entity).agg(F.array_sort(F.collect_set("c.text")).alias("caveats"),
                                 F.countDistinct("run_id").alias("n_runs"))


def aggregate_gaps(gaps: DataFrame) -> DataFrame:
    """V15 + T02: group gaps by fuzzy key; count, max severity, longest text,
    sorted sets of categories / sources / runs; ranked by severity,
    frequency, first category."""
    sev = F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    g = gaps.withColumn("__k", S.norm_key("text")).withColumn("__sev", F.coalesce(sev[F.col("severity")], F.lit(0)))
    a = g.groupBy("__k").agg(
        F.count("*").alias("frequency"),
        F.max_by("severity", F.struct("__sev", F.lit(0))).alias("severity"),
        F.max("__sev").alias("__rank"),
        F.max_by("text", F.struct(F.length("text"), "text")).alias("text"),
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.collect_set("run_id")).alias("runs"))
    w = Window.orderBy(F.col("__rank").desc(), F.col("frequency").desc(), F.col("categories")[0].asc(),
                       F.col("__k").asc())
    return a.withColumn("rank", F.row_number().over(w)).drop("__k", "__rank")


def run_status(stages: DataFrame, run: str = "run_id") -> DataFrame:
    """Failed if a critical stage failed; degraded if any stage degraded
    or a non-critical stage failed; else ok."""
    return stages.groupBy(run).agg(
        F.bool_or((F.col("status") == "failed") & F.col("critical")).alias("__cf"),
        F.bool_or((F.col("status") == "degraded") | ((F.col("status") == "failed") & ~F.col("critical"))).alias("__d")
    ).select(run, F.when(F.col("__cf"), "failed").when(F.col("__d"), "degraded").otherwise("ok").alias("status"))


def span_rollup(spans: DataFrame) -> DataFrame:
    """Duration, self time (duration minus direct children) and errors
    by span name and parent name."""
    d = spans.withColumn("dur", (F.unix_micros(F.col("ended_at").cast("timestamp"))
                                 - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000.0)
    child = d.where(F.col("parent_span_id").isNotNull()).groupBy(F.col("parent_span_id").alias("span_id")) \
        .agg(F.sum("dur").alias("child_ms"))
    parents = d.select(F.col("span_id").alias("parent_span_id"), F.col("name").alias("parent_name"))
    j = d.join(child, "span_id", "left").join(parents, "parent_span_id", "left")
    j = j.withColumn("self_ms", F.col("dur") - F.coalesce(F.col("child_ms"), F.lit(0.0)))
    return j.groupBy("name", "parent_name").agg(
        F.count("*").alias("n"), F.sum("dur").alias("total_ms"), F.sum("self_ms").alias("self_ms"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"))


def causal_label(has_experiment: Column, has_dose_response: Column, confounding_ruled_out: Column,
                 temporal_order: Column) -> Column:
    """established_causal needs an experiment (or natural experiment);
    strong_correlation needs temporal order, dose-response and confounders
    ruled out; otherwise associational."""
    return (F.when(has_experiment, "established_causal")
            .when(temporal_order & has_dose_response & confounding_ruled_out, "strong_correlation")
            .otherwise("associational"))


def status_vs_baseline(value: Column, base_mean: Column, base_sd: Column, k: float = 2.0) -> Column:
    """Elevated / depressed beyond k sd of the baseline, else stable."""
    return (F.when(base_mean.isNull() | base_sd.isNull(), "no_baseline")
            .when(value > base_mean + k * base_sd, "elevated")
            .when(value < base_mean - k * base_sd, "depressed").otherwise("stable"))
