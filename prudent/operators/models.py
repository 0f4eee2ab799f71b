"""Models fitted from one aggregate per step, and exact or simulated group comparisons.

What leaves Spark is a handful of numbers per step: cross products of the terms (a model has few),
or the cells of a table of levels.  Each pass over the rows is one aggregate with partial sums in
the tasks, so rows are never collected and nothing is broadcast but coefficients and margins.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prudent.functions import dist as D
from prudent.functions import studentized as Q
from prudent.operators.stats import finalize, group_moments, nz
from prudent.session import cut_lineage

#: groups of a pairwise comparison (the result has a row a pair), and levels of a factor
MAX_GROUPS, MAX_LEVELS = 100_000, 5_000
#: a pivot below this share of its column's size is a combination of earlier terms
PIVOT = 1e-10


# ---------------------------------------------------------------------------
# sweep operator
# ---------------------------------------------------------------------------
def sweep(a: np.ndarray, k: int, scale: np.ndarray) -> bool:
    """Sweep a symmetric cross-product matrix in place on term ``k``; False (untouched) if the term adds nothing."""
    d = a[k, k]
    if not d > PIVOT * scale[k]:
        return False
    row, column = a[k] / d, a[:, k].copy()
    a -= np.outer(column, row)
    a[k], a[:, k] = row, -column / d
    a[k, k] = 1 / d
    return True


# ---------------------------------------------------------------------------
# Tukey HSD
# ---------------------------------------------------------------------------
def tukey_hsd(df: DataFrame, value: str, group: str, by: list[str] = (), confidence: float | None = 0.95) -> DataFrame:
    """Tukey-Kramer comparison of every pair of groups, from the moments of the groups.

    One aggregate over the rows; then the k-row table of groups meets itself (``g1 < g2``).  Returns ``g1, g2, mean_diff,
    q, df, p_value`` and, with ``confidence``, the simultaneous interval.  Groups without a value are absent; a
    family of fewer than two groups or without degrees of freedom has no p-value.
    """
    by = list(by)
    m = cut_lineage(group_moments(df, value, group, by).where(F.col(group).isNotNull()))
    if m.count() > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups: the pairs are the result")
    fam = m.groupBy(*by).agg(F.count("*").alias("k"), (F.sum("n") - F.count("*")).alias("df"),
                             F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ssw"))
    fam = fam.withColumn("mse", F.expr(f"ssw / {nz('df')}"))
    if confidence:
        fam = fam.withColumn("q_crit", F.expr(Q.range_quantile(confidence, "k", "df")))
    fam = fam.select(*[F.col(c).alias(f"__{c}") if c in by else F.col(c) for c in fam.columns if c != "ssw"])
    one = F.struct(*fam.columns)

    def side(i: int) -> DataFrame:
        return m.select(*[F.col(c).alias(f"__{i}{c}") for c in by], F.col(group).alias(f"g{i}"), F.col("n").alias(f"n{i}"), F.col("m").alias(f"m{i}"))

    same = [F.col(f"__1{c}").eqNullSafe(F.col(f"__2{c}")) for c in by]
    pairs = side(1).join(F.broadcast(side(2)), [*same, F.col("g1") < F.col("g2")])
    pairs = (pairs.join(fam, [F.col(f"__1{c}").eqNullSafe(F.col(f"__{c}")) for c in by]) if by
             else pairs.withColumn("__fam", fam.select(one).scalar()).select("*", "__fam.*"))
    se = "sqrt(mse / 2 * (1.0D / n1 + 1.0D / n2))"
    out = pairs.withColumn("__q", F.expr(f"abs(m1 - m2) / {nz(se)}"))
    exprs = {"mean_diff": "(m1 - m2)", "q": "__q", "df": "df", "p_value": Q.range_sf("__q", "k", "df")}
    if confidence:
        exprs |= {"ci_low": f"(m1 - m2) - q_crit * {se}", "ci_high": f"(m1 - m2) + q_crit * {se}"}
    return finalize(out.select(*[F.col(f"__1{c}").alias(c) for c in by], "g1", "g2", "n1", "n2", "m1", "m2", "k", "df", "mse", "__q",
                               *(["q_crit"] if confidence else [])), exprs, keep=[*by, "g1", "g2"])


# ---------------------------------------------------------------------------
# Two-way analysis of variance, unbalanced
# ---------------------------------------------------------------------------
def _two_way(cells: pd.DataFrame, a: str, b: str) -> pd.DataFrame:
    n, m = cells["n"].to_numpy(float), cells["m"].to_numpy(float)
    within = float(cells["m2"].sum())
    ia, ib = (pd.factorize(cells[c], use_na_sentinel=False)[0] for c in (a, b))
    ka, kb = int(ia.max()) + 1, int(ib.max()) + 1
    m = m - np.average(m, weights=n)

    def one_way(i: np.ndarray, k: int) -> float:
        s, w = np.bincount(i, n * m, k), np.bincount(i, n, k)
        return within + float(np.sum(n * (m - (s / w)[i]) ** 2))

    # terms: levels of b (their columns are orthogonal), then those of a, then the response
    p = kb + ka
    x = np.zeros((p + 1, p + 1))
    np.add.at(x, (ib, ib), n)
    np.add.at(x, (kb + ia, kb + ia), n)
    np.add.at(x, (ib, kb + ia), n)
    np.add.at(x, (ib, p), n * m)
    np.add.at(x, (kb + ia, p), n * m)
    x = x + np.triu(x, 1).T
    x[p, p] = np.sum(n * m * m)
    scale = x.diagonal().copy()
    rank = sum(sweep(x, k, scale) for k in range(p))
    both = within + max(float(x[p, p]), 0.0)
    total = int(n.sum())
    error = total - len(cells)
    rows = [(a, one_way(ib, kb) - both, rank - kb), (b, one_way(ia, ka) - both, rank - ka),
            (f"{a}:{b}", both - within, len(cells) - rank), ("residual", within, error)]
    return pd.DataFrame({"source": [r[0] for r in rows], "ss": [max(r[1], 0.0) if r[2] else 0.0 for r in rows], "df1": [r[2] for r in rows],
                         "sse": within, "df2": error})


def two_way_anova(df: DataFrame, value: str, a: str, b: str, by: list[str] = ()) -> DataFrame:
    """Type II analysis of variance of two factors and their interaction, cells of any size.

    The rows give one aggregate per cell (count, mean, squared deviations); the table of cells, at most
    levels of ``a`` times levels of ``b``, is solved by the sweep operator, one family per task.  Empty cells and
    confounded levels take their degrees of freedom away.  Rows without a value are left out; a null level is a level.
    """
    by = list(by)
    cells = (df.where(F.col(value).isNotNull()).groupBy(*by, a, b)
             .agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("m2")))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + (", " if by else "") + "source string, ss double, df1 long, sse double, df2 long"

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        if max(part[a].nunique(), part[b].nunique()) > MAX_LEVELS:
            raise ValueError(f"more than {MAX_LEVELS} levels of a factor")
        out = _two_way(part, a, b)
        for i, c in enumerate(by):
            out.insert(i, c, part[c].iloc[0])
        return out

    t = cells.groupBy(*(by or [F.lit("all")])).applyInPandas(solve, schema)
    f = f"CASE WHEN source <> 'residual' THEN (ss / {nz('df1')}) / {nz('(sse / ' + nz('df2') + ')')} END"
    t = t.withColumn("__f", F.expr(f))
    return finalize(t, {"ss": "ss", "df": "df1", "ms": f"(ss / {nz('df1')})", "f": "__f",
                        "p_value": f"CASE WHEN __f IS NOT NULL THEN {D.f_sf('__f', 'df1', 'df2')} END",
                        "partial_eta_sq": f"CASE WHEN source <> 'residual' THEN ss / {nz('(ss + sse)')} END"}, keep=[*by, "source"])


# ---------------------------------------------------------------------------
# Generalised linear models
# ---------------------------------------------------------------------------
class Fit(NamedTuple):
    """Coefficients (null where a term is a combination of earlier ones), their covariance, and the fit's totals."""
    family: str
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    score: np.ndarray
    deviance: float
    null_deviance: float
    n: int
    rank: int
    steps: int
    converged: bool


_LINK = {"gaussian": lambda e: e, "poisson": F.exp, "binomial": lambda e: 1 / (1 + F.exp(-e))}
_VARIANCE = {"gaussian": lambda m: F.lit(1.0), "poisson": lambda m: m, "binomial": lambda m: m * (1 - m)}


def _deviance(family: str, y: Column, mu: Column) -> Column:
    def part(u: Column, v: Column) -> Column:
        return F.when(u > 0, u * F.log(u / v)).otherwise(0.0)

    return {"gaussian": lambda: (y - mu) * (y - mu), "poisson": lambda: 2 * (part(y, mu) - (y - mu)),
            "binomial": lambda: 2 * (part(y, mu) + part(1 - y, 1 - mu))}[family]()


def glm(df: DataFrame, y: str, xs: list[str], family: str = "gaussian", steps: int = 60, tolerance: float = 1e-11) -> Fit:
    """Linear, Poisson (log link) or logistic regression by iteratively reweighted least squares.

    Each step is one aggregate: the cross products of the terms weighted at the current coefficients, from which the sweep
    operator gives the next ones.  Terms are centred and scaled by their moments first, so sums don't cancel.  Rows with
    a null are left out.  For a logistic model with separated classes the coefficients grow without bound; the fit stops
    after ``steps`` and says it did not converge.
    """
    y_, x_ = "__y", [f"__x{i}" for i in range(len(xs))]
    rows = df.select(F.col(y).cast("double").alias(y_), *[F.col(c).cast("double").alias(n) for c, n in zip(xs, x_)]).dropna()
    if family != "gaussian":
        rows = cut_lineage(rows)  # read again at every step, only these columns
    first = rows.agg(F.count("*").alias("n"), F.avg(y_).alias("m"), *[f(c).alias(f"{p}{c}") for c in x_ for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n, p = first["n"], len(xs) + 1
    if not n:
        raise ValueError("no row without nulls")
    mean = np.array([first[f"m{c}"] for c in x_])
    size = np.array([first[f"s{c}"] or 1.0 for c in x_])
    z = [F.lit(1.0)] + [(F.col(c) - float(m)) / float(s) for c, m, s in zip(x_, mean, size)]
    target = F.col(y_)

    def pass_over(beta: np.ndarray | None) -> tuple[np.ndarray, float, np.ndarray]:
        """Cross products of terms and working response, deviance at ``beta``, score."""
        if beta is not None:
            eta = sum((t * float(b) for t, b in zip(z[1:], beta[1:])), F.lit(float(beta[0])))
            if family == "binomial":
                eta = F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0))
            mu = _LINK[family](eta)
        else:
            mu = {"gaussian": F.lit(float(first["m"])), "poisson": target + 0.1, "binomial": (target + 0.5) / 2}[family]
            eta = {"gaussian": mu, "poisson": F.log(mu), "binomial": F.log(mu / (1 - mu))}[family]
        base = rows.select(target.alias("y"), mu.alias("mu"), eta.alias("eta"), *[t.alias(f"t{i}") for i, t in enumerate(z)])
        mu, t = F.col("mu"), [F.col(f"t{i}") for i in range(p)]
        w = _VARIANCE[family](mu)
        working = F.col("eta") + (F.col("y") - mu) / w
        sums = [F.sum(w * t[i] * t[j]).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)]
        sums += [F.sum(w * t[i] * working).alias(f"r{i}") for i in range(p)] + [F.sum(t[i] * (F.col("y") - mu)).alias(f"g{i}") for i in range(p)]
        r = base.agg(*sums, F.sum(w * working * working).alias("zz"), F.sum(_deviance(family, F.col("y"), mu)).alias("dev")).first()
        a = np.zeros((p + 1, p + 1))
        for i in range(p):
            for j in range(i, p):
                a[i, j] = a[j, i] = r[f"x{i}_{j}"]
            a[i, p] = a[p, i] = r[f"r{i}"]
        a[p, p] = r["zz"]
        return a, float(r["dev"]), np.array([r[f"g{i}"] for i in range(p)])

    beta, deviance, converged, done = None, math.inf, False, 0
    while True:
        a, now, score = pass_over(beta)
        converged = beta is not None and abs(now - deviance) <= tolerance * (abs(now) + 1e-3)
        scale = a.diagonal().copy()
        kept = np.array([sweep(a, k, scale) for k in range(p)])
        if converged or done >= steps:
            break
        deviance, done = now, done + 1
        beta = np.where(kept, a[:p, p], 0.0)
    cov = a[:p, :p] * (now / max(n - int(kept.sum()), 1) if family == "gaussian" else 1.0)
    back = np.diag(np.concatenate([[1.0], 1 / size]))
    back[0, 1:] = -mean / size
    cov = np.where(np.outer(kept, kept), cov, 0.0)
    null = _null_deviance(rows, y_, family, float(first["m"]))
    beta = back @ beta
    return Fit(family, ["(intercept)", *xs], np.where(kept, beta, np.nan), np.where(np.outer(kept, kept), back @ cov @ back.T, np.nan), score,
               now, null, n, int(kept.sum()), done, bool(converged))


def _null_deviance(rows: DataFrame, y: str, family: str, mean: float) -> float:
    return float(rows.agg(F.sum(_deviance(family, F.col(y), F.lit(mean)))).first()[0])


def coefficients(spark: SparkSession, fit: Fit) -> DataFrame:
    """Coefficient table of a fit: estimate, standard error, t (linear) or z statistic, p-value, 95 % interval, totals."""
    rows = [(t, *(None if np.isnan(b) else float(v) for v in (b, math.sqrt(max(fit.cov[i, i], 0.0)) if not np.isnan(b) else b)))
            for i, (t, b) in enumerate(zip(fit.terms, fit.beta))]
    t = spark.createDataFrame(rows, "term string, b double, se double").withColumn("df", F.lit(float(fit.n - fit.rank)))
    stat = f"(b / {nz('se')})"
    tail, crit = (D.t_sf2(stat, "df"), D.t_ppf(0.975, "df")) if fit.family == "gaussian" else (D.norm_sf2(stat), repr(D.Z975))
    out = finalize(t, {"coefficient": "b", "std_error": "se", "statistic": stat, "p_value": tail,
                       "ci_low": f"b - {crit} * se", "ci_high": f"b + {crit} * se"}, keep=["term"])
    explained = 1 - fit.deviance / fit.null_deviance if fit.null_deviance else None
    return (out.withColumn("deviance", F.round(F.lit(fit.deviance), 4)).withColumn("explained", F.round(F.lit(explained).cast("double"), 6))
            .withColumn("converged", F.lit(fit.converged)))


def likelihood_ratio(df: DataFrame, y: str, reduced: list[str], extra: list[str], family: str = "binomial") -> DataFrame:
    """Do the ``extra`` terms improve a model of the ``reduced`` ones?  Difference of deviances on the same rows."""
    rows = df.select(y, *reduced, *extra).dropna()
    small, large = glm(rows, y, reduced, family), glm(rows, y, [*reduced, *extra], family)
    one = df.sparkSession.createDataFrame([(float(small.deviance), float(large.deviance), large.rank - small.rank, small.converged and large.converged)],
                                          "d0 double, d1 double, k int, converged boolean")
    chi = "greatest(d0 - d1, 0D)"
    return finalize(one, {"deviance_reduced": "d0", "deviance_full": "d1", "chi2": chi, "df": "k",
                          "p_value": f"CASE WHEN k > 0 THEN {D.chi2_sf(chi, 'k')} END"}).withColumn("converged", F.lit(small.converged and large.converged))


# ---------------------------------------------------------------------------
# Simulated test of a sparse table
# ---------------------------------------------------------------------------
def monte_carlo_chi2(df: DataFrame, a: str, b: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Chi-square of an R x C table against random tables with the same margins.

    The rows give the observed statistic and the two margins.  Replicates are rows of their own, dealt over the tasks; each has a
    generator seeded by its number and draws its table row by row (multivariate hypergeometric), so the result is the same on
    any partitioning, and a task holds one row of one table.  ``p_value`` counts the observed table as one of the
    replicates.  Rows with a null are left out.
    """
    cells = cut_lineage(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o")))
    ra, cb = (cells.groupBy(c).agg(F.sum("o").alias(f"n{c}")) for c in "ab")
    if max(ra.count(), cb.count()) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} levels of a variable")
    rows, columns = ([r[0] for r in t.select(f"n{c}").orderBy(F.desc(f"n{c}")).collect()] for t, c in ((ra, "a"), (cb, "b")))
    n = sum(rows)
    if n >= 10**9:
        raise ValueError("a table of 10**9 rows or more: its chi-square distribution needs no simulation (chi2)")
    observed = (cells.join(F.broadcast(ra), "a").join(F.broadcast(cb), "b")
                .agg(F.coalesce(F.sum(F.col("o") * F.col("o") / (F.col("na") * F.col("nb"))), F.lit(0.0)).alias("s")).first()["s"])
    r_, c_ = np.array(rows, np.int64), np.array(columns, np.int64)

    def draw(batches):
        for batch in batches:
            out = []
            for i in batch["id"]:
                rng, left, s = np.random.default_rng([seed, int(i)]), c_.copy(), 0.0
                for total in r_[:-1]:
                    o = rng.multivariate_hypergeometric(left, total, method="marginals")
                    left -= o
                    s += float(np.sum(o.astype(float) ** 2 / c_)) / float(total)
                out.append(s + (float(np.sum(left.astype(float) ** 2 / c_)) / float(r_[-1]) if len(r_) else 0.0))
            yield pd.DataFrame({"s": out})

    spark = df.sparkSession
    tasks = max(1, min(replicates, 2 * spark.sparkContext.defaultParallelism))
    # as large as observed: within rounding, as equal tables sum in another order
    extreme = F.count_if(F.col("s") >= float(observed) * (1 - 1e-12)).alias("extreme")
    found = spark.range(0, replicates, 1, tasks).mapInPandas(draw, "s double").agg(extreme)
    return found.select(F.lit(n).cast("long").alias("n"), F.lit(len(rows)).cast("long").alias("r"), F.lit(len(columns)).cast("long").alias("c"),
                        F.round(F.lit(float(n * observed - n)), 6).alias("chi2"), F.lit(replicates).cast("long").alias("replicates"), "extreme",
                        F.round((F.col("extreme") + 1) / F.lit(replicates + 1.0), 6).alias("p_value"))
