"""Robust location and scatter (K10) and density clustering without pairs of dense cells.

K10 carries many random starts through concentration steps together: a step is one scan in which
every task sums the moments of its rows per start and bin of distance, so only (starts x bins) rows are
shuffled.  K06 reads neighbourhoods from grids whose cells follow the density.
"""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prudent.operators.graph import connected_components
from prudent.operators.relational import avg_rank
from prudent.session import cut_lineage

#: bins of squared distance per factor of two, and the powers of two that they cover
PER_OCTAVE, OCTAVES = 64, 60


# ---------------------------------------------------------------------------
# Minimum covariance determinant
# ---------------------------------------------------------------------------
def chi2_quantile(p: int, q: float) -> float:
    """Wilson-Hilferty approximation."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * math.sqrt(2 / (9 * p))) ** 3


def _distances(x: np.ndarray, mu: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    d = x - mu
    return np.einsum("ij,jk,ik->i", d, inverse, d)


def _step(z: DataFrame, fits: list[tuple[np.ndarray, np.ndarray]], h: int, p: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Mean and covariance of the rows nearest to each fit: whole bins of distance until ``h`` rows are in."""
    inverses = [(mu, np.linalg.pinv(cov)) for mu, cov in fits]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    names = ["n"] + [f"s{i}" for i in range(p + len(pairs))]

    def sums(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = batch.to_numpy(float)
            moments = np.column_stack([np.ones(len(x)), x] + [x[:, i] * x[:, j] for i, j in pairs])
            for s, (mu, inverse) in enumerate(inverses):
                b = np.floor(np.log2(np.maximum(_distances(x, mu, inverse), 2.0 ** -OCTAVES)) * PER_OCTAVE)
                b = np.clip(b, -OCTAVES * PER_OCTAVE, OCTAVES * PER_OCTAVE).astype(np.int64)
                bins, at = np.unique(b, return_inverse=True)
                for k, column in enumerate(np.array([np.bincount(at, m, len(bins)) for m in moments.T]).T):
                    key = (s, int(bins[k]))
                    total[key] = total[key] + column if key in total else column
        yield pd.DataFrame([(s, b, *v) for (s, b), v in total.items()], columns=["start", "bin", *names]).astype({"start": "int32", "bin": "int64"})

    per = z.mapInPandas(sums, "start int, bin bigint, " + ", ".join(f"{c} double" for c in names)).groupBy("start", "bin").agg(*[F.sum(c).alias(c) for c in names])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    inside = per.withColumn("before", before).where(F.col("before") < h).groupBy("start").agg(*[F.sum(c).alias(c) for c in names])
    out = []
    for r in inside.orderBy("start").collect():  # one row a start
        n, mu = r["n"], np.array([r[f"s{i}"] for i in range(p)]) / r["n"]
        cov = np.zeros((p, p))
        for k, (i, j) in enumerate(pairs):
            cov[i, j] = cov[j, i] = r[f"s{p + k}"] / n - mu[i] * mu[j]
        out.append((r["start"], mu, cov))
    return out


def robust_scatter(df: DataFrame, features: list[str], alpha: float = 0.025, keep: float = 0.75, starts: int = 50, best: int = 10, seed: int = 42) -> DataFrame:
    """Robust Mahalanobis distance from the subset of ``keep`` rows whose covariance has the smallest determinant.

    Each of ``starts`` begins with the mean and covariance of a few rows drawn by a seeded hash; all take two concentration steps (refit on the nearest
    rows) at once, then the ``best`` go on until no determinant falls.  The winner is rescaled to the median of chi-square, and refitted
    on the rows below its 97.5 % point.  Adds ``d2, threshold, is_outlier``; rows with a null feature are left out.  The
    work of a step is one scan, whatever the starts; distances are cut at bins 1 % wide.  A share of up to ``1 - keep`` of the
    rows, wherever they lie, doesn't move the fit.
    """
    p = len(features)
    d = cut_lineage(df.where(" AND ".join(f"`{f}` IS NOT NULL" for f in features)))
    first = d.agg(F.count("*").alias("n"), *[f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n = first["n"]
    if n <= p + 1:
        return d.withColumn("d2", F.lit(None).cast("double")).withColumn("threshold", F.lit(None).cast("double")).withColumn("is_outlier", F.lit(False))
    scale = [(float(first[f"m{i}"]), float(first[f"s{i}"] or 1.0)) for i in range(p)]
    scaled = [((F.col(f"`{c}`") - m) / s).cast("double").alias(f"z{i}") for i, (c, (m, s)) in enumerate(zip(features, scale))]
    z = cut_lineage(d.select(*scaled))
    size = p + 2
    names = [f"z{i}" for i in range(p)]
    drawn = z.withColumn("h", F.xxhash64(F.lit(seed), *names)).orderBy("h", *names).limit(starts * size).collect()  # a few hundred rows
    pool = np.array([[r[c] for c in names] for r in drawn])
    rng = np.random.default_rng(seed)
    fits = []
    for _ in range(starts):
        x = pool[rng.permutation(len(pool))[:size]]
        fits.append((x.mean(0), np.cov(x.T).reshape(p, p) + 1e-9 * np.eye(p)))
    h = max(int(math.ceil(keep * n)), p + 1)
    for _ in range(2):
        fits = [(mu, cov) for _, mu, cov in _step(z, fits, h, p)]
    fits = sorted(fits, key=lambda f: np.linalg.det(f[1]))[:best]
    while True:
        after = sorted(((mu, cov) for _, mu, cov in _step(z, fits, h, p)), key=lambda f: np.linalg.det(f[1]))
        if np.linalg.det(after[0][1]) >= np.linalg.det(fits[0][1]) * (1 - 1e-6):
            break
        fits = after
    mu, cov = fits[0]

    def distance(mu: np.ndarray, inverse: np.ndarray):
        z_ = [(F.col(f"`{c}`") - m) / s - float(mu[i]) for i, (c, (m, s)) in enumerate(zip(features, scale))]
        return sum((float(inverse[i, j]) * z_[i] * z_[j] for i in range(p) for j in range(p)), F.lit(0.0))

    def rescaled(mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
        """Inverse covariance, the median distance that of chi-square."""
        inverse = np.linalg.pinv(cov)
        middle = d.select(F.percentile_approx(distance(mu, inverse), 0.5, 10000)).first()[0]
        return inverse * (chi2_quantile(p, 0.5) / middle) if middle else inverse

    inverse = rescaled(mu, cov)
    near = z.where(sum((float(inverse[i, j]) * (F.col(names[i]) - float(mu[i])) * (F.col(names[j]) - float(mu[j])) for i in range(p) for j in range(p)),
                       F.lit(0.0)) <= chi2_quantile(p, 0.975))
    r = near.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)],
                 *[F.covar_samp(names[i], names[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    if r["n"] > p + 1:
        mu = np.array([r[f"m{i}"] for i in range(p)])
        cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        inverse = rescaled(mu, cov)
    q = chi2_quantile(p, 1 - alpha)
    return d.withColumn("d2", distance(mu, inverse)).withColumn("threshold", F.lit(q)).withColumn("is_outlier", F.col("d2") > q)


# ---------------------------------------------------------------------------
# Distance to the k-th neighbour
# ---------------------------------------------------------------------------
def _around(dim: int, reach: int = 1):
    return F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in itertools.product(range(-reach, reach + 1), repeat=dim)]))


def k_distance(df: DataFrame, id_col: str, features: list[str], k: int) -> DataFrame:
    """Exact distance of every point to its ``k``-th nearest other point (``id, k_dist``; null where there are fewer points).

    Rounds go from fine to coarse grids, the cell twice as wide each time.  A point whose ``k``-th distance within the cells
    around it is no more than a cell's width is done: nothing outside can be nearer.  Only points in sparse places stay for
    wider cells, and few of those can lie near a dense place, so comparisons follow the points, not the square of a dense cell.
    The first width gives the fullest cell about ``8 k`` distinct places.  Equal points are one place with a count.  Rows with
    a null are left out.
    """
    dim = len(features)
    x = [f"x{i}" for i in range(dim)]
    pts = cut_lineage(df.select(F.col(id_col).alias("id"), *[F.col(f).cast("double").alias(c) for f, c in zip(features, x)]).dropna())
    spots = cut_lineage(pts.groupBy(*x).agg(F.count("*").alias("n")).withColumn("spot", F.xxhash64(*x)))
    ends = spots.agg(F.sum("n").alias("n"), *[f(c).alias(f"{p}{c}") for c in x for p, f in (("lo", F.min), ("hi", F.max))]).first()
    total = ends["n"] or 0
    empty = pts.select("id", F.lit(None).cast("double").alias("k_dist"))
    if total <= k:
        return empty.withColumnRenamed("id", id_col)
    extent = max(max(ends[f"hi{c}"] - ends[f"lo{c}"] for c in x), 1e-300)

    def cells(width: float):
        return [F.floor((F.col(c) - float(ends[f"lo{c}"])) / width).cast("bigint").alias(f"c{i}") for i, c in enumerate(x)]

    width = extent
    while width > extent * 2.0 ** -40:
        fullest = spots.groupBy(*cells(width)).count().agg(F.max("count")).first()[0]
        if fullest <= 8 * k + 8:
            break
        width /= 2 if fullest < 64 * k else 4
    left, done = spots, []
    while True:
        gridded = spots.select(*[F.col(c).alias(f"y{i}") for i, c in enumerate(x)], F.col("n").alias("m"), *cells(width))
        probe = left.select("spot", "n", *x, *cells(width), _around(dim).alias("o")).select(
            "spot", "n", *x, *[(F.col(f"c{i}") + F.col("o")[i]).alias(f"c{i}") for i in range(dim)])
        near = probe.join(gridded, [f"c{i}" for i in range(dim)])
        d2 = sum(((F.col(c) - F.col(f"y{i}")) ** 2 for i, c in enumerate(x)), F.lit(0.0))
        # the nearest k + 1 places hold at least k other points; the window keeps no more of a place's candidates
        w = Window.partitionBy("spot").orderBy("d2")
        ranked = near.select("spot", d2.alias("d2"), "m").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
        upto = F.sum("m").over(Window.partitionBy("spot").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)) - 1  # itself left out
        kth = ranked.withColumn("upto", upto).where(F.col("upto") >= k).groupBy("spot").agg(F.sqrt(F.min("d2")).alias("k_dist"))
        sure = cut_lineage(kth.where((F.col("k_dist") <= width) | F.lit(width >= extent)))
        done.append(sure)
        left = cut_lineage(left.join(sure.select("spot"), "spot", "left_anti"))
        if width >= extent or left.isEmpty():
            break
        width *= 2
    found = done[0]
    for f in done[1:]:
        found = found.unionByName(f)
    return (pts.withColumn("spot", F.xxhash64(*x)).join(found, "spot", "left").select(F.col("id").alias(id_col), "k_dist"))


def knee(distances: DataFrame, value: str = "k_dist") -> DataFrame:
    """The point of the ascending curve of ``value`` farthest below the chord between its ends: ``eps, rank, n``.  Ranks come from the library's bucketed ranks."""
    d = distances.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    r = cut_lineage(avg_rank(d, "v", [], out="rank", buckets=None))
    ends = r.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.sum("ties").alias("n")).first()
    if ends["n"] is None:
        return r.sparkSession.createDataFrame([], "eps double, rank double, n long")
    span, wide = (ends["hi"] - ends["lo"]) or 1.0, (ends["last"] - ends["first"]) or 1.0
    below = (F.col("rank") - float(ends["first"])) / float(wide) - (F.col("v") - float(ends["lo"])) / float(span)
    return r.agg(F.max(F.struct(below.alias("below"), (-F.col("rank")).alias("order"), F.col("v"), F.col("rank"))).alias("m")) \
        .select(F.col("m.v").alias("eps"), F.col("m.rank").alias("rank"), F.lit(ends["n"]).cast("long").alias("n"))


# ---------------------------------------------------------------------------
# Density clusters
# ---------------------------------------------------------------------------
def _box(x: list[str]) -> list:
    return [f(c).alias(f"{p}{i}") for i, c in enumerate(x) for p, f in (("lo", F.min), ("hi", F.max))]


def _linked_cells(core: DataFrame, x: list[str], eps: float, side: float, origin: list[float], reach: int) -> DataFrame:
    """Pairs (u, v) of cells, by the smallest core id in each, with core points within ``eps`` of each other.

    Pairs of boxes around the points of a part of each cell are told by their least and greatest distance; those that are neither
    within nor beyond ``eps`` are parted into halves along every axis, until none is left.  Two cells with a part pair within ``eps`` are
    linked, whatever their other parts.
    """
    dim = len(x)
    cell = [f"c{i}" for i in range(dim)]

    def parts(level: int) -> DataFrame:
        sub = [F.floor((F.col(c) - origin[i]) / (side / 2 ** level)).cast("bigint").alias(f"p{i}") for i, c in enumerate(x)]
        return core.select("rep", *cell, *x, *sub).groupBy("rep", *cell, *[f"p{i}" for i in range(dim)]).agg(*_box(x))

    def told(pairs: DataFrame) -> DataFrame:
        gap = [F.greatest(F.col(f"blo{i}") - F.col(f"ahi{i}"), F.col(f"alo{i}") - F.col(f"bhi{i}"), F.lit(0.0)) for i in range(dim)]
        far = [F.greatest(F.abs(F.col(f"bhi{i}") - F.col(f"alo{i}")), F.abs(F.col(f"ahi{i}") - F.col(f"blo{i}"))) for i in range(dim)]
        return pairs.withColumn("near", sum((g * g for g in gap), F.lit(0.0))).withColumn("far", sum((g * g for g in far), F.lit(0.0))).where(F.col("near") <= eps * eps)

    def side_of(p: DataFrame, s: str) -> DataFrame:
        return p.select(*[F.col(c).alias(f"{s}{c}") for c in p.columns])

    whole = parts(0)
    probe = whole.select("*", _around(dim, reach).alias("o"))
    probe = probe.select(*[F.col(c).alias(f"a{c}") for c in whole.columns], *[(F.col(f"c{i}") + F.col("o")[i]).alias(f"bc{i}") for i in range(dim)])
    pairs = told(probe.join(side_of(whole, "b"), [f"bc{i}" for i in range(dim)]).where("arep < brep"))
    links, level = [], 0
    while True:
        pairs = cut_lineage(pairs)
        links.append(cut_lineage(pairs.where(F.col("far") <= eps * eps).select(F.col("arep").alias("u"), F.col("brep").alias("v")).distinct()))
        open_ = pairs.where(F.col("far") > eps * eps).join(links[-1], (F.col("arep") == F.col("u")) & (F.col("brep") == F.col("v")), "left_anti")
        open_ = cut_lineage(open_.select("arep", "brep", *[f"{s}p{i}" for s in "ab" for i in range(dim)]))
        if open_.isEmpty():
            break
        level += 1
        finer = parts(level).drop(*cell)
        a, b = side_of(finer, "a"), side_of(finer, "b")

        def up(s: str) -> list:
            return [F.floor(F.col(f"{s}p{i}") / 2).cast("bigint").alias(f"{s}q{i}") for i in range(dim)]

        o = open_.select("arep", "brep", *[F.col(f"{s}p{i}").alias(f"{s}q{i}") for s in "ab" for i in range(dim)])
        j = o.join(a.select("*", *up("a")), ["arep", *[f"aq{i}" for i in range(dim)]]).join(b.select("*", *up("b")), ["brep", *[f"bq{i}" for i in range(dim)]])
        pairs = told(j.select(*a.columns, *b.columns))
    out = links[0]
    for f in links[1:]:
        out = out.unionByName(f)
    return out


def density_clusters(df: DataFrame, id_col: str, features: list[str], eps: float, min_pts: int) -> DataFrame:
    """DBSCAN, ``id, cluster, kind`` (core, border, noise; a cluster is named by its smallest core id).

    Cells are so small that two points of one cell are always within ``eps``: all points of a cell of ``min_pts`` or more are core and of one
    cluster, without a comparison.  Only points of emptier cells, fewer than ``min_pts`` each, count their neighbours in the cells around,
    so rows and comparisons follow the points, not the square of a dense place.  Cells are linked by boxes (``_linked_cells``), never
    by pairs of their points.  A border point takes the smallest cluster among core points within ``eps``.  Rows with a null feature or id
    are noise.
    """
    dim = len(features)
    x, cell = [f"x{i}" for i in range(dim)], [f"c{i}" for i in range(dim)]
    side, reach = eps / math.sqrt(dim) * (1 - 1e-9), math.ceil(math.sqrt(dim))
    rows = df.select(F.col(id_col).alias("id"), *[F.col(f).cast("double").alias(c) for f, c in zip(features, x)])
    known = rows.dropna()
    ends = known.agg(*[F.min(c).alias(c) for c in x]).first()
    origin = [float(ends[c] or 0.0) for c in x]
    pts = known.select("*", *[F.floor((F.col(c) - o) / side).cast("bigint").alias(k) for c, k, o in zip(x, cell, origin)])
    counts = pts.groupBy(*cell).agg(F.count("*").alias("n_cell"))
    pts = cut_lineage(pts.join(counts, cell))

    def near(some: DataFrame, others: DataFrame) -> DataFrame:
        """Rows of ``some`` with every point of ``others`` within ``eps`` (its columns under names that begin with o_)."""
        probe = some.select("*", _around(dim, reach).alias("o")).select(*some.columns, *[(F.col(c) + F.col("o")[i]).alias(f"o_{c}") for i, c in enumerate(cell)])
        j = probe.join(others.select(*[F.col(c).alias(f"o_{c}") for c in others.columns]), [f"o_{c}" for c in cell])
        return j.where(sum(((F.col(c) - F.col(f"o_{c}")) ** 2 for c in x), F.lit(0.0)) <= eps * eps)

    sparse = pts.where(F.col("n_cell") < min_pts)
    full = cut_lineage(near(sparse, pts.select("id", *x, *cell)).groupBy("id").agg(F.count("*").alias("deg")).where(F.col("deg") >= min_pts).select("id"))
    core = pts.where(F.col("n_cell") >= min_pts).unionByName(sparse.join(full, "id", "left_semi")).select("id", *x, *cell)
    reps = core.groupBy(*cell).agg(F.min("id").alias("rep"))
    core = cut_lineage(core.join(reps, cell))
    links = cut_lineage(_linked_cells(core, x, eps, side, origin, reach))
    parts = connected_components(links, "u", "v")
    core = cut_lineage(core.join(parts, F.col("rep") == F.col("node"), "left").withColumn("cluster", F.coalesce("component", "rep")).select("id", *x, *cell, "cluster"))
    rest = sparse.join(full, "id", "left_anti")
    border = near(rest.select("id", *x, *cell), core).groupBy("id").agg(F.min("o_cluster").alias("cluster"))
    named = core.select("id", "cluster", F.lit("core").alias("kind")).unionByName(border.select("id", "cluster", F.lit("border").alias("kind")))
    out = rows.select("id").join(named, "id", "left")
    return out.select(F.col("id").alias(id_col), "cluster", F.coalesce("kind", F.lit("noise")).alias("kind"))
