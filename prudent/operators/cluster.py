"""Clustering, multivariate outliers and reduction (inventory family K).

Model fitting is MLlib (distributed k-means, bisecting k-means, Gaussian
mixtures, PCA, scalers).  Everything that needs only aggregates (cluster
profiles, adjusted Rand index, conditional scores) is plain DataFrame code.
Per-tree / per-series work (isolation forest, DTW assignment) runs in pandas
functions over bounded inputs with broadcast model state.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from prudent.functions.scalar import safe_div
from prudent.session import cut_lineage


def prepare(df: DataFrame, features: list[str], scale: str = "standard", out: str = "features",
            center: bool = True) -> DataFrame:
    """Assemble and scale (z-score, or median/IQR for skewed data).
    ``center=False`` keeps the origin (bisecting k-means splits by a relative
    perturbation of the centre, which is zero on centred data)."""
    va = VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip")
    d = va.transform(df)
    sc = (StandardScaler(inputCol="__raw", outputCol=out, withMean=center, withStd=True) if scale == "standard"
          else RobustScaler(inputCol="__raw", outputCol=out, withCentering=center, withScaling=True))
    return sc.fit(d).transform(d).drop("__raw")


#: fits of a sweep that run at a time: a fit is a row of short jobs that leave most cores idle
FITS = 12


#: rows in a task of a fit, and tasks below which partitions are left as they are
FIT_ROWS, FIT_TASKS = 20_000, 16


def _kept(df: DataFrame) -> DataFrame:
    """Rows kept for many passes, in partitions by their number: a cached table keeps every shuffle partition, and a pass of a fit
    over 200 of a few hundred rows each spends its time on starting tasks.  More of them are put together, fewer stay as they are."""
    first = df.cache()
    tasks = max(FIT_TASKS, -(-first.count() // FIT_ROWS))
    if first.rdd.getNumPartitions() <= tasks:
        return first
    d = first.coalesce(tasks).cache()
    d.count()
    first.unpersist()
    return d


def _at_once(spark, calls: list) -> list:
    """Results of calls that each run their own Spark jobs, some at a time (as ``parallelism`` of a cross validator)."""
    with ThreadPoolExecutor(min(FITS, len(calls))) as pool:
        return [r.result() for r in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]


def kmeans_sweep(df: DataFrame, ks=range(2, 11), seed: int = 42, features: str = "features") -> DataFrame:
    """K-means for each k: silhouette, within-cluster cost (elbow) and
    the gap statistic against uniform reference sets drawn in the bounding
    box (seeded hashes, three references)."""
    ev = ClusteringEvaluator(featuresCol=features, predictionCol="cluster", metricName="silhouette")
    d = _kept(df.select(features))
    arr = d.select(vector_to_array(features).alias("a"))
    dim = len(arr.first()["a"])
    bounds = arr.select(*[F.min(F.col("a")[i]).alias(f"lo{i}") for i in range(dim)],
                        *[F.max(F.col("a")[i]).alias(f"hi{i}") for i in range(dim)]).first()
    refs = []
    for b in range(3):
        cols = [(F.lit(bounds[f"lo{i}"]) + (F.abs(F.xxhash64(F.monotonically_increasing_id(), F.lit(b), F.lit(i),
                                                              F.lit(seed))) % 1000003) / 1000003.0
                 * F.lit(bounds[f"hi{i}"] - bounds[f"lo{i}"])).alias(f"x{i}") for i in range(dim)]
        r = VectorAssembler(inputCols=[f"x{i}" for i in range(dim)], outputCol=features).transform(arr.select(*cols))
        refs.append(r.select(features).cache())
    for r in refs:
        r.count()  # kept before the fits share it

    def fit(k):
        m = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(d)
        return float(ev.evaluate(m.transform(d))), float(m.summary.trainingCost)

    def ref_cost(k, r):
        return KMeans(k=k, seed=seed, featuresCol=features).fit(r).summary.trainingCost

    ks = list(ks)
    # the largest first: they take longest
    order = sorted(ks, reverse=True)
    got = _at_once(df.sparkSession, [partial(fit, k) for k in order] + [partial(ref_cost, k, r) for k in order for r in refs])
    rows = []
    for k in ks:
        i = order.index(k)
        sil, cost = got[i]
        ref_costs = got[len(ks) + i * len(refs):len(ks) + (i + 1) * len(refs)]
        gap = float(np.mean([math.log(max(c, 1e-300)) for c in ref_costs]) - math.log(max(cost, 1e-300)))
        rows.append((k, sil, cost, gap))
    d.unpersist()
    for r in refs:
        r.unpersist()
    out = df.sparkSession.createDataFrame(rows, "k int, silhouette double, cost double, gap double")
    return out.withColumn("acceptable", F.col("silhouette") >= 0.25)


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from contingency counts."""
    c = df.groupBy(a, b).agg(F.count("*").alias("nij"))
    choose2 = lambda x: x * (x - 1) / 2.0
    sij = c.select(F.sum(choose2(F.col("nij")))).scalar()
    sa = c.groupBy(a).agg(F.sum("nij").alias("n")).select(F.sum(choose2(F.col("n")))).scalar()
    sb = c.groupBy(b).agg(F.sum("nij").alias("n")).select(F.sum(choose2(F.col("n")))).scalar()
    n = c.select(F.sum("nij")).scalar()
    exp = sa * sb / choose2(n)
    ari = safe_div(sij - exp, (sa + sb) / 2.0 - exp)
    return df.sparkSession.range(1).select(n.alias("n"), ari.alias("ari"))


def hierarchical(df: DataFrame, k: int, seed: int = 42, features: str = "features") -> DataFrame:
    """Divisive hierarchical clustering (bisecting k-means)."""
    m = BisectingKMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)
    return m.transform(df)


def gmm_sweep(df: DataFrame, ks=range(2, 7), seed: int = 42, features: str = "features") -> DataFrame:
    """Gaussian mixtures by BIC = -2 logL + p ln n (full covariances)."""
    d = _kept(df.select(features))
    n = d.count()
    dim = len(d.first()[features])

    def fit(k):
        return GaussianMixture(k=k, seed=seed, featuresCol=features).fit(d).summary.logLikelihood

    rows = []
    ks = list(ks)
    for k, ll in zip(ks, _at_once(df.sparkSession, [partial(fit, k) for k in ks])):
        p = k * (dim + dim * (dim + 1) / 2) + (k - 1)
        rows.append((k, float(ll), float(-2 * ll + p * math.log(n))))
    d.unpersist()
    out = df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double")
    return out.withColumn("best", F.col("bic") == F.min("bic").over(Window.partitionBy(F.lit(1))))


def characterise(df: DataFrame, cluster: str, features: list[str], tiny: float = 0.05) -> DataFrame:
    """Size, share, centroid and standardised feature differences vs
    the population; tiny clusters flagged."""
    pop = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_samp(f).alias(f"s_{f}") for f in features],
                 F.count("*").alias("N"))
    g = df.groupBy(cluster).agg(F.count("*").alias("size"), *[F.avg(f).alias(f"c_{f}") for f in features])
    scal = {c: pop.select(c).scalar() for c in pop.columns}
    out = g.select(cluster, "size", (F.col("size") / scal["N"]).alias("share"),
                   *[F.col(f"c_{f}").alias(f"centroid_{f}") for f in features],
                   *[safe_div(F.col(f"c_{f}") - scal[f"m_{f}"], scal[f"s_{f}"]).alias(f"effect_{f}") for f in features])
    return out.withColumn("tiny", F.col("share") < tiny)


def mahalanobis(df: DataFrame, features: list[str], alpha: float = 0.025, keep: float = 0.75,
                id_col: str | None = None) -> DataFrame:
    """Robust Mahalanobis distance.  Start from the mean / covariance,
    then C-steps (refit on the ``keep`` share with the smallest distances) as
    an MCD-style reweighting; flag d^2 above the chi-square quantile
    (Wilson-Hilferty approximation) with p degrees of freedom.  Each step is
    one aggregate of p + p(p+1)/2 sums; the p x p inverse is driver-side."""
    p = len(features)
    d = df.where(F.expr(" AND ".join(f"{f} IS NOT NULL" for f in features)))

    def fit(frame):
        aggs = [F.avg(f).alias(f"m{i}") for i, f in enumerate(features)]
        aggs += [F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(features)
                 for j, b in enumerate(features) if j >= i]
        r = frame.agg(*aggs).first()
        mu = np.array([r[f"m{i}"] for i in range(p)])
        cov = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        return mu, np.linalg.pinv(cov)

    def dist_col(mu, inv):
        terms = []
        for i in range(p):
            for j in range(p):
                if inv[i, j] != 0:
                    terms.append(F.lit(float(inv[i, j])) * (F.col(features[i]) - float(mu[i]))
                                 * (F.col(features[j]) - float(mu[j])))
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    d = cut_lineage(d)  # read in every step
    mu, inv = fit(d)
    seen: list[tuple] = []
    while (mark := tuple(float(f"{v:.9g}") for v in [*mu, *inv.ravel()])) not in seen:
        seen.append(mark)
        scored = d.withColumn("__d2", dist_col(mu, inv))
        cut = scored.select(F.percentile_approx("__d2", keep, 10000)).first()[0]
        mu, inv = fit(scored.where(F.col("__d2") <= cut))
    # consistency: rescale so the median distance matches the chi-square median
    med = d.select(F.percentile_approx(dist_col(mu, inv), 0.5, 10000)).first()[0]
    chi_med = p * (1 - 2 / (9 * p)) ** 3
    if med and med > 0:
        inv = inv * (chi_med / med)
    from statistics import NormalDist
    z = NormalDist().inv_cdf(1 - alpha)
    q = p * (1 - 2 / (9 * p) + z * math.sqrt(2 / (9 * p))) ** 3
    out = d.withColumn("d2", dist_col(mu, inv)).withColumn("is_outlier", F.col("d2") > q)
    return out.withColumn("threshold", F.lit(q))


def conditional_outliers(df: DataFrame, value: str, given: list[str], z: float = 3.0) -> DataFrame:
    """Cohort-relative score (value vs its group's mean / sd).  Group
    moments are aggregated and joined back, so no task holds a whole group."""
    st = df.groupBy(*given).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    st = st.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(given)], "__m", "__s")
    on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(given)]
    d = df.join(st, on, "left").withColumn("score", safe_div(F.col(value) - F.col("__m"), F.col("__s")))
    return d.drop("__m", "__s", *[f"__g{i}" for i in range(len(given))]).withColumn("is_outlier", F.abs("score") > z)


def model_outliers(df: DataFrame, value: str, control: str, given: list[str], z: float = 3.0) -> DataFrame:
    """Studentised residual of ``value`` from its group's regression on ``control``, flagged beyond ``z``.

    The sums of each group's regression are one aggregate, joined back; a residual is divided by its own standard error, which
    grows less with the row's leverage.  Rows with a null and groups of fewer than three rows have no score.
    """
    st = df.groupBy(*given).agg(F.regr_count(value, control).alias("__n"), F.regr_sxx(value, control).alias("__sxx"), F.regr_sxy(value, control).alias("__sxy"),
                                F.regr_syy(value, control).alias("__syy"), F.regr_avgx(value, control).alias("__mx"), F.regr_avgy(value, control).alias("__my"))
    st = st.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(given)], *[c for c in st.columns if c not in given])
    d = df.join(st, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(given)], "left")
    slope = safe_div("__sxy", "__sxx")
    off = F.col(control) - F.col("__mx")
    resid = F.col(value) - F.col("__my") - slope * off
    variance = safe_div(F.greatest(F.col("__syy") - slope * F.col("__sxy"), F.lit(0.0)), F.col("__n") - 2)
    lever = 1 / F.col("__n") + safe_div(off * off, F.col("__sxx"))
    d = d.withColumn("score", F.when(F.col("__n") > 2, safe_div(resid, F.sqrt(variance * F.greatest(1 - lever, F.lit(0.0))))))
    return d.drop(*st.columns).withColumn("is_outlier", F.abs("score") > z)


def pca(df: DataFrame, k: int, features: str = "features") -> DataFrame:
    """Principal components: explained variance per component and the
    loadings (feature x component)."""
    m = PCA(k=k, inputCol=features, outputCol="__pc").fit(df)
    ev = [float(x) for x in m.explainedVariance]
    load = m.pc.toArray()
    rows = [(j + 1, i, float(load[i, j]), ev[j]) for j in range(k) for i in range(load.shape[0])]
    return df.sparkSession.createDataFrame(rows, "component int, feature int, loading double, explained_variance double")


# -- isolation forest -------------------------------------------------------
def _c_factor(n: float) -> float:
    if n <= 1:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int):
    if depth >= limit or len(x) <= 1:
        return ("leaf", len(x))
    spread = x.max(axis=0) - x.min(axis=0)
    cand = np.flatnonzero(spread > 0)
    if len(cand) == 0:
        return ("leaf", len(x))
    f = int(rng.choice(cand))
    s = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < s
    return ("node", f, s, _grow(x[left], rng, depth + 1, limit), _grow(x[~left], rng, depth + 1, limit))


def _path_lengths(tree, x: np.ndarray) -> np.ndarray:
    """Path length of every row of a batch: a node splits the row numbers that reach it."""
    out = np.empty(len(x))
    stack = [(tree, np.arange(len(x)), 0)]
    while stack:
        node, at, depth = stack.pop()
        if node[0] == "leaf":
            out[at] = depth + _c_factor(node[1])
        elif len(at):
            _, f, cut, left, right = node
            low = x[at, f] < cut
            stack += [(left, at[low], depth + 1), (right, at[~low], depth + 1)]
    return out


def isolation_forest(df: DataFrame, features: list[str], id_col: str, trees: int = 200, sample: int = 256,
                     share: float = 0.05, seed: int = 42) -> DataFrame:
    """Isolation forest.  Each tree's subsample is the ``sample`` rows
    with the smallest seeded hash for that tree (a per-tree top-k, done by a
    window per tree over the hashed candidates), trees are grown in pandas per
    tree id, collected (``trees`` small structures), broadcast, and every row
    is scored in ``mapInPandas``; the top ``share`` by score is flagged."""
    spark = df.sparkSession
    d = df.select(id_col, *[F.col(f).cast("double").alias(f) for f in features]).na.drop()
    n = d.count()
    modulus = 1 << 30
    keep_below = min(modulus, int(modulus * min(1.0, 8.0 * sample / max(n, 1))) + 1)
    tid = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    # rank key per (row, tree); a map-side filter keeps ~8x the subsample so
    # the per-tree window only sorts a few thousand survivors
    h = d.select("*", tid).withColumn("__h", F.pmod(F.xxhash64(F.col(id_col), F.col("tree"), F.lit(seed)),
                                                    F.lit(modulus))).where(F.col("__h") < keep_below)
    samp = h.withColumn("__r", F.row_number().over(Window.partitionBy("tree").orderBy("__h", id_col))) \
        .where(F.col("__r") <= sample)
    limit = int(math.ceil(math.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100003 + t)
        tree = _grow(pdf[features].to_numpy(), rng, 0, limit)
        import pickle
        return pd.DataFrame({"tree": [t], "blob": [pickle.dumps(tree)]})

    forest = samp.groupBy("tree").applyInPandas(grow, "tree int, blob binary").collect()
    import pickle
    bc = spark.sparkContext.broadcast([pickle.loads(r["blob"]) for r in forest])
    cn = _c_factor(sample)

    def score(it):
        ts = bc.value
        for pdf in it:
            x = pdf[features].to_numpy()
            pl = sum((_path_lengths(t, x) for t in ts), np.zeros(len(x))) / len(ts)
            pdf = pdf[[id_col]].copy()
            pdf["score"] = np.power(2.0, -pl / cn)
            yield pdf

    # kept, as the cut-off and the result both read the scores
    sc = cut_lineage(d.mapInPandas(score, f"{id_col} {d.schema[id_col].dataType.simpleString()}, score double"))
    cut = sc.select(F.percentile_approx("score", 1 - share, 10000)).first()[0]
    return sc.withColumn("is_outlier", F.col("score") >= F.lit(cut))


def kprototypes(df: DataFrame, num: list[str], cat: list[str], k: int, seed: int = 42,
                gamma: float | None = None) -> DataFrame:
    """K-prototypes for mixed data.  Distance = squared numeric distance
    + gamma x categorical mismatches; prototypes (k rows) are recomputed as
    means and modes by one ``groupBy`` per pass and carried as literals, until
    they stay as they are (the total distance falls in every pass, so they do).
    The input is materialised once; a pass reads it and nothing before it."""
    d = cut_lineage(df.select(*num, *cat))
    if gamma is None:
        gamma = float(np.mean([v or 0.0 for v in d.select(*[F.stddev_samp(c) for c in num]).first()])) or 1.0
    init = d.withColumn("__h", F.xxhash64(*[F.col(c) for c in num + cat], F.lit(seed))).orderBy("__h").limit(k).collect()
    protos = [([float(r[c]) for c in num], [r[c] for c in cat]) for r in init]
    seen = []
    while True:
        dists = []
        for pn, pc in protos:
            e = sum(((F.col(c) - v) ** 2 for c, v in zip(num, pn)), F.lit(0.0))
            e = e + gamma * sum(((F.col(c) != F.lit(v)).cast("double") for c, v in zip(cat, pc)), F.lit(0.0))
            dists.append(e)
        arr = F.array(*[F.struct(dd.alias("d"), F.lit(i).alias("i")) for i, dd in enumerate(dists)])
        cur = d.withColumn("cluster", F.array_min(arr)["i"])
        got = {r["cluster"]: r for r in cur.groupBy("cluster").agg(
            *[F.avg(c).alias(f"n{i}") for i, c in enumerate(num)],
            *[F.mode(c, True).alias(f"c{i}") for i, c in enumerate(cat)]).collect()}  # k rows
        protos = [([float(got[g][f"n{i}"]) for i in range(len(num))], [got[g][f"c{i}"] for i in range(len(cat))]) if g in got else old
                  for g, old in enumerate(protos)]
        mark = tuple((tuple(float(f"{v:.9g}") for v in pn), tuple(pc)) for pn, pc in protos)
        if mark in seen:
            return cur
        seen.append(mark)


def dtw_kmeans(series: DataFrame, key: str, k: int = 3, band: int = 5, seed: int = 42) -> DataFrame:
    """Shape clustering of series under DTW (Sakoe-Chiba band, along the
    scaled diagonal and never narrower than the difference of two lengths):
    each series is assigned to the nearest of k centroid series (k x n
    distances per pass, never n x n), centroids are the element-wise means of
    members; passes go on until the centroids repeat; series are arrays of
    bounded length (periods)."""
    s = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("__a")) \
        .select(key, F.col("__a.y").alias("y"))
    cents = [np.array(r["y"], dtype=float) for r in
             s.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).orderBy("__h").limit(k).collect()]

    def dtw(a, b):
        n, m = len(a), len(b)
        wide = max(band, abs(n - m))
        cost = (np.asarray(a, dtype=float)[:, None] - np.asarray(b, dtype=float)[None, :]) ** 2
        prev = np.full(m + 1, np.inf)
        prev[0] = 0.0
        for i in range(1, n + 1):
            middle = i * m / n
            lo, hi = max(1, math.ceil(middle - wide)), min(m, math.floor(middle + wide))
            cur = np.full(m + 1, np.inf)
            best = np.minimum(prev[lo:hi + 1], prev[lo - 1:hi])
            left = np.inf
            for j, (c, up) in enumerate(zip(cost[i - 1, lo - 1:hi].tolist(), best.tolist()), start=lo):
                left = c + min(left, up)
                cur[j] = left
            prev = cur
        return float(np.sqrt(prev[m]))

    seen = []
    while True:
        bc = series.sparkSession.sparkContext.broadcast(cents)

        def assign(it):
            cs = bc.value
            for pdf in it:
                lab = [int(np.argmin([dtw(np.asarray(y, dtype=float), c) for c in cs])) for y in pdf["y"]]
                pdf = pdf.assign(cluster=lab)
                yield pdf
        out = s.mapInPandas(assign, f"{key} {s.schema[key].dataType.simpleString()}, y array<double>, cluster int")
        mean = out.select("cluster", F.posexplode("y").alias("i", "v")).groupBy("cluster", "i").agg(F.avg("v").alias("v"))
        got = {}
        for r in mean.collect():
            got.setdefault(r["cluster"], {})[r["i"]] = r["v"]
        cents = [np.array([got[c][i] for i in sorted(got[c])]) if c in got else cents[c] for c in range(k)]
        # rounded, as the order of a distributed mean may change its last bits
        mark = tuple(tuple(float(f"{v:.9g}") for v in c) for c in cents)
        if mark in seen:
            return out.drop("y")
        seen.append(mark)
