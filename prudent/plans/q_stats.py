"""Statistical-test queries (X family).  Oracles re-derive the sufficient
statistics in DuckDB SQL and share only the formula layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from prudent.functions.dist import DUCK
from prudent.operators import stats as X
from prudent.operators.stats import finalize_sql as fin
from prudent.plans.q_models import ols_sql
from prudent.plans.q_window import NATION_WEEKLY_SQL, SEGMENT_WEEKLY_SQL, nation_weekly, segment_weekly
from prudent.plans.registry import Tables, query


def _rank_sql(table: str, value: str, by: list[str], out: str = "rk") -> str:
    """Average ranks with ties by window functions (oracle side)."""
    pb = f"PARTITION BY {', '.join(by)}" if by else ""
    pbv = f"PARTITION BY {', '.join(by + [value])}"
    return (f"rank() OVER ({pb} ORDER BY {value}) + (count(*) OVER ({pbv}) - 1) / 2.0 AS {out}")


def _ties_sql(table: str, value: str, by: list[str]) -> str:
    g = ", ".join(by + [value])
    sel = ", ".join(by) + ", " if by else ""
    gb = f"GROUP BY {', '.join(by)}" if by else ""
    return (f"SELECT {sel}sum(pow(t, 3) - t) AS tie_term FROM (SELECT {g}, count(*) AS t FROM {table} GROUP BY {g}) {gb}")


# -- correlations ----------------------------------------------------------
@query("x01_pearson", fin("""SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS r
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1""",
                          X.corr_exprs(DUCK), ["l_returnflag"]))
def pearson(spark, sf):
    return X.pearson(Tables(spark, sf).lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


@query("x02_spearman", fin(f"""
WITH d AS (SELECT l_linestatus, l_discount, l_tax FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL),
 r AS (SELECT l_linestatus, {_rank_sql('d', 'l_discount', ['l_linestatus'], 'rx')},
              {_rank_sql('d', 'l_tax', ['l_linestatus'], 'ry')} FROM d)
SELECT l_linestatus, count(*) AS n, corr(rx, ry) AS r FROM r GROUP BY 1""", X.corr_exprs(DUCK), ["l_linestatus"]))
def spearman(spark, sf):
    return X.spearman(Tables(spark, sf).lineitem, "l_discount", "l_tax", "l_linestatus")


@query("x04_point_biserial", fin("""
SELECT l_linestatus, count(*) AS n, corr(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END, l_extendedprice) AS r
FROM lineitem GROUP BY 1""", X.corr_exprs(DUCK), ["l_linestatus"]))
def point_biserial(spark, sf):
    li = Tables(spark, sf).lineitem.withColumn("ret", (F.col("l_returnflag") == "R").cast("double"))
    return X.pearson(li, "ret", "l_extendedprice", "l_linestatus")


@query("x04_phi", fin("""
SELECT count(*) AS n, corr(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END,
                           CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END) AS r FROM lineitem""",
                      X.corr_exprs(DUCK)))
def phi(spark, sf):
    li = Tables(spark, sf).lineitem.withColumn("ret", (F.col("l_returnflag") == "R").cast("double")) \
        .withColumn("disc", (F.col("l_discount") >= 0.05).cast("double"))
    return X.pearson(li, "ret", "disc")


@query("x05_mutual_info", """
WITH w AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y,
                  min(l_quantity) OVER (PARTITION BY l_returnflag) AS lx, max(l_quantity) OVER (PARTITION BY l_returnflag) AS hx,
                  min(l_extendedprice) OVER (PARTITION BY l_returnflag) AS ly, max(l_extendedprice) OVER (PARTITION BY l_returnflag) AS hy
           FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
 b AS (SELECT l_returnflag, CAST(least(9, floor(coalesce((x - lx) / nullif(hx - lx, 0), 0.0) * 10)) AS INTEGER) AS bx,
              CAST(least(9, floor(coalesce((y - ly) / nullif(hy - ly, 0), 0.0) * 10)) AS INTEGER) AS by_ FROM w),
 j AS (SELECT l_returnflag, bx, by_, count(*) AS nxy FROM b GROUP BY 1, 2, 3),
 j2 AS (SELECT *, sum(nxy) OVER (PARTITION BY l_returnflag) AS n, sum(nxy) OVER (PARTITION BY l_returnflag, bx) AS nx,
               sum(nxy) OVER (PARTITION BY l_returnflag, by_) AS ny FROM j),
 mi AS (SELECT l_returnflag, sum(nxy / n * ln(nxy * n / (nx * ny))) AS mi, first(n) AS n FROM j2 GROUP BY 1),
 hx AS (SELECT l_returnflag, -sum(c / n * ln(c / n)) AS hx FROM (SELECT DISTINCT l_returnflag, bx, nx AS c, n FROM j2) GROUP BY 1),
 hy AS (SELECT l_returnflag, -sum(c / n * ln(c / n)) AS hy FROM (SELECT DISTINCT l_returnflag, by_, ny AS c, n FROM j2) GROUP BY 1)
SELECT mi.l_returnflag, round(CAST(n AS DOUBLE), 6) AS n, round(mi, 6) AS mi, round(mi / nullif(sqrt(hx * hy), 0), 6) AS nmi
FROM mi JOIN hx USING (l_returnflag) JOIN hy USING (l_returnflag)""")
def mutual_info(spark, sf):
    return X.mutual_info(Tables(spark, sf).lineitem, "l_quantity", "l_extendedprice", 10, "l_returnflag")


_PARTIAL = X.corr_exprs(DUCK, k_controls=1)
_PARTIAL["raw_r"] = "rxy"


@query("x06_partial_corr", fin("""
SELECT l_returnflag, n, rxy, (rxy - rxz * ryz) / sqrt(nullif((1 - rxz * rxz) * (1 - ryz * ryz), 0)) AS r FROM (
  SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS rxy, corr(l_quantity, l_discount) AS rxz,
         corr(l_extendedprice, l_discount) AS ryz FROM lineitem GROUP BY 1)""", _PARTIAL, ["l_returnflag"]))
def partial(spark, sf):
    return X.partial_corr(Tables(spark, sf).lineitem, "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")


@query("x33_steiger", fin("""
SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS rxy, corr(l_quantity, l_tax) AS rxz,
       corr(l_extendedprice, l_tax) AS ryz FROM lineitem GROUP BY 1""", X.steiger_exprs(DUCK), ["l_returnflag"]))
def steiger(spark, sf):
    return X.steiger(Tables(spark, sf).lineitem, "l_quantity", "l_extendedprice", "l_tax", "l_returnflag")


# -- two groups ------------------------------------------------------------
_WELCH_SUFF = """SELECT max(CASE WHEN o_orderstatus = 'F' THEN n END) AS n1, max(CASE WHEN o_orderstatus = 'F' THEN m END) AS m1,
       max(CASE WHEN o_orderstatus = 'F' THEN v END) AS v1, max(CASE WHEN o_orderstatus = 'O' THEN n END) AS n2,
       max(CASE WHEN o_orderstatus = 'O' THEN m END) AS m2, max(CASE WHEN o_orderstatus = 'O' THEN v END) AS v2
FROM (SELECT o_orderstatus, count(o_totalprice) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v
      FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice IS NOT NULL GROUP BY 1)"""


@query("x07_welch_t", fin(_WELCH_SUFF, X.welch_exprs(DUCK)))
def welch(spark, sf):
    return X.welch_t(Tables(spark, sf).orders, "o_totalprice", "o_orderstatus", "F", "O")


def _pairs(t: Tables):
    o = t.orders
    return o.groupBy("o_custkey").agg(
        F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("a"),
        F.avg(F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice"))).alias("b")) \
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())


_PAIRS_SQL = """p AS (SELECT o_custkey, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS a,
                  avg(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END) AS b FROM orders GROUP BY 1
           HAVING a IS NOT NULL AND b IS NOT NULL)"""


@query("x08_paired_t", fin(f"""WITH {_PAIRS_SQL}
SELECT count(*) AS n, avg(a - b) AS md, stddev_samp(a - b) AS sd FROM p""", X.paired_exprs(DUCK)))
def paired(spark, sf):
    return X.paired_t(_pairs(Tables(spark, sf)), "a", "b")


@query("x09_mann_whitney", fin(f"""
WITH d AS (SELECT o_orderstatus AS g, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice IS NOT NULL),
 r AS (SELECT g, v, {_rank_sql('d', 'v', [], 'rk')} FROM d),
 tt AS ({_ties_sql('d', 'v', [])})
SELECT count_if(g = 'F') AS n1, count_if(g = 'O') AS n2, sum(CASE WHEN g = 'F' THEN rk END) AS r1,
       avg(CASE WHEN g = 'F' THEN v END) AS m1, avg(CASE WHEN g = 'O' THEN v END) AS m2,
       stddev_samp(CASE WHEN g = 'O' THEN v END) AS sd2, (SELECT tie_term FROM tt) AS tie_term FROM r""",
                                   X.mann_whitney_exprs(DUCK)))
def mann_whitney(spark, sf):
    return X.mann_whitney(Tables(spark, sf).orders, "o_totalprice", "o_orderstatus", "F", "O")


@query("x10_wilcoxon", fin(f"""WITH {_PAIRS_SQL},
 d AS (SELECT a - b AS dd, abs(a - b) AS ad FROM p WHERE a - b <> 0),
 r AS (SELECT dd, {_rank_sql('d', 'ad', [], 'rk')} FROM d),
 tt AS ({_ties_sql('d', 'ad', [])})
SELECT count(*) AS n, sum(CASE WHEN dd > 0 THEN rk ELSE 0 END) AS w_plus, (SELECT tie_term FROM tt) AS tie_term FROM r""",
                           X.wilcoxon_exprs(DUCK)))
def wilcoxon(spark, sf):
    return X.wilcoxon(_pairs(Tables(spark, sf)), "a", "b")


# -- k groups --------------------------------------------------------------
@query("x11_anova", fin("""
WITH g AS (SELECT o_orderpriority, count(o_totalprice) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v
           FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1),
 gm AS (SELECT sum(n * m) / sum(n) AS gm FROM g)
SELECT count(*) AS k, sum(n) AS N, sum(n * pow(m - (SELECT gm FROM gm), 2)) AS ssb, sum((n - 1) * coalesce(v, 0)) AS ssw FROM g""",
                        X.anova_exprs(DUCK)))
def anova(spark, sf):
    return X.anova(Tables(spark, sf).orders, "o_totalprice", "o_orderpriority")


_PW = {k: v for k, v in X.welch_exprs(DUCK).items() if k in ("mean_diff", "t", "df", "p_value")}


@query("x12_pairwise_welch", f"""
WITH g AS (SELECT o_orderpriority AS grp, count(o_totalprice) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v
           FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1),
 p AS (SELECT a.grp AS g1, a.n AS n1, a.m AS m1, a.v AS v1, b.grp AS g2, b.n AS n2, b.m AS m2, b.v AS v2
       FROM g a JOIN g b ON a.grp < b.grp),
 s AS ({fin('SELECT * FROM p', _PW, ['g1', 'g2'])}),
 r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value) AS i FROM s)
SELECT g1, g2, mean_diff, t, df, p_value,
       round(least(1.0, max((m - i + 1) * p_value) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6)
         AS p_holm
FROM r""")
def pairwise(spark, sf):
    return X.pairwise_welch(Tables(spark, sf).orders, "o_totalprice", "o_orderpriority")


@query("x13_kruskal", fin(f"""
WITH d AS (SELECT o_orderpriority AS g, o_totalprice AS v FROM orders WHERE o_totalprice IS NOT NULL),
 r AS (SELECT g, {_rank_sql('d', 'v', [], 'rk')} FROM d),
 gi AS (SELECT g, count(*) AS ni, sum(rk) AS ri FROM r GROUP BY g),
 tt AS ({_ties_sql('d', 'v', [])})
SELECT count(*) AS k, sum(ni) AS N, sum(ri * ri / ni) AS s, (SELECT tie_term FROM tt) AS tie_term FROM gi""",
                          X.kruskal_exprs(DUCK)))
def kruskal(spark, sf):
    return X.kruskal(Tables(spark, sf).orders, "o_totalprice", "o_orderpriority")


def _dunn_sql(method_sql: str, out: str) -> str:
    z = ("((mr1 - mr2) / sqrt(nullif((N * (N + 1) / 12.0 - tie_term / (12.0 * (N - 1))) * (1.0 / n1 + 1.0 / n2), 0)))")
    from prudent.functions import dist as D
    return f"""
WITH d AS (SELECT o_orderpriority AS g, o_totalprice AS v FROM orders WHERE o_totalprice IS NOT NULL),
 r AS (SELECT g, {_rank_sql('d', 'v', [], 'rk')} FROM d),
 gi AS (SELECT g, count(*) AS ni, avg(rk) AS mr FROM r GROUP BY g),
 tt AS ({_ties_sql('d', 'v', [])}),
 p AS (SELECT a.g AS g1, b.g AS g2, a.ni AS n1, b.ni AS n2, a.mr AS mr1, b.mr AS mr2,
              (SELECT sum(ni) FROM gi) AS N, (SELECT tie_term FROM tt) AS tie_term FROM gi a JOIN gi b ON a.g < b.g),
 s AS ({fin('SELECT * FROM p', {'z': z, 'p_value': D.norm_sf2(z, DUCK)}, ['g1', 'g2'])}),
 r2 AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value) AS i FROM s)
SELECT g1, g2, z, p_value, round({method_sql}, 6) AS {out} FROM r2"""


@query("x14_dunn", _dunn_sql(
    "least(1.0, max((m - i + 1) * p_value) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))", "p_holm"))
def dunn(spark, sf):
    return X.dunn(Tables(spark, sf).orders, "o_totalprice", "o_orderpriority", "holm")


@query("x27_adjust_bh", _dunn_sql(
    "least(1.0, min(m * p_value / i) OVER (ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))", "p_bh"))
def adjust_bh(spark, sf):
    return X.dunn(Tables(spark, sf).orders, "o_totalprice", "o_orderpriority", "bh")


@query("x27_adjust_bonferroni", _dunn_sql("least(1.0, m * p_value)", "p_bonferroni"))
def adjust_bonf(spark, sf):
    return X.dunn(Tables(spark, sf).orders, "o_totalprice", "o_orderpriority", "bonferroni")


def _nation_year(t: Tables):
    j = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return j.groupBy("s_nationkey", F.year("l_shipdate").alias("yr")).agg(F.sum("l_quantity").alias("qty")) \
        .where("yr BETWEEN 1995 AND 2000")


_NY_SQL = """ny AS (SELECT s.s_nationkey, year(l_shipdate) AS yr, sum(l_quantity) AS qty FROM lineitem l
             JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE year(l_shipdate) BETWEEN 1995 AND 2000 GROUP BY 1, 2)"""


@query("x15_friedman", f"""
WITH {_NY_SQL},
 r AS (SELECT yr, count(*) OVER (PARTITION BY s_nationkey, qty) AS t,
              rank() OVER (PARTITION BY s_nationkey ORDER BY qty) + (count(*) OVER (PARTITION BY s_nationkey, qty) - 1) / 2.0 AS rk FROM ny),
 rj AS (SELECT yr, sum(rk) AS rj FROM r GROUP BY yr),
 s AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(rj * rj) AS srj, (SELECT CAST(count(DISTINCT s_nationkey) AS DOUBLE) FROM ny) AS n, (SELECT sum(t * t - 1) FROM r) AS ties FROM rj),
 c AS (SELECT n, k, (12.0 / (n * k * (k + 1)) * srj - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS chi FROM s)
SELECT round(n, 6) AS n, round(k, 6) AS k, round(chi, 6) AS chi2, round(k - 1, 6) AS df,
       round({__import__('prudent.functions.dist', fromlist=['x']).chi2_sf('chi', '(k - 1)', DUCK)}, 6) AS p_value,
       round(chi / (n * (k - 1)), 6) AS kendall_w FROM c""")
def friedman(spark, sf):
    return X.friedman(_nation_year(Tables(spark, sf)), "s_nationkey", "yr", "qty")


@query("x15_rm_anova", f"""WITH {_NY_SQL},
 gm AS (SELECT avg(qty) AS gm FROM ny),
 s AS (SELECT sum(k * pow(m - (SELECT gm FROM gm), 2)) AS sss FROM (SELECT count(*) AS k, avg(qty) AS m FROM ny GROUP BY s_nationkey)),
 c AS (SELECT sum(k * pow(m - (SELECT gm FROM gm), 2)) AS ssc FROM (SELECT count(*) AS k, avg(qty) AS m FROM ny GROUP BY yr)),
 t AS (SELECT sum(pow(qty - (SELECT gm FROM gm), 2)) AS sst, CAST(count(DISTINCT s_nationkey) AS DOUBLE) AS n, CAST(count(DISTINCT yr) AS DOUBLE) AS k FROM ny),
 f AS (SELECT *, (ssc / (k - 1)) / ((sst - sss - ssc) / ((n - 1) * (k - 1))) AS f FROM s, c, t)
SELECT round(f, 6) AS f, round(k - 1, 6) AS df1, round((n - 1) * (k - 1), 6) AS df2,
       round({__import__('prudent.functions.dist', fromlist=['x']).f_sf('f', '(k - 1)', '((n - 1) * (k - 1))', DUCK)}, 6) AS p_value,
       round(ssc / (sst - sss), 6) AS partial_eta_sq FROM f""")
def rm_anova(spark, sf):
    return X.rm_anova(_nation_year(Tables(spark, sf)), "s_nationkey", "yr", "qty")


# -- contingency tables ----------------------------------------------------
def _seg_prio(t: Tables):
    return t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")


_SEG_PRIO_SQL = """sp AS (SELECT c.c_mktsegment AS a, o.o_orderpriority AS b FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""


@query("x16_chi2", fin(f"""
WITH {_SEG_PRIO_SQL},
 cells AS (SELECT a, b, count(*) AS o FROM sp GROUP BY 1, 2),
 ra AS (SELECT a, sum(o) AS ra FROM cells GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM cells GROUP BY b),
 n AS (SELECT sum(o) AS n FROM cells),
 cellgrid AS (SELECT ra.a, cb.b, coalesce(cells.o, 0) AS o, ra.ra * cb.cb / n.n AS e
          FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b)
SELECT sum(pow(o - e, 2) / e) AS chi2, (SELECT n FROM n) AS n, (SELECT count(*) FROM ra) AS r,
       (SELECT count(*) FROM cb) AS c, min(e) AS min_expected, avg(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END) AS share_low_expected
FROM cellgrid""", X.chi2_exprs(DUCK)))
def chi2(spark, sf):
    return X.chi2(_seg_prio(Tables(spark, sf)), "c_mktsegment", "o_orderpriority")


@query("x16_chi2_yates", fin("""
WITH sp AS (SELECT o_orderstatus = 'F' AS a, o_orderpriority = '1-URGENT' AS b FROM orders),
 cells AS (SELECT a, b, count(*) AS o FROM sp GROUP BY 1, 2),
 ra AS (SELECT a, sum(o) AS ra FROM cells GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM cells GROUP BY b),
 n AS (SELECT sum(o) AS n FROM cells),
 cellgrid AS (SELECT ra.a, cb.b, coalesce(cells.o, 0) AS o, ra.ra * cb.cb / n.n AS e
          FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b)
SELECT sum(pow(greatest(abs(o - e) - 0.5, 0), 2) / e) AS chi2, (SELECT n FROM n) AS n, 2 AS r, 2 AS c,
       min(e) AS min_expected, avg(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END) AS share_low_expected FROM cellgrid""",
                               X.chi2_exprs(DUCK)))
def chi2_yates(spark, sf):
    o = Tables(spark, sf).orders.select((F.col("o_orderstatus") == "F").alias("a"),
                                        (F.col("o_orderpriority") == "1-URGENT").alias("b"))
    return X.chi2(o, "a", "b")


@query("x19_residuals", f"""
WITH {_SEG_PRIO_SQL},
 cells AS (SELECT a, b, count(*) AS o FROM sp GROUP BY 1, 2),
 ra AS (SELECT a, sum(o) AS ra FROM cells GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM cells GROUP BY b),
 n AS (SELECT sum(o) AS n FROM cells),
 g AS (SELECT ra.a, cb.b, ra.ra, cb.cb, n.n AS N, coalesce(cells.o, 0) AS o, ra.ra * cb.cb / n.n AS e
       FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b)
SELECT a AS c_mktsegment, b AS o_orderpriority, round(CAST(o AS DOUBLE), 6) AS o, round(e, 6) AS e,
       round((o - e) / sqrt(nullif(e, 0)), 6) AS std_resid,
       round((o - e) / sqrt(nullif(e * (1 - ra / N) * (1 - cb / N), 0)), 6) AS adj_resid,
       abs((o - e) / sqrt(nullif(e * (1 - ra / N) * (1 - cb / N), 0))) > 2 AS flag
FROM g""")
def residuals(spark, sf):
    return X.residuals(_seg_prio(Tables(spark, sf)), "c_mktsegment", "o_orderpriority")


@query("x17_fisher", fin("""
SELECT count_if(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS a,
       count_if(o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT') AS b,
       count_if(o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT') AS c,
       count_if(o_orderstatus <> 'P' AND o_orderpriority <> '1-URGENT') AS d
FROM orders""", X.fisher_exprs(DUCK)))
def fisher(spark, sf):
    return X.fisher(Tables(spark, sf).orders, "o_orderstatus = 'P'", "o_orderpriority = '1-URGENT'")


def _lines_region(t: Tables):
    return (t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
            .join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")), "s_nationkey"))


@query("x18_cmh", """
WITH t AS (SELECT n.n_regionkey, count_if(l_discount >= 0.05 AND l_returnflag = 'R') AS a,
                  count_if(l_discount >= 0.05 AND l_returnflag <> 'R') AS b,
                  count_if(l_discount < 0.05 AND l_returnflag = 'R') AS c,
                  count_if(l_discount < 0.05 AND l_returnflag <> 'R') AS d
           FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
           GROUP BY 1),
 s AS (SELECT sum(a * d / (a + b + c + d)) AS num, sum(b * c / (a + b + c + d)) AS den, sum(a) AS sa,
              sum((a + b) * (a + c) / (a + b + c + d)) AS ea,
              sum((a + b) * (c + d) * (a + c) * (b + d) / ((a + b + c + d) * (a + b + c + d) * (a + b + c + d - 1))) AS va,
              count(*) AS k FROM t)
SELECT round(CAST(k AS DOUBLE), 6) AS k, round(num / nullif(den, 0), 6) AS mh_odds_ratio,
       round(pow(greatest(abs(sa - ea) - 0.5, 0), 2) / nullif(va, 0), 6) AS cmh_chi2,
       round(""" + __import__('prudent.functions.dist', fromlist=['x']).chi2_sf(
    "(pow(greatest(abs(sa - ea) - 0.5, 0), 2) / nullif(va, 0))", "1", DUCK) + """, 6) AS p_value FROM s""")
def cmh(spark, sf):
    return X.cmh(_lines_region(Tables(spark, sf)), "l_discount >= 0.05", "l_returnflag = 'R'", "n_regionkey")


@query("x20_cramers_v", fin(f"""
WITH {_SEG_PRIO_SQL},
 cells AS (SELECT a, b, count(*) AS o FROM sp GROUP BY 1, 2),
 ra AS (SELECT a, sum(o) AS ra FROM cells GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM cells GROUP BY b),
 n AS (SELECT sum(o) AS n FROM cells),
 cellgrid AS (SELECT coalesce(cells.o, 0) AS o, ra.ra * cb.cb / n.n AS e
          FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b)
SELECT sum(pow(o - e, 2) / e) AS chi2, (SELECT n FROM n) AS n, (SELECT count(*) FROM ra) AS r,
       (SELECT count(*) FROM cb) AS c FROM cellgrid""",
                             {"cramers_v": X.chi2_exprs(DUCK)["cramers_v"], "tier": X.chi2_exprs(DUCK)["tier"]}))
def cramers_v(spark, sf):
    return chi2(spark, sf).select("cramers_v", "tier")


@query("x21_trend_chi2", fin("""
SELECT count(*) AS n, corr(CAST(left(o_orderpriority, 1) AS DOUBLE),
                           CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 2.0 ELSE 3.0 END) AS r FROM orders""",
                             {"n": "n", "r": "r", "m2": "((n - 1) * r * r)",
                              "p_value": __import__('prudent.functions.dist', fromlist=['x']).chi2_sf(
                                  "((n - 1) * r * r)", "1", DUCK)}))
def trend(spark, sf):
    o = Tables(spark, sf).orders.select(F.left("o_orderpriority", F.lit(1)).cast("double").alias("a"),
                                        F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 2.0)
                                        .otherwise(3.0).alias("b"))
    return X.trend_chi2(o, "a", "b")


@query("x22_odds_ratio", fin("""
SELECT l_linestatus, count_if(l_discount >= 0.05 AND l_returnflag = 'R') AS a,
       count_if(l_discount >= 0.05 AND NOT (l_returnflag = 'R')) AS b,
       count_if(NOT (l_discount >= 0.05) AND l_returnflag = 'R') AS c,
       count_if(NOT (l_discount >= 0.05) AND NOT (l_returnflag = 'R')) AS d FROM lineitem GROUP BY 1""",
                             {"a": "a", "b": "b", "c": "c", "d": "d", **X.odds_exprs()}, ["l_linestatus"]))
def odds(spark, sf):
    return X.odds_ratio(Tables(spark, sf).lineitem, "l_discount >= 0.05", "l_returnflag = 'R'", "l_linestatus")


# -- regression-type -------------------------------------------------------
@query("x23_slope", fin(f"""
WITH {NATION_WEEKLY_SQL}
SELECT s_nationkey, regr_count(qty, t) AS n, regr_sxx(qty, t) AS sxx, regr_syy(qty, t) AS syy, regr_sxy(qty, t) AS sxy
FROM (SELECT *, CAST(floor((week - DATE '1970-01-01') / 7) AS BIGINT) AS t FROM nw) GROUP BY 1""",
                        X.slope_exprs(DUCK), ["s_nationkey"]))
def slope(spark, sf):
    nw = nation_weekly(Tables(spark, sf)).withColumn("t", (F.unix_date("week") / 7).cast("bigint"))
    return X.slope(nw, "t", "qty", "s_nationkey")


@query("x25_interaction", f"""
WITH {SEGMENT_WEEKLY_SQL},
 s AS (SELECT c_mktsegment, regr_count(n_orders, t) AS n, regr_sxx(n_orders, t) AS sxx, regr_syy(n_orders, t) AS syy,
              regr_sxy(n_orders, t) AS sxy FROM sw GROUP BY 1),
 a AS (SELECT count(*) AS k, sum(n) AS n, sum(syy - sxy * sxy / sxx) AS rss_sep, sum(syy) AS syy, sum(sxy) AS sxy,
              sum(sxx) AS sxx FROM s)
""" + fin("SELECT * FROM a", {
    "k": "k", "n": "n", "common_slope": "(sxy / nullif(sxx, 0))",
    "f": "(((syy - sxy * sxy / sxx) - rss_sep) / (k - 1)) / nullif(rss_sep / (n - 2 * k), 0)",
    "df1": "(k - 1)", "df2": "(n - 2 * k)",
    "p_value": __import__('prudent.functions.dist', fromlist=['x']).f_sf(
        "((((syy - sxy * sxy / sxx) - rss_sep) / (k - 1)) / nullif(rss_sep / (n - 2 * k), 0))", "(k - 1)", "(n - 2 * k)",
        DUCK)}))
def interaction(spark, sf):
    return X.interaction(segment_weekly(Tables(spark, sf)), "t", "n_orders", "c_mktsegment")


@query("x26_heterogeneity", f"""
WITH {SEGMENT_WEEKLY_SQL},
 s AS (SELECT regr_slope(n_orders, t) AS b, (regr_syy(n_orders, t) - pow(regr_sxy(n_orders, t), 2) / regr_sxx(n_orders, t))
              / (regr_count(n_orders, t) - 2) / regr_sxx(n_orders, t) AS v FROM sw GROUP BY c_mktsegment),
 a AS (SELECT CAST(count(*) AS DOUBLE) AS k, sum(1 / v) AS sw, sum(1 / (v * v)) AS sw2, sum(b / v) / sum(1 / v) AS pooled FROM s WHERE v > 0),
 h AS (SELECT a.*, (SELECT sum((b - pooled) * (b - pooled) / v) FROM s) AS q FROM a)
SELECT round(k, 6) AS k, round(pooled, 6) AS pooled, round(q, 6) AS q, round(k - 1, 6) AS df,
       round({__import__('prudent.functions.dist', fromlist=['x']).chi2_sf('q', '(k - 1)', DUCK)}, 6) AS p_value,
       round(CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) ELSE 0 END, 6) AS i_squared,
       round(greatest(0, (q - (k - 1)) / nullif(sw - sw2 / sw, 0)), 6) AS tau_squared FROM h""")
def heterogeneity(spark, sf):
    """Between-segment heterogeneity of weekly order-count trends."""
    # from unrounded slopes: the rounded ones of the report shift Q in the third decimal
    s = segment_weekly(Tables(spark, sf)).groupBy("c_mktsegment").agg(
        F.regr_slope("n_orders", "t").alias("slope"),
        ((F.regr_syy("n_orders", "t") - F.regr_sxy("n_orders", "t") * F.regr_sxy("n_orders", "t") / F.regr_sxx("n_orders", "t"))
         / (F.regr_count("n_orders", "t") - 2) / F.regr_sxx("n_orders", "t")).alias("v"))
    return X.heterogeneity(s, "slope", "v")


@query("x24_regress", "SELECT term, coefficient, std_error, statistic AS t, p_value, explained AS r2 FROM (" + ols_sql() + ")")
def regress(spark, sf):
    return X.regress(Tables(spark, sf).lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query("x28_bootstrap")
def bootstrap(spark, sf):
    return X.bootstrap_mean(Tables(spark, sf).orders, "o_totalprice", 200, 42, key=["o_orderkey"])


@query("x28_cluster_bootstrap")
def cluster_bootstrap(spark, sf):
    return X.bootstrap_mean(Tables(spark, sf).orders, "o_totalprice", 200, 42, cluster="o_custkey")


@query("x29_power", f"""
WITH w AS ({fin(_WELCH_SUFF, X.welch_exprs(DUCK))})
""" + fin("SELECT n1, n2, p_value, cohens_d AS d_eff FROM w", X.power_exprs(DUCK), ["n1", "n2", "p_value"]))
def power(spark, sf):
    w = welch(spark, sf).select("n1", "n2", "p_value", F.col("cohens_d").alias("d_eff"))
    return X.finalize(w, X.power_exprs(), keep=["n1", "n2", "p_value"])


@query("x30_effect_tiers", f"""
WITH s AS ({_WELCH_SUFF})
SELECT round((m1 - m2) * 100.0 / nullif(abs(m2), 0), 6) AS rel_pct_diff,
       {X.d_tier("((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / nullif((n1 + n2 - 2), 0)), 0))")} AS tier
FROM s""")
def effect_tiers(spark, sf):
    t = Tables(spark, sf).orders.where(F.col("o_orderstatus").isin("F", "O"))
    m = X.group_moments(t, "o_totalprice", "o_orderstatus")
    s = m.agg(*[F.max(F.when(F.col("o_orderstatus") == g, F.col(c))).alias(f"{c}{i}")
                for i, g in ((1, "F"), (2, "O")) for c in ("n", "m", "v")])
    return s.select(F.round(F.expr("(m1 - m2) * 100.0 / nullif(abs(m2), 0)"), 6).alias("rel_pct_diff"),
                    F.expr(X.d_tier("((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / "
                                    "nullif((n1 + n2 - 2), 0)), 0))")).alias("tier"))


@query("x35_outcome", f"""
WITH w AS ({fin(_WELCH_SUFF, X.welch_exprs(DUCK))}),
 p AS ({fin("SELECT n1, n2, p_value, tier, cohens_d AS d_eff FROM w", X.power_exprs(DUCK), ["p_value", "tier"])})
SELECT p_value, tier, power, {X.outcome_expr()} AS outcome FROM p""")
def outcome(spark, sf):
    w = welch(spark, sf).select("n1", "n2", "p_value", "tier", F.col("cohens_d").alias("d_eff"))
    p = X.finalize(w, X.power_exprs(), keep=["p_value", "tier"])
    return p.select("p_value", "tier", "power", F.expr(X.outcome_expr()).alias("outcome"))


@query("x32_stratified_effect", """
WITH g AS (SELECT c.c_mktsegment, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS m1,
                  avg(CASE WHEN NOT (o_orderpriority = '1-URGENT') THEN o_totalprice END) AS m0, count(*) AS n
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1)
SELECT round(sum((m1 - m0) * n) / sum(n), 6) AS stratified_effect, count(*) AS n_strata
FROM g WHERE m1 IS NOT NULL AND m0 IS NOT NULL""")
def stratified(spark, sf):
    o = _seg_prio(Tables(spark, sf)).withColumn("treated", F.col("o_orderpriority") == "1-URGENT")
    return X.stratified_effect(o, "o_totalprice", "treated", "c_mktsegment") \
        .withColumn("stratified_effect", F.round("stratified_effect", 6))


@query("x32_ipw")
def ipw(spark, sf):
    t = Tables(spark, sf)
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey"), "o_custkey")
    o = o.withColumn("treated", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    return X.ipw_effect(o, "o_totalprice", "treated", ["c_acctbal", "c_nationkey"])
