"""Statistics of contingency tables whose products of margins leave the range of a long."""
import math

import pytest

from prudent.operators import stats as X
from prudent.plans.q_extra import kendall_tau


def _repeated(spark, cells: str, counts: str):
    """A row per cell, repeated as often as its count says (split first, so that no task makes all rows)."""
    t = spark.sql(f"SELECT *, explode(sequence(1, 100)) AS part FROM VALUES {cells} AS v({counts}, n)")
    return t.repartition(8).selectExpr("*", "explode(sequence(1, CAST(n / 100 AS INT))) AS i").drop("part", "i", "n")


def test_fisher_and_cmh_over_margins_of_millions(spark):
    a, b, c, d = 300_000, 299_000, 301_000, 302_000
    df = _repeated(spark, f"(true, true, 1, {a}), (true, false, 1, {b}), (false, true, 1, {c}), (false, false, 1, {d})", "e, o, s")
    n, r1, c1 = a + b + c + d, a + b, a + c
    g = lambda k: sum(s * math.lgamma(v + 1) for s, v in ((1, r1), (1, n - r1), (1, c1), (1, n - c1), (-1, n), (-1, k), (-1, r1 - k), (-1, c1 - k), (-1, n - r1 - c1 + k)))
    middle = r1 * c1 // n
    terms = [g(k) for k in range(middle - 22_000, middle + 22_000)]
    want = sum(math.exp(t) for t in terms if t <= g(a) + 1e-7)
    got = X.fisher(df, "e", "o").first()
    assert (got.a, got.b, got.c, got.d) == (a, b, c, d) and got.p_value == pytest.approx(want, abs=2e-6)
    m = X.cmh(df, "e", "o", "s").first()
    chi = (abs(a - r1 * c1 / n) - 0.5) ** 2 / (r1 * (n - r1) * c1 * (n - c1) / (n * n * (n - 1)))
    assert m.mh_odds_ratio == pytest.approx(a * d / (b * c), abs=1e-6) and m.cmh_chi2 == pytest.approx(chi, abs=2e-6)


def test_kendall_and_wilcoxon_over_millions_of_rows(spark):
    cells = {(1, 1): 900_000, (1, 2): 500_000, (2, 1): 400_000, (2, 2): 700_000}
    df = _repeated(spark, ", ".join(f"({x}, {y}, {n})" for (x, y), n in cells.items()), "x, y")
    n, s = sum(cells.values()), 900_000 * 700_000 - 500_000 * 400_000
    ties = lambda *m: sum(v * (v - 1) / 2 for v in m)
    both = (n * (n - 1) / 2 - ties(1_400_000, 1_100_000)) * (n * (n - 1) / 2 - ties(1_300_000, 1_200_000))
    got = kendall_tau(df).first()
    assert got.tau_b == pytest.approx(s / math.sqrt(both), abs=1e-7)
    assert got.z == pytest.approx(3 * s / math.sqrt(n * (n - 1) * (2 * n + 5) / 2), abs=1e-5)
    w = X.wilcoxon(df.selectExpr("CAST(x AS DOUBLE) * 3 AS a", "CAST(y AS DOUBLE) AS b"), "a", "b").first()
    assert w.n == n and w.w_plus == pytest.approx(n * (n + 1) / 2)
