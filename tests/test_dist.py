"""Distribution tails and quantiles against published table values, in
both dialects."""
import pytest

from prudent.functions import dist as D

CASES = [
    (lambda d: D.t_sf2("2.228138851986274", "10", d), 0.05),
    (lambda d: D.t_sf2("1.0", "1", d), 0.5),
    (lambda d: D.chi2_sf("3.841458820694124", "1", d), 0.05),
    (lambda d: D.chi2_sf("18.307038053275146", "10", d), 0.05),
    (lambda d: D.norm_sf2("1.959963984540054", d), 0.05),
    (lambda d: D.norm_cdf("-1.0", d), 0.15865525393145707),
    (lambda d: D.f_sf("4.964602743730711", "1", "10", d), 0.05),
    (lambda d: D.t_ppf(0.975, "10", d), 2.228138851986274),
    (lambda d: D.t_ppf(0.975, "3", d), 3.182446305284263),
    (lambda d: D.t_ppf(0.975, "1", d), 12.706204736174696),
    (lambda d: D.lgamma("0.5", d), 0.5723649429247001),
    (lambda d: D.t_ppf(0.975, "100000", d), 1.959987707534835),
]

# large degrees of freedom, where a capped series goes wrong
LARGE = [
    (lambda d: D.chi2_sf("1e8", "1e8", d), 0.5 - 1 / (3 * 3.141592653589793 ** 0.5 * 1e4), 1e-7),
    (lambda d: D.chi2_sf("1e6", "1e6", d), 0.49981193, 1e-7),
    (lambda d: D.chi2_sf("1.002e6", "1e6", d), 0.0786861, 1e-4),
    (lambda d: D.t_sf2("0.5", "1e12", d), 0.6170750774519738, 1e-9),
    (lambda d: D.f_sf("1.0", "3", "1e6", d), 0.3916257, 1e-5),
]


@pytest.mark.parametrize("fn,expected", CASES)
def test_spark_matches_tables(spark, fn, expected):
    got = spark.sql("SELECT " + fn("spark") + " AS v").collect()[0][0]
    assert got == pytest.approx(expected, rel=1e-8)


@pytest.mark.parametrize("fn,expected", CASES)
def test_duckdb_matches_tables(duck, fn, expected):
    got = duck.sql("SELECT " + fn("duckdb") + " AS v").fetchall()[0][0]
    assert got == pytest.approx(expected, rel=1e-8)


@pytest.mark.parametrize("fn,expected,tol", LARGE)
def test_large_degrees_of_freedom(spark, fn, expected, tol):
    assert spark.sql("SELECT " + fn("spark") + " AS v").collect()[0][0] == pytest.approx(expected, abs=tol)


@pytest.mark.parametrize("df", ["3", "10", "19999", "199999", "200001", "3e5"])
@pytest.mark.parametrize("q", [0.9, 1.0, 1.02])
def test_the_two_dialects_agree(spark, duck, df, q):
    x = f"{float(df) * q!r}"
    for f in (lambda d: D.chi2_sf(x, df, d), lambda d: D.t_sf2(f"{q * 2}", df, d), lambda d: D.f_sf(f"{q}", "4", df, d)):
        a = spark.sql("SELECT " + f("spark") + " AS v").collect()[0][0]
        b = duck.sql("SELECT " + f("duckdb") + " AS v").fetchall()[0][0]
        assert a == pytest.approx(b, abs=2e-9)


@pytest.mark.parametrize("df", ["3", "4", "7.5", "30", "9999", "10001", "1e6"])
def test_quantiles_agree(spark, duck, df):
    a = spark.sql("SELECT " + D.t_ppf(0.975, df, "spark") + " AS v").collect()[0][0]
    b = duck.sql("SELECT " + D.t_ppf(0.975, df, "duckdb") + " AS v").fetchall()[0][0]
    assert a == pytest.approx(b, abs=1e-9)
    assert spark.sql("SELECT " + D.t_sf2(repr(a), df, "spark") + " AS v").collect()[0][0] == pytest.approx(0.05, abs=1e-9)
