"""Gaps on planted entities: real ones are told, noise, recent blips and single competitors are not."""
import numpy as np

from prudent.operators import benchmark as B


def panel(spark, levels, sd, bump=None, periods=40):
    rng = np.random.default_rng(3)
    rows = [("g", e, t, float(m + rng.normal(0, sd) + ((bump or {}).get(e, 0) if t >= periods - 3 else 0))) for e, m in levels.items() for t in range(periods)]
    return spark.createDataFrame(rows + [("alone", "z", 1, 5.0), ("g", "e0", 99, None)], "grp string, e string, t int, v double")


def test_a_real_gap_is_told_and_others_are_not(spark):
    levels = {f"e{i}": 100 + (i % 5) for i in range(14)} | {"low": 80, "near": 100.5}
    got = {r.e: r for r in B.gap_report(panel(spark, levels, 1.5), ["grp"], "e", "t", "v").collect()}
    assert got["low"].verdict == "gap" and got["low"].ci_high < 0 and got["low"].windows_agree and got["low"].drop_one_peer
    assert got["near"].verdict == "not established"
    assert got["z"].benchmark is None and got["z"].verdict == "not established"
    noisy = {r.e: r for r in B.gap_report(panel(spark, levels, 30.0), ["grp"], "e", "t", "v").collect()}
    assert not noisy["low"].outside_noise and noisy["low"].verdict == "not established"


def test_a_recent_blip_and_one_high_peer_do_not_make_a_gap(spark):
    levels = {f"e{i}": 100.0 for i in range(14)} | {"star": 900.0, "mid": 101.0}
    got = {r.e: r for r in B.gap_report(panel(spark, levels, 0.2, {"e3": 60}), ["grp"], "e", "t", "v").collect()}
    assert not got["e3"].windows_agree
    assert got["mid"].gap < 0 and not got["mid"].drop_one_peer and got["mid"].verdict == "not established"
    assert got["star"].verdict == "strength"
    few = {r.e: r for r in B.gap_report(panel(spark, {"a": 1.0, "b": 50.0, "c": 51.0}, 0.1), ["grp"], "e", "t", "v").collect()}
    assert few["a"].enough_peers is False and few["a"].verdict == "not established"
