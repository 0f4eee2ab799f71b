"""Per-series algorithms on planted patterns, and the streaming CUSUM
against the batch fold."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from prudent.operators import series as G


def test_stl_recovers_planted_season():
    t = np.arange(156, dtype=float)
    season = 10 * np.sin(2 * np.pi * t / 52)
    y = 0.5 * t + season + np.random.default_rng(0).normal(0, 0.5, len(t))
    tr, se, re = G.stl_numpy(y, 52)
    assert np.corrcoef(se[26:-26], season[26:-26])[0, 1] > 0.95
    assert np.std(re) < 2.0


def test_pelt_finds_planted_shift():
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.normal(0, 1, 60), rng.normal(5, 1, 60)])
    cps = G.pelt_numpy(y)
    assert any(abs(c - 60) <= 2 for c in cps)
    assert len(cps) <= 3


def test_bocpd_flags_change():
    rng = np.random.default_rng(2)
    y = np.concatenate([rng.normal(0, 1, 50), rng.normal(8, 1, 50)])
    p, rl = G.bocpd_numpy(y, 1 / 50)
    assert rl[-1] < 60           # run length restarted after the change
    assert p[50:53].max() > p[10:40].max()


def test_classical_decompose_and_cusum(spark):
    t = np.arange(120)
    y = 5 + (t >= 80) * 6.0 + 2 * np.sin(2 * np.pi * t / 12)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "t": t.astype("int64"), "y": y}))
    d = G.classical_decompose(df, ["k"], 12).toPandas()
    idx = d.drop_duplicates("season")["seasonal"]
    assert len(idx) == 12 and abs(idx.sum()) < 1e-9            # indices centred over one cycle
    assert np.corrcoef(d.sort_values("t")["seasonal"], 2 * np.sin(2 * np.pi * t / 12))[0, 1] > 0.95
    # standardised by the whole-series mean (which includes the shift), both
    # sides accumulate: the low regime alarms first, the high one later
    c = G.cusum(df, ["k"], 0.5, 5.0).first()
    assert c.n_alarms > 0 and c.max_pos > 5 and c.max_neg > 5
    b = G.best_split(df, ["k"]).first()
    assert abs(b.split_t - 79) <= 1


def test_regularize_fills_gaps(spark):
    rows = [("a", "2024-01-01", 1.0), ("a", "2024-01-22", 2.0)]
    df = spark.createDataFrame(rows, "k string, d string, v double").withColumn("ts", F.to_timestamp("d"))
    r = G.regularize(df, ["k"], "ts", "v", "week", 0.0).orderBy("period").collect()
    assert [x.y for x in r] == [1.0, 0.0, 0.0, 2.0]
