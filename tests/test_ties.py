"""Friedman's statistic with ties against its definition."""
import numpy as np
import pandas as pd
import pytest

from prudent.operators import stats as X


def test_friedman_is_corrected_for_ties(spark):
    x = np.array([[1, 2, 2, 4], [3, 3, 3, 1], [2, 4, 1, 4], [5, 6, 7, 8], [1, 1, 2, 2]], float)
    rows = [(i, j, float(v)) for i, line in enumerate(x) for j, v in enumerate(line)]
    got = X.friedman(spark.createDataFrame(rows, "s int, c int, v double"), "s", "c", "v").first()
    ranks = pd.DataFrame(x).rank(axis=1).to_numpy()
    n, k = x.shape
    ties = sum(t ** 3 - t for line in x for t in np.unique(line, return_counts=True)[1])
    plain = 12 / (n * k * (k + 1)) * (ranks.sum(0) ** 2).sum() - 3 * n * (k + 1)
    assert got.chi2 == pytest.approx(plain / (1 - ties / (n * k * (k * k - 1))), abs=1e-6)
