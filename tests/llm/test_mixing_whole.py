"""What mixing keeps: an explicit share of the tokens."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from prudent.llm import mixing


def test_rate_meets_the_share_of_tokens():
    rng = np.random.default_rng(2)
    n, s = rng.integers(1, 10_000, 50).astype(float), rng.gamma(0.3, 2, 50) + 1e-3
    for keep in (0.01, 0.2, 0.5, 0.9, 1.0):
        c = mixing.rate(n, s, keep)
        assert abs((n * np.minimum(1, c * s)).sum() / n.sum() - keep) < 1e-9
    assert mixing.rate(n, s, None) == 1 / s.max()
    assert mixing.rate(np.array([5.0, 5.0]), np.array([0.0, 1.0]), 0.9) == float("inf")
    assert mixing.rate(np.zeros(2), np.zeros(2), 0.5) == 0.0
    with pytest.raises(ValueError):
        mixing.rate(n, s, 0.0)


def test_one_rare_document_barely_changes_what_is_kept(spark):
    rows = [(i, f"s{i % 4}", "en" if i % 3 else "de", "word " * (40 + i % 50)) for i in range(2000)]
    schema = "doc_id long, source string, lang string, text string"
    margins = [mixing.Margin("source", F.col("source"), temper=0.7), mixing.Margin("lang", F.col("lang"), temper=0.8)]

    def kept(rows):
        got = mixing.mix(spark.createDataFrame(rows, schema), margins, keep=mixing.KEEP).toPandas()
        assert set(got[got.source == "new"].probability) <= {1.0}
        return (got.tokens * got.probability).sum() / got.tokens.sum(), got[got.selected].tokens.sum() / got.tokens.sum()
    before, after = kept(rows), kept(rows + [(9999, "new", "xx", "word " * 20)])
    assert abs(before[0] - mixing.KEEP) < 1e-9 and abs(after[0] - mixing.KEEP) < 1e-9
    assert abs(before[1] - after[1]) < 0.02
