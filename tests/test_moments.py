"""Sliding correlations against a direct computation of every window."""

import numpy as np
import pytest

from barloom.plans.moments import sliding_correlation


@pytest.mark.parametrize("window", [1, 4, 7, 50])
def test_every_window_by_itself(spark, window):
    rng = np.random.default_rng(window)
    x, y = rng.normal(0, 0.02, 45), rng.normal(0, 0.02, 45)
    y[10:25] = 0.01  # constant for a while
    x[rng.random(45) < 0.2] = np.nan
    rows = [("k", i, None if np.isnan(a) else float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("empty", 0, None, None)]
    df = spark.createDataFrame(rows, "key string, p long, x double, y double")
    got = {(r.key, r.p): (r.n, r.correlation) for r in sliding_correlation(df, ["key"], "p", "x", "y", window).collect()}
    assert len(got) == len(rows) and got["empty", 0] == (0, None)
    for i in range(45):
        a, b = x[max(0, i - window + 1) : i + 1], y[max(0, i - window + 1) : i + 1]
        a, b = a[~np.isnan(a)], b[~np.isnan(a)]
        n, c = got["k", i]
        assert n == len(a)
        if len(a) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0:
            assert c is None
        else:
            assert c == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)


def test_a_window_of_no_rows_is_refused(spark):
    with pytest.raises(ValueError):
        sliding_correlation(spark.createDataFrame([("k", 0, 1.0, 1.0)], "key string, p long, x double, y double"), ["key"], "p", "x", "y", 0)
