"""Small bar fixtures."""

import numpy as np
import pandas as pd

START = pd.Timestamp("2024-01-01")


def random_bars(n=200, symbols=("a", "b"), gaps=(), seed=0, hours=1):
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        opening = np.r_[close[0], close[:-1]] * np.exp(rng.normal(0, 0.002, n))
        high = np.maximum(opening, close) * (1 + rng.uniform(0, 0.01, n))
        low = np.minimum(opening, close) * (1 - rng.uniform(0, 0.01, n))
        f = pd.DataFrame(
            {"symbol": s, "timestamp": START + pd.to_timedelta(np.arange(n) * hours, unit="h"), "open": opening, "high": high,
             "low": low, "close": close, "volume": rng.integers(1, 50, n).astype(float)}
        )
        out.append(f.drop(index=[g for g in gaps if g < n]))
    return pd.concat(out, ignore_index=True)


def frame(spark, pdf):
    """Spark frame with NTZ timestamps."""
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: df[c].cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def bars_from(highs, lows=None, closes=None, hours=1, skip_at=None):
    n = len(highs)
    lows = lows if lows is not None else [h - 2 for h in highs]
    closes = closes if closes is not None else [(h + l) / 2 for h, l in zip(highs, lows)]
    t = [START + pd.Timedelta(hours=hours * (i + (1 if skip_at is not None and i >= skip_at else 0))) for i in range(n)]
    return pd.DataFrame({"symbol": "a", "timestamp": t, "open": closes, "high": highs, "low": lows, "close": closes, "volume": 1.0}).astype(
        {"open": float, "high": float, "low": float, "close": float}
    )
