"""The streaming zigzag gives the batch events however its bars arrive."""

import numpy as np
import pytest
from helpers import frame, random_bars
from pyspark.sql import functions as F

from barloom.operators import structure as S
from barloom.streaming.bars import run_to_parquet, stream_zigzag

SCHEMA = "symbol string, known_at timestamp_ntz, high double, low double, close double"
LATE = 12


def _arrivals(bars, parts, rng):
    """Bars in an order that is at most ``LATE`` hours off, cut into files."""
    order = np.argsort(bars["known_at"].astype("int64").to_numpy() / 3.6e12 + rng.uniform(0, LATE - 1, len(bars)) if parts > 1 else rng.permutation(len(bars)))
    return [bars.iloc[i] for i in np.array_split(order, parts)]


@pytest.mark.parametrize("parts", [1, 4])
def test_any_split_into_triggers_gives_the_batch_events(spark, tmp_path, parts):
    bars = random_bars(n=160, symbols=("a", "b"), seed=3).rename(columns={"timestamp": "known_at"}).astype({"known_at": "datetime64[ns]"})
    for i, part in enumerate(_arrivals(bars, parts, np.random.default_rng(parts))):
        frame(spark, part).select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_to_parquet(stream_zigzag(raw, pct=2.0, late=f"{LATE} hours"), str(tmp_path / "out"))
    shown = frame(spark, bars).filter(F.col("known_at") <= F.lit(bars["known_at"].max()).cast("timestamp_ntz") - F.expr(f"interval {LATE} hours"))
    placed = shown.withColumn("pos", F.row_number().over(S.Window.partitionBy("symbol").orderBy("known_at")) - 1)
    want = S.zigzag_pct(placed, series=["symbol"], pct=2.0, at="known_at")
    rows = sorted(map(tuple, got.select(*want.columns).collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 10
