"""Ticks to bars, bars to higher-timeframe bars, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import epoch_us, floor_time, shift_time
from ..plans.single import with_values

HOUR = 3600
OHLCV = ["open", "high", "low", "close", "volume"]


def ticks_to_bars(
    ticks: DataFrame, step: int, *, keys: Sequence[str] = ("symbol",), ts: str = "timestamp", tie: str = "event_id"
) -> DataFrame:
    """One bar per key and ``step`` seconds from (ts, price, volume) rows.

    First and last price are picked by one decimal ordering key (time, then
    ``tie``): a fixed-width key keeps the map-side hash aggregation, where a
    struct key would sort every tick before combining.
    """
    order = epoch_us(F.col(ts)).cast("decimal(19,0)") * F.expr("10000000000000000000BD") + F.col(tie).cast(
        "decimal(19,0)"
    )
    return (
        ticks.withColumns({"_bar": floor_time(F.col(ts), step), "_ord": order.cast("decimal(38,0)")})
        .groupBy(*keys, F.col("_bar").alias("timestamp"))
        .agg(
            F.min_by("price", "_ord").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_ord").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("n_ticks"),
        )
        .withColumn("known_at", shift_time(F.col("timestamp"), step))
    )


def resample_ohlcv(
    bars: DataFrame,
    step: int,
    *,
    base: int = HOUR,
    keys: Sequence[str] = ("symbol",),
    ts: str = "timestamp",
    label: str = "left",
    extra_sums: Sequence[str] = (),
    require_complete: bool = True,
) -> DataFrame:
    """Bars of ``step`` seconds that contain every one of their base bars.

    ``label="left"`` stamps the open (with ``known_at`` = exclusive close),
    ``label="right"`` stamps the end.
    """
    us = epoch_us(F.col(ts))
    out = (
        bars.withColumn("_bar", floor_time(F.col(ts), step))
        .groupBy(*keys, "_bar")
        .agg(
            F.min_by("open", us).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", us).alias("close"),
            F.sum("volume").alias("volume"),
            *[F.sum(c).alias(c) for c in extra_sums],
            F.count(F.lit(1)).alias("bar_count"),
        )
    )
    if require_complete:
        out = out.filter(F.col("bar_count") == step // base)
    end = shift_time(F.col("_bar"), step)
    if label == "right":
        return out.withColumn("timestamp", end).drop("_bar")
    return out.withColumns({"timestamp": F.col("_bar"), "known_at": end}).drop("_bar")


def calendar(
    df: DataFrame, step: int, *, keys: Sequence[str] = ("symbol",), ts: str = "timestamp", bounds: DataFrame | None = None
) -> DataFrame:
    """Full grid per key between the first and last bar over all keys (of ``bounds``).

    The grid is generated per key and day, so no task expands a whole series.
    """
    bounds = (df if bounds is None else bounds).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    names = df.select(*keys).distinct()
    day = F.expr("sequence(date_trunc('day', _lo), date_trunc('day', _hi), interval 1 day)")
    grid = F.expr(f"sequence(_d, _d + interval 1 day - interval {step} second, interval {step} second)")
    return (
        with_values(names, bounds)
        .withColumn("_d", F.explode(day))
        .repartition(*keys, "_d")
        .withColumn(ts, F.explode(grid))
        .filter(F.col(ts).between(F.col("_lo"), F.col("_hi")))
        .select(*keys, F.col(ts).cast("timestamp_ntz").alias(ts))
    )


def reindex(df: DataFrame, step: int, *, keys: Sequence[str] = ("symbol",), ts: str = "timestamp") -> DataFrame:
    """Left join on the full calendar; absent bars stay null (no fill)."""
    return calendar(df, step, keys=keys, ts=ts).join(df, [*keys, ts], "left")


def keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep-last de-duplication by aggregation (combines before the shuffle)."""
    rest = [c for c in df.columns if c not in key]
    packed = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")
    return df.groupBy(*key).agg(packed).select(*key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def upsert_bars(old: DataFrame, new: DataFrame, *, key: Sequence[str], closed_at: str, as_of: Column) -> DataFrame:
    """Union of two loads, last load wins per key, unclosed bars dropped."""
    both = old.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)))
    return keep_last(both.filter(F.col(closed_at) <= as_of), key, ["_load"]).drop("_load")
