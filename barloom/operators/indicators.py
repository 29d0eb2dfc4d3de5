"""Technical indicators: the hourly feature table and the segmented family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.asof import Right, asof_join
from ..plans.blocks import BlockFrame, Ewm, shift_time, span, with_position
from .bars import HOUR, resample_ohlcv

# Fixed names: the 13 indicators of the segmented family.
SNAPSHOT_FEATURES = [
    "return_1", "ema12_distance", "ema26_distance", "sma20_distance", "rsi14", "macd_12_26", "macd_signal9",
    "macd_hist", "atr14_pct", "bb20_z", "bb20_width_pct", "rolling_vwap20_distance", "relative_volume20",
]
TIMEFRAMES = {"1h": HOUR, "4h": 4 * HOUR, "1d": 24 * HOUR}


def flag(cond: Column) -> Column:
    """Comparison where an unknown side counts as false."""
    return F.coalesce(cond, F.lit(False))


def nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def ternary(up: Column, down: Column) -> Column:
    return F.when(flag(up), 1).when(flag(down), -1).otherwise(0)


def finite(c: Column) -> Column:
    """NaN and infinities to null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def true_range(prev_close: Column) -> Column:
    """max of the three ranges; nulls skipped, so the first row is high - low."""
    h, l = F.col("high"), F.col("low")
    return F.greatest(h - l, F.abs(h - prev_close), F.abs(l - prev_close))


def rsi_from(gain: str, loss: str) -> Column:
    """100 - 100/(1+rs); null when there was no loss."""
    return 100 - 100 / (1 + F.col(gain) / nonzero(F.col(loss)))


def _delta_parts(prev: Column) -> dict[str, Column]:
    d = F.col("close") - prev
    return {"_gain": F.greatest(d, F.lit(0.0) * d), "_loss": F.greatest(-d, F.lit(0.0) * d), "_tr": true_range(prev)}


def candle_shape() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "range_pct": (h - l) / o * 100,
        "body_pct": (c - o) / o * 100,
        "upper_wick_pct": (h - F.greatest(o, c)) / o * 100,
        "lower_wick_pct": (F.least(o, c) - l) / o * 100,
    }


def hourly_base(bars: DataFrame, *, keys: Sequence[str] = ("symbol",), block: int = 1024) -> DataFrame:
    """Base features of one timeframe (rows counted over the whole series)."""
    placed = bars if "pos" in bars.columns else with_position(bars, keys=keys, ts="timestamp", step=HOUR, reset=False)
    bf = BlockFrame(placed, keys, before=73, size=block)
    close, prev = F.col("close"), bf.lag("close")
    bf.with_columns(
        {f"return_{n}h": close / bf.lag("close", n) - 1 for n in (1, 3, 6, 24)}
        | {"log_return_1h": F.ln(close / prev)}
        | _delta_parts(prev)
        | candle_shape()
    )
    bf.with_columns(
        {
            "volume_sma20": bf.rolling(F.avg("volume"), 20),
            "volatility_24h": bf.rolling(F.stddev_samp("log_return_1h"), 24, first=1),
            "volatility_72h": bf.rolling(F.stddev_samp("log_return_1h"), 72, first=1),
        }
        | {f"prev_high_{n}h": bf.rolling(F.max("high"), n, shift=1) for n in (24, 72)}
        | {f"prev_low_{n}h": bf.rolling(F.min("low"), n, shift=1) for n in (24, 72)}
    )
    w = 1 / 14
    specs = {f"ema{n}": Ewm("close", span(n)) for n in (20, 50, 200)}
    specs |= {
        "_ag": Ewm("_gain", w, start=1, min_periods=14),
        "_al": Ewm("_loss", w, start=1, min_periods=14),
        "atr14": Ewm("_tr", w, min_periods=14),
    }
    out = bf.ewm(specs)
    e20, e50, e200 = F.col("ema20"), F.col("ema50"), F.col("ema200")
    ph, pl = F.col("prev_high_24h"), F.col("prev_low_24h")
    out = out.withColumns(
        {f"distance_ema{n}_pct": (close / F.col(f"ema{n}") - 1) * 100 for n in (20, 50, 200)}
        | {f"distance_high_{n}h_pct": (F.col(f"prev_high_{n}h") / close - 1) * 100 for n in (24, 72)}
        | {f"distance_low_{n}h_pct": (close / F.col(f"prev_low_{n}h") - 1) * 100 for n in (24, 72)}
        | {
            "rsi14": rsi_from("_ag", "_al"),
            "atr14_pct": F.col("atr14") / close * 100,
            "volume_ratio": F.col("volume") / nonzero(F.col("volume_sma20")),
            "breakout_24h": flag(close > ph).cast("int"),
            "breakdown_24h": flag(close < pl).cast("int"),
            "trend_1h": ternary(
                (close > e20) & (e20 > e50) & (e50 > e200), (close < e20) & (e20 < e50) & (e50 < e200)
            ),
            "ema20_50_spread_pct": (e20 / e50 - 1) * 100,
            "ema50_200_spread_pct": (e50 / e200 - 1) * 100,
        }
    )
    return out.drop("_gain", "_loss", "_tr", "_ag", "_al")


def htf_features(htf: DataFrame, prefix: str, step: int, *, keys: Sequence[str] = ("symbol",), block: int = 1024) -> DataFrame:
    """close, EMA20/50, RSI, ATR % and trend of complete bars, with ``available_at``."""
    placed = with_position(htf, keys=keys, ts="timestamp", step=step, reset=False)
    bf = BlockFrame(placed, keys, before=1, size=block)
    bf.with_columns(_delta_parts(bf.lag("close")))
    w = 1 / 14
    out = bf.ewm(
        {
            "ema20": Ewm("close", span(20)),
            "ema50": Ewm("close", span(50)),
            "_ag": Ewm("_gain", w, start=1, min_periods=14),
            "_al": Ewm("_loss", w, start=1, min_periods=14),
            "_atr": Ewm("_tr", w, min_periods=14),
        }
    )
    c, e20, e50 = F.col("close"), F.col("ema20"), F.col("ema50")
    return out.select(
        *keys,
        shift_time(F.col("timestamp"), step).alias("available_at"),
        c.alias(f"{prefix}_close"),
        e20.alias(f"{prefix}_ema20"),
        e50.alias(f"{prefix}_ema50"),
        rsi_from("_ag", "_al").alias(f"{prefix}_rsi14"),
        (F.col("_atr") / c * 100).alias(f"{prefix}_atr14_pct"),
        ternary((c > e20) & (e20 > e50), (c < e20) & (e20 < e50)).alias(f"{prefix}_trend"),
    )


def feature_table(bars: DataFrame, *, keys: Sequence[str] = ("symbol",), block: int = 1024) -> DataFrame:
    """Hourly features with the last completed 4h and 1d context joined on."""
    keys = list(keys)
    out = hourly_base(bars, keys=keys, block=block).withColumn("available_at", shift_time(F.col("timestamp"), HOUR))
    contexts = []
    for prefix, step in (("4h", 4 * HOUR), ("1d", 24 * HOUR)):
        htf = htf_features(resample_ohlcv(bars, step, keys=keys), prefix, step, keys=keys, block=block)
        contexts.append(Right(htf.withColumnRenamed("available_at", f"{prefix}_available_at"), f"{prefix}_available_at"))
    out = asof_join(out, *contexts, left_on="available_at", keys=keys)
    return out.withColumn("trend_alignment", F.col("trend_1h") + F.col("4h_trend") + F.col("1d_trend"))


def segment_indicators(bars: DataFrame, step: int, *, keys: Sequence[str] = ("symbol",), block: int = 1024) -> DataFrame:
    """The 13 indicators; every gap restarts all histories.

    RSI is seeded with the mean of the first 14 deltas, the average true range
    is a plain mean of 14 whose first value in a run is unknown.
    """
    seg = [*keys, "seg"]
    placed = with_position(bars, keys=keys, ts="timestamp", step=step, reset=True)
    bf = BlockFrame(placed, seg, before=20, size=block)
    close, prev = F.col("close"), bf.lag("close")
    parts = _delta_parts(prev)
    typical = (F.col("high") + F.col("low") + close) / 3
    bf.with_columns(parts | {"return_1": close / prev - 1, "_tpv": typical * F.col("volume")})
    bf.with_columns(
        {
            "_g0": bf.rolling(F.avg("_gain"), 14, first=1),
            "_l0": bf.rolling(F.avg("_loss"), 14, first=1),
            "_atr": bf.rolling(F.avg("_tr"), 14, first=1),
            "_sma": bf.rolling(F.avg("close"), 20),
            "_std": bf.rolling(F.stddev_pop("close"), 20),
            "_tpv20": bf.rolling(F.sum("_tpv"), 20),
            "_vol20": bf.rolling(F.sum("volume"), 20),
            "_ref": bf.rolling(F.avg("volume"), 20, shift=1),
        }
    )
    out = bf.ewm(
        {
            "_e12": Ewm("close", span(12), min_periods=12),
            "_e26": Ewm("close", span(26), min_periods=26),
            "_g": Ewm("_gain", 1 / 14, start=14, seed="_g0"),
            "_l": Ewm("_loss", 1 / 14, start=14, seed="_l0"),
        }
    ).withColumn("_macd", F.col("_e12") - F.col("_e26"))
    out = BlockFrame(out, seg, size=block).ewm({"_signal": Ewm("_macd", span(9), start=25, min_periods=9)})
    g, l, macd, signal = (F.col(c) for c in ("_g", "_l", "_macd", "_signal"))
    out = out.withColumns(
        {
            "ema12_distance": close / F.col("_e12") - 1,
            "ema26_distance": close / F.col("_e26") - 1,
            "sma20_distance": close / F.col("_sma") - 1,
            "rsi14": F.when((g == 0) & (l == 0), 50.0).when(l == 0, 100.0).otherwise(100 - 100 / (1 + g / nonzero(l))),
            "macd_12_26": macd / close,
            "macd_signal9": signal / close,
            "macd_hist": (macd - signal) / close,
            "atr14_pct": F.col("_atr") / close,
            "bb20_z": (close - F.col("_sma")) / nonzero(F.col("_std")),
            "bb20_width_pct": 4 * F.col("_std") / F.col("_sma"),
            "rolling_vwap20_distance": close / (F.col("_tpv20") / nonzero(F.col("_vol20"))) - 1,
            "relative_volume20": F.col("volume") / nonzero(F.col("_ref")),
        }
    )
    return out.select(*bars.columns, "seg", "pos", *SNAPSHOT_FEATURES)


def _complete(bars: DataFrame, tf: str, step: int, base: int, keys: Sequence[str]) -> DataFrame:
    """Bars of one timeframe with ``known_at``."""
    if step == base:
        return bars.withColumn("known_at", shift_time(F.col("timestamp"), step))
    return resample_ohlcv(bars, step, base=base, keys=keys)


def snapshots(
    bars: DataFrame,
    build,
    fields: Sequence[str],
    *,
    timeframes: dict[str, int],
    keys: Sequence[str] = ("symbol",),
    impulses: dict[str, object] | None = None,
    context: Sequence[str] = ("close",),
) -> DataFrame:
    """One row per bar of the first timeframe; the others joined as of its close.

    ``build(bars, step)`` returns the fields with ``known_at``.  Matches older
    than one step of their own timeframe are dropped.  Columns in ``impulses``
    show only where the decision time equals their own ``known_at``.
    """
    impulses = impulses or {}
    base_tf, base = next(iter(timeframes.items()))
    out, rights, hidden = None, [], {}
    for tf, step in timeframes.items():
        made = build(_complete(bars, tf, step, base, keys), step)
        named = {c: f"{c}_{tf}" for c in [*context, *fields]}
        cols = [F.col(c).alias(n) for c, n in named.items()]
        if out is None:
            out = made.select(
                *keys,
                F.col("timestamp").alias(f"bar_open_{tf}"),
                F.col("known_at").alias("decision_at"),
                F.col("known_at").alias(f"known_at_{tf}"),
                *cols,
            )
            continue
        src = made.select(*keys, F.col("known_at").alias(f"known_at_{tf}"), *cols)
        rights.append(Right(src, f"known_at_{tf}", tolerance=step))
        hidden[f"known_at_{tf}"] = {named[c]: v for c, v in impulses.items()}
    out = asof_join(out, *rights, left_on="decision_at", keys=keys)
    for known, neutral in hidden.items():
        out = mask_impulses(out, neutral, decision="decision_at", known=known)
    return out


def mask_impulses(df: DataFrame, neutral: dict[str, object], *, decision: str, known: str) -> DataFrame:
    """Events show only at their own clock; elsewhere the neutral value.

    With a non-null neutral value an unmatched row (no context at all) stays
    null, except booleans, which become false.
    """
    fresh = F.col(decision) == F.col(known)
    cols = {}
    for c, v in neutral.items():
        if v is None:
            cols[c] = F.when(fresh, F.col(c))
        elif isinstance(v, bool):
            cols[c] = F.coalesce(F.col(c) & fresh, F.lit(v))
        else:
            cols[c] = F.when(fresh, F.col(c)).when(F.col(known).isNotNull(), F.lit(v))
    return df.withColumns(cols) if cols else df


def indicator_snapshots(
    bars: DataFrame, timeframes: dict[str, int] = TIMEFRAMES, *, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    return snapshots(
        bars, lambda b, s: segment_indicators(b, s, keys=keys), SNAPSHOT_FEATURES, timeframes=timeframes, keys=keys
    )


def directional_efficiency(bars: DataFrame, *, n: int = 168, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """abs(n-bar log move) / sum of abs(1-bar log moves); gap runs apart."""
    seg = [*keys, "seg"]
    placed = with_position(bars, keys=keys, ts="timestamp", step=HOUR, reset=True)
    bf = BlockFrame(placed, seg, before=n + 1)
    bf.with_columns({"log_return": F.ln(F.col("close") / bf.lag("close")), "_move": F.ln(F.col("close") / bf.lag("close", n))})
    bf.with_columns({"_path": bf.rolling(F.sum(F.abs("log_return")), n, first=1)})
    return bf.own().withColumn("efficiency", F.abs("_move") / nonzero(F.col("_path"))).drop("_move", "_path")


def trailing_context(bars: DataFrame, *, n: int = 60, step: int = HOUR, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Return, range and mean true range over the last ``n`` bars, at the close.

    Gap-free runs only, so a value means all ``n`` bars were there.
    """
    seg = [*keys, "seg"]
    placed = with_position(bars, keys=keys, ts="timestamp", step=step, reset=True)
    bf = BlockFrame(placed, seg, before=n + 1)
    close = F.col("close")
    bf.with_columns({"_tr": true_range(bf.lag("close"))})
    bf.with_columns(
        {
            "trailing_return": close / bf.lag("close", n - 1) - 1,
            "trailing_range": (bf.rolling(F.max("high"), n) - bf.rolling(F.min("low"), n)) / bf.lag("close", n - 1),
            "trailing_mean_tr": bf.rolling(F.avg("_tr"), n, first=1),
            "known_at": shift_time(F.col("timestamp"), step),
        }
    )
    return bf.own().drop("_tr")
