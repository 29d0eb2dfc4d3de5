"""Strict merge, normalisation and projection of wide decision rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import codes, relative_level
from ..plans.blocks import epoch_us

# Numeric codes of the categorical fields.
CATEGORIES = {
    "high_structure": {"NONE": 0, "FIRST": 0, "HH": 1, "LH": -1, "EH": 2},
    "low_structure": {"NONE": 0, "FIRST": 0, "HL": 1, "LL": -1, "EL": 2},
    "event_type": {"NONE": 0, "BULLISH_BOS": 1, "BEARISH_BOS": -1, "BULLISH_CHOCH": 2, "BEARISH_CHOCH": -2},
    "zz_event": {"NONE": 0, "HIGH": 1, "LOW": -1},
    "zz_direction": {"SEEK": 0, "UP": 1, "DOWN": -1},
}
# Fixed names: model fields per timeframe, and those with an availability mask.
CONTINUOUS = [
    "return_1", "ema12_distance", "ema26_distance", "sma20_distance", "rsi14", "macd_hist", "atr14_pct", "bb20_z",
    "bb20_width_pct", "rolling_vwap20_distance", "relative_volume20", "high_distance_pct", "low_distance_pct",
    "zz_reversal_atr", "zz_age_bars",
]
LEVELS = ["active_high", "active_low", "zz_last_high", "zz_last_low"]
FLAGS = ["pivot_high_confirmed", "pivot_low_confirmed"]
NUMBERS = ["trend_direction"]
MASKED = ["high_distance_pct", "low_distance_pct", "active_high", "active_low", "zz_reversal_atr", "zz_age_bars", "zz_last_high", "zz_last_low"]


def merge_snapshots(frames: Sequence[DataFrame], identity: Sequence[str]) -> DataFrame:
    """1:1 merge on an identical grid; any difference is an error in the job.

    A full outer join per frame keeps one-sided keys visible; columns shared
    by two frames must be equal (null-safe) and are taken once.
    """
    out = frames[0]
    for frame in frames[1:]:
        shared = [c for c in frame.columns if c in out.columns and c not in identity]
        fresh = [c for c in frame.columns if c not in out.columns]
        right = frame.select(*identity, F.lit(True).alias("_r"), *[F.col(c).alias(f"_{c}") for c in shared], *fresh)
        both = out.withColumn("_l", F.lit(True)).join(right, list(identity), "full_outer")
        bad = F.col("_l").isNull() | F.col("_r").isNull()
        for c in shared:
            bad = bad | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
        first = identity[0]
        fail = F.raise_error(F.lit("snapshots do not agree"))
        kind = dict(out.dtypes)[first]
        out = both.withColumn(first, F.when(bad, fail.cast(kind)).otherwise(F.col(first))).select(*out.columns, *fresh)
    return out


def normalise(df: DataFrame, timeframes: dict[str, int], *, keys: Sequence[str] = ("symbol",), decision: str = "decision_at") -> DataFrame:
    """Codes, relative levels, flags and masks; stale or future context fails.

    Every value is null where its timeframe's context is absent; values are
    kept in double and cast to float at the end.
    """
    out = [F.col(c) for c in keys] + [F.col(decision)]
    for tf, step in timeframes.items():
        known = F.col(f"known_at_{tf}")
        age = epoch_us(F.col(decision)) - epoch_us(known)
        wrong = F.raise_error(F.lit(f"future or stale context {tf}")).cast("int")
        present = known.isNotNull()
        out.append(F.when(present & ~age.between(0, step * 1_000_000), wrong).otherwise(present.cast("int")).alias(f"context_available_{tf}"))
        for c in [*CONTINUOUS, *LEVELS, *FLAGS, *NUMBERS, *CATEGORIES]:
            name = f"{c}_{tf}"
            if name not in df.columns:
                continue
            x = F.col(name)
            if c in LEVELS:
                x, target = relative_level(x, F.col(f"close_{tf}")), f"{c}_distance_to_close_{tf}"
            elif c in CATEGORIES:
                x, target = codes(x, CATEGORIES[c]), f"{name}_code"
            else:
                x, target = x.cast("int") if c in FLAGS else x, name
            x = F.when(present, x.cast("float"))
            out.append(x.alias(target))
            if c in MASKED:
                out.append(x.isNotNull().cast("int").alias(f"{target}_available"))
    return df.select(*out)


def feature_schema(df: DataFrame, *, drop: Sequence[str] = ("symbol", "decision_at")) -> tuple[list[str], str]:
    """Ordered feature names and the SHA-256 of their JSON list."""
    import hashlib
    import json

    names = [c for c in df.columns if c not in drop]
    return names, hashlib.sha256(json.dumps(names).encode()).hexdigest()


def project(df: DataFrame, names: Sequence[str], digest: str, *, keep: Sequence[str] = ("symbol", "decision_at")) -> DataFrame:
    """White-list projection in schema order, after checking the schema hash."""
    import hashlib
    import json

    if hashlib.sha256(json.dumps(list(names)).encode()).hexdigest() != digest:
        raise ValueError("feature schema changed")
    return df.select(*keep, *names)
