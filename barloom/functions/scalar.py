"""Decisions, outcomes, scores, bins and codes as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decision labels, event names.
LABELS = ["NO_TRADE", "LONG_BIAS", "SHORT_BIAS"]
OUTCOME_NAMES = {1: "TP", -1: "SL", 0: "UNRESOLVED"}


def _sign(a: Column, b: Column) -> Column:
    return F.when(a > b, 1).when(a < b, -1).otherwise(0)


def bias_score() -> Column:
    """Observable context score, -6 .. +6."""
    rsi = F.col("rsi14")
    trends = [F.coalesce(F.col(c), F.lit(0)) for c in ("trend_1h", "4h_trend", "1d_trend")]
    score = trends[0] + trends[1] + trends[2]
    score = score + _sign(F.col("close"), F.col("ema20")) + _sign(F.col("ema20"), F.col("ema50"))
    return (score + F.when(rsi.between(52, 70), 1).when(rsi.between(30, 48), -1).otherwise(0)).cast("int")


def decision_of(score: Column, cut: int = 2) -> Column:
    return F.when(score >= cut, "LONG_BIAS").when(score <= -cut, "SHORT_BIAS").otherwise("NO_TRADE")


def training_target(score: Column, long_outcome: Column, short_outcome: Column) -> Column:
    """Score AND realised outcome; null when the outcome is ambiguous."""
    known = long_outcome.isNotNull() & short_outcome.isNotNull()
    return F.when(
        known,
        F.when((score >= 2) & (long_outcome == 1) & (short_outcome != 1), "LONG_BIAS")
        .when((score <= -2) & (short_outcome == 1) & (long_outcome != 1), "SHORT_BIAS")
        .otherwise("NO_TRADE"),
    )


def outcome_name(value: Column) -> Column:
    out = F
    for v, name in OUTCOME_NAMES.items():
        out = out.when(value == v, name)
    return out.otherwise("UNKNOWN")


def outcome_of(decision: Column, long_outcome: Column, short_outcome: Column) -> Column:
    """Outcome of the side a decision took; NO_TRADE when it stayed out."""
    return (
        F.when(decision == "NO_TRADE", "NO_TRADE")
        .when(decision == "LONG_BIAS", outcome_name(long_outcome))
        .when(decision == "SHORT_BIAS", outcome_name(short_outcome))
        .otherwise("UNKNOWN")
    )


def trend_name(c: Column) -> Column:
    return F.when(c.isNull(), "INCONNU").when(c > 0, "HAUSSIER").when(c < 0, "BAISSIER").otherwise("NEUTRE")


def yes_no(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0)) == 1, "OUI").otherwise("NON")


def right_closed(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed bin holding x; MISSING for null.

    ``labels`` has one more entry than ``edges``.
    """
    out = F.when(x.isNull(), "MISSING")
    for edge, label in zip(edges, labels):
        out = out.when(x <= edge, label)
    return out.otherwise(labels[-1])


def codes(c: Column, mapping: Mapping[str, int]) -> Column:
    """Category to number; an unknown non-null category raises."""
    items = [F.lit(x) for kv in mapping.items() for x in kv]
    code = F.element_at(F.create_map(*items), c)
    return F.when(c.isNotNull() & code.isNull(), F.raise_error(F.concat(F.lit("unknown category "), c))).otherwise(code)


def relative_level(level: Column, close: Column) -> Column:
    return level / close - 1


def masked(df: DataFrame, cols: Sequence[str], present: Column | None = None) -> DataFrame:
    """Add ``<col>_available`` (0/1); null a feature whose context is absent."""
    out = {}
    for c in cols:
        x = F.col(c) if present is None else F.when(present, F.col(c))
        out[c] = x
        out[f"{c}_available"] = x.isNotNull().cast("int")
    return df.withColumns(out)


def guard_columns(columns: Sequence[str], blocked: Sequence[str]) -> list[str]:
    """Names as given, or an error if one carries future information."""
    bad = [c for c in columns if any(b in c for b in blocked)]
    if bad:
        raise ValueError(f"future-derived columns in X: {bad}")
    return list(columns)


def epoch_seconds(c: Column) -> Column:
    return F.unix_timestamp(c.cast("timestamp"))


def from_epoch_seconds(c: Column) -> Column:
    return F.timestamp_seconds(c).cast("timestamp_ntz")
