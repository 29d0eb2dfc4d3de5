"""Splits, folds, balanced samples, rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import epoch_us, shift_time
from ..plans.quantiles import quantiles
from ..plans.ranks import rank_by_hash, rank_by_score, rank_by_time
from ..plans.single import with_values
from .bars import HOUR


def chrono_split(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    ts: str = "timestamp",
    train: float = 0.70,
    validation: float = 0.15,
    purge: int = 24 * HOUR,
) -> DataFrame:
    """train / validation / test by chronological position, purged between.

    Boundaries are the timestamps at floor(n * ratio); rows in the purge gap
    before a boundary are dropped.
    """
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = rank_by_time(df.select(*keys, ts), keys, [ts])
    at = lambda f: F.min(F.when(F.col("_i") == F.floor(F.col("_n") * f), F.col(ts)))
    bounds = placed.join(counts, keys).groupBy(*keys).agg(at(train).alias("_v"), at(train + validation).alias("_t"))
    t = F.col(ts)
    split = (
        F.when(t < shift_time(F.col("_v"), -purge), "train")
        .when((t >= F.col("_v")) & (t < shift_time(F.col("_t"), -purge)), "validation")
        .when(t >= F.col("_t"), "test")
    )
    return df.join(bounds, keys).withColumn("split", split).filter(F.col("split").isNotNull()).drop("_v", "_t")


def walk_forward(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    order: Sequence[str] = ("timestamp", "event_id"),
    start: float = 0.5,
    folds: int = 5,
    purge: int = 24 * HOUR,
    known_at: str = "known_at",
    label_at: str = "label_available_at",
) -> DataFrame:
    """Rows with their ``fold`` and ``role`` (past / future), one row per use.

    A fold's past holds only rows known ``purge`` seconds before the fold and
    whose label was known before it.  The few folds of a key travel as one
    array next to each row: an equi-join, no row-by-row pairing.
    """
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = rank_by_time(df, keys, list(order)).join(counts, keys)
    first = F.floor(F.col("_n") * start)
    edge = lambda f: first + F.floor((F.col("_n") - first) * f / folds)
    number = F.lit(None).cast("int")
    for f in range(folds, 0, -1):
        number = F.when(F.col("_i") < edge(f), f).otherwise(number)
    rows = rows.withColumn("_fold", F.when(F.col("_i") >= first, number))
    heads = (
        rows.filter(F.col("_fold").isNotNull()).groupBy(*keys, "_fold").agg(F.min(known_at).alias("start"), F.min("_i").alias("left"))
        .groupBy(*keys).agg(F.collect_list(F.struct(F.col("_fold").alias("fold"), "start", "left")).alias("_folds"))
    )
    joined = rows.join(heads, keys)
    past = F.filter(
        "_folds",
        lambda f: (F.col("_i") < f["left"])
        & (F.col(known_at) < f["start"] - F.expr(f"INTERVAL '{purge}' SECOND"))
        & (F.col(label_at) < f["start"]),
    )
    uses = F.concat(
        F.transform(past, lambda f: F.struct(f["fold"].alias("fold"), F.lit("past").alias("role"))),
        F.when(F.col("_fold").isNotNull(), F.array(F.struct(F.col("_fold").alias("fold"), F.lit("future").alias("role")))).otherwise(
            F.expr("cast(array() as array<struct<fold:int,role:string>>)")
        ),
    )
    return joined.withColumn("_u", F.explode(uses)).select(*df.columns, "_u.fold", "_u.role")


def quartile_periods(df: DataFrame, *, keys: Sequence[str] = (), order: Sequence[str] = ("timestamp", "event_id"), k: int = 4, prefix: str = "TRAIN_Q") -> DataFrame:
    """Chronological k-quantile period by row position."""
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = rank_by_time(df, keys, list(order))
    joined = rows.join(n, keys) if keys else with_values(rows, n)
    number = F.least(F.lit(k), F.floor(F.lit(k) * F.col("_i") / F.col("_n")) + 1)
    return joined.withColumn("period", F.concat(F.lit(prefix), number.cast("string"))).drop("_i", "_n")


def sample_per_class(df: DataFrame, label: str, quota: Column, *, id: str, seed: int, strict: bool = False) -> DataFrame:
    """The first ``quota`` rows per class in seeded hash order.

    ``quota`` may use ``_n`` (rows of the class) and ``_min`` (smallest class).
    ``strict`` raises if a class has fewer rows than its quota.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    quotas = with_values(counts, counts.agg(F.min("_n").alias("_min"))).withColumn("_q", quota.cast("long"))
    if strict:
        short = F.raise_error(F.concat(F.lit("class too small: "), F.col(label).cast("string"))).cast("long")
        quotas = quotas.withColumn("_q", F.when(F.col("_n") < F.col("_q"), short).otherwise(F.col("_q")))
    ranked = rank_by_hash(df, [label], id, seed)
    return ranked.join(quotas.select(label, "_q"), label).filter(F.col("_i") < F.col("_q")).drop("_i", "_q")


def balance_to_smallest(df: DataFrame, label: str, *, id: str, seed: int = 42) -> DataFrame:
    return sample_per_class(df, label, F.col("_min"), id=id, seed=seed)


def balance_ratio(df: DataFrame, label: str, majority, *, share: float = 0.6, id: str, seed: int = 42) -> DataFrame:
    """Down-sample one class to ``share`` of the result; the others stay whole."""
    other = df.filter(F.col(label) != F.lit(majority)).agg(F.count(F.lit(1)).alias("_other"))
    ranked = with_values(rank_by_hash(df.filter(F.col(label) == F.lit(majority)), [label], id, seed), other)
    quota = F.floor(F.col("_other") * F.lit(share) / F.lit(1 - share) + 1e-9)
    kept = ranked.filter(F.col("_i") < quota).drop("_i", "_other")
    return df.filter(F.col(label) != F.lit(majority)).unionByName(kept)


def stratified(df: DataFrame, label: str, n: int, *, id: str, seed: int = 42) -> DataFrame:
    return sample_per_class(df, label, F.lit(n), id=id, seed=seed, strict=True)


def stride_rows(df: DataFrame, every: int, *, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Every k-th row in time order."""
    return rank_by_time(df, keys, list(order)).filter(F.col("_i") % every == 0).drop("_i")


def stride_schedule(df: DataFrame, *, first: str, stride: int, count: int, keys: Sequence[str] = ("symbol",), ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Rows at a fixed time schedule, and the scheduled times that have no row."""
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.timestamp_micros(
        F.unix_micros(F.lit(first).cast("timestamp")) + i.cast("long") * stride * 1_000_000).cast("timestamp_ntz")))
    plan = df.select(*keys).distinct().select(*keys, at.alias(ts))
    return plan.join(df, [*keys, ts]), plan.join(df.select(*keys, ts), [*keys, ts], "left_anti")


def profile_picks(df: DataFrame, criteria: Mapping[str, tuple[str, bool]], *, ts: str, key: Sequence[str], middle: Sequence[str]) -> DataFrame:
    """Top row by each criterion without reuse, then the row nearest the medians.

    Each pick is a bounded top-1; earlier picks leave by anti-join.  Distance
    to the median is scaled by the column's interquartile range.
    """
    key, left, picks = list(key), df, None
    for name, (col, ascending) in criteria.items():
        order = F.col(col).asc() if ascending else F.col(col).desc()
        one = left.orderBy(order, ts, *key).limit(1).withColumn("profile", F.lit(name))
        picks = one if picks is None else picks.unionByName(one)
        left = left.join(one.select(ts, *key), [ts, *key], "left_anti")
    dist = F.lit(0.0)
    wide = left
    for c in middle:
        q = quantiles(df, [], c, {f"_{c}_a": 0.25, f"_{c}_m": 0.5, f"_{c}_b": 0.75}).drop("n")
        wide = with_values(wide, q)
        spread = F.col(f"_{c}_b") - F.col(f"_{c}_a")
        dist = dist + F.abs(F.col(c) - F.col(f"_{c}_m")) / F.when(spread > 0, spread).otherwise(1.0)
    last = wide.withColumn("_d", dist).orderBy("_d", ts, *key).limit(1).select(*df.columns, F.lit("median").alias("profile"))
    return picks.unionByName(last)


def newest(df: DataFrame, n: int, *, ts: str = "timestamp", tie: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows, oldest first."""
    return df.orderBy(F.desc(ts), *tie).limit(n).orderBy(ts, *tie)


def top_fraction(df: DataFrame, score: str, *, by: Sequence[str], ties: Sequence[str], fractions: Sequence[float] = (0.10, 0.25, 0.50, 1.00)) -> DataFrame:
    """Rows of the top ceil(n * f) by score, repeated per fraction."""
    by = list(by)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = rank_by_score(df, by, score, list(ties)).join(n, by)
    rows = rows.withColumn("top_fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    k = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.col("top_fraction")))
    return rows.filter(F.col("_i") < k).drop("_i", "_n")


def asset_roles(df: DataFrame, held_out: Sequence[str], *, key: str = "symbol") -> DataFrame:
    return df.withColumn("role", F.when(F.col(key).isin(*held_out), "HELD_OUT").otherwise("TRAIN"))


def overlap_count(df: DataFrame, horizon: int, *, by: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Successive rows closer than the horizon, per group."""
    from ..plans.blocks import BlockFrame

    by = list(by)
    placed = rank_by_time(df.select(*by, ts), by, [ts])
    bf = BlockFrame(placed, by, pos="_i", before=1)
    rows = bf.with_columns({"_gap": epoch_us(F.col(ts)) - epoch_us(bf.lag(ts))}).own()
    close = F.coalesce(F.col("_gap") < horizon * 1_000_000, F.lit(False))
    return rows.groupBy(*by).agg(F.sum(close.cast("long")).alias("close_pairs"), (F.count(F.lit(1)) - 1).alias("pairs"))
