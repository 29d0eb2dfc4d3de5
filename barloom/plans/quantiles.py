"""Exact, linearly interpolated quantiles of large groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .single import with_values

BUCKETS = 64
FINE = 1024


def _on(by: Sequence[str], *extra: str) -> Column:
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    for c in extra:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return cond


def with_cells(counted: DataFrame, by: Sequence[str], value: str, *, total: str = "_n", buckets: int = BUCKETS, fine: int = FINE) -> DataFrame:
    """Add ``_rng``, a value range that grows with ``value``, and ``n``, the group's rows.

    A bounded sketch cuts each group into ``buckets`` even ranges; each is cut
    again into ``fine`` equal widths, so a range holds about one row in
    65 000 of its group whatever the group's size.
    """
    by = list(by)
    grid = [i / buckets for i in range(1, buckets)]
    edges = F.concat(
        F.array(F.min(value)), F.percentile_approx(value, grid, F.lit(20 * buckets)), F.array(F.max(value))
    )
    cuts = counted.groupBy(*by).agg(edges.alias("_edges"), F.sum(total).alias("n"))
    if by:
        joined = counted.alias("a").join(cuts.alias("b"), _on(by)).select("a.*", "b._edges", "b.n")
    else:
        joined = with_values(counted, cuts)
    v = F.col(value)
    inner = F.slice("_edges", 2, buckets - 1)
    joined = joined.withColumn("_r", F.size(F.filter(inner, lambda c: c < v)))
    lo, hi = F.get("_edges", F.col("_r")), F.get("_edges", F.col("_r") + 1)
    part = F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * fine), F.lit(fine - 1))).otherwise(0)
    return joined.withColumn("_rng", F.col("_r") * fine + part).drop("_edges", "_r")


def cell_offsets(ranged: DataFrame, by: Sequence[str], total: str = "_n") -> DataFrame:
    """Rows in each range (``_m``) and in all ranges before it (``_off``)."""
    upto = Window.partitionBy(*by).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*by, "_rng").agg(F.sum(total).alias("_m"))
    return sizes.withColumn("_off", F.coalesce(F.sum("_m").over(upto), F.lit(0)))


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    buckets: int = BUCKETS,
    fine: int = FINE,
) -> DataFrame:
    """One row per group: ``n`` and one column per named probability.

    ``percentile`` would gather every distinct value of a group in one task.
    Here equal values are counted map-side first, a bounded sketch cuts each
    group into value ranges, ranks are found on the range table, and only the
    few ranges that hold a wanted rank are sorted at all.
    """
    by = list(by)
    v = F.col(value).cast("double")
    counted = df.select(*by, v.alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(
        F.count(F.lit(1)).alias("_n")
    )
    ranged = with_cells(counted, by, "_v", buckets=buckets, fine=fine)
    rank = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in probs.items()}
    wanted = F.lit(False)
    for r in rank.values():
        for at in (F.floor(r), F.ceil(r)):
            wanted = wanted | ((F.col("_off") <= at) & (at < F.col("_off") + F.col("_m")))
    sizes = cell_offsets(ranged, by)
    near = ranged.alias("a").join(sizes.alias("b"), _on(by, "_rng")).select("a.*", "b._off", "b._m").filter(wanted)
    inside = Window.partitionBy(*by, "_rng").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("_hi", F.col("_off") + F.sum("_n").over(inside) - 1).withColumn(
        "_lo", F.col("_hi") - F.col("_n") + 1
    )
    picks, outs = [], []
    for i, (name, r) in enumerate(rank.items()):
        for side, at in (("f", F.floor(r)), ("c", F.ceil(r))):
            picks.append(F.max(F.when((F.col("_lo") <= at) & (at <= F.col("_hi")), F.col("_v"))).alias(f"_{side}{i}"))
        frac = r - F.floor(r)
        outs.append((F.col(f"_f{i}") + (F.col(f"_c{i}") - F.col(f"_f{i}")) * frac).alias(name))
    return ranked.groupBy(*by, "n").agg(*picks).select(*by, "n", *outs)


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], *, name: str = "feature", value: str = "x") -> DataFrame:
    """Columns to (name, value) rows; values cast to double."""
    narrow = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return narrow.unpivot(list(ids), list(cols), name, value)
