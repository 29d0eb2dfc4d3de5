"""Correlations over long sliding windows, at a cost that does not depend on the window's length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Share of the sum of squares below which a variance is rounding noise of a constant.
NOISE = 1e-12


def sliding_correlation(rows: DataFrame, keys: Sequence[str], pos: str, x: str, y: str, window: int) -> DataFrame:
    """keys, pos, n (rows where both are known) and correlation of the ``window`` positions up to each row.

    Positions are whole numbers from 0, one row each, absent values null.  A
    window is the end of one block of ``window`` positions and the begin of the
    next: sums run forwards and backwards inside each block, and every backward
    sum is sent to the one row whose window it begins.  Nothing is subtracted,
    so the sums stay exact to rounding; means must not be large against the
    spread (returns are not).  Null if either side is constant.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    keys = list(keys)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")).otherwise(0.0) for c in (x, y))
    terms = {"n": both.cast("long"), "x": a, "y": b, "xx": a * a, "yy": b * b, "xy": a * b}
    at = F.col(pos).cast("long")
    placed = rows.select(*keys, at.alias("_at"), F.floor(at / window).alias("_blk"), *[t.alias(f"_{c}") for c, t in terms.items()])
    block = Window.partitionBy(*keys, "_blk")
    up = block.orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = block.orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.select(
        *keys, "_at", *[F.sum(f"_{c}").over(up).alias(f"_u{c}") for c in terms], *[F.sum(f"_{c}").over(down).alias(f"_d{c}") for c in terms]
    )
    here = F.struct(F.col("_at").alias("at"), F.lit(1).alias("own"), *[F.col(f"_u{c}").alias(c) for c in terms])
    ahead = F.struct((F.col("_at") + (window - 1)).alias("at"), F.lit(0).alias("own"), *[F.col(f"_d{c}").alias(c) for c in terms])
    # the window that begins with a block ends with it: its forward sum is whole
    parts = F.when(F.col("_at") % window == 0, F.array(here)).otherwise(F.array(here, ahead))
    total = (
        summed.select(*keys, F.explode(parts).alias("_p")).groupBy(*keys, F.col("_p.at").alias("_at"))
        .agg(F.max("_p.own").alias("_own"), *[F.sum(f"_p.{c}").alias(f"_{c}") for c in terms]).filter("_own = 1")
    )
    n = F.nullif(F.col("_n"), F.lit(0))
    vx, vy = (F.col(f"_{c}{c}") - F.col(f"_{c}") * F.col(f"_{c}") / n for c in "xy")
    known = (vx > F.col("_xx") * NOISE) & (vy > F.col("_yy") * NOISE)
    value = (F.col("_xy") - F.col("_x") * F.col("_y") / n) / F.nullif(F.sqrt(vx) * F.sqrt(vy), F.lit(0.0))
    return total.select(*keys, F.col("_at").alias(pos), F.col("_n").alias("n"), F.when(known, value).alias("correlation"))
