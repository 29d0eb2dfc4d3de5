"""Backward as-of join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .blocks import epoch_us

DAY = 86_400


@dataclass(frozen=True)
class Right:
    """A table to look back into: its clock column and optional tolerance (s)."""

    df: DataFrame
    on: str
    tolerance: int | None = None
    exact: bool = True


def asof_join(
    left: DataFrame,
    *rights: Right,
    left_on: str,
    keys: Sequence[str] = ("symbol",),
    bucket: int = 64 * DAY,
) -> DataFrame:
    """Each left row with the latest row at or before it of every right table.

    All tables are tagged, unioned and scanned together: one shuffle, however
    many right tables.  The scan runs inside time buckets of ``bucket`` seconds
    per key, so one long key is many tasks.  With a ``tolerance`` (inclusive)
    right rows near a bucket's end are copied into the next one; without, the
    last right row of every bucket is carried forward over the bucket table.
    A whole right row travels as a struct: a null inside the matched row stays
    null.
    """
    keys = list(keys)
    us = bucket * 1_000_000
    home = F.floor(epoch_us(F.col("_t")) / us)
    both = left.withColumns({"_t": F.col(left_on), "_side": F.lit(1)}).withColumn("_bucket", home)
    payloads = []
    for i, right in enumerate(rights):
        payload = [c for c in right.df.columns if c not in keys]
        payloads.append(payload)
        r = right.df.select(
            *keys,
            F.col(right.on).alias("_t"),
            F.lit(0 if right.exact else 2).alias("_side"),
            F.struct(*payload).alias(f"_r{i}"),
        ).filter(F.col("_t").isNotNull())
        if right.tolerance is None:
            r = r.withColumn("_bucket", home)
        else:
            if right.tolerance > bucket:
                raise ValueError("tolerance must not exceed the bucket")
            reach = F.floor((epoch_us(F.col("_t")) + right.tolerance * 1_000_000) / us)
            r = r.withColumn("_bucket", F.explode(F.sequence(home, reach)))
        both = both.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_bucket").orderBy("_t", "_side")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    hits = {f"_h{i}": F.last(f"_r{i}", ignorenulls=True).over(upto) for i in range(len(rights))}
    out = both.withColumns(hits)
    carried = [i for i, r in enumerate(rights) if r.tolerance is None]
    if carried:
        out = cut(out)
        ends = out.groupBy(*keys, "_bucket").agg(
            *[F.max_by(f"_r{i}", F.when(F.col(f"_r{i}").isNotNull(), F.col("_t"))).alias(f"_e{i}") for i in carried]
        )
        before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.withColumns({f"_c{i}": F.last(f"_e{i}", ignorenulls=True).over(before) for i in carried})
        carry = carry.select(*keys, "_bucket", *[f"_c{i}" for i in carried])
        out = out.filter(F.col("_side") == 1).join(carry, [*keys, "_bucket"], "left")
        out = out.withColumns({f"_h{i}": F.coalesce(f"_h{i}", f"_c{i}") for i in carried})
    else:
        out = out.filter(F.col("_side") == 1)
    fresh = {}
    for i, r in enumerate(rights):
        if r.tolerance is not None:
            age = epoch_us(F.col("_t")) - epoch_us(F.col(f"_h{i}.`{r.on}`"))
            fresh[f"_h{i}"] = F.when(age <= r.tolerance * 1_000_000, F.col(f"_h{i}"))
    out = out.withColumns(fresh) if fresh else out
    picked = [F.col(f"_h{i}.`{c}`").alias(c) for i, payload in enumerate(payloads) for c in payload]
    return out.select(*left.columns, *picked)
