"""Exact ranks inside large groups, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import epoch_us
from .quantiles import cell_offsets, with_cells

CHUNK = 1024 * 3600 * 1_000_000


def rank_by_bucket(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence, out: str = "_i") -> DataFrame:
    """0-based rank in ``order`` where ``bucket`` is monotone in that order.

    Rows are sorted inside (by, bucket); bucket sizes are summed over the
    bucket table.
    """
    by = list(by)
    placed = df.withColumn("_bkt", bucket)
    upto = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "_bkt").count().withColumn("_off", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    local = Window.partitionBy(*by, "_bkt").orderBy(*order)
    return (
        placed.withColumn("_rn", F.row_number().over(local))
        .join(sizes.drop("count"), [*by, "_bkt"])
        .withColumn(out, F.col("_off") + F.col("_rn") - 1)
        .drop("_bkt", "_off", "_rn")
    )


def rank_by_time(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "_i") -> DataFrame:
    """0-based chronological rank; ``order`` starts with the timestamp column."""
    return rank_by_bucket(df, by, F.floor(epoch_us(F.col(order[0])) / CHUNK), order, out)


def rank_by_hash(df: DataFrame, by: Sequence[str], id: str, seed: int, out: str = "_i", *, digits: int = 3) -> DataFrame:
    """0-based rank in the order of md5(seed|id): a seeded random order.

    The leading hex digits split every group evenly, whatever its ids.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id).cast("string")))
    hashed = df.withColumn("_hash", h)
    return rank_by_bucket(hashed, by, F.substring("_hash", 1, digits), ["_hash", id], out).drop("_hash")


def rank_by_score(df: DataFrame, by: Sequence[str], score: str, ties: Sequence[str], out: str = "_i") -> DataFrame:
    """0-based rank by ``score`` descending, then by ``ties`` (a timestamp first).

    Distinct scores are counted and ranked by value range; rows sharing a score
    are ranked by time below it, so neither many scores nor one score held by
    most rows ends up in one task.
    """
    by = list(by)
    counted = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n")).withColumn("_neg", -F.col(score).cast("double"))
    ranged = with_cells(counted, by, "_neg")
    inside = Window.partitionBy(*by, "_rng").orderBy("_neg").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(inside), F.lit(0))
    starts = ranged.withColumn("_in", before).join(cell_offsets(ranged, by).drop("_m"), [*by, "_rng"])
    starts = starts.select(*by, score, (F.col("_off") + F.col("_in")).alias("_start"))
    tied = rank_by_time(df, [*by, score], ties, "_tie")
    return tied.join(starts, [*by, score]).withColumn(out, F.col("_start") + F.col("_tie")).drop("_start", "_tie")
