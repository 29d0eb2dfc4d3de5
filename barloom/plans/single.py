"""Values of a one-row table as columns of another, without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_values(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of ``one``, a table of one row (a total, a bound).

    The row is a scalar subquery: it is worked out once and becomes a constant,
    where a join on nothing would be a cross join.
    """
    row = one.select(F.struct(*one.columns).alias("_row")).scalar()
    return df.withColumn("_row", row).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("_row")[c].alias(c) for c in one.columns])
