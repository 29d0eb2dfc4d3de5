"""State machines whose chunks are small functions from the state they get to the state they leave.

A chunk's function is a table of pieces (``upto``, ``out``), sorted by
``upto``: a state below ``upto`` of the first such piece leaves ``out``; a state
beyond all pieces leaves the chunk as it came.  Tables compose to tables, so the
states at all chunk borders follow from pairwise composition by doubling: the
number of jobs grows with the logarithm of the chunks, whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def left_by(table: Column, state: Column, strict: bool = True) -> Column:
    """What ``table`` makes of ``state``; a null state enters the first piece."""
    below = F.filter(table, lambda p: state.isNull() | ((state < p["upto"]) if strict else (state <= p["upto"])))
    first = F.get(below, F.lit(0))
    return F.when(first.isNull(), state).otherwise(first["out"])


def joined_pieces(table: Column) -> Column:
    """``table`` with neighbouring pieces of one result made one."""
    return F.filter(table, lambda p, i: ~F.coalesce(F.get(table, i + 1)["out"] == p["out"], F.lit(False)))


def composed(first: Column, then: Column, strict: bool = True) -> Column:
    """Table of ``then`` after ``first``."""
    through = F.transform(first, lambda p: F.struct(p["upto"].alias("upto"), left_by(then, p["out"], strict).alias("out")))
    last = F.get(first, F.size(first) - 1)["upto"]
    return F.concat(through, F.filter(then, lambda p: p["upto"] > last))


def states_at_borders(tables: DataFrame, *, keys: Sequence[str], chunk: str, table: str, strict: bool = True) -> DataFrame:
    """(keys, ``chunk``, ``_state``): the state each chunk gets, null for the first of a series.

    ``tables`` has one row per chunk, numbered from 0 without gaps, each with
    at least one piece.  Round r composes each chunk's table with that of the
    2**r chunks before it.
    """
    keys = list(keys)
    own = materialise(tables.select(*keys, chunk, F.col(table).alias("_t")), "transfer")
    last = own.agg(F.max(chunk)).first()[0] or 0
    reach = 1
    while reach <= last:
        before = own.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col(chunk) + reach).alias("_at"), F.col("_t").alias("_before"))
        same = F.col(chunk) == F.col("_at")
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        both = own.join(before, same, "left")
        # a column of its own: the pieces are looked at twice when neighbours are joined
        longer = both.select(*keys, chunk, F.when(F.col("_before").isNull(), F.col("_t")).otherwise(composed(F.col("_before"), F.col("_t"), strict)).alias("_u"))
        own = materialise(longer.select(*keys, chunk, joined_pieces(F.col("_u")).alias("_t")), "transfer")
        reach *= 2
    entered = own.select(*keys, (F.col(chunk) + 1).alias(chunk), F.get("_t", F.lit(0))["out"].alias("_state"))
    nothing = own.where(F.col(chunk) == 0).select(*keys, chunk, F.lit(None).cast(entered.schema["_state"].dataType).alias("_state"))
    return entered.unionByName(nothing)
