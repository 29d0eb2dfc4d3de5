"""Machines that follow one extreme until a reversal, over long series, without running chunks in turn.

After its search for a direction such a machine knows only the bar of its
running extreme and the side it is on.  A later bar either goes beyond the
extreme, or its close reaches the extreme's threshold; both make that bar the
new extreme, on the same or the other side, and what came before is forgotten.
So a chunk is, for each side, a list of pieces in time order: the first piece
that an entering extreme meets (its height is below ``hi``, or its threshold is
at ``lo`` or above) names the extreme that leaves the chunk; an extreme that
meets none leaves as it came.  Neighbouring pieces with one result are one, so
a trend of any length is one piece.  Lists compose to lists, and the state at
every chunk's border follows by doubling: jobs grow with the logarithm of the
chunks.

Heights, thresholds and closes of the falling side are negated, so one rule
serves both.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .blocks import SCAN_BLOCK

OUT = "side int, mark long, x double, thr double, ref double"
PIECES = "array<struct<hi: double, lo: double, out: struct<side: int, mark: long, x: double, thr: double, ref: double>>>"


def exits(high: Sequence, low: Sequence, close: Sequence, rise_thr: Sequence, fall_thr: Sequence, turn_first: bool) -> tuple:
    """(heights, closes, thresholds, last extreme reached from each bar as the extreme), each for the rising and the falling side."""
    height = [list(high), [-v for v in low]]
    closes = [list(close), [-v for v in close]]
    limit = [list(rise_thr), [-v for v in fall_thr]]
    n = len(height[0])
    reached: list[list] = [[None] * n, [None] * n]
    # per side, what lies ahead: bars no nearer bar is as high as (heights negated), and bars no nearer bar closes as low as
    above: list[tuple[list, list]] = [([], []), ([], [])]
    below: list[tuple[list, list]] = [([], []), ([], [])]
    for i in range(n - 1, -1, -1):
        for s in (0, 1):
            values, bars = above[s]
            at = bisect_left(values, -height[s][i]) - 1
            beyond = bars[at] if at >= 0 else n
            values, bars = below[s]
            at = bisect_right(values, limit[s][i]) - 1
            turned = bars[at] if at >= 0 else n
            if beyond == turned == n:
                reached[s][i] = (s, i)
            elif turned < beyond or (turned == beyond and turn_first):
                reached[s][i] = reached[1 - s][turned]
            else:
                reached[s][i] = reached[s][beyond]
        for s in (0, 1):
            for (values, bars), v in ((above[s], -height[s][i]), (below[s], closes[s][i])):
                while values and values[-1] >= v:
                    values.pop(), bars.pop()
                values.append(v), bars.append(i)
    return height, closes, limit, reached


def pieces(height: Sequence, closes: Sequence, same: Sequence, other: Sequence, turn_first: bool) -> list[tuple[float, float, tuple]]:
    """Pieces of one side: (highest so far, lowest close so far, extreme that leaves)."""
    hi, lo, out = -np.inf, np.inf, []
    for h, c, on, off in zip(height, closes, same, other):
        for turn in (True, False) if turn_first else (False, True):
            if turn and c < lo:
                lo, left = c, off
            elif not turn and h > hi:
                hi, left = h, on
            else:
                continue
            if out and out[-1][2] == left:
                out.pop()
            out.append((hi, lo, left))
    return out


def first_direction(
    high: np.ndarray, low: np.ndarray, close: np.ndarray, rise_thr: np.ndarray, fall_thr: np.ndarray, before: tuple, own: bool
) -> tuple[int, int] | None:
    """(side, bar) at which the search ends: the close reaches the threshold of the lowest low or the highest high.

    ``before`` holds (height, threshold) of the highest high and the lowest low
    of earlier chunks, or nothing.  With ``own`` a bar counts among the bars
    whose extremes it is tested against and a rise goes first; else it does
    not, and a bar that does both is passed over.
    """
    if not len(high):
        return None
    met = []
    for s, (height, limit) in enumerate(((high, rise_thr), (-low, -fall_thr))):
        x, thr = before[s] if before[s] is not None else (-np.inf, -np.inf)
        top = np.maximum.accumulate(np.concatenate(([x], height)))
        record = np.maximum.accumulate(np.where(height > top[:-1], np.arange(1, len(height) + 1), 0))
        at = np.concatenate(([thr], limit))[np.concatenate(([0], record))]
        met.append((close if s == 0 else -close) <= (at[1:] if own else at[:-1]))
    fell, rose = met
    hit = rose | fell if own else rose != fell
    if not hit.any():
        return None
    i = int(hit.argmax())
    return (0 if rose[i] else 1), i


def _left(up: Column, down: Column, state: Column) -> Column:
    """The state that leaves a chunk with these pieces."""
    table = F.when(state["side"] > 0, up).otherwise(down)
    met = F.get(F.filter(table, lambda p: (state["x"] < p["hi"]) | (state["thr"] >= p["lo"])), F.lit(0))
    return F.when(met.isNull(), state).otherwise(met["out"])


def _joined(table: Column) -> Column:
    return F.filter(table, lambda p, i: ~F.coalesce(F.get(table, i + 1)["out"] == p["out"], F.lit(False)))


def _composed(first: Column, up: Column, down: Column, then: Column) -> Column:
    """Pieces of ``first``, then those of the next chunk (``then``; both of its sides are ``up`` and ``down``) that can still be met."""
    through = F.transform(first, lambda p: F.struct(p["hi"].alias("hi"), p["lo"].alias("lo"), _left(up, down, p["out"]).alias("out")))
    last = F.get(first, F.size(first) - 1)
    hi, lo = F.coalesce(last["hi"], F.lit(float("-inf"))), F.coalesce(last["lo"], F.lit(float("inf")))
    later = F.filter(then, lambda p: (p["hi"] > hi) | (p["lo"] < lo))
    later = F.transform(later, lambda p: F.struct(F.greatest(p["hi"], hi).alias("hi"), F.least(p["lo"], lo).alias("lo"), p["out"].alias("out")))
    return F.concat(through, later)


def states_between(tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ``_chunk``, ``_state``) of every chunk behind the one in which a series' search ends.

    ``tables`` has ``up``, ``down`` and ``start`` (the extreme that leaves the
    chunk if the search ends in it) of every chunk of every series.
    """
    keys = list(keys)
    found = tables.where(F.col("start").isNotNull()).groupBy(*keys).agg(F.min("_chunk").alias("_from"))
    own = tables.join(found, keys).where(F.col("_chunk") >= F.col("_from"))
    fixed = F.array(F.struct(F.lit(float("inf")).alias("hi"), F.lit(float("-inf")).alias("lo"), F.col("start").alias("out")))
    begins = F.col("_chunk") == F.col("_from")
    own = own.select(
        *keys, "_from", (F.col("_chunk") - F.col("_from")).alias("_n"),
        *[F.when(begins, fixed).otherwise(F.col(c)).cast(PIECES).alias(c) for c in ("up", "down")],
    )
    own = materialise(own, "turns")
    last = own.agg(F.max("_n")).first()[0] or 0
    reach = 1
    while reach <= last:
        before = own.select(*keys, (F.col("_n") + reach).alias("_n"), F.col("up").alias("_up"), F.col("down").alias("_down"))
        both = own.join(before, [*keys, "_n"], "left")
        longer = both.select(
            *keys, "_from", "_n",
            *[
                F.when(F.col(b).isNull(), F.col(c)).otherwise(_composed(F.col(b), F.col("up"), F.col("down"), F.col(c))).alias(c)
                for c, b in (("up", "_up"), ("down", "_down"))
            ],
        )
        own = materialise(longer.select(*keys, "_from", "_n", *[_joined(F.col(c)).alias(c) for c in ("up", "down")]), "turns")
        reach *= 2
    # each list now starts with the search's end, which every state enters
    return own.select(*keys, (F.col("_from") + F.col("_n") + 1).alias("_chunk"), F.get("up", F.lit(0))["out"].alias("_state"))


def folded_turns(
    df: DataFrame,
    *,
    keys: Sequence[str],
    pos: str,
    mark: Column,
    thresholds: tuple[Column, Column],
    ref: Column | None,
    turn_first: bool,
    search_own: bool,
    searching: Callable[[tuple | None, tuple | None], dict | None],
    following: Callable[[int, int, float, float], dict],
    step: Callable[[pd.DataFrame, dict | None], tuple[pd.DataFrame, dict]],
    schema: str,
    size: int = SCAN_BLOCK,
) -> tuple[DataFrame, bool]:
    """(rows that ``step`` makes of each series, with ``_chunk``; whether any series has several chunks).

    ``df`` has ``high``, ``low`` and ``close``; ``thresholds`` are those of a bar
    as the highest and as the lowest extreme, null where the machine passes the
    bar over.  ``mark`` names a bar in states, ``ref`` is kept beside it.
    ``step`` gets a chunk's rows by ``pos`` and the state made by ``searching``
    (highest and lowest bar before the chunk, as (mark, price, ref), or None)
    or ``following`` (side, mark, price, ref).  Rows go through Python twice.
    """
    keys = list(keys)
    rows = df.withColumns({"_chunk": F.floor(F.col(pos) / size)})
    several = rows.where(F.col("_chunk") > 0).limit(1).count() > 0
    out_schema = schema + ", _chunk long"

    def run(pdf: pd.DataFrame, state: dict | None) -> pd.DataFrame:
        out, _ = step(pdf, state)
        return out.assign(_chunk=pdf["_chunk"].iloc[0])

    if not several:
        return rows.groupBy(*keys, "_chunk").applyInPandas(lambda pdf: run(pdf.sort_values(pos), None), out_schema), False

    barred = {"_mark": mark.cast("long"), "_rise": thresholds[0], "_fall": thresholds[1], "_ref": (F.lit(None) if ref is None else ref).cast("double")}
    seen = rows.withColumns(barred)
    valid = F.col("_rise").isNotNull() & F.col("_fall").isNotNull()
    ends = seen.groupBy(*keys, "_chunk").agg(
        F.max(F.when(valid, F.struct("high", -F.col(pos), "_mark", F.col("_rise").alias("thr"), "_ref"))).alias("_h"),
        F.min(F.when(valid, F.struct("low", F.col(pos), "_mark", F.col("_fall").alias("thr"), "_ref"))).alias("_l"),
    )
    past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_h": F.max("_h").over(past), "_l": F.min("_l").over(past)})
    flat = {f"{c}_{n}": F.col(c)[f] for c, x in (("_h", "high"), ("_l", "low")) for n, f in (("x", x), ("mark", "_mark"), ("thr", "thr"), ("ref", "_ref"))}
    ends = materialise(ends.select(*keys, "_chunk", *[v.alias(k) for k, v in flat.items()]), "turns")

    types = dict(rows.dtypes)
    key_schema = ", ".join(f"`{c}` {types[c]}" for c in keys)

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        pdf = pdf[pdf["_rise"].notna() & pdf["_fall"].notna()].sort_values(pos)
        high, low, close, rise, fall = (pdf[c].to_numpy(float) for c in ("high", "low", "close", "_rise", "_fall"))
        height, closes, limit, reached = exits(high.tolist(), low.tolist(), close.tolist(), rise.tolist(), fall.tolist(), turn_first)
        marks, refs = pdf["_mark"].tolist(), [None if v != v else v for v in pdf["_ref"].astype(float).tolist()]

        def named(node: tuple[int, int]) -> dict:
            s, i = node
            return {"side": 1 - 2 * s, "mark": marks[i], "x": height[s][i], "thr": limit[s][i], "ref": refs[i]}

        made = [
            [{"hi": hi, "lo": lo, "out": named(left)} for hi, lo, left in pieces(height[s], closes[s], reached[s], reached[1 - s], turn_first)]
            for s in (0, 1)
        ]
        before = tuple((sign * head[f"{c}_x"], sign * head[f"{c}_thr"]) if head[f"{c}_x"] == head[f"{c}_x"] and head[f"{c}_x"] is not None else None for c, sign in (("_h", 1), ("_l", -1)))
        begun = first_direction(high, low, close, rise, fall, before, search_own)
        start = None if begun is None else named(reached[begun[0]][begun[1]])
        return pd.DataFrame({**{k: [head[k]] for k in [*keys, "_chunk"]}, "up": [made[0]], "down": [made[1]], "start": [start]})

    made = seen.join(ends, [*keys, "_chunk"]).groupBy(*keys, "_chunk").applyInPandas(
        tables, f"{key_schema}, _chunk long, up {PIECES}, down {PIECES}, start struct<side: int, mark: long, x: double, thr: double, ref: double>"
    )
    entered = states_between(materialise(made, "turns"), keys)
    entered = entered.select(*keys, "_chunk", *[F.col("_state")[f].alias(f"_s_{f}") for f in ("side", "mark", "x", "ref")])

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        head = {c: (None if pd.isna(pdf[c].iloc[0]) else pdf[c].iloc[0]) for c in pdf.columns if c.startswith(("_h_", "_l_", "_s_"))}
        if head["_s_side"] is not None:
            side = int(head["_s_side"])
            state = following(side, int(head["_s_mark"]), side * float(head["_s_x"]), head["_s_ref"])
        else:
            state = searching(*[(int(head[f"{c}_mark"]), float(head[f"{c}_x"]), head[f"{c}_ref"]) if head[f"{c}_x"] is not None else None for c in ("_h", "_l")])
        return run(pdf.sort_values(pos), state)

    # marks stay whole numbers in pandas only where no group mixes them with nulls: a chunk is one group with one value
    ready = rows.join(ends, [*keys, "_chunk"]).join(entered, [*keys, "_chunk"], "left")
    return ready.groupBy(*keys, "_chunk").applyInPandas(emit, out_schema), True
