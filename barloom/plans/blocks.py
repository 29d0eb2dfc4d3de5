"""Ordered computation over long series without one task per series.

A series (one ``keys`` value) may hold a third of all rows, so no plan here
sorts a whole series in one task.  Rows get a dense position, positions are cut
into fixed-size blocks, and

* bounded frames read a halo of neighbouring rows copied into each block,
* unbounded scans (running last / sum / max) run inside blocks and add a carry
  computed from one summary row per block,
* exponential averages guess each block's carry from decaying sums and repeat
  the recursion from there until every block starts where the one before ended,
  so they equal one pass over the series bit by bit.

Every stage shuffles the rows once by (keys, block).  Stages with a carry cut
the lineage there (see ``cut``), so a chain of them costs the sum of its parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

FRAME_BLOCK = 1024
SCAN_BLOCK = 32_768
_US = 1_000_000
_UNDERFLOW = 1e-300


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def floor_time(ts: Column, seconds: int) -> Column:
    """Start of the ``seconds``-wide bucket (epoch anchored) holding ``ts``."""
    us = seconds * _US
    return F.timestamp_micros(epoch_us(ts) - F.pmod(epoch_us(ts), F.lit(us))).cast("timestamp_ntz")


def shift_time(ts: Column, seconds: int) -> Column:
    return ts + F.expr(f"INTERVAL '{seconds}' SECOND")


def with_position(
    df: DataFrame,
    *,
    keys: Sequence[str],
    ts: str,
    step: int,
    reset: bool,
    size: int = SCAN_BLOCK,
) -> DataFrame:
    """Add ``pos``, the 0-based row number inside the series.

    ``reset=True`` also adds ``seg`` (first timestamp of the gap-free run) and
    counts positions from there; a run ends where two neighbours are not
    ``step`` seconds apart.  Time is cut into chunks of ``size`` steps: one
    local window per chunk plus a carry over one row per chunk.
    """
    keys = list(keys)
    t = F.col(ts)
    chunked = df.withColumn("_chunk", F.floor(epoch_us(t) / F.lit(step * _US * size)))
    local = Window.partitionBy(*keys, "_chunk").orderBy(ts)
    series = Window.partitionBy(*keys).orderBy("_chunk")
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    if not reset:
        counts = (
            chunked.groupBy(*keys, "_chunk").count()
            .withColumn("_off", F.coalesce(F.sum("count").over(before), F.lit(0)))
            .drop("count")
        )
        return (
            chunked.withColumn("_rn", F.row_number().over(local))
            .join(counts, [*keys, "_chunk"])
            .withColumn("pos", F.col("_off") + F.col("_rn") - 1)
            .drop("_chunk", "_rn", "_off")
        )
    prev = F.lag(t).over(local)
    broke = chunked.withColumn(
        "_brk", F.when(prev.isNotNull() & (epoch_us(t) - epoch_us(prev) != step * _US), t)
    )
    ends = broke.groupBy(*keys, "_chunk").agg(
        F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.max("_brk").alias("_last")
    )
    prev_hi = F.lag("_hi").over(series)
    ends = (
        ends.withColumn(
            "_head",
            F.when(prev_hi.isNull() | (epoch_us(F.col("_lo")) - epoch_us(prev_hi) != step * _US), F.col("_lo")),
        )
        .withColumn("_own", F.coalesce("_last", "_head"))
        .withColumn("_carry", F.coalesce("_head", F.last("_own", ignorenulls=True).over(before)))
        .select(*keys, "_chunk", "_carry")
    )
    running = local.rowsBetween(Window.unboundedPreceding, 0)
    return (
        broke.withColumn("_in", F.last("_brk", ignorenulls=True).over(running))
        .join(ends, [*keys, "_chunk"])
        .withColumn("seg", F.coalesce("_in", "_carry"))
        .withColumn("pos", ((epoch_us(t) - epoch_us(F.col("seg"))) / F.lit(step * _US)).cast("long"))
        .drop("_chunk", "_brk", "_in", "_carry")
    )


@dataclass(frozen=True)
class Ewm:
    """Recursion e_t = e_(t-1) + (x_t - e_(t-1)) alpha, seeded at row ``start``.

    ``x`` must be non-null from ``start`` on.  The result is null before
    ``start`` and, if ``min_periods`` is given, for its first rows; masking
    never changes the recursion.  ``seed`` replaces x at the start row.
    """

    x: str
    alpha: float
    start: int = 0
    min_periods: int = 0
    seed: str | None = None


def span(n: int) -> float:
    return 2.0 / (n + 1.0)


def _horner(decay: float):
    return lambda acc, x: acc * decay + x


def _recurrence(pos: str, specs: Mapping[str, Ewm]) -> Callable[[pa.Table], dict[str, list[float]]]:
    """Function of a block in order: states of each average after every row; ``_c_<out>`` is the state before the first.

    It holds plain values only, so workers need no copy of this package.
    """
    plain = [(out, s.x, s.seed or s.x, s.alpha, s.start) for out, s in specs.items()]

    def run(table: pa.Table) -> dict[str, list[float]]:
        at, made = table[pos].to_pylist(), {}
        for out, x, seed, alpha, start in plain:
            e, states = table[f"_c_{out}"][0].as_py() or 0.0, []
            for p, v, first in zip(at, table[x].to_pylist(), table[seed].to_pylist()):
                if p > start:
                    e = e + ((v or 0.0) - e) * alpha
                elif p == start:
                    e = first or 0.0
                states.append(e)
            made[out] = states
        return made

    return run


class BlockFrame:
    """Rows copied into blocks of ``size`` positions, with a halo each side."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        *,
        pos: str = "pos",
        before: int = 0,
        after: int = 0,
        size: int = FRAME_BLOCK,
    ) -> None:
        self.keys, self.pos, self.size = list(keys), pos, size
        p = F.col(pos)
        if before or after:
            first = F.greatest(F.floor((p - after) / size), F.lit(0))
            last = F.floor((p + before) / size)
            df = df.withColumn("_blk", F.explode(F.sequence(first, last)))
        else:
            df = df.withColumn("_blk", F.floor(p / size))
        self.df = df
        self._part = Window.partitionBy(*self.keys, "_blk").orderBy(pos)

    def frame(self, start: int, end: int):
        return self._part.rowsBetween(start, end)

    @property
    def row(self):
        """Window for lag / lead."""
        return self._part

    def rolling(self, agg: Column, n: int, *, shift: int = 0, first: int = 0) -> Column:
        """``agg`` over the last ``n`` rows; null until ``n`` rows exist.

        ``shift`` moves the frame back; ``first`` is the first row that has a
        value of the aggregated column.
        """
        w = self.frame(-(n - 1) - shift, -shift)
        return F.when(F.col(self.pos) >= n - 1 + shift + first, agg.over(w))

    def lag(self, col: str | Column, n: int = 1) -> Column:
        return F.lag(col, n).over(self._part)

    def with_columns(self, cols: Mapping[str, Column]) -> BlockFrame:
        self.df = self.df.withColumns(dict(cols))
        return self

    def own(self) -> DataFrame:
        """Rows of each block without the halo."""
        own = F.col("_blk") == F.floor(F.col(self.pos) / self.size)
        return self.df.filter(own).drop("_blk")

    def ewm(self, specs: Mapping[str, Ewm]) -> DataFrame:
        """Append exponential averages; ends the stage (halo rows dropped)."""
        p, size = F.col(self.pos), self.size
        own = F.col("_blk") == F.floor(p / size)
        k = F.pmod(p, F.lit(size)).cast("double")
        running = self.frame(Window.unboundedPreceding, 0)
        local = {}
        for out, s in specs.items():
            w = 1.0 - s.alpha
            if size * -math.log(w) > 650.0:
                raise ValueError(f"block of {size} rows too long for alpha={s.alpha}")
            seed = F.col(s.seed or s.x)
            b = F.when(own & (p > s.start), F.col(s.x) * s.alpha).when(own & (p == s.start), seed).otherwise(0.0)
            local[f"_l_{out}"] = F.pow(F.lit(w), k) * F.sum(b * F.pow(F.lit(w), -k)).over(running)
        rows = cut(self.df.withColumns(local).filter(own))
        ends = rows.filter(F.pmod(p, F.lit(size)) == size - 1).select(*self.keys, "_blk", *local)
        rows = rows.drop(*local)
        carried = self._settled(rows, self._decayed(ends, specs), specs)
        joined = rows.join(carried, [*self.keys, "_blk"], "left")
        pos, run = self.pos, _recurrence(self.pos, specs)

        def states(table: pa.Table) -> pa.Table:
            table = table.sort_by(pos)
            for out, e in run(table).items():
                table = table.append_column(f"_e_{out}", pa.array(e, pa.float64()))
            return table

        schema = T.StructType([*joined.schema.fields, *[T.StructField(f"_e_{o}", T.DoubleType()) for o in specs]])
        made = joined.groupBy(*self.keys, "_blk").applyInArrow(states, schema)
        done = {out: F.when(p >= s.start + max(s.min_periods - 1, 0), F.col(f"_e_{out}")) for out, s in specs.items()}
        return made.withColumns(done).drop("_blk", *[f"_{x}_{o}" for o in specs for x in "ce"])

    def _settled(self, rows: DataFrame, guess: DataFrame, specs: Mapping[str, Ewm]) -> DataFrame:
        """Carry into each block, exactly as one pass over the series has it.

        Blocks run from guessed carries; those whose predecessor ends elsewhere
        run again from there.  The recursion forgets its start, so a second
        round mostly moves nothing; each round settles one more block at least.
        """
        on, pos, run = [*self.keys, "_blk"], self.pos, _recurrence(self.pos, specs)
        cols = {s.x for s in specs.values()} | {s.seed for s in specs.values() if s.seed}
        narrow = rows.select(*on, *sorted({pos, *cols} - set(on)))
        outs = [f"_c_{o}" for o in specs]

        def last(table: pa.Table) -> pa.Table:
            table = table.sort_by(pos)
            head = {c: table[c].slice(0, 1) for c in on[:-1]}
            nxt = {"_blk": pa.array([table["_blk"][0].as_py() + 1], pa.int64())}
            ends = {f"_c_{o}": pa.array(e[-1:], pa.float64()) for o, e in run(table).items()}
            return pa.table(head | nxt | ends)

        def ends_of(blocks: DataFrame, how: str) -> DataFrame:
            return narrow.join(blocks, on, how).groupBy(*on).applyInArrow(last, guess.schema)

        known = cut(guess.select(*on, *outs))
        if known.isEmpty():
            return known
        made = ends_of(known, "left")
        while True:
            before = known.select(*on, *[F.col(c).alias(f"{c}_was") for c in outs])
            same = F.lit(True)
            for c in outs:
                same = same & F.col(c).eqNullSafe(F.col(f"{c}_was"))
            moved = cut(made.join(before, on).filter(~same).select(*on, *outs))
            if moved.isEmpty():
                return known
            known = cut(known.join(moved.select(*on), on, "left_anti").unionByName(moved))
            made = ends_of(moved, "inner")

    def _decayed(self, ends: DataFrame, specs: Mapping[str, Ewm]) -> DataFrame:
        """Carry into each block: sum of earlier block ends times decay**distance.

        Past the lag where the decay underflows a double nothing can reach the
        result, so the carry is itself a bounded frame over the block table.
        """
        folds, reach = {}, 1
        for out, s in specs.items():
            decay = (1.0 - s.alpha) ** self.size
            lags = 1 if decay < _UNDERFLOW else math.ceil(math.log(_UNDERFLOW) / math.log(decay)) + 1
            folds[out] = (decay, lags)
            reach = max(reach, lags)
        summary = BlockFrame(
            ends.withColumnRenamed("_blk", "_b"), self.keys, pos="_b", before=reach - 1, size=max(4 * reach, 1024)
        )
        carry = {}
        for out, (decay, lags) in folds.items():
            past = F.collect_list(f"_l_{out}").over(summary.frame(-(lags - 1), 0))
            carry[f"_c_{out}"] = F.aggregate(past, F.lit(0.0), _horner(decay))
        done = summary.with_columns(carry).own()
        return done.select(*self.keys, (F.col("_b") + 1).alias("_blk"), *carry)

    def scan(self, specs: Mapping[str, tuple[str, Column, bool]]) -> DataFrame:
        """Unbounded running ``last`` (non-null), ``sum``, ``max`` or ``min``.

        ``specs`` maps an output to (kind, column, include_current_row).  Kind
        ``last2`` gives a struct (now, prior): the last non-null value and the
        one before it.
        """
        keys, pos = self.keys, self.pos
        own = F.col("_blk") == F.floor(F.col(pos) / self.size)
        inputs = {f"_x_{o}": c for o, (_, c, _i) in specs.items()}
        rows = self.df.filter(own).withColumns(inputs)
        fns = {"sum": F.sum, "max": F.max, "min": F.min}
        seen = self.frame(Window.unboundedPreceding, -1)
        second = {
            f"_w_{o}": F.when(F.col(f"_x_{o}").isNotNull(), F.struct(F.last(f"_x_{o}", ignorenulls=True).over(seen).alias("v")))
            for o, (kind, _, _i) in specs.items() if kind == "last2"
        }
        rows = rows.withColumns(second) if second else rows
        ends, local, carry, later = [], {}, {}, {}
        before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        for out, (kind, _, inclusive) in specs.items():
            x = F.col(f"_x_{out}")
            w = self.frame(Window.unboundedPreceding, 0 if inclusive else -1)
            at = F.when(x.isNotNull(), F.col(pos))
            if kind in ("last", "last2"):
                local[f"_l_{out}"] = F.last(x, ignorenulls=True).over(w)
                ends.append(F.max_by(x, at).alias(f"_e_{out}"))
                carry[f"_c_{out}"] = F.last(f"_e_{out}", ignorenulls=True).over(before)
            else:
                local[f"_l_{out}"] = fns[kind](x).over(w)
                ends.append(fns[kind](x).alias(f"_e_{out}"))
                carry[f"_c_{out}"] = fns[kind](f"_e_{out}").over(before)
            if kind == "last2":
                local[f"_s_{out}"] = F.last(f"_w_{out}", ignorenulls=True).over(w)
                ends.append(F.max_by(f"_w_{out}", at).alias(f"_z_{out}"))
                end = F.when(
                    F.col(f"_e_{out}").isNotNull(), F.struct(F.coalesce(F.col(f"_z_{out}.v"), F.col(f"_c_{out}")).alias("v"))
                )
                later[f"_p_{out}"] = (end, before)
        rows = cut(rows.withColumns(local))
        summary = rows.groupBy(*keys, "_blk").agg(*ends).withColumns(carry)
        for name, (end, w) in later.items():
            summary = summary.withColumn("_end", end).withColumn(name, F.last("_end", ignorenulls=True).over(w))
        summary = summary.select(*keys, "_blk", *carry, *later)
        joined = rows.join(summary, [*keys, "_blk"])
        done = {}
        for out, (kind, _, _i) in specs.items():
            here, past = F.col(f"_l_{out}"), F.col(f"_c_{out}")
            if kind == "last":
                done[out] = F.coalesce(here, past)
            elif kind == "last2":
                prior = F.when(here.isNotNull(), F.coalesce(F.col(f"_s_{out}.v"), past)).otherwise(F.col(f"_p_{out}.v"))
                done[out] = F.struct(F.coalesce(here, past).alias("now"), prior.alias("prior"))
            elif kind == "sum":
                done[out] = F.coalesce(here + past, here, past)
            elif kind == "max":
                done[out] = F.greatest(here, past)
            else:
                done[out] = F.least(here, past)
        helpers = [f"_s_{o}" for o in specs if specs[o][0] == "last2"]
        return joined.withColumns(done).drop("_blk", *inputs, *local, *carry, *second, *later, *helpers)
