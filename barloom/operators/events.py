"""Candidate events, scenario grids, trade selection and equity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import guard_columns
from ..plans.blocks import SCAN_BLOCK, BlockFrame
from ..plans.ranks import rank_by_time
from ..plans.transfer import states_at_borders
from ..session import materialise
from .labels import event_outcomes

# Fixed names: causal features a candidate row may carry, and name parts that betray the future.
CANDIDATE_FEATURES = [
    "return_1h", "return_3h", "return_6h", "return_24h", "distance_ema20_pct", "distance_ema50_pct",
    "distance_ema200_pct", "rsi14", "atr14_pct", "volume_ratio", "volatility_24h", "volatility_72h", "range_pct",
    "body_pct", "upper_wick_pct", "lower_wick_pct", "distance_high_24h_pct", "distance_low_24h_pct",
    "distance_high_72h_pct", "distance_low_72h_pct", "breakout_24h", "breakdown_24h", "trend_1h", "4h_trend",
    "1d_trend", "trend_alignment", "ema20_50_spread_pct", "ema50_200_spread_pct", "4h_rsi14", "4h_atr14_pct",
    "1d_rsi14", "1d_atr14_pct", "4h_close", "1d_close",
]
BLOCKED_PATTERNS = ["future_", "_outcome_", "_best_", "_worst_", "up_move_", "down_move_"]


def event_id(side: Column, keys: Sequence[str] = ("symbol",), ts: str = "timestamp") -> Column:
    return F.concat_ws("_", *keys, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), side)


def build_candidates(bars: DataFrame, split_rows: DataFrame, *, keys: Sequence[str] = ("symbol",), horizon: int = 12,
                     tp: float = 1.5, sl: float = 1.0, fee_bps: float = 5.0, slippage_bps: float = 2.0) -> DataFrame:
    """Rows with |bias_score| >= 2, their side, id and event outcome.

    A row whose full horizon would leave its own split is DATA_INVALID.
    """
    keys = list(keys)
    ends = split_rows.groupBy(*keys, "split").agg(F.max("timestamp").alias("split_end"))
    side = F.when(F.col("bias_score") >= 2, "LONG").when(F.col("bias_score") <= -2, "SHORT")
    picked = (
        split_rows.withColumn("side", side).filter(F.col("side").isNotNull()).join(ends, [*keys, "split"])
        .withColumns({"event_id": event_id(F.col("side"), keys), "known_at": F.col("available_at")})
    )
    market = bars.select(*keys, "pos", "timestamp", "open", "high", "low", "close").join(
        picked.select(*keys, "timestamp", "side", "atr14", "split_end", "event_id"), [*keys, "timestamp"], "left"
    )
    made = event_outcomes(
        market, keys=keys, horizon=horizon, tp=tp, sl=sl, fee_bps=fee_bps, slippage_bps=slippage_bps, last_allowed="split_end"
    )
    y = made.drop(*keys, "pos", "timestamp", "open", "high", "low", "close", "side", "atr14", "split_end")
    return picked.join(y, "event_id")


def predictors(candidates: DataFrame, features: Sequence[str] = CANDIDATE_FEATURES) -> DataFrame:
    """X: identifiers and causal features only (checked by name)."""
    return candidates.select(
        "event_id", "symbol", "split", "timestamp", "known_at", "side", "bias_score",
        *guard_columns(features, BLOCKED_PATTERNS),
    )


def select_non_overlapping(
    events: DataFrame,
    *,
    keys: Sequence[str],
    start: str,
    end: str,
    order: Sequence[str],
    strict: bool = True,
    size: int = SCAN_BLOCK,
) -> DataFrame:
    """Mark TAKEN / SKIPPED_OVERLAP by walking each scenario in order.

    An event is taken if its ``start`` index lies beyond the ``end`` of the
    last taken one (``strict``), or at it; both are numbers and never null.
    The walk is cut into row blocks.  What a block does to the end it is handed
    is a small table (which event it lets in first, and where the walk from
    there leaves the block), so the ends at all block borders come from
    composing tables, in a number of rounds that grows with the logarithm of
    the blocks; then all blocks mark their events side by side.
    """
    keys = list(keys)
    placed = rank_by_time(events, keys, order)
    types = dict(placed.dtypes)
    cols = [*keys, *[c for c in order if c not in keys], "_i"]
    slim = placed.select(*dict.fromkeys([*cols, start, end])).withColumn("_chunk", F.floor(F.col("_i") / size))
    own = [*keys, "_chunk"]

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = _walk_table(*pdf.sort_values("_i")[[start, end]].to_numpy(object).T.tolist(), strict)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in own}, "_table": [[{"upto": s, "out": e} for s, e in pieces]]})

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*own).schema)
    if slim.where("_chunk > 0").limit(1).count():
        tables = slim.groupBy(*own).applyInPandas(table, f"{kind}, _table array<struct<upto:{types[start]},out:{types[end]}>>")
        states = states_at_borders(tables, keys=keys, chunk="_chunk", table="_table", strict=strict)
        known = [F.col(c).alias(f"_s{n}") for n, c in enumerate(own)]
        states = states.select(*known, F.col("_state"))
        same = F.col("_chunk") == F.col(f"_s{len(keys)}")
        for n, c in enumerate(keys):
            same &= F.col(c).eqNullSafe(F.col(f"_s{n}"))
        ready = slim.join(states, same).drop(*[f"_s{n}" for n in range(len(own))])
    else:
        ready = slim.withColumn("_state", F.lit(None).cast(types[end]))

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        busy = pdf["_state"].iloc[0]
        busy = None if pd.isna(busy) else busy
        marks = []
        for s, e in zip(pdf[start].tolist(), pdf[end].tolist()):
            free = busy is None or (s > busy if strict else s >= busy)
            marks.append("TAKEN" if free else "SKIPPED_OVERLAP")
            if free:
                busy = e
        return pdf[cols].assign(portfolio_status=marks)

    schema = ", ".join(f"`{c}` {types[c]}" for c in cols) + ", portfolio_status string"
    marks = ready.groupBy(*own).applyInPandas(mark, schema)
    return events.join(marks.drop("_i"), cols[:-1])


def _walk_table(starts: list, ends: list, strict: bool) -> list[tuple]:
    """(start, end): a walk that comes with an end below ``start`` (``strict``; or at most it) leaves the events with the end beside it.

    From the last event to the first, ``reach`` holds the events that a walk
    from further left could enter first: each starts later than those before it.
    """
    reach: list = []  # negated starts, ascending: the nearest event is last
    leaves: list = []
    for s, e in zip(reversed(starts), reversed(ends)):
        at = (bisect_left(reach, -e) if strict else bisect_right(reach, -e)) - 1
        out = leaves[at] if at >= 0 else e
        while reach and reach[-1] >= -s:
            reach.pop(), leaves.pop()
        reach.append(-s), leaves.append(out)
    pieces = [(-s, e) for s, e in zip(reversed(reach), reversed(leaves))]
    return [p for p, q in zip(pieces, [*pieces[1:], None]) if q is None or q[1] != p[1]]


def equity_path(trades: DataFrame, *, keys: Sequence[str], r: str, order: Sequence[str], initial: float = 1.0,
                alloc: float = 1.0, size: int = SCAN_BLOCK) -> DataFrame:
    """equity_before / equity_after / drawdown of a compounded trade sequence.

    Growth is a running sum of logs, the peak a running maximum (starting at
    the initial equity); both scans run in blocks.
    """
    keys, order = list(keys), list(order)
    # only the columns the scans need travel through them
    placed = rank_by_time(trades.select(*keys, *order, r), keys, order)
    ruin = F.raise_error(F.lit("equity falls to zero or below; lower alloc")).cast("double")
    placed = placed.withColumn("_g", F.when(F.col(r) * alloc <= -1, ruin).otherwise(F.log1p(F.col(r) * alloc)))
    run = BlockFrame(placed, keys, pos="_i", size=size).scan({"_sum": ("sum", F.col("_g"), True)})
    run = BlockFrame(run, keys, pos="_i", size=size).scan({"_top": ("max", F.col("_sum"), True)})
    peak = F.greatest(F.col("_top"), F.lit(0.0))
    path = run.select(
        *keys, *order,
        (F.exp("_sum") * initial).alias("equity_after"),
        (F.exp(F.col("_sum") - F.col("_g")) * initial).alias("equity_before"),
        (F.exp(F.col("_sum") - peak) - 1).alias("drawdown"),
        (F.col("_i") + 1).alias("trade_no"),
        F.col("_g").alias("log_equity_return"),
    )
    return trades.join(path, [*keys, *order])


def trade_summary(path: DataFrame, by: Sequence[str], *, initial: float = 1.0) -> DataFrame:
    """One row per scenario: counts, ending equity, drawdown, win rate, mean R."""
    n = F.count(F.lit(1))
    return path.groupBy(*by).agg(
        n.alias("trades"),
        F.sum((F.col("side") == "LONG").cast("long")).alias("long_trades"),
        F.sum((F.col("side") == "SHORT").cast("long")).alias("short_trades"),
        F.max_by("equity_after", "trade_no").alias("ending_equity"),
        ((F.max_by("equity_after", "trade_no") / initial - 1) * 100).alias("return_pct"),
        (F.least(F.min("drawdown"), F.lit(0.0)) * 100).alias("max_drawdown_exit_only_pct"),
        (F.avg((F.col("net_return") > 0).cast("double")) * 100).alias("win_rate_net_pct"),
        F.avg("net_r").alias("mean_net_r"),
    )


def cost_grid(trades: DataFrame, costs: Sequence[float] | Column, *, fee_weight: float = 5.0, slippage_weight: float = 2.0) -> DataFrame:
    """Net return of a fixed trade list at every total cost per side (bps).

    Each trade is repeated per cost with an exploded array (literal, or a column of the trades); raw prices
    are kept, so fills are recomputed without touching the bars.  A cost is
    split between fee and slippage by the weights.
    """
    sign = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    listed = costs if isinstance(costs, Column) else F.array(*[F.lit(float(c)) for c in costs])
    out = trades.withColumn("cost_bps", F.explode(listed))
    part = F.col("cost_bps") / (10_000 * (fee_weight + slippage_weight))
    fee, slip = part * fee_weight, part * slippage_weight
    paid = F.col("entry_raw") * (1 + sign * slip)
    got = F.col("exit_raw") * (1 - sign * slip)
    return out.withColumn("net_at_cost", sign * (got - paid) / paid - fee * (1 + got / paid))


def cost_totals(trades: DataFrame, costs: Sequence[float], by: Sequence[str], *, alloc: float = 1.0) -> DataFrame:
    grid = cost_grid(trades, costs)
    return grid.groupBy(*by, "cost_bps").agg(
        F.count(F.lit(1)).alias("trades"),
        (F.expm1(F.sum(F.log1p(F.col("net_at_cost") * alloc))) * 100).alias("return_pct"),
        (F.avg("net_at_cost") * 100).alias("mean_net_pct"),
    )


def break_even_cost(
    trades: DataFrame, by: Sequence[str], *, start: float = 10.0, doublings: int = 25, points: int = 64, passes: int = 3, alloc: float = 1.0
) -> DataFrame:
    """Cost per side (bps) at which the compounded return is zero, and how it was found.

    The trade sequence does not depend on the cost.  One pass over costs that
    double from ``start`` brackets each group's root, a few passes over
    ``points`` costs inside the bracket narrow it, and the last two costs are
    interpolated.  ``status`` says ESTIMATED, BREAK_EVEN_AT_ZERO_COST (cost 0),
    NEGATIVE_EVEN_WITH_ZERO_COST or NOT_BRACKETED (both without a cost).
    """
    by = list(by)
    slim = trades.select(*by, "side", "entry_raw", "exit_raw")
    wide = [0.0, *[start * 2**i for i in range(doublings + 1)]]

    def bracket(tried: DataFrame) -> DataFrame:
        g = F.sum(F.col("_log")).alias("g")
        totals = tried.groupBy(*by, "cost_bps").agg(g)
        return totals.groupBy(*by).agg(
            F.max(F.when(F.col("g") > 0, F.struct("cost_bps", "g"))).alias("a"), F.min(F.when(F.col("g") <= 0, F.struct("cost_bps", "g"))).alias("b"),
            (F.expm1(F.max(F.when(F.col("cost_bps") == 0, F.col("g")))) * 100).alias("_at_zero"),
        )

    def tried(rows: DataFrame) -> DataFrame:
        # a cost that ends the account is worse than any other
        net = F.col("net_at_cost") * alloc
        return rows.withColumn("_log", F.when((net > -1) & (F.col("cost_bps") < 10_000), F.log1p(net)).otherwise(float("-inf")))

    ends = materialise(bracket(tried(cost_grid(slim, wide))), "break-even")
    zero = ends.select(*by, "_at_zero")
    for _ in range(passes):
        step = (F.col("b.cost_bps") - F.col("a.cost_bps")) / points
        costs = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.col("a.cost_bps") + step * i)
        open_ends = ends.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(*by, costs.alias("_costs"))
        ends = materialise(bracket(tried(cost_grid(slim.join(open_ends, by), F.col("_costs")))), "break-even")
    w = F.col("a.g") / (F.col("a.g") - F.col("b.g"))
    root = ends.select(*by, (F.col("a.cost_bps") + w * (F.col("b.cost_bps") - F.col("a.cost_bps"))).alias("_root"))
    out = zero.join(root, by, "left")
    status = (
        F.when(F.col("_at_zero") < -1e-10, "NEGATIVE_EVEN_WITH_ZERO_COST")
        .when(F.abs("_at_zero") <= 1e-10, "BREAK_EVEN_AT_ZERO_COST")
        .when(F.col("_root").isNull(), "NOT_BRACKETED")
        .otherwise("ESTIMATED")
    )
    cost = F.when(status == "ESTIMATED", F.col("_root")).when(status == "BREAK_EVEN_AT_ZERO_COST", 0.0)
    return out.select(*by, cost.alias("break_even_bps"), status.alias("status"))
