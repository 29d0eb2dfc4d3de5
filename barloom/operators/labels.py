"""What the future did: excursions, first-touch labels, event outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import epoch_seconds
from ..plans.blocks import BlockFrame, epoch_us, shift_time
from .bars import HOUR

HORIZONS = (4, 12, 24)


def _int(c: Column) -> Column:
    return c.cast("int")


def first_true(path: Column, cond) -> Column:
    """1-based offset of the first bar of ``path`` that meets ``cond``; null if none."""
    k = F.array_position(F.transform(path, cond), F.lit(True))
    return F.when(k > 0, k)


def forward_path(bf: BlockFrame, horizon: int, cols: Sequence[str], *, start: int = 1) -> Column:
    """The bars ``start`` .. ``start+horizon-1`` ahead as an array of structs."""
    return F.collect_list(F.struct(*cols)).over(bf.frame(start, start + horizon - 1))


def touch(path: Column, horizon: int, entry: Column, atr: Column, tp: float, sl: float, side: str) -> dict[str, Column]:
    """First touch of target or stop inside the next ``horizon`` bars.

    outcome 1 target first, -1 stop first, 0 neither, null when both fall in
    one bar (order unknown) or the horizon or an input is incomplete.
    """
    up = 1.0 if side == "long" else -1.0
    goal, stop = entry + up * tp * atr, entry - up * sl * atr
    ahead = F.slice(path, 1, horizon)
    if side == "long":
        k_tp = first_true(ahead, lambda b: b["high"] >= goal)
        k_sl = first_true(ahead, lambda b: b["low"] <= stop)
    else:
        k_tp = first_true(ahead, lambda b: b["low"] <= goal)
        k_sl = first_true(ahead, lambda b: b["high"] >= stop)
    known = entry.isNotNull() & atr.isNotNull() & (F.size(ahead) == horizon)
    far = F.lit(horizon + 1)
    a, b = F.coalesce(k_tp, far), F.coalesce(k_sl, far)
    return {
        "outcome": _int(F.when(known & ~((a == b) & (a <= horizon)), F.when(a < b, 1).when(b < a, -1).otherwise(0))),
        "delay": _int(F.when(known & (F.least(a, b) <= horizon), F.least(a, b))),
        "ambiguous": F.when(known, (a == b) & (a <= horizon)).otherwise(F.lit(False)),
    }


def add_labels(
    feats: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    horizons: Sequence[int] = HORIZONS,
    tp: float = 1.5,
    sl: float = 1.0,
    block: int = 1024,
) -> DataFrame:
    """Forward returns, excursions and first-touch outcomes per horizon.

    Also keeps the delay in bars and, for each horizon and side, the same
    outcome entered at the next open.
    """
    most = max(horizons)
    bf = BlockFrame(feats, keys, after=most, size=block)
    bf.with_columns({"_path": forward_path(bf, most, ["open", "high", "low", "close"])})
    close, atr = F.col("close"), F.col("atr14")
    bf.with_columns(
        {f"_hi{h}": F.max("high").over(bf.frame(1, h)) for h in horizons}
        | {f"_lo{h}": F.min("low").over(bf.frame(1, h)) for h in horizons}
        | {"next_open": F.lead("open", 1).over(bf.row)}
    )
    out, path = {}, F.col("_path")
    for h in horizons:
        full = (F.size(path) >= h) & atr.isNotNull()
        hi, lo = F.col(f"_hi{h}"), F.col(f"_lo{h}")
        last = F.when(F.size(path) >= h, F.element_at(path, h)["close"])
        values = {
            f"future_return_{h}h_pct": (last / close - 1) * 100,
            f"long_best_{h}h_pct": (hi / close - 1) * 100,
            f"long_worst_{h}h_pct": (lo / close - 1) * 100,
            f"short_best_{h}h_pct": (close / lo - 1) * 100,
            f"short_worst_{h}h_pct": -((hi / close - 1) * 100),
            f"up_move_{h}h_atr": (hi - close) / atr,
            f"down_move_{h}h_atr": (close - lo) / atr,
        }
        out |= {k: F.when(full, v) for k, v in values.items()}
        for side in ("long", "short"):
            base = touch(path, h, close, atr, tp, sl, side)
            alt = touch(path, h, F.col("next_open"), atr, tp, sl, side)
            out[f"{side}_outcome_{h}h"] = base["outcome"]
            out[f"{side}_delay_{h}h"] = base["delay"]
            out[f"{side}_ambiguous_{h}h"] = base["ambiguous"]
            out[f"{side}_outcome_{h}h_next_open"] = alt["outcome"]
    out["entry_gap_pct"] = (F.col("next_open") / close - 1) * 100
    bf.with_columns(out)
    return bf.own().drop("_path", *[f"_{x}{h}" for h in horizons for x in ("hi", "lo")])


# Fixed names: features a training row must have.
REQUIRED_FEATURES = [
    "ema20", "ema50", "ema200", "rsi14", "atr14_pct", "volume_ratio", "volatility_72h",
    "4h_rsi14", "4h_atr14_pct", "4h_trend", "1d_rsi14", "1d_atr14_pct", "1d_trend",
]


def readiness(df: DataFrame, required: Sequence[str] = REQUIRED_FEATURES, label: str = "future_return_24h_pct") -> DataFrame:
    ready = F.lit(True)
    for c in required:
        ready = ready & F.col(c).isNotNull()
    return df.withColumns({"features_ready": ready, "labels_24h_ready": F.col(label).isNotNull()}).withColumn(
        "sample_ready", F.col("features_ready") & F.col("labels_24h_ready")
    )


def bracket_outcome(
    path: Column,
    side: Column,
    entry: Column,
    target: Column,
    stop: Column,
    *,
    horizon: int,
    fee_bps: Column | float,
    slippage_bps: Column | float,
    risk: Column,
) -> dict[str, Column]:
    """Outcome of entering at the first bar's open with a target and a stop.

    The stop wins inside an ambiguous bar; a later bar opening beyond a level
    fills at that open; without a touch the last close is taken.
    """
    long = side == "LONG"
    sign = F.when(long, 1.0).otherwise(-1.0)
    slip = F.lit(slippage_bps) / 10_000 if not isinstance(slippage_bps, Column) else slippage_bps / 10_000
    fee = F.lit(fee_bps) / 10_000 if not isinstance(fee_bps, Column) else fee_bps / 10_000

    def reason_at(b: Column, i: Column) -> Column:
        gap = i > 0
        return (
            F.when(gap & F.when(long, b["open"] <= stop).otherwise(b["open"] >= stop), "SL_GAP")
            .when(gap & F.when(long, b["open"] >= target).otherwise(b["open"] <= target), "TP_GAP")
            .when(F.when(long, b["low"] <= stop).otherwise(b["high"] >= stop), "SL")
            .when(F.when(long, b["high"] >= target).otherwise(b["low"] <= target), "TP")
        )

    held = F.slice(path, 1, horizon)
    hits = F.transform(held, reason_at)
    hit = F.array_position(F.transform(hits, lambda r: r.isNotNull()), F.lit(True))
    k = F.when(hit > 0, hit).otherwise(F.lit(horizon)).cast("int")
    reason = F.when(hit > 0, F.get(hits, k - 1)).otherwise("TIME")
    bar = F.get(held, k - 1)
    raw = (
        F.when(reason.endswith("GAP"), bar["open"])
        .when(reason == "SL", stop)
        .when(reason == "TP", target)
        .otherwise(bar["close"])
    )
    fill_in = entry * (1 + sign * slip)
    fill_out = raw * (1 - sign * slip)
    gross = sign * (fill_out - fill_in) / fill_in
    net = gross - fee * (1 + fill_out / fill_in)
    return {
        "reason": reason,
        "duration_bars": k,
        "entry_raw": entry,
        "entry_fill": fill_in,
        "exit_raw": raw,
        "exit_fill": fill_out,
        "gross_return": gross,
        "net_return": net,
        "net_r": net * fill_in / risk,
        "exit_bar": bar["timestamp"],
    }


def event_outcomes(
    bars: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    horizon: int = 12,
    tp: float = 1.5,
    sl: float = 1.0,
    fee_bps: float = 5.0,
    slippage_bps: float = 2.0,
    last_allowed: str | None = None,
    block: int = 1024,
) -> DataFrame:
    """Event label of every row with a ``side``; needs ``pos`` and ``atr14``.

    Entry is the next bar's open, levels are ATR multiples around it.  Rows
    whose full horizon leaves the data (or goes past ``last_allowed``, the end
    of the row's own split) are DATA_INVALID even if a touch came earlier.
    """
    bf = BlockFrame(bars, keys, after=horizon, size=block)
    bf.with_columns({"_path": forward_path(bf, horizon, ["timestamp", "open", "high", "low", "close"])})
    rows = bf.own().filter(F.col("side").isNotNull())
    path, atr, side = F.col("_path"), F.col("atr14"), F.col("side")
    sign = F.when(side == "LONG", 1.0).otherwise(-1.0)
    entry = F.get(path, 0)["open"]
    rows = rows.withColumns({"tp_price": entry + sign * tp * atr, "sl_price": entry - sign * sl * atr})
    inside = F.size(path) == horizon
    if last_allowed:
        inside = inside & F.coalesce(F.get(path, horizon - 1)["timestamp"] <= F.col(last_allowed), F.lit(False))
    sound = F.coalesce((atr > 0) & (F.col("tp_price") > 0) & (F.col("sl_price") > 0), F.lit(False))
    rows = rows.withColumn(
        "invalid_reason", F.when(~inside, "SPLIT_BOUNDARY").when(~sound, "INVALID_EVENT")
    )
    made = bracket_outcome(
        path, side, entry, F.col("tp_price"), F.col("sl_price"),
        horizon=horizon, fee_bps=fee_bps, slippage_bps=slippage_bps, risk=sl * atr,
    )
    ok = F.col("invalid_reason").isNull()
    made = {k: F.when(ok, v) for k, v in made.items()}
    made["entry_at"] = F.when(ok, F.get(path, 0)["timestamp"])
    rows = rows.withColumns(made)
    return rows.withColumns(
        {
            "label_available_at": shift_time(F.col("exit_bar"), HOUR),
            "event_outcome": F.when(~ok, "DATA_INVALID").otherwise(F.regexp_extract("reason", "^(TP|SL|TIME)", 1)),
            "tp_price": F.when(ok, F.col("tp_price")),
            "sl_price": F.when(ok, F.col("sl_price")),
        }
    ).drop("_path", "exit_bar")


MULTIPLES = (1.0, 1.5, 2.0, 3.0, 4.0, 5.0)


def target_grid(
    references: DataFrame,
    bars: DataFrame,
    *,
    keys: Sequence[str] = ("symbol",),
    horizon: int = 12,
    multiples: Sequence[float] = MULTIPLES,
    fee_bps: float = 5.0,
    slippage_bps: float = 2.0,
) -> DataFrame:
    """Outcome of every stop reference for every reward multiple.

    ``references`` has known_at, side, stop_price, status; ``bars`` has pos.
    The held window starts at the bar opening at ``known_at`` and must be
    ``horizon`` consecutive bars.
    """
    bf = BlockFrame(bars.select(*keys, "pos", "timestamp", "open", "high", "low", "close"), keys, after=horizon)
    bf.with_columns({"_path": forward_path(bf, horizon, ["timestamp", "open", "high", "low", "close"], start=0)})
    windows = bf.own().select(*keys, F.col("timestamp").alias("known_at"), F.col("pos").alias("entry_index"), "_path")
    grid = references.join(windows, [*keys, "known_at"], "left").withColumn(
        "multiple_r", F.explode(F.array(*[F.lit(float(m)) for m in multiples]))
    )
    path, side, stop = F.col("_path"), F.col("side"), F.col("stop_price")
    sign = F.when(side == "LONG", 1.0).otherwise(-1.0)
    entry = F.get(path, 0)["open"]
    covered = (F.size(path) == horizon) & (
        epoch_us(F.get(path, horizon - 1)["timestamp"]) - epoch_us(F.get(path, 0)["timestamp"])
        == (horizon - 1) * HOUR * 1_000_000
    )
    risk = sign * (entry - stop)
    goal = entry + sign * F.col("multiple_r") * risk
    grid = grid.withColumn(
        "eligibility",
        F.when(path.isNull(), "ENTRY_OUTSIDE_SPLIT")
        .when(~covered, "INCOMPLETE_HORIZON")
        .when(F.col("status") != "VALID_REFERENCE", F.col("status"))
        .when(stop.isNull() | (stop <= 0), "INVALID_STOP")
        .when((risk <= 0) | (goal <= 0), "INVALID_TARGET")
        .otherwise("ELIGIBLE"),
    )
    ok = F.col("eligibility") == "ELIGIBLE"
    made = bracket_outcome(
        path, side, entry, goal, stop, horizon=horizon, fee_bps=fee_bps, slippage_bps=slippage_bps, risk=risk
    )
    made = {k: F.when(ok, v) for k, v in made.items()}
    made |= {
        "target_price": F.when(ok, goal),
        "risk_price": F.when(ok, risk),
        "entry_at": F.when(ok, F.col("known_at")),
        "exit_at": F.when(ok, shift_time(made["exit_bar"], HOUR)),
        "exit_index": F.when(ok, F.col("entry_index") + made["duration_bars"] - 1),
    }
    return grid.withColumns(made).drop("_path", "exit_bar")


def excursions(
    trades: DataFrame, bars: DataFrame, *, keys: Sequence[str] = ("symbol",), step: int = HOUR, first: str = "open"
) -> DataFrame:
    """MAE / MFE in percent and in R over the bars each trade was held, however long.

    Each trade's bar indexes are expanded and matched by equality; the extremes
    combine before the shuffle.  Every trade has a result: a missing or
    ambiguous bar, a gap between the held bars, an entry that differs from the
    first bar's open, an entry or risk that is not positive, or an unknown side
    is an error.
    """
    ids = [*keys, "method", "timeframe", "multiple_r", "event_id"]
    held = trades.select(
        *ids, "entry_index", F.explode(F.sequence(F.col("entry_index"), F.col("entry_index") + F.col("duration_bars") - 1)).alias("pos")
    )
    ext = (
        held.join(bars.select(*keys, "pos", "timestamp", "high", "low", F.col(first).alias("_open")), [*keys, "pos"])
        .groupBy(*ids)
        .agg(
            F.max("high").alias("_hi"), F.min("low").alias("_lo"), F.count(F.lit(1)).alias("_n"),
            (epoch_seconds(F.max("timestamp")) - epoch_seconds(F.min("timestamp"))).alias("_span"),
            F.max(F.when(F.col("pos") == F.col("entry_index"), F.col("_open"))).alias("_first"),
        )
    )
    out = trades.join(ext, ids, "left")
    e, risk, long = F.col("entry_raw"), F.col("risk_price"), F.col("side") == "LONG"
    fault = (
        F.when(F.coalesce(F.col("duration_bars"), F.lit(0)) < 1, "duration")
        .when(~F.col("_n").eqNullSafe(F.col("duration_bars")), "held bars are missing or ambiguous")
        .when(F.col("_span") != (F.col("duration_bars") - 1) * step, "held bars have a gap")
        .when(~F.coalesce((e > 0) & (risk > 0) & (e < float("inf")) & (risk < float("inf")), F.lit(False)), "entry or risk is not positive")
        .when(F.abs(e - F.col("_first")) > 1e-10 * F.abs(F.col("_first")), "entry differs from the first bar")
        .when(~F.coalesce(F.col("side").isin("LONG", "SHORT"), F.lit(False)), "side")
    )
    fail = F.raise_error(F.concat(F.lit("excursions: "), fault, F.lit(", event "), F.coalesce(F.col("event_id").cast("string"), F.lit("?"))))
    up, down = F.when(fault.isNull(), F.col("_hi") - e).otherwise(fail.cast("double")), e - F.col("_lo")
    out = out.withColumns(
        {
            "_fav": F.greatest(F.when(long, up).otherwise(down), F.lit(0.0)),
            "_adv": F.greatest(F.when(long, down).otherwise(up), F.lit(0.0)),
        }
    )
    return out.withColumns(
        {
            "mfe_pct": F.col("_fav") / e * 100,
            "mae_pct": F.col("_adv") / e * 100,
            "mfe_r": F.col("_fav") / risk,
            "mae_r": F.col("_adv") / risk,
            "mfe_over_half_r": F.col("_fav") >= 0.5 * risk,
            "mfe_over_one_r": F.col("_fav") >= risk,
            "mae_over_half_r": F.col("_adv") >= 0.5 * risk,
            "intrabar_exit_uncertain": ~F.col("reason").startswith("TIME"),
            "exit_type": F.regexp_extract("reason", "^(TP|SL|TIME)", 1),
        }
    ).drop("_fav", "_adv", "_hi", "_lo", "_n", "_span", "_first")


def touch_by_join(rows: DataFrame, horizon: int, *, keys: Sequence[str] = ("symbol",), tp: float = 1.5, sl: float = 1.0) -> DataFrame:
    """First-touch outcomes again, as a forward range join.

    Every bar is sent to the ``horizon`` rows before it (index explode and
    equi-join); hits combine map-side to one row per decision.
    """
    ahead = rows.select(*keys, F.col("pos").alias("_at"), "high", "low").withColumn(
        "pos", F.explode(F.sequence(F.col("_at") - horizon, F.col("_at") - 1))
    )
    base = rows.select(*keys, "pos", "close", "atr14")
    both = base.join(ahead, [*keys, "pos"])
    k, c, a = F.col("_at") - F.col("pos"), F.col("close"), F.col("atr14")
    first = lambda cond: F.min(F.when(cond, k))
    hits = both.groupBy(*keys, "pos").agg(
        F.count(F.lit(1)).alias("_n"), F.first("atr14").alias("_atr"),
        first(F.col("high") >= c + tp * a).alias("_long_tp"), first(F.col("low") <= c - sl * a).alias("_long_sl"),
        first(F.col("low") <= c - tp * a).alias("_short_tp"), first(F.col("high") >= c + sl * a).alias("_short_sl"),
    )
    far, out = F.lit(horizon + 1).cast("long"), {}
    for side in ("long", "short"):
        x, y = F.coalesce(f"_{side}_tp", far), F.coalesce(f"_{side}_sl", far)
        known = (F.col("_n") == horizon) & F.col("_atr").isNotNull() & ~((x == y) & (x < far))
        out[f"{side}_again"] = F.when(known, F.when(x < y, 1).when(y < x, -1).otherwise(0))
    return hits.select(*keys, "pos", *[v.alias(n) for n, v in out.items()])
