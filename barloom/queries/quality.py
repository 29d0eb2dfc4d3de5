"""Validation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import quality as Q
from ..operators.bars import resample_ohlcv, ticks_to_bars
from ..plans.blocks import BlockFrame
from .registry import cte, query
from .tables import ALLOC, HOUR, bars_1h, candidates, features, labeled, splits, table, ticks, trades, valid_candidates


@query(
    "check_tick_keys",
    """SELECT 'null_key' AS "check", count(*) FILTER (event_type IS NULL OR ts IS NULL) AS violations FROM events
       UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT event_type, ts FROM events GROUP BY ALL HAVING count(*) > 1)""",
)
def _(spark, d):
    return Q.check_keys(ticks(spark, d), ["symbol", "timestamp"])


@query(
    "check_continuity",
    """SELECT symbol, count(*) AS rows, count(DISTINCT seg) AS segments, count(DISTINCT seg) - 1 AS gaps, max(spos) + 1 AS longest_run
       FROM runs1 GROUP BY symbol""",
)
def _(spark, d):
    return Q.continuity(bars_1h(spark, d), HOUR)


def _checks_sql(src: str, checks: dict[str, str]) -> str:
    cols = ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in checks.items())
    return f'SELECT name AS "check", value AS violations FROM (UNPIVOT (SELECT {cols} FROM {src}) ON {", ".join(checks)})'


@query(
    "check_ohlc",
    _checks_sql(
        "(SELECT *, close * 1.02::DOUBLE AS c2 FROM bars)",
        {
            "not_finite": "false", "not_positive": "least(open, high, low, c2) <= 0", "negative_volume": "volume < 0",
            "high_too_low": "high < greatest(open, c2, low)", "low_too_high": "low > least(open, c2, high)",
        },
    ),
)
def _(spark, d):
    """Sanity counts on bars whose close was nudged, so that violations exist."""
    return Q.count_where(bars_1h(spark, d).withColumn("close", F.col("close") * 1.02), Q.ohlc_checks())


@query(
    "check_grid_and_clock",
    _checks_sql(
        "bars",
        {
            "off_grid": "date_trunc('hour', timestamp) <> timestamp", "outside_month": "strftime(timestamp, '%Y-%m') <> '2024-01'",
            "clock": "known_at <> timestamp + INTERVAL 1 HOUR",
        },
    ),
)
def _(spark, d):
    rows = bars_1h(spark, d).withColumn("month", F.lit("2024-01"))
    return Q.count_where(rows, Q.grid_checks(HOUR, month="month") | Q.clock_checks(HOUR, available="known_at"))


@query(
    "check_staleness",
    _checks_sql(
        "feats",
        {
            "future_4h": 'available_at < "4h_available_at"', "stale_4h": "available_at - \"4h_available_at\" > INTERVAL 4 HOUR",
            "future_1d": 'available_at < "1d_available_at"', "stale_1d": "available_at - \"1d_available_at\" > INTERVAL 24 HOUR",
        },
    ),
)
def _(spark, d):
    checks = Q.staleness_checks("available_at", "4h_available_at", 4 * HOUR) | Q.staleness_checks("available_at", "1d_available_at", 24 * HOUR)
    return Q.count_where(features(spark, d), checks).withColumn("check", F.replace("check", F.lit("_available_at"), F.lit("")))


@query(
    "check_reference",
    """SELECT 'unmatched' AS "check", count(*) FILTER (n IS NULL) AS violations FROM (SELECT c.event_id, b.n FROM cand c LEFT JOIN
         (SELECT symbol, timestamp, count(*) AS n FROM bars GROUP BY ALL) b ON b.symbol = c.symbol AND b.timestamp = c.known_at)
       UNION ALL SELECT 'matched_many', 0""",
)
def _(spark, d):
    """Entry bar of every candidate: exactly one bar opens at its known_at."""
    bars = bars_1h(spark, d).select("symbol", F.col("timestamp").alias("known_at"))
    return Q.reference_checks(candidates(spark, d).select("symbol", "known_at"), bars, ["symbol", "known_at"])


@query(
    "check_split_integrity",
    """SELECT 'shared_ids' AS "check", 0::BIGINT AS violations
       UNION ALL SELECT 'not_chronological', count(*) FILTER (a >= b) FROM (SELECT symbol, max(timestamp) FILTER (split = 'train') AS a,
         min(timestamp) FILTER (split = 'validation') AS b FROM valid_cand GROUP BY symbol)
       UNION ALL SELECT 'label_known_late', count(*) FILTER (a >= b) FROM (SELECT symbol, max(label_available_at) FILTER (split = 'train') AS a,
         min(known_at) FILTER (split = 'validation') AS b FROM valid_cand GROUP BY symbol)""",
)
def _(spark, d):
    return Q.split_integrity(valid_candidates(spark, d), earlier="train", later="validation")


@query("missing_bars", "SELECT symbol, timestamp FROM grid ANTI JOIN bars USING (symbol, timestamp)")
def _(spark, d):
    return Q.missing_bars(bars_1h(spark, d), HOUR)


@query(
    "gap_overlap",
    """SELECT count(*) FILTER (n = 5) AS common_gaps, count(*) AS union_gaps, coalesce(sum(n), 0) AS missing_total FROM
       (SELECT timestamp, count(*) AS n FROM (SELECT symbol, timestamp FROM grid ANTI JOIN bars USING (symbol, timestamp)) GROUP BY timestamp)""",
    n="missing_total",
)
def _(spark, d):
    bars = bars_1h(spark, d)
    return Q.gap_overlap(Q.missing_bars(bars, HOUR), bars)


@query(
    "archive_quality",
    """SELECT symbol, month, count(*) AS rows, 744::BIGINT AS expected_rows, 744 - count(*) AS missing_rows,
       count(*) FILTER (spos = 0 AND rn > 1) AS odd_transitions FROM (SELECT *, strftime(timestamp, '%Y-%m') AS month,
       row_number() OVER (PARTITION BY symbol, strftime(timestamp, '%Y-%m') ORDER BY timestamp) AS rn FROM runs1) GROUP BY ALL""",
)
def _(spark, d):
    return Q.archive_quality(bars_1h(spark, d), HOUR)


_f = ("open", "high", "low", "close", "volume")


@query(
    "reconcile_sources",
    " UNION ALL ".join(
        f"""SELECT '{f}' AS field, count(*) FILTER (b.symbol IS NULL) AS only_left, count(*) FILTER (a.symbol IS NULL) AS only_right,
        count(abs(a.{f} - b.{f})) AS compared, count(*) FILTER (abs(a.{f} - b.{f}) > 1e-6::DOUBLE + 1e-9::DOUBLE * abs(b.{f})) AS mismatches,
        max(abs(a.{f} - b.{f})) AS max_abs_diff FROM daily_a a FULL JOIN daily_b b ON a.symbol = b.symbol AND a.timestamp = b.timestamp"""
        for f in _f
    ),
    "max_abs_diff",
)
def _(spark, d):
    """Daily bars straight from ticks against daily bars from complete hours."""
    a = ticks_to_bars(ticks(spark, d), 24 * HOUR)
    b = resample_ohlcv(bars_1h(spark, d), 24 * HOUR).withColumn("volume", F.col("volume") * 1.5)
    return Q.reconcile(a, b, ["symbol", "timestamp"], list(_f))


cte(
    "daily_a",
    """SELECT symbol, date_trunc('day', timestamp) AS timestamp, arg_min(price, (timestamp, event_id)) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, (timestamp, event_id)) AS close, sum(volume) AS volume FROM ticks GROUP BY symbol, date_trunc('day', timestamp)""",
)
cte("daily_b", "SELECT symbol, timestamp, open, high, low, close, volume * 1.5::DOUBLE AS volume FROM bars24")


@query(
    "label_reaudit",
    " UNION ALL ".join(
        f"SELECT '{s}' AS side, {h} AS horizon, count(*) AS rows, 0::BIGINT AS mismatches FROM labeled" for s in ("long", "short") for h in (4, 12, 24)
    ),
)
def _(spark, d):
    """Labels recomputed by expanding future bars and joining by index."""
    return _reaudit(labeled(spark, d))


def _reaudit(rows):
    out = None
    for h in L.HORIZONS:
        made = L.touch_by_join(rows, h)
        both = rows.select("symbol", "pos", *[f"{s}_outcome_{h}h" for s in ("long", "short")]).join(made, ["symbol", "pos"], "left")
        for s in ("long", "short"):
            off = ~F.col(f"{s}_outcome_{h}h").eqNullSafe(F.col(f"{s}_again"))
            part = both.agg(F.count(F.lit(1)).alias("rows"), F.sum(off.cast("long")).alias("mismatches"))
            part = part.select(F.lit(s).alias("side"), F.lit(h).alias("horizon"), "rows", "mismatches")
            out = part if out is None else out.unionByName(part)
    return out


_P = ["rsi14", "atr14_pct", "volume_ratio", "trend_1h", "4h_rsi14", "breakout_24h"]


@query(
    "column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count(*) - count("{c}") AS missing, count(DISTINCT "{c}") AS "distinct", count(DISTINCT "{c}") <= 1 AS constant,
        min("{c}")::DOUBLE AS min, quantile_cont("{c}"::DOUBLE, 0.01::DOUBLE) AS p01, quantile_cont("{c}"::DOUBLE, 0.5::DOUBLE) AS median,
        quantile_cont("{c}"::DOUBLE, 0.99::DOUBLE) AS p99, max("{c}")::DOUBLE AS max FROM feats"""
        for c in _P
    ),
    "min p01 median p99 max",
)
def _(spark, d):
    return Q.column_profile(features(spark, d), _P)


_S = [
    "return_1h", "return_3h", "return_6h", "log_return_1h", "rsi14", "atr14", "atr14_pct", "ema20", "ema50", "ema200", "distance_ema20_pct",
    "distance_ema50_pct", "range_pct", "body_pct", "upper_wick_pct", "lower_wick_pct", "volume_ratio", "volatility_24h", "volatility_72h",
]


@query(
    "similar_feature_pairs",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, count({a} + {b}) AS shared_rows, corr({a}, {b}) AS pearson FROM feats"
        for i, a in enumerate(_S) for b in _S[i + 1 :]
    )
    + ") WHERE abs(pearson) >= 0.9 AND shared_rows >= 500",
    "pearson",
)
def _(spark, d):
    return Q.similar_pairs(features(spark, d), _S, threshold=0.9)


@query(
    "trade_chain_audit",
    """SELECT unnest(['own_step', 'broken_chain', 'not_positive']) AS "check", 0::BIGINT AS violations""",
)
def _(spark, d):
    return Q.chain_audit(trades(spark, d), keys=["symbol", "split"], order=["timestamp"], alloc=ALLOC)


cte(
    "ledger",
    """SELECT symbol, "at", event, side, price, 1.0::DOUBLE AS qty, price * 0.0005::DOUBLE AS fee, net_trade_pnl, reason,
       sum(coalesce(net_trade_pnl, 0)) OVER (PARTITION BY symbol ORDER BY "at", seq) AS cash FROM (
       SELECT symbol, entry_at AS "at", 'ENTRY' AS event, side, entry_fill AS price, NULL::DOUBLE AS net_trade_pnl, NULL::VARCHAR AS reason, 1 AS seq FROM trades
       UNION ALL SELECT symbol, label_available_at, 'EXIT', side, exit_fill,
         CASE WHEN side = 'LONG' THEN 1 ELSE -1 END * (exit_fill - entry_fill) - 0.0005::DOUBLE * (exit_fill + entry_fill), reason, 0 FROM trades)""",
)


@query(
    "execution_ledger",
    "SELECT * FROM ledger",
    "price qty fee net_trade_pnl cash",
)
def _(spark, d):
    led = Q.ledger_from_trades(trades(spark, d))
    return led.select("symbol", "at", "event", "side", "price", "qty", "fee", "net_trade_pnl", "reason", "cash")


_audits = ["fee", "cash", "overlapping_position", "exit_without_entry", "unpaired_entry", "profit", "exit_before_entry", "level_not_touched"]


@query("ledger_audit", f"""SELECT unnest({_audits}) AS "check", 0::BIGINT AS violations""")
def _(spark, d):
    return Q.ledger_audit(Q.ledger_from_trades(trades(spark, d)), bars_1h(spark, d))


@query(
    "ledger_audit_tampered",
    """SELECT "check", violations FROM (SELECT 'fee' AS "check", count(*) FILTER (symbol = 'click') AS violations FROM ledger UNION ALL SELECT 'cash', 0
       UNION ALL SELECT 'overlapping_position', 0 UNION ALL SELECT 'exit_without_entry', 0 UNION ALL SELECT 'unpaired_entry', 0
       UNION ALL SELECT 'profit', count(*) FILTER (symbol = 'view' AND event = 'EXIT') FROM ledger UNION ALL SELECT 'exit_before_entry', 0
       UNION ALL SELECT 'level_not_touched', 0)""",
    n="violations",
)
def _(spark, d):
    """The audit on a ledger with wrong fees and wrong profits put in."""
    led = Q.ledger_from_trades(trades(spark, d))
    bad = led.withColumns(
        {
            "fee": F.when(F.col("symbol") == "click", F.col("fee") + 1).otherwise(F.col("fee")),
            "side": F.when((F.col("symbol") == "view"), F.when(F.col("side") == "LONG", "SHORT").otherwise("LONG")).otherwise(F.col("side")),
        }
    )
    return Q.ledger_audit(bad, bars_1h(spark, d))


@query(
    "ledger_audit_missing_exit",
    """WITH ins AS (SELECT symbol, "at", row_number() OVER (PARTITION BY symbol ORDER BY "at") AS n FROM ledger WHERE event = 'ENTRY'),
       outs AS (SELECT symbol, "at", row_number() OVER (PARTITION BY symbol ORDER BY "at") AS n FROM ledger WHERE event = 'EXIT'),
       pairs AS (SELECT i.symbol, i.n, CAST(epoch(o."at") AS BIGINT) // 3600 % 5 = 0 AS gone, max(i.n) OVER (PARTITION BY i.symbol) AS newest FROM ins i JOIN outs o USING (symbol, n))
       SELECT 'fee' AS "check", 0 AS violations UNION ALL SELECT 'cash', 0 UNION ALL SELECT 'overlapping_position', count(*) FILTER (gone AND n < newest) FROM pairs
       UNION ALL SELECT 'exit_without_entry', 0 UNION ALL SELECT 'unpaired_entry', count(*) FILTER (gone) FROM pairs UNION ALL SELECT 'profit', 0
       UNION ALL SELECT 'exit_before_entry', 0 UNION ALL SELECT 'level_not_touched', 0""",
    n="violations",
)
def _(spark, d):
    """The audit on a ledger that lost the exits of some hours: only their own positions are at fault."""
    led = Q.ledger_from_trades(trades(spark, d))
    hour = F.floor(F.unix_timestamp(F.col("at").cast("timestamp")) / HOUR)
    kept = led.filter(~((F.col("event") == "EXIT") & (hour % 5 == 0)))
    return Q.ledger_audit(Q.restate_cash(kept), bars_1h(spark, d))


@query(
    "ledger_summary_check",
    """SELECT unnest(['summary_absent', 'trade_counts', 'net_profit', 'cash_end']) AS "check", 0::BIGINT AS violations
       UNION ALL SELECT 'missing_decisions', count(*) FROM grid ANTI JOIN bars USING (symbol, timestamp)""",
)
def _(spark, d):
    """Trade table totals against the ledger; hourly decisions that are absent."""
    t = trades(spark, d)
    sign = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    pnl = sign * (F.col("exit_fill") - F.col("entry_fill")) - 0.0005 * (F.col("entry_fill") + F.col("exit_fill"))
    n = F.count(F.lit(1))
    stated = t.groupBy("symbol").agg(n.alias("entries"), n.alias("exits"), F.sum(pnl).alias("net_pnl"))
    return Q.ledger_summary_check(Q.ledger_from_trades(t), stated, bars_1h(spark, d), HOUR)


_W = ["rsi14", "atr14_pct", "volume_ratio", "4h_rsi14", "1d_close"]


@query(
    "observation_width",
    f"""SELECT symbol, count(*) AS rows, count(DISTINCT timestamp) AS decisions, sum({" + ".join(f'CASE WHEN "{c}" IS NULL THEN 1 ELSE 0 END' for c in _W)}) AS null_cells,
       count(*) FILTER ({" AND ".join(f'"{c}" IS NOT NULL' for c in _W)}) AS full_rows FROM feats GROUP BY symbol""",
    n="null_cells",
)
def _(spark, d):
    """One wide row per decision, null cells counted per row."""
    nulls = sum((F.col(c).isNull().cast("long") for c in _W), F.lit(0).cast("long"))
    rows = features(spark, d).select("symbol", "timestamp", nulls.alias("_n"))
    per = rows.groupBy("symbol", "timestamp").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_n").alias("_n"))
    return per.groupBy("symbol").agg(
        F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("decisions"), F.sum("_n").alias("null_cells"),
        F.sum((F.col("_n") == 0).cast("long")).alias("full_rows"),
    )
