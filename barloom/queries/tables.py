"""Market tables derived from ``events`` and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import bias_score, decision_of, training_target
from ..operators import bars as B
from ..operators import indicators as I
from ..operators import labels as L
from ..plans.blocks import with_position
from ..session import stage
from .registry import cte

HOUR = B.HOUR
# hourly tick bars jump by multiples of the price; a full allocation could be ruined by one short
ALLOC = 0.1
# readiness of the registered experiments: a month of data has too few days for daily RSI and ATR
READY = [c for c in L.REQUIRED_FEATURES if c not in ("1d_rsi14", "1d_atr14_pct")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks; prices are offset because ``value`` can be zero."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        "event_id",
        (F.col("value") + 100.0).alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


cte(
    "ticks",
    """SELECT event_type AS symbol, ts AS timestamp, event_id, value + 100.0::DOUBLE AS price,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events""",
)


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with their row number in the symbol (``pos``)."""

    def build() -> DataFrame:
        made = B.ticks_to_bars(ticks(spark, sf_dir), HOUR)
        return with_position(made, keys=["symbol"], ts="timestamp", step=HOUR, reset=False)

    return stage(spark, sf_dir, "bars_1h", build)


cte(
    "bars",
    """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS pos,
        timestamp + INTERVAL 1 HOUR AS known_at FROM (
       SELECT symbol, date_trunc('hour', timestamp) AS timestamp,
       arg_min(price, (timestamp, event_id)) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, (timestamp, event_id)) AS close, sum(volume) AS volume, count(*) AS n_ticks
       FROM ticks GROUP BY ALL)""",
)
for _name, _hours in (("bars4", 4), ("bars24", 24)):
    cte(
        _name,
        f"""SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS pos,
            timestamp + INTERVAL {_hours} HOUR AS known_at FROM (
           SELECT symbol, time_bucket(INTERVAL {_hours} HOUR, timestamp, TIMESTAMP '1970-01-01') AS timestamp,
           arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low,
           arg_max(close, timestamp) AS close, sum(volume) AS volume, count(*) AS bar_count
           FROM bars GROUP BY symbol, time_bucket(INTERVAL {_hours} HOUR, timestamp, TIMESTAMP '1970-01-01')
           HAVING count(*) = {_hours})""",
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "features", lambda: I.feature_table(bars_1h(spark, sf_dir)))


def _deltas(src: str) -> str:
    return f"""SELECT *, lag(close) OVER w AS prev_close, close - lag(close) OVER w AS delta,
        greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
        FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY pos)"""


def _ewm(src: str, spans: dict[str, int]) -> str:
    """Sequential recursion over rows, independent of the blocked plan."""
    first = ", ".join(f"close AS {n}" for n in spans)
    nxt = ", ".join(f"e.{n} + (d.close - e.{n}) * (2.0::DOUBLE / {k + 1})" for n, k in spans.items())
    w = "(1.0::DOUBLE / 14)"
    wilder = lambda c: f"CASE WHEN d.pos = 1 THEN {c} ELSE e.{{0}} + ({c} - e.{{0}}) * {w} END"
    gain = wilder("greatest(d.delta, 0.0::DOUBLE)").replace("{0}", "ag")
    loss = wilder("greatest(-d.delta, 0.0::DOUBLE)").replace("{0}", "al")
    return f"""SELECT symbol, pos, {first}, NULL::DOUBLE AS ag, NULL::DOUBLE AS al, tr AS atr FROM {src} WHERE pos = 0
        UNION ALL
        SELECT d.symbol, d.pos, {nxt}, {gain}, {loss}, e.atr + (d.tr - e.atr) * {w}
        FROM {{self}} e JOIN {src} d ON d.symbol = e.symbol AND d.pos = e.pos + 1"""


cte("deltas1", _deltas("bars"))
cte("deltas4", _deltas("bars4"))
cte("deltas24", _deltas("bars24"))
cte("ewm1", _ewm("deltas1", {"ema20": 20, "ema50": 50, "ema200": 200}).replace("{self}", "ewm1"))
cte("ewm4", _ewm("deltas4", {"ema20": 20, "ema50": 50}).replace("{self}", "ewm4"))
cte("ewm24", _ewm("deltas24", {"ema20": 20, "ema50": 50}).replace("{self}", "ewm24"))
for _p, _n, _h in (("4h", "4", 4), ("1d", "24", 24)):
    cte(
        f"htf{_n}",
        f"""SELECT symbol, timestamp + INTERVAL {_h} HOUR AS "{_p}_available_at", close AS "{_p}_close",
        e.ema20 AS "{_p}_ema20", e.ema50 AS "{_p}_ema50",
        CASE WHEN pos >= 14 THEN 100 - 100 / (1 + ag / nullif(al, 0)) END AS "{_p}_rsi14",
        CASE WHEN pos >= 13 THEN atr / close * 100 END AS "{_p}_atr14_pct",
        CASE WHEN close > ema20 AND ema20 > ema50 THEN 1 WHEN close < ema20 AND ema20 < ema50 THEN -1 ELSE 0 END
        AS "{_p}_trend" FROM deltas{_n} JOIN ewm{_n} e USING (symbol, pos)""",
    )


def _guard(n: int, expr: str) -> str:
    return f"CASE WHEN pos >= {n} THEN {expr} END"


_W = lambda a, b: f"OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"
cte(
    "base1",
    f"""SELECT *, {", ".join(f"close / lag(close, {n}) OVER s - 1 AS return_{n}h" for n in (1, 3, 6, 24))},
    ln(close / prev_close) AS log_return_1h,
    {_guard(19, f"avg(volume) {_W(19, 0)}")} AS volume_sma20,
    {", ".join(_guard(n, f"max(high) {_W(n, 1)}") + f" AS prev_high_{n}h" for n in (24, 72))},
    {", ".join(_guard(n, f"min(low) {_W(n, 1)}") + f" AS prev_low_{n}h" for n in (24, 72))},
    (high - low) / open * 100 AS range_pct, (close - open) / open * 100 AS body_pct,
    (high - greatest(open, close)) / open * 100 AS upper_wick_pct,
    (least(open, close) - low) / open * 100 AS lower_wick_pct
    FROM deltas1 WINDOW s AS (PARTITION BY symbol ORDER BY pos)""",
)
cte(
    "base2",
    f"""SELECT b.*, e.ema20, e.ema50, e.ema200,
    {", ".join(_guard(n, f"stddev_samp(log_return_1h) {_W(n - 1, 0)}") + f" AS volatility_{n}h" for n in (24, 72))},
    {", ".join(f"(close / ema{n} - 1) * 100 AS distance_ema{n}_pct" for n in (20, 50, 200))},
    {", ".join(f"(prev_high_{n}h / close - 1) * 100 AS distance_high_{n}h_pct" for n in (24, 72))},
    {", ".join(f"(close / prev_low_{n}h - 1) * 100 AS distance_low_{n}h_pct" for n in (24, 72))},
    {_guard(14, "100 - 100 / (1 + ag / nullif(al, 0))")} AS rsi14,
    {_guard(13, "atr")} AS atr14, {_guard(13, "atr / close * 100")} AS atr14_pct,
    volume / nullif(volume_sma20, 0) AS volume_ratio,
    CASE WHEN close > prev_high_24h THEN 1 ELSE 0 END AS breakout_24h,
    CASE WHEN close < prev_low_24h THEN 1 ELSE 0 END AS breakdown_24h,
    CASE WHEN close > ema20 AND ema20 > ema50 AND ema50 > ema200 THEN 1
         WHEN close < ema20 AND ema20 < ema50 AND ema50 < ema200 THEN -1 ELSE 0 END AS trend_1h,
    (ema20 / ema50 - 1) * 100 AS ema20_50_spread_pct, (ema50 / ema200 - 1) * 100 AS ema50_200_spread_pct,
    timestamp + INTERVAL 1 HOUR AS available_at
    FROM base1 b JOIN ewm1 e USING (symbol, pos)""",
)
cte(
    "feats",
    """SELECT x.*, d.* EXCLUDE (symbol), x.trend_1h + x."4h_trend" + d."1d_trend" AS trend_alignment FROM (
      SELECT b.*, h.* EXCLUDE (symbol) FROM base2 b
      ASOF LEFT JOIN htf4 h ON h.symbol = b.symbol AND b.available_at >= h."4h_available_at") x
    ASOF LEFT JOIN htf24 d ON d.symbol = x.symbol AND x.available_at >= d."1d_available_at" """,
)


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features plus forward labels and readiness flags."""

    def build() -> DataFrame:
        rows = L.add_labels(features(spark, sf_dir))
        score = bias_score()
        return L.readiness(rows, READY).withColumn("bias_score", score)

    return stage(spark, sf_dir, "labeled", build)


def _touch_sql(h: int, side: str, entry: str, name: str) -> str:
    up, down = ("high >= {e} + 1.5 * {a}", "low <= {e} - {a}") if side == "long" else (
        "low <= {e} - 1.5 * {a}", "high >= {e} + {a}")
    f = dict(e=entry, a="f.atr14")
    up, down = up.format(**f), down.format(**f)
    up, down = ("x." + s for s in (up, down))
    return (
        f"min(CASE WHEN {up} AND x.k <= {h} THEN x.k END) AS tp_{name}, "
        f"min(CASE WHEN {down} AND x.k <= {h} THEN x.k END) AS sl_{name}"
    )


_H = L.HORIZONS
_combos = [(h, s, e) for h in _H for s in ("long", "short") for e in ("", "_no")]
cte(
    "ahead",
    f"""SELECT f.symbol, f.pos, count(*) AS n_ahead,
    min(CASE WHEN x.k = 1 THEN x.open END) AS next_open,
    {", ".join(f"max(CASE WHEN x.k <= {h} THEN x.high END) AS hi{h}, min(CASE WHEN x.k <= {h} THEN x.low END) AS lo{h}, max(CASE WHEN x.k = {h} THEN x.close END) AS last{h}" for h in _H)},
    {", ".join(_touch_sql(h, s, "f.close" if e == "" else "f.next_open", f"{s}{h}{e}") for h, s, e in _combos)}
    FROM (SELECT symbol, pos, close, atr14, lead(open) OVER (PARTITION BY symbol ORDER BY pos) AS next_open FROM base2) f
    JOIN (SELECT b.symbol, b.pos - k AS at, k, open, high, low, close FROM bars b, range(1, 25) r(k)) x
    ON x.symbol = f.symbol AND x.at = f.pos GROUP BY f.symbol, f.pos""",
)


def _outcome_sql(h: int, side: str, suffix: str) -> str:
    tp, sl = f"coalesce(tp_{side}{h}{suffix}, 99)", f"coalesce(sl_{side}{h}{suffix}, 99)"
    return f"""CASE WHEN n_ahead >= {h} AND atr14 IS NOT NULL THEN
        CASE WHEN {tp} < {sl} THEN 1 WHEN {sl} < {tp} THEN -1 WHEN {tp} = 99 THEN 0 END END"""


def _label_cols() -> str:
    out = []
    for h in _H:
        ok = f"n_ahead >= {h} AND atr14 IS NOT NULL"
        vals = {
            f"future_return_{h}h_pct": f"(last{h} / close - 1) * 100",
            f"long_best_{h}h_pct": f"(hi{h} / close - 1) * 100",
            f"long_worst_{h}h_pct": f"(lo{h} / close - 1) * 100",
            f"short_best_{h}h_pct": f"(close / lo{h} - 1) * 100",
            f"short_worst_{h}h_pct": f"-((hi{h} / close - 1) * 100)",
            f"up_move_{h}h_atr": f"(hi{h} - close) / atr14",
            f"down_move_{h}h_atr": f"(close - lo{h}) / atr14",
        }
        out += [f"CASE WHEN {ok} THEN {v} END AS {k}" for k, v in vals.items()]
        for s in ("long", "short"):
            tp, sl = f"tp_{s}{h}", f"sl_{s}{h}"
            out += [
                f"{_outcome_sql(h, s, '')} AS {s}_outcome_{h}h",
                f"{_outcome_sql(h, s, '_no')} AS {s}_outcome_{h}h_next_open",
                f"CAST(CASE WHEN {ok} THEN least({tp}, {sl}) END AS INTEGER) AS {s}_delay_{h}h",
                f"coalesce({ok} AND {tp} = {sl}, false) AS {s}_ambiguous_{h}h",
            ]
    return ", ".join(out)


SCORE_SQL = """coalesce(trend_1h, 0) + coalesce("4h_trend", 0) + coalesce("1d_trend", 0)
    + CASE WHEN close > ema20 THEN 1 WHEN close < ema20 THEN -1 ELSE 0 END
    + CASE WHEN ema20 > ema50 THEN 1 WHEN ema20 < ema50 THEN -1 ELSE 0 END
    + CASE WHEN rsi14 BETWEEN 52 AND 70 THEN 1 WHEN rsi14 BETWEEN 30 AND 48 THEN -1 ELSE 0 END"""
cte(
    "labeled",
    f"""SELECT *, {" AND ".join(f'"{c}" IS NOT NULL' for c in READY)} AS features_ready,
    future_return_24h_pct IS NOT NULL AS labels_24h_ready,
    {" AND ".join(f'"{c}" IS NOT NULL' for c in READY)} AND future_return_24h_pct IS NOT NULL AS sample_ready,
    {SCORE_SQL} AS bias_score
    FROM (SELECT feats.*, a.next_open, (a.next_open / close - 1) * 100 AS entry_gap_pct, {_label_cols()}
          FROM feats LEFT JOIN ahead a USING (symbol, pos))""",
)


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable rows with their chronological split (purged rows dropped)."""
    from ..operators.sampling import chrono_split

    return stage(
        spark, sf_dir, "splits", lambda: chrono_split(labeled(spark, sf_dir).filter("sample_ready"), keys=["symbol"])
    )


cte(
    "ready_rows",
    """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS rn,
       count(*) OVER (PARTITION BY symbol) AS n FROM labeled WHERE sample_ready""",
)
cte(
    "split_bounds",
    """SELECT symbol, min(CASE WHEN rn = floor(n * 0.7::DOUBLE) THEN timestamp END) AS validation_start,
       min(CASE WHEN rn = floor(n * 0.85::DOUBLE) THEN timestamp END) AS test_start FROM ready_rows GROUP BY symbol""",
)
cte(
    "splits",
    """SELECT * FROM (SELECT r.* EXCLUDE (rn, n),
       CASE WHEN timestamp < validation_start - INTERVAL 24 HOUR THEN 'train'
            WHEN timestamp >= validation_start AND timestamp < test_start - INTERVAL 24 HOUR THEN 'validation'
            WHEN timestamp >= test_start THEN 'test' END AS split
       FROM ready_rows r JOIN split_bounds USING (symbol)) WHERE split IS NOT NULL""",
)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two competing rules on the split rows: 6-bar momentum and bias score."""

    def build() -> DataFrame:
        r6 = F.col("return_6h")
        score = F.col("bias_score")
        momentum = F.when(r6 > 0.05, "LONG_BIAS").when(r6 < -0.05, "SHORT_BIAS").otherwise("NO_TRADE")
        return splits(spark, sf_dir).select(
            "symbol", "timestamp", "available_at", "split",
            momentum.alias("model_prediction"),
            decision_of(score).alias("heuristic_prediction"),
            training_target(score, F.col("long_outcome_12h"), F.col("short_outcome_12h")).alias("target"),
            "bias_score", "long_outcome_12h", "short_outcome_12h", "future_return_12h_pct",
            "up_move_12h_atr", "down_move_12h_atr",
        )

    return stage(spark, sf_dir, "predictions", build)


cte(
    "predictions",
    """SELECT symbol, timestamp, available_at, split,
    CASE WHEN return_6h > 0.05 THEN 'LONG_BIAS' WHEN return_6h < -0.05 THEN 'SHORT_BIAS' ELSE 'NO_TRADE' END AS model_prediction,
    CASE WHEN bias_score >= 2 THEN 'LONG_BIAS' WHEN bias_score <= -2 THEN 'SHORT_BIAS' ELSE 'NO_TRADE' END AS heuristic_prediction,
    CASE WHEN long_outcome_12h IS NOT NULL AND short_outcome_12h IS NOT NULL THEN
      CASE WHEN bias_score >= 2 AND long_outcome_12h = 1 AND short_outcome_12h <> 1 THEN 'LONG_BIAS'
           WHEN bias_score <= -2 AND short_outcome_12h = 1 AND long_outcome_12h <> 1 THEN 'SHORT_BIAS'
           ELSE 'NO_TRADE' END END AS target,
    bias_score, long_outcome_12h, short_outcome_12h, future_return_12h_pct, up_move_12h_atr, down_move_12h_atr
    FROM splits""",
)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """|score| >= 2 rows of the splits with their event outcome."""
    from ..operators.events import build_candidates

    return stage(
        spark, sf_dir, "candidates", lambda: build_candidates(bars_1h(spark, sf_dir), splits(spark, sf_dir))
    )


cte(
    "cand",
    """SELECT *, CASE WHEN bias_score >= 2 THEN 'LONG' ELSE 'SHORT' END AS side, available_at AS known_at,
    symbol || '_' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '_' || CASE WHEN bias_score >= 2 THEN 'LONG' ELSE 'SHORT' END AS event_id
    FROM (SELECT *, max(timestamp) OVER (PARTITION BY symbol, split) AS split_end FROM splits) WHERE abs(bias_score) >= 2""",
)
cte(
    "cand_hits",
    """SELECT c.event_id, c.side, c.split_end, atr14, x.k, x.timestamp AS bar_at, x.open, x.high, x.low, x.close,
    min(CASE WHEN x.k = 1 THEN x.open END) OVER (PARTITION BY c.event_id) AS e
    FROM cand c JOIN (SELECT symbol, pos - k AS at, k, timestamp, open, high, low, close FROM bars, range(1, 13) r(k)) x
    ON x.symbol = c.symbol AND x.at = c.pos""",
)
cte(
    "cand_codes",
    """SELECT *, CASE WHEN side = 'LONG' THEN
        CASE WHEN k > 1 AND open <= sl THEN 'SL_GAP' WHEN k > 1 AND open >= tp THEN 'TP_GAP' WHEN low <= sl THEN 'SL' WHEN high >= tp THEN 'TP' END
      ELSE CASE WHEN k > 1 AND open >= sl THEN 'SL_GAP' WHEN k > 1 AND open <= tp THEN 'TP_GAP' WHEN high >= sl THEN 'SL' WHEN low <= tp THEN 'TP' END END AS code
    FROM (SELECT *, CASE WHEN side = 'LONG' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn,
          e + CASE WHEN side = 'LONG' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * 1.5::DOUBLE * atr14 AS tp,
          e - CASE WHEN side = 'LONG' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * atr14 AS sl FROM cand_hits)""",
)
cte(
    "cand_first",
    """SELECT *, e * (1 + sgn * 0.0002::DOUBLE) AS entry_fill, raw * (1 - sgn * 0.0002::DOUBLE) AS exit_fill FROM (
     SELECT *, CASE WHEN reason LIKE '%GAP' THEN xo WHEN reason = 'SL' THEN sl WHEN reason = 'TP' THEN tp ELSE xc END AS raw FROM (
      SELECT event_id, any_value(e) AS e, any_value(sgn) AS sgn, any_value(tp) AS tp, any_value(sl) AS sl, any_value(atr14) AS atr14,
       min(CASE WHEN k = 1 THEN bar_at END) AS entry_at,
       count(*) = 12 AND max(bar_at) <= any_value(split_end) AS inside,
       coalesce(arg_min(code, k) FILTER (code IS NOT NULL), 'TIME') AS reason,
       coalesce(min(k) FILTER (code IS NOT NULL), 12) AS duration_bars,
       coalesce(arg_min(open, k) FILTER (code IS NOT NULL), arg_max(open, k)) AS xo,
       coalesce(arg_min(close, k) FILTER (code IS NOT NULL), arg_max(close, k)) AS xc,
       coalesce(arg_min(bar_at, k) FILTER (code IS NOT NULL), max(bar_at)) AS exit_bar
      FROM cand_codes GROUP BY event_id))""",
)
OUTCOME_COLUMNS = (
    "event_outcome invalid_reason reason duration_bars entry_raw exit_raw entry_fill exit_fill gross_return net_return net_r "
    "entry_at label_available_at tp_price sl_price"
).split()
_val = {
    "event_outcome": "CASE WHEN ok THEN regexp_extract(f.reason, '^(TP|SL|TIME)', 1) ELSE 'DATA_INVALID' END",
    "invalid_reason": "CASE WHEN NOT coalesce(inside, false) THEN 'SPLIT_BOUNDARY' WHEN NOT ok THEN 'INVALID_EVENT' END",
    "reason": "CASE WHEN ok THEN f.reason END",
    "duration_bars": "CASE WHEN ok THEN CAST(f.duration_bars AS INTEGER) END",
    "entry_raw": "CASE WHEN ok THEN f.e END",
    "exit_raw": "CASE WHEN ok THEN f.raw END",
    "entry_fill": "CASE WHEN ok THEN f.entry_fill END",
    "exit_fill": "CASE WHEN ok THEN f.exit_fill END",
    "gross_return": "CASE WHEN ok THEN sgn * (f.exit_fill - f.entry_fill) / f.entry_fill END",
    "net_return": "CASE WHEN ok THEN sgn * (f.exit_fill - f.entry_fill) / f.entry_fill - 0.0005::DOUBLE * (1 + f.exit_fill / f.entry_fill) END",
    "net_r": "CASE WHEN ok THEN (sgn * (f.exit_fill - f.entry_fill) - 0.0005::DOUBLE * (f.entry_fill + f.exit_fill)) / f.atr14 END",
    "entry_at": "CASE WHEN ok THEN f.entry_at END",
    "label_available_at": "CASE WHEN ok THEN f.exit_bar + INTERVAL 1 HOUR END",
    "tp_price": "CASE WHEN ok THEN f.tp END",
    "sl_price": "CASE WHEN ok THEN f.sl END",
}
cte(
    "candidates",
    f"""SELECT * EXCLUDE (ok_) FROM (SELECT c.*, {", ".join(f"{v.replace('ok', 'ok_')} AS {k}" for k, v in _val.items())}, ok_
    FROM cand c LEFT JOIN (SELECT *, coalesce(inside AND atr14 > 0 AND tp > 0 AND sl > 0, false) AS ok_ FROM cand_first) f USING (event_id))""",
)
cte("valid_cand", "SELECT * FROM candidates WHERE event_outcome <> 'DATA_INVALID'")


def valid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).filter("event_outcome <> 'DATA_INVALID'")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-overlapping valid candidates per symbol and split, with equity."""
    from ..operators.events import equity_path, select_non_overlapping

    def build() -> DataFrame:
        rows = valid_candidates(spark, sf_dir).withColumn("exit_i", F.col("pos") + F.col("duration_bars"))
        keys = ["symbol", "split"]
        marked = select_non_overlapping(rows, keys=keys, start="pos", end="exit_i", order=["timestamp", "event_id"])
        taken = marked.filter("portfolio_status = 'TAKEN'").drop("portfolio_status")
        return equity_path(taken, keys=keys, r="net_return", order=["timestamp"], alloc=ALLOC)

    return stage(spark, sf_dir, "trades", build)


cte(
    "seq",
    """SELECT *, pos + duration_bars AS exit_i, row_number() OVER (PARTITION BY symbol, split ORDER BY pos) AS rn FROM valid_cand""",
)
cte(
    "nxt",
    """SELECT a.symbol, a.split, a.rn, min(b.rn) AS next_rn FROM seq a LEFT JOIN seq b
       ON a.symbol = b.symbol AND a.split = b.split AND b.pos > a.exit_i GROUP BY ALL""",
)
cte(
    "walk",
    """SELECT symbol, split, rn FROM seq WHERE rn = 1 UNION ALL
       SELECT w.symbol, w.split, n.next_rn FROM walk w JOIN nxt n USING (symbol, split, rn) WHERE n.next_rn IS NOT NULL""",
)
cte(
    "trades",
    """SELECT *, ln(1 + 0.1::DOUBLE * net_return) AS log_equity_return, equity_after / (1 + 0.1::DOUBLE * net_return) AS equity_before,
       equity_after / greatest(1, max(equity_after) OVER w) - 1 AS drawdown, row_number() OVER w AS trade_no FROM (
       SELECT s.*, exp(sum(ln(1 + 0.1::DOUBLE * net_return)) OVER (PARTITION BY symbol, split ORDER BY rn)) AS equity_after
       FROM seq s JOIN walk USING (symbol, split, rn)) WINDOW w AS (PARTITION BY symbol, split ORDER BY rn)""",
)


def dense_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second, longer market: one symbol per return flag, one ship day of ``lineitem`` as one hour, mean unit price as close."""

    def build() -> DataFrame:
        hours = F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date"))
        stamp = F.timestamp_seconds(F.lit(946_684_800) + hours * HOUR).cast("timestamp_ntz")
        return (
            table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), stamp.alias("timestamp"))
            .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))
        )

    return stage(spark, sf_dir, "dense_bars", build)


cte(
    "dense",
    """SELECT l_returnflag AS symbol, TIMESTAMP '2000-01-01' + to_hours(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate)) AS timestamp,
       avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL""",
)
# gap-free runs: within one, time minus row number is constant
cte(
    "dense_runs",
    """SELECT *, row_number() OVER (PARTITION BY symbol, seg ORDER BY timestamp) - 1 AS spos FROM (
       SELECT *, timestamp - to_hours(row_number() OVER (PARTITION BY symbol ORDER BY timestamp)) AS seg FROM dense)""",
)
cte("dense_rets", "SELECT symbol, seg, spos, timestamp, close, ln(close / lag(close) OVER (PARTITION BY symbol, seg ORDER BY spos)) AS r FROM dense_runs")
