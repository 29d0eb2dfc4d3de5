"""Indicator tables."""

from __future__ import annotations

from ..operators import indicators as I
from ..session import stage
from .registry import cte, query
from .tables import HOUR, bars_1h, features, labeled, predictions

FEATURE_COLUMNS = (
    "return_1h return_3h return_6h return_24h log_return_1h ema20 ema50 ema200 distance_ema20_pct distance_ema50_pct "
    "distance_ema200_pct rsi14 atr14 atr14_pct volume_sma20 volume_ratio volatility_24h volatility_72h range_pct "
    "body_pct upper_wick_pct lower_wick_pct prev_high_24h prev_low_24h prev_high_72h prev_low_72h "
    "distance_high_24h_pct distance_low_24h_pct distance_high_72h_pct distance_low_72h_pct ema20_50_spread_pct "
    "ema50_200_spread_pct 4h_close 4h_ema20 4h_ema50 4h_rsi14 4h_atr14_pct 1d_close 1d_ema20 1d_ema50 1d_rsi14 1d_atr14_pct"
)
FEATURE_FLAGS = "breakout_24h breakdown_24h trend_1h 4h_trend 1d_trend trend_alignment"
_all = ", ".join(f'"{c}"' for c in f"{FEATURE_COLUMNS} {FEATURE_FLAGS}".split())


@query("feature_table", f"SELECT symbol, timestamp, available_at, {_all} FROM feats", FEATURE_COLUMNS)
def _(spark, d):
    return features(spark, d).select("symbol", "timestamp", "available_at", *FEATURE_COLUMNS.split(), *FEATURE_FLAGS.split())


LABEL_COLUMNS = " ".join(
    f"{k}_{h}h{s}"
    for h in (4, 12, 24)
    for k, s in (("future_return", "_pct"), ("long_best", "_pct"), ("long_worst", "_pct"), ("short_best", "_pct"),
                 ("short_worst", "_pct"), ("up_move", "_atr"), ("down_move", "_atr"))
)
LABEL_INTS = " ".join(
    f"{s}_{k}_{h}h{x}" for h in (4, 12, 24) for s in ("long", "short")
    for k, x in (("outcome", ""), ("outcome", "_next_open"), ("delay", ""), ("ambiguous", ""))
)
_labels = ", ".join(f'"{c}"' for c in f"{LABEL_COLUMNS} {LABEL_INTS}".split())


@query(
    "forward_labels",
    f"SELECT symbol, timestamp, {_labels}, entry_gap_pct, bias_score, sample_ready FROM labeled",
    LABEL_COLUMNS + " entry_gap_pct",
)
def _(spark, d):
    return labeled(spark, d).select(
        "symbol", "timestamp", *LABEL_COLUMNS.split(), *LABEL_INTS.split(), "entry_gap_pct", "bias_score", "sample_ready"
    )


@query("two_predictions", "SELECT * FROM predictions", "future_return_12h_pct up_move_12h_atr down_move_12h_atr")
def _(spark, d):
    return predictions(spark, d)


_seg = "OVER (PARTITION BY symbol, seg ORDER BY spos ROWS BETWEEN {n} PRECEDING AND {m} PRECEDING)"
_win = lambda n, m=0: _seg.format(n=n, m=m)
for _n in ("1", "4"):
    cte(
        f"sd{_n}",
        f"""SELECT *, close - pc AS delta, CASE WHEN spos > 0 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM (
            SELECT *, lag(close) OVER (PARTITION BY symbol, seg ORDER BY spos) AS pc FROM runs{_n})""",
    )
    cte(
        f"seeds{_n}",
        f"""SELECT *, avg(greatest(delta, 0)) {_win(13)} AS g0, avg(greatest(-delta, 0)) {_win(13)} AS l0 FROM sd{_n}""",
    )
    cte(
        f"se{_n}",
        f"""SELECT symbol, seg, spos, close AS e12, close AS e26, NULL::DOUBLE AS sig, NULL::DOUBLE AS g, NULL::DOUBLE AS l FROM seeds{_n} WHERE spos = 0
            UNION ALL SELECT symbol, seg, spos, n12, n26, CASE WHEN spos = 25 THEN n12 - n26 WHEN spos > 25 THEN sig + (n12 - n26 - sig) * 0.2::DOUBLE END,
             CASE WHEN spos = 14 THEN g0 WHEN spos > 14 THEN (13 * g + greatest(delta, 0)) / 14 END, CASE WHEN spos = 14 THEN l0 WHEN spos > 14 THEN (13 * l + greatest(-delta, 0)) / 14 END FROM (
             SELECT d.symbol, d.seg, d.spos, d.delta, d.g0, d.l0, e.sig, e.g, e.l, e.e12 + (d.close - e.e12) * (2.0::DOUBLE / 13) AS n12, e.e26 + (d.close - e.e26) * (2.0::DOUBLE / 27) AS n26
             FROM se{_n} e JOIN seeds{_n} d ON d.symbol = e.symbol AND d.seg = e.seg AND d.spos = e.spos + 1)""",
    )
    _full = lambda n, x: f"CASE WHEN spos >= {n} THEN {x} END"
    cte(
        f"ind{_n}",
        f"""SELECT symbol, timestamp, known_at, close, close / pc - 1 AS return_1, {_full(11, 'close / e12 - 1')} AS ema12_distance, {_full(25, 'close / e26 - 1')} AS ema26_distance,
            {_full(19, f'close / avg(close) {_win(19)} - 1')} AS sma20_distance,
            CASE WHEN spos >= 14 THEN CASE WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi14,
            {_full(25, '(e12 - e26) / close')} AS macd_12_26, {_full(33, 'sig / close')} AS macd_signal9, {_full(33, '(e12 - e26 - sig) / close')} AS macd_hist,
            {_full(14, f'avg(tr) {_win(13)} / close')} AS atr14_pct, {_full(19, f'(close - avg(close) {_win(19)}) / nullif(stddev_pop(close) {_win(19)}, 0)')} AS bb20_z,
            {_full(19, f'4 * stddev_pop(close) {_win(19)} / avg(close) {_win(19)}')} AS bb20_width_pct,
            {_full(19, f'close / (sum((high + low + close) / 3 * volume) {_win(19)} / nullif(sum(volume) {_win(19)}, 0)) - 1')} AS rolling_vwap20_distance,
            {_full(20, f'volume / nullif(avg(volume) {_win(20, 1)}, 0)')} AS relative_volume20 FROM sd{_n} JOIN se{_n} USING (symbol, seg, spos)""",
    )
_F = " ".join(I.SNAPSHOT_FEATURES)


@query("segment_indicators_1h", f"SELECT symbol, timestamp, {', '.join(_F.split())} FROM ind1", _F)
def _(spark, d):
    """Thirteen indicators, restarted at every gap."""
    return I.segment_indicators(bars_1h(spark, d).drop("pos"), HOUR).select("symbol", "timestamp", *I.SNAPSHOT_FEATURES)


def _ind_sql() -> str:
    one = ", ".join(f"a.{c} AS {c}_1h" for c in I.SNAPSHOT_FEATURES)
    four = ", ".join(f"CASE WHEN m THEN b_{c} END AS {c}_4h" for c in I.SNAPSHOT_FEATURES)
    keep = ", ".join(f"b.{c} AS b_{c}" for c in I.SNAPSHOT_FEATURES)
    return f"""SELECT * EXCLUDE (m, b_known, b_close, {", ".join(f"b_{c}" for c in I.SNAPSHOT_FEATURES)}), CASE WHEN m THEN b_known END AS known_at_4h, CASE WHEN m THEN b_close END AS close_4h, {four} FROM (
       SELECT a.symbol, a.timestamp AS bar_open_1h, a.known_at AS decision_at, a.known_at AS known_at_1h, a.close AS close_1h, {one}, b.known_at AS b_known, b.close AS b_close, {keep},
       b.known_at IS NOT NULL AND a.known_at - b.known_at <= INTERVAL 4 HOUR AS m FROM ind1 a ASOF LEFT JOIN ind4 b ON a.symbol = b.symbol AND a.known_at >= b.known_at)"""


cte("ind_snap", _ind_sql())
_FRAMES = {"1h": HOUR, "4h": 4 * HOUR}


def indicator_rows(spark, d):
    return stage(spark, d, "indicator_snapshots", lambda: I.indicator_snapshots(bars_1h(spark, d).drop("pos"), _FRAMES))


@query("indicator_snapshots", "SELECT * FROM ind_snap", " ".join(f"{c}_{t}" for t in _FRAMES for c in ["close", *I.SNAPSHOT_FEATURES]))
def _(spark, d):
    return indicator_rows(spark, d)
