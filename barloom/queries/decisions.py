"""Decisions, outcomes, agreement, API-style listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as V
from ..operators import sampling as H
from ..operators import stats as T
from .registry import cte, query
from .tables import HOUR, bars_1h, candidates, features, labeled, predictions, splits, valid_candidates
from .structure import FRAMES, structure, zigzag_events

_OUT = "CASE {x} WHEN 1 THEN 'TP' WHEN -1 THEN 'SL' WHEN 0 THEN 'UNRESOLVED' ELSE 'UNKNOWN' END"
_res = lambda c: (
    f"CASE {c} WHEN 'NO_TRADE' THEN 'NO_TRADE' WHEN 'LONG_BIAS' THEN {_OUT.format(x='long_outcome_12h')} "
    f"WHEN 'SHORT_BIAS' THEN {_OUT.format(x='short_outcome_12h')} ELSE 'UNKNOWN' END"
)
cte("judged", f"SELECT *, {_res('model_prediction')} AS a_result, {_res('heuristic_prediction')} AS b_result FROM predictions")


@query("decision_outcomes", "SELECT symbol, timestamp, split, model_prediction, heuristic_prediction, target, a_result, b_result FROM judged")
def _(spark, d):
    p = predictions(spark, d)
    r = lambda c: V.outcome_of(F.col(c), F.col("long_outcome_12h"), F.col("short_outcome_12h"))
    return p.select(
        "symbol", "timestamp", "split", "model_prediction", "heuristic_prediction", "target",
        r("model_prediction").alias("a_result"), r("heuristic_prediction").alias("b_result"),
    )


def _stats_sql(dec: str, res: str, by: str, extra: str = "") -> str:
    return f"""SELECT *, long + short AS directional_signals, tp + sl AS resolved, round(100.0::DOUBLE * (long + short) / samples, 2) AS coverage_pct,
      round(100.0::DOUBLE * tp / nullif(tp + sl, 0), 2) AS win_rate_pct, round(tp * 1.5::DOUBLE - sl, 4) AS total_r,
      round((tp * 1.5::DOUBLE - sl) / nullif(tp + sl, 0), 4) AS expected_r FROM (
      SELECT {by}, count(*) AS samples, count(*) FILTER ({dec} = 'LONG_BIAS') AS long, count(*) FILTER ({dec} = 'SHORT_BIAS') AS short,
      count(*) FILTER ({dec} = 'NO_TRADE') AS no_trade, count(*) FILTER ({res} = 'TP') AS tp, count(*) FILTER ({res} = 'SL') AS sl,
      count(*) FILTER ({res} = 'UNRESOLVED') AS unresolved, count(*) FILTER ({res} = 'UNKNOWN') AS unknown FROM judged {extra} GROUP BY {by})"""


@query("signal_stats_by_split", _stats_sql("model_prediction", "a_result", "split"))
def _(spark, d):
    return T.signal_stats(predictions(spark, d), "model_prediction", ["split"])


@query(
    "signal_stats_by_direction",
    _stats_sql("heuristic_prediction", "b_result", "split, heuristic_prediction", "WHERE heuristic_prediction <> 'NO_TRADE'"),
)
def _(spark, d):
    p = predictions(spark, d).filter("heuristic_prediction <> 'NO_TRADE'")
    return T.signal_stats(p, "heuristic_prediction", ["split", "heuristic_prediction"])


_D = "model_prediction <> heuristic_prediction"
_agree = f"""SELECT split, count(*) AS samples, count(*) FILTER (NOT {_D}) AS agreements, count(*) FILTER ({_D}) AS disagreements,
    count(*) FILTER ({_D} AND heuristic_prediction = 'NO_TRADE') AS a_trades_b_abstains,
    count(*) FILTER ({_D} AND model_prediction = 'NO_TRADE') AS b_trades_a_abstains,
    count(*) FILTER ({_D} AND model_prediction <> 'NO_TRADE' AND heuristic_prediction <> 'NO_TRADE') AS opposite_direction,
    count(*) FILTER ({_D} AND a_result = 'TP' AND b_result <> 'TP') AS a_tp_only, count(*) FILTER ({_D} AND b_result = 'TP' AND a_result <> 'TP') AS b_tp_only,
    count(*) FILTER ({_D} AND a_result = 'SL' AND b_result = 'SL') AS both_sl,
    round(100.0::DOUBLE * count(*) FILTER (NOT {_D}) / count(*), 2) AS agreement_pct FROM judged GROUP BY split"""


@query("agreement_stats", _agree)
def _(spark, d):
    return T.agreement_stats(predictions(spark, d), "model_prediction", "heuristic_prediction", ["split"])


cte(
    "disagreements",
    f"""SELECT *, CASE WHEN model_prediction = 'NO_TRADE' THEN 'A_ABSTAINS' WHEN heuristic_prediction = 'NO_TRADE' THEN 'A_ADDS_TRADE' ELSE 'OPPOSITE_DIRECTION' END AS type,
    CASE WHEN model_prediction = 'NO_TRADE' THEN CASE b_result WHEN 'SL' THEN 'SL_AVOIDED' WHEN 'TP' THEN 'TP_MISSED' ELSE 'UNDETERMINED' END
         WHEN heuristic_prediction = 'NO_TRADE' THEN CASE a_result WHEN 'TP' THEN 'TP_ADDED' WHEN 'SL' THEN 'SL_ADDED' ELSE 'UNDETERMINED' END
         ELSE 'UNDETERMINED' END AS category FROM judged WHERE {_D}""",
)
_CTX = ["close", "rsi14", "atr14_pct", "volume_ratio", "trend_1h", "4h_trend", "1d_trend", "trend_alignment", "features_ready"]
_ctx_sql = ", ".join(f'm."{c}"' for c in _CTX)


@query(
    "disagreement_listing",
    f"""SELECT x.symbol, x.timestamp, x.model_prediction, x.heuristic_prediction, x.target, x.bias_score, x.a_result, x.b_result, x.type, x.category,
        epoch(x.timestamp)::BIGINT AS time, {_ctx_sql} FROM disagreements x LEFT JOIN labeled m USING (symbol, timestamp) WHERE x.split = 'test'""",
    "close rsi14 atr14_pct volume_ratio",
)
def _(spark, d):
    """Disagreements of one split with their market context."""
    rows = T.classify_disagreements(predictions(spark, d).filter("split = 'test'"), "model_prediction", "heuristic_prediction")
    rows = rows.select(
        "symbol", "timestamp", "model_prediction", "heuristic_prediction", "target", "bias_score", "a_result", "b_result", "type",
        "category", V.epoch_seconds(F.col("timestamp")).alias("time"),
    )
    return rows.join(labeled(spark, d).select("symbol", "timestamp", *_CTX), ["symbol", "timestamp"], "left")


@query("disagreement_counts", "SELECT split, type, category, count(*) AS n FROM disagreements GROUP BY ALL")
def _(spark, d):
    rows = T.classify_disagreements(predictions(spark, d), "model_prediction", "heuristic_prediction")
    return rows.groupBy("split", "type", "category").agg(F.count(F.lit(1)).alias("n"))


_text = "lower(concat_ws(' ', symbol, model_prediction, heuristic_prediction, a_result, b_result, type, category))"


@query(
    "disagreement_search",
    f"SELECT symbol, timestamp, type, category FROM disagreements WHERE contains({_text}, 'abstains') AND category = 'SL_AVOIDED'",
)
def _(spark, d):
    """Free-text search over the joined fields plus a category filter."""
    rows = T.classify_disagreements(predictions(spark, d), "model_prediction", "heuristic_prediction")
    text = F.lower(F.concat_ws(" ", "symbol", "model_prediction", "heuristic_prediction", "a_result", "b_result", "type", "category"))
    return rows.filter(text.contains("abstains") & (F.col("category") == "SL_AVOIDED")).select("symbol", "timestamp", "type", "category")


# group memberships per side
_member = {
    "ALL_A": "a", "ALL_B": "b", "BOTH": "a AND b", "A_ONLY": "a AND NOT b", "B_ONLY": "b AND NOT a",
}
cte(
    "groups",
    " UNION ALL ".join(
        f"""SELECT symbol, timestamp, split, bias_score, '{s}' AS side, '{g}' AS "group", {s.lower()}_outcome_12h AS outcome FROM
        (SELECT *, model_prediction = '{s}_BIAS' AS a, heuristic_prediction = '{s}_BIAS' AS b FROM predictions) WHERE {cond}"""
        for s in ("LONG", "SHORT") for g, cond in _member.items()
    ),
)


def _group_sql(src: str, by: str) -> str:
    return f"""SELECT *, CASE WHEN resolved > 0 THEN (p + 3.8416::DOUBLE / (2 * n) - mg) / (1 + 3.8416::DOUBLE / n) ELSE 0 END AS ci95_low,
      CASE WHEN resolved > 0 THEN (p + 3.8416::DOUBLE / (2 * n) + mg) / (1 + 3.8416::DOUBLE / n) ELSE 0 END AS ci95_high FROM (
      SELECT *, 1.96::DOUBLE * sqrt((p * (1 - p) + 3.8416::DOUBLE / (4 * n)) / n) AS mg FROM (
      SELECT *, wins + losses AS resolved, (wins + losses)::DOUBLE AS n, wins::DOUBLE / nullif(wins + losses, 0) AS p, wins::DOUBLE / nullif(wins + losses, 0) AS win_rate,
       wins * 1.5::DOUBLE - losses AS total_r, (wins * 1.5::DOUBLE - losses) / trades AS expected_r,
       (wins * 1.5::DOUBLE - losses) / nullif(wins + losses, 0) AS expected_r_resolved, trades >= 20 AS sufficient_count FROM (
      SELECT {by}, count(*) AS trades, count(*) FILTER (outcome = 1) AS wins, count(*) FILTER (outcome = -1) AS losses,
       count(*) FILTER (outcome = 0 OR outcome IS NULL) AS unresolved FROM {src} GROUP BY {by})))"""


def _group_out(src: str, by: str) -> str:
    return f"SELECT * EXCLUDE (n, p, mg), ci95_low > 0.4::DOUBLE AS above_break_even FROM ({_group_sql(src, by)})"


_GD = "win_rate total_r expected_r expected_r_resolved ci95_low ci95_high"


def _groups(spark, d):
    return T.signal_groups(predictions(spark, d))


@query("value_added_groups", _group_out("groups", 'split, side, "group"'), _GD)
def _(spark, d):
    return T.group_stats(_groups(spark, d), ["split", "side", "group"])


@query(
    "monthly_performance",
    _group_out("""(SELECT *, strftime(timestamp, '%Y-%m') AS month FROM groups WHERE "group" = 'ALL_A')""", "split, month, side"),
    _GD,
)
def _(spark, d):
    g = _groups(spark, d).filter("group = 'ALL_A'").withColumn("month", F.date_format("timestamp", "yyyy-MM"))
    return T.group_stats(g, ["split", "month", "side"])


@query("combined_splits_break_even", _group_out("(SELECT * FROM groups WHERE split IN ('validation', 'test'))", 'side, "group"'), _GD)
def _(spark, d):
    """Validation and test pooled, with the break-even test on the interval."""
    return T.group_stats(_groups(spark, d).filter(F.col("split").isin("validation", "test")), ["side", "group"])


def _bin_sql(x: str, edges: list, labels: list[str]) -> str:
    cases = " ".join(f"WHEN {x} <= {e} THEN '{v}'" for e, v in zip(edges, labels))
    return f"CASE WHEN {x} IS NULL THEN 'MISSING' {cases} ELSE '{labels[-1]}' END"


cte(
    "regimes",
    "SELECT symbol, timestamp, CASE WHEN trend_alignment >= 2 THEN 'BULLISH_ALIGNMENT' WHEN trend_alignment <= -2 THEN 'BEARISH_ALIGNMENT' ELSE 'MIXED' END AS trend_regime, "
    + ", ".join(f"{_bin_sql(c, e, v)} AS {n}" for n, (c, e, v) in T.REGIMES.items())
    + " FROM labeled",
)


@query("regime_labels", "SELECT * FROM regimes")
def _(spark, d):
    return T.add_regimes(labeled(spark, d)).select("symbol", "timestamp", "trend_regime", *T.REGIMES)


def _with_regimes(spark, d):
    ctx = T.add_regimes(labeled(spark, d)).select("symbol", "timestamp", "trend_regime", *T.REGIMES)
    return _groups(spark, d).join(ctx, ["symbol", "timestamp"])


_dims = ["trend_regime", *T.REGIMES]


@query(
    "regime_summary",
    _group_out(
        "(" + " UNION ALL ".join(
            f"""SELECT g.split, g.side, g."group", g.outcome, '{x}' AS dimension, r.{x} AS regime FROM groups g JOIN regimes r USING (symbol, timestamp)
            WHERE "group" IN ('BOTH', 'A_ONLY', 'B_ONLY')""" for x in _dims) + ")",
        'split, side, "group", dimension, regime',
    ),
    _GD,
)
def _(spark, d):
    g = _with_regimes(spark, d).filter(F.col("group").isin("BOTH", "A_ONLY", "B_ONLY"))
    return T.regime_summary(g, ["split", "side", "group"])


_FC = ["rsi14", "atr14_pct", "volume_ratio", "distance_ema200_pct", "trend_alignment"]


@query(
    "group_feature_stats",
    " UNION ALL ".join(
        f"""SELECT split, side, "group", '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, quantile_cont({c}::DOUBLE, 0.25::DOUBLE) AS q25,
        quantile_cont({c}::DOUBLE, 0.5::DOUBLE) AS median, quantile_cont({c}::DOUBLE, 0.75::DOUBLE) AS q75 FROM groups JOIN labeled USING (symbol, timestamp)
        WHERE {c} IS NOT NULL GROUP BY split, side, "group" """ for c in _FC),
    "mean std q25 median q75",
)
def _(spark, d):
    g = _groups(spark, d).join(labeled(spark, d).select("symbol", "timestamp", *_FC), ["symbol", "timestamp"])
    return T.feature_stats(g, ["split", "side", "group"], _FC)


cte(
    "cells",
    "SELECT split, target, heuristic_prediction AS pred, count(*) AS n FROM predictions WHERE target IS NOT NULL GROUP BY ALL",
)


@query(
    "classification_report",
    """SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM (
       SELECT split, label, support, predicted, 0::BIGINT AS invalid, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, acc::DOUBLE / n AS accuracy FROM (
       SELECT split, label, CAST(coalesce(sum(n) FILTER (target = label), 0) AS BIGINT) AS support, CAST(coalesce(sum(n) FILTER (pred = label), 0) AS BIGINT) AS predicted,
         coalesce(sum(n) FILTER (pred = label AND target = label), 0) AS tp, sum(n) FILTER (pred = target) AS acc, sum(n) AS n
       FROM cells, (SELECT unnest(['NO_TRADE', 'LONG_BIAS', 'SHORT_BIAS']) AS label) GROUP BY split, label))""",
    "precision recall f1 accuracy",
)
def _(spark, d):
    p = predictions(spark, d).filter("target is not null")
    return T.classification_report(p, "target", "heuristic_prediction", ["split"])


@query(
    "confusion_matrix",
    """SELECT target, CAST(coalesce(sum(n) FILTER (pred = 'NO_TRADE'), 0) AS BIGINT) AS NO_TRADE, CAST(coalesce(sum(n) FILTER (pred = 'LONG_BIAS'), 0) AS BIGINT) AS LONG_BIAS,
       CAST(coalesce(sum(n) FILTER (pred = 'SHORT_BIAS'), 0) AS BIGINT) AS SHORT_BIAS FROM cells GROUP BY target""",
)
def _(spark, d):
    return T.confusion_matrix(predictions(spark, d).filter("target is not null"), "target", "heuristic_prediction")


# listings and point queries
_at = lambda s: F.lit(s).cast("timestamp_ntz")
_CANDLE = "symbol timestamp available_at open high low close volume ema20 ema50 ema200 rsi14".split()


@query(
    "candles_range",
    f"""SELECT {", ".join(_CANDLE)} FROM feats WHERE symbol = 'click' AND timestamp >= TIMESTAMP '2024-01-10' AND timestamp <= TIMESTAMP '2024-01-20'
        ORDER BY timestamp DESC LIMIT 100""",
    "open high low close volume ema20 ema50 ema200 rsi14",
)
def _(spark, d):
    """Newest candles inside a range, oldest first."""
    f = features(spark, d).filter((F.col("symbol") == "click") & F.col("timestamp").between(_at("2024-01-10"), _at("2024-01-20")))
    return H.newest(f.select(*_CANDLE), 100)


@query(
    "candle_point",
    """SELECT symbol, timestamp, close, rsi14, atr14, "4h_trend", trend_alignment FROM feats WHERE timestamp = to_timestamp(1705312800)::TIMESTAMP""",
    "close rsi14 atr14",
)
def _(spark, d):
    """Point lookup by epoch seconds."""
    f = features(spark, d).filter(F.col("timestamp") == V.from_epoch_seconds(F.lit(1705312800)))
    return f.select("symbol", "timestamp", "close", "rsi14", "atr14", "4h_trend", "trend_alignment")


@query(
    "prediction_point",
    f"""SELECT symbol, timestamp, count(*) AS matches, any_value(model_prediction) AS model_prediction, any_value(heuristic_prediction) AS heuristic_prediction,
        any_value({_OUT.format(x='long_outcome_12h')}) AS long_result, any_value({_OUT.format(x='short_outcome_12h')}) AS short_result,
        any_value(model_prediction = heuristic_prediction) AS agrees, any_value(model_prediction = target) AS model_matches_target,
        any_value(heuristic_prediction = target) AS heuristic_matches_target
        FROM predictions WHERE symbol = 'view' AND timestamp >= TIMESTAMP '2024-01-25' GROUP BY ALL""",
)
def _(spark, d):
    """Predictions per time with agreement flags; ``matches`` > 1 is a conflict."""
    p = predictions(spark, d).filter((F.col("symbol") == "view") & (F.col("timestamp") >= _at("2024-01-25")))
    one = lambda c, n: F.first(c).alias(n)
    return p.groupBy("symbol", "timestamp").agg(
        F.count(F.lit(1)).alias("matches"), F.first("model_prediction").alias("model_prediction"), F.first("heuristic_prediction").alias("heuristic_prediction"),
        one(V.outcome_name(F.col("long_outcome_12h")), "long_result"), one(V.outcome_name(F.col("short_outcome_12h")), "short_result"),
        one(F.col("model_prediction") == F.col("heuristic_prediction"), "agrees"), one(F.col("model_prediction") == F.col("target"), "model_matches_target"),
        one(F.col("heuristic_prediction") == F.col("target"), "heuristic_matches_target"),
    )


@query(
    "signals_range",
    """SELECT symbol, timestamp, model_prediction, heuristic_prediction, a_result, b_result, bias_score FROM judged
       WHERE split = 'test' AND timestamp BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-30' ORDER BY timestamp, symbol LIMIT 150""",
)
def _(spark, d):
    r = lambda c: V.outcome_of(F.col(c), F.col("long_outcome_12h"), F.col("short_outcome_12h"))
    p = predictions(spark, d).filter((F.col("split") == "test") & F.col("timestamp").between(_at("2024-01-20"), _at("2024-01-30")))
    return p.select(
        "symbol", "timestamp", "model_prediction", "heuristic_prediction", r("model_prediction").alias("a_result"),
        r("heuristic_prediction").alias("b_result"), "bias_score",
    ).orderBy("timestamp", "symbol").limit(150)


@query(
    "visible_signals",
    """SELECT symbol, source, decision, count(*) AS signals, count(*) FILTER (result = 'TP') AS wins, count(*) FILTER (result = 'SL') AS losses FROM (
       SELECT symbol, source, decision, result FROM (
         SELECT symbol, timestamp, 'MODEL' AS source, model_prediction AS decision, a_result AS result FROM judged
         UNION ALL SELECT symbol, timestamp, 'HEURISTIC', heuristic_prediction, b_result FROM judged
         UNION ALL SELECT symbol, timestamp, 'TARGET', target, 'UNKNOWN' FROM judged WHERE target IS NOT NULL)
       WHERE decision <> 'NO_TRADE' AND (symbol, timestamp) IN (SELECT (symbol, timestamp) FROM bars WHERE timestamp >= TIMESTAMP '2024-01-15')) GROUP BY ALL""",
)
def _(spark, d):
    """Signals by source on the bars in view (semi-join, unpivot, counts)."""
    r = lambda c: V.outcome_of(F.col(c), F.col("long_outcome_12h"), F.col("short_outcome_12h"))
    view = bars_1h(spark, d).filter(F.col("timestamp") >= _at("2024-01-15")).select("symbol", "timestamp")
    p = predictions(spark, d).join(view, ["symbol", "timestamp"], "left_semi")
    s = lambda n, c, x: F.struct(F.lit(n).alias("source"), F.col(c).alias("decision"), x.alias("result"))
    items = F.array(
        s("MODEL", "model_prediction", r("model_prediction")), s("HEURISTIC", "heuristic_prediction", r("heuristic_prediction")),
        s("TARGET", "target", F.lit("UNKNOWN")),
    )
    long = p.withColumn("_s", F.explode(items)).select("symbol", "_s.*").filter("decision <> 'NO_TRADE'")
    return long.groupBy("symbol", "source", "decision").agg(
        F.count(F.lit(1)).alias("signals"), T.n_where(F.col("result") == "TP").alias("wins"), T.n_where(F.col("result") == "SL").alias("losses")
    )


@query(
    "unscored_rows",
    "SELECT symbol, timestamp FROM splits ANTI JOIN (SELECT symbol, timestamp FROM predictions WHERE model_prediction <> 'NO_TRADE') USING (symbol, timestamp)",
)
def _(spark, d):
    """Rows a resumed run still has to score (anti-join)."""
    done = predictions(spark, d).filter("model_prediction <> 'NO_TRADE'").select("symbol", "timestamp")
    return splits(spark, d).select("symbol", "timestamp").join(done, ["symbol", "timestamp"], "left_anti")


@query(
    "focus_window",
    """SELECT symbol, timestamp, close FROM bars WHERE timestamp BETWEEN TIMESTAMP '2024-01-16 12:00:00' - INTERVAL 72 HOUR AND TIMESTAMP '2024-01-16 12:00:00' + INTERVAL 72 HOUR""",
    "close",
)
def _(spark, d):
    mid = _at("2024-01-16 12:00:00")
    span = F.expr("INTERVAL 72 HOUR")
    return bars_1h(spark, d).filter(F.col("timestamp").between(mid - span, mid + span)).select("symbol", "timestamp", "close")


@query(
    "level_steps_per_candle",
    """SELECT b.symbol, b.timestamp, h.price AS last_high, h.confirmation_at AS high_known_at, l.price AS last_low, l.confirmation_at AS low_known_at FROM bars b
       ASOF LEFT JOIN (SELECT * FROM zigzag_events WHERE timeframe = '4h' AND kind = 'HIGH') h ON h.symbol = b.symbol AND b.timestamp >= h.confirmation_at
       ASOF LEFT JOIN (SELECT * FROM zigzag_events WHERE timeframe = '4h' AND kind = 'LOW') l ON l.symbol = b.symbol AND b.timestamp >= l.confirmation_at""",
    "last_high last_low",
)
def _(spark, d):
    """Levels known at each candle, as steps."""
    from ..plans.asof import Right, asof_join

    z = zigzag_events(spark, d).filter("timeframe = '4h'")
    side = lambda k: z.filter(F.col("kind") == k.upper()).select(
        "symbol", F.col("confirmation_at").alias(f"{k}_known_at"), F.col("price").alias(f"last_{k}"))
    return asof_join(
        bars_1h(spark, d).select("symbol", "timestamp"), Right(side("high"), "high_known_at"), Right(side("low"), "low_known_at"), left_on="timestamp"
    )


@query(
    "zigzag_polyline",
    """SELECT symbol, pivot_at, arg_max(price, confirmation_at) AS price, arg_max(kind, confirmation_at) AS kind FROM zigzag_events WHERE timeframe = '1h'
       AND (symbol, pivot_at) IN (SELECT (symbol, known_at) FROM bars) GROUP BY symbol, pivot_at""",
    "price",
)
def _(spark, d):
    """Polyline points on existing candles, last confirmation wins per time."""
    from ..operators.bars import keep_last

    z = zigzag_events(spark, d).filter("timeframe = '1h'").select("symbol", "pivot_at", "confirmation_at", "price", "kind")
    on = bars_1h(spark, d).select("symbol", F.col("known_at").alias("pivot_at"))
    return keep_last(z.join(on, ["symbol", "pivot_at"], "left_semi"), ["symbol", "pivot_at"], ["confirmation_at"]).drop("confirmation_at")
