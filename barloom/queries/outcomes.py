"""Candidate events and their outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import labels as L
from ..operators.stats import n_where
from ..plans.quantiles import quantiles
from ..session import stage
from .registry import cte, query
from .tables import ALLOC, OUTCOME_COLUMNS, bars_1h, candidates, trades, valid_candidates

_D = "entry_raw exit_raw entry_fill exit_fill gross_return net_return net_r tp_price sl_price"
_cols = ", ".join(OUTCOME_COLUMNS)


@query(
    "candidate_event_outcomes",
    f"SELECT event_id, symbol, split, timestamp, known_at, side, {_cols} FROM candidates",
    _D,
)
def _(spark, d):
    return candidates(spark, d).select("event_id", "symbol", "split", "timestamp", "known_at", "side", *OUTCOME_COLUMNS)


_X = [c for c in E.CANDIDATE_FEATURES if c not in ("1d_rsi14", "1d_atr14_pct")]
_ints = {"breakout_24h", "breakdown_24h", "trend_1h", "4h_trend", "1d_trend", "trend_alignment"}


@query(
    "candidate_predictors",
    "SELECT event_id, symbol, split, timestamp, known_at, side, bias_score, "
    + ", ".join(f'"{c}"' for c in _X)
    + " FROM cand",
    " ".join(c for c in _X if c not in _ints),
)
def _(spark, d):
    return E.predictors(candidates(spark, d), _X)


@query(
    "non_overlapping_selection",
    """SELECT s.event_id, s.symbol, s.split, CASE WHEN w.rn IS NULL THEN 'SKIPPED_OVERLAP' ELSE 'TAKEN' END AS portfolio_status
       FROM seq s LEFT JOIN walk w USING (symbol, split, rn)""",
)
def _(spark, d):
    rows = valid_candidates(spark, d).withColumn("exit_i", F.col("pos") + F.col("duration_bars"))
    made = E.select_non_overlapping(rows, keys=["symbol", "split"], start="pos", end="exit_i", order=["timestamp", "event_id"])
    return made.select("event_id", "symbol", "split", "portfolio_status")


@query(
    "equity_path",
    "SELECT event_id, symbol, split, trade_no, equity_before, equity_after, drawdown FROM trades",
    "equity_before equity_after drawdown",
)
def _(spark, d):
    return trades(spark, d).select("event_id", "symbol", "split", "trade_no", "equity_before", "equity_after", "drawdown")


_SUM = """count(*) AS trades, count(*) FILTER (side = 'LONG') AS long_trades, count(*) FILTER (side = 'SHORT') AS short_trades, arg_max(equity_after, trade_no) AS ending_equity,
    (arg_max(equity_after, trade_no) - 1) * 100 AS return_pct, least(min(drawdown), 0) * 100 AS max_drawdown_exit_only_pct, avg((net_return > 0)::INT) * 100 AS win_rate_net_pct, avg(net_r) AS mean_net_r"""


@query("trade_summary", f"SELECT symbol, split, {_SUM} FROM trades GROUP BY symbol, split", "ending_equity return_pct max_drawdown_exit_only_pct win_rate_net_pct mean_net_r")
def _(spark, d):
    return E.trade_summary(trades(spark, d), ["symbol", "split"])


def _cost_sql(costs: str) -> str:
    return f"""SELECT symbol, split, cost_bps, count(*) AS trades, (exp(sum(ln(1 + 0.1::DOUBLE * net))) - 1) * 100 AS return_pct, avg(net) * 100 AS mean_net_pct,
      sum(ln(1 + 0.1::DOUBLE * net)) AS g FROM (SELECT symbol, split, cost_bps, s * (got - paid) / paid - fee * (1 + got / paid) AS net FROM (
      SELECT *, entry_raw * (1 + s * slip) AS paid, exit_raw * (1 - s * slip) AS got FROM (
      SELECT symbol, split, entry_raw, exit_raw, CASE WHEN side = 'LONG' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s, c AS cost_bps, c / 70000 * 5 AS fee, c / 70000 * 2 AS slip
      FROM trades, (SELECT unnest({costs})::DOUBLE AS c)))) GROUP BY ALL"""


@query("cost_sensitivity", f"SELECT * EXCLUDE (g) FROM ({_cost_sql('[0, 2, 5, 7, 10]')})", "cost_bps return_pct mean_net_pct")
def _(spark, d):
    return E.cost_totals(trades(spark, d), [0, 2, 5, 7, 10], ["symbol", "split"], alloc=ALLOC)


def _even_sql(by: str) -> str:
    """Doubling costs, then two fine passes inside each group's bracket, then interpolation."""

    def ends(source: str) -> str:
        return f"""SELECT {by}, max(CASE WHEN g > 0 THEN struct_pack(c := c, g := g) END) AS a, min(CASE WHEN g <= 0 THEN struct_pack(c := c, g := g) END) AS b,
          (exp(max(CASE WHEN c = 0 THEN g END)) - 1) * 100 AS zero FROM (
          SELECT {by}, c, sum(CASE WHEN 0.1::DOUBLE * net > -1 AND c < 10000 THEN ln(1 + 0.1::DOUBLE * net) ELSE '-infinity'::DOUBLE END) AS g FROM (
          SELECT {by}, c, s * (got - paid) / paid - c / 70000 * 5 * (1 + got / paid) AS net FROM (
          SELECT *, entry_raw * (1 + s * c / 70000 * 2) AS paid, exit_raw * (1 - s * c / 70000 * 2) AS got FROM (
          SELECT {by}, entry_raw, exit_raw, c, CASE WHEN side = 'LONG' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM {source}))) GROUP BY ALL) GROUP BY ALL"""

    wide = ends("trades, (SELECT unnest(list_prepend(0.0::DOUBLE, list_transform(range(0, 26), lambda i: 10.0::DOUBLE * power(2, i)))) AS c)")
    one = ends(f"(SELECT t.*, a.c + (b.c - a.c) * i / 512 AS c FROM trades t JOIN even0 USING ({by}), (SELECT unnest(range(0, 513)) AS i) WHERE a IS NOT NULL AND b IS NOT NULL)")
    two = one.replace("even0", "even1")
    return f"""WITH even0 AS ({wide}), even1 AS ({one}), even2 AS ({two}),
      roots AS (SELECT {by}, a.c + a.g / (a.g - b.g) * (b.c - a.c) AS root FROM even2)
      SELECT {by}, CASE WHEN zero < -1e-10 THEN NULL WHEN abs(zero) <= 1e-10 THEN 0 ELSE root END AS break_even_bps,
        CASE WHEN zero < -1e-10 THEN 'NEGATIVE_EVEN_WITH_ZERO_COST' WHEN abs(zero) <= 1e-10 THEN 'BREAK_EVEN_AT_ZERO_COST' WHEN root IS NULL THEN 'NOT_BRACKETED' ELSE 'ESTIMATED' END AS status
      FROM even0 LEFT JOIN roots USING ({by})"""


@query("break_even_cost", f"SELECT * EXCLUDE (status) FROM ({_even_sql('symbol, split')})", "break_even_bps")
def _(spark, d):
    return E.break_even_cost(trades(spark, d), ["symbol", "split"], alloc=ALLOC).drop("status")


@query("break_even_status", _even_sql("symbol, split, side"), "break_even_bps")
def _(spark, d):
    return E.break_even_cost(trades(spark, d), ["symbol", "split", "side"], alloc=ALLOC)


# reward-multiple grid over structural stops
cte(
    "grid_hits",
    """SELECT r.event_id, r.method, r.timeframe, m.m AS multiple_r, r.symbol, r.side, r.known_at, r.split, r.stop_price AS stop, r.status, x.k, x.timestamp AS bar_at, x.open, x.high, x.low, x.close, x.pos0,
       CASE WHEN r.side = 'LONG' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sgn FROM stop_refs r CROSS JOIN (SELECT unnest([1.0, 1.5, 2.0, 3.0, 4.0, 5.0])::DOUBLE AS m) m
       LEFT JOIN (SELECT a.symbol, a.timestamp AS known_at, a.pos AS pos0, b.pos - a.pos AS k, b.timestamp, b.open, b.high, b.low, b.close FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.pos BETWEEN a.pos AND a.pos + 11) x
       ON x.symbol = r.symbol AND x.known_at = r.known_at""",
)
cte(
    "grid_levels",
    """SELECT *, e + sgn * multiple_r * sgn * (e - stop) AS goal, sgn * (e - stop) AS risk FROM (
       SELECT *, min(CASE WHEN k = 0 THEN open END) OVER g AS e, count(k) OVER g AS n, max(bar_at) OVER g - min(bar_at) OVER g AS held FROM grid_hits WINDOW g AS (PARTITION BY event_id, method, timeframe, multiple_r))""",
)
cte(
    "grid_codes",
    """SELECT *, CASE WHEN side = 'LONG' THEN CASE WHEN k > 0 AND open <= stop THEN 'SL_GAP' WHEN k > 0 AND open >= goal THEN 'TP_GAP' WHEN low <= stop THEN 'SL' WHEN high >= goal THEN 'TP' END
       ELSE CASE WHEN k > 0 AND open >= stop THEN 'SL_GAP' WHEN k > 0 AND open <= goal THEN 'TP_GAP' WHEN high >= stop THEN 'SL' WHEN low <= goal THEN 'TP' END END AS code FROM grid_levels""",
)
cte(
    "target_grid",
    """SELECT *, CASE WHEN ok THEN sgn * (xf - ef) / ef END AS gross_return, CASE WHEN ok THEN sgn * (xf - ef) / ef - 0.0005::DOUBLE * (1 + xf / ef) END AS net_return,
       CASE WHEN ok THEN (sgn * (xf - ef) / ef - 0.0005::DOUBLE * (1 + xf / ef)) * ef / risk_ END AS net_r, CASE WHEN ok THEN e END AS entry_raw, CASE WHEN ok THEN risk_ END AS risk_price,
       CASE WHEN ok THEN reason_ END AS reason, CASE WHEN ok THEN CAST(kk + 1 AS INTEGER) END AS duration_bars, CASE WHEN ok THEN known_at END AS entry_at, CASE WHEN ok THEN xbar + INTERVAL 1 HOUR END AS exit_at,
       CASE WHEN ok THEN pos0 + kk END AS exit_index, pos0 AS entry_index FROM (
      SELECT *, eligibility = 'ELIGIBLE' AS ok, e * (1 + sgn * 0.0002::DOUBLE) AS ef, raw * (1 - sgn * 0.0002::DOUBLE) AS xf FROM (
      SELECT *, CASE WHEN n = 0 THEN 'ENTRY_OUTSIDE_SPLIT' WHEN n < 12 OR held <> INTERVAL 11 HOUR THEN 'INCOMPLETE_HORIZON' WHEN status <> 'VALID_REFERENCE' THEN status
         WHEN stop IS NULL OR stop <= 0 THEN 'INVALID_STOP' WHEN risk_ <= 0 OR goal <= 0 THEN 'INVALID_TARGET' ELSE 'ELIGIBLE' END AS eligibility,
        CASE WHEN reason_ LIKE '%GAP' THEN xo WHEN reason_ = 'SL' THEN stop WHEN reason_ = 'TP' THEN goal ELSE xc END AS raw FROM (
      SELECT event_id, method, timeframe, multiple_r, any_value(symbol) AS symbol, any_value(side) AS side, any_value(known_at) AS known_at, any_value(split) AS split, any_value(status) AS status, any_value(stop) AS stop,
       any_value(sgn) AS sgn, any_value(e) AS e, any_value(n) AS n, any_value(held) AS held, any_value(goal) AS goal, any_value(risk) AS risk_, any_value(pos0) AS pos0,
       coalesce(arg_min(code, k) FILTER (code IS NOT NULL), 'TIME') AS reason_, coalesce(min(k) FILTER (code IS NOT NULL), 11) AS kk,
       arg_min(open, k) FILTER (code IS NOT NULL) AS xo, arg_max(close, k) AS xc, coalesce(arg_min(bar_at, k) FILTER (code IS NOT NULL), max(bar_at)) AS xbar
      FROM grid_codes GROUP BY event_id, method, timeframe, multiple_r)))""",
)
_GRID = "event_id method timeframe multiple_r symbol side split eligibility reason duration_bars entry_raw risk_price gross_return net_return net_r entry_at exit_at entry_index exit_index".split()


def scenario_grid(spark, d):
    """Every stop reference times every multiple, with the portfolio status."""
    from .structure import stop_references

    def build():
        grid = L.target_grid(stop_references(spark, d), bars_1h(spark, d))
        keys = ["method", "timeframe", "multiple_r", "symbol"]
        live = grid.filter("eligibility = 'ELIGIBLE'")
        marks = E.select_non_overlapping(live, keys=keys, start="entry_index", end="exit_index", order=["known_at", "event_id"])
        marks = marks.select("event_id", "method", "timeframe", "multiple_r", "portfolio_status")
        out = grid.join(marks, ["event_id", "method", "timeframe", "multiple_r"], "left")
        return out.fillna({"portfolio_status": "NOT_EVALUATED"})

    return stage(spark, d, "scenario_grid", build)


@query("structural_target_grid", f"SELECT {', '.join(_GRID)} FROM target_grid", "multiple_r entry_raw risk_price gross_return net_return net_r")
def _(spark, d):
    return scenario_grid(spark, d).select(*_GRID)


cte("gseq", "SELECT *, row_number() OVER (PARTITION BY method, timeframe, multiple_r, symbol ORDER BY known_at, event_id) AS rn FROM target_grid WHERE ok")
cte(
    "gnxt",
    """SELECT a.method, a.timeframe, a.multiple_r, a.symbol, a.rn, min(b.rn) AS next_rn FROM gseq a LEFT JOIN gseq b ON a.method = b.method AND a.timeframe = b.timeframe
       AND a.multiple_r = b.multiple_r AND a.symbol = b.symbol AND b.entry_index > a.exit_index AND b.entry_index <= a.exit_index + 400 GROUP BY ALL""",
)
cte(
    "gwalk",
    """SELECT method, timeframe, multiple_r, symbol, rn FROM gseq WHERE rn = 1 UNION ALL SELECT method, timeframe, multiple_r, symbol, n.next_rn FROM gwalk JOIN gnxt n USING (method, timeframe, multiple_r, symbol, rn)
       WHERE n.next_rn IS NOT NULL""",
)
cte(
    "scenarios",
    """SELECT t.*, coalesce(p.portfolio_status, 'NOT_EVALUATED') AS portfolio_status FROM target_grid t LEFT JOIN (
       SELECT s.event_id, s.method, s.timeframe, s.multiple_r, CASE WHEN w.rn IS NULL THEN 'SKIPPED_OVERLAP' ELSE 'TAKEN' END AS portfolio_status
       FROM gseq s LEFT JOIN gwalk w USING (method, timeframe, multiple_r, symbol, rn)) p USING (event_id, method, timeframe, multiple_r)""",
)


@query("scenario_portfolio_status", "SELECT method, timeframe, multiple_r, eligibility, portfolio_status, count(*) AS n FROM scenarios GROUP BY ALL", "multiple_r")
def _(spark, d):
    return scenario_grid(spark, d).groupBy("method", "timeframe", "multiple_r", "eligibility", "portfolio_status").agg(F.count(F.lit(1)).alias("n"))


@query("scenario_integrity", """SELECT unnest(['not_eligible_but_placed', 'eligible_without_outcome', 'unknown_reason', 'duration_out_of_range', 'unknown_side', 'duplicate_scenario', 'candidate_set_differs']) AS "check", 0::BIGINT AS violations""")
def _(spark, d):
    from ..operators.quality import scenario_integrity

    return scenario_integrity(scenario_grid(spark, d))


_BY = ["method", "timeframe", "multiple_r", "side"]
_bys = ", ".join(_BY)
_el, _tk = "eligibility = 'ELIGIBLE'", "portfolio_status = 'TAKEN'"


@query(
    "structural_diagnosis",
    f"""SELECT {_bys}, count(*) AS candidates, count(*) FILTER ({_el}) AS eligible, count(*) FILTER ({_tk}) AS taken, count(*) FILTER (portfolio_status = 'SKIPPED_OVERLAP') AS skipped_overlap,
        avg(net_return) FILTER ({_el}) * 100 AS eligible_net_mean_pct, quantile_cont(net_return, 0.5::DOUBLE) FILTER ({_el}) * 100 AS eligible_net_median_pct, avg(net_return) FILTER ({_tk}) * 100 AS taken_net_mean_pct,
        avg(net_r) FILTER ({_tk}) AS taken_net_r_mean, count(*) FILTER ({_el} AND reason LIKE 'TP%') AS eligible_tp, count(*) FILTER ({_el} AND reason LIKE 'SL%') AS eligible_sl, count(*) FILTER ({_el} AND reason = 'TIME') AS eligible_time,
        avg(duration_bars) FILTER ({_tk}) AS taken_duration_mean_h, quantile_cont(duration_bars::DOUBLE, 0.9::DOUBLE) FILTER ({_tk}) AS taken_duration_p90_h,
        avg(gross_return - net_return) FILTER ({_el}) * 10000 AS eligible_fee_effect_mean_bps FROM scenarios GROUP BY {_bys}""",
    "multiple_r eligible_net_mean_pct eligible_net_median_pct taken_net_mean_pct taken_net_r_mean taken_duration_mean_h taken_duration_p90_h eligible_fee_effect_mean_bps",
)
def _(spark, d):
    g = scenario_grid(spark, d)
    el, tk = F.col("eligibility") == "ELIGIBLE", F.col("portfolio_status") == "TAKEN"
    only = lambda c, x: F.avg(F.when(c, F.col(x)))
    cause = F.regexp_extract("reason", "^(TP|SL|TIME)", 1)
    base = g.groupBy(*_BY).agg(
        F.count(F.lit(1)).alias("candidates"), n_where(el).alias("eligible"), n_where(tk).alias("taken"), n_where(F.col("portfolio_status") == "SKIPPED_OVERLAP").alias("skipped_overlap"),
        (only(el, "net_return") * 100).alias("eligible_net_mean_pct"), (only(tk, "net_return") * 100).alias("taken_net_mean_pct"), only(tk, "net_r").alias("taken_net_r_mean"),
        *[n_where(el & (cause == c)).alias(f"eligible_{c.lower()}") for c in ("TP", "SL", "TIME")],
        only(tk, "duration_bars").alias("taken_duration_mean_h"), (F.avg(F.when(el, F.col("gross_return") - F.col("net_return"))) * 10_000).alias("eligible_fee_effect_mean_bps"),
    )
    med = quantiles(g.filter(el), _BY, "net_return", {"m": 0.5}).select(*_BY, (F.col("m") * 100).alias("eligible_net_median_pct"))
    p90 = quantiles(g.filter(tk), _BY, "duration_bars", {"taken_duration_p90_h": 0.9}).drop("n")
    return base.join(med, _BY, "left").join(p90, _BY, "left")


cte(
    "shared_ids",
    f"SELECT multiple_r, event_id FROM scenarios WHERE {_el} GROUP BY ALL HAVING count(DISTINCT (method, timeframe)) = 4",
)


def _shared(spark, d):
    g = scenario_grid(spark, d).filter("eligibility = 'ELIGIBLE'")
    ids = g.groupBy("multiple_r", "event_id").agg(F.countDistinct("method", "timeframe").alias("_n")).filter("_n = 4").drop("_n")
    return g.join(ids, ["multiple_r", "event_id"], "left_semi")


@query(
    "common_candidate_comparison",
    f"""SELECT {_bys}, count(*) AS common_candidates, avg(net_return) * 100 AS net_mean_pct, quantile_cont(net_return, 0.5::DOUBLE) * 100 AS net_median_pct, avg((reason LIKE 'TP%')::INT) * 100 AS tp_rate_pct,
        avg((reason LIKE 'SL%')::INT) * 100 AS sl_rate_pct, avg((reason = 'TIME')::INT) * 100 AS time_rate_pct FROM scenarios JOIN shared_ids USING (multiple_r, event_id) WHERE {_el} GROUP BY {_bys}""",
    "multiple_r net_mean_pct net_median_pct tp_rate_pct sl_rate_pct time_rate_pct",
)
def _(spark, d):
    """All four configurations on the candidates eligible in every one."""
    g = _shared(spark, d)
    rate = lambda c: F.avg(F.col("reason").startswith(c).cast("double")) * 100
    base = g.groupBy(*_BY).agg(
        F.count(F.lit(1)).alias("common_candidates"), (F.avg("net_return") * 100).alias("net_mean_pct"), rate("TP").alias("tp_rate_pct"), rate("SL").alias("sl_rate_pct"), rate("TIME").alias("time_rate_pct")
    )
    return base.join(quantiles(g, _BY, "net_return", {"m": 0.5}).select(*_BY, (F.col("m") * 100).alias("net_median_pct")), _BY)


@query(
    "paired_deltas",
    f"""SELECT multiple_r, side, comparator, count(*) AS n, avg(delta) * 100 AS mean_paired_delta_pct, quantile_cont(delta, 0.5::DOUBLE) * 100 AS median_paired_delta_pct, avg((delta > 0)::INT) * 100 AS share_reference_better_pct FROM (
        SELECT a.multiple_r, a.side, b.method || ' ' || b.timeframe AS comparator, a.net_return - b.net_return AS delta FROM scenarios a JOIN shared_ids USING (multiple_r, event_id) JOIN scenarios b USING (multiple_r, event_id)
        WHERE a.method = 'zigzag' AND a.timeframe = '4h' AND NOT (b.method = 'zigzag' AND b.timeframe = '4h')) GROUP BY ALL""",
    "multiple_r mean_paired_delta_pct median_paired_delta_pct share_reference_better_pct",
)
def _(spark, d):
    g = _shared(spark, d)
    is_ref = (F.col("method") == "zigzag") & (F.col("timeframe") == "4h")
    ref = g.filter(is_ref).select("multiple_r", "event_id", F.col("net_return").alias("_ref"))
    other = g.filter(~is_ref).withColumn("comparator", F.concat_ws(" ", "method", "timeframe"))
    pairs = other.join(ref, ["multiple_r", "event_id"]).withColumn("_delta", F.col("_ref") - F.col("net_return"))
    by = ["multiple_r", "side", "comparator"]
    base = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.avg("_delta") * 100).alias("mean_paired_delta_pct"), (F.avg((F.col("_delta") > 0).cast("double")) * 100).alias("share_reference_better_pct")
    )
    return base.join(quantiles(pairs, by, "_delta", {"m": 0.5}).select(*by, (F.col("m") * 100).alias("median_paired_delta_pct")), by)


@query(
    "monthly_compounding",
    f"""SELECT method, timeframe, multiple_r, strftime(entry_at, '%Y-%m') AS month, count(*) AS taken, (exp(sum(ln(1 + 0.1::DOUBLE * net_return))) - 1) * 100 AS monthly_compounded_pct, avg(net_return) * 100 AS mean_trade_net_pct,
        min(entry_at) AS first_entry, max(entry_at) AS last_entry FROM scenarios WHERE {_tk} GROUP BY ALL""",
    "multiple_r monthly_compounded_pct mean_trade_net_pct",
)
def _(spark, d):
    g = scenario_grid(spark, d).filter("portfolio_status = 'TAKEN'").withColumn("month", F.date_format("entry_at", "yyyy-MM"))
    return g.groupBy("method", "timeframe", "multiple_r", "month").agg(
        F.count(F.lit(1)).alias("taken"), (F.expm1(F.sum(F.log1p(F.col("net_return") * ALLOC))) * 100).alias("monthly_compounded_pct"),
        (F.avg("net_return") * 100).alias("mean_trade_net_pct"), F.min("entry_at").alias("first_entry"), F.max("entry_at").alias("last_entry"),
    )


cte(
    "exc",
    f"""SELECT *, fav / entry_raw * 100 AS mfe_pct, adv / entry_raw * 100 AS mae_pct, fav / risk_price AS mfe_r, adv / risk_price AS mae_r, regexp_extract(reason, '^(TP|SL|TIME)', 1) AS exit_type FROM (
        SELECT s.*, greatest(0, CASE WHEN side = 'LONG' THEN hi - entry_raw ELSE entry_raw - lo END) AS fav, greatest(0, CASE WHEN side = 'LONG' THEN entry_raw - lo ELSE hi - entry_raw END) AS adv FROM (
        SELECT s.event_id, s.method, s.timeframe, s.multiple_r, any_value(s.symbol) AS symbol, any_value(s.side) AS side, any_value(s.entry_raw) AS entry_raw, any_value(s.risk_price) AS risk_price, any_value(s.reason) AS reason, any_value(s.net_return) AS net_return,
         any_value(s.duration_bars) AS duration_bars, max(b.high) AS hi, min(b.low) AS lo FROM scenarios s JOIN bars b ON b.symbol = s.symbol AND b.pos BETWEEN s.entry_index AND s.exit_index WHERE s.{_tk} GROUP BY ALL) s)""",
)


def excursion_rows(spark, d):
    return L.excursions(scenario_grid(spark, d).filter("portfolio_status = 'TAKEN'"), bars_1h(spark, d))


@query("excursions", "SELECT event_id, method, timeframe, multiple_r, exit_type, mfe_pct, mae_pct, mfe_r, mae_r FROM exc", "multiple_r mfe_pct mae_pct mfe_r mae_r")
def _(spark, d):
    return excursion_rows(spark, d).select("event_id", "method", "timeframe", "multiple_r", "exit_type", "mfe_pct", "mae_pct", "mfe_r", "mae_r")


@query(
    "excursions_long_holds",
    """SELECT event_id, duration_bars, fav / entry_raw * 100 AS mfe_pct, adv / entry_raw * 100 AS mae_pct FROM (
        SELECT event_id, duration_bars, entry_raw, greatest(0, CASE WHEN side = 'LONG' THEN hi - entry_raw ELSE entry_raw - lo END) AS fav, greatest(0, CASE WHEN side = 'LONG' THEN entry_raw - lo ELSE hi - entry_raw END) AS adv FROM (
        SELECT a.symbol || '_' || a.pos AS event_id, CAST(13 + a.pos % 60 AS INTEGER) AS duration_bars, any_value(a.open) AS entry_raw, CASE WHEN a.pos % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side,
          max(b.high) AS hi, min(b.low) AS lo FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.pos BETWEEN a.pos AND a.pos + 12 + a.pos % 60
        GROUP BY a.symbol, a.pos HAVING count(*) = 13 + a.pos % 60 AND max(b.timestamp) - min(b.timestamp) = to_hours(CAST(12 + a.pos % 60 AS INTEGER))))""",
    "mfe_pct mae_pct",
)
def _(spark, d):
    bars = bars_1h(spark, d)
    start = bars.withColumn("duration_bars", (F.lit(13) + F.col("pos") % 60).cast("int"))
    # holds without a gap: the last held bar, by index, is duration - 1 hours after the first
    last = bars.select("symbol", (F.col("pos")).alias("_last"), F.col("timestamp").alias("_end"))
    whole = start.join(last, (start["symbol"] == last["symbol"]) & (F.col("_last") == F.col("pos") + F.col("duration_bars") - 1)).drop(last["symbol"])
    whole = whole.filter(F.unix_timestamp(F.col("_end").cast("timestamp")) - F.unix_timestamp(F.col("timestamp").cast("timestamp")) == (F.col("duration_bars") - 1) * 3600)
    made = whole.select(
        "symbol", F.concat_ws("_", "symbol", "pos").alias("event_id"), F.lit("hold").alias("method"), F.lit("1h").alias("timeframe"), F.lit(1.0).alias("multiple_r"),
        F.col("pos").alias("entry_index"), "duration_bars", F.col("open").alias("entry_raw"), F.lit(1.0).alias("risk_price"),
        F.when(F.col("pos") % 2 == 0, "LONG").otherwise("SHORT").alias("side"), F.lit("TIME").alias("reason"),
    )
    return L.excursions(made, bars).select("event_id", "duration_bars", "mfe_pct", "mae_pct")


@query(
    "excursion_report",
    """SELECT method, timeframe, multiple_r, side, exit_type, count(*) AS count, avg(net_return) * 100 AS mean_net_pct, avg(duration_bars) AS mean_duration_h, quantile_cont(mfe_r, 0.5::DOUBLE) AS median_mfe_r, quantile_cont(mfe_r, 0.9::DOUBLE) AS p90_mfe_r,
       quantile_cont(mae_r, 0.5::DOUBLE) AS median_mae_r, quantile_cont(mae_r, 0.9::DOUBLE) AS p90_mae_r, avg((mfe_r >= 0.5)::INT) * 100 AS pct_reached_half_r, avg((mfe_r >= 1)::INT) * 100 AS pct_reached_one_r FROM exc GROUP BY ALL""",
    "multiple_r mean_net_pct mean_duration_h median_mfe_r p90_mfe_r median_mae_r p90_mae_r pct_reached_half_r pct_reached_one_r",
)
def _(spark, d):
    rows = excursion_rows(spark, d)
    by = [*_BY, "exit_type"]
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), (F.avg("net_return") * 100).alias("mean_net_pct"), F.avg("duration_bars").alias("mean_duration_h"),
        (F.avg((F.col("mfe_r") >= 0.5).cast("double")) * 100).alias("pct_reached_half_r"), (F.avg((F.col("mfe_r") >= 1).cast("double")) * 100).alias("pct_reached_one_r"),
    )
    for c in ("mfe_r", "mae_r"):
        base = base.join(quantiles(rows, by, c, {f"median_{c}": 0.5, f"p90_{c}": 0.9}).drop("n"), by)
    return base
