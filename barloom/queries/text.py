"""Prompts, chat records, model outputs, normalised observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as V
from ..functions import text as X
from ..operators import screens as S
from ..operators import indicators as I
from ..operators import structure as ST
from ..operators.labels import bracket_outcome, forward_path
from ..operators.stats import n_where
from ..plans.blocks import BlockFrame
from ..plans.quantiles import quantiles
from ..session import scratch, stage
from ..sources import candles as C
from .registry import cte, query
from .structure import FRAMES
from .tables import HOUR, bars_1h, candidates, features, labeled, predictions, splits, table, trades, valid_candidates

_q = lambda s: "'" + s.replace("'", "''") + "'"
_tn = lambda c: f"CASE WHEN {c} IS NULL THEN 'INCONNU' WHEN {c} > 0 THEN 'HAUSSIER' WHEN {c} < 0 THEN 'BAISSIER' ELSE 'NEUTRE' END"


def _num_sql(x: str, n: int) -> str:
    return f"coalesce(regexp_replace(regexp_replace(CAST(CAST(round({x}, {n}) AS DECIMAL(30, {n})) AS VARCHAR), '0+$', ''), '\\.$', '.0'), 'None')"


def _shown_sql(col: str, kind: str, n: int) -> str:
    c = f'"{col}"'
    if kind == "trend":
        return _tn(c)
    if kind == "flag":
        return f"CASE WHEN coalesce({c}, 0) = 1 THEN 'OUI' ELSE 'NON' END"
    return _num_sql(f"{c} * 100" if kind == "pct" else c, n)


_sections = " || chr(10) || chr(10) || ".join(
    f"{_q(title)} || chr(10) || " + " || chr(10) || ".join(f"{_q(cap + ': ')} || {_shown_sql(col, kind, n)} || {_q(sfx)}" for cap, col, kind, n, sfx in lines)
    for title, lines in X.PROMPT
)
PROMPT_SQL = f"symbol || ' | 1H' || chr(10) || chr(10) || {_sections} || chr(10) || chr(10) || {_q(X.TASK)}"
_s = {k: _q(v) for k, v in X.SENTENCES.items()}
_t1, _t4, _td = (_tn(f'"{c}"') for c in ("trend_1h", "4h_trend", "1d_trend"))
COMMENTS_SQL = f"""list_filter([CASE WHEN {_t1} = {_t4} AND {_t4} = {_td} THEN 'Les tendances 1H, 4H et 1D sont alignées ' || lower({_t1}) || '.'
    ELSE 'Le contexte multi-timeframe est mixte : 1H=' || {_t1} || ', 4H=' || {_t4} || ', 1D=' || {_td} || '.' END,
    CASE WHEN rsi14 >= 70 THEN {_s['rsi_high']} WHEN rsi14 <= 30 THEN {_s['rsi_low']} WHEN rsi14 >= 55 THEN {_s['rsi_up']} WHEN rsi14 <= 45 THEN {_s['rsi_down']} ELSE {_s['rsi_flat']} END,
    CASE WHEN volume_ratio >= 1.5 THEN {_s['vol_high']} WHEN volume_ratio <= 0.7 THEN {_s['vol_low']} ELSE {_s['vol_mid']} END,
    CASE WHEN breakout_24h = 1 THEN {_s['breakout']} WHEN breakdown_24h = 1 THEN {_s['breakdown']} END,
    CASE WHEN atr14_pct >= 1.5 THEN {_s['atr_high']} WHEN atr14_pct <= 0.5 THEN {_s['atr_low']} END], lambda x: x IS NOT NULL)"""
cte("ctx", f"SELECT symbol, timestamp, split, bias_score, {COMMENTS_SQL} AS comments, {PROMPT_SQL} AS prompt FROM splits")


@query("context_comments", "SELECT symbol, timestamp, array_to_string(comments, chr(10)) AS context, len(comments) AS n FROM ctx", n="n")
def _(spark, d):
    c = X.context_comments()
    return splits(spark, d).select("symbol", "timestamp", F.array_join(c, "\n").alias("context"), F.size(c).cast("bigint").alias("n"))


@query("user_prompts", "SELECT symbol, timestamp, prompt FROM ctx")
def _(spark, d):
    return splits(spark, d).select("symbol", "timestamp", X.user_prompt(F.col("symbol")).alias("prompt"))


def _answer_sql() -> str:
    pick = lambda i: " ".join(f"WHEN '{k}' THEN {_q(v[i])}" for k, v in X.ANSWERS.items())
    return f"""'BIAS' || chr(10) || CASE WHEN bias_score >= 2 THEN 'HAUSSIER' WHEN bias_score <= -2 THEN 'BAISSIER' ELSE 'NEUTRE' END || chr(10) || chr(10) ||
      'CONTEXT' || chr(10) || array_to_string(list_transform(comments, lambda c: '- ' || c), chr(10)) || chr(10) || chr(10) ||
      'DECISION' || chr(10) || CASE target {pick(0)} END || chr(10) || chr(10) || 'RISK' || chr(10) || CASE target {pick(1)} END"""


cte(
    "chat",
    f"""SELECT symbol, timestamp, target AS decision, prompt, {_answer_sql()} AS answer FROM (SELECT c.*, p.target FROM ctx c JOIN predictions p USING (symbol, timestamp) WHERE p.target IS NOT NULL)""",
)


def chat(spark, d):
    """Training records: rows with an unambiguous target, three turns each."""

    def build():
        p = predictions(spark, d).filter("target is not null").select("symbol", "timestamp", F.col("target").alias("decision"))
        rows = splits(spark, d).join(p, ["symbol", "timestamp"])
        answer = X.assistant_answer(F.col("bias_score"), F.col("decision"))
        messages = X.chat_record(F.lit(X.SYSTEM_PROMPT), X.user_prompt(F.col("symbol")), answer)
        return rows.select("symbol", "timestamp", "decision", messages.alias("messages"))

    return stage(spark, d, "chat", build)


@query(
    "training_chat_records",
    f"""SELECT symbol, timestamp, decision, CAST(to_json([{{'role': 'system', 'content': {_q(X.SYSTEM_PROMPT)}}}, {{'role': 'user', 'content': prompt}}, {{'role': 'assistant', 'content': answer}}]) AS VARCHAR) AS messages FROM chat""",
)
def _(spark, d):
    return chat(spark, d).withColumn("messages", F.to_json("messages"))


@query(
    "prompts_without_answer",
    f"""SELECT symbol, timestamp, 2 AS turns, prompt AS user, CASE WHEN contains(prompt, {_q(X.MARKER)}) THEN regexp_replace(split_part(prompt, {_q(X.MARKER)}, 1), '\\s+$', '') ELSE prompt END || {_q(X.DECISION_TASK)} AS decision_prompt,
        CASE WHEN contains(prompt, {_q(X.MARKER)}) THEN regexp_replace(split_part(prompt, {_q(X.MARKER)}, 1), '\\s+$', '') ELSE prompt END || {_q(X.LABEL_TASK)} AS label_prompt FROM chat""",
)
def _(spark, d):
    """Answer turn dropped; prompt cut at the marker with another instruction."""
    user = X.first_content(F.col("messages"), "user")
    return chat(spark, d).select(
        "symbol", "timestamp", F.size(X.without_answer(F.col("messages"))).alias("turns"), user.alias("user"),
        X.rewritten_prompt(user).alias("decision_prompt"), X.rewritten_prompt(user, X.LABEL_TASK).alias("label_prompt"),
    )


@query(
    "conversation_roundtrip",
    """SELECT count(*) AS records, CAST(sum(n) AS BIGINT) AS turns, CAST(sum(answers) AS BIGINT) AS answers, CAST(sum(chars) AS BIGINT) AS chars, md5(min(h)) AS lowest FROM (
       SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS answers, sum(length(text)) AS chars, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id)""",
)
def _(spark, d):
    """Conversations as chat JSON lines, written and scanned back."""
    path = scratch(spark, "chat")
    C.write_chat(X.conversations_to_chat(table(spark, d, "conversations")), path)
    m = F.col("messages")
    rows = C.read_chat(spark, path).select(
        F.size(m).cast("long").alias("n"), F.size(F.filter(m, lambda x: x["role"] == "assistant")).cast("long").alias("answers"),
        F.aggregate(m, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x["content"])).alias("chars"),
        F.md5(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")).alias("h"),
    )
    return rows.agg(
        F.count(F.lit(1)).alias("records"), F.sum("n").alias("turns"), F.sum("answers").alias("answers"), F.sum("chars").alias("chars"), F.md5(F.min("h")).alias("lowest")
    )


_LIMITS = [512, 1024, 2048, 4096]
_PS = (50, 75, 90, 95, 97, 99)


@query(
    "conversation_lengths",
    f"""SELECT *, CASE {" ".join(f"WHEN ceil(p99) <= {n} THEN {n}" for n in _LIMITS)} END AS suggested_limit FROM (SELECT role, count(*) AS records, min(x) AS shortest, max(x) AS longest, avg(x) AS mean,
        {", ".join(f"count(*) FILTER (x > {n}) AS over_{n}" for n in _LIMITS)}, {", ".join(f"quantile_cont(x::DOUBLE, {p / 100}::DOUBLE) AS p{p}" for p in _PS)} FROM (
        SELECT conv_id, role, sum(length(text))::BIGINT AS x FROM conversations GROUP BY ALL) GROUP BY role)""",
    "mean " + " ".join(f"p{p}" for p in _PS),
)
def _(spark, d):
    """Characters per conversation and role."""
    c = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.sum(F.length("text").cast("long")).alias("chars"))
    return S.length_stats(c, ["role"], "chars", limits=_LIMITS)


cte(
    "generated",
    """SELECT *, CASE v WHEN 0 THEN 'decision : ' || lower(heuristic_prediction) WHEN 1 THEN 'Je choisis ' || model_prediction || '.' WHEN 2 THEN model_prediction || ' ou bien ' || heuristic_prediction
       WHEN 3 THEN 'DECISION:LONG_BIAS mais pas SHORT_BIAS' ELSE 'aucune idée' END AS generated FROM (SELECT *, (bias_score + 6) % 5 AS v FROM predictions)""",
)


@query(
    "parsed_decisions",
    """SELECT symbol, timestamp, generated, CASE v WHEN 0 THEN heuristic_prediction WHEN 1 THEN model_prediction WHEN 2 THEN CASE WHEN model_prediction = heuristic_prediction THEN model_prediction ELSE 'INVALID' END
       WHEN 3 THEN 'LONG_BIAS' ELSE 'INVALID' END AS decision FROM generated""",
)
def _(spark, d):
    v = F.pmod(F.col("bias_score") + 6, F.lit(5))
    m, h = F.col("model_prediction"), F.col("heuristic_prediction")
    text = (
        F.when(v == 0, F.concat(F.lit("decision : "), F.lower(h))).when(v == 1, F.concat(F.lit("Je choisis "), m, F.lit(".")))
        .when(v == 2, F.concat(m, F.lit(" ou bien "), h)).when(v == 3, "DECISION:LONG_BIAS mais pas SHORT_BIAS").otherwise("aucune idée")
    )
    rows = predictions(spark, d).select("symbol", "timestamp", text.alias("generated"))
    return rows.withColumn("decision", X.parse_decision(F.col("generated")))


# generated actions with known defects, by event
_variants = [
    ("VALID", lambda s, t: f"'{{\"action\": \"OPEN_LONG\", \"sl\": ' || {s} || ', \"tp\": ' || {t} || '}}'"),
    ("VALID", lambda s, t: "'{\"action\": \"WAIT\"}'"),
    ("PARAMETERS", lambda s, t: f"'{{\"action\": \"OPEN_LONG\", \"sl\": ' || {s} || '}}'"),
    ("NUMBER", lambda s, t: f"'{{\"action\": \"OPEN_LONG\", \"sl\": -' || {s} || ', \"tp\": ' || {t} || '}}'"),
    ("NOT_ONE_OBJECT", lambda s, t: f"'{{\"action\": \"MOVE_SL\", \"sl\": ' || {s} || ', \"sl\": ' || {t} || '}}'"),
    ("UNKNOWN_ACTION", lambda s, t: "'{\"action\": \"BUY\"}'"),
    ("NOT_ONE_OBJECT", lambda s, t: "'I would wait {\"action\": \"WAIT\"}'"),
    ("NO_ACTION", lambda s, t: f"'{{\"sl\": ' || {s} || '}}'"),
    ("SIZE", lambda s, t: "'{\"action\": \"' || repeat('WAIT', 600) || '\"}'"),
    ("NUMBER", lambda s, t: f"'{{\"action\": \"MOVE_TP\", \"tp\": \"' || {t} || '\"}}'"),
    ("PARAMETERS", lambda s, t: f"'{{\"action\": \"WAIT\", \"qty\": ' || {t} || '}}'"),
    ("VALID", lambda s, t: f"'{{\"action\": \"OPEN_SHORT\", \"qty\": 0.5, \"sl\": ' || {t} || ', \"tp\": ' || {s} || '}}'"),
]


def _raw_sql() -> str:
    s, t = "CAST(CAST(greatest(close - 0.2 * atr14, 1.0) AS DECIMAL(18, 2)) AS STRING)", "CAST(CAST(close + 2 * atr14 AS DECIMAL(18, 2)) AS STRING)"
    return "CASE v " + " ".join(f"WHEN {i} THEN {make(s, t)}" for i, (_, make) in enumerate(_variants)) + " END"


cte("acts", "SELECT *, (pos + bias_score + 6) % 12 AS v FROM valid_cand")


@query(
    "action_contract_screen",
    f"""SELECT event_id, CASE v {" ".join(f"WHEN {i} THEN '{c}'" for i, (c, _) in enumerate(_variants))} END AS contract, CASE v WHEN 0 THEN 'OPEN_LONG' WHEN 1 THEN 'WAIT' WHEN 11 THEN 'OPEN_SHORT' END AS action FROM acts""",
)
def _(spark, d):
    return actions(spark, d).select("event_id", "contract", "action")


def actions(spark, d):
    def build():
        rows = valid_candidates(spark, d).withColumn("v", F.pmod(F.col("pos") + F.col("bias_score") + 6, F.lit(12)))
        return S.screen_actions(rows.withColumn("raw", F.expr(_raw_sql())).drop("sl", "tp", "qty", "action"), "raw")

    return stage(spark, d, "actions", build)


def proposals(spark, d):
    """Screened actions at a flat account with the bar's own price and turnover."""
    rows = actions(spark, d).filter("contract = 'VALID'")
    none = F.lit(None).cast("double")
    rows = rows.select(
        "event_id", "symbol", "timestamp", "action", "sl", "tp", "qty", F.col("close").alias("price"), F.lit(10_000.0).alias("equity"),
        F.pmod(F.col("pos"), F.lit(20)).cast("double").alias("spread_bps"), (F.col("close") * F.col("volume")).alias("liquidity"),
        (F.pmod(F.col("pos"), F.lit(7)) * 60.0).alias("quote_age_s"), F.lit("FLAT").alias("side"), none.alias("entry_price"), none.alias("pos_sl"), none.alias("pos_tp"),
    )
    return S.screen_orders(rows)


cte(
    "screened",
    """SELECT event_id, symbol, timestamp, action, CASE WHEN age > 300 THEN 'STALE_OR_FUTURE_QUOTE' WHEN spread > 15 THEN 'SPREAD_LIMIT' WHEN action = 'WAIT' THEN 'ACCEPTED' WHEN action = 'OPEN_SHORT' THEN 'SHORT_NOT_SUPPORTED'
       WHEN NOT (sl > 0) THEN 'INVALID_PRICE' WHEN NOT (sl < close AND close < tp) THEN 'INVALID_PROTECTION_GEOMETRY' WHEN (close - sl) / close * 10000 < 5 OR (tp - close) / close * 10000 < 5 THEN 'MIN_DISTANCE'
       WHEN NOT (size > 0) THEN 'NO_EXECUTABLE_SIZE' ELSE 'ACCEPTED_PREVIEW_RECHECK_AT_FILL' END AS code, size FROM (
       SELECT *, floor(least(50 / (close - sl + close * 0.0014::DOUBLE), 10000 / close, close * volume * 0.01::DOUBLE / close) / 0.000001::DOUBLE * (1 - 1e-12::DOUBLE)) * 0.000001::DOUBLE AS size FROM (
       SELECT event_id, symbol, timestamp, close, volume, pos % 20 AS spread, (pos % 7) * 60 AS age, CASE v WHEN 0 THEN 'OPEN_LONG' WHEN 1 THEN 'WAIT' ELSE 'OPEN_SHORT' END AS action,
        CAST(greatest(close - 0.2::DOUBLE * atr14, 1.0::DOUBLE) AS DECIMAL(18, 2))::DOUBLE AS sl, CAST(close + 2 * atr14 AS DECIMAL(18, 2))::DOUBLE AS tp FROM acts WHERE v IN (0, 1, 11)))""",
)


@query(
    "order_screen",
    "SELECT event_id, action, code, code LIKE 'ACCEPTED%' AS accepted, CASE WHEN code = 'ACCEPTED_PREVIEW_RECHECK_AT_FILL' THEN size END AS approved_qty FROM screened",
    "approved_qty",
)
def _(spark, d):
    return proposals(spark, d).select("event_id", "action", "code", "accepted", "approved_qty")


@query(
    "campaign_summary",
    """SELECT symbol, count(*) AS observations, count(*) AS json_valid, count(*) FILTER (code LIKE 'ACCEPTED%') AS risk_accepted, 1.0::DOUBLE AS json_valid_rate, avg(lat) AS latency_mean, max(lat) AS latency_max, quantile_cont(lat, 0.5::DOUBLE) AS latency_median,
       count(*) FILTER (action = 'WAIT') AS waits, count(DISTINCT code) AS codes FROM (SELECT *, length(event_id) + (epoch(timestamp)::BIGINT // 3600 % 10)::DOUBLE AS lat FROM screened) GROUP BY symbol""",
    "json_valid_rate latency_mean latency_max latency_median",
)
def _(spark, d):
    hour = F.floor(F.unix_timestamp(F.col("timestamp").cast("timestamp")) / 3600)
    rows = proposals(spark, d).withColumns({"contract": F.lit("VALID"), "latency_s": F.length("event_id") + F.pmod(hour, F.lit(10)).cast("double")})
    out = S.campaign_summary(rows, ["symbol"])
    waits = F.coalesce(F.element_at("action_counts", "WAIT"), F.lit(0).cast("long"))
    return out.withColumns({"waits": waits, "codes": F.size("code_counts").cast("long")}).drop("action_counts", "code_counts")


@query(
    "paired_prompt_changes",
    "SELECT count(*) AS pairs, count(*) FILTER (model_prediction <> heuristic_prediction) AS changed FROM predictions",
)
def _(spark, d):
    """Two arms per row; how often the decision changes between them."""
    p = predictions(spark, d)
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(f"{a}_prediction").alias("value")) for a in ("model", "heuristic")])
    long = p.withColumn("_a", F.explode(arms)).select("symbol", "timestamp", "_a.*")
    return S.paired_changes(long, pair=["symbol", "timestamp"], arm="arm", value="value", arms=("model", "heuristic"))


# brackets at every decision with trailing volatility
cte(
    "bracket_rows",
    """SELECT t.symbol, t.timestamp, t.known_at, s.spec, b.close, b.pos, b.close - t.trailing_mean_tr * s.s AS sl, b.close + t.trailing_mean_tr * s.g AS tp, t.trailing_mean_tr AS atr FROM trail t JOIN bars b USING (symbol, timestamp),
       (VALUES ('sl1_tp1p5', 1.0::DOUBLE, 1.5::DOUBLE), ('sl1_tp2', 1.0, 2.0), ('sl1p5_tp2', 1.5, 2.0), ('sl2_tp3', 2.0, 3.0)) s(spec, s, g) WHERE t.trailing_mean_tr IS NOT NULL""",
)


def brackets(spark, d):
    ctx = I.trailing_context(bars_1h(spark, d).drop("pos")).filter("trailing_mean_tr is not null")
    return S.bracket_proposals(ctx.select("symbol", "timestamp", "known_at", "close", "trailing_mean_tr"), atr="trailing_mean_tr")


@query("bracket_proposals", "SELECT symbol, timestamp, spec, close, sl, tp FROM bracket_rows", "close sl tp")
def _(spark, d):
    return brackets(spark, d).select("symbol", "timestamp", "spec", "close", "sl", "tp")


cte(
    "bracket_codes",
    """SELECT symbol, timestamp, spec, sl, tp, atr, k, open, close, CASE WHEN k > 1 AND open <= sl THEN 'SL_GAP' WHEN k > 1 AND open >= tp THEN 'TP_GAP' WHEN low <= sl THEN 'SL' WHEN high >= tp THEN 'TP' END AS code,
       min(CASE WHEN k = 1 THEN open END) OVER (PARTITION BY symbol, timestamp, spec) AS e, count(*) OVER (PARTITION BY symbol, timestamp, spec) AS n FROM (
       SELECT k.symbol, k.timestamp, k.spec, k.sl, k.tp, k.atr, b.pos - k.pos AS k, b.open, b.high, b.low, b.close FROM bracket_rows k JOIN bars b ON b.symbol = k.symbol AND b.pos BETWEEN k.pos + 1 AND k.pos + 12)""",
)


@query(
    "bracket_outcome_summary",
    """SELECT spec, count(*) AS attempts, count(*) FILTER (net > 0) AS wins, count(*) FILTER (net < 0) AS losses, count(*) FILTER (reason LIKE 'TP%') AS tp, count(*) FILTER (reason LIKE 'SL%') AS sl, count(*) FILTER (reason = 'TIME') AS time, avg(net) AS mean_net, min(net) AS min_net, max(net) AS max_net FROM (
       SELECT spec, reason, (x * 0.9998::DOUBLE - e * 1.0002::DOUBLE) / (e * 1.0002::DOUBLE) - 0.0005::DOUBLE * (1 + x * 0.9998::DOUBLE / (e * 1.0002::DOUBLE)) AS net FROM (
       SELECT *, CASE WHEN reason LIKE '%GAP' THEN xo WHEN reason = 'SL' THEN sl WHEN reason = 'TP' THEN tp ELSE xc END AS x FROM (
       SELECT symbol, timestamp, spec, any_value(sl) AS sl, any_value(tp) AS tp, any_value(e) AS e, coalesce(arg_min(code, k) FILTER (code IS NOT NULL), 'TIME') AS reason, arg_min(open, k) FILTER (code IS NOT NULL) AS xo, arg_max(close, k) AS xc
       FROM bracket_codes WHERE n = 12 GROUP BY symbol, timestamp, spec))) GROUP BY spec""",
    "mean_net min_net max_net",
)
def _(spark, d):
    """What each bracket did over the next 12 bars, stop first."""
    bars = bars_1h(spark, d)
    bf = BlockFrame(bars, ["symbol"], after=12)
    bf.with_columns({"_path": forward_path(bf, 12, ["timestamp", "open", "high", "low", "close"])})
    ahead = bf.own().filter(F.size("_path") == 12).select("symbol", "timestamp", "_path")
    rows = brackets(spark, d).join(ahead, ["symbol", "timestamp"])
    path = F.col("_path")
    made = bracket_outcome(
        path, F.lit("LONG"), F.get(path, 0)["open"], F.col("tp"), F.col("sl"), horizon=12, fee_bps=5.0, slippage_bps=2.0, risk=F.col("trailing_mean_tr")
    )
    rows = rows.select("spec", made["reason"].alias("reason"), made["net_return"].alias("net"))
    cause = lambda c: n_where(F.col("reason").startswith(c)).alias(c.lower())
    return rows.groupBy("spec").agg(
        F.count(F.lit(1)).alias("attempts"), n_where(F.col("net") > 0).alias("wins"), n_where(F.col("net") < 0).alias("losses"), cause("TP"), cause("SL"), cause("TIME"),
        F.avg("net").alias("mean_net"), F.min("net").alias("min_net"), F.max("net").alias("max_net"),
    )
