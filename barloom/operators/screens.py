"""Screens over model outputs and order proposals, campaign summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.quantiles import quantiles
from ..plans.single import with_values

# Parameters each action must carry.
ACTION_KEYS = {
    "WAIT": [], "HOLD": [], "CLOSE": [], "OPEN_LONG": ["sl", "tp"], "OPEN_SHORT": ["sl", "tp"],
    "MOVE_SL": ["sl"], "MOVE_TP": ["tp"], "MOVE_SL_TP": ["sl", "tp"],
}
OPENS = ["OPEN_LONG", "OPEN_SHORT"]
MAX_BYTES = 2048
POLICY = {
    "max_risk_fraction": 0.005, "max_notional_to_equity": 1.0, "max_spread_bps": 15.0, "max_liquidity_fraction": 0.01,
    "min_stop_distance_bps": 5.0, "min_target_distance_bps": 5.0, "assumed_roundtrip_cost_bps": 14.0, "qty_step": 0.000001,
    "max_quote_age_seconds": 300.0,
}


def screen_actions(df: DataFrame, raw: str) -> DataFrame:
    """Classify generated JSON: one object, known action, exact keys, positive numbers.

    Adds ``action``, ``sl``, ``tp``, ``qty`` and ``contract`` (VALID or the
    first rule broken).  A repeated key makes the text no valid object.
    """
    text = F.trim(F.col(raw))
    rows = df.withColumns(
        {
            "_json": F.try_parse_json(text),
            "_keys": F.json_object_keys(text),
            "_bytes": F.octet_length(text),
        }
    )
    get = lambda k, t: F.try_variant_get("_json", f"$.{k}", t)
    rows = rows.withColumn("_action", get("action", "string"))
    kinds = F.create_map(*[x for k, v in ACTION_KEYS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]).cast("array<string>"))])
    given = F.array_remove("_keys", "action")
    need = F.element_at(kinds, F.col("_action"))
    extra = F.array_except(given, need)
    qty_ok = F.col("_action").isin(*OPENS) & (extra == F.array(F.lit("qty")))
    bad = F.lit(False)
    for k in ("sl", "tp", "qty"):
        kind = F.schema_of_variant(F.try_variant_get("_json", f"$.{k}", "variant"))
        numeric = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        bad = bad | (F.array_contains("_keys", k) & ~F.coalesce(numeric & (get(k, "double") > 0), F.lit(False)))
    contract = (
        F.when(F.col(raw).isNull() | (F.col("_bytes") > MAX_BYTES) | (F.col("_bytes") == 0), "SIZE")
        .when(F.col("_json").isNull() | F.col("_keys").isNull() | (F.size("_keys") != F.size(F.array_distinct("_keys"))), "NOT_ONE_OBJECT")
        .when(~F.array_contains("_keys", "action"), "NO_ACTION")
        .when(need.isNull(), "UNKNOWN_ACTION")
        .when((F.size(F.array_except(need, given)) > 0) | ((F.size(extra) > 0) & ~qty_ok), "PARAMETERS")
        .when(bad, "NUMBER")
        .otherwise("VALID")
    )
    rows = rows.withColumn("contract", contract)
    ok = F.col("contract") == "VALID"
    rows = rows.withColumns({"action": F.when(ok, F.col("_action"))} | {k: F.when(ok, get(k, "double")) for k in ("sl", "tp", "qty")})
    return rows.drop("_json", "_keys", "_bytes", "_action")


def screen_orders(df: DataFrame, policy: Mapping[str, float] = POLICY, *, allow_short: bool = False) -> DataFrame:
    """First rejection code of each proposal, and the approved size.

    Columns: action, sl, tp, qty (nullable), price, equity, spread_bps,
    liquidity, quote_age_s, and the position: side (FLAT/LONG/SHORT),
    entry_price, pos_sl, pos_tp.
    """
    p, a, px = policy, F.col("action"), F.col("price")
    sl, tp = F.col("sl"), F.col("tp")
    flat = F.col("side") == "FLAT"
    long = a == "OPEN_LONG"
    opening = a.isin(*OPENS)
    wants_sl = a.isin("OPEN_LONG", "OPEN_SHORT", "MOVE_SL", "MOVE_SL_TP")
    wants_tp = a.isin("OPEN_LONG", "OPEN_SHORT", "MOVE_TP", "MOVE_SL_TP")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    stop_bps, goal_bps = F.abs(px - sl) / px * 10_000, F.abs(px - tp) / px * 10_000
    unit_risk = F.abs(px - sl) + px * p["assumed_roundtrip_cost_bps"] / 10_000
    most = F.least(
        F.col("equity") * p["max_risk_fraction"] / unit_risk,
        F.col("equity") * p["max_notional_to_equity"] / px,
        F.col("liquidity") * p["max_liquidity_fraction"] / px,
        F.col("qty"),
    )
    size = F.floor(most / p["qty_step"] * (1 - 1e-12)) * p["qty_step"]
    geometry = F.when(long, (sl < px) & (px < tp)).otherwise((tp < px) & (px < sl))
    new_sl, new_tp = F.coalesce(sl, F.col("pos_sl")), F.coalesce(tp, F.col("pos_tp"))
    held_long = F.col("side") == "LONG"
    widening = F.when(held_long, new_sl < F.col("pos_sl")).otherwise(new_sl > F.col("pos_sl"))
    crooked = F.when(held_long, (new_sl >= new_tp) | (new_tp <= F.col("entry_price"))).otherwise(
        (new_sl <= new_tp) | (new_tp >= F.col("entry_price"))
    )
    crossing = F.when(held_long, (new_sl >= px) | (new_tp <= px)).otherwise((new_sl <= px) | (new_tp >= px))
    idle = a.isin("WAIT", "HOLD", "CLOSE")
    order = F.when(held_long, (F.col("pos_sl") < F.col("entry_price")) & (F.col("entry_price") < F.col("pos_tp"))).otherwise(
        (F.col("pos_tp") < F.col("entry_price")) & (F.col("entry_price") < F.col("pos_sl"))
    )
    age = F.col("quote_age_s")
    code = (
        F.when(a.isNull() | ~a.isin(*ACTION_KEYS), "INVALID_ACTION")
        .when(no(F.col("side").isin("FLAT", "LONG", "SHORT")) | (~flat & no(order)), "INVALID_POSITION")
        .when(no(age.between(0, p["max_quote_age_seconds"])), "STALE_OR_FUTURE_QUOTE")
        .when(no((px > 0) & (F.col("equity") > 0) & (F.col("spread_bps") >= 0) & (F.col("liquidity") >= 0)), "INVALID_MARKET")
        .when(F.col("spread_bps") > p["max_spread_bps"], "SPREAD_LIMIT")
        .when(F.when(flat, ~(opening | (a == "WAIT"))).otherwise(opening | (a == "WAIT")), "ILLEGAL_TRANSITION")
        .when((sl.isNotNull() != wants_sl) | (tp.isNotNull() != wants_tp), "INVALID_PARAMETERS")
        .when(F.col("qty").isNotNull() & no(opening & (F.col("qty") > 0)), "INVALID_QUANTITY")
        .when(yes(sl <= 0) | yes(tp <= 0), "INVALID_PRICE")
        .when(idle, "ACCEPTED")
        .when(opening & ~long & F.lit(not allow_short), "SHORT_NOT_SUPPORTED")
        .when(opening & no(geometry), "INVALID_PROTECTION_GEOMETRY")
        .when(opening & ((stop_bps < p["min_stop_distance_bps"]) | (goal_bps < p["min_target_distance_bps"])), "MIN_DISTANCE")
        .when(opening & no(size > 0), "NO_EXECUTABLE_SIZE")
        .when(opening, "ACCEPTED_PREVIEW_RECHECK_AT_FILL")
        .when(yes(widening), "STOP_WIDENING")
        .when(yes(crooked), "INVALID_PROTECTION_GEOMETRY")
        .when(yes(crossing), "PROTECTION_CROSSES_MARKET")
        .otherwise("ACCEPTED_PREVIEW")
    )
    out = df.withColumn("code", code)
    return out.withColumns(
        {
            "accepted": F.col("code").startswith("ACCEPTED"),
            "approved_qty": F.when(F.col("code") == "ACCEPTED_PREVIEW_RECHECK_AT_FILL", size),
        }
    )


# Stop and target multiples of the four bracket proposals.
BRACKETS = [("sl1_tp1p5", 1.0, 1.5), ("sl1_tp2", 1.0, 2.0), ("sl1p5_tp2", 1.5, 2.0), ("sl2_tp3", 2.0, 3.0)]


def bracket_proposals(decisions: DataFrame, *, atr: str, price: str = "close") -> DataFrame:
    """Four long brackets per decision from trailing volatility only."""
    specs = F.array(*[F.struct(F.lit(t).alias("spec"), F.lit(s).alias("_s"), F.lit(g).alias("_g")) for t, s, g in BRACKETS])
    out = decisions.withColumn("_b", F.explode(specs)).select("*", "_b.*").drop("_b")
    x, a = F.col(price), F.col(atr)
    return out.withColumns({"action": F.lit("OPEN_LONG"), "sl": x - a * F.col("_s"), "tp": x + a * F.col("_g")}).drop("_s", "_g")


def histogram(df: DataFrame, by: Sequence[str], col: str) -> Column | DataFrame:
    """Value counts of ``col`` per group as a map (values are few by contract)."""
    counts = df.groupBy(*by, F.coalesce(F.col(col), F.lit("INVALID")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct("_v", "_n")))
    return counts.groupBy(*by).agg(F.map_from_entries(entries).alias(f"{col}_counts"))


def campaign_summary(df: DataFrame, by: Sequence[str], *, latency: str = "latency_s") -> DataFrame:
    """Valid and accepted counts, action and code histograms, latency statistics."""
    ok, acc = F.col("contract") == "VALID", F.col("accepted")
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations"), F.sum(ok.cast("long")).alias("json_valid"),
        F.sum(F.coalesce(acc, F.lit(False)).cast("long")).alias("risk_accepted"),
        F.avg(ok.cast("double")).alias("json_valid_rate"), F.avg(latency).alias("latency_mean"), F.max(latency).alias("latency_max"),
    )
    med = quantiles(df, by, latency, {"latency_median": 0.5}).drop("n")
    keys = list(by)
    return base.join(med, keys).join(histogram(df, by, "action"), keys).join(histogram(df, by, "code"), keys)


def paired_changes(df: DataFrame, *, pair: Sequence[str], arm: str, value: str, arms: tuple[str, str]) -> DataFrame:
    """Pairs whose value differs between two arms."""
    wide = df.groupBy(*pair).pivot(arm, list(arms)).agg(F.first(value))
    a, b = (F.coalesce(F.col(x), F.lit("INVALID")) for x in arms)
    return wide.agg(F.count(F.lit(1)).alias("pairs"), F.sum((a != b).cast("long")).alias("changed"))


def length_stats(lengths: DataFrame, by: Sequence[str], col: str, *, limits: Sequence[int]) -> DataFrame:
    """Length distribution: moments, percentiles, rows above each limit, suggested limit."""
    base = lengths.groupBy(*by).agg(
        F.min(col).alias("shortest"), F.max(col).alias("longest"), F.avg(col).alias("mean"),
        *[F.sum((F.col(col) > n).cast("long")).alias(f"over_{n}") for n in limits],
    )
    q = quantiles(lengths, by, col, {f"p{p}": p / 100 for p in (50, 75, 90, 95, 97, 99)}).withColumnRenamed("n", "records")
    out = base.join(q, list(by)) if by else with_values(base, q)
    suggested = F.lit(None).cast("int")
    for n in sorted(limits, reverse=True):
        suggested = F.when(F.ceil(F.col("p99")) <= n, n).otherwise(suggested)
    return out.withColumn("suggested_limit", suggested)
