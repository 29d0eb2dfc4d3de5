"""Data-quality checks: each returns (check, violations) rows or a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.blocks import BlockFrame, epoch_us, floor_time, shift_time, with_position
from ..plans.quantiles import melt, quantiles
from ..plans.ranks import rank_by_time
from ..plans.single import with_values
from .bars import HOUR, calendar


def count_where(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check, violations) rows from row predicates, in one pass."""
    row = df.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(k) for k, c in checks.items()])
    return row.unpivot([], list(checks), "check", "violations")


def require(checks: DataFrame) -> None:
    """Fail closed: raise if any check has violations."""
    bad = checks.filter("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['violations']}" for r in bad))


def check_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    nulls = count_where(df, {"null_key": null})
    dups = df.groupBy(*key).count()
    return nulls.unionByName(count_where(dups, {"duplicate_key": F.col("count") > 1}))


def continuity(df: DataFrame, step: int, *, keys: Sequence[str] = ("symbol",), ts: str = "timestamp") -> DataFrame:
    """Rows, gap count and gap-free runs per series."""
    runs = with_position(df.select(*keys, ts), keys=keys, ts=ts, step=step, reset=True)
    starts = F.sum((F.col("pos") == 0).cast("long"))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), starts.alias("segments"), (starts - 1).alias("gaps"),
        (F.max("pos") + 1).alias("longest_run"),
    )


def ohlc_checks() -> dict[str, Column]:
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    odd = F.lit(False)
    for x in (o, h, l, c, v):
        odd = odd | x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return {
        "not_finite": odd,
        "not_positive": F.least(o, h, l, c) <= 0,
        "negative_volume": v < 0,
        "high_too_low": h < F.greatest(o, c, l),
        "low_too_high": l > F.least(o, c, h),
    }


def grid_checks(step: int, *, ts: str = "timestamp", month: str | None = None) -> dict[str, Column]:
    t = F.col(ts)
    out = {"off_grid": floor_time(t, step) != t}
    if month:
        out["outside_month"] = F.date_format(t, "yyyy-MM") != F.col(month)
    return out


def clock_checks(step: int, *, ts: str = "timestamp", available: str = "available_at") -> dict[str, Column]:
    return {"clock": F.col(available) != shift_time(F.col(ts), step)}


def staleness_checks(decision: str, known: str, limit: int) -> dict[str, Column]:
    age = epoch_us(F.col(decision)) - epoch_us(F.col(known))
    return {f"future_{known}": age < 0, f"stale_{known}": age > limit * 1_000_000}


def reference_checks(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every left key matches exactly one right row."""
    per = right.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    joined = left.join(per, list(key), "left")
    return count_where(joined, {"unmatched": F.col("_n").isNull(), "matched_many": F.col("_n") > 1})


def split_integrity(rows: DataFrame, *, earlier: str, later: str, id: str = "event_id", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Ids disjoint, order chronological, labels known before the next split."""
    a, b = (rows.filter(F.col("split") == s) for s in (earlier, later))
    shared = a.select(id).join(b.select(id), id, "left_semi").agg(F.count(F.lit(1)).alias("violations"))
    ends = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("split") == earlier, F.col("timestamp"))).alias("_last"),
        F.max(F.when(F.col("split") == earlier, F.col("label_available_at"))).alias("_label"),
        F.min(F.when(F.col("split") == later, F.col("timestamp"))).alias("_first"),
        F.min(F.when(F.col("split") == later, F.col("known_at"))).alias("_known"),
    )
    order = count_where(
        ends, {"not_chronological": F.col("_last") >= F.col("_first"), "label_known_late": F.col("_label") >= F.col("_known")}
    )
    return shared.select(F.lit("shared_ids").alias("check"), "violations").unionByName(order)


def missing_bars(df: DataFrame, step: int, *, keys: Sequence[str] = ("symbol",), ts: str = "timestamp") -> DataFrame:
    """Calendar slots without a bar."""
    return calendar(df, step, keys=keys, ts=ts).join(df.select(*keys, ts), [*keys, ts], "left_anti")


def gap_overlap(missing: DataFrame, symbols: DataFrame, *, key: str = "symbol", ts: str = "timestamp") -> DataFrame:
    """Slots missing for all symbols, for any, and in total."""
    n = symbols.select(key).distinct().agg(F.count(F.lit(1)).alias("_all"))
    per = with_values(missing.groupBy(ts).agg(F.count(F.lit(1)).alias("_n")), n)
    return per.agg(
        F.coalesce(F.sum((F.col("_n") == F.col("_all")).cast("long")), F.lit(0)).alias("common_gaps"),
        F.count(F.lit(1)).alias("union_gaps"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("missing_total"),
    )


def archive_quality(df: DataFrame, step: int, *, keys: Sequence[str] = ("symbol",), ts: str = "timestamp") -> DataFrame:
    """Per (key, month): rows, rows a full month has, missing, odd transitions."""
    runs = with_position(df.select(*keys, ts), keys=keys, ts=ts, step=step, reset=True)
    rows = runs.withColumn("month", F.date_format(ts, "yyyy-MM"))
    per = rows.groupBy(*keys, "month").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.col("pos") == 0).cast("long")).alias("_starts"),
        F.min(F.struct(F.col(ts), F.col("pos"))).alias("_first"),
    )
    day = F.to_date(F.concat("month", F.lit("-01")))
    expected = (F.dayofmonth(F.last_day(day)) * 86_400 / step).cast("long")
    return per.select(
        *keys, "month", "rows", expected.alias("expected_rows"), (expected - F.col("rows")).alias("missing_rows"),
        (F.col("_starts") - (F.col("_first.pos") == 0).cast("long")).alias("odd_transitions"),
    )


def reconcile(a: DataFrame, b: DataFrame, key: Sequence[str], fields: Sequence[str], *, atol: float = 1e-6, rtol: float = 1e-9) -> DataFrame:
    """Per field: compared rows, mismatches, largest difference; one-sided keys."""
    left = a.select(*key, F.struct(*fields).alias("_a"))
    right = b.select(*key, F.struct(*fields).alias("_b"))
    both = left.join(right, list(key), "full_outer")
    aggs = [
        F.sum(F.col("_b").isNull().cast("long")).alias("only_left"),
        F.sum(F.col("_a").isNull().cast("long")).alias("only_right"),
    ]
    for f in fields:
        x, y = F.col(f"_a.{f}"), F.col(f"_b.{f}")
        diff = F.abs(x - y)
        aggs.append(
            F.struct(
                F.count(diff).alias("compared"),
                F.coalesce(F.sum((diff > atol + rtol * F.abs(y)).cast("long")), F.lit(0)).alias("mismatches"),
                F.max(diff).alias("max_abs_diff"),
            ).alias(f)
        )
    one = both.agg(*aggs)
    return one.unpivot(["only_left", "only_right"], list(fields), "field", "_v").select("field", "only_left", "only_right", "_v.*")


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: missing, distinct, constant flag, min / p01 / median / p99 / max."""
    total = df.agg(F.count(F.lit(1)).alias("_rows"))
    long = melt(df, [], cols)
    counts = (
        long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("feature")
        .agg(
            F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("_n"))), F.lit(0)).alias("_have"),
            F.count("x").alias("distinct"), F.min("x").alias("min"), F.max("x").alias("max"),
        )
    )
    counts = with_values(counts, total)
    q = quantiles(long, ["feature"], "x", {"p01": 0.01, "median": 0.5, "p99": 0.99}).drop("n")
    return counts.join(q, "feature", "left").select(
        "feature", (F.col("_rows") - F.col("_have")).alias("missing"), "distinct", (F.col("distinct") <= 1).alias("constant"),
        "min", "p01", "median", "p99", "max",
    )


def similar_pairs(df: DataFrame, cols: Sequence[str], *, threshold: float = 0.995, least: int = 500) -> DataFrame:
    """Column pairs with |Pearson| >= threshold over enough shared rows.

    One scan: every task folds its rows into pairwise moment matrices (shifted
    by the column means, so nothing is lost to cancellation) and emits one row
    per pair; the pairs are then summed.  Work per row is one small matrix
    product, however many columns there are.
    """
    cols = list(cols)
    narrow = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    means = narrow.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in narrow.columns]).first()
    shift = np.array(list(means), dtype=float)
    upper = np.triu_indices(len(cols), 1)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def moments(parts):
        total = None
        for pdf in parts:
            x = pdf.to_numpy(dtype=float) - shift
            known = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            here = np.stack([known.T @ known, x.T @ known, known.T @ x, (x * x).T @ known, known.T @ (x * x), x.T @ x])
            total = here if total is None else total + here
        if total is not None:
            rows = {k: total[m][upper] for m, k in enumerate(names)}
            yield pd.DataFrame({"i": upper[0], "j": upper[1], **rows})

    sums = narrow.mapInPandas(moments, "i long, j long, " + ", ".join(f"{k} double" for k in names))
    s = sums.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in names])
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / F.col("n"), F.col("syy") - F.col("sy") ** 2 / F.col("n")
    some = (F.col("n") > 1) & (vx > 0) & (vy > 0)
    r = F.when(some, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    label = F.array(*[F.lit(c) for c in cols])
    out = s.filter(F.col("n") > 0).select(
        F.get(label, F.col("i").cast("int")).alias("a"), F.get(label, F.col("j").cast("int")).alias("b"),
        F.col("n").cast("long").alias("shared_rows"), r.alias("pearson"),
    )
    return out.filter((F.col("shared_rows") >= least) & (F.abs("pearson") >= threshold))


def chain_audit(path: DataFrame, *, keys: Sequence[str], order: Sequence[str], r: str = "net_return", alloc: float = 1.0, tol: float = 1e-9) -> DataFrame:
    """equity_after follows from before; each before equals the after before it."""
    placed = rank_by_time(path, keys, list(order))
    bf = BlockFrame(placed, keys, pos="_i", before=1)
    bf.with_columns({"_prev": bf.lag("equity_after")})
    rows = bf.own()
    own = F.abs(F.col("equity_after") - F.col("equity_before") * (1 + alloc * F.col(r))) > tol * F.col("equity_after")
    link = F.abs(F.col("equity_before") - F.col("_prev")) > tol * F.col("_prev")
    return count_where(rows, {"own_step": own, "broken_chain": link, "not_positive": F.col("equity_after") <= 0})


def ledger_from_trades(trades: DataFrame, *, qty: float = 1.0, fee_bps: float = 5.0) -> DataFrame:
    """ENTRY / EXIT rows of taken trades (append-only ledger form)."""
    fee = fee_bps / 10_000
    sign = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    pnl = sign * (F.col("exit_fill") - F.col("entry_fill")) * qty - fee * qty * (F.col("entry_fill") + F.col("exit_fill"))
    none = F.lit(None)
    rows = F.array(
        F.struct(
            F.col("entry_at").alias("at"), F.lit("ENTRY").alias("event"), F.col("entry_fill").alias("price"), F.lit(qty).alias("qty"),
            (F.col("entry_fill") * qty * fee).alias("fee"), none.cast("double").alias("net_trade_pnl"), none.cast("string").alias("reason"),
        ),
        F.struct(
            F.col("label_available_at").alias("at"), F.lit("EXIT").alias("event"), F.col("exit_fill").alias("price"), F.lit(qty).alias("qty"),
            (F.col("exit_fill") * qty * fee).alias("fee"), pnl.alias("net_trade_pnl"), F.col("reason").alias("reason"),
        ),
    )
    led = trades.withColumn("_e", F.explode(rows)).select("symbol", "side", "tp_price", "sl_price", "_e.*")
    # an exit at the close of a bar sorts before an entry at the next open
    led = led.withColumn("seq", F.when(F.col("event") == "EXIT", 0).otherwise(1))
    placed = rank_by_time(led, ["symbol"], ["at", "seq"])
    run = BlockFrame(placed, ["symbol"], pos="_i").scan({"cash": ("sum", F.coalesce("net_trade_pnl", F.lit(0.0)), True)})
    return run.drop("_i")


def restate_cash(ledger: DataFrame) -> DataFrame:
    """The ledger with its cash worked out again from its own profits."""
    placed = rank_by_time(ledger.drop("cash"), ["symbol"], ["at", "seq"])
    return BlockFrame(placed, ["symbol"], pos="_i").scan({"cash": ("sum", F.coalesce("net_trade_pnl", F.lit(0.0)), True)}).drop("_i")


def ledger_audit(ledger: DataFrame, bars: DataFrame, *, fee_bps: float = 5.0, tol: float = 1e-6) -> DataFrame:
    """Recompute fees, pairing, profit, cash and level touches of a ledger.

    A position is known by the running count of entries, for its entry and its
    exit alike, so an exit that is missing or doubled spoils its own position
    only.
    """
    fee, keys = fee_bps / 10_000, ["symbol"]
    placed = rank_by_time(ledger, keys, ["at", "seq"])
    rows = BlockFrame(placed, keys, pos="_i").scan(
        {
            "position": ("sum", (F.col("event") == "ENTRY").cast("long"), True),
            "_cash": ("sum", F.coalesce("net_trade_pnl", F.lit(0.0)), True),
        }
    )
    line = count_where(
        rows,
        {
            "fee": F.abs(F.col("fee") - F.col("price") * F.col("qty") * fee) > tol,
            "cash": F.abs(F.col("cash") - F.col("_cash")) > tol,
        },
    )
    pick = lambda e, c: F.max(F.when(F.col("event") == e, F.col(c)))
    pos = rows.groupBy("symbol", "position").agg(
        F.sum((F.col("event") == "ENTRY").cast("long")).alias("_n_in"), F.sum((F.col("event") == "EXIT").cast("long")).alias("_n_out"),
        F.max("side").alias("side"), F.max("tp_price").alias("tp"), F.max("sl_price").alias("sl"),
        pick("ENTRY", "at").alias("in_at"), pick("EXIT", "at").alias("out_at"), pick("ENTRY", "price").alias("p_in"),
        pick("EXIT", "price").alias("p_out"), pick("EXIT", "net_trade_pnl").alias("pnl"), pick("EXIT", "reason").alias("reason"),
        F.max("qty").alias("qty"),
    )
    last = bars.select("symbol", shift_time(F.col("timestamp"), HOUR).alias("out_at"), "high", "low")
    newest = pos.groupBy("symbol").agg(F.max("position").alias("_newest"))
    pos = pos.join(newest, "symbol").join(last, ["symbol", "out_at"], "left")
    sign = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    due = sign * (F.col("p_out") - F.col("p_in")) * F.col("qty") - fee * F.col("qty") * (F.col("p_in") + F.col("p_out"))
    level = F.when(F.col("reason") == "SL", F.col("sl")).when(F.col("reason") == "TP", F.col("tp"))
    pairs = count_where(
        pos,
        {
            "overlapping_position": (F.col("_n_in") == 1) & (F.col("_n_out") == 0) & (F.col("position") < F.col("_newest")),
            "exit_without_entry": (F.col("_n_out") > F.col("_n_in")),
            "unpaired_entry": (F.col("_n_in") == 1) & (F.col("_n_out") == 0),
            "profit": F.abs(F.col("pnl") - due) > tol,
            "exit_before_entry": F.col("out_at") <= F.col("in_at"),
            "level_not_touched": level.isNotNull() & ~level.between(F.col("low"), F.col("high")),
        },
    )
    return line.unionByName(pairs)


def ledger_summary(ledger: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Entries, exits, fees and realised profit of a ledger."""
    n = lambda e: F.sum((F.col("event") == e).cast("long"))
    return ledger.groupBy(*keys).agg(
        n("ENTRY").alias("entries"), n("EXIT").alias("exits"), F.sum("fee").alias("fees"),
        F.coalesce(F.sum("net_trade_pnl"), F.lit(0.0)).alias("net_pnl"), F.max_by("cash", "at").alias("cash"),
    )


def ledger_summary_check(ledger: DataFrame, stated: DataFrame, decisions: DataFrame, step: int, *, keys: Sequence[str] = ("symbol",), tol: float = 1e-6) -> DataFrame:
    """A stated summary against its ledger, and the decision grid's missing slots."""
    keys = list(keys)
    mine = ledger_summary(ledger, keys=keys).select(*keys, F.struct("entries", "exits", "net_pnl", "cash").alias("_m"))
    both = mine.join(stated.select(*keys, F.struct("entries", "exits", "net_pnl").alias("_s")), keys, "full_outer")
    m, s = F.col("_m"), F.col("_s")
    rows = count_where(
        both,
        {
            "summary_absent": m.isNull() | s.isNull(),
            "trade_counts": (m["entries"] != s["entries"]) | (m["exits"] != s["exits"]),
            "net_profit": F.abs(m["net_pnl"] - s["net_pnl"]) > tol,
            "cash_end": F.abs(m["cash"] - m["net_pnl"]) > tol,
        },
    )
    absent = missing_bars(decisions, step, keys=keys).agg(F.count(F.lit(1)).alias("violations"))
    return rows.unionByName(absent.select(F.lit("missing_decisions").alias("check"), "violations"))


def probability_checks(df: DataFrame, cols: Sequence[str], *, tol: float = 1e-9) -> DataFrame:
    total, outside = F.lit(0.0), F.lit(False)
    for c in cols:
        p = F.col(c)
        total = total + p
        outside = outside | p.isNull() | F.isnan(p) | (p < -1e-12) | (p > 1 + 1e-12)
    return count_where(df, {"out_of_bounds": outside, "sum_not_one": F.abs(total - 1) > tol})


def same_rows(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys present on one side only."""
    left, right = a.select(*key).withColumn("_a", F.lit(1)), b.select(*key).withColumn("_b", F.lit(1))
    return count_where(
        left.join(right, list(key), "full_outer"), {"only_left": F.col("_b").isNull(), "only_right": F.col("_a").isNull()}
    )


def scenario_integrity(grid: DataFrame, *, longest: int = 12) -> DataFrame:
    """Status combinations, missing outcomes, and one candidate set per multiple."""
    ok = F.col("eligibility") == "ELIGIBLE"
    rows = count_where(
        grid,
        {
            "not_eligible_but_placed": F.col("portfolio_status").isin("TAKEN", "SKIPPED_OVERLAP") & ~ok,
            "eligible_without_outcome": ok & (F.col("net_return").isNull() | F.col("exit_at").isNull()),
            "unknown_reason": ok & ~F.col("reason").rlike("^(TP|SL|TIME)(_|$)"),
            "duration_out_of_range": ok & ~F.col("duration_bars").between(1, longest),
            "unknown_side": ~F.col("side").isin("LONG", "SHORT"),
        },
    )
    per_id = grid.groupBy("method", "timeframe", "event_id").agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("multiple_r").alias("_m")
    )
    many = grid.agg(F.countDistinct("multiple_r").alias("_all"))
    per_id = with_values(per_id, many)
    return rows.unionByName(
        count_where(per_id, {"duplicate_scenario": F.col("_n") > F.col("_m"), "candidate_set_differs": F.col("_m") < F.col("_all")})
    )
