"""Aggregate audits of predictions, candidates and trades."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import LABELS, outcome_of, right_closed
from ..plans.blocks import BlockFrame, epoch_us, with_position
from ..plans.moments import sliding_correlation
from ..plans.quantiles import cell_offsets, melt, quantiles, with_cells
from ..plans.single import with_values
from ..session import materialise
from .bars import HOUR, calendar

TP_R, SL_R = 1.5, -1.0
# Regime edges (right-closed) and names.
REGIMES = {
    "rsi_regime": ("rsi14", [30, 45, 55, 70], ["RSI_LE_30", "RSI_30_45", "RSI_45_55", "RSI_55_70", "RSI_GT_70"]),
    "atr_regime": ("atr14_pct", [0.5, 1.0, 1.5], ["ATR_LE_0_5", "ATR_0_5_1", "ATR_1_1_5", "ATR_GT_1_5"]),
    "volume_regime": ("volume_ratio", [0.7, 1.5], ["LOW_VOLUME", "NORMAL_VOLUME", "HIGH_VOLUME"]),
    "ema_regime": (
        "distance_ema200_pct", [-2, 0, 2],
        ["BELOW_EMA200_FAR", "BELOW_EMA200_NEAR", "ABOVE_EMA200_NEAR", "ABOVE_EMA200_FAR"],
    ),
    "bias_regime": (
        "bias_score", [-4, -2, 1, 3], ["STRONG_SHORT", "MODERATE_SHORT", "NEUTRAL", "MODERATE_LONG", "STRONG_LONG"],
    ),
}


def n_where(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.when(b != 0, a * scale / b)


def corr(a: Column, b: Column, over=None) -> Column:
    """Pearson over rows where both are known; null if either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    parts = [F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)]
    cov, vx, vy = parts if over is None else [p.over(over) for p in parts]
    return F.when((vx > 0) & (vy > 0), cov / F.nullif(F.sqrt(vx * vy), F.lit(0.0)))


def add_regimes(df: DataFrame) -> DataFrame:
    t = F.col("trend_alignment")
    cols = {"trend_regime": F.when(t >= 2, "BULLISH_ALIGNMENT").when(t <= -2, "BEARISH_ALIGNMENT").otherwise("MIXED")}
    cols |= {name: right_closed(F.col(c), edges, labels) for name, (c, edges, labels) in REGIMES.items()}
    return df.withColumns(cols)


def signal_stats(df: DataFrame, decision: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts by side and outcome, coverage, win rate, total and expected R."""
    d = F.col(decision)
    result = outcome_of(d, F.col("long_outcome_12h"), F.col("short_outcome_12h"))
    rows = df.withColumn("_r", result)
    n = F.count(F.lit(1))
    out = rows.groupBy(*by).agg(
        n.alias("samples"), n_where(d == "LONG_BIAS").alias("long"), n_where(d == "SHORT_BIAS").alias("short"),
        n_where(d == "NO_TRADE").alias("no_trade"),
        *[n_where(F.col("_r") == v).alias(v.lower()) for v in ("TP", "SL", "UNRESOLVED", "UNKNOWN")],
    )
    resolved, directional = F.col("tp") + F.col("sl"), F.col("long") + F.col("short")
    total = F.col("tp") * TP_R + F.col("sl") * SL_R
    return out.withColumns(
        {
            "directional_signals": directional, "resolved": resolved,
            "coverage_pct": F.round(ratio(directional, F.col("samples"), 100), 2),
            "win_rate_pct": F.round(ratio(F.col("tp"), resolved, 100), 2),
            "total_r": F.round(total, 4), "expected_r": F.round(ratio(total, resolved), 4),
        }
    )


def agreement_stats(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement counts and, among disagreements, who traded and who was right."""
    lo, so = F.col("long_outcome_12h"), F.col("short_outcome_12h")
    rows = df.withColumns({"_a": outcome_of(F.col(a), lo, so), "_b": outcome_of(F.col(b), lo, so), "_diff": F.col(a) != F.col(b)})
    x, y, diff = F.col(a), F.col(b), F.col("_diff")
    stay = "NO_TRADE"
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), n_where(~diff).alias("agreements"), n_where(diff).alias("disagreements"),
        n_where(diff & (x != stay) & (y == stay)).alias("a_trades_b_abstains"),
        n_where(diff & (x == stay) & (y != stay)).alias("b_trades_a_abstains"),
        n_where(diff & (x != stay) & (y != stay)).alias("opposite_direction"),
        n_where(diff & (F.col("_a") == "TP") & (F.col("_b") != "TP")).alias("a_tp_only"),
        n_where(diff & (F.col("_b") == "TP") & (F.col("_a") != "TP")).alias("b_tp_only"),
        n_where(diff & (F.col("_a") == "SL") & (F.col("_b") == "SL")).alias("both_sl"),
    )
    return out.withColumn("agreement_pct", F.round(ratio(F.col("agreements"), F.col("samples"), 100), 2))


def classify_disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where two decisions differ, with kind and category."""
    lo, so = F.col("long_outcome_12h"), F.col("short_outcome_12h")
    rows = df.filter(F.col(a) != F.col(b)).withColumns(
        {"a_result": outcome_of(F.col(a), lo, so), "b_result": outcome_of(F.col(b), lo, so)}
    )
    abstains, adds = F.col(a) == "NO_TRADE", F.col(b) == "NO_TRADE"
    ra, rb = F.col("a_result"), F.col("b_result")
    category = (
        F.when(abstains & (rb == "SL"), "SL_AVOIDED").when(abstains & (rb == "TP"), "TP_MISSED")
        .when(adds & (ra == "TP"), "TP_ADDED").when(adds & (ra == "SL"), "SL_ADDED").otherwise("UNDETERMINED")
    )
    kind = F.when(abstains, "A_ABSTAINS").when(adds, "A_ADDS_TRADE").otherwise("OPPOSITE_DIRECTION")
    return rows.withColumns({"type": kind, "category": category})


def wilson(wins: Column, losses: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of a win rate; 0, 0 without resolved rows."""
    n = (wins + losses).cast("double")
    p = wins / n
    centre, denom = p + z * z / (2 * n), 1 + z * z / n
    margin = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    some = n > 0
    return (
        F.when(some, (centre - margin) / denom).otherwise(0.0),
        F.when(some, (centre + margin) / denom).otherwise(0.0),
    )


def signal_groups(df: DataFrame, a: str = "model_prediction", b: str = "heuristic_prediction") -> DataFrame:
    """One row per side and group (ALL_A, ALL_B, BOTH, A_ONLY, B_ONLY) a row belongs to."""
    def member(side: str) -> list[Column]:
        label = f"{side}_BIAS"
        x, y = F.col(a) == label, F.col(b) == label
        outcome = F.col(f"{side.lower()}_outcome_12h").alias("outcome")
        tests = {"ALL_A": x, "ALL_B": y, "BOTH": x & y, "A_ONLY": x & ~y, "B_ONLY": y & ~x}
        return [F.when(t, F.struct(F.lit(side).alias("side"), F.lit(g).alias("group"), outcome)) for g, t in tests.items()]

    items = F.array_compact(F.array(*member("LONG"), *member("SHORT")))
    return df.withColumn("_g", F.explode(items)).select("*", "_g.*").drop("_g")


def group_stats(groups: DataFrame, by: Sequence[str], *, least: int = 20) -> DataFrame:
    """Wins, losses, R per signal, Wilson interval per group."""
    o = F.col("outcome")
    out = groups.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), n_where(o == 1).alias("wins"), n_where(o == -1).alias("losses"),
        n_where((o == 0) | o.isNull()).alias("unresolved"),
    )
    wins, losses, n = F.col("wins"), F.col("losses"), F.col("trades")
    resolved, total = wins + losses, wins * TP_R + losses * SL_R
    low, high = wilson(wins, losses)
    return out.withColumns(
        {
            "resolved": resolved, "win_rate": ratio(wins, resolved), "total_r": total, "expected_r": ratio(total, n),
            "expected_r_resolved": ratio(total, resolved), "ci95_low": low, "ci95_high": high,
            "sufficient_count": n >= least,
            "above_break_even": low > F.lit(-SL_R / (TP_R - SL_R)),
        }
    )


def regime_summary(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """group_stats for every regime dimension from one scan (unpivoted)."""
    names = ["trend_regime", *REGIMES]
    dims = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("regime")) for n in names])
    long = groups.withColumn("_d", F.explode(dims)).select(*by, "outcome", "_d.*")
    return group_stats(long, [*by, "dimension", "regime"])


def feature_stats(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, quartiles of every column per group."""
    long = melt(df, by, cols).filter(F.col("x").isNotNull())
    keys = [*by, "feature"]
    base = long.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    q = quantiles(long, keys, "x", {"q25": 0.25, "median": 0.5, "q75": 0.75}).withColumnRenamed("n", "count")
    return base.join(q, keys)


def classification_report(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), labels: Sequence[str] = LABELS) -> DataFrame:
    """Per class precision / recall / F1 / support, with overall accuracy."""
    cells = df.groupBy(*by, y, yhat).agg(F.count(F.lit(1)).alias("_n"))
    items = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"), (F.col(y) == c).alias("is_true"), F.coalesce(F.col(yhat) == c, F.lit(False)).alias("is_pred")
            )
            for c in labels
        ]
    )
    long = cells.withColumn("_c", F.explode(items))
    n = F.col("_n")
    out = long.groupBy(*by, "_c.label").agg(
        F.sum(F.when(F.col("_c.is_true") & F.col("_c.is_pred"), n).otherwise(0)).alias("_tp"),
        F.sum(F.when(F.col("_c.is_pred"), n).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("_c.is_true"), n).otherwise(0)).alias("support"),
        F.sum(F.when(F.col(y) == F.col(yhat), n).otherwise(0)).alias("_right"),
        F.sum(F.when(F.col(yhat).isin(*labels), 0).otherwise(n)).alias("invalid"),
        F.sum(n).alias("_all"),
    )
    p = F.coalesce(ratio(F.col("_tp"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(ratio(F.col("_tp"), F.col("support")), F.lit(0.0))
    return out.select(
        *by, "label", "support", "predicted", "invalid", p.alias("precision"), r.alias("recall"),
        F.coalesce(ratio(p * r * 2, p + r), F.lit(0.0)).alias("f1"), (F.col("_right") / F.col("_all")).alias("accuracy"),
    )


def confusion_matrix(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), labels: Sequence[str] = LABELS) -> DataFrame:
    """True label by predicted label, fixed columns, absent cells 0."""
    return df.groupBy(*by, y).pivot(yhat, list(labels)).count().fillna(0)


def outcome_rates(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Event outcome shares and net return moments (population std) per group."""
    net = F.col("net_return") * 100
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(net).alias("net_mean_pct"), F.stddev_pop(net).alias("net_std_pct"),
        F.min("timestamp").alias("first_signal"), F.max("timestamp").alias("last_signal"),
        *[F.avg((F.col("event_outcome") == o).cast("double")).alias(f"rate_{o.lower()}") for o in ("TP", "SL", "TIME")],
    )
    med = quantiles(df.withColumn("_net", net), by, "_net", {"net_median_pct": 0.5}).drop("n")
    return base.join(med, list(by))


def trade_groups(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trades, win rate, means, median, log sum and compounded return per group."""
    net, g = F.col("net_return") * 100, F.col("log_equity_return")
    base = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), (F.avg((net > 0).cast("double")) * 100).alias("win_rate_net_pct"),
        (F.avg("gross_return") * 100).alias("mean_gross_pct"), F.avg(net).alias("mean_net_pct"),
        (F.sum(g) * 100).alias("sum_log_return_pct"), (F.expm1(F.sum(g)) * 100).alias("compounded_pct"), F.avg("net_r").alias("mean_r"),
    )
    med = quantiles(trades.withColumn("_net", net), by, "_net", {"median_net_pct": 0.5}).drop("n")
    return base.join(med, list(by))


def _top(df: DataFrame, by: Sequence[str], score: Column, tie: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` rows per group by ``score`` (bounded map-side top-k, then ranked)."""
    w = Window.partitionBy(*by).orderBy(score, *tie)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k)


def concentration(trades: DataFrame, by: Sequence[str], ks: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """Share of the log return carried by the best and worst k trades."""
    rows = trades.withColumn("_g", F.col("log_equity_return"))
    total = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), (F.sum("_g") * 100).alias("sum_log_pct"),
        n_where(F.col("_g") > 0).alias("positive_trades"), n_where(F.col("_g") < 0).alias("negative_trades"),
    )
    most = max(ks)
    for name, cond, score in (("best", F.col("_g") > 0, F.desc("_g")), ("worst", F.col("_g") < 0, F.asc("_g"))):
        top = _top(rows.filter(cond), by, score, ["timestamp"], most)
        sums = top.groupBy(*by).agg(
            *[(F.coalesce(F.sum(F.when(F.col("_k") <= k, F.col("_g"))), F.lit(0.0)) * 100).alias(f"{name}_{k}_sum_log_pct") for k in ks]
        )
        total = total.join(sums, list(by), "left")
    return total.fillna(0.0, [f"{n}_{k}_sum_log_pct" for n in ("best", "worst") for k in ks])


def reference_cuts(ref: DataFrame, by: Sequence[str], cols: Sequence[str], k: int) -> DataFrame:
    """Distinct k-quantile edges (outer ones included) of each column, per group."""
    probs = {f"q{i}": i / k for i in range(k + 1)}
    q = quantiles(melt(ref, by, cols), [*by, "feature"], "x", probs)
    return q.select(*by, "feature", F.array_distinct(F.array(*probs)).alias("edges"))


def bin_by_cuts(rows: DataFrame, cuts: DataFrame, by: Sequence[str], cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """(feature, x, bin) rows; bin = number of inner edges at or below x."""
    ids = [c for c in ids if c not in by]
    long = melt(rows, [*by, *ids], cols).filter(F.col("x").isNotNull())
    joined = long.join(cuts, [*by, "feature"])
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    return joined.withColumn("bin", F.size(F.filter(inner, lambda c: c <= F.col("x"))))


def drift(
    ref: DataFrame, cur: DataFrame, cols: Sequence[str], *, by: Sequence[str], bins: int = 10, smoothing: str = "epsilon"
) -> DataFrame:
    """PSI on reference quantile bins and standardised mean difference.

    ``epsilon`` adds 1e-5 to every share (population std); ``half`` adds half
    a count per bin (sample std).
    """
    keys = [*by, "feature"]
    cuts = reference_cuts(ref, by, cols, bins)
    tag = lambda d, s: bin_by_cuts(d, cuts, by, cols).select(*keys, "x", "bin", "edges", F.lit(s).alias("_s"))
    both = tag(ref, 0).unionByName(tag(cur, 1))
    per = both.groupBy(*keys, "bin").agg(n_where(F.col("_s") == 0).alias("_a"), n_where(F.col("_s") == 1).alias("_b"), F.first("edges").alias("_edges"))
    std = F.stddev_pop if smoothing == "epsilon" else F.stddev_samp
    moments = both.groupBy(*keys).agg(
        F.avg(F.when(F.col("_s") == 0, F.col("x"))).alias("ref_mean"), F.avg(F.when(F.col("_s") == 1, F.col("x"))).alias("cur_mean"),
        std(F.when(F.col("_s") == 0, F.col("x"))).alias("ref_std"), n_where(F.col("_s") == 0).alias("ref_n"), n_where(F.col("_s") == 1).alias("cur_n"),
    )
    cells = per.join(moments.select(*keys, "ref_n", "cur_n"), keys)
    if smoothing == "epsilon":
        # numpy-style bins: an edge value falls in the bin above it; every bin counts, also empty ones
        k, eps = F.size("_edges") - 1, 1e-5
        p = (F.col("_a") / F.col("ref_n") + eps) / (1 + eps * k)
        q = (F.col("_b") / F.col("cur_n") + eps) / (1 + eps * k)
        enough = F.max(F.size("_edges")) >= 3
    else:
        k = F.col("_k")
        cells = cells.join(per.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")), keys)
        p = (F.col("_a") + 0.5) / (F.col("ref_n") + 0.5 * k)
        q = (F.col("_b") + 0.5) / (F.col("cur_n") + 0.5 * k)
        enough = F.lit(True)
    psi = cells.groupBy(*keys).agg(F.sum((q - p) * F.ln(q / p)).alias("_psi"), enough.alias("_ok"))
    out = moments.join(psi, keys)
    return out.select(
        *keys, "ref_n", "cur_n", "ref_mean", "cur_mean", "ref_std",
        F.when(F.col("ref_std") > 1e-12, (F.col("cur_mean") - F.col("ref_mean")) / F.col("ref_std")).alias("smd"),
        F.when(F.col("_ok"), F.col("_psi")).alias("psi"),
    )


def outside_share(ref: DataFrame, cur: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Share of current rows outside the reference's p01 .. p99."""
    keys = [*by, "feature"]
    ends = quantiles(melt(ref, by, cols), keys, "x", {"ref_p01": 0.01, "ref_p99": 0.99}).drop("n")
    out = melt(cur, by, cols).join(ends, keys)
    beyond = (F.col("x") < F.col("ref_p01")) | (F.col("x") > F.col("ref_p99"))
    return out.groupBy(*keys, "ref_p01", "ref_p99").agg((F.avg(beyond.cast("double")) * 100).alias("outside_pct"))


def conditional_bins(rows: DataFrame, cols: Sequence[str], *, ref: str, by: Sequence[str] = ("side",), k: int = 3, least: int = 20) -> DataFrame:
    """Outcome rates per reference tertile of each feature and split."""
    cuts = reference_cuts(rows.filter(F.col("split") == ref), by, cols, k).filter(F.size("edges") == k + 1)
    wide = rows.withColumns({"_net": F.col("net_return"), "_out": F.col("event_outcome")})
    # right-closed bins: an edge value stays below
    long = melt(wide.select(*by, "split", "_net", "_out", *cols), [*by, "split", "_net", "_out"], cols).join(cuts, [*by, "feature"])
    inner = F.slice("edges", 2, k - 1)
    long = long.withColumn("bin", F.size(F.filter(inner, lambda c: c < F.col("x"))) + 1)
    n = F.count(F.lit(1))
    return long.groupBy(*by, "feature", "split", "bin").agg(
        n.alias("n"), (n >= least).alias("enough_observations"), (F.avg("_net") * 100).alias("mean_net_pct"),
        *[F.avg((F.col("_out") == o).cast("double")).alias(f"{o.lower()}_rate") for o in ("TP", "SL", "TIME")],
    )


def spearman(df: DataFrame, cols: Sequence[str], target: str, by: Sequence[str]) -> DataFrame:
    """Pearson and Spearman of each feature with the target, per group.

    Ranks are average ranks.  Equal values are counted first, so ties cost one
    row; the running count over values uses range buckets (see quantiles).
    """
    keys = [*by, "feature"]
    long = melt(df.withColumn("_y", F.col(target).cast("double")), [*by, "_y"], cols).filter(F.col("x").isNotNull() & F.col("_y").isNotNull())
    rx = average_rank(long.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_n")), keys, "x", "_rx")
    ry = average_rank(long.groupBy(*keys, "_y").agg(F.count(F.lit(1)).alias("_n")), keys, "_y", "_ry")
    ranked = long.join(rx, [*keys, "x"]).join(ry, [*keys, "_y"])
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), corr(F.col("x"), F.col("_y")).alias("pearson"), corr(F.col("_rx"), F.col("_ry")).alias("spearman")
    )


def average_rank(counted: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank of every distinct value from (keys, value, _n) rows."""
    ranged = with_cells(counted, keys, value)
    inside = Window.partitionBy(*keys, "_rng").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    offsets = cell_offsets(ranged, keys).drop("_m")
    ranked = ranged.withColumn("_upto", F.sum("_n").over(inside)).join(offsets, [*keys, "_rng"])
    return ranked.select(*keys, value, (F.col("_off") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str]) -> DataFrame:
    e = F.col(yhat) - F.col(y)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.abs(e)) * 100).alias("mae_pct"), (F.sqrt(F.avg(e * e)) * 100).alias("rmse_pct"),
        (F.avg(e) * 100).alias("bias_pct"),
        F.when((F.stddev_pop(y) > 0) & (F.stddev_pop(yhat) > 1e-12), corr(F.col(y), F.col(yhat))).alias("pearson"),
        (F.avg(y) * 100).alias("observed_mean_pct"), (F.avg(yhat) * 100).alias("predicted_mean_pct"),
    )


OUTCOMES = ("SL", "TIME", "TP")


def probability_metrics(df: DataFrame, by: Sequence[str], *, classes: Sequence[str] = OUTCOMES, y: str = "event_outcome") -> DataFrame:
    """Log loss, multiclass Brier score and accuracy of p_<class> columns; rows without any probability only count in ``n``."""
    p = {c: F.col(f"p_{c.lower()}") for c in classes}
    mine, brier = F.lit(None).cast("double"), F.lit(0.0)
    for c, x in p.items():
        mine = F.when(F.col(y) == c, x).otherwise(mine)
        brier = brier + F.pow(x - (F.col(y) == c).cast("double"), 2)
    best, top = F.greatest(*p.values()), F.lit(None).cast("string")
    for c, x in reversed(list(p.items())):
        top = F.when(x == best, c).otherwise(top)
    loss = F.when(best.isNotNull(), F.ln(F.least(F.greatest(mine, F.lit(1e-15)), F.lit(1.0))))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (-F.avg(loss)).alias("log_loss"),
        F.avg(brier).alias("brier_multiclass"), F.avg((top == F.col(y)).cast("double")).alias("accuracy"),
        F.avg("p_tp").alias("mean_p_tp"), F.avg((F.col(y) == "TP").cast("double")).alias("observed_tp_rate"),
    )


def calibration(df: DataFrame, by: Sequence[str], *, p: str = "p_tp", y: str = "event_outcome") -> DataFrame:
    """Predicted against observed rate in five fixed probability bins."""
    names = ["0-20%", "20-40%", "40-60%", "60-80%", "80-100%"]
    b = right_closed(F.col(p), [0.2, 0.4, 0.6, 0.8], names)
    return df.withColumn("tp_probability_bin", b).groupBy(*by, "tp_probability_bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted_tp"), F.avg((F.col(y) == "TP").cast("double")).alias("observed_tp")
    )


def prior_by_side(past: DataFrame, *, by: Sequence[str] = ("side",), classes: Sequence[str] = OUTCOMES, pseudo: float = 1.0) -> DataFrame:
    """Mean net return and smoothed outcome frequencies per side."""
    n = F.count(F.lit(1))
    return past.groupBy(*by).agg(
        F.avg("net_return").alias("prior_mean"),
        *[((n_where(F.col("event_outcome") == c) + pseudo) / (n + pseudo * len(classes))).alias(f"p_{c.lower()}") for c in classes],
    )


def block_bootstrap_ci(
    rows: DataFrame, *, a: Column, b: Column, value: str, block: str, by: Sequence[str], n: int = 600, seed: int = 7,
    low: float = 0.025, high: float = 0.975,
) -> DataFrame:
    """Interval of mean(b) - mean(a), resampling whole blocks.

    Blocks become (sum, count) rows first.  Replicate r draws block number
    md5(seed|side|r|draw) mod m, so draws are rows, not driver state, and the
    same in any engine.
    """
    side = F.when(a, "A").when(b, "B")
    blocks = (
        rows.withColumn("_side", side).filter(F.col("_side").isNotNull()).groupBy(*by, "_side", block)
        .agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    )
    w = Window.partitionBy(*by, "_side").orderBy(block)
    blocks = blocks.withColumn("_b", F.row_number().over(w) - 1)
    sizes = blocks.groupBy(*by, "_side").agg(F.count(F.lit(1)).alias("_m"))
    draws = (
        sizes.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("_draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    )
    text = F.concat_ws("|", F.lit(str(seed)), "_side", F.col("_rep").cast("string"), F.col("_draw").cast("string"))
    draws = draws.withColumn("_b", (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.col("_m")))
    means = (
        draws.join(blocks, [*by, "_side", "_b"]).groupBy(*by, "_side", "_rep")
        .agg((F.sum("_sum") / F.sum("_n")).alias("_mean"))
        .groupBy(*by, "_rep")
        .agg((F.max(F.when(F.col("_side") == "B", F.col("_mean"))) - F.max(F.when(F.col("_side") == "A", F.col("_mean")))).alias("_delta"))
    )
    means = means.withColumn("_delta", F.col("_delta") * 100)
    return quantiles(means, by, "_delta", {"ci_low": low, "ci_high": high}).withColumnRenamed("n", "replicates")


def yearly_profile(bars: DataFrame, *, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Available / missing hours, annualised volatility, p99 move, median quote volume."""
    runs = with_position(bars.select(*keys, "timestamp", "close", "volume"), keys=keys, ts="timestamp", step=HOUR, reset=True)
    bf = BlockFrame(runs, [*keys, "seg"], before=1)
    rows = bf.with_columns({"log_return": F.ln(F.col("close") / bf.lag("close"))}).own()
    rows = rows.withColumns({"year": F.year("timestamp"), "_abs": F.abs("log_return"), "_quote": F.col("close") * F.col("volume")})
    by = [*keys, "year"]
    span = rows.agg(F.min("timestamp").alias("_lo"), F.max("timestamp").alias("_hi"))
    total = ((F.unix_timestamp(F.col("_hi").cast("timestamp")) - F.unix_timestamp(F.col("_lo").cast("timestamp"))) / HOUR).cast("long") + 1
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("available_hours"), F.count("log_return").alias("valid_returns"),
        (F.stddev_samp("log_return") * F.sqrt(F.lit(24.0 * 365)) * 100).alias("annualized_vol_pct"),
    )
    base = with_values(base, span).withColumn("missing_hours", total - F.col("available_hours"))
    p99 = quantiles(rows, by, "_abs", {"_p": 0.99}).select(*by, (F.col("_p") * 100).alias("p99_abs_hourly_return_pct"))
    med = quantiles(rows, by, "_quote", {"median_quote_volume": 0.5}).drop("n")
    return base.drop("_lo", "_hi").join(p99, by).join(med, by)


def _returns(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    runs = with_position(bars.select(*keys, "timestamp", "close"), keys=keys, ts="timestamp", step=HOUR, reset=True)
    bf = BlockFrame(runs, [*keys, "seg"], before=1)
    return bf.with_columns({"r": F.ln(F.col("close") / bf.lag("close"))}).own().filter(F.col("r").isNotNull()).select(*keys, "timestamp", "r")


def pair_returns(bars: DataFrame, *, key: str = "symbol") -> DataFrame:
    """Returns of two symbols on common bars (a < b); the pairs are the result."""
    r = _returns(bars, [key])
    a = r.select(F.col(key).alias("a"), "timestamp", F.col("r").alias("ra"))
    b = r.select(F.col(key).alias("b"), "timestamp", F.col("r").alias("rb"))
    return a.join(b, "timestamp").filter(F.col("a") < F.col("b"))


def yearly_pair_correlation(bars: DataFrame, *, least: int = 100) -> DataFrame:
    per = pair_returns(bars).groupBy(F.year("timestamp").alias("year"), "a", "b").agg(
        F.count(F.lit(1)).alias("common_hours"), corr(F.col("ra"), F.col("rb")).alias("_c")
    )
    return per.select("year", "a", "b", "common_hours", F.when(F.col("common_hours") >= least, F.col("_c")).alias("correlation"))


def pair_correlation_matrix(bars: DataFrame, *, least: int = 1000, key: str = "symbol") -> DataFrame:
    """Common hours and return correlation of all symbols over the whole period: the upper triangle with its diagonal.

    A pair with fewer than ``least`` common hours has no correlation.
    """
    r = _returns(bars, [key])
    a = r.select(F.col(key).alias("a"), "timestamp", F.col("r").alias("ra"))
    b = r.select(F.col(key).alias("b"), "timestamp", F.col("r").alias("rb"))
    per = a.join(b, "timestamp").filter(F.col("a") <= F.col("b")).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("common_hours"), corr(F.col("ra"), F.col("rb")).alias("_c")
    )
    return per.select("a", "b", "common_hours", F.when(F.col("common_hours") >= least, F.col("_c")).alias("correlation"))


def _rolling(pairs: DataFrame, keys: Sequence[str], bars: DataFrame, window: int, coverage: float) -> DataFrame:
    """Quantiles of the correlation over ``window`` calendar hours, at every hour of the bars' calendar.

    A window counts if it lies inside the calendar and enough of its hours are
    known on both sides.
    """
    import math

    keys = list(keys)
    grid = calendar(pairs, HOUR, keys=keys, bounds=bars).join(pairs, [*keys, "timestamp"], "left")
    start = bars.agg(F.min("timestamp").alias("_t0"))
    hours = (epoch_us(F.col("timestamp")) - epoch_us(F.col("_t0"))) / (HOUR * 1_000_000)
    placed = with_values(grid, start).withColumn("_h", hours.cast("long")).drop("_t0")
    rows = sliding_correlation(placed, keys, "_h", "ra", "rb", window)
    rows = rows.filter((F.col("n") >= math.ceil(window * coverage)) & (F.col("_h") >= window - 1) & F.col("correlation").isNotNull())
    return quantiles(rows.drop("n"), keys, "correlation", {"p10": 0.1, "median": 0.5, "p90": 0.9}).withColumnRenamed("n", "windows")


def rolling_pair_correlation(bars: DataFrame, *, window: int, coverage: float = 0.98) -> DataFrame:
    """Median / p10 / p90 of the rolling correlation of every symbol pair."""
    pairs = materialise(pair_returns(bars), "pairs")
    q = _rolling(pairs, ["a", "b"], bars, window, coverage)
    return q.select("a", "b", F.lit(window).alias("window_hours"), "windows", "p10", "median", "p90")


def rolling_base_correlation(bars: DataFrame, *, base: str, days: Sequence[int] = (30, 90), coverage: float = 0.98, key: str = "symbol") -> DataFrame:
    """Median / p10 / p90 of the rolling correlation of every symbol with ``base``, itself included.

    A symbol without a full window has a row of no windows and null quantiles.
    """
    r = _returns(bars, [key])
    other = r.filter(F.col(key) == base).select("timestamp", F.col("r").alias("rb"))
    pairs = materialise(r.withColumnRenamed("r", "ra").join(other, "timestamp"), "base-pairs")
    names = bars.select(key).distinct()
    out = None
    for d in days:
        q = names.join(_rolling(pairs, [key], bars, d * 24, coverage), key, "left")
        q = q.select(key, F.lit(d).alias("window_days"), F.coalesce("windows", F.lit(0)).cast("long").alias("windows"), "p10", "median", "p90")
        out = q if out is None else out.union(q)
    return out


def robust_scaled(rows: DataFrame, ref: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Columns as (x - median) / IQR of the reference rows, named x0 .. xn."""
    q = quantiles(melt(ref, by, cols), [*by, "feature"], "x", {"a": 0.25, "m": 0.5, "b": 0.75})
    scale = F.struct("m", F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(1.0).alias("s"))
    wide = q.groupBy(*by).pivot("feature", list(cols)).agg(F.first(scale))
    wide = wide.select(*by, *[F.col(c).alias(f"_q{i}") for i, c in enumerate(cols)])
    return rows.join(wide, list(by)).withColumns(
        {f"x{i}": (F.col(c) - F.col(f"_q{i}.m")) / F.col(f"_q{i}.s") for i, c in enumerate(cols)}
    )


def neighbour_coverage(rows: DataFrame, cols: Sequence[str], *, ref: str, cur: str, by: Sequence[str] = ("side",), id: str = "event_id", cell_rows: int = 2048) -> DataFrame:
    """Nearest reference row of every row; share of current rows beyond the reference p95."""
    from ..plans.neighbours import nearest

    by = list(by)
    names = [f"x{i}" for i in range(len(cols))]
    scaled = robust_scaled(rows, rows.filter(F.col("split") == ref), cols, by).select(*by, "split", id, *names)
    points = scaled.filter(F.col("split") == ref).drop("split")
    dist = nearest(scaled.drop("split"), points, names, by=by, id=id, cell_rows=cell_rows)
    dist = dist.join(scaled.select(*by, id, "split"), [*by, id])
    a, b = dist.filter(F.col("split") == ref), dist.filter(F.col("split") == cur)
    qa = quantiles(a, by, "distance", {"train_loo_nn_median": 0.5, "train_loo_nn_p95": 0.95}).withColumnRenamed("n", "train_n")
    qb = quantiles(b, by, "distance", {"val_nn_median": 0.5, "val_nn_p95": 0.95}).withColumnRenamed("n", "validation_n")
    beyond = b.join(qa.select(*by, "train_loo_nn_p95"), by).groupBy(*by).agg(
        (F.avg((F.col("distance") > F.col("train_loo_nn_p95")).cast("double")) * 100).alias("val_beyond_train_p95_pct")
    )
    return qa.join(qb, by).join(beyond, by)
