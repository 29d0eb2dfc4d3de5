"""Distribution, drift, correlation and error statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import stats as T
from ..plans.quantiles import quantiles
from ..session import stage
from .registry import cte, query
from .sampling import folds, periods
from .tables import HOUR, bars_1h, dense_bars, labeled, splits, trades, valid_candidates

KEYS = ["rsi14", "atr14_pct", "volume_ratio", "distance_ema20_pct", "volatility_24h", "trend_alignment"]
_by_feature = lambda src, sel, grp: " UNION ALL ".join(
    f"SELECT {grp}, '{c}' AS feature, {sel.replace('{c}', c)} FROM {src} WHERE {c} IS NOT NULL GROUP BY {grp}" for c in KEYS
)


@query(
    "period_outcomes",
    """SELECT period, side, count(*) AS n, min(timestamp) AS first_signal, max(timestamp) AS last_signal, avg(net_return * 100) AS net_mean_pct,
       quantile_cont(net_return * 100, 0.5::DOUBLE) AS net_median_pct, stddev_pop(net_return * 100) AS net_std_pct,
       avg(CASE WHEN event_outcome = 'TP' THEN 1 ELSE 0 END) AS rate_tp, avg(CASE WHEN event_outcome = 'SL' THEN 1 ELSE 0 END) AS rate_sl,
       avg(CASE WHEN event_outcome = 'TIME' THEN 1 ELSE 0 END) AS rate_time FROM periods GROUP BY ALL""",
    "net_mean_pct net_median_pct net_std_pct rate_tp rate_sl rate_time",
)
def _(spark, d):
    return T.outcome_rates(periods(spark, d), ["period", "side"])


def _ref_cur(spark, d):
    v = valid_candidates(spark, d)
    return v.filter("split = 'train'"), v.filter("split = 'validation'")


def _drift_cte(name: str, k: int) -> None:
    probs = ", ".join(f"{i / k}::DOUBLE" for i in range(k + 1))
    cte(
        f"edges_{name}",
        " UNION ALL ".join(
            f"""SELECT side, '{c}' AS feature, list_sort(list_distinct(quantile_cont({c}::DOUBLE, [{probs}]))) AS edges FROM valid_cand WHERE split = 'train' GROUP BY side"""
            for c in KEYS
        ),
    )
    cte(
        f"binned_{name}",
        """SELECT v.*, e.edges, len(list_filter(e.edges[2:len(e.edges) - 1], lambda c: c <= x)) AS bin FROM long_cand v JOIN edges_""" + name + " e USING (side, feature)",
    )


cte(
    "long_cand",
    " UNION ALL ".join(
        f"SELECT event_id, symbol, timestamp, split, side, net_return, event_outcome, '{c}' AS feature, {c}::DOUBLE AS x FROM valid_cand WHERE split IN ('train', 'validation') AND {c} IS NOT NULL"
        for c in KEYS
    ),
)
for _n, _k in (("dec", 10), ("quint", 5), ("tert", 3)):
    _drift_cte(_n, _k)


def _moments(std: str) -> str:
    return f"""SELECT side, feature, count(*) FILTER (split = 'train') AS ref_n, count(*) FILTER (split = 'validation') AS cur_n, avg(x) FILTER (split = 'train') AS ref_mean,
        avg(x) FILTER (split = 'validation') AS cur_mean, {std}(x) FILTER (split = 'train') AS ref_std FROM long_cand GROUP BY ALL"""


_DD = "ref_mean cur_mean ref_std smd psi"


@query(
    "drift_deciles",
    f"""SELECT m.*, CASE WHEN ref_std > 1e-12 THEN (cur_mean - ref_mean) / ref_std END AS smd, psi FROM ({_moments('stddev_pop')}) m LEFT JOIN (
        SELECT side, feature, sum((q - p) * ln(q / p)) AS psi FROM (SELECT b.side, b.feature,
          (a / ref_n::DOUBLE + 1e-5::DOUBLE) / (1 + 1e-5::DOUBLE * k) AS p, (z / cur_n::DOUBLE + 1e-5::DOUBLE) / (1 + 1e-5::DOUBLE * k) AS q FROM (
          SELECT side, feature, bin, len(any_value(edges)) - 1 AS k, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'validation') AS z FROM binned_dec GROUP BY side, feature, bin) b
          JOIN ({_moments('stddev_pop')}) USING (side, feature) WHERE k >= 2) GROUP BY side, feature) USING (side, feature)""",
    _DD,
)
def _(spark, d):
    """PSI on train deciles with a 1e-5 floor, and standardised mean difference."""
    ref, cur = _ref_cur(spark, d)
    return T.drift(ref, cur, KEYS, by=["side"], bins=10)


@query(
    "drift_quintiles",
    f"""SELECT m.*, CASE WHEN ref_std > 1e-12 THEN (cur_mean - ref_mean) / ref_std END AS smd, psi FROM ({_moments('stddev_samp')}) m LEFT JOIN (
        SELECT side, feature, sum((q - p) * ln(q / p)) AS psi FROM (SELECT b.side, b.feature, (a + 0.5::DOUBLE) / (ref_n + 0.5::DOUBLE * k) AS p, (z + 0.5::DOUBLE) / (cur_n + 0.5::DOUBLE * k) AS q FROM (
          SELECT side, feature, bin, count(*) OVER (PARTITION BY side, feature) AS k, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'validation') AS z FROM binned_quint GROUP BY side, feature, bin) b
          JOIN ({_moments('stddev_samp')}) USING (side, feature)) GROUP BY side, feature) USING (side, feature)""",
    _DD,
)
def _(spark, d):
    ref, cur = _ref_cur(spark, d)
    return T.drift(ref, cur, KEYS, by=["side"], bins=5, smoothing="half")


@query(
    "outside_reference_range",
    """SELECT c.side, c.feature, a AS ref_p01, z AS ref_p99, avg(CASE WHEN x < a OR x > z THEN 1 ELSE 0 END) * 100 AS outside_pct FROM long_cand c JOIN (
       SELECT side, feature, quantile_cont(x, 0.01::DOUBLE) AS a, quantile_cont(x, 0.99::DOUBLE) AS z FROM long_cand WHERE split = 'train' GROUP BY ALL) USING (side, feature)
       WHERE split = 'validation' GROUP BY ALL""",
    "ref_p01 ref_p99 outside_pct",
)
def _(spark, d):
    ref, cur = _ref_cur(spark, d)
    return T.outside_share(ref, cur, KEYS, ["side"])


@query(
    "drift_top10",
    f"""SELECT side, feature, smd FROM (SELECT side, feature, (cur_mean - ref_mean) / ref_std AS smd FROM ({_moments('stddev_pop')}) WHERE ref_std > 1e-12) ORDER BY abs(smd) DESC, side, feature LIMIT 10""",
    "smd",
)
def _(spark, d):
    ref, cur = _ref_cur(spark, d)
    made = T.drift(ref, cur, KEYS, by=["side"]).select("side", "feature", "smd")
    return made.filter("smd is not null").orderBy(F.desc(F.abs("smd")), "side", "feature").limit(10)


@query("data_driven_bins", "SELECT event_id, feature, bin FROM binned_tert", n="bin")
def _(spark, d):
    """Tertile bins whose edges come from the train rows of each side only."""
    ref, cur = _ref_cur(spark, d)
    cuts = T.reference_cuts(ref, ["side"], KEYS, 3)
    out = T.bin_by_cuts(ref.unionByName(cur), cuts, ["side"], KEYS, ids=["event_id"])
    return out.select("event_id", "feature", F.col("bin").cast("bigint").alias("bin"))


cte(
    "cond",
    """SELECT *, len(list_filter(edges[2:3], lambda c: c < x)) + 1 AS rbin FROM binned_tert WHERE len(edges) = 4""",
)
_rate = lambda o: f"avg(CASE WHEN event_outcome = '{o}' THEN 1 ELSE 0 END) AS {o.lower()}_rate"


@query(
    "conditional_tertiles",
    f"""SELECT side, feature, split, CAST(rbin AS INTEGER) AS bin, count(*) AS n, count(*) >= 20 AS enough_observations, avg(net_return) * 100 AS mean_net_pct,
        {_rate('TP')}, {_rate('SL')}, {_rate('TIME')} FROM cond GROUP BY side, feature, split, rbin""",
    "mean_net_pct tp_rate sl_rate time_rate",
)
def _(spark, d):
    ref, cur = _ref_cur(spark, d)
    return T.conditional_bins(ref.unionByName(cur), KEYS, ref="train")


@query(
    "conditional_deltas",
    """SELECT side, feature, CAST(rbin AS INTEGER) AS bin, avg(net_return) FILTER (split = 'train') * 100 AS train, avg(net_return) FILTER (split = 'validation') * 100 AS validation,
       avg(net_return) FILTER (split = 'validation') * 100 - avg(net_return) FILTER (split = 'train') * 100 AS delta FROM cond GROUP BY side, feature, rbin""",
    "train validation delta",
)
def _(spark, d):
    ref, cur = _ref_cur(spark, d)
    made = T.conditional_bins(ref.unionByName(cur), KEYS, ref="train")
    wide = made.groupBy("side", "feature", "bin").pivot("split", ["train", "validation"]).agg(F.first("mean_net_pct"))
    return wide.withColumn("delta", F.col("validation") - F.col("train"))


# joint regime cells: two binned features and a discrete one
cte(
    "cells3",
    """SELECT v.event_id, v.split, v.side, v.symbol, v.timestamp, v.net_return, v.event_outcome, concat_ws('|', 'B' || (a.bin + 1), 'B' || (r.bin + 1), CAST(v.trend_alignment AS VARCHAR)) AS regime_id
       FROM valid_cand v JOIN (SELECT * FROM binned_tert WHERE feature = 'atr14_pct') a USING (event_id) JOIN (SELECT * FROM binned_tert WHERE feature = 'rsi14') r USING (event_id)""",
)


def regime_cells(spark, d):
    def build():
        ref, cur = _ref_cur(spark, d)
        cols = ["atr14_pct", "rsi14"]
        cuts = T.reference_cuts(ref, ["side"], cols, 3)
        both = ref.unionByName(cur)
        long = T.bin_by_cuts(both, cuts, ["side"], cols, ids=["event_id"])
        wide = long.groupBy("event_id").pivot("feature", cols).agg(F.first("bin"))
        b = lambda c: F.concat(F.lit("B"), (F.col(f"_{c}") + 1).cast("string"))
        wide = wide.withColumnsRenamed({c: f"_{c}" for c in cols})
        regime = F.concat_ws("|", b("atr14_pct"), b("rsi14"), F.col("trend_alignment").cast("string"))
        return both.join(wide, "event_id").withColumn("regime_id", regime)

    return stage(spark, d, "regime_cells", build)


_cell = "side, regime_id, count(*) FILTER (split = 'train') AS train_n, count(*) FILTER (split = 'validation') AS validation_n"


@query(
    "regime_cells",
    f"""SELECT {_cell}, count(*) FILTER (split = 'train') >= 20 AS represented, avg(net_return) FILTER (split = 'train') * 100 AS train_mean_net_pct,
        avg(net_return) FILTER (split = 'validation') * 100 AS validation_mean_net_pct FROM cells3 GROUP BY side, regime_id""",
    "train_mean_net_pct validation_mean_net_pct",
)
def _(spark, d):
    rows = regime_cells(spark, d)
    t, v = F.col("split") == "train", F.col("split") == "validation"
    return rows.groupBy("side", "regime_id").agg(
        T.n_where(t).alias("train_n"), T.n_where(v).alias("validation_n"), (T.n_where(t) >= 20).alias("represented"),
        (F.avg(F.when(t, F.col("net_return"))) * 100).alias("train_mean_net_pct"), (F.avg(F.when(v, F.col("net_return"))) * 100).alias("validation_mean_net_pct"),
    )


@query(
    "regime_coverage",
    f"""SELECT side, CAST(sum(train_n) AS BIGINT) AS train_n, CAST(sum(validation_n) AS BIGINT) AS validation_n, CAST(sum(CASE WHEN train_n >= 20 THEN validation_n ELSE 0 END) AS BIGINT) AS represented_n,
        CAST(sum(CASE WHEN train_n >= 20 AND validation_n >= 10 THEN validation_n ELSE 0 END) AS BIGINT) AS comparable_n, count(*) FILTER (train_n > 0) AS train_regimes,
        count(*) FILTER (validation_n > 0) AS validation_regimes FROM (SELECT {_cell} FROM cells3 GROUP BY side, regime_id) GROUP BY side""",
)
def _(spark, d):
    t, v = F.col("split") == "train", F.col("split") == "validation"
    per = regime_cells(spark, d).groupBy("side", "regime_id").agg(T.n_where(t).alias("t"), T.n_where(v).alias("v"))
    return per.groupBy("side").agg(
        F.sum("t").alias("train_n"), F.sum("v").alias("validation_n"), F.sum(F.when(F.col("t") >= 20, F.col("v")).otherwise(0)).alias("represented_n"),
        F.sum(F.when((F.col("t") >= 20) & (F.col("v") >= 10), F.col("v")).otherwise(0)).alias("comparable_n"),
        T.n_where(F.col("t") > 0).alias("train_regimes"), T.n_where(F.col("v") > 0).alias("validation_regimes"),
    )


cte(
    "bblocks",
    """SELECT *, row_number() OVER (PARTITION BY side, s ORDER BY day) - 1 AS b, count(*) OVER (PARTITION BY side, s) AS m FROM (
       SELECT side, CASE WHEN split = 'train' THEN 'A' ELSE 'B' END AS s, date_trunc('day', timestamp) AS day, sum(net_return) AS total, count(*) AS n FROM valid_cand
       WHERE split IN ('train', 'validation') GROUP BY ALL)""",
)


@query(
    "block_bootstrap",
    """SELECT side, count(*) AS replicates, quantile_cont(delta, 0.025::DOUBLE) AS ci_low, quantile_cont(delta, 0.975::DOUBLE) AS ci_high FROM (
       SELECT side, rep, (max(mean) FILTER (s = 'B') - max(mean) FILTER (s = 'A')) * 100 AS delta FROM (
       SELECT d.side, d.s, d.rep, sum(total) / sum(n) AS mean FROM (
         SELECT side, s, rep, CAST('0x' || substr(md5(concat('7|', s, '|', rep, '|', draw)), 1, 8) AS BIGINT) % m AS b FROM
           (SELECT DISTINCT side, s, m FROM bblocks), range(0, 600) r(rep), LATERAL (SELECT unnest(range(0, m)) AS draw)) d
       JOIN bblocks k ON k.side = d.side AND k.s = d.s AND k.b = d.b GROUP BY d.side, d.s, d.rep) GROUP BY side, rep) GROUP BY side""",
    "ci_low ci_high",
)
def _(spark, d):
    """Day-block bootstrap interval of validation mean minus train mean."""
    rows = valid_candidates(spark, d).withColumn("day", F.date_trunc("day", "timestamp"))
    return T.block_bootstrap_ci(rows, a=F.col("split") == "train", b=F.col("split") == "validation", value="net_return", block="day", by=["side"])


# priors: side means and smoothed frequencies from train, scored on the other splits
cte(
    "priors",
    """SELECT side, avg(net_return) AS prior_mean, (count(*) FILTER (event_outcome = 'SL') + 1) / (count(*) + 3)::DOUBLE AS p_sl,
       (count(*) FILTER (event_outcome = 'TIME') + 1) / (count(*) + 3)::DOUBLE AS p_time, (count(*) FILTER (event_outcome = 'TP') + 1) / (count(*) + 3)::DOUBLE AS p_tp
       FROM valid_cand WHERE split = 'train' GROUP BY side""",
)
cte("scored", "SELECT v.*, p.* EXCLUDE (side) FROM valid_cand v JOIN priors p USING (side)")


def scored(spark, d):
    v = valid_candidates(spark, d)
    return v.join(T.prior_by_side(v.filter("split = 'train'")), "side")


@query("side_priors", "SELECT * FROM priors", "prior_mean p_sl p_time p_tp")
def _(spark, d):
    return T.prior_by_side(valid_candidates(spark, d).filter("split = 'train'"))


_RM = """count(*) AS n, avg(abs(e)) * 100 AS mae_pct, sqrt(avg(e * e)) * 100 AS rmse_pct, avg(e) * 100 AS bias_pct,
    CASE WHEN stddev_pop(y) > 0 AND stddev_pop(p) > 1e-12 THEN corr(y, p) END AS pearson, avg(y) * 100 AS observed_mean_pct, avg(p) * 100 AS predicted_mean_pct"""
_RD = "mae_pct rmse_pct bias_pct pearson observed_mean_pct predicted_mean_pct"


@query("regression_metrics_prior", f"SELECT split, {_RM} FROM (SELECT split, net_return AS y, prior_mean AS p, prior_mean - net_return AS e FROM scored) GROUP BY split", _RD)
def _(spark, d):
    return T.regression_metrics(scored(spark, d), "net_return", "prior_mean", ["split"])


@query(
    "weekly_errors",
    f"SELECT side, strftime(week, '%Y-%m-%d') AS week, {_RM} FROM (SELECT side, date_trunc('week', timestamp) AS week, net_return AS y, prior_mean AS p, prior_mean - net_return AS e FROM scored) GROUP BY side, week",
    _RD,
)
def _(spark, d):
    rows = scored(spark, d).withColumn("week", F.date_format(F.date_trunc("week", "timestamp"), "yyyy-MM-dd"))
    return T.regression_metrics(rows, "net_return", "prior_mean", ["side", "week"])


@query(
    "walk_forward_prior_metrics",
    f"""SELECT fold, {_RM} FROM (SELECT u.fold, u.net_return AS y, p.m AS p, p.m - u.net_return AS e FROM wf_uses u JOIN
        (SELECT symbol, fold, side, avg(net_return) AS m FROM wf_uses WHERE role = 'past' GROUP BY ALL) p USING (symbol, fold, side) WHERE role = 'future') GROUP BY fold""",
    _RD,
)
def _(spark, d):
    """Side prior of each fold's past, scored on the fold."""
    use = folds(spark, d)
    past = use.filter("role = 'past'").groupBy("symbol", "fold", "side").agg(F.avg("net_return").alias("prior"))
    future = use.filter("role = 'future'").join(past, ["symbol", "fold", "side"])
    return T.regression_metrics(future, "net_return", "prior", ["fold"])


cte(
    "ranked_assoc",
    """SELECT *, rank() OVER (PARTITION BY split, side, feature ORDER BY x) + (count(*) OVER (PARTITION BY split, side, feature, x) - 1) / 2.0::DOUBLE AS rx,
       rank() OVER (PARTITION BY split, side, feature ORDER BY net_return) + (count(*) OVER (PARTITION BY split, side, feature, net_return) - 1) / 2.0::DOUBLE AS ry FROM long_cand""",
)
cte(
    "assoc",
    """SELECT split, side, feature, n, CASE WHEN NOT isnan(p) THEN p END AS pearson, CASE WHEN NOT isnan(s) THEN s END AS spearman FROM (
       SELECT split, side, feature, count(*) AS n, corr(x, net_return) AS p, corr(rx, ry) AS s FROM ranked_assoc GROUP BY ALL)""",
)


def associations(spark, d):
    ref, cur = _ref_cur(spark, d)
    return stage(spark, d, "associations", lambda: T.spearman(ref.unionByName(cur), KEYS, "net_return", ["split", "side"]))


@query("feature_associations", "SELECT * FROM assoc", "pearson spearman")
def _(spark, d):
    return associations(spark, d)


@query(
    "association_sign_flips",
    """SELECT side, feature, max(spearman) FILTER (split = 'train') AS train, max(spearman) FILTER (split = 'validation') AS validation,
       max(spearman) FILTER (split = 'train') * max(spearman) FILTER (split = 'validation') < 0 AS sign_flip FROM assoc GROUP BY side, feature""",
    "train validation",
)
def _(spark, d):
    wide = associations(spark, d).groupBy("side", "feature").pivot("split", ["train", "validation"]).agg(F.first("spearman"))
    return wide.withColumn("sign_flip", F.col("train") * F.col("validation") < 0)


_PM = """count(*) AS n, -avg(ln(least(greatest(CASE event_outcome WHEN 'SL' THEN p_sl WHEN 'TIME' THEN p_time ELSE p_tp END, 1e-15::DOUBLE), 1))) AS log_loss,
    avg((p_sl - (event_outcome = 'SL')::INT)^2 + (p_time - (event_outcome = 'TIME')::INT)^2 + (p_tp - (event_outcome = 'TP')::INT)^2) AS brier_multiclass,
    avg((CASE greatest(p_sl, p_time, p_tp) WHEN p_sl THEN 'SL' WHEN p_time THEN 'TIME' ELSE 'TP' END = event_outcome)::INT) AS accuracy,
    avg(p_tp) AS mean_p_tp, avg((event_outcome = 'TP')::INT) AS observed_tp_rate"""


@query("probability_metrics_prior", f"SELECT split, side, {_PM} FROM scored GROUP BY split, side", "log_loss brier_multiclass accuracy mean_p_tp observed_tp_rate")
def _(spark, d):
    return T.probability_metrics(scored(spark, d), ["split", "side"])


@query(
    "calibration_bins",
    """SELECT split, CASE WHEN p <= 0.2 THEN '0-20%' WHEN p <= 0.4 THEN '20-40%' WHEN p <= 0.6 THEN '40-60%' WHEN p <= 0.8 THEN '60-80%' ELSE '80-100%' END AS tp_probability_bin,
       count(*) AS n, avg(p) AS predicted_tp, avg((event_outcome = 'TP')::INT) AS observed_tp FROM (SELECT split, event_outcome, rsi14 / 100 AS p FROM valid_cand) GROUP BY ALL""",
    "predicted_tp observed_tp",
)
def _(spark, d):
    """RSI as a stand-in probability, so that several bins fill."""
    rows = valid_candidates(spark, d).withColumn("p_tp", F.col("rsi14") / 100)
    return T.calibration(rows, ["split"])


@query(
    "probability_checks",
    """SELECT 'out_of_bounds' AS "check", count(*) FILTER (p_sl < 0 OR p_tp > 1) AS violations FROM scored UNION ALL SELECT 'sum_not_one', count(*) FILTER (abs(p_sl + p_time + p_tp - 1) > 1e-9) FROM scored""",
)
def _(spark, d):
    from ..operators.quality import probability_checks

    return probability_checks(scored(spark, d), ["p_sl", "p_time", "p_tp"])


@query(
    "run_row_agreement",
    """SELECT 'only_left' AS "check", (SELECT count(*) FROM splits ANTI JOIN valid_cand USING (symbol, timestamp)) AS violations UNION ALL SELECT 'only_right', 0""",
)
def _(spark, d):
    """Keys a stored run lacks or adds against the rows it should cover."""
    from ..operators.quality import same_rows

    return same_rows(splits(spark, d), valid_candidates(spark, d), ["symbol", "timestamp"])


_BANDS = "CASE WHEN atr14_pct IS NULL THEN 'MISSING' WHEN atr14_pct <= 0.5 THEN '<=0.5%' WHEN atr14_pct <= 1.0 THEN '0.5-1%' WHEN atr14_pct <= 1.5 THEN '1-1.5%' ELSE '>1.5%' END"


def _dist_rows() -> str:
    return " UNION ALL ".join(
        f"SELECT split, '{s}' AS side, {h} AS horizon, {_BANDS} AS atr_band, {s}_outcome_{h}h AS o, {s}_ambiguous_{h}h AS amb, {s}_delay_{h}h AS delay FROM splits"
        for s in ("long", "short") for h in (4, 12, 24)
    )


cte("label_rows", _dist_rows())


def _label_rows(spark, d):
    from ..functions.scalar import right_closed

    band = right_closed(F.col("atr14_pct"), [0.5, 1.0, 1.5], ["<=0.5%", "0.5-1%", "1-1.5%", ">1.5%"])
    items = F.array(
        *[
            F.struct(
                F.lit(s).alias("side"), F.lit(h).alias("horizon"), F.col(f"{s}_outcome_{h}h").alias("o"),
                F.col(f"{s}_ambiguous_{h}h").alias("amb"), F.col(f"{s}_delay_{h}h").alias("delay"),
            )
            for s in ("long", "short") for h in (4, 12, 24)
        ]
    )
    return splits(spark, d).withColumns({"atr_band": band, "_l": F.explode(items)}).select("split", "atr_band", "_l.*")


@query(
    "label_distribution",
    """SELECT split, side, horizon, atr_band, count(*) AS n, count(*) FILTER (o = 1) AS tp, count(*) FILTER (o = -1) AS sl, count(*) FILTER (o = 0) AS no_touch,
       count(*) FILTER (amb) AS simultaneous, count(*) FILTER (o IS NULL AND NOT amb) AS other_null,
       count(*) FILTER (o = 1) * 100.0::DOUBLE / nullif(count(*) FILTER (o IN (1, -1)), 0) AS win_rate_resolved,
       (1.5::DOUBLE * count(*) FILTER (o = 1) - count(*) FILTER (o = -1)) / count(*) AS r_per_signal FROM label_rows GROUP BY ALL""",
    "win_rate_resolved r_per_signal",
)
def _(spark, d):
    o = F.col("o")
    out = _label_rows(spark, d).groupBy("split", "side", "horizon", "atr_band").agg(
        F.count(F.lit(1)).alias("n"), T.n_where(o == 1).alias("tp"), T.n_where(o == -1).alias("sl"), T.n_where(o == 0).alias("no_touch"),
        T.n_where(F.col("amb")).alias("simultaneous"), T.n_where(o.isNull() & ~F.col("amb")).alias("other_null"),
    )
    return out.withColumns(
        {
            "win_rate_resolved": T.ratio(F.col("tp"), F.col("tp") + F.col("sl"), 100.0),
            "r_per_signal": (F.col("tp") * 1.5 - F.col("sl")) / F.col("n"),
        }
    )


@query(
    "touch_delays",
    """SELECT split, side, horizon, count(delay) AS touches, quantile_cont(delay::DOUBLE, 0.5::DOUBLE) AS median_bars, quantile_cont(delay::DOUBLE, 0.9::DOUBLE) AS p90_bars,
       count(*) FILTER (delay <= 4) AS within_4 FROM label_rows WHERE delay IS NOT NULL GROUP BY ALL""",
    "median_bars p90_bars",
)
def _(spark, d):
    rows = _label_rows(spark, d).filter("delay is not null")
    by = ["split", "side", "horizon"]
    q = quantiles(rows, by, "delay", {"median_bars": 0.5, "p90_bars": 0.9}).withColumnRenamed("n", "touches")
    return q.join(rows.groupBy(*by).agg(T.n_where(F.col("delay") <= 4).alias("within_4")), by)


@query(
    "entry_convention_changes",
    """SELECT split, side, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS comparable, count(*) FILTER (a <> b) AS changed,
       100.0::DOUBLE * count(*) FILTER (a <> b) / nullif(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL), 0) AS change_pct FROM (
       SELECT split, 'long' AS side, long_outcome_12h AS a, long_outcome_12h_next_open AS b FROM splits UNION ALL SELECT split, 'short', short_outcome_12h, short_outcome_12h_next_open FROM splits) GROUP BY ALL""",
    "change_pct",
)
def _(spark, d):
    """Label changes between close entry and next-open entry."""
    items = F.array(
        *[F.struct(F.lit(s).alias("side"), F.col(f"{s}_outcome_12h").alias("a"), F.col(f"{s}_outcome_12h_next_open").alias("b")) for s in ("long", "short")]
    )
    rows = splits(spark, d).withColumn("_x", F.explode(items)).select("split", "_x.*")
    out = rows.groupBy("split", "side").agg(
        T.n_where(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("comparable"), T.n_where(F.col("a") != F.col("b")).alias("changed")
    )
    return out.withColumn("change_pct", T.ratio(F.col("changed"), F.col("comparable"), 100.0))


@query(
    "entry_gaps",
    """SELECT split, count(entry_gap_pct) AS n, quantile_cont(abs(entry_gap_pct), 0.5::DOUBLE) AS gap_abs_median_pct, quantile_cont(abs(entry_gap_pct), 0.95::DOUBLE) AS gap_abs_p95_pct
       FROM splits WHERE entry_gap_pct IS NOT NULL GROUP BY split""",
    "gap_abs_median_pct gap_abs_p95_pct",
)
def _(spark, d):
    rows = splits(spark, d).withColumn("g", F.abs("entry_gap_pct"))
    return quantiles(rows, ["split"], "g", {"gap_abs_median_pct": 0.5, "gap_abs_p95_pct": 0.95})


_TG = """count(*) AS trades, avg((net_return > 0)::INT) * 100 AS win_rate_net_pct, avg(gross_return) * 100 AS mean_gross_pct, avg(net_return) * 100 AS mean_net_pct,
    sum(log_equity_return) * 100 AS sum_log_return_pct, (exp(sum(log_equity_return)) - 1) * 100 AS compounded_pct, avg(net_r) AS mean_r, quantile_cont(net_return * 100, 0.5::DOUBLE) AS median_net_pct"""
_TGD = "win_rate_net_pct mean_gross_pct mean_net_pct sum_log_return_pct compounded_pct mean_r median_net_pct"


@query("weekly_trades", f"SELECT symbol, strftime(date_trunc('week', label_available_at), '%Y-%m-%d') AS week, {_TG} FROM trades GROUP BY 1, 2", _TGD)
def _(spark, d):
    t = trades(spark, d).withColumn("week", F.date_format(F.date_trunc("week", "label_available_at"), "yyyy-MM-dd"))
    return T.trade_groups(t, ["symbol", "week"])


@query(
    "trade_regimes",
    f"""SELECT side, dimension, regime, {_TG} FROM (SELECT t.*, 'atr_regime' AS dimension, r.atr_regime AS regime FROM trades t JOIN regimes r USING (symbol, timestamp)
        UNION ALL SELECT t.*, 'rsi_regime', r.rsi_regime FROM trades t JOIN regimes r USING (symbol, timestamp)
        UNION ALL SELECT t.*, 'trend_regime', r.trend_regime FROM trades t JOIN regimes r USING (symbol, timestamp)) GROUP BY side, dimension, regime""",
    _TGD,
)
def _(spark, d):
    t = T.add_regimes(trades(spark, d))
    dims = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("regime")) for n in ("atr_regime", "rsi_regime", "trend_regime")])
    long = t.withColumn("_d", F.explode(dims)).select("side", "net_return", "gross_return", "net_r", "log_equity_return", "_d.*")
    return T.trade_groups(long, ["side", "dimension", "regime"])


def _kth(name: str, cond: str, order: str) -> str:
    return ", ".join(f"coalesce(sum(g) FILTER ({name}_rn <= {k} AND {cond}), 0) * 100 AS {name}_{k}_sum_log_pct" for k in (1, 5, 10, 20))


@query(
    "gain_loss_concentration",
    f"""SELECT symbol, count(*) AS trades, sum(g) * 100 AS sum_log_pct, count(*) FILTER (g > 0) AS positive_trades, count(*) FILTER (g < 0) AS negative_trades,
        {_kth('best', 'g > 0', 'DESC')}, {_kth('worst', 'g < 0', 'ASC')} FROM (
        SELECT symbol, g, row_number() OVER (PARTITION BY symbol ORDER BY g DESC, timestamp) AS best_rn, row_number() OVER (PARTITION BY symbol ORDER BY g, timestamp) AS worst_rn
        FROM (SELECT *, log_equity_return AS g FROM trades)) GROUP BY symbol""",
    "sum_log_pct " + " ".join(f"{n}_{k}_sum_log_pct" for n in ("best", "worst") for k in (1, 5, 10, 20)),
)
def _(spark, d):
    return T.concentration(trades(spark, d), ["symbol"])


@query(
    "worst_weeks",
    """SELECT symbol, week, s AS sum_log_return_pct FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY s, week) AS rn FROM (
       SELECT symbol, strftime(date_trunc('week', label_available_at), '%Y-%m-%d') AS week, sum(log_equity_return) * 100 AS s FROM trades GROUP BY 1, 2)) WHERE rn <= 3""",
    "sum_log_return_pct",
)
def _(spark, d):
    week = F.date_format(F.date_trunc("week", "label_available_at"), "yyyy-MM-dd")
    per = trades(spark, d).groupBy("symbol", week.alias("week")).agg((F.sum("log_equity_return") * 100).alias("sum_log_return_pct"))
    return T._top(per, ["symbol"], F.asc("sum_log_return_pct"), ["week"], 3).drop("_k")


@query(
    "signal_proxy_summary",
    """SELECT side, g AS "group", count(*) AS n, avg(net_return) * 100 AS mean_net_pct, avg((event_outcome = 'TP')::INT) AS tp_rate FROM (
       SELECT side, net_return, event_outcome, unnest(CASE WHEN abs(bias_score) >= 4 AND rsi14 BETWEEN 30 AND 70 THEN ['ALL', 'ELIGIBLE', 'ELIGIBLE_POSITIVE'] WHEN abs(bias_score) >= 4 THEN ['ALL', 'ELIGIBLE'] ELSE ['ALL'] END) AS g FROM valid_cand) GROUP BY ALL""",
    "mean_net_pct tp_rate",
)
def _(spark, d):
    """All rows, rows passing the rule, and of those the positive proxy ones."""
    ok = F.abs("bias_score") >= 4
    pos = ok & F.col("rsi14").between(30, 70)
    g = F.array_compact(F.array(F.lit("ALL"), F.when(ok, "ELIGIBLE"), F.when(pos, "ELIGIBLE_POSITIVE")))
    rows = valid_candidates(spark, d).withColumn("group", F.explode(g))
    return rows.groupBy("side", "group").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("net_return") * 100).alias("mean_net_pct"), F.avg((F.col("event_outcome") == "TP").cast("double")).alias("tp_rate")
    )


# market panels
cte("rets", "SELECT symbol, timestamp, ln(close / lag(close) OVER (PARTITION BY symbol, seg ORDER BY spos)) AS r, close, volume FROM runs1")
cte("pairs", "SELECT a.symbol AS a, b.symbol AS b, a.timestamp, a.r AS ra, b.r AS rb FROM rets a JOIN rets b ON a.timestamp = b.timestamp AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL")


@query(
    "yearly_asset_profile",
    """SELECT symbol, year(timestamp) AS year, count(*) AS available_hours, count(r) AS valid_returns, (SELECT date_diff('hour', min(timestamp), max(timestamp)) + 1 FROM bars) - count(*) AS missing_hours,
       stddev_samp(r) * sqrt(8760) * 100 AS annualized_vol_pct, quantile_cont(abs(r), 0.99::DOUBLE) * 100 AS p99_abs_hourly_return_pct, quantile_cont(close * volume, 0.5::DOUBLE) AS median_quote_volume
       FROM rets GROUP BY ALL""",
    "annualized_vol_pct p99_abs_hourly_return_pct median_quote_volume",
)
def _(spark, d):
    return T.yearly_profile(bars_1h(spark, d)).withColumn("year", F.col("year").cast("bigint"))


@query(
    "yearly_pair_correlation",
    "SELECT year(timestamp) AS year, a, b, count(*) AS common_hours, CASE WHEN count(*) >= 100 THEN corr(ra, rb) END AS correlation FROM pairs GROUP BY ALL",
    "correlation",
)
def _(spark, d):
    return T.yearly_pair_correlation(bars_1h(spark, d)).withColumn("year", F.col("year").cast("bigint"))


@query(
    "rolling_pair_correlation",
    """SELECT a, b, 168 AS window_hours, count(*) AS windows, quantile_cont(c, 0.1::DOUBLE) AS p10, quantile_cont(c, 0.5::DOUBLE) AS median, quantile_cont(c, 0.9::DOUBLE) AS p90 FROM (
       SELECT a, b, count(ra) OVER w AS n, corr(ra, rb) OVER w AS c, row_number() OVER (PARTITION BY a, b ORDER BY timestamp) AS h FROM (
         SELECT k.a, k.b, g.timestamp, p.ra, p.rb FROM (SELECT DISTINCT a, b FROM pairs) k, (SELECT DISTINCT timestamp FROM grid) g LEFT JOIN pairs p ON p.a = k.a AND p.b = k.b AND p.timestamp = g.timestamp)
       WINDOW w AS (PARTITION BY a, b ORDER BY timestamp ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)) WHERE n >= ceil(168 * 0.6::DOUBLE) AND h >= 168 AND c IS NOT NULL GROUP BY a, b""",
    "p10 median p90",
)
def _(spark, d):
    return T.rolling_pair_correlation(bars_1h(spark, d), window=168, coverage=0.6)


@query(
    "directional_efficiency",
    """SELECT symbol, timestamp, efficiency FROM (SELECT symbol, timestamp, spos, abs(ln(close / lag(close, 24) OVER w)) / nullif(sum(abs(r)) OVER (PARTITION BY symbol, seg ORDER BY spos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 0) AS efficiency
       FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol, seg ORDER BY spos)) AS r FROM runs1) WINDOW w AS (PARTITION BY symbol, seg ORDER BY spos)) WHERE spos >= 24""",
    "efficiency",
)
def _(spark, d):
    """Net move over path length of the last 24 bars."""
    made = I.directional_efficiency(bars_1h(spark, d).drop("pos"), n=24)
    return made.filter("efficiency is not null").select("symbol", "timestamp", "efficiency")


# the longer market: full windows of the diversity report
cte("dense_pairs", "SELECT a.symbol AS a, b.symbol AS b, a.timestamp, a.r AS ra, b.r AS rb FROM dense_rets a JOIN dense_rets b ON a.timestamp = b.timestamp WHERE a.r IS NOT NULL AND b.r IS NOT NULL")
cte(
    "dense_grid",
    """SELECT k.a, k.b, g.timestamp, p.ra, p.rb FROM (SELECT x.symbol AS a, y.symbol AS b FROM (SELECT DISTINCT symbol FROM dense) x, (SELECT DISTINCT symbol FROM dense) y) k
       CROSS JOIN (SELECT unnest(generate_series((SELECT min(timestamp) FROM dense), (SELECT max(timestamp) FROM dense), INTERVAL 1 HOUR)) AS timestamp) g
       LEFT JOIN dense_pairs p ON p.a = k.a AND p.b = k.b AND p.timestamp = g.timestamp""",
)


def _dense_windows(days: int, where: str) -> str:
    """Correlation at every hour with a full window of ``days`` days; null without."""
    w = days * 24
    return f"""SELECT a, b, CASE WHEN n >= ceil({w} * 0.98::DOUBLE) AND h >= {w} THEN c END AS c FROM (
       SELECT a, b, count(ra) OVER w AS n, corr(ra, rb) OVER w AS c, row_number() OVER (PARTITION BY a, b ORDER BY timestamp) AS h FROM dense_grid WHERE {where}
       WINDOW w AS (PARTITION BY a, b ORDER BY timestamp ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW))"""


BASE = "a = 'A'"
DENSE_QUANTILES = "count(c) AS windows, quantile_cont(c, 0.1::DOUBLE) AS p10, quantile_cont(c, 0.5::DOUBLE) AS median, quantile_cont(c, 0.9::DOUBLE) AS p90"


@query(
    "rolling_pair_correlation_days",
    " UNION ALL ".join(f"SELECT a, b, {n * 24} AS window_hours, {DENSE_QUANTILES} FROM ({_dense_windows(n, 'a < b')}) WHERE c IS NOT NULL GROUP BY a, b" for n in (30, 90)),
    "p10 median p90",
)
def _(spark, d):
    """Every pair over 30 and 90 days, 98 % of the hours known."""
    one, two = (T.rolling_pair_correlation(dense_bars(spark, d), window=n * 24) for n in (30, 90))
    return one.union(two)


@query(
    "rolling_base_correlation",
    " UNION ALL ".join(f"SELECT b AS symbol, {n} AS window_days, {DENSE_QUANTILES} FROM ({_dense_windows(n, BASE)}) GROUP BY b" for n in (30, 90)),
    "p10 median p90",
)
def _(spark, d):
    """Every symbol against one base symbol over 30 and 90 days."""
    return T.rolling_base_correlation(dense_bars(spark, d), base="A")


@query(
    "pair_correlation_matrix",
    "SELECT a, b, count(*) AS common_hours, CASE WHEN count(*) >= 1000 THEN corr(ra, rb) END AS correlation FROM dense_pairs WHERE a <= b GROUP BY ALL",
    "correlation",
)
def _(spark, d):
    return T.pair_correlation_matrix(dense_bars(spark, d))


@query(
    "median_directional_efficiency",
    """SELECT symbol, count(*) AS bars, quantile_cont(e, 0.5::DOUBLE) AS median_efficiency FROM (
       SELECT symbol, spos, abs(ln(close / lag(close, 168) OVER w)) / nullif(sum(abs(r)) OVER (w ROWS BETWEEN 167 PRECEDING AND CURRENT ROW), 0) AS e
       FROM dense_rets WINDOW w AS (PARTITION BY symbol, seg ORDER BY spos)) WHERE spos >= 168 AND e IS NOT NULL GROUP BY symbol""",
    "median_efficiency",
)
def _(spark, d):
    """Median of the net move over path length of 168 hours, by symbol."""
    made = I.directional_efficiency(dense_bars(spark, d))
    return T.quantiles(made, ["symbol"], "efficiency", {"median_efficiency": 0.5}).withColumnRenamed("n", "bars")


NN = ["atr14_pct", "rsi14", "4h_rsi14", "4h_atr14_pct", "distance_ema200_pct", "ema50_200_spread_pct", "volume_ratio", "trend_alignment"]
cte(
    "nn_scale",
    "SELECT side, " + ", ".join(
        f"quantile_cont(\"{c}\"::DOUBLE, 0.5::DOUBLE) AS m{i}, coalesce(nullif(quantile_cont(\"{c}\"::DOUBLE, 0.75::DOUBLE) - quantile_cont(\"{c}\"::DOUBLE, 0.25::DOUBLE), 0), 1) AS s{i}" for i, c in enumerate(NN)
    ) + " FROM valid_cand WHERE split = 'train' GROUP BY side",
)
cte("nn_rows", "SELECT event_id, split, side, " + ", ".join(f"(\"{c}\" - m{i}) / s{i} AS x{i}" for i, c in enumerate(NN)) + " FROM valid_cand JOIN nn_scale USING (side) WHERE split IN ('train', 'validation')")
cte(
    "nn_dist",
    "SELECT a.event_id, a.split, a.side, min(sqrt(" + " + ".join(f"(a.x{i} - b.x{i}) ^ 2" for i in range(len(NN))) + ")) AS d FROM nn_rows a JOIN nn_rows b ON a.side = b.side AND b.split = 'train' AND a.event_id <> b.event_id GROUP BY ALL",
)


@query(
    "nearest_neighbour_coverage",
    """SELECT t.side, t.n AS train_n, v.n AS validation_n, t.med AS train_loo_nn_median, t.p95 AS train_loo_nn_p95, v.med AS val_nn_median, v.p95 AS val_nn_p95, b.pct AS val_beyond_train_p95_pct FROM
       (SELECT side, count(*) AS n, quantile_cont(d, 0.5::DOUBLE) AS med, quantile_cont(d, 0.95::DOUBLE) AS p95 FROM nn_dist WHERE split = 'train' GROUP BY side) t
       JOIN (SELECT side, count(*) AS n, quantile_cont(d, 0.5::DOUBLE) AS med, quantile_cont(d, 0.95::DOUBLE) AS p95 FROM nn_dist WHERE split = 'validation' GROUP BY side) v USING (side)
       JOIN (SELECT x.side, avg((x.d > q.p)::INT) * 100 AS pct FROM nn_dist x JOIN (SELECT side, quantile_cont(d, 0.95::DOUBLE) AS p FROM nn_dist WHERE split = 'train' GROUP BY side) q USING (side) WHERE x.split = 'validation' GROUP BY x.side) b USING (side)""",
    "train_loo_nn_median train_loo_nn_p95 val_nn_median val_nn_p95 val_beyond_train_p95_pct",
)
def _(spark, d):
    """Distance of each row to its nearest train row in robust-scaled space."""
    return T.neighbour_coverage(valid_candidates(spark, d).filter("split in ('train', 'validation')"), NN, ref="train", cur="validation")
