"""Splits, folds, samples, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as H
from ..operators import stats as T
from ..operators.indicators import trailing_context
from ..plans.quantiles import quantiles
from ..session import stage
from .registry import cte, query
from .tables import HOUR, bars_1h, candidates, labeled, splits, table, valid_candidates


@query("chrono_split", "SELECT symbol, timestamp, split FROM splits")
def _(spark, d):
    """70/15/15 by position with a 24 hour purge before each boundary."""
    return H.chrono_split(labeled(spark, d).filter("sample_ready").select("symbol", "timestamp"))


cte(
    "wf",
    """SELECT *, CASE WHEN i >= s THEN (SELECT min(f) FROM range(1, 6) r(f) WHERE i < s + floor((n - s) * f / 5)) END AS fold FROM (
       SELECT *, floor(n * 0.5::DOUBLE) AS s FROM (
       SELECT event_id, symbol, timestamp, known_at, label_available_at, side, net_return, event_outcome,
       row_number() OVER (PARTITION BY symbol ORDER BY timestamp, event_id) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM valid_cand WHERE split = 'train'))""",
)
cte("wf_heads", "SELECT symbol, fold, min(known_at) AS start, min(i) AS \"left\" FROM wf WHERE fold IS NOT NULL GROUP BY ALL")
cte(
    "wf_uses",
    """SELECT w.* EXCLUDE (fold), CAST(h.fold AS INTEGER) AS fold, 'past' AS role FROM wf w JOIN wf_heads h ON h.symbol = w.symbol AND w.i < h."left"
         AND w.known_at < h.start - INTERVAL 24 HOUR AND w.label_available_at < h.start
       UNION ALL SELECT w.* EXCLUDE (fold), CAST(fold AS INTEGER), 'future' FROM wf w WHERE fold IS NOT NULL""",
)


def folds(spark, d):
    return stage(spark, d, "folds", lambda: H.walk_forward(valid_candidates(spark, d).filter("split = 'train'")))


@query("walk_forward_folds", "SELECT event_id, fold, role FROM wf_uses")
def _(spark, d):
    return folds(spark, d).select("event_id", "fold", "role")


@query(
    "walk_forward_summary",
    """SELECT symbol, fold, count(*) FILTER (role = 'past') AS train_rows, count(*) FILTER (role = 'future') AS eval_rows,
       max(label_available_at) FILTER (role = 'past') AS last_label, min(known_at) FILTER (role = 'future') AS first_known FROM wf_uses GROUP BY ALL""",
)
def _(spark, d):
    past, future = F.col("role") == "past", F.col("role") == "future"
    return folds(spark, d).groupBy("symbol", "fold").agg(
        T.n_where(past).alias("train_rows"), T.n_where(future).alias("eval_rows"),
        F.max(F.when(past, F.col("label_available_at"))).alias("last_label"), F.min(F.when(future, F.col("known_at"))).alias("first_known"),
    )


cte(
    "periods",
    """SELECT *, 'TRAIN_Q' || least(4, 4 * (row_number() OVER (ORDER BY timestamp, event_id) - 1) // count(*) OVER () + 1) AS period
       FROM valid_cand WHERE split = 'train'""",
)


def periods(spark, d):
    return H.quartile_periods(valid_candidates(spark, d).filter("split = 'train'"))


@query("quartile_periods", "SELECT event_id, period FROM periods")
def _(spark, d):
    return periods(spark, d).select("event_id", "period")


def _hash(seed: int, id: str = "doc_id") -> str:
    return f"md5(concat('{seed}|', {id}))"


@query(
    "balance_to_smallest_class",
    f"""SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY {_hash(42)}, doc_id) AS rn FROM labels)
        WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY toxic))""",
)
def _(spark, d):
    return H.balance_to_smallest(table(spark, d, "labels"), "toxic", id="doc_id").select("doc_id", "quality", "toxic")


@query(
    "balance_majority_ratio",
    f"""SELECT doc_id, quality, toxic FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, quality, toxic FROM (
        SELECT *, row_number() OVER (ORDER BY {_hash(42)}, doc_id) AS rn FROM labels WHERE quality = 1)
        WHERE rn <= floor((SELECT count(*) FROM labels WHERE quality = 0) * 0.6::DOUBLE / 0.4::DOUBLE + 1e-9::DOUBLE)""",
)
def _(spark, d):
    return H.balance_ratio(table(spark, d, "labels"), "quality", 1, id="doc_id").select("doc_id", "quality", "toxic")


@query(
    "stratified_sample",
    f"""SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_hash(7)}, doc_id) AS rn FROM labels) WHERE rn <= 25""",
)
def _(spark, d):
    return H.stratified(table(spark, d, "labels"), "quality", 25, id="doc_id", seed=7).select("doc_id", "quality", "toxic")


@query(
    "stride_every_kth",
    "SELECT symbol, timestamp, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) - 1 AS i FROM bars) WHERE i % 12 = 0",
    "close",
)
def _(spark, d):
    return H.stride_rows(bars_1h(spark, d), 12).select("symbol", "timestamp", "close")


cte(
    "plan",
    """SELECT symbol, TIMESTAMP '2024-01-02' + k * INTERVAL 48 HOUR AS timestamp FROM (SELECT DISTINCT symbol FROM bars), range(0, 14) r(k)""",
)


@query(
    "stride_schedule",
    """SELECT p.symbol, p.timestamp, b.close, b.close IS NULL AS absent FROM plan p LEFT JOIN bars b USING (symbol, timestamp)""",
    "close",
)
def _(spark, d):
    """Decisions at a fixed 48 hour schedule; scheduled times without a bar are listed."""
    found, absent = H.stride_schedule(bars_1h(spark, d).select("symbol", "timestamp", "close"), first="2024-01-02 00:00:00", stride=48 * HOUR, count=14)
    return found.withColumn("absent", F.lit(False)).unionByName(
        absent.withColumns({"close": F.lit(None).cast("double"), "absent": F.lit(True)})
    )


cte(
    "trail",
    """SELECT symbol, timestamp, known_at, close / lag(close, 59) OVER w - 1 AS trailing_return,
       (max(high) OVER v - min(low) OVER v) / lag(close, 59) OVER w AS trailing_range,
       CASE WHEN spos >= 60 THEN avg(greatest(high - low, abs(high - pc), abs(low - pc))) OVER v END AS trailing_mean_tr, spos
       FROM (SELECT *, lag(close) OVER (PARTITION BY symbol, seg ORDER BY spos) AS pc FROM runs1)
       WINDOW w AS (PARTITION BY symbol, seg ORDER BY spos), v AS (PARTITION BY symbol, seg ORDER BY spos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
)


@query(
    "trailing_context_60",
    "SELECT symbol, timestamp, known_at, trailing_return, CASE WHEN spos >= 59 THEN trailing_range END AS trailing_range, trailing_mean_tr FROM trail",
    "trailing_return trailing_range trailing_mean_tr",
)
def _(spark, d):
    return trailing_context(bars_1h(spark, d).drop("pos")).select(
        "symbol", "timestamp", "known_at", "trailing_return", "trailing_range", "trailing_mean_tr"
    )


cte("pr", "SELECT symbol, timestamp, return_24h AS r, volatility_24h AS v FROM splits")
cte("pk1", "SELECT 'up' AS profile, * FROM (SELECT * FROM pr ORDER BY r DESC, timestamp, symbol LIMIT 1)")
cte("pk2", "SELECT 'down' AS profile, * FROM (SELECT * FROM pr ANTI JOIN pk1 USING (symbol, timestamp) ORDER BY r, timestamp, symbol LIMIT 1)")
cte("pk12", "SELECT * FROM pk1 UNION ALL SELECT * FROM pk2")
cte("pk3", "SELECT 'wild' AS profile, * FROM (SELECT * FROM pr ANTI JOIN pk12 USING (symbol, timestamp) ORDER BY v DESC, timestamp, symbol LIMIT 1)")
cte("pk123", "SELECT * FROM pk12 UNION ALL SELECT * FROM pk3")
cte("pk4", "SELECT 'calm' AS profile, * FROM (SELECT * FROM pr ANTI JOIN pk123 USING (symbol, timestamp) ORDER BY v, timestamp, symbol LIMIT 1)")
cte("pk1234", "SELECT * FROM pk123 UNION ALL SELECT * FROM pk4")
cte(
    "prq",
    "SELECT " + ", ".join(
        f"quantile_cont({c}, {q}::DOUBLE) AS {c}{n}" for c in ("r", "v") for n, q in (("a", 0.25), ("m", 0.5), ("b", 0.75))) + " FROM pr",
)


@query(
    "profile_picks",
    """SELECT * FROM pk1234 UNION ALL SELECT 'median', symbol, timestamp, r, v FROM (
       SELECT p.*, abs(r - rm) / (rb - ra) + abs(v - vm) / (vb - va) AS dist FROM (SELECT * FROM pr ANTI JOIN pk1234 USING (symbol, timestamp)) p, prq
       ORDER BY dist, timestamp, symbol LIMIT 1)""",
    "r v",
)
def _(spark, d):
    rows = splits(spark, d).select("symbol", "timestamp", F.col("return_24h").alias("r"), F.col("volatility_24h").alias("v"))
    want = {"up": ("r", False), "down": ("r", True), "wild": ("v", False), "calm": ("v", True)}
    return H.profile_picks(rows, want, ts="timestamp", key=["symbol"], middle=["r", "v"])


_FR = "(0.1), (0.25), (0.5), (1.0)"
cte(
    "topf",
    f"""SELECT x.*, f.f::DOUBLE AS top_fraction FROM (SELECT *, row_number() OVER (PARTITION BY split, side ORDER BY abs(bias_score) DESC, timestamp, event_id) AS rn,
        count(*) OVER (PARTITION BY split, side) AS n FROM valid_cand) x, (VALUES {_FR}) f(f) WHERE rn <= greatest(1, ceil(n * f.f::DOUBLE))""",
)


@query(
    "top_fraction_ranking",
    """SELECT split, side, top_fraction, count(*) AS candidate_count, avg(net_return) * 100 AS mean_net_return_pct, quantile_cont(net_return, 0.5::DOUBLE) * 100 AS median_net_return_pct,
       avg(CASE WHEN event_outcome = 'TP' THEN 1 ELSE 0 END) * 100 AS tp_rate_pct, avg(CASE WHEN event_outcome = 'SL' THEN 1 ELSE 0 END) * 100 AS sl_rate_pct
       FROM topf GROUP BY ALL""",
    "top_fraction mean_net_return_pct median_net_return_pct tp_rate_pct sl_rate_pct",
)
def _(spark, d):
    rows = valid_candidates(spark, d).select("event_id", "split", "side", "timestamp", "net_return", "event_outcome", F.abs("bias_score").cast("double").alias("score"))
    top = H.top_fraction(rows, "score", by=["split", "side"], ties=["timestamp", "event_id"])
    by = ["split", "side", "top_fraction"]
    rate = lambda o: F.avg((F.col("event_outcome") == o).cast("double")) * 100
    base = top.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidate_count"), (F.avg("net_return") * 100).alias("mean_net_return_pct"), rate("TP").alias("tp_rate_pct"), rate("SL").alias("sl_rate_pct")
    )
    med = quantiles(top, by, "net_return", {"m": 0.5}).select(*by, (F.col("m") * 100).alias("median_net_return_pct"))
    return base.join(med, by)


@query(
    "label_overlap",
    """SELECT symbol, split, count(*) FILTER (gap < INTERVAL 12 HOUR) AS close_pairs, count(*) - 1 AS pairs FROM (
       SELECT symbol, split, timestamp - lag(timestamp) OVER (PARTITION BY symbol, split ORDER BY timestamp) AS gap FROM splits) GROUP BY ALL""",
)
def _(spark, d):
    return H.overlap_count(splits(spark, d), 12 * HOUR, by=["symbol", "split"])


@query(
    "asset_roles",
    "SELECT CASE WHEN symbol IN ('view', 'signup') THEN 'HELD_OUT' ELSE 'TRAIN' END AS role, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM bars GROUP BY 1",
)
def _(spark, d):
    rows = H.asset_roles(bars_1h(spark, d), ["view", "signup"])
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"))
