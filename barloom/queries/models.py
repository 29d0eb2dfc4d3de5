"""Model baselines and the streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import stats as T
from ..operators.events import CANDIDATE_FEATURES
from ..session import scratch, stage
from ..streaming.bars import run_to_parquet, stream_bars, stream_zigzag
from .registry import query
from .sampling import folds
from .tables import bars_1h, ticks, valid_candidates

FEATURES = [c for c in CANDIDATE_FEATURES if c not in ("1d_rsi14", "1d_atr14_pct")]


def _split(spark, d):
    v = valid_candidates(spark, d)
    return v.filter("split = 'train'"), v.filter("split = 'validation'")


@query("ridge_validation")
def _(spark, d):
    """Ridge on train against the side prior, on validation."""
    train, val = _split(spark, d)
    made = M.with_ridge(M.fit_ridge(train, FEATURES), val, FEATURES)
    made = made.join(T.prior_by_side(train).select("side", "prior_mean"), "side", "left")
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("prediction")) for n, c in (("SIDE_PRIOR", "prior_mean"), ("RIDGE", "ridge"))])
    long = made.withColumn("_m", F.explode(models)).select("side", "net_return", "_m.*")
    return T.regression_metrics(long, "net_return", "prediction", ["model", "side"])


@query("logistic_validation")
def _(spark, d):
    """Three-class logistic on train, probability metrics on validation."""
    train, val = _split(spark, d)
    return T.probability_metrics(M.with_probabilities(M.fit_logistic(train, FEATURES), val, FEATURES), ["side"])


@query("boosted_validation")
def _(spark, d):
    """Boosted trees per class on train, class report on validation."""
    train, val = _split(spark, d)
    made = M.predicted_class(M.fit_boosted(train, FEATURES), val, FEATURES)
    return T.classification_report(made, "event_outcome", "predicted", labels=list(T.OUTCOMES))


@query("walk_forward_models")
def _(spark, d):
    """Ridge and logistic per fold, error metrics of the out-of-fold rows."""
    made = stage(spark, d, "walk_forward", lambda: M.walk_forward_predictions(folds(spark, d), FEATURES))
    ridge = T.regression_metrics(made, "net_return", "ridge", ["fold"])
    prob = T.probability_metrics(made, ["fold"]).select("fold", "log_loss", "brier_multiclass", "accuracy")
    return ridge.join(prob, "fold")


@query(
    "streamed_bars_4h",
    """SELECT h.symbol, h.timestamp, h.known_at, h.open, h.high, h.low, h.close, h.volume, h.n_ticks FROM (SELECT symbol, time_bucket(INTERVAL 4 HOUR, timestamp, TIMESTAMP '1970-01-01') AS timestamp,
       time_bucket(INTERVAL 4 HOUR, timestamp, TIMESTAMP '1970-01-01') + INTERVAL 4 HOUR AS known_at, arg_min(price, (timestamp, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (timestamp, event_id)) AS close,
       sum(volume) AS volume, count(*) AS n_ticks FROM ticks GROUP BY ALL) h JOIN bars4 b USING (symbol, timestamp) WHERE h.known_at <= (SELECT max(timestamp) FROM ticks) - INTERVAL 1 HOUR""",
    "open high low close volume",
)
def _(spark, d):
    """Tick stream to complete 4h bars, append mode after the watermark."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    rows = raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").alias("timestamp"), "event_id", (F.col("value") + 100.0).alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )
    return run_to_parquet(stream_bars(rows, "4 hours", parts=4), scratch(spark, "stream-bars"))


@query("streamed_zigzag_1h", "SELECT symbol, confirmation_at, pivot_at, kind, label, price FROM zzev1", "price")
def _(spark, d):
    """Bar stream to zigzag events with keyed state."""
    path = scratch(spark, "stream-input")
    bars_1h(spark, d).select("symbol", "known_at", "high", "low", "close").write.parquet(path)
    raw = spark.readStream.schema("symbol string, known_at timestamp_ntz, high double, low double, close double").parquet(path)
    return run_to_parquet(stream_zigzag(raw, pct=1.0, late="0 seconds"), scratch(spark, "stream-zigzag"))
