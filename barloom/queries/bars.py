"""Scans, sinks, resampling, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..plans.blocks import with_position
from ..session import scratch
from ..sources import candles as C
from .registry import cte, query
from .tables import HOUR, bars_1h, features, predictions, splits, table, ticks

OHLCV = "open high low close volume"


@query("bars_from_ticks", "SELECT symbol, timestamp, open, high, low, close, volume, n_ticks, known_at FROM bars", OHLCV)
def _(spark, d):
    return B.ticks_to_bars(ticks(spark, d), HOUR)


@query("resample_4h_complete", "SELECT symbol, timestamp, known_at, open, high, low, close, volume, bar_count FROM bars4", OHLCV)
def _(spark, d):
    return B.resample_ohlcv(bars_1h(spark, d), 4 * HOUR).select(
        "symbol", "timestamp", "known_at", "open", "high", "low", "close", "volume", "bar_count"
    )


@query(
    "resample_1d_right_label",
    "SELECT symbol, known_at AS timestamp, open, high, low, close, volume, bar_count FROM bars24",
    OHLCV,
)
def _(spark, d):
    return B.resample_ohlcv(bars_1h(spark, d), 24 * HOUR, label="right")


@query(
    "flagship_4h_context",
    """SELECT symbol, count(*) AS bars, count(h4) AS with_context, avg((close / h4 - 1) * 100) AS mean_distance_pct FROM (
       SELECT b.symbol, b.close, h.close AS h4 FROM bars b ASOF LEFT JOIN bars4 h ON h.symbol = b.symbol AND b.known_at >= h.known_at)
       GROUP BY symbol""",
    "mean_distance_pct",
)
def _(spark, d):
    """Hourly bars with the last complete 4h close known at their own close."""
    from ..plans.asof import Right, asof_join

    bars = B.ticks_to_bars(ticks(spark, d), HOUR)
    h4 = B.resample_ohlcv(bars, 4 * HOUR).select("symbol", F.col("known_at").alias("known_4h"), F.col("close").alias("close_4h"))
    joined = asof_join(bars.select("symbol", "known_at", "close"), Right(h4, "known_4h"), left_on="known_at")
    return joined.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.count("close_4h").alias("with_context"),
        F.avg((F.col("close") / F.col("close_4h") - 1) * 100).alias("mean_distance_pct"),
    )


@query("segment_ids", """SELECT symbol, timestamp, seg, spos AS pos FROM runs1""")
def _(spark, d):
    """Gap-free runs: first bar of the run and position inside it."""
    placed = with_position(bars_1h(spark, d).drop("pos"), keys=["symbol"], ts="timestamp", step=HOUR, reset=True)
    return placed.select("symbol", "timestamp", "seg", "pos")


cte(
    "grid",
    """SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS timestamp FROM
       (SELECT DISTINCT symbol FROM bars), (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM bars)""",
)


@query("calendar_reindex", "SELECT symbol, timestamp, close, volume FROM grid LEFT JOIN bars USING (symbol, timestamp)", "close volume")
def _(spark, d):
    return B.reindex(bars_1h(spark, d).select("symbol", "timestamp", "close", "volume"), HOUR)


@query(
    "upsert_incremental",
    """SELECT symbol, timestamp, CASE WHEN timestamp >= TIMESTAMP '2024-01-15' THEN close * 1.01::DOUBLE ELSE close END AS close,
       CASE WHEN timestamp >= TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END AS load FROM bars WHERE known_at <= TIMESTAMP '2024-01-25'""",
    "close",
)
def _(spark, d):
    """Second load restates bars from mid-month on; unclosed bars are dropped."""
    bars = bars_1h(spark, d).select("symbol", "timestamp", "known_at", "close")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    old = bars.filter(F.col("timestamp") < at("2024-01-20")).withColumn("load", F.lit(0))
    new = bars.filter(F.col("timestamp") >= at("2024-01-15")).withColumns({"close": F.col("close") * 1.01, "load": F.lit(1)})
    out = B.upsert_bars(old, new, key=["symbol", "timestamp"], closed_at="known_at", as_of=at("2024-01-25"))
    return out.select("symbol", "timestamp", "close", "load")


@query(
    "keep_last_dedup",
    "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL",
    "value",
)
def _(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return B.keep_last(ev, ["user_id", "event_type"], ["event_id"])


@query("csv_candle_roundtrip", "SELECT symbol, timestamp, open, high, low, close, volume FROM bars", OHLCV)
def _(spark, d):
    """Candles written as CSV (epoch ms for half, text for half) and scanned back."""
    path = scratch(spark, "csv")
    bars = bars_1h(spark, d)
    from ..plans.blocks import epoch_us

    ms = (epoch_us(F.col("timestamp")) / 1000).cast("bigint").cast("string")
    text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    stamp = F.when(F.col("symbol") < "d", ms).otherwise(text)
    C.write_report(bars.select("symbol", stamp.alias("timestamp"), *OHLCV.split()), path)
    return C.read_candles_csv(spark, path)


@query(
    "kline_archive_roundtrip",
    """SELECT symbol, strftime(timestamp, '%Y-%m') AS month, timestamp, open, high, low, close, volume, close * volume AS quote_volume,
       n_ticks AS trades FROM bars""",
    OHLCV + " quote_volume",
)
def _(spark, d):
    """Kline archive per symbol and month, one symbol's files in microseconds."""
    path = scratch(spark, "klines")
    rows = C.kline_rows(bars_1h(spark, d), micros_from="2024-02")
    wide = rows.withColumns(
        {c: F.when(F.col("symbol") == "view", F.col(c) * 1000).otherwise(F.col(c)) for c in ("open_time", "close_time")}
    )
    wide.repartition("symbol", "month").write.partitionBy("symbol", "month").option("header", True).csv(path)
    return C.read_kline_archive(spark, path)


@query(
    "universe_scan",
    "SELECT symbol, strftime(timestamp, '%Y-%m') AS month, count(*) AS rows, sum(volume) AS volume FROM bars GROUP BY ALL",
    "volume",
)
def _(spark, d):
    """Symbol/month partitioned table, checked for absent months, then scanned."""
    path = scratch(spark, "universe")
    C.write_table(
        bars_1h(spark, d).withColumn("month", F.date_format("timestamp", "yyyy-MM")), path, partition_by=["symbol", "month"]
    )
    df = C.read_universe(spark, path, "2024-01", "2024-01")
    return df.groupBy("symbol", "month").agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))


@query(
    "archive_inventory",
    """SELECT 'orders_' || lower(o_orderstatus) AS symbol, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months,
       min(strftime(o_orderdate, '%Y-%m')) AS first, max(strftime(o_orderdate, '%Y-%m')) AS last, count(*) AS bytes,
       date_diff('month', min(o_orderdate), max(o_orderdate)) + 1 - count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS missing_months
       FROM orders WHERE month(o_orderdate) <> 6 GROUP BY o_orderstatus""",
    n="bytes missing_months",
)
def _(spark, d):
    """Months present / missing per series from path names (one path per order)."""
    o = table(spark, d, "orders").filter(F.month("o_orderdate") != 6)
    name = F.concat(F.lit("s3/symbol=orders_"), F.lower("o_orderstatus"), F.lit("/month="), F.date_format("o_orderdate", "yyyy-MM"), F.lit("/f"))
    return C.inventory_months(o.select(name.alias("path"), F.lit(1).cast("bigint").alias("length")))


@query("table_manifest", "SELECT count(*) AS rows, min(timestamp) AS first, max(timestamp) AS last FROM bars")
def _(spark, d):
    files = spark.read.format("binaryFile").load(f"{d}/events.parquet")
    return C.manifest(bars_1h(spark, d), ts="timestamp", inputs=files, params={"step": HOUR}).select("rows", "first", "last")


@query("dataset_bounds", "SELECT split, min(timestamp) AS start, max(timestamp) AS \"end\", count(*) AS rows FROM splits GROUP BY split")
def _(spark, d):
    return C.dataset_bounds(splits(spark, d), by=["split"])


@query(
    "table_profile_nulls",
    """SELECT * FROM (SELECT 'rsi14' AS "column", 'double' AS type, false AS is_time, count(*) - count(rsi14) AS nulls, count(*) AS rows FROM feats
       UNION ALL SELECT 'timestamp', 'timestamp_ntz', true, count(*) - count(timestamp), count(*) FROM feats
       UNION ALL SELECT 'volatility_72h', 'double', false, count(*) - count(volatility_72h), count(*) FROM feats
       UNION ALL SELECT '4h_trend', 'int', false, count(*) - count("4h_trend"), count(*) FROM feats
       UNION ALL SELECT 'symbol', 'string', false, count(*) - count(symbol), count(*) FROM feats)""",
)
def _(spark, d):
    return C.inspect_table(features(spark, d).select("symbol", "timestamp", "rsi14", "volatility_72h", "4h_trend"))
