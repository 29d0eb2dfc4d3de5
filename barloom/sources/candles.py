"""Candle scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.blocks import epoch_us
from ..plans.single import with_values

# Fixed names: the 12 columns of an exchange kline archive, in file order.
KLINE_COLUMNS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades",
    "taker_buy_base", "taker_buy_quote", "ignore",
]
# Fixed value: epochs at or above this are microseconds, below it milliseconds.
MICROS_FROM = 100_000_000_000_000


def strict_double(c: str) -> Column:
    """Text to double; text that is not a number fails the job."""
    x = F.col(c)
    bad = x.isNotNull() & x.try_cast("double").isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit(f"not a number in {c}: "), x)).cast("double")).otherwise(
        x.try_cast("double")
    )


def read_candles_csv(spark: SparkSession, path: str, *, prices: Sequence[str] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """CSV candles with a header; ``timestamp`` in epoch milliseconds or text."""
    raw = spark.read.option("header", True).csv(path)
    t = F.col("timestamp")
    millis = F.timestamp_millis(t.try_cast("bigint")).cast("timestamp_ntz")
    stamp = F.when(t.rlike(r"^\d+$"), millis).otherwise(F.to_timestamp(t).cast("timestamp_ntz"))
    return raw.withColumns({"timestamp": stamp} | {c: strict_double(c) for c in prices})


def normalise_epoch(df: DataFrame, col: str, file_col: str) -> DataFrame:
    """Epoch integers to time, unit detected per file; a file mixing units fails."""
    big = F.col(col) >= MICROS_FROM
    unit = df.groupBy(file_col).agg(F.bool_or(big).alias("_any"), F.bool_and(big).alias("_all"))
    out = df.join(unit, file_col)
    mixed = F.raise_error(F.concat(F.lit("mixed epoch units in "), F.col(file_col))).cast("timestamp")
    at = F.when(F.col("_any") != F.col("_all"), mixed).when(F.col("_all"), F.timestamp_micros(F.col(col))).otherwise(
        F.timestamp_millis(F.col(col))
    )
    return out.withColumn("timestamp", at.cast("timestamp_ntz")).drop("_any", "_all")


def read_kline_archive(spark: SparkSession, path: str) -> DataFrame:
    """12-column kline CSVs; header rows dropped, symbol and month from the path."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in KLINE_COLUMNS])
    raw = (
        spark.read.schema(schema).option("recursiveFileLookup", True).csv(path)
        .withColumn("file", F.col("_metadata.file_path"))
        .filter(F.col("open_time") != "open_time")
    )
    numbers = {c: strict_double(c) for c in ("open", "high", "low", "close", "volume", "quote_volume")}
    raw = raw.withColumns(
        numbers
        | {
            "open_time": F.col("open_time").cast("bigint"),
            "trades": F.col("trades").cast("bigint"),
            "symbol": F.regexp_extract("file", r"symbol=([^/]+)/", 1),
            "month": F.regexp_extract("file", r"month=(\d{4}-\d{2})/", 1),
        }
    )
    return normalise_epoch(raw, "open_time", "file").select(
        "symbol", "month", "timestamp", "open", "high", "low", "close", "volume", "quote_volume", "trades"
    )


def read_bars(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; the projection reaches the reader."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def month_grid(df: DataFrame, start: str, end: str, key: str = "symbol") -> DataFrame:
    """Every (key, month) pair between two months, inclusive."""
    months = F.expr(f"sequence(date'{start}-01', date'{end}-01', interval 1 month)")
    grid = df.select(key).distinct().select(key, F.explode(months).alias("month"))
    return grid.withColumn("month", F.date_format("month", "yyyy-MM"))


def absent_months(df: DataFrame, start: str, end: str, key: str = "symbol") -> DataFrame:
    have = df.select(key, F.col("month").cast("string").alias("month")).distinct()
    return month_grid(df, start, end, key).join(have, [key, "month"], "left_anti")


def read_universe(spark: SparkSession, root: str, start: str, end: str) -> DataFrame:
    """Tables partitioned by symbol and month; a missing pair is an error."""
    df = spark.read.parquet(root)
    df = df.withColumn("month", F.col("month").cast("string")).filter(F.col("month").between(start, end))
    gaps = absent_months(df, start, end).limit(5).collect()
    if gaps:
        raise FileNotFoundError(f"absent months: {[(r[0], r[1]) for r in gaps]}")
    return df


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("messages array<struct<role:string,content:string>>").json(path)


def write_chat(df: DataFrame, path: str) -> None:
    df.select("messages").write.mode("errorifexists").json(path)


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = ()) -> None:
    """zstd parquet; an existing target is refused."""
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def inventory_months(files: DataFrame, *, path: str = "path", size: str = "length") -> DataFrame:
    """Per symbol: months present, first, last, bytes, months missing inside."""
    named = files.select(
        F.regexp_extract(path, r"symbol=([^/]+)/", 1).alias("symbol"),
        F.regexp_extract(path, r"month=(\d{4}-\d{2})", 1).alias("month"),
        F.col(size).alias("bytes"),
    ).filter("month <> ''")
    per = named.groupBy("symbol", "month").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
    out = per.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("months"), F.min("month").alias("first"), F.max("month").alias("last"),
        F.sum("bytes").alias("bytes"),
    )
    whole = F.expr("sequence(to_date(concat(first, '-01')), to_date(concat(last, '-01')), interval 1 month)")
    grid = out.select("symbol", F.explode(whole).alias("month")).withColumn("month", F.date_format("month", "yyyy-MM"))
    missing = (
        grid.join(per.select("symbol", "month"), ["symbol", "month"], "left_anti")
        .groupBy("symbol").agg(F.count(F.lit(1)).alias("missing_months"))
    )
    return out.join(missing, "symbol", "left").fillna({"missing_months": 0})


def manifest(df: DataFrame, *, ts: str, inputs: DataFrame | None = None, params: dict | None = None) -> DataFrame:
    """One row: rows, time range, schema hash, input hashes, parameters as JSON.

    ``inputs`` is a ``binaryFile`` scan of the source files.
    """
    import json

    out = df.agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    out = out.withColumns(
        {"columns_sha256": F.sha2(F.lit(json.dumps(df.columns)), 256), "parameters": F.lit(json.dumps(params or {}, sort_keys=True))}
    )
    if inputs is not None:
        digest = inputs.select("path", F.sha2("content", 256).alias("sha256"))
        prints = digest.agg(F.array_sort(F.collect_list("sha256")).alias("input_sha256"))
        out = with_values(out, prints)
    return out


def dataset_bounds(df: DataFrame, *, by: Sequence[str], ts: str = "timestamp") -> DataFrame:
    return df.groupBy(*by).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("rows"))


def inspect_table(df: DataFrame) -> DataFrame:
    """Per column: type, whether it is a time, null count, row count (one pass)."""
    n = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in df.columns]
    )
    long = n.unpivot(["_rows"], df.columns, "column", "nulls")
    kinds = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    kind = F.element_at(kinds, F.col("column"))
    return long.select(
        "column", kind.alias("type"), (kind.startswith("timestamp") | (kind == "date")).alias("is_time"),
        F.coalesce("nulls", F.lit(0)).alias("nulls"), F.col("_rows").alias("rows"),
    )


def kline_rows(bars: DataFrame, *, micros_from: str) -> DataFrame:
    """Bars in kline column order; months from ``micros_from`` on in microseconds."""
    us = epoch_us(F.col("timestamp"))
    month = F.date_format("timestamp", "yyyy-MM")
    unit = lambda c: F.when(month >= micros_from, c).otherwise(F.floor(c / 1000))
    zero = F.lit(0.0)
    return bars.select(
        "symbol", month.alias("month"), unit(us).alias("open_time"), "open", "high", "low", "close", "volume",
        unit(us + 3_599_999_000).alias("close_time"), (F.col("close") * F.col("volume")).alias("quote_volume"),
        F.col("n_ticks").alias("trades"), zero.alias("taker_buy_base"), zero.alias("taker_buy_quote"), F.lit(0).alias("ignore"),
    )
