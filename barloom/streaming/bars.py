"""Streaming bars and zigzag: the batch operators on an unbounded input."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.structure import ZIGZAG_PCT_SCHEMA, zigzag_pct_step
from ..plans.blocks import epoch_us


def stream_bars(ticks: DataFrame, every: str, *, parts: int, part: str = "hour", late: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """Complete bars from a tick stream, emitted once, after their close.

    Append mode with a watermark is the availability rule of the batch bars: a
    bar shows only when no tick of it can still arrive.  A bar is complete if
    each of its ``parts`` sub-periods has a tick; later ticks are dropped.
    """
    at = F.col("_at")
    order = epoch_us(at).cast("decimal(19,0)") * F.expr("10000000000000000000BD") + F.col("event_id").cast("decimal(19,0)")
    rows = ticks.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late).withColumn("_ord", order.cast("decimal(38,0)"))
    bars = rows.groupBy("symbol", F.window("_at", every)).agg(
        F.min_by("price", "_ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "_ord").alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_ticks"), F.size(F.collect_set(F.date_trunc(part, at))).alias("_parts"),
    )
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    return bars.filter(F.col("_parts") == parts).select(
        "symbol", ntz("window.start").alias("timestamp"), ntz("window.end").alias("known_at"), "open", "high", "low", "close", "volume", "n_ticks"
    )


class _OrderedZigzag(StatefulProcessor):
    """Bars wait in keyed state until the watermark has passed them, then go through the zigzag in time order."""

    def __init__(self, f: float, at: str):
        self.f, self.at = f, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "high double, low double, close double")
        self.reached = handle.getValueState("reached", "at long, zigzag string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.reached.get()[0] if self.reached.exists() else None
        first = None
        for pdf in rows:
            stamps = pdf["micros"].tolist()
            for t, h, l, c in zip(stamps, pdf["high"].tolist(), pdf["low"].tolist(), pdf["close"].tolist()):
                if done is None or t > done:
                    self.waiting.updateValue((t,), (h, l, c))
                    first = t if first is None else min(first, t)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = [], None
        for (t,), bar in self.waiting.iterator():
            if t <= upto:
                ready.append((t, *bar))
            else:
                rest = t if rest is None else min(rest, t)
        if rest is not None:
            self.handle.registerTimer(-(-rest // 1000))
        if not ready:
            return
        rows = pd.DataFrame(sorted(ready), columns=[self.at, "high", "low", "close"])
        before = json.loads(self.reached.get()[1]) if self.reached.exists() else None
        stamps = rows[self.at].tolist()
        rows[self.at] = pd.to_datetime(rows[self.at], unit="us")
        out, after = zigzag_pct_step(rows, before, self.f, self.at)
        self.reached.update((stamps[-1], json.dumps(after)))
        for t in stamps:
            self.waiting.removeKey((t,))
        if len(out):
            out.insert(0, "symbol", key[0])
            yield out


def stream_zigzag(bars: DataFrame, *, pct: float, at: str = "known_at", late: str = "1 hour") -> DataFrame:
    """Zigzag events from a bar stream, whatever the order in which bars come.

    A bar waits in the keyed state of its symbol until the watermark, ``late``
    behind the newest bar, has passed it; then a timer sends the waiting bars
    through the zigzag in time order.  So events are the same for any split
    into triggers, as long as no bar is more than ``late`` behind; later bars
    are dropped.  Of two bars of one time the last to arrive counts; bars
    without a time are left out.  Keeps its state in RocksDB (set for the
    session): what waits is bounded by ``late``, not by memory.
    """
    bars.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    # names must not begin with an underscore: rows are named tuples on their way
    timed = bars.filter(F.col(at).isNotNull()).select("symbol", F.col(at).cast("timestamp").alias("event_at"), epoch_us(F.col(at)).alias("micros"), "high", "low", "close")
    return timed.withWatermark("event_at", late).groupBy("symbol").transformWithStateInPandas(
        _OrderedZigzag(pct / 100.0, at), f"symbol string, {ZIGZAG_PCT_SCHEMA}", "Append", "EventTime"
    )


def run_to_parquet(stream: DataFrame, path: str) -> DataFrame:
    """Drain what is available now into parquet and read it back."""
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_stream")
        .option("path", f"{path}/rows").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
