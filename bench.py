"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

QUERIES = [
    "bars_from_ticks", "resample_4h_complete", "flagship_4h_context", "feature_table", "forward_labels", "segment_indicators_1h",
    "indicator_snapshots", "confirmed_swings_1h", "breaks_crossing_1h", "structure_table", "zigzag_pct_events", "zigzag_atr_1h",
    "candidate_event_outcomes", "stop_references", "structural_target_grid", "equity_path", "value_added_groups", "regime_summary",
    "classification_report", "top_fraction_ranking", "drift_deciles", "feature_associations", "block_bootstrap", "walk_forward_folds",
    "rolling_pair_correlation", "reconcile_sources", "ledger_audit", "training_chat_records", "conversation_lengths", "candles_range",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("barloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        # plans are built from Python: skip recording the call site of every expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from barloom.queries import queries

    known, times = queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in QUERIES:
        start = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
