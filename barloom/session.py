"""Session settings and materialised intermediate tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple[str, str, str], str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """All clocks are UTC; bar times are TIMESTAMP_NTZ end to end."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: ``spark.checkpoint.dir``.

    A machine-local temporary folder is used only by a local master, where
    driver and executors share one disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can read")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-barloom-"))
    return spark.sparkContext.getCheckpointDir()


def stage(
    spark: SparkSession, scope: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Write ``build()`` once per application and read it back.

    This is the one materialisation point between a long producer (features,
    labels) and its many consumers: lineage is cut, an executor loss costs a
    re-read, and every consumer gets a pruned, filterable parquet scan.
    """
    key = (spark.sparkContext.applicationId, scope, name)
    path = _STAGED.get(key)
    if path is None:
        root = f"{shared_dir(spark).rstrip('/')}/barloom/{key[0]}/{len(_STAGED)}-{name}"
        build().write.mode("overwrite").option("compression", "zstd").parquet(root)
        _STAGED[key] = path = root
    return spark.read.parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Written copy of ``df`` (used between rounds of iterative plans)."""
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, "round", f"{name}-{len(_STAGED)}")
    root = f"{shared_dir(spark).rstrip('/')}/barloom/{key[0]}/{key[2]}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(root)
    _STAGED[key] = root
    return spark.read.parquet(root)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, read by every later branch.

    Used where a plan needs the same rows twice (rows plus their per-block
    summary), so chained operators cost the sum of their work, not the
    product.  The checkpoint keeps the hash partitioning: the summary and the
    join back need no further shuffle of the rows.
    """
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    key = (spark.sparkContext.applicationId, "scratch", f"{name}-{len(_STAGED)}")
    _STAGED[key] = path = f"{shared_dir(spark).rstrip('/')}/barloom/{key[0]}/{key[2]}"
    return path
