"""Helpers shared by the operators: tables, written stages, two-level ranks, connected components."""

from __future__ import annotations

import gc
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

_COUNT = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark).rstrip('/')}/llm/{spark.sparkContext.applicationId}/{next(_COUNT)}-{name}"
    free_shuffles(spark)  # those of the last table: as it ended, Spark's listeners could still hold them
    df.write.option("compression", "zstd").parquet(path)
    del df
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path).withMetadata(schema.names[0], {"path": path})


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished stages now, not at its next periodic collection."""
    gc.collect()
    spark._jvm.System.gc()


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    path = df.schema[0].metadata.get("path")
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


#: Bits of the bitmap of hashed ids that :func:`with_ids` sends to the tasks (4 MB).
ID_BITS = 1 << 25


def with_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is in ``ids`` (one column of integers, which may repeat).

    A plain semi join would shuffle all of ``df``, texts and all, for the few rows
    that it keeps.  A bitmap of the hashed ids lets nearly all others go before;
    its size is fixed, and the join that follows is exact.
    """
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(ID_BITS)) + 1
    name = ids.columns[0]
    spots = ids.select(spot(name).alias("_spot")).select(F.bitmap_bucket_number("_spot").alias("_bucket"), F.bitmap_bit_position("_spot").alias("_bit"))
    # dealt out first: ids are shuffled, not a bitmap of each task
    maps = spots.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    rows = df.withColumn("_bucket", F.bitmap_bucket_number(spot(id_col))).withColumn("_bit", F.bitmap_bit_position(spot(id_col)).cast("int"))
    byte = F.conv(F.hex(F.expr("substring(_bits, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    near = rows.join(F.broadcast(maps), "_bucket").where(F.getbit(byte, F.col("_bit") % 8) == 1).select(*df.columns)
    # an inner join: a semi join would be pushed below the bitmap
    return near.join(ids.select(F.col(name).alias("_id")).distinct(), near[id_col] == F.col("_id")).select(*df.columns)


def dense_rank_in(df: DataFrame, group: str, order: list[Column], bucket: Column, out: str) -> DataFrame:
    """``out``: gapless position from 0 of each row in its ``group``.

    No group is sorted in one task: rows are ordered inside (group, bucket)
    cells only, and the cells' row counts are added up.  ``bucket`` must cut
    every group evenly (a hash of the key).
    """
    from pyspark.sql import Window

    rows = df.withColumn("_cell", bucket)
    sizes = rows.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(
        F.col(group).alias("_group"), F.col("_cell").alias("_base_cell"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    inside = rows.withColumn("_pos", F.row_number().over(Window.partitionBy(group, "_cell").orderBy(*order)) - 1)
    joined = inside.join(base, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_cell") == F.col("_base_cell")))
    return joined.withColumn(out, (F.col("_base") + F.col("_pos")).cast("long")).drop("_cell", "_pos", "_group", "_base_cell", "_base")


#: So many edges are joined up by one task, in memory; more go through rounds of stars.
LOCAL_EDGES = 1_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): smallest id reachable from each id that has an edge.

    Beyond ``LOCAL_EDGES``, every round replaces the edges by stars: each
    vertex is tied to the smallest vertex it or its neighbours know (large
    stars, then small stars), so path lengths shrink geometrically, and so do
    the edges where they hold loops.  The edges of a round are a written table;
    a vertex with very many neighbours is only ever aggregated with map-side
    combine and joined on, never gathered.  The rounds end with stars or with
    few enough edges for one task of bounded size.
    """
    own = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    last = None
    while own.limit(LOCAL_EDGES + 1).count() > LOCAL_EDGES:
        # large star: every larger neighbour of x is tied to the smallest of x's neighbourhood
        both = own.select("u", "v").union(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # small star: every smaller neighbour of x, and x, is tied to the smallest of them
        down = large.distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = written(small.where("u != v").distinct(), "edges")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last is not None:
            drop_written(own)
        own = new
        if now == last:
            out = own.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return out.union(own.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        last = now
    return written(own.coalesce(1).mapInArrow(_joined, "id long, component long"), "components")


def _joined(batches):
    """Union-find over a bounded number of edges."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(u) if u in root else root.setdefault(u, u), find(v) if v in root else root.setdefault(v, v)
            if x != y:
                root[max(x, y)] = min(x, y)
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(i) for i in ids], pa.int64())], names=["id", "component"])


def key_groups(batches, key: str):
    """(key, {column: values}) of each run of equal ``key`` in key-sorted Arrow batches.

    One group is held at a time; callers bound the size of a group.
    """
    current, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        keys = columns[key]
        begin = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[begin]:
                if held is not None and keys[begin] == current:
                    for n, v in columns.items():
                        held[n] += v[begin:i]
                else:
                    if held is not None:
                        yield current, held
                    current, held = keys[begin], {n: v[begin:i] for n, v in columns.items()}
                begin = i
    if held is not None:
        yield current, held
