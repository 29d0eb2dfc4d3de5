"""Near-duplicate vectors by counting collisions in one-dimensional random projections.

Each vector, scaled to unit length, gets two kinds of random projections.

* Positions on K projections, cut into windows of one width, form a cell; T
  such tables bring similar vectors into one cell with a calibrated recall and
  split the work.  K grows with the logarithm of the number of vectors, so
  cells stay small; T follows from K and the recall.
* Inside a cell every pair is compared on the other projections, the lines,
  which are not sorted: a pair collides on a line where one lies in the window
  centred on the other.  Pairs with
  enough collisions, a number calibrated by the binomial law at the threshold,
  are verified by their cosine in double precision.

A pair that shares several cells counts in the first table only, so links can
be added up without gathering pairs.  Large cells are compared in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, key_groups, written

SEED = 20240101
#: Width of a cell's windows and half width of a counting window, for unit vectors.
CELL_WIDTH, WINDOW = 2.0, 0.45
#: Lines on which collisions are counted.
LINES = 64
#: Wanted vectors in a cell, and most vectors of a block of a large cell.
CELL_ROWS, BLOCK = 64, 1024
TABLE_RECALL, COUNT_RECALL = 0.98, 0.999


def _normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def same_window(distance: float, width: float = CELL_WIDTH) -> float:
    """Probability that points at ``distance`` fall into one window of a randomly shifted line."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return 1 - 2 * _normal_cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def calibrate(n: int, threshold: float, recall: float = TABLE_RECALL) -> tuple[int, int]:
    """(K, T): projections per cell and tables for ``n`` vectors."""
    near, far = same_window(math.sqrt(2 - 2 * threshold)), same_window(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(n / CELL_ROWS, 1)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def least_collisions(threshold: float, lines: int = LINES, recall: float = COUNT_RECALL) -> int:
    """Largest count that a pair at the threshold reaches with probability ``recall`` or more."""
    p = 2 * _normal_cdf(WINDOW / math.sqrt(2 - 2 * threshold)) - 1
    tail = 0.0
    for count in range(lines, -1, -1):
        tail += math.comb(lines, count) * p**count * (1 - p) ** (lines - count)
        if tail >= recall:
            return count
    return 0


class Projections:
    """Random directions for vectors of one dimension; the same in every task."""

    def __init__(self, dimension: int, k: int, tables: int):
        rng = np.random.default_rng([SEED, dimension, k])
        self.lines = rng.standard_normal((dimension, LINES))
        self.cells = rng.standard_normal((tables, dimension, k))
        self.shift = rng.uniform(0, CELL_WIDTH, (tables, k))
        self.mixers = rng.integers(1, 1 << 62, (tables, k), dtype=np.int64) * 2 + 1
        self.salt = rng.integers(-(1 << 62), 1 << 62, tables, dtype=np.int64)

    def keys(self, unit: np.ndarray, table: int) -> np.ndarray:
        """64-bit cell keys of unit vectors in one table."""
        at = np.floor((unit @ self.cells[table] + self.shift[table]) / CELL_WIDTH).astype(np.int64)
        with np.errstate(over="ignore"):
            h = (at * self.mixers[table]).sum(axis=1) + self.salt[table]
            h = (h ^ (h >> 29)) * np.int64(0x3C79AC492BA7B653)
        return h ^ (h >> 32)


def unit_vectors(vectors: list[list[float]]) -> np.ndarray:
    """Rows scaled to length 1 (by the largest component first, so nothing overflows)."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def close_pairs(unit: np.ndarray, side: np.ndarray | None, lines: np.ndarray, threshold: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j that collide on ``least`` lines and reach the cosine; only across sides if given."""
    n = len(unit)
    at = (unit @ lines).astype(np.float32)
    step = max(1, 2_000_000 // (n * LINES))
    left, right = [], []
    for a in range(0, n, step):
        rows = at[a : a + step]
        count = (np.abs(rows[:, None, :] - at[None, a:, :]) <= WINDOW).sum(axis=2)
        i, j = np.nonzero(count >= least)
        i, j = i + a, j + a
        keep = i < j
        if side is not None:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        good = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        left.append(i[good]), right.append(j[good])
    return np.concatenate(left), np.concatenate(right)


def _cells(reps: DataFrame, k: int, tables: int) -> DataFrame:
    """(cell, rep, t): the cell of each vector in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Projections] = {}
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            vectors = batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                if d not in made:
                    made[d] = Projections(d, k, tables)
                p = made[d]
                unit = unit_vectors([vectors[i] for i in own])
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p.keys(unit, t)), pa.array(ids[own]), pa.array(np.full(len(own), t, np.int32))], names=["cell", "rep", "t"]
                    )

    return reps.select("rep", "v").mapInArrow(run, "cell long, rep long, t int")


def _links(rows: DataFrame, k: int, tables: int, threshold: float) -> DataFrame:
    """kind 0: (vector, weight of vectors linked in this block); kind 1: (a, b) of links that connect a block."""
    least = least_collisions(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Projections] = {}
        kinds, a, b = [], [], []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (kinds, a, b)], names=["kind", "a", "b"]
            )

        for _, group in key_groups(batches, "block"):
            t = group["t"][0]
            ids, weight = np.array(group["rep"], np.int64), np.array(group["w"], np.int64)
            side = np.array(group["mine"])
            sizes = np.array([len(v) for v in group["v"]])
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                if len(own) < 2:
                    continue
                if d not in made:
                    made[d] = Projections(d, k, tables)
                p, unit = made[d], unit_vectors([group["v"][i] for i in own])
                across = side[own] if group["cross"][0] else None
                i, j = close_pairs(unit, across, p.lines, threshold, least)
                if len(i) and t:
                    some, at = np.unique(np.concatenate((i, j)), return_inverse=True)
                    at_i, at_j = at[: len(i)], at[len(i) :]
                    fresh = np.ones(len(i), bool)
                    for earlier in range(t):
                        key = p.keys(unit[some], earlier)
                        fresh &= key[at_i] != key[at_j]
                    i, j = i[fresh], j[fresh]
                if not len(i):
                    continue
                count = np.bincount(i, weight[own][j], len(own)) + np.bincount(j, weight[own][i], len(own))
                some = np.flatnonzero(count)
                kinds.append(np.zeros(len(some), np.int64)), a.append(ids[own][some]), b.append(count[some].astype(np.int64))
                # a spanning forest of the block's links
                root = list(range(len(own)))
                keep = []
                for n, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    while root[y] != y:
                        root[y] = root[root[y]]
                        y = root[y]
                    if x != y:
                        root[y] = x
                        keep.append(n)
                kinds.append(np.ones(len(keep), np.int64)), a.append(ids[own][i[keep]]), b.append(ids[own][j[keep]])
            if len(a) > 1000:
                yield flush()
                kinds.clear(), a.clear(), b.clear()
        yield flush()

    return rows.mapInArrow(run, "kind long, a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors link when found with a cosine of at least ``threshold``; equal
    vectors are one vector with a weight.  Vectors that are null, empty or
    zero, or that hold null, NaN or infinite components, and rows with a null
    id link with nothing and are kept; vectors of different lengths do not
    link.  Rows that repeat an id count as separate vectors.  Other columns are
    ignored; an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    valid = F.col("vec_id").isNotNull() & whole & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    plain = F.transform("v", lambda x: x + F.lit(0.0))  # no negative zero
    good = written(rows.where(valid).groupBy(plain.alias("v")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w")), "vectors")
    k, tables = calibrate(good.count(), threshold)
    cells = written(_cells(good, k, tables), "vector-cells")
    sizes = cells.groupBy("cell", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK)
    placed = cells.join(sizes, ["cell", "t"]).withColumn("mine", F.pmod(F.xxhash64("rep", "t"), parts))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    placed = placed.select(
        "rep", "t", "mine", (F.col("mine") != F.col("other")).alias("cross"),
        F.xxhash64("cell", "t", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"),
    )
    # a cross block needs both of its sides; blocks are also the place where two keys may meet, which only adds comparisons
    full = placed.join(good, "rep").repartition("block").sortWithinPartitions("block", "rep")
    found = written(_links(full, k, tables, threshold), "vector-links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    tied = components(found.where("kind = 1").select("a", "b"))
    own = good.join(counts, "rep", "left").join(tied, F.col("rep") == F.col("id"), "left")
    own = own.select(F.col("v").alias("_v"), "w", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "rep").alias("c"))
    out = rows.withColumn("_key", F.when(valid, plain)).join(own, F.col("_key") == F.col("_v"), "left")
    component = F.coalesce("c", "vec_id")
    return out.select(
        "vec_id", F.coalesce(F.col("others") + F.col("w") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
