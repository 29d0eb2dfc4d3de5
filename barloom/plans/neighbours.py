"""Exact nearest neighbours in a k-d tree of written tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ranks import rank_by_score

#: Rows of a leaf, and children of an inner node.
CELL_ROWS, FAN = 2048, 16


def _tree(points: DataFrame, cols: list[str], by: list[str], id: str, cell_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """The points with their leaf ``_cell``, and per level the children (at most ``FAN``) of each node with their boxes.

    Every level cuts each node that is too large into equal parts by the rank
    of one coordinate, the coordinates in turn; ranks, not values, are cut, so
    tied coordinates do not make a large leaf.
    """
    clock = F.lit("1970-01-01").cast("timestamp_ntz")
    own = materialise(points.select(*by, id, *cols, F.lit(0).cast("long").alias("_cell")), "kd-points")
    depth = 0
    while True:
        sizes = own.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_all"))
        if not sizes.where(F.col("_all") > cell_rows).limit(1).count():
            break
        ranked = rank_by_score(own.withColumn("_tie_at", clock), [*by, "_cell"], cols[depth % len(cols)], ["_tie_at", id])
        fan = F.least(F.lit(FAN), F.ceil(F.col("_all") / cell_rows))
        part = F.floor(F.col("_i") * fan / F.col("_all"))
        own = materialise(ranked.join(sizes, [*by, "_cell"]).select(*by, id, *cols, (F.col("_cell") * FAN + part).cast("long").alias("_cell")), "kd-points")
        depth += 1
    lo, hi = [F.min(c).alias(f"lo_{i}") for i, c in enumerate(cols)], [F.max(c).alias(f"hi_{i}") for i, c in enumerate(cols)]
    boxes = own.groupBy(*by, "_cell").agg(*lo, *hi, F.count(F.lit(1)).alias("n"))
    sides = [f"{side}_{i}" for side in ("lo", "hi") for i in range(len(cols))]
    levels = []
    for _ in range(depth):
        boxes = materialise(boxes, "kd-boxes")
        up = boxes.withColumn("_up", F.floor(F.col("_cell") / FAN))
        kids = up.groupBy(*by, "_up").agg(F.collect_list(F.struct("_cell", "n", *sides)).alias("_kids")).withColumnRenamed("_up", "_cell")
        levels.append(kids)
        edges = [(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in sides]
        boxes = up.groupBy(*by, "_up").agg(*edges, F.sum("n").alias("n")).withColumnRenamed("_up", "_cell")
    return own, levels[::-1]


def nearest(
    queries: DataFrame, points: DataFrame, cols: Sequence[str], *, by: Sequence[str], id: str, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """(by, id, distance) of every query row to its nearest point with another id.

    A query goes down the tree to its nearest leaf, a join per level on the
    node it is in; the distance found there bounds the answer.  Then it goes
    down again into every box closer than that bound and visits those leaves.
    So no two tables are paired whole, a query row carries one node at a time,
    and the result is exact.  Query rows of a busy leaf are salted over tasks.
    Points with a null coordinate are no one's neighbours; a query without
    another point in its group has a null distance, one whose group has no
    point no row.
    """
    by, cols = list(by), list(cols)
    whole = points
    for c in cols:
        whole = whole.where(F.col(c).isNotNull())
    cells, levels = _tree(whole, cols, by, id, cell_rows)

    def gap(kid: Column) -> Column:
        total = F.lit(0.0)
        for i, c in enumerate(cols):
            d = F.greatest(kid[f"lo_{i}"] - F.col(c), F.col(c) - kid[f"hi_{i}"], F.lit(0.0))
            total = total + d * d
        return F.sqrt(total)

    q = queries.select(*by, F.col(id).alias("_qid"), *cols).join(cells.select(*by).distinct(), by, "left_semi").withColumn("_cell", F.lit(0).cast("long"))
    for kids in levels:
        # a box with a single row may hold the query alone, which gives no bound
        order = F.transform("_kids", lambda k: F.struct(F.when(k["n"] > 1, gap(k)).otherwise(F.lit(1e308)).alias("d"), k["_cell"].alias("c")))
        q = q.join(kids, [*by, "_cell"]).withColumn("_cell", F.array_min(order)["c"]).drop("_kids")
    q = materialise(q, "nn-queries")
    bound = materialise(_visit(q, cells, cols, by, id), "nn-bound")
    rest = q.join(bound, [*by, "_qid"]).withColumnRenamed("_cell", "_home").withColumn("_cell", F.lit(0).cast("long"))
    for kids in levels:
        near = F.filter("_kids", lambda k: gap(k) < F.coalesce(F.col("_d"), F.lit(1e308)))
        rest = rest.join(kids, [*by, "_cell"]).withColumn("_cell", F.explode(F.transform(near, lambda k: k["_cell"]))).drop("_kids")
    rest = materialise(rest.where("_cell != _home").select(*by, "_qid", *cols, "_cell"), "nn-visits")
    both = bound.unionByName(_visit(rest, cells, cols, by, id))
    return both.groupBy(*by, "_qid").agg(F.min("_d").alias("distance")).withColumnRenamed("_qid", id)


def _visit(q: DataFrame, cells: DataFrame, cols: list[str], by: list[str], id: str) -> DataFrame:
    """Smallest distance from each query row to the rows of its cell."""
    load = q.groupBy(*by, "_cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("_salts"))
    salted = q.join(load, [*by, "_cell"]).withColumn("_salt", F.pmod(F.xxhash64("_qid"), F.col("_salts").cast("long")).cast("int")).drop("_salts")
    copies = cells.join(load, [*by, "_cell"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    keys = [*by, "_cell", "_salt"]
    types = dict(q.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, "_qid"]) + ", _d double"

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame(columns=[*by, "_qid", "_d"])
        a, b = left[cols].to_numpy(float), right[cols].to_numpy(float)
        ids, best = right[id].to_numpy(), np.full(len(a), np.inf)
        asked = left["_qid"].to_numpy()
        for i in range(0, len(a), 256):
            for j in range(0, len(b), CELL_ROWS):
                d = ((a[i : i + 256, None, :] - b[None, j : j + CELL_ROWS, :]) ** 2).sum(axis=2)
                d[asked[i : i + 256, None] == ids[None, j : j + CELL_ROWS]] = np.inf
                best[i : i + 256] = np.minimum(best[i : i + 256], np.sqrt(d.min(axis=1)))
        out = left[[*by, "_qid"]].copy()
        out["_d"] = np.where(np.isfinite(best), best, np.nan)
        return out

    return salted.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(measure, schema)
