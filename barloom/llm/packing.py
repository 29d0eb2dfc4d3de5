"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_rank_in

CAPACITIES = (512, 1024, 2048, 4096)
#: More runs than this would not be broadcast; the number is bounded by the capacities, not by the documents.
MOST_RUNS = 500_000


def default_cost(capacity: int) -> float:
    """Cost of a sequence: a fixed part, its tokens, and attention growing with the square."""
    return 64 + capacity + capacity * capacity / 65536


@dataclass(frozen=True)
class Run:
    """Items of one length and ranks first..last: ``each`` of them to a bin, from ``bin`` on, the first at ``offset``."""

    length: int
    first: int
    last: int
    bin: int
    each: int
    offset: int
    capacity: int


def plan(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = default_cost) -> list[Run]:
    """Variable-capacity best-fit decreasing for ``counts[length]`` items of each length.

    Items go, longest first, to the open bin with the least room that fits.
    If none fits, bins of the permitted size are opened whose cost per token of
    such items is least.  At last every bin shrinks to the smallest permitted
    size that holds its contents.  Equal bins are one group, so the work
    depends on the capacities, never on the number of items.
    """
    sizes = sorted(set(capacities))
    if not sizes or sizes[0] < 1:
        raise ValueError("capacities must be positive")
    rooms: list[tuple[int, int, int, int]] = []  # (room, first bin, bins, used), sorted
    closed: list[tuple[int, int, int]] = []  # (first bin, bins, used)
    raw: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, items, bin, each, offset
    opened = 0
    shortest = min((k for k, n in counts.items() if n), default=1)

    def put_back(room: int, first: int, bins: int, used: int) -> None:
        if bins:
            if room >= shortest:
                insort(rooms, (room, first, bins, used))
            else:
                closed.append((first, bins, used))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        if length > sizes[-1] or length < 1:
            raise ValueError(f"length {length} is outside 1..{sizes[-1]}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, (length, -1, 0, 0))
            if at < len(rooms):
                room, first, bins, used = rooms.pop(at)
            else:
                room = min((c for c in sizes if c >= length), key=lambda c: (cost(c) / (c // length * length), -c))
                first, bins, used = opened, -(-left // (room // length)), 0
                opened += bins
            each = room // length
            full = min(bins, left // each)
            if full:
                raw.append((length, rank, full * each, first, each, used))
                put_back(room - each * length, first, full, used + each * length)
                rank, left = rank + full * each, left - full * each
            rest = bins - full
            if rest and left:  # fewer items than the next bin could take
                raw.append((length, rank, left, first + full, each, used))
                put_back(room - left * length, first + full, 1, used + left * length)
                full, rest, left = full + 1, rest - 1, 0
            put_back(room, first + full, rest, used)
    final = sorted(closed + [(first, bins, used) for _, first, bins, used in rooms])
    starts = [f[0] for f in final]
    out = []
    for length, rank, items, first, each, offset in raw:
        # cut where the final capacity changes
        last_bin = first + (items - 1) // each
        at = bisect_left(starts, first + 1) - 1
        here = first
        while here <= last_bin:
            group_first, bins, used = final[at]
            stop = min(last_bin, group_first + bins - 1)
            low, high = rank + (here - first) * each, min(rank + items, rank + (stop - first + 1) * each) - 1
            size = sizes[bisect_left(sizes, used)]
            if out and out[-1].length == length and out[-1].capacity == size and out[-1].last == low - 1 and out[-1].each == each and (
                out[-1].offset == offset and out[-1].bin + (low - out[-1].first) // each == here and (low - out[-1].first) % each == 0
            ):
                out[-1] = Run(length, out[-1].first, high, out[-1].bin, each, offset, size)
            else:
                out.append(Run(length, low, high, here, each, offset, size))
            here, at = stop + 1, at + 1
    return out


def word_count(text: Column) -> Column:
    """Words of a text and one end mark: at least 1, also for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None,
    capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = default_cost, cells: int = 4096,
) -> DataFrame:
    """doc_id, piece, start, length, bin_id, capacity, offset: where each part of each document goes.

    A document is one item of ``length`` tokens (words and an end mark by
    default); one longer than the largest capacity is cut there, and its parts
    are packed like documents.  Only the counts by length, at most as many rows
    as the largest capacity, are planned on the driver; items find their bin by
    their rank among those of the same length.

    Null and empty texts are items of length 1; a null or non-positive length
    counts as 1.  Repeated rows are packed each; other columns are ignored; an
    empty table gives no rows.
    """
    top = max(capacities)
    size = word_count(F.col(text_col)) if length is None else length
    items = df.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("long").alias("total"))
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("total") - 1) / top).cast("int"))))
    items = items.select(
        "doc_id", "piece", (F.col("piece") * F.lit(top)).cast("long").alias("start"),
        F.least(F.lit(top), F.col("total") - F.col("piece") * F.lit(top)).cast("int").alias("length"),
    )
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    runs = plan(counts, capacities, cost)
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(r.length, r.first, r.last, r.bin, r.each, r.offset, r.capacity) for r in runs],
        "_length int, _first long, _last long, _bin long, _each int, _offset long, capacity int",
    )
    if len(runs) <= MOST_RUNS:
        table = F.broadcast(table)
    ranked = dense_rank_in(
        items, "length", [F.col("doc_id"), F.col("piece")], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(cells)), "_rank"
    )
    fits = (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last"))
    order = F.col("_rank") - F.col("_first")
    return ranked.join(table, fits).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
        (F.col("_bin") + F.floor(order / F.col("_each"))).cast("long").alias("bin_id"), "capacity",
        (F.col("_offset") + order % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )
