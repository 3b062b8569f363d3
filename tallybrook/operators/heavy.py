"""Frequent values: exact, or with a bounded number of counters."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check(k: int, capacity: int | None) -> int:
    if k <= 0:
        raise ValueError("top must be a positive integer")
    capacity = capacity or max(10 * k, 1000)
    if capacity < k:
        raise ValueError("capacity must be at least top")
    return capacity


def ranked(counts: DataFrame, k: int) -> DataFrame:
    """rank, item, count_estimate: the most frequent first, then the smaller item. The window sees k rows only."""
    best = counts.orderBy(F.desc("count_estimate"), F.asc("item")).limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("count_estimate"), F.asc("item")))
    return best.select(place.cast("int").alias("rank"), "item", "count_estimate")


def exact(df: DataFrame, item: str, k: int = 10) -> DataFrame:
    check(k, None)
    some = df.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"))
    return ranked(some.groupBy("item").agg(F.count("*").alias("count_estimate")), k)


def space_saving(items, capacity: int) -> dict[str, int]:
    """Counters after a stream: a full table gives the least counter (of the smallest item) to a newcomer, plus one."""
    counts: dict[str, int] = {}
    heap: list[tuple[int, str]] = []
    for x in items:
        if x in counts:
            counts[x] += 1  # its heap entry is out of date from now on
        elif len(counts) < capacity:
            counts[x] = 1
            heapq.heappush(heap, (1, x))
        else:
            while True:
                n, old = heapq.heappop(heap)
                now = counts.get(old)
                if now == n:
                    break
                if now is not None:
                    heapq.heappush(heap, (now, old))
            del counts[old]
            counts[x] = n + 1
            heapq.heappush(heap, (n + 1, x))
    return counts


def bounded(df: DataFrame, item: str, k: int = 10, capacity: int | None = None, order: list | None = None) -> DataFrame:
    """Counters of one pass over all rows in ``order`` (as they come, if none is given).

    The algorithm is one pass over one stream, so this runs in one task that holds ``capacity`` counters, and gives
    the numbers that a single program gives. ``merged`` is the form for large inputs.
    """
    capacity = check(k, capacity)
    some = df.filter(F.col(item).isNotNull())
    stream = (some.orderBy(*order) if order else some).select(F.col(item).cast("string").alias("item")).coalesce(1)

    def run(batches):
        import pyarrow as pa

        counts = space_saving((x for b in batches for x in b.column(0).to_pylist()), capacity)
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:k]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["item", "count_estimate"])

    return ranked(stream.mapInArrow(run, "item string, count_estimate long"), k)


def merged(df: DataFrame, item: str, k: int = 10, capacity: int | None = None) -> DataFrame:
    """A pass of its own in each task, whose counters are added up by item: rows to shuffle are ``capacity`` for each task.

    Exact while a task sees no more than ``capacity`` items; else an item's count is off by no more than rows / capacity.
    """
    capacity = check(k, capacity)

    def run(batches):
        import pyarrow as pa

        counts = space_saving((x for b in batches for x in b.column(0).to_pylist()), capacity)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["item", "n"])

    some = df.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"))
    return ranked(some.mapInArrow(run, "item string, n long").groupBy("item").agg(F.sum("n").alias("count_estimate")), k)


def native(df: DataFrame, item: str, k: int = 10, capacity: int = 1000) -> DataFrame:
    """The engine's own sketch. It may return fewer than k rows and leaves the order of ties open."""
    check(k, capacity)
    found = df.filter(F.col(item).isNotNull()).agg(F.expr(f"approx_top_k(cast(`{item}` as string), {k}, {capacity})").alias("t")).select(F.explode("t").alias("x"))
    return ranked(found.select(F.col("x.item").alias("item"), F.col("x.count").alias("count_estimate")), k)
