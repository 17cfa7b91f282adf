"""Items in containers of a fixed capacity, with little unused space.

A dynamic programme over the global histogram of sizes chooses the bucket
boundaries that minimise padding, which is the room lost by counting each item
as large as its bucket's upper boundary. Batches under the token budget then
form from the largest bucket down: a container takes from its own bucket what
fits and is topped up from the largest smaller buckets that still fit. This
plan is made from bucket counts alone, at most BUCKETS of them, on the driver;
the items find their container by their rank in the bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256
#: Items to a rank chunk, so that a bucket with a third of all items is ranked
#: in many tasks.
CHUNK_ITEMS = 50_000


def bucket_bounds(histogram: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper boundaries of at most ``buckets`` size buckets with least padding.

    ``histogram[s]`` counts the items of size ``s``; sizes run from 0 to the
    capacity. The last boundary is the largest size that occurs.
    """
    sizes = np.flatnonzero(histogram)
    if len(sizes) <= buckets:
        return [int(s) for s in sizes]
    n = histogram[sizes].astype(float)
    cn, cs = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * sizes)]
    m = len(sizes)
    # cost[i, j]: padding of the bucket with the sizes i..j-1
    cost = np.full((m + 1, m + 1), np.inf)
    for j in range(1, m + 1):
        cost[:j, j] = sizes[j - 1] * (cn[j] - cn[:j]) - (cs[j] - cs[:j])
    best, back = cost[0].copy(), []
    best[0] = 0
    for _ in range(buckets - 1):
        total = best[:, None] + cost
        back.append(total.argmin(axis=0))
        best = np.minimum(total.min(axis=0), np.inf)
        best[0] = 0
    out, j = [], m
    for arg in reversed(back):
        if j == 0:
            break
        out.append(int(sizes[j - 1]))
        j = int(arg[j])
    if j:
        out.append(int(sizes[j - 1]))
    return sorted(set(out))


@dataclass
class Run:
    """Ranks ``first`` up to ``end`` of a bucket: ``each`` to a container from ``container`` on."""

    bound: int
    first: int
    end: int
    container: int
    each: int


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs that place ``counts[bound]`` items of size ``bound`` each.

    Best fit by decreasing size over groups of equal containers: a bucket's
    items go first where the least room is left, as many to a container as fit.
    """
    groups: list[list[int]] = []  # room, first container, number of containers
    runs, containers = [], 0
    for bound in sorted(counts, reverse=True):
        left, rank = counts[bound], 0
        size = max(bound, 1)
        for g in sorted((g for g in groups if g[0] >= size), key=lambda g: g[0]):
            if not left:
                break
            left, rank = _fill(groups, g, bound, size, left, rank, runs)
        while left:
            each = capacity // size
            if each < 1:
                raise ValueError("an item is larger than the capacity")
            g = [capacity, containers, -(-left // each)]
            containers += g[2]
            groups.append(g)
            left, rank = _fill(groups, g, bound, size, left, rank, runs)
    return runs


def _fill(groups: list, g: list[int], bound: int, size: int, left: int, rank: int, runs: list[Run]) -> tuple[int, int]:
    each = g[0] // size
    full = min(g[2], left // each)
    groups.remove(g)
    room, first, number = g
    if full:
        runs.append(Run(bound, rank, rank + full * each, first, each))
        groups.append([room - each * size, first, full])
        rank, left = rank + full * each, left - full * each
    if full < number and left and left < each:
        runs.append(Run(bound, rank, rank + left, first + full, left))
        groups.append([room - left * size, first + full, 1])
        rank, left, full = rank + left, 0, full + 1
    if full < number:
        groups.append([room, first + full, number - full])
    return left, rank


def parts(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """``key``, ``teil``, ``tokens``: items as they are, one larger than the
    capacity in parts of the capacity and a rest."""
    cut = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    return sizes.select(key, "tokens", F.explode(F.sequence(F.lit(0), cut - 1)).alias("teil")).select(
        key, "teil", F.least(F.lit(capacity), F.col("tokens") - F.col("teil").cast("bigint") * capacity).alias("tokens")
    )


def pack(sizes: DataFrame, key: str, capacity: int, buckets: int = BUCKETS) -> DataFrame:
    """``behaelter``, ``key``, ``teil``, ``tokens``: every item in a container.

    ``sizes`` has a unique ``key`` and ``tokens``, and should be stored, as it is
    read twice. Items without tokens are placed too. An empty table gives no
    rows. The same items give the same containers.
    """
    spark = sizes.sparkSession
    items = parts(sizes, key, capacity)
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in items.groupBy("tokens").count().collect():  # at most capacity + 1 rows
        histogram[r["tokens"]] = r["count"]
    bounds = bucket_bounds(histogram, buckets)
    edges = np.searchsorted(bounds, np.arange(capacity + 1)) if bounds else np.zeros(capacity + 1, int)
    counts = {b: int(histogram[: b + 1].sum() - (histogram[: bounds[i - 1] + 1].sum() if i else 0)) for i, b in enumerate(bounds)}
    runs = plan(counts, capacity)
    chunks = int(max(1, min(4096, histogram.sum() // CHUNK_ITEMS)))
    upper = F.element_at(F.array(*[F.lit(int(bounds[min(e, len(bounds) - 1)]) if bounds else 0) for e in edges]), F.col("tokens").cast("int") + 1)
    ranked = items.withColumn("bound", upper).withColumn("chunk", F.pmod(F.xxhash64(key, "teil"), F.lit(chunks)))
    before = ranked.groupBy("bound", "chunk").count().select(
        "bound", "chunk", (F.sum("count").over(Window.partitionBy("bound").orderBy("chunk")) - F.col("count")).alias("before")
    )
    rank = F.row_number().over(Window.partitionBy("bound", "chunk").orderBy(key, "teil"))
    # before has at most buckets * chunks rows, the plan a few runs to a bucket
    placed = ranked.withColumn("r", rank).join(F.broadcast(before), ["bound", "chunk"]).withColumn("r", F.col("before") + F.col("r") - 1)
    table = spark.createDataFrame([(r.bound, r.first, r.end, r.container, r.each) for r in runs], "b int, first bigint, end bigint, container bigint, each bigint")
    return placed.join(F.broadcast(table), (F.col("bound") == F.col("b")) & (F.col("r") >= F.col("first")) & (F.col("r") < F.col("end"))).select(
        (F.col("container") + F.floor((F.col("r") - F.col("first")) / F.col("each"))).alias("behaelter"), key, "teil", "tokens"
    )
