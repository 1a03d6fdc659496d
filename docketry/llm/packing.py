"""Items of varying size in containers of fixed capacity, by Karmarkar-Karp multiway differencing in blocks."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that are balanced together, at least; where that fills fewer containers than BLOCK_CONTAINERS, as many as do.
BLOCK_ITEMS = 256
#: What a block leaves open is part of one container beyond what its sizes force, so of this many a small share.
BLOCK_CONTAINERS = 50
#: Items of a block, at most, for capacities of thousands of documents; bounds a task (about 2 kB an item).
MOST_BLOCK_ITEMS = 100_000
#: Capacities that are packed in one pass over the items.
MOST_CAPACITIES = 1000


def differenced(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part, 0 to k - 1, of each item after multiway differencing; parts have nearly equal sums.

    Every item begins as a partition of its own with k parts, all empty but one. The two partitions that differ most
    between their largest and smallest part are merged, largest part to smallest, until one is left. Items in a part
    are chained, so a merge is a few vector operations of length k.
    """
    n = len(sizes)
    chain = np.full(n, -1)
    heap = []
    for i in range(n):
        sums, heads = np.zeros(k, np.int64), np.full(k, -1)
        sums[0], heads[0] = sizes[i], i
        heap.append((-int(sizes[i]) if k > 1 else 0, i, sums, heads, heads.copy()))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, s, h, t = heapq.heappop(heap)
        _, _, s2, h2, t2 = heapq.heappop(heap)
        s2, h2, t2 = s2[::-1], h2[::-1], t2[::-1]
        both = (h >= 0) & (h2 >= 0)
        chain[t[both]] = h2[both]
        sums, heads, tails = s + s2, np.where(h >= 0, h, h2), np.where(h2 >= 0, t2, t)
        order = np.argsort(-sums, kind="stable")
        sums, heads, tails = sums[order], heads[order], tails[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), i, sums - sums[-1], heads, tails))
    part = np.zeros(n, np.int64)
    for number, item in enumerate(heap[0][3] if heap else ()):
        while item >= 0:
            part[item] = number
            item = chain[item]
    return part


def packed(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A container number for each item of 0 < size <= capacity, none filled beyond capacity.

    The number of windows starts at the least that could do. Where differencing leaves one above the capacity, it gives
    up the smallest item that makes it fit; what was given up goes, largest first, where it leaves least room, and the
    number of windows rises for the rest, which are differenced among themselves.
    """
    k = max(1, -(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    if k >= len(sizes):
        return np.arange(len(sizes))
    part = differenced(sizes, k)
    room = capacity - np.bincount(part, sizes, k).astype(np.int64)
    out: list[int] = []
    for b in np.flatnonzero(room < 0).tolist():
        held = sorted(np.flatnonzero(part == b).tolist(), key=lambda i: int(sizes[i]))
        while room[b] < 0:
            i = next((x for x in held if sizes[x] >= -room[b]), held[-1])
            held.remove(i)
            room[b] += sizes[i]
            out.append(i)
    spaces = sorted((int(r), b) for b, r in enumerate(room) if r > 0)
    left: list[int] = []
    for i in sorted(out, key=lambda i: -int(sizes[i])):
        at = bisect_left(spaces, (int(sizes[i]), -1))
        if at == len(spaces):
            left.append(i)
            continue
        r, b = spaces.pop(at)
        part[i] = b
        insort(spaces, (r - int(sizes[i]), b))
    if left:
        part[left] = k + packed(sizes[left], capacity)
    return part


def _block_items(count: int, tokens: int, capacity: int, least: int) -> int:
    mean = max(1, tokens) / max(1, count)
    return max(least, min(MOST_BLOCK_ITEMS, int(BLOCK_CONTAINERS * capacity / mean) + 1))


def pack(items: DataFrame, capacities: Sequence[int], key: str = "doc_id", size: str = "n_tokens", block_items: int = BLOCK_ITEMS, seed: int = 0) -> DataFrame:
    """(capacity_tokens, block, container, key, piece, pieces, tokens): where each item is, for each capacity.

    A container is named by capacity_tokens, block and container. An item larger than the capacity is divided into
    full pieces, each a container of its own, and a rest that is packed like any other item; smaller items have one
    piece. Items of null or no size take no room and lie in the first container of their block. Keys are taken to be
    unique and not null.

    Items are dealt by a seeded hash to blocks, for each capacity blocks of so many items that one fills about
    BLOCK_CONTAINERS, so that a block is bounded whatever the distribution of sizes. What a block leaves open is at most
    a part of a container beyond what its sizes force.
    """
    capacities = sorted({int(c) for c in capacities})
    if not capacities or capacities[0] < 1 or len(capacities) > MOST_CAPACITIES:
        raise ValueError(f"between 1 and {MOST_CAPACITIES} capacities of at least 1 are needed")
    own = items.select(F.col(key).alias("_key"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("_size"))
    rest_of = lambda c: F.when(F.col("_size") > c, F.col("_size") % c).otherwise(F.col("_size"))
    count, *rests = own.agg(F.count("*"), *[F.coalesce(F.sum(rest_of(c)), F.lit(0)) for c in capacities]).first()
    blocks = {c: max(1, -(-count // _block_items(count, t, c, block_items))) for c, t in zip(capacities, rests, strict=True)}
    tasks = F.array(*[F.struct(F.lit(c).cast("bigint").alias("capacity_tokens"), F.lit(n).cast("bigint").alias("n")) for c, n in blocks.items()])
    dealt = own.select("_key", "_size", F.explode(tasks).alias("t")).select("t.capacity_tokens", F.pmod(F.xxhash64(F.lit(str(seed)), "_key"), F.col("t.n")).alias("block"), "_key", "_size")
    kind = own.schema["_key"].dataType.simpleString()

    def place(block: pd.DataFrame) -> pd.DataFrame:
        capacity = int(block["capacity_tokens"].iloc[0])
        block = block.sort_values(["_size", "_key"], ascending=[False, True], kind="stable")
        whole = block["_size"].to_numpy(np.int64)
        full = np.where(whole > capacity, whole // capacity, 0)
        rest = whole - full * capacity
        container = np.zeros(len(block), np.int64)
        real = np.flatnonzero(rest)
        if len(real):
            by_size = real[np.argsort(-rest[real], kind="stable")]
            container[by_size] = packed(rest[by_size], capacity)
        return pd.DataFrame({"capacity_tokens": block["capacity_tokens"], "block": block["block"], "_key": block["_key"], "container": container, "full": full, "rest": rest})

    # The rows are few bytes and the work per row is much, so partitions follow the blocks and not the bytes.
    whole = sum(blocks.values())
    parts = min(whole, max(4 * items.sparkSession.sparkContext.defaultParallelism, whole // 1000))
    placed = dealt.repartition(parts, "capacity_tokens", "block").groupBy("capacity_tokens", "block").applyInPandas(place, f"capacity_tokens bigint, block bigint, _key {kind}, container bigint, full bigint, rest bigint")
    ends = F.when((F.col("rest") > 0) | (F.col("full") == 0), F.col("full") + 1).otherwise(F.col("full"))
    pieces = placed.withColumn("pieces", ends).withColumn("piece", F.explode(F.sequence(F.lit(1).cast("bigint"), "pieces")))
    alone = F.col("piece") <= F.col("full")
    own_name = -(F.pmod(F.xxhash64("_key", "piece"), F.lit(1 << 62)) + 1)  # full pieces have containers below zero
    return pieces.select(
        "capacity_tokens", "block", F.when(alone, own_name).otherwise(F.col("container")).alias("container"), F.col("_key").alias(key), "piece", "pieces",
        F.when(alone, F.col("capacity_tokens")).otherwise(F.col("rest")).alias("tokens"),
    )


def divided_items(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(capacity_tokens, key) of the items that lie in more than one container of a capacity."""
    held = placed.groupBy("capacity_tokens", key).agg(F.count_distinct("block", "container").alias("n"))
    return held.where("n > 1").select("capacity_tokens", key)


def container_report(placed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, and the share of their room that is filled."""
    one = placed.groupBy("capacity_tokens", "block", "container").agg(F.sum("tokens").alias("_t"))
    out = one.groupBy("capacity_tokens").agg(F.count("*").alias("containers"), F.sum("_t").alias("tokens"), F.max("_t").alias("fullest"))
    return out.withColumn("filled", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4))
