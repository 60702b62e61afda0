"""Filling containers of fixed capacity (problem 8).

Method: harmonic packing.  Lengths fall into reciprocal-capacity classes: class
k holds the lengths in (C/(k+1), C/k], so exactly k documents of class k fit a
container whatever their exact lengths.  Documents are spread over shards by a
hash of their key, and each shard fills each class's containers with that fixed
number of documents, independently of all others.

Harmonic packing alone leaves up to 1/(k+1) of a class-k container unused, so
what is left over in a container is topped up from the higher classes (shorter
documents) of the same shard, longest first, before those fill their own.

An item longer than the capacity is divided into full containers and a rest;
no other item is divided.  Shards have a bounded number of items, counted
beforehand; a shard leaves at most a few containers partly empty, which is the
whole cost of working independently.

Defined results: items of size null or below 1 are left out; equal sizes are
ordered by key; an empty table gives no containers; keys must be unique.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.runtime import Scratch

#: Classes of their own; shorter items share the last class.
CLASSES = 64


def fill_shard(keys: list[int], sizes: list[int], capacity: int, classes: int = CLASSES) -> tuple[list[int], list[int], list[int], list[int]]:
    """Containers of one shard: parallel lists container, key, piece, size."""
    out: tuple[list[int], ...] = ([], [], [], [])
    bins = 0

    def put(b: int, key: int, piece: int, size: int) -> None:
        for column, x in zip(out, (b, key, piece, size), strict=True):
            column.append(x)

    whole: list[tuple[int, int, int]] = []
    for key, size in zip(keys, sizes, strict=True):
        piece = 0
        while size > capacity:  # only an item that alone exceeds a container is divided
            put(bins, key, piece, capacity)
            bins, piece, size = bins + 1, piece + 1, size - capacity
        whole.append((size, key, piece))
    whole.sort()
    by_class: list[list[tuple[int, int, int]]] = [[] for _ in range(classes + 1)]
    for item in whole:  # ascending within a class: pop() gives the longest
        by_class[min(classes, capacity // item[0])].append(item)
    for k in range(1, classes + 1):
        own = by_class[k]
        while own:
            room, n = capacity, 0
            while own and n < k and own[-1][0] <= room:
                size, key, piece = own.pop()
                put(bins, key, piece, size)
                room, n = room - size, n + 1
            j = max(k, 1)
            while j <= classes and room > 0:  # top up, longest that fits first
                at = bisect_right(by_class[j], (room, float("inf"), 0))
                if at == 0:
                    j += 1
                    continue
                size, key, piece = by_class[j].pop(at - 1)
                put(bins, key, piece, size)
                room -= size
            bins += 1
    return out


def pack(items: DataFrame, key: str, size: str, capacity: int, scratch: Scratch, shard_items: int = 8192) -> DataFrame:
    """``container, key, piece, size`` of every item; containers hold at most ``capacity``."""
    sized = scratch.keep(items.select(F.col(key).cast("bigint").alias("key"), F.col(size).cast("bigint").alias("size")).where("size >= 1"))
    n = sized.count()
    shards = max(1, -(-n // shard_items))

    def fill(shard: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        b, k, p, s = fill_shard(pdf["key"].tolist(), pdf["size"].tolist(), capacity)
        base = int(shard[0]) << 32
        return pd.DataFrame({"container": [base + x for x in b], "key": k, "piece": p, "size": s})

    spread = sized.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return spread.groupBy("shard").applyInPandas(fill, "container bigint, key bigint, piece bigint, size bigint")
