"""Contiguous shards of atomic groups with the smallest possible largest shard.

Groups (equal texts) are ordered by a hash of the text; a shard is a run of
groups.  The smallest feasible capacity is found by binary search with a greedy
check, and shards are cut where the greedy fill reaches it.

The group sizes never come to the driver.  It sees sums over key ranges, at
first 4,096 of them.  Taking every range as one group gives a capacity that is
surely enough; taking it as divisible gives one that is surely needed.  Only
ranges in which a cut may lie for a capacity between the two are split further
(each into 4,096), until they are single groups or the two bounds meet on the
same cuts.  So the answer is exact, and each round is one aggregation.

Cases: a null text has no bytes and forms one group with the empty ones.  Repeated rows share a
group.  Rows with a null id come first in their group.  With fewer groups than
shards the last shards stay empty; an empty table gives no rows.  Other columns are passed over.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilrow.llm.common import ordered

SHARDS = 16
_STEP = 12  # bits of the key that a round looks at
_BITS = 64


@dataclass
class Range:
    """Keys with this prefix: ``key >> shift == prefix``."""

    shift: int
    prefix: int
    size: int
    single: bool  # one group only


def _fill(ranges: list[Range], capacity: int, divisible: bool) -> list[int]:
    """Prefix sums where a greedy fill ends its shards.  A range that can't be divided and doesn't fit ends the list."""
    sums = [0, *accumulate(r.size for r in ranges)]
    ends, at = [], 0
    while at < sums[-1]:
        k = bisect_right(sums, at + capacity) - 1
        end = sums[k]
        if divisible and k < len(ranges) and not ranges[k].single:
            end = at + capacity
        if end <= at:
            break
        ends.append(end)
        at = end
    return ends


def _least(ranges: list[Range], shards: int, divisible: bool) -> int:
    """Smallest capacity with which the greedy fill needs at most ``shards`` shards."""
    total = sum(r.size for r in ranges)
    low, high = max(1, -(-total // shards)), max(total, 1)
    while low < high:
        middle = (low + high) // 2
        ends = _fill(ranges, middle, divisible)
        if len(ends) <= shards and (ends[-1:] == [total] or not total):
            high = middle
        else:
            low = middle + 1
    return low


def _between(ranges: list[Range], low: int, high: int, shards: int) -> list[int]:
    """Ranges that may hold a cut for some capacity from low to high."""
    sums = [0, *accumulate(r.size for r in ranges)]
    first, last = _fill(ranges, low, False), _fill(ranges, high, True)
    total, found = sums[-1], set()
    for k in range(shards - 1):
        a = first[k] if k < len(first) else (first[-1] if first else 0)
        b = last[k] if k < len(last) else total
        if a >= total:
            continue
        i = bisect_right(sums, a) - 1
        while i < len(ranges) and sums[i] <= b:
            if not ranges[i].single:
                found.add(i)
            i += 1
    return sorted(found)


def minimax_cuts(table: DataFrame, shards: int = SHARDS, key: str = "key", size: str = "size") -> tuple[int, list[int]]:
    """Capacity, and the last key of each shard but the last one.  ``table`` has one row for each member."""

    def sums(rows: DataFrame, shift: int) -> list[Range]:
        prefix = F.shiftright(F.col(key), shift) if shift else F.col(key)
        got = rows.groupBy(prefix.alias("prefix")).agg(F.sum(size).alias("size"), (F.min(key) == F.max(key)).alias("single")).collect()
        return sorted((Range(shift, r["prefix"], r["size"], r["single"] or not shift) for r in got), key=lambda r: r.prefix)

    ranges = sums(table, _BITS - _STEP)
    while True:
        low, high = _least(ranges, shards, True), _least(ranges, shards, False)
        open_ranges = _between(ranges, low, high, shards)
        if not open_ranges:
            break
        split: dict[int, list[Range]] = {}
        for shift in {ranges[i].shift for i in open_ranges}:
            mine = [i for i in open_ranges if ranges[i].shift == shift]
            rows = table.where(F.shiftright(F.col(key), shift).isin([ranges[i].prefix for i in mine]))
            below = max(0, shift - _STEP)
            parts = sums(rows, below)
            for i in mine:
                split[i] = [p for p in parts if p.prefix >> (shift - below) == ranges[i].prefix]
        ranges = [p for i, r in enumerate(ranges) for p in split.get(i, [r])]
    total = sum(r.size for r in ranges)
    if not total:
        return 0, []
    ends = _fill(ranges, high, False)
    at = [0, *accumulate(r.size for r in ranges)]
    # The last key of a range: all lower bits set.
    return high, [((ranges[at.index(e) - 1].prefix + 1) << ranges[at.index(e) - 1].shift) - 1 for e in ends[:-1]]


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard) for each row."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"), F.xxhash64(value).alias("key"),
    )
    table = ordered(rows, "shard-order", "key", "doc_id")
    _, cuts = minimax_cuts(table, shards)
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("key") > F.lit(cut)).cast("int")
    placed = table.withColumn("shard", number)
    # One row for each shard.
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"))
