"""Ordered running totals without putting a whole group into one task.

A plain window over all rows of a group needs that group in one task.  Here the
order is cut into buckets first.  Each bucket is summed on its own, a small
table of bucket totals gives every bucket its start, and the window runs inside
(group, bucket) only.  A group of any size is spread over its buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256
HASH_BUCKETS = 1024


def with_quantile_bucket(
    df: DataFrame, order: str, name: str, buckets: int = BUCKETS, descending: bool = False
) -> DataFrame:
    """Adds a bucket number that rises with the order and holds about equal shares.

    The cut points, at most ``buckets - 1`` numbers, are fetched once and put
    into the plan.  Approximate quantiles may differ between two evaluations,
    and every reader of the buckets must see the same ones.
    """
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.select(F.percentile_approx(order, shares, 10 * buckets)).first()[0] or []
    edges = sorted(set(cuts), reverse=descending)
    if not edges:
        return df.withColumn(name, F.lit(0))
    before = (lambda c: c > F.col(order)) if descending else (lambda c: c < F.col(order))
    return df.withColumn(name, F.size(F.filter(F.array(*map(F.lit, edges)), before)))


def hash_bucket(digest: Column, buckets: int = HASH_BUCKETS) -> Column:
    """A bucket that rises with a hex digest: its leading digits, so shares are even."""
    digits = next(d for d in range(1, 9) if 16**d >= buckets)
    return F.floor(
        F.conv(F.substring(digest, 1, digits), 16, 10).cast("long") * F.lit(buckets) / F.lit(16**digits)
    ).cast("int")


def running_totals(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], sums: dict[str, str | Column]
) -> DataFrame:
    """Adds, per output name, the sum of its input up to and including each row."""
    df = df.withColumn("bucket_", bucket)
    value = {name: (F.col(v) if isinstance(v, str) else v) for name, v in sums.items()}
    per_bucket = df.groupBy(*keys, "bucket_").agg(*[F.sum(v).alias(f"{n}_all") for n, v in value.items()])
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("bucket_")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = per_bucket.select(
        *[F.col(k).alias(f"{k}_k") for k in keys],
        F.col("bucket_").alias("bucket_k"),
        *[F.coalesce(F.sum(f"{n}_all").over(earlier), F.lit(0)).alias(f"{n}_start") for n in value],
    )
    inside = (
        Window.partitionBy(*keys, "bucket_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    within = df.withColumns({f"{n}_in": F.sum(v).over(inside) for n, v in value.items()})
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"{k}_k")) for k in keys] + [F.col("bucket_") == F.col("bucket_k")],
    )
    joined = within.join(starts, same, "left")
    return joined.withColumns({n: F.col(f"{n}_start") + F.col(f"{n}_in") for n in value}).select(
        *[c for c in df.columns if c != "bucket_"], *value
    )
