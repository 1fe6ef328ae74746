"""Positions and running sums over a whole table, without a window over all rows.

Rows are put into buckets that rise with the order. Per-bucket totals (one row a bucket) get their
running sum, and each row adds its place in its own bucket. Two shuffles, neither of them to one
task; only the table of buckets is. Without a bucket of the caller's, bounds come from a sample of
the order's own columns, so sparse keys, clusters and ties (split by the later columns) are even.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids in one bucket of a numeric key.
WIDTH = 50_000
#: Most buckets that sampled bounds make, and sampled keys for each.
BUCKETS, SAMPLED = 8_192, 20


def id_bucket(key: str, width: int = WIDTH) -> Column:
    return F.floor(F.col(key) / width)


def hex_bucket(key: str, digits: int = 3) -> Column:
    """Bucket of a uniform hexadecimal string."""
    return F.substring(key, 1, digits)


def hex_digits(n: int) -> int:
    """Digits of a uniform hexadecimal string that put about ``WIDTH`` of ``n`` rows into a bucket."""
    return max(1, math.ceil(math.log(max(n / WIDTH, 1), 16)))


def place(bounds: Column, x: Column, n: int) -> Column:
    """Number of the ``n`` sorted bounds that are at most ``x``, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= x, at + s).otherwise(at))


def even_bucket(df: DataFrame, order: list[str], width: int = WIDTH) -> Column | None:
    """Bucket of about ``width`` rows that rises with ``order``; none if two buckets take all rows.

    Runs one pass over the order's columns. The driver gets some ``SAMPLED`` keys a bucket, chosen by
    chance; they decide the balance, never the result.
    """
    rows = df.select(*order).sample(min(1.0, SAMPLED / width), 1).select(*order, F.rand(2).alias("_chance"))
    keys = rows.orderBy("_chance").limit(SAMPLED * BUCKETS).orderBy(*order).select(F.to_json(F.struct(*order))).collect()
    bounds = list(dict.fromkeys(r[0] for r in keys[SAMPLED::SAMPLED]))
    if len(keys) < 2 * SAMPLED or not bounds:
        return None
    kind = T.ArrayType(T.StructType([T.StructField(c, df.schema[c].dataType) for c in order]))
    return place(F.from_json(F.lit("[" + ",".join(bounds) + "]"), kind), F.struct(*order), len(bounds))


def with_totals(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the further columns of the one row of ``totals`` that has its keys; null is a key like others.

    ``totals`` has all keys of ``rows``, so no row is lost.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    totals = totals.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in totals.columns if c not in keys])
    same = [rows[k].eqNullSafe(totals[n]) for k, n in zip(keys, names, strict=True)]
    return rows.join(totals, same).drop(*names)


def running(df: DataFrame, name: str, bucket: Column | None, order: list[str], value: Column | None = None, within: list[str] | None = None, inclusive: bool = True, n: int | None = None) -> DataFrame:
    """Add ``name``: the running sum of ``value`` (1, if not given) in ``order``, inside ``within``.

    ``bucket`` must not decrease with the order; none stands for :func:`even_bucket`, for which ``n``
    may give the number of rows, if it is known. Without ``inclusive`` the row's own value is left out.
    Nulls in ``order`` come first, null groups and null buckets are as others, a null value adds 0.
    """
    keys = within or []
    if bucket is None and (n is None or n > 2 * WIDTH):
        bucket = even_bucket(df, order)
    value = F.lit(1).cast("long") if value is None else F.coalesce(value, F.lit(0))
    if bucket is None:  # few rows
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = df.withColumn("_value", value).withColumn("_inside", F.sum("_value").over(whole))
        return rows.withColumn(name, F.col("_inside") if inclusive else F.col("_inside") - F.col("_value")).drop("_value", "_inside")
    rows = df.withColumns({"_bucket": bucket, "_value": value})
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_inside", F.sum("_value").over(inside))
    out = with_totals(rows, totals, [*keys, "_bucket"])
    sum_ = F.col("_before") + F.col("_inside")
    return out.withColumn(name, sum_ if inclusive else sum_ - F.col("_value")).drop("_bucket", "_value", "_before", "_inside")


def position(df: DataFrame, name: str, bucket: Column | None, order: list[str], within: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Add ``name``: 0-based position in ``order``."""
    return running(df, name, bucket, order, within=within, inclusive=False, n=n)


def ntile(index: Column, total: Column, n: int) -> Column:
    """1-based tile of a 0-based position among ``total`` rows; earlier tiles take the remainder."""
    small, extra = F.floor(total / n), total % n
    cut = extra * (small + 1)
    return (F.when(index < cut, F.floor(index / (small + 1))).otherwise(extra + F.floor((index - cut) / F.greatest(small, F.lit(1)))) + 1).cast("long")
