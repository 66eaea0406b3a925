"""Top-k, samples, pivots, unpivots and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlens.config import SEED
from courtlens.operators.stats import bounded


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; Spark limits each group before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_members(
    df: DataFrame, member: str, pick_by: str, show: str, n: int = 10
) -> DataFrame:
    """``n`` members with the largest sum of ``pick_by``, shown sorted by the sum of ``show``."""
    sums = df.groupBy(member).agg(*[F.sum(c).alias(f"sum_{c}") for c in dict.fromkeys([pick_by, show])])
    best = sums.orderBy(F.col(f"sum_{pick_by}").desc(), F.col(member)).limit(n)
    return best.orderBy(F.col(f"sum_{show}").desc(), F.col(member))


def hash_order(keys: list[str], seed: int = SEED) -> Column:
    return F.xxhash64(*keys, F.lit(seed))


def sample_rows(
    df: DataFrame, keys: list[str], n: int, per: list[str] | None = None, seed: int = SEED
) -> DataFrame:
    """Up to ``n`` rows without replacement, chosen by a hash of the row key.

    Repeatable whatever the partitioning. The bound applies per group of ``per`` (the
    season, or nothing), whose sizes are a handful of rows. The
    hash threshold is estimated from the group size first, so only about ``n`` rows of a
    large group are ever sorted.
    """
    if not per:
        one = df.withColumn("__all", F.lit(0))
        return sample_rows(one, keys, n, ["__all"], seed).drop("__all")
    h = hash_order(keys, seed)
    # uniform in [0, 1)
    u = (h.cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    sizes = df.groupBy(*per).agg(F.count(F.lit(1)).alias("__n"))
    # 6 standard deviations of slack around the expected count, plus a floor
    bound = (F.lit(float(n)) + F.lit(6.0) * F.sqrt(F.lit(float(n))) + F.lit(50.0)) / F.col("__n")
    d = df.withColumns({"__h": h, "__u": u})
    d = d.join(bounded(sizes, per), per, "left")
    near = d.filter((F.col("__n") <= n) | (F.col("__u") <= bound))
    order = [F.col("__h"), *[F.col(k) for k in keys]]
    w = W.partitionBy(*per).orderBy(*order)
    return (
        near.withColumn("__rn", F.when(F.col("__n") > n, F.row_number().over(w)).otherwise(F.lit(0)))
        .filter(F.col("__rn") <= n)
        .drop("__h", "__u", "__n", "__rn")
    )


def count_pivot(
    df: DataFrame, keys: list[str], column: str, values: list[str], prefix: str = ""
) -> DataFrame:
    """Counts per key with one column per listed value, 0 where absent."""
    return df.groupBy(*keys).agg(
        *[F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values]
    )


def cross_tab(df: DataFrame, row: str, column: str, measure: str) -> DataFrame:
    """Sum of ``measure`` by row and column, in long form (one row per non-empty cell)."""
    return df.groupBy(row, column).agg(F.sum(measure).alias(f"sum_{measure}"))


def wide_cross_tab(
    df: DataFrame, row: str, column: str, measure: str, values: list | None = None
) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.sum(measure))


def unpivot(
    df: DataFrame, ids: list[str], values: list[str], name: str = "component", value: str = "value"
) -> DataFrame:
    as_double = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
    return as_double.unpivot(ids, values, name, value)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
