"""Joins: size-checked broadcast, existence probes, lookups; rows dealt out by their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20
#: Rows that one task is given where the number of partitions follows the number of rows.
TASK_ROWS = 250_000


def parts_of(rows: int, spark: SparkSession) -> int:
    """Partitions for so many rows: as many as a shuffle has, more where a task would get over ``TASK_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def parts_for(df: DataFrame) -> int:
    """``parts_of`` the rows of a scan, which a Parquet footer knows."""
    return parts_of(df.count(), df.sparkSession)


def dealt_out(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a scan, spread by ``keys`` where its files give one task far more than its share.

    A file with one row group is read by one task whatever its size, and all row work up to the next shuffle would be done there.
    """
    spark = df.sparkSession
    sizes = df.groupBy(F.spark_partition_id().alias("p")).count()
    most, rows = sizes.agg(F.max("count"), F.sum("count")).first()
    if (most or 0) <= TASK_ROWS or most * spark.sparkContext.defaultParallelism <= 2 * rows:
        return df
    return df.repartition(parts_of(rows, spark), *keys)


def checked_broadcast(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """Hint a broadcast only after measuring the side; otherwise leave it to shuffle joins.

    Reads at most ``max_rows + 1`` rows, and counts their text as UTF-8 bytes.
    """
    width = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), width).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df


def lookup(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Left join to a dimension, broadcast when measured small enough."""
    return df.join(checked_broadcast(small), keys, how)


def exists_in(df: DataFrame, small: DataFrame, on: dict[str, str], out: str) -> DataFrame:
    """Add ``out`` = some row of ``small`` matches; never multiplies rows.

    ``on`` maps a column of ``df`` to a column of ``small``.
    """
    probe = small.select(*[F.col(s).alias(d) for d, s in on.items()]).distinct().withColumn(
        out, F.lit(True)
    )
    d = df.join(checked_broadcast(probe), list(on), "left")
    return d.withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def name_dimension(*columns: tuple[DataFrame, str], out: str) -> DataFrame:
    """Distinct non-null union of name columns."""
    frames = [df.select(F.col(c).alias(out)) for df, c in columns]
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    return union.filter(F.col(out).isNotNull()).distinct()
