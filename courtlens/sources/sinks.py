"""Table sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from courtlens.operators.shape import union_all

COMBINED_TABLES = [
    "player_rankings", "top25_rankings_by_role", "ranking_role_audit",
    "serve_receive_player_value", "server_toughness", "team_phase_context",
]


def save_table(df: DataFrame, folder: str, name: str, partition: str | None = "season",
               fmt: str = "parquet") -> int:
    """Overwrite one table and return its row count, observed during the write."""
    seen = Observation(f"rows_{name}")
    w = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if partition and partition in df.columns:
        w = w.partitionBy(partition)
    if fmt == "csv":
        # quotes are doubled and blanks kept, as the readers expect
        w = w.option("header", True).option("escape", '"').option(
            "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    w.format(fmt).save(os.path.join(folder, name))
    return int(seen.get["rows"])


def save_seasons(df: DataFrame, folder: str, name: str, seasons: list[str]) -> None:
    """Replace these seasons of a table partitioned by season; the other seasons are not touched.

    A season that has rows no longer loses its old ones too.
    """
    path = os.path.join(folder, name)
    seen = Observation(f"seasons_{name}")
    df.observe(seen, F.collect_set("season").alias("written")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)
    spark = df.sparkSession
    for season in set(seasons) - set(seen.get["written"]):
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(path, f"season={season}"))
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def save_csv(df: DataFrame, folder: str, name: str) -> int:
    return save_table(df, folder, name, partition=None, fmt="csv")


def combine_seasons(frames: list[DataFrame]) -> DataFrame | None:
    """Union of per-season tables; nothing to combine below two."""
    return union_all(frames) if len(frames) >= 2 else None
