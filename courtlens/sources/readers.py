"""Source scans. Every reader returns all seasons at once with ``season`` as a column."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from courtlens import config
from courtlens.functions import text as T
from courtlens.operators import ordered
from courtlens.sources import seasons as S


def _csv(spark: SparkSession):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"')


def read_csv(
    spark: SparkSession, path: str | list[str], columns: list[str] | None = None,
    types: dict[str, str] | None = None,
) -> DataFrame:
    """CSV scan pruned to the wanted columns that exist, with coercing types.

    One header holds for all files of a call. Quoted values may hold line breaks, so a file
    is one split; convert large files to Parquet once.
    """
    raw = _csv(spark).csv(path)
    if columns is not None:
        raw = raw.select(*[c for c in raw.columns if c in columns])
    typed = {c: F.col(f"`{c}`").try_cast(t) for c, t in (types or {}).items() if c in raw.columns}
    return raw.withColumns(typed) if typed else raw


def season_path(folder: str, kind: str, season: str) -> str:
    return os.path.join(folder, config.SOURCE_FILES[kind].format(year=S.Season.parse(season).start))


def _by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _season_scans(spark: SparkSession, folder: str, kind: str, seasons: list[str]) -> list[DataFrame]:
    """The files of all seasons, one scan for each distinct header and not for each file, so that the
    plan does not grow with the seasons. ``__season`` is the season in the name of a row's file.
    """
    alike: dict[tuple[str, ...], list[str]] = {}
    for season in seasons:
        path = season_path(folder, kind, season)
        alike.setdefault(tuple(_csv(spark).csv(path).columns), []).append(path)
    name = re.escape(config.SOURCE_FILES[kind]).replace(re.escape("{year}"), "([0-9]{4})")
    year = F.regexp_extract(F.col("_metadata.file_path"), f".*/{name}", 1).cast("int")
    return [
        _csv(spark).schema(StructType([StructField(c, StringType()) for c in header])).csv(paths)
        .withColumn("__season", F.concat_ws("-", year, year + 1))
        for header, paths in alike.items()
    ]


def _box_rows(scan: DataFrame) -> DataFrame:
    """A scan under standard names; the season of the file counts where its rows name none."""
    df = T.standardize_columns(scan.drop("__season"))
    return df if "season" in df.columns else T.standardize_columns(
        scan.withColumnRenamed("__season", "season"))


def read_box_tables(spark: SparkSession, folder: str, seasons: list[str]) -> dict[str, DataFrame]:
    """Roster without pseudo-players, deduplicated player box score, team box score.

    Every season file is read by its own header, then all are put together by column name.
    """
    out = {kind: S.checked(_by_name([_box_rows(d) for d in _season_scans(spark, folder, kind, seasons)]))
           for kind in ("players", "player_match", "team_match")}
    out["players"] = drop_pseudo_players(out["players"])
    out["player_match"] = out["player_match"].dropDuplicates()
    return out


def drop_pseudo_players(players: DataFrame) -> DataFrame:
    return players.filter(~T.clean_name(F.col("player")).isin(config.ROSTER_PSEUDO_PLAYERS))


def read_pbp(spark: SparkSession, folder: str, seasons: list[str]) -> DataFrame:
    """Play-by-play rows as text, with the season of the file and an order column.

    Files are read by their own headers. The order column grows by season, file and row.
    """
    frames = []
    for scan in _season_scans(spark, folder, "pbp", seasons):
        raw = ordered.with_file_row(
            scan.select(*[c for c in scan.columns if c in config.PBP_COLUMNS], F.col("__season").alias("season")),
            keys=["season"])
        # the same numbers whichever other seasons are read
        base = F.shiftleft((F.substring("season", 1, 4).cast("bigint") - 1900), 49)
        frames.append(raw.withColumnRenamed("set", "set_no").withColumn("file_row", F.col("file_row") + base))
    return _by_name(frames)


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(folder, name))
    return df.select(*columns) if columns else df


def saved(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether the folder holds a table of this name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, name))
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def table_or_build(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """The saved table when present, otherwise the plan that makes it."""
    return spark.read.parquet(os.path.join(folder, name)) if saved(spark, folder, name) else build()
