"""Season texts: validation, ranges, selection and discovery."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlens import config


@dataclass(frozen=True, order=True)
class Season:
    """A season is the year it starts in; its text names that year and the next."""

    start: int

    @classmethod
    def parse(cls, text: object) -> Season:
        first, _, second = str(text).strip().partition("-")
        if not all(len(y) == 4 and y.isascii() and y.isdigit() for y in (first, second)):
            raise ValueError(f"{text!r} names no season; write the two years, as in {cls(2025)}")
        if int(second) - int(first) != 1:
            raise ValueError(f"{text!r} names no season: its years do not follow each other")
        return cls(int(first))

    def __str__(self) -> str:
        return f"{self.start}-{self.start + 1}"


def between(first: object, last: object) -> list[str]:
    """All seasons from the first to the last."""
    a, b = Season.parse(first), Season.parse(last)
    if a > b:
        raise ValueError(f"no season lies between {a} and {b}; name the earlier one first")
    return [str(Season(y)) for y in range(a.start, b.start + 1)]


def wanted(names: Iterable[str] | None = None, span: tuple[str, str] | None = None,
           single: str | None = None, found: Iterable[str] | None = None) -> list[str]:
    """Seasons a caller asked for.

    ``found`` (what a folder holds, returned in order) counts most, then ``names`` (entries
    may hold several, split by commas), then ``span``, then ``single``, then the default season.
    """
    if found is not None:
        every = sorted(set(map(Season.parse, found)))
        if not every:
            raise FileNotFoundError("no season files")
        return list(map(str, every))
    listed = [t for n in names or () for t in str(n).split(",") if t.strip()]
    if listed:
        return [str(Season.parse(t)) for t in listed]
    return between(*span) if span else [str(Season.parse(single or config.DEFAULT_SEASON))]


def valid_season(c: Column) -> Column:
    """True for the texts of ``Season``; false for others and null."""
    first, second = F.substring(c, 1, 4).try_cast("int"), F.substring(c, 6, 4).try_cast("int")
    return F.coalesce(c.rlike(r"^[0-9]{4}-[0-9]{4}$") & (second - first == 1), F.lit(False))


def checked(df: DataFrame, col: str = "season") -> DataFrame:
    """``df``, failing on the first row whose season is no season; no row is dropped.

    This also bounds the number of season values by the number of four-digit years.
    """
    c = F.col(col)
    wrong = F.raise_error(F.concat(F.lit("no season: "), F.coalesce(c, F.lit("null")))).cast("string")
    # as this is never null, a join by season need not check it once more in front of every shuffle
    return df.withColumn(col, F.coalesce(F.when(valid_season(c), c).otherwise(wrong), F.lit("")))


def pick(df: DataFrame, seasons: list[str] | None = None, first: str | None = None,
         last: str | None = None, col: str = "season") -> DataFrame:
    """Rows of the wanted seasons; on a season-partitioned table this prunes partitions."""
    if seasons is not None:
        df = df.filter(F.col(col).isin([str(Season.parse(x)) for x in seasons]))
    if first is not None:
        df = df.filter(F.col(col) >= str(Season.parse(first)))
    if last is not None:
        df = df.filter(F.col(col) <= str(Season.parse(last)))
    return df


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, year, season, path, length, modified) of every source file in a folder, from file metadata only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    kind = F
    for k, template in config.SOURCE_FILES.items():
        stem = re.escape(template.split("{")[0])
        kind = kind.when(F.col("path").rlike(rf"/{stem}\d{{4}}\.csv(/|$)"), k)
    y = F.col("year").cast("int")
    return files.select(
        kind.otherwise(None).alias("kind"), F.regexp_extract("path", r"_(\d{4})\.csv(?:/|$)", 1).alias("year"),
        "path", "length", F.col("modificationTime").alias("modified"),
    ).filter("kind is not null").withColumn("season", F.concat_ws("-", y.cast("string"), (y + 1).cast("string")))


def file_years(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, year) of every source file in a folder."""
    return source_files(spark, folder).select("kind", "year")


def complete_seasons(years: DataFrame, kinds: int = len(config.SOURCE_FILES)) -> DataFrame:
    """Seasons for which every kind of source file exists."""
    y = F.col("year").cast("int")
    return (
        years.groupBy("year").agg(F.count_distinct("kind").alias("n")).filter(F.col("n") == kinds)
        .select(F.concat_ws("-", y.cast("string"), (y + 1).cast("string")).alias("season"))
        .orderBy("season")
    )


def available(df: DataFrame, col: str = "season", newest_first: bool = False) -> DataFrame:
    """Distinct seasons of a table, by start year."""
    by = F.substring(col, 1, 4).try_cast("int")
    return df.select(col).distinct().orderBy(by.desc() if newest_first else by.asc(), col)


def discover_local(spark: SparkSession, folder: str, aggregate: DataFrame | None = None) -> DataFrame:
    """Seasons found in roster file names, plus those of an optional aggregate roster."""
    y = F.col("year").cast("int")
    found = file_years(spark, folder).filter("kind = 'players'").select(
        F.concat_ws("-", y.cast("string"), (y + 1).cast("string")).alias("season")
    )
    if aggregate is not None:
        found = found.unionByName(checked(aggregate.select("season")))
    return available(found)
