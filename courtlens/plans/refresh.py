"""Published tables of a folder of season files, brought up to date season by season.

A manifest table beside the published ones holds, for every season, the size and time of each of its source
files and the settings that the season was built with. A season is *absent* when nothing of it is published,
*stale* when its files or settings have changed, otherwise *fresh*. Only the absent and stale ones are built, and only
their partitions are overwritten; every model, score and rank belongs to one season, so the others stand.

The manifest row of a season goes last. A run that breaks off leaves seasons that the next run builds again.
Seasons whose files have gone stay published.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtlens.config import DEFAULT, ModelConfig
from courtlens.plans.season import SeasonTables
from courtlens.session import stable
from courtlens.sources import readers, seasons, sinks

MANIFEST = "season_manifest"   # names that begin with an underscore are not read
_STATE = "kind string, path string, length bigint, modified timestamp, settings string, tables array<string>, season string"


class SeasonStore:
    """The published tables in ``target`` of the season files in ``source``."""

    def __init__(self, spark: SparkSession, source: str, target: str, cfg: ModelConfig = DEFAULT,
                 wp_model: str | Callable[[DataFrame], DataFrame] = "mlp", tables: Iterable[str] | None = None):
        known = {**SeasonTables.PREPROCESSED, **SeasonTables.OUTPUTS}
        self.spark, self.source, self.target, self.cfg, self.wp_model = spark, source, target, cfg, wp_model
        self.tables = {name: known[name] for name in tables} if tables else known
        model = wp_model if isinstance(wp_model, str) else wp_model.__name__
        self.settings = hashlib.sha256(repr((cfg, model)).encode()).hexdigest()

    def files(self) -> DataFrame:
        """(kind, path, length, modified, season) of the files of every complete season; no file is opened."""
        found = seasons.source_files(self.spark, self.source)
        return found.join(seasons.complete_seasons(found), "season").select("kind", "path", "length", "modified", "season")

    def _manifest(self) -> DataFrame:
        if readers.saved(self.spark, self.target, MANIFEST):
            return self.spark.read.schema(_STATE).parquet(os.path.join(self.target, MANIFEST))
        return self.spark.createDataFrame([], _STATE)

    def state(self) -> DataFrame:
        """(season, status) of every season that has its files: absent, stale or fresh. One row per season."""
        mark = F.array_sort(F.collect_set(F.struct("kind", "path", "length", "modified")))
        now = self.files().groupBy("season").agg(mark.alias("now"))
        then = self._manifest().groupBy("season").agg(
            mark.alias("then"), F.min("settings").alias("settings"), F.first("tables").alias("tables"))
        same = (F.col("now") == F.col("then")) & (F.col("settings") == self.settings) & F.forall(
            F.array(*map(F.lit, sorted(self.tables))), lambda t: F.array_contains("tables", t))
        return now.join(then, "season", "left").select(
            "season", F.when(F.col("then").isNull(), "absent").when(same, "fresh").otherwise("stale").alias("status"))

    def refresh(self) -> dict[str, str]:
        """Build what is absent or stale; gives the status that each season had."""
        files = stable(self.files())   # a file that changes during the build is stale again afterwards
        status = {r["season"]: r["status"] for r in self.state().orderBy("season").collect()}
        todo = [s for s, was in status.items() if was != "fresh"]
        if todo:
            box = readers.read_box_tables(self.spark, self.source, todo)
            made = SeasonTables(box["players"], box["player_match"], box["team_match"],
                                readers.read_pbp(self.spark, self.source, todo), self.cfg, self.wp_model)
            for name, attribute in self.tables.items():
                sinks.save_seasons(getattr(made, attribute), self.target, name, todo)
            rows = files.where(F.col("season").isin(todo)).withColumns({
                "settings": F.lit(self.settings), "tables": F.array(*map(F.lit, sorted(self.tables)))})
            sinks.save_seasons(rows.select(*[c.split()[0] for c in _STATE.split(", ")]), self.target, MANIFEST, todo)
        return status

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """A published table, which is built first when there is none."""
        def build() -> DataFrame:
            self.refresh()
            return self.spark.read.parquet(os.path.join(self.target, name))

        df = readers.table_or_build(self.spark, self.target, name, build)
        return df.select(*columns) if columns else df

    def combine(self) -> dict[str, int]:
        """Write each ranking output of all seasons as one table; nothing where fewer than two seasons are published."""
        done = {}
        for name in sinks.COMBINED_TABLES:
            if name in self.tables:
                df = self.table(name)
                if len(df.select("season").distinct().limit(2).collect()) == 2:
                    done[name] = sinks.save_table(df, self.target, f"{name}_all_seasons", partition=None)
        return done
