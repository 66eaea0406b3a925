"""Match statistics tables, leaderboards and the queries behind the dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens.config import DROPPED_RESULTS, RANKING_TABLE_COLUMNS
from courtlens.functions import numeric as N
from courtlens.functions import text as T
from courtlens.operators import shape, stats

_BOX_FILLED = [
    "kills", "assists", "aces", "digs", "block_solos", "block_assists", "errors", "total_attacks",
]


# --- match statistics -------------------------------------------------------

def cleaned_player_box(player_match: DataFrame) -> DataFrame:
    """Display names, away flag, blocks (null if either part is) and zero-filled counts."""
    return player_match.withColumns({
        "team": T.display_team(F.col("team")),
        "opponent": T.display_team(F.col("opponent")),
        "is_away": (F.col("location") == "Away").cast("int"),
        "kill_efficiency": F.col("hit_pct"),
        "blocks": F.col("block_solos") + F.col("block_assists"),
    }).fillna(0, _BOX_FILLED)


def cleaned_team_box(team_match: DataFrame) -> DataFrame:
    """Display names, without postponed, cancelled or unreported matches."""
    named = team_match.withColumns({
        "team": T.display_team(F.col("team")), "opponent": T.display_team(F.col("opponent"))
    })
    return named.filter(~F.col("result").isin(DROPPED_RESULTS))


def player_stats(box: DataFrame) -> DataFrame:
    return box.select(
        "player", "team", "opponent", "season", "is_away", "kills", "assists", "aces", "digs",
        "blocks", F.round("kill_efficiency", 4).alias("kill_efficiency"),
    )


def team_stats(box: DataFrame) -> DataFrame:
    """Season means per team, and efficiency as a ratio of sums."""
    mean = lambda c: F.round(F.avg(c), 4)
    return box.groupBy("team", "season").agg(
        mean("kills").alias("avg_kills"), mean("assists").alias("avg_assists"),
        mean("digs").alias("avg_digs"), mean("blocks").alias("avg_blocks"),
        F.round(F.try_divide(
            (F.sum("kills") - F.sum("errors")).cast("double"), F.sum("total_attacks").cast("double")
        ), 4).alias("avg_efficiency"),
        F.count(F.lit(1)).alias("matches_played"),
    )


def match_stats(team_box: DataFrame) -> DataFrame:
    return team_box.select("team", "opponent", "season", "result")


def kills_table(box: DataFrame) -> DataFrame:
    return box.select("player", "team", "opponent", "season", "kills", "is_away")


def kills_by_location(box: DataFrame) -> DataFrame:
    """Least-squares kills per player and match, predicted at home (0) and away (1)."""
    fit = stats.least_squares(box, "is_away", "kills", [0, 1])
    return fit.select(F.col("x").alias("location"), F.col("prediction").alias("pred_kills"))


# --- workbook sheets --------------------------------------------------------

def mean_kills_by_location(box: DataFrame) -> DataFrame:
    return box.groupBy("location").agg(F.avg("kills").alias("avg_kills"))


def kills_cross_tab(box: DataFrame) -> DataFrame:
    return shape.cross_tab(box, "team", "opponent", "kills")


PLAYER_MEASURES = ["kills", "assists", "blocks", "aces", "digs"]


def player_sheet(
    box: DataFrame, seasons: list[str], teams: list[str] | None = None,
    positions: list[str] | None = None,
) -> DataFrame:
    """Five sums per player, position and team, most kills first."""
    d = box.filter(F.col("season").isin(seasons))
    if teams:
        d = d.filter(F.col("team").isin(teams))
    if positions:
        d = d.filter(F.col("pos").isin(positions))
    g = d.groupBy("player", "pos", "team").agg(*[F.sum(c).alias(f"sum_{c}") for c in PLAYER_MEASURES])
    return g.orderBy(F.col("sum_kills").desc(), "player", "team", "pos")


def player_sheet_long(sheet: DataFrame) -> DataFrame:
    """Measure names as rows."""
    return shape.unpivot(
        sheet, ["player", "pos", "team"], [f"sum_{c}" for c in PLAYER_MEASURES], "measure", "value"
    )


def team_comparison(team_box: DataFrame, teams: list[str]) -> DataFrame:
    return team_box.filter(F.col("team").isin(teams)).groupBy("team").agg(
        *[F.sum(c).alias(f"sum_{c}") for c in ("assists", "digs", "block_solos", "kills")]
    )


def top_teams(team_box: DataFrame, show: str = "block_solos", pick_by: str = "kills", n: int = 10) -> DataFrame:
    """The ten teams with most ``pick_by``, ordered by ``show`` (the two may differ)."""
    return shape.top_members(team_box, "team", pick_by, show, n)


# --- ranking dashboard ------------------------------------------------------

def typed_outputs(df: DataFrame) -> DataFrame:
    """Booleans and numbers as such, whatever the storage format kept."""
    flags = [c for c in ("meets_volume_threshold", "role_mismatch_flag") if c in df.columns]
    numbers = [
        c for c in ("overall_rank", "role_rank", "overall_score", "event_rallies", "calc_hit_pct",
                    "sr_shrunk_value") if c in df.columns
    ]
    return df.withColumns({
        **{c: N.loose_bool(F.col(c)) for c in flags},
        **{c: N.number(F.col(c)) for c in numbers},
    })


def filter_rankings(
    ranked: DataFrame, roles: list[str] = (), conferences: list[str] = (), team: str = "All teams",
    min_rallies: int = 0, only_threshold: bool = False, search: str = "",
) -> DataFrame:
    d = _common_filters(ranked, roles, conferences, team, min_rallies)
    if only_threshold:
        d = d.filter(F.col("meets_volume_threshold"))
    if search.strip():
        d = d.filter(T.contains_any(["player", "team", "conference"], search))
    return d.orderBy("overall_rank", "role_rank", F.col("overall_score").desc(), "player", "team")


def filter_audit(
    audit: DataFrame, roles: list[str] = (), conferences: list[str] = (), team: str = "All teams",
    min_rallies: int = 0, search: str = "",
) -> DataFrame:
    d = _common_filters(audit, roles, conferences, team, min_rallies)
    if search.strip():
        d = d.filter(T.contains_any(["player", "team", "audit_reason"], search))
    return d.orderBy("overall_rank", "role_rank", "player", "team")


def _common_filters(df, roles, conferences, team, min_rallies) -> DataFrame:
    d = df
    if roles:
        d = d.filter(F.col("role_family").isin(list(roles)))
    if conferences:
        d = d.filter(F.col("conference").isin(list(conferences)))
    if team != "All teams":
        d = d.filter(F.col("team") == team)
    return d.filter(F.coalesce(N.number(F.col("event_rallies")), F.lit(0.0)) >= min_rallies)


def flagged(audit: DataFrame) -> DataFrame:
    return audit.filter(F.coalesce(F.col("audit_reason"), F.lit("")) != "")


def role_counts(ranked: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).alias("players")
    return ranked.groupBy("season", "role_family").agg(n).orderBy("season", F.col("players").desc(), "role_family")


def headline_numbers(ranked: DataFrame) -> DataFrame:
    """Players ranked, volume-qualified, and the top player, per season."""
    order = F.struct("overall_rank", "player", "team")
    return ranked.groupBy("season").agg(
        F.count(F.lit(1)).alias("players_ranked"),
        F.count_if("meets_volume_threshold").alias("volume_qualified"),
        F.min_by("player", order).alias("top_player"),
        F.min_by("team", order).alias("top_team"),
    )


def best_overall(ranked: DataFrame, n: int = 12, columns: list[str] | None = None) -> DataFrame:
    """First ``n`` by overall rank."""
    cols = columns or ["season", "overall_rank", "player", "team", "role_family", "overall_score", "event_rallies"]
    return shape.top(
        ranked.select(*cols),
        [F.col("overall_rank"), *[F.col(c) for c in cols if c != "overall_rank"]], n,
    )


def filter_values(ranked: DataFrame) -> DataFrame:
    """Sorted distinct values of every filter, as (field, value) rows."""
    fields = ["role_family", "conference", "team"]
    values = ranked.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields
    ])).alias("v")).select("v.*")
    return values.filter(F.col("value").isNotNull()).distinct().orderBy("field", "value")


def rally_bound(ranked: DataFrame) -> DataFrame:
    """Largest event-rally count, the upper end of the volume slider."""
    n = F.coalesce(N.number(F.col("event_rallies")), F.lit(0.0))
    return ranked.agg(F.max(n).cast("bigint").alias("max_rallies")).withColumn(
        "default_rallies", F.when(F.col("max_rallies") >= 200, 200).otherwise(0)
    )


COMPONENTS = [
    "event_value_z", "tabular_value_z", "serve_receive_value_z", "final_value_z",
    "event_blend_weight", "tabular_blend_weight", "serve_receive_blend_weight",
]
STAT_LINE = [
    "box_kills", "box_assists", "box_digs", "box_total_attacks", "box_aces", "box_retatt",
    "touches_per_rally", "calc_hit_pct",
]


def player_components(ranked: DataFrame, values: list[str] = COMPONENTS) -> DataFrame:
    """(player, component, value) rows for the profile page."""
    return shape.unpivot(ranked, ["season", "team_clean", "player_clean"], values)


def player_options(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        "season", "overall_rank",
        T.player_label(F.col("overall_rank"), F.col("player"), F.col("team")).alias("label"),
    )


def ranking_download(filtered: DataFrame) -> DataFrame:
    """The columns offered for download, in table order; write it with ``sinks.save_csv``."""
    return filtered.select(*[c for c in RANKING_TABLE_COLUMNS if c in filtered.columns])
