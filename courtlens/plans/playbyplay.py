"""Touch-by-touch logs: dedup, contest ids, names, actor, score, event family, rallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens.functions import numeric as N
from courtlens.functions import text as T
from courtlens.operators import joins, ordered
from courtlens.operators.resolve import resolve
from courtlens.plans.roster import role_lookup
from courtlens.session import stable
from courtlens.sources.seasons import checked

CONTEST_KEY = ["season", "contestid"]
SET_KEY = [*CONTEST_KEY, "set_no"]
RALLY_KEY = [*SET_KEY, "rally_id"]
CLEAN_COLUMNS = [
    *RALLY_KEY, "file_row", "row_in_rally", "action_seq", "date", "away_team", "home_team",
    "away_clean", "home_clean", "team_clean", "score_is_numeric", "away_score_ffill",
    "home_score_ffill", "d_away", "d_home", "score_backward", "multi_point_jump",
    "one_point_increment", "player_on_home", "player_on_away", "actor_team", "actor_side",
    "actor_team_source", "event_text", "description_text", "event_family",
    "is_first_ball_kill_text", "is_action_row", "player", "player_clean", "player_uid",
    "role_family",
]
_TEXT = ["date", "away_team", "home_team", "score", "rally", "rally_event", "team", "event",
         "player", "description"]


def distinct_touches(pbp: DataFrame) -> DataFrame:
    """Full-row dedup over the log columns, keeping the earliest row.

    Two touches that really are identical collapse too; skip this step to keep both.
    """
    return ordered.keep_first(
        pbp.select("season", "file_row", "contestid", "set_no", *_TEXT),
        ["season", "contestid", "set_no", *_TEXT], "file_row",
    )


def outline(pbp: DataFrame) -> DataFrame:
    """(season, contestid, the three team texts, rows): all that has to be known of a log before it is cleaned.

    A few rows for each contest, from one pass that adds up in every task first.
    """
    d = N.with_missing(checked(pbp), {c: "string" for c in [*_TEXT, "contestid"]})
    return d.groupBy("season", "contestid", "team", "home_team", "away_team").agg(F.count(F.lit(1)).alias("rows"))


def largest_contest(outlined: DataFrame) -> int:
    sizes = outlined.groupBy("season", "contestid").agg(F.sum("rows").alias("n"))
    return int(sizes.agg(F.max("n")).first()[0] or 0)


def _typed_keys(pbp: DataFrame) -> DataFrame:
    return pbp.withColumns({
        "contestid": N.number(F.col("contestid"), "bigint"),
        "set_no": N.number(F.col("set_no"), "int"),
    })


def with_contest_ids(
    pbp: DataFrame, negative_synthetic: bool = False, missing: list[str] | None = None
) -> DataFrame:
    """Numeric contest ids; seasons with a missing one get ids from row order."""
    d = _typed_keys(pbp)
    missing = _seasons_without_ids(pbp) if missing is None else missing
    if not missing:
        return d
    whole = d.filter(~F.col("season").isin(missing))
    gaps = d.filter(F.col("season").isin(missing))
    rebuilt = ordered.contest_blocks(
        gaps, "file_row", "contestid", ["date", "home_team", "away_team"], "set_no", ["season"],
        "contestid", ordered.pick_chunk(gaps, ["season"]), negative_synthetic,
    )
    return whole.unionByName(rebuilt)


def _seasons_without_ids(pbp: DataFrame) -> list[str]:
    gaps = pbp.where(N.number(F.col("contestid"), "bigint").isNull()).select("season").distinct()
    return [r[0] for r in gaps.collect()]


def distinct_typed_touches(pbp: DataFrame, parts: int | None = None) -> DataFrame:
    """Dedup and typed keys in one shuffle, for logs with ids and no oversized set.

    Rows are spread by contest first. The contest is part of the dedup key and of every later
    window, so neither needs another exchange.
    """
    raw = pbp.select("season", "file_row", F.col("contestid").alias("__c"), F.col("set_no").alias("__s"), *_TEXT)
    d = raw.withColumns({
        "contestid": N.number(F.col("__c"), "bigint"), "set_no": N.number(F.col("__s"), "int"),
    }).dropna(subset=["contestid", "set_no"])
    spread = d.repartition(parts, *CONTEST_KEY) if parts else d.repartition(*CONTEST_KEY)
    return ordered.keep_first(spread, [*SET_KEY, "__c", "__s", *_TEXT], "file_row").drop("__c", "__s")


def with_actor(pbp: DataFrame, master: DataFrame) -> DataFrame:
    """Who owns the touch: the one roster that lists the player, else the team column."""
    d = joins.exists_in(
        pbp, master,
        {"season": "season", "player_clean": "player_clean", "home_clean": "team_clean"}, "player_on_home",
    )
    d = joins.exists_in(
        d, master,
        {"season": "season", "player_clean": "player_clean", "away_clean": "team_clean"}, "player_on_away",
    )
    home, away, team = F.col("home_clean"), F.col("away_clean"), F.col("team_clean")
    only_home = F.col("player_on_home") & ~F.col("player_on_away")
    only_away = F.col("player_on_away") & ~F.col("player_on_home")
    d = d.withColumn(
        "actor_team",
        F.when(only_home, home).when(only_away, away).when(team == home, home).when(team == away, away),
    )
    return d.withColumns({
        "actor_side": F.when(F.col("actor_team") == home, "home")
        .when(F.col("actor_team") == away, "away").otherwise("unknown"),
        "actor_team_source": F.when(only_home, "roster_home").when(only_away, "roster_away")
        .when((team == home) | (team == away), "team_column").otherwise("unresolved"),
    })


def with_score(pbp: DataFrame, chunk: int | None) -> DataFrame:
    """Parsed and carried-forward score, change since the previous row, anomaly flags."""
    away, home = T.score_parts(F.col("score"))
    d = pbp.withColumns({"__a": away, "__h": home})
    d = d.withColumn("score_is_numeric", F.col("__a").isNotNull() & F.col("__h").isNotNull())
    d = ordered.forward_fill(
        d, SET_KEY, "file_row", {"away_score_ffill": "__a", "home_score_ffill": "__h"}, chunk
    ).fillna(0, ["away_score_ffill", "home_score_ffill"])
    d = ordered.previous(
        d, SET_KEY, "file_row", {"__pa": "away_score_ffill", "__ph": "home_score_ffill"}, "__has", chunk
    )
    d = d.withColumns({
        "d_away": F.when(F.col("__has"), F.col("away_score_ffill") - F.col("__pa")).otherwise(0),
        "d_home": F.when(F.col("__has"), F.col("home_score_ffill") - F.col("__ph")).otherwise(0),
    })
    da, dh = F.col("d_away"), F.col("d_home")
    return d.withColumns({
        "score_backward": (da < 0) | (dh < 0),
        "multi_point_jump": (F.abs(da) + F.abs(dh)) > 1,
        "one_point_increment": (da >= 0) & (dh >= 0) & ((da + dh) == 1),
    }).drop("__a", "__h", "__pa", "__ph", "__has")


def with_rallies(pbp: DataFrame, chunk: int | None) -> DataFrame:
    """Rally number in the set, row number and running action count in the rally."""
    d = ordered.segment(pbp, SET_KEY, "file_row", "one_point_increment", "rally_id", chunk)
    return ordered.running_sum(
        d, RALLY_KEY, "file_row",
        {"row_in_rally": F.lit(1), "action_seq": F.col("is_action_row").cast("int")}, chunk,
    )


def with_score_and_rallies(pbp: DataFrame, chunk: int | None) -> DataFrame:
    """Both scans. In chunks they run on a few columns only and are joined back by row."""
    if chunk is None:
        return with_rallies(with_score(pbp, None), None)
    whole = stable(pbp)
    core = whole.select(*SET_KEY, "file_row", "score", "is_action_row")
    scanned = with_rallies(with_score(core, chunk), chunk).drop("score", "is_action_row")
    return whole.join(scanned, [*SET_KEY, "file_row"])


def clean_pbp(
    pbp: DataFrame, master: DataFrame, teams: DataFrame, *,
    dedup: bool = True, chunk: int | None | str = "auto", negative_synthetic: bool = False,
    outlined: DataFrame | None = None, parts: int | None = None,
) -> DataFrame:
    """The cleaned log, one row per touch (more where a player has two roster entries).

    ``chunk`` is the row limit per task inside a set; 'auto' measures the largest set. ``outlined`` is the
    written ``outline`` of the log, if there is one already, and ``parts`` the number of partitions to spread contests over.
    """
    d = N.with_missing(checked(pbp), {c: "string" for c in [*_TEXT, "contestid"]})
    outlined = stable(outline(pbp)) if outlined is None else outlined
    if chunk == "auto":
        chunk = ordered.pick_chunk(_typed_keys(d), SET_KEY)
    missing = _seasons_without_ids(outlined)
    if dedup and chunk is None and not missing:
        d = distinct_typed_touches(d, parts)
    else:
        d = distinct_touches(d) if dedup else d
        d = with_contest_ids(d, negative_synthetic, missing).dropna(subset=["contestid", "set_no"])
    d = resolve(
        d, {"team_clean": "team", "home_clean": "home_team", "away_clean": "away_team"}, teams, outlined
    )
    d = d.withColumns({
        "player_clean": T.clean_name(F.col("player")),
        "event_text": T.clean_name(F.col("event")),
        "description_text": T.clean_name(F.col("description")),
    })
    d = with_actor(d, master)
    d = d.withColumns({
        "event_family": T.event_family(F.col("event_text"), F.col("description_text")),
        "is_first_ball_kill_text": T.mentions_first_ball_kill(
            F.col("event_text"), F.col("description_text")
        ),
    })
    d = d.withColumn("is_action_row", F.col("event_family") != "admin")
    d = with_score_and_rallies(d, chunk)
    roles = role_lookup(master).withColumnRenamed("team_clean", "actor_team")
    d = joins.lookup(d, roles, ["season", "actor_team", "player_clean"])
    return d.select(*CLEAN_COLUMNS)
