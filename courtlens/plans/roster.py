"""Players, box scores and team strength."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens import config
from courtlens.functions import numeric as N
from courtlens.functions import text as T
from courtlens.operators import stats
from courtlens.operators.joins import checked_broadcast, lookup, name_dimension
from courtlens.operators.resolve import resolve
from courtlens.sources.seasons import checked

PLAYER_KEY = ["season", "team_clean", "player_clean"]
_MASTER = [
    "season", "teamid", "team", "team_clean", "conference", "number", "number_clean",
    "player", "player_clean", "pos", "role_family", "player_uid",
]


def player_master(players: DataFrame) -> DataFrame:
    """One row per distinct roster entry, with role bucket and composite id."""
    p = N.with_missing(
        checked(players),
        {c: "string" for c in ("teamid", "conference", "number", "pos")},
    )
    p = p.withColumns({
        "player_clean": T.clean_name(F.col("player")),
        "team_clean": T.clean_team(F.col("team")),
        "role_family": T.role_of(T.clean_name(F.col("pos"))),
        "number_clean": N.number(F.col("number"), "bigint"),
    })
    p = p.withColumn(
        "player_uid", T.composite_id(*[F.col(c) for c in (*PLAYER_KEY, "number_clean")])
    )
    return p.select(*_MASTER).distinct()


def known_teams(master: DataFrame, team_match: DataFrame) -> DataFrame:
    named = team_match.select(T.clean_team(F.col("team")).alias("team_clean"))
    return name_dimension((master, "team_clean"), (named, "team_clean"), out="team_clean")


def role_lookup(master: DataFrame, *extra: str) -> DataFrame:
    return master.select(*PLAYER_KEY, "role_family", "player_uid", *extra).distinct()


def prepare_player_match(player_match: DataFrame, master: DataFrame, teams: DataFrame) -> DataFrame:
    """Box rows with clean keys, resolved opponent, role and player id.

    Two roster entries with the same name give two rows, as a plain lookup would.
    """
    pm = checked(player_match)
    pm = N.with_missing(pm, {"contestid": "bigint"})
    pm = pm.withColumns({
        "player_clean": T.clean_name(F.col("player")),
        "team_clean": T.clean_team(F.col("team")),
        "contestid": N.number(F.col("contestid"), "bigint"),
    })
    pm = resolve(pm, {"opp_clean": "opponent"}, teams)
    return lookup(pm, role_lookup(master), PLAYER_KEY)


def prepare_team_match(team_match: DataFrame, teams: DataFrame) -> DataFrame:
    tm = checked(team_match).withColumn("team_clean", T.clean_team(F.col("team")))
    return resolve(tm, {"opp_clean": "opponent"}, teams)


def team_strength(team_match: DataFrame, master: DataFrame | None = None) -> DataFrame:
    """Season record per team and the index 0.50 wins + 0.35 set margin + 0.15 hitting."""
    won, sets_for, sets_against = T.result_parts(F.col("result"))
    tm = N.with_missing(checked(team_match), {"hit_pct": "double", "pts": "double"})
    g = tm.groupBy("season", "team_clean").agg(
        F.count(F.lit(1)).alias("matches"),
        F.avg(won).alias("win_pct"),
        F.sum(sets_for).alias("sets_for"),
        F.sum(sets_against).alias("sets_against"),
        F.avg(N.number(F.col("hit_pct"))).alias("mean_hit_pct"),
        F.avg(N.number(F.col("pts"))).alias("mean_pts"),
    )
    g = g.withColumn(
        "set_diff_per_match", N.safe_rate(F.col("sets_for") - F.col("sets_against"), F.col("matches"))
    )
    g = stats.median_fill(g, ["season"], "mean_hit_pct", "__hit")
    g = stats.zscores(
        g, ["season"], {"__zw": "win_pct", "__zs": "set_diff_per_match", "__zh": "__hit"},
        null_as_zero=False,
    )
    g = g.withColumn(
        "team_strength_index", 0.50 * F.col("__zw") + 0.35 * F.col("__zs") + 0.15 * F.col("__zh")
    ).drop("__zw", "__zs", "__zh", "__hit")
    if master is None:
        return g
    display = master.groupBy("season", "team_clean").agg(F.min("team").alias("team_display"))
    return g.join(checked_broadcast(display), ["season", "team_clean"], "left")


def player_match_enriched(
    player_match: DataFrame, strength: DataFrame, first_ball_contest: DataFrame
) -> DataFrame:
    """Box rows with own and opponent strength and the first-ball numbers of that match."""
    s = checked_broadcast(strength.select("season", "team_clean", "team_strength_index"))
    opp = s.select(
        "season", F.col("team_clean").alias("opp_clean"),
        F.col("team_strength_index").alias("opp_strength_index"),
    )
    counts, rates = config.FIRST_BALL_COUNTS, config.FIRST_BALL_RATES
    fb = first_ball_contest.select("contestid", *PLAYER_KEY, *counts, *rates)
    out = (
        player_match.join(s, ["season", "team_clean"], "left")
        .join(opp, ["season", "opp_clean"], "left")
        .withColumns({
            "team_strength_missing": F.col("team_strength_index").isNull(),
            "opp_strength_missing": F.col("opp_strength_index").isNull(),
        })
        .join(fb, ["contestid", *PLAYER_KEY], "left")
    )
    return out.fillna(0, counts).fillna(
        0.0, [*rates, "team_strength_index", "opp_strength_index"]
    )


def player_season_features(
    master: DataFrame, enriched: DataFrame, first_ball_season: DataFrame
) -> DataFrame:
    """One row per roster entry: season box totals, schedule strength, first-ball numbers."""
    from courtlens.config import BOX_STATS

    pm = N.with_missing(enriched, {c: "double" for c in BOX_STATS})
    box = pm.groupBy(*PLAYER_KEY).agg(
        F.count(F.lit(1)).alias("matches_played_rows"),
        F.avg("team_strength_index").alias("team_strength_index"),
        F.avg("opp_strength_index").alias("opp_strength_index"),
        F.avg(F.col("team_strength_missing").cast("int")).alias("team_strength_missing_rate"),
        F.avg(F.col("opp_strength_missing").cast("int")).alias("opp_strength_missing_rate"),
        *[F.sum(F.coalesce(N.number(F.col(c)), F.lit(0.0))).alias(f"box_{c}") for c in BOX_STATS],
    )
    fb_cols = [c for c in first_ball_season.columns if c.startswith("fb_")]
    fb = first_ball_season.select(*PLAYER_KEY, *fb_cols)
    out = master.join(box, PLAYER_KEY, "left").join(fb, PLAYER_KEY, "left")
    filled = [c for c in out.columns if c not in master.columns]
    return out.fillna(0, filled)
