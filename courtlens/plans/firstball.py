"""What the receiving team made of the first ball."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens.config import FAMILIES
from courtlens.functions import numeric as N
from courtlens.operators import ordered
from courtlens.operators.joins import checked_broadcast
from courtlens.plans.playbyplay import RALLY_KEY
from courtlens.plans.rallies import first_value
from courtlens.plans.roster import PLAYER_KEY

RECEIVE = ["reception", "reception_error"]
ATTACKS = ["attack", "kill", "attack_error"]
_FLAGS = [
    "reception_error", "first_ball_attack", "first_ball_kill", "first_ball_middle_attack",
    "receive_point_win",
]
_RATES = {
    "fb_attack_rate": "fb_attacks", "fb_kill_rate": "fb_kills",
    "fb_middle_attack_rate": "fb_middle_attacks", "fb_reception_error_rate": "fb_reception_errors",
    "fb_receive_point_win_rate": "fb_receive_point_wins",
}


def first_after_anchor(
    events: DataFrame, keys: list[str], order: str, anchor_where, anchor_cols: dict[str, str],
    hot: bool = False,
) -> DataFrame:
    """Events with the first anchor row of their group attached.

    ``anchor_cols`` names the columns of that row to attach (out -> source). Follow with a
    grouped ``first_value(..., order > anchor)`` to get what came first after it.
    """
    names = list(anchor_cols)
    packed = F.struct(*[F.col(s).alias(o) for o, s in anchor_cols.items()])
    d = ordered.attach(
        events, keys, {"__anchor": F.min_by(packed, F.when(anchor_where, F.col(order)))}, hot
    )
    return d.withColumns({o: F.col(f"__anchor.{o}") for o in names}).drop("__anchor")


def first_contacts(events: DataFrame, hot: bool = False) -> DataFrame:
    """Per rally: first reception, then first attack, kill and opponent action after it."""
    is_reception = (
        F.col("event_family").isin(RECEIVE)
        & (F.coalesce(F.col("player_clean"), F.lit("")) != "")
        & F.col("actor_team").isNotNull()
    )
    needed = events.select(
        *RALLY_KEY, "file_row", "actor_team", "player_clean", "event_family", "role_family"
    )
    d = first_after_anchor(
        needed, RALLY_KEY, "file_row", is_reception,
        {
            "reception_row": "file_row", "receiving_team": "actor_team",
            "passer_player_clean": "player_clean", "reception_event_family": "event_family",
        },
        hot,
    )
    after = F.col("file_row") > F.col("reception_row")
    same = F.col("actor_team") == F.col("receiving_team")
    other = F.col("actor_team") != F.col("receiving_team")
    attack = after & same & F.col("event_family").isin(ATTACKS)
    kill = after & same & (F.col("event_family") == "kill")
    row = F.col("file_row")
    anchored = ["reception_row", "receiving_team", "passer_player_clean", "reception_event_family"]
    return d.groupBy(*RALLY_KEY).agg(
        *[F.max(c).alias(c) for c in anchored],
        F.min(F.when(attack, row)).alias("first_attack_row"),
        first_value("player_clean", attack).alias("first_attack_player_clean"),
        first_value("event_family", attack).alias("first_attack_event_family"),
        first_value("role_family", attack).alias("first_attack_role_family"),
        F.min(F.when(after & other & F.col("event_family").isin(FAMILIES), row)).alias(
            "first_opp_action_row"
        ),
        F.min(F.when(kill, row)).alias("first_same_team_kill_row"),
        first_value("player_clean", kill).alias("first_ball_kill_player_clean"),
    )


def rally_pass(events: DataFrame, rallies: DataFrame, hot: bool = False) -> DataFrame:
    """Rallies with their first-ball contacts and outcome flags."""
    base = rallies.select(
        *RALLY_KEY, "date", "home_clean", "away_clean", "serve_team", "server_side",
        "server_player_clean", "terminal_event_family", "point_winner_side", "point_winner_team",
    )
    d = base.join(first_contacts(events, hot), RALLY_KEY, "left")
    opp = F.col("first_opp_action_row")
    before_opp = lambda c: F.col(c).isNotNull() & (opp.isNull() | (F.col(c) < opp))
    d = d.withColumn(
        "reception_error", N.true(F.col("reception_event_family") == "reception_error")
    )
    d = d.withColumns({
        "receive_point_win": N.true(F.col("point_winner_team") == F.col("receiving_team")),
        "first_ball_attack": N.true(before_opp("first_attack_row")) & ~F.col("reception_error"),
    })
    d = d.withColumn(
        "first_ball_kill",
        N.true(before_opp("first_same_team_kill_row")) & F.col("first_ball_attack"),
    )
    return d.withColumn(
        "first_ball_middle_attack",
        F.col("first_ball_attack") & N.true(F.col("first_attack_role_family") == "middle"),
    )


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {out: N.safe_rate(F.col(num), F.col("fb_receptions")) for out, num in _RATES.items()}
    )


def per_player_contest(passes: DataFrame) -> DataFrame:
    """First-ball counts and rates per passer and contest."""
    known = passes.filter(
        F.col("passer_player_clean").isNotNull() & F.col("receiving_team").isNotNull()
    ).withColumnsRenamed({"receiving_team": "team_clean", "passer_player_clean": "player_clean"})
    return _rates(known.groupBy("contestid", *PLAYER_KEY).agg(
        F.count(F.lit(1)).alias("fb_receptions"),
        F.count_if(~F.col("reception_error")).alias("fb_clean_receptions"),
        F.count_if("reception_error").alias("fb_reception_errors"),
        F.count_if("first_ball_attack").alias("fb_attacks"),
        F.count_if("first_ball_kill").alias("fb_kills"),
        F.count_if("first_ball_middle_attack").alias("fb_middle_attacks"),
        F.count_if("receive_point_win").alias("fb_receive_point_wins"),
    ))


def per_player_season(contest: DataFrame) -> DataFrame:
    """Season roll-up, summed before any display lookup so that nobody counts twice."""
    counts = [c for c in contest.columns if c.startswith("fb_") and not c.endswith("_rate")]
    return _rates(contest.groupBy(*PLAYER_KEY).agg(*[F.sum(c).alias(c) for c in counts]))


def with_display(df: DataFrame, master: DataFrame) -> DataFrame:
    names = master.select(*PLAYER_KEY, "player", "team", "role_family", "player_uid").distinct()
    return df.join(checked_broadcast(names), PLAYER_KEY, "left")
