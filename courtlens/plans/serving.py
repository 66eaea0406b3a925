"""Server toughness and serve-receive value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens.config import DEFAULT, ModelConfig
from courtlens.functions import numeric as N
from courtlens.operators import stats
from courtlens.operators.joins import checked_broadcast
from courtlens.plans.firstball import RECEIVE
from courtlens.plans.models import expected_outcomes
from courtlens.plans.playbyplay import RALLY_KEY
from courtlens.plans.roster import PLAYER_KEY

_DISPLAY = [*PLAYER_KEY, "player", "team", "conference", "role_family", "player_uid"]


def server_toughness(rallies: DataFrame, cfg: ModelConfig = DEFAULT) -> DataFrame:
    """Serve outcomes per server, and a volume-shrunk blend of their z-scores."""
    valid = rallies.filter(
        F.col("serve_team").isNotNull() & (F.coalesce(F.col("server_player_clean"), F.lit("")) != "")
    )
    ended = lambda family: F.count_if(F.col("terminal_event_family") == family)
    s = valid.groupBy(
        "season", F.col("serve_team").alias("team_clean"),
        F.col("server_player_clean").alias("player_clean"),
    ).agg(
        F.count(F.lit(1)).alias("serve_rallies"),
        F.count_if(F.col("point_winner_team") == F.col("serve_team")).alias("serve_points_won"),
        ended("ace").alias("serve_aces"),
        ended("service_error").alias("serve_errors"),
        ended("reception_error").alias("forced_reception_errors"),
    )
    n = F.col("serve_rallies")
    s = s.withColumns({
        "serve_point_win_rate": N.safe_rate(F.col("serve_points_won"), n),
        "serve_ace_rate": N.safe_rate(F.col("serve_aces"), n),
        "serve_error_rate": N.safe_rate(F.col("serve_errors"), n),
        "forced_reception_error_rate": N.safe_rate(F.col("forced_reception_errors"), n),
    })
    s = stats.zscores(s, ["season"], {
        "__p": "serve_point_win_rate", "__a": "serve_ace_rate",
        "__f": "forced_reception_error_rate", "__e": "serve_error_rate",
    })
    s = s.withColumn(
        "server_toughness_raw",
        cfg.serve_point_win_weight * F.col("__p") + cfg.serve_ace_weight * F.col("__a")
        + cfg.forced_reception_error_weight * F.col("__f") - cfg.serve_error_weight * F.col("__e"),
    ).drop("__p", "__a", "__f", "__e")
    return s.withColumn(
        "server_toughness_index", F.col("server_toughness_raw") * N.shrink(n, cfg.server_shrinkage)
    )


def with_player_display(df: DataFrame, features: DataFrame) -> DataFrame:
    names = features.select(*_DISPLAY).distinct()
    return df.join(checked_broadcast(names.drop(*[c for c in df.columns if c not in PLAYER_KEY])),
                   PLAYER_KEY, "left")


SR_FEATURES = [
    "server_toughness_index", "serve_point_win_rate", "serve_ace_rate", "serve_error_rate",
    "server_serve_rallies", "receive_score_diff_start", "total_points_start", "is_late_set",
]
SR_TARGETS = [
    "reception_error", "first_ball_attack", "first_ball_kill", "first_ball_middle_attack",
    "receive_point_win",
]


def receive_attempts(
    events: DataFrame, rallies: DataFrame, passes: DataFrame, servers: DataFrame
) -> DataFrame:
    """First serve-receive contact of each rally with its outcome and its difficulty."""
    is_receive = (
        F.col("is_action_row") & F.col("event_family").isin(RECEIVE)
        & (F.coalesce(F.col("player_clean"), F.lit("")) != "")
        & F.col("actor_team").isNotNull() & F.col("actor_side").isin("home", "away")
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("file_row")))
    r = events.filter(is_receive).groupBy(*RALLY_KEY).agg(
        F.min("file_row").alias("receive_row"),
        first("actor_team").alias("team_clean"),
        first("actor_side").alias("receiving_side"),
        first("player").alias("player"),
        first("player_clean").alias("player_clean"),
        first("event_family").alias("receive_event_family"),
    )
    flags = ["first_ball_attack", "first_ball_kill", "first_ball_middle_attack"]
    context = rallies.select(
        *RALLY_KEY, "score_home_start", "score_away_start", "serve_team", "server_player_clean",
        "point_winner_team",
    ).join(passes.select(*RALLY_KEY, *flags), RALLY_KEY, "left")
    profile = servers.select(
        "season", F.col("team_clean").alias("serve_team"),
        F.col("player_clean").alias("server_player_clean"),
        F.col("serve_rallies").cast("double").alias("server_serve_rallies"),
        "serve_point_win_rate", "serve_ace_rate", "serve_error_rate", "server_toughness_index",
    )
    d = r.join(context, RALLY_KEY, "left").join(
        checked_broadcast(profile), ["season", "serve_team", "server_player_clean"], "left"
    )
    d = d.fillna(0.0, SR_FEATURES[:5])
    error = F.col("receive_event_family") == "reception_error"
    home, away = F.col("score_home_start"), F.col("score_away_start")
    total = (F.coalesce(home, F.lit(0)) + F.coalesce(away, F.lit(0))).cast("double")
    late = ((F.col("set_no") < 5) & (total >= 38)) | ((F.col("set_no") == 5) & (total >= 20))
    return d.withColumns({
        "reception_error": error,
        **{f: N.true(F.col(f)) & ~error for f in flags},
        "receive_point_win": N.true(F.col("point_winner_team") == F.col("team_clean")),
        "receive_score_diff_start": F.when(F.col("receiving_side") == "home", home - away)
        .otherwise(away - home).cast("double"),
        "total_points_start": total,
        "is_late_set": late.cast("double"),
    })


def with_expectations(attempts: DataFrame, cfg: ModelConfig = DEFAULT) -> DataFrame:
    """Attempts with the expected rate of each outcome. Reads ``attempts`` twice."""
    return expected_outcomes(attempts, SR_TARGETS, SR_FEATURES, RALLY_KEY, cfg, cfg.aux_folds)


def serve_receive_value(attempts: DataFrame, cfg: ModelConfig = DEFAULT) -> DataFrame:
    """Passer values over expectation."""
    return passer_values(with_expectations(attempts, cfg), cfg)


def passer_values(scored: DataFrame, cfg: ModelConfig = DEFAULT) -> DataFrame:
    """Sum of weighted (actual - expected) per passer, shrunk by attempts."""
    actual = lambda t: F.col(t).cast("double")
    over = lambda t: actual(t) - F.col(f"expected_{t}")
    value = (
        cfg.sr_point_win_weight * over("receive_point_win")
        + cfg.sr_kill_weight * over("first_ball_kill")
        + cfg.sr_middle_weight * over("first_ball_middle_attack")
        + cfg.sr_attack_weight * over("first_ball_attack")
        - cfg.sr_error_weight * over("reception_error")
    )
    g = scored.withColumn("receive_attempt_value", value).groupBy(*PLAYER_KEY).agg(
        F.min_by("player", F.struct("contestid", "set_no", "rally_id")).alias("player"),
        F.count(F.lit(1)).alias("sr_attempts"),
        F.count_if(~F.col("reception_error")).alias("sr_clean_receptions"),
        F.count_if("reception_error").alias("sr_reception_errors"),
        F.count_if("first_ball_attack").alias("sr_first_ball_attacks"),
        F.count_if("first_ball_kill").alias("sr_first_ball_kills"),
        F.count_if("first_ball_middle_attack").alias("sr_first_ball_middle_attacks"),
        F.count_if("receive_point_win").alias("sr_receive_points_won"),
        F.sum("expected_reception_error").alias("sr_expected_reception_errors"),
        F.sum("expected_first_ball_attack").alias("sr_expected_first_ball_attacks"),
        F.sum("expected_first_ball_kill").alias("sr_expected_first_ball_kills"),
        F.sum("expected_first_ball_middle_attack").alias("sr_expected_first_ball_middle_attacks"),
        F.sum("expected_receive_point_win").alias("sr_expected_receive_points_won"),
        F.avg("server_toughness_index").alias("sr_avg_server_toughness"),
        F.avg("serve_ace_rate").alias("sr_avg_server_ace_rate"),
        F.sum("receive_attempt_value").alias("sr_value_total"),
    )
    n = F.col("sr_attempts")
    rate = lambda c: N.safe_rate(F.col(c), n)
    minus = lambda a, b: F.col(a) - F.col(b)
    g = g.withColumns({
        "sr_reception_error_rate": rate("sr_reception_errors"),
        "sr_first_ball_attack_rate": rate("sr_first_ball_attacks"),
        "sr_first_ball_kill_rate": rate("sr_first_ball_kills"),
        "sr_first_ball_middle_attack_rate": rate("sr_first_ball_middle_attacks"),
        "sr_receive_point_win_rate": rate("sr_receive_points_won"),
        "sr_error_avoided_oe": minus("sr_expected_reception_errors", "sr_reception_errors"),
        "sr_first_ball_attack_oe": minus("sr_first_ball_attacks", "sr_expected_first_ball_attacks"),
        "sr_first_ball_kill_oe": minus("sr_first_ball_kills", "sr_expected_first_ball_kills"),
        "sr_first_ball_middle_attack_oe": minus(
            "sr_first_ball_middle_attacks", "sr_expected_first_ball_middle_attacks"
        ),
        "sr_receive_point_win_oe": minus("sr_receive_points_won", "sr_expected_receive_points_won"),
        "sr_value_per_attempt": rate("sr_value_total"),
    })
    g = g.withColumn(
        "sr_shrunk_value_per_attempt", F.col("sr_value_per_attempt") * N.shrink(n, cfg.sr_shrinkage)
    )
    return g.withColumn("sr_shrunk_value", F.col("sr_shrunk_value_per_attempt") * n)
