"""Rally, contest and event tables from the cleaned log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlens.plans.playbyplay import RALLY_KEY, SET_KEY
from courtlens.session import stable

EVENT_COLUMNS = [
    "season", "date", "contestid", "set_no", "rally_id", "file_row", "row_in_rally", "action_seq",
    "away_clean", "home_clean", "away_score_ffill", "home_score_ffill", "team_clean", "actor_team",
    "actor_side", "actor_team_source", "event_family", "is_action_row", "player", "player_clean",
    "player_uid", "role_family",
]


def first_value(col: str, where: Column | None = None, order: str = "file_row") -> Column:
    """First non-null value of one column by order, among rows that satisfy ``where``."""
    cond = F.col(col).isNotNull() if where is None else where & F.col(col).isNotNull()
    return F.min_by(col, F.when(cond, F.col(order)))


def first_row(cols: list[str], where: Column, order: str = "file_row") -> Column:
    return F.min_by(F.struct(*cols), F.when(where, F.col(order)))


def last_row(cols: list[str], where: Column, order: str = "file_row") -> Column:
    return F.max_by(F.struct(*cols), F.when(where, F.col(order)))


def rally_rows(pbp: DataFrame) -> DataFrame:
    """One aggregate pass: score at both ends, counts, first serve and last action."""
    serve = F.col("event_family") == "serve"
    row = F.col("file_row")
    g = pbp.groupBy(*RALLY_KEY).agg(
        *[first_value(c).alias(c) for c in ("date", "away_team", "home_team", "away_clean", "home_clean")],
        F.min_by(F.struct("away_score_ffill", "home_score_ffill"), row).alias("__start"),
        F.max_by(F.struct("away_score_ffill", "home_score_ffill"), row).alias("__end"),
        F.count(F.lit(1)).alias("rally_rows"),
        F.count_if("is_action_row").alias("action_rows"),
        F.count_if(F.col("actor_team_source") == "unresolved").alias("unresolved_actor_rows"),
        F.bool_or("score_backward").alias("any_backward_score"),
        F.bool_or("multi_point_jump").alias("any_multi_point_jump"),
        F.bool_or(~F.col("score_is_numeric")).alias("any_non_numeric_score"),
        F.min(F.when(serve, row)).alias("serve_row"),
        first_value("actor_team", serve).alias("serve_team"),
        first_value("actor_side", serve).alias("server_side"),
        first_value("player_clean", serve).alias("server_player_clean"),
        last_row(
            ["file_row", "event_family", "actor_team", "actor_side", "player_clean"],
            F.col("is_action_row"),
        ).alias("__last"),
    )
    g = g.select(
        *RALLY_KEY, "date", "away_team", "home_team", "away_clean", "home_clean",
        F.col("__start.away_score_ffill").alias("score_away_start"),
        F.col("__start.home_score_ffill").alias("score_home_start"),
        F.col("__end.away_score_ffill").alias("score_away_end"),
        F.col("__end.home_score_ffill").alias("score_home_end"),
        "rally_rows", "action_rows", "unresolved_actor_rows", "any_backward_score",
        "any_multi_point_jump", "any_non_numeric_score", "serve_row", "serve_team",
        F.coalesce("server_side", F.lit("unknown")).alias("server_side"), "server_player_clean",
        F.col("__last.file_row").alias("terminal_row"),
        F.col("__last.event_family").alias("terminal_event_family"),
        F.col("__last.actor_team").alias("terminal_actor_team"),
        F.col("__last.actor_side").alias("terminal_actor_side"),
        F.col("__last.player_clean").alias("terminal_player_clean"),
    )
    g = g.withColumns({
        "away_delta": F.col("score_away_end") - F.col("score_away_start"),
        "home_delta": F.col("score_home_end") - F.col("score_home_start"),
    })
    side = F.when(F.col("home_delta") == 1, "home").when(F.col("away_delta") == 1, "away").otherwise("unknown")
    g = g.withColumns({
        "point_delta_total": F.abs("away_delta") + F.abs("home_delta"),
        "point_winner_side": side,
    })
    return g.withColumn(
        "point_winner_team",
        F.when(F.col("point_winner_side") == "home", F.col("home_clean"))
        .when(F.col("point_winner_side") == "away", F.col("away_clean")),
    )


_FINAL = ["score_home_end", "score_away_end"]


def with_set_results(rallies: DataFrame) -> DataFrame:
    """Last rally and winner of the set, sets won before it and in total, by two windows."""
    of_set, contest = W.partitionBy(*SET_KEY), W.partitionBy("season", "contestid")
    d = rallies.withColumns({
        "last_rally": F.max("rally_id").over(of_set),
        "__f": F.max_by(F.struct(*_FINAL), "rally_id").over(of_set),
    })
    d = _set_winner(d)
    ended = F.col("rally_id") == F.col("last_rally")
    won = lambda side: F.when(ended, F.col(f"{side}_set_win"))
    before = contest.orderBy("set_no").rangeBetween(W.unboundedPreceding, -1)
    return d.withColumns({
        **{f"{s}_sets_before": F.coalesce(F.sum(won(s)).over(before), F.lit(0)) for s in ("home", "away")},
        **{f"{s}_sets_total": F.sum(won(s)).over(contest) for s in ("home", "away")},
    })


def _set_winner(d: DataFrame) -> DataFrame:
    home, away = F.col("__f.score_home_end"), F.col("__f.score_away_end")
    return d.withColumns({
        "home_set_win": (home > away).cast("int"), "away_set_win": (away > home).cast("int"),
    }).drop("__f")


def set_summary(rallies: DataFrame) -> DataFrame:
    """The same per set, from partial aggregates; windows see one row per set only."""
    s = _set_winner(rallies.groupBy(*SET_KEY).agg(
        F.max_by(F.struct(*_FINAL), "rally_id").alias("__f"), F.max("rally_id").alias("last_rally"),
    ))
    contest = W.partitionBy("season", "contestid")
    before = contest.orderBy("set_no").rowsBetween(W.unboundedPreceding, -1)
    return s.withColumns({
        **{f"{x}_sets_before": F.coalesce(F.sum(f"{x}_set_win").over(before), F.lit(0)) for x in ("home", "away")},
        **{f"{x}_sets_total": F.sum(f"{x}_set_win").over(contest) for x in ("home", "away")},
    })


def rally_table(pbp: DataFrame, hot: bool = False) -> DataFrame:
    """Rallies with the state before and after each of them.

    The log is aggregated once. With ``hot``, when one contest may hold most rallies, the
    set results come from aggregates joined back instead of windows over whole contests.
    """
    rallies = rally_rows(pbp)
    if hot:
        rallies = stable(rallies)
        d = rallies.join(set_summary(rallies), SET_KEY)
    else:
        d = with_set_results(rallies)
    d = d.withColumns({
        "is_set_terminal": F.col("rally_id") == F.col("last_rally"),
        "home_match_win": (F.col("home_sets_total") > F.col("away_sets_total")).cast("int"),
    })
    step = F.col("is_set_terminal").cast("int")
    return d.withColumns({
        "home_sets_after": F.col("home_sets_before") + step * F.col("home_set_win"),
        "away_sets_after": F.col("away_sets_before") + step * F.col("away_set_win"),
        "set_after": F.col("set_no") + step,
        "score_home_after_state": F.when(F.col("is_set_terminal"), 0).otherwise(F.col("score_home_end")),
        "score_away_after_state": F.when(F.col("is_set_terminal"), 0).otherwise(F.col("score_away_end")),
        "server_side_after": F.col("point_winner_side"),
    }).drop("last_rally")


def contest_master(rallies: DataFrame) -> DataFrame:
    place = F.struct("set_no", "rally_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
    return rallies.groupBy("season", "contestid").agg(
        *[first(c) for c in ("date", "away_team", "home_team", "away_clean", "home_clean")],
        F.count_distinct("set_no").alias("sets"),
        F.count(F.lit(1)).alias("rallies"),
        *[F.max(c).alias(c) for c in ("home_sets_total", "away_sets_total", "home_match_win")],
    )


def event_table(pbp: DataFrame) -> DataFrame:
    return pbp.select(*EVENT_COLUMNS)
