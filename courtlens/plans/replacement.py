"""Single-set player rates and replacement value.

A game is one set of one contest. For every player of a game, the expected change in
points is computed if each other player of the game had taken the same chances, and
averaged. No pair of players is formed: the change is a sum of products of one term of
the original player or team and one term of the replacement, so the mean over the others
follows from a few sums per game.

Chances with no defined source in the method are left out: digs and sets that follow a
return, a dig or a serve by the same team, assists, and repeated hits. Digs only feed
such terms, so they do not move the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtlens.config import GAME_EVENTS
from courtlens.functions import numeric as N
from courtlens.operators import ordered
from courtlens.session import stable

GAME = ["season", "contestid", "set_no"]


def slug(event: str) -> str:
    return event.lower().replace(" ", "_")


def _playing(pbp: DataFrame) -> DataFrame:
    named = F.col("player").isNotNull() & (F.col("player") != "")
    return pbp.filter(
        named & ((F.col("team") == F.col("home_team")) | (F.col("team") == F.col("away_team")))
    )


def game_roster(pbp: DataFrame) -> DataFrame:
    """Distinct players seen in each game for each side."""
    return _playing(pbp).select(*GAME, "away_team", "home_team", "team", "player").distinct()


def tallies(pbp: DataFrame) -> DataFrame:
    """Touches of each event per player, team and game, written: all counts below are sums of it."""
    return stable(_playing(pbp).groupBy(*GAME, "home_team", "away_team", "team", "player").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("event") == e).alias(f"n_{slug(e)}") for e in GAME_EVENTS]))


def opportunities(pbp: DataFrame, events: list[str] = GAME_EVENTS) -> DataFrame:
    """Per player and game: own count, team opportunities and their share per roster mate."""
    return chances(tallies(pbp), events)


def chances(tallied: DataFrame, events: list[str] = GAME_EVENTS) -> DataFrame:
    """The same from ``tallies``. Team totals are summed first and joined to the roster, so nothing is multiplied by it."""
    own = tallied.groupBy(*GAME, "team", "player").agg(*[F.sum(f"n_{slug(e)}").alias(f"n_{slug(e)}") for e in events])
    team = own.groupBy(*GAME, "team").agg(
        *[F.sum(f"n_{slug(e)}").alias(f"opp_{slug(e)}") for e in events], F.count(F.lit(1)).alias("roster_size"))
    return own.join(team, [*GAME, "team"]).withColumns({
        f"share_{slug(e)}": F.col(f"opp_{slug(e)}") / F.col("roster_size") for e in events
    })


def serve_episodes(pbp: DataFrame, chunk: int | None | str = "auto") -> DataFrame:
    """From one serve to the next: server's side and sets and attacks of both sides.

    The last episode of a game is open and not counted. ``chunk`` is the row limit per task
    inside a game; 'auto' measures the largest game.
    """
    if chunk == "auto":
        chunk = ordered.pick_chunk(pbp, GAME)
    p = _playing(pbp).select(
        *GAME, "file_row", "home_team", "away_team", "team", "event",
        (F.col("event") == "Serve").cast("int").alias("is_serve"),
    )
    d = ordered.running_sum(p, GAME, "file_row", {"episode": F.col("is_serve")}, chunk)
    served = F.min_by("team", F.when(F.col("event") == "Serve", F.col("file_row")))
    count = lambda e, side: F.count_if((F.col("event") == e) & (F.col("team") == F.col(side)))
    e = d.filter(F.col("episode") > 0).groupBy(*GAME, "home_team", "away_team", "episode").agg(
        served.alias("serve_team"),
        *[count(ev, f"{s}_team").alias(f"{s}_{slug(ev)}")
          for ev in ("Set", "Attack", "Reception") for s in ("home", "away")],
    )
    if chunk is None:
        e = e.withColumn("last_episode", F.max("episode").over(W.partitionBy(*GAME)))
    else:   # a game may hold most episodes
        e = stable(e)
        e = e.join(e.groupBy(*GAME).agg(F.max("episode").alias("last_episode")), GAME)
    return e.filter(F.col("episode") < F.col("last_episode")).drop("last_episode")


def team_rates(pbp: DataFrame, chunk: int | None | str = "auto", tallied: DataFrame | None = None) -> DataFrame:
    """Team totals per game and what follows a serve: sets, attacks, attacks after a return.

    With ``tallied``, the ``tallies`` of the log, the log itself is read for the episodes only.
    """
    tallied = tallies(pbp) if tallied is None else tallied
    if chunk == "auto":
        largest = tallied.groupBy(*GAME).agg(F.sum("rows").alias("n")).agg(F.max("n")).first()[0] or 0
        chunk = ordered.HOT_ROWS if largest > ordered.HOT_ROWS else None
    e = serve_episodes(pbp, chunk)
    sides = F.explode(F.array(*[
        F.struct(
            F.col(f"{s}_team").alias("team"), F.col(f"{o}_team").alias("opponent"),
            (F.col("serve_team") == F.col(f"{s}_team")).alias("serving"),
            F.col(f"{s}_set").alias("sets"), F.col(f"{s}_attack").alias("attacks"),
            F.col(f"{o}_reception").alias("returned"),
        ) for s, o in (("home", "away"), ("away", "home"))
    ])).alias("t")
    flat = e.select(*GAME, sides).select(*GAME, "t.*")
    after = flat.groupBy(*GAME, "team").agg(
        F.sum(F.when(F.col("serving"), F.col("sets")).otherwise(0)).alias("sets_from_serve"),
        F.sum(F.when(~F.col("serving"), F.col("attacks")).otherwise(0)).alias("attacks_from_opp_serve"),
        F.sum(F.when(F.col("serving") & (F.col("returned") > 0), F.col("attacks")).otherwise(0))
        .alias("attacks_from_opp_return"),
    )
    opponent = F.when(F.col("team") == F.col("home_team"), F.col("away_team")).otherwise(F.col("home_team"))
    named = {"serves": "Serve", "returns": "Reception", "digs": "Dig", "sets": "Set", "attacks": "Attack"}
    total = tallied.groupBy(*GAME, "team", opponent.alias("opponent")).agg(
        *[F.sum(f"n_{slug(v)}").alias(f"team_{k}") for k, v in named.items()],
        F.sum(F.col("n_kill") + F.col("n_first_ball_kill") + F.col("n_ace") + F.col("n_block")).alias("team_points"),
    )
    d = total.join(after, [*GAME, "team"], "left").fillna(
        0, ["sets_from_serve", "attacks_from_opp_serve", "attacks_from_opp_return"]
    )
    other = d.select(
        *GAME, F.col("team").alias("opponent"), F.col("team_serves").alias("opp_serves"),
        F.col("team_returns").alias("opp_returns"), F.col("team_points").alias("opp_points"),
    )
    d = d.join(other, [*GAME, "opponent"], "left").fillna(0, ["opp_serves", "opp_returns", "opp_points"])
    return d.withColumns({
        "attacks_per_opp_serve": N.safe_rate(F.col("attacks_from_opp_serve"), F.col("opp_serves")),
        "attacks_per_opp_return": N.safe_rate(F.col("attacks_from_opp_return"), F.col("opp_returns")),
        "sets_per_serve": N.safe_rate(F.col("sets_from_serve"), F.col("team_serves")),
        "point_pct": N.safe_rate(F.col("team_points"), F.col("team_points") + F.col("opp_points")),
    })


def player_rates(counted: DataFrame) -> DataFrame:
    """Serve outcomes per serve, other touches as share of the team's opportunities."""
    n, o = (lambda e: F.col(f"n_{e}")), (lambda e: F.col(f"opp_{e}"))
    kills, kill_chances = n("kill") + n("first_ball_kill"), o("kill") + o("first_ball_kill")
    error = N.safe_rate(n("service_error"), n("serve"))
    return counted.select(
        *GAME, "team", "player",
        (F.lit(1.0) - error).alias("serve_pct"), error.alias("serve_error_pct"),
        N.safe_rate(n("ace"), n("serve")).alias("ace_pct"),
        N.safe_rate(n("reception"), o("reception")).alias("return_pct"),
        N.safe_rate(n("dig"), o("dig")).alias("dig_pct"),
        N.safe_rate(n("set"), o("set")).alias("set_pct"),
        N.safe_rate(n("attack"), o("attack")).alias("attack_pct"),
        N.safe_rate(kills, kill_chances).alias("kill_pct"),
        n("serve").alias("serves"), n("ace").alias("aces"), n("set").alias("sets"),
        kills.alias("kills"),
    )


def replacement_values(pbp: DataFrame, chunk: int | None | str = "auto") -> DataFrame:
    """Mean expected point change of a game if each other player took the player's chances."""
    tallied = tallies(pbp)
    rates = player_rates(chances(tallied))
    teams = stable(team_rates(pbp, chunk, tallied).select(
        *GAME, "team", "point_pct", "team_digs", "team_sets", "sets_per_serve"
    ))
    c = F.col

    def serve_gain(serve_pct: Column, point_pct: Column) -> Column:
        # a kept serve may be followed by another one of the same run
        den = F.lit(1.0) - serve_pct * point_pct
        return N.safe_rate(F.lit(1.0), F.when(den > 1e-12, den))

    # terms of a replacement, for each team whose player could be replaced
    terms = {
        "g": c("g"), "ga": c("g") * c("ace_pct"), "k": c("kill_pct"),
        "sk": c("set_pct") * c("kill_pct"), "gk": c("g") * c("kill_pct"),
        "gak": c("g") * c("ace_pct") * c("kill_pct"),
    }
    candidates = rates.select(*GAME, "player", "team", "serve_pct", "ace_pct", "set_pct", "kill_pct")
    per_side = (
        candidates.withColumnRenamed("team", "own_team")
        .join(teams.select(*GAME, "team", "point_pct"), GAME)
        .withColumn("g", serve_gain(c("serve_pct"), c("point_pct")))
        .select(*GAME, "team", "own_team", "player", *[t.alias(f"t_{n}") for n, t in terms.items()])
    )
    sums = per_side.groupBy(*GAME, "team").agg(
        F.count(F.lit(1)).alias("players"), *[F.sum(f"t_{n}").alias(f"s_{n}") for n in terms]
    )
    own = per_side.filter(c("own_team") == c("team")).drop("own_team")
    d = (
        rates.join(teams, [*GAME, "team"]).join(sums, [*GAME, "team"])
        .join(own, [*GAME, "team", "player"])
    )
    m = {n: (c(f"s_{n}") - c(f"t_{n}")) / (c("players") - 1) for n in terms}
    # change = g S a - A + (T + D s - s0 + q (S g - S g a - S + A)) k - K, averaged term by term
    aces = c("serves") * m["ga"] - c("aces")
    base = c("team_sets") - c("sets") + c("sets_per_serve") * (c("aces") - c("serves"))
    kills = (
        base * m["k"] + c("team_digs") * m["sk"]
        + c("sets_per_serve") * c("serves") * (m["gk"] - m["gak"]) - c("kills")
    )
    return d.filter(c("players") > 1).select(
        *GAME, "team", "player", "players", (aces + kills).alias("replacement_value")
    )


def rank_players(values: DataFrame) -> DataFrame:
    """Mean over games, lowest first: the less a substitute would add, the better.

    Scores that agree to twelve places are ties, broken by team and player.
    """
    g = values.groupBy("season", "team", "player").agg(
        F.count(F.lit(1)).alias("games"), F.avg("replacement_value").alias("score")
    )
    order = [F.col("__s").asc(), F.col("team").asc(), F.col("player").asc()]
    g = g.withColumn("__s", F.round("score", 12))
    return ordered.row_numbers(g, ["season"], order, "rank").drop("__s")
