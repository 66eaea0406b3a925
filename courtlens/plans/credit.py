"""Team phase context and win-probability credit per touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens.config import DEFAULT, FAMILIES, ModelConfig
from courtlens.functions import numeric as N
from courtlens.operators import ordered, stats
from courtlens.operators.joins import checked_broadcast
from courtlens.plans.firstball import ATTACKS
from courtlens.plans.playbyplay import RALLY_KEY
from courtlens.plans.roster import PLAYER_KEY


def _with_opponent(events: DataFrame) -> DataFrame:
    return events.withColumns({
        "is_action_row": N.loose_bool(F.col("is_action_row")),
        "opponent_team": F.when(F.col("actor_side") == "home", F.col("away_clean"))
        .otherwise(F.col("home_clean")),
    })


def team_phase_context(events: DataFrame, cfg: ModelConfig = DEFAULT) -> DataFrame:
    """Attack and block strength of each team, shrunk by volume.

    Every action is counted once for the acting team and once for its opponent; both
    roles go through one partial aggregate.
    """
    e = _with_opponent(events).filter(
        F.col("is_action_row") & F.col("actor_side").isin("home", "away")
        & F.col("actor_team").isNotNull()
    )
    both = e.select(
        "season", "event_family",
        F.explode(F.array(
            F.struct(F.col("actor_team").alias("team_clean"), F.lit(True).alias("acts")),
            F.struct(F.col("opponent_team").alias("team_clean"), F.lit(False).alias("acts")),
        )).alias("t"),
    ).select("season", "event_family", "t.*").filter(F.col("team_clean").isNotNull())
    acts, family = F.col("acts"), F.col("event_family")
    c = both.groupBy("season", "team_clean").agg(
        *[F.count_if(acts & (family == f)).alias(name) for f, name in (
            ("attack", "team_attack_events"), ("kill", "team_kills"),
            ("attack_error", "team_attack_errors"), ("block", "team_blocks"),
        )],
        F.count_if(~acts & family.isin(ATTACKS)).alias("opponent_attack_events_faced"),
    )
    attempts = F.col("team_attack_events") + F.col("team_kills") + F.col("team_attack_errors")
    c = c.withColumn("team_attack_attempts", attempts)
    rate = lambda a, b: N.safe_rate(a, F.col(b))
    c = c.withColumns({
        "team_attack_efficiency": rate(
            F.col("team_kills") - F.col("team_attack_errors"), "team_attack_attempts"
        ),
        "team_kill_rate": rate(F.col("team_kills"), "team_attack_attempts"),
        "team_attack_error_rate": rate(F.col("team_attack_errors"), "team_attack_attempts"),
        "team_block_rate_faced": rate(F.col("team_blocks"), "opponent_attack_events_faced"),
    })
    c = stats.zscores(c, ["season"], {
        "__e": "team_attack_efficiency", "__k": "team_kill_rate",
        "__x": "team_attack_error_rate", "__b": "team_block_rate_faced",
    })
    blend = (
        cfg.attack_efficiency_weight * F.col("__e") + cfg.kill_rate_weight * F.col("__k")
        - cfg.attack_error_weight * F.col("__x")
    )
    return c.withColumns({
        "team_attack_strength_index":
            N.shrink(F.col("team_attack_attempts"), cfg.phase_shrinkage) * blend,
        "team_block_strength_index":
            N.shrink(F.col("opponent_attack_events_faced"), cfg.phase_shrinkage) * F.col("__b"),
    }).drop("__e", "__k", "__x", "__b")


def event_weight(family: Column, cfg: ModelConfig = DEFAULT) -> Column:
    pairs = [F.lit(v) for kv in cfg.event_weights.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), family), F.lit(0.0))


def context_multiplier(cfg: ModelConfig = DEFAULT) -> Column:
    """Small bump for touches against strong opponents, clipped."""
    f = F.col("event_family")
    block, attack = F.col("opp_block_strength_index"), F.col("opp_attack_strength_index")
    one = F.lit(1.0)
    m = (
        F.when(f.isin("kill", "attack"), one + cfg.attack_factor * block)
        .when(f == "attack_error", one - cfg.attack_factor * block)
        .when(f.isin("block", "dig"), one + cfg.defense_factor * attack)
        .when(f.isin("block_error", "dig_error"), one - cfg.defense_factor * attack)
        .otherwise(one)
    )
    return N.clip(m, cfg.min_multiplier, cfg.max_multiplier)


def event_credit(
    events: DataFrame, values: DataFrame, context: DataFrame | None = None,
    cfg: ModelConfig = DEFAULT, hot: bool = False,
) -> DataFrame:
    """Each touch's share of its rally's win-probability change, for the actor's side.

    The share is the touch weight over the weight of all credited touches of the rally,
    of both teams. Rally weight and rally value share one exchange of the touches; with
    ``hot`` the weights are pre-aggregated instead, so no window holds a large rally.
    """
    e = _with_opponent(events).filter(
        F.col("is_action_row") & F.col("event_family").isin(list(cfg.event_weights))
        & (F.coalesce(F.col("player_clean"), F.lit("")) != "")
        & F.col("actor_side").isin("home", "away")
    ).withColumns({
        "team_clean": F.col("actor_team"), "event_weight": event_weight(F.col("event_family"), cfg),
    })
    e = ordered.attach(e, RALLY_KEY, {"rally_weight": F.sum("event_weight")}, hot)
    d = e.join(
        values.select(*RALLY_KEY, "home_wpa", "home_wp_before", "home_wp_after"), RALLY_KEY, "left"
    )
    d = d.withColumns({
        "event_weight_share": N.safe_rate(F.col("event_weight"), F.col("rally_weight")),
        "team_wpa": F.when(F.col("actor_side") == "home", F.col("home_wpa")).otherwise(-F.col("home_wpa")),
    }).withColumn("base_event_credit", F.col("team_wpa") * F.col("event_weight_share"))
    if context is None:
        d = d.withColumns({
            "opp_block_strength_index": F.lit(0.0), "opp_attack_strength_index": F.lit(0.0)
        })
    else:
        small = context.select(
            "season", F.col("team_clean").alias("opponent_team"),
            F.col("team_block_strength_index").alias("opp_block_strength_index"),
            F.col("team_attack_strength_index").alias("opp_attack_strength_index"),
        )
        d = d.join(checked_broadcast(small), ["season", "opponent_team"], "left").fillna(
            0.0, ["opp_block_strength_index", "opp_attack_strength_index"]
        )
    d = d.withColumn("context_multiplier", context_multiplier(cfg))
    d = d.withColumn("event_credit", F.col("base_event_credit") * F.col("context_multiplier"))
    return d.withColumns({
        "positive_credit": N.clip(F.col("event_credit"), low=0.0),
        "negative_credit": N.clip(F.col("event_credit"), high=0.0),
    })


def player_event_credit(credit: DataFrame) -> DataFrame:
    """Season totals per player, with one count column per event family.

    Distinct rallies are counted by a first aggregate per (player, rally), so a player
    with very many touches is spread over all tasks.
    """
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("contestid", "set_no", "file_row")))
    sums = ["event_credit", "base_event_credit", "positive_credit", "negative_credit",
            "context_multiplier", "opp_block_strength_index", "opp_attack_strength_index"]
    firsts = {"player": "player", "team": "actor_team", "player_uid": "player_uid",
              "role_family": "role_family"}
    per_rally = credit.groupBy(*PLAYER_KEY, "contestid", "set_no", "rally_id").agg(
        F.count(F.lit(1)).alias("touches"),
        *[F.sum(c).alias(c) for c in sums], F.count("event_credit").alias("__credited"),
        *[F.count_if(F.col("event_family") == f).alias(f"event_count_{f}") for f in FAMILIES],
        *[first(s).alias(o) for o, s in firsts.items()],
        F.min("file_row").alias("file_row"),
    )
    n = F.sum("touches")
    return per_rally.groupBy(*PLAYER_KEY).agg(
        *[first(o).alias(o) for o in firsts],
        n.alias("event_touches"),
        F.count(F.lit(1)).alias("event_rallies"),
        F.coalesce(F.sum("event_credit"), F.lit(0.0)).alias("raw_event_credit"),
        F.coalesce(F.sum("base_event_credit"), F.lit(0.0)).alias("raw_base_event_credit"),
        F.coalesce(F.sum("positive_credit"), F.lit(0.0)).alias("positive_event_credit"),
        F.coalesce(F.sum("negative_credit"), F.lit(0.0)).alias("negative_event_credit"),
        F.try_divide(F.sum("event_credit"), F.sum("__credited")).alias("mean_event_credit"),
        (F.sum("context_multiplier") / n).alias("avg_context_multiplier"),
        (F.sum("opp_block_strength_index") / n).alias("avg_opp_block_strength_index"),
        (F.sum("opp_attack_strength_index") / n).alias("avg_opp_attack_strength_index"),
        *[F.sum(f"event_count_{f}").alias(f"event_count_{f}") for f in FAMILIES],
    )
