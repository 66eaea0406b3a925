"""Role inference, blended scores, ranks, audit and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlens.config import BOX_STATS, DEFAULT, FAMILIES, ROLE_BLEND_DEFAULT, ModelConfig
from courtlens.functions import numeric as N
from courtlens.functions import text as T
from courtlens.operators import ordered, shape, stats
from courtlens.plans.models import ridge_by_group
from courtlens.plans.roster import PLAYER_KEY
from courtlens.session import stable

# --- fixed values: names of published columns, in their published order ---

CREDIT_COLUMNS = [
    "event_touches", "event_rallies", "raw_event_credit", "raw_base_event_credit",
    "positive_event_credit", "negative_event_credit", "mean_event_credit",
    "avg_context_multiplier", "avg_opp_block_strength_index", "avg_opp_attack_strength_index",
]
RATE_INPUTS = [
    "box_kills", "box_errors", "box_total_attacks", "box_aces", "box_serr", "box_digs", "box_rerr",
    "box_assists", "event_rallies", "event_touches", "fb_receptions", "fb_reception_errors",
    "fb_kills", "fb_middle_attacks",
]
RATES = [
    "calc_hit_pct", "kill_rate_per_attempt", "attack_error_rate", "serve_error_rate",
    "box_reception_error_rate", "touches_per_rally", "fb_reception_error_rate", "fb_kill_rate",
    "fb_middle_attack_rate",
]
SCHEDULE = [
    "matches_played_rows", "team_strength_index", "opp_strength_index",
    "team_strength_missing_rate", "opp_strength_missing_rate",
]
# season statistics the ridge reads: everything numeric but credit values, ids and sr_*
TABULAR_FEATURES = [
    *SCHEDULE, *[f"box_{c}" for c in BOX_STATS],
    "fb_receptions", "fb_clean_receptions", "fb_reception_errors", "fb_attacks", "fb_kills",
    "fb_middle_attacks", "fb_receive_point_wins", "fb_attack_rate", "fb_receive_point_win_rate",
    "event_touches", "event_rallies", "avg_context_multiplier", "avg_opp_block_strength_index",
    "avg_opp_attack_strength_index", *[f"event_count_{f}" for f in FAMILIES], *RATES,
]
RANK_COLUMNS = [
    "season", "role_family", "roster_role_family", "role_inferred_from_profile", "role_rank",
    "overall_rank", "role_score", "overall_score", "final_value_z", "score_z", "event_value_z",
    "tabular_value_z", "serve_receive_value_z", "blended_value_z", "team_strength_value_z",
    "event_blend_weight", "tabular_blend_weight", "serve_receive_blend_weight",
    "shrunk_event_value", "shrunk_credit_per_rally", "raw_event_credit", "raw_base_event_credit",
    "raw_credit_per_rally", "event_rallies", "event_touches", "meets_volume_threshold", "player",
    "team", "conference", "pos", "player_clean", "team_clean", "player_uid",
    "positive_event_credit", "negative_event_credit", "tabular_pred_value",
]
_EXTRA = {
    "team_strength_index", "opp_strength_index", "matches_played_rows", "calc_hit_pct",
    "kill_rate_per_attempt", "attack_error_rate", "serve_error_rate", "box_reception_error_rate",
    "touches_per_rally", "avg_context_multiplier", "avg_opp_block_strength_index",
    "avg_opp_attack_strength_index",
}
AUDIT_COLUMNS = [
    "season", "overall_rank", "role_rank", "player", "team", "conference", "pos", "role_family",
    "roster_role_family", "inferred_role_family", "role_inferred_from_profile",
    "role_mismatch_flag", "hitter_in_libero_bucket_flag", "low_efficiency_high_rank_flag",
    "low_volume_high_rank_flag", "audit_reason", "overall_score", "role_score", "event_rallies",
    "event_touches", "touches_per_rally", "box_kills", "box_errors", "box_total_attacks",
    "calc_hit_pct", "kill_rate_per_attempt", "attack_error_rate", "attacks_per_rally",
    "box_assists", "box_digs", "box_rerr", "box_serr", "event_count_kill", "event_count_attack",
    "event_count_attack_error", "event_count_reception", "event_count_reception_error",
    "event_count_set", "event_count_service_error", "sr_attempts", "sr_avg_server_toughness",
    "sr_reception_error_rate", "sr_first_ball_kill_rate", "sr_first_ball_middle_attack_rate",
    "sr_receive_point_win_rate", "sr_error_avoided_oe", "sr_first_ball_kill_oe",
    "sr_first_ball_middle_attack_oe", "sr_receive_point_win_oe", "sr_shrunk_value",
    "serve_receive_value_z", "avg_context_multiplier", "avg_opp_block_strength_index",
    "avg_opp_attack_strength_index", "raw_event_credit", "raw_base_event_credit",
    "shrunk_event_value", "positive_event_credit", "negative_event_credit",
]


def inferred_role(base: Column, cfg: ModelConfig = DEFAULT) -> Column:
    """Role from season volume and position text; the later rule wins over the earlier."""
    pos = F.lower(F.coalesce(F.col("pos").cast("string"), F.lit("")))
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    hitter = (
        (v("box_total_attacks") >= cfg.high_attack_total_attacks)
        | (v("box_kills") >= cfg.high_attack_kills)
        | (v("event_count_kill") >= cfg.high_attack_event_kills)
    )
    setter = (
        (pos == "s") | (v("box_assists") >= cfg.setter_assists)
        | (v("event_count_set") >= cfg.setter_event_sets)
    )
    middle = pos.rlike(r"\b(?:mb|mh|m|middle)\b")
    opposite = pos.rlike(r"\b(?:rs|opp|opposite|right side)\b")
    libero = (
        pos.rlike(r"\b(?:l|ds|libero)\b")
        & (v("box_total_attacks") < cfg.libero_max_total_attacks)
        & (v("box_assists") < cfg.libero_max_assists)
    )
    return (
        F.when(setter, "setter").when(libero, "libero_ds")
        .when(hitter & opposite, "opposite").when(hitter & middle, "middle")
        .when(hitter, "outside").otherwise(F.coalesce(base, F.lit("unknown")))
    )


def with_basic_rates(df: DataFrame) -> DataFrame:
    """Readable season rates, 0 where the denominator is."""
    df = N.zero_filled(df, RATE_INPUTS)
    c = F.col
    received = c("box_retatt") if "box_retatt" in df.columns else F.lit(0.0)
    return df.withColumns({
        "calc_hit_pct": N.safe_rate(c("box_kills") - c("box_errors"), c("box_total_attacks")),
        "kill_rate_per_attempt": N.safe_rate(c("box_kills"), c("box_total_attacks")),
        "attack_error_rate": N.safe_rate(c("box_errors"), c("box_total_attacks")),
        "serve_error_rate": N.safe_rate(c("box_serr"), c("box_aces") + c("box_serr")),
        "box_reception_error_rate": N.safe_rate(c("box_rerr"), received),
        "touches_per_rally": N.safe_rate(c("event_touches"), c("event_rallies")),
        "fb_reception_error_rate": N.safe_rate(c("fb_reception_errors"), c("fb_receptions")),
        "fb_kill_rate": N.safe_rate(c("fb_kills"), c("fb_receptions")),
        "fb_middle_attack_rate": N.safe_rate(c("fb_middle_attacks"), c("fb_receptions")),
    })


def with_shrunk_impact(df: DataFrame, cfg: ModelConfig = DEFAULT) -> DataFrame:
    """Credit per rally pulled toward the role mean, times rallies."""
    df = df.withColumn(
        "raw_credit_per_rally", N.safe_rate(F.col("raw_event_credit"), F.col("event_rallies"))
    )
    df = stats.shrink_to_group_mean(
        df, ["season", "role_family"], "raw_credit_per_rally", "event_rallies", cfg.impact_tau,
        "shrunk_credit_per_rally",
    )
    return df.withColumn(
        "shrunk_event_value", F.col("shrunk_credit_per_rally") * F.col("event_rallies")
    )


def blend_weights(role: Column, cfg: ModelConfig = DEFAULT) -> list[Column]:
    """Event, tabular and serve-receive weight of a role, summing to 1."""
    raw = []
    for i in range(3):
        w = F
        for name, weights in cfg.role_blend.items():
            w = w.when(role == name, F.lit(float(weights[i])))
        raw.append(w.otherwise(F.lit(float(ROLE_BLEND_DEFAULT[i]))))
    total = raw[0] + raw[1] + raw[2]
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return [w / total for w in raw]


def player_values(
    features: DataFrame, credit: DataFrame, receive: DataFrame | None, cfg: ModelConfig = DEFAULT
) -> DataFrame:
    """Season features, event credit and serve-receive value side by side, with roles."""
    d = features.join(
        credit.drop("player", "team", "role_family", "player_uid"), PLAYER_KEY, "left"
    )
    if receive is not None:
        d = d.join(
            receive.drop("player", "team", "conference", "role_family", "player_uid"),
            PLAYER_KEY, "left",
        )
    added = [
        c for c in d.columns
        if c in CREDIT_COLUMNS or c.startswith(("event_count_", "sr_"))
    ]
    d = N.zero_filled(d, [*dict.fromkeys([
        *added, *CREDIT_COLUMNS, *[f"event_count_{f}" for f in FAMILIES], "sr_shrunk_value",
    ])])
    d = d.withColumn("roster_role_family", F.coalesce("role_family", F.lit("unknown")))
    d = d.withColumn("role_family", inferred_role(F.col("roster_role_family"), cfg))
    return d.withColumn(
        "role_inferred_from_profile", F.col("role_family") != F.col("roster_role_family")
    )


def impact_rows(
    features: DataFrame, credit: DataFrame, receive: DataFrame | None, cfg: ModelConfig = DEFAULT
) -> DataFrame:
    """One written row per player and season with rates and shrunk impact: the input of the ridge and the scores."""
    return stable(with_shrunk_impact(with_basic_rates(player_values(features, credit, receive, cfg)), cfg))


def tabular_inputs(d: DataFrame) -> list[str]:
    return [c for c in TABULAR_FEATURES if c in d.columns]


def rankings(d: DataFrame, cfg: ModelConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Final scores and ranks per season of ``impact_rows``, and the ridge model chosen for each role."""
    d, models = ridge_by_group(
        d, ["season", "role_family"], tabular_inputs(d),
        "shrunk_event_value", F.col("event_rallies") >= cfg.tabular_min_rallies,
        "tabular_pred_value", cfg.tabular_min_players,
    )
    return stable(with_ranks(with_scores(d, cfg))), stable(models)


def with_scores(d: DataFrame, cfg: ModelConfig = DEFAULT) -> DataFrame:
    """Role z-scores, blend, team prior and the 0-100 score."""
    d = stats.zscores(d, ["season", "role_family"], {
        "event_value_z": "shrunk_event_value", "tabular_value_z": "tabular_pred_value",
        "serve_receive_value_z": "sr_shrunk_value",
    })
    d = stats.zscores(d, ["season"], {"team_strength_value_z": "team_strength_index"})
    w = blend_weights(F.col("role_family"), cfg)
    names = ["event_blend_weight", "tabular_blend_weight", "serve_receive_blend_weight"]
    d = d.withColumns(dict(zip(names, w)))
    d = d.withColumn(
        "blended_value_z",
        F.col(names[0]) * F.col("event_value_z") + F.col(names[1]) * F.col("tabular_value_z")
        + F.col(names[2]) * F.col("serve_receive_value_z"),
    )
    d = d.withColumn(
        "final_value_z",
        F.col("blended_value_z") + cfg.team_strength_weight * F.col("team_strength_value_z"),
    )
    d = d.withColumn("score_z", N.squash(F.col("final_value_z"), cfg.tanh_scale))
    d = d.withColumn("role_score", cfg.cdf_scale * N.normal_cdf(F.col("score_z")))
    return d.withColumns({
        "overall_score": F.col("role_score"),
        "meets_volume_threshold": F.col("event_rallies") >= cfg.min_rallies,
    })


def with_ranks(d: DataFrame) -> DataFrame:
    """Dense ranks by final value, per role and overall, within the season.

    Values that agree to twelve places tie, so that ranks do not hang on the order in
    which a run happened to add up its sums.
    """
    d = stable(d.withColumn("__v", F.round("final_value_z", 12)))
    d = ordered.dense_ranks(d, "__v", {"role_rank": ["season", "role_family"], "overall_rank": ["season"]})
    extra = [
        c for c in d.columns
        if (c.startswith(("box_", "fb_", "sr_", "event_count_")) or c in _EXTRA)
        and c not in RANK_COLUMNS
    ]
    return d.select(*RANK_COLUMNS, *extra)


def top_by_role(ranked: DataFrame, n: int = 25) -> DataFrame:
    """Best ``n`` of each role among players above the volume threshold."""
    return shape.top_per_group(
        ranked.filter("meets_volume_threshold"), ["season", "role_family"],
        [F.col("role_rank"), F.col("overall_rank"), F.col("player_clean"), F.col("team_clean")], n,
    )


def role_audit(ranked: DataFrame, cfg: ModelConfig = DEFAULT, shares: bool = False) -> DataFrame:
    """Rankings that deserve a second look, with the reasons spelt out.

    ``shares`` adds the reception, set and attack shares of a player's touches.
    """
    needed = [
        "box_kills", "box_errors", "box_total_attacks", "box_assists", "box_digs", "box_rerr",
        "box_serr", "event_rallies", "event_touches", "event_count_attack", "event_count_kill",
        "event_count_reception", "event_count_set",
    ]
    d = with_basic_rates(N.zero_filled(ranked, needed))
    c = F.col
    roster = F.coalesce(
        c("roster_role_family" if "roster_role_family" in ranked.columns else "role_family"),
        F.lit("unknown"),
    )
    d = d.withColumns({
        "attacks_per_rally": N.safe_rate(c("box_total_attacks"), c("event_rallies")),
        "reception_share_of_touches": N.safe_rate(c("event_count_reception"), c("event_touches")),
        "set_share_of_touches": N.safe_rate(c("event_count_set"), c("event_touches")),
        "attack_share_of_touches": N.safe_rate(
            c("event_count_attack") + c("event_count_kill"), c("event_touches")
        ),
        "roster_role_family": roster,
        "inferred_role_family": inferred_role(roster, cfg),
    })
    high = c("overall_rank") <= cfg.high_rank_cutoff
    d = d.withColumns({
        "role_mismatch_flag": c("inferred_role_family") != c("roster_role_family"),
        "hitter_in_libero_bucket_flag": (c("roster_role_family") == "libero_ds") & (
            (c("box_total_attacks") >= cfg.libero_attack_volume)
            | (c("event_count_kill") >= cfg.libero_event_kills)
        ),
        "low_efficiency_high_rank_flag": high
        & (c("box_total_attacks") >= cfg.low_efficiency_attack_volume)
        & (c("calc_hit_pct") < cfg.low_efficiency_hit_pct),
        "low_volume_high_rank_flag": high & (c("event_rallies") < cfg.low_volume_rallies),
    })
    # fixed values: the published texts of the reasons
    d = d.withColumn("audit_reason", T.join_reasons(
        (c("hitter_in_libero_bucket_flag"), F.lit("libero_ds label with hitter-level attack volume")),
        (c("role_mismatch_flag"), F.concat(
            F.lit("inferred role "), c("inferred_role_family"), F.lit(" differs from roster role "),
            c("roster_role_family"),
        )),
        (c("low_efficiency_high_rank_flag"),
         F.lit("top-100 rank despite sub-.200 calculated hitting percentage")),
        (c("low_volume_high_rank_flag"), F.lit(
            f"top-{cfg.high_rank_cutoff} rank on fewer than {cfg.low_volume_rallies} event rallies"
        )),
    ))
    extra = ["reception_share_of_touches", "set_share_of_touches", "attack_share_of_touches"]
    return d.select(*[a for a in AUDIT_COLUMNS if a in d.columns], *(extra if shares else []))
