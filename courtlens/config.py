"""Fixed values and model settings.

Everything in the first block must hold exactly these values for the published
tables to agree with earlier runs of the same analysis; it is data, not logic.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- fixed values -----------------------------------------------------------

PBP_COLUMNS = [
    "date", "contestid", "set", "away_team", "home_team", "score",
    "rally", "rally_event", "team", "event", "player", "description",
]

DEFAULT_SEASON = "2025-2026"

SOURCE_FILES = {
    "players": "wvb_playerseason_div1_{year}.csv",
    "player_match": "wvb_playermatch_div1_{year}.csv",
    "team_match": "wvb_teammatch_div1_{year}.csv",
    "pbp": "wvb_pbp_div1_{year}.csv",
}

HEADER_ALIASES = {
    "totalattacks": "total_attacks",
    "hitpct": "hit_pct",
    "blocksolos": "block_solos",
    "blockassists": "block_assists",
    "opponent_team": "opponent",
}

ROSTER_PSEUDO_PLAYERS = ["team", "totals", "opponent totals", "opponent"]

DROPPED_RESULTS = ["Ppd", "Canceled"]

ROLE_OF_POSITION = {
    "s": "setter", "setter": "setter",
    "mb": "middle", "mh": "middle", "m": "middle", "middle blocker": "middle",
    "oh": "outside", "ls": "outside", "os": "outside", "outside hitter": "outside",
    "rs": "opposite", "opp": "opposite", "opposite": "opposite", "right side": "opposite",
    "l": "libero_ds", "ds": "libero_ds", "l/ds": "libero_ds", "libero": "libero_ds",
}

ROLES = ["setter", "middle", "outside", "opposite", "libero_ds", "unknown"]

TEAM_ALIASES = {
    "app state": "app state",
    "arkansas state": "arkansas st.",
    "cal baptist": "california baptist",
    "coastal carolina": "coastal carolina",
    "ga southern": "ga. southern",
    "georgia southern": "ga. southern",
    "georgia state": "georgia st.",
    "la.-monroe": "ulm",
    "louisiana monroe": "ulm",
    "loyola marymount": "lmu (ca)",
    "miami ohio": "miami (oh)",
    "miami (ohio)": "miami (oh)",
    "saint marys": "saint marys (ca)",
    "saint marys ca": "saint marys (ca)",
    "saint peters": "saint peters",
    "st thomas": "st. thomas (mn)",
    "st. thomas": "st. thomas (mn)",
    "texas rio grande valley": "utrgv",
    "ut rio grande valley": "utrgv",
}

TOURNAMENT_WORDS = ["classic", "challenge", "invitational", "tournament", "regional", "showcase"]

# family, pattern on the event label, pattern on the description; first match wins
EVENT_RULES = [
    ("kill", r"first ball kill", r"first ball kill"),
    ("ace", r"service ace|^ace$", r"service ace| ace by"),
    ("service_error", r"service error", r"service error"),
    ("reception_error", r"reception error", r"reception error"),
    ("set_error", r"set error|ball handling error", r"set error|ball handling error"),
    ("attack_error", r"attack error", r"attack error"),
    ("block_error", r"block error", r"block error"),
    ("dig_error", r"dig error", r"dig error"),
    ("serve", r"^serve$| serves", r" serves$"),
    ("reception", r"^reception$|reception by", r"reception by"),
    ("set", r"^set$|set by", r"set by"),
    ("attack", r"^attack$", r"attack by"),
    ("kill", r"^kill$| kill by", r" kill by"),
    ("dig", r"^dig$|dig by", r"dig by"),
    ("block", r"^block$|block by", r"block by"),
]

EVENT_WEIGHTS = {
    "serve": 0.1, "reception": 0.2, "set": 0.2, "attack": 0.3, "kill": 1.0, "ace": 1.0,
    "dig": 0.25, "block": 0.8, "attack_error": 1.0, "service_error": 1.0,
    "reception_error": 1.0, "set_error": 1.0, "block_error": 0.8, "dig_error": 0.8,
}

FAMILIES = list(EVENT_WEIGHTS)

BOX_STATS = [
    "p", "s", "ms", "kills", "errors", "total_attacks", "assists", "aces", "serr", "digs",
    "rerr", "block_solos", "block_assists", "berr", "tb", "pts", "bhe", "retatt",
]

ROLE_BLEND = {  # event, tabular, serve-receive
    "libero_ds": (0.55, 0.15, 0.30),
    "outside": (0.60, 0.20, 0.20),
    "opposite": (0.70, 0.25, 0.05),
    "setter": (0.70, 0.25, 0.05),
    "middle": (0.75, 0.25, 0.00),
    "unknown": (0.75, 0.25, 0.00),
}
ROLE_BLEND_DEFAULT = (0.75, 0.25, 0.00)

WP_FEATURES = [
    "set_number", "home_sets", "away_sets", "home_points", "away_points", "home_score_diff",
    "total_points", "home_server", "away_server", "is_fifth_set", "is_late_set",
    "is_deuce_or_later",
]

FIRST_BALL_COUNTS = [
    "fb_receptions", "fb_clean_receptions", "fb_reception_errors", "fb_attacks", "fb_kills",
    "fb_middle_attacks", "fb_receive_point_wins",
]
FIRST_BALL_RATES = [
    "fb_attack_rate", "fb_kill_rate", "fb_middle_attack_rate", "fb_reception_error_rate",
    "fb_receive_point_win_rate",
]

GAME_EVENTS = [
    "Serve", "Service error", "Reception", "Set", "Set error", "Attack", "Attack error",
    "Ace", "Block", "Dig", "First ball kill", "Kill",
]

RANKING_TABLE_COLUMNS = [
    "overall_rank", "role_rank", "player", "team", "conference", "role_family",
    "overall_score", "event_rallies", "calc_hit_pct", "sr_shrunk_value",
    "meets_volume_threshold",
]

SEED = 42

# --- settings that callers may change ---------------------------------------


@dataclass(frozen=True)
class ModelConfig:
    """Weights, thresholds and shrinkage of the rating stage."""

    attack_efficiency_weight: float = 0.65
    kill_rate_weight: float = 0.25
    attack_error_weight: float = 0.10
    phase_shrinkage: float = 500.0
    attack_factor: float = 0.08
    defense_factor: float = 0.08
    min_multiplier: float = 0.75
    max_multiplier: float = 1.25
    serve_point_win_weight: float = 0.50
    serve_ace_weight: float = 0.35
    forced_reception_error_weight: float = 0.15
    serve_error_weight: float = 0.25
    server_shrinkage: float = 100.0
    sr_point_win_weight: float = 0.35
    sr_kill_weight: float = 0.25
    sr_middle_weight: float = 0.10
    sr_attack_weight: float = 0.15
    sr_error_weight: float = 0.15
    sr_shrinkage: float = 100.0
    impact_tau: float = 250.0
    min_rallies: int = 200
    high_attack_total_attacks: int = 150
    high_attack_kills: int = 80
    high_attack_event_kills: int = 80
    setter_assists: int = 500
    setter_event_sets: int = 1000
    libero_max_total_attacks: int = 50
    libero_max_assists: int = 200
    tabular_min_rallies: int = 100
    tabular_min_players: int = 10
    aux_min_rows: int = 50
    aux_max_rows: int = 0    # 0: outcomes are learnt from all rows
    aux_folds: int = 0   # 0: every row is scored by a model that it helped to fit
    wp_max_rallies: int = 0  # 0: win probability is learnt from all training rallies
    logistic_max_iter: int = 500
    mlp_max_iter: int = 150
    mlp_hidden: tuple = (64, 32)
    train_fraction: float = 0.70
    valid_fraction: float = 0.85
    team_strength_weight: float = 0.30
    tanh_scale: float = 3.0
    cdf_scale: float = 100.0
    libero_attack_volume: int = 100
    libero_event_kills: int = 50
    high_rank_cutoff: int = 100
    low_volume_rallies: int = 500
    low_efficiency_attack_volume: int = 300
    low_efficiency_hit_pct: float = 0.20
    event_weights: dict = field(default_factory=lambda: dict(EVENT_WEIGHTS))
    role_blend: dict = field(default_factory=lambda: dict(ROLE_BLEND))

    def but(self, **changes) -> "ModelConfig":
        return replace(self, **changes)


DEFAULT = ModelConfig()
