"""Domain constants. Everything here is a fixed value: the results depend on the exact numbers."""

from __future__ import annotations

# ---- metrics (fixed names) -------------------------------------------------
METRICS = [
    "pts_per36", "reb_per36", "ast_per36", "blk_per36", "stl_per36", "tov_per36",
    "fg3a_rate", "fta_rate", "ts_pct", "efg_pct", "ast_pct", "mpg",
]
PROSPECT_METRICS = [
    "mpg", "pts_per36", "reb_per36", "ast_per36", "blk_per36", "stl_per36",
    "ts_pct", "efg_pct", "fg3a_rate", "fta_rate",
]
SKILL_AXES = ["pts_per36", "reb_per36", "ast_per36", "blk_per36", "stl_per36", "ts_pct"]

# ---- positions (fixed sets) ------------------------------------------------
POSITION_WORDS = {
    "GUARD": "G", "FORWARD": "F", "CENTER": "C",
    "GUARD-FORWARD": "G-F", "FORWARD-GUARD": "F-G",
    "FORWARD-CENTER": "F-C", "CENTER-FORWARD": "C-F",
}
POSITION_GROUPS = {
    "G": ["G", "PG", "SG", "PG-SG", "SG-PG"],
    "W": ["F", "SF", "SG-SF", "SF-SG", "SF-PF", "PF-SF", "G-F", "F-G"],
    "B": ["C", "PF", "PF-C", "C-PF", "F-C", "C-F"],
}

# ---- impact score (fixed weights) ------------------------------------------
IMPACT_WEIGHTS = {
    "scoring": 0.32, "playmaking": 0.18, "efficiency": 0.08, "rebounding": 0.09,
    "steals": 0.12, "blocks": 0.07, "spacing": 0.08, "ball_security": 0.06,
}
IMPACT_EXPONENT = 0.72
VERSATILITY_EXPONENT = 0.28
CAREER_CREDIBILITY_MINUTES = 2500.0
SEASON_CREDIBILITY_MINUTES = 1500.0
LONGEVITY_MINUTES = 4000.0
WORKLOAD_MPG_EXPONENT = 0.50
WORKLOAD_VOLUME_EXPONENT = 0.25
RANK_CURVE = 1.2
LEGACY_CURVE = 1.5
PROSPECT_CURVE = 2.2
PROSPECT_ANCHOR = 0.50
SCORE_CEILING = 0.99
SHAPE_CONTRAST = 0.75
MPG_SCALED_METRICS = [
    "pts_per36", "ast_per36", "reb_per36", "stl_per36", "blk_per36",
    "ts_pct", "efg_pct", "fg3a_rate", "fta_rate",
]

# ---- player neighbours (fixed weights, in METRICS order) --------------------
PLAYSTYLE_WEIGHTS = [1.0, 1.9, 1.7, 1.6, 1.2, 0.5, 1.9, 1.1, 0.7, 0.6, 2.1, 0.6]
PLAYSTYLE_BANDWIDTH = 2.2
ARCHETYPE_BONUS = 0.18
SIZE_SIGMA = 12.0
WEIGHT_SIGMA = 36.0
CALIBER_SIGMA = 0.35
ROLE_BONUS = 1.07
ERA_REWARD = 0.10
ERA_TIMESCALE = 14.0
EXPLANATION_AXES = {
    "scoring volume": ["pts_per36", "mpg"],
    "creation": ["ast_per36", "ast_pct", "tov_per36"],
    "scoring efficiency": ["ts_pct", "efg_pct"],
    "shot mix": ["fg3a_rate", "fta_rate"],
    "defensive box score": ["stl_per36", "blk_per36"],
    "rebounding": ["reb_per36"],
}
EMBEDDING_WEIGHTS = {
    "height_inches": 1.2, "weight_lbs": 1.2, "fg3a_rate": 4.5, "reb_per36": 1.2,
    "ast_per36": 2.0, "ast_pct": 1.8, "stl_per36": 1.5, "blk_per36": 1.5, "fta_rate": 1.2,
    "efg_pct": 1.2, "pts_per36": 1.0, "mpg": 1.0, "ts_pct": 1.0, "tov_per36": 1.0,
}

# ---- cross-pool comps (fixed parameters) -----------------------------------
COMP_FEATURES = [
    "pts_per36", "reb_per36", "ast_per36", "blk_per36", "stl_per36", "fg3a_rate", "fta_rate",
    "ts_pct", "ast_pct", "mpg", "stocks", "scoring_load", "quality",
]
COMP_PERCENTILE_WEIGHTS = [
    0.0, 0.26, 0.0, 0.4172, 0.184, 0.1784, 0.1973, 0.1, 0.3473, 0.0513, 0.077, 0.0622, 0.1224,
]
COMP_ZSCORE_WEIGHTS = [0.1, 0.0, 0.0, 0.15, 0.1, 0.0, 0.1, 0.0, 0.0, 0.05, 0.0, 0.0, 0.0]
COMP_SIZE_WEIGHTS = [0.2903, 0.3185]
HYBRID_Z_SCALE = 0.25

# ---- teams (fixed names and thresholds) ------------------------------------
TEAM_FEATURES = [
    "pace", "off_rating", "def_rating", "ast_pct", "ast_to", "tm_tov_pct", "oreb_pct",
    "dreb_pct", "ts_pct", "fg3a", "fg3_pct", "paint_fga", "fta_rate",
]
TEAM_NEIGHBOUR_FEATURES = [
    "pace", "off_rating", "def_rating", "ast_pct", "tm_tov_pct",
    "oreb_pct", "dreb_pct", "ts_pct", "fg3a", "paint_fga",
]
STYLE_AXES = {
    "pace": ("pace", 1), "three_point_volume": ("fg3a", 1), "paint": ("paint_fga", 1),
    "defense": ("def_rating", -1), "playmaking": ("ast_pct", 1), "rebounding": ("reb_pct", 1),
}
BADGES = [
    "run_and_gun", "deep_threat", "paint_punishers", "defensive_wall", "playmakers",
    "grind_it_out", "glass_eaters", "foul_magnets", "iso_kings", "ball_movement",
]

# ---- roles and units (fixed names and thresholds) --------------------------
ROLES = [
    "Playmaker", "Secondary Creator", "Designated Scorer", "Perimeter Specialist",
    "Rim Attacker", "Interior Presence", "Defensive Specialist",
]
SHOOTER_MAKES = 1.8
UNIT_SCALE = 1.3333
BASELINE_METRICS = [
    "pace", "fg3a", "space", "paint_fga", "def_score", "ast", "ast_pct", "reb", "blk",
]
STYLE_AFFINITY_WEIGHTS = [0.75, 1.20, 1.00, 1.15, 1.20, 0.95]
STYLE_KEYS = ["pace", "three_point_volume", "paint", "defense", "playmaking", "rebounding"]
TRAITS = ["playmaking", "spacing", "rebounding", "paint_scoring", "defense", "scoring"]

QUALITY_FEATURES = [
    "talent_mean", "talent_top_two", "talent_floor", "scoring_mean", "scoring_peak",
    "efficiency_mean", "efficiency_floor", "playmaking_mean", "playmaking_peak",
    "rebounding_mean", "defense_mean", "availability_mean", "availability_floor",
]
FIT_CHANNELS = {
    "spacing_coverage": "spacing", "spacing_floor": "spacing",
    "creation_peak": "playmaking", "creation_support": "playmaking",
    "scoring_support": "playmaking", "perimeter_defense": "defense",
    "rim_protection": "defense", "rebounding_support": "interior",
    "two_way_coverage": "defense", "role_coverage": "overlap", "role_entropy": "overlap",
    "role_concentration": "overlap", "skill_redundancy": "overlap",
    "skill_diversity": "overlap", "guard_share": "overlap", "wing_share": "overlap",
    "big_share": "interior", "style_spacing": "spacing", "style_paint": "interior",
    "style_playmaking": "playmaking", "style_defense": "defense",
    "style_rebounding": "interior", "pace_extremity": "overlap",
    "inside_out_balance": "spacing", "creation_spacing": "playmaking",
    "defense_rebounding": "defense",
}
FIT_FEATURES = list(FIT_CHANNELS)
CHANNELS = ["playmaking", "spacing", "interior", "defense", "overlap"]

# ---- prospect projection (fixed ranges) ------------------------------------
PROJECTION_INPUT_RANGES = {
    "pts_per36": (0.0, 40.0), "reb_per36": (0.0, 22.0), "ast_per36": (0.0, 16.0),
    "blk_per36": (0.0, 7.0), "stl_per36": (0.0, 5.0), "ts_pct": (0.30, 0.80),
    "efg_pct": (0.25, 0.80), "fg3a_rate": (0.0, 0.95), "fta_rate": (0.0, 1.4),
    "mpg": (5.0, 40.0), "fg3_pct_college": (0.0, 0.60), "ast_pct_college": (0.0, 1.6),
    "height_in": (66.0, 90.0), "weight": (150.0, 320.0),
}
PROJECTION_OUTPUT_RANGES = {
    "pts_per36": (0.0, 40.0), "reb_per36": (0.0, 20.0), "ast_per36": (0.0, 14.0),
    "blk_per36": (0.0, 5.0), "stl_per36": (0.0, 4.0), "tov_per36": (0.0, 6.0),
    "fg3a_rate": (0.0, 0.95), "fta_rate": (0.0, 1.2), "ts_pct": (0.35, 0.75),
    "efg_pct": (0.3, 0.75), "ast_pct": (0.0, 60.0), "mpg": (8.0, 38.0), "fg3_pct": (0.20, 0.45),
}
ROLE_POSITION = {
    "Playmaker": "G", "Secondary Creator": "G", "Perimeter Specialist": "W",
    "Designated Scorer": "W", "Rim Attacker": "W", "Defensive Specialist": "W",
    "Interior Presence": "B",
}
PROSPECT_ID_BASE = 900_000_000
ROOKIE_MINUTES = 300.0
