"""Names and fixed values of the event and metric model. All are fixed values that results depend on."""

from __future__ import annotations

FIELD_X, FIELD_Y, YARD = 120.0, 80.0, 0.9144
DEEP_RADIUS, HIGH_TURNOVER_X = 20.0 / YARD, FIELD_X - 40.0 / YARD
PROGRESSIVE, REGAIN_SECONDS, LOOKBACK = 0.25, 5.0, 2
SET_PIECES = ["Corner", "Free Kick", "Throw-in", "Goal Kick", "Kick Off"]
TOUCHES = ["Ball Receipt*", "Carry", "Dribble", "Shot", "Clearance", "Miscontrol", "Goal Keeper"]
CREDITED = ["Pass", "Carry", "Dribble", "Foul Won", "Shot"]
ON_TARGET = ["Goal", "Saved", "Saved to Post"]
TACKLE_WON = ["Won", "Success In Play", "Success Out"]
OPEN_PLAY = ["Regular Play", "From Counter", "From Kick Off"]

POSITIONS = [
    "Goalkeeper", "Right Back", "Right Center Back", "Center Back", "Left Center Back", "Left Back", "Right Wing Back",
    "Left Wing Back", "Right Defensive Midfield", "Center Defensive Midfield", "Left Defensive Midfield", "Right Midfield",
    "Right Center Midfield", "Center Midfield", "Left Center Midfield", "Left Midfield", "Right Wing", "Right Attacking Midfield",
    "Center Attacking Midfield", "Left Attacking Midfield", "Left Wing", "Right Center Forward", "Center Forward",
    "Left Center Forward", "Secondary Striker",
]

# Threat by rows of y (8) and columns of x (12).
THREAT = [
    [0.006383, 0.007796, 0.008449, 0.009777, 0.011263, 0.012483, 0.014736, 0.017451, 0.021221, 0.027563, 0.034851, 0.043179],
    [0.007501, 0.008786, 0.009424, 0.010595, 0.012147, 0.013845, 0.016118, 0.018703, 0.024015, 0.029533, 0.040670, 0.043951],
    [0.008880, 0.009777, 0.010013, 0.011105, 0.012692, 0.014291, 0.016856, 0.019351, 0.024122, 0.028552, 0.054911, 0.064426],
    [0.009411, 0.010827, 0.010165, 0.011324, 0.012626, 0.014846, 0.016895, 0.019971, 0.023851, 0.035113, 0.108051, 0.257454],
    [0.009411, 0.010827, 0.010165, 0.011324, 0.012626, 0.014846, 0.016895, 0.019971, 0.023851, 0.035113, 0.108051, 0.257454],
    [0.008880, 0.009777, 0.010013, 0.011105, 0.012692, 0.014291, 0.016856, 0.019351, 0.024122, 0.028552, 0.054911, 0.064426],
    [0.007501, 0.008786, 0.009424, 0.010595, 0.012147, 0.013845, 0.016118, 0.018703, 0.024015, 0.029533, 0.040670, 0.043951],
    [0.006383, 0.007796, 0.008449, 0.009777, 0.011263, 0.012483, 0.014736, 0.017451, 0.021221, 0.027563, 0.034851, 0.043179],
]

PLAYER_COUNTS = [
    "passes", "passes_completed", "progressive_passes", "progressive_carries", "passes_into_final_third", "xt", "xa",
    "passes_into_penalty_area", "deep_completions", "sca", "shots", "np_shots", "goals", "np_goals", "shots_on_target", "xg", "npxg",
    "touches_in_att_pen_area", "take_ons", "take_ons_won", "fouls_drawn", "dispossessed", "tackles", "tackles_won", "dribbled_past",
    "duels_total", "duels_won", "aerial_won", "aerial_lost", "aerial_won_off", "aerial_won_def", "interceptions", "ball_recoveries",
    "padj_def_actions", "blocks", "clearances", "pressures", "pressure_regains", "counterpressures",
]
PLAYER_RATIOS = [
    ("pass_completion_pct", "passes_completed", "passes"), ("take_ons_pct", "take_ons_won", "take_ons"), ("aerial_won_pct", "aerial_won", "aerial_won + aerial_lost"),
    ("tackle_pct", "tackles_won", "tackles_won + dribbled_past"), ("duels_won_pct", "duels_won", "duels_total"), ("sot_pct", "shots_on_target", "np_shots"), ("npxg_per_shot", "npxg", "np_shots"),
]
TEAM_COUNTS = [
    "passes", "passes_completed", "ten_plus_pass_sequences", "progressive_passes", "passes_into_final_third", "xt", "sca", "gca",
    "passes_into_penalty_area", "open_play_xg", "build_up_attacks", "shots", "np_shots", "goals", "shots_on_target", "xg", "npxg",
    "high_turnovers", "pressures", "counterpressures", "direct_attacks", "open_play_sequences",
]
TEAM_RATES = ["possession_pct", "ppda", "field_tilt", "absolute_width", "sequence_start_distance", "direct_speed", "passes_per_sequence"]
TEAM_RATIOS = [("pass_completion_pct", "passes_completed", "passes"), ("xg_per_shot", "xg", "shots"), ("sot_pct", "shots_on_target", "np_shots")]

PLAYER_PHASES = {
    "progression": ["passes", "passes_completed", "progressive_passes", "progressive_carries", "passes_into_final_third", "xt", "pass_completion_pct"],
    "creation": ["xa", "passes_into_penalty_area", "deep_completions", "sca"],
    "finishing": ["shots", "np_shots", "goals", "np_goals", "shots_on_target", "xg", "npxg", "touches_in_att_pen_area", "sot_pct", "npxg_per_shot", "np_goals_minus_npxg"],
    "duels": ["take_ons", "take_ons_won", "fouls_drawn", "dispossessed", "tackles", "tackles_won", "dribbled_past", "duels_total", "duels_won", "take_ons_pct", "tackle_pct", "duels_won_pct"],
    "aerial": ["aerial_won", "aerial_lost", "aerial_won_off", "aerial_won_def", "aerial_won_pct"],
    "defence": ["interceptions", "ball_recoveries", "padj_def_actions", "blocks", "clearances", "pressures", "pressure_regains", "counterpressures"],
}
TEAM_PHASES = {
    "possession": ["possession_pct", "passes", "passes_completed", "pass_completion_pct", "ten_plus_pass_sequences"],
    "progression": ["progressive_passes", "passes_into_final_third", "xt"],
    "creation": ["sca", "gca", "passes_into_penalty_area", "open_play_xg", "build_up_attacks"],
    "finishing": ["shots", "np_shots", "goals", "shots_on_target", "xg", "npxg", "xg_per_shot", "sot_pct", "goals_minus_xg"],
    "pressing": ["ppda", "high_turnovers", "pressures", "counterpressures"],
    "territory": ["field_tilt", "absolute_width", "sequence_start_distance"],
    "style": ["direct_speed", "direct_attacks", "passes_per_sequence", "open_play_sequences"],
}
# Weights of the composite score; a metric that is measured out of sample too counts there under gen_ with the same weight.
IN_SAMPLE_WEIGHTS = {"top1": 1.0, "mrr": 1.0, "role_purity": 1.0, "rbo": 0.75, "knn_accuracy": 0.75, "coverage": 0.25, "diversity": 0.25, "asymmetry": 0.25}
SCORE_WEIGHTS = IN_SAMPLE_WEIGHTS | {f"gen_{k}": w for k, w in IN_SAMPLE_WEIGHTS.items() if k != "asymmetry"}


# The coarse role of each position; a secondary striker has none.
ROLES = {
    "GK": ["Goalkeeper"],
    "DEF": ["Right Back", "Right Center Back", "Center Back", "Left Center Back", "Left Back", "Right Wing Back", "Left Wing Back"],
    "MID": ["Right Defensive Midfield", "Center Defensive Midfield", "Left Defensive Midfield", "Right Midfield", "Right Center Midfield", "Center Midfield", "Left Center Midfield", "Left Midfield", "Right Attacking Midfield", "Center Attacking Midfield", "Left Attacking Midfield"],
    "ATT": ["Right Wing", "Left Wing", "Right Center Forward", "Center Forward", "Left Center Forward"],
}
