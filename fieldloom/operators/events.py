"""Ordered operators over event logs and the match metrics made from them.

The order of events in a match is their position (`pos`), never the clock. `flatten` turns the nested log into one flat row
per playable event; everything else works on flat rows and partitions by match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import catalogue as cat
from fieldloom.functions import scalars as fn

NAME = "STRUCT<name: STRING>"
EVENT_DDL = (
    "id STRING, period INT, minute INT, second INT, possession INT, type " + NAME + ", team STRUCT<id: BIGINT, name: STRING>, "
    "possession_team STRUCT<id: BIGINT, name: STRING>, play_pattern " + NAME + ", player STRUCT<id: BIGINT, name: STRING>, location ARRAY<DOUBLE>, counterpress BOOLEAN, "
    f"pass STRUCT<end_location: ARRAY<DOUBLE>, outcome: {NAME}, type: {NAME}, `cross`: BOOLEAN, aerial_won: BOOLEAN>, carry STRUCT<end_location: ARRAY<DOUBLE>>, "
    f"shot STRUCT<statsbomb_xg: DOUBLE, outcome: {NAME}, type: {NAME}, end_location: ARRAY<DOUBLE>, key_pass_id: STRING, aerial_won: BOOLEAN>, "
    f"dribble STRUCT<outcome: {NAME}>, duel STRUCT<type: {NAME}, outcome: {NAME}>, `50_50` STRUCT<outcome: {NAME}>, ball_receipt STRUCT<outcome: {NAME}>, "
    "ball_recovery STRUCT<recovery_failure: BOOLEAN>, clearance STRUCT<aerial_won: BOOLEAN>, miscontrol STRUCT<aerial_won: BOOLEAN>"
)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def with_idx(df: DataFrame, match: str, *order: str) -> DataFrame:
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(match).orderBy(*order)))


def run_id(df: DataFrame, match: str, key: str, idx: str = "idx", out: str = "run") -> DataFrame:
    """Numbers of stretches of equal key in order; null equals null."""
    w = Window.partitionBy(match).orderBy(idx)
    new = F.when((F.row_number().over(w) == 1) | ~F.col(key).eqNullSafe(F.lag(key).over(w)), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(out, F.sum("__new").over(w)).drop("__new")


def lookback(df: DataFrame, shot: Column, eligible: Column, match: str = "match_id", team: str = "team", run: str = "run", n: int = cat.LOOKBACK) -> DataFrame:
    """For each shot the last n eligible rows of its team before it in its stretch: shot_idx and the eligible row.

    Eligible rows are numbered within (match, stretch, team), so that a shot meets its rows by equality on the number.
    """
    w = Window.partitionBy(match, run, team).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__e", _true(eligible).cast("int")).withColumn("__before", F.coalesce(F.sum("__e").over(w), F.lit(0)))
    shots = rows.filter(_true(shot) & (F.col("__before") > 0)).select(F.col(match).alias("__m"), F.col(run).alias("__r"), F.col(team).alias("__t"), F.col("idx").alias("shot_idx"), *[F.col(c).alias(f"shot_{c}") for c in df.columns if c in ("goal",)], F.explode(F.sequence(F.greatest(F.col("__before") - n + 1, F.lit(1)), F.col("__before"))).alias("__k"))
    acts = rows.filter("__e = 1").withColumn("__k2", F.col("__before") + 1).drop("__e", "__before")
    met = acts.join(shots, (F.col(match) == F.col("__m")) & (F.col(run) == F.col("__r")) & F.col(team).eqNullSafe(F.col("__t")) & (F.col("__k2") == F.col("__k")))
    return met.drop("__m", "__r", "__t", "__k", "__k2")


def regains(df: DataFrame, trigger: Column, on_ball: Column, match: str = "match_id", team: str = "team", seconds: float = cat.REGAIN_SECONDS) -> DataFrame:
    """The trigger rows after which an on-ball row of the same team and period comes within the time, at least one.

    The clock does not run back within a period, so that whatever comes in time comes before anything that is late. An interval
    join: time is cut into blocks as long as the window, and a trigger looks into two of them.
    """
    block = lambda c: F.floor(c / F.lit(float(seconds)))
    hits = df.filter(_true(on_ball)).select(F.col(match).alias("__m"), F.col("period").alias("__p"), F.col(team).alias("__t"), F.col("idx").alias("__i"), F.col("sec").alias("__s"), block(F.col("sec")).alias("__b")).distinct()
    asked = df.filter(_true(trigger)).withColumn("__k", F.explode(F.array(block(F.col("sec")), block(F.col("sec")) + 1)))
    near = (F.col(match) == F.col("__m")) & (F.col("period") == F.col("__p")) & F.col(team).eqNullSafe(F.col("__t")) & (F.col("__k") == F.col("__b"))
    met = asked.join(hits, near & (F.col("__i") > F.col("idx")) & (F.col("__s") - F.col("sec") <= seconds), "left_semi")
    return met.drop("__k").dropDuplicates([match, "idx"])


def flatten(events: DataFrame) -> DataFrame:
    """One flat row per playable event (no shoot-outs), numbered per match: what all metrics are made of."""
    e = events.filter(F.coalesce("period", F.lit(1)) != 5)
    e = with_idx(e, "match_id", "pos")
    is_pass, end = F.col("type.name") == "Pass", F.coalesce("pass.end_location", "carry.end_location")
    kind, x, y = F.col("type.name"), fn.loc(F.col("location"), 0), fn.loc(F.col("location"), 1)
    won = _true(F.col("pass.aerial_won")) | _true(F.col("shot.aerial_won")) | _true(F.col("clearance.aerial_won")) | _true(F.col("miscontrol.aerial_won"))
    flat = e.select(
        "match_id", "idx", "id", F.coalesce("period", F.lit(1)).alias("period"), F.col("possession"), kind.alias("type"), F.col("team.name").alias("team"), F.col("team.id").alias("team_id"),
        F.col("possession_team.name").alias("owner"), F.col("play_pattern.name").alias("pattern"), F.col("player.id").alias("player_id"), x.alias("x"), y.alias("y"),
        fn.loc(end, 0).alias("ex"), fn.loc(end, 1).alias("ey"), fn.loc(F.col("shot.end_location"), 0).alias("sx"), F.coalesce("minute", F.lit(0)).alias("minute"), fn.event_seconds(F.col("minute"), F.col("second")).alias("sec"),
        (is_pass & F.col("pass.outcome.name").isNull()).alias("completed"), _true(F.col("pass.type.name").isin(cat.SET_PIECES)).alias("set_piece"), _true(F.col("pass.cross")).alias("crossed"),
        F.coalesce("shot.statsbomb_xg", F.lit(0.0)).alias("xg"), F.col("shot.outcome.name").alias("shot_outcome"), F.col("shot.type.name").alias("shot_type"), F.col("shot.key_pass_id").alias("key_pass_id"),
        F.col("dribble.outcome.name").alias("dribble"), F.col("duel.type.name").alias("duel"), F.col("duel.outcome.name").alias("duel_outcome"), F.col("50_50.outcome.name").alias("fifty"),
        _true(F.col("ball_recovery.recovery_failure")).alias("failed"), won.alias("aerial_won"), _true(F.col("counterpress")).alias("counterpress"),
        (_true(kind.isin(cat.TOUCHES)) & ~((kind == "Ball Receipt*") & F.col("ball_receipt.outcome.name").eqNullSafe("Incomplete"))).alias("touch"),
    )
    c = F.col
    located = c("x").isNotNull() & c("ex").isNotNull()
    base = c("completed") & located & ~c("set_piece")
    carry = (c("type") == "Carry") & located
    return flat.withColumns({
        "goal": (c("type") == "Shot") & c("shot_outcome").eqNullSafe("Goal"), "open_pass": base, "gain": F.when(base | carry, fn.threat_gain(c("x"), c("y"), c("ex"), c("ey"))).otherwise(0.0),
        "ahead": (base | carry) & fn.is_progressive(c("x"), c("y"), c("ex"), c("ey")), "tackle": _true((c("type") == "Duel") & (c("duel") == "Tackle")), "aerial_lost": _true((c("type") == "Duel") & (c("duel") == "Aerial Lost")),
        "eligible": _true(c("type").isin(cat.CREDITED)) & ~((c("type") == "Pass") & ~c("completed")) & ~((c("type") == "Dribble") & ~c("dribble").eqNullSafe("Complete")),
    })


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _shared(c=F.col) -> dict[str, Column]:
    """Metrics with one definition for players and teams."""
    shot, free = c("type") == "Shot", (c("type") == "Shot") & ~c("shot_type").eqNullSafe("Penalty")
    return {
        "passes": _n(c("type") == "Pass"), "passes_completed": _n(c("completed")), "progressive_passes": _n(c("open_pass") & c("ahead")),
        "passes_into_final_third": _n(c("open_pass") & (c("x") < 80) & (c("ex") >= 80)), "passes_into_penalty_area": _n(c("open_pass") & ~fn.in_box(c("x"), c("y")) & fn.in_box(c("ex"), c("ey"))),
        "xt": F.round(F.sum(c("gain").cast("decimal(18,6)")), 5).cast("double"), "shots": _n(shot), "xg": F.round(F.sum(F.when(shot, c("xg")).otherwise(0.0)), 5), "goals": _n(c("goal")), "np_shots": _n(free), "npxg": F.round(F.sum(F.when(free, c("xg")).otherwise(0.0)), 5),
        "shots_on_target": _n(free & c("shot_outcome").isin(cat.ON_TARGET)), "pressures": _n(c("type") == "Pressure"), "counterpressures": _n(c("counterpress")),
    }


def player_match_metrics(flat: DataFrame) -> DataFrame:
    """One row per (match, player) with the event metrics; possession-adjusted actions are added with the context."""
    c, kind = F.col, F.col("type")
    rows = run_id(flat, "match_id", "possession")
    fifty_won = c("fifty").isin("Won", "Success To Team")
    own = _shared() | {
        "deep_completions": _n(c("open_pass") & ~c("crossed") & (fn.dist_to_goal(c("ex"), c("ey")) <= cat.DEEP_RADIUS)), "progressive_carries": _n((kind == "Carry") & c("ahead")),
        "np_goals": _n(c("goal") & ~c("shot_type").eqNullSafe("Penalty")), "take_ons": _n(kind == "Dribble"), "take_ons_won": _n((kind == "Dribble") & (c("dribble") == "Complete")), "fouls_drawn": _n(kind == "Foul Won"),
        "dispossessed": _n(kind == "Dispossessed"), "dribbled_past": _n(kind == "Dribbled Past"), "tackles": _n(c("tackle")), "tackles_won": _n(c("tackle") & c("duel_outcome").isin(cat.TACKLE_WON)),
        "interceptions": _n(kind == "Interception"), "blocks": _n(kind == "Block"), "clearances": _n(kind == "Clearance"), "ball_recoveries": _n((kind == "Ball Recovery") & ~c("failed")),
        "duels_total": _n(c("tackle")) + _n(kind == "50/50") + _n(c("aerial_won")) + _n(c("aerial_lost")), "duels_won": _n(c("tackle") & c("duel_outcome").isin(cat.TACKLE_WON)) + _n((kind == "50/50") & fifty_won) + _n(c("aerial_won")),
        "touches_in_att_pen_area": _n(c("touch") & fn.in_box(c("x"), c("y"))), "aerial_won": _n(c("aerial_won")), "aerial_lost": _n(c("aerial_lost")),
        "aerial_won_off": _n(c("aerial_won") & F.coalesce(c("x") >= 60, F.lit(False))), "aerial_won_def": _n(c("aerial_won") & ~F.coalesce(c("x") >= 60, F.lit(False))),
    }
    keys = ["match_id", "player_id"]
    made = rows.filter("player_id is not null").groupBy(*keys).agg(*[v.alias(k) for k, v in own.items()])
    sca = lookback(rows, kind == "Shot", c("eligible")).filter("player_id is not null").groupBy(*keys).agg(F.count("*").alias("sca"))
    won = regains(rows, (kind == "Pressure") & c("player_id").isNotNull(), c("touch") | (kind == "Pass") | ((kind == "Ball Recovery") & ~c("failed")) | (kind == "Interception")).groupBy(*keys).agg(F.count("*").alias("pressure_regains"))
    xa = link_key_pass(rows).filter("player_id is not null").groupBy(*keys).agg(F.round(F.sum("assisted_xg"), 5).alias("xa"))
    return made.join(sca, keys, "left").join(won, keys, "left").join(xa, keys, "left").na.fill(0, ["sca", "pressure_regains"]).na.fill(0.0, ["xa"])


def link_key_pass(flat: DataFrame) -> DataFrame:
    """Passes with the expected goals of the shot that names them."""
    shots = flat.filter("type = 'Shot' and key_pass_id is not null").select(F.col("match_id").alias("__m"), F.col("key_pass_id").alias("__k"), F.col("xg").alias("assisted_xg"))
    return flat.join(shots, (F.col("match_id") == F.col("__m")) & (F.col("id") == F.col("__k"))).drop("__m", "__k")


def possessions(flat: DataFrame) -> DataFrame:
    """One row per (match, possession id): owner and pattern of its first event, wherever its events stand."""
    return flat.filter("possession is not null").groupBy("match_id", "possession").agg(F.min_by("owner", "idx").alias("owner"), F.min_by("pattern", "idx").alias("pattern"))


def sequence_metrics(flat: DataFrame) -> DataFrame:
    """Per (match, team) over its open-play possessions with a located event of its own."""
    c = F.col
    own = flat.join(possessions(flat).filter(c("pattern").isin(cat.OPEN_PLAY)).select(c("match_id").alias("__m"), c("possession").alias("__p"), c("owner").alias("__o")), (c("match_id") == c("__m")) & (c("possession") == c("__p")) & (c("team") == c("__o")))
    per = own.groupBy("match_id", "possession", "team").agg(
        _n(c("completed")).alias("n"), F.min_by("x", F.when(c("x").isNotNull(), c("idx"))).alias("start"), F.max(F.abs(c("y") - 40)).alias("half"), F.max(F.greatest("x", F.coalesce("ex", "x"))).alias("far"),
        (F.max("sec") - F.min("sec")).alias("took"), F.max((c("type") == "Shot") | fn.in_box(c("x"), c("y"))).alias("threat"),
    ).filter("start is not null")
    m, gain = cat.YARD, (c("far") - c("start")) * cat.YARD
    speed = F.when((gain > 0) & (c("took") > 0), gain / c("took"))
    return per.groupBy("match_id", "team").agg(
        F.count("*").alias("open_play_sequences"), (F.sum("n") / F.count("*")).alias("passes_per_sequence"), F.round(F.avg(2 * c("half") * m), 3).alias("absolute_width"), F.round(F.avg(c("start") * m), 3).alias("sequence_start_distance"),
        F.round(F.coalesce(F.avg(speed), F.lit(0.0)), 4).alias("direct_speed"), _n(c("n") >= 10).alias("ten_plus_pass_sequences"), _n((c("n") >= 10) & c("threat")).alias("build_up_attacks"),
        _n((c("start") < 60) & (c("far") - c("start") >= 0.5 * (cat.FIELD_X - c("start"))) & c("threat")).alias("direct_attacks"),
    )


def opponent_sum(c: Column, match: str) -> Column:
    """The others' total in the match."""
    return F.sum(c).over(Window.partitionBy(match)) - c


def team_match_metrics(flat: DataFrame) -> DataFrame:
    """One row per (match, team)."""
    c, kind = F.col, F.col("type")
    own = _shared() | {
        "touches": _n(c("touch")), "third_touches": _n(c("touch") & fn.in_final_third(c("x"))), "open_play_xg": F.round(F.sum(F.when(c("shot_type") == "Open Play", c("xg")).otherwise(0.0)), 5),
        "high_turnovers": _n(((kind == "Ball Recovery") & ~c("failed") | (kind == "Interception")) & F.coalesce(c("x") >= cat.HIGH_TURNOVER_X, F.lit(False))),
        "deep_passes": _n((kind == "Pass") & F.coalesce(c("x") <= 72, F.lit(False))), "press_acts": _n(((kind == "Interception") | (kind == "Foul Committed") | c("tackle")) & F.coalesce(c("x") >= 48, F.lit(False))),
    }
    keys = ["match_id", "team"]
    made = flat.filter("team is not null").groupBy(*keys).agg(*[v.alias(k) for k, v in own.items()])
    share = lambda k: F.coalesce(c(k) / F.nullif(F.sum(k).over(Window.partitionBy("match_id")), F.lit(0)), F.lit(0.0))
    made = made.withColumns({"possession_pct": share("touches"), "field_tilt": share("third_touches"), "ppda": opponent_sum(c("deep_passes"), "match_id") / F.nullif(c("press_acts"), F.lit(0))})
    met = lookback(run_id(flat, "match_id", "possession"), kind == "Shot", c("eligible"))
    sca = met.groupBy(*keys).agg(F.count("*").alias("sca"), _n(c("shot_goal")).alias("gca"))
    seq = sequence_metrics(flat)
    counts = ["sca", "gca", "open_play_sequences", "ten_plus_pass_sequences", "build_up_attacks", "direct_attacks"]
    return made.drop("touches", "third_touches", "deep_passes", "press_acts").join(sca, keys, "left").join(seq, keys, "left").na.fill(0, counts).na.fill(0.0, ["passes_per_sequence", "absolute_width", "sequence_start_distance", "direct_speed"])


def match_end(flat: DataFrame) -> DataFrame:
    return flat.groupBy("match_id").agg(F.coalesce(F.max(F.col("sec") / 60.0), F.lit(0.0)).alias("end_minute"))


def player_spells(lineups: DataFrame, flat: DataFrame) -> DataFrame:
    """Minutes per (match, player, position); a spell without an end lasts to the match's end."""
    ends = match_end(flat)
    each = lineups.select("match_id", "team_id", F.explode("lineup").alias("p")).select("match_id", "team_id", "p.player_id", "p.player_name", F.posexplode("p.positions").alias("k", "s"))
    timed = each.join(ends, "match_id", "left").select("*", F.coalesce(fn.parse_clock(F.col("s.from")), F.lit(0.0)).alias("a"), F.coalesce(fn.parse_clock(F.col("s.to")), F.col("end_minute"), F.lit(0.0)).alias("b"))
    return timed.groupBy("match_id", "team_id", "player_id", "player_name", F.col("s.position_id").alias("position_id"), F.col("s.position").alias("position_name")).agg(F.sum(F.greatest(F.lit(0.0), F.col("b") - F.col("a"))).alias("minutes"), F.min("k").alias("first"))


def player_minutes(spells: DataFrame) -> DataFrame:
    """Total minutes and the position with most of them (the first of equals); players without minutes are left out."""
    keys = ["match_id", "team_id", "player_id", "player_name"]
    best = F.max_by(F.struct("position_id", "position_name"), F.when(F.col("position_id").isNotNull(), F.struct("minutes", -F.col("first"))))
    total = spells.groupBy(*keys).agg(F.sum("minutes").alias("minutes_played"), best.alias("b"))
    return total.filter("minutes_played > 0").select(*keys, "minutes_played", F.col("b.position_id").alias("primary_position_id"), F.col("b.position_name").alias("primary_position_name"))


def build_match_tables(flat: DataFrame, lineups: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """player_match_stats, team_match_stats and player_match_positions of all matches in one plan."""
    teams = team_match_metrics(flat)
    names = flat.filter("team is not null").groupBy("match_id", "team").agg(F.first("team_id", ignorenulls=True).alias("team_id"))
    teams = teams.join(names, ["match_id", "team"]).join(matches.select("match_id", "home_team_id", "away_team_id", "home_score", "away_score"), "match_id", "left")
    home = F.col("team_id") == F.col("home_team_id")
    teams = teams.withColumns({"is_home": home.cast("int"), "opponent_id": F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")), "goals_for": F.when(home, F.col("home_score")).otherwise(F.col("away_score")), "goals_against": F.when(home, F.col("away_score")).otherwise(F.col("home_score"))})
    spells = player_spells(lineups, flat)
    players = player_minutes(spells).join(player_match_metrics(flat), ["match_id", "player_id"], "left").na.fill(0)
    players = players.join(teams.select("match_id", "team_id", "possession_pct"), ["match_id", "team_id"], "left")
    padj = F.round((F.col("interceptions") + F.col("ball_recoveries")) * fn.padj_factor(F.col("possession_pct")), 3)
    return players.withColumn("padj_def_actions", padj).drop("possession_pct"), teams.drop("home_team_id", "away_team_id", "home_score", "away_score"), spells.drop("first")
