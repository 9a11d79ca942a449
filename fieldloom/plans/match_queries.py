"""Registered queries of the match-data operators: metrics, minutes, quality checks, observations, leagues and careers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import catalogue as cat
from fieldloom.functions import scalars as fn
from fieldloom.operators import events as eo
from fieldloom.operators import features as fe
from fieldloom.operators import observations as ob
from fieldloom.operators import quality as dq
from fieldloom.plans import match_data as md
from fieldloom.plans.match_data import DIM_SQL, LINEUP_SQL, RAW_SQL
from fieldloom.plans.queries import _cell, c, r6
from fieldloom.plans.registry import query, table

GAIN = f"greatest(0.0::double, {_cell('ex', 'ey')} - {_cell('x', 'y')})::decimal(18, 6)"
#: Metrics with one definition for players and teams.
SHARED = f"""count(*) filter ("type" = 'Pass') passes, count(*) filter (done) passes_completed, count(*) filter (op and ahead) progressive_passes,
  count(*) filter (op and x < 80 and ex >= 80) passes_into_final_third, count(*) filter (op and not box and ebox) passes_into_penalty_area,
  coalesce(round(sum({GAIN}) filter (op or carried), 5), 0)::double xt, count(*) filter (shot) shots, round(coalesce(sum(gx) filter (shot), 0), 5) xg, count(*) filter (goal) goals, count(*) filter ("free") np_shots,
  round(coalesce(sum(gx) filter ("free"), 0), 5) npxg, count(*) filter ("free" and shot_outcome in ('Goal', 'Saved', 'Saved to Post')) shots_on_target,
  count(*) filter ("type" = 'Pressure') pressures, count(*) filter (counterpress) counterpressures"""
#: Actions credited with a shot: the last two of its team before it in its stretch of one possession.
CREDITS = """cr as (select s.match_id, s.idx shot_idx, s.goal shot_goal, a.player_id, a.team, row_number() over (partition by s.match_id, s.idx order by a.idx desc) n
  from rn s join rn a on s.match_id = a.match_id and s.run = a.run and s.team = a.team and a.idx < s.idx and a.credited where s.shot)"""
PLAYER = f"""{RAW_SQL}, {CREDITS},
  m as (select match_id, player_id, {SHARED}, count(*) filter (op and not crossed and d1 <= 20 / 0.9144) deep_completions, count(*) filter (carried and ahead) progressive_carries,
    count(*) filter (goal and "free") np_goals, count(*) filter ("type" = 'Dribble') take_ons, count(*) filter ("type" = 'Dribble' and dribble = 'Complete') take_ons_won, count(*) filter ("type" = 'Foul Won') fouls_drawn,
    count(*) filter ("type" = 'Dispossessed') dispossessed, count(*) filter ("type" = 'Dribbled Past') dribbled_past, count(*) filter (tackle) tackles, count(*) filter (tackle and duel_outcome = 'Won') tackles_won,
    count(*) filter ("type" = 'Interception') interceptions, count(*) filter ("type" = 'Block') blocks, count(*) filter ("type" = 'Clearance') clearances, count(*) filter (recovered) ball_recoveries,
    count(*) filter (tackle) + count(*) filter ("type" = '50/50') + count(*) filter (won) + count(*) filter (lost) duels_total,
    count(*) filter (tackle and duel_outcome = 'Won') + count(*) filter ("type" = '50/50' and fifty = 'Won') + count(*) filter (won) duels_won, count(*) filter (touch and box) touches_in_att_pen_area,
    count(*) filter (won) aerial_won, count(*) filter (lost) aerial_lost, count(*) filter (won and x >= 60) aerial_won_off, count(*) filter (won and (x >= 60) is not true) aerial_won_def
    from fl where player_id is not null group by all),
  sc as (select match_id, player_id, count(*) sca from cr where n <= 2 group by all),
  rg as (select match_id, player_id, count(*) regains from fl p where "type" = 'Pressure' and exists (select 1 from fl h where h.match_id = p.match_id and h.team = p.team and coalesce(h."period", 1) = coalesce(p."period", 1)
    and h.idx > p.idx and h.sec - p.sec <= 5 and (h.touch or h."type" in ('Pass', 'Interception') or h.recovered)) group by all),
  xs as (select a.match_id, a.player_id, round(sum(s.gx), 5) xa from fl s join fl a on s.match_id = a.match_id and s.prev_id::varchar = a.id where s.shot group by all),
  pm as (select m.*, coalesce(sca, 0) sca, coalesce(regains, 0) pressure_regains, coalesce(xa, 0) xa from m left join sc using (match_id, player_id) left join rg using (match_id, player_id) left join xs using (match_id, player_id))"""


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    return eo.flatten(md.raw_events(spark, folder))


@query(f"with {PLAYER} select * from pm")
def player_match_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return eo.player_match_metrics(_flat(spark, folder))


SEQUENCES = """po as (select match_id, possession, arg_min(owner, idx) owner, arg_min("pattern", idx) "pattern" from fl where possession is not null group by all),
  sq as (select match_id, possession, team, count(*) filter (done) n, arg_min(x, idx) filter (x is not null) s0, max(abs(y - 40)) half, max(greatest(x, coalesce(ex, x))) filter (x is not null) far,
    max(sec) - min(sec) took, bool_or(shot or coalesce(box, false)) threat from fl join po using (match_id, possession) where po."pattern" in ('Regular Play', 'From Counter', 'From Kick Off') and fl.team = po.owner group by all having s0 is not null),
  sm as (select match_id, team, count(*) open_play_sequences, sum(n) / count(*) passes_per_sequence, round(avg(2 * half * 0.9144), 3) absolute_width, round(avg(s0 * 0.9144), 3) sequence_start_distance,
    round(coalesce(avg(case when far > s0 and took > 0 then (far - s0) * 0.9144 / took end), 0), 4) direct_speed, count(*) filter (n >= 10) ten_plus_pass_sequences, count(*) filter (n >= 10 and threat) build_up_attacks,
    count(*) filter (s0 < 60 and far - s0 >= 0.5 * (120 - s0) and threat) direct_attacks from sq group by all)"""
# An event that is not a pass or a carry has no end.
ENDS = RAW_SQL.replace("coalesce(xg, 0) gx", "coalesce(xg, 0) gx, case when \"type\" in ('Pass', 'Carry') then ex end lx")
SEQUENCES = SEQUENCES.replace("max(greatest(x, coalesce(ex, x))) filter (x is not null)", "max(greatest(x, lx))")


@query(f"with {ENDS}, {SEQUENCES} select match_id, possession, owner, \"pattern\" from po")
def possession_owners(spark: SparkSession, folder: str) -> DataFrame:
    return eo.possessions(_flat(spark, folder))


@query(f"with {ENDS}, {SEQUENCES} select * replace (round(passes_per_sequence, 6) as passes_per_sequence) from sm")
def sequence_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return eo.sequence_metrics(_flat(spark, folder)).withColumn("passes_per_sequence", F.round("passes_per_sequence", 6))


TEAM = f"""{ENDS}, {CREDITS}, {SEQUENCES},
  tm as (select match_id, team, {SHARED}, round(coalesce(sum(gx) filter (shot and shot_type = 'Open Play'), 0), 5) open_play_xg, count(*) filter ((recovered or "type" = 'Interception') and x >= 120 - 40 / 0.9144) high_turnovers,
    count(*) filter (touch) tt, count(*) filter (touch and x >= 80) t3, count(*) filter ("type" = 'Pass' and x <= 72) deep, count(*) filter (("type" in ('Interception', 'Foul Committed') or tackle) and x >= 48) acts from fl group by all),
  tc as (select match_id, team, count(*) sca, count(*) filter (shot_goal) gca from cr where n <= 2 group by all),
  ts as (select tm.* exclude (tt, t3, deep, acts), tt / sum(tt) over w possession_pct, coalesce(t3 / nullif(sum(t3) over w, 0), 0) field_tilt, (sum(deep) over w - deep) / nullif(acts, 0) ppda from tm window w as (partition by match_id))"""


@query(f"""with {TEAM} select ts.* replace (round(possession_pct, 9) as possession_pct, round(field_tilt, 9) as field_tilt, round(ppda, 9) as ppda), coalesce(sca, 0) sca, coalesce(gca, 0) gca, coalesce(open_play_sequences, 0) open_play_sequences,
  coalesce(absolute_width, 0) absolute_width, coalesce(direct_attacks, 0) direct_attacks from ts left join tc using (match_id, team) left join sm using (match_id, team)""")
def team_match_metrics(spark: SparkSession, folder: str) -> DataFrame:
    got = eo.team_match_metrics(_flat(spark, folder)).drop("passes_per_sequence", "sequence_start_distance", "direct_speed", "ten_plus_pass_sequences", "build_up_attacks")
    return got.withColumns({k: F.round(k, 9) for k in ("possession_pct", "field_tilt", "ppda")})


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return eo.build_match_tables(_flat(spark, folder), md.lineups(spark, folder), md.matches(spark, folder))


MINUTES = f"""{LINEUP_SQL}, mi as (select match_id, team_id, player_id, sum(minutes) minutes_played, arg_max(position_id, minutes * 1000 - "first") position_id, arg_max(position_name, minutes * 1000 - "first") position_name from ps group by all having sum(minutes) > 0)"""


@query(f"with {RAW_SQL}, {LINEUP_SQL} select match_id, team_id, player_id, 'Player ' || player_id player_name, position_id, position_name, round(minutes, 6) \"minutes\" from ps")
def position_minutes(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder)[2].withColumn("minutes", F.round("minutes", 6))


@query(f"with {RAW_SQL}, {LINEUP_SQL} select match_id, round(e, 6) end_minute from en")
def match_ends(spark: SparkSession, folder: str) -> DataFrame:
    return eo.match_end(_flat(spark, folder)).select("match_id", r6(c("end_minute"), "end_minute"))


@query(f"""with {PLAYER}, {MINUTES}, pt as (select match_id, case team when 'A' then 1 else 2 end team_id, count(*) filter (touch) t from fl group by all), pc as (select match_id, team_id, t / sum(t) over (partition by match_id) p from pt)
  select match_id, team_id, player_id, round(minutes_played, 6) minutes_played, position_id primary_position_id, position_name primary_position_name, coalesce(passes, 0) passes, coalesce(sca, 0) sca, coalesce(xa, 0) xa, coalesce(duels_won, 0) duels_won,
  round(coalesce(interceptions + ball_recoveries, 0) * case when 1 - p <= 1e-6 then 1 else 0.5 / (1 - p) end, 3) padj_def_actions from mi left join pm using (match_id, player_id) left join pc using (match_id, team_id)""")
def match_players(spark: SparkSession, folder: str) -> DataFrame:
    got = _tables(spark, folder)[0]
    return got.select("match_id", "team_id", "player_id", r6(c("minutes_played"), "minutes_played"), "primary_position_id", "primary_position_name", "passes", "sca", "xa", "duels_won", "padj_def_actions")


@query(f"""with {TEAM}, {LINEUP_SQL} select match_id, team, case team when 'A' then 1 else 2 end team_id, case team when 'A' then 2 else 1 end opponent_id, case team when 'A' then 1 else 0 end is_home,
  case team when 'A' then home_score else away_score end goals_for, case team when 'A' then away_score else home_score end goals_against, passes, xg from ts join ma using (match_id)""")
def match_teams(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder)[1].select("match_id", "team", "team_id", "opponent_id", "is_home", "goals_for", "goals_against", "passes", "xg")


# --- scalar functions -------------------------------------------------------------------------------------------------


@query("""with k as (select o_orderkey k from orders) select k, case when k % 7 <> 0 then k % 200 else 0 end * 60 + case when k % 5 <> 0 then k % 60 else 0 end "seconds",
  round(case when k % 11 <> 0 then k % 130 + (k % 60) / 60 end, 9) clock, case when k % 3 = 0 then k % 1000 else 9223372036854775807 end "order", round(case when k % 13 = 0 or 1 - (k % 101) / 100 <= 1e-6 then 1 else 0.5 / (1 - (k % 101) / 100) end, 9) factor from k""")
def clock_functions(spark: SparkSession, folder: str) -> DataFrame:
    k = table(spark, folder, "orders").select(c("o_orderkey").alias("k"))
    text = F.when(c("k") % 11 != 0, F.format_string("%02d:%02d", c("k") % 130, c("k") % 60)).otherwise(F.when(c("k") % 2 == 0, ""))
    name = F.when(c("k") % 3 == 0, F.concat(F.lit("v"), c("k") % 1000)).otherwise(F.when(c("k") % 3 == 1, F.concat(F.lit("x"), c("k") % 1000)).otherwise("v1b"))
    share = F.when(c("k") % 13 != 0, c("k") % 101 / 100)
    return k.select("k", fn.event_seconds(F.when(c("k") % 7 != 0, c("k") % 200), F.when(c("k") % 5 != 0, c("k") % 60)).alias("seconds"), F.round(fn.parse_clock(text), 9).alias("clock"), fn.version_order(name).alias("order"), F.round(fn.padj_factor(share), 9).alias("factor"))


ROLES = {p: next((r for r, names in cat.ROLES.items() if p in names), "???") for p in cat.POSITIONS}


@query(f"""with p as (select p_partkey k, ({md.NAMED})[p_partkey % 25 + 1] p from part) select k, p "position", 'pos_' || replace(lower(p), ' ', '_') slug,
  case p {' '.join(f"when '{p}' then '{r}'" for p, r in ROLES.items())} end role from p""")
def position_names(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*[F.lit(p) for p in cat.POSITIONS])
    rows = table(spark, folder, "part").select(c("p_partkey").alias("k"), F.get(names, (c("p_partkey") % 25).cast("int")).alias("position"))
    return rows.select("k", "position", fn.position_slug(c("position")).alias("slug"), fn.role_of(c("position")).alias("role"))


SHOWN = ["passes", "pass_completion_pct", "field_tilt", "goals_minus_xg", "absolute_width", "direct_speed"]


@query(f"""with p as (select s_suppkey k, ({SHOWN})[s_suppkey % 6 + 1] f, case when s_suppkey % 10 <> 0 then round(s_acctbal / 100, 3) + 0.0003 end v from supplier) select k, f feature,
  case when v is null then '–' when f in ('pass_completion_pct', 'field_tilt') then printf('%.1f %%', v * 100) when f = 'goals_minus_xg' then printf('%+.2f', v) when f = 'absolute_width' then printf('%.1f m', v) when f = 'direct_speed' then printf('%.2f m/s', v)
    when abs(v) < 10 then printf('%.2f', v) else printf('%.1f', v) end shown from p""")
def shown_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All suppliers; values get a share of a thousandth, so that none ends in the middle between two shown ones, which engines round apart."""
    feature = F.get(F.array(*[F.lit(f) for f in SHOWN]), (c("s_suppkey") % 6).cast("int"))
    rows = table(spark, folder, "supplier").select(c("s_suppkey").alias("k"), feature.alias("feature"), F.when(c("s_suppkey") % 10 != 0, fn.round_scaled(c("s_acctbal") / 100, 3) + 0.0003).alias("v"))
    return rows.select("k", "feature", fn.format_metric(c("feature"), c("v")).alias("shown"))


# --- quality checks ---------------------------------------------------------------------------------------------------

REQUIRED_SQL = """select 'error' "level", 'events' place, match_id, count(*) || ' rows lack period' message from ra where "period" is null group by match_id"""
EVENT_SQL = """select 'warning' "level", 'events' place, match_id, count(*) || ' events have no possession' message from ra where possession is null group by match_id
  union all select 'warning', 'events', match_id, count(*) || ' shots have no expected goals' from ra where "type" = 'Shot' and xg is null group by match_id
  union all select 'warning', 'events', match_id, count(*) || ' locations are outside the field' from ra where y > 80 group by match_id
  union all select 'error', 'events', match_id, '1 count of team names is not two' from ra group by match_id having count(distinct team) <> 2"""
LINEUP_CHECK_SQL = """select 'error' "level", 'lineups' place, match_id, '1 count of teams is not two' message from us group by match_id having count(distinct team_id) <> 2
  union all select 'error', 'lineups', match_id, '1 no player has a spell' from us left join sp using (match_id, team_id, player_id) group by match_id having count(sp.k) = 0
  union all select 'warning', 'lineups', match_id, count(distinct team_id) || ' position names are unknown' from sp where player_id % 13 = 0 group by match_id"""


@query(f"with {RAW_SQL} {REQUIRED_SQL}")
def dq_required(spark: SparkSession, folder: str) -> DataFrame:
    return dq.check_required(md.raw_events(spark, folder), "events")


@query(f"""
with {RAW_SQL}, {LINEUP_SQL}
select 'error' "level", 'players' place, match_id, count(*) || ' rows lack player_name' message from us where player_id % 13 = 0 group by match_id
union all
select 'error', 'spells', match_id, count(*) || ' rows lack position' from sp where player_id % 11 = 0 group by match_id
""")
def dq_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every 13th player has lost the name, and the spells of every 11th the position."""
    players, spells = dq.lineup_members(md.lineups(spark, folder))
    players = players.withColumn("player_name", F.when(F.col("player_id") % 13 != 0, F.col("player_name")))
    spells = spells.withColumn("position", F.when(F.col("player_id") % 11 != 0, F.col("position")))
    return dq.check_required(players, "players").unionByName(dq.check_required(spells, "spells"))


@query(f"with {RAW_SQL} {EVENT_SQL}")
def dq_events(spark: SparkSession, folder: str) -> DataFrame:
    return dq.validate_events(md.raw_events(spark, folder))


@query(f"with {RAW_SQL}, {LINEUP_SQL} {LINEUP_CHECK_SQL}")
def dq_lineups(spark: SparkSession, folder: str) -> DataFrame:
    return dq.validate_lineups(md.lineups(spark, folder), md.matches(spark, folder))


@query(f"""with {RAW_SQL}, {LINEUP_SQL}, pr as ({REQUIRED_SQL} union all {EVENT_SQL} union all {LINEUP_CHECK_SQL}) select match_id, not exists (select 1 from pr where pr.match_id = ma.match_id and "level" = 'error') ok from ma""")
def dq_verdict(spark: SparkSession, folder: str) -> DataFrame:
    e, m, li = md.raw_events(spark, folder), md.matches(spark, folder), md.lineups(spark, folder)
    return dq.verdict(m, dq.check_required(e, "events"), dq.validate_events(e), dq.validate_lineups(li, m))


# --- observations -----------------------------------------------------------------------------------------------------


def _observations(spark: SparkSession, folder: str) -> DataFrame:
    players, _, spells = _tables(spark, folder)
    return ob.load_observations("player", players, md.players(spark, folder), md.matches(spark, folder), spells)


OBS_SQL = f"{PLAYER}, {MINUTES}, oo as (select mi.*, competition_id || '-' || season_id league_key, match_date from mi join ma using (match_id))"


@query(f"""with {OBS_SQL}, fr as (select match_id, player_id, lower(replace(position_name, ' ', '_')) slug, minutes / sum(minutes) over (partition by match_id, player_id) f from ps)
  select player_id entity_id, match_id, 'Player ' || player_id entity_name, league_key, round(minutes_played / 90, 9) mass, round(coalesce(sum(f) filter (slug = 'goalkeeper'), 0), 9) pos_goalkeeper, round(coalesce(sum(f) filter (slug = 'left_wing'), 0), 9) pos_left_wing
  from oo left join fr using (match_id, player_id) group by all""")
def player_observations(spark: SparkSession, folder: str) -> DataFrame:
    return _observations(spark, folder).select("entity_id", "match_id", "entity_name", "league_key", F.round(ob.mass("player"), 9).alias("mass"), F.round("pos_goalkeeper", 9).alias("pos_goalkeeper"), F.round("pos_left_wing", 9).alias("pos_left_wing"))


@query(f"""with {TEAM}, {LINEUP_SQL} select case team when 'A' then 1 else 2 end entity_id, match_id, 'Team ' || case team when 'A' then 1 else 2 end entity_name, competition_id || '-' || season_id league_key, 1.0::double mass, passes from ts join ma using (match_id)""")
def team_observations(spark: SparkSession, folder: str) -> DataFrame:
    got = ob.load_observations("team", _tables(spark, folder)[1], md.teams(spark, folder), md.matches(spark, folder))
    return got.select("entity_id", "match_id", "entity_name", "league_key", ob.mass("team").alias("mass"), "passes")


@query(f"with {OBS_SQL} select distinct player_id entity_id, 'Player ' || player_id entity_name from oo")
def entity_universe(spark: SparkSession, folder: str) -> DataFrame:
    return ob.entity_universe(_observations(spark, folder))


@query(f"with {OBS_SQL} select player_id, round(sum(minutes_played), 6) \"minutes\" from mi group by player_id")
def player_minutes_total(spark: SparkSession, folder: str) -> DataFrame:
    return ob.minutes_per_player(_tables(spark, folder)[0]).select("player_id", r6(c("minutes"), "minutes"))


ROLE_SQL = "case position_name " + " ".join(f"when '{p}' then '{r}'" for p, r in ROLES.items()) + " else '???' end"


@query(f"""with {OBS_SQL}, g as (select player_id, {ROLE_SQL} role, round(sum(minutes_played), 6) m from mi group by all) select player_id, role from (select *, row_number() over (partition by player_id order by m desc, role) n from g) where n = 1""")
def role_per_player(spark: SparkSession, folder: str) -> DataFrame:
    return ob.role_per_player(_tables(spark, folder)[0])


@query(f"""with {OBS_SQL}, g as (select player_id, position_name, sum(minutes) m from ps where position_name <> 'Sweeper' group by all having sum(minutes) > 0)
  select player_id, position_name, round(m, 6) "minutes", round(m / sum(m) over (partition by player_id), 9) fraction, row_number() over (partition by player_id order by m desc, position_name)::bigint "rank" from g""")
def position_usage(spark: SparkSession, folder: str) -> DataFrame:
    got = ob.position_usage(_tables(spark, folder)[2])
    return got.select("player_id", "position_name", r6(c("minutes"), "minutes"), F.round("fraction", 9).alias("fraction"), "rank")


@query(f"""with {RAW_SQL}, {LINEUP_SQL} select competition_id, season_id, count(*) matches, (select count(*) from ma) all_matches, (select count(distinct u) from rw) all_players, (select count(distinct u % 2) from rw) all_teams from ma group by all""")
def dataset_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ob.dataset_summary(md.matches(spark, folder), md.players(spark, folder), md.teams(spark, folder))


@query(f"""with {OBS_SQL}, g as (select player_id, league_key, min(match_date || '/' || match_id) f from oo group by all) select player_id entity_id, string_agg(league_key, ',' order by f) leagues from g group by all""")
def leagues_per_entity(spark: SparkSession, folder: str) -> DataFrame:
    got = ob.leagues_per_entity(_observations(spark, folder), md.matches(spark, folder))
    return got.select("entity_id", F.array_join("leagues", ",").alias("leagues"))


@query(f"with {RAW_SQL}, {LINEUP_SQL}, {DIM_SQL} select competition_id || '-' || season_id league_key, competition_name || ' ' || season_name \"name\" from co, se")
def league_names(spark: SparkSession, folder: str) -> DataFrame:
    return ob.league_names(md.competitions(spark, folder), md.seasons(spark, folder))


USED_SQL = f"{RAW_SQL}, {LINEUP_SQL}, {DIM_SQL}, ln as (select distinct competition_id || '-' || season_id league_key, trim(coalesce(case when competition_id <> 2 then competition_name end, '') || ' ' || season_name) \"name\" from ma join co using (competition_id) join se using (season_id))"


@query(f"with {USED_SQL} select * from ln")
def league_names_used(spark: SparkSession, folder: str) -> DataFrame:
    """One competition has no name."""
    return ob.league_names_used(md.matches(spark, folder), md.competitions(spark, folder).filter("competition_id != 2"), md.seasons(spark, folder))


@query(f"with {USED_SQL} select league_key, \"name\", case when lower(\"name\") like '%afr%' then 0 else 2 end \"first\" from ln where lower(\"name\") like '%afr%' or lower(\"name\") like '%season 20%'")
def holdout_leagues(spark: SparkSession, folder: str) -> DataFrame:
    return ob.resolve_holdout(league_names_used(spark, folder), ["AFR", " ", "season 20"])


@query(f"with {OBS_SQL} select player_id entity_id, count(*) n from oo where league_key not like '1-%' group by all")
def without_leagues(spark: SparkSession, folder: str) -> DataFrame:
    rows = _observations(spark, folder)
    return ob.exclude_leagues(rows, rows.select("league_key").filter("league_key like '1-%'")).groupBy("entity_id").agg(F.count("*").alias("n"))


@query(f"""with {OBS_SQL}, g as (select player_id, team_id, case when match_id % 5 <> 0 then league_key else '' end league, sum(minutes_played) m, count(*) n, min(case when match_id % 5 <> 0 then match_date else '' end) since from oo group by all),
  k as (select *, 'Team ' || team_id club, row_number() over (partition by player_id order by since, league, 'Team ' || team_id) place from g)
  select player_id, team_id, club, league, round(m, 6) "minutes", n matches, since, place, place = max(place) over (partition by player_id) "current" from k""")
def careers(spark: SparkSession, folder: str) -> DataFrame:
    """Some matches are missing and one team has no name."""
    got = ob.career(_tables(spark, folder)[0], md.teams(spark, folder).filter("team_id = 1"), md.matches(spark, folder).filter("match_id % 5 != 0"))
    return got.select("player_id", "team_id", "club", "league", r6(c("minutes"), "minutes"), "matches", "since", "place", "current")


@query(f"""with {OBS_SQL}, g as (select player_id, league_key league, team_id, min(match_date) since from oo group by all), s as (select player_id, league, string_agg('Team ' || team_id, ',' order by since, team_id) clubs, min(since) since from g group by all)
  select *, row_number() over (partition by player_id order by since, league)::bigint step from s""")
def career_steps(spark: SparkSession, folder: str) -> DataFrame:
    got = ob.league_steps(ob.career(_tables(spark, folder)[0], md.teams(spark, folder), md.matches(spark, folder)))
    return got.withColumn("clubs", F.array_join("clubs", ","))


@query(f"""with {PLAYER} select match_id, player_id, round(passes * 90 / nullif(minutes_played, 0), 6) passes, round(xt * 90 / nullif(minutes_played, 0), 7) xt, round(passes_completed / nullif(passes, 0), 6) pass_completion_pct, round(aerial_won / nullif(aerial_won + aerial_lost, 0), 6) aerial_won_pct,
  round((np_goals - npxg) * 90 / nullif(minutes_played, 0), 6) np_goals_minus_npxg from (select *, (player_id % 91)::double minutes_played from pm)""")
def player_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = eo.player_match_metrics(_flat(spark, folder)).withColumns({"minutes_played": (c("player_id") % 91).cast("double"), "padj_def_actions": F.lit(0.0)})
    got = fe.derive(rows, "player")
    return got.select("match_id", "player_id", r6(c("passes"), "passes"), F.round("xt", 7).alias("xt"), *[r6(c(k), k) for k in ("pass_completion_pct", "aerial_won_pct", "np_goals_minus_npxg")])


@query(f"with {TEAM} select match_id, team, passes::double passes, round(passes_completed / nullif(passes, 0), 6) pass_completion_pct, round(xg / nullif(shots, 0), 6) xg_per_shot, round(shots_on_target / nullif(np_shots, 0), 6) sot_pct, round(goals - xg, 6) goals_minus_xg from ts")
def team_features(spark: SparkSession, folder: str) -> DataFrame:
    got = fe.derive(eo.team_match_metrics(_flat(spark, folder)), "team")
    return got.select("match_id", "team", "passes", *[r6(c(k), k) for k in ("pass_completion_pct", "xg_per_shot", "sot_pct", "goals_minus_xg")])


@query(f"""with {OBS_SQL}, fr as (select match_id, player_id, coalesce(sum(minutes) filter (position_name = 'Left Wing'), 0) / sum(minutes) f from ps group by all having sum(minutes) > 0), g as (select * from oo join fr using (match_id, player_id))
  select player_id entity_id, match_id, round(least(greatest((f - avg(f) over w) / case when stddev_pop(f) over w = 0 then 1 else stddev_pop(f) over w end, -6), 6) / 5, 6) pos_left_wing, round(f, 6) raw_left_wing from g window w as (partition by league_key)""")
def position_block(spark: SparkSession, folder: str) -> DataFrame:
    """The block of z-scores by league divided by the root of the catalogue's size, and the raw one."""
    rows = _observations(spark, folder)
    z = fe.zscore(rows, fe.norm_stats(rows, "league_key", ["pos_left_wing"]), "league_key", ["pos_left_wing"])
    scaled = ob.scale_positions(z).select("entity_id", "match_id", r6(c("pos_left_wing"), "pos_left_wing"))
    raw = ob.scale_positions(z, rows, "raw").select("entity_id", "match_id", r6(c("pos_left_wing"), "raw_left_wing"))
    return scaled.join(raw, ["entity_id", "match_id"])


@query(f"with {OBS_SQL} select player_id entity_id, match_id, round(minutes_played / 90, 9) mass, round(minutes_played, 6) || '/' || coalesce(passes, 0)::double x from oo left join pm using (match_id, player_id)")
def feature_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows = _observations(spark, folder).withColumns({"mass": F.round(ob.mass("player"), 9), "minutes_played": F.round("minutes_played", 6)})
    got = fe.feature_matrix(rows, "entity_id", "match_id", "mass", ["minutes_played", "passes"])
    return got.withColumn("x", F.array_join("x", "/"))


@query(f"""with {OBS_SQL}, a as (select player_id, avg(minutes_played) m from oo group by all) select o.entity_id, round(m, 6) minutes_played, null::double never from (select distinct u entity_id from rw where u % 3 <> 0 union select -1) o left join a on player_id = entity_id""")
def aligned_table(spark: SparkSession, folder: str) -> DataFrame:
    mine = _tables(spark, folder)[0].groupBy(c("player_id").alias("entity_id")).agg(F.avg("minutes_played").alias("minutes_played"))
    model = md.players(spark, folder).select(c("player_id").alias("entity_id")).filter("entity_id % 3 != 0").unionByName(spark.createDataFrame([(-1,)], "entity_id bigint"))
    return ob.align(mine, model, ["never", "minutes_played"]).withColumn("minutes_played", F.round("minutes_played", 6))
