"""Registered queries over a match-data package of JSON files, which is written from the driver's event table first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.steps import shared_folder
from fieldloom.plans import match_data as md
from fieldloom.plans.registry import query
from fieldloom.sources import package

c = F.col

DECLARED = f"""{md.RAW_SQL}, {md.LINEUP_SQL}, {md.DIM_SQL},
  de as (select distinct competition_id, season_id, competition_name, season_name from ma join co using (competition_id) join se using (season_id) where (competition_id + season_id) % 4 <> 0)"""


def _package(spark: SparkSession, folder: str, damaged: bool = False) -> str:
    """The folder of a new package: every fourth season undeclared; damaged: some files missing, others no list or no JSON."""
    matches = md.matches(spark, folder).withColumns({"competition_stage": F.lit("League"), "home_team_name": F.lit("A"), "away_team_name": F.lit("B")})
    declared = matches.select("competition_id", "season_id").distinct().join(md.competitions(spark, folder), "competition_id").join(md.seasons(spark, folder), "season_id")
    declared = declared.filter((c("competition_id") + c("season_id")) % 4 != 0).select("competition_id", "season_id", "competition_name", "season_name")
    files = package.package_files(declared, matches, md.raw_events(spark, folder), md.lineups(spark, folder))
    if damaged:
        n = F.regexp_extract("path", r"(\d+)\.json$", 1).cast("bigint")
        lineup, event = c("path").startswith("lineups/"), c("path").startswith("events/")
        files = files.filter(~(lineup & (n % 5 == 0))).withColumn("value", F.when(event & (n % 7 == 0), "{}").when(event & (n % 11 == 0), "[{").otherwise(c("value")))
    root = f"{shared_folder(spark)}/fieldloom-steps/package-{uuid.uuid4().hex}"
    package.write_files(files, root)
    return root


@query(f"""with {md.RAW_SQL} select match_id, count(*) n, min(pos) first_pos, max(pos) last_pos, sum("minute")::bigint minute_sum, count("period") with_period, count(x) located, count(distinct "type") kinds,
  count(*) filter ("type" = 'Pass' and crossed) crosses, round(coalesce(sum(xg) filter ("type" = 'Shot'), 0), 6) xg, count(distinct player_id) players from ra group by match_id""")
def package_events(spark: SparkSession, folder: str) -> DataFrame:
    e = package.read_events(spark, _package(spark, folder))
    count = lambda cond: F.count(F.when(cond, 1))
    return e.groupBy("match_id").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("minute").alias("minute_sum"), F.count("period").alias("with_period"), F.count("location").alias("located"),
        F.count_distinct("type.name").alias("kinds"), count(c("pass.cross")).alias("crosses"), F.round(F.coalesce(F.sum("shot.statsbomb_xg"), F.lit(0.0)), 6).alias("xg"), F.count_distinct("player.id").alias("players"),
    )


@query(f"""with {md.RAW_SQL}, {md.LINEUP_SQL} select match_id, competition_id, season_id, match_date, 'League' competition_stage, 'A' home_team_name, 'B' away_team_name, home_score, away_score from ma""")
def package_matches(spark: SparkSession, folder: str) -> DataFrame:
    return package.read_matches(spark, _package(spark, folder)).select("match_id", "competition_id", "season_id", "match_date", "competition_stage", "home_team_name", "away_team_name", "home_score", "away_score")


@query(f"""with {md.RAW_SQL}, {md.LINEUP_SQL}, o as (select match_id, team_id, count(*) players from us group by all), s as (select match_id, team_id, count(*) spells from sp group by all)
  select match_id, team_id, players, coalesce(spells, 0) spells from o left join s using (match_id, team_id)""")
def package_lineups(spark: SparkSession, folder: str) -> DataFrame:
    rows = package.read_lineups(spark, _package(spark, folder))
    spells = F.aggregate("lineup", F.lit(0), lambda n, p: n + F.size(F.coalesce(p["positions"], F.array())))
    return rows.select("match_id", "team_id", F.size("lineup").cast("bigint").alias("players"), spells.cast("bigint").alias("spells"))


@query(f"""with {DECLARED} select competition_name, season_name, count(*) match_count, true available from de join ma using (competition_id, season_id) group by competition_name, season_name""")
def package_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Declared competitions with their seasons, whether the season's file is there, and its matches."""
    root = _package(spark, folder)
    declared = package.read_competitions(spark, root)
    seasons = package.competitions_catalog(declared, package.match_files(spark, root)).select("competition_name", F.explode("seasons").alias("s"))
    counts = package.match_counts(declared, package.read_matches(spark, root))
    return seasons.select("competition_name", "s.season_name", "s.available").join(counts, ["competition_name", "season_name"]).select("competition_name", "season_name", "match_count", "available")


@query(f"""with {DECLARED}, t as (select ma.* from ma join de using (competition_id, season_id)) select 'matches' place, match_id, 'its competition and season are not declared' message from ma anti join de using (competition_id, season_id)
  union all select 'lineups', match_id, 'the file is missing' from t where match_id % 5 = 0 union all select 'events', match_id, 'the file is no list' from t where match_id % 7 = 0
  union all select 'events', match_id, 'the file is no JSON' from t where match_id % 7 <> 0 and match_id % 11 = 0""")
def package_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Discovery in a damaged package, and the structural checks of the matches that it takes."""
    root = _package(spark, folder, damaged=True)
    taken, problems = package.discover(spark, root)
    return problems.unionByName(package.validate_structure(spark, root, taken)).select("place", "match_id", "message")
