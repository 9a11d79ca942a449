"""Data-quality checks: each gives rows (level, place, match_id, message), and a verdict per match."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.catalogue import POSITIONS

REQUIRED = {
    "events": ["id", "period", "minute", "type.name", "team.id", "team.name"],
    "lineups": ["team_id", "team_name", "lineup"],
    "players": ["player_id", "player_name", "positions"],
    "spells": ["position_id", "position", "from"],
    "matches": ["match_id", "match_date", "home_team_id", "away_team_id", "home_score", "away_score"],
}


def _told(df: DataFrame, place: str, checks: list[tuple[str, F.Column, str]]) -> DataFrame:
    """One row for each check (level, count, text) whose count is above 0; df has one row per match."""
    rows = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(place).alias("place"), F.col("match_id"), count.cast("bigint").alias("n"), F.lit(text).alias("t")) for level, count, text in checks])
    return df.select(F.explode(rows).alias("r")).select("r.*").filter("n > 0").select("level", "place", "match_id", F.concat_ws(" ", "n", "t").alias("message"))


def check_required(df: DataFrame, place: str) -> DataFrame:
    paths = REQUIRED[place]
    missing = df.groupBy("match_id").agg(*[F.sum(F.col(p).isNull().cast("int")).alias(p.replace(".", "_")) for p in paths])
    return _told(missing, place, [("error", F.col(p.replace(".", "_")), f"rows lack {p}") for p in paths])


def lineup_members(lineups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The players and the spells of line-ups, one row each with their match_id, for `check_required`; spells with their player_id."""
    players = lineups.select("match_id", F.explode("lineup").alias("p")).select("match_id", "p.*")
    spells = players.select("match_id", "player_id", F.explode("positions").alias("s")).select("match_id", "player_id", "s.*")
    return players, spells


def validate_events(events: DataFrame) -> DataFrame:
    """events: as read, one row per raw event."""
    x, y = F.get("location", 0), F.get("location", 1)
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    g = events.groupBy("match_id").agg(
        (F.count("id") - F.count_distinct("id")).alias("repeated"), F.max(F.coalesce("minute", F.lit(0))).alias("last"), F.count_distinct("team.name").alias("teams"),
        n((x < 0) | (x > 120) | (y < 0) | (y > 80)).alias("outside"), n(F.col("possession").isNull()).alias("loose"), n((F.col("type.name") == "Shot") & F.col("shot.statsbomb_xg").isNull()).alias("no_xg"),
    )
    return _told(g, "events", [
        ("error", F.col("repeated"), "event ids are repeated"), ("error", (F.col("last") == 0).cast("int"), "clock never leaves minute 0"), ("error", (F.col("teams") != 2).cast("int"), "count of team names is not two"),
        ("warning", F.col("outside"), "locations are outside the field"), ("warning", F.col("loose"), "events have no possession"), ("warning", F.col("no_xg"), "shots have no expected goals"),
    ])


def validate_lineups(lineups: DataFrame, matches: DataFrame) -> DataFrame:
    spells = F.flatten(F.transform("lineup", lambda p: F.coalesce(p["positions"], F.array())))
    names = F.array(*[F.lit(p) for p in POSITIONS])
    g = lineups.groupBy("match_id").agg(F.count("*").alias("teams"), F.collect_set("team_id").alias("ids"), F.sum(F.size(spells)).alias("spells"), F.sum(F.size(F.array_except(F.filter(F.transform(spells, lambda s: s["position"]), lambda s: s.isNotNull()), names))).alias("odd"))
    g = g.join(matches.select("match_id", F.array("home_team_id", "away_team_id").alias("own")), "match_id", "left")
    return _told(g, "lineups", [
        ("error", (F.col("teams") != 2).cast("int"), "count of teams is not two"), ("error", F.size(F.array_except("ids", F.coalesce("own", F.col("ids")))), "teams are not the match's"),
        ("error", (F.col("spells") == 0).cast("int"), "no player has a spell"), ("warning", F.col("odd"), "position names are unknown"),
    ])


def verdict(matches: DataFrame, *problems: DataFrame) -> DataFrame:
    """(match_id, ok): no error-level problem."""
    bad = reduce(DataFrame.unionByName, problems).filter("level = 'error'").select("match_id").distinct().withColumn("bad", F.lit(True))
    return matches.select("match_id").distinct().join(bad, "match_id", "left").select("match_id", F.col("bad").isNull().alias("ok"))


def ingest_report(before: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """One row: new and updated keys of a batch against the table before."""
    old = before.select(key).distinct().withColumn("__o", F.lit(1))
    return batch.select(key).distinct().join(old, key, "left").agg(F.count(F.when(F.col("__o").isNull(), 1)).alias("new"), F.count("__o").alias("updated"))


def ingest_items(before: Mapping[str, DataFrame], batch: Mapping[str, DataFrame], keys: Mapping[str, list[str]]) -> DataFrame:
    """(kind, key, state): each key of the batch once per kind (matches, players, teams, leagues), new or updated.

    A kind that the tables before lack is all new. Keys of several columns are joined by '/', null as the empty string.
    """
    def of(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys[kind]]).alias("key")).distinct()

    def told(kind: str) -> DataFrame:
        now = of(batch[kind], kind)
        if kind not in before:
            return now.select(F.lit(kind).alias("kind"), "key", F.lit("new").alias("state"))
        old = of(before[kind], kind).withColumn("__o", F.lit(1))
        state = F.when(F.col("__o").isNull(), "new").otherwise("updated")
        return now.join(old, "key", "left").select(F.lit(kind).alias("kind"), "key", state.alias("state"))

    return reduce(DataFrame.unionByName, [told(kind) for kind in batch])
