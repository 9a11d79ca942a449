"""The star schema of match data: columns, keys and partitioning of its nine tables. Facts are partitioned by league."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import catalogue as cat

#: Metrics that are not whole numbers.
DOUBLES = {"xt", "xa", "xg", "npxg", "open_play_xg", "padj_def_actions", *cat.TEAM_RATES}
_metrics = lambda names: ", ".join(f"{n} {'DOUBLE' if n in DOUBLES else 'BIGINT'}" for n in names)

#: table -> (DDL, key)
TABLES = {
    "competitions": ("competition_id BIGINT, competition_name STRING, country_name STRING, competition_gender STRING", ["competition_id"]),
    "seasons": ("season_id BIGINT, season_name STRING", ["season_id"]),
    "teams": ("team_id BIGINT, team_name STRING", ["team_id"]),
    "players": ("player_id BIGINT, player_name STRING", ["player_id"]),
    "team_competitions": ("team_id BIGINT, competition_id BIGINT, season_id BIGINT", ["team_id", "competition_id", "season_id"]),
    "matches": (
        "match_id BIGINT, competition_id BIGINT, season_id BIGINT, match_date STRING, match_week INT, competition_stage STRING, home_team_id BIGINT, away_team_id BIGINT, home_score INT, away_score INT",
        ["match_id"],
    ),
    "player_match_positions": ("player_id BIGINT, match_id BIGINT, position_id INT, position_name STRING, minutes DOUBLE", ["player_id", "match_id", "position_id"]),
    "player_match_stats": (
        "player_id BIGINT, match_id BIGINT, team_id BIGINT, minutes_played DOUBLE, primary_position_id INT, primary_position_name STRING, " + _metrics(cat.PLAYER_COUNTS),
        ["player_id", "match_id"],
    ),
    "team_match_stats": (
        "team_id BIGINT, match_id BIGINT, opponent_id BIGINT, is_home INT, goals_for INT, goals_against INT, " + _metrics([*cat.TEAM_COUNTS, *cat.TEAM_RATES]),
        ["team_id", "match_id"],
    ),
}
FACTS = ("player_match_positions", "player_match_stats", "team_match_stats")


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name][0])


def conform(df: DataFrame, name: str) -> DataFrame:
    """df in the table's columns, order and types; null where df lacks a column that is no key, ValueError where it is one."""
    if lacking := [k for k in TABLES[name][1] if k not in df.columns]:
        raise ValueError(f"{name} needs {', '.join(lacking)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(name)])


def write_star(tables: dict[str, DataFrame], path: str) -> None:
    """Writes tables of the schema; facts are partitioned by the league of their match, and only leagues that they hold are replaced."""
    for name, df in tables.items():
        rows = conform(df, name)
        if name in FACTS:
            rows = rows.join(tables["matches"].select("match_id", "competition_id", "season_id"), "match_id")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("competition_id", "season_id").parquet(f"{path}/{name}")
        else:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
