"""From match tables to a model's input, and the tables around a model: observations, universes, leagues, careers, alignment.

stats: player_match_stats or team_match_stats; matches: (match_id, competition_id, season_id, match_date, ...). Dimension
tables (players, teams, competitions, seasons) have one row per id; Spark broadcasts them where they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import catalogue as cat
from fieldloom.functions.scalars import position_slug, role_of
from fieldloom.operators.tables import argmax_label

#: kind -> (id, name) columns of its dimension
ENTITY = {"player": ("player_id", "player_name"), "team": ("team_id", "team_name")}
#: The columns that hold a player's share of minutes by position.
POSITION_FEATURES = ["pos_" + p.lower().replace(" ", "_") for p in cat.POSITIONS]


def league_key() -> Column:
    return F.concat_ws("-", F.col("competition_id").cast("string"), F.col("season_id").cast("string"))


def star_join(stats: DataFrame, names: DataFrame, matches: DataFrame, kind: str) -> DataFrame:
    """stats with entity_id, entity_name, competition_id, season_id and league_key; rows without name or match are left out."""
    if kind not in ENTITY:
        raise ValueError(f"unknown kind {kind}")
    key, name = ENTITY[kind]
    rows = stats.join(names.select(key, F.col(name).alias("entity_name")), key).join(matches.select("match_id", "competition_id", "season_id"), "match_id")
    return rows.withColumnRenamed(key, "entity_id").withColumn("league_key", league_key())


def position_fractions(positions: DataFrame) -> DataFrame:
    """(player_id, match_id, pos_...): share of the minutes of the match at each position; 0 where no minutes are known."""
    rows = positions.withColumn("slug", position_slug(F.col("position_name")))
    total = F.sum("minutes").over(Window.partitionBy("player_id", "match_id"))
    rows = rows.withColumn("fraction", F.when(total > 0, F.col("minutes") / total).otherwise(0.0))
    return rows.groupBy("player_id", "match_id").pivot("slug", POSITION_FEATURES).agg(F.sum("fraction")).na.fill(0.0)


def with_positions(observations: DataFrame, positions: DataFrame) -> DataFrame:
    """Observations with the 25 position columns, 0 where a player has no position in the match."""
    shares = position_fractions(positions).withColumnRenamed("player_id", "entity_id")
    return observations.join(shares, ["entity_id", "match_id"], "left").na.fill(0.0, POSITION_FEATURES)


def load_observations(kind: str, stats: DataFrame, names: DataFrame, matches: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """One row per (entity, match), with positions for players."""
    rows = star_join(stats, names, matches, kind)
    return rows if positions is None or kind == "team" else with_positions(rows, positions)


def mass(kind: str) -> Column:
    """Weight of an observation: minutes / 90 for players, 1 for teams."""
    if kind not in ENTITY:
        raise ValueError(f"unknown kind {kind}")
    return F.col("minutes_played").cast("double") / 90 if kind == "player" else F.lit(1.0)


def scale_positions(z: DataFrame, raw: DataFrame | None = None, mode: str = "zscore_sqrt", keys: tuple[str, ...] = ("entity_id", "match_id")) -> DataFrame:
    """The position block of a z-scored table by mode.

    zscore: as it is; zscore_sqrt: divided by the square root of the catalogue's size, so that the block weighs as one feature;
    raw: the unscaled fractions of `raw`, 0 where missing, take the place of the z-scores.
    """
    if mode == "zscore":
        return z
    if mode == "zscore_sqrt":
        return z.withColumns({p: F.col(p) / F.sqrt(F.lit(float(len(POSITION_FEATURES)))) for p in POSITION_FEATURES if p in z.columns})
    if mode == "raw":
        return z.drop(*POSITION_FEATURES).join(raw.select(*keys, *POSITION_FEATURES), list(keys), "left").na.fill(0.0, POSITION_FEATURES)
    raise ValueError(f"unknown mode {mode}")


def entity_universe(observations: DataFrame) -> DataFrame:
    return observations.select("entity_id", "entity_name").distinct()


def minutes_per_player(stats: DataFrame) -> DataFrame:
    return stats.groupBy("player_id").agg(F.sum("minutes_played").alias("minutes"))


def role_per_player(stats: DataFrame) -> DataFrame:
    """The coarse role with most minutes; the first in order of equals."""
    rows = stats.withColumn("role", role_of(F.col("primary_position_name")))
    return argmax_label(rows, ["player_id"], "role", "minutes_played").select("player_id", "role")


def position_usage(positions: DataFrame) -> DataFrame:
    """(player_id, position_name, minutes, fraction, rank) over the positions that the catalogue knows, most minutes first."""
    known = positions.filter(F.col("position_name").isin(cat.POSITIONS)).groupBy("player_id", "position_name").agg(F.sum(F.coalesce("minutes", F.lit(0.0))).alias("minutes")).filter("minutes > 0")
    w = Window.partitionBy("player_id")
    rows = known.withColumn("fraction", F.col("minutes") / F.sum("minutes").over(w))
    return rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("fraction"), "position_name")).cast("bigint"))


def dataset_summary(matches: DataFrame, players: DataFrame, teams: DataFrame) -> DataFrame:
    """(competition_id, season_id, matches) and, in each row, the totals of matches, players and teams."""
    totals = [t.agg(F.count("*").alias(n)) for n, t in (("all_matches", matches), ("all_players", players), ("all_teams", teams))]
    out = matches.groupBy("competition_id", "season_id").agg(F.count("*").alias("matches"))
    for t in totals:
        out = out.crossJoin(F.broadcast(t))  # one row each
    return out


def leagues_per_entity(observations: DataFrame, matches: DataFrame) -> DataFrame:
    """(entity_id, leagues): distinct league keys in order of their first match (date, then id)."""
    first = observations.join(matches.select("match_id", "match_date"), "match_id").groupBy("entity_id", "league_key").agg(F.min(F.struct("match_date", "match_id")).alias("first"))
    return first.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "league_key"))), lambda r: r["league_key"]).alias("leagues"))


def league_names(competitions: DataFrame, seasons: DataFrame) -> DataFrame:
    """(league_key, name) for every competition in every season: both are small dimensions."""
    both = competitions.select("competition_id", "competition_name").crossJoin(F.broadcast(seasons.select("season_id", "season_name")))
    return both.select(league_key().alias("league_key"), F.trim(F.concat_ws(" ", "competition_name", "season_name")).alias("name"))


def league_names_used(matches: DataFrame, competitions: DataFrame, seasons: DataFrame) -> DataFrame:
    """(league_key, name) of the leagues that have matches; the key where nothing has a name."""
    keys = matches.select("competition_id", "season_id").distinct()
    named = keys.join(competitions.select("competition_id", "competition_name"), "competition_id", "left").join(seasons.select("season_id", "season_name"), "season_id", "left")
    text = F.concat_ws(" ", F.nullif(F.col("competition_name"), F.lit("")), F.nullif(F.col("season_name"), F.lit("")))
    return named.select(league_key().alias("league_key"), F.coalesce(F.nullif(text, F.lit("")), league_key()).alias("name"))


def exclude_leagues(observations: DataFrame, keys: DataFrame, key: str = "league_key") -> DataFrame:
    """Rows outside the leagues named in keys; ValueError if none is left."""
    rest = observations.join(keys.select(key).distinct(), key, "left_anti")
    if rest.isEmpty():
        raise ValueError("no observations outside the excluded leagues")
    return rest


def resolve_holdout(leagues: DataFrame, texts: list[str]) -> DataFrame:
    """(league_key, name, first): leagues whose key is one of the texts or whose name contains one; first: the place of the first such text.

    Blank texts are passed over; a text that names no league is an error, as an empty hold-out would be evaluated in silence.
    """
    asked = [(i, t.strip().lower()) for i, t in enumerate(texts) if t.strip()]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in asked]) if asked else F.array().cast("array<struct<i: int, t: string>>")
    fits = F.filter(wanted, lambda w: (F.lower("league_key") == w["t"]) | F.contains(F.lower("name"), w["t"]))
    found = leagues.withColumn("fits", F.transform(fits, lambda w: w["i"]))
    met = {r.i for r in found.select(F.explode("fits").alias("i")).distinct().collect()}  # at most one per text
    if lacking := [t for i, t in asked if i not in met]:
        raise ValueError(f"no league is named {lacking[0]!r}")
    return found.filter(F.size("fits") > 0).select("league_key", "name", F.array_min("fits").alias("first"))


def career(stats: DataFrame, teams: DataFrame, matches: DataFrame) -> DataFrame:
    """(player_id, club, team_id, league, minutes, matches, since, current): a player's clubs by league, oldest first.

    A club without a name or a match without a date stays, with a name made of its id and an empty league and date.
    """
    rows = stats.filter("team_id is not null").join(teams.select("team_id", "team_name"), "team_id", "left").join(matches.select("match_id", "competition_id", "season_id", "match_date"), "match_id", "left")
    league = F.when(F.col("competition_id").isNotNull() & F.col("season_id").isNotNull(), league_key()).otherwise("")
    name = F.coalesce(F.nullif(F.col("team_name"), F.lit("")), F.concat(F.lit("Team "), F.col("team_id").cast("string")))
    by = rows.groupBy("player_id", "team_id", name.alias("club"), league.alias("league")).agg(F.sum(F.coalesce("minutes_played", F.lit(0.0))).alias("minutes"), F.count("*").alias("matches"), F.min(F.coalesce("match_date", F.lit(""))).alias("since"))
    w = Window.partitionBy("player_id")
    order = by.withColumn("place", F.row_number().over(w.orderBy("since", "league", "club", "team_id")).cast("bigint"))
    return order.withColumn("current", F.col("place") == F.count("*").over(w))


def league_steps(careers: DataFrame) -> DataFrame:
    """(player_id, league, clubs, since, step): clubs of one league together, leagues by their first match."""
    steps = careers.groupBy("player_id", "league").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "club"))), lambda r: r["club"]).alias("clubs"), F.min("since").alias("since"))
    return steps.withColumn("step", F.row_number().over(Window.partitionBy("player_id").orderBy("since", "league")).cast("bigint"))


def align(table: DataFrame, entities: DataFrame, features: list[str], key: str = "entity_id") -> DataFrame:
    """table with a model's entities as rows and its features as columns, in its order; null where the table has nothing.

    ValueError if no entity or no feature is found: then the table is not the model's.
    """
    known = [f for f in features if f in table.columns]
    if not known or table.join(entities.select(key), key, "left_semi").isEmpty():
        raise ValueError("the table and the model have no entity or no feature in common")
    rows = entities.select(key).join(table.select(key, *[F.col(f).cast("double").alias(f) for f in known]), key, "left")
    return rows.select(key, *[F.col(f) if f in known else F.lit(None).cast("double").alias(f) for f in features])
