"""Sources of a match-data package: competitions.json, matches/<competition>/<season>.json, events/<match>.json, lineups/<match>.json.

Each file is read whole as one row and parsed with an explicit schema, so that the order of an array is its position. File names
give the keys that rows do not hold. `to_bronze` writes events as Parquet, partitioned by competition and season, once.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators.events import EVENT_DDL

COMPETITION = "competition_id BIGINT, season_id BIGINT, competition_name STRING, season_name STRING, country_name STRING, competition_gender STRING"
MATCH = (
    "match_id BIGINT, match_date STRING, match_week INT, competition_stage STRUCT<name: STRING>, home_team STRUCT<home_team_id: BIGINT, home_team_name: STRING>, "
    "away_team STRUCT<away_team_id: BIGINT, away_team_name: STRING>, home_score INT, away_score INT"
)
LINEUP = "team_id BIGINT, team_name STRING, lineup ARRAY<STRUCT<player_id: BIGINT, player_name: STRING, player_nickname: STRING, positions: ARRAY<STRUCT<position_id: INT, position: STRING, `from`: STRING, `to`: STRING>>>>"
PROBLEM = "level STRING, place STRING, match_id BIGINT, message STRING"


def whole_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, value); no rows where no file fits."""
    schema = "value STRING"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        return spark.createDataFrame([], "path STRING, value STRING")
    return spark.read.schema(schema).option("wholetext", True).text(glob).select(F.col("_metadata.file_path").alias("path"), "value")


def _array(df: DataFrame, ddl: str, *keep: str) -> DataFrame:
    rows = df.select(*keep, F.posexplode(F.from_json("value", f"ARRAY<STRUCT<{ddl}>>", {"mode": "PERMISSIVE"})).alias("pos", "r"))
    return rows.select(*keep, "pos", "r.*")


def read_competitions(spark: SparkSession, root: str) -> DataFrame:
    return _array(whole_files(spark, f"{root}/competitions.json"), COMPETITION).drop("pos")


def match_files(spark: SparkSession, root: str) -> DataFrame:
    f = whole_files(spark, f"{root}/matches/*/*.json")
    key = lambda k: F.regexp_extract("path", r"matches/(\d+)/(\d+)\.json$", k)
    return f.filter(key(1) != "").select(key(1).cast("bigint").alias("competition_id"), key(2).cast("bigint").alias("season_id"), "value")


def read_matches(spark: SparkSession, root: str) -> DataFrame:
    m = _array(match_files(spark, root), MATCH, "competition_id", "season_id")
    return m.select("match_id", "competition_id", "season_id", "match_date", "match_week", F.col("competition_stage.name").alias("competition_stage"), F.col("home_team.home_team_id").alias("home_team_id"), F.col("home_team.home_team_name").alias("home_team_name"), F.col("away_team.away_team_id").alias("away_team_id"), F.col("away_team.away_team_name").alias("away_team_name"), "home_score", "away_score")


def by_match(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_extract("path", r"(\d+)\.json$", 1).cast("bigint").alias("match_id"), "value")


def read_events(spark: SparkSession, root: str) -> DataFrame:
    return _array(by_match(whole_files(spark, f"{root}/events/*.json")), EVENT_DDL, "match_id")


def read_lineups(spark: SparkSession, root: str) -> DataFrame:
    return _array(by_match(whole_files(spark, f"{root}/lineups/*.json")), LINEUP, "match_id").drop("pos")


def to_bronze(events: DataFrame, matches: DataFrame, path: str) -> None:
    keyed = events.join(matches.select("match_id", "competition_id", "season_id"), "match_id", "left")
    keyed.repartition("competition_id", "season_id", F.pmod(F.xxhash64("match_id"), F.lit(16))).sortWithinPartitions("match_id", "pos").write.mode("overwrite").partitionBy("competition_id", "season_id").parquet(path)


def competitions_catalog(competitions: DataFrame, files: DataFrame) -> DataFrame:
    """One row per competition with its seasons by name; available where the season's match file is there."""
    have = files.select("competition_id", "season_id", F.lit(True).alias("have")).distinct()
    seasons = F.sort_array(F.collect_list(F.struct("season_name", "season_id", F.coalesce("have", F.lit(False)).alias("available"))))
    return competitions.join(have, ["competition_id", "season_id"], "left").groupBy("competition_id", "competition_name").agg(seasons.alias("seasons"))


def match_counts(competitions: DataFrame, matches: DataFrame) -> DataFrame:
    n = matches.groupBy("competition_id", "season_id").agg(F.count("*").alias("n"))
    return competitions.join(n, ["competition_id", "season_id"], "left").select("competition_name", "season_name", F.coalesce("n", F.lit(0)).alias("match_count"))


def find_by_name(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose name is the text, whatever the case and the blanks around."""
    return df.filter(F.lower(F.trim(column)) == F.lit(text.strip().lower()))


def validate_structure(spark: SparkSession, root: str, matches: DataFrame) -> DataFrame:
    """Problems (level, place, match_id, message) of the matches' files: missing, no JSON, or no list."""
    out = spark.createDataFrame([], PROBLEM)
    for place in ("events", "lineups"):
        files = by_match(whole_files(spark, f"{root}/{place}/*.json"))
        each = matches.select("match_id").distinct().join(files, "match_id", "left")
        parsed = F.try_parse_json("value")
        told = F.when(F.col("value").isNull(), "the file is missing").when(parsed.isNull(), "the file is no JSON").when(~F.startswith(F.schema_of_variant(parsed), F.lit("ARRAY")), "the file is no list")
        out = out.unionByName(each.select(F.lit("error").alias("level"), F.lit(place).alias("place"), "match_id", told.alias("message")).filter("message is not null"))
    return out


def discover(spark: SparkSession, root: str, ids: list[int] | None = None, competition: str | None = None, season: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches to take, problems): declared matches by name and id; undeclared, repeated and missing ones are problems."""
    comps, matches = read_competitions(spark, root), read_matches(spark, root)
    wanted = find_by_name(comps, "competition_name", competition) if competition else comps
    wanted = find_by_name(wanted, "season_name", season) if season else wanted
    keys = ["competition_id", "season_id"]
    taken = matches.join(wanted.select(*keys).distinct(), keys, "left_semi")
    ask = spark.createDataFrame([(i,) for i in ids or []], "match_id BIGINT")
    taken = taken.join(F.broadcast(ask), "match_id", "left_semi") if ids else taken
    n = F.row_number().over(Window.partitionBy("match_id").orderBy(*keys))
    taken = taken.withColumn("__n", n)
    problem = lambda df, level, place, text: df.select(F.lit(level).alias("level"), F.lit(place).alias("place"), "match_id", F.lit(text).alias("message"))
    found = problem(matches.join(comps, keys, "left_anti"), "error", "matches", "its competition and season are not declared")
    found = found.unionByName(problem(taken.filter("__n > 1"), "error", "matches", "the match is there more than once"))
    found = found.unionByName(problem(ask.join(matches, "match_id", "left_anti"), "error", "matches", "the match is asked for but not there"))
    return taken.filter("__n = 1").drop("__n"), found


def _listed(rows: Column) -> Column:
    return F.to_json(F.collect_list(rows)).alias("value")


def package_files(competitions: DataFrame, matches: DataFrame, events: DataFrame, lineups: DataFrame) -> DataFrame:
    """(path, value): the files of a package. A match's events are gathered in order of pos; matches are as `read_matches` gives them."""
    named = lambda key, name, side: F.struct(F.col(f"{side}_team_id").alias(key), F.col(f"{side}_team_name").alias(name))
    match = F.struct(
        "match_id", F.col("match_date").cast("string").alias("match_date"), "match_week", F.struct(F.col("competition_stage").alias("name")).alias("competition_stage"),
        named("home_team_id", "home_team_name", "home").alias("home_team"), named("away_team_id", "away_team_name", "away").alias("away_team"), "home_score", "away_score",
    )
    event = F.struct(*[F.col(f"`{c}`") for c in events.columns if c not in ("match_id", "pos")]).alias("e")
    ordered = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", event))), lambda x: x["e"])).alias("value")
    path = lambda *parts: F.concat(*[F.lit(p) if p.endswith(("/", ".json")) else F.col(p).cast("string") for p in parts]).alias("path")
    parts = [
        competitions.agg(_listed(F.struct(*competitions.columns))).select(F.lit("competitions.json").alias("path"), "value"),
        matches.groupBy("competition_id", "season_id").agg(_listed(match)).select(path("matches/", "competition_id", "/", "season_id", ".json"), "value"),
        events.groupBy("match_id").agg(ordered).select(path("events/", "match_id", ".json"), "value"),
        lineups.groupBy("match_id").agg(_listed(F.struct("team_id", "team_name", "lineup"))).select(path("lineups/", "match_id", ".json"), "value"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def write_files(files: DataFrame, root: str) -> None:
    """Writes (path, value) as files of these names under root. Executors write them aside; the driver then only renames."""
    spark, aside = files.sparkSession, f"{root}/_writing"
    files.write.partitionBy("path").text(aside)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(at(aside)):
        name = folder.getPath().getName()
        if name.startswith("path="):
            target = at(f"{root}/{unquote(name.removeprefix('path='))}")
            fs.mkdirs(target.getParent())
            for part in fs.listStatus(folder.getPath()):
                if part.getPath().getName().startswith("part-"):
                    fs.rename(part.getPath(), target)
    fs.delete(at(aside), True)
