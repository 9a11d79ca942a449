"""The driver tables seen as an event log, as observations of entities, and as clouds of vectors; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import scalars as fn
from fieldloom.operators.events import run_id, with_idx
from fieldloom.plans.registry import table

FEATURES = ["qty", "price", "disc", "tax", "returned"]


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """match_id = day, idx by time, team = user % 2, player_id = user; places made from props and value."""
    e = table(spark, folder, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("match_id"), "ts", "event_id", (F.col("user_id") % 2).alias("team"), F.col("user_id").alias("player_id"), F.col("event_type").alias("type"), F.lit(1).alias("period"),
        fn.epoch_seconds(F.col("ts")).alias("sec"), F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)).alias("k"), F.coalesce("value", F.lit(0.0)).alias("value"),
    )
    e = with_idx(e, "match_id", "ts", "event_id").drop("ts")
    return e.withColumns({"x": F.pmod(F.col("k") * F.lit(1.2), F.lit(120.0)), "y": F.pmod(F.col("value") * F.lit(1.6), F.lit(80.0))})


def with_runs(e: DataFrame) -> DataFrame:
    return run_id(e, "match_id", "team")


EV = """ev as (select strftime(ts, '%Y-%m-%d') match_id, event_id, user_id % 2 team, user_id player_id, event_type type, epoch_ms(ts) // 1000 sec, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) k,
  coalesce(value, 0.0) "value", row_number() over (partition by strftime(ts, '%Y-%m-%d') order by ts, event_id) idx from events),
e as (select *, (k * 1.2::double) % 120.0::double x, (("value" * 1.6::double) % 80.0::double + 80.0::double) % 80.0::double y from ev),
f as (select *, case when lag(team) over (partition by match_id order by idx) is not distinct from team and lag(idx) over (partition by match_id order by idx) is not null then 0 else 1 end fresh from e),
r as (select *, sum(fresh) over (partition by match_id order by idx)::bigint run from f)"""


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per supplier and month: league = the supplier's region, mass = lines / 10, sums and means of lines."""
    dims = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dims = dims.select("s_suppkey", F.col("r_name").alias("league"))
    month = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint")
    d = lambda c: F.col(c).cast("double")
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), month.alias("match")).agg(
        (F.count("*") / 10).alias("mass"), F.sum(d("l_quantity")).alias("qty"), (F.sum(d("l_extendedprice")) / 1000).alias("price"), F.avg(d("l_discount")).alias("disc"), F.avg(d("l_tax")).alias("tax"), F.sum(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("returned"))
    return rows.join(dims, F.col("entity") == F.col("s_suppkey")).drop("s_suppkey")


OBS = """ob as (select l_suppkey entity, (year(l_shipdate) * 100 + month(l_shipdate))::bigint "match", count(*) / 10 mass, sum(l_quantity::double) qty, sum(l_extendedprice::double) / 1000 price,
  avg(l_discount::double) disc, avg(l_tax::double) tax, sum(case when l_returnflag = 'R' then 1.0::double else 0.0::double end) returned from lineitem group by all),
o as (select ob.*, r_name league from ob join supplier on entity = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def clouds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("label"), F.lit(1.0).alias("mass"), F.col("embedding").cast("array<double>").alias("x"))
