"""Registered queries of sweeps, metric tables, lookups, reports and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import fit
from fieldloom.operators import quality as dq
from fieldloom.operators import ranking as rk
from fieldloom.operators import sweep as sw
from fieldloom.operators import tables as tb
from fieldloom.plans.adapters import OBS, clouds, observations
from fieldloom.plans.model_queries import TOPS
from fieldloom.plans.queries import LONG, METRICS, _display, _metrics, _supplier_top, _top_sql, _zsql, c, r6
from fieldloom.plans.registry import query, table
from fieldloom.sources import metrics as mt
from fieldloom.sources import package

CONFIG_SQL = "cf as (select distinct o_orderstatus st, year(o_orderdate)::varchar yr, o_orderpriority pr, 'one' fixed from orders)"


def _configs(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(c("o_orderstatus").alias("st"), F.year("o_orderdate").cast("string").alias("yr"), c("o_orderpriority").alias("pr"), F.lit("one").alias("fixed")).distinct()


@query(f"with {CONFIG_SQL} select st, yr, pr from (select distinct st from cf), (select distinct yr from cf), (select distinct pr from cf)")
def sweep_grid(spark: SparkSession, folder: str) -> DataFrame:
    cf = _configs(spark, folder)
    return sw.grid(spark, {"st": cf.select("st"), "yr": cf.select("yr"), "pr": cf.select("pr")})


@query(f"""with {CONFIG_SQL} select st, yr, pr, fixed, sha256('{{"pr":"' || pr || '","yr":"' || yr || '"}}') fingerprint from cf""")
def sweep_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sw.dedupe(_configs(spark, folder), ["yr", "pr"])


@query(f"with {CONFIG_SQL}, n as (select count(distinct st) st, count(distinct yr) yr, count(distinct pr) pr, count(distinct fixed) fixed from cf) select * from (unpivot n on st, yr, pr, fixed into name axis value n) where n > 1")
def varying_axes(spark: SparkSession, folder: str) -> DataFrame:
    return sw.varying_axes(_configs(spark, folder), ["st", "yr", "pr", "fixed"])


@query(f"""with {CONFIG_SQL}, g as (select distinct yr, pr, '{{"pr":"' || pr || '","yr":"' || yr || '"}}' canon from cf), old as (select *, row_number() over (order by canon desc) n from g where yr::int % 2 = 0),
  nw as (select *, row_number() over (order by canon) + (select max(n) from old) n from g where yr::int % 2 = 1) select 'v' || n "name", yr, pr from (select * from old union all select * from nw)""")
def combination_names(spark: SparkSession, folder: str) -> DataFrame:
    """Even years have their names from before, in falling order."""
    cf = _configs(spark, folder).select("yr", "pr").distinct()
    canon = F.to_json(F.struct("pr", "yr"))
    old = cf.filter("yr % 2 = 0").withColumn("name", F.concat(F.lit("v"), F.row_number().over(rk.Window.orderBy(canon.desc()))))
    return sw.assign_names(old, cf, ["yr", "pr"])


@query(f"""with {METRICS} select combination, entity, metric, round(case when yr < '1995' then "value" * 2 else "value" end, 4) "value" from l""")
def accumulated_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Rows up to 1996 from before; the batch doubles those up to 1994 and adds those from 1997 on."""
    m = _metrics(spark, folder).select("combination", "entity", "metric", "value", "yr")
    batch = m.filter("yr < 1995 or yr >= 1997").withColumn("value", F.when(c("yr") < 1995, c("value") * 2).otherwise(c("value")))
    got = tb.accumulate(m.filter("yr < 1997"), batch, ["combination", "entity", "metric"])
    return got.select("combination", "entity", "metric", F.round("value", 4).alias("value"))


@query("""select o_orderkey::varchar combination, 'm' || o_custkey || '_euclidean' model, 'euclidean' distance, round(case when o_orderkey % 7 <> 0 then o_totalprice end, 2) "value" from orders""")
def typed_metrics(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "orders").select(c("o_orderkey").alias("combination"), F.concat(F.lit("m"), "o_custkey").alias("model"), F.when(c("o_orderkey") % 7 == 0, "none").otherwise(F.round("o_totalprice", 2).cast("string")).alias("value"))
    return mt.typed(raw)


@query("""select count(*) filter (c_custkey % 3 = 0) "new", count(*) filter (c_custkey % 3 <> 0) updated from customer where c_custkey % 2 = 0""")
def ingest_counts(spark: SparkSession, folder: str) -> DataFrame:
    cu = table(spark, folder, "customer").select("c_custkey")
    return dq.ingest_report(cu.filter("c_custkey % 3 != 0"), cu.filter("c_custkey % 2 = 0"), "c_custkey")


@query("""
with o as (select o_orderkey, o_custkey, o_orderpriority, year(o_orderdate) yr from orders),
k as (
    select 'matches' kind, o_orderkey::varchar "key", yr from o
    union all select 'players', o_custkey::varchar, yr from o
    union all select 'leagues', coalesce(o_orderpriority, '') || '/' || yr, yr from o
)
select kind, "key", case when bool_or(yr <= 1996) then 'updated' else 'new' end state
from k group by kind, "key" having bool_or(yr >= 1996)
""")
def ingest_items(spark: SparkSession, folder: str) -> DataFrame:
    """Orders up to 1996 are the tables before, those from 1996 on the batch."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("yr"))
    keys = {"matches": ["o_orderkey"], "players": ["o_custkey"], "leagues": ["o_orderpriority", "yr"]}
    before, batch = o.filter("yr <= 1996"), o.filter("yr >= 1996")
    return dq.ingest_items(dict.fromkeys(keys, before), dict.fromkeys(keys, batch), keys)


@query("""select c_custkey id, case when c_custkey % 2 = 0 and c_custkey % 3 = 0 then 'ready' when c_custkey % 2 = 0 then 'without_data' when c_custkey % 3 = 0 then 'projectable' else 'unknown' end status from customer""")
def entity_lookup(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "customer").select(c("c_custkey").alias("id"))
    return rk.lookup(ids, ids.filter("id % 2 = 0"), ids.filter("id % 3 = 0"))


@query("select c_custkey, c_name from customer where lower(trim(c_name)) = 'customer#000000007'")
def find_by_name(spark: SparkSession, folder: str) -> DataFrame:
    return package.find_by_name(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_name", "  CUSTOMER#000000007 ")


@query(f"""with {OBS}, {_zsql("partition by league")}, {LONG}, k as (select *, row_number() over (partition by entity order by abs(z) desc, feature) n from l) select entity, feature, round(z, 6) z, n::bigint "rank" from k where n <= 3""")
def distinctive_traits(spark: SparkSession, folder: str) -> DataFrame:
    return rk.traits(_display(spark, folder), "entity", 3).withColumn("z", F.round("z", 6))


@query(f"""with {TOPS}, {_top_sql("", "2")}, r as (select a, b, score, r, 'league' mode from t1 where r <= 10 union all select a, b, score, r, 'global' from t2 where r <= 10)
  select x.s_name reference, mode, r::bigint "rank", y.s_name candidate, round(score, 6) score from r join supplier x on a = x.s_suppkey join supplier y on b = y.s_suppkey where a % 20 = 0""")
def comparison_report(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    tops = {m: rk.top_k(_supplier_top(spark, folder, g, 10, asked=True), 10) for m, g in (("league", "league"), ("global", None))}
    return mt.comparison_report(tops, names).withColumn("score", F.round("score", 6))


@query(f"""with {TOPS}, {_zsql("partition by league")}, {LONG}, q as (select s_name text, 'exact' status, s_suppkey a from supplier where s_suppkey % 20 = 0 union all select 'Supplier#', 'ambiguous', null union all select 'nobody', 'absent', null),
  t as (select a, b, score, r from t1 where r <= 5 and a % 20 = 0), p as (select t.a, t.b, x.feature, round(abs(x.z) - abs(x.z - y.z), 9) s from t join l x on x.entity = t.a join l y on y.entity = t.b and y.feature = x.feature),
  k as (select *, row_number() over (partition by a, b order by s desc, feature) n from p), w2 as (select a, b, string_agg(feature, ',' order by n) traits from k where n <= 3 group by all)
  select text, status, q.a, r::bigint "rank", t.b, s_name candidate, round(score, 6) score, traits from q left join t on t.a = q.a left join w2 on w2.a = t.a and w2.b = t.b left join supplier on s_suppkey = t.b""")
def query_by_name(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    texts = names.filter("id % 20 = 0").select(c("name").alias("text")).unionByName(spark.createDataFrame([("Supplier#",), ("nobody",)], "text string"))
    got = rk.query_by_name(texts, names, _supplier_top(spark, folder, "league", 5, asked=True), _display(spark, folder), 5, 3)
    return got.select("text", "status", "a", "rank", "b", "candidate", r6(c("score"), "score"), F.array_join("traits", ",").alias("traits"))


# --- fits, held against numpy in the tests ------------------------------------------------------------------------------


def _matrix(spark: SparkSession, folder: str) -> DataFrame:
    return clouds(spark, folder).select(c("label").alias("entity_id"), c("id").alias("match_id"), "mass", "x")


@query()
def fit_f2(spark: SparkSession, folder: str) -> DataFrame:
    return fit.fit_f2(_matrix(spark, folder), neighbours=10)["scores"]


@query()
def fit_f5(spark: SparkSession, folder: str) -> DataFrame:
    """Labels' clouds by the parameters of the served team model."""
    how = fit.preset("team", "5", "global")
    return fit.fit_f5(_matrix(spark, folder), 64, 9, distance=fit.SERVED_DISTANCE, **how)["scores"]


@query()
def rebuilt_halves(spark: SparkSession, folder: str) -> DataFrame:
    """Each label's odd and even rows as entities of their own."""
    m = _matrix(spark, folder)
    halves = tb.split_halves(m, "entity_id", "match_id").select("entity_id", "match_id", F.concat_ws("/", "half", c("entity_id").cast("string")).alias("group"))
    return fit.rebuild(m, "5", halves, d=64, k=19, dim=256)
