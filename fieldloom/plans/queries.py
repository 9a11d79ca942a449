"""Registered queries of the analytics operators over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import catalogue as cat
from fieldloom.functions import scalars as fn
from fieldloom.operators import evaluation as ev
from fieldloom.operators import events as eo
from fieldloom.operators import features as fe
from fieldloom.operators import geometry as geo
from fieldloom.operators import matrices as mx
from fieldloom.operators import ranking as rk
from fieldloom.operators import sweep as sw
from fieldloom.operators import phases as ph
from fieldloom.operators import quantiles as qt
from fieldloom.operators import ranks as rn
from fieldloom.operators import tables as tb
from fieldloom.operators import transport as tr
from fieldloom.plans.adapters import EV, FEATURES, OBS, clouds, event_log, observations, with_runs
from fieldloom.plans.registry import query, table

TYPES = ["click", "error", "purchase", "signup", "view"]
c = F.col


def r6(x, name: str):
    return fn.round_scaled(x, 6).alias(name)


def n(cond) -> F.Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


# --- events -----------------------------------------------------------------------------------------------------------

NEXT = "m as (select *, lead(x) over (partition by match_id order by idx) ex, lead(y) over (partition by match_id order by idx) ey from e), d as (select *, sqrt((120-x)**2 + (40-y)**2) d0, sqrt((120-ex)**2 + (40-ey)**2) d1 from m)"


def _moves(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("match_id").orderBy("idx")
    return event_log(spark, folder).withColumns({"ex": F.lead("x").over(w), "ey": F.lead("y").over(w)})


@query(f"""with {EV}, {NEXT} select match_id, count(*) filter (d0 > 0 and d0 - d1 >= 0.25 * d0) progressive, count(*) filter (x >= 102 and y between 18 and 62) in_box,
  count(*) filter (x >= 80) final_third, round(avg(d0), 6) mean_distance from d group by match_id""")
def zone_progress(spark: SparkSession, folder: str) -> DataFrame:
    m = _moves(spark, folder)
    return m.groupBy("match_id").agg(n(fn.is_progressive(c("x"), c("y"), c("ex"), c("ey"))).alias("progressive"), n(fn.in_box(c("x"), c("y"))).alias("in_box"), n(fn.in_final_third(c("x"))).alias("final_third"), r6(F.avg(fn.dist_to_goal(c("x"), c("y"))), "mean_distance"))


GRID = "[" + ", ".join(str(v) for row in cat.THREAT for v in row) + "]::double[]"


def _cell(x: str, y: str) -> str:
    return f"({GRID})[least(greatest(trunc({y} / 80.0::double * 8)::int, 0), 7) * 12 + least(greatest(trunc({x} / 120.0::double * 12)::int, 0), 11) + 1]"


@query(f"with {EV}, {NEXT} select match_id, team, round(sum(greatest(0.0::double, {_cell('ex', 'ey')} - {_cell('x', 'y')})), 6) threat from m where ex is not null group by match_id, team")
def grid_threat(spark: SparkSession, folder: str) -> DataFrame:
    m = _moves(spark, folder).filter("ex is not null")
    return m.groupBy("match_id", "team").agg(r6(F.sum(fn.threat_gain(c("x"), c("y"), c("ex"), c("ey"))), "threat"))


@query(f"with {EV}, g as (select match_id, run, count(*) n from r group by match_id, run) select match_id, count(*) runs, max(n) longest from g group by match_id")
def run_islands(spark: SparkSession, folder: str) -> DataFrame:
    g = with_runs(event_log(spark, folder)).groupBy("match_id", "run").agg(F.count("*").alias("n"))
    return g.groupBy("match_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


@query(f"""with {EV}, p as (select s.match_id, s.idx, a.player_id, row_number() over (partition by s.match_id, s.idx order by a.idx desc) k
  from r s join r a on s.match_id = a.match_id and s.run = a.run and s.team = a.team and a.idx < s.idx and a.type in ('click', 'view', 'signup') where s.type = 'purchase')
  select player_id, count(*) credits from p where k <= 2 group by player_id""")
def shot_lookback(spark: SparkSession, folder: str) -> DataFrame:
    met = eo.lookback(with_runs(event_log(spark, folder)), c("type") == "purchase", c("type").isin("click", "view", "signup"))
    return met.groupBy("player_id").agg(F.count("*").alias("credits"))


@query(f"""with {EV} select match_id, team, count(*) regains from e p where type = 'error' and exists (select 1 from e h where h.match_id = p.match_id and h.team = p.team
  and h.idx > p.idx and h.type in ('click', 'view') and h.sec - p.sec <= 300) group by match_id, team""")
def regain_window(spark: SparkSession, folder: str) -> DataFrame:
    got = eo.regains(event_log(spark, folder), c("type") == "error", c("type").isin("click", "view"), seconds=300.0)
    return got.groupBy("match_id", "team").agg(F.count("*").alias("regains"))


@query(f"""with {EV}, g as (select match_id, run, team, count(*) n, arg_min(x, idx) start, max(x) far, max(sec) - min(sec) took from r group by match_id, run, team)
  select match_id, team, count(*) sequences, round(avg(n), 6) events_per_sequence, round(avg(start), 6) start_x, count(*) filter (n >= 3) long_sequences,
  round(coalesce(avg(case when far > start and took > 0 then (far - start) / took end), 0), 6) speed from g group by match_id, team""")
def possession_sequences(spark: SparkSession, folder: str) -> DataFrame:
    g = with_runs(event_log(spark, folder)).groupBy("match_id", "run", "team").agg(F.count("*").alias("n"), F.min_by("x", "idx").alias("start"), F.max("x").alias("far"), (F.max("sec") - F.min("sec")).alias("took"))
    speed = F.when((c("far") > c("start")) & (c("took") > 0), (c("far") - c("start")) / c("took"))
    return g.groupBy("match_id", "team").agg(F.count("*").alias("sequences"), r6(F.avg("n"), "events_per_sequence"), r6(F.avg("start"), "start_x"), n(c("n") >= 3).alias("long_sequences"), r6(F.coalesce(F.avg(speed), F.lit(0.0)), "speed"))


@query(f"""with {EV} select match_id, player_id, {', '.join(f"count(*) filter (type = '{t}') {t}s" for t in TYPES)}, round(coalesce(sum("value") filter (type = 'purchase'), 0), 6) purchase_value,
  count(*) filter (x >= 102 and y between 18 and 62) box_events from e group by match_id, player_id""")
def actor_day_metrics(spark: SparkSession, folder: str) -> DataFrame:
    kinds = [n(c("type") == t).alias(f"{t}s") for t in TYPES]
    return event_log(spark, folder).groupBy("match_id", "player_id").agg(*kinds, r6(F.sum(F.when(c("type") == "purchase", c("value")).otherwise(0.0)), "purchase_value"), n(fn.in_box(c("x"), c("y"))).alias("box_events"))


@query(f"""with {EV}, g as (select match_id, team, count(*) touches, count(*) filter (type = 'view' and x <= 72) passes, count(*) filter (type in ('error', 'signup') and x >= 48) acts from e group by match_id, team)
  select match_id, team, round(touches / sum(touches) over (partition by match_id), 6) share, round((sum(passes) over (partition by match_id) - passes) / nullif(acts, 0), 6) ppda from g""")
def team_share_ppda(spark: SparkSession, folder: str) -> DataFrame:
    g = event_log(spark, folder).groupBy("match_id", "team").agg(F.count("*").alias("touches"), n((c("type") == "view") & (c("x") <= 72)).alias("passes"), n(c("type").isin("error", "signup") & (c("x") >= 48)).alias("acts"))
    share = c("touches") / F.sum("touches").over(Window.partitionBy("match_id"))
    return g.select("match_id", "team", r6(share, "share"), r6(eo.opponent_sum(c("passes"), "match_id") / F.nullif(c("acts"), F.lit(0)), "ppda"))


@query(f"""with {EV}, g as (select player_id, type, count(*) w from e group by all), k as (select *, row_number() over (partition by player_id order by w desc, type) n from g) select player_id, type, w from k where n = 1""")
def role_argmax(spark: SparkSession, folder: str) -> DataFrame:
    return tb.argmax_label(event_log(spark, folder).withColumn("one", F.lit(1)), ["player_id"], "type", "one")


@query(f"with {EV} select player_id, {', '.join(f"round(count(*) filter (type = '{t}') / count(*), 6) {t}" for t in TYPES)} from e group by player_id")
def usage_fraction_pivot(spark: SparkSession, folder: str) -> DataFrame:
    got = tb.usage_fractions(event_log(spark, folder).withColumn("one", F.lit(1)), ["player_id"], "type", "one", TYPES)
    return got.select("player_id", *[r6(c(t), t) for t in TYPES])


@query(f"""with {EV}, g as (select player_id, type, count(*)::double w from e group by all), x as (select *, round(w / sum(w) over (partition by player_id) * 100, 9) x from g), fl as (select *, floor(x) f from x),
  k as (select *, row_number() over (partition by player_id order by x - f desc, type) k, 100 - sum(f) over (partition by player_id) spare from fl) select player_id, type, (f + case when k <= spare then 1 else 0 end)::bigint share from k""")
def apportion_percent(spark: SparkSession, folder: str) -> DataFrame:
    g = event_log(spark, folder).groupBy("player_id", "type").agg(F.count("*").cast("double").alias("w"))
    return tb.apportion(g, ["player_id"], "w", "type").select("player_id", "type", "share")


@query(f"""with {EV} select match_id, count(*) events, count(*) - count(distinct event_id) duplicate_ids, count(distinct team) teams, count(*) filter (x > 120 or y > 80) outside, max(sec) - min(sec) clock_span,
  case when count(*) > count(distinct event_id) or count(distinct team) <> 2 then 'error' when count(*) filter (x > 120 or y > 80) > 0 then 'warning' else 'ok' end verdict from e group by match_id""")
def dq_event_checks(spark: SparkSession, folder: str) -> DataFrame:
    g = event_log(spark, folder).groupBy("match_id").agg(F.count("*").alias("events"), (F.count("*") - F.count_distinct("event_id")).alias("duplicate_ids"), F.count_distinct("team").alias("teams"), n((c("x") > 120) | (c("y") > 80)).alias("outside"), (F.max("sec") - F.min("sec")).alias("clock_span"))
    return g.withColumn("verdict", F.when((c("duplicate_ids") > 0) | (c("teams") != 2), "error").when(c("outside") > 0, "warning").otherwise("ok"))


# --- tables -----------------------------------------------------------------------------------------------------------


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then 'U' else o_orderstatus end o_orderstatus, round(case when o_orderkey % 5 = 0 then o_totalprice * 2 else o_totalprice end, 2) o_totalprice
  from orders where o_orderkey % 3 <> 0 or o_orderkey % 5 = 0""")
def upsert_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    news = o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("U").alias("o_orderstatus"), (c("o_totalprice") * 2).alias("o_totalprice"))
    got = tb.upsert(o.filter("o_orderkey % 3 != 0"), news.unionByName(news.withColumn("o_totalprice", c("o_totalprice") / 2)), ["o_orderkey"], F.desc("o_totalprice"))
    return got.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("""select l_orderkey, l_linenumber, case when l_orderkey % 10 = 0 then -1 else l_quantity end l_quantity from lineitem where l_orderkey % 10 <> 0 or l_linenumber = 1""")
def replace_children(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    parents = li.filter("l_orderkey % 10 = 0")
    news = parents.filter("l_linenumber = 1").withColumn("l_quantity", F.lit(-1.0))
    gone = tb.replace_children(li, parents.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"]).filter("l_orderkey % 10 != 0")
    return gone.unionByName(news)


@query("""with m as (select distinct o_custkey k from orders where o_orderkey % 4 = 0), d as (select c_custkey k from customer where c_custkey % 3 <> 0),
  b as (select m.k a, d.k b from m full join d on m.k = d.k) select count(a) in_model, count(b) in_data, count(*) filter (a is not null and b is not null) covered, count(*) filter (b is null) "foreign", count(*) filter (a is null) missing from b""")
def coverage_sets(spark: SparkSession, folder: str) -> DataFrame:
    model = table(spark, folder, "orders").filter("o_orderkey % 4 = 0").select(c("o_custkey").alias("k"))
    return tb.coverage(model, table(spark, folder, "customer").filter("c_custkey % 3 != 0").select(c("c_custkey").alias("k")), "k")


@query("""select c_custkey, c_name || ' II' new_name, c_name old_name from customer where c_custkey % 7 = 0""")
def name_clashes(spark: SparkSession, folder: str) -> DataFrame:
    cu = table(spark, folder, "customer").select("c_custkey", "c_name")
    return tb.name_clashes(cu, cu.withColumn("c_name", F.when(c("c_custkey") % 7 == 0, F.concat("c_name", F.lit(" II"))).otherwise(c("c_name"))), "c_custkey", "c_name")


@query("""select o_orderkey, case when o_orderkey % 11 = 0 then 'lost' when o_orderkey % 13 = 0 then 'added' when o_orderkey % 6 = 0 and o_totalprice <> 0 then 'changed' else 'kept' end state from orders
  where not (o_orderkey % 11 = 0 and o_orderkey % 13 = 0)""")
def changed_rows(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select("o_orderkey", F.array("o_totalprice", F.lit(0.0)).alias("x"))
    prev = o.filter("o_orderkey % 13 != 0").withColumn("h", fn.row_hash(c("x")))
    cur = o.filter("o_orderkey % 11 != 0").withColumn("h", fn.row_hash(F.when(c("o_orderkey") % 6 == 0, F.transform("x", lambda v: v * 2)).otherwise(F.transform("x", lambda v: v * 1.0))))
    return tb.changed(prev, cur, ["o_orderkey"], "h")


@query("""with p as (select o_orderkey, row_number() over (order by o_orderkey) - 1 order_index from orders) select * from p""")
def index_orders(spark: SparkSession, folder: str) -> DataFrame:
    got = tb.index_entities(table(spark, folder, "orders"), "o_orderkey")
    return got.select("o_orderkey", c("entity_index").cast("bigint").alias("order_index"))


@query("""with x as (select o_orderkey k, nullif(month(o_orderdate) % 4, 0) v from orders), r as (select *, dense_rank() over (order by v nulls last) g from x), t as (select count(distinct v) n from x)
  select k, v::bigint w from r, t where v is not null and g <= greatest(1, ceil(0.5 * n))""")
def matchday_half(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "orders").select(c("o_orderkey").alias("match_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("match_date"), (F.month("o_orderdate") % 4).alias("match_week"))
    return tb.matchday_subset(m, 50).select(c("match_id").alias("k"), c("match_week").cast("bigint").alias("w"))


@query("""with r as (select o_orderkey k, row_number() over (order by cast(o_orderdate as date), o_orderkey) n, count(*) over () total from orders) select k from r where n <= ceil(0.3 * total)""")
def first_matches(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "orders").select(c("o_orderkey").alias("match_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("match_date"), F.lit(None).cast("int").alias("match_week"))
    return tb.matchday_subset(m, 30).select(c("match_id").alias("k"))


# --- features ---------------------------------------------------------------------------------------------------------


@query(f"""with {OBS}, h as (select *, case when (row_number() over (partition by entity order by "match") - 1) % 2 = 0 then 'A' else 'B' end half from o) select entity, half, count(*) n, round(avg(qty), 6) qty from h group by entity, half""")
def odd_even_halves(spark: SparkSession, folder: str) -> DataFrame:
    return tb.split_halves(observations(spark, folder), "entity", "match").groupBy("entity", "half").agg(F.count("*").alias("n"), r6(F.avg("qty"), "qty"))


@query(f"""with {OBS} select entity, "match", round(qty * 90 / mass, 6) qty_per90, round(returned / nullif(qty, 0), 6) return_ratio, round(qty * 90 / mass - price * 90 / mass, 6) diff from o""")
def per90_ratio_diff(spark: SparkSession, folder: str) -> DataFrame:
    q, p = fn.per90(c("qty"), c("mass")), fn.per90(c("price"), c("mass"))
    return observations(spark, folder).select("entity", "match", r6(q, "qty_per90"), r6(fn.safe_ratio(c("returned"), c("qty")), "return_ratio"), r6(q - p, "diff"))


def _zsql(over: str) -> str:
    z = ", ".join(f"least(greatest(({f} - avg({f}) over ({over})) / case when stddev_pop({f}) over ({over}) = 0 then 1 else stddev_pop({f}) over ({over}) end, -6), 6) {f}" for f in FEATURES)
    return f'z as (select entity, "match", league, mass, {z} from o)'


ROUNDED = ", ".join(f"round({f}, 6) {f}" for f in FEATURES)


def _z(spark: SparkSession, folder: str, group: str | None) -> DataFrame:
    obs = observations(spark, folder)
    return fe.zscore(obs, fe.norm_stats(obs, group, FEATURES), group, FEATURES)


@query(f'with {OBS}, {_zsql("partition by league")} select entity, "match", {ROUNDED} from z')
def zscore_league(spark: SparkSession, folder: str) -> DataFrame:
    return _z(spark, folder, "league").select("entity", "match", *[r6(c(f), f) for f in FEATURES])


@query(f'with {OBS}, {_zsql("")} select entity, "match", {ROUNDED} from z')
def zscore_global(spark: SparkSession, folder: str) -> DataFrame:
    return _z(spark, folder, None).select("entity", "match", *[r6(c(f), f) for f in FEATURES])


@query(f"""with {OBS}, a as (select league, avg(qty) mu, stddev_pop(qty) sd from o group by league), b as (select league, avg(qty) mu, stddev_pop(qty) sd from o where "match" < 199600 group by league)
  select entity, "match", round(least(greatest((qty - coalesce(b.mu, a.mu)) / coalesce(nullif(coalesce(b.sd, a.sd), 0), 1), -6), 6), 6) qty from o join a using (league) left join b using (league)""")
def zscore_frozen(spark: SparkSession, folder: str) -> DataFrame:
    obs = observations(spark, folder)
    stats = fe.merge_stats(fe.norm_stats(obs, "league", ["qty"]), fe.norm_stats(obs.filter("match < 199600"), "league", ["qty"]))
    return fe.zscore(obs, stats, "league", ["qty"]).select("entity", "match", r6(c("qty"), "qty"))


#: Means of whole numbers and hundredths by tenths are short decimals, which six digits would cut in the middle of a tie.
DIGITS = {"qty": 9, "disc": 9, "tax": 9, "returned": 9}


@query(f"with {OBS} select entity, {', '.join(f'round(sum(mass * {f}) / sum(mass), {DIGITS.get(f, 6)}) {f}' for f in FEATURES)} from o group by entity")
def weighted_display(spark: SparkSession, folder: str) -> DataFrame:
    return fe.weighted_mean(observations(spark, folder), "entity", "mass", FEATURES).select("entity", *[F.round(f, DIGITS.get(f, 6)).alias(f) for f in FEATURES])


@query(f"with {OBS} select entity, round(sum(mass * nullif(returned, 0)) / nullif(sum(case when returned <> 0 then mass end), 0), 6) returned from o group by entity")
def raw_weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    obs = observations(spark, folder).withColumn("returned", F.nullif(c("returned"), F.lit(0.0)))
    return fe.weighted_mean(obs, "entity", "mass", ["returned"], skip_null=True).select("entity", r6(c("returned"), "returned"))


@query("""with s as (select s_suppkey, s_nationkey, floor(s_acctbal / 500) v from supplier), r as (select *, rank() over (partition by s_nationkey order by v) k, count(*) over (partition by s_nationkey, v) t, count(*) over (partition by s_nationkey) n from s)
  select s_suppkey, case when n = 1 then 0.5 else round((k - 1 + (t - 1) / 2) / (n - 1), 6) end pct from r""")
def midrank_percentile(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", F.floor(c("s_acctbal") / 500).alias("v"))
    return s.select("s_suppkey", r6(tb.midrank_pct(["s_nationkey"], "v"), "pct"))


@query("""with q as (select quantile_cont(s_acctbal, 1/3) a, quantile_cont(s_acctbal, 2/3) b from supplier) select s_suppkey, case when s_acctbal > b then 'high' when s_acctbal > a then 'mid' else 'low' end tercile from supplier, q""")
def terciles(spark: SparkSession, folder: str) -> DataFrame:
    return tb.terciles(table(spark, folder, "supplier"), "s_acctbal").select("s_suppkey", "tercile")


def _display(spark: SparkSession, folder: str) -> DataFrame:
    return fe.melt(fe.weighted_mean(_z(spark, folder, "league"), "entity", "mass", FEATURES), ["entity"], FEATURES).withColumn("z", F.round("z", 9))


LONG = f"""w as (select entity, {', '.join(f'sum(mass * {f}) / sum(mass) {f}' for f in FEATURES)} from z group by entity), l as (select entity, feature, round(z, 9) z from (unpivot w on {', '.join(FEATURES)} into name feature value z))"""


@query(f"""with {OBS}, {_zsql("partition by league")}, {LONG}, p as (select entity, case when feature in ('qty', 'price') then 'volume' else 'terms' end phase, avg(case when feature = 'returned' then -z else z end) score from l group by all)
  select entity, phase, round(score, 6) score from p""")
def phase_profile(spark: SparkSession, folder: str) -> DataFrame:
    phases = spark.createDataFrame([("volume", "qty"), ("volume", "price"), ("terms", "disc"), ("terms", "tax"), ("terms", "returned")], "phase string, feature string")
    return fe.phase_profile(_display(spark, folder), phases, "entity", ["returned"]).select("entity", "phase", r6(c("score"), "score"))


@query(f"""with {OBS}, {_zsql("partition by league")}, {LONG}, p as (select a.entity a, b.entity b, a.feature, round(abs(a.z) - abs(a.z - b.z), 9) shared from l a join l b on a.feature = b.feature and b.entity = a.entity + 1),
  k as (select *, row_number() over (partition by a, b order by shared desc, feature) n from p) select a, b, feature, round(shared, 5) shared, n::bigint "rank" from k where n <= 2""")
def shared_traits(spark: SparkSession, folder: str) -> DataFrame:
    long = _display(spark, folder)
    ids = long.select(c("entity").alias("a")).distinct()
    pairs = ids.withColumn("b", c("a") + 1).join(ids.select(c("a").alias("b")), "b")
    return rk.shared_traits(pairs, long, "entity", 2).withColumn("shared", F.round("shared", 5))


@query(f"""with {OBS}, {_zsql("partition by league")}, {LONG}, v as (select entity, feature, case when feature = 'returned' then -z else z end v from l),
  k as (select *, row_number() over (partition by entity order by v desc, feature) b, row_number() over (partition by entity order by v, feature desc) w from v)
  select entity, case when b <= 2 then 'strength' else 'weakness' end side, (case when b <= 2 then b else w end)::bigint "rank", feature, round(v, 5) v from k where b <= 2 or w <= 2""")
def strengths(spark: SparkSession, folder: str) -> DataFrame:
    got = rk.strengths(_display(spark, folder), "entity", 2, fn.oriented(c("feature"), c("z"), ["returned"]))
    return got.withColumn("v", F.round("v", 5))


# --- geometry and ranking -----------------------------------------------------------------------------------------------

VEC = "v as (select vec_id id, label::bigint label, embedding::double[] x from embeddings)"


def _neighbour_distance(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    v = clouds(spark, folder)
    nxt = v.select((c("id") - 1).alias("id"), c("x").alias("b"))
    return v.join(nxt, "id").select("id", r6(geo.dist(c("x"), c("b"), kind), "d"))


@query(f"with {VEC} select a.id, round(list_distance(a.x, b.x), 6) d from v a join v b on b.id = a.id + 1")
def dist_l2(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbour_distance(spark, folder, "euclidean")


@query(f"with {VEC} select a.id, round(list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2]))), 6) d from v a join v b on b.id = a.id + 1")
def dist_l1(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbour_distance(spark, folder, "manhattan")


@query(f"with {VEC} select a.id, round(1 - list_cosine_similarity(a.x, b.x), 6) d from v a join v b on b.id = a.id + 1")
def dist_cos(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbour_distance(spark, folder, "cosine")


def _knn_sql(d: str) -> str:
    return f'with {VEC}, p as (select a.id, b.id neighbour, round({d}, 9) d from v a join v b on a.id <> b.id where a.id % 20 = 0), k as (select *, row_number() over (partition by id order by d, neighbour) r from p) select id, neighbour, r::bigint "rank", round(d, 6) distance from k where r <= 5'


def _knn(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    v = clouds(spark, folder)
    return geo.knn(v, v.filter("id % 20 = 0"), 5, kind).select("id", "neighbour", "rank", r6(c("distance"), "distance"))


@query(_knn_sql("list_distance(a.x, b.x)"))
def knn_l2(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, "euclidean")


@query(_knn_sql("list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2])))"))
def knn_l1(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, "manhattan")


@query(_knn_sql("1 - list_cosine_similarity(a.x, b.x)"))
def knn_cos(spark: SparkSession, folder: str) -> DataFrame:
    return _knn(spark, folder, "cosine")


def _supplier_vectors(spark: SparkSession, folder: str, group: str | None) -> DataFrame:
    w = fe.weighted_mean(_z(spark, folder, group), "entity", "mass", FEATURES)
    return w.select("entity", F.array(*FEATURES).alias("x"))


def _supplier_top(spark: SparkSession, folder: str, group: str | None, k: int, asked: bool = False) -> DataFrame:
    """The k best others of every supplier, or of the asked ones: those whose id is divisible by 20."""
    unit = geo.normalized(_supplier_vectors(spark, folder, group))
    return geo.pair_scores(unit.filter("entity % 20 = 0") if asked else unit, unit, "entity", lambda a, b: (a @ b.T).round(9), k)


def _top_sql(over: str, name: str) -> str:
    y = f"(select entity, [{', '.join(f'sum(mass * {f}) / sum(mass)' for f in FEATURES)}] x from z{name} group by entity)"
    return f"""z{name} as ({_zsql(over).split('as (', 1)[1]}, y{name} as {y}, s{name} as (select a.entity a, b.entity b, round(list_cosine_similarity(a.x, b.x), 9) score from y{name} a join y{name} b on a.entity <> b.entity),
  t{name} as (select *, row_number() over (partition by a order by score desc, b desc) r from s{name} where score <> 0)"""


@query(f'with {OBS}, {_top_sql("partition by league", "1")} select a, b, round(score, 6) score, r::bigint "rank" from t1 where r <= 10 and a % 20 = 0')
def topk_entities(spark: SparkSession, folder: str) -> DataFrame:
    return rk.top_k(_supplier_top(spark, folder, "league", 10, asked=True), 10).withColumn("score", F.round("score", 6))


@query(f"""with {OBS}, {_top_sql("partition by league", "1")}, {_top_sql("", "2")}, j as (select coalesce(p.a, q.a) a, p.b x, q.b y from (select * from t1 where r <= 10 and a % 20 = 0) p full join (select * from t2 where r <= 10 and a % 20 = 0) q on p.a = q.a and p.b = q.b)
  select a, round(count(*) filter (x is not null and y is not null) / count(*), 6) jaccard, count(*) filter (x is not null and y is not null) common from j group by a""")
def compare_rankings(spark: SparkSession, folder: str) -> DataFrame:
    got = rk.compare_rankings(_supplier_top(spark, folder, "league", 10, asked=True), _supplier_top(spark, folder, None, 10, asked=True))
    return got.withColumn("jaccard", F.round("jaccard", 6))


@query(f"""with {OBS}, {_top_sql("partition by league", "1")}, {_top_sql("", "2")} select p.a, p.b, p.r::bigint "rank", q.r::bigint other_rank
  from (select * from t1 where r <= 10 and a % 20 = 0) p left join (select * from t2 where r <= 10 and a % 20 = 0) q on p.a = q.a and p.b = q.b""")
def ranks_in_both(spark: SparkSession, folder: str) -> DataFrame:
    """Each supplier's ten nearest by league with their ranks in the model over all leagues."""
    return rk.ranks_in_both(*(_supplier_top(spark, folder, g, 10, asked=True) for g in ("league", None)))


WORDS = [("red",), ("small",), ("ring",), ("Large Bolt",), ("steel",), ("xyzzy",), ("small ring",)]
NAMES = "q as (select unnest(['red', 'small', 'ring', 'Large Bolt', 'steel', 'xyzzy', 'small ring']) text)"


def _words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WORDS, "text string")


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(c("p_partkey").alias("id"), c("p_name").alias("name"))


def _search_sql(where: str = "true") -> str:
    return f"""with {NAMES}, m as (select text, p_partkey id, p_name "name", lower(trim(p_name)) nn, case when lower(trim(p_name)) = lower(text) then 0 when starts_with(lower(trim(p_name)), lower(text)) then 1 else 2 end quality from part join q on contains(lower(p_name), lower(text)) where {where}),
  k as (select *, row_number() over (partition by text order by quality, nn, id) r from m) select id, "name", text, quality::int quality, r::bigint "rank" from k where r <= 10"""


@query(_search_sql())
def name_search(spark: SparkSession, folder: str) -> DataFrame:
    return rk.search(_parts(spark, folder), _words(spark), 10)


@query(_search_sql("p_partkey % 2 = 1"))
def search_absent(spark: SparkSession, folder: str) -> DataFrame:
    p = _parts(spark, folder)
    return rk.search_absent(p, p.filter("id % 2 = 0"), _words(spark), 10)


@query(f"""with {NAMES}, n as (select p_partkey id, translate(p_name, 'aeilrst', 'āĕĩłŕşţ') "name" from part), m as (select text, id, "name", replace(strip_accents("name"), 'ł', '') nn from n join q on contains(replace(strip_accents(lower("name")), 'ł', ''), lower(text))),
  k as (select *, case when lower(nn) = lower(text) then 0 when starts_with(lower(nn), lower(text)) then 1 else 2 end quality from m), o as (select *, row_number() over (partition by text order by quality, lower(nn), id) r from k) select id, "name", text, quality::int quality, r::bigint "rank" from o where r <= 10""")
def name_search_marked(spark: SparkSession, folder: str) -> DataFrame:
    """Names with letters beyond Latin-1; one of them does not come apart and is dropped."""
    return rk.search(_parts(spark, folder).withColumn("name", F.translate("name", "aeilrst", "āĕĩłŕşţ")), _words(spark), 10)


@query("""with q as (select distinct c_name text from customer where c_custkey % 10 = 0 union all select 'Customer#00000000' union all select 'nobody'), m as (select text, min(case when lower(c_name) = lower(text) then c_custkey end) e, count(c_custkey) n, min(c_custkey) a
  , list(c_name order by c_custkey)[1:10] told from q left join customer on contains(lower(c_name), lower(text)) group by text) select text, case when e is null and n > 1 then array_to_string(told, ',') end candidates, case when n = 0 then 'absent' when e is not null then 'exact' when n = 1 then 'unique' else 'ambiguous' end status, case when e is not null or n = 1 then coalesce(e, a) end id from m""")
def resolve_names(spark: SparkSession, folder: str) -> DataFrame:
    cu = table(spark, folder, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"))
    asked = cu.filter("id % 10 = 0").select(c("name").alias("text")).unionByName(spark.createDataFrame([("Customer#00000000",), ("nobody",)], "text string"))
    return rk.resolve(cu, asked).withColumn("candidates", F.array_join("candidates", ","))


# --- evaluation -------------------------------------------------------------------------------------------------------


def _label_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of the halves of each label: rows (a, b, score), target b = a."""
    v = tb.split_halves(clouds(spark, folder), "label", "id")
    e = geo.embed_entities(v.withColumn("key", F.concat_ws("/", "half", "label")), "key", "mass")
    e = geo.normalized(e).withColumn("half", F.substring("key", 1, 1)).withColumn("label", F.substring("key", 3, 9).cast("bigint"))
    a, b = e.filter("half = 'A'").select(c("label").alias("a"), c("x").alias("xa")), e.filter("half = 'B'").select(c("label").alias("b"), c("x").alias("xb"))
    return a.crossJoin(F.broadcast(b)).select("a", "b", F.round(1 - geo.dist(c("xa"), c("xb"), "cosine"), 9).alias("score"))  # one row per pair of labels


LABELS = f"""{VEC}, h as (select *, case when (row_number() over (partition by label order by id) - 1) % 2 = 0 then 'A' else 'B' end half from v),
g as (select half, label, list(x) xs from h group by all), u as (select half, label, list_transform(range(1, 65), lambda i: list_avg(list_transform(xs, lambda y: y[i]))) x from g),
s as (select a.label a, b.label b, round(list_cosine_similarity(a.x, b.x), 9) score from u a, u b where a.half = 'A' and b.half = 'B')"""


@query(f"""with {LABELS}, k as (select s.a, count(*) filter (s.score > t.score) + (count(*) filter (s.score = t.score) + 1) / 2 r from s join s t on t.a = s.a and t.b = t.a group by s.a)
  select round(avg((r <= 1)::int), 6) recall_1, round(avg((r <= 5)::int), 6) recall_5, round(avg((r <= 10)::int), 6) recall_10, round(avg(1 / r), 6) mrr from k""")
def target_rank_mrr(spark: SparkSession, folder: str) -> DataFrame:
    ranks = ev.target_rank(_label_scores(spark, folder).withColumn("target", c("a")))
    return ev.recall_mrr(ranks).select(*[r6(c(k), k) for k in ("recall_1", "recall_5", "recall_10", "mrr")])


@query(f"with {LABELS} select round(sqrt(sum((p.score - q.score) ** 2)) / sqrt(sum(p.score ** 2)), 6) asymmetry from s p join s q on p.a = q.b and p.b = q.a")
def asymmetry(spark: SparkSession, folder: str) -> DataFrame:
    return ev.asymmetry(_label_scores(spark, folder)).withColumn("asymmetry", F.round("asymmetry", 6))


@query(f"""with {LABELS}, k as (select a, b, rank() over (partition by a order by score) + (count(*) over (partition by a, score) - 1) / 2 x, rank() over (partition by a order by b % 4) + (count(*) over (partition by a, b % 4) - 1) / 2 y from s) select a, round(corr(x, y), 6) rho from k group by a""")
def spearman(spark: SparkSession, folder: str) -> DataFrame:
    s = _label_scores(spark, folder).withColumn("m", c("b") % 4)
    return ev.spearman(s, ["a"], "score", "m").withColumn("rho", F.round("rho", 6))


@query(f"""with {LABELS}, p as (select x.a, sign(x.score - y.score) s, sign(x.b % 4 - y.b % 4) t from s x join s y on x.a = y.a and x.b < y.b) select a, round(sum(s * t) / sqrt(sum(s * s) * sum(t * t)), 6) tau from p group by a""")
def kendall(spark: SparkSession, folder: str) -> DataFrame:
    s = _label_scores(spark, folder).withColumn("m", c("b") % 4)
    return ev.kendall_tau(s, "a", "b", "score", "m").withColumn("tau", F.round("tau", 6))


@query(f"""with {OBS}, {_top_sql("partition by league", "1")}, {_top_sql("", "2")}, p as (select a, list(b order by r) x from t1 where r <= 10 group by a), q as (select a, list(b order by r) y from t2 where r <= 1 + a // 20 % 12 group by a),
  k as (select a, x, y, greatest(len(x), len(y)) k from p join q using (a) where a % 20 = 0), d as (select a, k, d, len(list_intersect(x[1:d], y[1:d])) / d agreed from (select *, unnest(range(1, k + 1)) d from k))
  select a, round(sum(0.1 * agreed * 0.9 ** (d - 1)) + max(case when d = k then agreed * 0.9 ** k end), 6) rbo from d group by a""")
def rbo_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Ten of the one ranking against 1 to 12 of the other."""
    lists = lambda t, name: t.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]).alias(name))
    other = _supplier_top(spark, folder, None, 12, asked=True).filter("rank <= 1 + a div 20 % 12")
    both = lists(_supplier_top(spark, folder, "league", 10, asked=True), "x").join(lists(other, "y"), "a")
    return both.select("a", r6(ev.rbo(c("x"), c("y")), "rbo"))


@query(f"""with {VEC}, p as (select a.id, a.label, b.label guess, b.id nb, round(list_distance(a.x, b.x), 9) d from v a join v b on a.id <> b.id where a.id % 20 = 0), k as (select *, row_number() over (partition by id order by d, nb) r from p),
  g as (select id, label, guess, count(*) w from k where r <= 5 group by all), t as (select id, label, guess from (select *, row_number() over (partition by id order by w desc, guess) n from g) where n = 1),
  f as (select label x, count(*) n, count(*) filter (guess = label) hit from t group by label), s as (select guess x, count(*) said from t group by guess) select round(avg(2.0::double * hit / (n + coalesce(said, 0))), 6) f1 from f left join s using (x)""")
def macro_f1(spark: SparkSession, folder: str) -> DataFrame:
    v = clouds(spark, folder)
    near = geo.knn(v, v.filter("id % 20 = 0"), 5).join(v.select(c("id").alias("neighbour"), c("label").alias("guess")), "neighbour")
    vote = tb.majority_vote(near, ["id"], "guess").join(v.select("id", "label"), "id")
    return ev.macro_f1(vote, "label", "guess").withColumn("f1", F.round("f1", 6))


# --- sweeps -------------------------------------------------------------------------------------------------------------

METRICS = """m as (select year(o_orderdate)::varchar yr, o_orderpriority pr, o_orderstatus entity, year(o_orderdate)::varchar || '/' || o_orderpriority combination, avg(o_totalprice) mrr, count(*)::double coverage, stddev_pop(o_totalprice) asymmetry from orders group by all),
l as (select * from (unpivot m on mrr, coverage, asymmetry into name metric value "value"))"""


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").withColumn("yr", F.year("o_orderdate").cast("string"))
    g = o.groupBy("yr", c("o_orderpriority").alias("pr"), c("o_orderstatus").alias("entity")).agg(F.avg("o_totalprice").alias("mrr"), F.count("*").cast("double").alias("coverage"), F.stddev_pop("o_totalprice").alias("asymmetry"))
    return fe.melt(g.withColumn("combination", F.concat_ws("/", "yr", "pr")), ["yr", "pr", "entity", "combination"], ["mrr", "coverage", "asymmetry"], "metric", "value")


@query(f"""with {METRICS}, w as (select *, case metric when 'mrr' then 1 else 0.25 end wt, case when stddev_pop("value") over g = 0 then 0 else ("value" - avg("value") over g) / stddev_pop("value") over g end * case when metric = 'asymmetry' then -1 else 1 end z from l window g as (partition by entity, metric)),
  s as (select entity, combination, sum(wt::double * z) / sum(wt::double) score from w group by all) select entity, combination, round(score, 6) score, row_number() over (partition by entity order by round(score, 9) desc, combination)::bigint "rank" from s""")
def composite_score(spark: SparkSession, folder: str) -> DataFrame:
    weights = spark.createDataFrame([(k, v) for k, v in cat.SCORE_WEIGHTS.items()], "metric string, weight double")
    got = sw.composite(_metrics(spark, folder), weights, ["asymmetry"])
    return got.withColumn("score", F.round("score", 6))


CELLS = f"{METRICS}, x as (select yr, pr, max(\"value\") z from l where metric = 'mrr' group by all)"


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return sw.response_grid(_metrics(spark, folder).filter("metric = 'mrr'"), "yr", "pr")


@query(f"with {CELLS} select a.yr, b.pr, round(z, 4) z from (select distinct yr from x) a cross join (select distinct pr from x) b left join x on a.yr = x.yr and b.pr = x.pr")
def response_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _cells(spark, folder).withColumn("z", F.round("z", 4))


@query(f"with {CELLS} select yr, pr, round(z, 4) z, (yr = (select min(yr) from x) or yr = (select max(yr) from x) or pr = (select min(pr) from x) or pr = (select max(pr) from x)) on_edge from x order by z desc, yr, pr limit 1")
def edge_optimum(spark: SparkSession, folder: str) -> DataFrame:
    return sw.optimum(_cells(spark, folder), "yr", "pr").withColumn("z", F.round("z", 4))


@query(f"""with {METRICS}, p as (select combination, max("value") filter (entity = 'F') f, max("value") filter (entity = 'O') o, max("value") filter (entity = 'P') p from l where metric = 'mrr' group by combination)
  select combination, round(f, 4) "F", round(o, 4) "O", round(p, 4) "P", case when greatest(f, o, p) <> least(f, o, p) then case greatest(f, o, p) when f then 'F' when o then 'O' else 'P' end end best from p""")
def comparison_pivot(spark: SparkSession, folder: str) -> DataFrame:
    m = _metrics(spark, folder).filter("metric = 'mrr'")
    return sw.comparison(m, "combination", "entity", ["F", "O", "P"]).select("combination", *[F.round(k, 4).alias(k) for k in "FOP"], "best")


LOWER_CELLS = f"{METRICS}, x as (select yr, pr, min(\"value\") z from l where metric = 'asymmetry' group by all)"


def _lower(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder).filter("metric = 'asymmetry'")


@query(f"with {LOWER_CELLS} select yr, pr, round(z, 4) z, (yr = (select min(yr) from x) or yr = (select max(yr) from x) or pr = (select min(pr) from x) or pr = (select max(pr) from x)) on_edge from x order by z, yr, pr limit 1")
def lower_optimum(spark: SparkSession, folder: str) -> DataFrame:
    """The best cell of a metric of which less is better."""
    return sw.optimum(sw.response_grid(_lower(spark, folder), "yr", "pr", lower=True), "yr", "pr", lower=True).withColumn("z", F.round("z", 4))


@query(f"""with {METRICS}, p as (select combination, max("value") filter (entity = 'F') f, max("value") filter (entity = 'O') o, max("value") filter (entity = 'P') p from l where metric = 'asymmetry' group by combination)
  select combination, round(f, 4) "F", round(o, 4) "O", round(p, 4) "P", case when greatest(f, o, p) <> least(f, o, p) then case least(f, o, p) when f then 'F' when o then 'O' else 'P' end end best from p""")
def lower_comparison(spark: SparkSession, folder: str) -> DataFrame:
    wide = sw.comparison(_lower(spark, folder), "combination", "entity", ["F", "O", "P"], lower=True)
    return wide.select("combination", *[F.round(k, 4).alias(k) for k in "FOP"], "best")


@query(f"""with {METRICS}, n as (select count(distinct combination) n from l where metric = 'asymmetry'), mm as (select entity combination, avg("value") mean, count(*) = any_value(n) complete from l, n where metric = 'asymmetry' group by entity)
  select combination, round(mean, 6) mean, complete, complete and mean = (select min(mean) from mm where complete) best from mm""")
def best_on_average(spark: SparkSession, folder: str) -> DataFrame:
    wide = sw.comparison(_lower(spark, folder), "combination", "entity", ["F", "O", "P"], lower=True)
    return sw.best_on_average(wide, ["F", "O", "P"], lower=True).withColumn("mean", F.round("mean", 6))


@query()
def filled_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Mean prices by year and priority with a third of the cells taken out, filled along years and then along priorities."""
    cells = sw.response_grid(_metrics(spark, folder).filter("metric = 'mrr'").withColumn("yr", c("yr").cast("int")).withColumn("pr", F.ascii("pr").cast("int")), "yr", "pr", "mean")
    return sw.fill_grid(cells.withColumn("z", F.when((c("yr") + c("pr")) % 3 != 0, c("z"))), "yr", "pr")


@query("""with v as (select o_orderkey id, sum(l_quantity)::double q, 10.0::double * count(*) n, round(any_value(o_totalprice)) / 1000 p from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey),
  d as (select a.id, b.id neighbour, sqrt((a.q - b.q) ** 2 + (a.n - b.n) ** 2 + (a.p - b.p) ** 2) far from v a join v b on a.id <> b.id where a.id % 20 = 0)
  select id, neighbour, round(far, 4) distance, row_number() over (partition by id order by round(far, 9), neighbour) "rank" from d qualify row_number() over (partition by id order by round(far, 9), neighbour) <= 5""")
def knn_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest orders by quantity, lines and price, of orders whose key is divisible by 20 against all; pivot cells leave most distances out."""
    lines = table(spark, folder, "lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.sum("l_quantity").cast("double").alias("q"), (F.lit(10.0) * F.count("*")).alias("n"))
    price = table(spark, folder, "orders").select(c("o_orderkey").alias("id"), (F.round("o_totalprice") / 1000).cast("double").alias("p"))
    v = lines.join(price, "id").select("id", F.array("q", "n", "p").alias("x"))
    return geo.knn(v, v.filter("id % 20 = 0"), 5).withColumn("distance", F.round("distance", 4))


# --- operators without SQL: held against numpy in the tests --------------------------------------------------------------


@query()
def pchip_monthly(spark: SparkSession, folder: str) -> DataFrame:
    obs = observations(spark, folder).groupBy("league", "match").agg(F.sum("qty").alias("y"))
    pts = obs.select("league", (F.floor(c("match") / 100) * 12 + c("match") % 100).cast("double").alias("x"), "y")
    return sw.pchip(pts, "league", "x", "y", pts.select("league", (c("x") + 0.5).alias("x")))


@query()
def whitening(spark: SparkSession, folder: str) -> DataFrame:
    v = clouds(spark, folder)
    return geo.whiten(v, "x", geo.fit_whitening(v, "x", 64), "id")


@query()
def rff_embedding(spark: SparkSession, folder: str) -> DataFrame:
    v = clouds(spark, folder)
    return geo.embed_entities(geo.rff(v, "x", 64, 128, geo.kernel_width(v, "id", "x"), "label", "mass"), "label", "mass")


@query()
def mmd_topk(spark: SparkSession, folder: str) -> DataFrame:
    return geo.mmd_similarity(rff_embedding(spark, folder), "label", 5)


@query()
def ease_topk(spark: SparkSession, folder: str) -> DataFrame:
    e = geo.embed_entities(observations(spark, folder).select("entity", "mass", F.array(*FEATURES).alias("x")), "entity", "mass")
    return geo.ease_rerank(e, "entity", len(FEATURES), 0.03, 10)


def _nation_clouds(spark: SparkSession, folder: str) -> DataFrame:
    """(nation, match, mass, x): a nation's cloud has one observation per month, made from all its suppliers."""
    nation = table(spark, folder, "supplier").select(c("s_suppkey").alias("entity"), c("s_nationkey").alias("nation"))
    w = c("mass")
    months = observations(spark, folder).join(nation, "entity").groupBy("nation", "match").agg(*[(F.sum(w * c(f)) / F.sum(w)).alias(f) for f in FEATURES], F.sum(w).alias("mass"))
    z = fe.zscore(months, fe.norm_stats(months, None, FEATURES), None, FEATURES)
    return z.select("nation", "match", "mass", F.array(*FEATURES).alias("x"))


@query()
def sinkhorn_nations(spark: SparkSession, folder: str) -> DataFrame:
    """Transport kernel between nations."""
    return tr.kernel_from_costs(tr.sinkhorn_pairs(_nation_clouds(spark, folder), "nation"))


@query()
def ease_transport(spark: SparkSession, folder: str) -> DataFrame:
    """The nations' transport kernel re-ranked by the inverse of its block Gram matrix, blocks of seven nations."""
    return mx.ease_kernel(sinkhorn_nations(spark, folder), 0.03, 10, size=7)


@query()
def phase_stability_transport(spark: SparkSession, folder: str) -> DataFrame:
    """Top lists of the nations' transport kernel against those of twenty bootstrap draws of their months."""
    return ph.transport_stability(_nation_clouds(spark, folder), "nation", "match")


@query("""select l_orderkey, l_linenumber, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2 "rank",
  round((rank() over (partition by l_returnflag order by l_discount) - 1 + (count(*) over (partition by l_returnflag, l_discount) - 1) / 2) / (count(*) over (partition by l_returnflag) - 1), 9) pct from lineitem""")
def global_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks of all lines by price, and percentiles by discount in three groups with eleven values."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", c("l_extendedprice").cast("double").alias("price"), c("l_discount").cast("double").alias("discount"))
    ranked = rn.with_midrank_pct(rn.with_avg_rank(lines, [], "price", "rank"), ["l_returnflag"], "discount", "pct")
    return ranked.select("l_orderkey", "l_linenumber", "rank", F.round("pct", 9).alias("pct"))


@query("""select l_returnflag g, round(quantile_cont(l_extendedprice::double, 0.025), 6) low, round(median(l_extendedprice::double), 6) middle, round(quantile_cont(l_extendedprice::double, 0.975), 6) high,
  round(median(l_discount::double), 6) discount from lineitem group by l_returnflag""")
def exact_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    price, discount = qt.quantiles(lines, "l_extendedprice", [0.025, 0.5, 0.975], "l_returnflag"), qt.quantiles(lines, "l_discount", [0.5], "l_returnflag")
    return spark.createDataFrame([(g, *(round(v, 6) for v in (*vs, *discount[g]))) for g, vs in price.items()], "g string, low double, middle double, high double, discount double")


@query()
def slim_edges(spark: SparkSession, folder: str) -> DataFrame:
    v = clouds(spark, folder)
    return geo.aggregate_weights(geo.slim_weights(v, "id", "x", 20, 1.0, 0.05), v, "id", "label", "mass")


@query()
def bootstrap_stability(spark: SparkSession, folder: str) -> DataFrame:
    obs = observations(spark, folder).select("entity", "match", "qty")
    draws = ev.resample(obs, "entity", "match", 20)
    means = draws.join(obs, ["entity", "match"]).groupBy("entity", "b").agg((F.sum(c("qty") * c("times")) / F.sum("times")).alias("m"))
    return means.groupBy("entity").agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


@query()
def sign_flip(spark: SparkSession, folder: str) -> DataFrame:
    h = tb.split_halves(observations(spark, folder), "entity", "match").groupBy("entity").pivot("half", ["A", "B"]).agg(F.avg("qty"))
    return ev.paired_permutation(h.withColumn("d", c("A") - c("B")).filter("d is not null"), "entity", "d")


@query()
def mantel_labels(spark: SparkSession, folder: str) -> DataFrame:
    s = _label_scores(spark, folder).filter("a < b")
    return ev.mantel(s, s.withColumn("score", F.abs(c("a") - c("b")).cast("double")))
