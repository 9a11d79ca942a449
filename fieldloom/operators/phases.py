"""Evaluation of a fitted similarity without labels, phase by phase; each phase is one job that gives (metric, value) rows or its table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import evaluation as ev
from fieldloom.operators.geometry import dist, normalized
from fieldloom.operators.ranking import top_k
from fieldloom.operators.steps import stored
from fieldloom.operators.tables import majority_vote, terciles
from fieldloom.operators.transport import kernel_from_costs, sinkhorn_draws


def lists(top: DataFrame, name: str, *more: str) -> DataFrame:
    """Top-k tables as one array per reference."""
    return top.groupBy("a", *more).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda r: r["b"]).alias(name))


def sanity(raw: DataFrame, scores: DataFrame, roles: DataFrame) -> DataFrame:
    """Phase 0: asymmetry of the directional scores, and the share of best neighbours with the same role. roles: (entity, role), null unknown."""
    mine, theirs = roles.select(F.col("entity").alias("a"), F.col("role").alias("ra")), roles.select(F.col("entity").alias("b"), F.col("role").alias("rb"))
    best = top_k(scores, 1).join(mine.filter("ra is not null"), "a").join(theirs, "b", "left")
    pure = best.agg(F.avg(F.when(F.col("ra").eqNullSafe(F.col("rb")), 1.0).otherwise(0.0)).alias("purity"), F.count("*").alias("n_purity"))
    return ev.asymmetry(raw).crossJoin(pure)


def self_retrieval(halves: DataFrame, minutes: DataFrame | None = None) -> DataFrame:
    """Phase 1: (scope, n, pool, chance, mrr, recall_1, recall_5, recall_10) of finding an entity's other half.

    halves: (a, b, score), a a half A and b a half B, entity ids on both sides; both directions, together and by minutes terciles.
    """
    there = ev.target_rank(halves.withColumn("target", F.col("a"))).select(F.col("a").alias("e"), "rank", F.lit("A->B").alias("scope"))
    back = ev.target_rank(halves.select(F.col("b").alias("a"), F.col("a").alias("b"), "score").withColumn("target", F.col("a"))).select(F.col("a").alias("e"), "rank", F.lit("B->A").alias("scope"))
    both = there.unionByName(back)
    parts = [both.withColumn("scope", F.lit("global")), there, back]
    if minutes is not None:
        of = terciles(there.select("e").join(minutes.select(F.col("entity").alias("e"), "minutes"), "e"), "minutes")
        parts.append(both.drop("scope").join(of.select("e", F.col("tercile").alias("scope")), "e"))
    rows = reduce(lambda x, y: x.unionByName(y), parts)
    pool = halves.agg(F.count_distinct("b").alias("pool"))
    shares = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in (1, 5, 10)]
    return rows.groupBy("scope").agg(F.count("*").alias("n"), F.avg(1 / F.col("rank")).alias("mrr"), *shares).crossJoin(F.broadcast(pool)).withColumn("chance", 1 / F.col("pool"))


def denoising(before: DataFrame, after: DataFrame, n: int = 999) -> DataFrame:
    """Phase 4: mean gain of the reciprocal rank by re-ranking, and its p. Both: (a, b, score) of halves, as above."""
    rr = lambda t, name: ev.target_rank(t.withColumn("target", F.col("a"))).select("a", (1 / F.col("rank")).alias(name))
    gain = rr(after, "x").join(rr(before, "y"), "a").select("a", (F.col("x") - F.col("y")).alias("d"))
    return ev.paired_permutation(gain, "a", "d", n).crossJoin(gain.agg(F.avg("d").alias("delta_mrr")))


def stability(base: DataFrame, resampled: DataFrame, p: float = 0.9) -> DataFrame:
    """Phase 2: mean overlap of the top lists with those of resamples, and its interval. resampled: (draw, a, b, rank)."""
    asked = lists(base, "x")
    draws = resampled.select("draw").distinct()
    got = lists(resampled, "y", "draw")
    none = F.array().cast(asked.schema["x"].dataType)
    each = asked.crossJoin(F.broadcast(draws)).join(got, ["a", "draw"], "left").withColumn("y", F.coalesce("y", none))
    by = each.groupBy("draw").agg(F.avg(ev.rbo(F.col("x"), F.col("y"), p)).alias("rbo"), F.count("*").alias("n"))
    ci = ev.bootstrap_ci(by, "rbo")
    return by.agg(F.avg("rbo").alias("rbo"), F.max("n").alias("n_asked"), F.count("*").alias("draws")).crossJoin(ci)


def transport_stability(obs: DataFrame, entity: str, match: str, n: int = 20, k: int = 10, kind: str = "euclidean", p: float = 0.9, seed: int = 7) -> DataFrame:
    """Phase 2 of a transport model: as `stability`, the scores refitted under each of n bootstrap draws.

    obs: (entity, match, mass, x). A draw multiplies masses by how often an observation was drawn, so clouds and ground costs are made
    once, for the model itself (draw 0) and all draws.
    """
    times = ev.resample(obs, entity, match, n, seed).groupBy(entity, match).agg(F.map_from_entries(F.collect_list(F.struct("b", "times"))).alias("times"))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda b: F.coalesce(F.element_at("times", b), F.lit(0)) * F.col("mass"))
    clouds = obs.join(times, [entity, match], "left").select(entity, F.concat(F.array(F.col("mass").cast("double")), F.coalesce(drawn, F.array_repeat(F.lit(0.0), n))).alias("masses"), "x")
    kernel = stored(kernel_from_costs(sinkhorn_draws(clouds, entity, kind), "draw"), "draw-scores")
    rank = F.row_number().over(Window.partitionBy("draw", "a").orderBy(F.desc("score"), F.desc("b")))
    top = kernel.withColumn("rank", rank).filter(F.col("rank") <= k)
    return stability(top.filter("draw = 0").select("a", "b", "rank"), top.filter("draw > 0").select("draw", "a", "b", "rank"), p)


def triangulation(models: Mapping[str, DataFrame], pairs: list[tuple[str, str]], sample: int = 500, seed: int = 7, n: int = 199) -> DataFrame:
    """Phase 3: (left, right, rho, p, tau) over pairs of score tables; a sample of at most `sample` common entities by hash."""
    out = []
    for left, right in pairs:
        x, y = models[left], models[right]
        ids = ev.fixed_sample(x.select(F.col("a").alias("e")).distinct().join(y.select(F.col("a").alias("e")).distinct(), "e", "left_semi"), "e", sample, seed)
        of = lambda t: t.filter("a < b").join(ids.select(F.col("e").alias("a")), "a", "left_semi").join(ids.select(F.col("e").alias("b")), "b", "left_semi").select("a", "b", "score")  # noqa: B023, E731
        test = ev.mantel(of(x), of(y), n, seed)
        both = top_k(x.join(ids.select(F.col("e").alias("a")), "a", "left_semi"), 10).select("a", "b", F.col("score").alias("sx")).join(y.select("a", "b", F.col("score").alias("sy")), ["a", "b"])
        tau = ev.kendall_tau(both, "a", "b", "sx", "sy").agg(F.avg("tau").alias("tau"))
        out.append(test.crossJoin(tau).select(F.lit(left).alias("left"), F.lit(right).alias("right"), "rho", "p", "tau"))
    return reduce(lambda x, y: x.unionByName(y), out)


def downstream(scores: DataFrame, entities: DataFrame, k: int = 10, voters: int = 5) -> DataFrame:
    """Phase 5: k-NN role vote (accuracy, macro F1), coverage, diversity of lists, in-degree and its rank correlation with volume.

    entities: (entity, role, volume, x); a null role is unknown.
    """
    top = top_k(scores, k)
    role = lambda side, out: entities.filter("role is not null").select(F.col("entity").alias(side), F.col("role").alias(out))
    votes = majority_vote(top.filter(F.col("rank") <= voters).join(role("b", "guess"), "b"), ["a"], "guess").join(role("a", "role"), "a")
    vote = votes.agg(F.avg(F.when(F.col("guess") == F.col("role"), 1.0).otherwise(0.0)).alias("knn_accuracy"), F.count("*").alias("n_knn")).crossJoin(ev.macro_f1(votes, "role", "guess").withColumnRenamed("f1", "knn_f1"))
    degree = entities.select("entity", F.col("volume").cast("double").alias("volume")).join(top.groupBy(F.col("b").alias("entity")).agg(F.count("*").alias("n")), "entity", "left").select("volume", F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    reach = degree.agg(F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)).alias("coverage"), F.avg("n").alias("indegree"))
    popular = ev.spearman(degree, [], "n", "volume").select(F.col("rho").alias("popularity"))
    x = top.select("a", "b", "rank").join(entities.select(F.col("entity").alias("b"), "x"), "b")
    # lists hold at most k members, so that pairs within a list are bounded
    apart = x.alias("p").join(x.alias("q"), (F.col("p.a") == F.col("q.a")) & (F.col("p.rank") < F.col("q.rank"))).groupBy("p.a").agg(F.avg(dist(F.col("p.x"), F.col("q.x"), "euclidean")).alias("d")).agg(F.avg("d").alias("diversity"))
    return vote.crossJoin(reach).crossJoin(popular).crossJoin(apart)


def pool_of(inside: DataFrame, pool: int, seed: int = 7) -> DataFrame:
    """(entity, inside): at most `pool` entities of each side, as many of the one as of the other, drawn by hash."""
    known = inside.select("entity", "inside")
    sizes = known.groupBy("inside").count()
    n = F.least(F.min("count"), F.lit(pool))
    rank = F.row_number().over(Window.partitionBy("inside").orderBy(F.xxhash64(F.lit(seed), "entity"), "entity"))
    return known.withColumn("i", rank).crossJoin(F.broadcast(sizes.agg(n.alias("n")))).filter("i <= n").select("entity", "inside")


def generalization(embedded_halves: DataFrame, inside: DataFrame, pool: int, seed: int = 7, minutes: DataFrame | None = None) -> DataFrame:
    """Phase 7: self-retrieval inside and outside the fitted leagues over pools of one size.

    embedded_halves: (entity, half, x), all embedded by the model that was fitted without the held-out leagues; inside: (entity, inside).
    The pool is `pool_of` the entities; halves of others are not looked at, and need not be embedded.
    """
    chosen = pool_of(inside, pool, seed)
    rows = normalized(embedded_halves).join(chosen, "entity")
    half = lambda h, e, x: rows.filter(F.col("half") == h).select(F.col("entity").alias(e), "inside", F.col("x").alias(x))
    # at most `pool` entities on either side of each of the two scopes; written, as every rank compares a score with itself
    scores = half("A", "a", "xa").join(half("B", "b", "xb"), "inside").select("inside", "a", "b", (1 - dist(F.col("xa"), F.col("xb"), "cosine")).alias("score"))
    scores = stored(scores, "half-scores")
    told = [self_retrieval(scores.filter("inside" if i else "not inside").select("a", "b", "score"), minutes).withColumn("inside", F.lit(i)) for i in (True, False)]
    return told[0].unionByName(told[1])


def evaluate(tables: Mapping[str, DataFrame], axes: Mapping[str, str]) -> DataFrame:
    """(axes, phase, item, metric, value): the phases' tables as one long table tagged with the model's axes.

    Each phase is made and written on its own: in one plan the broadcasts of one phase wait for the work of all others, longer than Spark lets them.
    """
    out = []
    for phase, df in tables.items():
        df = stored(df, f"phase-{phase}")
        names = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "long", "integer", "float")]
        keys = [c for c in df.columns if c not in names]
        item = F.concat_ws("/", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
        long = df.select(item.alias("item"), *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["item"], names, "metric", "value")
        out.append(long.select(*[F.lit(v).alias(a) for a, v in axes.items()], F.lit(phase).alias("phase"), "item", "metric", "value"))
    return reduce(lambda x, y: x.unionByName(y), out)
