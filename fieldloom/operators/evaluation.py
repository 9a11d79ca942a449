"""Evaluation without labels: ranks, list overlap, rank correlation, permutation tests and resampling, all as grouped jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.quantiles import quantiles
from fieldloom.operators.ranks import with_avg_rank
from fieldloom.operators.tables import avg_rank


def target_rank(candidates: DataFrame, query: str = "a", target: str = "target", cand: str = "b", score: str = "score") -> DataFrame:
    """(query, rank): greater scores + (equal scores + 1) / 2, from 1; candidates name the query's target."""
    goal = candidates.filter(F.col(cand) == F.col(target)).select(query, F.col(score).alias("__s"))
    both = candidates.join(goal, query)
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return both.groupBy(query).agg((count(F.col(score) > F.col("__s")) + (count(F.col(score) == F.col("__s")) + 1) / 2.0).alias("rank"))


def recall_mrr(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    return ranks.agg(*[F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks], F.avg(1.0 / F.col("rank")).alias("mrr"))


def rbo(a: Column, b: Column, p: float = 0.9) -> Column:
    """Extrapolated rank-biased overlap of two array columns, to the depth of the longer one; 1 for two empty lists, 0 for one."""
    k = F.greatest(F.size(a), F.size(b))
    agree = lambda d: F.size(F.array_intersect(F.slice(a, F.lit(1), d), F.slice(b, F.lit(1), d))).cast("double")
    total = F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda s, d: s + agree(d) / d * F.pow(F.lit(p), d - 1))
    value = (1 - p) * total + agree(k) / k * F.pow(F.lit(p), k)
    return F.when(k == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(value)


def kendall_tau(df: DataFrame, group: str, item: str, x: str, y: str) -> DataFrame:
    """Tau-b per group of bounded lists (top-k tables): 1 below two items, 0 without variation."""
    a, b = df.select(group, F.col(item).alias("i"), F.col(x).alias("xa"), F.col(y).alias("ya")), df.select(group, F.col(item).alias("j"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    s, t = F.signum(F.col("xa") - F.col("xb")), F.signum(F.col("ya") - F.col("yb"))
    got = a.join(b, group).filter("i < j").groupBy(group).agg(F.sum(s * t).alias("c"), F.sum(s * s).alias("nx"), F.sum(t * t).alias("ny"))
    den = F.sqrt(F.col("nx") * F.col("ny"))
    return df.select(group).distinct().join(got, group, "left").select(group, F.when(F.col("c").isNull(), 1.0).when(den == 0, 0.0).otherwise(F.col("c") / den).alias("tau"))


def pearson(x: str, y: str) -> Column:
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """rho per group; without groups ranks are made over the whole table, by ranges."""
    if group:
        ranked = df.withColumn("__x", avg_rank(group, x)).withColumn("__y", avg_rank(group, y))
    else:
        ranked = with_avg_rank(with_avg_rank(df, [], x, "__x"), [], y, "__y")
    return ranked.groupBy(*group).agg(pearson("__x", "__y").alias("rho"))


def asymmetry(scores: DataFrame) -> DataFrame:
    """Frobenius norm of S - S' over that of S."""
    back = scores.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("score").alias("back"))
    d = F.coalesce("score", F.lit(0.0)) - F.coalesce("back", F.lit(0.0))
    both = scores.join(back, ["a", "b"], "full_outer")
    return both.agg((F.sqrt(F.sum(d * d)) / F.nullif(F.sqrt(F.sum(F.coalesce("score", F.lit(0.0)) ** 2)), F.lit(0.0))).alias("asymmetry"))


def macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Mean F1 over the true classes; 0 where undefined."""
    conf = df.groupBy(truth, guess).agg(F.count("*").alias("n"))
    said = conf.groupBy(F.col(guess).alias("c")).agg(F.sum("n").alias("said"))
    true = conf.groupBy(F.col(truth).alias("c")).agg(F.sum("n").alias("is"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("hit"))
    return true.join(said, "c", "left").agg(F.avg(2.0 * F.col("hit") / (F.col("is") + F.coalesce("said", F.lit(0)))).alias("f1"))


def bootstrap_ci(df: DataFrame, c: str, alpha: float = 0.05) -> DataFrame:
    """(low, high): exact, and no task holds all values."""
    low, high = quantiles(df.filter(F.col(c).isNotNull() & ~F.isnan(c)), c, [alpha / 2, 1 - alpha / 2]).get(None, (None, None))
    return df.sparkSession.createDataFrame([(low, high)], "low double, high double")


def fixed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by a hash of the key; the same ones at any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def paired_permutation(df: DataFrame, key: str, diff: str, n: int = 999, seed: int = 7) -> DataFrame:
    """Sign-flip test: mean difference and p = (1 + flips at least as extreme) / (n + 1); zeros are dropped, (0, 1) without rows."""
    rows = df.filter(F.col(diff) != 0).select(key, F.col(diff).alias("d"))
    flips = rows.select("d", key, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("perm"))
    sign = F.when(F.xxhash64(F.lit(seed), "perm", key) % 2 == 0, 1.0).otherwise(-1.0)
    means = flips.groupBy("perm").agg(F.avg(F.col("d") * sign).alias("m"))
    real = rows.agg(F.avg("d").alias("mean"))
    got = real.join(means, F.lit(True), "left").groupBy("mean").agg(F.sum(F.when(F.abs("m") >= F.abs("mean") - 1e-12, 1).otherwise(0)).alias("more"))
    return got.select(F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(F.col("mean").isNull(), 1.0).otherwise((1 + F.col("more")) / F.lit(n + 1.0)).alias("p"))


def mantel(a: DataFrame, b: DataFrame, n: int = 199, seed: int = 7) -> DataFrame:
    """Spearman correlation of two pair tables (a < b, score) over one bounded set of entities, and p by relabelling the second."""
    x, y = (with_avg_rank(t, [], "score", out).select("a", "b", out) for t, out in ((a, "x"), (b, "y")))
    ids = x.select(F.col("a").alias("e")).union(x.select("b")).distinct()
    perms = ids.select("e", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("perm"))
    plain = Window.partitionBy("perm").orderBy("e")
    mixed = Window.partitionBy("perm").orderBy(F.xxhash64(F.lit(seed), "perm", "e"), "e")
    slots = perms.select("perm", "e", F.row_number().over(plain).alias("i"), F.row_number().over(mixed).alias("j"))
    to = slots.alias("p").join(slots.alias("q"), (F.col("p.perm") == F.col("q.perm")) & (F.when(F.col("p.perm") == 0, F.col("p.i")).otherwise(F.col("p.j")) == F.col("q.i"))).select(F.col("p.perm").alias("perm"), F.col("p.e").alias("old"), F.col("q.e").alias("new"))
    moved = y.join(to.select("perm", F.col("old").alias("a"), F.col("new").alias("na")), "a").join(to.select("perm", F.col("old").alias("b"), F.col("new").alias("nb")), ["perm", "b"])
    moved = moved.select("perm", F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "y")
    r = x.join(moved, ["a", "b"]).groupBy("perm").agg(pearson("x", "y").alias("r"))
    real = r.filter("perm = 0").select(F.col("r").alias("r0"))
    return r.filter("perm > 0").crossJoin(F.broadcast(real)).groupBy("r0").agg(((1 + F.sum(F.when(F.abs("r") >= F.abs("r0") - 1e-12, 1).otherwise(0))) / F.lit(n + 1.0)).alias("p")).withColumnRenamed("r0", "rho")


def resample(obs: DataFrame, entity: str, match: str, n: int, seed: int = 7) -> DataFrame:
    """(b, entity, match, times): n bootstrap draws of each entity's observations with replacement, drawn by hash."""
    w = Window.partitionBy(entity)
    rows = obs.select(entity, match).withColumn("i", F.row_number().over(w.orderBy(match))).withColumn("size", F.count("*").over(w))
    draws = rows.select(entity, "size", F.col("i").alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("b"))
    draws = draws.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "b", entity, "slot"), F.col("size")) + 1).groupBy("b", entity, "i").agg(F.count("*").alias("times"))
    return draws.join(rows.select(entity, match, "i"), [entity, "i"]).select("b", entity, match, "times")
