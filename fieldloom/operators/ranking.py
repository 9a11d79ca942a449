"""Top-k, name search and explanations over score and display tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.scalars import normalize_name


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(a, b, score, rank): best k others by score, then larger id; zero, null and NaN scores are left out, negative ones stay."""
    ok = scores.filter((F.col("a") != F.col("b")) & F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") != 0))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), F.desc("b")))
    return ok.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k)


def compare_rankings(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, jaccard, common): overlap of two top-k tables per reference."""
    x, y = a.select("a", "b", F.lit(1).alias("x")), b.select("a", "b", F.lit(1).alias("y"))
    both = F.sum(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1).otherwise(0))
    return x.join(y, ["a", "b"], "full_outer").groupBy("a").agg((both / F.count("*")).alias("jaccard"), both.cast("bigint").alias("common"))


def ranks_in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, rank, other_rank): each candidate of the first table with its rank in the second, null if it is not there."""
    return a.select("a", "b", "rank").join(b.select("a", "b", F.col("rank").alias("other_rank")), ["a", "b"], "left")


def _quality(name: Column, text: Column) -> Column:
    return F.when(name == text, 0).when(name.startswith(text), 1).when(name.contains(text), 2)


def search(names: DataFrame, queries: DataFrame, limit: int, key: str = "id", name: str = "name", text: str = "text") -> DataFrame:
    """(text, id, name, quality, rank): exact, then prefix, then substring matches, then by name. Queries are a stated, small set."""
    n, q = names.select(key, name, normalize_name(F.col(name)).alias("__n")), queries.select(text, normalize_name(F.col(text)).alias("__t")).distinct()
    if (asked := q.limit(MOST_TEXTS + 1).count()) > MOST_TEXTS:
        raise ValueError(f"{asked} texts at once; at most {MOST_TEXTS} are compared with every name")
    met = n.join(F.broadcast(q), F.col("__n").contains(F.col("__t"))).withColumn("quality", _quality(F.col("__n"), F.col("__t")))
    rank = F.row_number().over(Window.partitionBy(text).orderBy("quality", "__n", key))
    return met.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= limit).drop("__n", "__t")


#: Texts that are compared with every name at once at most; more are taken in several rounds.
MOST_TEXTS = 10_000


def resolve(names: DataFrame, queries: DataFrame, key: str = "id", name: str = "name", text: str = "text", most: int = MOST_TEXTS, told: int = 10) -> DataFrame:
    """(text, status, id, candidates): exact match, else the only substring match, else ambiguous or absent.

    candidates: of an ambiguous text the first `told` names that hold it, in order of ids; else null.

    Exact names are found by an equi join. Only the other texts are looked for inside the names, `most` of them in a round, so that
    what is broadcast is bounded.
    """
    n = names.select(key, F.col(name).alias("__name"), normalize_name(F.col(name)).alias("__n"))
    q = queries.select(text, normalize_name(F.col(text)).alias("__t")).distinct()
    exact = q.join(n, F.col("__t") == F.col("__n")).groupBy(text).agg(F.min(key).alias("id")).withColumn("status", F.lit("exact"))
    rest = q.join(exact.select(text), text, "left_anti")
    rounds = max(1, -(-rest.count() // most))
    some = lambda k: rest if rounds == 1 else rest.filter(F.pmod(F.xxhash64(text), F.lit(rounds)) == k)
    met = reduce(DataFrame.unionByName, [n.join(F.broadcast(some(k)), F.col("__n").contains(F.col("__t"))).select(text, key, "__name") for k in range(rounds)])
    # the first names only are kept before they are gathered
    at = F.row_number().over(Window.partitionBy(text).orderBy(key))
    names_of = met.withColumn("__at", at).filter(F.col("__at") <= told).groupBy(text).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__name"))), lambda x: x["__name"]).alias("__told"))
    found = rest.join(met.groupBy(text).agg(F.count("*").alias("n"), F.min(key).alias("any")), text, "left").join(names_of, text, "left")
    status = F.when(F.col("n").isNull(), "absent").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    others = found.select(text, status.alias("status"), F.when(F.col("n") == 1, F.col("any")).alias("id"), F.when(F.col("n") > 1, F.col("__told")).alias("candidates"))
    return exact.select(text, "status", "id", F.lit(None).cast("array<string>").alias("candidates")).unionByName(others)


def search_absent(data: DataFrame, model: DataFrame, queries: DataFrame, limit: int, key: str = "id", name: str = "name", text: str = "text") -> DataFrame:
    return search(data.join(model.select(key), key, "left_anti"), queries, limit, key, name, text)


def lookup(ids: DataFrame, model: DataFrame, data: DataFrame, key: str = "id") -> DataFrame:
    m, d = model.select(key).distinct().withColumn("m", F.lit(1)), data.select(key).distinct().withColumn("d", F.lit(1))
    status = F.when(F.col("m").isNotNull() & F.col("d").isNotNull(), "ready").when(F.col("m").isNotNull(), "without_data").when(F.col("d").isNotNull(), "projectable").otherwise("unknown")
    return ids.join(m, key, "left").join(d, key, "left").select(key, status.alias("status"))


def traits(long: DataFrame, entity: str, n: int = 4) -> DataFrame:
    """Features of largest absolute value per entity."""
    rank = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(F.abs("z")), "feature"))
    return long.filter("z is not null").withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= n)


def shared_traits(pairs: DataFrame, long: DataFrame, entity: str, n: int = 4) -> DataFrame:
    """Per pair (a, b) the features in which both stand out alike: |za| - |za - zb|."""
    za, zb = long.select(F.col(entity).alias("a"), "feature", F.col("z").alias("za")), long.select(F.col(entity).alias("b"), "feature", F.col("z").alias("zb"))
    s = F.round(F.abs("za") - F.abs(F.col("za") - F.col("zb")), 9)
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("shared"), "feature"))
    return pairs.select("a", "b").join(za, "a").join(zb, ["b", "feature"]).withColumn("shared", s).withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= n).select("a", "b", "feature", "shared", "rank")


def strengths(long: DataFrame, entity: str, n: int, oriented: Column) -> DataFrame:
    """The n best and n worst features, at most half of them each."""
    w = Window.partitionBy(entity)
    rows = long.withColumn("v", F.round(oriented, 9)).withColumn("__c", F.count("*").over(w))
    rows = rows.withColumn("best", F.row_number().over(w.orderBy(F.desc("v"), "feature"))).withColumn("worst", F.row_number().over(w.orderBy("v", F.desc("feature"))))
    cut = F.least(F.lit(n), F.floor(F.col("__c") / 2))
    side = F.when(F.col("best") <= cut, "strength").when(F.col("worst") <= cut, "weakness")
    rank = F.when(F.col("best") <= cut, F.col("best")).otherwise(F.col("worst")).cast("bigint")
    return rows.withColumn("side", side).withColumn("rank", rank).filter("side is not null").select(entity, "side", "rank", "feature", "v")


def divergence(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """One row over two score tables (a, b, score): max_abs, relative (to the largest absolute score of the second) and the mean share of common top k."""
    x, y = a.select("a", "b", F.col("score").alias("x")), b.select("a", "b", F.col("score").alias("y"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = x.join(y, ["a", "b"], "full_outer").agg(F.max(F.abs(zero(F.col("x")) - zero(F.col("y")))).alias("max_abs"), F.max(F.abs(zero(F.col("y")))).alias("top"))
    # common / jaccard is the size of the union, so that this is the mean size of the two lists
    tops = compare_rankings(top_k(a, k), top_k(b, k)).withColumn("of", (F.col("common") / F.nullif(F.col("jaccard"), F.lit(0.0)) + F.col("common")) / 2)
    overlap = tops.agg(F.avg(F.when(F.col("common") == 0, 0.0).otherwise(F.col("common") / F.col("of"))).alias("overlap"))
    return both.crossJoin(overlap).select("max_abs", (F.col("max_abs") / F.nullif(F.col("top"), F.lit(0.0))).alias("relative"), "overlap")


def top_by_volume(df: DataFrame, volume: str, name: str, n: int = 6) -> DataFrame:
    return df.orderBy(F.desc(volume), F.desc(name)).limit(n)


def model_leagues(obs: DataFrame, league: str) -> DataFrame:
    """One row: leagues, and whether there is a single one, where normalising by league and over all is the same."""
    return obs.agg(F.count_distinct(league).alias("leagues")).withColumn("single", F.col("leagues") <= 1)


def recommend(scores: DataFrame, long: DataFrame, profile: DataFrame, ids: DataFrame, k: int = 10, n: int = 4) -> DataFrame:
    """(a, rank, b, score, traits, phases_a, phases_b): the k best (1 to 50) of the asked entities, with what both share and their phases.

    long: (entity, feature, z); profile: (entity, phase, pct); ids: (a).
    """
    top = top_k(scores.join(ids.select("a").distinct(), "a", "left_semi"), min(max(k, 1), 50))
    shared = shared_traits(top, long, "entity", n)
    told = shared.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda r: r["feature"]).alias("traits"))
    phases = profile.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("phase", "pct"))).alias("phases"))
    of = lambda side: phases.select(F.col("entity").alias(side), F.col("phases").alias(f"phases_{side}"))
    return top.join(told, ["a", "b"], "left").join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "rank", "b", "score", "traits", "phases_a", "phases_b")


def compare_positions(shares: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, position, share_a, share_b): the positions of either of two entities. shares: (entity, position, share), whole percents."""
    one = lambda side: pairs.select("a", "b").distinct().join(shares.select(F.col("entity").alias(side), "position", F.col("share").alias(f"share_{side}")), side)
    both = one("a").join(one("b"), ["a", "b", "position"], "full_outer").na.fill(0, ["share_a", "share_b"])
    return both.filter((F.col("share_a") > 0) | (F.col("share_b") > 0)).select("a", "b", "position", "share_a", "share_b")


def query_by_name(texts: DataFrame, names: DataFrame, scores: DataFrame, long: DataFrame, k: int = 10, n: int = 4) -> DataFrame:
    """(text, status, a, rank, b, candidate, score, traits) for many names in one job; a text that names nobody has one row without a candidate.

    texts: (text); names: (id, name); long: (entity, feature, z).
    """
    told = resolve(names, texts)
    best = top_k(scores.join(told.select(F.col("id").alias("a")).distinct(), "a", "left_semi"), k)
    traits = shared_traits(best, long, "entity", n).groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda r: r["feature"]).alias("traits"))
    rows = best.join(names.select(F.col("id").alias("b"), F.col("name").alias("candidate")), "b").join(traits, ["a", "b"], "left")
    return told.withColumnRenamed("id", "a").join(rows, "a", "left").select("text", "status", "a", "rank", "b", "candidate", "score", "traits")
