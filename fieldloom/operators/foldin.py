"""Fold-in: scores for entities that the fitted model has not seen, without fitting it again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.features import phase_profile, zscore
from fieldloom.operators.geometry import aggregate_weights, embed_entities, normalized, pair_scores, rff, slim_weights
from fieldloom.operators.ranking import recommend
from fieldloom.operators.ranks import with_midrank_pct
from fieldloom.operators.steps import stored


def project_features(obs: DataFrame, frozen: DataFrame, group: str | None, features: list[str]) -> DataFrame:
    """z-scores in the model's frozen space; ValueError if its features are others, or it has no statistics for a group of obs."""
    names = {r.feature for r in frozen.select("feature").distinct().limit(len(features) + 1).collect()}
    if names != set(features):
        raise ValueError(f"the model's features differ: {sorted(names ^ set(features))}")
    key = F.col(group) if group else F.lit("all")
    lacking = obs.select(key.alias("grp")).distinct().join(frozen.select("grp").distinct(), "grp", "left_anti").first()
    if lacking is not None:
        raise ValueError(f"the model has no statistics for {lacking.grp}")
    return zscore(obs, frozen, group, features)


def project_f5(clouds: DataFrame, model: DataFrame, data: DataFrame, entity: str, x: str, d: int, dim: int, sigma: float, k: int, kind: str = "euclidean", seed: int = 7) -> DataFrame:
    """(a, b, score, rank): cosine of the new clouds' mean embeddings with the model's, by the model's width, seed and size.

    model: (entity, mass, x) as embedded at the fit; entities that the data have not are left out. No re-ranking is applied.
    """
    new = embed_entities(rff(clouds, x, d, dim, sigma, entity, "mass", seed=seed, kind=kind), entity, "mass")
    known = model.join(data.select(entity).distinct(), entity, "left_semi")
    return pair_scores(normalized(new), normalized(known), entity, lambda a, b: a @ b.T, k)


def pieces(new: DataFrame, model: DataFrame, key: str, entity: str, mass: str, x: str, k: int, beta: float, l1: float, kind: str = "euclidean") -> DataFrame:
    """(o, b, part): what each new observation o gives to model entity b, apart from o's own mass: resampling needs no new regression."""
    w = slim_weights(new, key, x, k, beta, l1, kind, base=model)
    m = model.select(F.col(key).alias("s"), F.col(entity).alias("b"), F.col(mass).cast("double").alias("m"))
    return w.join(m, "s").groupBy(F.col("r").alias("o"), "b").agg(F.sum(F.col("w") * F.col("m")).alias("part"))


def score_pieces(parts: DataFrame, new: DataFrame, model: DataFrame, key: str, entity: str, mass: str) -> DataFrame:
    """(a, b, score): parts summed under the masses of the new observations, over the product of both entities' masses."""
    o = new.select(F.col(key).alias("o"), F.col(entity).alias("a"), F.col(mass).cast("double").alias("m"))
    total = lambda t, name: t.groupBy(F.col(entity).alias(name)).agg(F.sum(F.col(mass).cast("double")).alias(f"t{name}"))
    sums = parts.join(o, "o").groupBy("a", "b").agg(F.sum(F.col("part") * F.col("m")).alias("v"))
    size = F.coalesce(F.nullif(F.col("ta") * F.col("tb"), F.lit(0.0)), F.lit(1.0))
    return sums.join(total(new, "a"), "a").join(total(model, "b"), "b").select("a", "b", (F.col("v") / size).alias("score"))


def project_f2(new: DataFrame, model: DataFrame, key: str, entity: str, mass: str, x: str, k: int, beta: float, l1: float, kind: str = "euclidean") -> DataFrame:
    """(a, b, score): only the new rows are solved, against the model's rows; one direction, so about half the fitted size."""
    return score_pieces(pieces(new, model, key, entity, mass, x, k, beta, l1, kind), new, model, key, entity, mass)


def similarity_between_new(new: DataFrame, model: DataFrame, key: str, entity: str, mass: str, x: str, k: int, beta: float, l1: float, kind: str = "euclidean") -> DataFrame:
    """(a, b, score) among new entities: the model's other rows compete as neighbours, weights on new rows count."""
    cols = [key, entity, mass, x]
    anchors = model.join(new.select(key), key, "left_anti").select(*cols)
    w = slim_weights(new, key, x, k, beta, l1, kind, base=anchors.unionByName(new.select(*cols)))
    return aggregate_weights(w.join(new.select(F.col(key).alias("s")), "s", "left_semi"), new, key, entity, mass)


def recommend_projected(scores: DataFrame, long: DataFrame, new_long: DataFrame, phases: DataFrame, lower_better: list[str], k: int = 10, n: int = 4) -> DataFrame:
    """recommend() for projected entities: they join the display table, and phase percentiles are taken with them included."""
    both = long.select("entity", "feature", "z").unionByName(new_long.select("entity", "feature", "z"))
    profile = with_midrank_pct(stored(phase_profile(both, phases, "entity", lower_better), "phase-scores"), ["phase"], "score", "pct").select("entity", "phase", "pct")
    return recommend(scores, both, profile, new_long.select(F.col("entity").alias("a")), k, n)
