"""The two fitting pipelines as compositions of the geometry operators, the served presets, and the refit under other groupings.

fm: feature matrix (entity_id, match_id, mass, x), one row per observation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import geometry as geo
from fieldloom.operators import transport as tr
from fieldloom.operators.matrices import ease_kernel

# What is served per entity kind, with which parameters, and in which distance.
SERVED = {"player": ("5", "by_league"), "team": ("5", "global")}
SERVED_DISTANCE = "manhattan"
SERVED_PARAMETERS = {
    "player": {"method": "mmd", "dim": 1536, "ease": 0.0},
    "team": {"method": "mmd", "dim": 1216, "ease": 0.03},
}


def preset(kind: str, formulation: str, normalisation: str, distance: str = SERVED_DISTANCE) -> dict:
    """Parameters of the served model of that kind; none for any other cell."""
    served = SERVED.get(kind) == (formulation, normalisation) and distance == SERVED_DISTANCE
    return dict(SERVED_PARAMETERS[kind]) if served else {}


def display(fm: DataFrame) -> DataFrame:
    """(entity_id, mass, x): mean features by mass, for show."""
    return geo.embed_entities(fm.select("entity_id", "mass", F.col("x").cast("array<double>").alias("x")), "entity_id", "mass")


def fit_f2(fm: DataFrame, neighbours: int = 50, beta: float = 1.0, l1: float = 0.05, distance: str = "euclidean", start: DataFrame | None = None) -> Mapping[str, DataFrame]:
    """scores (a, b, score), weights (r, s, w) and display: each observation rebuilt from its neighbours, weights summed to entities."""
    rows = fm.withColumn("o", F.concat_ws("/", F.col("entity_id").cast("string"), F.col("match_id").cast("string")))
    w = geo.slim_weights(rows, "o", "x", neighbours, beta, l1, distance, start=start)
    return {"scores": geo.aggregate_weights(w, rows, "o", "entity_id", "mass"), "weights": w, "display": display(fm)}


def fit_f5(fm: DataFrame, d: int, k: int, method: str = "mmd", dim: int = 1024, ease: float = 0.03, distance: str = "euclidean", sigma: float | None = None, seed: int = 7, block: int | None = None) -> Mapping[str, DataFrame]:
    """scores (a, b, score), the k best of each entity, and display: similarity of the entities' clouds, re-ranked in closed form.

    Mean embeddings are re-ranked in low-rank form, a transport kernel by the inverse of a block matrix (blocks of `block` entities).
    """
    if method == "mmd":
        rows = fm.withColumn("o", F.concat_ws("/", F.col("entity_id").cast("string"), F.col("match_id").cast("string")))
        sigma = sigma or geo.kernel_width(rows, "o", "x", distance, seed)
        e = geo.embed_entities(geo.rff(fm, "x", d, dim, sigma, "entity_id", "mass", seed=seed, kind=distance), "entity_id", "mass")
        return {"scores": geo.ease_rerank(e, "entity_id", dim, ease, k), "display": display(fm)}
    if method != "sinkhorn":
        raise ValueError(f"unknown method {method}")
    kernel = tr.kernel_from_costs(tr.sinkhorn_pairs(fm.select(F.col("entity_id"), "mass", "x"), "entity_id", distance))
    return {"scores": ease_kernel(kernel, ease, k, block), "display": display(fm)}


def rebuild(fm: DataFrame, formulation: str, grouping: DataFrame | None = None, masses: DataFrame | None = None, **how) -> DataFrame:
    """Scores of the same fit under virtual entities (entity_id, match_id, group) or other masses (entity_id, match_id, mass): halves, resamples."""
    keys = ["entity_id", "match_id"]
    rows = fm if masses is None else fm.drop("mass").join(masses.select(*keys, "mass"), keys)
    if grouping is not None:
        rows = rows.join(grouping.select(*keys, "group"), keys).drop("entity_id").withColumnRenamed("group", "entity_id")
    return (fit_f2 if formulation == "2" else fit_f5)(rows, **how)["scores"]
