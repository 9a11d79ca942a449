"""Model artefacts and warm state as partitioned tables, what of a state can be used again, and the refit from it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.scalars import row_hash
from fieldloom.operators.geometry import slim_weights
from fieldloom.operators.transport import kernel_from_costs, sinkhorn_pairs
from fieldloom.operators.tables import changed

#: The tables of a model, and those of the state from which it can be fitted again.
MODEL, STATE = ("scores", "entities", "display", "norm_stats", "model_meta"), ("obs", "w", "ot", "state_meta")
AXES = ("formulation", "entity_kind", "normalisation", "distance")


def state_tables(fm: DataFrame, meta: Mapping[str, str], weights: DataFrame | None = None, costs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The state from which a fit can go on: obs (entity, match, hash of the features), w (r, s, w), ot (a, b, cost), state_meta (name, value).

    meta holds what is learnt from all rows and kept, such as the kernel's width or the whitening's root as JSON, and the set-up.
    """
    out = {"obs": fm.select(F.col("entity_id").alias("entity"), F.col("match_id").alias("match"), row_hash(F.col("x").cast("array<double>")).alias("hash"))}
    out["state_meta"] = fm.sparkSession.createDataFrame(sorted(meta.items()) or [("", "")], "name string, value string").filter("name != ''")
    return out | {k: t for k, t in (("w", weights), ("ot", costs)) if t is not None}


def write_tables(tables: Mapping[str, DataFrame], path: str, axes: Mapping[str, str], names: tuple[str, ...] = MODEL) -> None:
    """Writes the tables of one model under its axes; other models in the folder stay, an earlier one with the same axes gives way."""
    if unknown := set(tables) - set(names):
        raise ValueError(f"unknown tables {sorted(unknown)}")
    for name, df in tables.items():
        keyed = df.withColumns({a: F.lit(axes[a]) for a in AXES})
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*AXES).parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str, axes: Mapping[str, str]) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}")
    for a in AXES:
        df = df.filter(F.col(a) == axes[a])
    return df.drop(*AXES)


def reusable_rows(prev: DataFrame, cur: DataFrame, same_setup: bool = True) -> DataFrame:
    """(entity, match, known, same) per row of cur (entity, match, hash); nothing can be used again under another set-up."""
    state = changed(prev, cur, ["entity", "match"], "hash").filter("state != 'lost'")
    ok = F.lit(same_setup)
    return state.select("entity", "match", (ok & (F.col("state") != "added")).alias("known"), (ok & (F.col("state") == "kept")).alias("same"))


def intact_entities(prev: DataFrame, cur: DataFrame, same_setup: bool = True) -> DataFrame:
    """(entity, intact): all rows of now were there and are the same, and none was lost."""
    state = changed(prev, cur, ["entity", "match"], "hash")
    got = state.groupBy("entity").agg(F.bool_and(F.col("state") == "kept").alias("intact"), F.bool_or(F.col("state") != "lost").alias("now"))
    return got.filter("now").select("entity", (F.col("intact") & F.lit(same_setup)).alias("intact"))


def refit_transport(clouds: DataFrame, costs: DataFrame, intact: DataFrame, entity: str, kind: str = "euclidean") -> tuple[DataFrame, DataFrame]:
    """(costs, kernel): the costs of pairs of intact entities are taken over, all others made anew."""
    kept = intact.filter("intact").select("entity")
    of = lambda side: kept.select(F.col("entity").alias(side))
    now = sinkhorn_pairs(clouds, entity, kind, known=costs.join(of("a"), "a", "left_semi").join(of("b"), "b", "left_semi"))
    return now, kernel_from_costs(now)


def refit_slim(obs: DataFrame, weights: DataFrame, rows: DataFrame, key: str, x: str, k: int, beta: float, l1: float, kind: str = "euclidean") -> DataFrame:
    """Weights of all rows, begun from the earlier weights between rows that are known; rows: (key, known)."""
    known = rows.filter("known").select(key)
    of = lambda side: known.select(F.col(key).alias(side))
    return slim_weights(obs, key, x, k, beta, l1, kind, start=weights.join(of("r"), "r", "left_semi").join(of("s"), "s", "left_semi"))
