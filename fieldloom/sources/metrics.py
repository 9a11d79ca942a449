"""Sweep metrics, evaluation tables and ranking reports as CSV."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["combination", "model", "formulation", "entity", "normalisation", "distance", "phase", "metric"]
#: Tables from before there was a choice have this distance.
FORMER_DISTANCE = "euclidean"


def typed(raw: DataFrame) -> DataFrame:
    """Key columns as text, value as a number (null if it is none), and the former distance where none is told.

    A table without the column has the distance added to its model names too, so that earlier and later rows of one model meet.
    """
    out = raw
    if "distance" not in raw.columns:
        out = out.withColumn("distance", F.lit(FORMER_DISTANCE))
        if "model" in raw.columns:
            out = out.withColumn("model", F.concat(F.col("model").cast("string"), F.lit(f"_{FORMER_DISTANCE}")))
    out = out.withColumn("distance", F.coalesce("distance", F.lit(FORMER_DISTANCE)))
    known = {k: F.col(k).cast("string") for k in KEYS if k in out.columns}
    return out.withColumns(known | ({"value": F.col("value").try_cast("double")} if "value" in out.columns else {}))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return typed(spark.read.option("header", True).csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_eval(tables: Mapping[str, DataFrame], path: str, extra: Mapping[str, str] | None = None) -> None:
    """One folder of CSV per phase; `extra` columns, such as the variant, come first in all rows."""
    for name, df in tables.items():
        write_csv(df.select(*[F.lit(v).alias(k) for k, v in (extra or {}).items()], "*"), f"{path}/{name}")


def comparison_report(tops: Mapping[str, DataFrame], names: DataFrame) -> DataFrame:
    """(reference, mode, rank, candidate, score): the rankings of several models side by side. tops: mode -> (a, b, score, rank); names: (id, name)."""
    rows = reduce(DataFrame.unionByName, [t.select("a", "b", "score", "rank", F.lit(mode).alias("mode")) for mode, t in tops.items()])
    of = lambda side, out: names.select(F.col("id").alias(side), F.col("name").alias(out))
    return rows.join(of("a", "reference"), "a").join(of("b", "candidate"), "b").select("reference", "mode", "rank", "candidate", "score")
