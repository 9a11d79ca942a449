"""What the vector searches share: usable rows with a number each, and blocks of vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vector_col: str, *more: Column, zero: bool) -> DataFrame:
    """(row, id, vector, more...): rows with an id and a vector of finite components, of the most frequent length.

    zero: whether vectors without a component other than zero are usable. Of equally frequent lengths the smallest counts;
    `row` tells repeated rows apart, so the result is to be written before it is used twice.
    """
    v = F.col("vector")
    kept = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), *more)
    kept = kept.filter(F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0))
    if not zero:
        kept = kept.filter(F.exists(v, lambda x: x != 0))
    sizes = kept.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    kept = kept.filter(F.size(v) == F.lit(sizes["d"] if sizes else 0))
    return kept.select(F.monotonically_increasing_id().alias("row"), "*")


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """A column of vectors of one length, in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def best(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows per key, numbered from 1 in `rank`; rows are bounded per key and task, and pre-selected before the shuffle."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", at).filter(F.col("rank") <= k)
