"""Ranks over whole tables or a few large groups, without a window that one task has to hold.

Equal values are counted first, so ties never lie across a border. The distinct values are dealt by range, numbered inside
their range, and the ranges' totals, one row per range and group, give what stands before each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.steps import stored


def _free(columns: list[str], *names: str) -> list[str]:
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def value_ranks(df: DataFrame, groups: list[str], c: str) -> DataFrame:
    """(groups, value, before, ties, total): per distinct value how many rows of the group are smaller, equal and there at all; nulls are left out.

    The result reads a written table.
    """
    counts = df.filter(F.col(c).isNotNull()).groupBy(*groups, F.col(c).alias("value")).agg(F.count("*").alias("ties"))
    ranged = counts.repartitionByRange(*[F.col(g) for g in groups], F.col("value")).withColumn("__part", F.spark_partition_id())
    # written, so that the borders of the ranges are the same for all that reads them
    ranged = stored(ranged, "ranges")
    starts = ranged.groupBy(*groups, "__part").agg(F.sum("ties").alias("__n"))
    # a row per range and group
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    starts = starts.withColumn("total", F.sum("__n").over(whole)).withColumn("__base", F.sum("__n").over(whole.orderBy("__part")) - F.col("__n")).drop("__n")
    inside = Window.partitionBy(*groups, "__part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups] + [F.col("l.__part") == F.col("r.__part")]
    on = same[0]
    for cond in same[1:]:
        on = on & cond
    rows = ranged.withColumn("before", F.sum("ties").over(inside) - F.col("ties")).alias("l").join(starts.alias("r"), on)
    return rows.select(*[F.col(f"l.{g}").alias(g) for g in groups], "l.value", (F.col("r.__base") + F.col("l.before")).alias("before"), "l.ties", "r.total")


def _with(df: DataFrame, groups: list[str], c: str, out: str, value: Column) -> DataFrame:
    names = _free([*df.columns, out], *[f"r_{g}" for g in groups], "r_value", "before", "ties", "total")
    ranks = value_ranks(df, groups, c).toDF(*names)
    on = F.col(c) == F.col(names[len(groups)])
    for g, r in zip(groups, names, strict=False):
        on = on & F.col(g).eqNullSafe(F.col(r))
    before, ties, total = (F.col(n) for n in names[-3:])
    return df.join(ranks, on, "left").select(*df.columns, value(before, ties, total).alias(out))


def with_avg_rank(df: DataFrame, groups: list[str], c: str, out: str) -> DataFrame:
    """df with ranks from 1, ties averaged; null for null."""
    return _with(df, groups, c, out, lambda before, ties, total: before + (ties + 1) / 2.0)


def with_midrank_pct(df: DataFrame, groups: list[str], c: str, out: str) -> DataFrame:
    """df with the midrank from 0 over n - 1; 0.5 for a single value; null for null."""
    return _with(df, groups, c, out, lambda before, ties, total: F.when(total == 1, 0.5).otherwise((before + (ties - 1) / 2.0) / (total - 1)))
