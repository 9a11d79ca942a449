"""Keyed maintenance of tables, joins by key sets, and ordered functions over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.quantiles import quantiles


def last_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Whole-row replacement by key; of several updates of a key the first in the given order wins."""
    return target.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(last_per_key(updates, keys, *order))


def replace_children(target: DataFrame, updates: DataFrame, parent_keys: list[str]) -> DataFrame:
    """All rows of the parents that the updates name give way to the updates' rows."""
    return target.join(updates.select(*parent_keys).distinct(), parent_keys, "left_anti").unionByName(updates)


def accumulate(prev: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return upsert(prev, new, keys, *[F.col(k) for k in keys])


def coverage(model: DataFrame, data: DataFrame, key: str) -> DataFrame:
    """One row: in_model, in_data, covered, foreign (model only), missing (data only)."""
    both = model.select(key).distinct().withColumn("m", F.lit(1)).join(data.select(key).distinct().withColumn("d", F.lit(1)), key, "full_outer")
    n = lambda cond: F.count(F.when(cond, 1))
    m, d = F.col("m").isNotNull(), F.col("d").isNotNull()
    return both.agg(n(m).alias("in_model"), n(d).alias("in_data"), n(m & d).alias("covered"), n(m & ~d).alias("foreign"), n(~m & d).alias("missing"))


def name_clashes(before: DataFrame, batch: DataFrame, key: str, name: str) -> DataFrame:
    """Keys that the batch knows under another name."""
    return batch.select(key, F.col(name).alias("new_name")).distinct().join(before.select(key, F.col(name).alias("old_name")), key).filter("new_name != old_name").distinct()


def changed(prev: DataFrame, cur: DataFrame, keys: list[str], h: str) -> DataFrame:
    """Per key: kept, changed, added or lost, by equality of hashes."""
    a, b = prev.select(*keys, F.col(h).alias("__a"), F.lit(1).alias("__p")), cur.select(*keys, F.col(h).alias("__b"), F.lit(1).alias("__c"))
    state = F.when(F.col("__p").isNull(), "added").when(F.col("__c").isNull(), "lost").when(F.col("__a").eqNullSafe(F.col("__b")), "kept").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def split_halves(df: DataFrame, entity: str, *order: str) -> DataFrame:
    """Alternate rows of an entity go to halves A and B; a single row goes to A."""
    n = F.row_number().over(Window.partitionBy(entity).orderBy(*order))
    return df.withColumn("half", F.when((n - 1) % 2 == 0, "A").otherwise("B"))


def index_entities(df: DataFrame, entity: str) -> DataFrame:
    """Distinct entities numbered from 0 by id: per-range counts give the offsets, so no single task sorts all of them."""
    ids = df.select(entity).distinct().repartitionByRange(F.col(entity)).withColumn("__part", F.spark_partition_id())
    base = ids.groupBy("__part").agg(F.count("*").alias("n"), F.min(entity).alias("lo"))
    starts = base.select("__part", (F.sum("n").over(Window.orderBy("lo")) - F.col("n")).alias("base"))
    n = F.row_number().over(Window.partitionBy("__part").orderBy(entity))
    return ids.join(F.broadcast(starts), "__part").select(entity, (F.col("base") + n - 1).alias("entity_index"))


def avg_rank(part: list[str], c: str) -> Column:
    """Ranks from 1 with ties averaged."""
    ties = F.count("*").over(Window.partitionBy(*part, c))
    return F.rank().over(Window.partitionBy(*part).orderBy(c)) + (ties - 1) / 2.0


def midrank_pct(part: list[str], c: str) -> Column:
    """Midrank from 0 over n - 1; 0.5 for a single value; null for null."""
    n = F.count(c).over(Window.partitionBy(*part))
    ties = F.count("*").over(Window.partitionBy(*part, c))
    rank = F.rank().over(Window.partitionBy(*part).orderBy(F.col(c).asc_nulls_last()))
    return F.when(F.col(c).isNull(), None).when(n == 1, 0.5).otherwise((rank - 1 + (ties - 1) / 2.0) / (n - 1))


def apportion(df: DataFrame, part: list[str], frac: str, order: str, total: int = 100) -> DataFrame:
    """Splits a whole number by fractions, the rest to the largest remainders (ties by order); zeros when the sum is 0."""
    w = Window.partitionBy(*part)
    exact = F.coalesce(F.col(frac) / F.nullif(F.sum(frac).over(w), F.lit(0.0)) * total, F.lit(0.0))
    df = df.withColumn("__x", F.round(exact, 9)).withColumn("__f", F.floor("__x"))
    left = F.when(F.sum("__x").over(w) > 0, F.lit(total) - F.sum("__f").over(w)).otherwise(0)
    order_w = w.orderBy((F.col("__x") - F.col("__f")).desc(), order)
    return df.withColumn("__left", left).withColumn("share", (F.col("__f") + F.when(F.row_number().over(order_w) <= F.col("__left"), 1).otherwise(0)).cast("bigint")).drop("__x", "__f", "__left")


def terciles(df: DataFrame, c: str) -> DataFrame:
    """low, mid or high; strictly above a third's border moves up."""
    low, high = quantiles(df, c, [1 / 3, 2 / 3]).get(None, (None, None))
    return df.withColumn("tercile", F.when(F.col(c) > F.lit(high), "high").when(F.col(c) > F.lit(low), "mid").otherwise("low"))


def argmax_label(df: DataFrame, keys: list[str], label: str, weight: str) -> DataFrame:
    """The label of most weight per key; the first in order of equals."""
    sums = df.groupBy(*keys, label).agg(F.sum(weight).alias("w"))
    return last_per_key(sums, keys, F.desc("w"), F.asc(label))


def usage_fractions(df: DataFrame, keys: list[str], label: str, weight: str, labels: list[str]) -> DataFrame:
    """Each label's share of the weight, one column per label, 0 where absent."""
    wide = df.groupBy(*keys).pivot(label, labels).agg(F.sum(weight)).na.fill(0)
    total = sum((F.col(f"`{x}`") for x in labels), F.lit(0.0))
    return wide.select(*keys, *[F.coalesce(F.col(f"`{x}`") / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias(x) for x in labels])


def majority_vote(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Most frequent known label, the first in order of equals."""
    return argmax_label(df.filter(F.col(label).isNotNull()).withColumn("__one", F.lit(1)), keys, label, "__one").drop("w")


def matchday_subset(matches: DataFrame, pct: float, match: str = "match_id", week: str = "match_week", date: str = "match_date") -> DataFrame:
    """The first share of the weeks, where there are several and half of the matches carry one; else of the matches by date."""
    share = F.lit(min(max(pct, 0.0), 100.0) / 100)
    known = F.when(F.col(week) != 0, F.col(week))
    facts = matches.agg(F.count_distinct(known).alias("weeks"), F.count(known).alias("with_week"), F.count("*").alias("n"))
    # ranks over the distinct weeks and dates, few rows, and within a date; no task sorts all matches
    weeks = matches.select(known.alias("__k")).filter("__k is not null").distinct().withColumn("__w", F.row_number().over(Window.orderBy("__k")))
    day = F.coalesce(F.col(date).cast("string"), F.lit(""))
    days = matches.groupBy(day.alias("__day")).agg(F.count("*").alias("__c")).withColumn("__before", F.sum("__c").over(Window.orderBy("__day")) - F.col("__c")).drop("__c")
    rows = matches.withColumn("__k", known).withColumn("__day", day).join(weeks, "__k", "left").join(days, "__day").crossJoin(F.broadcast(facts))
    rows = rows.withColumn("__d", F.col("__before") + F.row_number().over(Window.partitionBy("__day").orderBy(match)))
    by_week = (F.col("weeks") > 1) & (F.col("with_week") * 2 >= F.col("n"))
    kept = F.when(by_week, F.col("__k").isNotNull() & (F.col("__w") <= F.greatest(F.lit(1), F.ceil(share * F.col("weeks"))))).otherwise(F.col("__d") <= F.greatest(F.lit(1), F.ceil(share * F.col("n"))))
    return rows.filter(kept).select(*matches.columns)
