"""Analytics over a long table of sweep metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, axes: dict[str, list | DataFrame]) -> DataFrame:
    """All combinations of the axes' values: lists, or tables whose first column holds them."""
    of = lambda v, name: v.toDF(name).distinct() if isinstance(v, DataFrame) else spark.createDataFrame([(x,) for x in v], [name])
    parts = [of(values, name) for name, values in axes.items()]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def dedupe(configs: DataFrame, relevant: list[str]) -> DataFrame:
    """Adds a fingerprint of the columns that matter; work is done once per fingerprint and joined back."""
    return configs.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*sorted(relevant))), 256))


def composite(metrics: DataFrame, weights: DataFrame, lower_better: list[str], key: str = "combination", group: str = "entity") -> DataFrame:
    """(group, key, score, rank): weighted mean of z-scores over the metrics that are there; deviation 0 counts as z 0."""
    w = Window.partitionBy(group, "metric")
    sd = F.stddev_pop("value").over(w)
    z = F.when(sd == 0, 0.0).otherwise((F.col("value") - F.avg("value").over(w)) / sd)
    z = F.when(F.col("metric").isin(lower_better), -z).otherwise(z)
    got = metrics.filter("value is not null").withColumn("z", z).join(F.broadcast(weights), "metric").groupBy(group, key).agg((F.sum(F.col("weight") * F.col("z")) / F.sum("weight")).alias("score"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("score", 9)), key))
    return got.withColumn("rank", rank.cast("bigint"))


def response_grid(metrics: DataFrame, x: str, y: str, how: str = "best", lower: bool = False) -> DataFrame:
    """(x, y, z) over all values of both axes; z is the best or the mean, null where nothing was run. lower: less is better."""
    best = F.min if lower else F.max
    cells = metrics.groupBy(x, y).agg((best if how == "best" else F.avg)("value").alias("z"))
    return metrics.select(x).distinct().crossJoin(metrics.select(y).distinct()).join(cells, [x, y], "left")


def optimum(cells: DataFrame, x: str, y: str, lower: bool = False) -> DataFrame:
    """The best cell and whether it lies on the edge of an axis with more than two values; ties to the smaller axes' values."""
    best = cells.filter("z is not null").orderBy(F.asc("z") if lower else F.desc("z"), x, y).limit(1)
    ends = cells.agg(*[f(c).alias(f"{n}_{k}") for k, c in (("x", x), ("y", y)) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count_distinct))])
    edge = lambda k, c: (F.col(f"n_{k}") > 2) & ((F.col(c) == F.col(f"lo_{k}")) | (F.col(c) == F.col(f"hi_{k}")))
    return best.crossJoin(ends).select(x, y, "z", (edge("x", x) | edge("y", y)).alias("on_edge"))


def comparison(metrics: DataFrame, row: str, col: str, cols: list[str], lower: bool = False) -> DataFrame:
    """One row per model with a column per combination, and the best combination if values differ; lower: less is better."""
    wide = metrics.groupBy(row).pivot(col, cols).agg(F.first("value"))
    value = lambda c: -F.col(f"`{c}`") if lower else F.col(f"`{c}`")
    best = F.array_max(F.array(*[F.struct(value(c).alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(cols)]))
    worst = F.least(*[value(c) for c in cols])
    return wide.withColumn("best", F.when(best["v"] != worst, best["c"]))


def best_on_average(wide: DataFrame, cols: list[str], lower: bool = False) -> DataFrame:
    """(combination, mean, complete, best): means of a comparison's columns; the best is sought among those that every model has, ties to the first."""
    counts = wide.agg(F.count("*").alias("__rows"), *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(cols)], *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)])
    each = F.array(*[F.struct(F.lit(c).alias("combination"), F.lit(i).alias("at"), F.col(f"m{i}").alias("mean"), (F.col(f"n{i}") == F.col("__rows")).alias("complete")) for i, c in enumerate(cols)])
    rows = counts.select(F.explode(each).alias("x")).select("x.*")
    # a row per combination: a stated, small set
    order = Window.partitionBy("complete").orderBy(F.asc_nulls_last("mean") if lower else F.desc_nulls_last("mean"), "at")
    best = F.col("complete") & F.col("mean").isNotNull() & (F.row_number().over(order) == 1)
    return rows.select("combination", "mean", "complete", best.alias("best"))


def varying_axes(configs: DataFrame, axes: list[str]) -> DataFrame:
    """(axis, n) for axes with more than one value."""
    return configs.agg(*[F.count_distinct(F.coalesce(F.col(a).cast("string"), F.lit(""))).alias(a) for a in axes]).unpivot([], axes, "axis", "n").filter("n > 1")


def assign_names(reg: DataFrame, configs: DataFrame, cols: list[str]) -> DataFrame:
    """Configurations keep the name under which the registry has them; new ones get the next numbers."""
    canon = F.to_json(F.struct(*sorted(cols)))
    known = reg.select("name", canon.alias("canon"))
    last = known.agg(F.coalesce(F.max(F.regexp_extract("name", r"^v(\d+)$", 1).try_cast("int")), F.lit(0)).alias("last"))
    rows = configs.withColumn("canon", canon).dropDuplicates(["canon"]).join(known, "canon", "left")
    fresh = rows.filter("name is null").withColumn("n", F.row_number().over(Window.orderBy("canon"))).crossJoin(last).withColumn("name", F.concat(F.lit("v"), F.col("last") + F.col("n")))
    return rows.filter("name is not null").select("name", *cols).unionByName(fresh.select("name", *cols))


def pchip(points: DataFrame, key: str, x: str, y: str, at: DataFrame) -> DataFrame:
    """(key, x, y) at the asked places by monotone cubic interpolation, within the known range only.

    Slopes at the points come from windows over each key's series; places are joined to the interval that holds them.
    """
    w = Window.partitionBy(key).orderBy(x)
    c = F.col
    p = points.filter(c(y).isNotNull()).select(c(key), c(x).alias("x0"), c(y).alias("y0"))
    w = Window.partitionBy(key).orderBy("x0")
    p = p.withColumns({"x1": F.lead("x0").over(w), "y1": F.lead("y0").over(w), "xp": F.lag("x0").over(w), "yp": F.lag("y0").over(w)})
    p = p.withColumns({"h": c("x1") - c("x0"), "d": (c("y1") - c("y0")) / (c("x1") - c("x0")), "hp": c("x0") - c("xp"), "dp": (c("y0") - c("yp")) / (c("x0") - c("xp"))})
    inner = F.when(c("d") * c("dp") <= 0, 0.0).otherwise((3 * (c("h") + c("hp"))) / ((2 * c("h") + c("hp")) / c("dp") + (c("h") + 2 * c("hp")) / c("d")))

    def end(h, d, h2, d2):
        m = ((2 * h + h2) * d - h * d2) / (h + h2)
        m = F.when(F.signum(m) != F.signum(d), 0.0).when((F.signum(d) != F.signum(d2)) & (F.abs(m) > 3 * F.abs(d)), 3 * d).otherwise(m)
        return F.coalesce(m, d)

    nxt, prv = lambda n: F.lead(n).over(w), lambda n: F.lag(n).over(w)
    slope = F.when(c("dp").isNull(), end(c("h"), c("d"), nxt("h"), nxt("d"))).when(c("d").isNull(), end(c("hp"), c("dp"), prv("hp"), prv("dp"))).otherwise(inner)
    p = p.withColumn("m0", slope).withColumn("m1", F.lead("m0").over(w)).select(key, "x0", "x1", "y0", "y1", "h", "m0", "m1")
    inside = (c("ax") >= c("x0")) & ((c("ax") < c("x1")) | c("x1").isNull() & (c("ax") == c("x0")))
    got = at.select(c(key).alias("__k"), c(x).alias("ax")).join(p, (c("__k") == c(key)) & inside)
    t = (c("ax") - c("x0")) / c("h")
    val = (2 * t**3 - 3 * t**2 + 1) * c("y0") + (t**3 - 2 * t**2 + t) * c("h") * c("m0") + (-2 * t**3 + 3 * t**2) * c("y1") + (t**3 - t**2) * c("h") * c("m1")
    return got.select(key, c("ax").alias(x), F.coalesce(val, c("y0")).alias(y))


def fill_grid(cells: DataFrame, x: str, y: str, z: str = "z") -> DataFrame:
    """(x, y, z, filled): holes of a response grid by monotone cubic interpolation along x within each y, what is left along y within each x.

    Cells are (x, y, z) with a null z for a hole. Outside the known range of both its row and its column a hole stays one.
    """
    for key, along in ((y, x), (x, y)):
        holes = cells.filter(F.col(z).isNull()).select(key, along)
        # a single known point gives no curve
        known = cells.filter(F.col(z).isNotNull())
        some = known.groupBy(key).count().filter("count > 1").select(key)
        made = pchip(known.join(some, key, "left_semi"), key, along, z, holes.join(some, key, "left_semi")).withColumnRenamed(z, "__made")
        if "filled" not in cells.columns:
            cells = cells.withColumn("filled", F.lit(False))
        cells = cells.join(made, [key, along], "left").select(x, y, F.coalesce(z, "__made").alias(z), (F.col("filled") | F.col(z).isNull() & F.col("__made").isNotNull()).alias("filled"))
    return cells
