"""Entropic optimal transport between entities' clouds of observations, many pairs and many draws of masses at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.geometry import block_distances
from fieldloom.operators.quantiles import quantiles
from fieldloom.operators.steps import batches_of, stored

#: Numbers of the plans that are solved together.
TOGETHER = 1 << 18


def sinkhorn_many(c: np.ndarray, wa: np.ndarray, wb: np.ndarray, reg: float = 0.5, iters: int = 100, stride: int = 20) -> np.ndarray:
    """Entropic transport costs: c (..., n, m) costs, wa (..., n) and wb (..., m) masses, leading axes broadcast.

    Every `stride`-th step is in the log domain, those between are scalings, where they stay finite. Places of mass 0 count as 1e-300.
    """
    share = lambda w: np.maximum(w / np.where((t := w.sum(-1, keepdims=True)) == 0, 1, t), 1e-300)
    a, b = share(wa), share(wb)
    lead = np.broadcast_shapes(c.shape[:-2], a.shape[:-1], b.shape[:-1])
    a, b = np.broadcast_to(a, (*lead, a.shape[-1])), np.broadcast_to(b, (*lead, b.shape[-1]))
    la, lb, f, g, m = np.log(a), np.log(b), np.zeros(a.shape), np.zeros(b.shape), -c / reg

    def lse(z: np.ndarray, axis: int) -> np.ndarray:
        t = z.max(axis=axis, keepdims=True)
        return t.squeeze(axis) + np.log(np.exp(z - t).sum(axis=axis))

    done = 0
    while done < iters:
        # a step in the log domain; then the plan is finite, and a few steps are scalings of its rows and columns
        f = la - lse(m + g[..., None, :], -1)
        g = lb - lse(m + f[..., :, None], -2)
        some = min(stride, iters - done) - 1
        if some:
            plan = np.exp(m + f[..., :, None] + g[..., None, :])
            with np.errstate(all="ignore"):
                v = np.ones(b.shape)
                for _ in range(some):
                    u = a / (plan @ v[..., None])[..., 0]
                    v = b / (u[..., None, :] @ plan)[..., 0, :]
                logs = np.log(u), np.log(v)
            if not all(np.isfinite(x).all() for x in logs):
                stride, done = 1, done + 1
                continue
            f, g = f + logs[0], g + logs[1]
        done += some + 1
    return (np.exp(m + f[..., :, None] + g[..., None, :]) * c).sum(axis=(-2, -1))


def ground_cost(xa: np.ndarray, xb: np.ndarray, kind: str) -> np.ndarray:
    return np.maximum(block_distances(xa, xb, "manhattan" if kind == "manhattan" else "sqeuclidean"), 0)


def sinkhorn(xa: np.ndarray, wa: np.ndarray, xb: np.ndarray, wb: np.ndarray, kind: str = "euclidean", reg: float = 0.5, iters: int = 100, stride: int = 20) -> float:
    """Entropic transport cost of two clouds."""
    return float(sinkhorn_many(ground_cost(xa, xb, kind), np.asarray(wa, dtype=float), np.asarray(wb, dtype=float), reg, iters, stride))


def _clouds(rows: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vectors, masses by draw) per row of list<struct<m: list<double>, x: list<double>>>."""
    flat, sizes = rows.flatten(), rows.value_lengths().to_numpy()
    part = lambda name: flat.field(name).flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    cuts = np.cumsum(sizes)[:-1]
    return list(zip(np.split(part("x"), cuts), np.split(part("m"), cuts), strict=True))


def _solved(a: list, b: list, kind: str) -> np.ndarray:
    """(pair, draw): costs of pairs of clouds, padded to one size; padding has no mass and is out of reach."""
    n, m, draws = max(len(x) for x, _ in a), max(len(x) for x, _ in b), a[0][1].shape[1]
    c, wa, wb = np.zeros((len(a), 1, n, m)), np.zeros((len(a), draws, n)), np.zeros((len(a), draws, m))
    for k, ((xa, ma), (xb, mb)) in enumerate(zip(a, b, strict=True)):
        own = ground_cost(xa, xb, kind)
        far = 1e3 + 4 * own.max()
        c[k, 0, : len(xa), len(xb) :] = c[k, 0, len(xa) :, : len(xb)] = far
        c[k, 0, len(xa) :, len(xb) :] = 2 * far
        c[k, 0, : len(xa), : len(xb)] = own
        wa[k, :, : len(xa)], wb[k, :, : len(xb)] = ma.T, mb.T
    return sinkhorn_many(c, wa, wb)


def _costs(clouds: DataFrame, entity: str, masses: str, kind: str, known: DataFrame | None, groups: int) -> DataFrame:
    """(a, b, costs) for pairs a < b: one cost per draw of masses; the ground cost of a pair is made once."""
    rows = F.collect_list(F.struct(F.col(masses).cast("array<double>").alias("m"), F.col("x").cast("array<double>").alias("x"))).alias("rows")
    packed = clouds.groupBy(F.col(entity).alias("e")).agg(rows).withColumn("g", F.pmod(F.xxhash64("e"), F.lit(groups)))
    packed = stored(packed, "clouds")
    a = packed.select(F.col("e").alias("a"), F.col("rows").alias("ra"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    # a fixed number of partitions: the few rows are light to send and heavy to work on, so they are not to be put together
    pairs = a.repartition(4 * groups, "g").join(packed.select(F.col("e").alias("b"), F.col("rows").alias("rb"), "g").repartition(4 * groups, "g").hint("merge"), "g").filter("a < b")
    if known is not None:
        pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
    # pairs of a group of clouds are many and small: dealt out evenly
    pairs = pairs.select("a", "b", "ra", "rb").repartition(4 * groups, "a", "b")
    name = clouds.schema[entity].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, rb = _clouds(batch.column("ra")), _clouds(batch.column("rb"))
            # like sizes together, so that little is padded
            order = sorted(range(len(ra)), key=lambda r: (len(ra[r][0]), len(rb[r][0])))
            out, start = [None] * len(order), 0
            while start < len(order):
                stop, most = start, 0
                while stop < len(order):
                    x, y = ra[order[stop]], rb[order[stop]]
                    most = max(most, len(x[0]) * len(y[0]) * x[1].shape[1])
                    if stop > start and most * (stop + 1 - start) > TOGETHER:
                        break
                    stop += 1
                some = order[start:stop]
                for r, costs in zip(some, _solved([ra[r] for r in some], [rb[r] for r in some], kind), strict=True):
                    out[r] = costs.tolist()
                start = stop
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.list_(pa.float64()))], names=["a", "b", "costs"])

    most = packed.agg(F.max(F.size("rows") * (F.size(F.col("rows")[0]["x"]) + F.size(F.col("rows")[0]["m"])))).first()[0] or 1
    with batches_of(clouds.sparkSession, 16 * most):
        return stored(pairs.mapInArrow(run, f"a {name}, b {name}, costs array<double>"), "transport")


def sinkhorn_pairs(clouds: DataFrame, entity: str, kind: str = "euclidean", known: DataFrame | None = None, groups: int = 16) -> DataFrame:
    """(a, b, cost) for entity pairs a < b; pairs in `known` are taken from there. clouds: entity, mass, x, one row per observation.

    Clouds are packed per entity and go into groups by hash; pairs of groups are joined, so that every cloud is sent `groups` times.
    Solved once: the result reads a written table.
    """
    one = clouds.withColumn("mass", F.array(F.col("mass").cast("double")))
    made = _costs(one, entity, "mass", kind, known, groups).select("a", "b", F.col("costs")[0].alias("cost"))
    return made if known is None else made.unionByName(known.select("a", "b", "cost"))


def sinkhorn_draws(clouds: DataFrame, entity: str, kind: str = "euclidean", groups: int = 16) -> DataFrame:
    """(draw, a, b, cost), draws from 0. clouds: entity, masses (one per draw), x.

    A resample changes masses only, so a pair's ground cost is made once and all its draws are solved together.
    """
    return _costs(clouds, entity, "masses", kind, None, groups).select("a", "b", F.posexplode("costs").alias("draw", "cost"))


def kernel_from_costs(costs: DataFrame, by: str | None = None) -> DataFrame:
    """exp(-cost / median cost), both directions; scale 1 if the median is 0. by: a column whose groups (few) have medians of their own.

    Costs are written once; the median is exact and no task holds all costs.
    """
    costs = stored(costs, "costs")
    scales = {g: (m or 1.0) for g, (m,) in quantiles(costs, "cost", [0.5], by).items()}
    if by is None:
        scale = F.lit(scales.get(None, 1.0))
    else:
        pairs = [F.lit(x) for g, m in scales.items() for x in (g, m)]
        scale = F.element_at(F.create_map(*pairs), F.col(by).cast("string")) if pairs else F.lit(1.0)
    sides = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("side")
    keep = [] if by is None else [by]
    return costs.select(*keep, sides, F.exp(-F.col("cost") / scale).alias("score")).select(*keep, "side.a", "side.b", "score")
