"""Distances, exact neighbours, kernels, transport and re-ranking over observation vectors.

Matrices of feature size (d x d, d x D, D x D) may reach the driver; tables of observations and entities never do. Pair work
runs over blocks: rows are packed into blocks of bounded size, pairs of blocks are joined, numpy works inside a pair of
blocks, and only the best k per row leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("euclidean", "sqeuclidean", "manhattan", "cosine", "mahalanobis")


def dist(a: Column, b: Column, kind: str, root: np.ndarray | None = None) -> Column:
    """Distance of two array columns; mahalanobis needs the root that `fit_whitening` gives."""
    if kind == "mahalanobis":
        if root is None:
            raise ValueError("mahalanobis needs the root of a fitted whitening")
        apart = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        parts = [F.aggregate(F.zip_with(apart, F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x * w), F.lit(0.0), lambda s, v: s + v) for row in root]
        return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    d = lambda f: total(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))
    if kind == "euclidean":
        return F.sqrt(d(lambda x, y: (x - y) * (x - y)))
    if kind == "sqeuclidean":
        return d(lambda x, y: (x - y) * (x - y))
    if kind == "manhattan":
        return d(lambda x, y: F.abs(x - y))
    norm = lambda c: F.sqrt(total(F.transform(c, lambda v: v.cast("double") * v.cast("double"))))
    unit = lambda c: F.when(c == 0, 1.0).otherwise(c)
    return F.lit(1.0) - d(lambda x, y: x * y) / (unit(norm(a)) * unit(norm(b)))


def block_distances(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    if kind == "manhattan":
        return np.stack([np.abs(b - row).sum(1) for row in a])
    if kind == "cosine":
        unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
        return 1 - unit(a) @ unit(b).T
    sq = np.stack([((b - row) ** 2).sum(1) for row in a])
    return sq if kind == "sqeuclidean" else np.sqrt(sq)


def blocks(df: DataFrame, key: str, x: str, n: int) -> DataFrame:
    """Rows packed into n blocks by a hash of the key: block, keys, xs."""
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n))).groupBy("block").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(x).cast("array<double>").alias("x"))).alias("rows"))


def knn(base: DataFrame, query: DataFrame, k: int, kind: str = "euclidean", key: str = "id", x: str = "x", block_rows: int = 2048, root: np.ndarray | None = None) -> DataFrame:
    """(key, neighbour, distance, rank): the k nearest other rows of base per row of query, ties by id.

    A base of one block meets each block of queries at once; a larger one is searched by pivot cells (`neighbours`), which gives the same rows.
    """
    if kind == "mahalanobis":
        if root is None:
            raise ValueError("mahalanobis needs the root of a fitted whitening")
        base, query, kind, x = whiten(base, x, root, key), whiten(query, x, root, key), "euclidean", "x"
    if base.count() > block_rows:
        from fieldloom.operators.neighbours import knn_pruned  # built on this module

        return knn_pruned(base, query, k, kind, key, x, block_rows)
    n_query = max(1, -(-query.count() // block_rows))
    left = blocks(query, key, x, n_query).select(F.lit(0).alias("b"), F.col("rows").alias("qs"))
    right = blocks(base, key, x, 1).select(F.lit(0).alias("b"), F.col("rows").alias("bs"))
    pairs = left.join(F.broadcast(right), "b").select("qs", "bs")
    kind_sql = base.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for qs, bs in zip(frame["qs"], frame["bs"], strict=True):
                qk, bk = np.array([r["k"] for r in qs]), np.array([r["k"] for r in bs])
                d = block_distances(np.stack([r["x"] for r in qs]), np.stack([r["x"] for r in bs]), kind)
                d[qk[:, None] == bk[None, :]] = np.inf
                order = np.lexsort((np.broadcast_to(bk, d.shape), d), axis=1)[:, :k]
                got = np.take_along_axis(d, order, 1)
                out = pd.DataFrame({"id": np.repeat(qk, order.shape[1]), "neighbour": bk[order].ravel(), "distance": got.ravel()})
                yield out[np.isfinite(out["distance"])]

    best = pairs.mapInPandas(run, f"id {kind_sql}, neighbour {kind_sql}, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("distance", 9), "neighbour"))
    return best.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k).withColumnRenamed("id", key)


def moments(df: DataFrame, x: str, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and outer-product sum of a vector column: one d x d matrix per partition is summed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, m = 0, np.zeros(d), np.zeros((d, d))
        for frame in frames:
            if len(frame):
                a = np.stack(frame["x"].to_numpy()).astype(float)
                n, s, m = n + len(a), s + a.sum(0), m + a.T @ a
        yield pd.DataFrame({"i": np.arange(d), "n": n, "s": s, "m": list(m)})

    parts = df.select(F.col(x).cast("array<double>").alias("x")).mapInPandas(run, "i int, n bigint, s double, m array<double>")
    got = parts.select("i", "n", "s", F.posexplode("m").alias("j", "v")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v")).toPandas()
    m, s = np.zeros((d, d)), np.zeros(d)
    m[got["i"], got["j"]] = got["v"]
    s[got["i"]] = got["s"]
    return int(got["n"].max() if len(got) else 0), s, m


def fit_whitening(df: DataFrame, x: str, d: int, ridge: float = 1e-3) -> np.ndarray:
    """Symmetric root of the inverse covariance (n - 1), eigenvalues floored at ridge times their mean; identity for fewer than two rows."""
    n, s, m = moments(df, x, d)
    if n < 2:
        return np.eye(d)
    values, vectors = np.linalg.eigh((m - np.outer(s, s) / n) / (n - 1))
    if values.mean() <= 0:
        return np.eye(d)
    return (vectors / np.sqrt(np.maximum(values, ridge * values.mean()))) @ vectors.T


def mapped(df: DataFrame, x: str, f, *keep: str, out: str = "x") -> DataFrame:
    """keep columns and f(matrix of x) as an array column; f works on blocks of rows."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame[list(keep)].assign(**{out: list(f(np.stack(frame["__x"].to_numpy()).astype(float)))})

    return df.select(*keep, F.col(x).cast("array<double>").alias("__x")).mapInPandas(run, f"{kinds}, {out} array<double>")


def whiten(df: DataFrame, x: str, root: np.ndarray, *keep: str) -> DataFrame:
    return mapped(df, x, lambda a: a @ root, *keep)


def kernel_width(df: DataFrame, key: str, x: str, kind: str = "euclidean", seed: int = 7, sample: int = 2000) -> float:
    """Median heuristic over the pairs of a bounded sample (the rows of smallest hash); 1 if there is no positive distance."""
    rows = df.select(key, F.col(x).cast("array<double>").alias("x")).orderBy(F.xxhash64(F.lit(seed), key), key).limit(sample)
    found = [r.x for r in rows.select("x").collect()]  # at most `sample` rows
    if len(found) < 2:
        return 1.0
    v, kind = np.array(found, dtype=float), "manhattan" if kind == "manhattan" else "sqeuclidean"
    d = np.concatenate([block_distances(v[i : i + 1], v[i + 1 :], kind)[0] for i in range(len(v) - 1)])
    d = d[d > 0]
    return 1.0 if not len(d) else float(np.median(d) if kind == "manhattan" else np.sqrt(np.median(d) / 2))


def omega(d: int, dim: int, sigma: float, seed: int, kind: str = "euclidean") -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = rng.standard_cauchy((d, dim)) / sigma if kind == "manhattan" else rng.normal(0, 1 / sigma, (d, dim))
    return w, rng.uniform(0, 2 * np.pi, dim)


def rff(df: DataFrame, x: str, d: int, dim: int, sigma: float, *keep: str, seed: int = 7, kind: str = "euclidean") -> DataFrame:
    """Random Fourier features of the kernel of that width."""
    w, b = omega(d, dim, sigma, seed, kind)
    return mapped(df, x, lambda a: np.sqrt(2 / dim) * np.cos(a @ w + b), *keep)


def embed_entities(features: DataFrame, entity: str, mass: str, x: str = "x") -> DataFrame:
    """(entity, mass, x): mass-weighted mean vectors. Sums are made per partition and entity first."""
    kind, dim = features.schema[entity].dataType.simpleString(), "array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            a, w = np.stack(frame["x"].to_numpy()) if len(frame) else np.zeros((0, 1)), frame["m"].to_numpy(float)
            keys, at = np.unique(frame["e"].to_numpy(), return_inverse=True)
            sums = np.zeros((len(keys), a.shape[1]))
            np.add.at(sums, at, a * w[:, None])
            yield pd.DataFrame({"e": keys, "m": np.bincount(at, weights=w, minlength=len(keys)), "x": list(sums)})

    parts = features.select(F.col(entity).alias("e"), F.col(mass).cast("double").alias("m"), F.col(x).alias("x")).mapInPandas(run, f"e {kind}, m double, x {dim}")
    by = parts.select("e", "m", F.posexplode("x").alias("i", "v")).groupBy("e", "i").agg(F.sum("v").alias("v"), F.sum("m").alias("m"))
    unit = F.coalesce(F.nullif(F.first("m"), F.lit(0.0)), F.lit(1.0))
    return by.groupBy("e").agg(F.first("m").alias("mass"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("x"), unit.alias("u")).select(F.col("e").alias(entity), "mass", F.transform("x", lambda v: v / F.col("u")).alias("x"))


def normalized(df: DataFrame, x: str = "x") -> DataFrame:
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return df.withColumn("__n", F.when(n == 0, 1.0).otherwise(n)).withColumn(x, F.transform(x, lambda v: v / F.col("__n"))).drop("__n")


def pair_divergence(a: DataFrame, b: DataFrame, key: str, score, block_rows: int | None = None) -> DataFrame:
    """One row (max_abs, top) over all pairs of different rows: the largest difference of the scores in a and b, and the largest absolute score in b.

    score is a function of two blocks of rows; a row that one side lacks and undefined scores count as 0. No pairs are emitted.
    block_rows: rows of a tile, if not by bytes.
    """
    from fieldloom.operators.steps import stored
    from fieldloom.operators.tiles import LEFT, RIGHT, all_pairs, ids

    both = stored(a.select(F.col(key).alias("id"), F.col("x").alias("xa")).join(b.select(F.col(key).alias("id"), F.col("x").alias("xb")), "id", "full_outer"), "both")
    first = both.select(F.greatest(F.size("xa"), F.size("xb")).alias("d")).first()

    d = first.d if first else 1

    def filled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a side, of zeros where it has none, and which ones it has."""
        have = column.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((len(have), d))
        out[have] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        return out, have

    def make(t: pa.Table) -> tuple:
        return (ids(t.column("id").combine_chunks()), *[filled(t.column(c).combine_chunks()) for c in ("xa", "xb")])

    def side(q: tuple, r: tuple, part: slice) -> np.ndarray:
        out = np.nan_to_num(score(q[0], r[0][part]), nan=0.0)
        out[~q[1]], out[:, ~r[1][part]] = 0, 0
        return out

    def run(batches: Iterator[pa.RecordBatch], tile: tuple) -> Iterator[pa.RecordBatch]:
        far, top = 0.0, 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, LEFT):
                piece = batch.slice(at, LEFT)
                own, q = ids(piece.column("id")), [filled(piece.column(c)) for c in ("xa", "xb")]
                for n in range(0, len(tile[0]), RIGHT):
                    part = slice(n, n + RIGHT)
                    s, t = (side(q[i], tile[1 + i], part) for i in (0, 1))
                    same = own[:, None] == tile[0][None, part]
                    s[same], t[same] = 0, 0
                    far, top = max(far, np.abs(s - t).max()), max(top, np.abs(t).max())
        yield pa.RecordBatch.from_arrays([pa.array([far]), pa.array([top])], names=["max_abs", "top"])

    found = all_pairs(both, 16 * d + 64, make, run, "max_abs double, top double", block_rows)
    return found.agg(F.max("max_abs").alias("max_abs"), F.max("top").alias("top"))


def pair_scores(left: DataFrame, right: DataFrame, key: str, score, k: int, block_rows: int | None = None) -> DataFrame:
    """(a, b, score, rank): the k best other rows per row of left, by a function of two blocks of rows; zero scores are left out, ties by larger id.

    block_rows: rows of a tile, if not by bytes.
    """
    from fieldloom.operators.tiles import best_pairs

    return best_pairs(left, right, key, score, k, block_rows)


def mmd_similarity(embedded: DataFrame, entity: str, k: int) -> DataFrame:
    """Cosine of mean embeddings, the k best per entity."""
    unit = normalized(embedded)
    return pair_scores(unit, unit, entity, lambda a, b: a @ b.T, k)


def ease_rerank(embedded: DataFrame, entity: str, dim: int, lam: float, k: int) -> DataFrame:
    """Closed-form re-ranking of the cosine similarity in low-rank form.

    With unit rows M, S = M M' - I. One Gram matrix (dim x dim) is summed over the partitions and decomposed; each entity gets its
    row of U = M V e^(-1/2), and a pair's score needs those two rows only. No entity x entity matrix is made or inverted.
    """
    unit = normalized(embedded.filter("mass > 0"))
    _, _, gram = moments(unit, "x", dim)
    e, v = np.linalg.eigh(gram)
    kept = e > 1e-10 * e.max()
    e, v = e[kept], v[:, kept]
    q = 1 / ((e - 1) ** 2 + lam)
    h, g = q - 1 / (1 + lam), (e - 1) * q + 1 / (1 + lam)
    u = mapped(unit, "x", lambda a: (a @ v) / np.sqrt(e), entity)

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pa, pb = 1 / (1 + lam) + a**2 @ h, 1 / (1 + lam) + b**2 @ h
        s, sp = (a * e) @ b.T, (a * g) @ b.T
        return s - sp * (1 / pa[:, None] + 1 / pb[None, :]) / 2

    return pair_scores(u, u, entity, score, k)


def nn_elastic_net(a: np.ndarray, y: np.ndarray, beta: float, l1: float, max_iter: int = 200, tol: float = 1e-4, start: np.ndarray | None = None) -> np.ndarray:
    """Non-negative weights of the columns of a for y: coordinate descent on half the squared error + beta/2 L2 + l1 L1."""
    gram, rhs = a.T @ a, a.T @ y
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    for _ in range(max_iter):
        most = 0.0
        for j in range(len(w)):
            new = max(0.0, (rhs[j] - gram[j] @ w + gram[j, j] * w[j] - l1) / (gram[j, j] + beta)) if gram[j, j] + beta > 0 else 0.0
            most = max(most, abs(new - w[j]))
            w[j] = new
        if most < tol:
            break
    return w


def nn_l1_net(a: np.ndarray, y: np.ndarray, beta: float, l1: float, start: np.ndarray | None = None, passes: int = 8, least: float = 1e-6, tol: float = 1e-4) -> np.ndarray:
    """As nn_elastic_net, the residual in the absolute norm: squares reweighted by the last pass's residuals, held at `least`."""
    scale, w = np.ones(len(y)), start
    for _ in range(passes):
        last, w = w, nn_elastic_net(a * scale[:, None], y * scale, beta, l1, start=w)
        if last is not None and (not len(w) or np.abs(w - last).max() < tol):
            break
        scale = np.maximum(np.abs(y - a @ w), least) ** -0.5
    return w


def nn_elastic_nets(gram: np.ndarray, rhs: np.ndarray, beta: float, l1: float, max_iter: int = 200, tol: float = 1e-4, start: np.ndarray | None = None) -> np.ndarray:
    """nn_elastic_net of many rows at once, each until it stands still: gram (row, k, k), rhs (row, k)."""
    out = np.zeros(rhs.shape) if start is None else start.copy()
    live, g, r, w = np.arange(len(rhs)), gram, rhs, out.copy()
    for _ in range(max_iter):
        most = np.zeros(len(live))
        for j in range(rhs.shape[1]):
            own = g[:, j, j]
            with np.errstate(divide="ignore", invalid="ignore"):
                new = np.where(own + beta > 0, np.maximum(0.0, (r[:, j] - (g[:, j] * w).sum(1) + own * w[:, j] - l1) / (own + beta)), 0.0)
            most = np.maximum(most, np.abs(new - w[:, j]))
            w[:, j] = new
        done = most < tol
        if done.any():
            out[live[done]] = w[done]
            live, g, r, w = live[~done], g[~done], r[~done], w[~done]
        if not len(live):
            break
    out[live] = w
    return out


def nn_l1_nets(a: np.ndarray, y: np.ndarray, beta: float, l1: float, start: np.ndarray | None = None, passes: int = 8, least: float = 1e-6, tol: float = 1e-4) -> np.ndarray:
    """nn_l1_net of many rows at once: a (row, k, d), y (row, d)."""
    scale, out, live = np.ones(y.shape), start, np.arange(len(y))
    for n in range(passes):
        last, m = None if out is None else out[live], a[live] * scale[live][:, None, :]
        w = nn_elastic_nets(m @ m.transpose(0, 2, 1), (m @ (y[live] * scale[live])[:, :, None])[:, :, 0], beta, l1, start=last)
        out = w if out is None else out.copy() if n == 0 else out
        out[live] = w
        if last is not None:
            live = live[np.abs(w - last).max(1, initial=0.0) >= tol]
        if not len(live):
            break
        scale[live] = np.maximum(np.abs(y[live] - (out[live][:, None, :] @ a[live])[:, 0]), least) ** -0.5
    return out


#: Bytes of neighbours' vectors that are brought to their rows at once.
ROUND_BYTES = 1 << 30


def slim_weights(obs: DataFrame, key: str, x: str, k: int, beta: float, l1: float, kind: str = "euclidean", base: DataFrame | None = None, start: DataFrame | None = None, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(r, s, w): each observation rebuilt from its k nearest ones with positive weights; rows are solved together, each by its own regression.

    Neighbours come from `base` (obs itself unless given); the residual is absolute for the manhattan distance. `start` (r, s, w)
    are earlier weights to begin from; neighbours that it lacks begin at 0. Vectors are brought to the rows in rounds of bounded size,
    whose weights are written; a round's shuffles are given up before the next one.
    """
    from fieldloom.operators.steps import released, stored  # the neighbours' module is built on this one

    base = obs if base is None else base
    near = stored(knn(base, obs, k, kind, key, x).select(F.col(key).alias("r"), F.col("neighbour").alias("s")), "slim-near")
    first = base.select(F.size(x).alias("d")).first()
    rounds = max(1, -(-near.count() * (8 * (first.d if first else 1) + 16) // round_bytes))
    warm, kind_sql = start is not None, obs.schema[key].dataType.simpleString()
    vectors = base.select(F.col(key).alias("s"), F.col(x).cast("array<double>").alias("v"))
    own = obs.select(F.col(key).alias("r"), F.col(x).cast("array<double>").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                n, r, y = piece.column("n"), piece.column("r"), piece.column("y")
                sizes, each = np.diff(n.offsets.to_numpy()), n.flatten()
                y = y.flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
                row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                # rows with fewer neighbours get columns of zeros, whose weights stay 0
                a, w0 = np.zeros((len(sizes), sizes.max(initial=0), y.shape[1])), np.zeros((len(sizes), sizes.max(initial=0)))
                a[row, place] = each.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(each), -1)
                w0[row, place] = each.field("w0").to_numpy(zero_copy_only=False)
                if kind == "manhattan":
                    w = nn_l1_nets(a, y, beta, l1, start=w0 if warm else None)
                else:
                    w = nn_elastic_nets(a @ a.transpose(0, 2, 1), (a @ y[:, :, None])[:, :, 0], beta, l1, start=w0 if warm else None)
                w = w[row, place]
                kept = pa.array(np.flatnonzero(w > 0))
                yield pa.RecordBatch.from_arrays([r.take(pa.array(row)).take(kept), each.field("s").take(kept), pa.array(w).take(kept)], names=["r", "s", "w"])

    out = []
    for i in range(rounds):
        some = lambda t: t if rounds == 1 else t.filter(F.pmod(F.xxhash64(F.lit(13), "r"), F.lit(rounds)) == i)  # noqa: B023, E731
        mine = some(near)
        mine = mine.withColumn("w0", F.lit(0.0)) if start is None else mine.join(some(start.select("r", "s", F.col("w").alias("w0"))), ["r", "s"], "left").na.fill(0.0, ["w0"])
        packed = mine.join(vectors, "s").groupBy("r").agg(F.array_sort(F.collect_list(F.struct("s", "v", "w0"))).alias("n")).join(some(own), "r")
        out.append(stored(packed.select("r", "n", "y").mapInArrow(run, f"r {kind_sql}, s {kind_sql}, w double"), "slim"))
        del mine, packed
        if rounds > 1:
            released(base.sparkSession)
    return reduce(DataFrame.unionByName, out)


def aggregate_weights(w: DataFrame, obs: DataFrame, key: str, entity: str, mass: str, symmetric: bool = True) -> DataFrame:
    """(a, b, score): observation weights summed to entities by mass over the product of the entities' masses."""
    o = obs.select(F.col(key).alias("o"), F.col(entity).alias("e"), F.col(mass).cast("double").alias("m"))
    total = o.groupBy("e").agg(F.sum("m").alias("t"))
    r, s = o.select(F.col("o").alias("r"), F.col("e").alias("a"), F.col("m").alias("mr")), o.select(F.col("o").alias("s"), F.col("e").alias("b"), F.col("m").alias("ms"))
    sums = w.join(r, "r").join(s, "s").groupBy("a", "b").agg(F.sum(F.col("w") * F.col("mr") * F.col("ms")).alias("v")).filter("a != b")
    t = lambda n: total.select(F.col("e").alias(n), F.col("t").alias(f"t{n}"))
    one = sums.join(t("a"), "a").join(t("b"), "b").select("a", "b", (F.col("v") / (F.col("ta") * F.col("tb"))).alias("score"))
    if not symmetric:
        return one
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).groupBy("a", "b").agg((F.sum("score") / 2).alias("score"))
