"""Block matrices as tables: (i, j, m), m the bytes of a block of size x size doubles, row by row.

A square table of pairs becomes blocks by a dense index of its entities; edges are padded with zeros. Products join blocks on
the inner index and sum per place; the inverse runs block by block (Gauss-Jordan). No table of pairs reaches the driver or one task:
a task holds a few blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.steps import batches_of, dropped, stored
from fieldloom.operators.tables import index_entities

BLOCK = "i int, j int, m binary"
#: Panels of one step are broadcast up to so many bytes, joined by shuffle beyond.
MOST_PANEL = 64 << 20


def block_size(n: int) -> int:
    """At most some thirty steps of the inverse, and blocks of 0.5 to 32 MB."""
    return min(2048, max(256, -(-n // 32)))


def indexed(pairs: DataFrame) -> DataFrame:
    """(e, at): the entities of (a, b, score) numbered from 0; a written table."""
    ids = pairs.select(F.col("a").alias("e")).union(pairs.select("b")).distinct()
    return stored(index_entities(ids, "e").select("e", F.col("entity_index").cast("bigint").alias("at")), "matrix-index")


def from_pairs(pairs: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """Blocks of (a, b, score); repeated pairs add up. A task gathers one block at a time."""
    row, col = (index.select(F.col("e").alias(s), F.col("at").alias(f"at_{s}")) for s in "ab")
    cells = pairs.join(row, "a").join(col, "b").select(*[F.floor(F.col(f"at_{s}") / size).cast("int").alias(k) for s, k in (("a", "i"), ("b", "j"))], *[F.pmod(f"at_{s}", F.lit(size)).alias(s) for s in "ab"], F.col("score").cast("double").alias("v"))

    def pack(key: tuple, cells: pa.Table) -> pa.Table:
        m = np.zeros((size, size))
        np.add.at(m, (cells.column("a").to_numpy(), cells.column("b").to_numpy()), cells.column("v").to_numpy())
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "j": pa.array([key[1].as_py()], pa.int32()), "m": pa.array([m.tobytes()])})

    return cells.groupBy("i", "j").applyInArrow(pack, BLOCK)


def grid(df: DataFrame, side: int) -> DataFrame:
    """(i, j) of all places: as many rows as blocks, not as entities."""
    spark = df.sparkSession
    return spark.range(side * side).select((F.col("id") / side).cast("int").alias("i"), (F.col("id") % side).cast("int").alias("j"))


def mapped(df: DataFrame, size: int, f, blocks: tuple[str, ...] = ("m",), schema: str = BLOCK) -> DataFrame:
    """f of (i, j, the blocks of the row, null as None), one block out per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c) for c in ("i", "j", *blocks)]
            for r in range(len(batch)):
                i, j = cols[0][r].as_py(), cols[1][r].as_py()
                got = [np.frombuffer(c[r].as_buffer()).reshape(size, -1) if c[r].is_valid else None for c in cols[2:]]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([np.ascontiguousarray(f(i, j, *got)).tobytes()], pa.binary())], names=["i", "j", "m"])

    return df.select("i", "j", *blocks).mapInArrow(run, schema)


def summed(parts: DataFrame, size: int, side: int) -> DataFrame:
    """The sum of the blocks at each place; places without any are zero. Blocks of a place come one after the other and are added as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        told = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["i", "j", "m"])
        for batch in batches:
            for i, j, m in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("m"), strict=True):
                if at != (i, j):
                    if at is not None:
                        yield told()
                    at, total = (i, j), np.zeros((size, size))
                if m.is_valid:
                    total += np.frombuffer(m.as_buffer()).reshape(size, size)
        if at is not None:
            yield told()

    every = parts.unionByName(grid(parts, side).withColumn("m", F.lit(None).cast("binary")))
    return every.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, BLOCK)


def product(left: DataFrame, right: DataFrame, size: int, side: int, transposed: bool = False) -> DataFrame:
    """left times right, or left transposed times right; a written table."""
    inner, outer = ("i", "j") if transposed else ("j", "i")
    a = left.select(F.col(inner).alias("k"), F.col(outer).alias("i"), F.col("m").alias("x"))
    b = right.select(F.col("i").alias("k"), "j", F.col("m").alias("y"))
    with batches_of(left.sparkSession, 2 * 8 * size * size):
        parts = mapped(a.join(b.hint("merge"), "k"), size, lambda i, j, x, y: (x.T if transposed else x) @ y, ("x", "y"))
        return stored(summed(parts, size, side), "product")


def plus_diagonal(blocks: DataFrame, size: int, n: int, value: float) -> DataFrame:
    """value added on the diagonal; the padding gets 1 there, so that it can be inverted and touches nothing else."""

    def f(i: int, j: int, m: np.ndarray) -> np.ndarray:
        if i != j:
            return m
        return m + np.diag(np.where(np.arange(i * size, (i + 1) * size) < n, value, 1.0))

    return mapped(blocks, size, f)


def inverse(blocks: DataFrame, size: int, side: int) -> DataFrame:
    """The inverse of a symmetric positive definite matrix, by Gauss-Jordan steps over blocks; a written table.

    A step inverts one diagonal block and sends the block row and the block column of it to the blocks that they change: `side` steps, each one pass
    over the matrix. Definite matrices need no pivoting.
    """
    spark, now = blocks.sparkSession, blocks
    small = side * size * size * 8 <= MOST_PANEL
    with batches_of(spark, 3 * 8 * size * size):
        now = stored(now, "inverse")
        for k in range(side):
            pivot = now.filter((F.col("i") == k) & (F.col("j") == k)).select(F.col("m").alias("p"))
            # one row joined to the block row: the pivot
            row = mapped(now.filter(F.col("i") == k).crossJoin(F.broadcast(pivot)), size, lambda i, j, m, p, k=k: np.linalg.inv(p) if j == k else np.linalg.solve(p, m), ("m", "p"))
            row = stored(row, "panel")
            right = row.select("j", F.col("m").alias("r"))
            left = now.filter((F.col("j") == k) & (F.col("i") != k)).select("i", F.col("m").alias("c"))
            if small:
                right, left = F.broadcast(right), F.broadcast(left)
            met = now.join(right, "j", "left").join(left, "i", "left")

            def step(i: int, j: int, m: np.ndarray, c: np.ndarray | None, r: np.ndarray, k: int = k) -> np.ndarray:
                return r if i == k else (0.0 if j == k else m) - c @ r

            last, now = now, stored(mapped(met, size, step, ("m", "c", "r")), "inverse")
            dropped(last, row)
    return now


def diagonal(blocks: DataFrame, size: int) -> DataFrame:
    """(j, d): the diagonal, a vector of bytes per block."""
    with_d = mapped(blocks.filter("i = j"), size, lambda i, j, m: np.diag(m).copy())
    return with_d.select("j", F.col("m").alias("d"))


def top_pairs(blocks: DataFrame, index: DataFrame, size: int, n: int, k: int) -> DataFrame:
    """(a, b, score): the k largest entries of each row off the diagonal, ties to the smaller index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, m in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("m"), strict=True):
                m = np.frombuffer(m.as_buffer()).reshape(size, size)[: n - i * size, : n - j * size].copy()
                if i == j:
                    np.fill_diagonal(m, -np.inf)
                order = np.argsort(-m, axis=1, kind="stable")[:, :k]
                r = np.repeat(np.arange(len(m)), order.shape[1])
                score = np.take_along_axis(m, order, 1).ravel()
                kept = score > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array((r + i * size)[kept]), pa.array((order.ravel() + j * size)[kept]), pa.array(score[kept])], names=["ra", "rb", "score"])

    with batches_of(blocks.sparkSession, 8 * size * size):
        best = stored(blocks.mapInArrow(run, "ra bigint, rb bigint, score double"), "block-tops")
    rank = F.row_number().over(Window.partitionBy("ra").orderBy(F.desc("score"), "rb"))
    best = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    name = lambda s: index.select(F.col("at").alias(f"r{s}"), F.col("e").alias(s))
    return best.join(name("a"), "ra").join(name("b"), "rb").select("a", "b", "score")


def ease_kernel(scores: DataFrame, lam: float, k: int, size: int | None = None) -> DataFrame:
    """(a, b, score): closed-form re-ranking of a whole score table, the k best of each entity.

    With P the inverse of S'S + lam I, the weights are B = I - P / diag(P) by columns, and the result the symmetric part of S B.
    """
    index = indexed(scores)
    n = index.count()
    size = size or block_size(n)
    side = max(1, -(-n // size))
    spark = scores.sparkSession
    with batches_of(spark, 8 * size * size):
        s = stored(summed(from_pairs(scores.filter("a != b"), index, size), size, side), "kernel")
    gram = product(s, s, size, side, transposed=True)
    p = inverse(plus_diagonal(gram, size, n, lam), size, side)
    sp = product(s, p, size, side)
    with batches_of(spark, 4 * 8 * size * size):
        cut = lambda i, j, m, x, d: m - x / d.reshape(1, -1)
        d = stored(diagonal(p, size), "diagonal")
        both = s.join(sp.withColumnRenamed("m", "x").hint("merge"), ["i", "j"]).join(d, "j")
        out = stored(mapped(both, size, cut, ("m", "x", "d")), "weighed")
        back = out.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("m").alias("y"))
        sym = stored(mapped(out.join(back.hint("merge"), ["i", "j"]), size, lambda i, j, m, y: (m + y.T) / 2, ("m", "y")), "symmetric")
    top = top_pairs(sym, index, size, n, k)
    dropped(s, gram, p, sp, d, out)
    return top
