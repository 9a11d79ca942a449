"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector has a codebook of its own; the pair of codes is the vector's cell, so K centroids a half give K * K cells.
A query ranks the centroids of either half by their share of the measure (here the inner product, largest first) and walks
the pairs in descending sum with a heap, without ever sorting all pairs, until the cells passed hold `budget` entries.
Those entries are reranked by the measure itself on the original vectors.

Fitting. The codebooks are fitted on at most `sample` rows (those with the smallest hashes); every row is indexed. The budget is measured, not
guessed: for at most `tries` of the queries the true neighbours are found by brute force over all rows, and the budget
is the number of entries that a walk must pass to reach the share `recall` of them. So it follows the data: few entries where
vectors are clustered, many where they are spread evenly, and `recall` is what was measured on the tried queries.

Work. Entries are placed in the order of their cells and cut into shards of `shard` rows by prefix sums of the cells'
counts, which splits cells of any size. A query goes only to the shards that hold cells of its walk, and queries of like
cells go together in blocks; a shard meets a block of queries in one task, so both sides are bounded. Cell counts (K * K numbers at
most, K at most 1,024) and codebooks are broadcast; vectors never are, but for the tried queries.

Ties: scores are summed the same way for each row, so equal vectors have equal scores, and the smaller id comes first.

Defined results: rows with a null id, an empty or zero vector, null or non-finite components, or a length other than the most frequent
one take no part. Repeated rows, also of one id, are rows of their own: each is searched for, and finds the others. Fewer rows
than k: all of them. Without rows or queries the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Steps, tidy
from fieldloom.llm.vectors import best, matrix, usable

#: Scores of queries and entries that a task holds at once.
AT_ONCE = 1 << 21


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """At most k centroids; they begin as distinct points."""
    if not x.size:
        return np.zeros((min(1, len(x)), x.shape[1]))
    points = np.unique(x, axis=0)
    c = np.random.default_rng(seed).permutation(points)[:k].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c**2).sum(1)[None, :] - 2 * x[at : at + 4096] @ c.T).argmin(axis=1) for at in range(0, len(x), 4096)] or [np.zeros(0, dtype=np.int64)])


class Cells:
    """Codebooks of the halves, and the cells' counts and places in the order of cells."""

    def __init__(self, first: np.ndarray, second: np.ndarray, cut: int):
        self.first, self.second, self.cut = first, second, cut
        self.counts = self.starts = np.zeros(len(first) * len(second), dtype=np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.cut], self.first) * len(self.second) + nearest(x[:, self.cut :], self.second)

    def filled(self, cells: np.ndarray, counts: np.ndarray) -> Cells:
        self.counts = np.zeros(len(self.first) * len(self.second), dtype=np.int64)
        self.counts[cells] = counts
        self.starts = np.cumsum(self.counts) - self.counts
        return self

    def parts(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroids' shares of the measure, per half."""
        return q[: self.cut] @ self.first.T, q[self.cut :] @ self.second.T

    def walk(self, q: np.ndarray, budget: int) -> list[int]:
        """Cells with entries, by descending sum of the halves' shares, until they hold `budget` entries."""
        s, t = self.parts(q)
        a, b = np.argsort(-s, kind="stable"), np.argsort(-t, kind="stable")
        s, t, width = s[a].tolist(), t[b].tolist(), len(b)
        a, b, counts = (a * width).tolist(), b.tolist(), self.counts
        # of a row of pairs only the next one is in the heap; a row begins when the one above it has begun
        heap, out, seen = [(-(s[0] + t[0]), 0, 0)], [], 0
        while heap and seen < budget:
            _, i, j = heap[0]
            cell = a[i] + b[j]
            if n := counts.item(cell):
                out.append(cell)
                seen += n
            if j + 1 < width:
                heapq.heapreplace(heap, (-(s[i] + t[j + 1]), i, j + 1))
            else:
                heapq.heappop(heap)
            if j == 0 and i + 1 < len(s):
                heapq.heappush(heap, (-(s[i + 1] + t[0]), i + 1, 0))
        return out

    def passed(self, q: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many entries a walk has passed once it is through with each of the cells."""
        s, t = self.parts(q)
        sums = (s[:, None] + t[None, :]).ravel()
        order = np.argsort(-sums, kind="stable")
        total = np.empty(len(sums), dtype=np.int64)
        total[order] = np.cumsum(self.counts[order])
        return total[cells]


def reranked(q: np.ndarray, e: np.ndarray, ids: np.ndarray, seen: np.ndarray | None, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score): the k best entries per query among those it has seen, ties by smaller id.

    own: mask of pairs of a query and its own row.
    """
    if not (len(q) and len(e)):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    scores = q @ e.T
    if seen is not None:
        scores[~seen] = -np.inf
    if own is not None:
        scores[own] = -np.inf
    n = min(k, len(e))
    least = np.partition(scores, len(e) - n, axis=1)[:, len(e) - n]
    # all that may be among the best once sums are made alike
    near = 1e-12 * (1 + np.linalg.norm(q, axis=1) * np.linalg.norm(e, axis=1).max())
    at, found = np.nonzero((scores >= (least - near)[:, None]) & (scores > -np.inf))
    exact = np.concatenate([(q[at[i : i + 65536]] * e[found[i : i + 65536]]).sum(axis=1) for i in range(0, len(at), 65536)] or [np.zeros(0)])
    order = np.lexsort((ids[found], -exact, at))
    at, found, exact = at[order], found[order], exact[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at, side="left")
    return at[rank < k], found[rank < k], exact[rank < k]


class MultiIndex:
    """An index of all usable rows, written to the shared folder; `close` deletes it."""

    def __init__(self, rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None, centroids: int | None = None, sample: int = 16_384, shard: int = 8192):
        spark = rows.sparkSession
        self.steps, self.id_col, self.shard = Steps(spark), id_col, shard
        asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
        held = usable(rows, id_col, vector_col, asked.alias("asked"), zero=False)
        some = matrix(held.select("vector", F.xxhash64("id", "vector").alias("h")).orderBy("h").limit(sample).toArrow().column("vector").combine_chunks())
        if centroids is None:
            # some fifty entries a cell
            n = held.count()
            centroids = max(4, min(1024, 1 << round(np.log2(max(n, 768) / 48) / 2)))
        cut = some.shape[1] // 2
        self.cells = Cells(kmeans(some[:, :cut], centroids), kmeans(some[:, cut:], centroids), cut)
        sent = spark.sparkContext.broadcast(self.cells)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = sent.value.of(matrix(batch.column("vector")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int64))], names=[*batch.schema.names, "cell"])

        kinds = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in held.columns)
        self.entries = self.steps.stored(held.mapInArrow(code, f"{kinds}, cell bigint"), "multi-index")
        counts = self.entries.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asked").alias("asked")).toArrow()
        self.cells.filled(counts.column("cell").to_numpy(), counts.column("n").to_numpy())
        self.size, self.asked = int(self.cells.counts.sum()), int(counts.column("asked").to_numpy().sum())

    def brute(self, tries: int, k: int) -> DataFrame:
        """(query, cells): the cells of the true k best of at most `tries` queries, by brute force over all rows."""
        some = self.entries.filter("asked").select("row", "vector").orderBy(F.xxhash64(F.lit(3), "row"), "row").limit(tries).toArrow()
        rows, q = some.column("row").to_numpy(), matrix(some.column("vector").combine_chunks())
        sent = self.entries.sparkSession.sparkContext.broadcast((rows, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, q = sent.value
            for batch in batches:
                e, row, ids, cell = matrix(batch.column("vector")), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id", "cell"))
                for at in range(0, len(e), 1 << 14):
                    part = slice(at, at + (1 << 14))
                    a, b, score = reranked(q, e[part], ids[part], None, k, rows[:, None] == row[part][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(rows[a]), pa.array(score), pa.array(row[part][b]), pa.array(cell[part][b])], names=["query", "score", "row", "cell"])

        found = self.entries.select("row", "id", "vector", "cell").mapInArrow(run, "query bigint, score double, row bigint, cell bigint")
        top = best(found, ["query"], k, F.desc("score"), F.col("row")).groupBy("query").agg(F.collect_list("cell").alias("cells"))
        return top.join(self.entries.select(F.col("row").alias("query"), "vector"), "query")

    def calibrate(self, k: int, recall: float, tries: int) -> int:
        """Entries to pass so that the share `recall` of the tried queries' true neighbours is reached."""
        sent = self.entries.sparkSession.sparkContext.broadcast(self.cells)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for q, cells in zip(matrix(batch.column("vector")), batch.column("cells").to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(sent.value.passed(q, np.array(cells, dtype=np.int64)))], names=["n"])

        # at most `tries` times k numbers
        need = np.sort(self.brute(tries, k).select("vector", "cells").mapInArrow(run, "n bigint").toArrow().column("n").to_numpy())
        return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) if len(need) else k

    def search(self, k: int = 20, recall: float = 0.95, tries: int = 256, least: int = 1024, block: int = 8192, budget: int | None = None) -> DataFrame:
        """(query_id, rank, <id>, score) of the queries; a walk passes `least` entries at any rate, or `budget` if given."""
        if budget is None:
            budget = max(least, k, self.calibrate(k, recall, tries))
        sent, size, shard = self.entries.sparkSession.sparkContext.broadcast(self.cells), max(1, self.size), self.shard
        blocks = max(1, -(-self.asked // block))

        def place(cell: np.ndarray, row: np.ndarray) -> np.ndarray:
            """The entries' places in the order of cells, rows of one cell spread evenly over the cell's stretch."""
            c = sent.value
            spread = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            return c.starts[cell] + (spread % np.maximum(c.counts[cell], 1).astype(np.uint64)).astype(np.int64)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = place(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "row"))) // shard
                yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["shard", *batch.schema.names])

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = sent.value
                own = place(*(batch.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "row"))) * blocks // size
                for i, q in enumerate(matrix(batch.column("vector"))):
                    cells = np.sort(np.array(c.walk(q, budget), dtype=np.int64))
                    first, last = c.starts[cells] // shard, (c.starts[cells] + c.counts[cells] - 1) // shard
                    # a cell that reaches over shards is asked for in each of them; cells in order are shards in order
                    times = last - first + 1
                    every = np.repeat(cells, times)
                    to = np.repeat(first, times) + np.arange(len(every)) - np.repeat(np.cumsum(times) - times, times)
                    shards, begin = np.unique(to, return_index=True)
                    lists = [x.astype("<i4").tobytes() for x in np.split(every, begin[1:])]
                    same = np.zeros(len(shards), dtype=np.int64) + i
                    yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(own[same]), *(batch.column(x).take(pa.array(same)) for x in ("row", "id", "vector")), pa.array(lists, type=pa.binary())], names=["shard", "block", "row", "id", "vector", "cells"])

        kind = {c: self.entries.schema[c].dataType.simpleString() for c in self.entries.columns}
        asked = self.entries.filter("asked").select("row", "id", "vector", "cell").mapInArrow(route, f"shard bigint, block bigint, row bigint, id {kind['id']}, vector {kind['vector']}, cells binary")
        asked = self.steps.stored(asked, "walks")
        placed = self.entries.select("row", "id", "vector", "cell").mapInArrow(spread, f"shard bigint, row bigint, id {kind['id']}, vector {kind['vector']}, cell bigint")
        met = asked.select(F.col("shard").alias("shard"), F.col("block").alias("block")).distinct()
        placed = placed.join(met.hint("merge"), "shard")

        def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
            return _meet(left.combine_chunks(), right.combine_chunks(), k)

        found = asked.groupBy("shard", "block").cogroup(placed.groupBy("shard", "block")).applyInArrow(meet, f"query bigint, query_id {kind['id']}, score double, id {kind['id']}, row bigint")
        top = best(found, ["query"], k, F.desc("score"), F.col("id"), F.col("row"))
        return top.select("query_id", "rank", F.col("id").alias(self.id_col), "score")

    def close(self) -> None:
        self.steps.drop(*self.steps.tables)


def _meet(asked: pa.Table, placed: pa.Table, k: int) -> pa.Table:
    """A block of queries and a shard: entries of the cells that some walks of the block passed, scored together, each query's own ones kept."""
    names = ["query", "query_id", "score", "id", "row"]
    vectors = lambda t: matrix(t.column("vector").combine_chunks())
    ids, row, cell = (placed.column(c).to_numpy() for c in ("id", "row", "cell"))
    e, q, mine = vectors(placed), vectors(asked), asked.column("row").to_numpy()
    order = np.argsort(cell, kind="stable")
    e, ids, row, cell = e[order], ids[order], row[order], cell[order]
    here, begin = np.unique(cell, return_index=True)
    sizes = np.diff(np.append(begin, len(cell)))
    walks = [np.frombuffer(c, dtype="<i4") for c in asked.column("cells").to_pylist()]
    parts, step = [], max(1, AT_ONCE // max(1, len(e)))
    for at in range(0, len(q) if len(e) else 0, step):
        some = slice(at, at + step)
        passed = np.stack([np.isin(here, w, assume_unique=True) for w in walks[some]])
        any_ = np.flatnonzero(np.repeat(passed.any(axis=0), sizes))
        seen = np.repeat(passed, sizes, axis=1)[:, any_]
        a, b, score = reranked(q[some], e[any_], ids[any_], seen, k, mine[some][:, None] == row[any_][None, :])
        parts.append((a + at, any_[b], score))
    a, b, score = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64),) * 3
    kind = placed.schema.field("id").type
    return pa.table([pa.array(mine[a]), asked.column("id").take(pa.array(a)), pa.array(score.astype(np.float64)), pa.array(ids[b], type=kind), pa.array(row[b])], names=names)


@tidy
def search(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """(query_id, rank, <id>, score): each query row's k nearest found, by largest inner product; a written table."""
    index = MultiIndex(rows, id_col, vector_col, queries)
    steps = Steps(rows.sparkSession)
    out = steps.stored(index.search(k, **how), "neighbours")
    index.close()
    return out
