"""Hard-negative mining by slot-decomposed selection.

An anchor's positives are its nearest rows of the same label. Each positive opens a window of scores below its own: from
`low` to `high` per cent of it. The windows of one anchor overlap, so the same negative answers several of them. The
positives' upper limits, sorted, cut the scores into disjoint slots:

    above u1 (no window) | slot 0: (u2, u1] | slot 1: (u3, u2] | ... | last slot: up to the smallest limit

A row of another label falls into one slot. Combiners keep the best k per anchor and slot, in each task and then per anchor. As slots are
disjoint and descend, the best k below the i-th limit are the first k of slot i, slot i + 1, ... one after the other; a window's lower
limit only cuts off the end of that list. So one selection per slot answers all windows of an anchor exactly.

Scores are integer inner products: components are floor(scale * x). Anchors go through in blocks of about `block` rows (a bounded broadcast);
for each block the rows are read where they are, twice: for the positives, then for the slots. Nothing but the best rows of each
task is shuffled, and rows are never paired with rows, only with the stated anchors.

Defined results: rows with a null id, label or vector, an empty vector, null or non-finite components, or a length other than the most frequent one
take no part; a zero vector does (its scores are 0). Repeated rows, also of one id, are rows of their own. Ties go to the smaller id.
A positive score below zero has an empty window, zero admits zero only. An anchor without positives has no rows; an
empty table gives none. Scores beyond 64 bits saturate. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Steps, scratch, tidy
from fieldloom.llm.vectors import best, matrix, usable

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Scores of a block of anchors and rows that a task holds at once.
AT_ONCE = 1 << 21
FOUND = "anchor bigint, slot int, score bigint, id {id}, row bigint"


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles that are whole numbers, or Python's integers where doubles would round them."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * x)
    if not out.size or np.abs(out).max() < 2.0**53:
        return out
    big = [int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(np.longdouble(scale) * v)) for v in x.ravel().tolist()]
    return np.array(big, dtype=object).reshape(x.shape)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b, as 64-bit numbers or as Python's integers."""
    if not (len(a) and len(b)):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = lambda m: np.vectorize(int, otypes=[object])(m)
    return whole(a).dot(whole(b).T)


class Combiner:
    """Keeps the best k rows per anchor and slot of what it is given."""

    def __init__(self, k: int, limit: int = 1 << 20):
        self.k, self.limit, self.parts, self.size = k, limit, [], 0

    def add(self, *columns: np.ndarray) -> None:
        """anchor, slot, score, id, row."""
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > self.limit:
            self.parts = [self.table()]
            self.size = len(self.parts[0][0])
            self.limit = max(self.limit, 2 * self.size)

    def table(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
        anchor, slot, score, ids, row = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        # scores fit 64 bits here; their complement sorts descending
        order = np.lexsort((row, ids, ~score, slot, anchor))
        anchor, slot = anchor[order], slot[order]
        new = np.ones(len(anchor), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (slot[1:] != slot[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        kept = np.arange(len(new)) - first < self.k
        return anchor[kept], slot[kept], *(c[order][kept] for c in (score, ids, row))


def select(scores: np.ndarray, allowed: np.ndarray, uppers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, slot, column) of the k largest allowed scores in each slot, first columns first.

    uppers: the limits of each anchor's slots, descending; a score of more than the first is in no slot.
    """
    n = scores.shape[1]
    if scores.dtype == object or (scores.size and max(abs(int(scores.max())), abs(int(scores.min()))) >= (1 << 61) // n):
        # ranks among the scores stand for them
        values, scores = np.unique(scores, return_inverse=True)
        uppers = np.searchsorted(values, uppers, side="right") - 1
        scores = scores.reshape(allowed.shape)
    else:
        lo, hi = (int(scores.min()), int(scores.max())) if scores.size else (0, 0)
        uppers = np.clip(uppers, lo - 1, hi).astype(np.int64)
    keys = np.where(allowed, scores.astype(np.int64) * n + np.arange(n - 1, -1, -1), LEAST)
    keys.sort(axis=1)
    ends = [(keys < (uppers[:, j : j + 1] + 1) * n).sum(axis=1) for j in range(uppers.shape[1])]
    ends.append((~allowed).sum(axis=1))
    out = []
    for slot, (end, start) in enumerate(zip(ends, ends[1:], strict=False)):
        # the last limit may lie below what is not allowed
        at = end[:, None] - 1 - np.arange(k)[None, :]
        a, j = np.nonzero(at >= np.maximum(start, ends[-1])[:, None])
        out.append((a, np.full(len(a), slot), n - 1 - keys[a, at[a, j]] % n))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _scan(rows: DataFrame, anchors: dict, k: int, scale: int) -> DataFrame:
    """(anchor, slot, score, id, row): the best k per anchor and slot in each task.

    anchors: row, label, x and, for negatives, uppers; without uppers rows of the anchor's own label are asked for.
    """
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found, kind = sent.value, Combiner(k), None
        x, uppers = own["x"], own.get("uppers")
        codes = {label: c for c, label in enumerate(dict.fromkeys(own["label"]))}
        mine = np.array([codes[label] for label in own["label"]])
        for batch in batches:
            kind = batch.schema.field("id").type
            ids, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
            order = np.lexsort((row, ids))
            ids, row = ids[order], row[order]
            theirs = np.array([codes.get(label, -1) for label in batch.column("label").to_pylist()])[order]
            m = scaled(matrix(batch.column("vector")), scale)[order]
            step = max(1, AT_ONCE // max(1, len(m)))
            if uppers is None:
                parts = [(np.flatnonzero(mine == c), np.flatnonzero(theirs == c)) for c in np.intersect1d(mine, theirs)]
            else:
                parts = [(np.arange(len(x)), np.arange(len(m)))]
            for who, cols in parts:
                for at in range(0, len(who), step):
                    some = who[at : at + step]
                    scores = inner(x[some], m[cols])
                    if uppers is None:
                        allowed, limits = own["row"][some][:, None] != row[cols][None, :], np.full((len(some), 1), MOST, dtype=object)
                    else:
                        allowed, limits = mine[some][:, None] != theirs[cols][None, :], uppers[some]
                    a, slot, c = select(scores, allowed, limits, k)
                    value = np.array([min(max(int(v), LEAST), MOST) for v in scores[a, c]], dtype=np.int64) if scores.dtype == object else scores[a, c]
                    found.add(own["row"][some][a], slot, value, ids[cols][c], row[cols][c])
        if kind is not None:
            anchor, slot, score, ids, row = found.table()
            for at in range(0, len(anchor), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[part]), pa.array(slot[part].astype(np.int32)), pa.array(score[part]), pa.array(ids[part], type=kind), pa.array(row[part])],
                    names=["anchor", "slot", "score", "id", "row"],
                )

    return rows.mapInArrow(run, FOUND.format(id=rows.schema["id"].dataType.simpleString()))


@tidy
def mine(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: int = 256, block: int = 16_384,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), a written table.

    anchors: a condition on rows. A negative's score s answers a positive of score p if low * p <= 100 * s <= high * p.
    """
    steps = Steps(rows.sparkSession)
    held = usable(rows.filter(F.col(label_col).isNotNull()), id_col, vector_col, F.col(label_col).alias("label"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"), zero=True)
    held = steps.stored(held, "vectors")
    asked = held.filter("is_anchor")
    blocks = max(1, -(-asked.count() // block))
    path = scratch(rows.sparkSession, "negatives")
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        _mined(held, own, steps, positives, k, low, high, scale).write.mode("append").parquet(path)
        steps.drop(*steps.tables[1:])
    out = rows.sparkSession.read.parquet(path)
    steps.drop(held)
    return out


def _mined(held: DataFrame, own: DataFrame, steps: Steps, positives: int, k: int, low: int, high: int, scale: int) -> DataFrame:
    """One block of anchors against all rows."""
    got = own.select("row", "label", "vector").orderBy("row").toArrow()
    sent = {"row": got.column("row").to_numpy(), "label": got.column("label").to_pylist(), "x": scaled(matrix(got.column("vector").combine_chunks()), scale)}
    order = (F.desc("score"), F.col("id"), F.col("row"))
    near = best(_scan(held, sent, positives, scale), ["anchor"], positives, *order)
    near = steps.stored(near.select("anchor", (F.col("rank") - 1).alias("at"), "id", "score"), "positives")
    place = {row: i for i, row in enumerate(sent["row"].tolist())}
    uppers = np.full((len(place), positives), LEAST, dtype=object)
    for r in near.select("anchor", "at", "score").toArrow().to_pylist():
        uppers[place[r["anchor"]], r["at"]] = r["score"] * high // 100
    slots = best(_scan(held, sent | {"uppers": uppers}, k, scale), ["anchor", "slot"], k, *order)
    # per anchor at most `positives` slots of k rows: one descending list, whose suffixes answer the windows
    lists = slots.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "rank", "id", "score"))).alias("all"))
    lists = steps.stored(lists, "slots")
    wide = lambda c: c.cast("decimal(38,0)")
    suffix = F.slice(F.filter("all", lambda e: e["slot"] >= F.col("at")), 1, k)
    inside = F.filter(suffix, lambda e: wide(e["score"]) * 100 >= wide(F.col("score")) * low)
    named = own.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    told = near.join(lists, "anchor").join(named, "anchor").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(inside).alias("n", "e"))
    return told.select("anchor_id", "positive_id", (F.col("n") + 1).alias("rank"), F.col("e.id").alias("negative_id"), "positive_score", F.col("e.score").alias("negative_score"))
