"""Vector searches against brute force: recall, ties, windows, odd rows and extreme numbers."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import multi_index, negatives, queries

VECTORS = "vec_id bigint, embedding array<float>, label int, score double, rank string, row bigint, Cell int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 0.0, "r", 1, 2) for i, v, label in rows], VECTORS)


def odd_vectors():
    same = [1.0, 2.0, 0.0, -1.0]
    return [
        (20, same, 1), (40, same, 1), (41, same, 2), (7, same, 1), (20, same, 1), (60, [0.0, 0.0, 0.0, 0.0], 1), (80, None, 1), (100, [1.0, None, 0.0, 2.0], 1),
        (120, [float("nan"), 0.0, 0.0, 1.0], 1), (140, [float("inf"), 0.0, 0.0, 1.0], 1), (160, [], 1), (180, [1.0, 2.0], 1), (None, same, 1), (200, [-1.0, 0.5, 3.0, 1.0], None), (3, [0.5, 0.5, 0.25, -4.0], 2),
    ]


def usable_rows(rows, zero):
    return [(i, np.array(v, dtype=np.float32).astype(float), label) for i, v, label in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


def brute_neighbours(rows, k):
    own, out = usable_rows(rows, zero=False), []
    for a, (i, x, _) in enumerate(own):
        if i % 20 == 0:
            found = sorted((-float((x * y).sum()), j) for b, (j, y, _) in enumerate(own) if b != a)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out)


def test_neighbours_of_odd_rows(spark):
    rows = odd_vectors()
    for k in (2, 20):
        got = multi_index.search(table_of(spark, rows), F.col("vec_id") % 20 == 0, k)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == brute_neighbours(rows, k)
    none = table_of(spark, [])
    assert multi_index.search(none, F.col("vec_id") % 20 == 0).count() == 0
    assert multi_index.search(table_of(spark, rows[2:4]), F.col("vec_id") % 20 == 0).count() == 0
    one = table_of(spark, [(20, [1.0, 2.0, 3.0, 4.0], 1)])
    assert multi_index.search(one, F.col("vec_id") % 20 == 0).count() == 0


def test_one_dimension_and_string_ids(spark):
    rows = spark.createDataFrame([(f"v{i:02}", [float(i)]) for i in range(-3, 40)], "vec_id string, embedding array<double>")
    got = multi_index.search(rows, F.col("vec_id") == "v05", 3).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [("v05", 1, "v39", 195.0), ("v05", 2, "v38", 190.0), ("v05", 3, "v37", 185.0)]


@pytest.mark.parametrize("kind", ["even", "clustered", "copies"])
def test_recall_against_brute_force(spark, kind):
    """The share of true neighbours found by walks alone is what was asked for, and clustered vectors need few entries."""
    rng = np.random.default_rng(5)
    n, d = 6000, 32
    x = rng.normal(size=(n, d))
    if kind == "clustered":
        x = rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.15 * rng.normal(size=(n, d))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    if kind == "copies":
        x[::3] = x[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    index = multi_index.MultiIndex(rows, queries=F.col("vec_id") % 20 == 0, shard=512)
    got = index.search(20, recall=0.95, tries=64, least=1, block=100).collect()
    q = np.arange(0, n, 20)
    assert len(got) == 20 * len(q)
    scores = x[q].astype(float) @ x.astype(float).T
    scores[np.arange(len(q)), q] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores.round(12)), axis=1)[:, :20]
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = sum(len({v for v, _ in found[int(a)].values()} & set(o.tolist())) for a, o in zip(q, order, strict=True))
    assert hits >= (0.95 if kind == "clustered" else 0.9) * order.size
    for a in q[:50]:
        for rank in range(1, 21):
            v, s = found[int(a)][rank]
            assert abs(s - float(x[a].astype(float) @ x[v].astype(float))) < 1e-12
            assert rank == 1 or (-found[int(a)][rank - 1][1], found[int(a)][rank - 1][0]) < (-s, v)
    budget = index.calibrate(20, 0.95, 64)
    if kind == "clustered":
        assert budget < 0.1 * n
    if kind == "copies":
        # the smallest ids of two thousand equal scores
        assert [found[0][r][0] for r in range(1, 21)] == list(range(3, 63, 3))
    index.close()


def test_walk_is_in_descending_order_of_sums():
    rng = np.random.default_rng(1)
    cells = multi_index.Cells(rng.normal(size=(7, 3)), rng.normal(size=(5, 2)), 3)
    counts = rng.integers(0, 4, 35)
    cells.filled(np.flatnonzero(counts), counts[counts > 0])
    q = rng.normal(size=5)
    sums = (q[:3] @ cells.first.T)[:, None] + (q[3:] @ cells.second.T)[None, :]
    order = [c for c in np.argsort(-sums.ravel(), kind="stable") if counts[c]]
    assert cells.walk(q, 10**9) == order
    for budget in (1, 5, 20):
        walk = cells.walk(q, budget)
        assert walk == order[: len(walk)] and counts[walk].sum() >= budget > counts[walk[:-1]].sum()
        assert cells.passed(q, np.array([walk[-1]]))[0] == counts[walk].sum()


def brute_negatives(rows, positives=5, k=10, low=30, high=90):
    own = [(i, [math.floor(256 * v) if abs(v) < 2**53 else int(v) * 256 for v in x.tolist()], label) for i, x, label in usable_rows(rows, zero=True) if label is not None]
    out = []
    for a, (i, x, label) in enumerate(own):
        if i % 100 == 0:
            scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j, b, other) for b, (j, y, other) in enumerate(own) if b != a)
            for minus, j, _, _ in [s for s in scored if s[3] == label][:positives]:
                fit = [s for s in scored if s[3] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus][:k]
                out += [(i, j, rank, s[1], -minus, -s[0]) for rank, s in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [16_384, 3])
def test_negatives_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    # few values, so that many scores are equal; some labels rare, a row repeated, odd rows between
    rows = [(int(i), (rng.integers(-2, 5, 4) / 4).tolist(), int(rng.choice([0, 0, 0, 1, 1, 2, 9]))) for i in rng.permutation(900)]
    rows += [rows[3], *odd_vectors(), (300, rows[0][1], 0)]
    want = brute_negatives(rows)
    assert len(want) > 200
    got = negatives.mine(table_of(spark, rows), F.col("vec_id") % 100 == 0, block=block)
    assert sorted(map(tuple, got.collect())) == want


def test_negatives_with_numbers_beyond_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 10.0 ** float(rng.integers(0, 8))).tolist(), int(i % 3)) for i in range(0, 400)]
    got = sorted(map(tuple, negatives.mine(table_of(spark, rows), F.col("vec_id") % 100 == 0).collect()))
    assert got == brute_negatives(rows) and max(abs(r[5]) for r in got) > 1 << 53
    huge = [(i, [3e38, 1.0, 0.0, float(i)], i % 2) for i in range(0, 300, 50)]
    assert all(r.positive_score == r.negative_score == (1 << 63) - 1 for r in negatives.mine(table_of(spark, huge), F.col("vec_id") % 100 == 0).collect())


def test_negatives_without_anchors_or_rows(spark):
    assert negatives.mine(table_of(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine(table_of(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 4, 2)]), F.col("vec_id") % 100 == 0).count() == 0
    alone = [(100, [1.0] * 4, 1), (2, [1.0] * 4, 2)]
    assert negatives.mine(table_of(spark, alone), F.col("vec_id") % 100 == 0).count() == 0


def test_combiner_and_slots_keep_the_best_of_each_slot():
    scores = np.array([[5, 9, 9, 3, 7, 1]])
    a, slot, c = negatives.select(scores, np.array([[True, True, True, False, True, True]]), np.array([[9, 5, -(1 << 63)]], dtype=object), 2)
    assert sorted(zip(slot.tolist(), c.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 0), (1, 5)]
    kept = negatives.Combiner(1, limit=2)
    for s, i in ((4, 7), (6, 9), (6, 8), (1, 1)):
        kept.add(*(np.array([v]) for v in (0, 0, s, i, i)))
    assert [c.tolist() for c in kept.table()] == [[0], [0], [6], [8], [8]]


def test_neighbours_query_reaches_recall(spark, sf):
    got = queries.QUERIES["op11_neighbours"](spark, sf).toPandas()
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet' order by vec_id").fetchnumpy()
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"]
    asked = np.flatnonzero(ids % 20 == 0)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    order = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    told = got.groupby("query_id")["vec_id"].agg(set)
    assert sum(len(told[ids[a]] & set(ids[o].tolist())) for a, o in zip(asked, order, strict=True)) >= 0.9 * order.size
