"""Registered queries that must cover all rows or pairs of their tables."""

from __future__ import annotations

import numpy as np
import pytest

from fieldloom.plans import model_queries, queries


def test_all_orders_are_indexed(spark, sf):
    keys = sorted(r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey").distinct().collect())
    got = {r.o_orderkey: r.order_index for r in queries.index_orders(spark, sf).collect()}
    assert got == {k: i for i, k in enumerate(keys)}


def test_score_divergence_covers_all_pairs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 130, 5))
    table = {g: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "entity bigint, x array<double>") for g, m in (("league", x), (None, y))}
    monkeypatch.setattr(queries, "_supplier_vectors", lambda spark, folder, group: table[group])
    monkeypatch.setattr(model_queries, "_supplier_vectors", lambda spark, folder, group: table[group])
    s, t = ((u @ u.T) * (1 - np.eye(130)) for u in (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y)))
    best = [[set(np.argsort(-(m - 9 * np.eye(130)), axis=1)[i, :10]) for i in range(130)] for m in (s, t)]
    got = model_queries.score_divergence(spark, str(tmp_path)).first()
    top = np.abs(s - t).max()
    assert got.max_abs == pytest.approx(top, abs=2e-6)
    assert got.relative == pytest.approx(top / np.abs(t).max(), abs=2e-6)
    assert got.overlap == pytest.approx(np.mean([len(a & b) / 10 for a, b in zip(*best, strict=True)]), abs=2e-6)


def test_pair_divergence_in_blocks_with_missing_rows(spark):
    from fieldloom.operators import geometry as geo

    x = np.random.default_rng(5).normal(size=(40, 3))
    a = spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "id bigint, x array<double>")
    b = spark.createDataFrame([(i, (x[i] * 2).tolist()) for i in range(10, 40)], "id bigint, x array<double>")
    want = [np.zeros((40, 40)), np.zeros((40, 40))]
    want[0][:30, :30], want[1][10:, 10:] = x[:30] @ x[:30].T, 4 * x[10:] @ x[10:].T
    s, t = (m * (1 - np.eye(40)) for m in want)
    got = geo.pair_divergence(a, b, "id", lambda p, q: p @ q.T, 7).first()
    assert (got.max_abs, got.top) == pytest.approx((np.abs(s - t).max(), np.abs(t).max()))


def test_best_pairs_tile_by_tile_take_larger_ids_of_equal_scores(spark):
    from fieldloom.operators import geometry as geo

    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 3)).round(1)
    x[20:60], x[70] = x[20], 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    asked = df.filter("id % 7 = 0")
    for left in (df, asked):
        got = {(r.a, r["rank"]): (r.b, r.score) for r in geo.pair_scores(left, df, "id", lambda a, b: (a @ b.T).round(9), 6, 25).collect()}
        want = {}
        for a in (r.id for r in left.collect()):
            s = (x[a] @ x.T).round(9)
            best = [b for b in sorted(range(90), key=lambda b: (-s[b], -b)) if b != a and s[b] != 0][:6]
            want |= {(a, n): (b, pytest.approx(s[b])) for n, b in enumerate(best, 1)}
        assert got == want


def test_generalization_makes_halves_of_the_pool_only(spark, sf, monkeypatch):
    """With pools of one entity four halves are embedded."""
    from fieldloom.operators import geometry as geo
    from fieldloom.operators import phases as ph

    embedded, embed = [], geo.embed_entities
    told, asked = ph.generalization, []
    monkeypatch.setattr(geo, "embed_entities", lambda *a: embedded.append(embed(*a)) or embedded[-1])
    monkeypatch.setattr(ph, "generalization", lambda halves, inside, pool, **more: asked.append(inside) or told(halves, inside, pool, **more))
    monkeypatch.setattr(ph, "pool_of", lambda inside, pool, seed=7, f=ph.pool_of: f(inside, 1, seed))
    model_queries.phase_generalization(spark, sf)
    assert asked[0].count() > 2 and embedded[0].count() == 4
