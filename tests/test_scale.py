"""Operators that no single task or driver has to hold: block matrices, exact quantiles, global ranks, batched transport."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import evaluation as ev
from fieldloom.operators import geometry as geo
from fieldloom.operators import matrices as mx
from fieldloom.operators import neighbours as nb
from fieldloom.operators import phases as ph
from fieldloom.operators import quantiles as qt
from fieldloom.operators import ranking as rk
from fieldloom.operators import ranks as rn
from fieldloom.operators import sweep as sw
from fieldloom.operators import transport as tr
from fieldloom.operators.steps import stored


def whole(blocks, size, n):
    out = np.zeros((-(-n // size) * size,) * 2)
    for r in blocks.collect():
        out[r.i * size : (r.i + 1) * size, r.j * size : (r.j + 1) * size] = np.frombuffer(r.m).reshape(size, size)
    return out[:n, :n]


def test_inverse_of_two_thousand_entities_in_blocks(spark):
    """Blocks as they come from the columns of a matrix; 16 blocks, equal to the dense inverse."""
    n, size = 2000, 500
    rng = np.random.default_rng(4)
    s = rng.normal(size=(n, 64))
    s = np.exp(-np.abs(s @ s.T) / 20)
    np.fill_diagonal(s, 0)
    rows = [(i, j, s[i * size : (i + 1) * size, j * size : (j + 1) * size].tobytes()) for i in range(4) for j in range(4)]
    blocks = stored(spark.createDataFrame(rows, mx.BLOCK), "test-kernel")
    gram = mx.product(blocks, blocks, size, 4, transposed=True)
    assert np.abs(whole(gram, size, n) - s.T @ s).max() < 1e-8
    p = mx.inverse(mx.plus_diagonal(gram, size, n, 0.5), size, 4)
    want = np.linalg.inv(s.T @ s + 0.5 * np.eye(n))
    assert np.abs(whole(p, size, n) - want).max() < 1e-8
    d = np.concatenate([np.frombuffer(r.d) for r in sorted(mx.diagonal(p, size).collect())])
    assert np.abs(d - np.diag(want)).max() < 1e-8


def dense_ease(s, lam):
    p = np.linalg.inv(s.T @ s + lam * np.eye(len(s)))
    b = -p / np.diag(p)
    np.fill_diagonal(b, 0)
    return (s @ b + (s @ b).T) / 2


@pytest.mark.parametrize("size", [4, 16, None])
def test_reranking_of_a_kernel_with_holes(spark, size):
    """Edges that do not fill a block, pairs that are not there, string ids."""
    rng = np.random.default_rng(5)
    n, names = 30, [f"e{i:02}" for i in range(30)]
    s = rng.uniform(size=(n, n)) * (rng.uniform(size=(n, n)) < 0.6)
    np.fill_diagonal(s, 0)
    pairs = spark.createDataFrame([(names[i], names[j], float(s[i, j])) for i in range(n) for j in range(n) if s[i, j]] + [("e03", "e03", 9.0)], "a string, b string, score double")
    got = {(r.a, r.b): r.score for r in mx.ease_kernel(pairs, 0.1, 5, size).collect()}
    want = dense_ease(s, 0.1)
    best = {(names[i], names[j]): want[i, j] for i in range(n) for j in sorted((j for j in range(n) if j != i), key=lambda j: -want[i, j])[:5]}
    assert got == pytest.approx(best, abs=1e-9)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(6)
    values = {
        "even": rng.normal(size=400).tolist(), "odd": (rng.normal(size=401) * 10.0 ** rng.integers(-300, 300, 401)).tolist(), "ties": [1.0] * 500 + [2.0] * 499 + [-0.0, 0.0],
        "one": [3.5], "two": [-1.0, 4.0], "same": [7.25] * 100, "ends": [float("-inf"), -5e-324, 5e-324, 1.7e308, float("inf")],
    }
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("even", None), ("none", None)], "g string, v double").repartition(5)
    shares = [0.0, 0.025, 1 / 3, 0.5, 2 / 3, 0.9, 1.0]
    got = qt.quantiles(df, "v", shares, "g")
    assert got.keys() == values.keys()
    for g, vs in values.items():
        if g != "ends":
            assert got[g] == pytest.approx(np.quantile(vs, shares).tolist(), rel=1e-14, abs=1e-300)
    assert got["ends"][0] == float("-inf") and got["ends"][3] == 5e-324 and got["ends"][-1] == float("inf")
    assert qt.median(df.filter("g = 'none'"), "v") is None and qt.median(df.filter("g = 'ties'"), "v") == np.median(values["ties"])


def test_order_of_doubles_is_kept():
    x = np.array([float("-inf"), -1e300, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e300, float("inf"), float("nan")])
    keys = qt.ordered(x)
    assert (keys[1:] > keys[:-1]).all() and [qt.back(int(k)) for k in keys[:-1]] == x[:-1].tolist()
    assert qt.ordered(np.array([-0.0]))[0] == qt.ordered(np.array([0.0]))[0]


def test_ranks_equal_windows_with_ties_over_borders(spark):
    """Half of the rows share one value, so that it would lie across ranges; a third one group."""
    rng = np.random.default_rng(7)
    rows = [(i, "big" if i % 3 else ("x", "y", None)[i // 3 % 3], 5.0 if i % 2 else float(rng.integers(-20, 20)), None if i % 11 == 0 else i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, part string, v double, before int").repartition(7)
    for groups in ([], ["part"]):
        got = rn.with_midrank_pct(rn.with_avg_rank(df, groups, "v", "rank"), groups, "v", "pct")
        assert got.columns == [*df.columns, "rank", "pct"]
        told = {r.id: (r["rank"], r.pct) for r in got.collect()}
        p = pd.DataFrame(rows, columns=["id", "part", "v", "before"])
        by = p.groupby("part", dropna=False)["v"] if groups else p["v"]
        rank = by.rank()
        size = by.transform("size") if groups else len(p)
        want = dict(zip(p["id"], zip(rank, (rank - 1) / (size - 1), strict=True), strict=True))
        for k in (0, 1):
            assert {i: t[k] for i, t in told.items()} == pytest.approx({i: t[k] for i, t in want.items()})
    nulls = {r.id: r["rank"] for r in rn.with_avg_rank(df, [], "before", "rank").collect()}
    assert all((nulls[i] is None) == (b is None) for i, _, _, b in rows)


def test_spearman_and_mantel_without_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.integers(0, 9)), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    got = ev.spearman(df, [], "x", "y").first().rho
    one = ev.spearman(df.withColumn("g", F.lit(0)), ["g"], "x", "y").first().rho
    assert got == pytest.approx(one)


@pytest.mark.parametrize("kind", ["euclidean", "manhattan"])
def test_batched_transport_equals_single_pairs(spark, kind):
    """Clouds of different sizes, draws in which observations have no mass."""
    rng = np.random.default_rng(9)
    clouds = {e: (rng.normal(e % 3, 1, (int(rng.integers(1, 14)), 3)), None) for e in range(9)}
    draws = 4
    clouds = {e: (x, rng.integers(0, 3, (len(x), draws)) + (rng.uniform(size=(len(x), draws)) < 0.3) + np.eye(len(x), draws)) for e, (x, _) in clouds.items()}
    for _, m in clouds.values():
        m[0, m.sum(axis=0) == 0] = 1
    rows = [(e, x[k].tolist(), m[k].tolist()) for e, (x, m) in clouds.items() for k in range(len(x))]
    df = spark.createDataFrame(rows, "e bigint, x array<double>, masses array<double>")
    got = {(r.draw, r.a, r.b): r.cost for r in tr.sinkhorn_draws(df, "e", kind, groups=2).collect()}
    want = {(d, a, b): tr.sinkhorn(clouds[a][0], clouds[a][1][:, d], clouds[b][0], clouds[b][1][:, d], kind) for d in range(draws) for a in clouds for b in clouds if a < b}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    kernel = tr.kernel_from_costs(spark.createDataFrame([(*k, v) for k, v in want.items()], "draw int, a bigint, b bigint, cost double"), "draw")
    told = {(r.draw, r.a, r.b): r.score for r in kernel.collect()}
    for d in range(draws):
        median = np.median([v for k, v in want.items() if k[0] == d])
        assert told[d, 1, 0] == told[d, 0, 1] == pytest.approx(np.exp(-want[d, 0, 1] / median))


def test_transport_solver_against_plain_scalings():
    rng = np.random.default_rng(10)
    x, y, a, b = rng.normal(size=(6, 2)), rng.normal(size=(5, 2)), rng.uniform(0.2, 1, 6), rng.uniform(0.2, 1, 5)
    c = ((x[:, None] - y[None]) ** 2).sum(-1)
    k, u, v = np.exp(-c / 0.5), np.ones(6), np.ones(5)
    for _ in range(100):
        u = a / a.sum() / (k @ v)
        v = b / b.sum() / (k.T @ u)
    assert tr.sinkhorn(x, a, y, b) == pytest.approx(float((u[:, None] * k * v * c).sum()), rel=1e-12)
    # costs beyond what scalings can hold go step by step in the log domain
    far = tr.sinkhorn(x * 40, a, y * 40, b)
    assert np.isfinite(far) and far > 100


def test_transport_stability_against_plain_loops(spark):
    rng = np.random.default_rng(11)
    rows = [(e, m, float(1 + m % 3), rng.normal(e % 3, 1, 2).tolist()) for e in range(6) for m in range(5)]
    obs = spark.createDataFrame(rows, "e bigint, match bigint, mass double, x array<double>")
    times = {(r.b, r.e, r.match): r.times for r in ev.resample(obs, "e", "match", 3).collect()}

    def tops(draw):
        weight = lambda e, m, w: w * (times.get((draw, e, m), 0) if draw else 1)
        cloud = {e: (np.array([x for i, _, _, x in rows if i == e]), np.array([weight(i, m, w) for i, m, w, _ in rows if i == e])) for e in range(6)}
        cost = {(a, b): tr.sinkhorn(*cloud[a], *cloud[b]) for a in range(6) for b in range(a + 1, 6)}
        return {a: sorted((b for b in range(6) if b != a), key=lambda b: (cost[min(a, b), max(a, b)], -b))[:3] for a in range(6)}

    def rbo(x, y, p=0.9):
        agree = [len({*x[:d]} & {*y[:d]}) for d in range(1, 4)]
        return (1 - p) * sum(n / d * p ** (d - 1) for d, n in enumerate(agree, 1)) + agree[-1] / 3 * p**3

    base = tops(0)
    means = [np.mean([rbo(base[a], drawn[a]) for a in range(6)]) for drawn in (tops(d) for d in (1, 2, 3))]
    got = ph.transport_stability(obs, "e", "match", 3, 3).first()
    assert (got.rbo, got.low, got.high) == pytest.approx((np.mean(means), *np.quantile(means, [0.025, 0.975])))
    assert (got.n_asked, got.draws) == (6, 3)


@pytest.mark.parametrize("kind", ["euclidean", "sqeuclidean", "manhattan", "cosine"])
def test_pruned_neighbours_equal_brute_force(spark, kind):
    """Clusters, one of which holds a third of the rows, copies and a zero vector; chunks smaller than that cluster."""
    rng = np.random.default_rng(12)
    centres = 8 * rng.normal(size=(12, 5))
    x = centres[np.minimum(rng.integers(0, 18, 900), 11)] + 0.2 * rng.normal(size=(900, 5))
    x[100:110] = x[100]
    x[500] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    report = {}
    got = nb.knn_pruned(df, df.filter("id % 5 = 0"), 4, kind, "id", "x", chunk=100, report=report)
    assert got.columns == ["id", "neighbour", "distance", "rank"]
    told = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in got.collect()}
    for q in range(0, 900, 5):
        d = geo.block_distances(x[q : q + 1], x, kind)[0]
        d[q] = np.inf
        order = np.lexsort((np.arange(900), d.round(9)))[:4]
        assert [told[q, r][0] for r in range(1, 5)] == order.tolist()
        assert [told[q, r][1] for r in range(1, 5)] == pytest.approx(d[order].tolist(), abs=1e-9)
    assert len(told) == 720 and report["share"] < 0.5


def test_pruned_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id bigint, x array<double>")
    got = sorted((r.id, r["rank"], r.neighbour) for r in nb.knn_pruned(df, df.filter("id < 1"), 9, "euclidean", "id", "x", chunk=2, pivots=2).collect())
    assert got == [(0, r, r) for r in range(1, 5)]
    direct = sorted((r.id, r["rank"], r.neighbour) for r in geo.knn(df, df.filter("id < 1"), 9).collect())
    assert direct == got == sorted((r.id, r["rank"], r.neighbour) for r in geo.knn(df, df.filter("id < 1"), 9, block_rows=2).collect())


@pytest.mark.parametrize("kind", ["euclidean", "manhattan", "cosine"])
def test_neighbours_met_tile_by_tile(spark, kind):
    """Nine tiles, ids as text, copies across tiles, rows without a distance; only the base, the queries and their lists are written."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 6))
    x[300:330], x[400:460] = x[300], 0
    x[700] = np.nan
    ids = np.array([f"k{i}" for i in range(800)])
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id string, x array<double>")
    report = {}
    got = nb.knn_pruned(df, df.filter("id like '%5' or id like 'k4%'"), 7, kind, "id", "x", chunk=50, report=report, tile=90)
    told = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in got.collect()}
    assert report["tiles"] == 9
    asked = [i for i, k in enumerate(ids) if k.endswith("5") or k.startswith("k4")]
    for q in asked:
        d = geo.block_distances(x[q : q + 1], x, kind)[0]
        d[[q, 700]] = np.inf
        order = np.lexsort((ids, d.round(9)))[:7]
        assert [told[ids[q], r][0] for r in range(1, 8)] == ids[order].tolist()
        assert [told[ids[q], r][1] for r in range(1, 8)] == pytest.approx(d[order].tolist(), abs=1e-9)
    assert len(told) == 7 * len(asked)


def test_grid_is_filled_along_rows_and_then_columns(spark):
    """A plane with holes: curves through points of a plane stay in it; what no row and no column reaches stays open."""
    holes = {(1, 1), (2, 1), (0, 0), (4, 2), (3, 3), (3, 0), (3, 1), (3, 2)}
    cells = [(x, y, None if (x, y) in holes else 2.0 * x + 3.0 * y) for x in range(5) for y in range(5)]
    got = {(r.x, r.y): (r.z, r.filled) for r in sw.fill_grid(spark.createDataFrame(cells, "x int, y int, z double"), "x", "y").collect()}
    assert len(got) == 25 and got[0, 0] == (None, False)
    for (x, y), (z, filled) in got.items():
        if (x, y) != (0, 0):
            assert z == pytest.approx(2 * x + 3 * y) and filled == ((x, y) in holes)
    # at the end of its row, so filled along its column
    assert got[4, 2][1]


def test_less_is_better_where_said(spark):
    rows = [("m1", "v1", 3.0), ("m1", "v2", 1.0), ("m2", "v1", 2.0), ("m2", "v2", 2.0), ("m3", "v1", 0.5)]
    df = spark.createDataFrame(rows, "model string, combination string, value double")
    for lower, want in ((False, {"m1": "v1", "m2": None}), (True, {"m1": "v2", "m2": None})):
        wide = sw.comparison(df, "model", "combination", ["v1", "v2"], lower)
        assert {r.model: r.best for r in wide.filter("model != 'm3'").collect()} == want
        means = {r.combination: (r["mean"], r.complete, r.best) for r in sw.best_on_average(wide, ["v1", "v2"], lower).collect()}
        assert means == {"v1": (pytest.approx(5.5 / 3), True, True), "v2": (1.5, False, False)}
    grid = df.withColumn("y", F.lit(1))
    assert sw.optimum(sw.response_grid(grid, "combination", "y", lower=True), "combination", "y", lower=True).first().z == 0.5
    assert sw.optimum(sw.response_grid(grid, "combination", "y"), "combination", "y").first().z == 3.0


def test_candidates_and_ranks_in_both(spark):
    names = spark.createDataFrame([(i, f"Anna {i:02}") for i in range(14)] + [(99, "Ánna")], "id bigint, name string")
    asked = spark.createDataFrame([("anna",), ("anna 1",), ("ANNA 03",), ("nobody",)], "text string")
    got = {r.text: (r.status, r.id, r.candidates) for r in rk.resolve(names, asked).collect()}
    assert got == {"anna": ("exact", 99, None), "anna 1": ("ambiguous", None, [f"Anna {i}" for i in range(10, 14)]), "ANNA 03": ("exact", 3, None), "nobody": ("absent", None, None)}
    many = rk.resolve(names.filter("id < 99"), asked.limit(1)).first()
    assert many.status == "ambiguous" and many.candidates == [f"Anna {i:02}" for i in range(10)]
    a = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "a int, b int, rank int")
    b = spark.createDataFrame([(1, 3, 1), (1, 4, 2)], "a int, b int, rank int")
    assert {(r.b, r["rank"], r.other_rank) for r in rk.ranks_in_both(a, b).collect()} == {(2, 1, None), (3, 2, 1)}
