"""Fold-in, artefacts, state reuse and evaluation phases against brute force and numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import artefacts as art
from fieldloom.operators import features as fe
from fieldloom.operators import foldin
from fieldloom.operators import geometry as geo
from fieldloom.operators import phases as ph
from fieldloom.operators import ranking as rk
from fieldloom.operators import transport as tr


def obs(spark, n, d, seed=3, first=0):
    x = np.random.default_rng(seed).normal(size=(n, d)) + 1
    rows = [(first + i, (first + i) % 5, 1.0 + i % 3, x[i].tolist()) for i in range(n)]
    return x, spark.createDataFrame(rows, "id bigint, e bigint, m double, x array<double>")


def test_l1_regression_resists_an_outlier_and_warm_start_gives_the_same(spark):
    rng = np.random.default_rng(1)
    a = np.abs(rng.normal(size=(60, 3)))
    y = a @ np.array([0.5, 0.0, 1.0])
    y[0] += 50
    w, plain = geo.nn_l1_net(a, y, 1e-6, 1e-6), geo.nn_elastic_net(a, y, 1e-6, 1e-6)
    assert np.abs(w - [0.5, 0, 1]).max() < 0.02 < np.abs(plain - [0.5, 0, 1]).max()
    loss = lambda v: np.abs(y - a @ v).sum()
    assert loss(w) <= min(loss(np.maximum(0, w + step)) for step in rng.normal(scale=0.1, size=(50, 3))) + 1e-3
    _, df = obs(spark, 40, 4)
    cold = geo.slim_weights(df, "id", "x", 6, 0.5, 0.01)
    state = spark.createDataFrame([(i, i % 2 == 0) for i in range(40)], "id bigint, known boolean")
    warm = {(r.r, r.s): r.w for r in art.refit_slim(df, cold, state, "id", "x", 6, 0.5, 0.01).collect()}
    for r in cold.collect():
        assert warm.get((r.r, r.s), 0.0) == pytest.approx(r.w, abs=5e-3)


def test_regressions_of_many_rows_are_those_of_each(spark):
    rng = np.random.default_rng(6)
    a, y, start = rng.normal(size=(50, 7, 9)), rng.normal(size=(50, 9)), rng.uniform(size=(50, 7))
    a[3, 5:], start[3, 5:] = 0, 0  # a row with fewer neighbours
    for w0 in (None, start):
        own = lambda i: None if w0 is None else w0[i]  # noqa: B023, E731
        many = geo.nn_elastic_nets(a @ a.transpose(0, 2, 1), (a @ y[:, :, None])[:, :, 0], 0.5, 0.01, start=w0)
        assert np.abs(many - [geo.nn_elastic_net(a[i].T, y[i], 0.5, 0.01, start=own(i)) for i in range(50)]).max() < 1e-9
        many = geo.nn_l1_nets(a, y, 0.5, 0.01, start=w0)
        assert np.abs(many - [geo.nn_l1_net(a[i].T, y[i], 0.5, 0.01, start=own(i)) for i in range(50)]).max() < 1e-6
    _, df = obs(spark, 60, 4)
    for kind in ("euclidean", "manhattan"):
        once, rounds = ({(r.r, r.s): r.w for r in geo.slim_weights(df, "id", "x", 6, 0.5, 0.01, kind, round_bytes=b).collect()} for b in (1 << 30, 4000))
        assert once and once == pytest.approx(rounds)


def test_projection_by_rows_and_by_resampled_masses(spark):
    xm, model = obs(spark, 25, 4)
    xn, new = obs(spark, 10, 4, seed=9, first=100)
    args = ("id", "e", "m", "x", 6, 0.5, 0.01)
    want = np.zeros((5, 5))
    mass, own = np.array([1.0 + i % 3 for i in range(25)]), np.array([1.0 + i % 3 for i in range(10)])
    d = geo.block_distances(xn, xm, "euclidean")
    for o in range(10):
        near = np.sort(np.argsort(d[o])[:6])
        for s, w in zip(near, geo.nn_elastic_net(xm[near].T, xn[o], 0.5, 0.01), strict=True):
            want[o % 5, s % 5] += own[o] * w * mass[s]
    total = np.array([[own[np.arange(10) % 5 == a].sum() * mass[np.arange(25) % 5 == b].sum() for b in range(5)] for a in range(5)])
    got = {(r.a, r.b): r.score for r in foldin.project_f2(new, model, *args).collect()}
    assert got == pytest.approx({(a, b): v for (a, b), v in np.ndenumerate(want / total) if v})
    parts = foldin.pieces(new, model, *args)
    twice = {(r.a, r.b): r.score for r in foldin.score_pieces(parts, new.withColumn("m", F.col("m") * 2), model, "id", "e", "m").collect()}
    assert twice == pytest.approx(got)
    among = foldin.similarity_between_new(new, model, *args).collect()
    assert among and {r.a for r in among} <= set(range(5)) and all(r.a != r.b for r in among)


def test_projection_by_embedding_and_frozen_features(spark):
    _, df = obs(spark, 30, 3)
    df = df.withColumn("mass", F.col("m"))
    model = geo.embed_entities(geo.rff(df, "x", 3, 32, 1.5, "e", "mass"), "e", "mass")
    new = df.filter("e = 1").withColumn("e", F.lit(77).cast("bigint"))
    got = foldin.project_f5(new, model, df.filter("e != 2"), "e", "x", 3, 32, 1.5, 4).orderBy("rank").collect()
    assert (got[0].a, got[0].b) == (77, 1) and got[0].score == pytest.approx(1) and 2 not in {r.b for r in got}
    stats = fe.norm_stats(spark.createDataFrame([("g", 1.0), ("g", 3.0)], "g string, v double"), "g", ["v"])
    rows = spark.createDataFrame([("g", 4.0)], "g string, v double")
    assert foldin.project_features(rows, stats, "g", ["v"]).first().v == 2.0
    for frame, names in ((rows, ["v", "u"]), (rows.withColumn("g", F.lit("h")), ["v"])):
        with pytest.raises(ValueError):
            foldin.project_features(frame, stats, "g", names)


def test_state_reuse_and_tables(spark, tmp_path):
    t = lambda rows: spark.createDataFrame(rows, "entity bigint, match bigint, hash bigint")
    prev, cur = t([(1, 1, 5), (1, 2, 6), (2, 1, 7), (3, 1, 8), (3, 2, 9)]), t([(1, 1, 5), (1, 2, 6), (2, 1, 70), (3, 1, 8), (4, 1, 1)])
    assert {(r.entity, r.match): (r.known, r.same) for r in art.reusable_rows(prev, cur).collect()} == {(1, 1): (True, True), (1, 2): (True, True), (2, 1): (True, False), (3, 1): (True, True), (4, 1): (False, False)}
    assert {r.entity: r.intact for r in art.intact_entities(prev, cur).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert not any(r.intact for r in art.intact_entities(prev, cur, same_setup=False).collect())
    axes = {"formulation": "2", "entity_kind": "player", "normalisation": "league", "distance": "manhattan"}
    other = axes | {"formulation": "5"}
    for _ in range(2):
        art.write_tables({"obs": prev}, str(tmp_path), axes, art.STATE)
    art.write_tables({"obs": cur}, str(tmp_path), other, art.STATE)
    assert sorted(map(tuple, art.read_table(spark, str(tmp_path), "obs", axes).collect())) == sorted(map(tuple, prev.collect()))
    assert art.read_table(spark, str(tmp_path), "obs", other).count() == 5
    with pytest.raises(ValueError):
        art.write_tables({"nothing": prev}, str(tmp_path), axes)
    _, df = obs(spark, 20, 3)
    df = df.withColumn("mass", F.col("m"))
    costs = tr.sinkhorn_pairs(df, "e", groups=2)
    intact = spark.createDataFrame([(e, e < 3) for e in range(5)], "entity bigint, intact boolean")
    marked = costs.withColumn("cost", F.lit(-1.0))
    again = {(r.a, r.b): r.cost for r in art.refit_transport(df, marked, intact, "e")[0].collect()}
    want = {(r.a, r.b): -1.0 if r.b < 3 else r.cost for r in costs.collect()}
    assert again == pytest.approx(want)


def test_phases(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 4))
    s = x @ x.T
    pairs = [(a, b, float(s[a, b])) for a in range(12) for b in range(12) if a != b]
    scores = spark.createDataFrame(pairs, "a bigint, b bigint, score double")
    roles = {i: None if i == 3 else "xyz"[i % 3] for i in range(12)}
    tops = {a: sorted((b for b in range(12) if b != a), key=lambda b: (-s[a, b], -b)) for a in range(12)}
    ents = spark.createDataFrame([(i, roles[i], float(i), x[i].tolist()) for i in range(12)], "entity bigint, role string, volume double, x array<double>")
    got = ph.sanity(scores, scores, ents.select("entity", "role")).first()
    assert got.asymmetry == pytest.approx(0, abs=1e-9) and got.n_purity == 11 and got.purity == pytest.approx(np.mean([roles[a] == roles[tops[a][0]] for a in range(12) if a != 3]))
    down = ph.downstream(scores, ents, 4, 3).first()
    lists = {a: tops[a][:4] for a in tops}
    degree = [sum(i in t for t in lists.values()) for i in range(12)]
    apart = np.mean([np.mean([np.linalg.norm(x[p] - x[q]) for k, p in enumerate(t) for q in t[k + 1 :]]) for t in lists.values()])
    assert (down.coverage, down.indegree, down.diversity) == pytest.approx((np.mean(np.array(degree) > 0), np.mean(degree), apart))
    vote = {}
    for a in range(12):
        votes = [roles[b] for b in lists[a][:3] if roles[b]]
        if roles[a] and votes:
            vote[a] = max(sorted(set(votes)), key=votes.count)
    assert down.n_knn == len(vote) and down.knn_accuracy == pytest.approx(np.mean([vote[a] == roles[a] for a in vote]))
    base = rk.top_k(scores, 5)
    same = ph.stability(base, base.crossJoin(spark.range(3).withColumnRenamed("id", "draw"))).first()
    assert (same.rbo, same.low, same.high, same.n_asked, same.draws) == pytest.approx((1, 1, 1, 12, 3))
    tri = ph.triangulation({"p": scores, "q": scores}, [("p", "q")], n=19).first()
    assert tri.rho == pytest.approx(1) and tri.tau == pytest.approx(1) and tri.p <= 0.1
    halves = spark.createDataFrame([(a, b, 2.0 if a == b else 1.0) for a in range(6) for b in range(6)], "a bigint, b bigint, score double")
    minutes = spark.createDataFrame([(i, float(i)) for i in range(6)], "entity bigint, minutes double")
    found = {r.scope: r for r in ph.self_retrieval(halves, minutes).collect()}
    assert set(found) == {"global", "A->B", "B->A", "low", "mid", "high"} and all(r.mrr == 1 and r.pool == 6 for r in found.values()) and found["global"].n == 12
    flat = halves.withColumn("score", F.lit(1.0))
    gain = ph.denoising(flat, halves, 99).first()
    assert gain.delta_mrr == pytest.approx(1 - 1 / 3.5) and gain.p < 0.2
    e = spark.createDataFrame([(i, h, x[i].tolist()) for i in range(12) for h in "AB"], "entity bigint, half string, x array<double>")
    inside = spark.createDataFrame([(i, i < 8) for i in range(12)], "entity bigint, inside boolean")
    told = ph.generalization(e, inside, 50).collect()
    assert {(r.inside, r.scope): (r.pool, r.mrr) for r in told} == {(i, k): (4, 1.0) for i in (True, False) for k in ("global", "A->B", "B->A")}
    long = ph.evaluate({"p": ph.downstream(scores, ents, 4, 3), "q": ph.self_retrieval(halves)}, {"formulation": "5"}).collect()
    assert {r.phase for r in long} == {"p", "q"} and {r.formulation for r in long} == {"5"}
    zero = rk.divergence(scores, scores).first()
    assert (zero.max_abs, zero.relative, zero.overlap) == pytest.approx((0, 0, 1))


