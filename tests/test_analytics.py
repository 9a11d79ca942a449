"""Analytics operators against hand-made matches, brute force and numpy."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import catalogue as cat
from fieldloom.functions import scalars as fn
from fieldloom.operators import evaluation as ev
from fieldloom.operators import events as eo
from fieldloom.operators import features as fe
from fieldloom.operators import geometry as geo
from fieldloom.operators import quality as dq
from fieldloom.operators import ranking as rk
from fieldloom.operators import sweep as sw
from fieldloom.operators import tables as tb
from fieldloom.operators import transport as tr
from fieldloom.sources import package
from fieldloom.streaming import ingest


def event(k, possession, owner, clock, kind, player, team, at, **more):
    minute, second = clock
    return {"id": f"e{k}", "period": 1, "minute": minute, "second": second, "possession": possession, "type": {"name": kind}, "team": {"id": team, "name": "AB"[team - 1]}, "possession_team": {"id": owner, "name": "AB"[owner - 1]}, "play_pattern": {"name": "Regular Play"}, "player": {"id": player, "name": str(player)}, "location": list(at)} | more


def small_match():
    done = {"outcome": {"name": "Won"}}
    return [
        event(1, 1, 1, (1, 0), "Pass", 10, 1, (20, 40), **{"pass": {"end_location": [60, 40]}}), event(2, 1, 1, (1, 5), "Carry", 11, 1, (60, 40), carry={"end_location": [85, 40]}),
        event("kp", 1, 1, (1, 10), "Pass", 11, 1, (85, 40), **{"pass": {"end_location": [110, 40]}}), event(4, 1, 1, (1, 12), "Shot", 10, 1, (110, 40), shot={"statsbomb_xg": 0.4, "outcome": {"name": "Goal"}, "type": {"name": "Open Play"}, "key_pass_id": "ekp"}),
        event(5, 2, 2, (5, 0), "Pressure", 11, 1, (50, 40)), event(6, 2, 2, (5, 3), "Ball Recovery", 10, 1, (50, 40)),
        event(7, 3, 2, (10, 0), "Duel", 20, 2, (30, 40), duel={"type": {"name": "Tackle"}} | done), event(8, 3, 2, (10, 1), "Duel", 21, 2, (30, 40), duel={"type": {"name": "Aerial Lost"}}),
        event(9, 3, 2, (130, 0), "Shot", 20, 2, (110, 40), period=5, shot={"statsbomb_xg": 0.9}),
    ]


def lineups():
    spell = [{"position_id": 14, "position": "Center Midfield", "from": "00:00", "to": None}]
    player = lambda i, s=spell: {"player_id": i, "player_name": f"p{i}", "positions": s}
    return [{"team_id": 1, "team_name": "A", "lineup": [player(10, [{"position_id": 3, "position": "Right Center Back", "from": "00:00", "to": "04:00"}, {"position_id": 23, "position": "Center Forward", "from": "04:00", "to": None}]), player(11), player(12), player(13, [])]}, {"team_id": 2, "team_name": "B", "lineup": [player(20), player(21)]}]


@pytest.fixture(scope="module")
def package_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("package")
    for d in ("matches/7", "events", "lineups", "matches/9"):
        (root / d).mkdir(parents=True)
    (root / "competitions.json").write_text(json.dumps([{"competition_id": 7, "season_id": 1, "competition_name": " Cup", "season_name": "2020"}, {"competition_id": 7, "season_id": 2, "competition_name": " Cup", "season_name": "2021"}]))
    match = lambda i: {"match_id": i, "match_date": "2020-01-01", "match_week": 1, "home_team": {"home_team_id": 1, "home_team_name": "A"}, "away_team": {"away_team_id": 2, "away_team_name": "B"}, "home_score": 1, "away_score": 0}
    (root / "matches/7/1.json").write_text(json.dumps([match(100)]))
    (root / "matches/9/9.json").write_text(json.dumps([match(900)]))
    (root / "events/100.json").write_text(json.dumps(small_match()))
    (root / "lineups/100.json").write_text(json.dumps(lineups()))
    return root


def test_package_to_match_tables(spark, package_dir):
    root = f"file://{package_dir}"
    matches, problems = package.discover(spark, root, ids=[100, 55], competition="cup ")
    assert [r.match_id for r in matches.collect()] == [100]
    assert sorted((r.match_id, r.message) for r in problems.collect()) == [(55, "the match is asked for but not there"), (900, "its competition and season are not declared")]
    raw = package.read_events(spark, root)
    assert [r.id for r in raw.orderBy("pos").collect()] == [e["id"] for e in small_match()]
    flat = eo.flatten(raw)
    players, teams, spells = eo.build_match_tables(flat, package.read_lineups(spark, root), matches)
    p = {r.player_id: r for r in players.collect()}
    assert p.keys() == {10, 11, 12, 20, 21} and p[12].passes == 0 and p[12].minutes_played == pytest.approx(10 + 1 / 60)
    assert (p[10].progressive_passes, p[10].goals, p[10].np_goals, p[10].npxg, p[10].sca, p[10].ball_recoveries) == (1, 1, 1, 0.4, 0, 1)
    assert (p[11].progressive_carries, p[11].sca, p[11].xa, p[11].pressure_regains, p[11].passes_into_penalty_area, p[11].deep_completions) == (1, 2, 0.4, 1, 1, 1)
    assert (p[20].tackles, p[20].tackles_won, p[20].duels_won, p[21].aerial_lost, p[21].duels_total) == (1, 1, 1, 1, 1)
    assert p[10].primary_position_name == "Center Forward"
    t = {r.team: r for r in teams.collect()}
    assert (t["A"].sca, t["A"].gca, t["A"].goals_for, t["B"].goals_for, t["A"].opponent_id, t["A"].is_home) == (2, 2, 1, 0, 2, 1)
    assert t["A"].possession_pct == 1.0 and t["A"].xg == sum(p[i].xg for i in (10, 11, 12)) and t["A"].open_play_sequences == 1
    assert t["A"].sequence_start_distance == pytest.approx(round(20 * 0.9144, 3)) and t["A"].direct_attacks == 1
    assert spells.count() == 6
    feats = fe.derive(players, "player").filter("player_id = 11").first()
    assert feats.sca == pytest.approx(2 * 90 / (10 + 1 / 60)) and feats.pass_completion_pct == 1.0 and feats.take_ons_pct is None
    assert fe.derive(teams, "team").filter("team = 'A'").first().goals_minus_xg == pytest.approx(0.6)
    catalog = package.competitions_catalog(package.read_competitions(spark, root), package.match_files(spark, root)).first()
    assert [(s.season_name, s.available) for s in catalog.seasons] == [("2020", True), ("2021", False)]
    assert sorted((r.season_name, r.match_count) for r in package.match_counts(package.read_competitions(spark, root), package.read_matches(spark, root)).collect()) == [("2020", 1), ("2021", 0)]


def test_checks_and_verdicts(spark, package_dir):
    root = f"file://{package_dir}"
    raw, lines, matches = package.read_events(spark, root), package.read_lineups(spark, root), package.read_matches(spark, root)
    bad = raw.withColumn("match_id", F.lit(1).cast("bigint")).filter("team.name = 'A'")
    bad = bad.unionByName(bad.limit(1))
    got = dq.validate_events(raw.unionByName(bad)).collect()
    assert {(r.match_id, r.message) for r in got if r.level == "error"} == {(1, "1 event ids are repeated"), (1, "1 count of team names is not two")}
    assert dq.validate_lineups(lines, matches).count() == 0 and dq.check_required(raw, "events").count() == 0
    ok = {r.match_id: r.ok for r in dq.verdict(raw.unionByName(bad), dq.validate_events(raw.unionByName(bad))).collect()}
    assert ok == {100: True, 1: False}


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text(json.dumps(small_match()))
    (src / "2.json").write_text(json.dumps(small_match()[:5]))  # one team only: left out
    args = (spark, f"file://{src}", f"file://{tmp_path}/table", f"file://{tmp_path}/state")
    ingest.stream_ingest(*args)
    ingest.stream_ingest(*args)
    assert {(r.match_id, r["count"]) for r in ingest.read_table(spark, args[2]).groupBy("match_id").count().collect()} == {(1, 9)}
    (src / "3.json").write_text(json.dumps(small_match()[:8]))
    ingest.stream_ingest(*args)
    assert {(r.match_id, r["count"]) for r in ingest.read_table(spark, args[2]).groupBy("match_id").count().collect()} == {(1, 9), (3, 8)}


def test_lookback_and_runs_against_a_walk(spark):
    rng = np.random.default_rng(3)
    rows = [(int(m), i, None if rng.random() < 0.1 else int(rng.integers(1, 4)), "AB"[rng.integers(2)], ["Shot", "Pass", "Foul", "Carry"][rng.integers(4)]) for m in (1, 2) for i in range(1, 200)]
    df = eo.run_id(spark.createDataFrame(rows, "match_id bigint, idx int, possession int, team string, type string"), "match_id", "possession")
    got = sorted((r.match_id, r.shot_idx, r.idx) for r in eo.lookback(df, F.col("type") == "Shot", F.col("type").isin("Pass", "Carry", "Shot")).collect())
    want = []
    for m in (1, 2):
        own = [r for r in rows if r[0] == m]
        for k, r in enumerate(own):
            left = 2
            for q in reversed(own[:k]) if r[4] == "Shot" else []:
                if q[2] != r[2] or not left:
                    break
                if q[3] == r[3] and q[4] != "Foul":
                    want.append((m, r[1], q[1]))
                    left -= 1
    assert got == sorted(want)


def test_scalars(spark):
    row = spark.range(1).select(
        fn.is_progressive(*[F.lit(float(v)) for v in (20, 40, 45, 40)]).alias("edge"), fn.is_progressive(*[F.lit(float(v)) for v in (20, 40, 44, 40)]).alias("below"), fn.threat_at(F.lit(120.0), F.lit(0.0)).alias("corner"),
        fn.parse_clock(F.lit("93:30")).alias("clock"), fn.position_slug(F.lit("Right Back")).alias("slug"), fn.padj_factor(F.lit(1.0)).alias("one"), fn.padj_factor(F.lit(0.75)).alias("two"), fn.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("none"),
        fn.normalize_name(F.lit(" Çélia Ñ ")).alias("name"), fn.version_order(F.lit("v12")).alias("v"), fn.role_of(F.lit("Secondary Striker")).alias("role"), fn.role_of(F.lit("Left Wing Back")).alias("back"), (fn.row_hash(F.array(F.lit(-0.0))) == fn.row_hash(F.array(F.lit(0.0)))).alias("zero"),
        fn.format_metric(F.lit("possession_pct"), F.lit(0.5)).alias("shown"),
    ).first()
    assert (row.edge, row.below, row.corner, row.clock, row.slug, row.one, row.two, row.none) == (True, False, cat.THREAT[0][11], 93.5, "pos_right_back", 1.0, 2.0, None)
    assert (row.name, row.v, row.role, row.back, row.zero, row.shown) == ("celia n", 12, "???", "DEF", True, "50.0 %")


def vectors(spark, n=120, d=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    df = spark.createDataFrame([(i, i % 9, float(1 + i % 3), x[i].tolist()) for i in range(n)], "id bigint, e bigint, m double, x array<double>")
    return x, df


@pytest.mark.parametrize("kind", ["euclidean", "manhattan", "cosine"])
def test_knn_is_exact(spark, kind):
    x, df = vectors(spark)
    d = geo.block_distances(x, x, kind)
    np.fill_diagonal(d, np.inf)
    got = geo.knn(df, df, 4, kind, block_rows=25).collect()
    assert len(got) == 480
    for r in got:
        assert r.distance == pytest.approx(np.sort(d[r.id])[r["rank"] - 1]) and d[r.id, r.neighbour] == pytest.approx(r.distance)


def test_whitening_and_embeddings(spark):
    x, df = vectors(spark)
    root = geo.fit_whitening(df, "x", 6)
    assert np.allclose(np.cov(x @ root, rowvar=False), np.eye(6))
    a = np.stack([r.x for r in geo.whiten(df, "x", root, "id").orderBy("id").collect()])
    assert np.allclose(a, x @ root)
    z = np.stack([r.x for r in geo.rff(df, "x", 6, 4000, 2.0, "id").orderBy("id").collect()])
    kernel = np.exp(-geo.block_distances(x, x, "sqeuclidean") / 8)
    assert np.abs(z @ z.T - kernel).max() < 0.12
    e = {r.e: r for r in geo.embed_entities(df, "e", "m").collect()}
    m = np.array([1 + i % 3 for i in range(120)], float)
    for k in range(9):
        own = np.arange(120) % 9 == k
        assert np.allclose(e[k].x, np.average(x[own], axis=0, weights=m[own])) and e[k].mass == m[own].sum()


@pytest.mark.parametrize("lam", [0.03, 0.5])
def test_ease_equals_dense_inverse(spark, lam):
    x, df = vectors(spark, 40, 12)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T - np.eye(40)
    p = np.linalg.inv(s.T @ s + lam * np.eye(40))
    r = s @ (np.eye(40) - p / np.diag(p))
    want = (r + r.T) / 2
    got = geo.ease_rerank(df.withColumnRenamed("m", "mass"), "id", 12, lam, 39).collect()
    assert len(got) == 40 * 39 and max(abs(g.score - want[g.a, g.b]) for g in got) < 1e-9


def test_transport_and_slim(spark):
    x, df = vectors(spark, 27, 3)
    costs = {(r.a, r.b): r.cost for r in tr.sinkhorn_pairs(df.withColumnRenamed("m", "mass"), "e", groups=4).collect()}
    assert len(costs) == 36
    m = np.array([1 + i % 3 for i in range(27)], float)
    own = [np.arange(27) % 9 == k for k in range(9)]
    assert costs[0, 1] == pytest.approx(tr.sinkhorn(x[own[0]], m[own[0]], x[own[1]], m[own[1]]))
    known = spark.createDataFrame([(0, 1, 99.0)], "a bigint, b bigint, cost double")
    again = {(r.a, r.b): r.cost for r in tr.sinkhorn_pairs(df.withColumnRenamed("m", "mass"), "e", known=known, groups=4).collect()}
    assert again == pytest.approx(costs | {(0, 1): 99.0})
    w = {(r.r, r.s): r.w for r in geo.slim_weights(df, "id", "x", 5, 0.5, 0.01).collect()}
    d = geo.block_distances(x, x, "euclidean")
    np.fill_diagonal(d, np.inf)
    near = np.sort(np.argsort(d[4])[:5])
    want = geo.nn_elastic_net(x[near].T, x[4], 0.5, 0.01)
    assert {s: v for (r, s), v in w.items() if r == 4} == pytest.approx({int(s): v for s, v in zip(near, want, strict=True) if v > 0})
    grad = x[near] @ (x[near].T @ want - x[4]) + 0.5 * want + 0.01
    assert np.all(grad[want == 0] > -1e-2) and np.all(np.abs(grad[want > 0]) < 1e-2)
    agg = geo.aggregate_weights(spark.createDataFrame([(0, 1, 0.5), (9, 1, 0.25)], "r bigint, s bigint, w double"), df, "id", "e", "m").collect()
    total = [m[o].sum() for o in own]
    v = (0.5 * m[0] * m[1] + 0.25 * m[9] * m[1]) / (total[0] * total[1]) / 2
    assert {(r.a, r.b): r.score for r in agg} == pytest.approx({(0, 1): v, (1, 0): v})


def test_ranks_lists_and_tests(spark):
    s = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.0), (1, 5, -1.0), (1, 1, 9.0), (1, 6, float("nan"))], "a bigint, b bigint, score double")
    assert [(r.b, r["rank"]) for r in rk.top_k(s, 9).orderBy("rank").collect()] == [(3, 1), (2, 2), (5, 3)]
    lists = spark.createDataFrame([([1, 2, 3], [1, 2, 3]), ([1, 2], [3, 4]), ([], []), ([1], [])], "x array<int>, y array<int>")
    assert [round(r[0], 9) for r in lists.select(ev.rbo(F.col("x"), F.col("y"))).collect()] == [1.0, 0.0, 1.0, 0.0]
    diffs = spark.createDataFrame([(i, float(i % 7 + 1)) for i in range(40)], "k bigint, d double")
    got = ev.paired_permutation(diffs, "k", "d").first()
    assert got.p == pytest.approx(0.001) and got["mean"] == pytest.approx(np.mean([i % 7 + 1 for i in range(40)]))
    none = ev.paired_permutation(diffs.filter("k < 0"), "k", "d").first()
    assert (none["mean"], none.p) == (0.0, 1.0)
    pairs = [(a, b, float((a * 7 + b * 13) % 50)) for a in range(12) for b in range(a + 1, 12)]
    t = spark.createDataFrame(pairs, "a bigint, b bigint, score double")
    same = ev.mantel(t, t).first()
    assert same.rho == pytest.approx(1.0) and same.p == pytest.approx(1 / 200)
    names = spark.createDataFrame([(1, "Ana"), (2, "Anabel"), (3, "Juana")], "id bigint, name string")
    asked = spark.createDataFrame([("ana",), ("bel",), ("an",), ("zz",)], "text string")
    assert {r.text: (r.status, r.id) for r in rk.resolve(names, asked).collect()} == {"ana": ("exact", 1), "bel": ("unique", 2), "an": ("ambiguous", None), "zz": ("absent", None)}
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "id bigint")
    assert {r.id: r.status for r in rk.lookup(ids(1, 2, 3, 4), ids(1, 2), ids(2, 3)).collect()} == {1: "without_data", 2: "ready", 3: "projectable", 4: "unknown"}
    draws = ev.resample(spark.createDataFrame([(e, m) for e in range(5) for m in range(e + 1)], "e bigint, m bigint"), "e", "m", 10)
    assert {(r.b, r.e): r.n for r in draws.groupBy("b", "e").agg(F.sum("times").alias("n")).collect()} == {(b, e): e + 1 for b in range(1, 11) for e in range(5)}


def test_tables_and_sweeps(spark):
    x = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0, None, 3.0])] + [("b", 0, 5.0)], "p string, i int, v double")
    assert [r[0] for r in x.select("p", "i", tb.midrank_pct(["p"], "v").alias("r")).orderBy("p", "i").select("r").collect()] == [0.25, 0.25, None, 1.0, 0.5]
    zero = tb.apportion(spark.createDataFrame([("p", "x", 0.0), ("p", "y", 0.0)], "p string, t string, f double"), ["p"], "f", "t")
    assert [r.share for r in zero.collect()] == [0, 0]
    stats = fe.norm_stats(spark.createDataFrame([("g", 1.0, 2.0), ("g", 3.0, 2.0)], "g string, a double, b double"), "g", ["a", "b"])
    assert {r.feature: (r.mu, r.sd) for r in stats.collect()} == {"a": (2.0, 1.0), "b": (2.0, 1.0)}
    assert sw.grid(spark, {"k": [1, 2], "d": ["l1", "l2", "cos"]}).count() == 6
    reg = spark.createDataFrame([("v3", 1, "l1")], "name string, k int, d string")
    named = sw.assign_names(reg, spark.createDataFrame([(1, "l1"), (2, "l1"), (2, "l1")], "k int, d string"), ["k", "d"])
    assert {(r.name, r.k) for r in named.collect()} == {("v3", 1), ("v4", 2)}
    pts = spark.createDataFrame([("s", float(i), y) for i, y in enumerate([0.0, 1.0, 1.0, 4.0])], "s string, x double, y double")
    at = spark.createDataFrame([("s", q / 10) for q in range(-5, 40)], "s string, x double")
    got = {r.x: r.y for r in sw.pchip(pts, "s", "x", "y", at).collect()}
    assert set(got) == {q / 10 for q in range(0, 31)} and got[1.5] == pytest.approx(1.0) and got[3.0] == 4.0
    ys = [got[k] for k in sorted(got)]
    assert all(b >= a - 1e-12 for a, b in zip(ys, ys[1:], strict=False))


def test_entry_works_without_text_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') and k[2:3].isdigit() for k in q); assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
