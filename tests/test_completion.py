"""Observations, leagues, fits, schema and metric tables against hand-made rows and numpy."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import quality as dq
from fieldloom.functions import catalogue as cat
from fieldloom.functions import scalars as fn
from fieldloom.operators import artefacts as art
from fieldloom.operators import evaluation as ev
from fieldloom.operators import fit
from fieldloom.operators import geometry as geo
from fieldloom.operators.matrices import ease_kernel
from fieldloom.operators import observations as ob
from fieldloom.operators import ranking as rk
from fieldloom.sources import metrics as mt
from fieldloom.sources import package, schemas


def test_overlap_of_lists_of_unequal_length(spark):
    rows = [([1, 2, 3], [1]), ([1], [1, 2, 3]), ([], []), ([1], []), ([1, 2, 3, 4], [2, 1, 9]), (list(range(10)), list(range(10)))]

    def brute(a, b, p=0.9):
        if not a and not b:
            return 1.0
        if not a or not b:
            return 0.0
        k = max(len(a), len(b))
        agreed = [len(set(a[:d]) & set(b[:d])) / d for d in range(1, k + 1)]
        return (1 - p) * sum(x * p**d for d, x in enumerate(agreed)) + agreed[-1] * p**k

    got = spark.createDataFrame(rows, "a array<int>, b array<int>").select(ev.rbo(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in got] == pytest.approx([brute(a, b) for a, b in rows])
    assert got[0].r == pytest.approx(0.415, abs=5e-4) == got[1].r


def test_names_with_any_marks(spark):
    names = ["Čech Őrs Şahin", " José Ángel ", "Łukasz", "ﬁne № ½", "日本", "", None, "ÀÉ́"]
    want = ["cech ors sahin", "jose angel", "ukasz", "fine no 12", "", "", None, "ae"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", fn.normalize_name(F.col("n")).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == want


@pytest.mark.parametrize("most", [10_000, 1])
def test_names_resolved_in_rounds(spark, most):
    names = spark.createDataFrame([(1, "José"), (2, "Jose"), (3, "Anna"), (4, "Joanna"), (5, "Čech")], "id int, name string")
    asked = spark.createDataFrame([("jose",), ("ANNA",), ("oann",), ("ann",), ("cech ",), ("zz",), ("o",)], "text string")
    got = {r.text: (r.status, r.id) for r in rk.resolve(names, asked, most=most).collect()}
    assert got == {"jose": ("exact", 1), "ANNA": ("exact", 3), "oann": ("unique", 4), "ann": ("ambiguous", None), "cech ": ("exact", 5), "zz": ("absent", None), "o": ("ambiguous", None)}


def test_mahalanobis_needs_and_uses_a_root(spark):
    x = np.random.default_rng(3).normal(size=(60, 4)) @ np.diag([1, 2, 5, 0.3])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    with pytest.raises(ValueError):
        geo.dist(F.col("x"), F.col("x"), "mahalanobis")
    with pytest.raises(ValueError):
        geo.knn(df, df, 3, "mahalanobis")
    root, inverse = geo.fit_whitening(df, "x", 4), np.linalg.inv(np.cov(x.T))
    d = lambda a, b: float(np.sqrt((a - b) @ inverse @ (a - b)))
    pairs = df.alias("p").join(df.alias("q"), F.col("p.id") + 1 == F.col("q.id")).select(F.col("p.id").alias("id"), geo.dist(F.col("p.x"), F.col("q.x"), "mahalanobis", root).alias("d")).collect()
    assert {r.id: r.d for r in pairs} == pytest.approx({i: d(x[i], x[i + 1]) for i in range(59)})
    near = {(r.id, r["rank"]): r.neighbour for r in geo.knn(df, df.filter("id < 5"), 2, "mahalanobis", root=root).collect()}
    for i in range(5):
        assert [near[i, 1], near[i, 2]] == sorted((j for j in range(60) if j != i), key=lambda j: d(x[i], x[j]))[:2]


def test_fits_against_closed_forms(spark):
    rng = np.random.default_rng(8)
    rows = [(e, m, 1.0 + m % 3, rng.normal(e % 3, 1, 4).tolist()) for e in range(7) for m in range(6)]
    fm = spark.createDataFrame(rows, "entity_id bigint, match_id bigint, mass double, x array<double>")
    got = fit.fit_f5(fm, 4, 6, dim=64, ease=0.05, sigma=2.0)
    w, b = geo.omega(4, 64, 2.0, 7)
    z = {e: sum(m * np.sqrt(2 / 64) * np.cos(np.array(x) @ w + b) for i, _, m, x in rows if i == e) for e in range(7)}
    unit = np.stack([z[e] / np.linalg.norm(z[e]) for e in range(7)])
    s = unit @ unit.T
    np.fill_diagonal(s, 0)

    def ease(s, lam):
        p = np.linalg.inv(s.T @ s + lam * np.eye(len(s)))
        c = -p / np.diag(p)
        np.fill_diagonal(c, 0)
        return (s @ c + (s @ c).T) / 2

    want = ease(s, 0.05)
    told = {(r.a, r.b): r.score for r in got["scores"].collect()}
    assert told == pytest.approx({(i, j): want[i, j] for i in range(7) for j in range(7) if i != j})
    pairs = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(7) for j in range(7) if i != j], "a bigint, b bigint, score double")
    blocked = {(r.a, r.b): r.score for r in ease_kernel(pairs, 0.05, 6, size=2).collect()}
    assert blocked == pytest.approx(told)
    moved = fit.fit_f5(fm, 4, 6, method="sinkhorn", ease=0.1, block=3)["scores"]
    assert moved.count() == 42 and {r.entity_id: len(r.x) for r in got["display"].collect()} == {e: 4 for e in range(7)}
    assert fit.preset("team", "5", "global") == fit.SERVED_PARAMETERS["team"] and fit.preset("team", "5", "by_league") == {} == fit.preset("player", "5", "by_league", "cosine")


def test_rebuild_under_groups_and_masses(spark):
    rng = np.random.default_rng(9)
    fm = spark.createDataFrame([(e, m, 1.0, rng.normal(e, 1, 3).tolist()) for e in range(4) for m in range(6)], "entity_id bigint, match_id bigint, mass double, x array<double>")
    groups = fm.select("entity_id", "match_id", F.concat(F.col("entity_id").cast("string"), F.when(F.col("match_id") % 2 == 0, "a").otherwise("b")).alias("group"))
    plain = {(r.a, r.b): r.score for r in fit.fit_f2(fm, neighbours=5)["scores"].collect()}
    assert {(r.a, r.b): r.score for r in fit.rebuild(fm, "2", neighbours=5).collect()} == pytest.approx(plain)
    halves = {(r.a, r.b): r.score for r in fit.rebuild(fm, "2", groups, neighbours=5).collect()}
    for (a, b), v in plain.items():
        # an entity's score is the mean over its halves, which weigh the same
        assert v == pytest.approx(sum(halves.get((f"{a}{x}", f"{b}{y}"), 0.0) for x in "ab" for y in "ab") / 4, rel=1e-3)
    twice = fit.rebuild(fm, "2", masses=fm.select("entity_id", "match_id", (F.col("mass") * 2).alias("mass")), neighbours=5)
    assert {(r.a, r.b): r.score for r in twice.collect()} == pytest.approx(plain)


def stats_of(spark):
    rows = [(1, 100, 7, 90.0, "Goalkeeper"), (1, 101, 8, 30.0, "Left Wing"), (1, 102, 7, 10.0, "Left Wing"), (2, 100, 7, 60.0, "Secondary Striker"), (3, 999, None, 5.0, None)]
    stats = spark.createDataFrame(rows, "player_id bigint, match_id bigint, team_id bigint, minutes_played double, primary_position_name string")
    matches = spark.createDataFrame([(100, 1, 2, "2020-02-01"), (101, 1, 2, "2020-03-01"), (102, 5, 2, "2020-01-01")], "match_id bigint, competition_id bigint, season_id bigint, match_date string")
    return stats, matches


def test_observations_and_careers(spark):
    stats, matches = stats_of(spark)
    names = spark.createDataFrame([(1, "One"), (2, "Two")], "player_id bigint, player_name string")
    places = spark.createDataFrame([(1, 100, 1, "Goalkeeper", 30.0), (1, 100, 21, "Left Wing", 60.0), (2, 100, 25, "Secondary Striker", 0.0)], "player_id bigint, match_id bigint, position_id int, position_name string, minutes double")
    rows = ob.load_observations("player", stats, names, matches, places)
    got = {(r.entity_id, r.match_id): r for r in rows.collect()}
    assert set(got) == {(1, 100), (1, 101), (1, 102), (2, 100)} and got[1, 100].entity_name == "One" and got[1, 102].league_key == "5-2"
    assert (got[1, 100].pos_goalkeeper, got[1, 100].pos_left_wing, got[1, 101].pos_left_wing, got[2, 100].pos_secondary_striker) == pytest.approx((1 / 3, 2 / 3, 0, 0))
    assert len(ob.POSITION_FEATURES) == 25 == len([c for c in rows.columns if c.startswith("pos_")])
    assert {r.entity_id: r.leagues for r in ob.leagues_per_entity(rows, matches).collect()} == {1: ["5-2", "1-2"], 2: ["1-2"]}
    with pytest.raises(ValueError):
        ob.load_observations("club", stats, names, matches)
    with pytest.raises(ValueError):
        ob.exclude_leagues(rows, rows.select("league_key"))
    assert {r.player_id: r.role for r in ob.role_per_player(stats.filter("player_id < 3")).collect()} == {1: "GK", 2: "???"}
    clubs = ob.career(stats, spark.createDataFrame([(7, "Seven")], "team_id bigint, team_name string"), matches)
    told = [(r.player_id, r.club, r.league, r.minutes, r.matches, r.since, r.current) for r in clubs.orderBy("player_id", "place").collect()]
    assert told == [
        (1, "Seven", "5-2", 10.0, 1, "2020-01-01", False), (1, "Seven", "1-2", 90.0, 1, "2020-02-01", False), (1, "Team 8", "1-2", 30.0, 1, "2020-03-01", True),
        (2, "Seven", "1-2", 60.0, 1, "2020-02-01", True),
    ]
    assert [(r.league, r.clubs) for r in ob.league_steps(clubs).filter("player_id = 1").orderBy("step").collect()] == [("5-2", ["Seven"]), ("1-2", ["Seven", "Team 8"])]


def test_position_block_modes(spark):
    z = spark.createDataFrame([(1, 1, 5.0, 2.0)], "entity_id bigint, match_id bigint, pos_goalkeeper double, passes double").withColumns({p: F.lit(1.0) for p in ob.POSITION_FEATURES if p != "pos_goalkeeper"})
    raw = z.withColumn("pos_goalkeeper", F.lit(0.25))
    assert ob.scale_positions(z).first()["pos_goalkeeper"] == 1.0 and ob.scale_positions(z).first()["passes"] == 2.0
    assert ob.scale_positions(z, mode="zscore").first()["pos_goalkeeper"] == 5.0 and ob.scale_positions(z, raw, "raw").first()["pos_goalkeeper"] == 0.25
    with pytest.raises(ValueError):
        ob.scale_positions(z, mode="other")


def test_holdouts_and_alignment(spark):
    leagues = spark.createDataFrame([("1-2", "Indian Super 2020"), ("3-4", "La Liga 2020"), ("5-6", "")], "league_key string, name string")
    assert {(r.league_key, r["first"]) for r in ob.resolve_holdout(leagues, ["india", "", "3-4", "2020"]).collect()} == {("1-2", 0), ("3-4", 2)}
    with pytest.raises(ValueError):
        ob.resolve_holdout(leagues, ["india", "nowhere"])
    table = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "entity_id bigint, a double, b double")
    model = spark.createDataFrame([(2,), (9,)], "entity_id bigint")
    got = ob.align(table, model, ["b", "zz"])
    assert got.columns == ["entity_id", "b", "zz"] and {tuple(r) for r in got.collect()} == {(2, 5.0, None), (9, None, None)}
    with pytest.raises(ValueError):
        ob.align(table, model, ["zz"])
    with pytest.raises(ValueError):
        ob.align(table, model.filter("entity_id = 9"), ["a"])


def test_schema_metrics_and_reports(spark, tmp_path):
    stats, matches = stats_of(spark)
    wide = schemas.conform(stats, "player_match_stats")
    assert wide.columns[:6] == ["player_id", "match_id", "team_id", "minutes_played", "primary_position_id", "primary_position_name"] and wide.columns[6:] == cat.PLAYER_COUNTS and len(schemas.TABLES) == 9
    with pytest.raises(ValueError):
        schemas.conform(stats.drop("match_id"), "player_match_stats")
    schemas.write_star({"matches": matches, "player_match_stats": stats}, f"file://{tmp_path}/star")
    assert spark.read.parquet(f"file://{tmp_path}/star/player_match_stats").filter("competition_id = 5").count() == 1
    old = spark.createDataFrame([("v1", "m", "2", "x"), ("v1", "m", "5", "0.5")], "combination string, model string, formulation string, value string")
    mt.write_csv(old, f"file://{tmp_path}/m")
    got = {(r.model, r.distance, r.formulation, r.value) for r in mt.read_metrics(spark, f"file://{tmp_path}/m").collect()}
    assert got == {("m_euclidean", "euclidean", "2", None), ("m_euclidean", "euclidean", "5", 0.5)}
    mt.write_eval({"phase0": old.select("value"), "phase1": old.select("model")}, f"file://{tmp_path}/eval", {"variant": "v9"})
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/eval/phase0").columns == ["variant", "value"]


def test_state_and_structure(spark, tmp_path):
    fm = spark.createDataFrame([(1, 5, [0.0, 1.0]), (1, 6, [-0.0, 1.0])], "entity_id bigint, match_id bigint, x array<double>")
    state = art.state_tables(fm, {"sigma": "2.5"})
    assert set(state) == {"obs", "state_meta"} and len({r.hash for r in state["obs"].collect()}) == 1
    assert [tuple(r) for r in state["state_meta"].collect()] == [("sigma", "2.5")]
    for d in ("events", "lineups"):
        (tmp_path / d).mkdir()
    for place, i, text in (("events", 1, json.dumps([{}])), ("events", 2, "{"), ("events", 3, "{}"), ("lineups", 1, "[]"), ("lineups", 2, "[]"), ("lineups", 3, "[]")):
        (tmp_path / place / f"{i}.json").write_text(text)
    matches = spark.createDataFrame([(i,) for i in range(1, 5)], "match_id bigint")
    got = {(r.place, r.match_id, r.message) for r in package.validate_structure(spark, f"file://{tmp_path}", matches).collect()}
    assert got == {("events", 2, "the file is no JSON"), ("events", 3, "the file is no list"), ("events", 4, "the file is missing"), ("lineups", 4, "the file is missing")}


def test_ingest_items(spark):
    rows = lambda *v: spark.createDataFrame(list(v), "a bigint, b string")
    keys = {"matches": ["a"], "leagues": ["a", "b"], "teams": ["b"]}
    batch = rows((1, "x"), (1, "x"), (2, None), (3, "y"))
    got = dq.ingest_items({"matches": rows((1, "q"), (9, "q")), "leagues": rows((2, None), (1, "y"))}, dict.fromkeys(keys, batch), keys)
    want = {("matches", "1", "updated"), ("matches", "2", "new"), ("matches", "3", "new"), ("leagues", "1/x", "new"), ("leagues", "2/", "updated"), ("leagues", "3/y", "new")}
    assert sorted(map(tuple, got.collect())) == sorted(want | {("teams", "x", "new"), ("teams", "y", "new"), ("teams", "", "new")})
    assert dq.ingest_items({}, {"matches": rows()}, keys).count() == 0


def test_required_fields_of_players_and_spells(spark):
    rows = [(1, [("p", 7, [(1, "Goalkeeper", "00:00"), (None, None, "45:00")]), (None, 8, None)]), (2, [("q", 9, [])]), (3, None)]
    spell = "struct<position_id: int, position: string, from: string>"
    lineups = spark.createDataFrame(rows, f"match_id bigint, lineup array<struct<player_name: string, player_id: bigint, positions: array<{spell}>>>")
    players, spells = dq.lineup_members(lineups)
    told = lambda df, place: sorted((r.match_id, r.message) for r in dq.check_required(df, place).collect())
    assert told(players, "players") == [(1, "1 rows lack player_name"), (1, "1 rows lack positions")]
    assert told(spells, "spells") == [(1, "1 rows lack position"), (1, "1 rows lack position_id")]
