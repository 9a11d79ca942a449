"""Registered queries against their SQL on rows that two engines round apart."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import scalars as fn
from fieldloom.plans import match_queries, model_queries, package_queries, queries  # noqa: F401  (register their queries)
from fieldloom.plans.registry import ORACLE, QUERIES


def same(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    want, got = cur.fetchall(), QUERIES[name](spark, folder)
    order = [[d[0] for d in cur.description].index(c) for c in got.columns]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want)


@pytest.fixture
def late(tmp_path):
    """Events five seconds apart; half of them lie less than half a millisecond before a whole second, some of these before a whole minute."""
    path = str(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"""copy (select i::bigint event_id, timestamp '2024-01-01 00:00:00' + interval (i * 5 + 4) second + interval (case when i % 2 = 1 then 999600 else 1000 end) microsecond ts,
      (i * 7 % 11)::bigint user_id, ['click', 'view', 'purchase', 'error', 'signup'][i * 13 % 17 % 5 + 1] event_type, 1.5::double "value", '{{"k": ' || (i * 31 % 96) || '}}' props from range(2000) t(i)) to '{path}' (format parquet)""")
    con.execute(f"copy (select 0 r_regionkey, 'AFRICA' r_name union all select 1, 'AMERICA') to '{tmp_path}/region.parquet' (format parquet)")
    return str(tmp_path)


def test_seconds_of_an_instant_are_those_of_its_milliseconds(spark):
    at = [dt.datetime(2024, 1, 1, 0, 0, 0, us) for us in (999500, 999499, 0, 500)] + [dt.datetime(1969, 12, 31, 23, 59, 58, us) for us in (0, 500, 500000, 999500)]
    con = duckdb.connect()
    want = [con.execute("select epoch_ms(?::timestamp) // 1000", [t]).fetchone()[0] for t in at]
    rows = spark.createDataFrame([(i, str(t)) for i, t in enumerate(at)], "i int, t string").select("i", fn.epoch_seconds(F.col("t").cast("timestamp")).alias("s"))
    assert [r.s for r in sorted(rows.collect())] == want


@pytest.mark.parametrize("name", ["package_events", "player_match_metrics", "possession_sequences", "sequence_metrics"])
def test_events_just_before_a_second(spark, late, name):
    same(spark, late, name, "events")


def test_balances_in_the_middle_between_two_shown_values(spark, tmp_path):
    values = [-818.85, -818.55, -817.25, -814.05, -813.75, 818.85, 4.35, 1234.55]
    duckdb.connect().execute(f"copy (select i::bigint s_suppkey, 'S' || i s_name, 0 s_nationkey, ({values}::double[])[i // 6 % {len(values)} + 1] s_acctbal from range(200) t(i)) to '{tmp_path}/supplier.parquet' (format parquet)")
    same(spark, str(tmp_path), "shown_metrics", "supplier")


def test_small_shares_as_text(spark):
    values = [0.0, 1e-06, 1e-05, 3.3e-05, 0.0001, 0.000167, 0.00102, 0.5, 1.0]
    con = duckdb.connect()
    want = [con.execute("select ?::double::varchar", [v]).fetchone()[0] for v in values]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fn.share_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in sorted(got)] == want


def test_phase_scores_do_not_depend_on_the_order_of_rows(spark):
    from fieldloom.operators import features as fe

    z = [("a", 0.1), ("b", 0.7), ("c", 1e16), ("d", -1e16)]
    phases = spark.createDataFrame([("p", f) for f, _ in z], "phase string, feature string")
    rows = [(i, *z[(i + k) % 4]) for i in range(4) for k in range(4)]
    long = spark.createDataFrame(rows, "entity int, feature string, z double").coalesce(1)
    assert len({r.score for r in fe.phase_profile(long, phases, "entity", []).collect()}) == 1
