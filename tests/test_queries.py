"""Every registered query of the engine's own operators against its SQL, on the smallest data."""

import math
import os

import duckdb
import pytest

from windloom.plans.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=str)
    cur = duck.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name, key", [("advected_field", "s"), ("periodic_replay", "t")])
def test_whole_table(spark, sf_dir, name, key):
    """Every slice reaches the result, and unmoved cells are the table's own."""
    from windloom.sources.views import cells

    got, c = QUERIES[name](spark, sf_dir), cells(spark, sf_dir)
    assert {r[0] for r in c.select("s").distinct().collect()} <= {r[0] for r in got.select(key).distinct().collect()}
    own = got.where("frame = 0" if name == "advected_field" else "y between 0 and 7 and x between 0 and 7").selectExpr(f"{key} as s", "y", "x", "u as u1")
    both = c.join(own, ["s", "y", "x"])
    assert both.count() == c.count() and both.where("y < 7 and x < 7 and abs(u - u1) > 1e-4").count() == 0  # the last line is read a little before the edge


def test_patch_distance_has_the_operator_s_constants(spark, sf_dir):
    from windloom.operators import ensemble
    from windloom.plans.base import rounded
    from windloom.sources.views import cells

    c = cells(spark, sf_dir)
    want = rounded(ensemble.multiscale_patch_distance(c.where("s % 2 = 0"), c.where("s % 2 = 1"), 8, (1, 2, 4), count=2048, projections=64)).collect()
    got = QUERIES["patch_distance"](spark, sf_dir).collect()
    assert [(r["factor"], plain(r["distance"])) for r in got] == [(r["factor"], plain(r["distance"])) for r in want]
    assert [math.isnan(r["distance"]) for r in sorted(got, key=lambda r: r["factor"])] == [False, True, True]  # planes of 8 hold no patch of 5 when halved


def test_board_rounds_distances_as_its_sql_does(spark, sf_dir, monkeypatch):
    """The SQL rounds them to four digits and then to three: 0.26546 is 0.2655 and then 0.266, other metrics are rounded once."""
    from windloom.operators import boards

    rows = [(0, "W1 v (m/s)", 0.26546), (1, "W1 u (m/s)", 8.03449), (2, "W1 cond (m/s)", 0.26546)]
    monkeypatch.setattr(boards, "run_suite", lambda *a, **k: spark.createDataFrame(rows, "ord int, metric string, value double"))
    got = {r["metric"]: r["value"] for r in QUERIES["flagship_board"](spark, sf_dir).collect()}
    want = {m: duckdb.sql(f"select round(round({v}::double, 4), 3)" if m != "W1 cond (m/s)" else f"select round({v}::double, 3)").fetchall()[0][0] for _, m, v in rows}
    assert got == want and got["W1 v (m/s)"] == 0.266


def test_suite_board_has_values(spark, sf_dir):
    got = {r["metric"]: r["value"] for r in QUERIES["suite_board"](spark, sf_dir).collect()}
    assert not [m for m in ("W1 cond (m/s)", "SR_time", "disp log-MSD RMSE", "final spread ratio") if math.isnan(got[m])]
