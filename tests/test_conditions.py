"""Condition runs, shared grids, floors, boards, ingestion: checks that raise, and values against plain arrays."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from windloom.functions.shared import shared_folder
from windloom.operators import conditions, launcher
from windloom.sources import artifact, ingest


def runs(spark, seeds=(0, 1), levels=(1, 2), shift=0.0, days=(8, 9, 11, 12)):
    rng = np.random.default_rng(5)
    rows = [(m, d, h, s, lv, y, x, float(rng.standard_normal() + lv + shift), float(rng.standard_normal())) for m in (1, 4) for d in days for h in (0, 12) for s in seeds for lv in levels for y in range(4) for x in range(4)]
    return spark.createDataFrame(rows, "month int, day int, hour int, seed int, level int, y int, x int, u double, v double")


def test_bands_and_windows(spark):
    r = runs(spark)
    assert conditions.level_band(r, 2, 2).select("level").distinct().count() == 1
    with pytest.raises(ValueError, match="no level"):
        conditions.level_band(r, 50, 60)
    w = conditions.centre_window(r, 2)
    assert w.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first() == (0, 1, 0, 1) and w.count() * 4 == r.count()
    with pytest.raises(ValueError, match="smaller"):
        conditions.centre_window(r, 5)


def test_runs_are_matched_and_checked(spark):
    a, b = conditions.on_common(runs(spark, levels=(1, 2)), runs(spark, seeds=(1, 2), levels=(2, 3)))
    assert {r[0] for r in a.select("level").distinct().collect()} == {2} and {r[0] for r in b.select("seed").distinct().collect()} == {1}
    with pytest.raises(ValueError, match="no common condition"):
        conditions.on_common(runs(spark), runs(spark, seeds=(7,)))
    conditions.require_equal_grid(runs(spark), runs(spark, seeds=(3,)))
    with pytest.raises(ValueError, match="level differs"):
        conditions.require_equal_grid(runs(spark), runs(spark, levels=(1, 3)))
    with pytest.raises(ValueError, match="condition set differs"):
        conditions.score_board(runs(spark), {"a": runs(spark), "b": runs(spark, seeds=(0, 2))})


def test_containment(spark):
    axes = lambda lo, hi: spark.createDataFrame([(lo, lo + 200), (hi, hi + 200)], "lat double, lon double")
    conditions.require_inside(axes(20.0, 50.0), axes(20.0, 50.0))
    with pytest.raises(ValueError, match="does not contain"):
        conditions.require_inside(axes(20.0, 50.0), axes(19.9, 40.0))


def test_episodes(spark):
    day = lambda m, n=24: spark.sql(f"select explode(sequence(timestamp_ntz'2023-{m:02d}-08 00:00:00', timestamp_ntz'2023-{m:02d}-08 00:00:00' + interval {n - 1} hour, interval 1 hour)) as time").withColumns({"u": F.lit(1.0), "v": F.lit(0.0)})
    got = conditions.episodes_joined([day(m) for m in (1, 4, 7, 10)])
    assert got.count() == 96 and {r[0] for r in got.select("segment").distinct().collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError, match="contiguous"):
        conditions.episodes_joined([day(1), day(4, 23)])


def test_shared_grid_of_a_linear_field(spark):
    """value = latitude + 10 * longitude + pressure is read exactly; a target outside is an error."""
    rows = [(0, lv, y, x, 30.0 + y + 10.0 * (230 + x) + 50.0 * (lv + 1), 0.0) for lv in range(3) for y in range(6) for x in range(6)]
    c = spark.createDataFrame(rows, "run int, level int, y int, x int, u double, v double")
    pressure = spark.createDataFrame([(lv, 50.0 * (lv + 1)) for lv in range(3)], "level int, p double")
    lat, lon = [30.25, 33.5], [231.0, 234.75, 235.0]
    got = conditions.to_shared_grid(c, ["run"], (30.0, 1.0, 6), (230.0, 1.0, 6), lat, lon, pressure, 50.0, (75.0, 125.0)).collect()
    assert len(got) == 12
    for r in got:
        assert r["u"] == pytest.approx(lat[r["y"]] + 10 * lon[r["x"]] + r["pressure"])
    with pytest.raises(ValueError, match="does not contain"):
        conditions.to_shared_grid(c, ["run"], (30.0, 1.0, 6), (230.0, 1.0, 6), [29.0], lon, pressure, 50.0)
    with pytest.raises(Exception, match="outside the column"):
        conditions.to_shared_grid(c, ["run"], (30.0, 1.0, 6), (230.0, 1.0, 6), lat, lon, pressure, 50.0, (40.0,)).collect()


def test_floor_needs_both_halves(spark):
    stamp = F.make_timestamp_ntz(F.lit(2023), F.col("month"), F.col("day"), F.col("hour"), F.lit(0), F.lit(0))
    got = {r["metric"]: r["value"] for r in conditions.floor(runs(spark).withColumn("time", stamp)).collect()}
    assert got["W1 u (m/s)"] > 0 and got["W1 cond (m/s)"] > 0
    with pytest.raises(ValueError, match="both sides"):
        conditions.floor(runs(spark, days=(8, 9)).withColumn("time", stamp))


def test_run_metrics(spark):
    rng = np.random.default_rng(3)
    u, v = rng.standard_normal((2, 4, 2, 8, 8))
    cells = spark.createDataFrame([(t, lv, y, x, float(u[t, lv, y, x]), float(v[t, lv, y, x])) for t in range(4) for lv in range(2) for y in range(8) for x in range(8)], "t int, level int, y int, x int, u double, v double")
    planes = spark.createDataFrame([(t, lv, u[t, lv].ravel().tolist(), v[t, lv].ravel().tolist()) for t in range(4) for lv in range(2)], "t int, level int, u array<double>, v array<double>")
    got = {r["metric"]: r["value"] for r in conditions.field_metrics(cells, planes, 8, 8, (3, 3, 1)).collect()}
    jump = lambda axis: np.sqrt(np.diff(u, axis=axis) ** 2 + np.diff(v, axis=axis) ** 2)
    s = np.hypot(u, v)
    want = {"u_mean_mps": u.mean(), "v_std_mps": v.std(), "speed_p95_mps": np.quantile(s, 0.95), "speed_max_mps": s.max(), "mean_temporal_vector_change_mps": jump(0).mean()}
    want |= {f"{n}_boundary_ratio": np.take(jump(a), k, a).mean() / jump(a).mean() for n, a, k in (("x", 3, 3), ("y", 2, 3), ("time", 0, 1))}
    want["grid_vorticity_std"] = (np.gradient(v, axis=3) - np.gradient(u, axis=2)).std()
    want["mean_adjacent_frame_correlation"] = np.mean([np.corrcoef(np.r_[u[t, lv].ravel(), v[t, lv].ravel()], np.r_[u[t + 1, lv].ravel(), v[t + 1, lv].ravel()])[0, 1] for t in range(3) for lv in range(2)])
    assert len(got) == 16 and {k: got[k] for k in want} == pytest.approx(want)


def test_boards(spark, tmp_path):
    scores = spark.createDataFrame([(p, e, s, "m", float(p + s + (e == "a"))) for p in (4, 16) for e in "ab" for s in range(5)], "profile int, entity string, seed int, metric string, value double")
    d = conditions.paired_differences(scores.where("profile = 4"), "a", "b").first()
    assert (d["n"], d["mean"], d["low"], d["high"]) == (5, 1.0, 1.0, 1.0)
    board = conditions.tile_board(scores.groupBy("profile", "metric").agg(F.avg("value").alias("value")), spark.createDataFrame([(4, 1.0), (16, 2.0)], "profile int, seconds double"), spark.createDataFrame([(4, 1.1), (16, 1.2)], "profile int, jump_ratio double"))
    conditions.write_summary(board, str(tmp_path / "summary"))
    back = spark.read.option("header", True).csv(str(tmp_path / "summary"))
    assert back.count() == 2 and set(back.columns) == {"profile", "m", "seconds", "jump_ratio"}
    gate = conditions.passes(spark.createDataFrame([("x", 3.0), ("y", 1.0), ("z", float("nan"))], "metric string, value double"), spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 1.0)], "metric string, value double"))
    assert {r["metric"]: r["ok"] for r in gate.collect()} == {"x": False, "y": True}
    told = json.loads(conditions.block_comparison(runs(spark).where("month = 1").withColumn("t", F.col("day") * 100 + F.col("hour") + F.col("seed")), runs(spark, shift=2.0).where("month = 1").withColumn("t", F.col("day") * 100 + F.col("hour") + F.col("seed"))))
    assert told["rmse"] == pytest.approx(np.sqrt(2.0)) and told["marginal_w1"] == pytest.approx(1.0)


def test_ingestion(spark, tmp_path):
    part = lambda a: spark.sql(f"select explode(sequence(timestamp_ntz'2023-01-{a:02d} 00:00:00', timestamp_ntz'2023-01-{a:02d} 05:00:00', interval 1 hour)) as time").withColumn("u", F.lit(float(a)))
    ingest.ingest([part(3), part(1), part(2)], str(tmp_path / "a"), artifact.default_attrs("x", "none", [0]))
    back, _ = artifact.read(spark, str(tmp_path / "a"))
    assert back.count() == 18
    ingest.save_stats(spark.createDataFrame([(1, 2.0)], "level int, mean_u double"), str(tmp_path / "s"))
    assert ingest.load_stats(spark, str(tmp_path / "s")).first() == (1, 2.0)
    assert [r["hpa"] for r in ingest.pressure_levels(spark, [60, 130, 90], 3).collect()] == [130.0, 90.0, 60.0]
    with pytest.raises(ValueError):
        ingest.pressure_levels(spark, [0, 10], 2)


def test_demo_cache(spark):
    for shape, dims in (((12, 10), ["t", "i", "j"]), ((6, 5, 4), ["t", "i", "j", "k"])):
        c = ingest.demo_cache(spark, shape, frames=6, seed=2)
        assert c.columns[: len(dims)] == dims and c.count() == 6 * int(np.prod(shape))
        r = c.agg(F.avg("u"), F.stddev_pop("u")).first()
        assert r[1] == pytest.approx(6.0, rel=1e-6) and abs(r[0] - 12.0) < 24
    assert c.exceptAll(ingest.demo_cache(spark, (6, 5, 4), frames=6, seed=2)).isEmpty()
    with pytest.raises(ValueError):
        ingest.demo_cache(spark, (3,))


def test_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text("model: {width: 64, deep: true}\ntrain: {rate: 0.1}\n")
    assert ingest.load_config(str(tmp_path / "c.yaml")) == {"model": {"width": 64, "deep": True}, "train": {"rate": 0.1}}
    assert ingest.load_config(str(tmp_path / "c.yaml"), {"width": "32", "rate": "1e-3", "deep": "false"}, ()) == {"width": 32, "deep": False, "rate": 0.001}
    with pytest.raises(KeyError):
        ingest.load_config(str(tmp_path / "c.yaml"), {"nothing": "1"}, ())


def test_manifest_is_written_after_all_checks(spark, tmp_path):
    fine, bad = spark.createDataFrame([], "time string"), spark.createDataFrame([("2023",)], "time string")
    with pytest.raises(ValueError, match="gaps"):
        ingest.manifest(spark, str(tmp_path / "m"), {"years": [2018]}, {"levels": fine, "gaps": bad})
    assert not (tmp_path / "m").exists()
    ingest.manifest(spark, str(tmp_path / "m"), {"years": [2018]}, {"levels": fine, "gaps": fine})
    assert json.loads("".join(r[0] for r in spark.read.text(str(tmp_path / "m")).collect())) == {"years": [2018], "checks": ["gaps", "levels"]}


def test_registered_runs(spark):
    launcher.register("double", lambda c: {"x": 2 * c["n"]})
    got = {r["name"]: r for r in launcher.launch(spark, {"defaults": {"run": "double", "n": 4}, "runs": [{"name": "a"}, {"name": "b", "run": "none"}]}).collect()}
    assert json.loads(got["a"]["result"]) == {"x": 8} and "unknown run" in got["b"]["error"]


def test_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
