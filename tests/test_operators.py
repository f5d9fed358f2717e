"""Properties of the operators that SQL can't express, on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windloom.functions.noise import derive_seed, derived_seed
from windloom.operators import aggregate, align, arena, boards, crops, distributions, fields, launcher, lazyfield, physics, planning, spectra, temporal, windows
from windloom.sources import artifact


def plane_cells(spark, f, n=16, s=1):
    return spark.createDataFrame([(k, 0, y, x, *map(float, f(k, y, x))) for k in range(s) for y in range(n) for x in range(n)], "s long, level int, y int, x int, u double, v double")


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=500), np.full(300, 0.25), [np.nan, 1e6]])
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)], "g int, x double")
    qs = [0, 0.001, 0.1, 0.5, 0.77, 0.999, 1]
    got = {(r["g"], r["k"]): r["q"] for r in distributions.exact_quantiles(df, ["g"], "x", qs, bins=16).collect()}
    for g in (0, 1):
        own = [v for i, v in enumerate(x) if i % 2 == g and not np.isnan(v)]
        for k, q in enumerate(qs):
            assert got[(g, k)] == pytest.approx(np.quantile(own, q), abs=1e-9)


def test_quantile_edges_are_computed_once(spark):
    """A sketch merged in another order gives other edges, so no plan that reads the bins twice may hold it."""
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"))
    for by in (["g"], []):
        assert "percentile_approx" not in distributions.exact_quantiles(df, by, "x", [0.5])._jdf.queryExecution().toString()


def test_suite_reads_its_fields_once_for_a_kind_of_quantiles(spark, monkeypatch):
    """Marginal distances and tails come from one pass, and so do the shears of u and v; each is as the operators give it alone."""
    rng = np.random.default_rng(5)
    side = lambda k: spark.createDataFrame([(s, lv, float(a), float(b)) for s in range(40) for lv in (2, 5, 9) for a, b in [k * rng.standard_normal(2)]], "s int, level int, u double, v double")
    pred, ref = side(1.0), side(2.0)
    thickness = spark.createDataFrame([(2, 100.0), (5, 250.0), (9, 500.0)], "level int, dz double")
    passes, plain = [], distributions.exact_quantiles
    monkeypatch.setattr(distributions, "exact_quantiles", lambda *a, **k: passes.append(1) or plain(*a, **k))
    got = {r["metric"]: r["value"] for r in boards.run_suite(pred, ref, thickness=thickness, column=["s"], seeds=(pred, ref, [])).collect()}
    assert len(passes) == 3
    for r in distributions.marginal_w1(pred, ref).collect():
        assert got[f"W1 {r['component']} (m/s)"] == pytest.approx(r["w1"], rel=1e-12)
    for r in distributions.extreme_quantile_error(pred, ref).collect():
        assert got[f"tail err {r['tail']} (m/s)"] == pytest.approx(r["error"], rel=1e-12)
    for c in ("u", "v"):
        x, y = (physics.shear_samples(f, thickness, ["s"], c) for f in (pred, ref))
        assert got[f"W1 shear {c} ((m/s)/km)"] == pytest.approx(distributions.wasserstein1(x, y, [], "shear").first()["w1"], rel=1e-12)


def test_w1_is_zero_on_itself_and_shift(spark):
    df = spark.range(200).select(F.lit(1).alias("level"), F.col("id").cast("double").alias("u"), F.lit(0.0).alias("v"))
    moved = df.withColumn("u", F.col("u") + 3)
    got = {r["component"]: r["w1"] for r in distributions.marginal_w1(moved, df).collect()}
    assert got["u"] == pytest.approx(3) and got["v"] == 0


def test_boundary_coherence_one_for_a_ramp_and_more_for_a_seam(spark):
    ramp = plane_cells(spark, lambda k, y, x: (x, 1))
    r = windows.boundary_coherence(ramp, ["s"], 4).first()
    assert r["jump_ratio"] == pytest.approx(1) and r["squared_ratio"] == pytest.approx(1) and r["direction_gap"] < 5e-3
    rng = np.random.default_rng(4)
    z = rng.normal(size=(16, 16, 2))
    seam = plane_cells(spark, lambda k, y, x: (z[y, x, 0] + 20 * (x >= 8), z[y, x, 1]))
    r = windows.boundary_coherence(seam, ["s"], 8).first()
    assert r["jump_ratio"] > 3 and r["squared_ratio"] > r["jump_ratio"]


def test_segments_keep_episodes(spark):
    rows = [(f"2023-{m:02d}-08 {h:02d}:00:00", float(h), 0.0) for m in (1, 4, 7, 10) for h in range(24)]
    s = windows.segments(spark.createDataFrame(rows, "time string, u double, v double").withColumn("time", F.to_timestamp("time").cast("timestamp_ntz")), least=16)
    assert s.select("segment").distinct().count() == 4
    assert windows.adjacent_change(s, []).first()["change"] == pytest.approx(1)
    assert windows.seam_jump_ratio(s, [], 4).first()["ratio"] == pytest.approx(1)


def test_gradient_matches_numpy(spark):
    z = np.random.default_rng(1).normal(size=(16, 16, 2))
    c = plane_cells(spark, lambda k, y, x: z[y, x])
    got = windows.vorticity_divergence(c, ["s"]).toPandas().sort_values(["y", "x"])
    vort = np.gradient(z[..., 1], axis=1) - np.gradient(z[..., 0], axis=0)
    assert np.allclose(got["vort"].to_numpy().reshape(16, 16), vort)


def test_relational_dft_equals_fft(spark):
    z = np.random.default_rng(2).normal(size=(8, 8, 2))
    c = plane_cells(spark, lambda k, y, x: z[y, x], n=8)
    got = spectra.relational_power(c, ["s"], 8, 8).toPandas().sort_values(["ky", "kx"])["power"].to_numpy().reshape(8, 8)
    f = [np.fft.fft2(z[..., k] - z[..., k].mean()) for k in (0, 1)]
    assert np.allclose(got, 0.5 * (abs(f[0]) ** 2 + abs(f[1]) ** 2))


def test_phase_shuffle_keeps_spectrum(spark):
    z = np.random.default_rng(3).normal(size=64)
    p = spark.createDataFrame([(1, z.tolist(), z.tolist())], "s long, u array<double>, v array<double>")
    r = spectra.phase_shuffle(p, ["s"], 8, 8).first()
    assert np.allclose(abs(np.fft.fft2(np.reshape(r["u"], (8, 8)))), abs(np.fft.fft2(z.reshape(8, 8))))
    assert not np.allclose(r["u"], z)


def test_vertical_interpolation_uses_pressure(spark):
    rows = [(c, float(p), float(p), -2.0 * p) for c in range(4) for p in (50, 100, 150)]
    df = spark.createDataFrame(rows, "c int, p double, u double, v double")
    for r in align.vertical(df, [75.0, 125.0], ["c"]).collect():
        assert r["u"] == r["pressure"] and r["v"] == -2 * r["pressure"]
    with pytest.raises(Exception, match="outside the column"):
        align.vertical(df, [40.0], ["c"]).collect()


def test_multilinear_reproduces_affine(spark):
    g = [(t, i, j, 2.0 * i + 3 * j + 1 + 10 * t) for t in range(4) for i in range(1, 13) for j in range(1, 9)]
    grid = spark.createDataFrame(g, "t int, i int, j int, u double")
    rng = np.random.default_rng(5)
    pts = [(k, float(rng.uniform(0, 13)), float(rng.uniform(0, 9)), float(rng.uniform(-1, 5))) for k in range(20)]
    got = {r["id"]: r["u"] for r in align.multilinear(spark.createDataFrame(pts, "id int, i double, j double, s double"), grid, (4, 12, 8)).collect()}
    for k, i, j, s in pts:
        assert got[k] == pytest.approx(2 * i + 3 * j + 1 + 10 * min(max(s, 0), 3))


def test_pressure_levels_are_ordered(spark):
    p = [r["hpa"] for r in physics.standard_pressure_hpa(spark.range(49, 67).select(F.col("id").cast("int").alias("level"))).orderBy("level").collect()]
    assert all(a < b for a, b in zip(p, p[1:])) and 50 < p[0] and p[-1] < 140


def test_condition_set_is_one_small_task(spark):
    from windloom.operators import boards

    done = spark.createDataFrame([(1, 0, 8, 0), (4, 12, 9, 1), (2, 0, 8, 0)], "month int, hour int, day int, seed int")
    whole = boards.condition_set(spark, [1, 4], [0, 12], range(8, 11), 2)
    assert whole.rdd.getNumPartitions() == 1
    want = {(m, h, d, s) for m in (1, 4) for h in (0, 12) for d in (8, 9, 10) for s in (0, 1)}
    assert sorted(map(tuple, whole.collect())) == sorted(want)
    assert sorted(map(tuple, boards.condition_set(spark, [1, 4], [0, 12], range(8, 11), 2, done).collect())) == sorted(want - {(1, 0, 8, 0), (4, 12, 9, 1)})


def test_condition_sets_must_match(spark):
    a = spark.createDataFrame([(1, 8, 0, 0)], "month int, day int, hour int, seed int")
    align.require_same_keys(a, a, a.columns)
    with pytest.raises(ValueError, match="condition set differs"):
        align.require_same_keys(a, a.withColumn("seed", F.lit(1)), a.columns)


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", float(-k)) for k in range(1, 6)] + [("b", 1.25)], "g string, x double")
    got = {r["g"]: r for r in aggregate.bootstrap(df, ["g"], "x").collect()}
    assert got["a"]["mean"] == -3 and got["a"]["low"] < -3 < got["a"]["high"] < 0
    assert got["b"]["low"] == got["b"]["high"] == 1.25


def test_norm_stats_reject_empty_level(spark):
    df = spark.createDataFrame([(1, float("nan"), 1.0)], "level int, u double, v double")
    with pytest.raises(Exception, match="without finite"):
        aggregate.norm_stats(df).collect()


def test_infinite_field_is_crop_invariant_and_repeats(spark):
    f = lazyfield.InfiniteField(window=8, depth=2, seed=3)
    key = lambda df: {(r["y"], r["x"]): (r["u"], r["v"]) for r in df.collect()}
    small, large = key(f.materialise(spark, 2, 8, 3, 9)), key(f.materialise(spark, 0, 12, 0, 12))
    assert len(small) == 36 and all(np.allclose(small[k], large[k], atol=1e-9) for k in small)


def test_chart_field_is_crop_invariant(spark):
    f = lazyfield.ChartField(core=8, halo=4, window=8, stride=4, seed=3)
    key = lambda df: {(r["y"], r["x"]): (r["u"], r["v"]) for r in df.collect()}
    small, large = key(f.materialise(spark, 2, 6, 3, 7)), key(f.materialise(spark, 0, 10, 0, 10))
    assert all(np.allclose(small[k], large[k], atol=1e-9) for k in small)


def test_window_counts(spark):
    calls = {r["round"]: r["windows"] for r in lazyfield.InfiniteField(window=64, stride=32, depth=1).calls(spark, 0, 64, 0, 64).collect()}
    assert calls == {0: 9}


def test_streamfunction_is_divergence_free(spark):
    f = fields.RandomFeatureField(planar=True, lengthscale=5.0, seed=1)
    h = 1e-4
    at = lambda di, dj: f.velocity(F.lit(3.0) + di, F.lit(4.0) + dj)
    r = spark.range(1).select(((at(h, 0)[0] - at(-h, 0)[0]) / (2 * h)).alias("ui"), ((at(0, h)[1] - at(0, -h)[1]) / (2 * h)).alias("vj")).first()
    assert abs(r["ui"] + r["vj"]) < 1e-6


def test_actor_mass_sums_to_one():
    for scale, noise, most in ((1.0, 0.0, 1), (1.0, 0.5, 2), (2.0, 1.5, 3)):
        m = arena.clipped_gaussian(scale, noise, most)
        assert m.shape == (3, 2 * most + 1) and np.allclose(m.sum(axis=1), 1, atol=1e-5) and np.allclose(m[1], m[1][::-1])


def test_rollouts_repeat_and_truncate(spark):
    a = arena.Arena(np.zeros((15, 15)), mode="clip")
    e = arena.episodes(spark, ["r"], 3)
    x, y = (arena.rollouts(e, a, horizon=20).orderBy("episode", "step").collect() for _ in range(2))
    assert x == y and len(x) == 60 and sum(r["truncated"] for r in x) == 3


def test_backward_induction_equals_arrays(spark):
    n = 5
    drift = np.full((n, n, 3), 1 / 3)
    actor = arena.clipped_gaussian(1.0, 0.4, 1)
    reward = np.array([[0.0 if abs(i - 2) + abs(j - 2) <= 1 else -1.0 for j in range(n)] for i in range(n)])
    rows = [(i + 1, j + 1, k - 1, float(drift[i, j, k])) for i in range(n) for j in range(n) for k in range(3)]
    for mode in ("terminal", "clip", "periodic"):
        moves = planning.transitions(spark, spark.createDataFrame(rows, "i int, j int, d int, p double"), actor, n, n, mode)
        table = spark.createDataFrame([(i + 1, j + 1, float(reward[i, j])) for i in range(n) for j in range(n)], "i int, j int, reward double")
        got = planning.backward_induction(table, moves, 3).toPandas().sort_values(["i", "j"])["value"].to_numpy().reshape(n, n)
        assert np.allclose(got, planning.induct(reward, drift, actor, 3, mode)[0])


def test_warm_start_equals_cold(spark):
    drift = np.zeros((7, 7, 3))
    drift[:, :, 1] = 1
    goals = spark.createDataFrame([(4, 4)], "gi int, gj int")
    how = dict(drift=drift, actor=arena.clipped_gaussian(1.0, 0.0, 2), radius=1.0, tolerance=1e-8)
    cold = planning.shortest_costs(goals, **how).toPandas().sort_values(["i", "j"])["cost"].to_numpy().reshape(7, 7)
    warm = planning.shortest_costs(goals, **how, warm={(4, 4): cold}).toPandas().sort_values(["i", "j"])["cost"].to_numpy().reshape(7, 7)
    assert np.abs(cold - warm).max() < 1e-4


def test_derived_seeds(spark):
    assert spark.range(3).select(derived_seed(F.lit(7), F.col("id")).alias("s")).collect() == [(derive_seed(7, e),) for e in range(3)]


def test_launch_keeps_failures(spark):
    got = {r["name"]: r for r in launcher.launch(spark, {"defaults": {"n": 1}, "runs": [{"name": "a"}, {"name": "b", "n": 0}]}, lambda c: {"x": 1 / c["n"]}).collect()}
    assert got["a"]["error"] is None and "ZeroDivisionError" in got["b"]["error"]


def test_crops_mirror(spark):
    c = plane_cells(spark, lambda k, y, x: (x, y)).withColumn("t", F.col("s").cast("int"))
    idx = spark.createDataFrame([(0, 0, 2, 3, True, False)], "idx long, t0 int, y0 int, x0 int, flip_x boolean, flip_y boolean")
    got = {(r["y"], r["x"]): (r["u"], r["v"]) for r in crops.crops(c, idx, 4).collect()}
    assert got[(0, 0)] == (-6.0, 2.0) and got[(3, 3)] == (-3.0, 5.0)
    ch = crops.channels(crops.crops(c, idx, 4))
    assert {(r["y"], r["x"]): (r["u"], r["v"]) for r in crops.from_channels(ch).collect()} == got


def test_dispersion_of_constant_wind(spark):
    p = spark.createDataFrame([(0, k, [1.0] * 64, [0.0] * 64) for k in range(4)], "segment long, frame int, u array<double>, v array<double>")
    got = {r["lead"]: r for r in temporal.dispersion(p, ["segment"], 8, 8, 10.0, 100.0, 100.0).collect()}
    assert got[3]["msd"] == pytest.approx(900) and got[3]["spread"] == pytest.approx(got[0]["spread"])


def test_artifact_round_trip(spark, tmp_path):
    c = plane_cells(spark, lambda k, y, x: (x, y), n=4)
    attrs = artifact.default_attrs("toy", "none", [0], seed=3)
    artifact.write(c, attrs, str(tmp_path / "a"))
    back, got = artifact.read(spark, str(tmp_path / "a"))
    assert back.exceptAll(c).count() == 0 and got["generator"] == {"name": "toy"} and not artifact.has_query_log(spark, str(tmp_path / "a"))
    artifact.write_query_log(spark.createDataFrame([(1, 2)], "x int, y int"), str(tmp_path / "a"))
    assert artifact.has_query_log(spark, str(tmp_path / "a"))


def test_npz_cache(spark, tmp_path):
    np.savez(tmp_path / "ok.npz", winds=np.arange(24.0).reshape(2, 3, 4, 1))
    assert artifact.cache_from_npz(spark, str(tmp_path / "ok.npz")).count() == 24
    bad = np.ones((2, 4, 3, 1))
    bad[0, 0, 0, 0] = np.nan
    np.savez(tmp_path / "bad.npz", winds=bad)
    with pytest.raises(Exception, match="no finite cache"):
        artifact.cache_from_npz(spark, str(tmp_path / "bad.npz")).collect()


def test_suite_has_dispersion(spark):
    from windloom.operators import boards

    cells = plane_cells(spark, lambda k, y, x: (0.1 * x + k, 0.1 * y), n=8, s=8)
    track = lambda u: spark.createDataFrame([(g, f, 0, [u] * 64, [0.0] * 64) for g in range(2) for f in range(4 - g)], "segment int, frame int, level int, u array<double>, v array<double>")
    got = {r["metric"]: r["value"] for r in boards.run_suite(cells, cells, tracks=(track(2.0), track(1.0))).collect()}
    assert got["disp log-MSD RMSE"] == pytest.approx(np.log(4.0), abs=1e-6) and got["final spread ratio"] == pytest.approx(1.0)
