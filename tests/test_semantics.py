"""Operators against plain array versions, written out again here."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from windloom.functions import noise
from windloom.operators import arena, boards, distributions, lazyfield, physics, spectra, temporal, windows


def field(spark, u, v):
    """(s, y, x) arrays as cells."""
    rows = [(s, y, x, float(u[s, y, x]), float(v[s, y, x])) for s in range(u.shape[0]) for y in range(u.shape[1]) for x in range(u.shape[2])]
    return spark.createDataFrame(rows, "s int, y int, x int, u double, v double")


def coherence(u, v, stride):
    out = {}
    pairs = []
    for axis in (2, 1):
        n = u.shape[axis]
        a, b = np.arange(n - 1), np.arange(1, n)
        ua, ub, va, vb = (np.take(f, i, axis) for f, i in ((u, a), (u, b), (v, a), (v, b)))
        jump = np.hypot(ub - ua, vb - va)
        cosine = (ua * ub + va * vb) / np.maximum(np.hypot(ua, va) * np.hypot(ub, vb), 1e-6)
        seam = np.broadcast_to(((b % stride) == 0).reshape([-1 if k == axis else 1 for k in range(3)]), jump.shape)
        pairs.append((jump.ravel(), cosine.ravel(), seam.ravel()))
    jump, cosine, seam = (np.concatenate(x) for x in zip(*pairs))
    out["jump_ratio"], out["squared_ratio"] = jump[seam].mean() / jump.mean(), (jump[seam] ** 2).mean() / (jump**2).mean()
    out["seam_cosine"], out["all_cosine"] = cosine[seam].mean(), cosine.mean()
    return out | {"direction_gap": out["all_cosine"] - out["seam_cosine"]}


@pytest.mark.parametrize("kind", ["ramp", "rotating", "noise", "seam"])
def test_boundary_coherence(spark, kind):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:16, :16]
    u, v = {"ramp": (x + 0.0, np.ones_like(x)), "rotating": (np.cos(0.3 * x + 0.1 * y), np.sin(0.3 * x + 0.1 * y)), "noise": rng.standard_normal((2, 16, 16)), "seam": rng.standard_normal((2, 16, 16))}[kind]
    u, v = np.stack([u, u if kind == "rotating" else 2 * u]).astype(float), np.stack([v, v]).astype(float)
    if kind == "seam":
        u[..., 8:] += 20
    got = windows.boundary_coherence(field(spark, u, v), ["s"], 8).first().asDict()
    want = coherence(u, v, 8)
    assert {k: pytest.approx(want[k], abs=1e-9) for k in want} == got
    if kind == "seam":
        assert got["jump_ratio"] > 3 and got["squared_ratio"] > got["jump_ratio"]
    if kind == "rotating":
        assert got["all_cosine"] == pytest.approx((math.cos(0.3) + math.cos(0.1)) / 2)


def test_advantages(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for g in range(6):
        n = int(rng.integers(1, 9))
        r, v, d = rng.standard_normal(n), rng.standard_normal(n), rng.random(n) < 0.3
        last, over = float(rng.standard_normal()), bool(g % 2)
        rows += [(g, t, float(r[t]), float(v[t]), bool(d[t]), last, over) for t in range(n)]
        after, done, adv, out = np.append(v[1:], last), np.append(d[1:], over), 0.0, []
        for t in reversed(range(n)):
            adv = r[t] + 0.99 * after[t] * (1 - done[t]) - v[t] + 0.99 * 0.95 * (1 - done[t]) * adv
            out.insert(0, adv)
        want[g] = (out, (np.array(out) + v).tolist())
    df = spark.createDataFrame(rows, "g int, step int, reward double, value double, done boolean, last_value double, last_done boolean")
    for row in windows.advantages(df, ["g"], last_value="last_value", last_done="last_done").collect():
        assert row["gae"] == pytest.approx(want[row["g"]][0]) and row["returns"] == pytest.approx(want[row["g"]][1])


def test_navigation_reward(spark):
    i, j = F.col("i"), F.col("j")
    got = {(r["i"], r["j"]): r["r"] for r in arena.grid(spark, 5, 5).select("i", "j", arena.navigation_reward(i, j, (3.0, 3.0)).alias("r")).collect()}
    assert got[3, 3] == pytest.approx(9.9) and got[1, 3] == pytest.approx(9.9 / 1.2) and min(got.values()) > 0
    with pytest.raises(ValueError):
        arena.navigation_reward(i, j, (3.0, 3.0), peak=0.1)


def test_arena_reads_before_it_moves():
    f = np.zeros((9, 9))
    f[1, 1], f[3, 1] = 2.0, -1.0
    a = arena.Arena(f, mode="clip", seen=f * 0.25)
    i, j, seen, left, _ = a.step(2.0, 2.0, 1, np.random.default_rng(0))
    assert (i, j, seen, left) == (4.0, 2.0, 0.5, False)
    assert arena.Arena(f, mode="clip", scale=2.0).step(2.0, 9.0, 2, np.random.default_rng(0))[1:4] == (9.0, 0.0, True)
    assert arena.Arena(f, mode="periodic").step(4.0, 2.0, 1, np.random.default_rng(0))[0] == 3.0


def series(spark, lengths, seed, points=3):
    rng = np.random.default_rng(seed)
    data = [rng.standard_normal((2, points, n)).cumsum(axis=2) for n in lengths]
    rows = [(k, p, t, float(d[0, p, t]), float(d[1, p, t])) for k, d in enumerate(data) for p in range(points) for t in range(d.shape[2])]
    return data, spark.createDataFrame(rows, "segment int, p int, frame int, u double, v double")


def plain_psd(data, dt):
    spectra_ = []
    for d in data:
        n = d.shape[2]
        w = np.hanning(n)
        w = w / np.sqrt((w**2).mean())
        p = abs(np.fft.rfft((d - d.mean(axis=2, keepdims=True)) * w, axis=2)) ** 2 * dt / n
        spectra_.append((np.fft.rfftfreq(n, dt)[1:], np.log(p[..., 1:] + 1e-30).reshape(-1, n // 2).mean(axis=0)))
    f = max((s[0] for s in spectra_), key=len)
    return f, np.mean([np.interp(np.log(f), np.log(g), lp) for g, lp in spectra_], axis=0)


def test_temporal_spectra(spark):
    (a, da), (b, db) = series(spark, (20, 33, 16), 1), series(spark, (24, 40), 2)
    pa_, pb = (temporal.temporal_psd(temporal.segment_psd(d, [], ["p"], 1.0), []) for d in (da, db))
    fa, la = plain_psd(a, 1.0)
    fb, lb = plain_psd(b, 1.0)
    got = sorted((r["f"], r["p"]) for r in pa_.collect())
    assert [g[0] for g in got] == pytest.approx(fa.tolist()) and np.log([g[1] for g in got]) == pytest.approx(la)
    at = np.interp(np.log(fb), np.log(fa), la, left=np.nan, right=np.nan)
    inside = np.isfinite(at)
    assert not inside.all()
    assert temporal.temporal_residual(pa_, pb).first()[0] == pytest.approx(np.sqrt(((at - lb)[inside] ** 2).mean()))


def test_dispersion_compared(spark):
    """Mean of ratios over levels at each side's last lead, curves over hours; spread is a mean distance."""
    rows = lambda scale, leads: spark.createDataFrame([(g, lv, k, scale * (1.0 + lv) * k * k, (1.0 + g) * (scale + lv) * (k + 1)) for g in range(2) for lv in range(2) for k in range(leads)], "segment int, level int, lead int, msd double, spread double")
    got = temporal.dispersion_compare(rows(4.0, 5), rows(1.0, 4), (1.0, 2.0)).first()
    hours, want = [2.0, 4.0, 6.0], []
    for h in hours:
        if h <= 4:
            want.append((np.interp(h, [1, 2, 3, 4], np.log([6.0 * k * k for k in (1, 2, 3, 4)])) - np.log(1.5 * (h / 2) ** 2)) ** 2)
    assert got["log_rmse"] == pytest.approx(np.sqrt(np.mean(want)))
    assert got["spread_ratio"] == pytest.approx(np.mean([(4.0 + lv) * 5 / ((1.0 + lv) * 4) for lv in range(2)]))
    p = spark.createDataFrame([(0, 0, k, [0.0] * 64, [0.0] * 64) for k in range(2)], "segment int, level int, frame int, u array<double>, v array<double>")
    g = np.linspace(0.1 * 7, 0.9 * 7, 8)
    y, x = np.meshgrid(g * 3.0, g * 2.0, indexing="ij")
    assert temporal.dispersion(p, ["segment", "level"], 8, 8, 1.0, 2.0, 3.0).first()["spread"] == pytest.approx(np.hypot(y - y.mean(), x - x.mean()).mean())


def test_plane_descriptors(spark):
    rng = np.random.default_rng(4)
    for ny, nx in ((16, 16), (3, 3), (12, 20)):
        u, v = rng.standard_normal((2, ny, nx))
        planes = spark.createDataFrame([(0, u.ravel().tolist(), v.ravel().tolist())], "s int, u array<double>, v array<double>")
        got = spectra.plane_diagnostics(planes, ["s"], ny, nx, 2.0, 3.0).first()
        fy, fx = np.fft.fftfreq(ny, 3.0), np.fft.fftfreq(nx, 2.0)
        r = np.hypot(*np.meshgrid(fx, fy)).ravel()
        edges = np.linspace(0, r.max(), 17)
        slopes = []
        for f in (u, v):
            p = abs(np.fft.fft2(f - f.mean())).ravel() ** 2
            k, m = zip(*[((a + b) / 2, p[(r >= a) & (r < b)].mean()) for a, b in zip(edges, edges[1:]) if ((r >= a) & (r < b)).any() and p[(r >= a) & (r < b)].mean() > 0])
            slopes.append(np.polyfit(np.log10(k), np.log10(m), 1)[0] if len(k) >= 3 else np.nan)
        assert got["slope"] == pytest.approx(np.nanmean(slopes) if not np.isnan(slopes).all() else np.nan, nan_ok=True)
    assert spectra.tukey(16).tolist() == pytest.approx([0.5 * (1 + math.cos(math.pi * (2 * min(i, 15 - i) / 7.5 - 1))) if min(i, 15 - i) <= 3 else 1.0 for i in range(16)])
    assert spectra.tukey(3).tolist() == [1.0] * 3
    got = {r["descriptor"]: r["value"] for r in spectra.field_diagnostics(planes, ["s"], 12, 20).collect()}
    assert len(got) == 7 and all(math.isfinite(x) for x in got.values())
    assert got["wind RMS (m/s)"] == pytest.approx(np.sqrt((u**2 + v**2).mean())) and got["speed p95 (m/s)"] == pytest.approx(np.quantile(np.hypot(u, v), 0.95))


def test_coordinate_noise_bit_for_bit(spark):
    """The 64-bit hash, wrapping, and the normal value of its low 53 bits."""
    wrap = lambda n: (n + (1 << 63)) % (1 << 64) - (1 << 63)
    got = {(r["t"], r["y"], r["x"]): (r["c0"], r["c1"]) for r in lazyfield.coordinate_noise(lazyfield.box(spark, -3, 3, -2, 4, -1, 2), 2, 7).collect()}
    assert len(got) == 108
    for (t, y, x), values in got.items():
        for c, value in enumerate(values):
            h = 7
            for factor, at in ((6364136223846793005, x), (1442695040888963407, y), (22695477, t), (1103515245, c)):
                h ^= wrap(factor * at)
            h ^= h >> 33
            h = wrap(h * 2862933555777941757 + 3037000493)
            h ^= h >> 29
            share = min(max((h & ((1 << 53) - 1)) / 2.0**53, 1e-12), 1 - 1e-12)
            assert value == pytest.approx(statistics.NormalDist().inv_cdf(share), abs=1e-12)


def test_normal_quantile(spark):
    p = [1e-12, 1e-9, 0.001, 0.07, 0.075, 0.4, 0.5, 0.93, 0.999, 1 - 1e-12]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(noise.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([statistics.NormalDist().inv_cdf(x) for x in p], abs=1e-13, rel=1e-13)


def test_tile_seeds(spark):
    mask = (1 << 64) - 1

    def plain(seed, y, x):
        h = (seed * 0x9E3779B97F4A7C15 & mask) ^ ((y & 0xFFFFFFFF) * 0xBF58476D1CE4E5B9 & mask) ^ ((x & 0xFFFFFFFF) * 0x94D049BB133111EB & mask)
        return (h ^ h >> 31) & (1 << 63) - 1

    rows = spark.createDataFrame([(s, y, x) for s in (0, 7, 123456789012) for y in (-5, 0, 3) for x in (-1, 0, 40)], "s long, y int, x int")
    assert all(r["seed"] == plain(r["s"], r["y"], r["x"]) for r in rows.withColumn("seed", noise.tile_seed(F.col("s"), F.col("y"), F.col("x"))).collect())


def test_toy_denoiser():
    z = np.random.default_rng(0).standard_normal((6, 16, 16))
    out = lazyfield.toy_denoiser(z)
    u, v = out[0::2], out[1::2]
    k = 2 * np.pi * np.fft.fftfreq(16)
    div = 1j * k[None, None, :] * np.fft.fft2(u) + 1j * k[None, :, None] * np.fft.fft2(v)
    nyquist = np.ones((16, 16), bool)
    nyquist[8], nyquist[:, 8] = False, False
    assert abs(div[:, nyquist]).max() < 1e-8
    assert np.sqrt((u**2 + v**2).mean()) == pytest.approx(15.0)
    assert (lazyfield.toy_denoiser(z) == out).all() and abs(np.corrcoef(u[0].ravel(), u[1].ravel())[0, 1]) > 0.2


def test_point_queries_equal_the_box(spark):
    f = lazyfield.InfiniteField(window=8, depth=2, seed=7)
    whole = {(r["y"], r["x"]): (r["u"], r["v"]) for r in f.materialise(spark, -2, 3, -2, 3).collect()}
    points = spark.createDataFrame([(-2, -1), (0, 0), (2, 1)], "y int, x int")
    for r in lazyfield.query_log(f, points).collect():
        assert (r["u"], r["v"]) == pytest.approx(whole[r["y"], r["x"]]) and r["seconds"] > 0


@pytest.mark.parametrize("kind", ["outlier", "heavy", "ties", "one", "lognormal"])
def test_quantiles_of_skewed_groups(spark, kind):
    rng = np.random.default_rng(0)
    x = {"outlier": np.append(rng.random(3000), 1e9), "heavy": rng.standard_cauchy(3000) ** 3, "ties": rng.integers(0, 3, 3000) * 1.0, "one": np.array([4.0]), "lognormal": np.exp(5 * rng.standard_normal(3000))}[kind]
    df = spark.createDataFrame([(k, float(v)) for k, part in ((0, x), (1, -x)) for v in part], "g int, x double")
    qs = [0.0, 0.001, 0.5, 1 / 3, 0.999, 1.0]
    for r in distributions.exact_quantiles(df, ["g"], "x", qs).collect():
        assert r["q"] == pytest.approx(np.quantile(x if r["g"] == 0 else -x, qs[r["k"]]), rel=1e-12, abs=1e-12)
    got = {r["k"]: r["q"] for r in distributions.exact_quantiles(df.where("g = 0"), [], "x", [i / 99 for i in range(100)]).collect()}
    assert [got[i] for i in range(100)] == pytest.approx(np.quantile(x, [i / 99 for i in range(100)]).tolist(), rel=1e-12, abs=1e-12)


def test_shear_is_pooled_over_levels(spark):
    rng = np.random.default_rng(1)
    side = lambda k: spark.createDataFrame([(s, 0, 0, lv, float(a), float(b)) for s in range(12) for lv in range(4) for a, b in [k * rng.standard_normal(2) + lv]], "s int, y int, x int, level int, u double, v double")
    pred, ref = side(1.0), side(3.0)
    thickness = spark.createDataFrame([(0, 100.0), (1, 250.0), (2, 500.0)], "level int, dz double")
    columns = {c: [np.array([r["shear"] for r in physics.shear_samples(f, thickness, ["s", "y", "x"], c).collect()]) for f in (pred, ref)] for c in ("u", "v")}
    got = {r["metric"]: r["value"] for r in boards.run_suite(pred, ref, thickness=thickness).collect()}
    q = np.arange(1024) / 1023
    for c in ("u", "v"):
        a, b = columns[c]
        assert got[f"W1 shear {c} ((m/s)/km)"] == pytest.approx(abs(np.quantile(a, q) - np.quantile(b, q)).mean())

