"""Condition runs and their boards: selecting, matching and checking runs, a shared grid, floors, anchors, comparisons.

A run's cells carry its condition keys (month, day, hour, seed) as columns. Checks are aggregates or anti-joins whose few
result rows decide; they raise before anything is scored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windloom.operators import aggregate, align, boards, distributions, ensemble, spectra, windows

# Day from which a reference's second half begins; shared grid: points a side, spacing in km, pressures; region of fixed blocks.
SPLIT_DAY = 11
SHARED_SIDE, SHARED_KM, SHARED_HPA = 16, 50.0, tuple(range(60, 131, 10))
REGION = {"lat": (33.0, 48.75), "lon": (233.0, 248.75)}
CONDITION = ("month", "day", "hour", "seed")


# Selecting


def level_band(cells: DataFrame, low: float, high: float) -> DataFrame:
    """Levels from low to high, both included; an error if none is there."""
    got = cells.where(F.col("level").between(low, high))
    if got.isEmpty():
        raise ValueError(f"no level between {low} and {high}")
    return got


def centre_window(cells: DataFrame, size: int) -> DataFrame:
    """The window of ``size`` cells a side in the middle of the grid, y and x counted from its corner."""
    ends = cells.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
    y0, x0 = ((ends[c] + 1 - size) // 2 for c in ("y", "x"))
    if min(y0, x0) < 0:
        raise ValueError(f"the grid is smaller than {size}")
    inside = F.col("y").between(y0, y0 + size - 1) & F.col("x").between(x0, x0 + size - 1)
    return cells.where(inside).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def at_condition(reference: DataFrame, month: int, hour: int, days: Sequence[int], time: str = "time") -> DataFrame:
    return reference.where((F.month(time) == month) & (F.hour(time) == hour) & F.dayofmonth(time).isin(list(days)))


def fixed_region(cells: DataFrame, region: Mapping[str, tuple[float, float]] = REGION) -> DataFrame:
    out = cells
    for axis, (low, high) in region.items():
        out = out.where(F.col(axis).between(low, high))
    return out


# Matching and checking


def on_common(run: DataFrame, reference: DataFrame, axes: Sequence[str] = ("level", "y", "x"), keys: Sequence[str] = CONDITION) -> tuple[DataFrame, DataFrame]:
    """Both cropped to the coordinates and conditions that both have: semi-joins on small distinct sets."""
    out = [run, reference]
    for names in ([a] for a in axes):
        shared = align.common_keys(out, names)
        out = [d.join(F.broadcast(shared), names, "left_semi") for d in out]  # one axis
    shared = align.common_keys(out, keys)
    if shared.isEmpty():
        raise ValueError("no common condition")
    return tuple(d.join(shared, list(keys), "left_semi") for d in out)


def require_equal_grid(run: DataFrame, reference: DataFrame, axes: Sequence[str] = ("level", "y", "x")) -> None:
    """An error unless both have the same levels and coordinates."""
    for a in axes:
        if not align.key_differences(run, reference, [a]).isEmpty():
            raise ValueError(f"{a} differs from the reference")


def require_inside(source: DataFrame, target: DataFrame, axes: Sequence[str] = ("lat", "lon")) -> None:
    """An error if the target leaves the source's extent."""
    ends = lambda d: d.agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max)))).first()
    s, t = ends(source), ends(target)
    if any(t[f"lo_{a}"] < s[f"lo_{a}"] or t[f"hi_{a}"] > s[f"hi_{a}"] for a in axes):
        raise ValueError("source field does not contain the complete target grid")


def episodes_joined(parts: Sequence[DataFrame], keys: Sequence[str] = (), time: str = "time", frames: int = 24) -> DataFrame:
    """Episodes set one after another in time, with segment and frame; an error unless each is one segment of ``frames`` frames."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    axis = windows.segments(whole.select(*keys, time).distinct(), keys, time)
    told = axis.groupBy(*keys, "segment").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.count("*").alias("segments"), F.min("n").alias("least"), F.max("n").alias("most"))
    if told.where((F.col("segments") != len(parts)) | (F.col("least") != frames) | (F.col("most") != frames)).limit(1).count():
        raise ValueError(f"episodes aren't {len(parts)} contiguous segments of {frames} frames")
    return whole.join(axis, [*keys, time])


def attach_coordinates(cells: DataFrame, lat_origin: float, lon_origin: float, time_origin: str, stride: int, time_stride: int, step: float = 0.25) -> DataFrame:
    """cells (t, y, x) with lat, lon, time: a window that begins one stride into the grid."""
    return cells.withColumns({
        "lat": F.lit(lat_origin) + step * (stride + F.col("y")), "lon": F.lit(lon_origin) + step * (stride + F.col("x")),
        "time": F.timestamp_add("HOUR", (F.lit(time_stride) + F.col("t")).cast("int"), F.lit(time_origin).cast("timestamp_ntz")),
    })


# Shared grid


def positions(targets: Sequence[float], first: float, step: float, n: int) -> list[float]:
    """Fractional places of target coordinates on a regular axis; an error outside it."""
    out = [(t - first) / step for t in targets]
    if min(out) < -1e-9 or max(out) > n - 1 + 1e-9:
        raise ValueError("source field does not contain the complete target grid")
    return [min(max(p, 0.0), n - 1.0) for p in out]


def resample(cells: DataFrame, keys: Sequence[str], shape: tuple[int, int], places: tuple[Sequence[float], Sequence[float]], ratio: float = 1.0) -> DataFrame:
    """Planes of cells read by lines at fractional places along y and x; blurred first (sigma half the ratio) if the target is coarser."""
    if ratio > 1:
        cells = align.smooth(cells, keys, 0.5 * ratio)
    for axis, other, n, own in (("y", "x", shape[0], places[0]), ("x", "y", shape[1], places[1])):
        rows = []
        for to, p in enumerate(own):
            lo = min(max(n - 2, 0), math.floor(p))
            rows += [(to, lo, 1 - (p - lo)), (to, min(lo + 1, n - 1), p - lo)]
        parts = cells.sparkSession.createDataFrame(rows, f"_to int, {axis} int, _w double")
        cells = cells.join(F.broadcast(parts), axis).groupBy(*keys, F.col("_to").alias(axis), other).agg(*(F.sum(F.col(c) * F.col("_w")).alias(c) for c in ("u", "v")))  # two rows a target line
    return cells


def to_shared_grid(cells: DataFrame, keys: Sequence[str], lat: tuple[float, float, int], lon: tuple[float, float, int], target_lat: Sequence[float], target_lon: Sequence[float], pressure: DataFrame, spacing_km: float, targets: Sequence[float] = SHARED_HPA, target_km: float = SHARED_KM) -> DataFrame:
    """keys, pressure, y, x, u, v: containment check, horizontal resampling, then each column interpolated in pressure.

    lat and lon: first coordinate, step and number of points; pressure: level, p (hPa), one row a level.
    """
    places = positions(target_lat, *lat), positions(target_lon, *lon)
    flat = resample(cells, [*keys, "level"], (lat[2], lon[2]), places, target_km / spacing_km)
    return align.vertical(flat.join(F.broadcast(pressure), "level"), targets, [*keys, "y", "x"])  # one row a level


# Floors and anchors


def floor_groups(reference: DataFrame, time: str = "time", split: int = SPLIT_DAY) -> tuple[DataFrame, DataFrame]:
    """Days before the split and from it on, keyed by month and hour, where both have them."""
    keyed = reference.withColumns({"month": F.month(time), "hour": F.hour(time)})
    return boards.conditional_groups(*aggregate.halves(keyed, time, split), time)


def floor(reference: DataFrame, time: str = "time", split: int = SPLIT_DAY) -> DataFrame:
    """metric, value of a reference's halves against each other: what no method can be expected to beat. Needs days on both sides."""
    early, late = aggregate.halves(reference, time, split)
    if early.isEmpty() or late.isEmpty():
        raise ValueError(f"the reference needs days on both sides of day {split}")
    return boards.run_suite(early, late, seeds=(*floor_groups(reference, time, split), ["month", "hour"])).drop("ord")


def anchors(planes: DataFrame, cells: DataFrame, ny: int, nx: int, keys: Sequence[str] = ("s", "level"), seed: int = 0) -> DataFrame:
    """anchor, keys, y, x, u, v: two fields known to be broken, one with the reference's spectra and random phases, one with its means and deviations only."""
    shuffled = spectra.phase_shuffle(planes, list(keys), ny, nx, seed)
    flat = shuffled.select(*keys, F.posexplode(F.arrays_zip("u", "v")).alias("i", "c"))
    flat = flat.select(F.lit("phase shuffle").alias("anchor"), *keys, F.floor(F.col("i") / nx).cast("int").alias("y"), (F.col("i") % nx).cast("int").alias("x"), "c.u", "c.v")
    noise = ensemble.white_noise(cells, keys, seed).select(F.lit("white noise").alias("anchor"), *keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "u", "v")
    return flat.unionByName(noise)


# Measures of single fields


def spacing_km(axes: DataFrame) -> DataFrame:
    """Mean of both grid spacings."""
    return aggregate.spacing_m(axes).select(((F.col("dx_m") + F.col("dy_m")) / 2000).alias("km"))


def residual(u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    return F.sqrt(F.pow(u1 - u2, 2) + F.pow(v1 - v2, 2))


def negative_log_density(value: Column, mean: Column, sd: Column) -> Column:
    """Summed over rows, of values under normal predictions."""
    return F.sum(0.5 * math.log(2 * math.pi) + F.ln(sd) + 0.5 * F.pow((value - mean) / sd, 2))


def seam_at(cells: DataFrame, keys: Sequence[str], axis: str, index: int) -> DataFrame:
    """ratio of the mean jump behind line ``index`` of an axis to the mean of all."""
    j = windows.jumps(cells, keys, axes=(axis,))
    return j.agg((F.avg(F.when(F.col("at") == index, F.col("jump"))) / F.greatest(F.avg("jump"), F.lit(1e-12))).alias("ratio"))


def field_metrics(cells: DataFrame, planes: DataFrame, ny: int, nx: int, seams: tuple[int, int, int] = (31, 31, 1)) -> DataFrame:
    """metric, value of one run (t, level, y, x, u, v; planes with t, level and arrays): moments, seams in x, y and t, change and correlation in time, high frequencies, divergence and vorticity."""
    s = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    one = cells.agg(F.avg("u").alias("u_mean_mps"), F.stddev_pop("u").alias("u_std_mps"), F.avg("v").alias("v_mean_mps"), F.stddev_pop("v").alias("v_std_mps"), F.avg(s).alias("speed_mean_mps"), F.max(s).alias("speed_max_mps"))
    vd = windows.vorticity_divergence(cells, ["t", "level"]).agg(F.stddev_pop("div").alias("grid_divergence_std"), F.stddev_pop("vort").alias("grid_vorticity_std"))
    shape = spectra.plane_diagnostics(planes, ["t", "level"], ny, nx).agg(F.avg("high_fraction").alias("high_frequency_power_fraction"), F.avg("centroid").alias("spectral_centroid_cycles_per_pixel"))
    more = [
        vd, shape,
        distributions.exact_quantiles(cells.select(s.alias("s")), [], "s", [0.95]).select(F.col("q").alias("speed_p95_mps")),
        *(seam_at(cells, ["level"] if a == "t" else ["t", "level"], a, k).withColumnRenamed("ratio", f"{n}_boundary_ratio") for a, n, k in (("x", "x", seams[0]), ("y", "y", seams[1]), ("t", "time", seams[2]))),
        windows.jumps(cells, ["level"], axes=("t",)).agg(F.avg("jump").alias("mean_temporal_vector_change_mps")),
        windows.frame_correlations(cells, "t", ["level"]).agg(F.avg("r").alias("mean_adjacent_frame_correlation")),
    ]
    for m in more:
        one = one.crossJoin(F.broadcast(m))  # one row each
    return one.unpivot([], one.columns, "metric", "value")


# Boards


def forwards(runs: DataFrame) -> DataFrame:
    """runs with forward evaluations where they aren't recorded: a trajectory of n steps takes two a step but one for the last."""
    return runs.withColumn("forwards", F.coalesce("forwards", F.col("calls") * (2 * F.col("steps") - 1)))


def score_board(reference: DataFrame, methods: Mapping[str, DataFrame], keys: Sequence[str] = CONDITION, **parts) -> DataFrame:
    """entity, metric, value: the suite of every method against the reference on a shared grid; all methods must have the first one's conditions."""
    out, first = None, None
    for name, cells in methods.items():
        if first is None:
            first = cells
        else:
            align.require_same_keys(first, cells, keys)
        one = boards.run_suite(cells, reference, **{k: v[name] for k, v in parts.items() if name in v}).select(F.lit(name).alias("entity"), "metric", "value")
        out = one if out is None else out.unionByName(one)
    return out


def paired_differences(scores: DataFrame, entity: str, against: str, keys: Sequence[str] = ("seed",)) -> DataFrame:
    """metric, n, mean, sd, low, high: differences of two entities' scores over equal keys, with a bootstrap interval."""
    side = lambda e, c: scores.where(F.col("entity") == e).select(*keys, "metric", F.col("value").alias(c))
    d = side(entity, "a").join(side(against, "b"), [*keys, "metric"]).where(~F.isnan("a") & ~F.isnan("b")).select("metric", (F.col("a") - F.col("b")).alias("d"))
    return aggregate.bootstrap(d, ["metric"], "d")


def tile_board(scores: DataFrame, performance: DataFrame, coherence: DataFrame) -> DataFrame:
    """One row a tile profile: its scores by metric, times, and boundary coherence."""
    names = [r[0] for r in scores.select("metric").distinct().orderBy("metric").collect()]  # a board's metrics
    wide = scores.groupBy("profile").pivot("metric", names).agg(F.first("value"))
    return wide.join(performance, "profile").join(coherence, "profile")


def write_summary(board: DataFrame, path: str) -> None:
    """summary.csv: a board has a few rows."""
    board.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def block_comparison(run: DataFrame, reference: DataFrame, keys: Sequence[str] = ("t", "level", "y", "x")) -> str:
    """JSON of pointwise errors and of per-level distances (1001 quantiles) of two fields on one block."""
    require_equal_grid(run, reference, [k for k in keys if k != "t"])
    point = aggregate.pointwise(run, reference, keys).first().asDict()
    a, b = (distributions.stacked(d, ["level"], ("u", "v")) for d in (run, reference))
    w1 = distributions.wasserstein1(a, b, ["component", "level"], "x", 1001).agg(F.avg("w1").alias("marginal_w1")).first()
    return json.dumps(point | w1.asDict(), indent=1)


def passes(scores: DataFrame, floors: DataFrame, factor: float = 2.0) -> DataFrame:
    """metric, value, floor, ok: a gate on how far scores may lie above their floor."""
    j = scores.join(floors.select("metric", F.col("value").alias("floor")), "metric").where(~F.isnan("value") & ~F.isnan("floor"))
    return j.select("metric", "value", "floor", (F.col("value") <= factor * F.col("floor")).alias("ok"))
