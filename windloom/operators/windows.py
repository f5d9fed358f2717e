"""Neighbour operators on cells and series: jumps, seams, gradients, structure, segments, correlations.

Every window is partitioned by a line of a plane or by a series, so that shuffles are on (slice, line) and
tasks stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lags of the structure function, floor of the cosine's denominator, coherence threshold, spacing in km, gap factor, least frames.
LAGS = (1, 2, 4, 8, 16)
COSINE_FLOOR, MEAN_FLOOR = 1e-6, 1e-12
COHERENCE, SPACING_KM = 0.5, 27.83
GAP, LEAST_FRAMES = 1.5, 16


def along(axis: str, *keys: str) -> Window:
    other = {"x": ["y"], "y": ["x"], "t": ["y", "x"]}[axis]
    return Window.partitionBy(*keys, *other).orderBy(axis)


def neighbours(cells: DataFrame, keys: Sequence[str], lags: Sequence[int] = (1,), axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """keys, axis, lag, at (place of the first cell), line, u, v, u1, v1: cells with their lag-th neighbours, axes stacked.

    All lags of an axis are read in one window.
    """
    out = None
    for axis in axes:
        w = along(axis, *keys)
        ahead = F.array(*[F.struct(F.lit(lag).alias("lag"), F.lead("u", lag).over(w).alias("u1"), F.lead("v", lag).over(w).alias("v1")) for lag in lags])
        one = cells.select(*keys, F.lit(axis).alias("axis"), F.col(axis).alias("at"), F.col({"x": "y", "y": "x", "t": "y"}[axis]).alias("line"), "u", "v", ahead.alias("n"))
        one = one.withColumn("n", F.explode("n")).select(*keys, "axis", "n.lag", "at", "line", "u", "v", "n.u1", "n.v1").where("u1 is not null")
        out = one if out is None else out.unionByName(one)
    return out


def jumps(cells: DataFrame, keys: Sequence[str], lag: int = 1, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """neighbours with du, dv, jump: increments to the lag-th neighbour and their length."""
    return _increments(neighbours(cells, keys, (lag,), axes))


def _increments(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"du": F.col("u1") - F.col("u"), "dv": F.col("v1") - F.col("v")}).withColumn("jump", F.sqrt(F.col("du") * F.col("du") + F.col("dv") * F.col("dv")))


def boundary_coherence(cells: DataFrame, keys: Sequence[str], stride: int) -> DataFrame:
    """One row: jump and squared-jump ratio of tile boundaries to all, mean cosine of the vectors on both sides of a boundary and of all neighbours, the latter less the former."""
    length = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    cosine = (F.col("u") * F.col("u1") + F.col("v") * F.col("v1")) / F.greatest(length("u", "v") * length("u1", "v1"), F.lit(COSINE_FLOOR))
    j = jumps(cells, keys).withColumns({"cosine": cosine, "square": F.col("jump") * F.col("jump"), "seam": F.pmod(F.col("at") + 1, F.lit(stride)) == 0})
    at_seams = lambda c: F.avg(F.when(F.col("seam"), F.col(c)))
    one = j.agg(
        (at_seams("jump") / F.greatest(F.avg("jump"), F.lit(MEAN_FLOOR))).alias("jump_ratio"), (at_seams("square") / F.greatest(F.avg("square"), F.lit(MEAN_FLOOR))).alias("squared_ratio"),
        at_seams("cosine").alias("seam_cosine"), F.avg("cosine").alias("all_cosine"),
    )
    return one.withColumn("direction_gap", F.col("all_cosine") - F.col("seam_cosine"))


def seam_ratios(cells: DataFrame, keys: Sequence[str], stride: int, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """axis, ratio of the mean jump at tile boundaries to that elsewhere; null without a boundary."""
    seam = F.pmod(F.col("at") + 1, F.lit(stride)) == 0
    return jumps(cells, keys, axes=axes).groupBy("axis").agg(F.avg(F.when(seam, F.col("jump"))).alias("seam"), F.avg(F.when(~seam, F.col("jump"))).alias("rest"), F.avg("jump").alias("mean")).withColumn("ratio", F.col("seam") / F.col("mean"))


def structure_function(cells: DataFrame, keys: Sequence[str], lags: Sequence[int] = LAGS) -> DataFrame:
    """lag, s2: mean squared vector increment, averaged over x and y; lags that fit both axes."""
    by_axis = _increments(neighbours(cells, keys, lags)).groupBy("lag", "axis").agg(F.avg(F.col("jump") * F.col("jump")).alias("m"))
    return by_axis.groupBy("lag").agg(F.avg("m").alias("s2"), F.count("*").alias("axes")).where("axes = 2").select("lag", "s2")


def increment_kurtosis(cells: DataFrame, keys: Sequence[str], lag: int = 2, value: str = "du") -> DataFrame:
    """Kurtosis (3 for a normal) of the increments of one component, axes pooled."""
    return jumps(cells, keys, lag).agg((F.kurtosis(value) + 3).alias("kurtosis"))


def gradient(column: str, axis: str, keys: Sequence[str], h: float = 1.0) -> Column:
    """Central differences inside, one-sided at the edges."""
    w, c = along(axis, *keys), F.col(column)
    ahead, behind = F.lead(column).over(w), F.lag(column).over(w)
    return F.coalesce((ahead - behind) / (2 * h), (ahead - c) / h, (c - behind) / h)


def vorticity_divergence(cells: DataFrame, keys: Sequence[str], dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """cells with vort and div."""
    g = lambda c, a, h: gradient(c, a, keys, h)
    return cells.withColumns({"_vx": g("v", "x", dx), "_ux": g("u", "x", dx)}).withColumns({"_uy": g("u", "y", dy), "_vy": g("v", "y", dy)}).select(*cells.columns, (F.col("_vx") - F.col("_uy")).alias("vort"), (F.col("_ux") + F.col("_vy")).alias("div"))


def vorticity_divergence_ratio(cells: DataFrame, keys: Sequence[str], dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    return vorticity_divergence(cells, keys, dx, dy).agg((F.stddev_pop("vort") / (F.stddev_pop("div") + 1e-12)).alias("ratio"))


def correlation_curve(cells: DataFrame, keys: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """lag, correlation: vector autocorrelation by lag after removing each plane's mean, x and y averaged, 1 at lag 0."""
    plane = Window.partitionBy(*keys)
    c = cells.withColumn("u", F.col("u") - F.avg("u").over(plane)).withColumn("v", F.col("v") - F.avg("v").over(plane))
    products = neighbours(c, keys, lags).groupBy("lag", "axis").agg(F.avg(F.col("u") * F.col("u1") + F.col("v") * F.col("v1")).alias("p"))
    curve = products.groupBy("lag").agg(F.avg("p").alias("p"))
    zero = curve.where("lag = 0").select(F.col("p").alias("p0"))
    return curve.crossJoin(F.broadcast(zero)).select("lag", (F.col("p") / F.col("p0")).alias("correlation"))


def coherence_length(curve: DataFrame, spacing_km: float = SPACING_KM, threshold: float = COHERENCE) -> DataFrame:
    """km at which the curve first falls to the threshold, between two lags by a line; the last lag if it never does."""
    w = Window.orderBy("lag")  # a curve has one row for each lag
    c = curve.withColumns({"l0": F.lag("lag").over(w), "c0": F.lag("correlation").over(w)})
    first = c.where(F.col("correlation") <= threshold).agg(F.min(F.struct("lag", "l0", "c0", "correlation")).alias("f"), F.lit(1).alias("one"))
    last = curve.agg(F.max("lag").alias("last"), F.lit(1).alias("one"))
    at = F.when(F.col("f.l0").isNull(), F.col("f.lag").cast("double")).otherwise(F.col("f.l0") + (F.col("f.c0") - threshold) / (F.col("f.c0") - F.col("f.correlation")) * (F.col("f.lag") - F.col("f.l0")))
    return last.join(first, "one", "left").select((F.coalesce(at, F.col("last").cast("double")) * spacing_km).alias("coherence_km"))


def _seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def segments(series: DataFrame, keys: Sequence[str] = (), time: str = "time", gap: float = GAP, least: int = 1) -> DataFrame:
    """series with segment (from 0) and frame (from 0): split where a step exceeds ``gap`` times the median step.

    ``series`` has one row for each key and time. Segments of fewer than ``least`` frames go.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    d = series.withColumn("_step", _seconds(time) - F.lag(_seconds(time)).over(w))
    if keys:
        typical = d.groupBy(*keys).agg(F.percentile("_step", F.lit(0.5)).alias("_typical"))
        d = d.join(typical, list(keys))
    else:
        d = d.crossJoin(F.broadcast(d.agg(F.percentile("_step", F.lit(0.5)).alias("_typical"))))
    d = d.withColumn("segment", F.sum(F.when(F.col("_step") > gap * F.col("_typical"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy(*keys, "segment")
    d = d.withColumn("frame", F.row_number().over(s.orderBy(time)) - 1).withColumn("_frames", F.count("*").over(s))
    return d.where(F.col("_frames") >= least).drop("_step", "_typical", "_frames")


def median_step_hours(series: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(time)
    d = series.withColumn("_step", _seconds(time) - F.lag(_seconds(time)).over(w))
    return d.groupBy(*keys).agg((F.percentile("_step", F.lit(0.5)) / 3600).alias("hours"))


def adjacent_change(segmented: DataFrame, keys: Sequence[str], points: Sequence[str] = ()) -> DataFrame:
    """Mean over segments of the mean vector change between consecutive frames."""
    w = Window.partitionBy(*keys, "segment", *points).orderBy("frame")
    d = F.sqrt(F.pow(F.col("u") - F.lag("u").over(w), 2) + F.pow(F.col("v") - F.lag("v").over(w), 2))
    per = segmented.withColumn("_d", d).groupBy(*keys, "segment").agg(F.avg("_d").alias("m"))
    return per.groupBy(*keys).agg(F.avg("m").alias("change")) if keys else per.agg(F.avg("m").alias("change"))


def seam_jump_ratio(segmented: DataFrame, keys: Sequence[str], period: int, points: Sequence[str] = ()) -> DataFrame:
    """Jumps at every period-th step against all jumps, each averaged over segments first."""
    w = Window.partitionBy(*keys, "segment", *points).orderBy("frame")
    d = F.sqrt(F.pow(F.lead("u").over(w) - F.col("u"), 2) + F.pow(F.lead("v").over(w) - F.col("v"), 2))
    per = segmented.withColumn("_d", d).groupBy(*keys, "segment").agg(F.avg("_d").alias("m"), F.avg(F.when(F.pmod(F.col("frame") + 1, F.lit(period)) == 0, F.col("_d"))).alias("s"))
    return per.groupBy(*keys).agg((F.avg("s") / F.avg("m")).alias("ratio")) if keys else per.agg((F.avg("s") / F.avg("m")).alias("ratio"))


def frame_correlations(cells: DataFrame, frame: str, keys: Sequence[str] = ("level",)) -> DataFrame:
    """keys, frame, r: Pearson correlation of each frame with the next, u and v together."""
    w = Window.partitionBy(*keys, "y", "x").orderBy(frame)
    pair = cells.select(*keys, frame, F.array(F.struct(F.col("u").alias("a"), F.lead("u").over(w).alias("b")), F.struct(F.col("v").alias("a"), F.lead("v").over(w).alias("b"))).alias("p"))
    return pair.select(*keys, frame, F.explode("p").alias("p")).where("p.b is not null").groupBy(*keys, frame).agg(F.corr("p.a", "p.b").alias("r"))


def valid_blocks(segmented: DataFrame, tau: int, keys: Sequence[str] = ()) -> DataFrame:
    """Frames at which a block of tau consecutive frames of one segment begins."""
    w = Window.partitionBy(*keys, "segment").orderBy("frame").rowsBetween(0, tau - 1)
    return segmented.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == tau).drop("_n")


def frame_pairs(segmented: DataFrame, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs (frame, frame + k) within a segment: u, v and next_u, next_v."""
    w = Window.partitionBy(*keys, "segment").orderBy("frame")
    return segmented.withColumns({"next_u": F.lead("u", k).over(w), "next_v": F.lead("v", k).over(w)}).where("next_u is not null")


def advantages(rollout: DataFrame, keys: Sequence[str], gamma: float = 0.99, lam: float = 0.95, last_value: str | None = None, last_done: str | None = None) -> DataFrame:
    """keys, gae, returns (arrays in step order): generalised advantages of reward, value, done by step, and advantages plus values.

    ``done`` says that an episode begins with its step: what follows a step counts unless the next step is done. What
    follows the last one is in the columns ``last_value`` and ``last_done`` (equal within a rollout; else 0 and not done).
    A recurrence from the end, as an aggregate over each rollout's ordered array.
    """
    last = [(F.first(F.col(c).cast(t)) if c else F.lit(zero)).alias(n) for c, t, zero, n in ((last_value, "double", 0.0, "_v"), (last_done, "boolean", False, "_d"))]
    steps = rollout.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("step", "reward", "value", "done"))).alias("s"), *last)

    def back(acc, s):
        goes_on = F.when(acc["done"], 0.0).otherwise(1.0)
        adv = s["reward"] + gamma * acc["value"] * goes_on - s["value"] + gamma * lam * goes_on * acc["adv"]
        return F.struct(s["value"].alias("value"), s["done"].alias("done"), adv.alias("adv"), F.concat(F.array(adv), acc["out"]).alias("out"))

    start = F.struct(F.col("_v").alias("value"), F.col("_d").alias("done"), F.lit(0.0).alias("adv"), F.array().cast("array<double>").alias("out"))
    gae = steps.select(*keys, F.aggregate(F.reverse("s"), start, back)["out"].alias("gae"), F.col("s.value").alias("_values"))
    return gae.select(*keys, "gae", F.zip_with("gae", "_values", lambda a, v: a + v).alias("returns"))


def regret(values: DataFrame, keys: Sequence[str], best: float, order: str = "step") -> DataFrame:
    """values with running regret (sum of best - value) and running maximum."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return values.withColumns({"regret": F.sum(F.lit(best) - F.col("value")).over(w), "running_max": F.max("value").over(w)})


def first_argmax(df: DataFrame, keys: Sequence[str], value: str, choice: str) -> DataFrame:
    """The row of each group with the largest value; of ties the smallest choice."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(choice))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
