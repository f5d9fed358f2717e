"""Structure of ensembles: sliced patch distance, curve errors, gradient distance, spread ratio."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windloom.functions.noise import uniform
from windloom.operators import aggregate, distributions, windows

# Pooling factors, patch side, patches, projections, seed, jumps sampled.
FACTORS, PATCH, PATCHES, PROJECTIONS, SEED, JUMPS = (1, 2, 4), 5, 2048, 64, 17, 250_000


def standardise(cells: DataFrame, reference: DataFrame) -> DataFrame:
    s = reference.groupBy("level").agg(F.avg("u").alias("mu"), F.stddev_pop("u").alias("su"), F.avg("v").alias("mv"), F.stddev_pop("v").alias("sv"))
    return cells.join(F.broadcast(s), "level").withColumns({"u": (F.col("u") - F.col("mu")) / (F.col("su") + 1e-6), "v": (F.col("v") - F.col("mv")) / (F.col("sv") + 1e-6)}).select(*cells.columns)  # one row a level


def patches(cells: DataFrame, side: int, patch: int, count: int, seed: int) -> DataFrame:
    """id, values: ``count`` vector patches (u then v, row-major) at places drawn by a hash, the same for equal slices."""
    spark = cells.sparkSession
    numbered = cells.select("s").distinct().withColumn("_i", F.row_number().over(Window.orderBy("s")) - 1)
    n = numbered.count()
    room = side - patch + 1
    draw = lambda stream, m: F.floor(uniform(F.lit(seed), F.col("id"), stream=stream) * m).cast("int")
    at = spark.range(count).select("id", draw(1, n).alias("_i"), draw(2, room).alias("y0"), draw(3, room).alias("x0")).join(numbered, "_i")
    cut = cells.join(F.broadcast(at), "s").where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + patch) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + patch))
    rows = cut.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "u", "v"))).alias("c"))  # patch * patch values
    return rows.select("id", F.concat(F.transform("c", lambda c: c["u"]), F.transform("c", lambda c: c["v"])).alias("values"))


def sliced_distance(a: DataFrame, b: DataFrame, size: int, projections: int, seed: int) -> DataFrame:
    """distance: mean over random directions of the mean gap between equally ranked projections."""
    spark = a.sparkSession
    d = np.random.default_rng(seed).standard_normal((projections, size))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    dirs = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(d)], "p int, d array<double>")

    def ranked(x: DataFrame, name: str) -> DataFrame:
        dot = F.aggregate(F.zip_with("values", "d", lambda v, w: v * w), F.lit(0.0), lambda s, t: s + t)
        return x.crossJoin(F.broadcast(dirs)).select("p", "id", dot.alias(name)).withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(name, "id"))).drop("id")

    return ranked(a, "x").join(ranked(b, "y"), ["p", "r"]).groupBy("p").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("w")).agg(F.avg("w").alias("distance"))


def multiscale_patch_distance(pred: DataFrame, ref: DataFrame, side: int, factors: Sequence[int] = FACTORS, patch: int = PATCH, count: int = PATCHES, projections: int = PROJECTIONS, seed: int = SEED) -> DataFrame:
    """factor, distance; both standardised by the reference's levels, pooled, cut into patches at equal draws."""
    a, b = standardise(pred, ref), standardise(ref, ref)
    out = None
    for f in factors:
        if side // f < patch:  # no patch fits: said, not left out
            one = pred.sparkSession.createDataFrame([(f, float("nan"))], "factor int, distance double")
            out = one if out is None else out.unionByName(one)
            continue
        pa, pb = (patches(aggregate.pooled(x, ["s", "level"], f, side), side // f, patch, count, seed + f) for x in (a, b))
        one = sliced_distance(pa, pb, 2 * patch * patch, projections, seed).select(F.lit(f).alias("factor"), "distance")
        out = one if out is None else out.unionByName(one)
    return out


def structure_log_rmse(pred: DataFrame, ref: DataFrame, keys: Sequence[str], lags: Sequence[int]) -> DataFrame:
    a, b = (windows.structure_function(x, keys, lags) for x in (pred, ref))
    return a.withColumnRenamed("s2", "x").join(b, "lag").agg(F.sqrt(F.avg(F.pow(F.ln(F.col("x") + 1e-30) - F.ln(F.col("s2") + 1e-30), 2))).alias("rmse"))


def correlation_rmse(pred: DataFrame, ref: DataFrame, keys: Sequence[str], lags: Sequence[int]) -> DataFrame:
    a, b = (windows.correlation_curve(x, keys, lags) for x in (pred, ref))
    return a.withColumnRenamed("correlation", "x").join(b, "lag").agg(F.sqrt(F.avg(F.pow(F.col("x") - F.col("correlation"), 2))).alias("rmse"))


def gradient_w1(pred: DataFrame, ref: DataFrame, keys: Sequence[str], count: int = JUMPS) -> DataFrame:
    """Distance of neighbour jumps' distributions; ``count`` jumps in order of a hash where there are more (a sampling operator)."""
    def sampled(x: DataFrame) -> DataFrame:
        j = windows.jumps(x, keys)
        return j.withColumn("_h", F.xxhash64(*keys, "axis", "line", "at")).orderBy("_h").limit(count)

    return distributions.wasserstein1(sampled(pred), sampled(ref), [], "jump")


def spread_ratio(pred: DataFrame, ref: DataFrame, group: Sequence[str], seed: str, day: str, keys: Sequence[str]) -> DataFrame:
    """ratio, generated, observed: mean RMS over pairs of seeds of one condition (group and day) against that over pairs of days of one group."""
    a = aggregate.pair_distances(pred, [*group, day], seed, keys).agg(F.avg("rms").alias("generated"))
    b = aggregate.pair_distances(ref, group, day, keys).agg(F.avg("rms").alias("observed"))
    return a.crossJoin(F.broadcast(b)).select((F.col("generated") / F.col("observed")).alias("ratio"), "generated", "observed")  # one row each


def white_noise(cells: DataFrame, keys: Sequence[str] = ("s", "level"), seed: int = 0) -> DataFrame:
    """Gaussian cells with each plane's mean and deviation; a value depends on seed and coordinates only."""
    from windloom.functions.noise import normal

    w = Window.partitionBy(*keys)
    at = [F.lit(seed), *(F.col(k) for k in keys), F.col("y"), F.col("x")]
    return cells.select(*keys, "y", "x", (F.avg("u").over(w) + F.stddev_pop("u").over(w) * normal(*at, stream=1)).alias("u"), (F.avg("v").over(w) + F.stddev_pop("v").over(w) * normal(*at, stream=2)).alias("v"))
