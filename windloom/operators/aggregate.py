"""Aggregates: moments, costs, intervals, maps, mass functions, errors, validation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windloom.operators.distributions import exact_quantiles

# Floor of deviations, bootstrap resamples and seed.
EPS, RESAMPLES, SEED = 1e-6, 20_000, 20260726


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def norm_stats(cells: DataFrame, by: Sequence[str] = ("level",), eps: float = EPS) -> DataFrame:
    """level, mean_u, std_u, mean_v, std_v over finite values, by mergeable sums; an error for a level without any."""
    out = []
    for c in ("u", "v"):
        x = F.when(finite(F.col(c).cast("double")), F.col(c).cast("double"))
        out += [F.sum(x).alias(f"s_{c}"), F.sum(x * x).alias(f"q_{c}"), F.count(x).alias(f"n_{c}")]
    return from_moments(cells.groupBy(*by).agg(*out), by, eps)


def from_moments(m: DataFrame, by: Sequence[str], eps: float = EPS) -> DataFrame:
    cols = []
    for c in ("u", "v"):
        n = F.when(F.col(f"n_{c}") == 0, F.raise_error(F.lit("level without finite values"))).otherwise(F.col(f"n_{c}"))
        mean = F.col(f"s_{c}") / n
        cols += [mean.alias(f"mean_{c}"), (F.sqrt(F.greatest(F.lit(0.0), F.col(f"q_{c}") / n - mean * mean)) + eps).alias(f"std_{c}")]
    return m.select(*by, *cols)


def normalise(cells: DataFrame, stats: DataFrame, inverse: bool = False) -> DataFrame:
    """u, v as z-scores of their level, or back; stats has one row a level."""
    j = cells.join(F.broadcast(stats), "level")
    f = (lambda c: F.col(c) * F.col(f"std_{c}") + F.col(f"mean_{c}")) if inverse else (lambda c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}"))
    return j.withColumns({"u": f("u"), "v": f("v")}).select(*cells.columns)


def experiment_summary(episodes: DataFrame, by: Sequence[str]) -> DataFrame:
    return episodes.groupBy(*by).agg(F.avg("reward").alias("mean_reward"), F.stddev_pop("reward").alias("std_reward"), F.avg("length").alias("mean_length"), F.avg(F.col("reached").cast("double")).alias("reach_rate"))


def performance(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, median, mean, p10, p90 of seconds; median of finite memory, NaN if none."""
    by = list(by)
    q = exact_quantiles(runs, by, "seconds", [0.1, 0.5, 0.9]).groupBy(*by).agg(*(F.max(F.when(F.col("k") == k, F.col("q"))).alias(n) for k, n in enumerate(("p10_s", "median_s", "p90_s"))))
    m = exact_quantiles(runs.where(finite(F.col("memory"))), by, "memory", [0.5]).select(*by, F.col("q").alias("memory"))
    counts = runs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_s"))
    return counts.join(q, by, "left").join(m, by, "left").select(*by, "n", "mean_s", "p10_s", "median_s", "p90_s", F.coalesce("memory", F.lit(float("nan"))).alias("memory"))


def interval(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and normal interval, deviation with n - 1 (0 for one value)."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), sd.alias("sd")).withColumns({"low": F.col("mean") - 1.96 * F.col("sd") / F.sqrt("n"), "high": F.col("mean") + 1.96 * F.col("sd") / F.sqrt("n")})


def bootstrap(df: DataFrame, by: Sequence[str], value: str, resamples: int = RESAMPLES, seed: int = SEED, at_once: int = 2_000_000) -> DataFrame:
    """Mean, deviation (n - 1), and the percentile interval of resampled means; one value gives itself.

    The groups are paired per-condition differences, a few thousand at most; a group is drawn in blocks of bounded size.
    """
    kinds = dict(df.dtypes)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].to_numpy(dtype=float))
        if len(x) == 1:
            return pd.DataFrame([[*key, 1, x[0], 0.0, x[0], x[0]]], columns=[*by, "n", "mean", "sd", "low", "high"])
        rng, means, step = np.random.default_rng(seed), [], max(1, at_once // len(x))
        for i in range(0, resamples, step):
            means.append(x[rng.integers(0, len(x), (min(step, resamples - i), len(x)))].mean(axis=1))
        low, high = np.quantile(np.concatenate(means), [0.025, 0.975])
        return pd.DataFrame([[*key, len(x), x.mean(), x.std(ddof=1), low, high]], columns=[*by, "n", "mean", "sd", "low", "high"])

    return df.where(F.col(value).isNotNull()).select(*by, value).groupBy(*by).applyInPandas(one, ", ".join([*(f"{c} {kinds[c]}" for c in by), "n long, mean double, sd double, low double, high double"]))


def mean_of_duplicates(obs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return obs.groupBy(*keys).agg(F.avg(value).alias(value))


def speed_maps(cells: DataFrame, at: Sequence[str] = ("y", "x")) -> DataFrame:
    s = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    speed = cells.withColumn("_s", s)
    p95 = exact_quantiles(speed, at, "_s", [0.95]).select(*at, F.col("q").alias("p95"))
    return speed.groupBy(*at).agg(F.avg("_s").alias("mean"), F.stddev_pop("_s").alias("std")).join(p95, list(at))


def colour_limit(cells: DataFrame) -> DataFrame:
    s = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    q = exact_quantiles(cells.select(s.alias("_s")), [], "_s", [0.99])
    return q.agg(F.greatest(F.max("q"), F.lit(1.0)).alias("colour_limit"))


def mass_function(samples: DataFrame, k: str, support: DataFrame) -> DataFrame:
    """k, p: share of samples at every point of the support, 0 where none."""
    n = samples.groupBy(k).agg(F.count("*").alias("n"))
    total = samples.agg(F.count("*").alias("all"))
    return support.join(n, k, "left").crossJoin(F.broadcast(total)).select(k, (F.coalesce("n", F.lit(0)) / F.col("all")).alias("p"))


def mass_distance(a: DataFrame, b: DataFrame, k: str) -> DataFrame:
    """Total variation, largest and Euclidean difference of two mass functions."""
    j = a.select(k, F.col("p").alias("p1")).join(b.select(k, F.col("p").alias("p2")), k, "full_outer")
    d = F.abs(F.coalesce("p1", F.lit(0.0)) - F.coalesce("p2", F.lit(0.0)))
    return j.agg((F.sum(d) / 2).alias("total_variation"), F.max(d).alias("max_abs"), F.sqrt(F.sum(d * d)).alias("l2"))


def cost_rmse(a: DataFrame, b: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    """RMSE of two cost tables over cells where both are below 0.99 of the limit."""
    j = a.select(*keys, F.col("cost").alias("c1")).join(b.select(*keys, F.col("cost").alias("c2")), list(keys)).where((F.col("c1") < 0.99 * limit) & (F.col("c2") < 0.99 * limit))
    return j.agg(F.sqrt(F.coalesce(F.sum(F.pow(F.col("c1") - F.col("c2"), 2)), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("rmse"), F.count("*").alias("n"))


def field_rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg(F.pow(a - b, 2)))


def pooled(cells: DataFrame, keys: Sequence[str], factor: int, side: int) -> DataFrame:
    """Means of factor x factor blocks; the side must divide."""
    if side % factor:
        raise ValueError(f"{factor} does not divide {side}")
    return cells.groupBy(*keys, F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg("u").alias("u"), F.avg("v").alias("v"))


def pointwise(pred: DataFrame, ref: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rmse, mae, r over cells that both have, components stacked."""
    j = pred.select(*keys, F.col("u").alias("u1"), F.col("v").alias("v1")).join(ref.select(*keys, F.col("u").alias("u2"), F.col("v").alias("v2")), list(keys))
    s = j.select(F.explode(F.array(F.struct(F.col("u1").alias("a"), F.col("u2").alias("b")), F.struct(F.col("v1").alias("a"), F.col("v2").alias("b")))).alias("p")).select("p.a", "p.b")
    return s.agg(F.sqrt(F.avg(F.pow(F.col("a") - F.col("b"), 2))).alias("rmse"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.corr("a", "b").alias("r"))


def spacing_m(axes: DataFrame) -> DataFrame:
    """dx_m, dy_m of a regular grid with columns lat, lon."""
    step = lambda c: (F.max(c) - F.min(c)) / (F.countDistinct(c) - 1)
    mean_lat = (F.max("lat") + F.min("lat")) / 2
    return axes.agg((F.abs(step("lon")) * 111320.0 * F.cos(F.radians(mean_lat))).alias("dx_m"), (F.abs(step("lat")) * 111320.0).alias("dy_m"))


def hourly_gaps(times: DataFrame, start: str, end: str, step: str = "1 hour") -> DataFrame:
    """issue (missing, unexpected), time: against the exact calendar [start, end)."""
    spark = times.sparkSession
    wanted = spark.sql(f"select explode(sequence(timestamp_ntz'{start}', timestamp_ntz'{end}' - interval {step}, interval {step})) as time")
    have = times.select(F.col("time").cast("timestamp_ntz").alias("time")).distinct()
    return wanted.join(have, "time", "left_anti").select(F.lit("missing").alias("issue"), "time").unionByName(have.join(wanted, "time", "left_anti").select(F.lit("unexpected").alias("issue"), "time"))


def held_out_days(df: DataFrame, time: str, first: int = 8, last: int = 14) -> DataFrame:
    return df.where(F.dayofmonth(time).between(first, last))


def halves(df: DataFrame, time: str, day: int = 11) -> tuple[DataFrame, DataFrame]:
    return df.where(F.dayofmonth(time) < day), df.where(F.dayofmonth(time) >= day)


def recipe_differences(recipes: DataFrame, reference: str, free: Sequence[str] = ("crop",)) -> DataFrame:
    """recipe, key: controlled keys on which a recipe (recipe, key, value) differs from the reference."""
    base = recipes.where(F.col("recipe") == reference).select("key", F.col("value").alias("base"), F.lit(True).alias("has"))
    rest = recipes.where(F.col("recipe") != reference)
    every = rest.select("recipe").distinct().crossJoin(F.broadcast(base)).join(rest, ["recipe", "key"], "full_outer")
    return every.where(~F.col("key").isin(list(free)) & ~(F.col("base").eqNullSafe(F.col("value")) & F.coalesce("has", F.lit(False)))).select("recipe", "key")


def mean_by_group(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str) -> DataFrame:
    """Mean of means: within inner groups first."""
    m = df.groupBy(*outer, *inner).agg(F.avg(value).alias("_m"))
    return m.groupBy(*outer).agg(F.avg("_m").alias(value)) if outer else m.agg(F.avg("_m").alias(value))


def pair_distances(members: DataFrame, group: Sequence[str], member: str, keys: Sequence[str]) -> DataFrame:
    """group, m1, m2, rms: the RMS vector difference of each pair of a group's members (a few per condition)."""
    a = members.select(*group, *keys, F.col(member).alias("m1"), F.col("u").alias("u1"), F.col("v").alias("v1"))
    b = members.select(*group, *keys, F.col(member).alias("m2"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    d = F.pow(F.col("u1") - F.col("u2"), 2) + F.pow(F.col("v1") - F.col("v2"), 2)
    return a.join(b, [*group, *keys]).where("m1 < m2").groupBy(*group, "m1", "m2").agg(F.sqrt(F.avg(d)).alias("rms"))


def pairwise_spread(members: DataFrame, group: Sequence[str], member: str, keys: Sequence[str]) -> DataFrame:
    """group, rms: mean over pairs of members of the RMS vector difference."""
    return pair_distances(members, group, member, keys).groupBy(*group).agg(F.avg("rms").alias("rms"))


def ordered(df: DataFrame, keys: Sequence[str], order: str, name: str = "idx") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
