"""Distances between distributions of two fields, by exact quantiles.

Quantiles interpolate linearly between order statistics. A group's values are first counted (equal values
meet before the shuffle), the counts are stored and cut by range into bins of about equally many different values; a bin
may hold a part of a group or many groups. Sums of the bins tell with which rank a group's part begins in each, and ranks
are found within bins. So no task holds a whole group, ties cost nothing, and an outlier or a heavy tail doesn't crowd a bin.
Which bin holds a row is stored with it: bins summed by one cut and read by another would give wrong ranks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windloom.functions.shared import shared_folder

# Quantile grid of the Wasserstein distance, tail pairs.
N_QUANTILES = 1024
TAILS = {"1%": (0.01, 0.99), "0.1%": (0.001, 0.999)}
#: Different values (of all groups) meant for a bin.
BIN_ROWS = 1 << 18


def grid(n: int = N_QUANTILES) -> list[float]:
    return [i / (n - 1) for i in range(n)]


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], bins: int | None = None) -> DataFrame:
    """by, k (position in qs), q: null and NaN values, and rows with a null key, take no part. bins: by default as many as BIN_ROWS asks for."""
    by = list(by)
    shared_folder(df.sparkSession)
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    for c in by:
        kept = kept.where(F.col(c).isNotNull())
    kept = kept.groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n")).checkpoint(eager=True)
    bins = bins or 1 + kept.count() // BIN_ROWS
    if bins > 1:
        kept = kept.repartitionByRange(bins, *by, "_x").withColumn("_bin", F.spark_partition_id()).checkpoint(eager=True)
    else:
        kept = kept.withColumn("_bin", F.lit(0))
    group = Window.partitionBy(*by)
    spans = kept.groupBy(*by, "_bin").agg(F.sum("_n").alias("_m"))
    before = F.coalesce(F.sum("_m").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(*by, "_bin", before.alias("_before"), F.sum("_m").over(group).alias("_all"))
    quantiles = np.array([float(q) for q in qs])

    def ranks(rows: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        spans = spans.reset_index(drop=True)
        rows = rows.merge(spans[by].assign(_g=np.arange(len(spans))), on=by) if by else rows.assign(_g=0)
        g, x, n = rows["_g"].to_numpy(), rows["_x"].to_numpy(), rows["_n"].to_numpy()
        order = np.lexsort((x, g))
        g, x, n = g[order], x[order], n[order]
        ends = np.searchsorted(g, np.arange(len(spans) + 1))
        out_g, out_k, out_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, (first, total) in enumerate(zip(spans["_before"].tolist(), spans["_all"].tolist())):
            upto = first + np.cumsum(n[ends[i] : ends[i + 1]])
            at = quantiles * (total - 1)
            low, high = np.floor(at), np.ceil(at)
            for rank, part in ((low, 1 - (at - low)), (high, np.where(high != low, at - low, 0.0))):
                k = np.flatnonzero((rank >= first) & (rank < upto[-1]) & (part > 0))
                out_g.append(np.full(len(k), i))
                out_k.append(k)
                out_q.append(x[ends[i] + np.searchsorted(upto, rank[k], side="right")] * part[k])
        got = spans[by].iloc[np.concatenate(out_g)].reset_index(drop=True)
        return got.assign(k=np.concatenate(out_k), q=np.concatenate(out_q))

    kinds = dict(kept.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "k int, q double"])
    hit = kept.groupBy("_bin").cogroup(spans.groupBy("_bin")).applyInPandas(ranks, schema)
    return hit.groupBy(*by, "k").agg(F.sum("q").alias("q"))


def stacked(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, component, x: the values one below the other."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("x")) for c in values])).alias("r")
    return df.select(*keys, rows).select(*keys, "r.component", "r.x")


def quantile_gaps(pred: DataFrame, ref: DataFrame, by: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """by, k, gap: distance of equal quantiles, for groups that both sides have; both sides go through one pass."""
    side = lambda d, n: d.select(*by, F.col(value).cast("double").alias("_v"), F.lit(n).alias("_side"))
    q = exact_quantiles(side(pred, 0).unionByName(side(ref, 1)), ["_side", *by], "_v", qs)
    both = q.groupBy(*by, "k").agg(F.max(F.when(F.col("_side") == 0, F.col("q"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("q"))).alias("_b"))
    return both.where("_a is not null and _b is not null").select(*by, "k", F.abs(F.col("_a") - F.col("_b")).alias("gap"))


def wasserstein1(pred: DataFrame, ref: DataFrame, by: Sequence[str], value: str, n: int = N_QUANTILES) -> DataFrame:
    """by, w1: mean distance of n quantiles."""
    return quantile_gaps(pred, ref, by, value, grid(n)).groupBy(*by).agg(F.avg("gap").alias("w1"))


def level_index(df: DataFrame) -> DataFrame:
    """Levels numbered from 0 in order; two fields are paired by this number, the longer stack cut."""
    numbers = df.select("level").distinct().withColumn("level_idx", F.row_number().over(Window.orderBy("level")) - 1)
    return df.join(F.broadcast(numbers), "level")  # as many rows as levels


def marginal_w1(pred: DataFrame, ref: DataFrame, values: Sequence[str] = ("u", "v"), n: int = N_QUANTILES) -> DataFrame:
    """component, w1: the mean over levels, paired by index, of each level's distance."""
    a, b = (stacked(level_index(d), ["level_idx"], values) for d in (pred, ref))
    return wasserstein1(a, b, ["component", "level_idx"], "x", n).groupBy("component").agg(F.avg("w1").alias("w1"))


def extreme_quantile_error(pred: DataFrame, ref: DataFrame, values: Sequence[str] = ("u", "v")) -> DataFrame:
    """tail, error: the mean over levels and components of quantile distances at the tails."""
    a, b = (stacked(level_index(d), ["level_idx"], values) for d in (pred, ref))
    qs = [(name, q) for name, pair in TAILS.items() for q in pair]
    names = F.array(*[F.lit(name) for name, _ in qs])
    gaps = quantile_gaps(a, b, ["component", "level_idx"], "x", [q for _, q in qs]).withColumn("tail", names[F.col("k")])
    return gaps.groupBy("tail", "component", "level_idx").agg(F.avg("gap").alias("e")).groupBy("tail").agg(F.avg("e").alias("error"))


def marginal_and_tails(pred: DataFrame, ref: DataFrame, values: Sequence[str] = ("u", "v"), n: int = N_QUANTILES) -> tuple[DataFrame, DataFrame]:
    """What marginal_w1 and extreme_quantile_error give, both sides read once for the two."""
    a, b = (stacked(level_index(d), ["level_idx"], values) for d in (pred, ref))
    qs = [(name, q) for name, pair in TAILS.items() for q in pair]
    names = F.array(*[F.lit(name) for name, _ in qs])
    gaps = quantile_gaps(a, b, ["component", "level_idx"], "x", grid(n) + [q for _, q in qs]).checkpoint(eager=True)
    w1 = gaps.where(F.col("k") < n).groupBy("component", "level_idx").agg(F.avg("gap").alias("w1")).groupBy("component").agg(F.avg("w1").alias("w1"))
    tails = gaps.where(F.col("k") >= n).withColumn("tail", names[F.col("k") - n])
    return w1, tails.groupBy("tail", "component", "level_idx").agg(F.avg("gap").alias("e")).groupBy("tail").agg(F.avg("e").alias("error"))


def conditional_w1(pred: DataFrame, ref: DataFrame, condition: Sequence[str], values: Sequence[str] = ("u", "v"), n: int = N_QUANTILES) -> DataFrame:
    """w1: per condition and level with all seeds pooled, then the mean over components and levels, then over conditions; NaN if none."""
    a, b = (stacked(d, [*condition, "level"], values) for d in (pred, ref))
    groups = wasserstein1(a, b, [*condition, "component", "level"], "x", n).groupBy(*condition).agg(F.avg("w1").alias("w1"))
    return groups.agg(F.coalesce(F.avg("w1"), F.lit(float("nan"))).alias("w1"), F.count("*").alias("groups"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, density over equal bins, the last one closed; empty bins are NaN. Values outside take no part."""
    width = (high - low) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width)).cast("int")
    counts = df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").crossJoin(F.broadcast(total)).select("bin", F.coalesce(F.col("n") / (F.col("all") * width), F.lit(float("nan"))).alias("density"))
