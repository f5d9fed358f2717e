"""Ingestion, caches, statistics, configurations and manifests."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions.columns import wrap_longitude
from windloom.functions.noise import coordinate_normal
from windloom.operators.launcher import coerce, flatten
from windloom.sources import artifact


def ingest(parts: Sequence[DataFrame], path: str, attrs: dict, time: str = "time") -> None:
    """Chunks in any order as one artifact sorted by time: range-partitioned, so that no task sorts them all."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    artifact.write(whole.repartitionByRange(F.col(time)).sortWithinPartitions(time), attrs, path)


def demo_cache(spark: SparkSession, shape: Sequence[int], frames: int = 24, seed: int = 0, mean: float = 12.0, std: float = 6.0, time_sigma: float = 2.0) -> DataFrame:
    """t, i, j[, k], u[, v]: smooth periodic winds for trials, with a mean of u. Noise is blurred (sigma 15 % of an axis, one at least), scaled to unit variance.

    The blur is one circular transform of a component's table, which is small by its use.
    """
    if len(shape) not in (2, 3):
        raise ValueError("the grid has two or three axes")
    dims, axes = (frames, *shape), ["t", "i", "j", "k"][: len(shape) + 1]
    whole, columns, rest = spark.range(int(np.prod(dims))), [], F.col("id")
    for n, a in reversed(list(zip(dims, axes))):
        columns.append((rest % n).cast("int").alias(a))
        rest = F.floor(rest / n)
    cells = whole.select(*reversed(columns))
    noise = cells.withColumns({"y": F.col("i"), "x": F.col("j") + (shape[1] * F.col("k") if len(shape) == 3 else 0)})
    noise = coordinate_normal(noise, len(shape) - 1, seed).drop("y", "x")
    sigmas = (time_sigma, *(max(1.0, 0.15 * n) for n in shape))

    def kernel(n: int, sigma: float) -> np.ndarray:
        r = int(4 * sigma + 0.5)
        w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        out = np.zeros(n)
        np.add.at(out, np.arange(-r, r + 1) % n, w / w.sum())
        return np.fft.fft(out).real

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(axes)
        for name in [c for c in pdf.columns if c.startswith("c")]:
            f = np.fft.fftn(pdf[name].to_numpy().reshape(dims))
            for d, sigma in enumerate(sigmas):
                f = f * kernel(dims[d], sigma).reshape([-1 if k == d else 1 for k in range(len(dims))])
            f = np.fft.ifftn(f).real
            pdf[name] = (f / (f.std() + 1e-9)).ravel()
        return pdf

    made = noise.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(lambda pdf: smooth(pdf.drop(columns="whole")), ", ".join([*(f"{a} int" for a in axes), *(f"c{c} double" for c in range(len(shape) - 1))]))
    winds = [(F.lit(mean) + std * F.col("c0")).alias("u"), *([(std * F.col("c1")).alias("v")] if len(shape) == 3 else [])]
    return made.select(*axes, *winds)


def pressure_levels(spark: SparkSession, levels: Sequence[float], n: int) -> DataFrame:
    """k (from 0), hpa, from low to high altitude: the levels asked for, or n of them evenly spaced in the logarithm."""
    if not levels or min(levels) <= 0 or n <= 0:
        raise ValueError("levels and their number must be positive")
    if n == len(levels):
        return spark.createDataFrame(list(enumerate(sorted(map(float, levels), reverse=True))), "k int, hpa double")
    a, b = float(np.log(max(levels))), float(np.log(min(levels)))
    return spark.range(n).select(F.col("id").cast("int").alias("k"), F.exp(F.lit(a) + F.col("id") * ((b - a) / max(n - 1, 1))).alias("hpa"))


def save_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").parquet(path)  # one row a level


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def coordinate_channels(points: DataFrame, grid: DataFrame) -> DataFrame:
    """points (lat, lon and more) with lat_n, lon_n: distances from the grid's centre in half widths, longitudes turned to its side first."""
    c = grid.agg(((F.max("lat") + F.min("lat")) / 2).alias("_la"), ((F.max("lat") - F.min("lat")) / 2).alias("_lh"), ((F.max("lon") + F.min("lon")) / 2).alias("_lo"), ((F.max("lon") - F.min("lon")) / 2).alias("_oh"))
    lon = wrap_longitude(F.col("lon"), F.col("_lo"))
    return points.crossJoin(F.broadcast(c)).withColumns({"lat_n": (F.col("lat") - F.col("_la")) / F.col("_lh"), "lon_n": (lon - F.col("_lo")) / F.col("_oh")}).drop("_la", "_lh", "_lo", "_oh")  # one row


def field_payload(cells: DataFrame, chunk: Sequence[str], side: int, points: int = 12) -> DataFrame:
    """chunk keys, payload: JSON of u and v rounded to 3 digits at a lattice of points a side, in order of t, level, y, x."""
    at = sorted({int(x) for x in np.linspace(0, side - 1, points).round()})
    picked = cells.where(F.col("y").isin(at) & F.col("x").isin(at))
    rows = F.array_sort(F.collect_list(F.struct("t", "level", "y", "x", F.bround("u", 3).alias("u"), F.bround("v", 3).alias("v"))))  # a chunk's lattice
    return picked.groupBy(*chunk).agg(rows.alias("c")).select(*chunk, F.to_json(F.struct(F.transform("c", lambda r: r["u"]).alias("u"), F.transform("c", lambda r: r["v"]).alias("v"))).alias("payload"))


def load_config(path: str, overrides: Mapping[str, str] | None = None, sections: tuple[str, ...] | None = None) -> dict:
    """A YAML file; with ``sections`` their keys at the top (all with none named), then overrides in their defaults' types."""
    import yaml

    with open(path) as f:
        config = yaml.safe_load(f) or {}
    if sections is not None:
        config = flatten(config, sections)
    for key, value in (overrides or {}).items():
        if key not in config:
            raise KeyError(f"unknown option {key}")
        config[key] = coerce(value, config[key])
    return config


def manifest(spark: SparkSession, path: str, about: dict, checks: Mapping[str, DataFrame]) -> dict:
    """Write a manifest as JSON after all checks pass: each is a table of problems, which must be empty."""
    for name, problems in checks.items():
        first = problems.limit(3).collect()
        if first:
            raise ValueError(f"{name}: " + "; ".join(str(r.asDict()) for r in first))
    told = about | {"checks": sorted(checks)}
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return told


