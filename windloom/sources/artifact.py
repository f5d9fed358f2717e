"""Artifacts: cells, attributes and query logs as Parquet; condition records and caches from NumPy files."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Attributes stored as JSON text.
JSON_ATTRS = ("generator", "conditioning", "capabilities", "hardware", "level_coeffs", "seam_boundaries")


def make_cells(arrays: DataFrame, ny: int, nx: int) -> DataFrame:
    """t, level, y, x, u, v (float) from rows of (t, level, u array, v array); arrays of another length are an error."""
    n = ny * nx
    ok = (F.size("u") == n) & (F.size("v") == n)
    flat = arrays.select("t", "level", F.posexplode(F.arrays_zip(F.when(ok, F.col("u")).otherwise(F.raise_error(F.lit("plane of wrong size")).cast("array<double>")).alias("u"), F.col("v").alias("v"))).alias("i", "c"))
    return flat.select("t", "level", (F.col("i") / nx).cast("int").alias("y"), (F.col("i") % nx).alias("x"), F.col("c.u").cast("float").alias("u"), F.col("c.v").cast("float").alias("v"))


def to_planes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, u, v arrays in row-major order: one row a plane."""
    c = F.array_sort(F.collect_list(F.struct("y", "x", "u", "v")))
    return cells.groupBy(*keys).agg(c.alias("c")).select(*keys, F.transform("c", lambda r: r["u"]).alias("u"), F.transform("c", lambda r: r["v"]).alias("v"))


def default_attrs(generator: str, conditioning: str, levels: list[int], seed: int | None = None, capabilities: dict | None = None) -> dict:
    return {"format_version": "v1", "generator": {"name": generator}, "capabilities": capabilities or {}, "conditioning": {"kind": conditioning}, "model_levels": levels, "seed": -1 if seed is None else seed, "dt_native": "1h", "lon_convention": "0-360", "units": "u,v:m/s; T:K"}


def encode_attrs(attrs: dict) -> list[tuple[str, str]]:
    return [(k, json.dumps(v) if isinstance(v, (dict, list)) else str(v)) for k, v in attrs.items()]


def decode_attrs(rows: list[tuple[str, str]]) -> dict:
    """JSON attributes decoded; text that isn't JSON stays."""
    out = {}
    for k, v in rows:
        try:
            out[k] = json.loads(v) if k in JSON_ATTRS else v
        except ValueError:
            out[k] = v
    return out


def write(cells: DataFrame, attrs: dict, path: str, partition: str | None = None) -> None:
    """Overwrites; clustered by time and level so that slices read few row groups."""
    w = cells.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(partition) if partition else w).parquet(f"{path}/cells")
    cells.sparkSession.createDataFrame(encode_attrs(attrs), "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/attrs")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/cells"), decode_attrs([(r["name"], r["value"]) for r in spark.read.parquet(f"{path}/attrs").collect()])


def write_query_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(f"{path}/querylog")


def has_query_log(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/querylog")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cache_from_npz(spark: SparkSession, path: str) -> DataFrame:
    """t, i, j[, k], u[, v] with 1-indexed axes, from .npz caches of rank 4 (one component) or 5 (two); bad ranks and values are errors."""

    def run(it: Iterator[pd.DataFrame]):
        for pdf in it:
            for raw in pdf["content"]:
                w = np.load(io.BytesIO(raw))["winds"].astype(float)
                if w.ndim not in (4, 5) or w.shape[-1] != w.ndim - 3 or not np.isfinite(w).all():
                    raise ValueError(f"winds of shape {w.shape} are no finite cache")
                w = w if w.ndim == 5 else np.concatenate([w[:, :, :, None, :], np.zeros((*w.shape[:3], 1, 1))], axis=4)
                t, i, j, k = np.meshgrid(*(np.arange(n) for n in w.shape[:4]), indexing="ij")
                yield pd.DataFrame({"t": t.ravel(), "i": i.ravel() + 1, "j": j.ravel() + 1, "k": k.ravel() + 1, "u": w[..., 0].ravel(), "v": w[..., 1].ravel()})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "t int, i int, j int, k int, u double, v double")


def condition_runs(spark: SparkSession, folder: str) -> DataFrame:
    """month, day, hour, seed, path of the files m*_d*_h*_s*.npz; their number must be the config's."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "m*_d*_h*_s*.npz").load(folder).select("path")
    num = lambda g: F.regexp_extract("path", r"m(\d+)_d(\d+)_h(\d+)_s(\d+)\.npz$", g).cast("int")
    out = files.select(num(1).alias("month"), num(2).alias("day"), num(3).alias("hour"), num(4).alias("seed"), "path")
    wanted = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/config.json").collect()))["conditions"]
    if out.count() != wanted:
        raise ValueError(f"{folder} holds another number of files than its config's {wanted}")
    return out


def condition_cells(spark: SparkSession, folder: str, frame: int = 0) -> DataFrame:
    """The runs' cells at one frame: keys, level, y, x, u, v, seconds."""
    keyed = condition_runs(spark, folder)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "m*_d*_h*_s*.npz").load(folder).select("path", "content")

    def run(it: Iterator[pd.DataFrame]):
        for pdf in it:
            for r in pdf.itertuples(index=False):
                z = np.load(io.BytesIO(r.content))
                u, v = z["u"][frame], z["v"][frame]
                level, y, x = np.meshgrid(z["levels"], np.arange(u.shape[1]), np.arange(u.shape[2]), indexing="ij")
                yield pd.DataFrame({"path": r.path, "level": level.ravel().astype(float), "y": y.ravel(), "x": x.ravel(), "u": u.ravel().astype(float), "v": v.ravel().astype(float)})

    return content.mapInPandas(run, "path string, level double, y int, x int, u double, v double").join(keyed, "path").drop("path")


def periodic(base: DataFrame, box: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """box (t, y, x) filled from a base table that repeats in all directions."""
    t, y, x = (F.pmod(c, F.lit(n)) for c, n in zip(("t", "y", "x"), sizes))
    keyed = box.select(F.col("t").alias("_t"), F.col("y").alias("_y"), F.col("x").alias("_x"), t.alias("t"), y.alias("y"), x.alias("x"))
    return keyed.join(base, ["t", "y", "x"]).drop("t", "y", "x").withColumnsRenamed({"_t": "t", "_y": "y", "_x": "x"})


def log_metrics(spark: SparkSession, path: str, run: str, metrics: dict[str, float], step: int) -> None:
    spark.createDataFrame([(run, k, float(v), step) for k, v in metrics.items()], "run string, key string, value double, step int").coalesce(1).write.mode("append").parquet(path)
