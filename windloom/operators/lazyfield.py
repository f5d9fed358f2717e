"""Unbounded fields as functions of a box: windows that cover it are made on demand and blended.

A value depends on the seed and its coordinates only, so any box agrees with any larger one and nothing is
stored. A round sends each noise or field cell to the windows that hold it, denoises each window as one group
and adds up weighted windows: sum(w * value) / sum(w). Each further round needs a margin of one window.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions.noise import coordinate_normal, ramp

Denoiser = Callable[[np.ndarray, int], np.ndarray]


def toy_denoiser(values: np.ndarray, level: int = 0, slope: float = -3.0, k0: float = 0.05, rms: float = 15.0, levels: float = 1.0) -> np.ndarray:
    """A divergence-free field from noise of the same shape, (2 * n, h, w): u and v of level after level.

    The stream function has the phases of the noise's vorticity and amplitudes of a power law, so that the spectrum of
    winds has the slope; levels are blended by exponential weights (over ``levels`` of them), speeds scaled to ``rms``.
    """
    n, h, w = values.shape[0] // 2, *values.shape[1:]
    ky, kx = 2 * np.pi * np.fft.fftfreq(h)[:, None], 2 * np.pi * np.fft.fftfreq(w)[None, :]
    k = np.hypot(kx, ky)
    u, v = np.fft.fft2(values[0::2]), np.fft.fft2(values[1::2])
    vorticity = 1j * kx * v - 1j * ky * u
    stream = np.where(k > 0, (k0 + k) ** ((slope - 2) / 2), 0.0) * np.exp(1j * np.angle(-vorticity))
    out = np.stack([np.fft.ifft2(-1j * ky * stream).real, np.fft.ifft2(1j * kx * stream).real], axis=1)
    if levels > 0 and n > 1:
        near = np.exp(-abs(np.subtract.outer(np.arange(n), np.arange(n))) / levels)
        out = np.einsum("lm,mchw->lchw", near / near.sum(axis=1, keepdims=True), out)
    return out.reshape(values.shape) * (rms / max(np.sqrt((out**2).sum(axis=1).mean()), 1e-12))


def box(spark: SparkSession, y0: int, y1: int, x0: int, x1: int, t0: int = 0, t1: int = 1) -> DataFrame:
    n = (t1 - t0) * (y1 - y0) * (x1 - x0)
    i, h, w = F.col("id"), y1 - y0, x1 - x0
    return spark.range(n).select((F.lit(t0) + F.floor(i / (h * w))).cast("int").alias("t"), (F.lit(y0) + F.floor(i / w) % h).cast("int").alias("y"), (F.lit(x0) + i % w).cast("int").alias("x"))


def coordinate_noise(cells: DataFrame, channels: int, seed: int) -> DataFrame:
    """cells with c0, c1, ..: standard normal values of (seed, channel, t, y, x)."""
    return coordinate_normal(cells, channels, seed)


def windows_of(at: Column, window: int, stride: int) -> Column:
    """Numbers of the windows [k * stride, k * stride + window) that hold a coordinate."""
    return F.sequence((F.floor((at - window) / stride) + 1).cast("int"), F.floor(at / stride).cast("int"))


class InfiniteField:
    """depth rounds of windowed denoising and blending on top of coordinate noise."""

    def __init__(self, denoiser: Denoiser = toy_denoiser, window: int = 16, stride: int | None = None, depth: int = 2, seed: int = 0, edge: float = 0.01, level: int = 0):
        self.denoiser, self.window, self.stride, self.depth, self.seed, self.edge, self.level = denoiser, window, stride or window // 2, depth, seed, edge, level

    def margin(self) -> int:
        return self.window

    def _round(self, cells: DataFrame, k: int) -> DataFrame:
        win, stride, denoise, level, edge = self.window, self.stride, self.denoiser, self.level, self.edge
        sent = cells.withColumn("wy", F.explode(windows_of(F.col("y"), win, stride))).withColumn("wx", F.explode(windows_of(F.col("x"), win, stride)))

        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            if len(pdf) < win * win:  # a window that the box cuts: its cells lie in the margin
                return pd.DataFrame({c: pd.Series(dtype="int32" if c in ("t", "y", "x") else "float64") for c in ("t", "y", "x", "c0", "c1")})
            pdf = pdf.sort_values(["y", "x"])
            out = denoise(pdf[["c0", "c1"]].to_numpy().T.reshape(2, win, win), level)
            return pd.DataFrame({"t": pdf["t"], "y": pdf["y"], "x": pdf["x"], "c0": out[0].ravel(), "c1": out[1].ravel()})

        made = sent.groupBy("t", "wy", "wx").applyInPandas(lambda key, pdf: one(key, pdf).assign(wy=key[1], wx=key[2]).astype({"wy": "int32", "wx": "int32"}), "t int, y int, x int, c0 double, c1 double, wy int, wx int")
        w = ramp(F.col("y") - F.col("wy") * stride, win, edge) * ramp(F.col("x") - F.col("wx") * stride, win, edge)
        made = made.withColumn("w", w)
        return made.groupBy("t", "y", "x").agg((F.sum(F.col("w") * F.col("c0")) / F.sum("w")).alias("c0"), (F.sum(F.col("w") * F.col("c1")) / F.sum("w")).alias("c1"))

    def materialise(self, spark: SparkSession, y0: int, y1: int, x0: int, x1: int, t0: int = 0, t1: int = 1) -> DataFrame:
        """t, y, x, u, v of a box."""
        m = self.margin() * self.depth
        cells = coordinate_noise(box(spark, y0 - m, y1 + m, x0 - m, x1 + m, t0, t1), 2, self.seed)
        for k in range(self.depth):
            m -= self.margin()
            cells = self._round(cells, k).where(F.col("y").between(y0 - m, y1 + m - 1) & F.col("x").between(x0 - m, x1 + m - 1))
        return cells.select("t", "y", "x", F.col("c0").alias("u"), F.col("c1").alias("v"))

    def calls(self, spark: SparkSession, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
        """round, windows that a box needs."""
        rows, m = [], self.window * (self.depth - 1)
        for k in range(self.depth):
            n = lambda a, b: (b - 1) // self.stride - ((a - self.window) // self.stride + 1) + 1
            rows.append((k, n(y0 - m, y1 + m) * n(x0 - m, x1 + m)))
            m -= self.window
        return spark.createDataFrame(rows, "round int, windows long")

    def seams(self, y0: int, y1: int) -> list[int]:
        return [s for s in range(y0 // self.stride * self.stride, y1, self.stride) if y0 < s < y1]


class ChartField:
    """An atlas: each chart solves its own core and halo from coordinate noise; a partition of unity joins them.

    The solver steps a chart's state toward the consensus of its overlapping windows' clean predictions (Heun).
    """

    def __init__(self, denoiser: Denoiser = toy_denoiser, core: int = 16, halo: int = 8, window: int = 16, stride: int = 8, steps: int = 3, seed: int = 0, strategy: str = "average", relaxation: float = 0.5):
        self.denoiser, self.core, self.halo, self.window, self.stride, self.steps, self.seed = denoiser, core, halo, window, stride, steps, seed
        self.strategy, self.relaxation = strategy, relaxation

    def materialise(self, spark: SparkSession, y0: int, y1: int, x0: int, x1: int, t0: int = 0, t1: int = 1) -> DataFrame:
        core, halo, win, stride, steps, denoise = self.core, self.halo, self.window, self.stride, self.steps, self.denoiser
        relax = self.relaxation if self.strategy == "consensus" else 1.0
        side = core + 2 * halo
        lo = lambda a: (a - halo) // core
        hi = lambda b: -(-(b + halo) // core)
        keys = box(spark, lo(y0), hi(y1), lo(x0), hi(x1), t0, t1).select("t", F.col("y").alias("cy"), F.col("x").alias("cx"))
        local = spark.range(side * side).select((F.floor(F.col("id") / side) - halo).cast("int").alias("dy"), (F.col("id") % side - halo).cast("int").alias("dx"))
        cells = keys.crossJoin(F.broadcast(local)).select("t", "cy", "cx", (F.col("cy") * core + F.col("dy")).alias("y"), (F.col("cx") * core + F.col("dx")).alias("x"))  # side * side offsets
        cells = coordinate_noise(cells, 2, self.seed)

        def clean(z: np.ndarray) -> np.ndarray:
            total, weight = np.zeros_like(z), np.zeros(z.shape[1:])
            mid = (win - 1) / 2
            r = 1 - 0.99 * np.abs(np.arange(win) - mid) / mid
            w = np.outer(r, r)
            for a in range(0, side - win + 1, stride):
                for b in range(0, side - win + 1, stride):
                    total[:, a : a + win, b : b + win] += w * denoise(z[:, a : a + win, b : b + win], 0)
                    weight[a : a + win, b : b + win] += w
            return total / np.maximum(weight, 1e-12)

        def chart(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["y", "x"])
            z = pdf[["c0", "c1"]].to_numpy().T.reshape(2, side, side)
            sigma = np.append(np.linspace(1.0, 0.2, steps), 0.0)
            for s, n in zip(sigma, sigma[1:]):
                d = (z - clean(z)) / s
                nxt = z + relax * (n - s) * d
                if n > 0:
                    nxt = z + relax * (n - s) * 0.5 * (d + (nxt - clean(nxt)) / n)
                z = nxt
            return pd.DataFrame({"t": pdf["t"], "cy": pdf["cy"], "cx": pdf["cx"], "y": pdf["y"], "x": pdf["x"], "u": z[0].ravel(), "v": z[1].ravel()})

        made = cells.groupBy("t", "cy", "cx").applyInPandas(chart, "t int, cy int, cx int, y int, x int, u double, v double")
        weight = ramp(F.col("y") - (F.col("cy") * core - halo), side) * ramp(F.col("x") - (F.col("cx") * core - halo), side)
        made = made.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1)).withColumn("w", weight)
        return made.groupBy("t", "y", "x").agg((F.sum(F.col("w") * F.col("u")) / F.sum("w")).alias("u"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def query_log(field: InfiniteField, points: DataFrame) -> DataFrame:
    """y, x, u, v, seed, seconds of point queries (y, x): every point's own box is made in one task, as if asked alone."""
    spark = points.sparkSession
    win, stride, depth, denoise, edge, seed = field.window, field.stride, field.depth, field.denoiser, field.edge, field.seed
    side = 2 * win * depth + 1
    reach = spark.range(side * side).select((F.floor(F.col("id") / side) - win * depth).cast("int").alias("dy"), (F.col("id") % side - win * depth).cast("int").alias("dx"))
    cells = points.select(F.col("y").alias("py"), F.col("x").alias("px")).distinct().crossJoin(F.broadcast(reach))  # a point's box, of a fixed size
    cells = coordinate_noise(cells.select("py", "px", F.lit(0).alias("t"), (F.col("py") + F.col("dy")).alias("y"), (F.col("px") + F.col("dx")).alias("x")), 2, seed)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        began = time.perf_counter()
        pdf = pdf.sort_values(["y", "x"])
        now = pdf[["c0", "c1"]].to_numpy().T.reshape(2, side, side)
        y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
        mid = (win - 1) / 2
        r = 1 - (1 - edge) * np.abs(np.arange(win) - mid) / mid
        weights = np.outer(r, r)
        for _ in range(depth):
            total, weight = np.zeros_like(now), np.zeros(now.shape[1:])
            for a in range(-y0 % stride, now.shape[1] - win + 1, stride):
                for b in range(-x0 % stride, now.shape[2] - win + 1, stride):
                    total[:, a : a + win, b : b + win] += weights * denoise(now[:, a : a + win, b : b + win], field.level)
                    weight[a : a + win, b : b + win] += weights
            now = (total / np.maximum(weight, 1e-300))[:, win:-win, win:-win]
            y0, x0 = y0 + win, x0 + win
        return pd.DataFrame({"y": [key[0]], "x": [key[1]], "u": [now[0, 0, 0]], "v": [now[1, 0, 0]], "seed": [seed], "seconds": [time.perf_counter() - began]}).astype({"y": "int32", "x": "int32", "seed": "int64"})

    return cells.groupBy("py", "px").applyInPandas(one, "y int, x int, u double, v double, seed long, seconds double")


def repeats_exactly(field: InfiniteField, spark: SparkSession, *bounds: int) -> bool:
    a, b = field.materialise(spark, *bounds), field.materialise(spark, *bounds)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
