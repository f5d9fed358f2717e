"""Planning: backward induction, all-pairs stochastic shortest paths, Gaussian-process estimation, acquisition."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windloom.functions.shared import shared_folder

# Sweeps, relative tolerance, share of the out-of-bounds cost from which a cell counts as lost.
SWEEPS, TOLERANCE, SENTINEL = 2000, 1e-3, 0.99



def transitions(spark: SparkSession, drift: DataFrame, actor: np.ndarray, n_x: int, n_y: int, mode: str = "terminal") -> DataFrame:
    """i, j, action, i2, j2, p, out: drift is (i, j, d, p) along i, actor mass (actions, displacements) along j."""
    most = actor.shape[1] // 2
    rows = [(a, z - most, float(actor[a, z])) for a in range(actor.shape[0]) for z in range(actor.shape[1]) if actor[a, z] > 0]
    acts = spark.createDataFrame(rows, "action int, z int, q double")
    j = drift.crossJoin(F.broadcast(acts)).select("i", "j", "action", (F.col("i") + F.col("d")).alias("i2"), (F.col("j") + F.col("z")).alias("j2"), (F.col("p") * F.col("q")).alias("p"))  # a few displacements
    out = ~(F.col("i2").between(1, n_x) & F.col("j2").between(1, n_y))
    if mode == "clip":
        j, out = j.withColumns({"i2": F.greatest(F.lit(1), F.least(F.lit(n_x), "i2")), "j2": F.greatest(F.lit(1), F.least(F.lit(n_y), "j2"))}), F.lit(False)
    elif mode == "periodic":
        j, out = j.withColumns({"i2": F.pmod(F.col("i2") - 1, F.lit(n_x)) + 1, "j2": F.greatest(F.lit(1), F.least(F.lit(n_y), "j2"))}), F.lit(False)
    return j.withColumn("out", out).groupBy("i", "j", "action", "i2", "j2", "out").agg(F.sum("p").alias("p"))


def backward_induction(reward: DataFrame, moves: DataFrame, horizon: int, checkpoint_every: int = 5) -> DataFrame:
    """i, j, value, action at time 0: value = max over actions of the sum of p * (reward' + value'), 0 outside.

    One join and aggregate a step; lineage is cut with checkpoints. Of equal actions the first.
    """
    spark = reward.sparkSession
    shared_folder(spark)
    moves = moves.checkpoint()
    value = reward.select("i", "j", F.lit(0.0).alias("value"), F.lit(0).alias("action"))
    w = Window.partitionBy("i", "j").orderBy(F.desc("q"), "action")
    for k in range(horizon):
        ahead = value.join(reward, ["i", "j"]).select(F.col("i").alias("i2"), F.col("j").alias("j2"), (F.col("value") + F.col("reward")).alias("ahead"))
        q = moves.join(ahead, ["i2", "j2"], "left").groupBy("i", "j", "action").agg(F.sum(F.col("p") * F.when(F.col("out"), 0.0).otherwise(F.col("ahead"))).alias("q"))
        value = q.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("i", "j", F.col("q").alias("value"), "action")
        if (k + 1) % checkpoint_every == 0:
            value = value.checkpoint()
    return value


def induct(reward: np.ndarray, drift: np.ndarray, actor: np.ndarray, horizon: int, mode: str = "terminal") -> tuple[np.ndarray, np.ndarray]:
    """The same on arrays for a small grid: drift (n_x, n_y, 2 d + 1), actor (actions, 2 z + 1)."""
    value, best = np.zeros_like(reward), np.zeros(reward.shape, dtype=int)
    for _ in range(horizon):
        q = np.stack([_expected(value + reward, drift, actor[a], mode, 0.0) for a in range(actor.shape[0])])
        value, best = q.max(axis=0), q.argmax(axis=0)
    return value, best


def _expected(ahead: np.ndarray, drift: np.ndarray, actor: np.ndarray, mode: str, outside: float) -> np.ndarray:
    n_x, n_y = ahead.shape
    d, z = drift.shape[2] // 2, len(actor) // 2
    i, j = np.meshgrid(np.arange(n_x), np.arange(n_y), indexing="ij")
    out = np.zeros_like(ahead)
    for a in range(-d, d + 1):
        for b in range(-z, z + 1):
            p = drift[:, :, a + d] * actor[b + z]
            i2, j2 = i + a, j + b
            if mode == "periodic":
                i2, j2 = i2 % n_x, np.clip(j2, 0, n_y - 1)
            elif mode == "clip":
                i2, j2 = np.clip(i2, 0, n_x - 1), np.clip(j2, 0, n_y - 1)
            inside = (i2 >= 0) & (i2 < n_x) & (j2 >= 0) & (j2 < n_y)
            out += p * np.where(inside, ahead[np.clip(i2, 0, n_x - 1), np.clip(j2, 0, n_y - 1)], outside)
    return out


def shortest_costs(goals: DataFrame, drift: np.ndarray, actor: np.ndarray, radius: float, mode: str = "terminal", metric: str = "euclidean", sweeps: int = SWEEPS, tolerance: float = TOLERANCE, warm: dict | None = None) -> DataFrame:
    """gi, gj, i, j, cost, action, sweeps: expected steps to the vicinity of each goal, one group a goal.

    Leaving the grid costs n_x * n_y. In the vicinity the cost is 0 and the action stays (1).
    """
    n_x, n_y, _ = drift.shape

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        outs = []
        i, j = np.meshgrid(np.arange(1, n_x + 1), np.arange(1, n_y + 1), indexing="ij")
        for gi, gj in zip(pdf["gi"], pdf["gj"]):
            a, b = abs(i - gi), abs(j - gj)
            near = {"euclidean": np.hypot(a, b), "l1": a + b, "linf": np.maximum(a, b)}[metric] <= radius
            most = float(n_x * n_y)
            cost = np.where(near, 0.0, most) if warm is None else np.where(near, 0.0, warm[(int(gi), int(gj))])
            for k in range(sweeps):
                q = np.stack([1 + _expected(cost, drift, actor[x], mode, most) for x in range(actor.shape[0])])
                new = np.where(near, 0.0, np.minimum(q.min(axis=0), most))
                known = (new < SENTINEL * most) & ~near
                change = np.max(np.abs(new - cost)[known] / np.maximum(new[known], 1e-9)) if known.any() else 0.0
                settled = change < tolerance and bool(((cost < SENTINEL * most) == (new < SENTINEL * most)).all())
                cost = new
                if settled:
                    break
            outs.append(pd.DataFrame({"gi": gi, "gj": gj, "i": i.ravel(), "j": j.ravel(), "cost": cost.ravel(), "action": np.where(near, 1, q.argmin(axis=0)).ravel(), "sweeps": k + 1}))
        return pd.concat(outs)

    return goals.groupBy("gi", "gj").applyInPandas(one, "gi int, gj int, i int, j int, cost double, action int, sweeps int")


def matern52(a: np.ndarray, b: np.ndarray, sigma: float, length: float) -> np.ndarray:
    r = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)) * math.sqrt(5) / length
    return sigma**2 * (1 + r + r * r / 3) * np.exp(-r)


def gp_posterior(x: np.ndarray, y: np.ndarray, grid: np.ndarray, sigma: float = 1.0, length: float = 2.0, noise: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance on the grid of an exact process with few observations."""
    chol = np.linalg.cholesky(matern52(x, x, sigma, length) + noise**2 * np.eye(len(x)))
    ks = matern52(x, grid, sigma, length)
    alpha = np.linalg.solve(chol.T, np.linalg.solve(chol, y))
    v = np.linalg.solve(chol, ks)
    return ks.T @ alpha, np.maximum(sigma**2 - (v**2).sum(axis=0), 0.0)


def estimate(observed: DataFrame, n_x: int, n_y: int, **kernel: float) -> DataFrame:
    """i, j, mean, var on the grid; duplicates of observed (i, j, y) are averaged first, one row a cell at most."""
    pts = observed.groupBy("i", "j").agg(F.avg("y").alias("y")).orderBy("i", "j").collect()
    x, y = np.array([[r["i"], r["j"]] for r in pts], dtype=float), np.array([r["y"] for r in pts])
    g = np.array([[i, j] for i in range(1, n_x + 1) for j in range(1, n_y + 1)], dtype=float)
    m, v = gp_posterior(x, y, g, **kernel)
    return observed.sparkSession.createDataFrame([(int(a), int(b), float(p), float(q)) for (a, b), p, q in zip(g, m, v)], "i int, j int, mean double, var double")


def expected_improvement(posterior: DataFrame, best: float) -> DataFrame:
    """posterior with ei on |mean|; the normal's distribution function is a short Arrow function, as SQL has none."""
    @F.pandas_udf("double")
    def ei(mean: pd.Series, var: pd.Series) -> pd.Series:
        s = np.sqrt(np.maximum(var, 1e-12))
        z = (np.abs(mean) - best) / s
        cdf = z.map(lambda t: 0.5 * (1 + math.erf(t / math.sqrt(2))))
        return (np.abs(mean) - best) * cdf + s * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    return posterior.withColumn("ei", ei("mean", "var"))


def most_uncertain(posterior: DataFrame, b: int) -> DataFrame:
    """The b cells of largest variance; ties by cell."""
    return posterior.orderBy(F.desc("var"), "i", "j").limit(b)


def replay_add(buffer: Sequence, item, capacity: int) -> list:
    """A ring that keeps the last ``capacity`` items."""
    return [*buffer, item][-capacity:]
