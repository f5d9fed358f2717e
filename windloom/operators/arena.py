"""Grid arenas: actor, boundaries, rewards, rollouts. A rollout is one group an episode; fields and grids are columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windloom.functions.columns import clip, wrap_cell
from windloom.functions.noise import derive_seed


def grid(spark: SparkSession, n_x: int, n_y: int) -> DataFrame:
    """i, j from 1."""
    return spark.range(n_x * n_y).select((F.floor(F.col("id") / n_y) + 1).cast("int").alias("i"), (F.col("id") % n_y + 1).cast("int").alias("j"))


def distance(i: Column, j: Column, target: tuple[float, float], metric: str = "euclidean") -> Column:
    a, b = F.abs(i - target[0]), F.abs(j - target[1])
    return {"euclidean": F.sqrt(a * a + b * b), "l1": a + b, "linf": F.greatest(a, b)}[metric].cast("double")


def step_cost(i: Column, j: Column, target, radius: float, cost: float = 1.0, metric: str = "euclidean") -> Column:
    """0 inside the vicinity, -cost outside."""
    return F.when(distance(i, j, target, metric) <= radius, 0.0).otherwise(-cost)


def navigation_reward(i: Column, j: Column, target, peak: float = 10.0, cost: float = 0.1, scale: float = 0.1, metric: str = "euclidean") -> Column:
    """Never negative: the peak less the step's cost at the target, falling off with the inverse of distance."""
    if not 0 <= cost < peak or scale <= 0:
        raise ValueError("the peak must exceed the cost, which isn't negative, and the scale be positive")
    return (peak - cost) / (1.0 + scale * distance(i, j, target, metric))


def boundary(i: Column, n: int, mode: str) -> tuple[Column, Column]:
    """Position after the boundary, and whether it was left."""
    out = (i < 1) | (i > n)
    if mode == "clip":
        return clip(i, 1.0, float(n)), out
    if mode == "periodic":
        return wrap_cell(i, n), out
    return i, out


def validate_position(i: Column, j: Column, n_x: int, n_y: int, label: str) -> Column:
    ok = i.between(1, n_x) & j.between(1, n_y)
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{label} outside the grid: "), i.cast("string"), F.lit(", "), j.cast("string"))).cast("boolean"))


def controllable(action: Column, eps: Column, scale: float, most: float) -> Column:
    """Displacement of actions 0, 1, 2 with noise, within most."""
    return clip(scale * (action - 1) + eps, -most, most)


def clipped_gaussian(scale: float, noise: float, most: int) -> np.ndarray:
    """(3, 2 * most + 1): mass of each whole displacement for each action; tails go to the ends."""
    cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    out = np.zeros((3, 2 * most + 1))
    for a in range(3):
        mean = scale * (a - 1)
        if noise <= 0:
            out[a, int(max(-most, min(most, round(mean)))) + most] = 1.0
            continue
        edges = [-math.inf, *(z + 0.5 for z in range(-most, most)), math.inf]
        out[a] = [cdf((h - mean) / noise) - cdf((lo - mean) / noise) for lo, h in zip(edges, edges[1:])]
    return out


@dataclass
class Arena:
    """Ambient drift along i from a field grid (n_x, n_y), control along j. The agent sees ``seen`` (by default the field itself)."""

    field: np.ndarray
    scale: float = 1.0
    noise: float = 0.0
    most: float = 2.0
    mode: str = "terminal"
    target: tuple[float, float] = (8.0, 8.0)
    radius: float = 1.0
    process_noise: float = 0.0
    seen: np.ndarray | None = None
    seen_noise: float = 0.0

    def at(self, field: np.ndarray, i: float, j: float, noise: float, rng) -> float:
        """A drift at a place, with noise, within ``most``."""
        n_x, n_y = field.shape
        u = float(field[min(max(round(i), 1), n_x) - 1, min(max(round(j), 1), n_y) - 1])
        return min(max(u + (noise * rng.standard_normal() if noise else 0.0), -self.most), self.most)

    def step(self, i: float, j: float, action: int, rng) -> tuple[float, float, float, bool, bool]:
        """i, j, observed drift, left the grid, reached. True and observed drift are both read where the step begins."""
        n_x, n_y = self.field.shape
        drift = self.at(self.field, i, j, self.process_noise, rng)
        seen = self.at(self.field if self.seen is None else self.seen, i, j, self.seen_noise, rng)
        i2, j2 = i + drift, j + min(max(self.scale * (action - 1) + self.noise * rng.standard_normal(), -self.most), self.most)
        left = not (1 <= i2 <= n_x and 1 <= j2 <= n_y)
        if self.mode == "clip":
            i2, j2 = min(max(i2, 1.0), float(n_x)), min(max(j2, 1.0), float(n_y))
        elif self.mode == "periodic":
            i2, j2, left = (i2 - 1) % n_x + 1, min(max(j2, 1.0), float(n_y)), False
        reached = math.hypot(i2 - self.target[0], j2 - self.target[1]) <= self.radius
        return i2, j2, seen, left, reached


Policy = Callable[[float, float, int, np.random.Generator], int]


def random_policy(i, j, step, rng) -> int:
    return int(rng.integers(0, 3))


def greedy_policy(target: tuple[float, float]) -> Policy:
    return lambda i, j, step, rng: 1 + int(np.sign(round(target[1] - j)))


def rollouts(episodes: DataFrame, arena: Arena, policy: Policy = random_policy, horizon: int = 50, start: tuple[float, float] = (2.0, 2.0), keys: Sequence[str] = ("run", "episode"), seed: str = "seed") -> DataFrame:
    """keys, step, i, j, action, drift, reward, terminated, truncated, reached, total: one row a step, in one task an episode."""
    kinds = dict(episodes.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.to_dict("records"):
            rng, (i, j), total, reached = np.random.default_rng(int(r[seed])), start, 0.0, False
            for k in range(horizon):
                a = policy(i, j, k, rng)
                i, j, drift, left, hit = arena.step(i, j, a, rng)
                reached = reached or hit
                reward = 0.0 if hit else -1.0
                total += reward
                end = left and arena.mode == "terminal"
                out.append([*(r[c] for c in keys), k, i, j, a, drift, reward, end, k == horizon - 1 and not end, reached, total])
                if end:
                    break
        return pd.DataFrame(out, columns=[*keys, "step", "i", "j", "action", "drift", "reward", "terminated", "truncated", "reached", "total"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "step int, i double, j double, action int, drift double, reward double, terminated boolean, truncated boolean, reached boolean, total double"])
    return episodes.groupBy(*keys).applyInPandas(one, schema)


def episodes(spark: SparkSession, runs: Sequence[str], count: int, master: int = 0, evaluation: bool = True) -> DataFrame:
    """run, episode, seed; evaluation seeds are derived from the master plus a million."""
    offset = 1_000_000 if evaluation else 0
    return spark.createDataFrame([(r, e, derive_seed(master + offset, e)) for r in runs for e in range(count)], "run string, episode int, seed long")


def summarise(steps: DataFrame, keys: Sequence[str] = ("run", "episode")) -> DataFrame:
    """One row an episode: reward, length, terminated, reached."""
    return steps.groupBy(*keys).agg(F.sum("reward").alias("reward"), F.count("*").alias("length"), F.max("terminated").alias("terminated"), F.max("reached").alias("reached"))


def latched(steps: DataFrame, keys: Sequence[str], hit: str) -> DataFrame:
    """steps with reached so far and reward so far."""
    w = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumns({"reached_so_far": F.max(hit).over(w), "reward_so_far": F.sum("reward").over(w)})


def segment_counters(steps: DataFrame, run: Sequence[str], segment: str = "segment") -> DataFrame:
    """Steps and rewards so far in the run and in its segment."""
    a = Window.partitionBy(*run).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    b = Window.partitionBy(*run, segment).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumns({"run_steps": F.count("*").over(a), "segment_steps": F.count("*").over(b), "run_reward": F.sum("reward").over(a), "segment_reward": F.sum("reward").over(b)})


def drift(spark: SparkSession, u: float, start: float, n: int, steps: int) -> DataFrame:
    """Passive drift of one particle by a recursive query, periodic."""
    return spark.sql(f"with recursive d(step, i) as (select 0, cast({start} as double) union all select step + 1, pmod(i - 1 + {u}, {n}D) + 1 from d where step < {steps}) select step, i from d")
