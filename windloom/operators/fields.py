"""Flow fields for navigation as column factories: velocity at (i, j, k, t) as expressions that Catalyst folds."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FlowField:
    """velocity(i, j, k, t) gives (u, v) columns; v is None in two dimensions. reset(seed) fixes what is random."""

    def reset(self, seed: int) -> FlowField:
        return self

    def velocity(self, i: Column, j: Column, k: Column | None = None, t: Column | None = None) -> tuple[Column, Column | None]:
        raise NotImplementedError

    def __add__(self, other: FlowField) -> FlowField:
        return SumField(self, other)

    def __mul__(self, by: float) -> FlowField:
        return ScaledField(self, by)

    __rmul__ = __mul__


@dataclass
class ConstantField(FlowField):
    u: float = 0.0
    v: float | None = None

    def velocity(self, i, j, k=None, t=None):
        return F.lit(float(self.u)), None if self.v is None else F.lit(float(self.v))


class ZeroField(ConstantField):
    pass


@dataclass
class RandomDriftField(FlowField):
    """One drift an episode, uniform in [-most, most]."""

    most: float
    planar: bool = False
    seed: int = 0

    def reset(self, seed):
        return RandomDriftField(self.most, self.planar, seed)

    def velocity(self, i, j, k=None, t=None):
        u, v = np.random.default_rng(self.seed).uniform(-self.most, self.most, 2)
        return F.lit(float(u)), F.lit(float(v)) if self.planar else None


@dataclass
class SumField(FlowField):
    a: FlowField
    b: FlowField

    def reset(self, seed):
        return SumField(*reset_once((self.a, self.b), seed))

    def velocity(self, i, j, k=None, t=None):
        (u1, v1), (u2, v2) = self.a.velocity(i, j, k, t), self.b.velocity(i, j, k, t)
        return u1 + u2, v1 if v2 is None else v2 if v1 is None else v1 + v2


@dataclass
class ScaledField(FlowField):
    a: FlowField
    by: float

    def reset(self, seed):
        return ScaledField(self.a.reset(seed), self.by)

    def velocity(self, i, j, k=None, t=None):
        u, v = self.a.velocity(i, j, k, t)
        return u * self.by, None if v is None else v * self.by


def reset_once(fields: tuple[FlowField, ...], seed: int) -> list[FlowField]:
    """Each leaf once, so that a field that stands in several places stays the same."""
    done: dict[int, FlowField] = {}
    return [done.setdefault(id(f), f.reset(seed)) for f in fields]


def leaves(*roots: FlowField) -> list[FlowField]:
    """Different leaf fields of a tree, in order."""
    out: dict[int, FlowField] = {}
    todo = list(roots)
    while todo:
        f = todo.pop(0)
        parts = [getattr(f, n) for n in ("a", "b") if isinstance(getattr(f, n, None), FlowField)]
        todo = parts + todo
        if not parts:
            out.setdefault(id(f), f)
    return list(out.values())


@dataclass
class RandomFeatureField(FlowField):
    """A Gaussian process by random Fourier features, Matern of the given smoothness.

    Two dimensions: a scalar u. Planar: a stream function psi with u = d psi / dj, v = -d psi / di, free of divergence.
    """

    sigma: float = 1.0
    lengthscale: float = 1.0
    nu: float = 2.5
    features: int = 64
    planar: bool = False
    time_scale: float | None = None
    seed: int = 0

    def reset(self, seed):
        return RandomFeatureField(self.sigma, self.lengthscale, self.nu, self.features, self.planar, self.time_scale, seed)

    def parameters(self) -> np.ndarray:
        """omega_i, omega_j, omega_t, phase, weight for each feature. Student-t frequencies give the Matern."""
        rng = np.random.default_rng(self.seed)
        g = rng.standard_normal((self.features, 2)) / np.sqrt(rng.chisquare(2 * self.nu, (self.features, 1)) / (2 * self.nu)) / self.lengthscale
        wt = rng.standard_normal(self.features) / self.time_scale if self.time_scale else np.zeros(self.features)
        return np.column_stack([g, wt, rng.uniform(0, 2 * math.pi, self.features), rng.standard_normal(self.features) * self.sigma * math.sqrt(2 / self.features)])

    def velocity(self, i, j, k=None, t=None):
        rows = F.array(*[F.struct(*(F.lit(float(x)).alias(n) for n, x in zip("abtpw", r))) for r in self.parameters()])
        phase = lambda f: f["a"] * i + f["b"] * j + f["t"] * (t if t is not None else F.lit(0.0)) + f["p"]
        total = lambda g: F.aggregate(F.transform(rows, g), F.lit(0.0), lambda s, x: s + x)
        if not self.planar:
            return total(lambda f: f["w"] * F.cos(phase(f))), None
        return total(lambda f: -f["w"] * f["b"] * F.sin(phase(f)) * self.lengthscale), total(lambda f: f["w"] * f["a"] * F.sin(phase(f)) * self.lengthscale)


class FittedField(FlowField):
    """Bayesian linear regression on random features: the Gram matrix is an aggregate, the small solve is the driver's."""

    def __init__(self, base: RandomFeatureField, noise: float = 0.1):
        self.base, self.noise, self.weights = base, noise, np.zeros(base.features)

    def _phi(self, i: Column, j: Column) -> Column:
        p = self.base.parameters()
        scale = math.sqrt(2 / self.base.features)
        return F.transform(F.array(*[F.struct(F.lit(float(r[0])).alias("a"), F.lit(float(r[1])).alias("b"), F.lit(float(r[3])).alias("p")) for r in p]), lambda f: scale * F.cos(f["a"] * i + f["b"] * j + f["p"]))

    def fit(self, observed: DataFrame) -> FittedField:
        """observed: i, j, u. Sums of phi * phi' over rows; features squared numbers come to the driver."""
        n = self.base.features
        rows = observed.select(self._phi(F.col("i"), F.col("j")).alias("f"), "u")
        pairs = rows.select("f", "u", F.posexplode("f").alias("a", "fa")).select("a", F.posexplode(F.concat("f", F.array("u"))).alias("b", "fb"), "fa")
        got = pairs.groupBy("a", "b").agg(F.sum(F.col("fa") * F.col("fb")).alias("s")).collect()
        m = np.zeros((n, n + 1))
        for r in got:
            m[r["a"], r["b"]] = r["s"]
        self.weights = np.linalg.solve(m[:, :n] + self.noise**2 * np.eye(n), m[:, n])
        return self

    def velocity(self, i, j, k=None, t=None):
        w = F.array(*[F.lit(float(x)) for x in self.weights])
        return F.aggregate(F.zip_with(self._phi(i, j), w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), None
