"""Alignment of axes, keys and grids: tolerant joins, intersections, interval joins, interpolation, regridding."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(source: DataFrame, target: DataFrame, tolerance: float = 1e-6, circular: bool = False) -> DataFrame:
    """source_idx, target_idx of axis points (idx, c) within the tolerance, by a join on cells of that size.

    A target point without a partner is an error on reading ``source_idx`` (null here): see require_all.
    """
    period = 360.0 if circular else None
    cell = max(tolerance, 1e-9) * 2

    def keyed(df: DataFrame) -> DataFrame:
        c = F.pmod("c", F.lit(period)) if circular else F.col("c")
        return df.withColumn("_c", c).withColumn("_k", F.floor(F.col("_c") / cell))

    a = keyed(source).select(F.col("idx").alias("source_idx"), F.col("_c").alias("_a"), F.explode(F.array(F.col("_k") - 1, F.col("_k"), F.col("_k") + 1)).alias("_k"))
    if circular:
        n = math.ceil(period / cell)
        a = a.withColumn("_k", F.pmod("_k", F.lit(n)))
    b = keyed(target).select(F.col("idx").alias("target_idx"), F.col("_c").alias("_b"), "_k")
    d = F.abs(F.col("_a") - F.col("_b"))
    d = F.least(d, F.lit(period) - d) if circular else d
    close = b.join(a, "_k").withColumn("_d", d).where(F.col("_d") <= tolerance)
    best = close.groupBy("target_idx").agg(F.min(F.struct("_d", "source_idx")).alias("m")).select("target_idx", F.col("m.source_idx").alias("source_idx"))
    return target.select(F.col("idx").alias("target_idx")).join(best, "target_idx", "left")


def require_all(df: DataFrame, column: str, message: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit(message))).otherwise(F.col(column)))


def common_axis(axes: Sequence[DataFrame], least: int = 0, digits: int = 6) -> DataFrame:
    """c: points that all axes have, rounded; an error if fewer than ``least``."""
    out = axes[0].select(F.bround("c", digits).alias("c")).distinct()
    for a in axes[1:]:
        out = out.intersect(a.select(F.bround("c", digits).alias("c")))
    if least and out.count() < least:
        raise ValueError(f"fewer than {least} common points")
    return out


def common_keys(runs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    out = runs[0].select(*keys).distinct()
    for r in runs[1:]:
        out = out.intersect(r.select(*keys))
    return out


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """side (missing, extra) and keys on which the sets differ."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, list(keys), "left_anti").select(F.lit("missing").alias("side"), *keys).unionByName(y.join(x, list(keys), "left_anti").select(F.lit("extra").alias("side"), *keys))


def require_same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    shown = key_differences(a, b, keys).orderBy("side", *keys).limit(3).collect()
    if shown:
        raise ValueError("condition set differs: " + "; ".join(str(r.asDict()) for r in shown))


def at_times(reference: DataFrame, wanted: DataFrame, time: str = "time") -> DataFrame:
    """Reference rows of the wanted hours."""
    hour = F.date_trunc("hour", F.col(time)).cast("timestamp_ntz")
    return reference.withColumn("_h", hour).join(wanted.select(hour.alias("_h")).distinct(), "_h", "left_semi").drop("_h")


def missing_times(reference: DataFrame, wanted: DataFrame, time: str = "time") -> DataFrame:
    hour = F.date_trunc("hour", F.col(time)).cast("timestamp_ntz")
    return wanted.select(hour.alias("hour")).distinct().join(reference.select(hour.alias("hour")), "hour", "left_anti")


def covering_charts(queries: DataFrame, core: int, halo: int) -> DataFrame:
    """queries (start, stop) with each chart whose core and halo meet them; charts are named by number, not joined."""
    first = F.floor((F.col("start") - halo) / core).cast("long")
    last = (F.ceil((F.col("stop") + halo) / core) - 1).cast("long")
    return queries.withColumn("chart", F.explode(F.sequence(first, last))).where((F.col("chart") * core - halo < F.col("stop")) & ((F.col("chart") + 1) * core + halo > F.col("start")))


def newest_containing(points: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Each point (id, t) with the latest chunk (t0, t1) that contains it, an as-of join on blocks of ``width``.

    Half-open, less one step at the end so that a point can be interpolated.
    """
    p = points.withColumn("_b", F.floor(F.col("t") / width))
    c = chunks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("t0") / width), F.floor(F.col("t1") / width))))
    hit = p.join(c, "_b").where("t >= t0 and t < t1 - 1")
    return hit.groupBy("id", "t").agg(F.max("t0").alias("t0"))


def lerp_on(targets: DataFrame, table: DataFrame, keys: Sequence[str] = (), clamp: bool = True) -> DataFrame:
    """keys, x, y: a table (keys, x, y) interpolated linearly at targets (x, or keys and x), clamped or null outside.

    The table's brackets are met by their place in order, after a window within each key.
    """
    w = Window.partitionBy(*keys).orderBy("x")
    br = table.select(*keys, F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.lag("x").over(w).alias("_before"))
    own = [k for k in keys if k in targets.columns]
    t = targets.select(*own, F.col("x").alias("xt"))
    joined = t.join(br, own) if own else t.crossJoin(br) if not keys else t.crossJoin(br)
    inside = (F.col("xt") >= F.col("x0")) & (F.col("x1").isNull() & (F.col("xt") == F.col("x0")) | (F.col("xt") < F.col("x1")))
    below = F.col("_before").isNull() & (F.col("xt") < F.col("x0"))
    above = F.col("x1").isNull() & (F.col("xt") > F.col("x0"))
    hit = joined.where(inside | below | above)
    y = F.when(inside & F.col("x1").isNotNull(), F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("xt") - F.col("x0")) / (F.col("x1") - F.col("x0"))).when(inside, F.col("y0")).otherwise(F.col("y0") if clamp else F.lit(None).cast("double"))
    return hit.select(*keys, F.col("xt").alias("x"), y.alias("y"))


def vertical(columns: DataFrame, targets: Sequence[float], keys: Sequence[str], pressure: str = "p", values: Sequence[str] = ("u", "v")) -> DataFrame:
    """Each column of cells interpolated in pressure to the targets; a target outside a column's range is an error."""
    w = Window.partitionBy(*keys).orderBy(pressure)
    br = columns.select(*keys, F.col(pressure).alias("p0"), F.lead(pressure).over(w).alias("p1"), F.min(pressure).over(Window.partitionBy(*keys)).alias("_lo"), F.max(pressure).over(Window.partitionBy(*keys)).alias("_hi"), *values, *(F.lead(v).over(w).alias(f"{v}1") for v in values))
    lo, hi = min(targets), max(targets)
    br = br.withColumn("p0", F.when((F.col("_lo") > lo) | (F.col("_hi") < hi), F.raise_error(F.lit("target pressure outside the column"))).otherwise(F.col("p0")))
    at = br.withColumn("pressure", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    hit = at.where("(pressure >= p0 and pressure < p1) or (p1 is null and pressure = p0)")
    frac = F.when(F.col("p1").isNull(), 0.0).otherwise((F.col("pressure") - F.col("p0")) / (F.col("p1") - F.col("p0")))
    return hit.select(*keys, "pressure", *((F.col(v) + frac * (F.coalesce(f"{v}1", v) - F.col(v))).alias(v) for v in values))


def smooth(cells: DataFrame, keys: Sequence[str], sigma: float, values: Sequence[str] = ("u", "v")) -> DataFrame:
    """Separable Gaussian blur (radius ceil(3 sigma)) with zeros outside: each cell sends its weighted share to its neighbours."""
    r = math.ceil(3 * sigma)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    offsets = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(w / sum(raw)).alias("w")) for i, w in zip(range(-r, r + 1), raw)])
    for axis, other in (("y", "x"), ("x", "y")):
        ends = cells.agg(F.min(axis), F.max(axis)).first()
        sent = cells.withColumn("_k", F.explode(offsets)).select(*keys, (F.col(axis) + F.col("_k.o")).alias(axis), other, *((F.col(v) * F.col("_k.w")).alias(v) for v in values))
        cells = sent.where(F.col(axis).between(ends[0], ends[1])).groupBy(*keys, axis, other).agg(*(F.sum(v).alias(v) for v in values))
    return cells


def bracket(target: Column, n: int) -> tuple[Column, Column]:
    """Whole part and fraction of a position on 0..n-1, clamped a little before the end."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(n - 1.001), target))
    return F.floor(p), p - F.floor(p)


def bilinear(points: DataFrame, planes: DataFrame, keys: Sequence[str], ny: int, nx: int, values: Sequence[str] = ("u", "v")) -> DataFrame:
    """points (keys, yp, xp) with values sampled from planes (arrays, row-major): four array look-ups, no join of cells."""
    j, fy = bracket(F.col("yp"), ny)
    i, fx = bracket(F.col("xp"), nx)
    joined = points.join(planes.select(*keys, *(F.col(v).alias(f"_{v}") for v in values)), list(keys))

    def sample(v: str) -> Column:
        at = lambda dj, di: F.element_at(F.col(f"_{v}"), ((j + dj) * nx + i + di + 1).cast("int"))
        return (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))

    return joined.select(*points.columns, *(sample(v).alias(v) for v in values))


def multilinear(points: DataFrame, grid: DataFrame, shape: Sequence[int], values: Sequence[str] = ("u",)) -> DataFrame:
    """points (id, i, j[, k], s) sampled from a grid table (t, i, j[, k], values) with 1-indexed axes.

    Linear beyond the edges (the border cell's slope goes on); time s is clamped to the table.
    """
    axes = ["i", "j", "k"][: len(shape) - 1]
    t_max = shape[0] - 1
    s = F.greatest(F.lit(0.0), F.least(F.lit(float(t_max)), F.col("s")))
    t0 = F.least(F.floor(s), F.lit(max(t_max - 1, 0)))
    corner = points.select("id", F.explode(F.array(*[F.struct((t0 + d).cast("int").alias("t"), (1 - (s - t0) if d == 0 else s - t0).alias("w")) for d in range(2 if t_max else 1)])).alias("c"), *axes).select("id", "c.t", F.col("c.w").alias("w"), *axes)
    for a, n in zip(axes, shape[1:]):
        lo = F.greatest(F.lit(1), F.least(F.lit(n - 1), F.floor(a)))
        corner = corner.withColumn("_c", F.explode(F.array(F.struct(lo.cast("int").alias("at"), (1 - (F.col(a) - lo)).alias("f")), F.struct((lo + 1).cast("int").alias("at"), (F.col(a) - lo).alias("f"))))).withColumn("w", F.col("w") * F.col("_c.f")).withColumn(a, F.col("_c.at")).drop("_c")
    return corner.join(grid, ["t", *axes]).groupBy("id").agg(*(F.sum(F.col("w") * F.col(v)).alias(v) for v in values))


def regrid(cells: DataFrame, keys: Sequence[str], shape: tuple[int, int], target: tuple[int, int], ratio: float | None = None) -> DataFrame:
    """Planes of cells resampled to ``target`` points over the same extent; blurred first if that is coarser (sigma half the ratio)."""
    (ny, nx), (my, mx) = shape, target
    ratio = ratio if ratio is not None else max(ny / my, nx / mx)
    if ratio > 1:
        cells = smooth(cells, keys, 0.5 * ratio)
    for axis, other, n, m in (("y", "x", ny, my), ("x", "y", nx, mx)):
        scale = (n - 1) / (m - 1)
        spots = cells.sparkSession.range(m).select(F.col("id").cast("int").alias("_to"), (F.col("id") * scale).alias("_p"))
        lo = F.least(F.lit(n - 2), F.floor("_p"))
        parts = spots.select("_to", F.explode(F.array(F.struct(lo.cast("int").alias("at"), (1 - (F.col("_p") - lo)).alias("w")), F.struct((lo + 1).cast("int").alias("at"), (F.col("_p") - lo).alias("w")))).alias("c")).select("_to", F.col("c.at").alias(axis), "c.w")
        cells = cells.join(F.broadcast(parts), axis).groupBy(*keys, F.col("_to").alias(axis), other).agg(F.sum(F.col("u") * F.col("w")).alias("u"), F.sum(F.col("v") * F.col("w")).alias("v"))
    return cells
