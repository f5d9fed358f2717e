"""Training crops, pairs and blocks as index tables joined to cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.functions.noise import uniform


def crop_index(spark: SparkSession, n: int, frames: int, ny: int, nx: int, size: int, seed: int = 0, augment: bool = True) -> DataFrame:
    """idx, t0, y0, x0, flip_x, flip_y: each a pure function of (seed, idx)."""
    draw = lambda stream, m: F.floor(uniform(F.lit(seed), F.col("id"), stream=stream) * m).cast("int")
    flip = lambda stream: (uniform(F.lit(seed), F.col("id"), stream=stream) < 0.5) if augment else F.lit(False)
    return spark.range(n).select(F.col("id").alias("idx"), draw(1, frames).alias("t0"), draw(2, ny - size + 1).alias("y0"), draw(3, nx - size + 1).alias("x0"), flip(4).alias("flip_x"), flip(5).alias("flip_y"))


def crops(cells: DataFrame, index: DataFrame, size: int, frame: str = "t") -> DataFrame:
    """idx, level, y, x (in the crop), u, v: mirrored crops change the sign of the component across the mirror."""
    j = index.join(cells, index["t0"] == cells[frame]).where(F.col("y").between(F.col("y0"), F.col("y0") + size - 1) & F.col("x").between(F.col("x0"), F.col("x0") + size - 1))
    y, x = F.col("y") - F.col("y0"), F.col("x") - F.col("x0")
    return j.select("idx", "level", F.when(F.col("flip_y"), size - 1 - y).otherwise(y).alias("y"), F.when(F.col("flip_x"), size - 1 - x).otherwise(x).alias("x"), F.when(F.col("flip_x"), -F.col("u")).otherwise(F.col("u")).alias("u"), F.when(F.col("flip_y"), -F.col("v")).otherwise(F.col("v")).alias("v"))


def channels(crop_cells: DataFrame) -> DataFrame:
    """idx, channel (2l is u, 2l + 1 is v), y, x, value."""
    return crop_cells.select("idx", F.explode(F.array(F.struct((2 * F.col("level")).alias("channel"), F.col("u").alias("value")), F.struct((2 * F.col("level") + 1).alias("channel"), F.col("v").alias("value")))).alias("c"), "y", "x").select("idx", "c.channel", "y", "x", "c.value")


def from_channels(crop_channels: DataFrame) -> DataFrame:
    return crop_channels.groupBy("idx", F.floor(F.col("channel") / 2).cast("int").alias("level"), "y", "x").agg(F.max(F.when(F.col("channel") % 2 == 0, F.col("value"))).alias("u"), F.max(F.when(F.col("channel") % 2 == 1, F.col("value"))).alias("v"))
