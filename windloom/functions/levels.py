"""Hybrid model levels: half-level coefficients as a small DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# N, a (Pa), b of the half levels 47 to 67.
HALF_LEVELS = (
    (47, 4799.149414, 0.000000), (48, 5119.895020, 0.000000), (49, 5452.990723, 0.000000), (50, 5798.344727, 0.000000), (51, 6156.074219, 0.000000),
    (52, 6526.946777, 0.000000), (53, 6911.870605, 0.000000), (54, 7311.869141, 0.000000), (55, 7727.412109, 0.000007), (56, 8159.354004, 0.000024),
    (57, 8608.525391, 0.000059), (58, 9076.400391, 0.000112), (59, 9562.682617, 0.000199), (60, 10065.978516, 0.000340), (61, 10584.631836, 0.000562),
    (62, 11116.662109, 0.000890), (63, 11660.067383, 0.001353), (64, 12211.547852, 0.001992), (65, 12766.873047, 0.002857), (66, 13324.668945, 0.003971),
    (67, 13881.331055, 0.005378),
)
#: Surface pressure at which levels get a representative pressure, Pa.
STANDARD_SURFACE = 101325.0


def half_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HALF_LEVELS), "n int, a double, b double")


def half_levels_sql() -> str:
    return "(values " + ", ".join(f"({n}, cast({a} as double), cast({b} as double))" for n, a, b in HALF_LEVELS) + ") as half(n, a, b)"
