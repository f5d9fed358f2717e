"""Column expressions on gridded fields: physics, coordinates, time features, normalisation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gas constant of dry air, gravity, humidity factor, metres in a degree.
R_DRY, GRAVITY, HUMIDITY, DEGREE_M = 287.05, 9.80665, 0.61, 111320.0


def speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def virtual_temperature(t: Column, q: Column) -> Column:
    return t * (1 + HUMIDITY * q)


def surface_pressure(lnsp: Column) -> Column:
    return F.exp(lnsp).cast("float")


def wind_from(speed_: Column, degrees: Column) -> tuple[Column, Column]:
    """u, v of a wind given by speed and the direction it comes from; missing speed is calm."""
    s = F.coalesce(F.nanvl(speed_, F.lit(0.0)), F.lit(0.0))
    return -s * F.sin(F.radians(degrees)), -s * F.cos(F.radians(degrees))


def time_features(ts: Column) -> dict[str, Column]:
    """Sines and cosines of the annual, semi-annual and daily phase."""
    stamp = ts.cast("timestamp")
    day = (F.unix_micros(stamp) - F.unix_micros(F.date_trunc("year", stamp))) / 86400e6
    hour = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    year, half, daily = 2 * math.pi * day / 365.25, 4 * math.pi * day / 365.25, 2 * math.pi * hour / 24.0
    return {"sin_year": F.sin(year), "cos_year": F.cos(year), "sin_half": F.sin(half), "cos_half": F.cos(half), "sin_day": F.sin(daily), "cos_day": F.cos(daily)}


def wrap_longitude(lon: Column, lon0: float) -> Column:
    return F.when(lon - lon0 > 180, lon - 360).when(lon - lon0 < -180, lon + 360).otherwise(lon)


def grid_time(t: Column, origin: str, hours: int = 1) -> Column:
    return F.timestamp_add("HOUR", (t * hours).cast("int"), F.lit(origin).cast("timestamp_ntz"))


def tangent_axis(i: Column, n: int, centre: float, spacing_km: float, latitude: float | None = None) -> Column:
    """Degrees of point i of n around a centre; for longitude give the latitude."""
    per_degree = DEGREE_M / 1000 * (math.cos(math.radians(latitude)) if latitude is not None else 1.0)
    return F.lit(centre) + (i - (n - 1) / 2) * (spacing_km / per_degree)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def wrap_cell(i: Column, n: int) -> Column:
    """Periodic position on [1, n]."""
    return F.pmod(i - 1, F.lit(float(n))) + 1


def whole_displacement(u: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.bround(u, 0).cast("int")
