"""Longitude conventions, area weights and unit factors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors that turn a model unit into the reported one (fixed values).
UNIT_FACTORS = {
    "transport": 4.26,
    "transport_divergence_m_per_year": 4.26 / 111000**2 * 86400 * 365,
    "hundredth": 0.01,
}


def wrap_longitude(lon: Column, strict: bool = False) -> Column:
    """0..360 to -180..180; ``strict`` keeps exactly 180 where it is."""
    beyond = lon > 180 if strict else lon >= 180
    return F.when(beyond, lon - 360).otherwise(lon)


def recentre_longitude(lon: Column) -> Column:
    """-180..180 re-centred on the date line."""
    return F.when(lon <= 0, lon + 180).otherwise(lon - 180)


def shift_longitude(lon: Column, degrees: float = -180.0) -> Column:
    return lon + F.lit(float(degrees))


def area_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def scale(value: Column, unit: str) -> Column:
    return value * F.lit(UNIT_FACTORS[unit])


def polynomial(coefs: list[Column], x: Column) -> Column:
    """Horner evaluation; ``coefs`` from the constant term upwards."""
    out = coefs[-1]
    for c in reversed(coefs[:-1]):
        out = out * x + c
    return out


def gaussian_weights(m: int) -> list[float]:
    """Normal density at ``m`` even steps over [-2, 2], scaled to sum 1."""
    if m == 1:
        return [1.0]
    raw = [math.exp(-0.5 * (-2 + 4 * i / (m - 1)) ** 2) for i in range(m)]
    total = sum(raw)
    return [w / total for w in raw]
