"""Small column expressions shared by the field operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finite(v: Column) -> Column:
    """True for numbers that are neither NULL, NaN nor infinite (Spark orders NaN above infinity)."""
    return F.coalesce(F.abs(v) < float("inf"), F.lit(False))


def finite_or_null(v: Column) -> Column:
    return F.when(F.abs(v) < float("inf"), v)


def clamp(v: Column, lo, hi) -> Column:
    return F.greatest(F.least(v, col(hi)), col(lo))


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def normalise_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def wrap_span(v: Column, half: float) -> Column:
    """v shifted by whole turns into the closed span [-half, half]; ties keep their side."""
    k = v / (2 * half)
    return v - 2 * half * F.signum(k) * F.greatest(F.lit(0.0), F.ceil(F.abs(k) - 0.5).cast("double"))


def snap(v: Column, a: float, b: float, eps: float = 1e-9) -> Column:
    """v moved onto the end of [a, b] when it is outside by at most eps."""
    lo, hi = min(a, b), max(a, b)
    return F.when((v < lo) & (v >= lo - eps), lo).when((v > hi) & (v <= hi + eps), hi).otherwise(v)


def round_half_away(v: Column) -> Column:
    """Rounding with ties away from zero, on doubles of any sign."""
    return F.signum(v) * F.floor(F.abs(v) + 0.5)
