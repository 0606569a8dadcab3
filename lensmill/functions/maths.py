"""Scores, distances and back-off, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def rounded(c: Column, digits: int) -> Column:
    """To so many digits, half away from zero by the binary value, as SQL engines round; round() goes by the decimal text."""
    return F.round(c * F.lit(10.0**digits)) / F.lit(10.0**digits)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def log_density(d: Column) -> Column:
    """ln(1 + d) / ln 11, from 0 to 1."""
    return clamp(F.log(1 + d) / F.log(F.lit(11.0)), 0.0, 1.0)


def age_factor(days: Column) -> Column:
    """1 - exp(-days / 30): older counts more."""
    return 1 - F.exp(-F.greatest(days, F.lit(0)) / 30.0)


def size_factor(n: Column) -> Column:
    return 1 - F.exp(-n / 10.0)


def backoff(attempt: Column, base: int, cap: int, most_shift: int = 20) -> Column:
    """base * 2^attempt, at most cap."""
    return F.least(F.lit(base).cast("long") * F.pow(F.lit(2.0), F.least(attempt, F.lit(most_shift))).cast("long"), F.lit(cap).cast("long"))


def box_area(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(right - left, zero) * F.greatest(bottom - top, zero)


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union of two boxes (left, top, right, bottom); 0 for empty ones."""
    both = box_area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = box_area(*a) + box_area(*b) - both
    return F.when(union > 0, both / union).otherwise(0.0)
