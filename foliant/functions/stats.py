"""Aggregates and array statistics whose definitions differ from the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_percentile(values: Column, p: float) -> Column:
    """Element floor(n p) of the sorted array, held to the last; null if empty."""
    s = F.array_sort(values)
    return F.when(F.size(s) == 0, None).otherwise(F.try_element_at(s, F.least(F.floor(F.size(s) * F.lit(p)) + 1, F.size(s)).cast("int")))


def mean(values: Column) -> Column:
    return F.when(F.size(values) == 0, 0.0).otherwise(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def without_outliers(values: Column) -> Column:
    """Values within 1.5 interquartile ranges of the floor-index quartiles; unchanged below 4 values or if under 2 would remain."""
    q1, q3 = floor_percentile(values, 0.25), floor_percentile(values, 0.75)
    kept = F.filter(values, lambda x: x.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    return F.when((F.size(values) < 4) | (F.size(kept) < 2), values).otherwise(kept)


def trimmed_mean(value: Column) -> Column:
    """Mean without one smallest and one largest, from three values on."""
    n = F.count(value)
    return F.when(n >= 3, (F.sum(value) - F.min(value) - F.max(value)) / (n - 2)).otherwise(F.avg(value))


def variation(value: Column) -> Column:
    """Sample standard deviation over the mean; 0 for fewer than two values or all zero, infinite at mean 0."""
    sd, m = F.coalesce(F.stddev_samp(value), F.lit(0.0)), F.avg(value)
    return F.when(m != 0, F.abs(sd / m)).when(sd == 0, 0.0).otherwise(float("inf"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence to base 2 of two distributions."""
    term = lambda x, m: F.when((x > 0) & (m > 0), x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda x, y: 0.5 * term(x, (x + y) / 2) + 0.5 * term(y, (x + y) / 2))
    return F.aggregate(both, F.lit(0.0), lambda s, t: s + t)


def circular_mean(degrees: Column) -> Column:
    return F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))))


def decay(a: Column, b: Column, scale: float) -> Column:
    return F.exp(-F.abs(a - b) / F.lit(scale))


def ratio(a: Column, b: Column) -> Column:
    """Smaller over larger; 1 if both are zero."""
    return F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b))
