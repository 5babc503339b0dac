"""Arithmetic on arrays of numbers, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_FRAMES = 999.0
FAILED_NORM = 1e-8


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit vector; one too short to have a direction stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 1e-12, x.cast("double") / n).otherwise(x.cast("double")))


def failed(v: Column) -> Column:
    """An embedding that was never computed: its norm is next to nothing."""
    return norm(v) <= FAILED_NORM


def mean_min_distance(a: Column, b: Column) -> Column:
    """Mean over the frames of one side of the distance to the nearest of the other, averaged both ways."""

    def one_way(xs: Column, ys: Column) -> Column:
        nearest = F.transform(xs, lambda x: F.array_min(F.transform(ys, lambda y: F.bit_count(x.bitwiseXOR(y)))))
        return total(nearest) / F.size(xs)

    some = (F.size(F.coalesce(a, F.array().cast("array<bigint>"))) > 0) & (F.size(F.coalesce(b, F.array().cast("array<bigint>"))) > 0)
    return F.when(some, (one_way(a, b) + one_way(b, a)) / 2.0).otherwise(F.lit(NO_FRAMES))
