"""Vector algebra on array<double> columns, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def vector(*columns: str | Column) -> Column:
    """An array<double> of scalar columns."""
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sqdist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def axpy(alpha: Column, x: Column, y: Column) -> Column:
    """alpha * x + y."""
    return F.zip_with(x, y, lambda u, v: alpha * u + v)


def logsumexp(z: Column) -> Column:
    """ln of the sum of exponentials, shifted by the largest entry."""
    return let(F.array_max(z), lambda m: m + F.log(total(F.transform(z, lambda v: F.exp(v - m)))))


def softmax(z: Column) -> Column:
    # the largest entry and the sum are bound, not evaluated again for each entry
    powers = let(z, lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
    return let(powers, lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))


def argmax(z: Column) -> Column:
    """The first index of the largest entry, from 0."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def argmin(z: Column) -> Column:
    """The first index of the smallest entry, from 0."""
    return (F.array_position(z, F.array_min(z)) - 1).cast("int")


def one_hot(index: Column, size: int, low: float = 0.0, high: float = 1.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == index, F.lit(high)).otherwise(F.lit(low)))


def linspace(low: float, high: float, n: int) -> list[float]:
    """n points from low to high, both included."""
    return [low + (high - low) * k / (n - 1) for k in range(n)] if n > 1 else [low]
