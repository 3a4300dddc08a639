"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def finite(a: Column) -> Column:
    return a.isNotNull() & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def normalized(a: Column, strict: bool = True) -> Column:
    """All components at unit length. Strict: null if one is not finite or the length is tiny; else what the division gives, NaN over
    a length of 0."""
    over = lambda n: F.transform(a, lambda x: F.when(n == 0, float("nan")).otherwise(F.try_divide(x.cast("double"), n)))
    unit = F.get(F.transform(F.array(norm(a)), over), F.lit(0))  # the length is taken once, not for each component
    return F.when(finite(a) & (norm(a) > SMALL), unit) if strict else unit


def rounded(x: Column, places: int) -> Column:
    """A double's nearest multiple of 10 to the power -places, halves away from zero. As in IEEE arithmetic, what is rounded to zero
    keeps its sign, and the scaled number is rounded, not its decimal text. Its magnitude is below 2 to the power 53 when scaled."""
    scaled = F.abs(x) * 10.0**places
    low = F.floor(scaled)
    near = F.signum(x) * (low + F.when(scaled - low >= 0.5, 1).otherwise(0)).cast("double") / 10.0**places
    return F.when(F.isnan(x) | (scaled >= 2.0**53), x).otherwise(near)


def cosine(a: Column, b: Column) -> Column:
    """Null for different lengths, zero vectors or components that are not finite."""
    ok = (F.size(a) == F.size(b)) & finite(a) & finite(b) & (norm(a) > SMALL) & (norm(b) > SMALL)
    return F.when(ok, dot(a, b) / (norm(a) * norm(b)))
