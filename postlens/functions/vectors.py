"""Array-of-float expressions (V4-V7, P5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """A zero vector stays zero."""
    norm = l2_norm(v)
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def any_nonzero(v: Column) -> Column:
    """True if some element differs from 0; a missing element counts as different, a missing vector does not."""
    return F.coalesce(F.exists(v, lambda x: x.isNull() | (x != 0)), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """NULL when either vector is zero."""
    scale = l2_norm(a) * l2_norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def pool(vectors: Column, dim: int, how: str = "mean") -> Column:
    """V7 on an array of vectors: element-wise mean or max, no vectors give zeros; the result is not normalised."""
    usable = F.filter(vectors, lambda v: v.isNotNull())
    count = F.size(usable)
    first = F.transform(F.try_element_at(usable, F.lit(1)), lambda x: x.cast("double"))
    rest = F.slice(usable, 2, F.greatest(count, F.lit(1)))
    if how == "max":
        folded = F.aggregate(rest, first, lambda a, v: F.zip_with(a, v, lambda x, y: F.greatest(x, y.cast("double"))))
    else:
        total = F.aggregate(rest, first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
        folded = F.transform(total, lambda x: x / F.greatest(count, F.lit(1)))
    return F.when(F.coalesce(count, F.lit(0)) > 0, folded).otherwise(zeros(dim))


def pack(columns: Sequence[str]) -> Column:
    """V4: columns with a numeric suffix, in index order."""
    return F.array(*[F.col(c) for c in sorted(columns, key=lambda c: int(c.rsplit("_", 1)[1]))])


def expand(vector: str, prefix: str, dim: int) -> list[Column]:
    """V3: the columns of one projection."""
    return [F.col(vector)[i].alias(f"{prefix}{i}") for i in range(dim)]


def field_products(vectors: Sequence[str]) -> list[Column]:
    """Inner product of every pair of field vectors."""
    return [
        dot(F.col(a), F.col(b)).alias(f"{a}_x_{b}")
        for i, a in enumerate(vectors)
        for b in vectors[i + 1:]
    ]
