"""Vectors as columns, in native higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def as_doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine; 0 if either vector has length 0, null if their dimensions differ. Norms may be given."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(F.size(a) == F.size(b), F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0)))


def truncate_renormalize(c: Column, dimensions: int) -> Column:
    """The first ``dimensions`` components at length 1 (length clipped at 1e-12); an error if there are fewer."""
    head = F.slice(as_doubles(c), 1, dimensions)
    scaled = F.transform(head, lambda x: x / F.greatest(norm(head), F.lit(1e-12)))
    wrong = F.raise_error(F.lit(f"fewer than {dimensions} dimensions")).cast("array<double>")
    return F.when(F.size(c) < dimensions, wrong).otherwise(scaled)
