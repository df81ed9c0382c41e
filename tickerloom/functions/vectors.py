"""Array arithmetic that stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tickerloom.functions.numbers import col


def as_doubles(c: Column | str) -> Column:
    return col(c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), size))


def zero_vector(n: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("double"), n)


def concat_vectors(numbers: Sequence[Column | str], vector: Column | str) -> Column:
    """Numeric columns followed by a vector, as one array."""
    return F.concat(F.array(*[col(c).cast("double") for c in numbers]), as_doubles(vector))
