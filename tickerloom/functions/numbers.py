"""Scalar arithmetic shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_MODULUS = 2147483647


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_double(c: Column | str) -> Column:
    """Cast to double and turn NaN into NULL, so that aggregates skip it."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def truncate_cents(c: Column | str) -> Column:
    """Keep two decimals, cutting toward zero."""
    return ratio((col(c) * 100).cast("bigint"), F.lit(100))


def up_flag(c: Column | str) -> Column:
    return (col(c) > 0).cast("int")


def to_number(c: Column | str) -> Column:
    """Parse text as a number; text that is no number becomes NULL."""
    return clean_double(F.trim(col(c).cast("string")).try_cast("double"))


def hash_order(c: Column | str, seed: int = 0) -> Column:
    """Arithmetic pseudo-random order of integer ids, the same in every SQL engine.

    The id is reduced first, so the product stays inside 64 bits for any id.
    """
    reduced = F.pmod(col(c).cast("bigint") + F.lit(1 + seed).cast("bigint"), F.lit(HASH_MODULUS).cast("bigint"))
    return (reduced * F.lit(48271).cast("bigint") * F.lit(69621).cast("bigint")) % F.lit(HASH_MODULUS).cast("bigint")
