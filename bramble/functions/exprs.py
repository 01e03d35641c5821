"""Column expressions: exact decimals, IEEE division, list functions, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dec(c: Column | str, precision: int = 15, scale: int = 2) -> Column:
    """Money and quantities as exact decimals."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({precision},{scale})")


def ieee_div(a: Column, b: Column) -> Column:
    """a / b in doubles: a zero divisor gives an infinity, or NaN for 0 / 0, in ANSI mode too."""
    x, y = a.cast("double"), b.cast("double")
    zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
    return F.when(y == 0, zero).otherwise(x / F.when(y != 0, y))


def avg_decimal(c: Column) -> Column:
    """Average of a decimal as a double: the exact sum, and one division."""
    return F.sum(c).cast("double") / F.count(c)


def list_sum(c: Column) -> Column:
    """Sum of an array<bigint>: 0 if empty, null if null; a null element is an error."""
    checked = F.when(F.exists(c, lambda x: x.isNull()), F.raise_error(F.lit("list_sum: NULL elements are not supported"))).otherwise(c)
    return F.aggregate(checked, F.lit(0).cast("bigint"), lambda a, x: a + x)


def list_expr_sum(c: Column) -> Column:
    """Sum of sin(x) * cos(x) + sqrt(abs(x) + 1) over an array<bigint>."""
    term = lambda x: F.sin(x.cast("double")) * F.cos(x.cast("double")) + F.sqrt(F.abs(x.cast("double")) + 1)
    return F.aggregate(F.transform(c, term), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of one length."""
    return dot(a, b) / (norm(a) * norm(b))
