"""Vector scalars as pure expressions; the block kernel for many pairs is in operators.vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))


def l2_normalise(vec: Column) -> Column:
    """x / |x|; a zero vector stays zero."""
    # The pair (vector, length) is built once so that the length is not recomputed per element.
    pair = F.array(F.struct(vec.alias("v"), norm(vec).alias("n")))
    scaled = F.transform(pair, lambda p: F.transform(
        p["v"], lambda x: F.when(p["n"] > 0, x / p["n"]).otherwise(x.cast("double"))))
    return F.get(scaled, F.lit(0))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def cosine_score(a: Column, b: Column) -> Column:
    """Inner product of the normalised vectors; 0 when either is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, inner_product(a, b) / size).otherwise(F.lit(0.0))


def is_zero(vec: Column) -> Column:
    return ~F.exists(vec, lambda x: x != 0)
