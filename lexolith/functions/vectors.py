"""Column expressions on vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similarity(a: Column, b: Column) -> Column:
    """The dot product, which is the cosine of unit vectors; 0 if either is null or the lengths differ.

    Products are single precision where the vectors are, sums are double.
    """
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(dot)


def is_valid_vector(vector: Column, dimensions: int) -> Column:
    return F.coalesce(F.size(vector) == dimensions, F.lit(False)) & vector.isNotNull()
