"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def require_size(vector: Column, size: int) -> Column:
    """The vector, or an error when its length differs."""
    stop = F.raise_error(F.lit(f"vector must have length {size}")).cast("array<float>")
    return F.when(F.size(vector) == size, vector).otherwise(stop)
