"""Rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(col: Column | str, digits: int) -> Column:
    """Round the double itself.

    ``round(col, digits)`` rounds the printed decimal instead, so that 38.675,
    which as a double lies below the half, would go up.
    """
    value = F.col(col) if isinstance(col, str) else col
    scale = F.lit(float(10 ** digits))
    return F.round(value.cast("double") * scale) / scale
