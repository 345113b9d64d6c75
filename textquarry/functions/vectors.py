"""Distances and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances are compared at nine decimals: below that, the order of summation shows.
COMPARE_DIGITS = 9
SHOWN_DIGITS = 4



def shown_distance(distance: Column) -> Column:
    return F.round(distance, SHOWN_DIGITS)


def score(distance: Column) -> Column:
    """Relevance in (0, 1]: ``1 / (1 + distance)``."""
    return F.round(F.lit(1.0) / (F.lit(1.0) + distance), SHOWN_DIGITS)
