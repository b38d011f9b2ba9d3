"""Values that are computed once. An expression that is used by its name in several places is computed in each of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then) -> Column:
    """then(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
