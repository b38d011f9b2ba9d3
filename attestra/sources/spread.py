"""Rows over all cores, where a row is much more work than its bytes say."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Parts at least, as a session that has just begun doesn't know of all its executors.
LEAST_PARTS = 48


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The same rows, dealt by keys. A reader makes few tasks of few bytes, down to one, and a shuffle's small parts are merged
    again unless their number is said, as here."""
    return rows.repartition(max(LEAST_PARTS, 4 * rows.sparkSession.sparkContext.defaultParallelism), *keys)
