"""Small helpers for one-row summaries."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*parts: DataFrame) -> DataFrame:
    """One row from several one-row frames with different columns, without a join."""
    stacked = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
