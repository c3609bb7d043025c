"""Text and hash expressions shared by reasons, headlines and keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, places: int) -> Column:
    """Fixed-point text, exact ties to even; NULL stays NULL."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", F.bround(value, places)))


def short_hash(text: Column) -> Column:
    """First 32 hex digits of SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(32))
