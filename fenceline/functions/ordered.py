"""Values carried forward along an order, without one task per key."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_known_before(df: DataFrame, key: str, at: str, tie: str, columns: list[str], prefix: str) -> DataFrame:
    """Add, per column, the last non-null value of the same key strictly before each row.

    The order is (``at``, ``tie``). A key's rows are cut into hours: the last value of each hour is
    found by partial aggregation, carried over the (few) hours, and only then ordered inside one
    hour. A key that holds a third of all rows is thus spread over many tasks.
    """
    chunked = df.withColumn("__chunk", F.date_trunc("hour", F.col(at)))
    order = F.struct(at, tie)

    def last(column) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)

    hours = chunked.groupBy(key, "__chunk").agg(*[last(c) for c in columns])
    earlier = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select(
        key, "__chunk", *[F.last(c, ignorenulls=True).over(earlier).alias(f"__in_{c}") for c in columns]
    )
    inside = Window.partitionBy(key, "__chunk").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunked.join(carried, [key, "__chunk"])
        .select(
            *df.columns,
            *[
                F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"__in_{c}")).alias(f"{prefix}{c}")
                for c in columns
            ],
        )
    )
