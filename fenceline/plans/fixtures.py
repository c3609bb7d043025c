"""Views over the generated test tables in the two input shapes the operators expect."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_daily(spark: SparkSession, sf_dir: str, stores: int = 5, skus: int = 5) -> DataFrame:
    """One row per (date, store, SKU) from ``lineitem``, folded onto so many stores and SKUs.

    The price is exact integer arithmetic on cents, so that every engine gets the same double.
    """
    qty = F.col("l_quantity").cast("bigint")
    returned = F.col("l_returnflag") == "R"
    even_line = F.col("l_linenumber") % 2 == 0

    def code(prefix, number):
        return F.concat(F.lit(prefix), F.lpad(F.col(number).cast("string"), 3, "0"))

    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.to_date("l_shipdate").alias("date"),
            (F.col("l_suppkey") % stores).alias("store"),
            (F.col("l_partkey") % skus).alias("sku"),
        )
        .agg(
            (500 + F.sum(F.when(even_line, qty).otherwise(-qty))).cast("int").alias("on_hand"),
            F.sum(F.when(returned, 0).otherwise(qty)).cast("int").alias("sold"),
            F.sum(F.when(F.col("l_linenumber") == 1, qty).otherwise(0)).cast("int").alias("delivered"),
            F.sum(F.when(returned, qty).otherwise(0)).cast("int").alias("returned"),
            F.expr("sum(floor(l_extendedprice * 100 + 0.5)) div sum(bigint(l_quantity))").alias("unit_cents"),
            (F.max("l_discount") >= 0.08).alias("promo_flag"),
        )
        .select(
            "date",
            code("ST-", "store").alias("store_id"),
            code("SKU-", "sku").alias("sku_id"),
            "on_hand",
            "sold",
            "delivered",
            "returned",
            (F.col("unit_cents").cast("double") / 100).alias("price"),
            "promo_flag",
        )
    )


def flexible_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a table with declared roles (see ``EVENTS_ROLES``)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.to_date("ts").alias("day"),
        F.col("event_type"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.col("props"),
    )


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as untidy text: mixed date forms, currency signs, blanks and nulls."""
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    text_date = (
        F.when(key % 19 == 5, F.lit("not a date"))
        .when(key % 3 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 3 == 1, F.date_format(day, "dd/MM/yyyy"))
        .otherwise((F.unix_date(day).cast("bigint") * 86400).cast("string"))
    )
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    thousands = F.expr("cents div 100000")
    return (
        table(spark, sf_dir, "orders")
        .withColumn("cents", cents)
        .select(
            key.alias("row_index"),
            text_date.alias("order_date"),
            F.when(key % 17 == 3, F.lit(None).cast("string"))
            .when(key % 17 == 4, F.lit("  "))
            .otherwise(F.concat(F.lit(" C"), F.col("o_custkey").cast("string"), F.lit(" ")))
            .alias("customer"),
            F.when(key % 17 == 5, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)))
            .alias("priority"),
            F.when(key % 17 == 3, F.lit("not a number"))
            .when(key % 17 == 6, F.lit(None).cast("string"))
            .otherwise(
                F.concat(
                    F.lit("$"),
                    thousands.cast("string"),
                    F.lit(","),
                    F.lpad(F.expr("cents div 100 % 1000").cast("string"), 3, "0"),
                    F.lit("."),
                    F.lpad(F.expr("cents % 100").cast("string"), 2, "0"),
                )
            )
            .alias("total"),
            F.col("o_orderstatus").alias("status"),
        )
    )
