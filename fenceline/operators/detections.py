"""The common detection table that both detectors write into."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenceline.functions.text import short_hash
from fenceline.operators.tukey import tukey_reasons

REASON_TYPE = (
    "array<struct<type:string,feature:string,z_score:double,message:string,value:double,mean:double,distance:double>>"
)

COLUMNS = {
    "detection_id": "string",
    "dataset_id": "bigint",
    "date": "date",
    "store_id": "string",
    "sku_id": "string",
    "detector_type": "string",
    "metric_name": "string",
    "q1": "double",
    "q3": "double",
    "iqr": "double",
    "lower_fence": "double",
    "upper_fence": "double",
    "actual_value": "double",
    "outlier_distance": "double",
    "anomaly_score": "double",
    "threshold_used": "double",
    "is_outlier": "boolean",
    "reasons": REASON_TYPE,
    "sample_size": "bigint",
    "fallback_used": "string",
}


def _conform(df: DataFrame, detector: str) -> DataFrame:
    """All columns of the common table; the id is a hash of the natural key, so reruns agree."""
    metric: Column = F.col("metric_name") if "metric_name" in df.columns else F.lit("")
    made = {
        "detection_id": short_hash(
            F.concat_ws("|", F.col("date").cast("string"), "store_id", "sku_id", F.lit(detector), metric)
        ),
        "detector_type": F.lit(detector),
    }
    return df.select(
        *[
            made.get(name, F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in COLUMNS.items()
        ]
    )


def tukey_detections(results: DataFrame) -> DataFrame:
    none = {name: F.lit(None).cast("double") for name in ("z_score", "value", "mean")}
    reason = F.struct(
        F.col("reason.type").alias("type"),
        F.lit(None).cast("string").alias("feature"),
        none["z_score"].alias("z_score"),
        F.col("reason.message").alias("message"),
        none["value"].alias("value"),
        none["mean"].alias("mean"),
        F.col("reason.distance").alias("distance"),
    )
    told = tukey_reasons(results).withColumn("reasons", F.when(F.col("is_outlier"), F.array(reason)))
    return _conform(told, "tukey")


def forest_detections(results: DataFrame) -> DataFrame:
    """Expects ``reasons`` as array<struct<feature, z_score, message, value, mean>>."""
    full = F.transform(
        "reasons",
        lambda r: F.struct(
            F.lit(None).cast("string").alias("type"),
            r["feature"].alias("feature"),
            r["z_score"].alias("z_score"),
            r["message"].alias("message"),
            r["value"].alias("value"),
            r["mean"].alias("mean"),
            F.lit(None).cast("double").alias("distance"),
        ),
    )
    told = results.withColumn("reasons", F.when(F.size("reasons") > 0, full)).withColumnRenamed(
        "is_anomaly", "is_outlier"
    )
    return _conform(told, "isolation_forest")
