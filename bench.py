"""Time the headline queries end to end and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fenceline.plans.catalog import QUERIES, stored  # noqa: E402

HEADLINE = [
    "features_daily",
    "tukey_results",
    "incidents",
    "feature_baseline",
    "forest_results",
    "flexible_tukey",
    "flexible_forest",
    "flexible_incidents",
    "boxplot",
    "profile_columns",
    "profile_numeric",
    "suggest_schema",
    "valid_rows",
    "packed_rows",
    "unique_identifiers",
    "incident_summary",
    "apply_changes",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores)
        # Small test tables: keep several tasks per stage instead of one.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM
    times = {}
    # The reading side works on stored tables; their one-off cost is shown on its own.
    started = time.perf_counter()
    for name in ("incidents", "items"):
        stored(spark, folder, name)
    times["stored_tables"] = round(time.perf_counter() - started, 3)
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    scale = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
