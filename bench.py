"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], each the median of three runs, and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

HEADLINE = (
    "tag_query_sorted_slice tag_merge_outer file_semi range_union range_invert extract_samples sum_samples flag_merge scan_sessions asof_lookup gapfill_linear "
    "common_mode bin_nearest bin_bilinear gather_bilinear div_map map_solve block_mu_sigma tile_pyramid argmax_merge radius_pairs covariance poly_filter"
).split()


def main() -> None:
    cpus, d = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tallyfield import catalog

    spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # starts the JVM's machinery
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.time()
            catalog.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        took[name] = round(median(runs), 3)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
