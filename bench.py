"""Headline queries at one scale: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the tables and
the cores. Every query runs once to warm up and then BENCH_REPEATS times (default 3); the
figure is the best time to compute all rows of the result.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quillon import queries as engine

HEADLINE = ["topk", "project_alias_float", "filter_and_or_not", "int_div_mod", "float_arithmetic", "coercion_mixed", "null_three_valued", "cast_float_int", "cast_float_utf8", "sort_multi", "sort_nulls_first", "nan_compare", "limit_file_order"]


def main() -> None:
    folder, cpus, repeats = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_REPEATS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(repeats + 1):
            began = time.perf_counter()
            engine.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(min(times[1:]), 4)
    print(json.dumps({"metric": "engine_headline_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
