"""Runs the headline queries once each and prints one line of JSON. Each is run on the next smaller tables first, where
these lie beside the folder, so that what is measured is throughput and not the start of the JVM."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from redactlake import queries as core

HEADLINE = ["scan_default", "redact_default", "scan_pii_all", "mask_label", "has_sensitive", "secret_generic_api_key", "keywords_exceptions", "regex_detector", "dedupe_findings", "mask_partial", "scan_no_dedupe"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.01")
    for name in HEADLINE if os.path.isdir(small) else ["pii_email"]:
        core.QUERIES[name](spark, small if os.path.isdir(small) else folder).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.time()
        core.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
