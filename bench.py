"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "flagship_mask", "d01_email", "d05_card_documents", "c03_fingerprints", "o1_overlaps", "e08_token_entities", "r05_partial_mask_all", "m03_synthetic_round_trip",
    "x06_decisions", "a02_admission_gate", "t01_process_directions", "g01_compact_decisions",
)


def main() -> None:
    from maskfold.plans.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        QUERIES[name](spark, "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf_dir).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "documents_per_sec": round(docs / took["flagship_mask"])}))


if __name__ == "__main__":
    main()
