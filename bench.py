"""Times the headline queries: one JSON line, the median of three warm runs each."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from graphquarry.plans.queries import QUERIES

HEADLINE = ["traverse_in", "fts_bm25_term", "symbol_call_counts", "validation_union_summary", "tag_search_and"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[name] = round(median(runs[1:]), 3)
    # beside the sum: a symbol graph from source files, a file a supplier, parsed and resolved anew each time
    runs = []
    for _ in range(3):
        t = time.perf_counter()
        QUERIES["symbol_build_calls"](spark, sf_dir).write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - t)
    rebuild = {"files": spark.read.parquet(f"{sf_dir}/supplier.parquet").count(), "sec": round(median(runs), 3)}
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "symbol_rebuild": rebuild, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
