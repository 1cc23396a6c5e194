"""Times the headline queries: one warm-up, then the median of three runs. Prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from lacework.queries import QUERIES

HEADLINE = ("triangle_count", "triangle_count_all", "clique4_count", "clique5_count", "clique4_count_all", "three_motif", "three_star_count", "degree_deciles", "edges_oriented", "fsm_wedge", "fsm_triangle", "fsm_four_chain", "fsm_three_star")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        own = []
        for _ in range(1 + runs):
            spark.catalog.clearCache()  # each run reads and prepares the graph anew
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            own.append(time.perf_counter() - began)
        times[name] = round(statistics.median(own[1:]), 3)
    print(json.dumps({"metric": "sum of median seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
