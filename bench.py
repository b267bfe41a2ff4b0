"""Times the headline queries: once to warm up, then the median of three runs each; prints one JSON line."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from meshloom.registry import QUERIES
from meshloom.storage import delete_written

HEADLINE = ["tag_intersect", "tag_statistics", "average_position", "polygon_edges", "polygon_skin", "bounding_boxes", "locate_points", "shared_vertices", "ghost_layer", "reduce_tag", "global_ids"]
RUNS = 3


def seconds(make) -> float:
    began = time.time()
    make().write.format("noop").mode("overwrite").save()
    return time.time() - began


if __name__ == "__main__":
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map={"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # how fast the machine is just now: a sum that no change of this library touches
    calibration = statistics.median(seconds(lambda: spark.range(100_000_000).selectExpr("sum(hash(id))")) for _ in range(RUNS + 1))
    times = {}
    for name in HEADLINE:
        seconds(lambda: QUERIES[name](spark, folder))  # compiled and cached by the system
        times[name] = round(statistics.median(seconds(lambda: QUERIES[name](spark, folder)) for _ in range(RUNS)), 3)
        delete_written(spark)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1], "calibration": round(calibration, 3)}))
