"""Times the headline queries: one warm-up, then the median of three runs, results written to nowhere."""

from __future__ import annotations

import json
import os
import statistics
import time

from silvaspark.plans.catalogue import QUERIES
from silvaspark.session import session

HEADLINE = ("treetop_local_maxima", "min_distance_filter", "ndsm", "veg_mask_dilated", "point_ndvi", "crown_point_join", "crown_metrics", "corr_pearson", "spectral_indices", "veg_fraction", "training_samples", "fill_holes", "polygonize", "watershed")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = session(f"local[{cpus}]", shuffle_partitions=2 * int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
