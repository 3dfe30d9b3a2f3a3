"""Benchmark: build the star once, then time every report (one warm-up, one timed run).

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_WARMUP_DIR (default: the sf0.001 folder next to BENCH_SF_DIR, if present).
Prints one JSON line: {"metric", "value", "unit", "queries", "rows", "sf"}.
Each run is a noop write of the full result, so every row is produced.

The star build is timed once on BENCH_SF_DIR after the same build has run on the
warm-up folder (other data, so no table is reused): JVM class loading, JIT and code
generation are paid there, as the reports pay them in their warm-up run. The
warm-up time is reported apart as "warmup_star_build".
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


# model fits (200-round boosted trees, ALS), timed only with BENCH_TRAINING=1
TRAINING = {"fraud_model_evaluation", "fraud_feature_importance", "recommended_methods", "fraud_permutation_importance",
            "merchant_segment_methods"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    from payflow.session import get_spark
    from payflow.plans.registry import reports
    from payflow.plans.store import TABLES, build_all

    spark = get_spark(f"local[{cpus}]", app="payflow-bench", shuffle_partitions=cpus * 2)
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    warm_dir = os.environ.get("BENCH_WARMUP_DIR",
                              os.path.join(os.path.dirname(sf_dir), "sf0.001")).rstrip("/")
    warmup = None
    if warm_dir != sf_dir and os.path.isdir(warm_dir):
        t = time.time()
        build_all(spark, warm_dir)
        warmup = round(time.time() - t, 3)
    t = time.time()
    build_all(spark, sf_dir)
    times["star_build"] = round(time.time() - t, 3)

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    for name, job in reports().items():
        if only and name not in only:
            continue
        if name in TABLES:
            continue          # the marts are timed as star_build
        if name in TRAINING and not os.environ.get("BENCH_TRAINING"):
            continue          # model fits are timed apart (see "training" below)
        run(job(spark, sf_dir))                       # warm-up
        t = time.time()
        df = job(spark, sf_dir)
        run(df)
        times[name] = round(time.time() - t, 3)
        rows[name] = df.count()
    training = {}
    if os.environ.get("BENCH_TRAINING"):
        for name in TRAINING:
            training[name] = times.pop(name, None)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_wall_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "training": training,
                      "warmup_star_build": warmup, "warmup_dir": warm_dir if warmup is not None else None,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
