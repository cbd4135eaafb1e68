"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is executed completely with the ``noop`` sink (no collect).  A query that
fails is named under ``errors`` and the others go on.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabrisk.plans.catalog import QUERIES  # noqa: E402
from tabrisk.session import local_session  # noqa: E402

HEADLINE = [
    "describe_numeric",
    "corr_with_target",
    "knn_impute",
    "prepared_scaled",
    "stratified_sample",
    "diverse_sample",
    "smote",
    "fold_metrics",
    "shap_values",
    "prompts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) if cpus.isdigit() else 8))
    # warm-up: JVM start, first code generation (not timed)
    spark.range(1000).selectExpr("sum(id)").collect()
    times, errors = {}, {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:  # the others still count
            errors[name] = str(e).splitlines()[0][:300]
            continue
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out | ({"errors": errors} if errors else {})))
    spark.stop()


if __name__ == "__main__":
    main()
