"""Benchmark: wall time of the headline plans on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each plan is executed in full with the no-op sink (every row computed, nothing collected to the driver). ``queries`` are the
times of the plans one after the other in a session: shared stages (keyed observations, merged entities, log,
predictions) are written by the first plan that needs them. With BENCH_COLD=1, ``cold`` has each plan's time again with
those stages forgotten, so that it builds its own."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["cleaning_funnel", "holdout_anti", "memorization", "merge_measurements", "regression_metrics",
            "seed_matched_diff", "early_stop", "patience_table", "seeded_split", "shuffle_labels", "bootstrap_ci",
            "poisson_bootstrap", "parse_pair_array", "parse_label_object", "latest_response", "cost_rollup",
            "distinct_curve", "hash_fingerprint", "max_tanimoto", "stream_log_ingest"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from augeval.plans.registry import QUERIES, load_all
    from augeval.session import get_spark
    load_all()
    spark = get_spark(f"local[{cpus}]", app="augeval-bench", shuffle_partitions=max(8, 2 * cpus),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                             "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)})
    times = {}
    t_all = time.time()
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(f"# {n}: {times[n]}s", file=sys.stderr, flush=True)
    total = round(time.time() - t_all, 3)
    cold = {}
    if os.environ.get("BENCH_COLD") == "1":
        from augeval.plans import roles, stages
        for n in names:
            for memo in (roles._LOG, roles._PREDS, stages._KEYED, stages._MERGED):
                memo.clear()
            t0 = time.time()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            cold[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_plans_total_wall", "value": total, "unit": "sec", "queries": times, **({"cold": cold} if cold else {}),
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
