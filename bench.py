"""Headline queries on one scale factor; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the headline list).
"""

from __future__ import annotations

import json
import os
import re
import time

HEADLINE = [
    "similar_episodes_j7",           # similarity search
    "retrieved_episodes_x3",
    "categories_by_material_j1",     # category selection
    "selected_categories_x6",
    "global_features_c12",           # fingerprint
    "glcm_features_c13",
    "lbp_histogram_c14",
    "auto_tune_x5",                  # auto-tune
    "density_percentiles_m7",
    "ink_limit_stats_m12",           # press work
    "black_candidates_m30",
    "prepress_inks_x8",
    "lowfreq_rmse_m17",
    "micro_holes_w5",
    "layer_overlap_j8",              # masks
    "content_loss_j20_m15",
    "closed_masks_w7",
    "components_g2",
    "delivery_verdict_x1_m21",       # audit
    "baseline_regression_j13_x7",
    "signal_counts_m3",              # learning
    "learned_weight_fold_c20",
    "category_priors_m4",
    "category_priors_rollup_m5",
    "enqueue_decisions_t5",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    from inkloom.plans import catalog
    from inkloom.session import local_session

    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM code paths and the Python workers before timing
    catalog.QUERIES["similar_episodes_j7"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    catalog.QUERIES["components_g2"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
