"""Time the headline queries: one JSON line. Env: BENCH_SF_DIR, BENCH_CPUS, BENCH_QUERIES (comma list)."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from layerframe.plans.catalog import QUERIES
from layerframe.session import get_session

HEADLINE = [
    "h04_f02_flagship_fit_by_group", "h06_metrics", "h07_best_equation", "h10_pareto_fitted_family", "h02_valid_pixels_bilayer", "f05_residual_log",
    "b02_stack_keys", "c04_c05_optimal_grid", "c08_stitch_first", "c11_box_mean_5x5", "c12_high_pass", "c23_safe_centers", "d02_component_stats", "d05_thin_points", "d06_leader_clusters", "e01_radius_pairs",
    "e02_k_nearest", "e07_cycle_score", "e22_stacking_class", "e23_trimmed_mean", "i02_dice_iou", "i07_log_dumps", "g01_g08_weighted_draw", "a15_content_hashes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = get_session("bench", cpus=cpus, shuffle=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    took = {}
    for n in names:
        t = time.perf_counter()
        QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save()
        took[n] = round(time.perf_counter() - t, 3)
        print(n, took[n], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
