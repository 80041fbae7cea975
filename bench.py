"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "search_best_scene_per_side", "rank_nearest_then_clearest", "one_frame_per_pass",
    "strip_best_pair", "radar_best_pair", "change_detection_plan",
    "median_composite", "change_layers", "window_sum_and_mean", "speckle_lee",
    "detector_log_ratio", "detector_intensity_correlation", "detector_intensity_z", "detector_multi_temporal",
    "evidence_percentile_rank", "fuse_mean", "merge_strongest_signed", "blob_labels", "ranked_candidates",
    "radar_layover_mask", "dem_vertical_offset", "volume_from_outlines", "ledger_find", "score_map_against_truth",
]


def main() -> None:
    import registry
    from siltmark.session import local_session
    registry.load_all()
    spark = local_session(CPUS, int(os.environ.get("BENCH_PARTITIONS", "8")))
    # start the JVM's compilers and the Python workers before the clock
    registry.ALL["sensor_groups"](spark, SF_DIR).count()
    spark.range(64).repartition(8).mapInPandas(lambda it: it, "id long").count()
    times = {}
    for name in HEADLINE:
        t = time.time()
        registry.ALL[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
