"""Time the headline queries; prints one JSON line."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "e3_unblind_compare", "e2_blinded_run", "e1_ingest", "t15_detector_bundle", "j1_wide_variants", "d6_near_duplicates",
    "d5_scene_change_sampler", "w1_persistence", "w3_best_variant", "s1_sample_scores", "s4_empirical_p", "s5_bh_q_values",
    "s6_permutation_p", "s8_family_statistics", "j5_q_attach", "b1_blind_ids", "b4_unblind", "t8_series_spectrum",
    "t11_text_evidence", "d8_sampling_diagnostics", "io6_group_fingerprint", "k1_top_candidates",
]


def main():
    from signalblind.plans import load
    from signalblind.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "signalblind-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    took = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "1"))):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
