"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once untimed, then timed; the time covers planning and the
full result (written to the no-op sink)."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortwave.plans import QUERIES
from cohortwave.session import build_session

HEADLINE = [
    "agg1_bytes_by_modality_task", "agg4_missingness_by_group", "jn8_reconcile", "jn12_triplet_integrity", "win1_manifest_running_total",
    "lag1_marker_gap", "win2_closed_window", "jn10_event_epochs", "sig1_artifact_fraction", "sig3_bad_channels", "sig6_narrowband",
    "sig8_welch_psd", "sig12_baseline_features", "sig28_windowed_tfa", "win4_phase_locked_boundaries", "sig20_harmonic_estimate",
    "sig26_subject_features", "st1_kruskal_wallis", "st11_roc_auc", "win5_benjamini_hochberg", "rs1_stratified_bootstrap",
    "dq1_qc_verdict", "cv4_nested_predictions", "md2_single_analysis", "md12_scoring_with_refusal", "str1_continuous_qc",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    names = [n for n in HEADLINE if not only or any(n.startswith(o) for o in only)]
    run = lambda n: QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
    times, jobs = {}, {}
    tracker = spark.sparkContext.statusTracker()
    for n in names:
        run(n)
        spark.sparkContext.setJobGroup(f"bench-{n}", n)
        t = time.time()
        run(n)
        times[n] = round(time.time() - t, 3)
        jobs[n] = len(tracker.getJobIdsForGroup(f"bench-{n}"))
        print(f"{n} {times[n]} s, {jobs[n]} jobs", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "jobs": jobs,
                      "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
