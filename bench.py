"""Timed headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.catalog import entries  # noqa: E402
from tidemark.session import local_session  # noqa: E402

# One query per family: features, segmentation, rules, fusion, bootstrap, forest, retrieval, evaluation, dashboards.
HEADLINE = [
    "c05_moments", "c04_features_events", "c08_features_items", "c02_gap_segments", "c03_live_labels", "f01_thresholds", "f04_rule_hits",
    "f23_strategies", "f30_tie_enumeration", "g06_bootstrap_f1", "f24_feature_auc", "f10_forest_scores", "h03_tokens", "h05_bm25",
    "h11_top_k", "h14_hybrid", "h21_search", "h18_select", "h22_context", "i03_summary", "e08_alert_totals", "e09_sparkline", "e10_waveform", "j03_stream_verdicts",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "tidemark-bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    known = {e.name: e for e in entries()}
    spark.range(1).count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        known[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
