"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query's result is fully computed (small results collected, large ones
written to the no-op sink); times are wall seconds per query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from upshot.plans import load_all  # noqa: E402
from upshot.session import get_spark  # noqa: E402

HEADLINE = [
    "s3_engagement_panel",        # panel build: lineitem x part x orders, two aggregations
    "c5_analysis_table",          # cohort builder, union of two join branches
    "e1_two_sample_ttest",        # flagship: cleaned panel -> cross-section -> t tests
    "e3_segment_lift",
    "a17_segment_rollup",
    "e8_organization_lift",       # dedupe + Mann-Whitney ranks + chi-square per organization
    "e9_type_lift_vs_control",
    "g5_growth_comparison",
    "e13_did",
    "e16_wilcoxon_prepost",
    "e12_ate_bootstrap",
    "m2_caliper_matching",
    "k5_k10_cluster_selection",
]
LARGE = {"s3_engagement_panel", "c5_analysis_table"}


def shuffle_bytes(ev_dir: str, spans: dict) -> dict:
    """Shuffle MB written per query from the event log: each job is assigned
    to the query whose wall-clock span contains its submission time."""
    stage_query, written = {}, {}
    files = sorted(os.path.join(r, f) for r, _, fs in os.walk(ev_dir) for f in fs
                   if f.startswith("events_"))
    for path in files:
        with open(path) as f:
            for line in f:
                try:
                    e = json.loads(line)
                except ValueError:
                    continue
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    ts = e.get("Submission Time", 0)
                    q = next((k for k, (a, b) in spans.items() if a <= ts <= b), None)
                    for sid in e.get("Stage IDs", []):
                        stage_query[sid] = q
                elif kind == "SparkListenerTaskEnd":
                    q = stage_query.get(e.get("Stage ID"))
                    m = (e.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    if q is not None:
                        written[q] = written.get(q, 0) + m.get("Shuffle Bytes Written", 0)
    return {k: round(written.get(k, 0) / 1e6, 2) for k in spans}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    # Spark's event log in a scratch folder gives shuffle bytes per query (no UI)
    ev_dir = tempfile.mkdtemp(prefix="upshot-bench-events-")
    spark = get_spark(f"local[{cpus}]", app="upshot-bench", shuffle_partitions=int(cpus) * 2,
                      extra_conf={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g"),
                                  "spark.eventLog.enabled": "true",
                                  "spark.eventLog.dir": f"file://{ev_dir}",
                                  "spark.eventLog.compress": "false"})
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="upshot-bench-ckpt-"))
    reg = load_all()
    times = {}
    rows = {}
    spans = {}
    for name in (only or HEADLINE):
        q = reg[name]
        t0 = time.time()
        df = q.build(spark, sf_dir)
        if name in LARGE:
            df.write.format("noop").mode("overwrite").save()
            rows[name] = None
        else:
            rows[name] = len(df.collect())
        times[name] = round(time.time() - t0, 3)
        spans[name] = (t0 * 1000.0, time.time() * 1000.0)
    spark.stop()
    shuffle = shuffle_bytes(ev_dir, spans)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus),
           "rows": rows, "shuffle_mb": shuffle}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
