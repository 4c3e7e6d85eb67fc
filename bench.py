"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names) choose what runs. Every query is written in full to a
sink that discards it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from marginalia.plans import all_queries
from marginalia.session import build_session

HEADLINE = (
    "d1_micro_f1",
    "c2_exact_match",
    "c6_edge_match",
    "d9_paired_bootstrap_delta",
    "d8_bootstrap_f1_multinomial",
    "e10_cascade_curve",
    "i1_exact_locate",
    "i1_fuzzy_align",
    "i2_assembled_relations",
    "b3_violations",
    "c15_resolved_edges",
    "c16_segments",
    "c19_shingle_contamination",
    "d7_cost_by_scope",
    "e9_cap_admission",
    "d12_output_health",
    "j1_streaming_spend",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_marginalia_spread=cpus,
        spark_driver_memory="16g",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, took = all_queries(), {}
    for name in names:
        began = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {took[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_seconds", "value": total, "unit": "sec", "queries": took, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
