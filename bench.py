"""Benchmark the headline queries.

Runs each query over the whole tables in ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and executes it through the
``noop`` sink (full computation, nothing collected on the driver).  Prints
one JSON line: {"metric", "value", "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scriptorium.plans import catalogue  # noqa: E402,F401
from scriptorium.plans.registry import QUERIES  # noqa: E402
from scriptorium.session import build_session  # noqa: E402

HEADLINE = [
    "cer_by_lang",            # minimum slice: explode, noise, normalise, levenshtein, aggregate
    "evaluation_report",      # AGG-21: every metric incl. sentence BLEU in one aggregate
    "row_scores",             # per-row score table with the dense global index
    "conversion_stats",       # full abbreviation expansion
    "training_table",         # MOD-4: split + byte tokens
    "lexicon_evaluation",     # MOD-2 learn + JOI-3 apply + CER before/after
    "align_lines",            # JOI-2 band join as an exploded equi-join
    "assemble_pages",         # AGG-16
    "worst_per_lang",         # TOP-5 with group limit
    "metric_trend",           # WIN-5
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * int(cpus)))
    # Warm-up: JVM start, class loading and file listing are not query time.
    QUERIES["line_pairs"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
