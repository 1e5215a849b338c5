"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced with the ``noop`` sink (full computation, nothing
collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from aularank.plans import registry  # noqa: E402
from aularank.session import get_session  # noqa: E402

HEADLINE = [
    "course_catalog",
    "model_build",
    "user_neighbours",
    "score_collaborative",
    "score_history",
    "recommend_hybrid",
    "response_text",
    "route_decision",
    "chunk_search",
    "answer_prompts",
    "daily_metrics",
    "recommendation_history",
    "constraint_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = get_session()
    # Warm-up: JVM start, parquet footer reads and codegen of the common scan.
    registry.SPARK["clean_enrolments"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    queries = dict(registry.SPARK, model_build=registry.q_model_build)
    for name in names:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
