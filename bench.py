"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion through the ``noop`` sink (the whole plan
executes, nothing is collected). Iterative queries include their loop. One
warm-up run, then the median of $BENCH_RUNS runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pair_amount_round0",
    "three_leg_extract",
    "three_leg_extract_union",
    "touching_cards",
    "touching_segment_cards",
    "suspect_card_count",
    "edge_list",
    "trace_fixpoint",
    "trace_closed_fixpoint",
    "trace_closed_fixpoint_full",
    "trace_consume_5",
    "trace_rounds_transfer",
    "trace_history_fixpoint",
    "trace_history_transfers",
    "card_digest",
]


def _sf(path: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def main() -> None:
    from cardtrail.queries import QUERIES
    from cardtrail.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cpus}]", app="cardtrail-bench", shuffle_partitions=cpus,
                          extra={"spark.driver.memory": "8g"})
    timings: dict[str, float] = {}
    for name in names:
        q = QUERIES[name]

        def once() -> float:
            t0 = time.perf_counter()
            q(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()  # warm-up
        timings[name] = round(statistics.median(once() for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({"metric": "sum_of_median_query_seconds",
                      "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": _sf(sf_dir), "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
