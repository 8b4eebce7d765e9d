"""The three-leg and two-leg extracts for a list beyond the broadcast bound: one scan with
repeated rows against one semi join per leg, with all broadcasts off."""

import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cardtrail import queries as Q  # noqa: E402
from cardtrail.operators import semi  # noqa: E402
from cardtrail.functions import predicates as P  # noqa: E402
from cardtrail.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "cardtrail.broadcast.maxRows": "0"}
    spark = build_session("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g", **off})
    cards = Q._segment_cards(spark, sf_dir)
    transfers = Q._closed(spark, sf_dir).filter(P.is_transfer()).select(Q.IN_COL, Q.OUT_COL, "trans_at")
    for name, rows, legs in (("three legs", Q._closed(spark, sf_dir), [Q.IN_COL, Q.OUT_COL, Q.PRI_COL]), ("two legs", transfers, [Q.IN_COL, Q.OUT_COL])):
        for method in ("explode", "union"):
            took = []
            for _ in range(6):
                began = time.perf_counter()
                semi.legs_extract(rows, cards, legs, None, method).write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - began)
            took = took[1:]
            print(f"{name}, {method}: median {statistics.median(took):.2f} s, {min(took):.2f} to {max(took):.2f}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
