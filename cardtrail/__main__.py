"""Command line: ``python -m cardtrail <command> ...`` (spark-submit friendly).

  trace BEGIN END TABLE SRC DEST SEEDS [OUT]  parametric trace, prints sizes; the
                                            reached cards go to OUT/cards
  two-round-trace SOURCE SEEDS BEGIN END OUT  2-round trace, cards to OUT/cards
  two-rounds SOURCE CARDS BEGIN END OUT     round 0 and 1 tables
  extract SOURCE CARDS BEGIN END OUT        three-leg extract
  transfer-cards EXTRACT OUT                distinct transfer cards of a stored extract
  digest PLAIN OUT                          blacklist digests (key from stdin)
  edges SOURCE SEEDS BEGIN END OUT          4-round trace, last round's edges as text
  all-rows SOURCE SEEDS BEGIN END OUT       5-round trace, consumption + transfers as text
  every-round SOURCE SEEDS BEGIN END OUT    4-round trace, every round's rows by round

SOURCE is a table name, or a path when it contains '/'; CARDS/SEEDS is a text
file with one card per line.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from . import jobs
from .sources.cards import cards_from_text
from .sources.history import read_history


def _print_sizes(sizes: list[int]) -> None:
    for i, n in enumerate(sizes):
        print(f"round {i}\t{n}")


def main(argv: list[str]) -> int:
    if not argv:
        print(__doc__)
        return 2
    cmd, rest = argv[0], argv[1:]
    spark = SparkSession.builder.appName(f"cardtrail-{cmd}").getOrCreate()
    if cmd == "trace":
        out = rest[6] if len(rest) == 7 else None
        _print_sizes(jobs.parametric_trace(spark, jobs.SearchArgs.parse(rest[:6] if out else rest), out))
    elif cmd == "transfer-cards":
        extract, out = rest
        jobs.transfer_cards_job(read_history(spark, extract, fmt="table" if "/" not in extract else "parquet"), out)
    elif cmd in ("two-rounds", "extract"):
        source, cards, begin, end, out = rest
        history = read_history(spark, source, fmt="table" if "/" not in source else "parquet")
        card_df = cards_from_text(spark, cards)
        if cmd == "extract":
            jobs.extract_job(history, card_df, begin, end, out)
        else:
            print(jobs.two_rounds_job(spark, history, card_df, begin, end, out))
    elif cmd in ("edges", "all-rows", "every-round", "two-round-trace"):
        source, seeds, begin, end, out = rest
        history = read_history(spark, source, fmt="table" if "/" not in source else "parquet")
        if cmd == "two-round-trace":
            _print_sizes(jobs.two_round_trace_job(history, cards_from_text(spark, seeds), begin, end, out))
            return 0
        job = {"edges": jobs.edges_job, "all-rows": jobs.all_rows_job,
               "every-round": jobs.every_round_job}[cmd]
        res = job(history, cards_from_text(spark, seeds), begin, end, out)
        _print_sizes(res.sizes)
    elif cmd == "digest":
        plain, out = rest
        key = sys.stdin.readline().rstrip("\n")
        jobs.digest_cards(cards_from_text(spark, plain), key).write.mode("overwrite").parquet(out)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
