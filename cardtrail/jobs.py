"""Job entry points: the traced jobs as functions over a history source, each
writing its outputs with ``sinks``. The CLI in ``__main__`` calls these."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .constants import CARD, IN_COL, OUT_COL
from .functions import predicates as P
from .functions.digest import card_digest
from .operators import sets, summary
from .plans import closure, two_round
from .sources.cards import cards_from_arg
from .sources.history import read_history


def digest_cards(plain: DataFrame, key: str) -> DataFrame:
    """The blacklist preparation: plaintext card numbers to listed digests.
    Only the digests leave this function; nothing plaintext is written."""
    return plain.select(card_digest(F.col(CARD), key).alias(CARD))


@dataclass
class SearchArgs:
    """The six parameters of the parametric trace, validated."""
    begin: str
    end: str
    table: str
    src: str
    dest: str
    seeds: str

    @classmethod
    def parse(cls, argv: list[str]) -> SearchArgs:
        if len(argv) != 6:
            raise ValueError("expected 6 arguments: begin end table src dest seeds")
        if any(not a.strip() for a in argv[:5]):
            raise ValueError("begin, end, table, src and dest must be non-empty")
        return cls(*argv)


def _save_trace(result: closure.TraceResult, out: str | None) -> list[int]:
    """Write the reached cards and the sizes of a trace (if ``out`` is given), delete
    its scratch, return the sizes."""
    try:
        if out is not None:
            sinks.write_table(result.cards(), f"{out}/cards")
            sinks.write_table(result.sizes_df(), f"{out}/sizes")
        return list(result.sizes)
    finally:
        result.cleanup()


def parametric_trace(spark: SparkSession, args: SearchArgs, out: str | None = None,
                     fmt: str = "table", **kw) -> list[int]:
    """Half-open window, successful rows, blank ends dropped, any two columns,
    until the count stops changing. Writes the reached cards to ``out``/cards and the
    sizes to ``out``/sizes; returns the sizes."""
    history = read_history(spark, args.table, fmt=fmt)
    return _save_trace(closure.preset_fixpoint(history, cards_from_arg(spark, args.seeds), args.begin,
                                               args.end, src=args.src, dest=args.dest, **kw), out)


def two_round_trace_job(history: DataFrame, seeds: DataFrame, begin: str, end: str,
                        out: str | None, **kw) -> list[int]:
    """The closure of at most two rounds, half-open window, blank ends dropped."""
    return _save_trace(closure.preset_two_rounds(history, seeds, begin, end, **kw), out)


def two_rounds_job(spark: SparkSession, history: DataFrame, cards: DataFrame, begin: str,
                   end: str, out_dir: str, amount_type: str = summary.AMOUNT_TYPE) -> int:
    """Round 0 and round 1 into tables; returns the number of suspect cards. The
    extract and the round-1 rows are written once, to their output folders, and
    read back by what follows; ``unreadable`` holds, by round, how many amounts the
    sums leave out because they can't be read exactly."""
    # Counting the list (a small input) gives its broadcast a proven size.
    t = two_round.run(history.filter(P.date_closed(begin, end)), cards, cards.count(),
                      cards_path=f"{out_dir}/cards_round0", extract_path=f"{out_dir}/extract",
                      rows_path=f"{out_dir}/rows_round1", amount_type=amount_type)
    for pairs, number in ((t.round0_pairs, 0), (t.round1_pairs, 1)):
        text = pairs.withColumn("amount", summary.plain_amount("amount"))
        sinks.write_delimited(text, f"{out_dir}/pairs_round{number}")
    sinks.write_table(t.round1_cards, f"{out_dir}/cards_round1")
    unreadable = (t.round0_unreadable.withColumn("round", F.lit(0))
                  .unionByName(t.round1_unreadable.withColumn("round", F.lit(1))))
    sinks.write_table(unreadable, f"{out_dir}/unreadable")
    return int(spark.read.parquet(f"{out_dir}/cards_round1")
               .agg(F.countDistinct(CARD)).first()[0])


def extract_job(history: DataFrame, cards: DataFrame, begin: str, end: str,
                out: str) -> None:
    """The three-leg extract of a window into a table."""
    sinks.write_table(two_round.round0_extract(history.filter(P.date_closed(begin, end)), cards,
                                               cards.count()), out)


def transfer_cards(extract: DataFrame) -> DataFrame:
    """Transfer endpoints of an extract as a bag (one column ``card``)."""
    return sets.endpoint_bag(extract.filter(P.is_transfer()), [IN_COL, OUT_COL])


def transfer_cards_job(extract: DataFrame, out: str) -> None:
    """The distinct transfer cards of a stored extract, as a table."""
    sinks.write_table(transfer_cards(extract).distinct(), out)


def edges_job(history, seeds, begin, end, out, **kw) -> closure.TraceResult:
    r = closure.preset_edges(history, seeds, begin, end, **kw)
    try:
        sinks.write_row_text(r.edges, out)
    finally:
        r.result.cleanup()
    return r.result


def all_rows_job(history, seeds, begin, end, out_dir, **kw) -> closure.TraceResult:
    r = closure.preset_all_rows(history, seeds, begin, end, **kw)
    try:
        sinks.write_row_text(r.consumption, f"{out_dir}/consumption")
        sinks.write_row_text(r.transfers, f"{out_dir}/transfers")
    finally:
        r.result.cleanup()
    return r.result


def every_round_job(history, seeds, begin, end, out_dir, **kw) -> closure.TraceResult:
    r = closure.preset_every_round(history, seeds, begin, end, **kw)
    try:
        sinks.write_rounds(r.consumption, f"{out_dir}/consumption")
        sinks.write_rounds(r.transfers, f"{out_dir}/transfers")
    finally:
        r.result.cleanup()
    return r.result
