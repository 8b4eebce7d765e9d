"""Two fixed rounds of tracing, as a chain of relational steps (no loop).

Round 0: every transaction of the window whose in, out or primary account is
listed (a bag: a row matching k legs appears k times); transfer amounts by
(in, out) pair over that bag; the distinct transfer cards. Round 1: transfers of
the window with either end among those cards (a two-leg bag), their pair
amounts, their distinct cards and the number of them.

The round-0 cards are written to the shared checkpoint folder (one small
job) so that round 1 knows their exact number; everything else is lazy.
``extract_path`` and ``rows_path`` also write the round-0 extract and the round-1
rows once, and every consumer reads them back: one scan of the history a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..constants import AMOUNT_COL, IN_COL, OUT_COL, PRI_COL
from ..functions import predicates as P
from ..operators import semi, sets, summary
from ..session import delete_path, scratch_path
from ..sinks import write_counted


def round0_extract(history: DataFrame, cards: DataFrame, known_rows: int | None = None,
                   method: str = "auto") -> DataFrame:
    """Rows of ``history`` listed by in, out or primary account, as a bag."""
    return semi.legs_extract(history, cards, [IN_COL, OUT_COL, PRI_COL], known_rows, method)


def round1_rows(history: DataFrame, cards: DataFrame, known_rows: int | None = None,
                method: str = "auto") -> DataFrame:
    """Transfers with in or out listed: (in, out, trans_at), as a bag."""
    transfers = history.filter(P.is_transfer()).select(IN_COL, OUT_COL, AMOUNT_COL)
    return semi.legs_extract(transfers, cards, [IN_COL, OUT_COL], known_rows, method)


class TwoRounds:
    """Outputs of the two rounds. Round-0 frames are lazy; the round-0 cards are
    written (and counted) on first use of a round-1 output."""

    def __init__(self, history: DataFrame, extract: DataFrame, method: str, semantics: str,
                 cards_path: str | None = None, rows_path: str | None = None,
                 amount_type: str = summary.AMOUNT_TYPE):
        self.rows_path = rows_path
        self.amount_type = amount_type
        self._scratch: list[str] = []
        self.history = history
        self.cards_path = cards_path
        self.extract = extract                     # round-0 rows, all columns
        self.method = method
        self.semantics = semantics
        transfers0 = extract.filter(P.is_transfer())
        self.round0_pairs = summary.pair_amount(transfers0, amount_type=amount_type)  # in, out, amount
        # n_unreadable: amounts that the sums leave out
        self.round0_unreadable = summary.unreadable_amounts(transfers0, amount_type=amount_type)
        self.round0_cards = sets.endpoint_set(transfers0, [IN_COL, OUT_COL])  # card
        self._round1 = None

    def _handover(self) -> DataFrame:
        # The round-0 cards are handed over as a table (written once, counted
        # while written), so round 1 joins them with a proven size: broadcast
        # under the bound, without shuffling the window's transfers first.
        if self._round1 is None:
            spark = self.history.sparkSession
            path = self.cards_path
            if path is None:
                path = scratch_path(spark, "cards0")
                self._scratch.append(path)
            n0 = write_counted(self.round0_cards, path)
            cards0 = spark.read.parquet(path)
            if self.semantics == "set":
                transfers = (self.history.filter(P.is_transfer())
                             .select(IN_COL, OUT_COL, AMOUNT_COL))
                self._round1 = semi.touching(transfers, cards0, [IN_COL, OUT_COL], n0)
            else:
                self._round1 = round1_rows(self.history, cards0, n0, self.method)
            if self.rows_path is not None:
                self._round1.write.mode("overwrite").parquet(self.rows_path)
                self._round1 = spark.read.parquet(self.rows_path)
        return self._round1

    def cleanup(self) -> None:
        """Delete the scratch tables of these outputs; they can't be read afterwards."""
        for path in self._scratch:
            delete_path(self.history.sparkSession, path)

    @property
    def round1_rows(self) -> DataFrame:     # in, out, trans_at (a bag)
        return self._handover()

    @property
    def round1_pairs(self) -> DataFrame:    # in, out, amount
        return summary.pair_amount(self._handover(), amount_type=self.amount_type)

    @property
    def round1_unreadable(self) -> DataFrame:   # n_unreadable
        return summary.unreadable_amounts(self._handover(), amount_type=self.amount_type)

    @property
    def round1_cards(self) -> DataFrame:    # card
        return sets.endpoint_set(self._handover(), [IN_COL, OUT_COL])

    @property
    def suspect_count(self) -> DataFrame:   # n_cards
        return summary.distinct_count(self.round1_cards)


def run(history: DataFrame, cards: DataFrame, known_rows: int | None = None,
        method: str = "auto", semantics: str = "bag", cards_path: str | None = None,
        extract_path: str | None = None, rows_path: str | None = None,
        amount_type: str = summary.AMOUNT_TYPE) -> TwoRounds:
    """``history`` is already restricted to the window. ``cards_path`` is where
    the round-0 cards are handed over (a scratch folder by default).

    ``semantics="bag"`` (the jobs' behaviour) sums amounts over the bags, so a
    transfer between two listed cards counts once per matching leg;
    ``"set"`` counts each matched row once (the legs become one ``OR`` test).
    """
    if semantics not in ("bag", "set"):
        raise ValueError(f"unknown semantics {semantics!r}")
    if semantics == "set":
        extract = semi.touching(history, cards, [IN_COL, OUT_COL, PRI_COL], known_rows)
    else:
        extract = round0_extract(history, cards, known_rows, method)
    if extract_path is not None:
        extract.write.mode("overwrite").parquet(extract_path)
        extract = history.sparkSession.read.parquet(extract_path)
    return TwoRounds(history, extract, method, semantics, cards_path, rows_path, amount_type)
