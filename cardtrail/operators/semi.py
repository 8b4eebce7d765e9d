"""Semi joins against card lists: single legs, multi-leg bags, and the
"row touches the list" existence test.

A card list is broadcast only behind a checked size: when its row count is
known (``known_rows``) and under ``session.broadcast_row_limit``. Otherwise no
hint is given and AQE chooses from runtime statistics (a broadcast when the
measured shuffle output is small, else a shuffled join with skew splitting of
hot card keys on the history side).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CARD, PRI_COL
from ..functions import predicates as P
from ..session import broadcast_row_limit

_KEY = "__ct_card"
_LEG = "__ct_leg"


def card_keys(cards: DataFrame, known_rows: int | None = None, name: str = _KEY) -> DataFrame:
    """The card list renamed to a private column, broadcast if its size is known
    to be small."""
    keys = cards.select(F.col(CARD).alias(name))
    if known_rows is not None:
        limit = broadcast_row_limit(cards.sparkSession)
        if known_rows <= limit:
            return F.broadcast(keys)
    return keys


def semi_join(df: DataFrame, cards: DataFrame, on: str,
              known_rows: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``on`` value is listed (``left semi join``).

    Duplicates in the list never multiply rows; a null ``on`` never matches.
    """
    keys = card_keys(cards, known_rows)
    return df.join(keys, F.col(on) == F.col(_KEY), "left_semi")


def legs_extract(df: DataFrame, cards: DataFrame, legs: Sequence[str],
                 known_rows: int | None = None, method: str = "auto") -> DataFrame:
    """Bag union of one semi join per leg: a row matching k legs appears k times.

    ``method="explode"`` scans ``df`` once: each row is repeated once per non-null
    leg value, then one semi join keeps the listed ones. ``method="union"`` is the
    literal ``UNION ALL`` of one semi join per leg (one scan per leg): its keys are
    columns of the scan, so that runtime filters made from the list can reach it
    before the shuffle. ``"auto"`` explodes under the broadcast bound, where nothing
    is shuffled, and unites beyond it, as it must for a list of unknown size.
    """
    if method == "auto":
        method = "explode" if _broadcastable(cards, known_rows) or df.isStreaming else "union"
    if method == "union":
        out = None
        for leg in legs:
            part = semi_join(df, cards, leg, known_rows)
            out = part if out is None else out.unionAll(part)
        return out
    if method != "explode":
        raise ValueError(f"unknown method {method!r}")
    keys = card_keys(cards, known_rows)
    cols = df.columns
    values = F.filter(F.array(*[F.col(c) for c in legs]), lambda v: v.isNotNull())
    rep = df.select("*", F.explode(values).alias(_LEG))
    return rep.join(keys, F.col(_LEG) == F.col(_KEY), "left_semi").select(*cols)


def _broadcastable(cards: DataFrame, known_rows: int | None) -> bool:
    return known_rows is not None and known_rows <= broadcast_row_limit(cards.sparkSession)


def touching(df: DataFrame, cards: DataFrame, cols: Sequence[str],
             known_rows: int | None = None) -> DataFrame:
    """Rows with any of ``cols`` listed, each row once (``c1 IN list OR c2 IN
    list``); no row id or dedup is needed, so duplicate history rows stay
    duplicates.

    A list of checked small size is broadcast and the test is a chain of hash
    existence joins over one scan. Otherwise the rows are split into disjoint
    legs: listed by ``c1``; listed by ``c2`` but not by ``c1``; and so on. Each leg
    is a semi join of a scan first (one shuffle of the history, less what runtime
    filters drop) and anti joins of its few matches after. AQE can split the hot
    keys of semi and anti joins across tasks (it cannot split an existence join),
    so a hub account does not stall one task.
    """
    if _broadcastable(cards, known_rows):
        keys = card_keys(cards, known_rows)
        cond = F.lit(False)
        for c in cols:
            cond = cond | F.col(c).isin(keys)
        return df.filter(cond)
    out = None
    for i, c in enumerate(cols):
        keys = card_keys(cards, None)
        hit = df.join(keys, F.col(c) == F.col(_KEY), "left_semi")
        for earlier in cols[:i]:
            hit = hit.join(keys, F.col(earlier) == F.col(_KEY), "left_anti")
        out = hit if out is None else out.unionAll(hit)
    return out


def consumption_of(df: DataFrame, cards: DataFrame, pri: str = PRI_COL,
                   known_rows: int | None = None) -> DataFrame:
    """Consumption (kind neither S25 nor S33) of listed cards."""
    return semi_join(df.filter(P.is_consumption()), cards, pri, known_rows)


def all_of(df: DataFrame, cards: DataFrame, pri: str = PRI_COL,
           known_rows: int | None = None) -> DataFrame:
    """Every transaction of listed cards."""
    return semi_join(df, cards, pri, known_rows)
