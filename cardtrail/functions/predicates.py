"""Row predicates of the tracing jobs, as Spark Columns (JVM-side, pushed down
where the source allows).

Dates are ``yyyyMMdd`` strings compared as strings, never parsed: some bounds
used in practice (``20160931``) are not real dates.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DATE_COL, KIND_COL, NON_CONSUMPTION_KINDS, SUCCESS_FLAGS, TRANSFER_KIND


def _lit(v) -> Column:
    # Bounds are compared as strings even when given as numbers: an unquoted
    # number would cast the column instead.
    return F.lit(str(v))


def date_closed(begin, end, col: str = DATE_COL) -> Column:
    """``begin <= pdate <= end``."""
    return (F.col(col) >= _lit(begin)) & (F.col(col) <= _lit(end))


def date_half_open(begin, end, col: str = DATE_COL) -> Column:
    """``begin <= pdate < end``."""
    return (F.col(col) >= _lit(begin)) & (F.col(col) < _lit(end))


def date_window(begin=None, end=None, end_inclusive: bool = True, col: str = DATE_COL) -> Column:
    """Either bound may be open (None)."""
    cond = F.lit(True)
    if begin is not None:
        cond = cond & (F.col(col) >= _lit(begin))
    if end is not None:
        cond = cond & ((F.col(col) <= _lit(end)) if end_inclusive else (F.col(col) < _lit(end)))
    return cond


def date_ranges(ranges: Iterable[tuple], col: str = DATE_COL) -> Column:
    """Union of closed ranges: ``(b1 <= pdate <= e1) or (b2 <= pdate <= e2) ...``,
    within the range from the first to the last, which can be pushed as it is."""
    ranges = list(ranges)
    if not ranges:
        return F.lit(False)
    cond = F.lit(False)
    for b, e in ranges:
        cond = cond | date_closed(b, e, col)
    return date_closed(min(b for b, _ in ranges), max(e for _, e in ranges), col) & cond


def nonblank(*cols: str) -> Column:
    """Every column is non-blank after trimming spaces; null fails (3-valued logic)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (F.trim(F.col(c)) != F.lit(""))
    return cond


def not_null_nor_empty(*cols: str) -> Column:
    """``c is not null and c != ''`` for each column, without trimming."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & (F.col(c) != F.lit(""))
    return cond


def successful() -> Column:
    """The three success flags."""
    cond = F.lit(True)
    for c, v in SUCCESS_FLAGS:
        cond = cond & (F.col(c) == F.lit(v))
    return cond


def is_transfer(col: str = KIND_COL) -> Column:
    return F.col(col) == F.lit(TRANSFER_KIND)


def is_consumption(col: str = KIND_COL) -> Column:
    """Neither of the non-consumption kinds; a null kind fails."""
    cond = F.lit(True)
    for k in NON_CONSUMPTION_KINDS:
        cond = cond & (F.col(col) != F.lit(k))
    return cond
