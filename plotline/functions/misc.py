"""Clock, back-transform, ordinal keyword rules and display formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# --- fixed values: default clock zone --------------------------------------
DEFAULT_TZ = "Asia/Ho_Chi_Minh"
# ---------------------------------------------------------------------------


def current_time(tz: str = DEFAULT_TZ) -> Column:
    """wall-clock time in ``tz`` as a zone-less timestamp (evaluated once
    per query), whatever the session time zone is."""
    local = F.current_timestamp().cast("timestamp_ntz")          # wall clock in the session zone
    return F.convert_timezone(F.current_timezone(), F.lit(tz), local)


def exp_back(c) -> Column:
    """log-space value → original scale (e^x)."""
    return F.exp(as_col(c))


def ordinal_by_keywords(c, rules: Sequence[tuple[str, int]], lower: bool = True) -> Column:
    """F16: first rule whose keyword the text contains gives the ordinal; null otherwise.

    Rules are tested in order, so a longer keyword must come before any
    keyword it contains (``'III'`` before ``'II'`` before ``'I'``).
    """
    col = as_col(c)
    if lower:
        col = F.lower(col)
    out = None
    for kw, val in rules:
        cond = col.contains(kw.lower() if lower else kw)
        out = F.when(cond, F.lit(val)) if out is None else out.when(cond, F.lit(val))
    return out


def money_text(c, scale: float = 1000.0) -> Column:
    """number × scale, rounded half-to-even to a whole number (as
    Python's ``round``), with thousands separators."""
    return F.format_number(F.bround(as_col(c) * F.lit(scale), 0), 0)
