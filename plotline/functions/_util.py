from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Accept a Column or a column name (names with dots/commas/slashes allowed)."""
    if isinstance(c, Column):
        return c
    return F.col(quote(c))


def quote(name: str) -> str:
    """Backtick-quote a column name so ``Gia/m2`` or ``NoiThat,TienNghi`` resolve."""
    return "`" + name.replace("`", "``") + "`"
