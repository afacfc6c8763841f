"""Projection / filter helpers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions._util import quote


def prefixed(df: DataFrame, cols: Sequence[str], prefix: str) -> DataFrame:
    """Select ``cols`` in the given order, each renamed ``prefix + name``."""
    return df.select(*[F.col(quote(c)).alias(prefix + c) for c in cols])


def where_equals(df: DataFrame, col: str, value) -> DataFrame:
    """Equality filter (pushed down to the scan by Catalyst)."""
    return df.where(F.col(quote(col)) == F.lit(value))


def sql_where_equals(df: DataFrame, view: str, col: str, value, columns: Sequence[str] = ("*",)) -> DataFrame:
    """The same filter written in SQL over a temp view."""
    df.createOrReplaceTempView(view)
    cols = ", ".join(c if c == "*" else quote(c) for c in columns)
    # the value is a bound parameter, never spliced into the SQL text
    return df.sparkSession.sql(f"SELECT {cols} FROM {quote(view)} WHERE {quote(col)} = :value",
                               args={"value": value})


def pick_rows(df: DataFrame, col: str, keys) -> DataFrame:
    """Rows whose ``col`` is among ``keys``.

    A short Python list becomes an ``IN`` predicate (pushed to the scan).  A
    DataFrame of keys becomes a left-semi join, whose strategy Spark chooses
    from the measured sizes, splitting skewed keys.
    """
    if isinstance(keys, DataFrame):
        k = keys.select(F.col(keys.columns[0]).alias(col))
        return df.join(k, col, "left_semi")
    return df.where(F.col(quote(col)).isin(list(keys)))


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """P10: names of the columns matching a regular expression (full match)."""
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.fullmatch(c)]


def sql_transform(df: DataFrame, statement: str) -> DataFrame:
    """SQL statement over ``__THIS__`` as a pipeline stage."""
    return SQLTransformer(statement=statement).transform(df)
