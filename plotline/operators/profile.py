"""Dashboard aggregates and ordered reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money_text


def totals(df: DataFrame, price_col: str, scale: float = 1000.0) -> DataFrame:
    """Row count, mean price × scale (rounded) and its display text."""
    avg = F.avg(price_col)
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                  F.bround(avg * F.lit(scale), 0).cast("bigint").alias("avg_price_scaled"),
                  money_text(avg, scale).alias("avg_price_text"))


def group_counts(df: DataFrame, keys: Sequence[str], count_col: str = "n") -> DataFrame:
    """Rows per group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias(count_col))


def group_mean(df: DataFrame, keys: Sequence[str], value_col: str, out_col: str = "avg_value",
               digits: int | None = None) -> DataFrame:
    """Mean of a value per group."""
    avg = F.avg(value_col)
    return df.groupBy(*keys).agg((F.round(avg, digits) if digits is not None else avg).alias(out_col))


def group_share(df: DataFrame, keys: Sequence[str], count_col: str = "n",
                share_col: str = "share", digits: int | None = None) -> DataFrame:
    """Group size and its share of all rows.

    The grand total is a scalar subquery over the grouped result: no window
    over all rows (which would pull them into one partition) and no cross join.
    """
    counts = group_counts(df, keys, count_col)
    share = F.col(count_col) / counts.agg(F.sum(count_col)).scalar()
    return counts.withColumn(share_col, F.round(share, digits) if digits is not None else share)


def top_by_count(df: DataFrame, key: str, k: int = 1, count_col: str = "n") -> DataFrame:
    """The ``k`` most frequent values (ties → smallest value first)."""
    return (group_counts(df.where(F.col(key).isNotNull()), [key], count_col)
            .orderBy(F.desc(count_col), F.asc(key)).limit(k))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows after an explicit order (deterministic)."""
    return df.orderBy(*order_by).limit(n)


def top_n(df: DataFrame, score_col: str, n: int, tie_col: str) -> DataFrame:
    """Descending score, tie-broken, first ``n``."""
    return df.orderBy(F.desc(score_col), F.asc(tie_col)).limit(n)


def above_threshold(df: DataFrame, score_col: str, threshold: float) -> DataFrame:
    """T5: rows with score strictly above the threshold."""
    return df.where(F.col(score_col) > F.lit(threshold))
