"""Join helpers.

No side is hinted for a broadcast: Spark's own threshold takes file-backed
dimensions whose scans are proven small, and adaptive execution decides from
measured shuffle sizes for everything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def materialise_table(df: DataFrame) -> DataFrame:
    """Compute a derived table once and cut its lineage (reliable checkpoint
    into the session's shared checkpoint folder)."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lookup_join(fact: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Fact ⟕ dimension; the dimension's size decides the join strategy."""
    return fact.join(dim, on, how)


def join_group_counts(df: DataFrame, key: str, count_col: str = "count") -> DataFrame:
    """Attach each row's group size (inner join, so null keys drop out).

    Counting first collapses a hot key to one row (partial aggregation); the
    counts are materialised so the join reads a scan on both sides, which
    lets adaptive execution split the hot key's partition of ``df``.
    """
    counts = materialise_table(df.groupBy(key).agg(F.count(F.lit(1)).alias(count_col)))
    return df.join(counts, key, "inner")
