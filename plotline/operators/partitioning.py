"""Partition layout of inputs that are read many times, and order without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by a hash of ``keys`` to ``spark.sql.shuffle.partitions`` partitions.

    For learners that pass over their input often: the layout depends on the
    rows and the session's setting only, not on files or on the number of cores.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ordered_places(df: DataFrame, *order: str | Column) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``df`` sorted by range over all partitions, with each row's partition and place in it.

    The frame (keep it narrow) is written to the shared checkpoint folder, so
    partitions and places stay as they are when executors are lost.  The list
    gives each partition that has rows, in order, with its row count.
    """
    ensure_checkpoint_dir(df.sparkSession)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.orderBy(*order).select("*", F.spark_partition_id().alias("__part"), place.alias("__place")).checkpoint()
    counts = placed.groupBy("__part").count().orderBy("__part").collect()       # one row per partition
    return placed, [(r["__part"], r["count"]) for r in counts]


def numbered(df: DataFrame, number_col: str, *order: str | Column) -> DataFrame:
    """``df`` with ``number_col`` 0, 1, 2 … in the given (total) order, without passing through one task."""
    placed, counts = ordered_places(df, *order)
    starts, before = [], 0
    for part, n in counts:
        starts += [F.lit(part), F.lit(before).cast("long")]
        before += n
    start = F.create_map(*starts)[F.col("__part")] if starts else F.lit(None).cast("long")
    return placed.select(*df.columns, (start + F.col("__place")).alias(number_col))
