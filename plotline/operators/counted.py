"""Row losses made visible (G10): operators that drop rows and count them on the way.

Counts ride on the plan itself (``DataFrame.observe``): no extra pass, and nothing
runs until the result does.  They are read with ``Observation.get`` after the first
action; on a stream the same metrics come with every batch's progress.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions._util import quote


def keep_counted(df: DataFrame, keep: Column, name: str) -> tuple[DataFrame, Observation]:
    """Rows for which ``keep`` holds, and an observation of ``rows`` seen and ``dropped`` (null counts as dropped)."""
    seen, on = Observation(name), F.coalesce(keep, F.lit(False))
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~on).alias("dropped"))
    return counted.where(on), seen


def join_levels_counted(df: DataFrame, levels: DataFrame, key: str, name: str = "levels") -> tuple[DataFrame, Observation]:
    """J2 inner join with a fitted (key, level) table, counting the rows without a level (a null or unknown key)."""
    level = next(c for c in levels.columns if c != key)
    return keep_counted(df.join(levels, key, "left"), F.col(quote(level)).isNotNull(), name)


def index_counted(df: DataFrame, col: str, labels: DataFrame, output_col: str | None = None,
                  name: str = "labels") -> tuple[DataFrame, Observation]:
    """M1 with skip: the label index from a ``label_table``, counting rows with a null or unseen label."""
    from .encode import index_by_table
    out = output_col or f"{col}_idx"
    return keep_counted(index_by_table(df, col, labels, out, how="left"), F.col(quote(out)).isNotNull(), name)
