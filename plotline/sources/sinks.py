"""Writers (S8–S11).

Writers go through Spark's committers (each task writes its own part file,
the job commit publishes them), so an executor lost mid-write only retries
its task.  Folder names carry a timestamp unless ``overwrite`` is set.
"""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.misc import DEFAULT_TZ


def _target(base_dir: str, stem: str, overwrite: bool, tz: str = DEFAULT_TZ) -> str:
    name = stem if overwrite else f"{stem}_{datetime.now(ZoneInfo(tz)).strftime('%Y%m%d_%H%M')}"
    return f"{base_dir.rstrip('/')}/{name}"


def write_json(df: DataFrame, base_dir: str, stem: str = "raw", overwrite: bool = False) -> str:
    """JSON-lines folder, timestamped (fails if it exists) or overwritten."""
    path = _target(base_dir, stem, overwrite)
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)
    return path


def write_csv(df: DataFrame, base_dir: str, stem: str = "url", overwrite: bool = False) -> str:
    """CSV folder with a header row."""
    path = _target(base_dir, stem, overwrite)
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)
    return path


def write_batches(df: DataFrame, path: str, order_col: str, batch_size: int = 1000, fmt: str = "json") -> str:
    """Partial outputs of ``batch_size`` keys, one partition folder per batch.

    The batch number is ``floor(key / batch_size)`` of an ordered non-negative
    numeric key: it depends on the key alone, so writing a range of keys again
    replaces only the folders of that range (dynamic partition overwrite).
    Choose ``batch_size`` for the whole key range and keep it.  Rows are dealt
    by batch first, so each folder gets few files.
    """
    out = df.withColumn("batch", F.floor(F.col(order_col) / F.lit(batch_size)).cast("bigint"))
    (out.repartition("batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch").format(fmt).save(path))
    return path


def save_model(model, path: str, overwrite: bool = True) -> str:
    """Persist any fitted MLlib model / pipeline model."""
    w = model.write()
    (w.overwrite() if overwrite else w).save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    """Always load a *fitted* pipeline as ``PipelineModel``."""
    return PipelineModel.load(path)
