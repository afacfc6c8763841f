"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: white space of every word rule here: space and U+0009 to U+000D
SPACE_CLASS = r"[\x20\x09-\x0D]"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared checkpoint folder and read it back.

    The written table cuts the lineage: a lost executor costs no recomputation
    before this point, joins see real sizes, and joins on a hot key keep an
    exchange on both sides, so adaptive execution can split the hot partition.
    The folder is the one named by ``spark.checkpoint.dir``; its owner clears it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/plotline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._plotline_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the table behind a ``cut`` frame that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._plotline_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str) -> Column:
    """The text column as a string, null counting as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(modulus)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _send_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per context."""
    sc = spark.sparkContext
    if not getattr(sc, "_plotline_sent", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(prefix="plotline-"), "plotline_package.zip")
        with zipfile.ZipFile(name, "w") as z:
            for folder, _, files in os.walk(package):
                for f in files:
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        z.write(path, os.path.relpath(path, os.path.dirname(package)))
        sc.addPyFile(name)
        sc._plotline_sent = True


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors.

    Batches are bounded in bytes by ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """
    _send_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_groups(groups: GroupedData, fn: Callable, schema) -> DataFrame:
    """``groups.applyInPandas`` with this package on the executors, for groups of bounded size."""
    _send_package(groups.session)
    return groups.applyInPandas(fn, schema)
