"""Readers (S1–S7) and the driver-table loader."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DEFAULT, ListingColumns, raw_listing_schema

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder (``<dir>/<name>.parquet``)."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def read_listing_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
                      cols: ListingColumns = DEFAULT) -> DataFrame:
    """Multi-line JSON (one array per file) with an explicit schema, so no
    inference pass reads the data twice."""
    return (spark.read.option("multiLine", True)
            .schema(schema or raw_listing_schema(cols)).json(path))


def json_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON arrays as ``file, element`` (its place), ``value`` (its text).

    Files are read in byte ranges, so one large array is read by many tasks: text is
    cut after every ``}``, and whether a piece begins inside a string, and how deep,
    follows from sums over the pieces before it (first in each range, then over one
    row per range).  An object ends where no brace is open.  Elements other than
    objects, and empty arrays, give no rows; several arrays or objects in one file
    are read one after the other; a cut-off object at the end is returned as it is.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("i"), "value")
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    so_far = Window.partitionBy("file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def count(text, char: str):
        return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))

    def opened(text):
        return count(F.regexp_replace(text, r'"[^"]*+(?:"|\z)', ""), "{")

    quoted = pieces.select("file", "block", "i", "value", count(bare, '"').alias("quotes"), opened(bare).alias("open_0"),
                           opened(F.concat(F.lit('"'), bare)).alias("open_1"))
    quoted = quoted.withColumn("run", F.sum("quotes").over(so_far))

    def delta(start: int):
        """Change of depth over a piece and the brace after it, for a range that begins inside (1) or outside (0) a string."""
        begins, ends = (F.col("run") - F.col("quotes") + start) % 2, (F.col("run") + start) % 2
        return F.when(begins == 1, F.col("open_1")).otherwise(F.col("open_0")) - (1 - ends)

    quoted = quoted.withColumns({"d_0": delta(0), "d_1": delta(1)})
    ranges = quoted.groupBy("file", "block").agg(F.sum("quotes").alias("q"), F.sum("d_0").alias("d_0"), F.sum("d_1").alias("d_1"))
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("q").over(blocks), F.lit(0)) % 2)
    ranges = ranges.withColumn("d", F.when(F.col("inside") == 1, F.col("d_1")).otherwise(F.col("d_0")))
    ranges = ranges.select("file", "block", "inside", F.coalesce(F.sum("d").over(blocks), F.lit(0)).alias("depth"))

    deep = quoted.join(ranges, ["file", "block"])
    step = F.when(F.col("inside") == 1, F.col("d_1")).otherwise(F.col("d_0"))
    closes = (F.col("depth") + F.sum(step).over(so_far) == 0) & ((F.col("run") + F.col("inside")) % 2 == 0)
    ended = deep.select("file", "block", "i", "value", closes.cast("long").alias("last"))
    before = ended.groupBy("file", "block").agg(F.sum("last").alias("n")).select(
        "file", "block", F.coalesce(F.sum("n").over(blocks), F.lit(0)).alias("before"))
    placed = ended.withColumn("k", F.sum("last").over(so_far) - F.col("last")).join(before, ["file", "block"])
    whole = placed.groupBy("file", (F.col("before") + F.col("k")).alias("element")).agg(
        F.sort_array(F.collect_list(F.struct("block", "i", "value"))).alias("p"), F.max("last").alias("closed"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.when(F.col("closed") == 1, "}").otherwise(""))
    return (whole.select("file", "element", F.regexp_replace(text, r"^[^{]*+", "").alias("value"))
            .where(F.col("value") != ""))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | None = None,
                    cols: ListingColumns = DEFAULT) -> DataFrame:
    """S1 for arrays larger than a task should read: same rows as ``read_listing_json``, read in byte ranges."""
    return parse_json_column(json_array_elements(spark, path), "value", schema or raw_listing_schema(cols))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON-lines (inferred schema unless one is given)."""
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             infer: bool = True) -> DataFrame:
    """S3: CSV with a header; types inferred unless a schema is given."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer).csv(path)


def read_lookup(spark: SparkSession, path: str,
                schema: T.StructType | str | None = None) -> DataFrame:
    """CSV dimension; Spark broadcasts it when its files are within the session's threshold."""
    return read_csv(spark, path, schema, infer=schema is None)


def rows_to_df(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    """In-memory rows with an explicit schema (small, driver-side inputs only)."""
    return spark.createDataFrame(list(rows), schema)


def json_records_to_df(spark: SparkSession, records: Sequence[dict], schema: T.StructType) -> DataFrame:
    """JSON records (e.g. one submitted form) → typed rows via ``from_json``."""
    texts = spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in records], "value string")
    return parse_json_column(texts, "value", schema)


def parse_json_column(df: DataFrame, col: str, schema: T.StructType) -> DataFrame:
    """S6 (distributed form): a string column of JSON objects → struct fields."""
    return df.select(F.from_json(F.col(col), schema).alias("__r")).select("__r.*")


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Expose a DataFrame to SQL under ``name``."""
    df.createOrReplaceTempView(name)
    return df
