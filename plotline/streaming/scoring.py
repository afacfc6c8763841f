"""Score listings as they arrive, with Structured Streaming.

The stream is stateless: each micro-batch is cleaned with *training*
statistics, encoded with the *fitted* feature plan (joins against the fitted
tables) and scored by a fitted model.  There is no watermark and no state,
because the operator has none.  The query has a checkpoint and every batch
writes the folder of its own number, so a restarted or failed query resumes
from its last committed batch and a repeated batch replaces itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions._util import as_col, quote
from ..operators import clean as C
from ..operators.select import pick_rows
from ..operators.evaluate import predict_back_transformed
from ..operators.models import fit_regressor
from ..plans.driver_queries import query
from ..plans.feature_queries import _clean_sql, raw_listings, raw_listings_from, tier_lookup
from ..plans.listing import FittedFeatures, ListingCleaner, ListingFit, label_log
from ..schema import DEFAULT, ListingColumns
from ..session import ensure_checkpoint_dir
from ..sources import load_pipeline, read_table, save_model


def score_frame(raw: DataFrame, stats: C.ImputeStats, fitted: FittedFeatures, model,
                cols: ListingColumns = DEFAULT, keep=None) -> DataFrame:
    """Clean → encode → score one batch; keeps the
    identifier (or the ``keep`` columns) and the price back-transformed from log space."""
    clean, _ = C.clean_raw(raw, cols, is_train=False, stats=stats)
    scored = model.transform(fitted.transform(clean))
    keep = [as_col(c) for c in (keep if keep is not None else (cols.identifier,))]
    return scored.select(*keep, F.exp("prediction").alias("prediction"))


def predicted_vs_actual(raw: DataFrame, stats: C.ImputeStats, fitted: FittedFeatures, model,
                        cols: ListingColumns = DEFAULT, keys=None) -> DataFrame:
    """Chosen listings (``keys`` = list or DataFrame of identifiers) or
    typed-in rows → (identifier, actual price, predicted price) in millions."""
    if keys is not None:
        raw = pick_rows(raw, cols.identifier, keys)
    clean, _ = C.clean_raw(raw, cols, is_train=False, stats=stats)
    return predict_listings(fitted.transform(clean), model, cols)


def predict_listings(features: DataFrame, model, cols: ListingColumns = DEFAULT, keep=()) -> DataFrame:
    """(identifier, actual price, predicted price, ``keep`` columns) of encoded listings."""
    return model.transform(features).select(
        cols.identifier, F.col(quote(cols.label)).cast("double").alias("actual"),
        F.exp("prediction").alias("predicted"), *keep)


def start_scoring(spark: SparkSession, source: str, schema, to_raw: Callable[[DataFrame], DataFrame],
                  stats: C.ImputeStats, fitted: FittedFeatures, model, sink: str, checkpoint: str,
                  cols: ListingColumns = DEFAULT, fmt: str = "parquet", glob: str | None = None,
                  max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the scoring stream over files arriving under ``source``.

    Every micro-batch is scored as a batch and replaces its own folder
    ``batch=<number>`` of the sink, so a batch that is run again after a failure
    leaves each of its rows once.
    """
    def score_batch(batch: DataFrame, number: int) -> None:
        scored = score_frame(to_raw(batch), stats, fitted, model, cols)
        scored.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.format(fmt).load(source)
    writer = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def table_source(spark: SparkSession, d: str, name: str) -> tuple[str, str | None]:
    """Folder and file filter to stream a table from: its own folder, or the one file in ``d``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return f"{d}/{name}.parquet", None
    return d, f"{name}.parquet"


def scratch_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """(sink, checkpoint) folders under the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    return f"{run}/out", f"{run}/checkpoint"


def _served_sql() -> str:
    """Every open order as cleaned for serving, with a gap of zero."""
    return (f'SELECT "MaTin", "TongGia" AS actual, 0.0::DOUBLE AS score_gap FROM ({_clean_sql(train=False)})')


@query("stream_score", _served_sql())
def stream_score(spark: SparkSession, d: str) -> DataFrame:
    """Fit on finished orders, stream the open orders through the scorer, and compare each
    streamed score with the batch score (null gap: a listing only one of them has)."""
    cols, stats, fitted, model = _fit_listing_model(spark, d)

    orders_schema = read_table(spark, d, "orders").schema
    customers = read_table(spark, d, "customer")
    nation = read_table(spark, d, "nation")

    def to_raw(orders: DataFrame) -> DataFrame:
        raw = raw_listings_from(orders, customers, nation)
        return raw.where(F.col("o_orderstatus") != "F").drop("o_orderstatus")

    sink, ckpt = scratch_paths(spark, "stream_score")
    source, glob = table_source(spark, d, "orders")
    q = start_scoring(spark, source, orders_schema, to_raw, stats, fitted, model, sink, ckpt, cols, glob=glob)
    q.awaitTermination()
    streamed = spark.read.parquet(sink).withColumnRenamed("prediction", "streamed")
    batch = predicted_vs_actual(to_raw(read_table(spark, d, "orders")), stats, fitted, model, cols)
    return batch.join(streamed, cols.identifier, "full").select(
        cols.identifier, "actual", _log_gap(F.col("predicted"), F.log("streamed")))


def _log_gap(predicted, log_score):
    return F.round(F.abs(F.log(predicted) - log_score), 6).alias("score_gap")


def _fit_listing_model(spark: SparkSession, d: str):
    """Fit imputation, features and a log-price linear model on finished orders."""
    cols = ListingColumns()
    raw = raw_listings(spark, d)
    train = raw.where(F.col("o_orderstatus") == "F").drop("o_orderstatus")
    # no standardisation step: least squares without regularisation (like the
    # tree models) gives the same predictions on scaled or unscaled features,
    # so the scaler's extra pass over the training set would buy nothing here
    with ListingFit(train, cols, tier_lookup(spark, d), index_invalid="keep", fill_missing=0.0) as fit:
        data = label_log(fit.fitted.transform(fit.clean_train), cols.label)
        model = fit_regressor("linear", data, "features", "label")
    return cols, fit.stats, fit.fitted, model


@query("batch_score", _served_sql())
def batch_score(spark: SparkSession, d: str) -> DataFrame:
    """M21 over a whole table: every open order scored, the actual price, and how far the score is
    from the model's coefficients applied to the feature vector."""
    cols, stats, fitted, model = _fit_listing_model(spark, d)
    raw = raw_listings(spark, d)
    serve = raw.where(F.col("o_orderstatus") != "F").drop("o_orderstatus")
    clean, _ = C.clean_raw(serve, cols, is_train=False, stats=stats)
    scored = predict_listings(fitted.transform(clean), model, cols, keep=["features"])
    terms = F.zip_with(vector_to_array("features"), F.array(*[F.lit(float(w)) for w in model.coefficients]),
                       lambda x, w: x * w)
    by_hand = F.aggregate(terms, F.lit(float(model.intercept)), lambda total, x: total + x)
    return scored.select(cols.identifier, "actual", _log_gap(F.col("predicted"), by_hand))


@query("saved_score", _served_sql())
def saved_score(spark: SparkSession, d: str) -> DataFrame:
    """Cleaning, features and model saved as one pipeline, loaded, and every open order scored
    with what was loaded; the gap is to the score of the pipeline in memory."""
    cols, stats, fitted, model = _fit_listing_model(spark, d)
    path = f"{scratch_paths(spark, 'saved_score')[0]}/pipeline"
    kept = PipelineModel(stages=[ListingCleaner(stats, cols), fitted, model])
    save_model(kept, path)
    loaded = load_pipeline(path)
    raw = raw_listings(spark, d)
    serve = raw.where(F.col("o_orderstatus") != "F").drop("o_orderstatus")
    now = loaded.transform(serve).select(cols.identifier, F.col(quote(cols.label)).cast("double").alias("actual"), "prediction")
    before = kept.transform(serve).select(F.col(cols.identifier).alias("__id"), F.col("prediction").alias("__before"))
    return now.join(before, F.col(cols.identifier) == F.col("__id"), "left").select(
        cols.identifier, "actual", F.round(F.abs(F.col("prediction") - F.col("__before")), 6).alias("score_gap"))


__all__ = ["batch_score", "predict_back_transformed", "predicted_vs_actual", "scratch_paths", "score_frame",
           "start_scoring"]
