"""Regressors, metrics, importances and stream scoring."""

import os

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from plotline.operators import clean as C
from plotline.operators import evaluate as V
from plotline.operators import encode as E
from plotline.operators.models import DEFAULT_PARAMS, fit_regressor
from plotline.plans.listing import fit_features, label_log
from plotline.schema import ListingColumns
from plotline.streaming import scoring as SC
from tests.conftest import SF_SMALL
from tests.listing_fixtures import TIER_SCHEMA, TIERS, listing, listing_df


@pytest.fixture(scope="module")
def data(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(
        F.log("l_extendedprice").alias("label"), "l_quantity", "l_discount", "l_tax")
    cached = E.assemble(li, ["l_quantity", "l_discount", "l_tax"], "features").cache()
    yield cached
    cached.unpersist()


def test_metrics_match_evaluator(spark, data):
    model = fit_regressor("linear", data, "features", "label")
    scored = V.predict_back_transformed(model, data, "label")
    m = V.regression_metrics(scored, "label").collect()[0]
    ev = RegressionEvaluator(labelCol="label", predictionCol="prediction")
    assert m.rmse == pytest.approx(ev.evaluate(scored), rel=1e-9)
    assert m.mae == pytest.approx(ev.evaluate(scored, {ev.metricName: "mae"}), rel=1e-9)
    assert m.r2 == pytest.approx(ev.evaluate(scored, {ev.metricName: "r2"}), rel=1e-6)


@pytest.mark.parametrize("kind", ["forest", "gbt", "tree", "isotonic"])
def test_tree_and_isotonic_models(spark, data, kind):
    model = fit_regressor(kind, data, "features", "label")
    out = model.transform(data)
    assert out.count() == data.count() and out.where(F.col("prediction").isNull()).count() == 0
    again = fit_regressor(kind, data, "features", "label").transform(data)
    assert out.select(F.sum("prediction")).collect()[0][0] == pytest.approx(
        again.select(F.sum("prediction")).collect()[0][0])          # fixed seed: deterministic
    if kind == "forest":
        assert model.getNumTrees == DEFAULT_PARAMS["forest"]["numTrees"]


def test_importances_and_selection(spark, data):
    slicer, table = V.select_features(data, "forest", "top", n_features=2, label_col="label")
    rows = table.collect()
    assert [r.name for r in rows][0] in {"l_quantity", "l_discount", "l_tax"}
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    assert len(slicer.getIndices()) == 2
    sliced = slicer.transform(data)
    assert len(sliced.select("features_slice").first()[0]) == 2
    thr, thr_table = V.select_features(data, "tree", "threshold", threshold=0.0, label_col="label")
    scores = {r.idx: r.score for r in thr_table.collect()}
    assert sorted(thr.getIndices()) == sorted(i for i, s in scores.items() if s > 0.0)


def test_batch_and_stream_scores_agree(spark, tmp_dir):
    cols = ListingColumns()
    train = listing_df(spark)
    clean, stats = C.clean_raw(train, cols, is_train=True)
    tiers = spark.createDataFrame(TIERS, TIER_SCHEMA)
    fitted = fit_features(clean, cols, tiers, index_invalid="keep", fill_missing=0.0)
    model = fit_regressor("linear", label_log(fitted.transform(clean), cols.label), "features", "label")
    new = [listing(MaTin=str(9000 + i), TongGia=None, PhongNgu=str(i % 4)) for i in range(6)]
    src = os.path.join(tmp_dir, "incoming")
    listing_df(spark, new).write.parquet(src)
    batch = SC.score_frame(listing_df(spark, new), stats, fitted, model).collect()
    sink, ckpt = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt")
    q = SC.start_scoring(spark, src, listing_df(spark, new).schema, lambda d: d, stats, fitted, model, sink, ckpt)
    q.awaitTermination()
    stream = spark.read.parquet(sink).collect()
    assert sorted((r.MaTin, round(r.prediction, 9)) for r in batch) == \
        sorted((r.MaTin, round(r.prediction, 9)) for r in stream)
    assert len(stream) == 6


def test_predicted_vs_actual_for_selected_and_typed_rows(spark):
    from plotline.schema import raw_listing_schema
    from plotline.sources import json_records_to_df
    cols = ListingColumns()
    clean, stats = C.clean_raw(listing_df(spark), cols, is_train=True)
    fitted = fit_features(clean, cols, spark.createDataFrame(TIERS, TIER_SCHEMA), index_invalid="keep",
                          fill_missing=0.0)
    model = fit_regressor("linear", label_log(fitted.transform(clean), cols.label), "features", "label")
    chosen = SC.predicted_vs_actual(listing_df(spark), stats, fitted, model, cols, keys=["1001", "1007"])
    rows = {r.MaTin: r for r in chosen.collect()}
    assert sorted(rows) == ["1001", "1007"] and rows["1001"].actual == pytest.approx(5200.0)
    assert all(r.predicted > 0 for r in rows.values())
    typed = json_records_to_df(spark, [{"MaTin": "x1", "NgayDangBan": "02/07/2022", "TongGia": None,
                                        "DienTich": "60 m²", "Tinh": "Tỉnh Một", "PhongNgu": "2"}],
                               raw_listing_schema(cols))
    one = SC.predicted_vs_actual(typed, stats, fitted, model, cols).collect()
    assert len(one) == 1 and one[0].actual is None and one[0].predicted > 0


def test_stream_restart_processes_only_new_files(spark, tmp_dir):
    cols = ListingColumns()
    clean, stats = C.clean_raw(listing_df(spark), cols, is_train=True)
    fitted = fit_features(clean, cols, spark.createDataFrame(TIERS, TIER_SCHEMA), index_invalid="keep",
                          fill_missing=0.0)
    model = fit_regressor("linear", label_log(fitted.transform(clean), cols.label), "features", "label")
    src, sink, ckpt = (os.path.join(tmp_dir, x) for x in ("in", "out", "ckpt"))
    schema = listing_df(spark).schema
    first = [listing(MaTin=f"a{i}") for i in range(3)]
    listing_df(spark, first).write.mode("append").parquet(src)
    SC.start_scoring(spark, src, schema, lambda d: d, stats, fitted, model, sink, ckpt).awaitTermination()
    second = [listing(MaTin=f"b{i}") for i in range(2)]
    listing_df(spark, second).write.mode("append").parquet(src)
    SC.start_scoring(spark, src, schema, lambda d: d, stats, fitted, model, sink, ckpt).awaitTermination()
    out = sorted(r.MaTin for r in spark.read.parquet(sink).collect())
    assert out == ["a0", "a1", "a2", "b0", "b1"]                      # resumed, nothing scored twice


def test_ranking_helpers(spark):
    from plotline.operators import profile as PR
    df = spark.createDataFrame([(0, 0.5), (1, 0.2), (2, 0.5), (3, 0.01)], "idx int, score double")
    assert [r.idx for r in PR.top_n(df, "score", 3, "idx").collect()] == [0, 2, 1]
    assert sorted(r.idx for r in PR.above_threshold(df, "score", 0.01).collect()) == [0, 1, 2]


def test_metrics_skip_unscored_rows_and_constant_labels(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.5), (None, 3.0), (4.0, None)], "y double, p double")
    m = V.regression_metrics(df, "y", "p").collect()[0]
    assert m.n == 2 and m.mae == pytest.approx(0.5) and m.rmse == pytest.approx(0.5)
    const = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, p double")
    c = V.regression_metrics(const, "y", "p").collect()[0]
    assert c.n == 2 and c.r2 is None                                   # zero variance: undefined, no error


def test_isotonic_on_many_rows_of_one_value(spark):
    from pyspark.ml.regression import IsotonicRegression
    from pyspark.sql import functions as F
    from plotline.operators.encode import assemble
    from plotline.operators.models import fit_regressor
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") % 501).cast("double")).alias("x"),
        ((F.col("id") * 37 % 101) + F.col("id") % 501 / 50).alias("label"))
    rows = assemble(df, ["x"], "features")
    got = fit_regressor("isotonic", rows).transform(rows).select("x", "prediction").distinct().collect()
    want = IsotonicRegression(featuresCol="features").fit(rows).transform(rows).select("x", "prediction").distinct()
    assert {r.x: round(r.prediction, 9) for r in got} == {r.x: round(r.prediction, 9) for r in want.collect()}
