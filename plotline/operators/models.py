"""Regressors (M12–M16) with the hyper-parameters of the published models.

All estimators are MLlib's distributed ones: tree learners aggregate split
statistics per partition and merge them (no data goes through the driver).
"""

from __future__ import annotations

from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, IsotonicRegression,
                                   LinearRegression, RandomForestRegressor)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# --- fixed values: hyper-parameters of the saved models --------------------
# random forest: 20 trees, depth 5, 32 bins
# gradient-boosted trees: 20 iterations, step 0.1, depth 5
# decision tree: depth 5
# isotonic regression: increasing, feature index 0
# ---------------------------------------------------------------------------
DEFAULT_PARAMS = {
    "linear": {},
    "forest": {"numTrees": 20, "maxDepth": 5, "maxBins": 32},
    "gbt": {"maxIter": 20, "stepSize": 0.1, "maxDepth": 5, "maxBins": 32},
    "tree": {"maxDepth": 5, "maxBins": 32},
    "isotonic": {"isotonic": True, "featureIndex": 0},
}

_ESTIMATORS = {
    "linear": LinearRegression,
    "forest": RandomForestRegressor,
    "gbt": GBTRegressor,
    "tree": DecisionTreeRegressor,
    "isotonic": IsotonicRegression,
}


def make_regressor(kind: str, features_col: str = "features", label_col: str = "label",
                   prediction_col: str = "prediction", seed: int | None = 42, **params):
    """An unfitted estimator of ``kind`` (linear, forest, gbt, tree, isotonic)."""
    cls = _ESTIMATORS[kind]
    p = dict(DEFAULT_PARAMS[kind])
    p.update(params)
    est = cls(featuresCol=features_col, labelCol=label_col, predictionCol=prediction_col, **p)
    if seed is not None and est.hasParam("seed"):
        est = est.setSeed(seed)
    return est


def fit_regressor(kind: str, df: DataFrame, features_col: str = "features", label_col: str = "label",
                  prediction_col: str = "prediction", seed: int | None = 42, **params):
    """Fit a regressor; GBT checkpoints its lineage every 10 iterations in the
    session's checkpoint folder so a lost executor does not replay all rounds.
    Seeded sampling follows the input's partitions: the caller deals them out
    (``by_key``) where the model must not depend on how files were split."""
    if kind == "gbt" and df.sparkSession.sparkContext.getCheckpointDir():
        params.setdefault("checkpointInterval", 10)
    est = make_regressor(kind, features_col, label_col, prediction_col, seed, **params)
    data = df.select(features_col, label_col)
    if kind == "isotonic":
        data, est = _one_row_per_value(data, features_col, label_col, est), est.setWeightCol("weight")
    return est.fit(data)


def _one_row_per_value(df: DataFrame, features_col: str, label_col: str, est) -> DataFrame:
    """(feature value, mean label, number of rows): the isotonic fit of these
    weighted rows is that of all rows, and a value holding a large share of the
    rows never becomes one task's array."""
    x = F.col(features_col)
    if isinstance(df.schema[features_col].dataType, VectorUDT):
        x = vector_to_array(x)[est.getFeatureIndex()]
    return (df.select(x.cast("double").alias(features_col), F.col(label_col).cast("double").alias(label_col))
            .groupBy(features_col).agg(F.avg(label_col).alias(label_col),
                                       F.count(label_col).cast("double").alias("weight"))
            .where(F.col("weight") > 0))
