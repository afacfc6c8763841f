"""Scoring, metrics and feature-importance selection."""

from __future__ import annotations

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exp_back
from .models import fit_regressor


def predict_back_transformed(model, df: DataFrame, label_col: str,
                             prediction_col: str = "prediction") -> DataFrame:
    """Score, then map label and prediction back from log space (e^x)."""
    scored = model.transform(df)
    return scored.withColumns({label_col: exp_back(label_col),
                               prediction_col: exp_back(prediction_col)})


def regression_metrics(df: DataFrame, label_col: str, prediction_col: str = "prediction") -> DataFrame:
    """RMSE, MAE and R² in ONE aggregate pass (nothing collected but
    the one-row result).  R² = 1 − SS_res / SS_tot with SS_tot = n·var_pop(y)."""
    y, p = F.col(label_col), F.col(prediction_col)
    err = y - p
    pairs = df.where(y.isNotNull() & p.isNotNull())       # metrics over scored, labelled rows only
    agg = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("ss_res"),
                    F.sum(F.abs(err)).alias("sae"), F.var_pop(y).alias("var_y"))
    n = F.col("n").cast("double")
    return agg.select(
        F.col("n").cast("bigint").alias("n"),
        F.sqrt(F.try_divide(F.col("ss_res"), n)).alias("rmse"),
        F.try_divide(F.col("sae"), n).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.col("ss_res"), F.col("var_y") * n)).alias("r2"),
    )


def feature_attributes(df: DataFrame, features_col: str) -> list[tuple[int, str]]:
    """(index, name) of every slot of an assembled vector, from its ML metadata."""
    meta = df.schema[features_col].metadata.get("ml_attr", {})
    out = []
    for group in meta.get("attrs", {}).values():
        out += [(a["idx"], a.get("name", f"f{a['idx']}")) for a in group]
    named = {i for i, _ in out}
    return sorted(out + [(i, f"f{i}") for i in range(meta.get("num_attrs", 0)) if i not in named])


def feature_importances(model, df: DataFrame, features_col: str) -> DataFrame:
    """Importance per feature slot with its name, highest first.

    The table has one row per feature (bounded by the vector width), built
    from the fitted model and the vector metadata.
    """
    imp = model.featureImportances
    attrs = feature_attributes(df, features_col) or [(i, f"f{i}") for i in range(imp.size)]
    rows = [(int(i), name, float(imp[int(i)])) for i, name in attrs]
    schema = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("name", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("score"), F.asc("idx"))


def select_features(df: DataFrame, kind: str = "forest", selector: str = "top", n_features: int = 20,
                    threshold: float = 0.01, features_col: str = "features", label_col: str = "label",
                    output_col: str = "features_slice", **params) -> tuple[VectorSlicer, DataFrame]:
    """Fit a tree model, rank importances, and return a ``VectorSlicer``
    keeping the top ``n_features`` (selector='top') or those scoring above
    ``threshold`` (selector='threshold'), plus the importance table."""
    model = fit_regressor(kind, df, features_col, label_col, **params)
    table = feature_importances(model, df, features_col)
    if selector == "top":
        chosen = table.orderBy(F.desc("score"), F.asc("idx")).limit(n_features)
    elif selector == "threshold":
        chosen = table.where(F.col("score") > F.lit(threshold))
    else:
        raise ValueError("selector must be 'top' or 'threshold'")
    indices = sorted(r["idx"] for r in chosen.collect())
    return VectorSlicer(inputCol=features_col, outputCol=output_col, indices=indices), table
