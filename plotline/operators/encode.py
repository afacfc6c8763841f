"""Feature encoders.

Every learned encoder is split into ``fit_*`` (one distributed job that
learns a small state: labels, vocabulary, group counts) and a transform made
of narrow column expressions or a join, so the same fitted state serves
training, batch scoring and streaming.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (Binarizer, Bucketizer, CountVectorizerModel, OneHotEncoder,
                                StandardScaler, StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordinal_by_keywords
from ..functions._util import quote
from .joins import materialise_table
from .partitioning import numbered

# --- fixed values ----------------------------------------------------------
# seller activity bins: [0,2) [2,5) [5,8) [8,16) [16,inf)
ACTIVITY_SPLITS = (0.0, 2.0, 5.0, 8.0, 16.0, float("inf"))
# province tier keywords → ordinal, tested in this order, case-sensitive
TIER_RULES = (("Đặc biệt", 4), ("III", 3), ("II", 2), ("I", 1))
# district keywords (lower-cased) → ordinal
DISTRICT_RULES = (("tp", 3), ("quận", 3), ("thị xã", 2), ("huyện", 1))
# ward keywords (lower-cased) → ordinal
WARD_RULES = (("phường", 3), ("thị trấn", 2), ("xã", 1))
# ---------------------------------------------------------------------------


# --- M1 / M2: label index and one-hot --------------------------------------

def fit_label_indexer(df: DataFrame, cols: Sequence[str], suffix: str = "_idx",
                      handle_invalid: str = "skip") -> PipelineModel:
    """M1: index each column by descending frequency (ties alphabetical).

    One multi-column indexer counts the labels of every column in a single
    pass over the data (not one scan per column).  Returned as a one-stage
    ``PipelineModel`` so it persists and loads like any fitted pipeline.
    """
    stage = StringIndexer(inputCols=list(cols), outputCols=[c + suffix for c in cols],
                          handleInvalid=handle_invalid, stringOrderType="frequencyDesc")
    return Pipeline(stages=[stage]).fit(df)


def index_labels(model: PipelineModel, col_position: int = 0) -> list[str]:
    """Fitted labels of one indexed column, most frequent first."""
    return [list(labels) for stage in model.stages for labels in stage.labelsArray][col_position]


def label_table(df: DataFrame, col: str) -> DataFrame:
    """M1 as a table: one ``(label, idx)`` row per label of ``col``, most frequent first, ties by label.

    For label sets of any size: labels never reach the driver or a single task.
    """
    counts = df.where(F.col(quote(col)).isNotNull()).groupBy(F.col(quote(col)).cast("string").alias("label")).count()
    return numbered(counts, "idx", F.desc("count"), F.asc("label")).select("label", F.col("idx").cast("double").alias("idx"))


def index_by_table(df: DataFrame, col: str, labels: DataFrame, output_col: str | None = None,
                   how: str = "inner") -> DataFrame:
    """``df`` with the index of ``col`` from a ``label_table``; rows with a null or unseen label go
    (``how='left'``: they stay, with a null index)."""
    found = labels.select(F.col("label").alias("__label"), F.col("idx").alias(output_col or f"{col}_idx"))
    return df.join(found, F.col(quote(col)).cast("string") == F.col("__label"), how).drop("__label")


def fit_one_hot(df: DataFrame, input_cols: Sequence[str], output_cols: Sequence[str] | None = None,
                drop_last: bool = True, handle_invalid: str = "error"):
    """M2: one-hot of index columns (last level dropped by default)."""
    output_cols = list(output_cols or [c.replace("_idx", "_ohe") if "_idx" in c else c + "_ohe"
                                       for c in input_cols])
    return OneHotEncoder(inputCols=list(input_cols), outputCols=output_cols, dropLast=drop_last,
                         handleInvalid=handle_invalid).fit(df)


def vector_columns(df: DataFrame, vec_col: str, names: Sequence[str]) -> DataFrame:
    """Expand a vector column into named double columns (for inspection/SQL)."""
    arr = vector_to_array(F.col(vec_col))
    return df.select("*", *[arr[i].alias(n) for i, n in enumerate(names)]).drop(vec_col)


# --- M3 / M4 / M5: multi-hot counts of array values ------------------------

def normalise_values(arr: Column) -> Column:
    """F8 on every element, null elements removed (a null is not a category)."""
    return F.transform(F.filter(arr, lambda x: x.isNotNull()), lambda x: F.regexp_replace(x, r"\.", ""))


def count_value(arr: Column, value: str) -> Column:
    """Occurrences of ``value`` in an array (elements removed by ``array_remove``)."""
    return F.size(arr) - F.size(F.array_remove(arr, F.lit(value)))


@dataclass
class MultiHotVocab:
    """Sorted vocabulary per array column (M3 'auto' fit, or given for M4)."""
    vocab: dict

    def width(self) -> int:
        return sum(len(v) for v in self.vocab.values())


def fit_multi_hot(df: DataFrame, cols: Sequence[str]) -> MultiHotVocab:
    """M3 fit for the wide form: distinct normalised values of every array column in ONE job.

    Each row contributes (column, value) pairs; ``distinct`` shuffles only
    the de-duplicated pairs (map-side partial aggregation).  The wide form makes a
    column of every value, so its values are names on the driver; the feature
    plan keeps them in a table instead (``slots.fit_value_table``).
    """
    per_col = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("c"),
                 normalise_values(F.coalesce(F.col(quote(c)), F.array().cast("array<string>"))).alias("vs"))
        for c in cols])))
    distinct = per_col.select("c", F.explode("vs").alias("v")).distinct()
    vocab = {c: [] for c in cols}
    for r in distinct.collect():
        vocab[r["c"]].append(r["v"])
    return MultiHotVocab({c: sorted(v) for c, v in vocab.items()})


def multi_hot_columns(df: DataFrame, col: str, vocab: Sequence[str], prefix: str | None = None,
                      keep_input: bool = False) -> DataFrame:
    """M3/M4 transform, wide form: one BIGINT count column per vocabulary word.

    Values outside the vocabulary are ignored; a word absent from a row is 0;
    a repeated value counts 2+.  No row id and no join: one projection.
    Each column scans the row's array once, so the wide form is for small
    vocabularies; ``multi_hot_vectors`` counts every value in one pass into a
    sparse vector.
    """
    prefix = f"{col}_" if prefix is None else prefix
    norm = normalise_values(F.coalesce(F.col(quote(col)), F.array().cast("array<string>")))
    outs = [count_value(norm, w).cast("bigint").alias(prefix + w) for w in vocab]
    kept = [F.col(quote(c)) for c in df.columns if keep_input or c != col]
    return df.select(*kept, *outs)


def multi_hot_vectors(df: DataFrame, vocab: MultiHotVocab, suffix: str = "_ohe",
                      output_col: str | None = "features_ohe", keep_input: bool = False) -> DataFrame:
    """M5: every array column → sparse count vector (CountVectorizer with the
    fitted vocabulary), optionally assembled into one vector."""
    out = df
    vec_cols = []
    for c, words in vocab.vocab.items():
        tmp = f"__norm_{len(vec_cols)}"
        out = out.withColumn(tmp, normalise_values(
            F.coalesce(F.col(quote(c)), F.array().cast("array<string>"))))
        vec = c + suffix
        if not words:  # nothing seen in training: the column adds no feature
            out = out.drop(tmp) if keep_input else out.drop(tmp, c)
            continue
        cv = CountVectorizerModel.from_vocabulary(list(words), inputCol=tmp, outputCol=vec)
        out = cv.transform(out).drop(tmp)
        vec_cols.append(vec)
        if not keep_input:
            out = out.drop(c)
    if output_col:
        out = VectorAssembler(inputCols=vec_cols, outputCol=output_col).transform(out).drop(*vec_cols)
    return out


def values_long(df: DataFrame, id_col: str, col: str, value_col: str = "value") -> DataFrame:
    """F18 + F8: one row per (id, normalised value); a null or empty array
    keeps its row with a null value (``explode_outer``)."""
    exploded = df.select(id_col, F.explode_outer(F.col(quote(col))).alias(value_col))
    return exploded.select(id_col, F.regexp_replace(value_col, r"\.", "").alias(value_col))


def value_crosstab(df: DataFrame, id_col: str, col: str, vocab: Sequence[str] | None = None) -> DataFrame:
    """A4: contingency table id × value (counts), one column per value.

    Each row's counts are computed in place (no explode), then summed per id
    in ONE partially-aggregated shuffle — the same table as
    ``groupBy(id).pivot(value).count()``, which needs two aggregations.  Ids
    with no non-null value do not appear (as in a pivot); null is not a
    column.  Without ``vocab`` the values are fitted first (one job).
    """
    if vocab is None:
        vocab = fit_multi_hot(df, [col]).vocab[col]
    norm = normalise_values(F.coalesce(F.col(quote(col)), F.array().cast("array<string>")))
    rows = df.select(id_col, norm.alias("__vs")).where(F.size("__vs") > 0)
    return rows.groupBy(id_col).agg(*[F.sum(count_value(F.col("__vs"), v)).cast("bigint").alias(v) for v in vocab])


# --- M6: seller activity level ---------------------------------------------

def fit_activity_levels(df: DataFrame, key: str, splits=ACTIVITY_SPLITS,
                        level_col: str | None = None, materialise: bool = True) -> DataFrame:
    """M6 fit: rows per key → bucket index.  Returns a (key, level) table.

    ``groupBy().count()`` is partially aggregated before the shuffle, so a
    hot key costs one row per map task, not a hot partition.  The table is
    fitted state, so it is materialised (reliable checkpoint in the shared
    folder): joining it back then reads a plain scan, which is what lets
    adaptive execution split a hot key's partition on the fact side (its
    skew-join rule does not apply when an aggregate sits under the join).
    """
    level_col = level_col or f"{key}_level"
    counts = df.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    b = Bucketizer(splits=list(splits), inputCol="__n", outputCol=level_col, handleInvalid="keep")
    levels = b.transform(counts).drop("__n")
    return materialise_table(levels) if materialise else levels


def apply_activity_levels(df: DataFrame, levels: DataFrame, key: str, keep_input: bool = False,
                          how: str = "inner", default_level: float | None = None) -> DataFrame:
    """M6 transform / J2: attach levels by key.

    Training uses ``how='inner'`` (rows with a null key drop out, as in the
    source); serving uses ``how='left'`` with ``default_level`` for unseen keys.

    Adaptive execution decides on the join: a broadcast when the measured
    level table is small, or a split of the hot key's partition (skew join)
    when it is not.
    """
    level_col = [c for c in levels.columns if c != key][0]
    out = df.join(levels, key, how)
    if default_level is not None:
        out = out.withColumn(level_col, F.coalesce(F.col(level_col), F.lit(float(default_level))))
    return out if keep_input else out.drop(key)


# --- M7: administrative ordinals -------------------------------------------

def administrative_ordinals(df: DataFrame, tiers: DataFrame | None = None, province: str = "Tinh",
                            district: str = "Huyen", ward: str = "Xa", tier_col: str = "PhanLoaiTinh",
                            keep_input: bool = False) -> DataFrame:
    """M7: province tier (lookup join) and district / ward keyword ordinals."""
    out = df
    made = []
    if tiers is not None and province in df.columns:
        out = out.join(tiers.select(province, tier_col), province, "left")
        out = out.withColumn(f"{province}_idx", ordinal_by_keywords(tier_col, TIER_RULES, lower=False))
        out = out.drop(tier_col)
        made.append(province)
    if district in df.columns:
        out = out.withColumn(f"{district}_idx", ordinal_by_keywords(district, DISTRICT_RULES))
        made.append(district)
    if ward in df.columns:
        out = out.withColumn(f"{ward}_idx", ordinal_by_keywords(ward, WARD_RULES))
        made.append(ward)
    return out if keep_input else out.drop(*made)


# --- M8 / M10 / M11 ----------------------------------------------------------

def assemble(df: DataFrame, input_cols: Sequence[str], output_col: str,
             handle_invalid: str = "error") -> DataFrame:
    """M8: columns → one vector (``handle_invalid``: error / skip / keep)."""
    return VectorAssembler(inputCols=list(input_cols), outputCol=output_col,
                           handleInvalid=handle_invalid).transform(df)


def binarize(df: DataFrame, col: str, threshold: float, output_col: str) -> DataFrame:
    """1.0 when value > threshold, else 0.0."""
    return Binarizer(threshold=float(threshold), inputCol=col, outputCol=output_col).transform(df)


def fit_standard_scaler(df: DataFrame, input_col: str, output_col: str = "standardized",
                        with_mean: bool = False, with_std: bool = True):
    """Divide by the sample standard deviation (optionally centre)."""
    return StandardScaler(inputCol=input_col, outputCol=output_col, withMean=with_mean,
                          withStd=with_std).fit(df)
