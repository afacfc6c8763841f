"""Composite listing plans: cleaning (N12) and feature extraction (M9).

``fit_features`` learns every data-dependent piece once — seller activity
levels, label indices, multi-hot vocabularies — and returns a
``FittedFeatures`` whose ``transform`` is pure DataFrame code, usable on a
training set or a scoring batch (a stream is scored batch by batch), and which
can be saved, alone or with cleaning and model as one ``PipelineModel``.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import StorageLevel
from pyspark.ml import Model, PipelineModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions._util import quote
from ..operators import clean as C
from ..operators import encode as E
from ..operators.slots import fit_value_table, slot_names, sparse_features
from ..schema import DEFAULT, ListingColumns
from ..session import wide_projections

__all__ = ["FittedFeatures", "ListingCleaner", "ListingFit", "clean_listings", "fit_features", "label_log"]


def clean_listings(train: DataFrame, serve: DataFrame | None = None, cols: ListingColumns = DEFAULT):
    """N12 with a fit/transform split: statistics come from ``train`` only.

    Returns (clean_train, clean_serve or None, stats).  Serving rows keep an
    unparseable or missing label (``is_train=False``).
    """
    clean_train, stats = C.clean_raw(train, cols, is_train=True)
    clean_serve = None
    if serve is not None:
        clean_serve, _ = C.clean_raw(serve, cols, is_train=False, stats=stats)
    return clean_train, clean_serve, stats


class _TableWriter(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        settings, tables, models = self.stage._state()
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.stage, path, spark, extraMetadata={"settings": settings, "tables": sorted(tables)})
        for name, df in tables.items():
            df.write.parquet(f"{path}/tables/{name}")
        for name, model in models.items():
            model.write().save(f"{path}/models/{name}")


class _TableReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        tables = {n: spark.read.parquet(f"{path}/tables/{n}") for n in meta["tables"]}
        stage = self.kind._from_state(meta["settings"], tables, path)
        stage._resetUid(meta["uid"])
        return stage


class _TableStage(Model, MLWritable, MLReadable):
    """A fitted pipeline stage whose state is a few settings and Parquet tables."""

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class ListingCleaner(_TableStage):
    """The serving half of N12 with fitted statistics (rows without a label stay)."""

    def __init__(self, stats: C.ImputeStats, cols: ListingColumns = DEFAULT):
        super().__init__()
        self.stats, self.cols = stats, cols

    def _transform(self, df: DataFrame) -> DataFrame:
        return C.clean_raw(df, self.cols, is_train=False, stats=self.stats)[0]

    def _state(self):
        spark = SparkSession.active()
        kinds = {"mean": self.stats.means, "mode": self.stats.modes, "constant": self.stats.constants}
        rows = [(k, c, json.dumps(v)) for k, own in kinds.items() for c, v in own.items()]
        fills = spark.createDataFrame(rows, "kind string, column string, value string")
        return {"cols": asdict(self.cols), "arrays": list(self.stats.arrays)}, {"fills": fills}, {}

    @classmethod
    def _from_state(cls, settings, tables, path):
        by_kind: dict[str, dict] = {"mean": {}, "mode": {}, "constant": {}}
        for r in tables["fills"].collect():                     # one row per column
            by_kind[r["kind"]][r["column"]] = json.loads(r["value"])
        stats = C.ImputeStats(by_kind["mean"], by_kind["mode"], by_kind["constant"], tuple(settings["arrays"]))
        return cls(stats, _columns_from(settings["cols"]))


def _columns_from(d: dict) -> ListingColumns:
    return ListingColumns(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})


class FittedFeatures(_TableStage):
    """The fitted feature plan (M9): seller levels, label places and vocabularies are tables.

    ``transform`` takes a batch; a stream goes through it batch by batch (see
    ``streaming.scoring``).  Save it alone or as a stage of a ``PipelineModel``.
    """

    def __init__(self, cols: ListingColumns, levels: DataFrame | None, tiers: DataFrame | None, values: DataFrame,
                 sizes: dict[str, int], index_cols, arrays, adm_cols=(), numeric_cols=(), handle_invalid: str = "keep",
                 index_invalid: str = "skip", output_col: str = "features", fill_missing: float | None = None,
                 one_hot: bool = False, scaler=None):
        super().__init__()
        self.cols, self.levels, self.tiers, self.values, self.sizes = cols, levels, tiers, values, sizes
        self.index_cols, self.arrays, self.adm_cols, self.numeric_cols = index_cols, arrays, tuple(adm_cols), tuple(numeric_cols)
        self.handle_invalid, self.index_invalid, self.output_col = handle_invalid, index_invalid, output_col
        self.fill_missing, self.one_hot, self.scaler = fill_missing, one_hot, scaler

    @property
    def level_col(self) -> str | None:
        return f"{self.cols.seller}_level" if self.levels is not None else None

    def _transform(self, df: DataFrame) -> DataFrame:
        """M6 → M7 → M1 (→ M2) → M5 → M8 on any batch of clean listings."""
        c, out = self.cols, df
        adm = []
        if self.levels is not None:
            out = E.apply_activity_levels(out, self.levels, c.seller, keep_input=False, how="left", default_level=0.0)
            adm.append(self.level_col)
        out = E.administrative_ordinals(out, self.tiers, c.province, c.district, c.ward)
        adm += [f"{a}_idx" for a in self.adm_cols]
        numeric = [f"__num_{i}" for i in range(len(self.numeric_cols))]
        out = out.select("*", *[F.col(quote(x)).cast("double").alias(n) for x, n in zip(self.numeric_cols, numeric)])
        if self.fill_missing is not None and numeric + adm:   # an unmatched ordinal becomes an explicit level
            out = out.fillna(float(self.fill_missing), subset=[*numeric, *adm])
        out = sparse_features(out, self.values, self.sizes, [*numeric, *adm], self.index_cols, self.arrays, self.output_col,
                              self.index_invalid, self.handle_invalid, self.one_hot, keep_inputs=False)
        return self.scaler.transform(out) if self.scaler is not None else out

    def slot_table(self) -> DataFrame:
        """``(slot, name)`` of every vector slot."""
        dense = [*self.numeric_cols, *([self.level_col] if self.levels is not None else []), *[f"{a}_idx" for a in self.adm_cols]]
        return slot_names(self.values, self.sizes, dense, self.index_cols, self.arrays, self.index_invalid, self.one_hot)

    def slot_names(self) -> list[str]:
        """Name of every vector slot, in order, for reports on plans of a known width."""
        return [r["name"] for r in self.slot_table().orderBy("slot").collect()]

    def _state(self):
        tables = {"values": self.values}
        tables |= {n: t for n, t in (("levels", self.levels), ("tiers", self.tiers)) if t is not None}
        settings = {"cols": asdict(self.cols), "sizes": self.sizes, "scaled": self.scaler is not None} | {
            n: getattr(self, n) for n in ("index_cols", "arrays", "adm_cols", "numeric_cols", "handle_invalid", "index_invalid",
                                          "output_col", "fill_missing", "one_hot")}
        return settings, tables, {"scaler": self.scaler} if self.scaler is not None else {}

    @classmethod
    def _from_state(cls, settings, tables, path):
        s = dict(settings)
        scaler = StandardScalerModel.load(f"{path}/models/scaler") if s.pop("scaled") else None
        return cls(_columns_from(s.pop("cols")), tables.get("levels"), tables.get("tiers"), tables["values"], s.pop("sizes"),
                   scaler=scaler, **s)


def fit_features(train: DataFrame, cols: ListingColumns = DEFAULT, tiers: DataFrame | None = None,
                 handle_invalid: str = "keep", index_invalid: str = "skip",
                 output_col: str = "features", fill_missing: float | None = None,
                 standardize: bool = False, standardized_col: str = "standardized",
                 numeric_cols=(), one_hot: bool = False) -> FittedFeatures:
    """Fit M6 levels, M1 places and M3 vocabularies on clean training rows;
    with ``standardize`` also an M11 scaler on the assembled vector (output
    ``standardized_col``, divided by the sample standard deviation).
    ``numeric_cols`` adds continuous columns to the vector as they are; the
    source's plan assembles none (only level, ordinals, indices, amenities).
    With ``one_hot`` the label indices enter the vector one-hot encoded (M2)."""
    present = set(train.columns)
    levels = None
    if cols.seller in present:
        levels = E.fit_activity_levels(train, cols.seller, level_col=f"{cols.seller}_level")   # materialised
    index_cols = [x for x in cols.indexed_categoricals if x in present]
    arrays = [a for a in cols.arrays if a in present]
    values, sizes = fit_value_table(train, index_cols, arrays)
    adm_cols = tuple(a for a in (cols.province, cols.district, cols.ward)
                     if a in present and (a != cols.province or tiers is not None))
    fitted = FittedFeatures(cols, levels, tiers, values, sizes, index_cols, arrays, adm_cols,
                            tuple(c for c in numeric_cols if c in present), handle_invalid, index_invalid, output_col,
                            fill_missing, one_hot)
    if standardize:
        fitted.scaler = E.fit_standard_scaler(fitted.transform(train), output_col, standardized_col)
    return fitted


class ListingFit:
    """Fit everything a listing model needs, computing the training rows once.

    ``with ListingFit(raw_train, cols, tiers) as fit:`` persists the prepared
    training rows (memory, spilling to disk) for the duration of the block,
    so imputation statistics, activity levels, label indices, vocabularies
    and any model fitted inside the block read them from the cache instead of
    re-deriving them from the sources (each re-derivation repeats the fact ⋈
    customer shuffle); the cache is released on exit.  ``storage_level``
    may be ``DISK_ONLY`` for a training set larger than executor memory, or
    ``None`` to recompute instead of caching.  Executor loss only drops
    cached blocks, which Spark recomputes.
    """

    def __init__(self, raw_train: DataFrame, cols: ListingColumns = DEFAULT, tiers: DataFrame | None = None,
                 storage_level: StorageLevel | None = StorageLevel.MEMORY_AND_DISK, **feature_opts):
        self.storage_level = storage_level
        self.cols = cols
        self.prepared = C.prepare_for_imputation(raw_train, cols)
        self.tiers = tiers
        self.feature_opts = feature_opts
        self.stats: C.ImputeStats | None = None
        self.fitted: FittedFeatures | None = None
        self.clean_train: DataFrame | None = None

    def __enter__(self) -> "ListingFit":
        if self.storage_level is not None:
            self.prepared.persist(self.storage_level)
        try:
            with wide_projections(self.prepared.sparkSession):
                self.stats = C.fit_imputer(self.prepared, self.cols)
                self.clean_train = C.finish_clean(self.prepared, self.stats, self.cols, is_train=True)
                self.fitted = fit_features(self.clean_train, self.cols, self.tiers, **self.feature_opts)
        except BaseException:
            self.prepared.unpersist()
            raise
        return self

    def __exit__(self, *exc) -> None:
        self.prepared.unpersist()

    def pipeline(self, model) -> PipelineModel:
        """Cleaning, features and a fitted model as one pipeline that can be saved and loaded."""
        return PipelineModel(stages=[ListingCleaner(self.stats, self.cols), self.fitted, model])

    def clean(self, raw: DataFrame, is_train: bool = False) -> DataFrame:
        """Clean any other batch or stream with the fitted statistics."""
        return C.clean_raw(raw, self.cols, is_train=is_train, stats=self.stats)[0]


def label_log(df: DataFrame, label_col: str, out_col: str = "label") -> DataFrame:
    """Model label: natural log of the price (back-transformed by M17).

    Only rows with a positive price can be training rows (log of 0 is undefined)."""
    price = F.col(quote(label_col)).cast("double")
    return df.where(price > 0).withColumn(out_col, F.log(price))
