"""Missing-data handling, unit stripping and the typed-cast stage.

Statistics (means, modes) are *fitted once* on training data and then reused
for any later batch or stream, so a one-row serving batch is imputed with the
same values as the training set.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (area_number, length_number, price_per_m2_to_millions,
                         price_to_millions, try_double, try_float, try_int)
from ..functions._util import quote
from ..schema import DEFAULT, ListingColumns

# --- fixed values: text that means "no value" ------------------------------
SENTINELS = ("--", "")
# ---------------------------------------------------------------------------


def _q(name: str) -> Column:
    return F.col(quote(name))


def _select_replacing(df: DataFrame, replacements: dict[str, Column]) -> DataFrame:
    """One projection that rewrites some columns in place, order kept."""
    return df.select(*[replacements[c].alias(c) if c in replacements else _q(c)
                       for c in df.columns])


def count_nulls(df: DataFrame, cols=None) -> DataFrame:
    """One row, one BIGINT per column = number of nulls (single scan)."""
    cols = list(cols or df.columns)
    return df.agg(*[F.count_if(_q(c).isNull()).cast("bigint").alias(c) for c in cols])


def count_nulls_long(df: DataFrame, cols=None, name_col: str = "column",
                     value_col: str = "n_null") -> DataFrame:
    """N1 transposed: (column, n_null) rows."""
    wide = count_nulls(df, cols)
    return wide.unpivot([], [quote(c) for c in wide.columns], name_col, value_col)


def blank_to_null(df: DataFrame, cols=None, sentinels=SENTINELS) -> DataFrame:
    """Sentinel text (``'--'``, ``''``) → null, in string columns only."""
    string_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = [c for c in (cols or df.columns) if c in string_cols]
    return _select_replacing(df, {
        c: F.when(_q(c).isin(*sentinels), F.lit(None).cast("string")).otherwise(_q(c))
        for c in targets})


def strip_units(df: DataFrame, cols: ListingColumns = DEFAULT) -> DataFrame:
    """F1–F4 over the listing roles: prices → millions (double), areas and
    lengths → numbers, year → int.  Unparseable text becomes null."""
    rep: dict[str, Column] = {}
    present = set(df.columns)
    if cols.label in present:
        rep[cols.label] = price_to_millions(cols.label)
    if cols.price_per_m2 in present:
        rep[cols.price_per_m2] = price_per_m2_to_millions(cols.price_per_m2)
    for a in (cols.area, cols.land_area):
        if a in present:
            rep[a] = try_double(area_number(a))
    for length in cols.lengths:
        if length in present:
            rep[length] = try_double(length_number(length))
    if cols.year in present:
        rep[cols.year] = try_int(cols.year)
    return _select_replacing(df, rep)


def area_fallback(df: DataFrame, cols: ListingColumns = DEFAULT) -> DataFrame:
    """Missing area is taken from land area."""
    if cols.area in df.columns and cols.land_area in df.columns:
        return _select_replacing(df, {cols.area: F.coalesce(_q(cols.area), _q(cols.land_area))})
    return df


@dataclass
class ImputeStats:
    """Fitted imputation values."""
    means: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    constants: dict = field(default_factory=dict)
    arrays: tuple = ()

    def fill_values(self) -> dict:
        out = dict(self.constants)
        out.update(self.modes)
        out.update(self.means)
        return out


def column_mode(df: DataFrame, col: str):
    """Most frequent non-null value; ties go to the smallest value.

    Counted with a distributed ``groupBy`` (partial aggregation, no single
    task holds all values) and reduced with a top-1 ordered take.
    """
    row = (df.select(_q(col).alias("v")).where(F.col("v").isNotNull())
           .groupBy("v").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.asc("v")).limit(1).collect())
    return row[0]["v"] if row else None


def fit_imputer(df: DataFrame, cols: ListingColumns = DEFAULT) -> ImputeStats:
    """Fit means and modes on ``df`` with ONE scan.

    ``df`` is expected after ``strip_units`` and ``area_fallback``.  Means are
    decomposable, so a single grouped aggregate keyed by each mode column
    (grouping sets, partially aggregated before the shuffle) yields per-value
    row counts *and* per-value partial sums; the shuffled result has one row
    per distinct mode value, not one per input row.  Means are then summed
    from the groups of one grouping set, and each mode is a top-1 ordered take
    over its groups (ties to the smallest value).
    """
    present = set(df.columns)
    mean_cols = [c for c in cols.mean_filled if c in present]
    mode_cols = [c for c in cols.mode_filled if c in present]
    means, modes = {}, {}
    if mode_cols:
        n = len(mode_cols)
        parts = [F.count(F.lit(1)).alias("__n"), F.grouping_id().alias("__gid")]
        for i, c in enumerate(mean_cols):
            parts += [F.sum(_q(c)).alias(f"__s{i}"), F.count(_q(c)).alias(f"__c{i}")]
        groups = (df.groupingSets([[_q(m)] for m in mode_cols], *[_q(m) for m in mode_cols])
                  .agg(*parts).persist())
        try:
            gid = {m: sum(1 << (n - 1 - j) for j in range(n) if j != k) for k, m in enumerate(mode_cols)}
            if mean_cols:
                row = (groups.where(F.col("__gid") == gid[mode_cols[0]])
                       .agg(*[(F.sum(f"__s{i}") / F.sum(f"__c{i}")).alias(c) for i, c in enumerate(mean_cols)])
                       .collect()[0])
                means = {c: row[c] for c in mean_cols if row[c] is not None}
            for m in mode_cols:
                top = (groups.where((F.col("__gid") == gid[m]) & _q(m).isNotNull())
                       .orderBy(F.desc("__n"), F.asc(_q(m))).limit(1).collect())
                if top:
                    modes[m] = top[0][m]
        finally:
            groups.unpersist()
    elif mean_cols:
        row = df.agg(*[F.avg(_q(c)).alias(c) for c in mean_cols]).collect()[0]
        means = {c: row[c] for c in mean_cols if row[c] is not None}
    constants = {c: cols.default_category for c in cols.categoricals if c in present}
    constants.update({c: v for c, v in cols.constant_fills.items() if c in present})
    arrays = tuple(c for c in cols.arrays if c in present)
    return ImputeStats(means=means, modes=modes, constants=constants, arrays=arrays)


def apply_imputer(df: DataFrame, stats: ImputeStats) -> DataFrame:
    """Fill with fitted values in one projection."""
    rep: dict[str, Column] = {}
    types = {f.name: f.dataType for f in df.schema.fields}
    for c, v in stats.fill_values().items():
        # a text constant fills text columns only (a numeric column is left
        # as it is, like ``fillna`` does), so no cast can fail under ANSI
        if c in types and not (isinstance(v, str) and not isinstance(types[c], T.StringType)):
            rep[c] = F.coalesce(_q(c), F.lit(v).cast(types[c]))
    for c in stats.arrays:
        if c in types:
            rep[c] = F.coalesce(_q(c), F.array().cast(types[c]))
    return _select_replacing(df, rep)


def empty_arrays_for_null(df: DataFrame, cols) -> DataFrame:
    """Null array → typed empty array."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return _select_replacing(df, {c: F.coalesce(_q(c), F.array().cast(types[c]))
                                  for c in cols if c in types})


def drop_incomplete(df: DataFrame, required, drop_cols=()) -> DataFrame:
    """Drop rows missing any required field, then drop columns."""
    cond = None
    for c in required:
        cond = _q(c).isNotNull() if cond is None else cond & _q(c).isNotNull()
    out = df.where(cond) if cond is not None else df
    return out.drop(*[c for c in drop_cols if c in out.columns])


def drop_records(df: DataFrame, cols: ListingColumns = DEFAULT, is_train: bool = True) -> DataFrame:
    """N8 for listings: identifier and post date always required, label when training."""
    required = [cols.identifier, cols.post_date] + ([cols.label] if is_train else [])
    return drop_incomplete(df, [c for c in required if c in df.columns], cols.dropped_after_clean)


def type_cast(df: DataFrame, cols: ListingColumns = DEFAULT) -> DataFrame:
    """Continuous columns → float, year → int, never raising."""
    rep = {c: try_float(c) for c in cols.float_columns if c in df.columns}
    if cols.year in df.columns:
        rep[cols.year] = try_int(cols.year)
    return _select_replacing(df, rep)


def fill_numeric_zero(df: DataFrame) -> DataFrame:
    """``fillna(0)`` on numeric columns only; strings and arrays untouched."""
    return df.fillna(0)


def fill_with_mean(df: DataFrame, col: str) -> DataFrame:
    """Fill a numeric column with its mean."""
    mean = df.agg(F.avg(_q(col))).collect()[0][0]
    if mean is None:
        return df
    return _select_replacing(df, {col: F.coalesce(_q(col), F.lit(mean).cast(df.schema[col].dataType))})


def prepare_for_imputation(df: DataFrame, cols: ListingColumns = DEFAULT) -> DataFrame:
    """N2 → F1–F4 → N6: everything before statistics are needed."""
    return area_fallback(strip_units(blank_to_null(df, [c for c in df.columns if c not in cols.arrays]),
                                     cols), cols)


def clean_raw(df: DataFrame, cols: ListingColumns = DEFAULT, is_train: bool = True,
              stats: ImputeStats | None = None) -> tuple[DataFrame, ImputeStats]:
    """N2 → F1–F4 → N6 → impute (N3–N5, N7) → N8 → P12.

    When ``stats`` is given (serving), nothing is fitted.  In training mode
    the statistics are fitted on the prepared rows; rows without a label are
    dropped after the cast so unparseable prices never become labels.
    """
    prepared = prepare_for_imputation(df, cols)
    if stats is None:
        stats = fit_imputer(prepared, cols)
    return finish_clean(prepared, stats, cols, is_train), stats


def finish_clean(prepared: DataFrame, stats: ImputeStats, cols: ListingColumns = DEFAULT,
                 is_train: bool = True) -> DataFrame:
    """The part of N12 after statistics exist: impute → cast → drop."""
    return drop_records(type_cast(apply_imputer(prepared, stats), cols), cols, is_train)
