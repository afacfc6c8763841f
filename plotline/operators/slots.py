"""Vector slots of categorical values, kept as a table (M1–M3, M5, M9).

``fit_value_table`` numbers the distinct values of any number of categorical and
array columns; ``sparse_features`` turns rows into sparse vectors by looking their
values up in that table: within the row while the table is short, by a join
otherwise.  So a vocabulary may have any size; the driver holds one count per column.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import quote
from ..session import ensure_checkpoint_dir, wide_projections
from .encode import normalise_values
from .joins import materialise_table
from .partitioning import numbered

VALUE_SCHEMA = "column string, value string, place long"
# tables of up to so many values go to every task, where a value is found by comparing it with its column's
FEW_VALUES = 4096


def _values(df: DataFrame, index_cols: Sequence[str], array_cols: Sequence[str]):
    """(column, values) structs of a row: a categorical has one value, perhaps null."""
    empty = F.array().cast("array<string>")
    return ([F.struct(F.lit(c).alias("column"), F.array(F.col(quote(c)).cast("string")).alias("values")) for c in index_cols]
            + [F.struct(F.lit(a).alias("column"), normalise_values(F.coalesce(F.col(quote(a)), empty)).alias("values"))
               for a in array_cols])


def fit_value_table(df: DataFrame, index_cols: Sequence[str], array_cols: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """``(column, value, place)`` of every value, and the number of values per column.

    Labels are placed by falling count, then value (as ``StringIndexer`` does);
    array values, dots removed, by value.  One pass counts all columns together,
    aggregated before the shuffle; the numbering is a range sort.
    """
    index_cols, array_cols = list(index_cols), list(array_cols)
    spark = df.sparkSession
    if not index_cols + array_cols:
        return spark.createDataFrame([], VALUE_SCHEMA), {}
    counts = (df.select(F.inline(F.array(*_values(df, index_cols, array_cols)))).select("column", F.explode("values").alias("value"))
              .where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    rank = F.when(F.col("column").isin(*index_cols), -F.col("n")).otherwise(F.lit(0)) if index_cols else F.lit(0)
    placed = materialise_table(numbered(counts.withColumn("rank", rank), "at", "column", "rank", "value").select("column", "value", "at"))
    firsts = {r["column"]: (r["first"], r["n"]) for r in placed.groupBy("column").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect()}           # one row per column
    first = F.create_map(*[x for c, (at, _) in firsts.items() for x in (F.lit(c), F.lit(at).cast("long"))]) if firsts else None
    values = placed.select("column", "value", (F.col("at") - (first[F.col("column")] if firsts else F.lit(0))).alias("place"))
    return values, {c: firsts.get(c, (0, 0))[1] for c in index_cols + array_cols}


def sparse_features(df: DataFrame, values: DataFrame, sizes: dict[str, int], dense_cols: Sequence[str], index_cols: Sequence[str],
                    array_cols: Sequence[str], output_col: str, index_invalid: str = "skip", handle_invalid: str = "keep",
                    one_hot: bool = False, keep_inputs: bool = True) -> DataFrame:
    """``df`` with one sparse vector per row: dense columns, label indices (or one-hot slots), value counts.

    A null or unseen label gets its column's next index (``index_invalid='keep'``),
    its row goes (``'skip'``) or the job fails (``'error'``); unseen array values are
    ignored.  A null dense value is NaN (``handle_invalid='keep'``), drops the row or
    fails alike.  One-hot slots leave out the last category, the unseen one if kept.

    With up to ``FEW_VALUES`` values each row finds its own (``_looked_up``); with
    more, values and table meet in a join (``_joined``).  Either way the vectors are
    written to the shared folder, which is also how arrays become MLlib vectors
    without leaving native code.
    """
    dense_cols, index_cols, array_cols = list(dense_cols), list(index_cols), list(array_cols)
    # first slot and last index of each column
    starts, at = {}, len(dense_cols)
    for c in index_cols:
        n = sizes[c] + (1 if index_invalid == "keep" else 0)
        starts[c], at = at, at + (max(n - 1, 0) if one_hot else 1)
    for a in array_cols:
        starts[a], at = at, at + sizes[a]
    width = at

    # tree learners read which slots hold label indices; the list has one entry per column
    nominal = [] if one_hot else [{"idx": starts[c], "name": f"{c}_idx", "num_vals": sizes[c] + (index_invalid == "keep")}
                                  for c in index_cols if sizes[c]]
    meta = {"ml_attr": {"num_attrs": width, **({"attrs": {"nominal": nominal}} if nominal else {})}}
    few = sum(sizes[c] for c in index_cols + array_cols) <= FEW_VALUES and bool(dense_cols or index_cols)
    out = (_looked_up if few else _joined)(df, values, sizes, starts, dense_cols, index_cols, array_cols, output_col, index_invalid,
                                           handle_invalid, one_hot, width, meta, keep_inputs)
    return out if keep_inputs else out.drop(*dense_cols, *index_cols, *array_cols)


def _vector(terms: Column, width: int) -> Column:
    """Terms (slot, x) in order of slots as the fields of a sparse vector."""
    return F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"),
                    F.transform(terms, lambda t: t["slot"].cast("int")).alias("indices"), terms["x"].alias("values"))


def _written(df: DataFrame) -> str:
    """``df`` as Parquet in the shared folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    with wide_projections(df.sparkSession):
        df.write.parquet(path)
    return path


def _looked_up(df, values, sizes, starts, dense_cols, index_cols, array_cols, output_col, index_invalid, handle_invalid, one_hot,
               width, meta, keep_inputs) -> DataFrame:
    """Features found within each row: the values of every column, in order of their places, are one row that all tasks get.

    Whole rows are written, so ``df`` is computed once however often the vectors are read.
    """
    columns = index_cols + array_cols
    listed = [F.array_sort(F.collect_list(F.when(F.col("column") == c, F.struct("place", "value"))))["value"] for c in columns]
    # named by number: two columns may differ in case only
    known = F.broadcast(values.agg(F.lit(0).alias("__none"), *[x.alias(f"__known_{i}") for i, x in enumerate(listed)]))
    places = {c: F.col(f"__known_{i}") for i, c in enumerate(columns)}
    inputs = [c for c in [*dense_cols, *columns] if not keep_inputs]
    kept = [f for f in df.schema.fields if f.name not in inputs and f.name != output_col]

    # one projection per step: an expression that a later step names more than once is computed once
    numbers = [F.col(quote(c)).cast("double").alias(f"__x_{i}") for i, c in enumerate(dense_cols)]
    for i, c in enumerate(index_cols):                                                       # places from 1, 0: unseen
        at = F.array_position(places[c], F.col(quote(c)).cast("string"))
        numbers.append(F.coalesce(at, F.lit(0).cast("long")).alias(f"__at_{i}"))
    for i, a in enumerate(array_cols):
        own = normalise_values(F.coalesce(F.col(quote(a)), F.array().cast("array<string>")))
        at = F.filter(F.transform(own, lambda v: F.array_position(places[a], v)), lambda at: at > 0)
        numbers.append(F.sort_array(at).alias(f"__found_{i}"))
    rows = df.crossJoin(known).select(*[F.col(quote(f.name)).alias(f"c{i}") for i, f in enumerate(kept)], *numbers)

    terms, unseen, missing = [], [], []
    for i in range(len(dense_cols)):
        x = F.col(f"__x_{i}")
        missing.append(x.isNull())
        terms.append(F.struct(F.lit(i).cast("long").alias("slot"), F.coalesce(x, F.lit(float("nan"))).alias("x")))
    for i, c in enumerate(index_cols):
        at = F.col(f"__at_{i}")
        unseen.append(at == 0)
        place = F.when(at == 0, F.lit(sizes[c]).cast("long")).otherwise(at - 1)
        if one_hot:
            last = sizes[c] - (0 if index_invalid == "keep" else 1)
            terms.append(F.struct((place + starts[c]).alias("slot"), (place < last).cast("double").alias("x")))
        else:
            terms.append(F.struct(F.lit(starts[c]).cast("long").alias("slot"), place.cast("double").alias("x")))

    def counted(found: Column, start: int) -> Column:
        return F.transform(F.array_distinct(found), lambda at: F.struct(
            (at + (start - 1)).alias("slot"), (F.size(found) - F.size(F.array_remove(found, at))).cast("double").alias("x")))

    single = F.filter(F.array(*terms), lambda t: t["x"] != 0)
    found = [counted(F.col(f"__found_{i}"), starts[a]) for i, a in enumerate(array_cols)]
    for flags, mode, what in ((unseen, index_invalid, "unseen or null label"), (missing, handle_invalid, "null feature")):
        if flags and mode in ("skip", "error"):
            flag = F.exists(F.array(*flags), lambda f: f)
            rows = rows.where(~flag if mode == "skip" else
                              F.when(flag, F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True)))
    stored = [f"c{i}" for i, f in enumerate(kept) if f.dataType != T.NullType()]
    rows = rows.select(*stored, F.concat(single, *found).alias("__terms"))
    path = _written(rows.select(*stored, _vector(F.col("__terms"), width).alias("vector")))
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept) if f.dataType != T.NullType()],
                           T.StructField("vector", VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path).select(
        *[(F.lit(None) if f.dataType == T.NullType() else F.col(f"c{i}")).alias(f.name, metadata=f.metadata) for i, f in enumerate(kept)],
        F.col("vector").alias(output_col, metadata=meta))


def _joined(df, values, sizes, starts, dense_cols, index_cols, array_cols, output_col, index_invalid, handle_invalid, one_hot,
            width, meta, keep_inputs) -> DataFrame:
    """Features by a join of values with the table, for tables of any size.

    Features depend on the input columns alone, so they are computed once per
    different input (a hash of it is the key, hot rows fold into one) and joined
    back: no row ids.
    """
    inputs = [F.col(quote(c)) for c in [*dense_cols, *index_cols, *array_cols]]
    keyed = df.withColumn("__key", F.md5(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(inputs)]))))
    inputs_once = keyed.select("__key", *inputs).dropDuplicates(["__key"])

    nothing = F.lit(None).cast("string")
    dense = [F.struct(F.lit("").alias("column"), F.array(F.struct(
        nothing.alias("value"), F.lit(i).cast("long").alias("slot"), F.col(quote(c)).cast("double").alias("x"))).alias("own"))
        for i, c in enumerate(dense_cols)]
    def counted(own: Column) -> Column:
        def one(v: Column) -> Column:
            n = F.when(v.isNull(), F.lit(1)).otherwise(F.size(own["values"]) - F.size(F.array_remove(own["values"], v)))
            return F.struct(v.alias("value"), F.lit(None).cast("long").alias("slot"), n.cast("double").alias("x"))
        return F.struct(own["column"].alias("column"), F.transform(F.array_distinct(own["values"]), one).alias("own"))

    counts = [counted(own) for own in _values(df, index_cols, array_cols)]
    pairs = inputs_once.select("__key", F.inline(F.array(*dense, *counts))).select("__key", "column", F.inline("own"))
    found = pairs.join(values, ["column", "value"], "left")

    is_label, is_dense = F.col("column").isin(*index_cols), F.col("column") == ""
    first = F.create_map(*[x for c, s in starts.items() for x in (F.lit(c), F.lit(s).cast("long"))]) if starts else F.lit(None)
    count = F.create_map(*[x for c in index_cols for x in (F.lit(c), F.lit(sizes[c]).cast("long"))]) if index_cols else F.lit(None)
    start = first[F.col("column")] if starts else F.lit(0).cast("long")
    unseen = is_label & F.col("place").isNull()
    place = F.when(unseen, count[F.col("column")] if index_cols else F.lit(0).cast("long")).otherwise(F.col("place"))
    if one_hot:
        last = (count[F.col("column")] if index_cols else F.lit(0)) - (0 if index_invalid == "keep" else 1)
        label = F.when(place < last, F.struct((start + place).alias("slot"), F.lit(1.0).alias("x")))
    else:
        label = F.struct(start.alias("slot"), place.cast("double").alias("x"))
    missing = is_dense & F.col("x").isNull()
    term = (F.when(is_dense, F.struct(F.col("slot"), F.coalesce(F.col("x"), F.lit(float("nan"))).alias("x")))
            .when(is_label, label)
            .when(F.col("place").isNotNull(), F.struct((start + F.col("place")).alias("slot"), F.col("x"))))
    terms = found.select("__key", term.alias("term"), unseen.alias("unseen"), missing.alias("missing"))
    for flag, mode, what in (("unseen", index_invalid, "unseen or null label"), ("missing", handle_invalid, "null feature")):
        if mode == "error":
            terms = terms.where(F.when(F.col(flag), F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True)))
    rows = terms.groupBy("__key").agg(F.sort_array(F.collect_list(F.when(F.col("term.x") != 0, F.col("term")))).alias("t"),
                                      F.max("unseen").alias("unseen"), F.max("missing").alias("missing"))
    if index_invalid == "skip":
        rows = rows.where(~F.col("unseen"))
    if handle_invalid == "skip":
        rows = rows.where(~F.col("missing"))
    path = _written(rows.select("__key", _vector(F.col("t"), width).alias(output_col)))
    schema = T.StructType([T.StructField("__key", T.StringType()), T.StructField(output_col, VectorUDT())])
    vectors = df.sparkSession.read.schema(schema).parquet(path).select("__key", F.col(output_col).alias(output_col, metadata=meta))
    return keyed.join(vectors, "__key").drop("__key")


def slot_names(values: DataFrame, sizes: dict[str, int], dense_names: Sequence[str], index_cols: Sequence[str],
               array_cols: Sequence[str], index_invalid: str, one_hot: bool = False) -> DataFrame:
    """``(slot, name)`` of every vector slot, as a table."""
    spark = values.sparkSession
    rows = list(dense_names)
    for c in index_cols:
        n = sizes[c] + (1 if index_invalid == "keep" else 0)
        if one_hot and n - 1 > 0:
            rows.append((c, n - 1))
        elif not one_hot:
            rows.append(f"{c}_idx")
    named, at = [], 0
    for r in rows:
        if isinstance(r, tuple):
            named.append((at, r[0], r[1]))
            at += r[1]
        else:
            named.append((at, r, 0))
            at += 1
    fixed = spark.createDataFrame(named, "at long, name string, n long")
    wide = fixed.where("n > 0").select("at", "name", F.explode(F.expr("sequence(0L, n - 1)")).alias("i"))
    out = (fixed.where("n = 0").select(F.col("at").alias("slot"), "name")
           .unionByName(wide.select((F.col("at") + F.col("i")).alias("slot"), F.concat("name", F.lit("_ohe_"), "i").alias("name"))))
    for a in array_cols:
        own = values.where(F.col("column") == a)
        out = out.unionByName(own.select((F.col("place") + at).alias("slot"), F.concat(F.lit(f"{a}_"), "value").alias("name")))
        at += sizes[a]
    return out
