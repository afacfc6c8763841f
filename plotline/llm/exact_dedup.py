"""Exact dedup by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, cut, text_of

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text without white space (space and U+0009 to U+000D)."""
    return F.regexp_replace(text, SPACE_CLASS, "")


def _signature(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    norm = src.select("id", F.char_length("t").alias("n_cp"), normalised(F.col("t")).alias("norm"))
    return norm.select("id", "n_cp", F.char_length("norm").alias("norm_len"),
                       F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"), "norm")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: ``id, norm_len, prefix, full_hash, keep_id, group_size, kept``.

    Texts are equal when identical without white space.  Candidates shrink level
    by level on narrow rows: (1) rows whose normalised length occurs once are
    single, (2) of the rest those whose length and prefix hash occur once, and
    (3) only rows surviving both are read again for a hash of the full text
    (SHA-256, ``full_hash``; null for the others).  Length and hash counts are
    aggregated map-side; the joins on a hot length, prefix or hash have an
    exchange on both sides, so adaptive execution splits the hot group.

    Of equal texts the row with the most code points in the original text stays,
    then the smallest id, null ids last.  Null text counts as empty, and all
    empty texts are one group.  Of rows alike in id, length and text exactly one
    is kept.  A null id stays null in ``id`` (and in ``keep_id`` when such a row
    is the one that stays).  An empty table gives an empty result; other columns
    are not read.
    """
    return _marked(docs, id_col, text_col, prefix_chars).drop("n_cp")


def _marked(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """``exact_dedup`` with the code points of each original text as ``n_cp``."""
    keys = cut(_signature(docs, id_col, text_col, prefix_chars).drop("norm"))
    lengths = cut(keys.groupBy("norm_len").agg(F.count("*").alias("n")).where("n > 1").select("norm_len"))
    level1 = keys.join(lengths, "norm_len", "left_semi")
    level2 = cut(level1.groupBy("norm_len", "prefix").agg(F.count("*").alias("n"))
                 .where("n > 1").select("norm_len", "prefix"))

    single = keys.join(level2, ["norm_len", "prefix"], "left_anti").select(
        "id", "n_cp", "norm_len", "prefix", F.lit(None).cast("string").alias("full_hash"),
        F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))

    full = _signature(docs, id_col, text_col, prefix_chars).join(level2, ["norm_len", "prefix"], "left_semi")
    # rows alike in id, length and text are one row with a count from here on
    rows = cut(full.select("id", "n_cp", "norm_len", "prefix", F.sha2("norm", 256).alias("full_hash"))
               .groupBy("full_hash", "norm_len", "prefix", "id", "n_cp").agg(F.count("*").alias("m")))
    order = F.struct((-F.col("n_cp")).alias("o"), F.col("id").isNull().alias("z"), F.col("id").alias("id"))
    best = cut(rows.groupBy("full_hash").agg(F.min(order).alias("best"), F.sum("m").alias("group_size")))
    won = (F.col("best.o") == -F.col("n_cp")) & F.col("best.id").eqNullSafe(F.col("id"))
    copies = rows.join(best, "full_hash").select(
        "id", "n_cp", "norm_len", "prefix", "full_hash", F.col("best.id").alias("keep_id"), "group_size",
        won.alias("won"), F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("k"))
    copies = copies.withColumn("kept", F.col("won") & (F.col("k") == 1)).drop("won", "k")
    return single.unionByName(copies)


def with_digest(docs: DataFrame, result: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Add ``text_sha256`` to every row of a result: single rows, whose full text the
    operator never hashed, get theirs here by their (unique) length and prefix."""
    result = cut(result)
    sig = _signature(docs, id_col, text_col, prefix_chars).select(
        "norm_len", "prefix", F.sha2("norm", 256).alias("sha"))
    alone = result.where("full_hash is null").join(sig, ["norm_len", "prefix"])
    return (alone.withColumn("text_sha256", F.col("sha")).drop("sha")
            .unionByName(result.where("full_hash is not null").withColumn("text_sha256", F.col("full_hash"))))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with the columns of ``docs``.

    Copies are found by the operator; the rows that stay are fetched by id, code
    points and full hash, or, where the operator needed no full hash, by the length
    and prefix that no other text has; the full text is hashed for the former only.
    One row is taken per kept (id, text): rows alike in id, length and text count
    once.  Columns of any name are passed on.  An empty table gives an empty result.
    """
    kept = cut(_marked(docs, id_col, text_col, PREFIX_CHARS).where("kept")
               .select(F.col("id").alias("_keep_id"), F.col("n_cp").alias("_keep_cp"), F.col("norm_len").alias("_keep_len"),
                       F.col("prefix").alias("_keep_prefix"), F.col("full_hash").alias("_keep_hash")))
    # the caller's columns travel in one struct, so none of their names can meet the ones used here
    taken = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), normalised(text_of(text_col)).alias("_n"),
                        F.char_length(text_of(text_col)).alias("_cp"))
    tagged = taken.withColumns({"_len": F.char_length("_n"), "_prefix": F.xxhash64(F.substring("_n", 1, PREFIX_CHARS))})
    match = (F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_len") == F.col("_keep_len"))
             & (F.col("_prefix") == F.col("_keep_prefix")) & (F.col("_cp") == F.col("_keep_cp"))
             & (F.col("_keep_hash").isNull() | (F.sha2("_n", 256) == F.col("_keep_hash"))))
    found = tagged.join(kept, match).dropDuplicates(["_keep_id", "_keep_cp", "_keep_len", "_keep_prefix", "_keep_hash"])
    return found.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
