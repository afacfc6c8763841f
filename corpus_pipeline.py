"""Corpus pipeline: the stages that turn ``documents`` into packed training sequences.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``.  Its result is written as
Parquet and read back as the next stage's ``docs``; all but the last return the
columns of ``documents``.  Null, empty and repeated rows are treated as the
stage's operator defines them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.llm.exact_dedup import drop_exact_copies
from plotline.llm.packing import pack_documents
from plotline.llm.pii import find_pii
from plotline.llm.quality import ACCEPT_AT, score_quality, train_quality
from plotline.llm.simhash import drop_near_copies
from plotline.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below its threshold go.

    Null and empty texts are scored as one empty passage; every other row stays as it is, repeated ones
    too, with all its columns.  Without usable labels no document is told apart: all or none stay.
    """
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = "_quality_score"
    while score in docs.columns:
        score += "_"
    return score_quality(docs, model, score_col=score).where(F.col(score) >= ACCEPT_AT).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal but for white space stays."""
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of SimHashes (3-word shingles) at most 2 bits apart stays."""
    return drop_near_copies(docs, shingle=3, max_bits=2)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers become labels, terms that disclose them are generalised or removed; ``n_chars`` follows."""
    new = {"text": F.col("pii.clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("pii.clean").cast(docs.schema["n_chars"].dataType)
    return find_pii(docs).withColumns(new).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a packed sequence.

    Null and empty texts are the end id alone, repeated rows are packed one by one, an empty table gives no rows;
    columns other than id and text are not read.
    """
    return pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

#: learned scores, fingerprints and token ids are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each result written to the shared checkpoint folder.

    An empty table gives no rows.  ``sf_dir`` holds ``documents.parquet`` and ``labels.parquet``.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
