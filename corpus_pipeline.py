"""The corpus pipeline: quality, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of ``documents``.
Every stage works on all that the one before kept.  ``run`` writes each stage's rows as Parquet to the shared folder
that the cluster names in spark.checkpoint.dir and reads them again, so a lost executor never reaches back further
than the stage it worked on.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.llm import exact, minhash, packing, quality, secrets
from dqloom.llm.common import checkpoint_folder, labelled, read

QUALITY_LEAST = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are mostly good; the labels of every fifth document are never learned from.

    Texts are scored whole, each row by itself, so repeated rows share their fate; null and empty texts get the score
    of a text without lines.  Without labels of both kinds all documents have the same score.  An empty table gives an
    empty one; further columns are passed on.
    """
    model = quality.fit(labelled(docs, read(spark, sf_dir, "labels"), "quality", 5, 0, quality.SAMPLE))
    return quality.keep_good(docs, model, QUALITY_LEAST)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, compared whole, the row with the largest doc_id.

    Null texts count as empty and equal each other; of rows that repeat the largest doc_id one stays; null identifiers
    lose against others.  An empty table gives an empty one; further columns are passed on.
    """
    return exact.drop_copies(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id.

    Rows go by their own identifier and text: another text under a repeated identifier is not lost, and rows that
    repeat the staying document stay with it.  Null, empty and blank texts and null identifiers are kept.  Whole texts
    are compared.  An empty table gives an empty one; further columns are passed on.
    """
    return minhash.drop_near(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked in the whole text; n_chars follows the text where there is one.

    Null and empty texts are left as they are; every row is masked by itself.  An empty table gives an empty one;
    further columns are passed on.
    """
    masked = secrets.mask(docs)
    if "n_chars" in docs.columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), count).otherwise(F.col("n_chars")))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens: the columns of ``packing.pack``.

    Null and empty texts are their closing id alone; long texts are cut; null and repeated identifiers are kept as
    they are.  An empty table has no pieces.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

# The classifier and the tokens cannot be stated in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
