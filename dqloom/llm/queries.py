"""The corpus queries, with the SQL that states a result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.llm import bpe, caps, exact, language, minhash, packing, periods, pieces, quality, secrets, spelling, substrings, toxicity
from dqloom.llm.common import crc_bucket, labelled, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


@query()
def op8_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return caps.near_vectors(read(spark, folder, "embeddings"))


@query(
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
)
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact.content_sort(read(spark, folder, "documents").select("doc_id", "text"), keep="max")
    return rows.select(
        "doc_id",
        F.col("__keep_id").alias("keep_id"),
        F.col("__group_size").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.sha2("__text", 256).alias("text_sha256"),
    )


@query()
def op4_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    rows = secrets.scan(read(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        *(secrets.count_of("__base", kind).alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(secrets.as_text("__base"), 256).alias("base_sha256"),
        secrets.as_text("__spans").alias("spans"),
    )


@query()
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(labelled(docs, read(spark, folder, "labels"), "toxic", 3, 1, toxicity.SAMPLE))
    return _judged(toxicity.score(docs, model, keep=["doc_id"]), 3, 1, 0.7)


@query()
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents"))


@query()
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(True))
    known = docs.where(~held_out & F.col("text").isNotNull() & F.col("lang").isNotNull())
    model = language.fit(known.select(F.col("doc_id").alias("key"), "text", "lang"))
    found = language.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query()
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, folder, "documents"), with_text=False)


@query()
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(labelled(docs, read(spark, folder, "labels"), "quality", 5, 0, quality.SAMPLE))
    return _judged(quality.score(docs, model, keep=["doc_id"]), 5, 0, 0.3)


@query()
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


@query()
def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


@query()
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(read(spark, folder, "documents"), change=spelling.lossy)


@query()
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periods.contract(read(spark, folder, "documents"))


def _judged(scored: DataFrame, buckets: int, held_out: int, threshold: float) -> DataFrame:
    """Contract columns of a trained score; a null identifier counts as held out, as nothing is learned from it."""
    return scored.select(
        "doc_id",
        F.coalesce(crc_bucket(F.col("doc_id"), buckets) == held_out, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
