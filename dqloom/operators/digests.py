"""Differences of two stored versions of a large table, read only where they differ.

A version is stored in buckets of its key's hash, with a digest of each bucket next to it.  A digest does not depend on
the order of rows: it adds and combines two hashes of each row.  Comparing two versions compares their digests, a few
rows whatever the table's size, and then reads and joins the buckets that differ; equal versions are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.operators import diff

BUCKET = "_bucket"
BITS = 8  # 256 buckets; a version of 100 TB wants some 16
_SEED = 29


def bucket_of(keys: Sequence[str], bits: int = BITS) -> Column:
    """The first bits of the key's hash; an incomplete key has a bucket too."""
    return F.shiftrightunsigned(F.xxhash64(*_told_apart(keys)), 64 - bits).cast("int")


def _told_apart(columns: Sequence[str]) -> list[Column]:
    # hashes skip NULLs, so where they are is part of what is hashed
    return [part for c in columns for part in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]


def leaf_digests(rows: DataFrame, bucket: str = BUCKET) -> DataFrame:
    """``_bucket, rows, total, mixed``: digests of the buckets, from one aggregate with a map-side step."""
    columns = sorted(c for c in rows.columns if c != bucket)
    first, second = F.xxhash64(*_told_apart(columns)), F.xxhash64(F.lit(_SEED), *_told_apart(columns))
    return rows.select(bucket, first.cast("decimal(20,0)").alias("_first"), second.alias("_second")).groupBy(bucket).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_first").alias("total"), F.bit_xor("_second").alias("mixed")
    )


def root_digest(leaves: DataFrame) -> DataFrame:
    """One row: rows and digest of a whole version; equal for equal versions in the same columns, however they are bucketed."""
    return leaves.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.bit_xor("mixed"), F.lit(0)).alias("mixed"),
    )


def store(rows: DataFrame, path: str, keys: Sequence[str], bits: int = BITS) -> None:
    """Write a version below ``path``: its rows by bucket, and its digests, taken from what was written."""
    spark = rows.sparkSession
    bucketed = rows.withColumn(BUCKET, bucket_of(keys, bits))
    bucketed.hint("rebalance", BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(f"{path}/rows")
    stored = spark.read.schema(bucketed.schema).parquet(f"{path}/rows")
    described = leaf_digests(stored).withColumns({"bits": F.lit(bits), "columns": F.lit(",".join(sorted(rows.columns)))})
    described.coalesce(1).write.mode("errorifexists").parquet(f"{path}/digests")


def read_rows(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path}/rows")


def differing_buckets(spark: SparkSession, before: str, after: str) -> list[int] | None:
    """Buckets whose digests differ; None where the versions are not laid out alike and must be compared in full."""
    old, new = (spark.read.parquet(f"{path}/digests") for path in (before, after))
    layouts = old.select("bits", "columns").union(new.select("bits", "columns")).distinct().limit(2).collect()
    if len(layouts) > 1:
        return None
    kept = ["rows", "total", "mixed"]
    both = old.select(F.col(BUCKET), F.struct(*kept).alias("_old")).join(new.select(F.col(BUCKET), F.struct(*kept).alias("_new")), BUCKET, "full")
    # at most two to the number of bits
    return sorted(r[0] for r in both.filter("NOT (_old <=> _new)").select(BUCKET).collect())


def stored_diff(spark: SparkSession, before: str, after: str, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``diff.keyed_diff`` of two stored versions (of some of their columns); only differing buckets are read."""
    buckets = differing_buckets(spark, before, after)
    sides = []
    for path in (before, after):
        rows = read_rows(spark, path)
        if buckets is not None:
            rows = rows.filter(F.col(BUCKET).isin(buckets)) if buckets else rows.limit(0)
        sides.append(rows.select(*columns) if columns else rows.drop(BUCKET))
    return diff.keyed_diff(*sides, keys)
