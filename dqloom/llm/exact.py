"""Exact deduplication by content sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqloom.llm.common import cut_lineage

# A text counts as hot when its copies would fill this share of an average shuffle partition ...
HOT_SHARE = 0.25
# ... and are at least this many.
HOT_ROWS = 512
# Leading characters that the splitters look at; the driver samples these, never whole texts.
LEADING = 16


def content_sort(
    docs: DataFrame,
    identifier: str = "doc_id",
    text: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with ``__text`` (normalised), ``__keep_id``, ``__group_size`` and ``__kept``.

    Sampled splitters range-partition the rows by the beginning of their normalised text (then by its hash, as many
    texts may begin alike), Spark's external sort places equal texts adjacent, and neighbours are compared in full.  The row with the smallest (``keep='max'``: largest) identifier
    of a group stays.

    Copies of one text cannot be split by splitters on the text alone.  So the texts with more copies than a share
    of a partition are found first by a pre-aggregated count of hashes - by construction at most
    ``partitions / HOT_SHARE`` texts, whatever the size of the table.  Their groups are combined on the map side, by
    the full text, and their rows get the group's values by a broadcast of that bounded table; they are never
    brought together.

    Null texts count as empty.  Of rows that repeat an identifier within a group one stays.  Null identifiers lose
    against others; a group of only such rows keeps one of them.  An empty table gives an empty result.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("__text", normalise(content) if normalise else content).withColumn("__hash", F.xxhash64("__text"))
    best = F.min(identifier) if keep == "min" else F.max(identifier)
    order = F.asc_nulls_last(identifier) if keep == "min" else F.desc_nulls_last(identifier)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = max(HOT_ROWS, int(docs.count() * HOT_SHARE / partitions))
    hot = cut_lineage(rows.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least).select("__hash"))

    group = Window.partitionBy("__leading", "__hash", "__text")
    cold = (
        rows.join(F.broadcast(hot), "__hash", "left_anti")
        .withColumn("__leading", F.substring("__text", 1, LEADING))
        .repartitionByRange("__leading", "__hash")
        .withColumn("__keep_id", F.first(identifier).over(group.orderBy(order)))
        .withColumn("__kept", F.row_number().over(group.orderBy(order)) == 1)
        .withColumn("__group_size", F.count(F.lit(1)).over(group))
    )

    hot_rows = rows.join(F.broadcast(hot), "__hash", "left_semi")
    groups = cut_lineage(
        hot_rows.groupBy("__hash", "__text")
        .agg(best.alias("__keep_id"), F.count(F.lit(1)).alias("__group_size"))
        .select("__hash", F.sha2("__text", 256).alias("__sha"), "__keep_id", "__group_size")
    )
    placed = hot_rows.withColumn("__sha", F.sha2("__text", 256)).join(F.broadcast(groups), ["__hash", "__sha"])
    wins = F.col(identifier).eqNullSafe(F.col("__keep_id"))
    losers = placed.where(~wins).withColumn("__kept", F.lit(False))
    winners = placed.where(wins).withColumn("__kept", F.row_number().over(Window.partitionBy("__hash", "__sha").orderBy(F.lit(1))) == 1)
    columns = [*docs.columns, "__text", "__keep_id", "__group_size", "__kept"]
    return cold.select(columns).unionByName(losers.select(columns)).unionByName(winners.select(columns))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    return content_sort(docs, **options).where("__kept").select(docs.columns)
