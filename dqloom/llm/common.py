"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqloom.session import checkpoint_folder, cut_lineage

__all__ = ["checkpoint_folder", "cut_lineage", "read", "crc_bucket", "labelled", "bounded_sample", "small_batches", "slices", "grouped", "components"]

# Rows of one Arrow batch: some MB of text, as long texts are cut into slices inside a task.
BATCH_ROWS = 512
# Characters that one vectorised step holds at a time (a single longer text is a step of its own).
SLICE_CHARS = 1 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{table}.parquet"))


def crc_bucket(identifier: Column, buckets: int) -> Column:
    """crc32 of the identifier's decimal text, modulo ``buckets``; a null identifier has none."""
    return F.crc32(identifier.cast("string").cast("binary")) % buckets


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts stays in a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def slices(lengths, budget: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges whose lengths add up to ``budget`` at most; a longer item stands alone."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > budget:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def grouped(batches, keys: list[str]):
    """From frames sorted by ``keys``: frames of complete groups, with the bounds between the groups."""
    import pandas as pd

    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        change = np.zeros(len(held) - 1, dtype=bool)
        for key in keys:
            values = held[key].to_numpy()
            change |= values[1:] != values[:-1]
        edges = (np.flatnonzero(change) + 1).tolist()
        if edges:
            yield held.iloc[: edges[-1]], [0, *edges]
            held = held.iloc[edges[-1] :].reset_index(drop=True)
    if held is not None:
        yield held, [0, len(held)]


def labelled(docs: DataFrame, labels: DataFrame, target: str, buckets: int, held_out: int, sample: int) -> DataFrame:
    """Labelled rows to learn from, ``label_id``, ``text`` and ``label``: about ``sample`` of them, chosen by hash.

    Rows of the held-out bucket, without an identifier, without text or without a label are left out; of
    repeated label rows of one document the smallest label counts.  The sample is drawn from the labels, so that
    a broadcast of its bounded rows finds their texts and no text is shuffled.
    """
    known = labels.where(F.col(target).isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min(target).cast("int").alias("label"))
    known = known.where((crc_bucket(F.col("label_id"), buckets) != held_out) & F.col("label").isin(0, 1))
    chosen = F.broadcast(bounded_sample(known, "label_id", sample))
    return docs.select(F.col("doc_id").alias("label_id"), "text").where("text IS NOT NULL").join(chosen, "label_id")


def bounded_sample(rows: DataFrame, key: str, size: int, per: str | None = None) -> DataFrame:
    """About ``size`` rows (of each value of ``per``), chosen by a hash of ``key``; all where there are fewer.

    The choice is deterministic.  Only the counts, one per value of ``per``, meet in one place.
    """
    groups = [per] if per else []
    counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__rows"))
    share = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    if per is None:
        total = counts.first()[0]
        return rows if total <= size else rows.where(share < size / total)
    return rows.join(F.broadcast(counts), per).where(share * F.col("__rows") < size).drop("__rows")


def forest(edges: np.ndarray) -> np.ndarray:
    """The (node, smallest reachable node) pairs of the given edges."""
    nodes, flat = np.unique(edges, return_inverse=True)
    parent = np.arange(len(nodes))
    a, b = flat.reshape(-1, 2).T
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        np.minimum.at(parent, parent[a], low)
        np.minimum.at(parent, parent[b], low)
        while not np.array_equal(parent, jumped := parent[parent]):
            parent = jumped
        if np.array_equal(parent, before):
            break
    moved = parent != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[parent[moved]]], axis=1)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) per node that has an edge; root is the smallest.

    Every task first contracts its own edges to stars, so that a hot node crosses the shuffle once per task.
    Then large-star and small-star steps alternate until the edges are stars; each round is checkpointed in the
    shared folder.  Self-loops and repeated edges do no harm; no edges give no rows.
    """

    def contract(batches):
        import pandas as pd

        held = np.empty((0, 2), dtype=np.int64)
        for pdf in batches:
            held = forest(np.concatenate([held, pdf[["a", "b"]].to_numpy(np.int64)]))
        yield pd.DataFrame({"a": held[:, 0], "b": held[:, 1]})

    small = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    stars = cut_lineage(small.where("a <> b").mapInPandas(contract, "a long, b long").distinct())
    for _ in range(rounds):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        # large star: every larger neighbour is tied to the smallest node around the centre
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.where("m < a").select("a", F.col("m").alias("b"))
        ).distinct()
        # small star: the smaller neighbours and the centre are tied to the smallest of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        fresh = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        fresh = cut_lineage(fresh.where("a <> b").distinct())
        summary = fresh.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
        inner = fresh.join(fresh.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        stars = fresh
        if inner == 0 and (summary.first()["most"] or 1) == 1:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = stars.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def annotate(docs: DataFrame, add: str, function, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the columns ``add`` (DDL), computed in Arrow batches.

    ``function`` gets a list of texts, None for null, and returns one sequence per added column.  It sees slices of
    bounded size, and every row by itself decides its result, so a lost task is simply run again.  Columns of ``docs``
    that are named like an added one are replaced.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    small_batches(docs.sparkSession)
    added = _parse_datatype_string(add)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added.names]
    source = docs.select(*(docs[c] for c in kept), docs[text].alias("__text"))
    schema = StructType([*source.schema.fields[:-1], *added.fields])
    kinds = [f.type for f in to_arrow_schema(added)]

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            parts = [function(texts[a:b]) for a, b in slices([len(t or "") for t in texts])]
            if not parts:
                continue
            made = [pa.chunked_array([pa.array(p[i], type=kind) for p in parts], type=kind).combine_chunks() for i, kind in enumerate(kinds)]
            made = [m.chunk(0) if isinstance(m, pa.ChunkedArray) else m for m in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)

    return source.mapInArrow(run, schema)
