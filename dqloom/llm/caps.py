"""Near-duplicate vectors by spherical-cap filters with structured directions."""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqloom.llm.common import components, cut_lineage, forest, grouped, small_batches

COSINE = 0.93
LISTED = 16  # filters that a vector exceeds on average, of NARROW filters; of more filters the caps are narrower, ...
LEAST = 10  # filters that every vector goes to, its closest ones; likewise
NARROW = 256
GROWTH = 0.2  # ... so both grow with this power of their number, which keeps the recall at the cosine bound
MEETING = 160  # vectors of one label that a filter holds on average
FILTERS = 1024  # at least
BLOCK = 512  # vectors of a filter that are compared with as many others at a time


def codebook(dimensions: int, directions: int) -> tuple[np.ndarray, np.ndarray]:
    """A rotation and one set of unit vectors per half of the space: (rotation, (2, directions, half))."""
    draw = np.random.default_rng(dimensions * 1_000_003 + directions)
    rotation, _ = np.linalg.qr(draw.standard_normal((dimensions + dimensions % 2,) * 2))
    codes = draw.standard_normal((2, directions, (dimensions + 1) // 2))
    return rotation[:dimensions], codes / np.linalg.norm(codes, axis=2, keepdims=True)


def lists(filters: int) -> tuple[int, int]:
    """How many of ``filters`` filters a vector exceeds on average, and how many it goes to at least."""
    grown = max(filters / NARROW, 1) ** GROWTH
    return math.ceil(LISTED * grown), math.ceil(LEAST * grown)


def enough(largest: int) -> int:
    """Codes per half for a label of ``largest`` vectors, so that a filter holds ``MEETING`` of them at most on average."""
    directions = math.isqrt(FILTERS - 1) + 1
    while directions**2 * MEETING < largest * lists(directions**2)[0]:
        directions += 1
    return directions


def decode(unit: np.ndarray, directions: int, listed: int = LISTED, least: int = LEAST) -> list[np.ndarray]:
    """The filters that each unit vector goes to, in rising order.

    A filter is a pair of codes, one per half, and its direction their scaled concatenation.  A vector's inner
    product with it is the sum of two numbers, so the filters beyond the threshold are listed code by code of the
    first half, leaving out codes that no second one can lift over it.  The threshold lets ``listed`` filters through
    on average; vectors that fewer reach go to their ``least`` closest ones.
    """
    dimensions = unit.shape[1]
    rotation, codes = codebook(dimensions, directions)
    turned = unit @ rotation
    half = turned.shape[1] // 2
    left, right = turned[:, :half] @ codes[0].T, turned[:, half:] @ codes[1].T
    share = min(listed / directions**2, 0.5)
    bound = math.sqrt(2) * NormalDist().inv_cdf(1 - share) / math.sqrt(dimensions)
    rows, filters = [], []
    reach = right.max(axis=1)
    for code in range(directions):
        near = np.flatnonzero(left[:, code] + reach >= bound)
        hit, other = np.nonzero(right[near] >= bound - left[near, code, None])
        rows.append(near[hit])
        filters.append(code * directions + other)
    rows, filters = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort((filters, rows))
    rows, filters = rows[order], filters[order]
    count = np.bincount(rows, minlength=len(unit))
    lists = np.split(filters, np.cumsum(count)[:-1])
    k = min(least, directions**2)
    for i in np.flatnonzero(count < k).tolist():
        # the k best pairs are among the k best codes of each half
        a, b = np.argsort(-left[i])[:k], np.argsort(-right[i])[:k]
        best = np.argsort(-(left[i, a][:, None] + right[i, b][None, :]), axis=None, kind="stable")[:k]
        lists[i] = np.sort(a[best // len(b)] * directions + b[best % len(b)])
    return lists


def _listed(directions: int, number: str):
    """Each vector's filters; vectors travel in the precision ``number`` that they are stored in."""

    listed, least = lists(directions**2)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            chosen: list = [None] * len(pdf)
            sizes = pdf["embedding"].map(len).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                values = np.stack(pdf["embedding"].iloc[at].tolist()).astype(float)
                unit = values / np.linalg.norm(values, axis=1, keepdims=True)
                for i, found in zip(at, decode(unit, directions, listed, least), strict=True):
                    chosen[i] = found
            raw = [np.asarray(v, dtype=number).tobytes() for v in pdf["embedding"]]
            yield pd.DataFrame({"label": pdf["label"], "size": sizes.astype(np.int32), "node": pdf["node"], "copies": pdf["copies"], "vector": raw, "filters": chosen})

    return run


def _verify(cosine: float, number: str):
    """Per group: each vector's links that this filter is the first to show, and edges that span the linked ones."""

    def linked_in(pdf: pd.DataFrame):
        nodes, copies, side = pdf["node"].to_numpy(), pdf["copies"].to_numpy(), pdf["side"].to_numpy()
        vectors = np.frombuffer(b"".join(pdf["vector"]), dtype=number).reshape(len(pdf), -1).astype(np.float64)
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        split = pdf["low"].iloc[0] != pdf["high"].iloc[0]
        a = np.flatnonzero(side == pdf["low"].iloc[0])
        b = np.flatnonzero(side == pdf["high"].iloc[0]) if split else a
        if not len(a) or not len(b) or (not split and len(a) < 2):
            return None
        near = vectors[a] @ vectors[b].T >= cosine
        if not split:
            np.fill_diagonal(near, False)
        if not near.any():
            return None
        here = pdf["filter"].iloc[0]
        # a pair counts where no earlier filter holds both
        lists = [f[f < here] for f in pdf["filters"]]
        names = np.unique(np.concatenate(lists))
        holds = np.zeros((len(pdf), len(names)), dtype=np.float32)
        for i, f in enumerate(lists):
            holds[i, np.searchsorted(names, f)] = 1
        fresh = near & (holds[a] @ holds[b].T == 0)
        parts = [pd.DataFrame({"a": nodes[a], "n": fresh @ copies[b], "b": nodes[a]})]
        if split:
            parts.append(pd.DataFrame({"a": nodes[b], "n": fresh.T @ copies[a], "b": nodes[b]}))
        x, y = np.nonzero(fresh)
        if len(x):
            edges = forest(np.stack([nodes[a[x]], nodes[b[y]]], axis=1))
            parts.append(pd.DataFrame({"a": edges[:, 0], "n": 0, "b": edges[:, 1]}))
        made = pd.concat(parts)
        return made[(made["n"] > 0) | (made["a"] != made["b"])]

    def run(batches):
        for pdf, bounds in grouped(batches, ["label", "size", "filter", "low", "high"]):
            found = [linked_in(pdf.iloc[a:b]) for a, b in itertools.pairwise(bounds) if b - a > 1]
            found = [f for f in found if f is not None and len(f)]
            if found:
                yield pd.concat(found, ignore_index=True).groupby(["a", "b"], as_index=False)["n"].sum()

    return run


def near_vectors(vectors: DataFrame, identifier: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """(identifier, ``n_links``, ``component_id``, ``kept``), one row per row of ``vectors``.

    Vectors of equal label and length are linked when their cosine, in double precision, is at least ``cosine``.
    Equal vectors of a label are one node that stands for all its copies.  Nodes are joined on the filters whose cap
    they lie in and verified there; the number of filters grows with the largest label, so that a filter holds as
    many of it as before.  Filters with more vectors, a cluster of near copies say, are compared block by block in
    groups of their own; each pair counts in the first filter that holds both, and tasks send counts and spanning
    edges, never pairs.  A pair that shares no filter is missed: of pairs at the cosine bound about one in a thousand or
    fewer, simulated for 1 024 to 1 million filters, as the lists grow with their number.

    Vectors that are null, empty, zero or hold null or non-finite numbers, rows with a null label and rows with a null
    identifier are linked with nothing and kept; their component is their own identifier.  Rows that repeat an
    identifier are vectors of their own, each with its links.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark, 1024)
    rows = vectors.select(vectors[identifier].cast("long").alias("id"), vectors[vector].alias("embedding"), vectors[label].alias("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound, F.lit(False))
    # a fingerprint of the vector's text stands for it in the joins; equal vectors have equal text
    print_of = F.sha2(F.concat_ws(",", F.col("embedding").cast("array<string>")), 256)
    marked = rows.withColumn("usable", usable).withColumn("print", F.when(F.col("usable"), print_of))
    equal = marked.where("usable").groupBy("label", "print")
    # nodes are vectors, not identifiers, as an identifier may name several vectors; their numbers are stored with them
    vectors_of = equal.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("embedding").alias("embedding"))
    distinct = cut_lineage(vectors_of.withColumn("node", F.monotonically_increasing_id()))
    largest = distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    directions = enough(largest)
    kind, element = dict(distinct.dtypes)["label"], dict(distinct.dtypes)["embedding"]
    number, index = "float32" if element == "array<float>" else "float64", "int" if directions**2 < 2**31 else "long"
    listed = cut_lineage(
        distinct.select("label", "node", "copies", "embedding").mapInPandas(
            _listed(directions, number), f"label {kind}, size int, node long, copies long, vector binary, filters array<{index}>"
        )
    )
    narrow = listed.select("label", "size", F.explode("filters").alias("filter"))
    crowded = narrow.groupBy("label", "size", "filter").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    placed = listed.withColumn("filter", F.explode("filters")).join(crowded, ["label", "size", "filter"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    side = F.pmod(F.xxhash64("node"), blocks).cast("int")
    placed = placed.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})
    keys = ["label", "size", "filter", "low", "high"]
    meeting = placed.select(*keys, "side", "node", "copies", "vector", "filters").repartition(*keys).sortWithinPartitions(*keys)
    found = cut_lineage(meeting.mapInPandas(_verify(cosine, number), "a long, b long, n long"))
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("a <> b").select("a", "b"))
    nodes = distinct.select("label", "print", "node", "first", "copies").join(counts, "node", "left").join(roots, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "node"))
    nodes = nodes.join(nodes.groupBy("root").agg(F.min("first").alias("least")), "root")
    result = marked.drop("embedding").join(nodes, ["label", "print"], "left")
    component = F.when(F.col("usable"), F.col("least")).otherwise(F.col("id"))
    return result.select(
        F.col("id").alias(identifier),
        F.when(F.col("usable"), F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
