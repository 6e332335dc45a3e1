"""Near-duplicate documents by an LSH forest over MinHash signatures."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqloom.llm.common import annotate, components, cut_lineage, forest, grouped, small_batches
from dqloom.llm.words import shingle_sets

SHINGLE = 5
PERCENT = 75  # documents are linked when 100 * intersection >= PERCENT * union
TREES = 20  # sorted signature orders
PER_TREE = 5  # signature values that a tree starts with; further levels use those of the next trees
DEPTH = 3  # values that neighbours share at least
REGION = 1024  # neighbours in a tree's order that are compared at a time; the rest of denser regions is compared in blocks afterwards
LOWEST = 0.55  # share of equal signature values below which a pair is no candidate; 4.6 deviations under PERCENT
FEW = 20_000  # nodes that are sent to every task
WIDTH = 3  # most similar partners that a document proposes at first ...
PROMISING = 0.7  # ... and the share of equal values from which it does
SIZE = TREES * PER_TREE
_FACTORS = np.random.default_rng(7).integers(0, 1 << 31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray) -> bytes:
    """``SIZE`` minimum hashes, 16 bits of each, in the order of the trees."""
    if not len(shingles):
        return b""
    points = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SIZE, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(points), 512):
        np.minimum(least, (points[start : start + 512, None] * _FACTORS).min(axis=0), out=least)
    least = least * np.uint32(0x85EBCA6B)
    return (least >> np.uint32(16)).astype(">u2").tobytes()


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``n_shingles``, ``set_key`` (digest of the shingle set, null if empty) and ``signature``."""

    def judge(texts):
        sets = shingle_sets(texts, shingle)
        return [len(s) for s in sets], [_digest(s) for s in sets], [signature(s) for s in sets]

    return annotate(docs, "n_shingles long, set_key binary, signature binary", judge, text, keep)


def _regions(distinct: DataFrame) -> DataFrame:
    """(key, chunk, tree, whole, node, signature) of the nodes that have neighbours, once per tree.

    A tree orders the signatures from its own first value on, cyclically.  Nodes that share ``DEPTH`` values are a
    region; its nodes are cut, in that order, into overlapping chunks of ``REGION``.  So a node meets all nodes of a
    sparse region, and in a dense one those with the longest common prefixes first (``_across`` has the others).
    ``whole`` has a bit for each tree in which the node's region is one chunk.
    """
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.substring("signature", t * (2 * PER_TREE) + 1, F.lit(2 * DEPTH))).alias("key")),
    )
    keyed = distinct.select("node", F.explode(trees).alias("at")).select("node", "at.tree", "at.key")
    shared = keyed.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("size > 1")
    bits = F.sum(F.when(F.col("size") <= REGION, F.expr("shiftleft(1, tree)")).otherwise(0)).over(Window.partitionBy("node"))
    shared = shared.withColumn("whole", bits.cast("int")).join(distinct.select("node", "signature"), "node")
    start = F.col("tree") * (2 * PER_TREE) + 1
    order = F.concat(F.substring("signature", start, F.lit(2 * SIZE)), F.substring("signature", F.lit(1), start - 1))
    place = F.row_number().over(Window.partitionBy("key").orderBy("order", "node")) - 1
    small = shared.where(F.col("size") <= REGION).withColumn("chunk", F.lit(0))
    large = shared.where(F.col("size") > REGION).withColumn("order", order).withColumn("home", F.floor(place / (REGION // 2)).cast("int"))
    large = large.withColumn("chunk", F.explode(F.array("home", F.col("home") + 1)))
    columns = ["key", "chunk", "tree", "whole", "node", "signature"]
    return small.select(columns).union(large.select(columns))


def _alike(roots: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Share of equal values of each pair, 0 where it is too low or the pair is in one component."""
    n = len(values)
    alike = np.zeros((n, n), dtype=np.float32)
    for i in range(n - 1):
        alike[i, i + 1 :] = (values[i + 1 :] == values[i]).sum(axis=1)
    alike = (alike + alike.T) / SIZE
    alike[(alike < LOWEST) | (roots[:, None] == roots[None, :])] = 0
    return alike


def _values(signatures) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), dtype=np.uint16).reshape(-1, SIZE)


def _propose(batches):
    """The most similar pairs of every group of (key, chunk)."""
    for pdf, bounds in grouped(batches, ["key", "chunk"]):
        nodes, values, found = pdf["node"].to_numpy(), _values(pdf["signature"]), []
        for start, stop in itertools.pairwise(bounds):
            if stop - start < 2:
                continue
            alike = _alike(np.arange(stop - start), values[start:stop])
            best = alike >= PROMISING
            if len(alike) - 1 > WIDTH:
                bound = -np.partition(-alike, WIDTH - 1, axis=1)[:, WIDTH - 1]
                best &= alike >= bound[:, None]
                best &= np.cumsum(best, axis=1) <= WIDTH  # of equal ones the first count
            a, b = np.nonzero(best)
            a, b = nodes[start + a], nodes[start + b]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
        if len(pairs):
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact comparison of two full sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    short, long = (x, y) if len(x) < len(y) else (y, x)
    common = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(percent: int):
    def run(batches):
        for pdf in batches:
            sets = zip(pdf["left"], pdf["right"], strict=True)
            kept = np.array([_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sets], dtype=bool)
            if kept.any():
                yield pdf.loc[kept, ["a", "b"]]

    return run


def _met(values: np.ndarray, trees: np.ndarray, a: np.ndarray, b: np.ndarray, tree: int) -> np.ndarray:
    """Whether each pair shares a region of a tree before ``tree``, of those that both have a bit for in ``trees``."""
    heads = values.reshape(len(values), TREES, PER_TREE)[:, :tree, :DEPTH]
    met = np.zeros(len(a), dtype=bool)
    for t in range(tree):
        met |= (((trees[a] & trees[b]) >> t) & 1).astype(bool) & (heads[a, t] == heads[b, t]).all(axis=1)
    return met


def _to_compare(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs of two components in a group, the most similar first, each in the first tree it meets in.

    Pairs that share an earlier tree's region, if that is one chunk, are compared there.
    """
    roots, tree = pdf["root"].to_numpy(), int(pdf["tree"].iloc[0])
    values, whole = _values(pdf["signature"]), pdf["whole"].to_numpy()
    alike = np.triu(_alike(roots, values))
    a, b = np.nonzero(alike)
    before = _met(values, whole, a, b, tree)
    a, b = a[~before], b[~before]
    order = np.argsort(-alike[a, b], kind="stable")
    return a[order], b[order]


def _open_rows(batches):
    """The rows of (key, chunk) groups that have a pair to compare."""
    for pdf, bounds in grouped(batches, ["key", "chunk"]):
        wanted = np.zeros(len(pdf), dtype=bool)
        for start, stop in itertools.pairwise(bounds):
            for side in _to_compare(pdf.iloc[start:stop]):
                wanted[start + side] = True
        if wanted.any():
            yield pdf[wanted]


def _finish(percent: int):
    """Links between components that are still apart, enough of them to join what is linked."""

    def join(pdf: pd.DataFrame) -> list[tuple[int, int]]:
        nodes, roots = pdf["node"].to_numpy(), pdf["root"].to_numpy().copy()
        sets = [np.frombuffer(f, np.uint64) for f in pdf["full"]]
        found = []
        for x, y in zip(*(side.tolist() for side in _to_compare(pdf)), strict=True):
            if roots[x] != roots[y] and _linked(sets[x], sets[y], percent):
                found.append((int(nodes[x]), int(nodes[y])))
                roots[roots == roots[y]] = roots[x]
        return found

    def run(batches):
        for pdf, bounds in grouped(batches, ["key", "chunk"]):
            found = [e for start, stop in itertools.pairwise(bounds) for e in join(pdf.iloc[start:stop])]
            if found:
                yield pd.DataFrame(sorted(set(found)), columns=["a", "b"])

    return run


def _crossing(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs of two components in a block of a crowded region, each in the first tree it meets in."""
    nodes, roots, values = pdf["node"].to_numpy(), pdf["root"].to_numpy(), _values(pdf["signature"])
    left = pdf["left"].to_numpy(dtype=bool)
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    alike = np.zeros((len(a), len(b)), dtype=np.int16)
    for i, x in enumerate(a):
        alike[i] = (values[b] == values[x]).sum(axis=1)
    # two nodes outside the largest component meet on both sides
    twice = (roots[b] != pdf["mass"].iloc[0])[None, :] & (nodes[a][:, None] > nodes[b][None, :])
    x, y = np.nonzero((alike >= round(LOWEST * SIZE)) & (roots[a][:, None] != roots[b][None, :]) & ~twice)
    x, y = a[x], b[y]
    before = _met(values, np.full(len(pdf), -1), x, y, int(pdf["tree"].iloc[0]))
    return x[~before], y[~before]


def _crossing_rows(batches):
    """The rows of (key, row, column) groups that have a pair to compare."""
    for pdf, bounds in grouped(batches, ["key", "row", "column"]):
        wanted = np.zeros(len(pdf), dtype=bool)
        for start, stop in itertools.pairwise(bounds):
            for side in _crossing(pdf.iloc[start:stop]):
                wanted[start + side] = True
        if wanted.any():
            yield pdf[wanted]


def _marks(sets: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    marks = np.zeros((len(sets), len(points)), dtype=np.float32)
    for i, s in enumerate(sets):
        s = s[np.searchsorted(s, points[0]) : np.searchsorted(s, points[-1], "right")]
        at = np.searchsorted(points, s)
        marks[i, at[points[at] == s]] = 1
    return marks


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of all pairs of sorted sets, by products of their marks."""
    points = np.intersect1d(np.concatenate(left), np.concatenate(right))
    common = np.zeros((len(left), len(right)), dtype=np.float64)
    for start in range(0, len(points), 4096):
        part = points[start : start + 4096]
        common += _marks(left, part) @ _marks(right, part).T
    return common.astype(np.int64)


def _settle(percent: int):
    """Links between components of a crowded region, as spanning edges of their roots."""

    def join(pdf: pd.DataFrame) -> np.ndarray:
        x, y = _crossing(pdf)
        if not len(x):
            return np.zeros((0, 2), dtype=np.int64)
        roots, full = pdf["root"].to_numpy(), pdf["full"].to_numpy()
        a, b = np.unique(x), np.unique(y)
        left, right = [np.frombuffer(f, np.uint64) for f in full[a]], [np.frombuffer(f, np.uint64) for f in full[b]]
        total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])
        common = _common(left, right)
        linked = (100 * common >= percent * (total - common))[np.searchsorted(a, x), np.searchsorted(b, y)]
        return forest(np.stack([roots[x[linked]], roots[y[linked]]], axis=1))

    def run(batches):
        for pdf, bounds in grouped(batches, ["key", "row", "column"]):
            found = np.concatenate([join(pdf.iloc[start:stop]) for start, stop in itertools.pairwise(bounds)])
            if len(found):
                yield pd.DataFrame(forest(found), columns=["a", "b"])

    return run


def _across(regions: DataFrame, full: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(node, root) after all candidate pairs of two components in regions of more than one chunk are compared.

    The nodes of a region that are not in its largest component are compared with all its nodes, in blocks of half a
    ``REGION`` by as much, so a region of near copies that are joined already costs little.  The earlier trees' links
    are joined before the next trees are compared, unless these add no more rows than all regions have.  What shares
    no component after that is compared in full: the cost is the product of the two counts, nothing is left out.
    """
    half = max(REGION // 2, 1)
    # a node has two successive chunks in a crowded region, one of them even
    crowds = regions.where("(shiftright(whole, tree) & 1) = 0 AND chunk % 2 = 0").select("key", "tree", "node", "signature")
    if crowds.isEmpty():
        return roots
    rows, done = regions.count(), -1
    while True:
        at = crowds.where(F.col("tree") > done).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        kinds = at.groupBy("tree", "key", "root").agg(F.count(F.lit(1)).alias("n"))
        mixed = kinds.groupBy("tree", "key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("mass"))
        blocks = {"rows": F.ceil((F.col("n") - F.col("most")) / half).cast("int"), "columns": F.ceil(F.col("n") / half).cast("int")}
        mixed = cut_lineage(mixed.where("most < n").withColumns(blocks))
        loads = mixed.groupBy("tree").agg(F.sum(F.expr("rows * n + columns * (n - most)")).alias("load")).orderBy("tree").collect()
        if not loads:
            return roots
        trees, load = [], 0
        for r in loads:
            if trees and load + r["load"] > rows:
                break
            trees.append(r["tree"])
            load += r["load"]
        done = trees[-1]
        here = at.where(F.col("tree").isin(trees)).join(mixed.drop("tree", "n", "most"), "key")
        keys = ["key", "row", "column"]
        names = [*keys, "left", "tree", "mass", "node", "root", "signature"]
        few = here.where("root <> mass").withColumns({"left": F.lit(True), "row": F.pmod(F.xxhash64(F.lit(1), "node"), "rows").cast("int")})
        few = few.withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
        every = here.withColumns({"left": F.lit(False), "column": F.pmod(F.xxhash64(F.lit(2), "node"), "columns").cast("int")})
        every = every.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
        meeting = few.select(names).union(every.select(names)).repartition(*keys).sortWithinPartitions(*keys)
        kept = "key long, row int, column int, left boolean, tree int, mass long, node long, root long, signature binary"
        wanted = cut_lineage(meeting.mapInPandas(_crossing_rows, kept))
        needed = wanted.select("node").distinct()
        # few nodes find their sets without a shuffle of all sets
        sets = full.join(F.broadcast(needed) if needed.count() <= FEW else needed, "node", "left_semi")
        complete = wanted.join(sets, "node").repartition(*keys).sortWithinPartitions(*keys)
        found = cut_lineage(complete.mapInPandas(_settle(percent), "a long, b long"))
        if not found.isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").union(found))
        if len(trees) == len(loads):
            return roots


def links(distinct: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(node, root) of all nodes linked to another one, from distinct sets (node, set_key, doc, signature) and (doc, text).

    ``doc`` names a document that has the set.  Where several texts have that name, the one with the set is taken.

    First every node proposes its most similar partners of each neighbourhood, and full sets confirm these pairs.
    That joins most of what belongs together.  Then, in the neighbourhoods that still hold several components, the
    nodes that have a candidate in another one get their full sets, and all candidate pairs of two components are compared in place, each in the first tree where
    it meets, the most similar first.  Only links that join components leave a task, so a group of many copies is
    never expanded into its pairs.  Last, pairs of two components that share a crowded region but no chunk of it are
    compared in blocks, so no candidate link between components is left out.
    """
    small_batches(distinct.sparkSession, 1024)
    regions = cut_lineage(_regions(distinct))
    wanted = distinct.join(regions.select("node").distinct(), "node", "left_semi").select("node", "doc", "set_key")

    def whole_sets(some):
        sets = shingle_sets(some, shingle)
        return [_digest(s) for s in sets], [s.tobytes() for s in sets]

    named = annotate(texts.join(wanted, "doc"), "found_key binary, full binary", whole_sets, keep=["node", "set_key"])
    full = cut_lineage(named.where("found_key = set_key").select("node", "full").dropDuplicates(["node"]))
    keys = ["key", "chunk"]
    proposed = regions.select(*keys, "node", "signature").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_propose, "a long, b long")
    pairs = proposed.distinct()
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("full").alias("left")), "a")
    both = both.join(full.select(F.col("node").alias("b"), F.col("full").alias("right")), "b")
    sure = cut_lineage(both.select("a", "b", "left", "right").mapInPandas(_confirm(percent), "a long, b long"))

    roots = components(sure)
    placed = regions.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    group = Window.partitionBy(*keys)
    mixed = placed.withColumns({"low": F.min("root").over(group), "high": F.max("root").over(group)}).where("low < high")
    kinds = "key long, chunk int, tree int, whole int, node long, root long, signature binary"
    mixed = mixed.select(*keys, "tree", "whole", "node", "root", "signature").sortWithinPartitions(*keys).mapInPandas(_open_rows, kinds)
    more = mixed.join(full, "node").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_finish(percent), "a long, b long")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").union(more))
    return _across(regions, full, roots, percent)


def _judged(docs: DataFrame, identifier: str, text: str, percent: int, shingle: int) -> DataFrame:
    """(doc, print, n_shingles, component, stays), one row per row of ``docs``; ``print`` is a digest of the text.

    ``stays`` holds for the rows of one document of each component: of the smallest identifier, and of its sets the
    one with the smallest digest.
    """
    source = docs.select(docs[identifier].cast("long").alias("doc"), docs[text].alias("text"))
    prints = F.sha2(F.coalesce("text", F.lit("")), 256)
    signed = cut_lineage(signatures(source.withColumn("print", prints), keep=["doc", "print"], shingle=shingle))
    groups = signed.where("set_key IS NOT NULL AND doc IS NOT NULL").groupBy("set_key")
    # nodes are sets, not identifiers, as an identifier may name several texts; their numbers are stored with them
    sets = groups.agg(F.min("doc").alias("doc"), F.min("signature").alias("signature"))
    distinct = cut_lineage(sets.withColumn("node", F.monotonically_increasing_id()))
    roots = links(distinct, source, percent, shingle)
    named = distinct.drop("signature").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min(F.struct("doc", "set_key")).alias("least"))
    named = named.join(least, "root").select("set_key", "least")
    found = signed.drop("signature").join(named, "set_key", "left")
    stays = F.col("least").isNull() | F.col("doc").isNull() | (F.struct("doc", "set_key") == F.col("least"))
    component = F.when(F.col("doc").isNotNull(), F.coalesce("least.doc", "doc"))
    return found.select("doc", "print", "n_shingles", component.alias("component"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, identifier: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(identifier, ``n_shingles``, ``component_id``, ``kept``), one row per row of ``docs``.

    Words are what lies between white space, A-Z lower-cased; the set of a text are its distinct shingles, or the
    whole sequence if it is shorter.  Equal sets are one node, so copies cost one row each; the component is named by
    the smallest identifier that has one of its sets.  Null, empty and blank texts have no shingle and are linked with
    nothing.  Rows with a null identifier take part in no component and are kept.  Repeated rows get the same result;
    rows that repeat an identifier with another text are judged by their own text.  Texts are compared whole, whatever
    their length.  An empty table gives an empty result.
    """
    found = _judged(docs, identifier, text, percent, shingle)
    kept = F.coalesce(F.col("doc") == F.col("component"), F.lit(True))
    return found.select(F.col("doc").alias(identifier), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def drop_near(docs: DataFrame, identifier: str = "doc_id", text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with the columns of ``docs``.

    That is the document with the smallest identifier; rows that repeat it in identifier and words stay with it.  A
    row goes by its own identifier and text, so other texts under the same identifier are not lost.  Rows with a null
    identifier, and null, empty and blank texts are kept; an empty table gives an empty result.
    """
    gone = _judged(docs, identifier, text, percent, shingle).where("NOT stays").select(F.col("doc").alias("__gone"), F.col("print").alias("__print")).distinct()
    same = (docs[identifier] == F.col("__gone")) & (F.sha2(F.coalesce(docs[text], F.lit("")), 256) == F.col("__print"))
    return docs.join(gone, same, "left_anti")
