"""Exact, near and passage duplicates, and near vectors."""

import random

import numpy as np
import pandas as pd
import plain
import pytest
import zstandard
from conftest import MEDIUM, SMALL
from dqloom.llm import caps, exact, minhash, queries, substrings
from dqloom.llm.common import components
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, score string, root int, chunk string, `key` int, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "c", 2, "w") for d, t in rows], DOCS)


EDGES = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (5, " \n\t "), (6, "a b "), (7, "A b"), (7, "A b"), (None, "a b"), (None, None), (8, "x " * 50_000)]


# -- exact ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [512, 1])
def test_exact_groups(spark, monkeypatch, hot):
    """The same result whether groups are sorted or, as hot ones, combined first."""
    monkeypatch.setattr(exact, "HOT_ROWS", hot)
    monkeypatch.setattr(exact, "HOT_SHARE", 0.0 if hot == 1 else 0.25)
    rows = exact.content_sort(frame(spark, EDGES), keep="max").collect()
    found = {(r["doc_id"], r["text"]): (r["__keep_id"], r["__group_size"]) for r in rows}
    assert len(rows) == len(EDGES)
    assert found[(1, "a b")] == found[(4, "a b")] == found[(None, "a b")] == (4, 3)
    assert found[(2, None)] == found[(3, "")] == found[(None, None)] == (3, 3)
    assert found[(7, "A b")] == (7, 2) and found[(6, "a b ")] == (6, 1)
    kept = sorted((r["doc_id"] for r in rows if r["__kept"]))
    assert kept == [3, 4, 5, 6, 7, 8]


def test_exact_keeps_smallest_and_normalises(spark):
    stays = exact.drop_copies(frame(spark, EDGES[:7]), normalise=lambda c: F.lower(F.trim(c)))
    assert stays.columns == frame(spark, EDGES[:1]).columns
    assert sorted(r["doc_id"] for r in stays.collect()) == [1, 2, 5]  # Spark's trim takes blanks only


def test_exact_of_empty_table(spark):
    assert exact.content_sort(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact.content_sort(frame(spark, []), keep="any")


# -- near ----------------------------------------------------------------------------------------------------------


def _varied(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(80)]
    rows = [(1000, " ".join(base))]
    for i in range(60):  # a star: near the centre, farther from each other
        copy = list(base)
        for at in draw.sample(range(80), draw.choice([1, 2, 3])):
            copy[at] = f"n{i}_{at}"
        rows.append((i, " ".join(copy)))
    for i in range(60, 120):
        rows.append((i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 40)))))
    rows += [(200 + i, rows[i][1]) for i in range(0, 40, 3)]
    return [*rows, (300, None), (301, ""), (302, "one two"), (303, "One  TWO"), (304, "one two three"), (305, "  ")]


@pytest.mark.parametrize("region", [1024, 16])
def test_near_duplicates_of_stars(spark, monkeypatch, region):
    """Also where neighbourhoods are cut into small chunks."""
    monkeypatch.setattr(minhash, "REGION", region)
    rows = _varied(3)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert found == plain.near(rows)


def test_near_duplicates_joined_through_a_hub_only(spark, monkeypatch):
    """Light edits of one text that are linked with it, but not with each other, in regions of many chunks."""
    monkeypatch.setattr(minhash, "REGION", 16)
    draw = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = [(5000, " ".join(base))]
    for i in range(400):
        copy = list(base)
        for at in draw.sample(range(2, 198, 5), 5):
            copy[at] = f"n{i}_{at}"
        rows.append((i, " ".join(copy)))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert found == plain.near(rows) and {c for _, c in found.values()} == {0}


def test_near_edges(spark):
    found = minhash.near_duplicates(frame(spark, EDGES)).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(EDGES)
    assert by[1]["component_id"] == by[4]["component_id"] == by[6]["component_id"] == by[7]["component_id"] == 1
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[5]["n_shingles"] == 0 and by[5]["kept"]
    assert by[None]["kept"] and by[None]["component_id"] is None
    assert by[8]["n_shingles"] == 1
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_query_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op2_minhash_near_dedup"](spark, MEDIUM).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == plain.near(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_drop_near_keeps_columns(spark):
    rows = _varied(5)
    stays = minhash.drop_near(frame(spark, rows))
    truth = plain.near(rows)
    assert stays.columns == frame(spark, rows[:1]).columns
    assert sorted(r["doc_id"] for r in stays.collect()) == sorted(d for d, (_, c) in truth.items() if c == d)


# -- passages ------------------------------------------------------------------------------------------------------


def test_probes_that_share_their_high_half_stay_apart():
    draw = np.random.default_rng(5)
    hashes = np.unique((np.uint64(12345) << np.uint64(32)) | draw.integers(0, 1 << 32, 5000, dtype=np.uint64))
    for buckets in (8, 1 << 20, (1 << 32) - 1):
        bucket, rest = substrings._place(hashes, buckets)
        exact = [int(h) * buckets >> 32 for h in hashes]
        assert [(int(b) << 32) | int(r) for b, r in zip(bucket, rest, strict=True)] == exact and exact == sorted(exact)
    assert len(set(exact)) == len(hashes)


def test_windows_of_one_hash_are_told_apart_by_the_other():
    def claim(chunk, check):
        packed = {"checks": np.uint64([check]), "ids": np.int64([chunk]), "starts": np.uint32([0])}
        return {"chunk": chunk, "bucket": 0, "rests": substrings._pack_rising(np.uint32([7])), **{name: values.tobytes() for name, values in packed.items()}}

    found = substrings._settle(pd.DataFrame([claim(3, 1), claim(2, 2), claim(1, 1), claim(4, 2)]))
    assert [zstandard.decompress(f)[0] for f in found["found"]] == [1, 0, 0, 1]


def test_repeats_of_few_words(spark):
    """Few distinct words give overlapping, nested and self-repeating passages."""
    draw = random.Random(11)
    passages = [" ".join(draw.choice("abc") for _ in range(draw.randint(5, 60))) for _ in range(12)]
    rows = [(draw.randint(-(2**60), 2**60), "\n ".join(draw.choice(passages) for _ in range(draw.randint(0, 6)))) for _ in range(150)]
    rows += [(1, None), (2, ""), (3, "z " * 30), (4, "z " * 19), (5, "z " * 20)]
    for window in (20, 7):
        found = substrings.remove_repeats(frame(spark, rows).repartition(5), window=window)
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()} == plain.repeats(rows, window)


def test_repeat_edges(spark):
    rows = [(1, "q " * 40), (1, "q " * 40), (None, "q " * 40), (None, None), (2, "q " * 25)]
    found = substrings.remove_repeats(frame(spark, rows)).collect()
    assert len(found) == 5
    first = [r for r in found if r["doc_id"] == 1]
    assert first[0] == first[1] and first[0]["n_removed"] == 39 and first[0]["kept"] == "q"
    assert {r["n_removed"] for r in found if r["doc_id"] is None} == {0}
    assert [r["n_removed"] for r in found if r["doc_id"] == 2] == [25]
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_repeat_query_against_plain(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op5_substring_dedup"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == plain.repeats(rows)


# -- vectors -------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, filters string, n int"


def _vectors():
    draw = np.random.default_rng(2)
    rows = []
    for centre in draw.standard_normal((40, 32)):
        for _ in range(draw.integers(1, 30)):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + draw.standard_normal(32) * draw.choice([0.05, 0.3, 0.5])], int(draw.integers(0, 3))))
    rows += [(len(rows) + i, rows[5][1], rows[5][2]) for i in range(20)]
    n = len(rows)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 32, [1.0, None] * 16, [nan] * 32, [inf] + [1.0] * 31, [2 * x for x in rows[5][1]], [1.0, 2.0], [2.0, 4.0]]
    rows += [(n + i, v, rows[5][2]) for i, v in enumerate(odd)]
    return [*rows, (n + 50, rows[5][1], None)]


@pytest.mark.parametrize("block", [512, 8])
def test_near_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    rows = _vectors()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.near_vectors(table).collect()}
    assert found == plain.near_vectors(rows)


def test_near_vectors_edges(spark):
    assert caps.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    rows = caps.near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1, "x", 1), (3, [1.0, 0.0], 1, "x", 1)], VECTORS)).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows} == {(None, 0, None, True), (3, 0, 3, True)}


def test_cap_lists_hold_every_filter_beyond_the_threshold():
    draw = np.random.default_rng(1).standard_normal((50, 10))
    unit = draw / np.linalg.norm(draw, axis=1, keepdims=True)
    rotation, codes = caps.codebook(10, 12)
    turned = unit @ rotation
    scores = ((turned[:, :5] @ codes[0].T)[:, :, None] + (turned[:, 5:] @ codes[1].T)[:, None, :]).reshape(50, -1)
    bound = 2**0.5 * caps.NormalDist().inv_cdf(1 - 16 / 144) / 10**0.5
    for i, found in enumerate(caps.decode(unit, 12)):
        beyond = np.flatnonzero(scores[i] >= bound)
        assert found.tolist() == (beyond if len(beyond) >= caps.LEAST else np.sort(np.argsort(-scores[i], kind="stable")[: caps.LEAST])).tolist()


@pytest.mark.parametrize("directions", [32, 100, 316, 1000])
def test_pairs_at_the_bound_share_a_filter_of_few_and_of_many(directions):
    draw = np.random.default_rng(6)
    a, b = draw.standard_normal((2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b *= (1 - caps.COSINE**2) ** 0.5 / np.linalg.norm(b, axis=1, keepdims=True)
    sides = []
    for side in (a, caps.COSINE * a + b):
        table = pd.DataFrame({"label": 1, "node": range(len(side)), "copies": 1, "embedding": list(side)})
        sides.append([set(f) for part in caps._listed(directions, "float64")([table]) for f in part["filters"]])
    missed = sum(x.isdisjoint(y) for x, y in zip(*sides, strict=True))
    assert missed <= 8  # two in a thousand


def test_components_of_random_graphs(spark):
    draw = random.Random(4)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    truth = plain.Sets({x for e in edges for x in e})
    for a, b in edges:
        truth.join(a, b)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert found == {x: truth.root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- repeated identifiers ------------------------------------------------------------------------------------------

A, B = (" ".join(f"{word}{i}" for i in range(60)) for word in "ab")


def test_near_duplicates_under_one_identifier(spark):
    """An identifier may name several texts; each is linked by its own words."""
    rows = [(1, A), (1, B), (2, A + " more"), (3, B + " more"), (4, "something else"), (1, A), (5, None), (None, A)]
    found = minhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in found) == [
        (0, 56, None, True), (1, 56, 1, True), (1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (4, 1, 4, True), (5, 0, 5, True),
    ]
    apart = minhash.near_duplicates(frame(spark, [(7, A), (2, B), (7, B + " more"), (9, A + " more")])).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in apart) == [(2, 56, 2), (7, 56, 7), (7, 57, 2), (9, 57, 7)]


def test_drop_near_goes_by_rows(spark):
    """A text is not lost because another one under its identifier goes."""
    rows = [(1, A), (2, A + " more"), (2, "a text of its own"), (3, B), (3, B + " more"), (3, B), (None, A), (4, None), (4, "")]
    kept = [(r["doc_id"], r["text"]) for r in minhash.drop_near(frame(spark, rows)).collect()]
    assert len(kept) in (6, 7) and (2, "a text of its own") in kept and (2, A + " more") not in kept and kept.count((1, A)) == 1
    assert sorted(kept.count((3, t)) for t in (B, B + " more")) in ([0, 1], [0, 2])


def test_near_vectors_under_one_identifier(spark):
    """A vector that repeats an identifier has its own links only."""
    rows = [(1, [1.0, 0.0], 1, "x", 1), (1, [0.0, 1.0], 1, "x", 1), (2, [1.0, 0.01], 1, "x", 1), (3, [1.0, 0.02], 1, "x", 1), (3, [-1.0, 0.0], 1, "x", 1)]
    found = caps.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 2, 1)]
