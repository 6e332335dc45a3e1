"""The pipeline's stages, and every query against its SQL or at least whole."""

import corpus_pipeline
import oracle
import plain
import pytest
from conftest import MEDIUM, SMALL
from dqloom.llm import queries


def test_names_cover_all_operators():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert oracle.differences(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], oracle.connect(SMALL)) == []


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{number}"
        stage(spark, docs, MEDIUM).write.parquet(path)
        before, after = {r["doc_id"]: r for r in docs.collect()}, spark.read.parquet(path)
        if name != "packing":
            assert after.dtypes == docs.dtypes
        rows = after.collect()
        kept = {r["doc_id"] for r in rows}
        if name == "quality_classifier":
            gone = set(before) - kept
            assert gone and all(labels.get(d, 0) == 0 for d in gone)
        elif name == "exact_dedup":
            last = {}
            for d in sorted(before):
                last[before[d]["text"]] = d
            assert kept == set(last.values())
        elif name == "near_dedup":
            truth = plain.near([(d, r["text"]) for d, r in before.items()])
            assert kept == {d for d, (_, c) in truth.items() if c == d}
        elif name == "secret_scans":
            assert kept == set(before) and not any(plain.secrets(r["text"]) for r in rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
            assert all(r["text"] == before[r["doc_id"]]["text"] for r in rows if not plain.secrets(before[r["doc_id"]]["text"]))
        else:
            assert kept == set(before)
        docs = after


def test_run_packs_the_documents_that_stay(spark):
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in pieces} <= {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert max(r["offset"] + r["length"] for r in pieces) <= 1024


ODD = "doc_id long, text string, lang string, source string, n_chars long, label int, score string, node long, `key` string, start int"
SOLE, OTHER = (" ".join(f"{word}{i}" for i in range(40)) for word in "cd")


def odd(spark, rows):
    return spark.createDataFrame([(d, t, "en", "x", len(t or ""), 1, "s", 5, "k", 2) for d, t in rows], ODD)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and identifiers, columns that clash with inner ones."""
    rows = [(1, None), (2, ""), (3, SOLE), (3, SOLE), (4, SOLE + " more"), (4, OTHER), (None, OTHER), (None, None), (5, "password = hunter22 " + SOLE[:20])]
    docs = odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES[1:]:
        after = stage(spark, docs, SMALL)
        if name == "packing":
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in docs.collect()}
            continue
        assert after.dtypes == docs.dtypes
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
        if name == "exact_dedup":
            assert kept == sorted([(2, ""), (3, SOLE), (4, SOLE + " more"), (4, OTHER), (5, rows[-1][1])])
        elif name == "near_dedup":
            assert kept == sorted([(2, ""), (3, SOLE), (4, OTHER), (5, rows[-1][1])])
        elif name == "secret_scans":
            assert (4, OTHER) in kept and not any("hunter22" in t for _, t in kept)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, odd(spark, []), SMALL).count() == 0
