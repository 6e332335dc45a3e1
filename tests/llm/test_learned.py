"""Toxicity, language, quality: held-out figures, edges and the models' parts."""

import itertools

import numpy as np
import plain
import pytest
from conftest import MEDIUM
from dqloom.llm import language, quality, queries, toxicity
from pyspark.sql import functions as F

EDGE_TEXTS = [None, "", " ", "\n\n", "1234 !!", "é", "word " * 40_000, "line\n" * 5_000]


def frame(spark, texts):
    schema = "doc_id long, text string, score string, label int, lang_pred int, n_lines string"
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in enumerate(texts)], schema)


def judged(spark, name, column, buckets, held_out):
    found = queries.QUERIES[name](spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    rows = found.collect()
    assert len(rows) == docs and all(0 <= r["score"] <= 1 for r in rows)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % buckets == held_out
    assert found.where(F.col("held_out") != crc).count() == 0
    return found.join(labels, "doc_id").where("held_out").select(column, "score", "predicted").toPandas()


def test_toxicity_on_held_out_documents(spark):
    rows = judged(spark, "op1_toxicity", "toxic", 3, 1)
    assert plain.auc(rows["toxic"], rows["score"]) > 0.85
    assert (rows["predicted"] == (rows["score"] >= 0.7)).all() and ((rows["predicted"] == 1) & (rows["toxic"] == 0)).sum() <= 1


def test_quality_on_held_out_documents(spark):
    rows = judged(spark, "op6_quality_classifier", "quality", 5, 0)
    assert plain.auc(rows["quality"], rows["score"]) > 0.95
    assert ((rows["predicted"] == 0) & (rows["quality"] == 1)).sum() <= 1


def test_language_on_held_out_documents(spark):
    found = queries.QUERIES["op3_language_id"](spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.count() == 1000
    assert found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def training(spark, rows):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "label_id long, text string, label int")


def test_toxicity_folds_and_pardons(spark):
    names = [f"name{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(f"{n} you rotten thing", 1) for n in names[:60]] + [(f"{n} ate fine apples", 0) for n in names[60:200]]
    rows += [(f"{n} saw rotten apples", 0) for n in names[200:206]]
    model = toxicity.fit(training(spark, rows))
    assert [e for e, _ in model.entries if e.startswith("rott")] and any("rotten appies" in e for e in model.exceptions)
    texts = ["a rotten day", "a r0tt3n day", "a RоTTЕN day", "a ｒｏｔｔｅｎ day", "a rot​ten day", "rotten apples", "a fine day", "unrotten", None, ""]
    got = [r["score"] for r in sorted(toxicity.score(frame(spark, texts), model, keep=["doc_id"]).collect())]
    assert got[0] == pytest.approx(got[1]) == pytest.approx(got[2]) == pytest.approx(got[3]) == pytest.approx(got[4])
    assert got[0] > 0.5 > got[6] and got[5] == got[6] == got[7] == got[8] == got[9]


def test_longer_text_dilutes(spark):
    model = toxicity.Model((("rotten", 5.0),), (), (-4.0, 0.5, 1.5))
    got = [r["score"] for r in sorted(toxicity.score(frame(spark, ["rotten", "rotten" + " fine" * 500]), model, keep=["doc_id"]).collect())]
    assert got[0] > got[1] > 0


@pytest.mark.parametrize("rows", [[], [("good words", 0)], [("bad words", 1)]])
def test_models_without_both_labels(spark, rows):
    for module in (toxicity, quality):
        scored = module.score(frame(spark, EDGE_TEXTS), module.fit(training(spark, rows)))
        assert scored.count() == len(EDGE_TEXTS)
        assert all(0 <= r["score"] <= 1 for r in scored.collect())


def test_edges_of_learned_scores(spark):
    model = toxicity.Model((("rotten", 5.0),), ("rotten apples",), (-4.0, 0.5, 1.5))
    found = toxicity.score(frame(spark, EDGE_TEXTS), model)
    assert "lang_pred" in found.columns and dict(found.dtypes)["score"] == "double" and found.count() == len(EDGE_TEXTS)
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_language_edges(spark):
    known = [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("... 123", "xx"), ("", "en")] * 3
    model = language.fit(spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(known)], "key long, text string, lang string"))
    texts = [*EDGE_TEXTS, "the dog", "die Katze", "Ж", "the dog"]
    rows = sorted(language.identify(frame(spark, texts), model, keep=["doc_id"]).collect())
    assert [r["lang_pred"] for r in rows[:5]] == ["und"] * 5 and [r["score"] for r in rows[:5]] == [0.0] * 5
    assert all(r["lang_pred"] in ("en", "de") for r in rows[5:]) and rows[10]["rejected"]
    assert [rows[i]["lang_pred"] for i in (8, 9)] == ["en", "de"] and rows[8][1:] == rows[11][1:]
    assert language.identify(frame(spark, []), model).count() == 0
    nothing = language.fit(spark.createDataFrame([], "key long, text string, lang string"))
    assert {r["lang_pred"] for r in language.identify(frame(spark, texts), nothing).collect()} == {"und"}


def test_rows_count_alone():
    texts = ["Ein Satz.", None, "aé b", "", "zzz"]
    together = language.ngram_counts(texts)
    assert all((together[i] == language.ngram_counts([t])[0]).all() for i, t in enumerate(texts))
    x, weight, counts = quality.line_features(["a b\nc", None, "x\n\nx\n"])
    assert counts.tolist() == [2, 1, 4] and weight.tolist() == [3, 1, 1, 1, 1, 1, 1]
    alone = np.concatenate([quality.line_features([t])[0] for t in ("a b\nc", None, "x\n\nx\n")])
    assert np.allclose(x, alone)


def test_forward_backward_against_all_labelings():
    draw = np.random.default_rng(0)
    counts = np.array([1, 4, 2, 5])
    scores, change = draw.standard_normal((12, 2)), draw.standard_normal((2, 2))
    marginals, pairs = quality._Chains(counts).run(scores, change)
    truth, truth_pairs = np.zeros((12, 2)), np.zeros((2, 2))
    start = 0
    for n in counts:
        ways = list(itertools.product((0, 1), repeat=int(n)))
        weight = np.array([np.exp(sum(scores[start + i, y] for i, y in enumerate(w)) + sum(change[a, b] for a, b in itertools.pairwise(w))) for w in ways])
        for w, p in zip(ways, weight / weight.sum(), strict=True):
            for i, y in enumerate(w):
                truth[start + i, y] += p
            for a, b in itertools.pairwise(w):
                truth_pairs[a, b] += p
        start += n
    assert np.allclose(marginals, truth) and np.allclose(pairs, truth_pairs)


def test_neighbouring_lines_matter(spark):
    good, bad = "This is a plain sentence of prose.", "x | y | z | w"
    rows = [("\n".join([good] * 4), 1)] * 30 + [("\n".join([bad] * 4), 0)] * 30
    model = quality.fit(training(spark, [(t + f"\nline {i}", y) for i, (t, y) in enumerate(rows)]))
    lines = quality.label_lines(model, ["\n".join([good, good, bad, bad, bad])])[0]
    assert lines[0] > 0.5 > lines[3]
