"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqloom.llm.common import annotate, cut_lineage, small_batches

SAMPLE = 20_000  # labelled documents that the lexicon and the calibration are fitted on
LEXICON = 600  # entries at most, the most telling first
STEM = (4, 8)  # least and greatest length of a stem; whole words may be longer
LEAST_SUPPORT = 4  # distinct toxic texts that an entry must occur in
LEAST_PRECISION = 0.8
LEAST_GAIN = 14.0  # log-likelihood ratio of an entry against chance
WHOLE = 0.95  # an entry is lengthened to a longer one that has this share of its toxic texts
EXCEPTION_PRECISION = 0.2

# Letters of other scripts and full-width forms that pass for a Latin letter, and digits and signs that
# stand for one.  Latin letters with accents are letters of their own in many languages and stay.
LOOKALIKES = {
    "a": "аαａ@4", "b": "вьβｂ8", "c": "сϲｃ", "d": "ԁｄ", "e": "еєεｅ3", "g": "ɡｇ9", "h": "һнｈ", "i": "іιıｉlӏｌ1",
    "j": "јｊ", "k": "кκｋ", "m": "мｍ", "n": "пηｎ", "o": "оοσｏ0", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ$5",
    "t": "тτｔ7", "u": "υｕ", "v": "νѵｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уγｙ", "z": "ｚ2",
}
_FOLD = {ord(c): plain for plain, variants in LOOKALIKES.items() for c in variants} | dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF))
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, look-alikes and substituted digits as the letter they stand for, invisible marks gone.

    l, i and 1 fall together, as a 1 may stand for either.
    """
    return text.lower().translate(_FOLD)


@dataclass(frozen=True)
class Model:
    entries: tuple[tuple[str, float], ...]  # word beginnings and their weights
    exceptions: tuple[str, ...]  # phrases in which an entry does not count
    weights: tuple[float, float, float]  # of 1, log(1 + total) and log(1 + total per 100 words)


def _terms(words: list[str]) -> set[str]:
    low, high = STEM
    found = set()
    for w in set(words):
        if len(w) >= low:
            found.update(w[:n] for n in range(low, min(len(w), high) + 1))
            found.add(w)
    return found


def _gain(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Log-likelihood ratio of a term's split against that of all texts."""
    n, total = toxic + clean, all_toxic + all_clean
    return 2 * sum(k * math.log(k * total / (n * whole)) for k, whole in ((toxic, all_toxic), (clean, all_clean)) if k)


def _entries(counted: list, all_toxic: int, all_clean: int) -> list[tuple[str, float]]:
    """Of telling terms that begin alike the shortest, lengthened where its texts share more; smoothed log odds weigh."""
    ranked = sorted(((_gain(r["toxic"], r["clean"], all_toxic, all_clean), r) for r in counted), key=lambda x: (-x[0], x[1]["term"]))
    good = [(g, r) for g, r in ranked if g >= LEAST_GAIN][:LEXICON]
    chosen: dict[str, float] = {}
    for _, r in sorted(good, key=lambda x: (len(x[1]["term"]), x[1]["term"])):
        term = r["term"]
        if not any(term[:n] in chosen for n in range(STEM[0], len(term))):
            longer = max((o["term"] for _, o in good if o["term"].startswith(term) and o["toxic"] >= WHOLE * r["toxic"]), key=lambda t: (len(t), t))
            chosen[longer] = math.log((r["toxic"] + 0.5) / (all_toxic + 1)) - math.log((r["clean"] + 0.5) / (all_clean + 1))
    return sorted(chosen.items())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the constant and is not shrunk."""
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@functools.lru_cache(maxsize=4)
def _automaton(model: Model):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for term, weight in model.entries:
        machine.add_word(" " + term, (weight, 0, len(term) + 1))
    for phrase in model.exceptions:
        machine.add_word(f" {phrase} ", (0.0, 1, len(phrase) + 2))
    machine.make_automaton()
    return machine


def _total(model: Model, words: list[str]) -> float:
    """Weight of the lexicon hits that lie in no exception phrase; of hits that begin alike the heaviest counts."""
    if not model.entries:
        return 0.0
    hits: dict[int, float] = {}
    pardoned = []
    for end, (weight, exception, length) in _automaton(model).iter(" " + " ".join(words) + " "):
        start = end - length + 1
        if exception:
            pardoned.append((start, end))
        else:
            hits[start] = max(hits.get(start, 0.0), weight)
    if pardoned:
        covered, reach = set(), -1
        ordered = sorted(pardoned)
        at = 0
        for start in sorted(hits):
            while at < len(ordered) and ordered[at][0] <= start:
                reach = max(reach, ordered[at][1])
                at += 1
            if start < reach:
                covered.add(start)
        return sum(w for s, w in hits.items() if s not in covered)
    return sum(hits.values())


def features(model: Model, text: str | None) -> tuple[float, float, int]:
    """log(1 + total weight), log(1 + weight per 100 words), words."""
    words = WORD.findall(fold(text)) if text else []
    total = _total(model, words)
    return math.log1p(total), math.log1p(100 * total / max(len(words), 1)), len(words)


def fit(training: DataFrame) -> Model:
    """A model from a bounded sample of rows (label_id, text, label), see ``common.labelled``.

    Distinct texts count once.  Words and their beginnings are counted in tasks and summed by Spark; only terms that
    are frequent and precise enough reach the driver.  Exceptions are words and word pairs that contain an entry
    and yet occur mostly in clean texts.  Without labelled rows of both kinds, every score is the plain base rate.
    """
    small_batches(training.sparkSession)
    rows = cut_lineage(training.groupBy("text").agg(F.min("label").alias("label")))
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_toxic, all_clean = totals.get(1, 0), totals.get(0, 0)
    if not all_toxic or not all_clean:
        base = math.log((all_toxic + 0.5) / (all_clean + 0.5)) if totals else -3.0
        return Model((), (), (base, 0.0, 0.0))

    def counter(terms):
        def count(batches):
            held = {0: Counter(), 1: Counter()}
            for pdf in batches:
                for text, label in zip(pdf["text"], pdf["label"], strict=True):
                    held[label].update(terms(WORD.findall(fold(text))))
                names = list(held[0].keys() | held[1].keys())
                if names:
                    yield pd.DataFrame({"term": names, "toxic": [held[1][t] for t in names], "clean": [held[0][t] for t in names]})
                held = {0: Counter(), 1: Counter()}

        summed = rows.select("text", "label").mapInPandas(count, "term string, toxic long, clean long").groupBy("term")
        return summed.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    telling = counter(_terms).where((F.col("toxic") >= LEAST_SUPPORT) & (share >= LEAST_PRECISION))
    entries = _entries(telling.orderBy(F.desc("toxic"), "term").limit(20 * LEXICON).collect(), all_toxic, all_clean)
    stems = {e for e, _ in entries}

    def contexts(words: list[str]) -> set[str]:
        found = set()
        for i, w in enumerate(words):
            if any(w[:n] in stems for n in range(STEM[0], len(w) + 1)):
                found.add(w)
                found.update(" ".join(words[a : a + 2]) for a in (i - 1, i) if a >= 0 and a + 2 <= len(words))
        return found

    benign = counter(contexts).where((F.col("clean") >= LEAST_SUPPORT) & (share <= EXCEPTION_PRECISION))
    exceptions = tuple(sorted(r["term"] for r in benign.orderBy(F.desc("clean"), "term").limit(LEXICON).collect())) if stems else ()
    draft = Model(tuple(entries), exceptions, (0.0, 0.0, 0.0))

    def measure(batches):
        for pdf in batches:
            x = [features(draft, t) for t in pdf["text"]]
            yield pd.DataFrame({"a": [v[0] for v in x], "b": [v[1] for v in x], "label": pdf["label"].to_numpy()})

    # equal feature values are merged, so the driver gets at most the sample's distinct values
    measured = rows.select("text", "label").mapInPandas(measure, "a double, b double, label int").toPandas()
    x = np.column_stack([np.ones(len(measured)), measured["a"], measured["b"]])
    return Model(draft.entries, exceptions, tuple(map(float, _logistic(x, measured["label"].to_numpy(float)))))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``weight`` (of all hits) and ``n_words``.

    Null and empty texts have no hit and get the score of a text without one.  Whole texts are scanned; repeated
    rows are scored each by itself; an empty table gives an empty result.
    """
    constant, by_total, by_density = model.weights

    def judge(texts):
        x = [features(model, t) for t in texts]
        z = np.array([constant + by_total * a + by_density * b for a, b, _ in x])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), [math.expm1(a) for a, _, _ in x], [n for _, _, n in x]

    return annotate(docs, "score double, weight double, n_words long", judge, text, keep)
