"""Language identification by nearest clustered centroid over normalised TF-IDF n-gram vectors."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqloom.llm.common import annotate, bounded_sample, slices, small_batches

DIMENSIONS = 8192  # hashed space of letter bigrams and trigrams
CLUSTERS = 4  # centroids per language
SAMPLE = 1500  # documents per language that centroids are fitted on; frequencies cover all documents
REJECT_QUANTILE = 0.002  # share of a cluster's own sample that lies beyond its rejection distance
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ngram_counts(texts: list[str | None]) -> np.ndarray:
    """One row of hashed counts per text: bigrams and trigrams of lower-case letters, other characters as breaks."""
    lowered = ["\0" + t.lower() + "\0" if t else "\0" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _letters()[points]
    points = np.where(letter, points, 0)
    first, second = points[:-1], points[1:]
    shift = 32 - DIMENSIONS.bit_length() + 1
    counts = np.zeros(len(texts) * DIMENSIONS, dtype=np.int64)
    pairs = first * np.uint32(2654435761) + second * np.uint32(2246822519)
    use = np.flatnonzero(letter[:-1] | letter[1:])
    use = use[owner[use] == owner[use + 1]]
    counts += np.bincount(owner[use] * DIMENSIONS + ((pairs[use] * np.uint32(3266489917)) >> np.uint32(shift)), minlength=len(counts))
    if len(points) > 2:
        triples = pairs[:-1] + points[2:] * np.uint32(668265263) + np.uint32(374761393)
        use = np.flatnonzero(letter[1:-1])
        use = use[owner[use] == owner[use + 2]]
        counts += np.bincount(owner[use] * DIMENSIONS + ((triples[use] * np.uint32(3266489917)) >> np.uint32(shift)), minlength=len(counts))
    return counts.reshape(len(texts), DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts, dtype=np.float32) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    idf: np.ndarray
    languages: list[str]  # one per centroid, the commonest language first
    centroids: np.ndarray
    reject: np.ndarray  # least cosine that a centroid accepts


def _frequencies(training: DataFrame) -> tuple[int, np.ndarray]:
    """Documents and document frequencies over all rows: one row per task and dimension meets in an aggregate."""

    def count(batches):
        total, seen = 0, np.zeros(DIMENSIONS, dtype=np.int64)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slices([len(t) for t in texts]):
                seen += (ngram_counts(texts[a:b]) > 0).sum(axis=0)
            total += len(texts)
        yield pd.DataFrame({"dimension": np.append(np.arange(DIMENSIONS), -1), "n": np.append(seen, total)})

    rows = training.select("text").mapInPandas(count, "dimension int, n long").groupBy("dimension").agg(F.sum("n").alias("n")).collect()
    found = {r["dimension"]: r["n"] for r in rows}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(DIMENSIONS)], dtype=np.int64)


def _cluster(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; returns unit centroids."""
    seeds = [points.mean(axis=0)]
    seeds[0] /= max(np.linalg.norm(seeds[0]), 1e-9)
    while len(seeds) < min(k, len(points)):
        seeds.append(points[np.argmin((points @ np.array(seeds).T).max(axis=1))])
    centres = np.array(seeds)
    for _ in range(rounds):
        near = np.argmax(points @ centres.T, axis=1)
        sums = np.stack([points[near == i].sum(axis=0) for i in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        fresh = np.where(norms > 0, sums / np.maximum(norms, 1e-9), centres).astype(np.float32)
        if np.allclose(fresh, centres, atol=1e-5):
            break
        centres = fresh
    return centres


def fit(training: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """A model from rows (key, text, lang) without nulls; ``sample`` documents per language at most shape centroids.

    Each language is clustered in a task of its own over its bounded sample; the driver gets only centroids.
    No rows, or rows without any letter, give a model without languages.
    """
    small_batches(training.sparkSession)
    total, seen = _frequencies(training)
    idf = (np.log((total + 1) / (seen + 1)) + 1).astype(np.float32)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values("key")["text"].tolist()
        points = np.concatenate([vectors(ngram_counts(texts[a:b]), idf) for a, b in slices([len(t) for t in texts])])
        points = points[points.any(axis=1)]
        if not len(points):
            return pd.DataFrame({"lang": [], "part": [], "centroid": [], "reject": []}, dtype=object)
        centres = _cluster(points, clusters)
        closeness = points @ centres.T
        near = closeness.argmax(axis=1)
        own = [closeness[near == i, i] for i in range(len(centres))]
        return pd.DataFrame(
            {
                "lang": pdf["lang"].iloc[0],
                "part": range(len(centres)),
                "centroid": [c.astype(np.float32).tobytes() for c in centres],
                "reject": [float(np.quantile(o, REJECT_QUANTILE)) if len(o) else 0.0 for o in own],
            }
        )

    rows = bounded_sample(training, "key", sample, per="lang").groupBy("lang").applyInPandas(
        centroids, "lang string, part int, centroid binary, reject double"
    ).collect()
    common = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sorted(rows, key=lambda r: (-common[r["lang"]], r["lang"], r["part"]))
    matrix = np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows]) if rows else np.zeros((0, DIMENSIONS), np.float32)
    return Model(idf, [r["lang"] for r in rows], matrix, np.array([r["reject"] for r in rows]))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine to the nearest centroid, 0 to 1) and ``rejected``.

    Texts that are null or have no letter, and all texts under a model without languages, get ``und`` and score 0
    and count as rejected.  ``rejected`` marks texts farther from their nearest centroid than its rejection
    distance; their nearest language is still given.  Ties go to the language that is commoner in training.
    Whole texts are used, repeated rows are judged each by itself, an empty table gives an empty result.
    """
    languages = np.array([*model.languages, UNKNOWN], dtype=object)

    def judge(texts):
        alpha = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
        if not model.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        closeness = vectors(ngram_counts(texts), model.idf) @ model.centroids.T
        near = closeness.argmax(axis=1)
        best = np.where(alpha, closeness[np.arange(len(texts)), near].astype(float), 0.0)
        far = best < model.reject[near]
        return languages[np.where(alpha, near, len(languages) - 1)], np.clip(best, 0.0, 1.0), far | ~alpha

    return annotate(docs, "lang_pred string, score double, rejected boolean", judge, text, keep)
