"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqloom.llm.common import annotate, slices, small_batches

SAMPLE = 8_000  # labelled documents that the field is fitted on
CHAIN = 200  # lines of a training chain; longer documents give several
ROUNDS = 3  # fits, each on lines relabelled by the one before
STEPS = 120  # gradient steps of a fit
SHRINK = 1e-3
# Kinds of characters that features count apart.
MARKS = "#$%&*@^~=_<>{}[]\\+"
CLASSES = 8


@functools.cache
def _classes() -> np.ndarray:
    """Per code point: 0 other, 1 lower or uncased letter, 2 upper, 3 digit, 4 space, 5 bar, 6 exclamation, 7 mark."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            kinds[i] = 2 if c.isupper() else 1
        elif c.isdigit():
            kinds[i] = 3
        elif c.isspace():
            kinds[i] = 4
    kinds[ord("|")], kinds[ord("!")] = 5, 6
    kinds[[ord(c) for c in MARKS]] = 7
    return kinds


def _steps(values: np.ndarray, *bounds: float) -> np.ndarray:
    return np.stack([values > b for b in bounds], axis=1)


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their weights (length, 1 at least) and the number of lines of each text.

    A text's lines are its parts between line feeds; null and empty texts have one empty line.  A line's features
    are its own, those of the lines before and after it in its text, and whether it is the first or last.
    """
    split = [(t or "").split("\n") for t in texts]
    counts = np.array([len(x) for x in split])
    lines = [line for x in split for line in x]
    points = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(x) for x in lines])
    ends = np.cumsum(lengths + 1)
    kinds = _classes()[points]
    # every line ends with its line feed, so no segment is empty; the line feed is taken off the spaces again
    of_kind = np.stack([np.add.reduceat(kinds == k, ends - lengths - 1, dtype=np.int64) for k in range(CLASSES)], axis=1)
    of_kind[:, 4] -= 1
    n = np.maximum(lengths, 1)
    share = of_kind / n[:, None]
    words = [line.split() for line in lines]
    many = np.array([len(w) for w in words])
    distinct = np.array([len(set(w)) for w in words]) / np.maximum(many, 1)
    repeats = np.array([sum(map(operator.eq, w, w[1:])) for w in words]) / np.maximum(many, 1)
    twice = []
    for x in split:
        seen: set[str] = set()
        for line in x:
            twice.append(line in seen and bool(line))
            seen.add(line)
    letters = np.maximum(of_kind[:, 1] + of_kind[:, 2], 1)
    upper = of_kind[:, 2] / letters
    closed = np.array([line.rstrip()[-1:] in ".!?:;…" and bool(line.strip()) for line in lines])
    opened = np.array([line.lstrip()[:1].isupper() for line in lines])
    size = np.maximum(many, 1)
    own = np.column_stack([
        np.log1p(lengths) / 5, np.log1p(many) / 3, share, upper, distinct, repeats, np.array(twice), closed, opened,
        np.minimum(lengths / size / 10, 2), lengths == 0, many == 1,
        _steps(upper, 0.3, 0.7), _steps(repeats, 0.05, 0.3, 0.7), _steps(share[:, 5], 0.02, 0.08), _steps(share[:, 6], 0.02, 0.1),
        _steps(share[:, 7], 0.02, 0.1, 0.25), _steps(share[:, 3], 0.1, 0.4), _steps(share[:, 0], 0.05, 0.15),
        _steps(1 - distinct, 0.3, 0.6), (1 - distinct) * (many > 20),
    ]).astype(np.float32)
    first = np.zeros(len(lines), dtype=bool)
    last = first.copy()
    stops = np.cumsum(counts)
    first[stops - counts], last[stops - 1] = True, True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    full = np.column_stack([np.ones(len(lines), np.float32), own, before, after, first, last]).astype(np.float32)
    return full, n.astype(float), counts


class _Chains:
    """Chains of lines laid out step by step, the longest chain first, so that a step is one array operation."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        starts = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        self.active = [int((sizes > t).sum()) for t in range(int(sizes[0]) if len(sizes) else 0)]
        self.starts = starts

    def run(self, scores: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: each line's marginals and the sum of the pair marginals; states are bad, good."""
        emit = np.exp(scores - scores.max(axis=1, keepdims=True))
        move = np.exp(change)
        n = len(scores)
        forward, backward = np.empty((n, 2)), np.ones((n, 2))
        for t, k in enumerate(self.active):
            at = self.starts[:k] + t
            here = emit[at] if t == 0 else emit[at] * (forward[at - 1] @ move)
            forward[at] = here / here.sum(axis=1, keepdims=True)
        pairs = np.zeros((2, 2))
        for t in range(len(self.active) - 1, 0, -1):
            at = self.starts[: self.active[t]] + t
            ahead = emit[at] * backward[at]
            behind = ahead @ move.T
            weight = (forward[at - 1] * behind).sum(axis=1)
            pairs += np.einsum("ni,nj->ij", forward[at - 1] / weight[:, None], ahead) * move
            backward[at - 1] = behind / behind.sum(axis=1, keepdims=True)
        marginals = forward * backward
        return marginals / marginals.sum(axis=1, keepdims=True), pairs


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the good state; the bad state's are zero
    change: np.ndarray  # transition weights, bad and good
    calibration: tuple[float, float]


def _goodness(model: Model, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    scores = np.zeros((len(x), 2))
    scores[:, 1] = x @ (model.weights / model.scale).astype(np.float32) - float(model.centre @ (model.weights / model.scale))
    return _Chains(counts).run(scores, model.change)[0][:, 1]


def _documents(good: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals, as log odds."""
    starts = np.cumsum(counts) - counts
    share = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return np.log(share / (1 - share))


def _fit_field(x: np.ndarray, y: np.ndarray, importance: np.ndarray, counts: np.ndarray, start: Model) -> Model:
    """Gradient ascent (Adam) on the weighted conditional likelihood of the line labels."""
    z = x - start.centre
    z /= start.scale
    chains = _Chains(counts)
    stops = np.cumsum(counts)
    follows = np.ones(len(y), dtype=bool)
    follows[stops - counts] = False
    at = np.flatnonzero(follows)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    theta = np.concatenate([start.weights, start.change.ravel()])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    scores = np.zeros((len(x), 2))
    for step in range(1, STEPS + 1):
        scores[:, 1] = z @ theta[:-4].astype(np.float32)
        marginals, pairs = chains.run(scores, theta[-4:].reshape(2, 2))
        gradient = np.concatenate([z.T @ (importance * (y - marginals[:, 1])).astype(np.float32), (seen - pairs).ravel()]) / len(y) - SHRINK * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(start.centre, start.scale, theta[:-4], theta[-4:].reshape(2, 2), start.calibration)


def _calibrate(values: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * values, -30, 30)))
        h = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum(), ((y - p) * values).sum() - 0.1 * b])
        m = np.array([[h.sum(), (h * values).sum()], [(h * values).sum(), (h * values**2).sum() + 0.1]])
        da, db = np.linalg.solve(m, g)
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


def fit(training: DataFrame) -> Model:
    """A model from a bounded sample of rows (label_id, text, label), see ``common.labelled``.

    Line features are computed in tasks; the driver gets those of the bounded sample.  Only documents are labelled,
    so the field is fitted several times: at first every line has its document's label, later the lines of bad
    documents that the last fit holds for good become good, except the worst.  A logistic curve then turns the
    length-weighted marginals into probabilities.  Without labelled rows of both kinds every score is the base rate.
    """
    small_batches(training.sparkSession)

    def measure(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in slices([len(t) for t in texts], 1 << 18):
                x, weight, counts = line_features(texts[a:b])
                stops = np.cumsum(counts)
                yield pd.DataFrame({
                    "key": pdf["label_id"].to_numpy()[a:b], "label": pdf["label"].to_numpy()[a:b], "lines": counts,
                    "x": [x[s - n : s].tobytes() for s, n in zip(stops, counts, strict=True)],
                    "weight": [weight[s - n : s].tobytes() for s, n in zip(stops, counts, strict=True)],
                })

    rows = training.select("label_id", "text", "label")
    kind = dict(rows.dtypes)["label_id"]
    found = rows.mapInPandas(measure, f"key {kind}, label int, lines int, x binary, weight binary").toPandas().sort_values("key", kind="stable")
    width = line_features([""])[0].shape[1]
    if found["label"].nunique() < 2:
        base = 0.0 if found.empty else 3.0 if found["label"].iloc[0] else -3.0
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), (base, 0.0))
    # single precision throughout: the sample's features are the driver's largest arrays
    x = np.frombuffer(b"".join(found.pop("x")), dtype=np.float32).reshape(-1, width)
    weight = np.frombuffer(b"".join(found["weight"]), dtype=float)
    counts, label = found["lines"].to_numpy(), found["label"].to_numpy()
    chains = np.concatenate([[CHAIN] * (n // CHAIN) + [n % CHAIN] * bool(n % CHAIN) for n in counts]).astype(int)
    centre, scale = x.mean(axis=0, dtype=float), np.sqrt(np.maximum((x**2).mean(axis=0, dtype=float) - x.mean(axis=0, dtype=float) ** 2, 0))
    centre[0], scale = 0.0, np.where(scale > 1e-4, scale, 1.0)
    centre, scale = centre.astype(np.float32), scale.astype(np.float32)
    model = Model(centre, scale, np.zeros(width), np.zeros((2, 2)), (0.0, 1.0))
    owner = np.repeat(np.arange(len(counts)), counts)
    of_document = label[owner]
    # long documents weigh less per line, so that each document counts alike up to ten lines
    importance = 1 / np.sqrt(np.minimum(counts, CHAIN))[owner]
    y = of_document.copy()
    for _ in range(ROUNDS):
        model = _fit_field(x, y, importance, chains, model)
        good = _goodness(model, x, counts)
        worst = np.minimum.reduceat(good, np.cumsum(counts) - counts)[owner]
        y = np.where((of_document == 0) & ((good < 0.5) | (good <= worst)), 0, 1)
    model.calibration = _calibrate(_documents(_goodness(model, x, counts), weight, counts), label.astype(float))
    return model


def label_lines(model: Model, texts: list[str | None]) -> list[list[float]]:
    """The probability of every line of each text to be good."""
    x, _, counts = line_features(texts)
    good = _goodness(model, x, counts)
    return [part.tolist() for part in np.split(good, np.cumsum(counts)[:-1])]


def _judge(model: Model):
    shift, slope = model.calibration

    def judge(texts):
        x, weight, counts = line_features(texts)
        good = _goodness(model, x, counts)
        z = shift + slope * _documents(good, weight, counts)
        bad = np.add.reduceat((good < 0.5).astype(np.int64), np.cumsum(counts) - counts)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), counts, bad

    return judge


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is better), ``n_lines`` and ``bad_lines``.

    Null and empty texts are one empty line.  Whole texts are judged, however long; repeated rows each by itself;
    an empty table gives an empty result.
    """
    return annotate(docs, "score double, n_lines long, bad_lines long", _judge(model), text, keep)


def keep_good(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with the columns of ``docs``."""
    judge = _judge(model)
    return annotate(docs, "__score double", lambda texts: judge(texts)[:1], text).where(F.col("__score") >= threshold).select(docs.columns)
