"""Quality classifier: naive Bayes support vectors.

Features are presences of n-grams of words (1, 2) and of word shapes (1 to 3), hashed into ``DIMENSIONS``; a shape says
how a word is cased, which kinds of other characters it holds, and whether it repeats the word before. Each feature is
scaled by the log-count ratio of the two classes, rows have unit length, and dual coordinate descent fits a linear
hinge-loss model. A logistic curve, fitted on rows held back from it, turns margins into scores.

The model is fitted on at most ``SAMPLE`` labelled documents, at least an eighth of them of each label where there are so
many, and set back to the share of label 1 among all. Null and empty texts have no features and get the score
of the intercept alone. Labels other than 0 and 1 are left out; with no label of one class, all scores are the smoothed share
of label 1. Texts of any length are read whole. Repeated rows get equal scores (no ties to break) and count once in the
sample. An empty table gives an empty table. Columns named ``score`` are replaced, all others pass through.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import per_worker, with_python_columns
from .sampling import fit_once, labelled_sample, logistic, probability

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS, SAMPLE, COST, EPOCHS, SMOOTH, MEMORY = 18, 8000, 1.0, 12, 1.0, 200_000
DIMENSIONS = 1 << BITS
_UPPER, _LETTERS, _DIGITS, _RUN = (re.compile(p) for p in (r"[A-ZÀ-ÖØ-Þ]{2,}", r"[^\W\d_U]+", r"\d+", r"([^\w\s])\1+"))


def shape(word: str) -> str:
    """``Word,`` -> ``w,``; ``WORD!!`` -> ``U!+``; ``word$$$`` -> ``w$+``; ``1.2`` -> ``9.9``."""
    return _RUN.sub(r"\1+", _DIGITS.sub("9", _LETTERS.sub("w", _UPPER.sub("U", word))))


class Words(dict):
    """Word -> the 32-bit hash of it in lower case, then that of its shape, in one integer."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh32_intdigest(word.lower()) << 32 | xxhash.xxh32_intdigest(shape(word), seed=1)
        if len(self) < MEMORY and len(word) <= 64:
            self[word] = value
        return value


def features(text: str | None, words: dict) -> np.ndarray:
    """Distinct feature numbers of a whole text."""
    tokens = (text or "").split()
    if not tokens:
        return np.zeros(0, np.int64)
    both = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    w, s = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    s[1:] += np.uint64(77) * (w[1:] == w[:-1]).astype(np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    grams = [w, s + np.uint64(1 << 33)]
    if len(w) > 1:
        s2 = s[:-1] * m + s[1:]
        grams += [(w[:-1] * m + w[1:]) ^ np.uint64(3), s2 ^ np.uint64(5)]
        if len(w) > 2:
            grams.append((s2[:-1] * m + s[2:]) ^ np.uint64(7))
    h = np.concatenate(grams)
    h = (h ^ (h >> np.uint64(31))) * m
    return np.unique((h >> np.uint64(64 - BITS)).astype(np.int64))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Weights (last: intercept) of an L2-regularised hinge-loss model on rows of scaled, unit-length indicators."""
    rng = np.random.default_rng(11)
    w, alpha = np.zeros(DIMENSIONS + 1), np.zeros(len(rows))
    values = [ratio[r] / max(1e-12, np.sqrt(np.square(ratio[r]).sum())) if len(r) else np.zeros(0) for r in rows]
    size = np.array([v @ v + 1 for v in values])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            slope = y[i] * (w[r] @ v + w[-1]) - 1
            new = min(max(alpha[i] - slope / size[i], 0.0), COST)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def margin(r: np.ndarray, w: np.ndarray, ratio: np.ndarray) -> float:
    if not len(r):
        return float(w[-1])
    v = ratio[r]
    return float(w[r] @ v / max(1e-12, np.sqrt(v @ v)) + w[-1])


def fit(texts: list[str], labels: list[int]) -> dict[str, np.ndarray]:
    rows = sorted(zip(texts, labels, strict=True))
    order = np.random.default_rng(3).permutation(len(rows))
    y = np.array([2 * rows[i][1] - 1 for i in order], float)
    prior = (1 + (y > 0).sum()) / (2 + len(y))
    nothing = {"w": np.zeros(DIMENSIONS + 1, np.float32), "ratio": np.zeros(DIMENSIONS, np.float32), "curve": np.array([0.0, np.log(prior / (1 - prior))])}
    cut = len(y) * 4 // 5
    if len(set(y[:cut])) < 2 or len(set(y[cut:])) < 2:
        return nothing
    words = Words()
    x = [features(rows[i][0], words) for i in order]
    count = {c: SMOOTH + np.bincount(np.concatenate([r for r, v in zip(x[:cut], y[:cut], strict=True) if v == c]), minlength=DIMENSIONS) for c in (1, -1)}
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())
    ratio[count[1] + count[-1] <= 2 * SMOOTH + 1] = 0  # seen once or never
    w = dual_descent(x[:cut], y[:cut], ratio)
    held = np.array([margin(r, w, ratio) for r in x[cut:]])
    curve = logistic(held[:, None], (y[cut:] > 0).astype(float), ridge=1e-2)
    return {"w": w.astype(np.float32), "ratio": ratio.astype(np.float32), "curve": curve}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict[str, np.ndarray]:
    """A model from at most SAMPLE labelled documents, set back to the share of label 1 among all."""
    sample, more = labelled_sample(docs, labels, label, SAMPLE)
    model = fit_once(sample, ["text", "label"], fit)
    return model | {"curve": model["curve"] + np.array([0.0, more])}


def score(df: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Add ``score``, 0 to 1."""

    def make():
        words = per_worker(Words)
        w, ratio, curve = model["w"], model["ratio"], model["curve"]

        def run(texts):
            margins = np.array([margin(features(t, words), w, ratio) for t in texts]).reshape(-1, 1)
            return [probability(margins, curve)]

        return run

    return with_python_columns(df, [text], {"score": "double"}, make)
