"""Language identification by string kernels.

A text, lower-cased, with all ASCII other than letters made white space, is the set of its byte n-grams of lengths
``NGRAMS`` (a blended spectrum of presences), hashed into ``DIMENSIONS``. The kernel of two texts is the size of the
common set over the geometric mean of both sizes. Landmarks (at most ``LANDMARKS`` texts of each language) give a
Nyström map; one-versus-rest kernel ridge regression on at most ``TRAIN`` texts of each language gives its weights. The
map and the weights fold into one matrix, so scoring is two matrix products for a batch of texts.

A null text, or one without a letter, is ``und`` with score 0. Ties go to the language that sorts first. If nothing can
be learned (no labelled text), every text is ``und``. Texts of any length are read whole. Repeated rows get equal results
and count once in the sample; rows without an id aren't learned from. An empty table gives an empty table. Columns of the
input named like a new one are replaced, all others pass through, whatever their names.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_python_columns
from .sampling import first_of_each, fit_once

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NGRAMS, DIMENSIONS, LANDMARKS, TRAIN, RIDGE = (1, 2, 3), 8192, 40, 400, 0.1
UNKNOWN = "und"
FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def presences(texts: list[str | None]) -> np.ndarray:
    """One row of 0/1 for each text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts, strict=True):
        raw = b" " + b" ".join((text or "").lower().encode().translate(FOLD).split()) + b" "
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        code = np.zeros(len(b), np.uint32)
        for n in range(1, max(NGRAMS) + 1):
            if len(b) < n:
                break
            code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
            if n in NGRAMS:
                row[(code * np.uint32(2654435761)) >> np.uint32(32 - 13)] = 1
    return out


def kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    return (x @ z.T) / np.sqrt(x.sum(axis=1)[:, None] * z.sum(axis=1)[None, :])


def fit(texts: list[str], langs: list[str]) -> dict[str, np.ndarray]:
    names = sorted(set(langs))
    if not names:
        return {"names": np.array([], "U1"), "landmarks": np.zeros((0, DIMENSIONS), np.uint8), "weights": np.zeros((0, 0))}
    langs = np.array(langs)
    marks = np.concatenate([np.flatnonzero(langs == n)[:LANDMARKS] for n in names])
    x = presences(texts)
    z = x[marks]
    values, vectors = np.linalg.eigh(kernel(z, z).astype(np.float64))
    good = values > 1e-6 * values.max()
    to_map = vectors[:, good] / np.sqrt(values[good])
    phi = kernel(x, z) @ to_map
    sizes = np.array([(langs == n).sum() for n in names])
    y = np.where(langs[:, None] == np.array(names)[None, :], 1.0, -1.0)
    each = (1.0 / sizes)[np.searchsorted(names, langs)][:, None]  # every language counts alike
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    pull = RIDGE / len(x) * np.eye(phi1.shape[1])
    pull[-1, -1] = 1e-9
    w = np.linalg.solve(phi1.T @ (phi1 * each) + pull, phi1.T @ (y * each))
    return {"names": np.array(names), "landmarks": z.astype(np.uint8), "weights": np.vstack([to_map @ w[:-1], w[-1:]])}


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict[str, np.ndarray]:
    """A model from the documents with a text and a language; ``doc_id`` only orders the sample."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    known = known.select(F.col(lang).alias("label"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sizes = known.groupBy("label").agg(F.count("*").alias("n")).withColumn("bound", F.lit(TRAIN))
    first = first_of_each(known, "label", "id", sizes)  # at most TRAIN rows of each language
    picked = known.join(F.broadcast(first.distinct()), ["id", "label"]).groupBy("id", "label").agg(F.min("text").alias("text"))
    return fit_once(picked, ["text", "label"], _fit_ordered)


def _fit_ordered(texts: list[str], langs: list[str]) -> dict[str, np.ndarray]:
    rows = sorted((t, l) for t, l in zip(texts, langs, strict=True) if has_letter(t))
    order = np.random.default_rng(5).permutation(len(rows))
    return fit([rows[i][0] for i in order], [rows[i][1] for i in order])


def identify(df: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1: the winning regression's output, clipped from -1..1)."""

    def make():
        names = [str(n) for n in model["names"]]
        z, w = model["landmarks"].astype(np.float32), model["weights"]

        def run(texts):
            if not names:
                return [[UNKNOWN] * len(texts), [0.0] * len(texts)]
            known = [has_letter(t) for t in texts]
            out = kernel(presences(texts), z) @ w[:-1] + w[-1]
            best = out.argmax(axis=1)
            top = np.clip((out.max(axis=1) + 1) / 2, 0, 1)
            return [
                [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
                [float(s) if k else 0.0 for s, k in zip(top, known, strict=True)],
            ]

        return run

    return with_python_columns(df, [text], {"lang_pred": "string", "score": "double"}, make)
