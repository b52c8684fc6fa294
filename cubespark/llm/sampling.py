"""Bounded training samples, one-task fits of models whose size doesn't grow, and calibration of their scores."""

from __future__ import annotations

import io
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def id_modulo(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def class_bounds(n0: int, n1: int, bound: int) -> tuple[int, int]:
    """How many of n0 and n1 rows a sample of ``bound`` takes: in proportion, but of each at least an eighth of it or all."""
    least = bound // 8
    k1 = min(n1, max(least, bound * n1 // max(1, n0 + n1)), bound - min(n0, least))
    k0 = min(n0, bound - k1)
    return k0, min(n1, bound - k0)


def first_of_each(rows: DataFrame, key: str, doc_id: str, bounds: DataFrame) -> DataFrame:
    """(key, doc_id) of the first rows of each key by a hash of the id; bounds: (key, n, bound) with n rows of the key.

    Only rows whose hash is below a limit that about ``bound`` of n rows meet are ranked, so that few rows move and no
    task gets many of one key, however many it has. A key that the limit left short gets one four times as high.
    """
    at = F.xxhash64(F.col(doc_id).cast("string"))
    bounds = written(bounds.filter("bound > 0"), "bounds")
    near, factor = None, 1
    while near is None or not short.isEmpty():
        limit = factor * (F.col("bound") + 6 * F.sqrt("bound") + 20) / F.col("n")
        near = rows.select(key, doc_id, at.alias("_at")).join(F.broadcast(bounds), key)
        near = written(near.filter(F.col("_at") / 2.0**64 + 0.5 <= limit).drop("n"), "near")
        short = bounds.join(near.groupBy(key).agg(F.count("*").alias("got")), key, "left")
        short = short.filter((F.coalesce("got", F.lit(0)) < F.least("n", "bound")) & (factor * F.col("bound") < F.col("n")))
        factor *= 4
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_at", doc_id))
    return written(near.withColumn("_n", rank).filter(F.col("_n") <= F.col("bound")).select(key, doc_id), "sample-ids")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, float]:
    """(text, label) of at most ``bound`` labelled documents, filled by ``class_bounds``, each class by a hash of its ids.

    Also the log odds of label 1 among all labelled documents less those in the sample. Labels other than 0 and 1 are
    left out; of repeated ids one label (the largest) and one text count.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    rows = written(rows.join(docs.select(F.col(doc_id).alias("id")), "id", "left_semi"), "sample-labels")
    n = rows.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    bounds = class_bounds(*n, bound)
    sizes = docs.sparkSession.createDataFrame([(i, n[i], bounds[i]) for i in (0, 1)], "label int, n bigint, bound bigint")
    first = first_of_each(rows, "label", "id", sizes)  # at most ``bound`` rows
    found = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(first), "id")
    sample = written(found.groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label"), "sample")
    more = float(np.log(n[1] / bounds[1]) - np.log(n[0] / bounds[0])) if min(bounds) else 0.0
    return sample, more


def fit_once(sample: DataFrame, columns: list[str], fit: Callable[..., dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Run ``fit`` on a bounded sample in one task; arrays of a size that doesn't depend on it come back."""

    def run(batches):
        parts = [b for b in batches]
        values = [[x for b in parts for x in b.column(c).to_pylist()] for c in columns]
        out = io.BytesIO()
        np.savez(out, **fit(*values))
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    found = written(sample.select(*columns).repartition(1).mapInArrow(run, "model binary"), "model").first()
    if found is None:  # nothing to learn from
        return fit(*([] for _ in columns))
    with np.load(io.BytesIO(found["model"])) as got:
        return {k: got[k] for k in got.files}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pull = np.diag([*[ridge] * (x.shape[1] - 1), 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
