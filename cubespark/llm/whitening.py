"""Embedding whitening from exact, bit-sliced cross-products.

An entry c becomes the integer x = floor(1024 c) + 100000. Blocks of ``BLOCK_ROWS`` rows are shifted by the least x of each
dimension, and each bit plane of each dimension is packed across rows into 64-bit words. The population count of the AND of
two planes, times the weights of both bits, adds up to the exact cross-product of two dimensions; the shifts are put back
in whole numbers. A task adds up its blocks in Python integers and emits one row for each pair of dimensions, in limbs that
Spark adds as longs: what meets on the driver is as many rows as there are pairs, whatever the table's size. There
n * sum(xy) - sum(x) * sum(y) is centred as integers; only then come floats, eigenvalues and unit eigenvectors.

Rows go with a null vector, a null, NaN or infinite entry, or one that is too large for a long (2^52 or more in size). The
dimension is the length that most of the rows left have (of equally frequent ones the longest); rows of another length go
too. Equal rows count as often as they stand there. A component whose eigenvalue is not above rounding (1e-12 of the
trace) can't be scaled: its ``whitened`` is null and it doesn't count for ``identity_error``; ``explained`` is null if all
rows are equal. ``deviation`` is exact as decimal(38,0), null beyond. Eigenvalues that tie keep the order of the solver.
An empty table gives an empty table. Columns of the input named like a new one (in any case) are replaced; others pass.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT, BLOCK_ROWS = 1024, 100_000, 8192
#: Cross-products travel as so many limbs of so many bits, which add up as longs.
LIMBS, LIMB_BITS = 5, 40
LARGEST = 2.0**52
#: Share of the trace below which an eigenvalue is rounding.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n rows of so many dimensions, their sums, unit eigenvectors in columns, eigenvalues, and shares of the trace."""

    dimension: int
    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    scale: np.ndarray


def integers(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the numbers of rows with a whole vector of this length, and their integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    there = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == dimension)
    rows = np.flatnonzero(there)
    c = values[(offsets[rows, None] + np.arange(dimension)).astype(np.int64)] if len(rows) and dimension else np.zeros((len(rows), dimension))
    fine = (np.abs(c) < LARGEST).all(axis=1)  # false for NaN
    return rows[fine], np.floor(SCALE * c[fine]).astype(np.int64) + SHIFT


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, products) of a block of rows, exact, as Python integers in object arrays."""
    n, d = x.shape
    low = x.min(axis=0)
    y = x.astype(np.uint64) - low.astype(np.uint64)
    planes, dims, bits = [], [], []
    for b in range(int(y.max()).bit_length()):
        plane = np.packbits(((y >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        some = np.flatnonzero(plane.any(axis=1))
        planes.append(plane[some])
        dims.append(some)
        bits.append(np.full(len(some), b))
    low = low.astype(object)
    total, products = np.zeros(d, object), np.zeros((d, d), object)
    if planes:
        dim, bit, plane = np.concatenate(dims), np.concatenate(bits), np.concatenate(planes)
        order = np.argsort(dim, kind="stable")
        dim, bit = dim[order], bit[order]
        words = np.zeros((len(order), -(-plane.shape[1] // 8) * 8), np.uint8)
        words[:, : plane.shape[1]] = plane[order]
        words = words.view(np.uint64)
        weight = np.array([1 << int(b) for b in bit], object)
        counts = np.zeros((len(order), len(order)), np.int64)
        for k in range(len(order)):
            counts[k, k:] = np.bitwise_count(words[k:] & words[k]).sum(axis=1, dtype=np.int64)
        counts = np.triu(counts) + np.triu(counts, 1).T
        # Whole numbers of 64 bits hold a block's products up to 24 bits an entry; beyond, Python's integers do.
        wide = object if int(bit.max()) >= 24 else np.int64
        weight = weight.astype(wide)
        first = np.flatnonzero(np.r_[True, dim[1:] != dim[:-1]])
        weighed = counts.astype(wide) * weight[:, None] * weight[None, :]
        at = dim[first]
        products[np.ix_(at, at)] = np.add.reduceat(np.add.reduceat(weighed, first, axis=0), first, axis=1).astype(object)
        total[at] = np.add.reduceat(np.diagonal(counts).astype(wide) * weight, first).astype(object)
    shift = np.outer(total, low)
    return total + n * low, products + shift + shift.T + n * np.outer(low, low)


def _limbs(value: int) -> list[int]:
    """Signed value = sum of limb_k 2^(40 k), all but the last in [0, 2^40)."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB_BITS) - 1))
        value >>= LIMB_BITS
    return [*out, value]


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        _, x = integers(batch.column(0), dimension)
        for at in range(0, len(x), BLOCK_ROWS):
            held.append(x[at : at + BLOCK_ROWS])
            n += len(held[-1])
            if n >= BLOCK_ROWS:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def fit(df: DataFrame, vector: str = "embedding") -> Whitening:
    """Exact sums and cross-products of all usable rows, and the eigenvectors of their covariance."""
    spark = df.sparkSession
    entries = df.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    usable = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < F.lit(LARGEST)))
    sizes = entries.filter(usable).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max_by(F.struct("d", "n"), F.struct("n", "d")).alias("m")).first()["m"]
    d, n = (most["d"], most["n"]) if most else (0, 0)
    limbs = [f"l{k}" for k in range(LIMBS)]

    def run(batches):
        sums, products = np.zeros(d, object), np.zeros((d, d), object)
        some = False
        for x in _blocks(batches, d):
            s, p = cross_products(x)
            sums, products, some = sums + s, products + p, True
        if some:
            i, j = np.triu_indices(d)
            rows = [_limbs(int(v)) for v in [*sums, *products[i, j]]]
            names = [pa.array([*([-1] * d), *i.tolist()], pa.int64()), pa.array([*range(d), *j.tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays(names + [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["i", "j", *limbs])

    schema = "i bigint, j bigint, " + ", ".join(f"{c} bigint" for c in limbs)
    found = entries.mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in limbs])
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    for i, j, *parts in written(found, "scatter").collect() if d else ():  # one row for each pair of dimensions
        value = sum(int(p) << (LIMB_BITS * k) for k, p in enumerate(parts))
        if i < 0:
            sums[j] = value
        else:
            products[i, j] = products[j, i] = value
    centred = n * products - np.outer(sums, sums)
    v = np.array([[value / (n * n) for value in row] for row in centred], float).reshape(d, d)
    values, vectors = np.linalg.eigh(v) if d else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(v))
    fine = values > ROUNDING * trace
    scale = np.where(fine, 1 / np.sqrt(np.where(fine, values, 1)), np.nan)
    explained = [float(e) / trace if trace > 0 else None for e in values]
    return Whitening(d, n, sums, vectors, values, explained, scale)


def deviations(z: np.ndarray) -> list[int]:
    """Sums of squares of the rows of z, exact."""
    if not z.size:
        return [0] * len(z)
    if z.dtype == object or z.shape[1] * int(np.abs(z).max()) ** 2 >= 1 << 63:
        z = z.astype(object)
    return [int(v) for v in (z * z).sum(axis=1)]


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n x - S, exact."""
    if len(x) and model.n * int(np.abs(x).max()) + max(abs(int(s)) for s in model.sums) >= 1 << 62:
        return model.n * x.astype(object) - model.sums
    return model.n * x - model.sums.astype(np.int64)


def whiten(df: DataFrame, model: Whitening, components: int = 8, vector: str = "embedding") -> DataFrame:
    """The usable rows of ``df`` with ``whitened`` (an array, null where a component can't be scaled) and ``deviation``."""
    k = min(components, model.dimension)
    new = ("whitened", "deviation", "_v")
    keep = [c for c in df.columns if c.lower() not in new]
    # All that passes through lies in one struct, so no name can clash; the vector is read once more as doubles.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")]).alias("_row"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    schema = T.StructType([rows.schema["_row"]]).add("whitened", T.ArrayType(T.DoubleType())).add("deviation", T.StringType())

    def run(batches):
        axes = model.vectors[:, :k] * model.scale[:k]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                good, x = integers(part.column("_v"), model.dimension)
                if not len(good):
                    continue
                z = _centred(x, model)
                w = (z.astype(float) / model.n) @ axes
                flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1) * k, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column("_row").take(pa.array(good)), lists, pa.array(map(str, deviations(z)), pa.string())], names=["_row", "whitened", "deviation"])

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], "whitened", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"))


def identity_error(df: DataFrame, model: Whitening, components: int = 8, vector: str = "embedding") -> float | None:
    """Largest absolute entry of the covariance of ``whitened``, over all usable rows, minus the identity; None without rows."""
    k = min(components, model.dimension, int((~np.isnan(model.scale)).sum()))
    if not k or not model.n:
        return None

    def run(batches):
        axes = model.vectors[:, :k] * model.scale[:k]
        sums, products = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, model.dimension):
            w = (_centred(x, model).astype(float) / model.n) @ axes
            sums, products = sums + w.sum(axis=0), products + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k)), pa.array([*sums, *products.ravel()])], names=["i", "s"])

    entries = df.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    total = np.zeros(k + k * k)
    for i, s in entries.mapInArrow(run, "i bigint, s double").groupBy("i").agg(F.sum("s")).collect():  # k + k * k rows
        total[i] = s
    mean = total[:k] / model.n
    return float(np.abs(total[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())
