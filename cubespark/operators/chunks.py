"""User functions on lat/lon chunks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cubespark.functions.grid import CELL
from cubespark.operators.masks import CHUNK_KEYS, mask_chunks, with_chunks
from cubespark.operators.reshape import densify
from cubespark.operators.series import cells

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def chunk_apply(
    df: DataFrame, fn: Callable[..., pd.DataFrame], schema: str, size: int, mask: DataFrame | None = None, args: tuple = (), combine: DataFrame | None = None, keys: list[str] = CELL
) -> DataFrame:
    """``fn(pandas frame of a chunk, *args)`` on each chunk; with a mask, on chunks with a valid cell only.

    Results are listed by chunk (columns chunk_lat, chunk_lon come first); with ``combine``, a spine of ``keys``, they form one
    dataset on it, null where no chunk gave a row. A chunk has a fixed number of cells, so a group holds the series of at
    most ``size * size`` cells.
    """
    rows = with_chunks(df, size) if mask is None else mask_chunks(df, mask, size)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf, *args)
        return pd.concat([pd.DataFrame({c: [k] * len(out) for c, k in zip(CHUNK_KEYS, key, strict=True)}, index=out.index), out], axis=1)

    out = rows.groupBy(*CHUNK_KEYS).applyInPandas(run, f"chunk_lat int, chunk_lon int, {schema}")
    return out if combine is None else densify(out.drop(*CHUNK_KEYS), combine, keys)


def chunk_stream(df: DataFrame, fn: Callable[..., Iterator[pd.DataFrame]], schema: str, size: int, mask: DataFrame | None = None, order: tuple[str, ...] = ("date",), args: tuple = ()) -> DataFrame:
    """X1 in bounded memory: ``fn(series, *args)`` gets an iterator over the cells of a chunk, each a pandas frame in ``order``, and
    yields frames of ``schema``. A task holds one cell's series at a time, however many cells and years a chunk has.

    Series that ``fn`` doesn't take are passed over. Results have columns chunk_lat, chunk_lon first.
    """
    rows = with_chunks(df, size) if mask is None else mask_chunks(df, mask, size)
    rows = rows.repartition(*CHUNK_KEYS).sortWithinPartitions(*CHUNK_KEYS, *CELL, *order)
    out = StructType.fromDDL(f"chunk_lat int, chunk_lon int, {schema}")
    arrow = to_arrow_schema(out)

    def run(batches):
        series = ((table.column("chunk_lat")[0].as_py(), table.column("chunk_lon")[0].as_py(), table) for _, _, table in cells(batches))
        for key, group in groupby(series, key=lambda x: x[:2]):
            for pdf in fn((table.to_pandas() for _, _, table in group), *args):
                pdf = pd.concat([pd.DataFrame({c: [k] * len(pdf) for c, k in zip(CHUNK_KEYS, key, strict=True)}, index=pdf.index), pdf], axis=1)
                yield from pa.Table.from_pandas(pdf, arrow, preserve_index=False).to_batches()

    return rows.mapInArrow(run, out)


def chunk_complete(saved: DataFrame, expected: DataFrame, flush: bool = False) -> DataFrame:
    """N2, batch form: chunks whose saved samples have reached the expected number; ``flush`` adds the others."""
    done = saved.groupBy(*CHUNK_KEYS).count().withColumnRenamed("count", "saved").join(expected, CHUNK_KEYS)
    out = done.withColumn("complete", done["saved"] >= done["samples"])
    return out if flush else out.filter("complete")


def spread_of(pdf: pd.DataFrame, scale: float, value: str = "v") -> pd.DataFrame:
    """A function for ``chunk_apply``: the scaled range of each cell's values."""
    cells = pdf.groupby(["lat_idx", "lon_idx"])[value]
    return ((cells.max() - cells.min()) * scale).rename("spread").reset_index()


def spreads_of(series: Iterator[pd.DataFrame], scale: float, value: str = "v") -> Iterator[pd.DataFrame]:
    """A function for ``chunk_stream``: the same, cell by cell."""
    for pdf in series:
        spread = (pdf[value].max() - pdf[value].min()) * scale
        yield pd.DataFrame({"lat_idx": pdf["lat_idx"].iloc[:1], "lon_idx": pdf["lon_idx"].iloc[:1], "spread": [spread]})
