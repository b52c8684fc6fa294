"""Regridding between regular grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.functions.grid import CELL


def regrid_nearest(src: DataFrame, target: DataFrame, lat_of: Column, lon_of: Column) -> DataFrame:
    """The nearest source cell of each target cell, by one index per axis.

    ``lat_of`` and ``lon_of`` give the source index from target columns, as ``nearest_index`` does.
    """
    rows = target.withColumns({"src_lat": lat_of, "src_lon": lon_of})
    return rows.join(src, ["src_lat", "src_lon"], "left").drop("src_lat", "src_lon")


def _overlaps(start: Column, end: Column, size: float) -> Column:
    """Indexes of target intervals [i size, (i + 1) size) that meet [start, end)."""
    return F.sequence(F.floor(start / size).cast("int"), (F.ceil(end / size) - 1).cast("int"))


def remap_weights(cells: DataFrame, src_size: float, dst_size: float, lat0: float = 90.0) -> DataFrame:
    """The sparse weight matrix (src_lat, src_lon, lat_idx, lon_idx, weight) of conservative means; build it once, store it.

    ``cells`` are source cells (src_lat, src_lon); (i, j) covers latitudes lat0 - src_size * (i, i + 1) and longitudes
    src_size * (j, j + 1); target cells likewise with ``dst_size``. Each source cell is exploded to the few targets it
    overlaps; a weight is the longitude overlap times the difference of sines of latitude.
    """
    a, b = F.col("src_lat") * src_size, (F.col("src_lat") + 1) * src_size
    c, d = F.col("src_lon") * src_size, (F.col("src_lon") + 1) * src_size
    rows = cells.select("src_lat", "src_lon").distinct().withColumn("lat_idx", F.explode(_overlaps(a, b, dst_size))).withColumn("lon_idx", F.explode(_overlaps(c, d, dst_size)))
    top, low = F.greatest(a, F.col("lat_idx") * dst_size), F.least(b, (F.col("lat_idx") + 1) * dst_size)
    left, right = F.greatest(c, F.col("lon_idx") * dst_size), F.least(d, (F.col("lon_idx") + 1) * dst_size)
    w = (right - left) * (F.sin(F.radians(F.lit(lat0) - top)) - F.sin(F.radians(F.lit(lat0) - low)))
    return rows.withColumn("weight", w).filter(F.col("weight") > 1e-15)


def apply_weights(src: DataFrame, weights: DataFrame, value: str = "v", keys: list[str] = ()) -> DataFrame:
    """Remapped means of each target cell for each of ``keys`` (time steps, variables): one equi-join, one aggregate.

    Null cells carry no weight; a target whose cells are all null at a step has no row there.
    """
    rows = src.filter(F.col(value).isNotNull()).join(weights, ["src_lat", "src_lon"])
    return rows.groupBy(*CELL, *keys).agg((F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias(value))


def regrid_conservative(src: DataFrame, src_size: float, dst_size: float, lat0: float = 90.0, value: str = "v") -> DataFrame:
    """First-order conservative means of one field on a coarser or shifted grid; see ``remap_weights`` and ``apply_weights``."""
    return apply_weights(src, remap_weights(src, src_size, dst_size, lat0), value)


def ensemble_median(df: DataFrame, value: str = "v", keys: list[str] = CELL) -> DataFrame:
    """The median over members of each cell."""
    return df.groupBy(*keys).agg(F.median(value).alias("median"))


def source_check(cube: DataFrame, raw: DataFrame, value: str = "v", keys: list[str] = CELL) -> DataFrame:
    """Stored minus raw, and rows that stand on one side only."""
    both = cube.select(*keys, F.col(value).alias("stored")).join(raw.select(*keys, F.col(value).alias("raw")), keys, "full")
    side = F.when(F.col("stored").isNull(), "raw").when(F.col("raw").isNull(), "stored").otherwise("both")
    return both.withColumns({"diff": F.col("stored") - F.col("raw"), "side": side})
