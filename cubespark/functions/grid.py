"""The 0.1 degree grid: integer indexes are the keys, degrees and chunks follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.functions.values import count_upto

CELL = ["lat_idx", "lon_idx"]
LON0, LAT0, STEP, N_LON, N_LAT, CHUNK = -74.5, 76.5, 0.1, 1460, 1140, 20


def longitude(idx: Column | str) -> Column:
    return F.lit(LON0) + F.lit(STEP) * F.col(idx) if isinstance(idx, str) else F.lit(LON0) + F.lit(STEP) * idx


def latitude(idx: Column | str) -> Column:
    return F.lit(LAT0) - F.lit(STEP) * (F.col(idx) if isinstance(idx, str) else idx)


def chunk_of(idx: str, size: int = CHUNK) -> Column:
    return F.floor(F.col(idx) / size).cast("int")


def cell_coords(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Degrees and chunk of each cell."""
    return df.withColumns({"lat": latitude("lat_idx"), "lon": longitude("lon_idx"), "chunk_lat": chunk_of("lat_idx", chunk), "chunk_lon": chunk_of("lon_idx", chunk)})


def bbox(df: DataFrame, lon0: float, lon1: float, lat0: float, lat1: float) -> DataFrame:
    """cells inside a box, as ranges of the integer keys, so that they reach the scan."""
    at = lambda x, zero, sign: sign * (x - zero) / STEP
    eps = 1e-6
    return df.filter(
        F.col("lon_idx").between(at(lon0, LON0, 1) - eps, at(lon1, LON0, 1) + eps) & F.col("lat_idx").between(at(lat1, LAT0, -1) - eps, at(lat0, LAT0, -1) + eps)
    )


def region_rules(lat: Column, lon: Column) -> Column:
    """the land regions that folds may use."""
    return (lon > -25) & ((lat <= 16.5) | (lat > 32.5)) & ((lat < 60) | (lon > 0))


def nearest_index(x: Column, zero: float, step: float) -> Column:
    """F10 on a regular axis: the index of the nearest coordinate (halves go up)."""
    return F.floor((x - zero) / step + 0.5).cast("int")


def nearest_label(df: DataFrame, axis: DataFrame, x: str, label: str) -> DataFrame:
    """F10 on an irregular axis: add the nearest label, the smaller one on ties.

    The sorted labels are one value; each row finds its neighbours in it by bisection.
    """
    labels = axis.agg(F.sort_array(F.collect_set(label))).scalar()

    def best(ends: Column) -> Column:
        low, high = F.coalesce(ends["low"], ends["high"]), F.coalesce(ends["high"], ends["low"])
        return F.when(F.abs(high - F.col(x)) < F.abs(low - F.col(x)), high).otherwise(low)

    upto = count_upto(F.col("_labels"), F.col(x))
    ends = F.transform(F.array(upto), lambda n: F.struct(F.get("_labels", n - 1).alias("low"), F.get("_labels", n).alias("high")))
    return df.withColumn("_labels", labels).withColumn(f"nearest_{label}", F.transform(ends, best)[0]).drop("_labels")


def roi_from_anchor(df: DataFrame, lon: float, lat: float, n_lon: int, n_lat: int, chunk: int = CHUNK) -> DataFrame:
    """n_lon x n_lat chunks right of and above the chunk edge nearest to an anchor."""
    edge = lambda d: round(d / STEP / chunk) * chunk
    left, low = edge(lon - LON0), edge(LAT0 - lat)
    return df.filter(F.col("lon_idx").between(left, left + n_lon * chunk - 1) & F.col("lat_idx").between(low - n_lat * chunk, low - 1))
