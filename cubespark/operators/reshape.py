"""Projections and reshapes of cell tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORT = {"latitude": "lat", "longitude": "lon"}


def rename(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Lower case, coordinate names shortened, then ``names`` applied."""
    low = df.toDF(*[c.lower() for c in df.columns])
    return low.withColumnsRenamed(SHORT | {k.lower(): v for k, v in (names or {}).items()})


def rename_suffix(df: DataFrame, columns: list[str], add: str = "", drop: str = "") -> DataFrame:
    """Take a suffix off column names and put one on."""
    return df.withColumnsRenamed({c: (c.removesuffix(drop) if drop else c) + add for c in columns})


def stack_dims(df: DataFrame, dims: list[str], keys: list[str], new_dim: str, start_at_zero: bool = True) -> DataFrame:
    """P5: fuse ordered coordinates into one integer per series: 0..n-1, or -n+1..0."""
    w = Window.partitionBy(*keys).orderBy(*dims)
    at = F.row_number().over(w) - 1
    return df.withColumn(new_dim, at if start_at_zero else at - F.count("*").over(Window.partitionBy(*keys)) + 1)


def pack_channels(df: DataFrame, columns: list[str], out: str = "channels") -> DataFrame:
    """P10: several variables as one array, in the order given."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns])).drop(*columns)


def unpack_channels(df: DataFrame, columns: list[str], packed: str = "channels") -> DataFrame:
    """The inverse of ``pack_channels``."""
    return df.withColumns({c: F.col(packed)[i] for i, c in enumerate(columns)}).drop(packed)


def to_long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Wide -> (keys, variable, value)."""
    return df.unpivot(keys, columns, "variable", "value")


def repeat_time(df: DataFrame, n: int, t: str = "t") -> DataFrame:
    """Every step n times."""
    return df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(t, F.col(t) * n + F.col("_i")).drop("_i")


def drop_value(df: DataFrame, x: str, v: float, out: str = "kept") -> DataFrame:
    """Entries equal to v become 0, the others are scaled by n / n_kept; no entry kept is an error."""
    sums = df.agg(F.count(x).alias("_n"), F.count_if(F.col(x) != v).alias("_k"))
    factor = F.when(F.col("_k") > 0, F.col("_n") / F.col("_k")).otherwise(F.raise_error(F.lit("no value is kept")).cast("double"))
    scale = sums.select(factor.alias("_s")).filter(F.col("_s").isNotNull())
    return df.join(F.broadcast(scale)).withColumn(out, F.when(F.col(x) == v, 0.0).otherwise(F.col(x) * F.col("_s"))).drop("_s")


def avg_pool_time(df: DataFrame, k: int, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Means of whole blocks of k steps; an incomplete last block is left out."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    blocks = df.withColumn("block", F.floor(at / k)).groupBy(*keys, "block").agg(F.avg(value).alias("mean"), F.count("*").alias("_n"))
    return blocks.filter(F.col("_n") == k).drop("_n")


def densify(df: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of the spine, with values where there are any."""
    return spine.join(df, keys, "left")


def empty_like(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same coordinates, all else null."""
    return df.select(*[F.col(c) if c in keys else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])


def last_n(df: DataFrame, n: int, keys: list[str], order: Column | str) -> DataFrame:
    """the last n steps of each series."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc() if isinstance(order, str) else order.desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def first_n(df: DataFrame, n: int, keys: list[str], order: str) -> DataFrame:
    """the first n steps of each series."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_r") <= n).drop("_r")


def frame_range(df: DataFrame, order: list[str], frames: int | range = -1) -> DataFrame:
    """the rows of some time steps of all series: the first so many, an explicit range of positions (with its stride), or all (-1).

    Positions count the distinct steps of ``df`` from 0; the time axis is what is numbered, never the rows.
    """
    if isinstance(frames, int) and frames == -1:
        return df
    want = range(frames) if isinstance(frames, int) else frames
    if want.step < 1:
        raise ValueError("frames ascend")
    axis = df.select(*order).distinct().withColumn("_at", F.row_number().over(Window.orderBy(*order)) - 1)
    axis = axis.filter((F.col("_at") >= want.start) & (F.col("_at") < want.stop) & ((F.col("_at") - want.start) % want.step == 0))
    return df.join(F.broadcast(axis.drop("_at")), order, "left_semi")  # a time axis


def shuffled(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """An order that only the keys and the seed decide."""
    return df.withColumn("order_key", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))))
