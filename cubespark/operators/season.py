"""Mean seasonal cycles, anomalies and flux from accumulated series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubespark.functions.grid import CELL


def msc_raw(df: DataFrame, value: str = "v", keys: list[str] = CELL, out: str = "m") -> DataFrame:
    """A1: the mean over years by cell (and hour, if a key) and day of year; nulls are skipped."""
    return df.groupBy(*keys, F.dayofyear("date").alias("doy")).agg(F.avg(value).alias(out))


def _smoothed(days: Column, half: int, least: int) -> Column:
    """An array of 366 circular means from a map of days to values; null below ``least`` values."""
    year = F.transform(F.sequence(F.lit(1), F.lit(366)), lambda d: F.element_at(days, d))
    padded = F.concat(F.slice(year, 367 - half, half), year, F.slice(year, 1, half))

    def mean(near: Column) -> Column:
        total = F.aggregate(near, F.lit(0.0), lambda s, v: s + v)
        return F.when(F.size(near) >= least, total / F.size(near))

    around = lambda p: F.transform(F.sequence(F.lit(1), F.lit(366)), lambda d: F.filter(F.slice(p, d, 2 * half + 1), lambda v: v.isNotNull()))
    return F.transform(F.transform(F.array(padded), around)[0], mean)


def smooth_msc(raw: DataFrame, value: str = "m", keys: list[str] = CELL, out: str = "v_msc", half: int = 8, least: int = 5) -> DataFrame:
    """Circular centered mean over 2 * half + 1 days of 1..366, null below ``least`` values; all 366 days appear.

    The days of a cell (at most 366) are one row; a mean without a day counts nowhere. Rows dealt by cell before (``df.repartition(*keys)``) aren't moved again.
    """
    days = raw.groupBy(*keys).agg(F.map_from_entries(F.filter(F.collect_list(F.struct("doy", value)), lambda x: x["doy"].isNotNull())).alias("_days"))
    rows = days.select(*keys, F.posexplode(_smoothed(F.col("_days"), half, least)).alias("_at", out))
    return rows.select(*keys, (F.col("_at") + 1).alias("doy"), out)


def msc_align(msc: DataFrame, ref: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """The seasonal value of each date of ``ref``."""
    if "doy" not in msc.columns or "date" not in ref.columns:
        raise ValueError("msc needs doy, ref needs date")
    return ref.withColumn("doy", F.dayofyear("date")).join(msc, [*keys, "doy"], "left")


def anomaly(df: DataFrame, value: str = "v", keys: list[str] = CELL, half: int = 8, least: int = 5) -> DataFrame:
    """Value minus the smoothed seasonal cycle of its day, as ``doy``, ``<value>_msc`` and ``<value>_ano``.

    All is one sort of each cell's rows by day of year (one exchange by cell; none on a table bucketed by cell): rows of one day are
    peers, the first of them carries the day's mean into the circular window. Rows without a date, or of days with too few
    means around, have null ``_msc``. Columns of ``df`` named like a new one are replaced.
    """
    new = ["doy", f"{value}_msc", f"{value}_ano"]
    rows = df.select(*[F.col(c) for c in df.columns if c not in new], F.dayofyear("date").alias("doy"))
    by_day = Window.partitionBy(*keys).orderBy("doy")
    first = ~F.lag("doy", 1).over(by_day).eqNullSafe(F.col("doy")) & F.col("doy").isNotNull()
    rows = rows.withColumn("_mean", F.when(first, F.avg(value).over(by_day.rangeBetween(0, 0))))
    # Days of the year at most ``half`` away, round the turn of the year.
    near = [by_day.rangeBetween(low, high) for low, high in ((-half, half), (366 - half, 366 + half), (-366 - half, -366 + half))]
    total = sum((F.coalesce(F.sum("_mean").over(w), F.lit(0.0)) for w in near[1:]), F.coalesce(F.sum("_mean").over(near[0]), F.lit(0.0)))
    n = sum((F.count("_mean").over(w) for w in near[1:]), F.count("_mean").over(near[0]))
    rows = rows.withColumns({"_total": total, "_n": n})
    rows = rows.withColumn(f"{value}_msc", F.when(F.col("doy").isNotNull() & (F.col("_n") >= least), F.col("_total") / F.col("_n")))
    return rows.withColumn(f"{value}_ano", F.col(value) - F.col(f"{value}_msc")).drop("_mean", "_total", "_n")


def cumulative_to_flux(df: DataFrame, value: str, keys: list[str] = CELL, out: str = "flux") -> DataFrame:
    """An accumulation that restarts each day, as amounts per step; the last step of a series is 0."""
    w = Window.partitionBy(*keys).orderBy("date", "hour")
    ahead = F.lead(value).over(w)
    last = F.row_number().over(w) == F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(last, 0.0).when(F.col("hour") == 0, ahead).otherwise(ahead - F.col(value)))


def infer_step(df: DataFrame, ts: Column | str, keys: list[str]) -> DataFrame:
    """The step of each series in seconds, whether it is regular, and whether it is hourly."""
    at = F.unix_timestamp(ts) if isinstance(ts, str) else ts
    w = Window.partitionBy(*keys).orderBy("_t")
    rows = df.withColumn("_t", at).withColumn("_d", F.col("_t") - F.lag("_t").over(w))
    seen = rows.groupBy(*keys).agg(F.min("_d").alias("step"), F.max("_d").alias("_max"))
    return seen.withColumn("regular", F.coalesce(F.col("step") == F.col("_max"), F.lit(False))).withColumn("hourly", F.coalesce(F.col("regular") & (F.col("step") == 3600), F.lit(False))).drop("_max")
