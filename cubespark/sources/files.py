"""Partitioned cell tables: scans, spines, ingest and write-back."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.functions import dates, values
from cubespark.functions.grid import CELL


def _in(df: DataFrame, column: str, want) -> DataFrame:
    return df if want == "*" else df.filter(F.col(column).isin(want if isinstance(want, (list, tuple)) else [want]))


def scan_files(spark: SparkSession, path: str, variables="*", scales="*", years="*", months="*", must_exist: bool = True) -> DataFrame:
    """Rows of a table partitioned by variable, scale, year, month. Each argument is a value, a list or ``*``.

    Rows of static variables (scale ``static``) have null year and month and ignore both. No match is an error.
    """
    df = _in(_in(spark.read.parquet(path), "variable", variables), "scale", scales)
    for column, want in (("year", years), ("month", months)):
        if want != "*":
            df = df.filter(F.col(column).isin(want if isinstance(want, (list, tuple)) else [want]) | (F.col("scale") == "static"))
    if must_exist and df.isEmpty():
        raise FileNotFoundError(f"nothing matches in {path}")
    return df


def parse_source_name(name) -> list:
    """``var.scale.nx.ny.MM.YYYY.nc`` -> variable, scale, month, year and the canonical name."""
    part = F.split(name, r"\.")
    variable, scale, month, year = (F.get(part, F.lit(i)) for i in (0, 1, 4, 5))
    canonical = F.concat_ws(".", F.lower(variable), scale, year, F.lpad(month, 2, "0"))
    return [F.lower(variable).alias("variable"), scale.alias("scale"), month.cast("int").alias("month"), year.cast("int").alias("year"), canonical.alias("canonical")]


def cube_spine(cells: DataFrame, start: str, end: str, hourly: bool = False) -> DataFrame:
    """S3: every day (and hour) of a span for every cell; a year means its first or last day."""
    full = lambda x, tail: f"{x}{tail}" if len(x) == 4 else x
    days = F.sequence(F.lit(full(start, "-01-01")).cast("date"), F.lit(full(end, "-12-31")).cast("date"), F.expr("interval 1 day"))
    out = cells.select(*cells.columns, F.explode(days).alias("date"))
    return out.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))) if hourly else out


def seasonal_spine(cells: DataFrame, hourly: bool = False) -> DataFrame:
    """S3: the 366 seasonal days (and hours) of every cell."""
    out = cells.select(*cells.columns, F.explode(F.sequence(F.lit(1), F.lit(366))).alias("doy"))
    return out.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))) if hourly else out


def layout_of(df: DataFrame) -> str:
    """Static without time, hourly if the step is one hour, daily otherwise; irregular steps are an error.

    Stamps all at one full hour of the day are daily if there are two days or more, or if that hour is midnight; a single
    stamp at another hour is hourly.
    """
    if "ts" not in df.columns:
        return "static"
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    seen = df.select(t.alias("t")).agg(
        F.count_if(F.col("t") % 3600 != 0).alias("odd"), F.min(F.col("t") % 86400).alias("low"), F.max(F.col("t") % 86400).alias("high"), F.min("t").alias("first"), F.max("t").alias("last")
    ).first()
    if seen["odd"]:
        raise ValueError("time steps are neither hourly nor daily")
    one_hour = seen["low"] == seen["high"]
    return "daily" if one_hour and (seen["first"] != seen["last"] or not seen["low"]) else "hourly"


def ingest(df: DataFrame, variable: str, path: str, value: str = "value", layout: str | None = None) -> str:
    """Write one variable into its time regions; a rerun replaces the months it holds and no others.

    ``layout`` (static, daily or hourly) is inferred from the time steps if it isn't given.
    """
    layout = layout or layout_of(df)
    out = df.withColumn(value, values.convert_units(variable, F.col(value).cast("double")).cast("float")).withColumns({"variable": F.lit(variable), "scale": F.lit(layout)})
    if layout == "static":
        out = out.withColumns({"year": F.lit(None).cast("int"), "month": F.lit(None).cast("int")})
    else:
        out = dates.split_day_hour(out)
        out = (out if layout == "hourly" else out.drop("hour")).withColumns({"year": F.year("date"), "month": F.month("date")})
    target = f"{path}/{layout}"
    parts = ["variable", "scale", "year", "month"]
    out.repartition(*parts, *[F.floor(F.col(c) / 20) for c in CELL]).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*parts).parquet(target)
    return target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def _on(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to its end there."""
    fs, at = _on(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _on(spark, path)
    fs.delete(at, True)


def stored_months(spark: SparkSession, path: str, variable: str, months: DataFrame, schema: str) -> DataFrame:
    """What a table written by ``ingest`` holds of a variable in some (year, month); nothing if it isn't there yet."""
    schema = f"{schema}, variable string, scale string, year int, month int"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).filter(F.col("variable") == variable).join(F.broadcast(months), ["year", "month"], "left_semi")


def write_derived(df: DataFrame, path: str, parts: tuple[str, ...] = ("chunk_lat", "chunk_lon")) -> None:
    """Write chunks of a derived variable; chunks that ``df`` doesn't hold stay as they are."""
    df.repartition(*parts).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*parts).parquet(path)


def write_by_cell(df: DataFrame, table: str, path: str, buckets: int, order: tuple[str, ...] = ("date",), partitions: tuple[str, ...] = ()) -> DataFrame:
    """Write a table whose rows of a cell share a bucket, sorted by cell and time, and read it back.

    Windows, groups and joins by cell then need no exchange. Rows are dealt by cell once before, so each bucket of a
    partition is one file. ``path`` is where its files lie; a table of that name is replaced.
    """
    writer = df.repartition(buckets, *CELL).write.mode("overwrite").option("path", path).bucketBy(buckets, *CELL).sortBy(*CELL, *order)
    (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(table, format="parquet")
    return df.sparkSession.table(table)


def write_predictions(pred: DataFrame, stats: DataFrame, spine: DataFrame, num_days: int, path: str, target: str = "v", kinds: tuple[str, ...] = ("ts",)) -> None:
    """The last ``num_days`` of each cell, denormalised and named ``<target>[_kind]_hat``, on the full spine.

    pred: cell, date and one column ``<kind>`` for each kind, normalised; stats: one row mean, std.
    """
    from cubespark.operators.reshape import densify, last_n

    rows = last_n(pred, num_days, CELL, "date").crossJoin(F.broadcast(stats))
    name = {k: target + ("" if k == "ts" else f"_{k}") + "_hat" for k in kinds}
    rows = rows.select(*CELL, "date", *[values.normalize(F.col(k), F.col("mean"), F.col("std"), invert=True).alias(name[k]) for k in kinds])
    out = densify(rows, spine, [*CELL, "date"]).withColumns({"chunk_lat": F.floor(F.col("lat_idx") / 20), "chunk_lon": F.floor(F.col("lon_idx") / 20)})
    write_derived(out, path)


def var_catalog(df: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per variable: name, long_name, units, mean, std; ``names`` maps a column to (long_name, units)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], list(names), "variable", "value")
    text = F.create_map(*[F.lit(x) for c, (full, unit) in names.items() for x in (c, f"{full}\t{unit}")])
    both = F.split(text[F.col("variable")], "\t")
    stats = long.groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return stats.select("variable", both[0].alias("long_name"), both[1].alias("units"), "mean", "std")


def with_metadata(df: DataFrame, catalog: dict[str, dict]) -> DataFrame:
    """The catalog's entries as metadata of the columns."""
    return df.select(*[F.col(c).alias(c, metadata=catalog[c]) if c in catalog else F.col(c) for c in df.columns])


def scan_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """All JSON event files below a folder, with the trial from the folder's name."""
    schema = "wall_time double, name string, step bigint, value double"
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    return rows.withColumn("trial", F.regexp_extract(F.col("_metadata.file_path"), r"trial=?(\d+)", 1).cast("int"))
