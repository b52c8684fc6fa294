"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Rows of a written table up to which it is broadcast, and up to which it is one range.
BROADCAST_ROWS, ONE_RANGE = 1_000_000, 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and all runs on one machine, a temporary one."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return f"file://{_OWN['dir']}"


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cubespark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that haven't been written elsewhere are lost."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, on any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """Broadcast a written table of a few short columns if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def in_ranges(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` written in as many ranges of ``order`` as there are shuffle partitions, with the number of its range in ``_p``.

    A table of at most ONE_RANGE rows is one range.
    """
    rows = written(df, name)
    if rows.count() <= ONE_RANGE:
        return rows.withColumn("_p", F.lit(0))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), name)


def sums_before(parts: DataFrame, sums: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """(by, _p) with the sums of all ranges before each in ``<name>_before`` and of all in ``<name>_all``; one row for each range."""
    rows = parts.groupBy(*by, "_p").agg(*[v.alias(k) for k, v in sums.items()])
    w = Window.partitionBy(*(by or [F.lit(0)]))
    run = w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    more = [c for k in sums for c in (F.coalesce(F.sum(k).over(run), F.lit(0)).alias(f"{k}_before"), F.sum(k).over(w).alias(f"{k}_all"))]
    return rows.select(*by, "_p", *more)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Add the position of each row in ``order``, from 0, and ``<out>_all``, their number: windows span one range each."""
    rows = in_ranges(df, order, "ranges")
    before = sums_before(rows, {"n": F.count("*")})
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    rows = rows.withColumn("_i", at).join(F.broadcast(before), "_p")  # one row for each range
    return rows.withColumns({out: F.col("n_before") + F.col("_i"), f"{out}_all": F.col("n_all")}).drop("_p", "_i", "n_before", "n_all")
