"""Metric logs of trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order given."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def pivot_metrics(df: DataFrame, names: list[str], keys: tuple[str, ...] = ("trial", "step")) -> DataFrame:
    """One column for each metric name."""
    return df.groupBy(*keys).pivot("name", names).agg(F.first("value"))


def best_trial(df: DataFrame, trial: str = "trial", score: str = "score") -> DataFrame:
    """The trial of the lowest score, the first on ties; an empty table is an error."""
    best = df.agg(F.min(F.struct(score, trial)).alias("b"))
    found = F.when(F.col("b").isNull(), F.raise_error(F.lit("no trials")).cast("int")).otherwise(F.col("b")[trial])
    return best.select(found.alias(trial), F.col("b")[score].alias(score))


def best_so_far(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The running minimum."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.min(value).over(w))


def early_stop_step(df: DataFrame, keys: list[str], order: list[str], value: str, patience: int = 20, min_delta: float = 0.0) -> DataFrame:
    """Checks, the check of the last improvement and its value, and the check at which training stops (or null).

    A check improves if it is below the best one before by more than ``min_delta``; after ``patience`` checks without
    one, training stops, and later checks don't count.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("check", F.row_number().over(w)).withColumn("_prior", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    better = F.col("_prior").isNull() | (F.col(value) < F.col("_prior") - min_delta)
    rows = rows.withColumn("_hit", F.max(F.when(better, F.col("check"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_stop", F.min(F.when(F.col("check") - F.col("_hit") >= patience, F.col("check"))).over(Window.partitionBy(*keys)))
    lived = rows.filter(F.col("_stop").isNull() | (F.col("check") <= F.col("_stop")))
    return lived.groupBy(*keys).agg(F.max("check").alias("checks"), F.max("_hit").alias("best_check"), F.min(value).alias("best"), F.first("_stop").alias("stop_check"))
