"""Losses that skip missing targets, and their roll-ups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.functions.values import finite

HUBER_DELTA, LEAST_VARIANCE = 0.3, 1e-6


def pred_obs(pred: DataFrame, obs: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions beside observations."""
    return pred.join(obs, keys)


def error(kind: str, p: Column, t: Column) -> Column:
    """l1, l2 or huber (delta 0.3) of one row."""
    e = F.abs(p - t)
    if kind == "l1":
        return e
    if kind == "l2":
        return e * e
    if kind == "huber":
        return F.when(e < HUBER_DELTA, 0.5 * e * e).otherwise(HUBER_DELTA * (e - 0.5 * HUBER_DELTA))
    raise ValueError(f"no such loss: {kind}")


def _reduced(rows: DataFrame, term: Column, sample: str | None, by: list[str]) -> DataFrame:
    """sum / n over valid rows, or the mean over samples of it."""
    rows = rows.withColumn("_e", term)
    if sample is None:
        return rows.groupBy(*by).agg((F.sum("_e") / F.count("_e")).alias("loss"))
    each = rows.groupBy(*by, sample).agg((F.sum("_e") / F.count("_e")).alias("_l"))
    return each.groupBy(*by).agg(F.avg("_l").alias("loss"))


def masked_loss(df: DataFrame, kind: str, sample: str | None = None, by: list[str] = (), prediction: str = "prediction", target: str = "target") -> DataFrame:
    """Over finite targets only; with ``sample``, the mean of the samples' own means. No valid row gives null."""
    term = F.when(finite(F.col(target)), error(kind, F.col(prediction), F.col(target)))
    return _reduced(df, term, sample, list(by))


def nll_term(m: Column, v: Column, y: Column, beta: float = 0.5) -> Column:
    """Gaussian negative log-likelihood, weighted by variance to the power beta."""
    v = F.greatest(v, F.lit(LEAST_VARIANCE))
    return (0.5 * (F.log(v) + (y - m) ** 2 / v) + 0.5 * math.log(2 * math.pi)) * v**beta


def beta_nll(df: DataFrame, beta: float = 0.5, sample: str | None = None, by: list[str] = (), prediction: str = "prediction", target: str = "target", variance: str = "variance") -> DataFrame:
    """The weighted likelihood over finite targets; a variance column is required."""
    if variance not in df.columns:
        raise ValueError("a variance is required")
    term = F.when(finite(F.col(target)), nll_term(F.col(prediction), F.col(variance), F.col(target), beta))
    return _reduced(df, term, sample, list(by))


def nan_loss(df: DataFrame, mode: str, reduction: str, sample: str, weight: str | None = None, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """A10: ``element``: weighted mean of all errors; ``batch``: (weighted) mean of the samples' means."""
    rows = df.withColumn("_e", F.when(finite(F.col(target)), error(mode, F.col(prediction), F.col(target))))
    w = F.col(weight) if weight else F.lit(1.0)
    if reduction == "element":
        return rows.filter("_e is not null").agg((F.sum(F.col("_e") * w) / F.sum(w)).alias("loss"))
    if reduction != "batch":
        raise ValueError(f"no such reduction: {reduction}")
    each = rows.groupBy(sample).agg(F.avg("_e").alias("_l"), F.avg(w).alias("_w")).filter("_l is not null")
    return each.agg((F.sum(F.col("_l") * F.col("_w")) / F.sum("_w")).alias("loss"))


def nan_mse_mae(df: DataFrame, by: list[str] = (), prediction: str = "prediction", target: str = "target") -> DataFrame:
    """Mean squared and mean absolute error over valid targets; null if there are none."""
    ok = finite(F.col(target))
    off = F.when(ok, F.col(prediction) - F.col(target))
    return df.groupBy(*by).agg(F.avg(off * off).alias("mse"), F.avg(F.abs(off)).alias("mae"))


def step_losses(df: DataFrame, kinds: list[str], num_days: int | None = None, sample: str = "sample", order: str = "step", tail: str = "window") -> DataFrame:
    """The loss of each predicted kind and their sum.

    Columns ``<kind>_hat``, ``<kind>`` and, for all kinds or none, ``<kind>_var``. With variances the likelihood, else
    l1. ``num_days`` scores the last so many steps of each sample; ``tail='reference'`` drops the first so many instead.
    """
    has = [f"{k}_var" in df.columns for k in kinds]
    if any(has) != all(has):
        raise ValueError("variances must be given for all kinds or none")
    if num_days is not None:
        from pyspark.sql import Window

        column = F.col(order).desc() if tail == "window" else F.col(order).asc()
        rank = F.row_number().over(Window.partitionBy(sample).orderBy(column))
        df = df.withColumn("_r", rank).filter(F.col("_r") <= num_days if tail == "window" else F.col("_r") > num_days)
    rows = [F.struct(F.lit(k).alias("kind"), F.col(f"{k}_hat").alias("prediction"), F.col(k).alias("target"), *([F.col(f"{k}_var").alias("variance")] if all(has) else [])) for k in kinds]
    long = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    each = beta_nll(long, by=["kind"]) if all(has) else masked_loss(long, "l1", by=["kind"])
    return each.unionByName(each.agg(F.lit("sum").alias("kind"), F.sum("loss").alias("loss")))


def epoch_mean(df: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """The mean of a metric weighted by batch size."""
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias(value))
