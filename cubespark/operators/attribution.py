"""Baselines, integrated gradients of Column scores, cross-validated linear models."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubespark.functions.grid import CELL

#: Central differences step by this share of the larger of 1 and the value; exact for quadratic scores.
STEP = 1e-4


def baselines(df: DataFrame, msc: DataFrame, static: DataFrame, dynamic: list[str], statics: list[str], precip_zero: bool = False) -> DataFrame:
    """Reference inputs ``<name>_base``: the aligned seasonal cycle, 0 for tp if asked, the global mean of statics."""
    rows = df.withColumn("doy", F.dayofyear("date")).join(msc, [*CELL, "doy"], "left")
    rows = rows.withColumns({f"{c}_base": F.lit(0.0) if c == "tp" and precip_zero else F.col(f"{c}_msc") for c in dynamic})
    means = static.agg(*[F.avg(c).alias(f"{c}_base") for c in statics])
    return rows.crossJoin(F.broadcast(means))


def integrated_gradients(df: DataFrame, score: Callable[[dict[str, Column]], Column], features: list[str], n_steps: int = 50, keep: list[str] = ()) -> DataFrame:
    """One column ``attr_<feature>`` for each feature; base values stand in ``<feature>_base``.

    The path integral is a Gauss-Legendre sum; the derivative at each node is a central difference of the score, which
    is any function from feature columns to a column. The nodes are one array literal, summed inside each row: no rows
    are added and nothing is shuffled.
    """
    x, w = np.polynomial.legendre.leggauss(n_steps)
    nodes = F.array(*[F.struct(F.lit(float((a + 1) / 2)).alias("a"), F.lit(float(b / 2)).alias("w")) for a, b in zip(x, w, strict=True)])
    base = {f: F.col(f"{f}_base") for f in features}

    def slope(node: Column, f: str) -> Column:
        at = {g: base[g] + node["a"] * (F.col(g) - base[g]) for g in features}
        h = STEP * F.greatest(F.lit(1.0), F.abs(at[f]))
        return (score(at | {f: at[f] + h}) - score(at | {f: at[f] - h})) / (2 * h)

    total = lambda f: F.aggregate(nodes, F.lit(0.0), lambda s, n: s + n["w"] * slope(n, f))
    return df.select(*keep, *[((F.col(f) - base[f]) * total(f)).alias(f"attr_{f}") for f in features])


def context_join(targets: DataFrame, series: DataFrame, k: int, keys: list[str] = CELL) -> DataFrame:
    """For each target day the k days up to it, offset -k+1..0, as an equi-join on the exploded days."""
    days = targets.select(*keys, F.col("date").alias("time"), F.explode(F.sequence(F.lit(-k + 1), F.lit(0))).alias("context"))
    days = days.withColumn("date", F.date_add("time", F.col("context")))
    return days.join(series, [*keys, "date"])


def context_index(df: DataFrame, end: Column, length: int, first: str, last: str, out: tuple[str, str, str] = ("start_index", "end_index", "context_start")) -> DataFrame:
    """Positions of a context of ``length`` days before ``end`` in a series that spans first..last (dates)."""
    zero = F.lit(first).cast("date")
    start = F.date_sub(end, length - 1)
    bad = (start < zero) | (end > F.lit(last).cast("date"))
    checked = F.when(bad, F.raise_error(F.lit("the context leaves the series")).cast("int")).otherwise(F.datediff(start, zero))
    return df.withColumns({out[0]: checked, out[1]: F.datediff(end, zero), out[2]: start})


def attribution_span(df: DataFrame, start: Column, end: Column, context: int, window_start: Column, window_end: Column, days: Column) -> DataFrame:
    """Where an attribution from ``start`` to ``end`` lies in data of ``days`` days up to ``window_end``.

    Adds the dates data_start and context_start and, counted from data_start, start_index and end_index. A start outside
    the window, or a context that begins before the data, is an error.
    """
    data_start, context_start = F.date_sub(window_end, days - 1), F.date_sub(start, context - 1)
    bad = F.when((start < window_start) | (start > window_end), "the start is out of the window").when(context_start < data_start, "the context is too large")
    index = F.when(bad.isNotNull(), F.raise_error(bad).cast("int")).otherwise(F.datediff(start, data_start))
    return df.withColumns({"data_start": data_start, "context_start": context_start, "start_index": index, "end_index": F.datediff(end, data_start)})


def attr_daily(df: DataFrame, keys: list[str], feature: str = "feature", value: str = "attr") -> DataFrame:
    """Mean attribution over the hours of each context day."""
    return df.groupBy(*keys, "time", "context", feature).agg(F.avg(value).alias(value))


def fit_predict_cv(df: DataFrame, x: str | list[str], y: str, k: int, fold: str = "fold_mask", all_folds: bool = False) -> DataFrame:
    """Least squares on the train folds of each iteration; predictions ``<y>_hat`` for its test fold, or rows of all folds.

    Sums of products of each fold add up to those of any set of folds, so the data is read once to fit all. The k small
    systems (one unknown for each feature and the intercept) are solved on the driver. A row with a missing value isn't
    learned from; with a missing feature, its prediction is null. Of collinear features the shortest solution counts.
    """
    names = [x] if isinstance(x, str) else list(x)
    ok = df.filter(F.col(fold) > 0)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*names, y]])
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in [*names, y]]]
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    sums = ok.filter(whole).groupBy(fold).agg(*[F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect()  # one row a fold
    p, rows = len(names) + 1, []
    for i in range(k):
        m = np.zeros((p + 1, p + 1))
        for r in sums:
            if r[fold] not in (i % k + 1, (i + 1) % k + 1):
                for a, b in pairs:
                    m[a, b] += r[f"s{a}_{b}"]
        m = np.triu(m) + np.triu(m, 1).T
        if m[0, 0]:
            scale = np.sqrt(np.maximum(np.diag(m)[:p], 1e-300))
            beta = np.linalg.lstsq(m[:p, :p] / np.outer(scale, scale), m[:p, p] / scale, rcond=1e-13)[0] / scale
            rows.append(((i + 1) % k + 1, i, [float(b) for b in beta]))
    model = df.sparkSession.createDataFrame(rows, "_test int, fold_id int, _beta array<double>")
    hat = sum((F.col("_beta")[i + 1] * F.col(c) for i, c in enumerate(names)), F.col("_beta")[0])
    if all_folds:  # k rows of coefficients for each row
        models = model.agg(F.sort_array(F.collect_list(F.struct("fold_id", "_beta")))).scalar()
        out = ok.withColumn("_m", F.explode(models)).select(*df.columns, "_m.fold_id", "_m._beta")
    else:
        out = ok.join(F.broadcast(model), F.col(fold) == F.col("_test")).drop("_test")
    return out.withColumn(f"{y}_hat", hat).drop("_beta")


def align_three(obs: DataFrame, msc: DataFrame, attr: DataFrame, keys: list[str]) -> DataFrame:
    """Observation, seasonality and attribution on a common time axis."""
    return obs.join(msc, keys).join(attr, keys)


def extract_series(df: DataFrame, lat: int, lon: int, n: int, order: str = "date") -> DataFrame:
    """The last n steps of one cell with their offsets from the end, -n+1..0."""
    from cubespark.operators.reshape import last_n, stack_dims

    rows = last_n(df.filter((F.col("lat_idx") == lat) & (F.col("lon_idx") == lon)), n, CELL, order)
    return stack_dims(rows, [order], CELL, "context", start_at_zero=False)
