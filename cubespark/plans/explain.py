"""Queries on predictions and attributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cubespark.functions.grid import CELL
from cubespark.operators import attribution as at
from cubespark.operators import season, series
from cubespark.plans.cube import day, r
from cubespark.plans.masks import K, folds
from cubespark.plans.registry import query
from cubespark.sources import adapters as a

iso = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)


def score(x):
    """The quadratic y = a^2 + 2 b + a b."""
    return x["a"] * x["a"] + 2 * x["b"] + x["a"] * x["b"]


def inputs(spark, sf_dir):
    return a.cell_daily(spark, sf_dir).select(*CELL, "date", (F.col("v") / 10).alias("a"), (F.col("v2") / 10000).alias("b"), F.lit(0.51234567).alias("a_base"), F.lit(1.01234567).alias("b_base"))


IN = "(SELECT lat_idx, lon_idx, date, v / 10 AS a, v2 / 10000 AS b FROM cell_daily)"
# Closed form: the path integral of a quadratic is its difference over the midpoint gradient.
ATTR_A = "(a - 0.51234567) * ((a + 0.51234567) + (b + 1.01234567) / 2)"
ATTR_B = "(b - 1.01234567) * (2 + (a + 0.51234567) / 2)"


@query("x8_integrated_gradients", f"SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, round({ATTR_A}, 4) AS attr_a, round({ATTR_B}, 4) AS attr_b FROM {IN}")
def x8(spark, sf_dir):
    out = at.integrated_gradients(inputs(spark, sf_dir), score, ["a", "b"], 8, keep=[*CELL, "date"])
    return out.select(*CELL, day(), r("attr_a", digits=4), r("attr_b", digits=4))


@query("j6_context_join", "SELECT t.lat_idx, t.lon_idx, strftime(t.date, '%Y-%m-%d') AS time, CAST(d.date - t.date AS INTEGER) AS context, round(d.v, 6) AS v FROM cell_daily t JOIN cell_daily d ON d.lat_idx = t.lat_idx AND d.lon_idx = t.lon_idx AND d.date BETWEEN t.date - 29 AND t.date")
def j6(spark, sf_dir):
    daily = a.cell_daily(spark, sf_dir)
    return at.context_join(daily.select(*CELL, "date"), daily, 30).select(*CELL, iso("time"), "context", r("v"))


def decayed(rate: float, weights: list[float], static: float):
    """A score that couples all days of a context, the square of a decayed sum of daily means with a static beside it, and
    its derivatives."""

    def linear(x, s):
        k = x.shape[1]
        total = (x.mean(axis=2) * np.array(weights)).sum(axis=2) @ rate ** np.arange(k - 1, -1, -1.0)
        return total + static * s[:, 0]

    def score(x, s):
        return linear(x, s) ** 2

    def gradient(x, s):
        _, k, hours, _ = x.shape
        outer = 2 * linear(x, s)
        inner = rate ** np.arange(k - 1, -1, -1.0)[:, None, None] * np.array(weights) / hours
        return outer[:, None, None, None] * np.broadcast_to(inner, x.shape[1:]), static * outer[:, None]

    return score, gradient


def unsigned(name: str, digits: int):
    """Rounded, and no negative zero."""
    return (F.round(name, digits) + 0.0).alias(name)


SIZE_BASE = 25.5


def every_day(daily):
    """All cells with all days of the data."""
    span = daily.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return daily.select(*CELL).distinct().crossJoin(F.broadcast(span)).select(*CELL, F.explode(F.sequence("lo", "hi")).alias("date"))


def with_size(rows, spark, sf_dir):
    return rows.join(a.cell_static(spark, sf_dir).select(*CELL, "size"), CELL, "left").withColumn("size_base", F.lit(SIZE_BASE))


def day_contexts(spark, sf_dir):
    found = inputs(spark, sf_dir).select(*CELL, "date", "a", "b").withColumn("target", F.lit(True))
    rows = with_size(every_day(found).join(found, [*CELL, "date"], "left"), spark, sf_dir)
    rows = rows.withColumns({"a_base": F.lit(0.51234567), "b_base": F.lit(1.01234567)})
    score, gradient = decayed(0.5, [1.0, 0.3], 0.1)
    return series.attribute_contexts(rows, score, ["a", "b"], ["size"], 7, 8, gradient, target="target")


# With a linear sum u inside the square, the integral for an element is its difference times its weight times u(x) + u(b).
DAYS = f"""WITH x AS ({IN[1:-1]}), c AS (SELECT t.lat_idx, t.lon_idx, t.date AS time, CAST(o AS INTEGER) AS context, coalesce(d.a, 0.51234567) AS a, coalesce(d.b, 1.01234567) AS b
 FROM x t CROSS JOIN (SELECT unnest(range(-6, 1)) AS o) LEFT JOIN x d ON d.lat_idx = t.lat_idx AND d.lon_idx = t.lon_idx AND d.date = t.date + CAST(o AS INTEGER)
 WHERE t.date - 6 >= (SELECT min(date) FROM x)),
u AS (SELECT lat_idx, lon_idx, time, sum(pow(0.5, -context) * (a + 0.3 * b)) + 0.1 * coalesce(any_value(size), {SIZE_BASE}) AS ux, sum(pow(0.5, -context) * (0.51234567 + 0.3 * 1.01234567)) + 0.1 * {SIZE_BASE} AS ub, coalesce(any_value(size), {SIZE_BASE}) AS size
 FROM c LEFT JOIN cell_static USING (lat_idx, lon_idx) GROUP BY 1, 2, 3)"""


@query(
    "x9_attribution_days",
    f"""{DAYS} SELECT lat_idx, lon_idx, strftime(time, '%Y-%m-%d') AS time, context, 'a' AS feature, round((a - 0.51234567) * pow(0.5, -context) * (ux + ub), 4) + 0.0 AS attr FROM c JOIN u USING (lat_idx, lon_idx, time)
UNION ALL SELECT lat_idx, lon_idx, strftime(time, '%Y-%m-%d'), context, 'b', round((b - 1.01234567) * pow(0.5, -context) * 0.3 * (ux + ub), 4) + 0.0 FROM c JOIN u USING (lat_idx, lon_idx, time)""",
)
def x9(spark, sf_dir):
    out = series.attributions_long(day_contexts(spark, sf_dir), ["a", "b"])
    return out.select(*CELL, iso("time"), "context", "feature", unsigned("attr", 4))


@query("x9_attribution_statics", f"{DAYS} SELECT lat_idx, lon_idx, strftime(time, '%Y-%m-%d') AS time, round((size - {SIZE_BASE}) * 0.1 * (ux + ub), 4) + 0.0 AS attr_size FROM u")
def x9_statics(spark, sf_dir):
    return day_contexts(spark, sf_dir).select(*CELL, iso("time"), unsigned("attr_size", 4))


def hour_contexts(spark, sf_dir):
    """Days of 24 hours; missing ones count as their base value."""
    hourly = a.cell_hourly(spark, sf_dir)
    hours = F.map_from_entries(F.collect_list(F.struct("hour", (F.col("v") / 10).alias("v"))))
    days = hourly.groupBy(*CELL, "date").agg(hours.alias("_h"))
    of = lambda values: F.transform(F.sequence(F.lit(0), F.lit(23)), values)
    rows = every_day(days).join(days, [*CELL, "date"], "left").withColumn("v", of(lambda h: F.element_at("_h", h))).drop("_h")
    rows = with_size(rows.withColumn("v_base", of(lambda h: F.lit(0.5))), spark, sf_dir)
    score, gradient = decayed(0.7, [1.0], 0.2)
    return series.attribute_contexts(rows, score, ["v"], ["size"], 5, 8, gradient)


HOURS = f"""WITH e AS (SELECT *, min(date) OVER () AS lo FROM cell_hourly), g AS (SELECT lat_idx, lon_idx, CAST(lo + CAST(i AS INTEGER) AS DATE) AS date FROM (SELECT DISTINCT lat_idx, lon_idx FROM e) CROSS JOIN (SELECT min(date) AS lo, unnest(range(0, max(date) - min(date) + 1)) AS i FROM e)),
m AS (SELECT g.*, (coalesce(sum(e.v / 10), 0) + 0.5 * (24 - count(e.v))) / 24 AS m FROM g LEFT JOIN e ON e.lat_idx = g.lat_idx AND e.lon_idx = g.lon_idx AND e.date = g.date GROUP BY 1, 2, 3),
c AS (SELECT t.lat_idx, t.lon_idx, t.date AS time, CAST(d.date - t.date AS INTEGER) AS context, d.m FROM m t JOIN m d ON d.lat_idx = t.lat_idx AND d.lon_idx = t.lon_idx AND d.date BETWEEN t.date - 4 AND t.date WHERE t.date - 4 >= (SELECT min(date) FROM e)),
u AS (SELECT lat_idx, lon_idx, time, sum(pow(0.7, -context) * m) + 0.2 * coalesce(any_value(size), {SIZE_BASE}) AS ux, sum(pow(0.7, -context) * 0.5) + 0.2 * {SIZE_BASE} AS ub FROM c LEFT JOIN cell_static USING (lat_idx, lon_idx) GROUP BY 1, 2, 3)"""


@query("x9_attribution_hours", f"{HOURS} SELECT lat_idx, lon_idx, strftime(time, '%Y-%m-%d') AS time, context, 'v' AS feature, round((m - 0.5) * pow(0.7, -context) / 24 * (ux + ub), 6) + 0.0 AS attr FROM c JOIN u USING (lat_idx, lon_idx, time)")
def x9_hours(spark, sf_dir):
    out = series.attributions_long(hour_contexts(spark, sf_dir), ["v"])
    return out.select(*CELL, iso("time"), "context", "feature", unsigned("attr", 6))


@query("x9_completeness", f"{HOURS} SELECT lat_idx, lon_idx, strftime(time, '%Y-%m-%d') AS time, round(ux * ux - ub * ub, 4) AS total, round(ux * ux - ub * ub, 4) AS delta FROM u")
def x9_completeness(spark, sf_dir):
    total = F.aggregate("attr_v", F.lit(0.0), lambda s, v: s + v) * F.col("hours") + F.col("attr_size")
    return hour_contexts(spark, sf_dir).select(*CELL, iso("time"), r(total, "total", 4), r("delta", digits=4))


@query(
    "a25_attr_daily",
    "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS time, CAST(0 AS INTEGER) AS context, 'v' AS feature, round(avg(v), 6) AS attr FROM cell_hourly GROUP BY 1, 2, 3",
)
def a25(spark, sf_dir):
    rows = a.cell_hourly(spark, sf_dir).select(*CELL, F.col("date").alias("time"), F.lit(0).alias("context"), F.lit("v").alias("feature"), F.col("v").alias("attr"))
    return at.attr_daily(rows, CELL).select(*CELL, iso("time"), "context", "feature", r("attr"))


@query("w8_context_index", "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, CAST(date - 29 - DATE '1994-12-01' AS INTEGER) AS start_index, CAST(date - DATE '1994-12-01' AS INTEGER) AS end_index, strftime(date - 29, '%Y-%m-%d') AS context_start FROM cell_daily")
def w8(spark, sf_dir):
    return at.context_index(a.cell_daily(spark, sf_dir), F.col("date"), 30, "1994-12-01", "2001-12-31").select(*CELL, day(), "start_index", "end_index", iso("context_start"))


@query(
    "w8_attribution_span",
    "SELECT lat_idx, lon_idx, strftime(lo, '%Y-%m-%d') AS data_start, strftime(hi - 100 - 1094, '%Y-%m-%d') AS context_start, CAST(hi - 100 - lo AS INTEGER) AS start_index, CAST(hi - 10 - lo AS INTEGER) AS end_index FROM (SELECT lat_idx, lon_idx, min(date) AS lo, max(date) AS hi FROM cell_daily GROUP BY 1, 2)",
)
def w8_span(spark, sf_dir):
    cells = a.cell_daily(spark, sf_dir).groupBy(*CELL).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    start, end = F.date_sub("hi", 100), F.date_sub("hi", 10)
    out = at.attribution_span(cells, start, end, 1095, F.date_sub("hi", 365), F.col("hi"), F.datediff("hi", "lo") + 1)
    return out.select(*CELL, iso("data_start"), iso("context_start"), "start_index", "end_index")


CV = """SELECT d.lat_idx, d.lon_idx, strftime(d.date, '%Y-%m-%d') AS date, f.fold_mask, CAST(i AS INTEGER) AS fold_id, round(m.b * d.v + m.c, 4) AS v2_hat
FROM (SELECT i, regr_slope(d.v2, d.v) AS b, regr_intercept(d.v2, d.v) AS c FROM (SELECT unnest(range(0, 4)) AS i) CROSS JOIN cell_daily d JOIN fold_mask f USING (lat_idx, lon_idx) WHERE f.fold_mask NOT IN (0, i % 4 + 1, (i + 1) % 4 + 1) GROUP BY 1) m
JOIN fold_mask f ON f.fold_mask = (m.i + 1) % 4 + 1 JOIN cell_daily d USING (lat_idx, lon_idx)"""


@query("x10_fit_predict_cv", CV)
def x10(spark, sf_dir):
    rows = a.cell_daily(spark, sf_dir).join(folds(spark, sf_dir), CELL)
    return at.fit_predict_cv(rows, "v", "v2", K).select(*CELL, day(), "fold_mask", "fold_id", r("v2_hat", digits=4))


CV_ALL = """WITH x AS (SELECT d.*, f.fold_mask, CAST(dayofyear(d.date) AS DOUBLE) AS u FROM cell_daily d JOIN fold_mask f USING (lat_idx, lon_idx) WHERE f.fold_mask > 0),
c AS (SELECT i, covar_pop(v2, v) AS yv, covar_pop(v2, u) AS yu, var_pop(v) AS vv, var_pop(u) AS uu, covar_pop(v, u) AS vu, avg(v2) AS y, avg(v) AS v, avg(u) AS u
 FROM (SELECT unnest(range(0, 4)) AS i) CROSS JOIN x WHERE fold_mask NOT IN (i % 4 + 1, (i + 1) % 4 + 1) GROUP BY 1),
b AS (SELECT *, (yv * uu - yu * vu) / (vv * uu - vu * vu) AS bv, (yu * vv - yv * vu) / (vv * uu - vu * vu) AS bu FROM c)
SELECT x.lat_idx, x.lon_idx, strftime(x.date, '%Y-%m-%d') AS date, CAST(b.i AS INTEGER) AS fold_id, round(b.y + b.bv * (x.v - b.v) + b.bu * (x.u - b.u), 3) AS v2_hat FROM x CROSS JOIN b"""


@query("x10_predict_all_folds", CV_ALL)
def x10_all(spark, sf_dir):
    rows = a.cell_daily(spark, sf_dir).join(folds(spark, sf_dir), CELL).withColumn("u", F.dayofyear("date").cast("double"))
    return at.fit_predict_cv(rows, ["v", "u"], "v2", K, all_folds=True).select(*CELL, day(), "fold_id", r("v2_hat", digits=3))


@query(
    "j14_align_three",
    f"SELECT d.lat_idx, d.lon_idx, strftime(d.date, '%Y-%m-%d') AS date, round(d.v, 6) AS v, round(c.v_msc, 8) AS v_msc, round({ATTR_A}, 4) AS attr FROM cell_daily d JOIN {IN} i USING (lat_idx, lon_idx, date) JOIN msc c ON c.lat_idx = d.lat_idx AND c.lon_idx = d.lon_idx AND c.doy = dayofyear(d.date)",
)
def j14(spark, sf_dir):
    daily = a.cell_daily(spark, sf_dir)
    msc = season.msc_align(season.smooth_msc(season.msc_raw(daily)), daily.select(*CELL, "date")).drop("doy")
    attr = at.integrated_gradients(inputs(spark, sf_dir), score, ["a", "b"], 8, keep=[*CELL, "date"]).select(*CELL, "date", F.col("attr_a").alias("attr"))
    out = at.align_three(daily.select(*CELL, "date", "v"), msc, attr, [*CELL, "date"])
    return out.select(*CELL, day(), r("v"), r("v_msc", digits=8), r("attr", digits=4))


@query("j17_extract_series", "SELECT strftime(date, '%Y-%m-%d') AS date, CAST(1 - row_number() OVER (ORDER BY date DESC) AS INTEGER) AS context, round(v, 6) AS v FROM cell_daily WHERE lat_idx = 3 AND lon_idx = 5 ORDER BY date DESC LIMIT 100")
def j17(spark, sf_dir):
    out = at.extract_series(a.cell_daily(spark, sf_dir), 3, 5, 100)
    return out.select(day(), F.col("context").cast("int").alias("context"), r("v"))
