"""Queries on masks and folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.functions import grid
from cubespark.functions.grid import CELL
from cubespark.operators import masks as m
from cubespark.plans.cube import day, r
from cubespark.plans.registry import query
from cubespark.sources import adapters as a

#: Seed and number of folds, and chunk size, of the registered queries.
SEED, K, SIZE = 42, 4, 2


def folds(spark, sf_dir):
    return m.assign_folds(a.mask(spark, sf_dir), K, SIZE, SEED, 10)


def wide_mask(spark, sf_dir):
    """A larger grid: customers dealt over 40 x 40 cells."""
    return a.table(spark, sf_dir, "orders").groupBy(F.expr("cast(o_custkey % 40 as int)").alias("lat_idx"), F.expr("cast((o_custkey div 40) % 40 as int)").alias("lon_idx")).agg((F.sum("o_totalprice") > 500000).alias("mask"))


WIDE = "(SELECT CAST(o_custkey % 40 AS INTEGER) AS lat_idx, CAST((o_custkey // 40) % 40 AS INTEGER) AS lon_idx, sum(o_totalprice) > 500000 AS mask FROM orders GROUP BY 1, 2)"
DIAMOND = "(SELECT y, x FROM (SELECT unnest(range(-2, 3)) AS y) CROSS JOIN (SELECT unnest(range(-2, 3)) AS x) WHERE abs(y) + abs(x) <= 2)"


@query(
    "a5_availability_mask",
    "SELECT c.lat_idx, c.lon_idx, coalesce(a.ok AND b.ok, false) AS mask FROM (SELECT DISTINCT lat_idx, lon_idx FROM cell_daily) c LEFT JOIN (SELECT lat_idx, lon_idx, bool_or(v > 45) AS ok FROM cell_daily WHERE year(date) = 1996 GROUP BY 1, 2) a USING (lat_idx, lon_idx) LEFT JOIN (SELECT lat_idx, lon_idx, bool_or(size > 24) AS ok FROM cell_static GROUP BY 1, 2) b USING (lat_idx, lon_idx)",
)
def a5(spark, sf_dir):
    return m.availability_mask([(a.cell_daily(spark, sf_dir), (F.year("date") == 1996) & (F.col("v") > 45)), (a.cell_static(spark, sf_dir), F.col("size") > 24)])


@query("a6_chunk_any", "SELECT lat_idx // 2 AS chunk_lat, lon_idx // 2 AS chunk_lon, bool_or(mask) AS valid FROM mask GROUP BY 1, 2")
def a6(spark, sf_dir):
    return m.chunk_any(a.mask(spark, sf_dir), SIZE, 8, 10)


@query("a7_chunk_counts", "SELECT lat_idx // 2 AS chunk_lat, lon_idx // 2 AS chunk_lon, CAST(count(*) * 3 AS BIGINT) AS samples FROM mask WHERE mask GROUP BY 1, 2")
def a7(spark, sf_dir):
    return m.chunk_counts(a.mask(spark, sf_dir), SIZE, 3)


@query("a26_distinct_chunks", "SELECT chunk_lat, chunk_lon FROM chunks")
def a26(spark, sf_dir):
    return m.distinct_chunks(a.mask(spark, sf_dir), SIZE)


@query("f4_apply_mask", "SELECT d.lat_idx, d.lon_idx, strftime(d.date, '%Y-%m-%d') AS date, round(CASE WHEN k.mask THEN d.v END, 6) AS v FROM cell_daily d LEFT JOIN mask k USING (lat_idx, lon_idx)")
def f4(spark, sf_dir):
    return m.apply_mask(a.cell_daily(spark, sf_dir), a.mask(spark, sf_dir), drop=False, columns=["v"]).select(*CELL, day(), r("v"))


@query("f5_isin", "SELECT lat_idx, lon_idx, fold_mask FROM fold_mask WHERE fold_mask IN (1, 3)")
def f5(spark, sf_dir):
    return folds(spark, sf_dir).filter(F.col("fold_mask").isin(1, 3))


@query("j3_mask_chunks", "SELECT d.lat_idx, d.lon_idx, strftime(d.date, '%Y-%m-%d') AS date, round(d.v, 6) AS v FROM cell_daily d WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_lat = d.lat_idx // 2 AND c.chunk_lon = d.lon_idx // 2)")
def j3(spark, sf_dir):
    return m.mask_chunks(a.cell_daily(spark, sf_dir), a.mask(spark, sf_dir), SIZE).select(*CELL, day(), r("v"))


@query(
    "j7_buffer_exclude",
    "SELECT t.lat_idx, t.lon_idx FROM fold_mask t WHERE t.fold_mask NOT IN (0, 2) AND NOT EXISTS (SELECT 1 FROM fold_mask f WHERE f.fold_mask = 2 AND (f.lat_idx - t.lat_idx) * (f.lat_idx - t.lat_idx) + (f.lon_idx - t.lon_idx) * (f.lon_idx - t.lon_idx) <= 1)",
)
def j7(spark, sf_dir):
    f = folds(spark, sf_dir)
    return m.buffer_exclude(f.filter("fold_mask = 2"), f.filter("fold_mask NOT IN (0, 2)"), 3).select(*CELL)


@query(
    "x6_binary_opening",
    f"WITH w AS {WIDE}, d AS {DIAMOND}, e AS (SELECT w.lat_idx + d.y AS lat_idx, w.lon_idx + d.x AS lon_idx FROM w CROSS JOIN d WHERE w.mask GROUP BY 1, 2 HAVING count(*) = 13), o AS (SELECT DISTINCT e.lat_idx + d.y AS lat_idx, e.lon_idx + d.x AS lon_idx FROM e CROSS JOIN d WHERE e.lat_idx BETWEEN 0 AND 39 AND e.lon_idx BETWEEN 0 AND 39) SELECT w.lat_idx, w.lon_idx, o.lat_idx IS NOT NULL AS mask FROM w LEFT JOIN o USING (lat_idx, lon_idx)",
)
def x6(spark, sf_dir):
    return m.binary_opening(wide_mask(spark, sf_dir), 40, 40)


@query("x2_assign_folds", "SELECT lat_idx, lon_idx, fold_mask FROM fold_mask")
def x2(spark, sf_dir):
    return folds(spark, sf_dir)


@query("x3_fold_roles", "SELECT lat_idx, lon_idx, fold_mask, CASE WHEN fold_mask = 2 THEN 'val' WHEN fold_mask = 3 THEN 'test' WHEN fold_mask > 0 THEN 'train' END AS role FROM fold_mask")
def x3(spark, sf_dir):
    return m.fold_roles(folds(spark, sf_dir), 1, K)


PREDICTED = "SELECT i AS fold_id, {}, lat_idx, lon_idx FROM fold_mask, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS i) WHERE {}"


@query("x3_prediction_set", PREDICTED.format("false AS all_folds", "fold_mask = (i + 1) % 4 + 1") + " UNION ALL " + PREDICTED.format("true", "fold_mask > 0"))
def x3_predicted(spark, sf_dir):
    f = folds(spark, sf_dir)
    sets = [m.prediction_set(f, i, K, all_folds=every).select(F.lit(i).alias("fold_id"), F.lit(every).alias("all_folds"), *CELL) for i in range(K) for every in (False, True)]
    return reduce(DataFrame.unionByName, sets)


@query(
    "x5_split_chunks",
    "SELECT m.lat_idx, m.lon_idx, coalesce(m.mask AND t.t = 2, false) AS mask FROM mask m LEFT JOIN (SELECT chunk_lat, chunk_lon, ntile(3) OVER (ORDER BY chunk_lat, chunk_lon) AS t FROM chunks) t ON t.chunk_lat = m.lat_idx // 2 AND t.chunk_lon = m.lon_idx // 2",
)
def x5(spark, sf_dir):
    return m.split_chunks(a.mask(spark, sf_dir), SIZE, 3, 1)


@query("x13_check_cube", "SELECT lat_idx, lon_idx, count(*) AS days FROM cell_daily GROUP BY 1, 2")
def x13(spark, sf_dir):
    return m.check_cube(a.cell_daily(spark, sf_dir), ["v", "lst"]).groupBy(*CELL).agg(F.count("*").alias("days"))


@query("u2_fold_difference", "SELECT DISTINCT fold_mask FROM fold_mask WHERE fold_mask NOT IN (0, 2, 3)")
def u2(spark, sf_dir):
    return m.fold_difference(folds(spark, sf_dir), 2, 3)


@query("u3_mask_and", "SELECT m.lat_idx, m.lon_idx FROM mask m JOIN (SELECT lat_idx, lon_idx FROM cell_static WHERE size > 25) s USING (lat_idx, lon_idx) WHERE m.mask")
def u3(spark, sf_dir):
    return m.mask_and(a.mask(spark, sf_dir), a.cell_static(spark, sf_dir).select(*CELL, (F.col("size") > 25).alias("mask")))


@query("u3_mask_and_not", "SELECT m.lat_idx, m.lon_idx FROM mask m WHERE m.mask AND NOT EXISTS (SELECT 1 FROM cell_static s WHERE s.size > 25 AND s.lat_idx = m.lat_idx AND s.lon_idx = m.lon_idx)")
def u3_not(spark, sf_dir):
    return m.mask_and_not(a.mask(spark, sf_dir), a.cell_static(spark, sf_dir).select(*CELL, (F.col("size") > 25).alias("mask")))


@query("f2_fold_regions", "SELECT lat_idx, lon_idx, chunk_lat, chunk_lon FROM (SELECT lat_idx, lon_idx, lat_idx // 2 AS chunk_lat, lon_idx // 2 AS chunk_lon, 76.5 - 0.1 * lat_idx * 90 AS lat, -74.5 + 0.1 * lon_idx * 120 AS lon FROM cell_static) WHERE lon > -25 AND (lat <= 16.5 OR lat > 32.5) AND (lat < 60 OR lon > 0)")
def f2_folds(spark, sf_dir):
    rows = m.with_chunks(a.cell_static(spark, sf_dir), SIZE)
    return rows.filter(grid.region_rules(grid.latitude(F.col("lat_idx") * 90), grid.longitude(F.col("lon_idx") * 120))).select(*CELL, "chunk_lat", "chunk_lon")
