"""Queries on map statistics and regridding."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubespark.functions.grid import CELL, nearest_index
from cubespark.operators import maps, regrid
from cubespark.plans.cube import r
from cubespark.plans.registry import query
from cubespark.sources import adapters as a
from cubespark.sources import files
from cubespark.sources.scratch import small, written


def src(spark, sf_dir):
    """A 6 x 7 source grid with one missing cell."""
    cell = F.expr("(l_suppkey % 6) * 7 + l_partkey % 7")
    rows = a.table(spark, sf_dir, "lineitem").withColumn("q", F.when(cell != 17, F.col("l_quantity")))
    return rows.groupBy(F.expr("cast(l_suppkey % 6 as int)").alias("src_lat"), F.expr("cast(l_partkey % 7 as int)").alias("src_lon")).agg(F.avg("q").alias("v"))


@query("a2_stats", "SELECT 'v' AS variable, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM cell_daily SEMI JOIN (SELECT lat_idx, lon_idx FROM mask WHERE mask) k USING (lat_idx, lon_idx)")
def a2(spark, sf_dir):
    from cubespark.operators.masks import apply_mask

    return maps.stats(apply_mask(a.cell_daily(spark, sf_dir), a.mask(spark, sf_dir)), ["v"]).select("variable", "n", r("mean"), r("std"))


@query("a3_static_stats", "SELECT 'size' AS variable, count(size) AS n, round(avg(size), 6) AS mean, round(stddev_pop(size), 6) AS std FROM cell_static UNION ALL SELECT 'price', count(price), round(avg(price), 6), round(stddev_pop(price), 6) FROM cell_static")
def a3(spark, sf_dir):
    return maps.stats(a.cell_static(spark, sf_dir), ["size", "price"]).select("variable", "n", r("mean"), r("std"))


@query("a4_min_max", "SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem")
def a4(spark, sf_dir):
    return a.table(spark, sf_dir, "lineitem").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query(
    "j15_scaling_lookup",
    "WITH t AS (SELECT 'size' AS variable, avg(size) AS mean, stddev_pop(size) AS std FROM cell_static UNION ALL SELECT 'price', avg(price), stddev_pop(price) FROM cell_static) SELECT q.lat_idx, q.lon_idx, q.variable, round((q.value - t.mean) / t.std, 6) AS scaled FROM (SELECT lat_idx, lon_idx, 'size_msc' AS variable, size AS value FROM cell_static UNION ALL SELECT lat_idx, lon_idx, 'price', price FROM cell_static) q LEFT JOIN t ON t.variable = regexp_replace(q.variable, '_msc$', '')",
)
def j15(spark, sf_dir):
    static = a.cell_static(spark, sf_dir)
    rows = static.withColumnRenamed("size", "size_msc").unpivot(CELL, ["size_msc", "price"], "variable", "value")
    out = maps.scaling_lookup(rows, maps.stats(static, ["size", "price"]))
    return out.select(*CELL, "variable", r((F.col("value") - F.col("mean")) / F.col("std"), "scaled"))


@query("s9_var_catalog", "SELECT 'size' AS variable, 'Part size' AS long_name, 'cm' AS units, round(avg(size), 6) AS mean, round(stddev_pop(size), 6) AS std FROM cell_static UNION ALL SELECT 'price', 'Retail price', 'EUR', round(avg(price), 6), round(stddev_pop(price), 6) FROM cell_static")
def s9(spark, sf_dir):
    out = files.var_catalog(a.cell_static(spark, sf_dir), {"size": ("Part size", "cm"), "price": ("Retail price", "EUR")})
    return out.select("variable", "long_name", "units", r("mean"), r("std"))


@query("a14_ensemble_median", "SELECT lat_idx, lon_idx, round(median(m), 6) AS median FROM (SELECT lat_idx, lon_idx, avg(v) AS m FROM cell_daily GROUP BY 1, 2, year(date)) GROUP BY 1, 2")
def a14(spark, sf_dir):
    yearly = a.cell_daily(spark, sf_dir).groupBy(*CELL, F.year("date").alias("year")).agg(F.avg("v").alias("m"))
    return regrid.ensemble_median(yearly, "m").select(*CELL, r("median"))


@query("a15_quantile", "SELECT round(quantile_cont(v, 0.01), 6) AS q01, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.99), 6) AS q99, round(greatest(abs(quantile_cont(v, 0.01)), abs(quantile_cont(v, 0.99))), 6) AS lim FROM cell_daily")
def a15(spark, sf_dir):
    df = a.cell_daily(spark, sf_dir)
    lim = maps.symmetric_limit(df, "v").scalar()
    return maps.quantiles(df, "v", [0.01, 0.5, 0.99]).select(r("q0", "q01"), r("q1", "q50"), r("q2", "q99"), r(lim, "lim"))


QS = [0.01, 0.1, 0.5, 0.9, 0.99]


@query("a15_quantile_sketch", f"SELECT CAST(lat_idx // 4 AS INTEGER) AS band, q, count(v) AS n, TRUE AS within FROM cell_daily CROSS JOIN (SELECT unnest({QS}) AS q) GROUP BY 1, 2")
def a15_sketch(spark, sf_dir):
    """Sketches of chunks, merged to bands of latitude, hold the rank error against exact counts."""
    daily = a.cell_daily(spark, sf_dir).withColumns({"chunk_lat": F.expr("cast(lat_idx div 2 as int)"), "chunk_lon": F.expr("cast(lon_idx div 2 as int)"), "band": F.expr("cast(lat_idx div 4 as int)")})
    parts = written(maps.quantile_sketches(daily, "v", ["band", "chunk_lat", "chunk_lon"]), "sketches")
    found = maps.sketch_quantiles(maps.merge_sketches(parts, ["band"]), QS)
    ranks = daily.join(F.broadcast(found), "band").groupBy("band", "q", "n").agg(F.count_if(F.col("v") < F.col("quantile")).alias("below"), F.count_if(F.col("v") <= F.col("quantile")).alias("upto"))
    within = (F.col("below") / F.col("n") <= F.col("q") + maps.RANK_ERROR) & (F.col("upto") / F.col("n") >= F.col("q") - maps.RANK_ERROR)
    return ranks.select("band", "q", "n", within.alias("within"))


@query("a16_area_weighted_mean", "SELECT lat_idx // 2 AS band, round(sum(cos(radians(lat_idx * 10)) * size) / sum(cos(radians(lat_idx * 10))), 6) AS mean FROM cell_static GROUP BY 1")
def a16(spark, sf_dir):
    rows = a.cell_static(spark, sf_dir).withColumns({"deg": F.col("lat_idx") * 10, "band": F.expr("cast(lat_idx div 2 as int)")})
    return maps.area_weighted_mean(rows, "size", "deg", ["band"]).select("band", r("mean"))


@query(
    "a16_area_weighted_median",
    "WITH w AS (SELECT size AS x, cos(radians(lat_idx * 10)) AS w FROM cell_static), c AS (SELECT x, sum(w) OVER (ORDER BY x, w ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS hi, (sum(w) OVER (ORDER BY x, w ROWS UNBOUNDED PRECEDING) - w) / sum(w) OVER () AS lo, power(sum(w) OVER (), 2) / sum(w * w) OVER () AS n FROM w) SELECT round(sum(x * (least(1, greatest(0, n * hi - ((n - 1) * 0.5 + 1) + 1)) - least(1, greatest(0, n * lo - ((n - 1) * 0.5 + 1) + 1)))), 6) AS median, (SELECT round(min(x), 6) FROM c WHERE hi >= 0.5) AS lower_median FROM c",
)
def a16_median(spark, sf_dir):
    rows = a.cell_static(spark, sf_dir).withColumn("w", maps.area_weight(F.col("lat_idx") * 10))
    low = maps.weighted_quantile(rows, 0.5, "size", "w", method="lower").select(r("quantile", "lower_median"))
    return maps.weighted_quantile(rows, 0.5, "size", "w").select(r("quantile", "median")).crossJoin(low)


@query(
    "a17_weighted_histogram",
    "WITH q AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM cell_daily), b AS (SELECT least(CAST(floor((v - lo) / (hi - lo) * 29) AS INTEGER), 28) AS bin, cos(radians(lat_idx * 10)) AS w FROM cell_daily, q WHERE v BETWEEN lo AND hi) SELECT bin, round(sum(w), 6) AS weight, count(*) AS n FROM b GROUP BY 1",
)
def a17(spark, sf_dir):
    rows = a.cell_daily(spark, sf_dir).withColumn("deg", F.col("lat_idx") * 10)
    return maps.weighted_histogram(rows, "v", "deg", 30).select("bin", r("weight"), "n")


@query(
    "a18_histogram_2d",
    "WITH s AS (SELECT CAST(dayofyear(date) AS INTEGER) AS x, v - 25 AS y FROM cell_daily WHERE abs(v - 25) > 5), e AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM s) SELECT least(CAST(floor((x - lx) / (hx - lx) * 40) AS INTEGER), 39) AS bin_x, least(CAST(floor((y - ly) / (hy - ly) * 10) AS INTEGER), 9) AS bin_y, count(*) AS n FROM s, e GROUP BY 1, 2",
)
def a18(spark, sf_dir):
    rows = a.cell_daily(spark, sf_dir).select(F.dayofyear("date").alias("x"), (F.col("v") - 25).alias("y"))
    return maps.histogram_2d(rows, "x", "y", (40, 10), 5.0)


P = "points"


@query("j9_pairs_within", f"SELECT a.id AS a, b.id AS b, round(sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2), 6) AS dist FROM {P} a JOIN {P} b ON a.id < b.id WHERE sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) <= 2.5")
def j9(spark, sf_dir):
    return maps.pairs_within(a.points(spark, sf_dir), 2.5, digits=6).select("a", "b", "dist")


@query(
    "a19_empirical_variogram",
    f"SELECT CAST(greatest(ceil(d / 5 * 10), 1) AS INTEGER) AS lag, round(avg(sq) / 2, 4) AS gamma, count(*) AS pairs FROM (SELECT sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) AS d, (a.z - b.z) ** 2 AS sq FROM {P} a JOIN {P} b ON a.id < b.id) WHERE d <= 5 GROUP BY 1",
)
def a19(spark, sf_dir):
    return maps.empirical_variogram(a.points(spark, sf_dir), 10, 5.0).select("lag", r("gamma", digits=4), "pairs")


@query(
    "j10_regrid_nearest",
    "SELECT c.lat_idx, c.lon_idx, round(s.v, 6) AS v FROM cell_static c LEFT JOIN regrid_src s ON s.src_lat = CAST(floor((c.lat_idx * 0.7 - 0.2) / 1.0 + 0.5) AS INTEGER) AND s.src_lon = CAST(floor((c.lon_idx * 0.7 - 0.1) / 1.0 + 0.5) AS INTEGER)",
)
def j10(spark, sf_dir):
    lat = nearest_index(F.col("lat_idx") * 0.7, 0.2, 1.0)
    lon = nearest_index(F.col("lon_idx") * 0.7, 0.1, 1.0)
    return regrid.regrid_nearest(src(spark, sf_dir), a.cell_static(spark, sf_dir).select(*CELL), lat, lon).select(*CELL, r("v"))


@query(
    "j11_regrid_conservative",
    "WITH s AS (SELECT src_lat * 10.0 AS a, (src_lat + 1) * 10.0 AS b, src_lon * 10.0 AS c, (src_lon + 1) * 10.0 AS d, v FROM regrid_src WHERE v IS NOT NULL), t AS (SELECT CAST(i AS INTEGER) AS lat_idx, CAST(j AS INTEGER) AS lon_idx FROM (SELECT unnest(range(0, 10)) AS i) CROSS JOIN (SELECT unnest(range(0, 12)) AS j)), o AS (SELECT lat_idx, lon_idx, v, (least(d, (lon_idx + 1) * 7.0) - greatest(c, lon_idx * 7.0)) * (sin(radians(90 - greatest(a, lat_idx * 7.0))) - sin(radians(90 - least(b, (lat_idx + 1) * 7.0)))) AS w FROM s JOIN t ON a < (lat_idx + 1) * 7.0 AND b > lat_idx * 7.0 AND c < (lon_idx + 1) * 7.0 AND d > lon_idx * 7.0) SELECT lat_idx, lon_idx, round(sum(w * v) / sum(w), 6) AS v FROM o GROUP BY 1, 2",
)
def j11(spark, sf_dir):
    return regrid.regrid_conservative(src(spark, sf_dir), 10.0, 7.0).select(*CELL, r("v"))


@query(
    "j11_remap_over_time",
    "WITH s AS (SELECT (l_suppkey % 6) * 10.0 AS a, (l_suppkey % 6 + 1) * 10.0 AS b, (l_partkey % 7) * 10.0 AS c, (l_partkey % 7 + 1) * 10.0 AS d, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4, 5), t AS (SELECT CAST(i AS INTEGER) AS lat_idx, CAST(j AS INTEGER) AS lon_idx FROM (SELECT unnest(range(0, 10)) AS i) CROSS JOIN (SELECT unnest(range(0, 12)) AS j)), o AS (SELECT lat_idx, lon_idx, date, v, (least(d, (lon_idx + 1) * 7.0) - greatest(c, lon_idx * 7.0)) * (sin(radians(90 - greatest(a, lat_idx * 7.0))) - sin(radians(90 - least(b, (lat_idx + 1) * 7.0)))) AS w FROM s JOIN t ON a < (lat_idx + 1) * 7.0 AND b > lat_idx * 7.0 AND c < (lon_idx + 1) * 7.0 AND d > lon_idx * 7.0) SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, round(sum(w * v) / sum(w), 6) AS v FROM o GROUP BY 1, 2, 3",
)
def j11_time(spark, sf_dir):
    rows = a.table(spark, sf_dir, "lineitem").groupBy(F.expr("cast(l_suppkey % 6 as int)").alias("src_lat"), F.expr("cast(l_partkey % 7 as int)").alias("src_lon"), F.to_date("l_shipdate").alias("date")).agg(F.avg("l_quantity").alias("v"))
    weights = written(regrid.remap_weights(rows, 10.0, 7.0), "weights")
    return regrid.apply_weights(rows, small(weights), "v", ["date"]).select(*CELL, F.date_format("date", "yyyy-MM-dd").alias("date"), r("v"))


@query(
    "j13_source_check",
    "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, CASE WHEN a.v IS NULL THEN 'raw' WHEN b.v IS NULL THEN 'stored' ELSE 'both' END AS side, round(a.v - b.v, 6) AS diff FROM "
    + " FULL JOIN ".join(f"(SELECT CAST(l_suppkey % 8 AS INTEGER) AS lat_idx, CAST(l_partkey % 10 AS INTEGER) AS lon_idx, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS v FROM lineitem WHERE {c} GROUP BY 1, 2, 3) {n}" for n, c in (("a", "l_linenumber <= 3"), ("b", "l_linenumber >= 2")))
    + " USING (lat_idx, lon_idx, date)",
)
def j13(spark, sf_dir):
    # What is stored came from the first lines, the raw source holds all but one: some days stand on one side only.
    def part(lines):
        rows = a.table(spark, sf_dir, "lineitem").filter(lines).select(F.expr("cast(l_suppkey % 8 AS int)").alias("lat_idx"), F.expr("cast(l_partkey % 10 AS int)").alias("lon_idx"), F.to_date("l_shipdate").alias("date"), "l_quantity")
        return rows.groupBy(*CELL, "date").agg(F.avg("l_quantity").alias("v"))

    out = regrid.source_check(part("l_linenumber <= 3"), part("l_linenumber >= 2"), keys=[*CELL, "date"])
    return out.select(*CELL, F.date_format("date", "yyyy-MM-dd").alias("date"), "side", r("diff"))
