"""Queries on daily and hourly cells: seasons, reshapes, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.functions import dates, grid, values
from cubespark.functions.grid import CELL
from cubespark.operators import reshape, season
from cubespark.plans.registry import query
from cubespark.sources import adapters as a
from cubespark.sources import files
from cubespark.sources.scratch import new_path


def day():
    return F.date_format("date", "yyyy-MM-dd").alias("date")


TS = "yyyy-MM-dd HH:mm:ss"


def r(col, name: str | None = None, digits: int = 6):
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, digits).alias(name or col)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = a.cell_hourly(spark, sf_dir)
    spine = files.cube_spine(hourly.select(*CELL).distinct(), "2024-01-01", "2024-01-31", hourly=True)
    return reshape.densify(hourly, spine, [*CELL, "date", "hour"])


def accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*CELL, "date").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return dense(spark, sf_dir).select(*CELL, "date", "hour", F.sum(F.coalesce("v", F.lit(0.0))).over(w).alias("acc"))


@query("a1_msc_raw", "SELECT lat_idx, lon_idx, CAST(doy AS INTEGER) AS doy, round(m, 8) AS m FROM msc_raw")
def a1(spark, sf_dir):
    return season.msc_raw(a.cell_daily(spark, sf_dir)).select(*CELL, "doy", r("m", digits=8))


@query("w1_smooth_msc", "SELECT lat_idx, lon_idx, CAST(doy AS INTEGER) AS doy, round(v_msc, 8) AS v_msc FROM msc")
def w1(spark, sf_dir):
    daily = a.cell_daily(spark, sf_dir).repartition(*CELL)  # one exchange serves means and windows
    return season.smooth_msc(season.msc_raw(daily)).select(*CELL, "doy", r("v_msc", digits=8))


@query(
    "j1_msc_align",
    "SELECT c.lat_idx, c.lon_idx, strftime(c.date, '%Y-%m-%d') AS date, CAST(dayofyear(c.date) AS INTEGER) AS doy, round(m.v_msc, 8) AS v_msc FROM cell_daily c LEFT JOIN msc m ON m.lat_idx = c.lat_idx AND m.lon_idx = c.lon_idx AND m.doy = dayofyear(c.date)",
)
def j1(spark, sf_dir):
    daily = a.cell_daily(spark, sf_dir).repartition(*CELL)
    return season.msc_align(season.smooth_msc(season.msc_raw(daily)), daily).select(*CELL, day(), "doy", r("v_msc", digits=8))


J2 = "SELECT c.lat_idx, c.lon_idx, strftime(c.date, '%Y-%m-%d') AS date, round(c.v, 8) AS v, round(m.v_msc, 8) AS v_msc, round(c.v - m.v_msc, 8) AS v_ano FROM cell_daily c LEFT JOIN msc m ON m.lat_idx = c.lat_idx AND m.lon_idx = c.lon_idx AND m.doy = dayofyear(c.date)"


@query("j2_anomaly", J2)
def j2(spark, sf_dir):
    return season.anomaly(a.cell_daily(spark, sf_dir)).select(*CELL, day(), r("v", digits=8), r("v_msc", digits=8), r("v_ano", digits=8))


@query("j2_anomaly_bucketed", J2)
def j2_bucketed(spark, sf_dir):
    """On a table that is bucketed by cell: written once, then no exchange."""
    path = new_path(spark, "by-cell")
    table = files.write_by_cell(a.cell_daily(spark, sf_dir).select(*CELL, "date", "v"), f"by_cell_{path.rsplit('-', 1)[1]}", path, 8)
    return season.anomaly(table).select(*CELL, day(), r("v", digits=8), r("v_msc", digits=8), r("v_ano", digits=8))


@query(
    "w2_cumulative_to_flux",
    "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, hour, round(CASE WHEN rn = 1 THEN 0 WHEN hour = 0 THEN nx ELSE nx - acc END, 6) AS flux FROM (SELECT *, lead(acc) OVER w AS nx, row_number() OVER (PARTITION BY lat_idx, lon_idx ORDER BY date DESC, hour DESC) AS rn FROM cell_accum WINDOW w AS (PARTITION BY lat_idx, lon_idx ORDER BY date, hour))",
)
def w2(spark, sf_dir):
    return season.cumulative_to_flux(accumulated(spark, sf_dir), "acc").select(*CELL, day(), "hour", r("flux"))


@query(
    "w4_infer_step",
    "SELECT user_id, CAST(min(d) AS BIGINT) AS step, coalesce(min(d) = max(d), false) AS regular, coalesce(min(d) = max(d) AND min(d) = 3600, false) AS hourly FROM (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT - lag(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT) AS d FROM events) GROUP BY 1",
)
def w4(spark, sf_dir):
    return season.infer_step(a.table(spark, sf_dir, "events"), F.unix_timestamp(F.col("ts").cast("timestamp")), ["user_id"]).select("user_id", "step", "regular", "hourly")


@query(
    "s3_cube_spine",
    "SELECT c.lat_idx, c.lon_idx, strftime(d.date, '%Y-%m-%d') AS date, h.hour FROM (SELECT DISTINCT lat_idx, lon_idx FROM cell_hourly) c CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS date) d CROSS JOIN (SELECT CAST(unnest(range(0, 24)) AS INTEGER) AS hour) h",
)
def s3(spark, sf_dir):
    return files.cube_spine(a.cell_hourly(spark, sf_dir).select(*CELL).distinct(), "2024-01-01", "2024-01-31", hourly=True).select(*CELL, day(), "hour")


@query("j12_densify", "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, hour, round(v, 6) AS v FROM hourly_dense")
def j12(spark, sf_dir):
    return dense(spark, sf_dir).select(*CELL, day(), "hour", r("v"))


@query("s10_empty_like", "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, CAST(NULL AS DOUBLE) AS v, CAST(NULL AS DOUBLE) AS v2 FROM cell_daily")
def s10(spark, sf_dir):
    return reshape.empty_like(a.cell_daily(spark, sf_dir), [*CELL, "date"]).select(*CELL, day(), "v", "v2")


@query("p1_rename", "SELECT p_partkey AS part, p_size AS size, p_brand FROM part")
def p1(spark, sf_dir):
    upper = a.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("P_PARTKEY"), F.col("p_size").alias("P_SIZE"), F.col("p_brand").alias("P_Brand"))
    return reshape.rename(upper, {"P_PARTKEY": "part", "P_SIZE": "size"})


@query("p2_convert_units", "SELECT l_orderkey, l_linenumber, round(l_quantity - 273.15, 6) AS t2m, round(l_extendedprice * 1000, 6) AS tp, l_discount AS ssrd FROM lineitem")
def p2(spark, sf_dir):
    names = {"t2m": "l_quantity", "tp": "l_extendedprice", "ssrd": "l_discount"}
    return a.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[r(values.convert_units(n, F.col(c)), n) for n, c in names.items()])


@query("p3_split_day_hour", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def p3(spark, sf_dir):
    return dates.split_day_hour(a.table(spark, sf_dir, "events")).select("event_id", day(), "hour")


@query("p4_stack_time", "SELECT lat_idx, lon_idx, strftime(date + to_hours(hour), '%Y-%m-%d %H:%M:%S') AS ts, round(v, 6) AS v FROM cell_hourly")
def p4(spark, sf_dir):
    return dates.stack_time(a.cell_hourly(spark, sf_dir)).select(*CELL, F.date_format("ts", TS).alias("ts"), r("v"))


@query(
    "p5_stack_dims",
    "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, hour, CAST(row_number() OVER (PARTITION BY lat_idx, lon_idx ORDER BY date, hour) - count(*) OVER (PARTITION BY lat_idx, lon_idx) AS BIGINT) AS step FROM cell_hourly",
)
def p5(spark, sf_dir):
    out = reshape.stack_dims(a.cell_hourly(spark, sf_dir), ["date", "hour"], CELL, "step", start_at_zero=False)
    return out.select(*CELL, day(), "hour", F.col("step").cast("long").alias("step"))


@query("p6_msc_to_date", "SELECT lat_idx, lon_idx, strftime(DATE '2000-01-01' + CAST(doy - 1 AS INTEGER), '%Y-%m-%d') AS date, round(m, 6) AS m FROM msc_raw")
def p6(spark, sf_dir):
    raw = season.msc_raw(a.cell_daily(spark, sf_dir))
    return raw.withColumn("date", dates.msc_to_date(F.col("doy"))).select(*CELL, day(), r("m"))


@query("p8_layer_profile_mean", "SELECT lat_idx, lon_idx, round(((l0 + l1) / 2 * 5 + (l1 + l2) / 2 * 10 + (l2 + l3) / 2 * 15 + (l3 + l4) / 2 * 30 + (l4 + l5) / 2 * 40) / 100, 6) AS sandfrac FROM (SELECT lat_idx, lon_idx, " + ", ".join(f"max(CASE WHEN layer = {i} THEN sndppt END) AS l{i}" for i in range(6)) + " FROM layers GROUP BY 1, 2)")
def p8(spark, sf_dir):
    wide = a.layers(spark, sf_dir).groupBy(*CELL).pivot("layer", list(range(6))).agg(F.first("sndppt"))
    return wide.select(*CELL, r(values.layer_profile_mean([F.col(str(i)) for i in range(6)]), "sandfrac"))


@query("p9_fill_missing", "SELECT sample, step, coalesce(target, 0) AS target FROM pred_obs")
def p9(spark, sf_dir):
    return a.pred_obs(spark, sf_dir).select("sample", "step", F.coalesce("target", F.lit(0.0)).alias("target"))


@query("p10_pack_channels", "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, variable, round(value, 6) AS value FROM (SELECT lat_idx, lon_idx, date, v AS value, 'v' AS variable FROM cell_daily UNION ALL SELECT lat_idx, lon_idx, date, v2, 'v2' FROM cell_daily)")
def p10(spark, sf_dir):
    packed = reshape.pack_channels(a.cell_daily(spark, sf_dir), ["v", "v2"])
    wide = reshape.unpack_channels(packed, ["v", "v2"])
    return reshape.to_long(wide, [*CELL, "date"], ["v", "v2"]).select(*CELL, day(), "variable", r("value"))


@query("p12_rename_suffix", "SELECT lat_idx, lon_idx, round(avg(v), 6) AS v_hat, round(avg(v2), 6) AS v2_hat FROM cell_daily GROUP BY 1, 2")
def p12(spark, sf_dir):
    means = a.cell_daily(spark, sf_dir).groupBy(*CELL).agg(r(F.avg("v"), "v_ano"), r(F.avg("v2"), "v2_ano"))
    return reshape.rename_suffix(means, ["v_ano", "v2_ano"], add="_hat", drop="_ano")


@query("p13_flat_seq", "SELECT sample, CAST(i // 2 AS INTEGER) AS seq, CAST(i % 2 AS INTEGER) AS feat, round(x, 6) AS x FROM (SELECT sample, unnest(generate_series(0, len(xs) - 1)) AS i, unnest(xs) AS x FROM (SELECT sample, flatten(list([prediction, variance] ORDER BY step, prediction, variance)) AS xs FROM pred_obs GROUP BY 1))")
def p13(spark, sf_dir):
    rows = a.pred_obs(spark, sf_dir).groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("step", "prediction", "variance"))).alias("s"))
    flat = rows.select("sample", values.seq_to_flat(F.transform("s", lambda x: F.array(x["prediction"], x["variance"]))).alias("flat"))
    seq = flat.select("sample", F.posexplode(values.flat_to_seq(F.col("flat"), 2)).alias("seq", "row"))
    return seq.select("sample", "seq", F.posexplode("row").alias("feat", "x")).select("sample", "seq", "feat", r("x"))


@query("p14_harmonics", "SELECT lat_idx, lon_idx, CAST(doy AS INTEGER) AS doy, round(0.5 * 1.0 + 2.0 * cos(2 * pi() * doy / 366) + 3.0 * sin(2 * pi() * doy / 366), 6) AS y FROM msc_raw")
def p14(spark, sf_dir):
    terms = values.harmonics(F.col("doy"), 2, 1, 366)
    amplitudes = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return season.msc_raw(a.cell_daily(spark, sf_dir)).select(*CELL, "doy", r(values.dot(terms, amplitudes), "y"))


@query("p15_repeat_time", "SELECT sample, CAST(step * 2 + i AS INTEGER) AS t, round(prediction, 6) AS prediction FROM pred_obs CROSS JOIN (SELECT unnest(range(0, 2)) AS i)")
def p15(spark, sf_dir):
    return reshape.repeat_time(a.pred_obs(spark, sf_dir), 2, "step").select("sample", F.col("step").alias("t"), r("prediction"))


@query("p16_drop_value", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN 0 ELSE l_discount * (SELECT count(l_discount) / count(*) FILTER (WHERE l_discount <> 0) FROM lineitem) END, 6) AS kept FROM lineitem")
def p16(spark, sf_dir):
    return reshape.drop_value(a.table(spark, sf_dir, "lineitem"), "l_discount", 0.0).select("l_orderkey", "l_linenumber", r("kept"))


@query("p17_cell_coords", "SELECT lat_idx, lon_idx, round(76.5 - 0.1 * lat_idx, 6) AS lat, round(-74.5 + 0.1 * lon_idx, 6) AS lon, lat_idx // 2 AS chunk_lat, lon_idx // 2 AS chunk_lon FROM cell_static")
def p17(spark, sf_dir):
    return grid.cell_coords(a.cell_static(spark, sf_dir), 2).select(*CELL, r("lat"), r("lon"), "chunk_lat", "chunk_lon")


@query("f1_bbox", "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, round(v, 6) AS v FROM cell_daily WHERE lon_idx BETWEEN 2 AND 6 AND lat_idx BETWEEN 1 AND 5")
def f1(spark, sf_dir):
    return grid.bbox(a.cell_daily(spark, sf_dir), -74.3, -73.9, 76.0, 76.4).select(*CELL, day(), r("v"))


@query("f2_region_rules", "SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT id, lat * 2 AS lat, lon - 30 AS lon FROM points) WHERE lon > -25 AND (lat <= 16.5 OR lat > 32.5) AND (lat < 60 OR lon > 0)")
def f2(spark, sf_dir):
    rows = a.points(spark, sf_dir).select("id", (F.col("lat") * 2).alias("lat"), (F.col("lon") - 30).alias("lon"))
    return rows.filter(grid.region_rules(F.col("lat"), F.col("lon"))).select("id", r("lat"), r("lon"))


@query("f3_time_slice", "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, round(v, 6) AS v FROM cell_daily WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-12-31'")
def f3(spark, sf_dir):
    return dates.time_slice(a.cell_daily(spark, sf_dir), "1996-03-01", "1997").select(*CELL, day(), r("v"))


@query("f7_last_n", "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY lat_idx, lon_idx ORDER BY date DESC) AS rn FROM cell_daily) WHERE rn <= 30")
def f7(spark, sf_dir):
    return reshape.last_n(a.cell_daily(spark, sf_dir), 30, CELL, "date").select(*CELL, day(), r("v"))


@query("f8_abs_threshold", "SELECT c_custkey, c_acctbal FROM customer WHERE abs(c_acctbal) > 500")
def f8(spark, sf_dir):
    return a.table(spark, sf_dir, "customer").filter(F.abs("c_acctbal") > 500).select("c_custkey", "c_acctbal")


@query("f9_valid_nonzero", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount IS NOT NULL AND l_discount <> 0")
def f9(spark, sf_dir):
    return a.table(spark, sf_dir, "lineitem").filter(values.valid_nonzero(F.col("l_discount"))).select("l_orderkey", "l_linenumber", "l_discount")


@query(
    "f10_nearest_label",
    "SELECT id, CAST(floor((lon + 74.5) / 0.1 + 0.5) AS INTEGER) AS lon_idx, (SELECT arg_min(p, (abs(p - z), p)) FROM (SELECT DISTINCT CAST(p_size * 200 AS DOUBLE) AS p FROM part)) AS nearest_p FROM points",
)
def f10(spark, sf_dir):
    axis = a.table(spark, sf_dir, "part").select((F.col("p_size") * 200).cast("double").alias("p"))
    rows = grid.nearest_label(a.points(spark, sf_dir), axis, "z", "p")
    return rows.select("id", grid.nearest_index(F.col("lon"), grid.LON0, grid.STEP).alias("lon_idx"), "nearest_p")


@query("f11_roi_from_anchor", "SELECT id, lat_idx, lon_idx FROM (SELECT id, CAST(id * 7 % 400 AS INTEGER) AS lat_idx, CAST(id * 13 % 1000 AS INTEGER) AS lon_idx FROM points) WHERE lon_idx BETWEEN 840 AND 939 AND lat_idx BETWEEN 200 AND 259")
def f11(spark, sf_dir):
    rows = a.points(spark, sf_dir).select("id", F.expr("cast(id * 7 % 400 as int)").alias("lat_idx"), F.expr("cast(id * 13 % 1000 as int)").alias("lon_idx"))
    return grid.roi_from_anchor(rows, 10, 50, 5, 3)


@query("f12_frame_range", "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, hour, round(v, 6) AS v FROM (SELECT *, dense_rank() OVER (ORDER BY date, hour) AS t FROM cell_hourly) WHERE t <= 48")
def f12(spark, sf_dir):
    return reshape.frame_range(a.cell_hourly(spark, sf_dir), ["date", "hour"], 48).select(*CELL, day(), "hour", r("v"))


@query("f12_frame_stride", "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, hour, round(v, 6) AS v FROM (SELECT *, dense_rank() OVER (ORDER BY date, hour) - 1 AS t FROM cell_hourly) WHERE t >= 24 AND t < 600 AND (t - 24) % 6 = 0")
def f12_stride(spark, sf_dir):
    return reshape.frame_range(a.cell_hourly(spark, sf_dir), ["date", "hour"], range(24, 600, 6)).select(*CELL, day(), "hour", r("v"))


@query("f13_finite", "SELECT sample, step, target FROM pred_obs WHERE target IS NOT NULL AND isfinite(target)")
def f13(spark, sf_dir):
    return a.pred_obs(spark, sf_dir).filter(values.finite(F.col("target"))).select("sample", "step", "target")


@query("t2_shuffle", "SELECT lat_idx, lon_idx, md5(concat_ws('|', CAST(lat_idx AS VARCHAR), CAST(lon_idx AS VARCHAR), '42')) AS order_key FROM cell_static")
def t2(spark, sf_dir):
    return reshape.shuffled(a.cell_static(spark, sf_dir), CELL, 42).select(*CELL, "order_key").orderBy("order_key")


@query("t3_lat_descending", "SELECT lat_idx, lon_idx, round(76.5 - 0.1 * lat_idx, 6) AS lat, round(size, 6) AS size FROM cell_static")
def t3(spark, sf_dir):
    return a.cell_static(spark, sf_dir).select(*CELL, r(grid.latitude("lat_idx"), "lat"), r("size")).orderBy("lat_idx", "lon_idx")


@query("a24_avg_pool_time", "SELECT lat_idx, lon_idx, CAST(block AS BIGINT) AS block, round(avg(v), 6) AS mean FROM (SELECT lat_idx, lon_idx, v, (row_number() OVER (PARTITION BY lat_idx, lon_idx ORDER BY date) - 1) // 7 AS block FROM cell_daily) GROUP BY 1, 2, 3 HAVING count(*) = 7")
def a24(spark, sf_dir):
    return reshape.avg_pool_time(a.cell_daily(spark, sf_dir), 7, CELL, ["date"], "v").select(*CELL, "block", r("mean"))


@query("p11_context_to_date", "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, c AS context_offset, strftime(date + CAST(c AS INTEGER), '%Y-%m-%d') AS context_date FROM cell_daily CROSS JOIN (SELECT CAST(unnest(range(-2, 1)) AS INTEGER) AS c)")
def p11(spark, sf_dir):
    rows = a.cell_daily(spark, sf_dir).withColumn("context_offset", F.explode(F.sequence(F.lit(-2), F.lit(0))))
    at = F.date_format(dates.context_to_date(F.col("date"), F.col("context_offset")), "yyyy-MM-dd")
    return rows.select(*CELL, day(), "context_offset", at.alias("context_date"))
