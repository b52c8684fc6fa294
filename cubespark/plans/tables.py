"""Queries that write and read tables, run user functions on chunks, and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubespark.functions.grid import CELL
from cubespark.operators import chunks, maps
from cubespark.operators import masks as m
from cubespark.plans.cube import day, r
from cubespark.plans.masks import SIZE
from cubespark.plans.registry import query
from cubespark.sources import adapters as a
from cubespark.sources import files
from cubespark.sources.scratch import new_path
from cubespark.streaming import streams


@query(
    "s2_parse_source_name",
    "SELECT event_id, lower(event_type) AS variable, '0d10' AS scale, CAST(month(ts) + user_id % 12 AS INTEGER) % 12 + 1 AS month, CAST(year(ts) AS INTEGER) AS year, lower(event_type) || '.0d10.' || year(ts) || '.' || lpad(CAST((month(ts) + user_id % 12) % 12 + 1 AS VARCHAR), 2, '0') AS canonical FROM events",
)
def s2(spark, sf_dir):
    month = F.lpad(((F.month("ts") + F.col("user_id") % 12) % 12 + 1).cast("string"), 2, "0")
    name = F.concat_ws(".", F.upper("event_type"), F.lit("0d10"), F.lit("1460"), F.lit("1140"), month, F.year("ts").cast("string"), F.lit("nc"))
    return a.table(spark, sf_dir, "events").select("event_id", *files.parse_source_name(name))


def hourly_values(spark, sf_dir):
    rows = a.cell_hourly(spark, sf_dir)
    return rows.select(*CELL, F.make_timestamp_ntz(F.year("date"), F.month("date"), F.day("date"), F.col("hour"), F.lit(0), F.lit(0)).alias("ts"), F.col("v").alias("value"))


INGESTED = "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, hour, CAST(round(v * 1000, 0) AS BIGINT) AS value FROM cell_hourly"


def _stored(df):
    return df.select(*CELL, day(), "hour", F.round("value", 0).cast("long").alias("value"))


@query("s4_ingest", INGESTED)
def s4(spark, sf_dir):
    path = new_path(spark, "ingest")
    for _ in range(2):  # a rerun changes nothing
        target = files.ingest(hourly_values(spark, sf_dir), "tp", path)
    return _stored(spark.read.parquet(target))


@query("s1_scan_files", "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, hour FROM cell_hourly WHERE month(date) = 1")
def s1(spark, sf_dir):
    target = files.ingest(hourly_values(spark, sf_dir), "tp", new_path(spark, "scan"))
    return files.scan_files(spark, target, "tp", "hourly", [2024], [1]).select(*CELL, day(), "hour")


@query("s5_write_derived", "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN lat_idx < 2 THEN v * 2 ELSE v END, 6) AS v FROM cell_daily")
def s5(spark, sf_dir):
    rows = m.with_chunks(a.cell_daily(spark, sf_dir).select(*CELL, "date", "v"), SIZE)
    path = new_path(spark, "derived")
    files.write_derived(rows, path)
    files.write_derived(rows.filter("chunk_lat = 0").withColumn("v", F.col("v") * 2), path)
    return spark.read.parquet(path).select(*CELL, day(), r("v"))


@query(
    "s6_write_predictions",
    "WITH t AS (SELECT avg(v) AS mean, stddev_pop(v) AS std FROM cell_daily), l AS (SELECT lat_idx, lon_idx, date, v FROM (SELECT *, row_number() OVER (PARTITION BY lat_idx, lon_idx ORDER BY date DESC) AS rn FROM cell_daily) WHERE rn <= 30) SELECT c.lat_idx, c.lon_idx, strftime(d.date, '%Y-%m-%d') AS date, round(l.v * t.std + t.mean, 6) AS v_hat FROM (SELECT DISTINCT lat_idx, lon_idx FROM cell_daily) c CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS date) d CROSS JOIN t LEFT JOIN l ON l.lat_idx = c.lat_idx AND l.lon_idx = c.lon_idx AND l.date = d.date",
)
def s6(spark, sf_dir):
    daily = a.cell_daily(spark, sf_dir)
    stats = daily.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    pred = daily.select(*CELL, "date", F.col("v").alias("ts"))
    path = new_path(spark, "predictions")
    files.write_predictions(pred, stats, files.cube_spine(daily.select(*CELL).distinct(), "1995", "2001"), 30, path)
    return spark.read.parquet(path).select(*CELL, day(), r("v_hat"))


@query("s7_write_attributions", "SELECT lat_idx, lon_idx, strftime(date, '%Y-%m-%d') AS time, CAST(0 AS INTEGER) AS context, 'v' AS feature, round(v - 25, 6) AS attr FROM cell_daily")
def s7(spark, sf_dir):
    rows = a.cell_daily(spark, sf_dir)
    attr = rows.select(*CELL, F.col("date").alias("time"), F.lit(0).alias("context"), F.lit("v").alias("feature"), (F.col("v") - 25).alias("attr"))
    path = new_path(spark, "attributions")
    files.write_derived(m.with_chunks(attr, SIZE), path)
    return spark.read.parquet(path).select(*CELL, F.date_format("time", "yyyy-MM-dd").alias("time"), "context", "feature", r("attr"))


@query("s8_scan_metric_log", "SELECT trial, name, step, value FROM metric_log")
def s8(spark, sf_dir):
    rows = a.metric_log(spark, sf_dir).select("trial", F.unix_micros(F.col("wall_time").cast("timestamp")).cast("double").alias("wall_time"), "name", "step", "value")
    path = new_path(spark, "logs")
    rows.write.partitionBy("trial").json(path)
    return files.scan_metric_log(spark, path).select("trial", "name", "step", "value")


SPREAD = "SELECT lat_idx, lon_idx, round((max(v) - min(v)) * 2, 6) AS spread FROM cell_daily GROUP BY 1, 2"


def spreads(spark, sf_dir, mask=None, combine=None):
    df = a.cell_daily(spark, sf_dir).select(*CELL, "v")
    return chunks.chunk_apply(df, chunks.spread_of, "lat_idx int, lon_idx int, spread double", SIZE, mask, (2.0,), combine)


@query("x1_chunk_apply", SPREAD)
def x1(spark, sf_dir):
    return spreads(spark, sf_dir, a.mask(spark, sf_dir)).select(*CELL, r("spread"))


@query("x1_chunk_list", f"SELECT lat_idx // 2 AS chunk_lat, lon_idx // 2 AS chunk_lon, * FROM ({SPREAD})")
def x1_list(spark, sf_dir):
    return spreads(spark, sf_dir).select(*m.CHUNK_KEYS, *CELL, r("spread"))


@query("x1_chunk_stream", SPREAD)
def x1_stream(spark, sf_dir):
    daily = a.cell_daily(spark, sf_dir).select(*CELL, "date", "v")
    out = chunks.chunk_stream(daily, chunks.spreads_of, "lat_idx int, lon_idx int, spread double", SIZE, a.mask(spark, sf_dir), args=(2.0,))
    return out.select(*CELL, r("spread"))


GRID = "(SELECT CAST(i AS INTEGER) AS lat_idx, CAST(j AS INTEGER) AS lon_idx FROM (SELECT unnest(range(0, 20)) AS i) CROSS JOIN (SELECT unnest(range(0, 20)) AS j))"


@query("x1_chunk_combine", f"SELECT g.lat_idx, g.lon_idx, s.spread FROM {GRID} g LEFT JOIN ({SPREAD}) s USING (lat_idx, lon_idx)")
def x1_combine(spark, sf_dir):
    grid = spark.range(400).select(F.expr("cast(id div 20 as int)").alias("lat_idx"), F.expr("cast(id % 20 as int)").alias("lon_idx"))
    return spreads(spark, sf_dir, combine=grid).select(*CELL, r("spread"))


@query("n1_stream_ingest", INGESTED)
def n1(spark, sf_dir):
    path = new_path(spark, "arriving")
    hourly_values(spark, sf_dir).repartition(3, "lat_idx").write.parquet(path)
    target = streams.stream_ingest(streams.read_files(spark, path, 1), "tp", new_path(spark, "streamed"))
    return _stored(spark.read.parquet(target))


N2 = "SELECT CAST(lat_idx // 2 AS INTEGER) AS chunk_lat, CAST(lon_idx // 2 AS INTEGER) AS chunk_lon, count(*) AS saved FROM cell_daily GROUP BY 1, 2 HAVING count(*) >= 2000"


@query("n2_chunk_complete", N2)
def n2(spark, sf_dir):
    saved = m.with_chunks(a.cell_daily(spark, sf_dir), SIZE)
    expected = saved.select(*m.CHUNK_KEYS).distinct().withColumn("samples", F.lit(2000).cast("long"))
    return chunks.chunk_complete(saved, expected).select(*m.CHUNK_KEYS, "saved")


def saved_samples(spark, sf_dir, expected):
    """One row for each saved sample, some of them twice."""
    rows = m.with_chunks(a.cell_daily(spark, sf_dir), SIZE).select(*m.CHUNK_KEYS, F.xxhash64(*CELL, "date").alias("sample"), F.lit(expected).cast("bigint").alias("samples"), F.lit(False).alias("flush"))
    return rows.union(rows.filter("sample % 3 = 0"))


COMPLETE = "chunk_lat int, chunk_lon int, saved bigint, complete boolean"


@query("n2_chunk_complete_stream", "SELECT chunk_lat, chunk_lon FROM (" + N2 + ")")
def n2_stream(spark, sf_dir):
    source = new_path(spark, "saved")
    saved_samples(spark, sf_dir, 2000).repartition(4).write.parquet(source)
    out = streams.chunk_complete_stream(streams.read_files(spark, source, 1), new_path(spark, "complete"))
    return spark.read.schema(COMPLETE).parquet(out).filter("complete").select(*m.CHUNK_KEYS)


@query("n2_chunk_flush_stream", "SELECT chunk_lat, chunk_lon, CASE WHEN saved < 2500 THEN saved ELSE -1 END AS short, saved >= 2500 AS complete FROM (" + N2.replace(" HAVING count(*) >= 2000", "") + ")")
def n2_flush(spark, sf_dir):
    source, path = new_path(spark, "saved"), new_path(spark, "flushed")
    rows = saved_samples(spark, sf_dir, 2500)
    rows.repartition(2).write.parquet(source)
    streams.chunk_complete_stream(streams.read_files(spark, source, 1), path)
    ends = rows.select(*m.CHUNK_KEYS).distinct().selectExpr("*", "cast(null as bigint) as sample", "cast(null as bigint) as samples", "true as flush")
    ends.coalesce(1).write.mode("append").parquet(source)
    streams.chunk_complete_stream(streams.read_files(spark, source, 1), path)  # a second run takes up where the first ended
    return spark.read.schema(COMPLETE).parquet(path).select(*m.CHUNK_KEYS, F.when(~F.col("complete"), F.col("saved")).otherwise(-1).alias("short"), "complete")


@query("n3_stream_metrics", "SELECT trial, name, min(value) AS best, count(*) AS checks FROM metric_log GROUP BY 1, 2")
def n3(spark, sf_dir):
    return arrived(spark, sf_dir, 10**9).select("trial", "name", "best", "checks")


def arrived(spark, sf_dir, patience):
    """Status after two runs of a stream whose second source holds the later half and some of the first again."""
    path, state = new_path(spark, "status"), new_path(spark, "state")
    rows = a.metric_log(spark, sf_dir)
    for i, part in enumerate((rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1 or event_id % 10 = 0"))):
        source = new_path(spark, "metrics")
        part.repartition(2).write.parquet(source)
        streams.stream_metrics(streams.read_files(spark, source, 1), path, ["step", "wall_time", "event_id"], patience, state=f"{state}-{i}")
    return streams.latest(spark, path)


@query(
    "n3_early_stop",
    "WITH c AS (SELECT *, row_number() OVER w AS c, min(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM metric_log WINDOW w AS (PARTITION BY trial, name ORDER BY step, wall_time, event_id)), h AS (SELECT *, max(CASE WHEN prior IS NULL OR value < prior THEN c END) OVER (PARTITION BY trial, name ORDER BY c ROWS UNBOUNDED PRECEDING) AS hit FROM c), s AS (SELECT *, min(CASE WHEN c - hit >= 20 THEN c END) OVER (PARTITION BY trial, name) AS stop FROM h) SELECT trial, name, min(value) AS best, count(*) AS checks, CAST(max(hit) FILTER (WHERE stop IS NULL OR c <= stop) AS INTEGER) AS best_check, CAST(coalesce(max(stop), -1) AS INTEGER) AS stop_check FROM s GROUP BY 1, 2",
)
def n3_stop(spark, sf_dir):
    out = arrived(spark, sf_dir, 20)
    return out.select("trial", "name", "best", "checks", "best_check", F.coalesce("stop_check", F.lit(-1)).alias("stop_check"))


@query("a2_stats_merged", "SELECT 'v' AS variable, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM cell_daily")
def a2_merged(spark, sf_dir):
    parts = maps.stats(m.with_chunks(a.cell_daily(spark, sf_dir), SIZE), ["v"], m.CHUNK_KEYS)
    return maps.merge_stats(parts).select("variable", "n", r("mean"), r("std"))


@query("a2_stats_by_chunk", "SELECT lat_idx // 2 AS chunk_lat, lon_idx // 2 AS chunk_lon, 'v' AS variable, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM cell_daily GROUP BY 1, 2")
def a2_chunks(spark, sf_dir):
    return maps.stats(m.with_chunks(a.cell_daily(spark, sf_dir), SIZE), ["v"], m.CHUNK_KEYS).select(*m.CHUNK_KEYS, "variable", "n", r("mean"), r("std"))
