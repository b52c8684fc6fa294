"""Views of the given relational tables as cell tables. CTES holds the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(df: DataFrame, lat: str, lon: str, *more) -> DataFrame:
    return df.select(F.expr(lat).cast("int").alias("lat_idx"), F.expr(lon).cast("int").alias("lon_idx"), *more)


def cell_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cell(table(spark, sf_dir, "lineitem"), "l_suppkey % 8", "l_partkey % 10", F.to_date("l_shipdate").alias("date"), "l_quantity", "l_extendedprice")
    return rows.groupBy("lat_idx", "lon_idx", "date").agg(F.avg("l_quantity").alias("v"), F.avg("l_extendedprice").alias("v2"))


def cell_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cell(table(spark, sf_dir, "events"), "user_id div 15", "user_id % 15", F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), "value")
    return rows.groupBy("lat_idx", "lon_idx", "date", "hour").agg(F.sum("value").alias("v"))


def cell_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cell(table(spark, sf_dir, "part"), "p_partkey % 8", "(p_partkey div 8) % 10", "p_size", "p_retailprice")
    return rows.groupBy("lat_idx", "lon_idx").agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("price"))


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cell(table(spark, sf_dir, "lineitem"), "l_suppkey % 8", "l_partkey % 10", (F.col("l_linenumber") - 1).alias("layer"), "l_quantity")
    return rows.filter("layer <= 5").groupBy("lat_idx", "lon_idx", "layer").agg(F.avg("l_quantity").alias("sndppt"))


def mask(spark: SparkSession, sf_dir: str, days: int = 75) -> DataFrame:
    """Cells with at least so many days in 1996."""
    rows = cell_daily(spark, sf_dir)
    return rows.groupBy("lat_idx", "lon_idx").agg((F.count_if(F.year("date") == 1996) >= days).alias("mask"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("id"), F.expr("(c_custkey * 37 % 400) / 10.0").alias("lat"), F.expr("(c_custkey * 53 % 600) / 10.0").alias("lon"), F.col("c_acctbal").alias("z")).withColumns({"lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double")})


def pred_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("sample"),
        F.col("l_linenumber").alias("step"),
        (F.col("l_extendedprice") / 2000).alias("prediction"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("target"),
        (F.col("l_discount") + 0.01).alias("variance"),
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(
        (F.col("user_id") % 10).cast("int").alias("trial"),
        F.col("ts").alias("wall_time"),
        F.col("event_type").alias("name"),
        F.get_json_object("props", "$.k").cast("bigint").alias("step"),
        "value",
        "event_id",
    )


CTES = {
    "cell_daily": "SELECT CAST(l_suppkey % 8 AS INTEGER) AS lat_idx, CAST(l_partkey % 10 AS INTEGER) AS lon_idx, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS v, avg(l_extendedprice) AS v2 FROM lineitem GROUP BY 1, 2, 3",
    "cell_hourly": "SELECT CAST(user_id // 15 AS INTEGER) AS lat_idx, CAST(user_id % 15 AS INTEGER) AS lon_idx, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour, sum(value) AS v FROM events GROUP BY 1, 2, 3, 4",
    "cell_static": "SELECT CAST(p_partkey % 8 AS INTEGER) AS lat_idx, CAST((p_partkey // 8) % 10 AS INTEGER) AS lon_idx, avg(p_size) AS size, avg(p_retailprice) AS price FROM part GROUP BY 1, 2",
    "layers": "SELECT CAST(l_suppkey % 8 AS INTEGER) AS lat_idx, CAST(l_partkey % 10 AS INTEGER) AS lon_idx, l_linenumber - 1 AS layer, avg(l_quantity) AS sndppt FROM lineitem WHERE l_linenumber <= 6 GROUP BY 1, 2, 3",
    "mask": "SELECT lat_idx, lon_idx, count(*) FILTER (WHERE year(date) = 1996) >= 75 AS mask FROM cell_daily GROUP BY 1, 2",
    "points": "SELECT c_custkey AS id, (c_custkey * 37 % 400) / 10.0 AS lat, (c_custkey * 53 % 600) / 10.0 AS lon, c_acctbal AS z FROM customer",
    "pred_obs": "SELECT l_orderkey AS sample, l_linenumber AS step, l_extendedprice / 2000 AS prediction, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS target, l_discount + 0.01 AS variance FROM lineitem",
    "metric_log": "SELECT CAST(user_id % 10 AS INTEGER) AS trial, ts AS wall_time, event_type AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS step, value, event_id FROM events",
    # Shared intermediate results.
    "msc_raw": "SELECT lat_idx, lon_idx, dayofyear(date) AS doy, avg(v) AS m FROM cell_daily GROUP BY 1, 2, 3",
    "msc": "SELECT c.lat_idx, c.lon_idx, d.doy, CASE WHEN count(r.m) >= 5 THEN avg(r.m) END AS v_msc FROM (SELECT DISTINCT lat_idx, lon_idx FROM msc_raw) c CROSS JOIN (SELECT unnest(range(1, 367)) AS doy) d LEFT JOIN msc_raw r ON r.lat_idx = c.lat_idx AND r.lon_idx = c.lon_idx AND (abs(r.doy - d.doy) <= 8 OR abs(r.doy - d.doy) >= 358) GROUP BY 1, 2, 3",
    "hourly_dense": "SELECT c.lat_idx, c.lon_idx, d.date, h.hour, e.v FROM (SELECT DISTINCT lat_idx, lon_idx FROM cell_hourly) c CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS date) d CROSS JOIN (SELECT CAST(unnest(range(0, 24)) AS INTEGER) AS hour) h LEFT JOIN cell_hourly e ON e.lat_idx = c.lat_idx AND e.lon_idx = c.lon_idx AND e.date = d.date AND e.hour = h.hour",
    "cell_accum": "SELECT lat_idx, lon_idx, date, hour, sum(coalesce(v, 0)) OVER (PARTITION BY lat_idx, lon_idx, date ORDER BY hour ROWS UNBOUNDED PRECEDING) AS acc FROM hourly_dense",
    "stats": "SELECT count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM cell_daily",
    "chunks": "SELECT DISTINCT CAST(lat_idx // 2 AS INTEGER) AS chunk_lat, CAST(lon_idx // 2 AS INTEGER) AS chunk_lon FROM mask WHERE mask",
    "folded": "SELECT chunk_lat, chunk_lon, CAST(ntile(4) OVER (ORDER BY md5(concat_ws('|', CAST(chunk_lat * 5 + chunk_lon AS VARCHAR), '42')), chunk_lat, chunk_lon) AS INTEGER) AS fold FROM chunks",
    "fold_mask": "SELECT m.lat_idx, m.lon_idx, CASE WHEN m.mask THEN coalesce(f.fold, 0) ELSE 0 END AS fold_mask FROM mask m LEFT JOIN folded f ON f.chunk_lat = m.lat_idx // 2 AND f.chunk_lon = m.lon_idx // 2",
    "last_log": "SELECT trial, name, step, wall_time, value FROM (SELECT *, row_number() OVER (PARTITION BY trial, name, step ORDER BY wall_time DESC, event_id DESC) AS rn FROM metric_log) WHERE rn = 1",
    "regrid_src": "SELECT CAST(l_suppkey % 6 AS INTEGER) AS src_lat, CAST(l_partkey % 7 AS INTEGER) AS src_lon, avg(CASE WHEN (l_suppkey % 6) * 7 + l_partkey % 7 <> 17 THEN l_quantity END) AS v FROM lineitem GROUP BY 1, 2",
}
