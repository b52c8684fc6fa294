"""Context attributions, full samples, pruning, co-location, rolling batches, dense squares, and streams by key, by hand."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import os
import random
import sys
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cubespark.functions import grid
from cubespark.operators import maps, masks, samples, season, series
from cubespark.plans import explain
from cubespark.sources import files
from cubespark.streaming import streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY = dt.date(2001, 1, 1)
CUBE = "lat_idx int, lon_idx int, date date, "


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def days(rows):
    return [(lat, lon, DAY + dt.timedelta(days=d), *rest) for lat, lon, d, *rest in rows]


def score(x, s):
    """Couples all days, hours, features and statics."""
    return (x * np.arange(1.0, 1 + x[0].size).reshape(x.shape[1:])).sum(axis=(1, 2, 3)) ** 2 + 3 * s[:, 0] * x.sum(axis=(1, 2, 3))


def gradient(x, s):
    w = np.arange(1.0, 1 + x[0].size).reshape(x.shape[1:])
    u = (x * w).sum(axis=(1, 2, 3))
    return 2 * u[:, None, None, None] * w + 3 * s[:, 0][:, None, None, None], 3 * x.sum(axis=(1, 2, 3))[:, None]


def context_frame(spark):
    rng = random.Random(2)
    rows = [(lat, 0, d, [rng.random(), None if d == 4 else rng.random()], [0.5, 0.25], rng.random(), None, 2.0 + lat, 1.0) for lat in (0, 1) for d in range(9) if (lat, d) != (1, 5)]
    return spark.createDataFrame(days(rows), CUBE + "a array<double>, a_base array<double>, b double, b_base double, s double, s_base double").repartition(5, "date")


def test_contexts_are_complete_and_whole(spark):
    df = context_frame(spark)
    out = series.attribute_contexts(df, score, ["a", "b"], ["s"], 3, 6)
    got = {(r["lat_idx"], (r["time"] - DAY).days): r for r in out.collect()}
    # Cell 1 lacks day 5: no context holds it.
    assert set(got) == {(0, d) for d in range(2, 9)} | {(1, d) for d in (2, 3, 4, 8)}
    for r in got.values():
        assert r["hours"] == 2 and len(r["attr_a"]) == len(r["attr_b"]) == 3
        total = r["hours"] * (sum(r["attr_a"]) + sum(r["attr_b"])) + r["attr_s"]
        assert math.isclose(total, r["delta"], rel_tol=1e-7, abs_tol=1e-7)
    exact = {(r["lat_idx"], (r["time"] - DAY).days): r for r in series.attribute_contexts(df, score, ["a", "b"], ["s"], 3, 6, gradient).collect()}
    for k, r in got.items():
        assert np.allclose(r["attr_a"], exact[k]["attr_a"], atol=1e-6) and np.allclose(r["attr_b"], exact[k]["attr_b"], atol=1e-6) and math.isclose(r["attr_s"], exact[k]["attr_s"], abs_tol=1e-6)
    long = series.attributions_long(out, ["a", "b"]).filter("lat_idx = 0 and time = '2001-01-04'").collect()
    assert sorted((r["feature"], r["context"]) for r in long) == [(f, c) for f in "ab" for c in (-2, -1, 0)]
    assert plan_of(out).count("Exchange ") == 2  # the test's own, and the one by cell


def test_a_block_is_a_part_of_a_series(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 1)
    df = context_frame(spark).withColumn("goal", F.col("date") > DAY + dt.timedelta(days=5))
    out = series.attribute_contexts(df, score, ["a", "b"], ["s"], 2, 4, gradient, target="goal")
    assert sorted((r["lat_idx"], (r["time"] - DAY).days) for r in out.collect()) == [(0, 6), (0, 7), (0, 8), (1, 7), (1, 8)]
    assert series.attribute_contexts(df.limit(0), score, ["a", "b"], ["s"], 2, 4).count() == 0


def test_short_series_share_a_block(spark, tmp_path):
    rows = [(lat, 0, d, float(lat + d), 0.0, 1.0, 0.0) for lat in range(40) for d in range(3)]
    df = spark.createDataFrame(days(rows), CUBE + "a double, a_base double, s double, s_base double")
    at = str(tmp_path)

    def counted(x, s):
        tempfile.mkstemp(dir=at)
        return score(x, s)

    out = series.attribute_contexts(df, counted, ["a"], ["s"], 2, 4, gradient).collect()
    want = series.attribute_contexts(df, score, ["a"], ["s"], 2, 4, gradient).collect()
    assert len(out) == 80 and sorted(out) == sorted(want)
    assert len(os.listdir(at)) <= 8  # two for each of at most four tasks


def test_gradient_of_the_decayed_score():
    score, gradient = explain.decayed(0.7, [1.0, 0.3], 0.2)
    rng = np.random.default_rng(3)
    x, s = rng.random((4, 5, 24, 2)), rng.random((4, 1))
    for exact, near in zip(gradient(x, s), series.slopes(score, x, s), strict=True):
        assert exact.shape == near.shape and np.allclose(exact, near, atol=1e-6)


def test_full_samples(spark, tmp_path):
    hourly = spark.createDataFrame([(21, 3, DAY, 0, 4.0, 2.0), (21, 3, DAY, 23, None, 3.0), (21, 3, DAY + dt.timedelta(days=400), 1, 8.0, 0.0)], "lat_idx int, lon_idx int, date date, hour int, v double, tp double")
    daily = spark.createDataFrame([(21, 3, DAY, 5.0)], CUBE + "d double")
    cycle = spark.createDataFrame([(21, 3, 1, 0, 3.0, 9.0)], "lat_idx int, lon_idx int, doy int, hour int, v_msc double, tp_msc double")
    cycle_daily = spark.createDataFrame([(21, 3, 1, 4.5)], "lat_idx int, lon_idx int, doy int, d_msc double")
    static = spark.createDataFrame([(21, 3, 10.0), (2, 2, 12.0)], "lat_idx int, lon_idx int, s double")
    tables = {}
    for name, df in {"hourly": hourly, "daily": daily, "cycle": cycle, "cycle_daily": cycle_daily, "static": static}.items():
        df.write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    windows = spark.createDataFrame([(DAY, dt.date(2001, 12, 31), DAY, 365)], "start_window_date date, end_window_date date, start_context_date date, num_window_days int")
    stats = {"v": (2.0, 2.0), "tp": (1.0, 4.0), "d": (1.0, 2.0), "s": (11.0, 1.0)}
    out = series.full_samples(tables["hourly"], tables["daily"], tables["cycle"], tables["cycle_daily"], tables["static"], windows, stats, ["v", "tp"], ["s"], "v", "d", precip_zero=True)
    assert out.schema == spark.createDataFrame([], series.SAMPLE).schema
    got = {r["coords"]["lat_idx"]: r for r in out.collect()}
    r, empty = got[21], got[2]
    assert (r["coords"]["chunk_lat"], r["coords"]["chunk_lon"], r["coords"]["num_days"], r["coords"]["dayofyear"]) == (1, 0, 365, list(range(1, 366)))
    assert len(r["f_hourly"]) == 365 and r["f_hourly"][0][0] == [1.0, 0.25] and r["f_hourly"][0][23] == [None, 0.5] and r["f_hourly"][1][0] == [None, None]
    assert r["f_hourly_bl"][0][0] == [0.5, -0.25] and r["f_hourly_bl"][0][1] == [None, -0.25]
    assert r["f_static"] == [-1.0] and r["f_static_bl"] == [0.0] and empty["f_static"] == [1.0]
    assert (r["t_hourly_ts"][0][0], r["t_hourly_msc"][0][0], r["t_hourly_ano"][0][0]) == (1.0, 0.5, 0.5)
    assert (r["t_daily_ts"][0], r["t_daily_msc"][0], r["t_daily_ano"][0], r["t_daily_ts"][1]) == (2.0, 1.75, 0.25, None)
    assert all(x is None for d in empty["f_hourly"] for h in d for x in h)
    plain = series.full_samples(hourly, None, cycle, None, static, windows, stats, ["v"], ["s"], baseline=False).filter("coords.lat_idx = 21").first()
    assert plain["f_hourly_bl"] is None and plain["t_daily_ts"] is None and plain["t_hourly_ts"] is None
    assert plan_of(out).count("Exchange ") == 1


def test_chunk_keys_prune_the_scan(spark, tmp_path):
    rows = [(lat, lon, DAY, 1.0) for lat in range(8) for lon in range(8)]
    path = tmp_path / "cube"
    masks.with_chunks(spark.createDataFrame(rows, CUBE + "v double"), 2).repartition("chunk_lat", "chunk_lon").write.partitionBy("chunk_lat", "chunk_lon").parquet(str(path))
    mask = spark.createDataFrame([(lat, lon, lat < 2 and lon > 5) for lat in range(8) for lon in range(8)], "lat_idx int, lon_idx int, mask boolean")
    out = masks.mask_chunks(spark.read.parquet(str(path)), mask, 2)
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()
    for file in path.glob("chunk_lat=[123]/*/*.parquet"):
        file.write_bytes(b"not read")
        Path(str(file.parent / f".{file.name}.crc")).unlink(missing_ok=True)
    assert out.count() == 4 and set(out.columns) == {"lat_idx", "lon_idx", "date", "v", "chunk_lat", "chunk_lon"}


def test_tables_by_cell_need_no_exchange(spark, tmp_path):
    rng = random.Random(1)
    rows = [(lat, lon, DAY + dt.timedelta(days=d), h, rng.random()) for lat in range(3) for lon in range(3) for d in range(40) for h in (0, 12)]
    df = spark.createDataFrame(rows, CUBE + "hour int, v double")
    table = files.write_by_cell(df, "by_cell_test", str(tmp_path / "by_cell"), 4, ("date", "hour"))
    try:
        for out in (season.anomaly(table), season.cumulative_to_flux(table, "v")):
            assert "Exchange" not in plan_of(out)
        assert sorted(map(str, season.anomaly(table).collect())) == sorted(map(str, season.anomaly(df).select(*season.anomaly(table).columns).collect()))
    finally:
        spark.sql("DROP TABLE by_cell_test")


def test_seasons_with_null_dates_and_own_columns(spark):
    rows = [(0, 0, DAY + dt.timedelta(days=i), float(i), 77) for i in range(10)] + [(0, 0, None, 5.0, 77)]
    df = spark.createDataFrame(rows, CUBE + "v double, doy int")
    got = season.anomaly(df)
    assert got.columns == ["lat_idx", "lon_idx", "date", "v", "doy", "v_msc", "v_ano"]
    by = {r["doy"]: r for r in got.collect()}
    assert set(by) == {*range(1, 11), None} and (by[None]["v_msc"], by[None]["v_ano"]) == (None, None)
    assert by[1]["v_msc"] == sum(range(9)) / 9 and by[10]["v_msc"] == sum(range(1, 10)) / 9
    smooth = {r["doy"]: r["v_msc"] for r in season.smooth_msc(season.msc_raw(df)).collect()}
    assert all(by[d]["v_msc"] == smooth[d] for d in range(1, 11)) and len(smooth) == 366


def test_the_season_is_a_circle(spark):
    rng = random.Random(9)
    rows = [(0, 0, dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(1460)), rng.choice([None, rng.random()])) for _ in range(900)]
    df = spark.createDataFrame(rows, CUBE + "v double")
    smooth = {r["doy"]: r["v_msc"] for r in season.smooth_msc(season.msc_raw(df)).collect()}
    for r in season.anomaly(df).collect():
        assert (r["v_msc"] is None) == (smooth[r["doy"]] is None) and (r["v_msc"] is None or math.isclose(r["v_msc"], smooth[r["doy"]], rel_tol=1e-12))


def test_constant_values_have_a_bin(spark):
    df = spark.createDataFrame([(3.0, 1.0, 0.0)] * 4, "v double, y double, lat double")
    for robust in (True, False):
        assert [(r["bin"], r["n"]) for r in maps.weighted_histogram(df, "v", "lat", 5, robust=robust).collect()] == [(3, 4)]
    assert [(r["bin_x"], r["bin_y"], r["n"]) for r in maps.histogram_2d(df, "v", "y", (4, 2)).collect()] == [(3, 1, 4)]


@pytest.mark.parametrize("one_range", [0, 1000])
def test_null_is_a_group(spark, monkeypatch, one_range):
    from cubespark.sources import scratch

    monkeypatch.setattr(scratch, "ONE_RANGE", one_range)
    df = spark.createDataFrame([(None, float(i), 1.0) for i in range(5)] + [("x", float(i), 1.0) for i in range(3)], "g string, v double, w double")
    assert {r["g"]: r["quantile"] for r in maps.weighted_quantile(df, 0.5, "v", "w", ["g"]).collect()} == {None: 2.0, "x": 1.0}


def test_long_axes_are_searched_whole(spark):
    axis = spark.range(3000).select((F.col("id") * 2.0).alias("p"))
    df = spark.createDataFrame([(3.4,), (4321.2,), (None,), (-5.0,), (9e9,)], "x double")
    got = [r["nearest_p"] for r in grid.nearest_label(df, axis, "x", "p").collect()]
    assert got[:2] == [4.0, 4322.0] and got[3:] == [0.0, 5998.0]


def test_dense_squares_are_cut(spark, monkeypatch):
    monkeypatch.setattr(maps, "SQUARE", 10)
    rng = random.Random(4)
    points = [(i, rng.random() if i % 10 else 4 * rng.random() - 2, rng.random() if i % 10 else 4 * rng.random() - 2, rng.random()) for i in range(250)]
    df = spark.createDataFrame(points, "id bigint, lat double, lon double, z double")
    got = sorted((r["a"], r["b"]) for r in maps.pairs_within(df, 1.0).collect())
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(points, 2) if math.dist(a[1:3], b[1:3]) <= 1.0)
    assert got == want


def test_sample_rows_are_the_values_of_full_samples(spark, monkeypatch):
    monkeypatch.setattr(series, "ROWS", 5)
    rng = random.Random(6)
    at = lambda: (rng.randrange(3), 0, DAY + dt.timedelta(days=rng.randrange(1096)))
    hourly = spark.createDataFrame([(*at(), rng.randrange(24), rng.random(), None if i % 3 == 0 else 1.0) for i in range(30)], CUBE + "hour int, v double, tp double").dropDuplicates(["lat_idx", "date", "hour"])
    daily = spark.createDataFrame([(*at(), rng.random()) for _ in range(20)], CUBE + "d double").dropDuplicates(["lat_idx", "date"])
    cycle = spark.createDataFrame([(0, 0, 60, 5, 3.0, None), (2, 0, 366, 0, 1.0, 2.0)], "lat_idx int, lon_idx int, doy int, hour int, v_msc double, tp_msc double")
    cycle_daily = spark.createDataFrame([(1, 0, 59, 4.5)], "lat_idx int, lon_idx int, doy int, d_msc double")
    static = spark.createDataFrame([(0, 0, 10.0, None), (7, 0, None, 2.0)], "lat_idx int, lon_idx int, s double, t double")
    windows = samples.date_windows(spark.createDataFrame([(y,) for y in range(2001, 2004)], "year int"), 1, 2)
    tables = (hourly, daily, cycle, cycle_daily, static, windows, {"v": (1.0, 2.0), "d": (3.0, 4.0)}, ["v", "tp"], ["s", "t"])
    want = set()
    for r in series.full_samples(*tables, "v", "d").collect():
        c = r["coords"]
        first = c["window_end"] - dt.timedelta(days=len(c["dayofyear"]) - 1)
        for name in series.MEMBERS:
            for i, x in enumerate(r[name]):
                day = None if "static" in name else first + dt.timedelta(days=i)
                flat = [(None, i, x)] if day is None else [(None, 0, x)] if "daily" in name else [(h, f, y) for h, z in enumerate(x) for f, y in enumerate(z if name[0] == "f" else [z])]
                want |= {(c["lat_idx"], c["lon_idx"], c["window_start"], day, h, name, f, y) for h, f, y in flat if y is not None}
    got = series.sample_rows(*tables, target_hourly="v", target_daily="d").collect()
    assert len(got) == len(want) > 100 and {tuple(r) for r in got} == want


def test_points_of_one_place(spark, monkeypatch):
    """Many points on few places, some on one: pairs and sums equal those of all pairs, z may be missing."""
    monkeypatch.setattr(maps, "BUNDLE", 7)
    monkeypatch.setattr(maps, "SQUARE", 20)
    rng = random.Random(5)
    places = [(rng.randrange(-6, 6) / 2, rng.randrange(-6, 6) / 2) for _ in range(12)]
    points = [(i, *places[0 if i % 3 else rng.randrange(12)], None if i % 11 == 0 else 1e6 + rng.random()) for i in range(200)]
    df = spark.createDataFrame([*points, (900, None, 1.0, 2.0)], "id bigint, lat double, lon double, z double")
    pairs = [(a[0], b[0], math.dist(a[1:3], b[1:3]), None if None in (a[3], b[3]) else (a[3] - b[3]) ** 2) for a, b in itertools.combinations(points, 2)]
    pairs = [p for p in pairs if p[2] <= 1.5]
    got = maps.pairs_within(df, 1.5, digits=3).collect()
    assert sorted((r["a"], r["b"], r["dist"]) for r in got) == sorted((a, b, round(d, 3)) for a, b, d, _ in pairs)
    near = lambda x: None if x is None else round(x, 9)
    assert {(r["a"], r["b"]): near(r["sq"]) for r in got} == {(a, b): near(sq) for a, b, _, sq in pairs}
    lag = lambda d: max(math.ceil(d / 1.5 * 6), 1)
    found = {r["lag"]: r for r in maps.empirical_variogram(df, 6, 1.5).collect()}
    assert set(found) == {lag(p[2]) for p in pairs}
    for k, r in found.items():
        sq = [p[3] for p in pairs if lag(p[2]) == k]
        assert r["pairs"] == len(sq) and math.isclose(r["gamma"], np.mean([x for x in sq if x is not None]) / 2, rel_tol=1e-6)


def test_pairs_of_two_rows_are_few(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 3 as double) AS lat", "1.0D AS lon", "2.0D AS z")
    n = sorted(r["n"] for r in maps._bundles(df, "id").collect())
    assert sum(n) == 5000 and n[-1] ** 2 < 10_000


def rolling(sizes, order, buffer):
    """Positions (chunk, number in chunk) dealt one by one."""
    queue, left, out = list(order), dict(sizes), []
    places = [[queue.pop(0)] if queue else [] for _ in range(buffer)]
    while any(places):
        for c in itertools.chain(*places):
            out.append((c, sizes[c] - left[c]))
            left[c] -= 1
        for i, place in enumerate(places):
            if place and not left[place[0]]:
                places[i] = [queue.pop(0)] if queue else []
    return out


@pytest.mark.parametrize("sizes,buffer", [([5, 1, 4, 4, 2, 9, 1], 3), ([3], 4), ([2, 2, 2, 2, 2], 2), ([1] * 150 + [40], 5)])
def test_rolling_batches(spark, sizes, buffer):
    names = [None, *(f"c{i}" for i in range(1, len(sizes)))]
    rows = [(c, k) for c, n in zip(names, sizes, strict=True) for k in range(n)]
    df = spark.createDataFrame(rows, "chunk string, k int")
    md5 = lambda *x: F.md5(F.concat_ws("|", *x, F.lit("3")))
    order = [r["chunk"] for r in df.select("chunk").distinct().orderBy(md5(F.col("chunk")), "chunk").collect()]
    inner = {}
    for r in df.orderBy(md5(F.col("k").cast("string")), "k").collect():
        inner.setdefault(r["chunk"], []).append(r["k"])
    want = {(c, inner[c][i]): at // 4 for at, (c, i) in enumerate(rolling(dict(zip(names, sizes, strict=True)), order, buffer))}
    got = {(r["chunk"], r["k"]): r["batch_id"] for r in samples.rolling_batches(df, 4, buffer, 3, ["chunk"], ["k"]).collect()}
    assert got == want
    whole = samples.rolling_batches(df, 4, buffer, 3, ["chunk"], ["k"], drop_last=True).groupBy("batch_id").count().collect()
    assert len(whole) == len(rows) // 4 and all(r["count"] == 4 for r in whole)


SAVED = "chunk_lat int, chunk_lon int, sample bigint, samples bigint, flush boolean, at timestamp"


def put(spark, path, rows):
    spark.createDataFrame(rows, SAVED).coalesce(1).write.mode("append").parquet(path)


def read_all(spark, path):
    return sorted(tuple(r) for r in spark.read.schema("chunk_lat int, chunk_lon int, saved bigint, complete boolean").parquet(path).collect())


def test_a_repeated_flush_changes_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    now = dt.datetime(2024, 1, 1)
    steps = [[(0, 0, 1, 3, False, now), (0, 0, 1, 3, False, now), (0, 0, 2, 3, None, now)], [(0, 0, None, None, True, now)], [(0, 0, 2, 3, True, now)], [(0, 0, 3, 3, False, now), (1, 1, 7, 1, True, now)]]
    for rows in steps:
        put(spark, source, rows)
        streams.chunk_complete_stream(streams.read_files(spark, source), out)
    assert read_all(spark, out) == [(0, 0, 2, False), (1, 1, 1, True)]


def test_quiet_chunks_end_by_time(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    start = dt.datetime(2024, 1, 1)
    later = lambda m: start + dt.timedelta(minutes=m)
    for rows in ([(0, 0, 1, 2, False, start), (0, 0, 1, 2, False, start), (5, 5, 1, 1, False, start)], [(1, 1, 1, 9, False, later(40))], [(1, 1, 2, 9, False, later(200))], [(1, 1, 3, 9, False, later(201))]):
        put(spark, source, rows)
        streams.chunk_complete_stream(streams.read_files(spark, source), out, at="at", delay="10 minutes", quiet_seconds=3600)
    assert read_all(spark, out) == [(0, 0, 1, False), (5, 5, 1, True)]


def test_checks_of_null_trials_and_names_stay(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(1, "a", 1, 0.5), (None, "a", 1, 0.25), (1, None, 1, 0.75)]
    for i, step in enumerate((1, 2)):
        source = str(tmp_path / f"in{i}")
        spark.createDataFrame([(t, n, step, v / step) for t, n, _, v in rows], "trial int, name string, step int, value double").write.parquet(source)
        streams.stream_metrics(streams.read_files(spark, source), path, ["step"], state=f"{path}/_state{i}")
    got = {(r["trial"], r["name"], r["checks"], r["best"]) for r in streams.latest(spark, path).collect()}
    assert got == {(1, "a", 2, 0.25), (None, "a", 2, 0.125), (1, None, 2, 0.375)}


def test_sketches_merge_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("part"), (F.col("id") % 2).alias("region"), ((F.col("id") * 7919) % 60_000).cast("double").alias("v")).union(spark.sql("SELECT 99L, 5L, CAST(NULL AS DOUBLE)"))
    parts = maps.quantile_sketches(df, "v", ["region", "part"])
    assert [r["sketch"] for r in parts.filter("part = 99").collect()] == [None]
    merged = maps.merge_sketches(parts, ["region"])
    got = maps.sketch_quantiles(merged, [0.0, 0.25, 0.5, 0.99, 1.0]).collect()
    assert {r["region"] for r in got} == {0, 1} and all(r["n"] == 30_000 for r in got)
    assert all(abs(r["quantile"] / 60_000 - r["q"]) <= maps.RANK_ERROR for r in got)


def test_weights_serve_all_steps(spark):
    from cubespark.operators import regrid

    rng = random.Random(5)
    rows = [(i, j, d, None if rng.random() < 0.2 else rng.random()) for i in range(4) for j in range(5) for d in range(3)]
    df = spark.createDataFrame(rows, "src_lat int, src_lon int, day int, v double")
    weights = regrid.remap_weights(df, 10.0, 7.0)
    got = {(r["day"], r["lat_idx"], r["lon_idx"]): r["v"] for r in regrid.apply_weights(df, weights, "v", ["day"]).collect()}
    one = {(d, r["lat_idx"], r["lon_idx"]): r["v"] for d in range(3) for r in regrid.regrid_conservative(df.filter(f"day = {d}"), 10.0, 7.0).collect()}
    assert got.keys() == one.keys() and all(math.isclose(got[k], one[k]) for k in one)


def first_values(frames):
    for pdf in itertools.islice(frames, 3):
        yield pdf.head(1)[["lat_idx", "lon_idx", "v"]]


def test_chunks_are_handed_on_cell_by_cell(spark):
    from cubespark.operators import chunks

    rows = [(lat, lon, DAY + dt.timedelta(days=d), float(d)) for lat in range(4) for lon in range(4) for d in range(5, 0, -1)]
    df = spark.createDataFrame(rows, CUBE + "v double").repartition(7)
    got = sorted(tuple(r) for r in chunks.chunk_stream(df, first_values, "lat_idx int, lon_idx int, v double", 2).collect())
    # The first day of the first three cells of each chunk of four.
    assert got == sorted((a, b, 2 * a + i, 2 * b + j, 1.0) for a in (0, 1) for b in (0, 1) for i, j in ((0, 0), (0, 1), (1, 0)))


def test_a_lost_driver_costs_no_month(spark, tmp_path):
    import shutil

    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    put_hours = lambda rows: spark.createDataFrame(rows, "lat_idx int, lon_idx int, ts timestamp, value double").coalesce(1).write.mode("append").parquet(source)
    put_hours([(0, 0, dt.datetime(2020, 5, 1, h), float(h)) for h in range(6)])
    streams.stream_ingest(streams.read_files(spark, source), "t2m", path)
    put_hours([(0, 0, dt.datetime(2020, 5, 1, 5), 50.0), (0, 0, dt.datetime(2020, 5, 1, 7), 7.0)])
    streams.stream_ingest(streams.read_files(spark, source), "t2m", path)
    read = lambda: sorted((r["hour"], round(r["value"], 3)) for r in spark.read.parquet(f"{path}/hourly").collect())
    want = read()
    assert [h for h, _ in want] == [0, 1, 2, 3, 4, 5, 7]
    # The driver goes between deletion and rename of the month: the trigger isn't committed, the month's rows are gone.
    shutil.rmtree(tmp_path / "out" / "hourly" / "variable=t2m")
    for f in (tmp_path / "out" / "_state" / "t2m" / "commits").glob("*1*"):
        f.unlink()
    streams.stream_ingest(streams.read_files(spark, source), "t2m", path)
    assert read() == want
