"""Ingest, scans, write-back and streams on small tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cubespark.functions import dates
from cubespark.operators import chunks
from cubespark.sources import files
from cubespark.streaming import streams

HOURLY = "lat_idx int, lon_idx int, ts timestamp_ntz, value double"


def hours(spark, start, n, add=0.0):
    at = dt.datetime.fromisoformat(start)
    return spark.createDataFrame([(1, 2, at + dt.timedelta(hours=i), float(i + add)) for i in range(n)], HOURLY)


def stored(spark, path):
    rows = spark.read.parquet(path).collect()
    return {(str(r["date"]), r["hour"]): round(r["value"], 3) for r in rows}


def test_ingest_fills_its_months_only(spark, tmp_path):
    path = str(tmp_path / "cube")
    for start in ("2020-01-01", "2020-02-01"):
        target = files.ingest(hours(spark, start, 48), "t2m", path)
    before = stored(spark, target)
    files.ingest(hours(spark, "2020-02-01", 24, add=100), "t2m", path)
    after = stored(spark, target)
    assert len(before) == 96 and before[("2020-01-01", 3)] == pytest.approx(3 - 273.15)
    assert len(after) == 72 and after[("2020-02-01", 0)] == pytest.approx(100 - 273.15)
    assert after[("2020-01-02", 0)] == before[("2020-01-02", 0)]


def test_layouts(spark):
    assert files.layout_of(hours(spark, "2020-01-01", 5)) == "hourly"
    assert files.layout_of(hours(spark, "2020-01-01T07:00:00", 1)) == "hourly" and files.layout_of(hours(spark, "2020-01-01", 1)) == "daily"
    assert files.layout_of(spark.createDataFrame([(1, 2, 3.0)], "lat_idx int, lon_idx int, value double")) == "static"
    odd = hours(spark, "2020-01-01", 3).withColumn("ts", F.expr("ts + interval 7 minutes"))
    with pytest.raises(ValueError, match="neither"):
        files.layout_of(odd)


def test_scan(spark, tmp_path):
    target = files.ingest(hours(spark, "2020-01-30", 96), "tp", str(tmp_path / "cube"))
    assert files.scan_files(spark, target, "tp", "*", 2020, [2]).count() == 48
    with pytest.raises(FileNotFoundError):
        files.scan_files(spark, target, "ssrd")
    assert files.scan_files(spark, target, "ssrd", must_exist=False).count() == 0


def test_stack_and_split_are_inverse(spark):
    df = hours(spark, "2020-03-01", 30)
    back = dates.stack_time(dates.split_day_hour(df)).select("lat_idx", "lon_idx", "ts", "value")
    assert back.exceptAll(df).isEmpty()
    with pytest.raises(ValueError):
        dates.stack_time(df)


def test_stream_ingest_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    parts = [hours(spark, "2020-01-31", 30), hours(spark, "2020-01-01", 10), hours(spark, "2020-01-31", 5, add=50)]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(source)
    target = streams.stream_ingest(streams.read_files(spark, source, 1), "tp", str(tmp_path / "out"))
    got = stored(spark, target)
    assert len(got) == 40 and got[("2020-02-01", 5)] == pytest.approx(29_000) and got[("2020-01-01", 9)] == pytest.approx(9_000)
    assert got[("2020-01-31", 2)] in (2_000.0, 52_000.0)


def test_later_runs_keep_what_earlier_ones_stored(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for start, n in (("2020-01-01T03:00:00", 1), ("2020-01-01", 5), ("2020-01-02", 5)):
        hours(spark, start, n).coalesce(1).write.mode("append").parquet(source)
        target = streams.stream_ingest(streams.read_files(spark, source, 1), "tp", out)
    got = stored(spark, target)
    assert len(got) == 10 and got[("2020-01-01", 4)] == pytest.approx(4_000) and got[("2020-01-02", 4)] == pytest.approx(4_000)
    assert got[("2020-01-01", 3)] == pytest.approx(3_000) and not (tmp_path / "out" / "daily").exists()


def test_repeated_hours_of_a_trigger_have_an_order(spark, tmp_path):
    source = str(tmp_path / "in")
    both = hours(spark, "2020-01-01", 3, add=9).withColumn("seen", F.lit(1)).union(hours(spark, "2020-01-01", 3).withColumn("seen", F.lit(2)))
    both.coalesce(1).write.parquet(source)
    target = streams.stream_ingest(streams.read_files(spark, source, 1), "tp", str(tmp_path / "out"), order="seen")
    assert stored(spark, target)[("2020-01-01", 2)] == pytest.approx(2_000)


def test_stats_of_groups_without_values(spark):
    from cubespark.operators import maps

    df = spark.createDataFrame([(1, 2.0, None), (1, 4.0, None), (2, None, None)], "g int, v double, w double")
    got = {(r["g"], r["variable"]): (r["n"], r["mean"], r["std"]) for r in maps.stats(df, ["v", "w"], ["g"]).collect()}
    assert got == {(1, "v"): (2, 3.0, 1.0), (2, "v"): (0, None, None), (1, "w"): (0, None, None), (2, "w"): (0, None, None)}
    merged = {r["variable"]: (r["n"], r["mean"], r["std"]) for r in maps.merge_stats(maps.stats(df, ["v", "w"], ["g"])).collect()}
    assert merged == {"v": (2, 3.0, 1.0), "w": (0, None, None)}
    with pytest.raises(Exception, match="no valid values"):
        maps.stats(df, ["w"], ["g"]).collect()


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return final.count("Exchange "), final.count("FileScan"), final


def test_season_plans(spark, tmp_path):
    from cubespark.operators import season

    rows = [(i % 7, i % 3, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(i % 50)) for i in range(900)]
    spark.createDataFrame(rows, "lat_idx int, lon_idx int, date date, v double").write.parquet(str(tmp_path / "daily"))
    daily = spark.read.parquet(str(tmp_path / "daily"))
    for df in (season.anomaly(daily), season.smooth_msc(season.msc_raw(daily.repartition("lat_idx", "lon_idx")))):
        n, scans, plan = exchanges(df)
        assert (n, scans) == (1, 1), plan
    assert season.anomaly(daily).count() == 900


def test_scratch(spark):
    from cubespark.sources import scratch

    df = scratch.written(spark.range(5), "some")
    assert df.count() == 5 and files.exists(spark, df.inputFiles()[0].rsplit("/", 1)[0])
    rows = spark.range(1000).selectExpr("id", "cast(id * 7919 % 1000 as double) as v")
    got = scratch.numbered(rows, ["v"], "at").collect()
    assert all(r["at"] == r["v"] and r["at_all"] == 1000 for r in got) and len(got) == 1000
    folder = df.inputFiles()[0].rsplit("/", 2)[0]
    scratch.remove_scratch(spark)
    assert not files.exists(spark, folder)


def test_chunk_completeness(spark):
    saved = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] * 2, "chunk_lat int, chunk_lon int")
    expected = spark.createDataFrame([(0, 0, 3), (0, 1, 3)], "chunk_lat int, chunk_lon int, samples int")
    assert [(r["chunk_lon"], r["saved"]) for r in chunks.chunk_complete(saved, expected).collect()] == [(0, 3)]
    assert {r["chunk_lon"]: r["complete"] for r in chunks.chunk_complete(saved, expected, flush=True).collect()} == {0: True, 1: False}


def test_predictions_and_catalog(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0)], "lat_idx int, lon_idx int")
    spine = files.cube_spine(cells, "2020-01-01", "2020-01-10")
    pred = spine.withColumn("ts", F.lit(2.0))
    stats = spark.createDataFrame([(10.0, 3.0)], "mean double, std double")
    path = str(tmp_path / "pred")
    files.write_predictions(pred, stats, spine, 4, path)
    got = [r["v_hat"] for r in spark.read.parquet(path).orderBy("date").collect()]
    assert got == [None] * 6 + [16.0] * 4
    named = files.with_metadata(pred, {"ts": {"units": "K"}})
    assert named.schema["ts"].metadata == {"units": "K"}
    row = files.var_catalog(pred, {"ts": ("Series", "K")}).first()
    assert (row["variable"], row["long_name"], row["units"], row["mean"], row["std"]) == ("ts", "Series", "K", 2.0, 0.0)
