"""Small inputs with values worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cubespark.functions import grid, values
from cubespark.operators import attribution, logs, maps, masks, metrics, regrid, reshape, samples, season


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def losses(spark):
    return frame(spark, [(1, 1.0, None, 0.25), (1, 1.0, 2.0, 0.25), (2, 1.0, 2.0, 0.25), (2, 1.0, 2.0, 0.25)], "sample int, prediction double, target double, variance double")


@pytest.mark.parametrize(("kind", "want"), [("l1", 1.0), ("l2", 1.0), ("huber", 0.255)])
@pytest.mark.parametrize("sample", [None, "sample"])
def test_masked_loss(losses, kind, want, sample):
    assert metrics.masked_loss(losses, kind, sample).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("sample", [None, "sample"])
def test_beta_nll(losses, sample):
    assert metrics.beta_nll(losses, 0.5, sample).first()[0] == pytest.approx(1.1128956763)


def test_nan_mse_of_nothing_is_null(losses):
    assert metrics.nan_mse_mae(losses.filter("target is null")).first()[0] is None


def test_mixed_variances_are_an_error(losses):
    with pytest.raises(ValueError):
        metrics.step_losses(losses.selectExpr("sample", "prediction as ts_hat", "target as ts", "variance as ts_var", "1.0 as ano", "1.0 as ano_hat"), ["ts", "ano"])


def test_stats(spark):
    row = maps.stats(frame(spark, [(1.0,), (2.0,), (4.0,), (None,)], "v double"), ["v"]).first()
    assert (row["n"], row["mean"], row["std"]) == (3, pytest.approx(2.3333333333), pytest.approx(1.2472191289))


def test_flux(spark):
    days = [dt.date(2020, 1, 1), dt.date(2020, 1, 2)]
    rows = [(0, 0, d, h, float((h + 1) * (i + 1))) for i, d in enumerate(days) for h in range(24)]
    got = season.cumulative_to_flux(frame(spark, rows, "lat_idx int, lon_idx int, date date, hour int, acc double"), "acc").orderBy("date", "hour").collect()
    assert [r["flux"] for r in got] == [2.0] + [1.0] * 22 + [-22.0] + [4.0] + [2.0] * 22 + [0.0]


def smooth(spark, rows):
    return {r["doy"]: r["v_msc"] for r in season.smooth_msc(frame(spark, rows, "lat_idx int, lon_idx int, doy int, m double")).collect()}


def test_smoothing_wraps(spark):
    got = smooth(spark, [(0, 0, d, 17.0 if d == 1 else 0.0) for d in range(1, 367)])
    assert {d for d, v in got.items() if v == pytest.approx(1.0)} == {*range(1, 10), *range(359, 367)}
    assert all(v == 0 for d, v in got.items() if 9 < d < 359)


def test_smoothing_needs_five(spark):
    got = smooth(spark, [(0, 0, d, 1.0) for d in range(1, 5)])
    assert len(got) == 366 and set(got.values()) == {None}


def test_anomaly_plus_msc_is_value(spark):
    rows = [(0, 0, dt.date(2001 + y, 1, 1) + dt.timedelta(days=d), float(d % 11 + y)) for y in range(2) for d in range(0, 365, 2)]
    for r in season.anomaly(frame(spark, rows, "lat_idx int, lon_idx int, date date, v double")).collect():
        assert r["v_ano"] + r["v_msc"] == pytest.approx(r["v"])


def test_profile(spark):
    row = frame(spark, [(60.0, 50.0, 45.0, 40.0, 35.0, 30.0)], "a double, b double, c double, d double, e double, f double")
    assert row.select(values.layer_profile_mean([F.col(c) for c in "abcdef"])).first()[0] == pytest.approx(38.125)


def test_normalize(spark):
    row = spark.range(1)
    one, two = F.lit(1.0), F.lit(2.0)
    pick = lambda *a, **k: row.select(values.normalize(F.lit(a[0]), one, two, **k)).first()[0]
    assert (pick(3.0), pick(1.0, invert=True), pick(3.0, is_uncertainty=True), pick(3.0, invert=True, is_uncertainty=True)) == (1.0, 3.0, 1.5, 6.0)


def years(spark, first, last):
    return frame(spark, [(y,) for y in range(first, last + 1)], "year int")


@pytest.mark.parametrize(
    ("first", "last", "context", "window", "want"),
    [
        (2002, 2005, 2, 2, ("2002-01-02", 731, 1460)),
        (2002, 2021, 2, -1, ("2002-01-06", 6575, 7300)),
        (2004, 2007, 2, 2, ("2004-01-02", 730, 1460)),
    ],
)
def test_date_windows(spark, first, last, context, window, want):
    r = samples.date_windows(years(spark, first, last), context, window).first()
    assert (str(r["start_context_date"]), r["num_window_days"], (r["end_window_date"] - r["start_context_date"]).days + 1) == want


def test_year_windows(spark):
    y = years(spark, 2002, 2021)
    assert samples.year_windows(y, 2, 2).first()["n_windows"] == 9
    assert samples.year_windows(y, 2, -1).first()["n_windows"] == 1
    with pytest.raises(Exception, match="divide"):
        samples.year_windows(y, 2, 4).collect()


@pytest.mark.parametrize(("n", "left", "want"), [(9, [1, 10, 10], [1, 4, 4]), (8, [10, 10, 1], [4, 3, 1]), (10, [4, 4, 4, 4], [3, 3, 2, 2])])
def test_fair_share(spark, n, left, want):
    got = samples.fair_share(frame(spark, list(enumerate(left)), "chunk int, left int"), n).orderBy("chunk").collect()
    assert [r["take"] for r in got] == want


def test_fair_share_too_few(spark):
    with pytest.raises(Exception, match="too few"):
        samples.fair_share(frame(spark, [(0, 2)], "chunk int, left int"), 3).collect()


@pytest.mark.parametrize(("fold_id", "want"), [(0, (1, 2)), (8, (9, 10)), (9, (10, 1))])
def test_fold_roles(spark, fold_id, want):
    got = masks.fold_roles(frame(spark, [(i,) for i in range(11)], "fold_mask int"), fold_id).collect()
    roles = {r["role"]: r["fold_mask"] for r in got if r["role"] in ("val", "test")}
    assert (roles["val"], roles["test"]) == want
    with pytest.raises(ValueError):
        masks.fold_roles(spark.range(1), 10)


def test_fold_sizes(spark):
    cells = frame(spark, [(i, 0, True) for i in range(23)], "lat_idx int, lon_idx int, mask boolean")
    got = masks.assign_folds(cells, 10, 1, 3, 1).groupBy("fold_mask").count().collect()
    assert sorted(r["count"] for r in got) == [2] * 7 + [3] * 3


def test_disks():
    assert [len(masks.disk(n)) for n in (3, 5, 7)] == [5, 13, 29]
    with pytest.raises(ValueError):
        masks.disk(4)


def opened(spark, cells, n):
    every = frame(spark, [(y, x, (y, x) in cells) for y in range(n) for x in range(n)], "lat_idx int, lon_idx int, mask boolean")
    return {(r["lat_idx"], r["lon_idx"]) for r in masks.binary_opening(every, n, n).filter("mask").collect()}


def test_opening(spark):
    full = {(y, x) for y in range(5) for x in range(5)}
    assert opened(spark, full, 5) == {(y, x) for y, x in full if abs(y - 2) + abs(x - 2) <= 2}
    block = {(y, x) for y in range(2, 7) for x in range(2, 7)} | {(4, 7)}
    once = opened(spark, block, 9)
    assert len(block) == 26 and len(once) == 18 and once <= block and opened(spark, once, 9) == once


def test_roi(spark):
    got = grid.roi_from_anchor(frame(spark, [(y, x) for y in range(195, 265) for x in range(835, 945)], "lat_idx int, lon_idx int"), 10, 50, 5, 3)
    r = got.agg(F.min("lat_idx"), F.max("lat_idx"), F.min("lon_idx"), F.max("lon_idx")).first()
    assert tuple(r) == (200, 259, 840, 939)


def test_integrated_gradients(spark):
    df = frame(spark, [(3.0, 4.0, 0.0, 0.0)], "a double, b double, a_base double, b_base double")
    r = attribution.integrated_gradients(df, lambda x: x["a"] * x["a"] + 2 * x["b"] + x["a"] * x["b"], ["a", "b"]).first()
    assert tuple(r) == (pytest.approx(15, abs=1e-5), pytest.approx(14, abs=1e-5))


def test_regrid_constant(spark):
    src = frame(spark, [(y, x, 3.5) for y in range(6) for x in range(6)], "src_lat int, src_lon int, v double")
    assert {round(r["v"], 9) for r in regrid.regrid_conservative(src, 1.0, 0.7).collect()} == {3.5}


@pytest.mark.parametrize(("last", "want"), [(4.0, 2.6), (None, 1.0 / 0.6)])
def test_regrid_overlaps(spark, last, want):
    # The target 1..2 meets sources of width 0.4 at 0.2, 0.4 and 0.4 of its width.
    src = frame(spark, [(0, 2, 1.0), (0, 3, 2.0), (0, 4, last)], "src_lat int, src_lon int, v double")
    got = regrid.regrid_conservative(src, 0.4, 1.0).filter("lon_idx = 1").first()
    assert got["v"] == pytest.approx(want)


def test_histogram(spark):
    rows = frame(spark, [(x,) for x in (0.0, 0.5, 1.0, 1.0, 1.2)], "v double")
    got = maps.weighted_histogram(rows, "v", None, 3, 0.0, 1.0).orderBy("bin").collect()
    assert [r["n"] for r in got] == [1, 3]


def test_repeat_pool_dedupe(spark):
    t = frame(spark, [(0, 0.0), (1, 1.0)], "t int, v double")
    assert [r["v"] for r in reshape.repeat_time(t, 2).orderBy("t").collect()] == [0.0, 0.0, 1.0, 1.0]
    seven = frame(spark, [(0, i, float(i)) for i in range(1, 8)], "c int, t int, v double")
    assert [r["mean"] for r in reshape.avg_pool_time(seven, 3, ["c"], ["t"], "v").orderBy("block").collect()] == [2.0, 5.0]
    log = frame(spark, [("a", 1, 0.5, 1), ("a", 1, 0.7, 2), ("b", 1, 2.0, 3)], "name string, step int, value double, wall_time int")
    assert {(r["name"], r["value"]) for r in logs.dedupe_keep_last(log, ["name", "step"], ["wall_time"]).collect()} == {("a", 0.7), ("b", 2.0)}


def test_best_trial(spark):
    trials = frame(spark, [(2, 0.1), (1, 0.1), (3, 0.4)], "trial int, score double")
    assert logs.best_trial(trials).first()["trial"] == 1
    with pytest.raises(Exception, match="no trials"):
        logs.best_trial(trials.filter("trial > 9")).collect()


def test_drop_value_needs_one(spark):
    ones = frame(spark, [(1.0,), (1.0,)], "x double")
    with pytest.raises(Exception, match="kept"):
        reshape.drop_value(ones, "x", 1.0).collect()


def test_batches_cover_all(spark):
    rows = frame(spark, [(i, i % 7) for i in range(100)], "id int, chunk int")
    got = samples.assign_batches(rows, 8, 2, 1, ["chunk"], ["id"]).collect()
    sizes = {}
    for r in got:
        sizes[r["batch_id"]] = sizes.get(r["batch_id"], 0) + 1
    assert len({r["id"] for r in got}) == 100 and sorted(sizes.values()) == [4] + [8] * 12
    assert samples.assign_batches(rows, 8, 2, 1, ["chunk"], ["id"], drop_last=True).count() == 96


def test_weighted_median(spark):
    rows = frame(spark, [(float(i), 1.0) for i in (1, 2, 3, 4)], "x double, w double")
    assert maps.weighted_quantile(rows, 0.5, "x", "w").first()[0] == pytest.approx(2.5)
    assert maps.weighted_quantile(rows, 0.5, "x", "w", method="lower").first()[0] == 2.0
