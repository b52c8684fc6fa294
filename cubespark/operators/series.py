"""Whole series, cell by cell, for functions that need many steps of a cell at once: context attributions and samples."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.functions.grid import CELL

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Central differences step by this share of the larger of 1 and the value.
STEP = 1e-4
#: Numbers that a block of contexts may hold; a few blocks of them fit a processor's cache.
BLOCK = 1 << 17


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(lat_idx, lon_idx, rows) of each cell of a partition that is sorted by cell; what is held is one cell's series."""
    held: list[pa.RecordBatch] = []
    at: tuple[int, int] | None = None
    for batch in batches:
        lat, lon = batch.column("lat_idx").to_numpy(), batch.column("lon_idx").to_numpy()
        cuts = np.flatnonzero((np.diff(lat) != 0) | (np.diff(lon) != 0)) + 1
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if begin == end:
                continue
            key = (int(lat[begin]), int(lon[begin]))
            if held and key != at:
                yield *at, pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield *at, pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """(rows, width) of a column of numbers or of arrays of one length; null is NaN."""
    flat = column.combine_chunks()
    if pa.types.is_list(flat.type):
        sizes = np.diff(flat.offsets.to_numpy())
        width = int(sizes.max(initial=1)) if width is None else width
        out = np.full((len(flat), width), np.nan)
        whole = flat.is_valid().to_numpy(zero_copy_only=False) & (sizes == width)
        values = flat.values.to_numpy(zero_copy_only=False).astype(float)
        first = flat.offsets.to_numpy()[:-1][whole]
        out[whole] = values[first[:, None] + np.arange(width)]
        return out
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, 1)


def nested(values: np.ndarray) -> pa.Array:
    """An array of nested lists, one for each index of the first axis; NaN is null."""
    flat = np.ascontiguousarray(values, float).ravel()
    out: pa.Array = pa.array(flat, pa.float64(), mask=np.isnan(flat))
    for size in reversed(values.shape[1:]):
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(out) // size + 1 if size else len(values) + 1, dtype=np.int32) * size), out)
    return out


def slopes(score: Callable, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the score of each row by each of its elements, by central differences."""
    out = []
    for part in (x, s):
        grad = np.empty_like(part)
        flat, flat_grad = part.reshape(len(part), -1), grad.reshape(len(part), -1)
        for e in range(flat.shape[1]):
            old = flat[:, e].copy()
            h = STEP * np.maximum(1, np.abs(old))
            flat[:, e] = old + h
            above = score(x, s)
            flat[:, e] = old - h
            flat_grad[:, e] = (above - score(x, s)) / (2 * h)
            flat[:, e] = old
        out.append(grad)
    return out[0], out[1]


def path_integral(score: Callable, gradient: Callable | None, x: np.ndarray, s: np.ndarray, x0: np.ndarray, s0: np.ndarray, n_steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Integrated gradients of whole contexts x (rows, days, hours, features) and statics s (rows, statics)."""
    at, weight = np.polynomial.legendre.leggauss(n_steps)
    gx, gs = np.zeros_like(x), np.zeros_like(s)
    for a, w in zip((at + 1) / 2, weight / 2, strict=True):
        here = x0 + a * (x - x0), s0 + a * (s - s0)
        dx, ds = gradient(*here) if gradient else slopes(score, *here)
        gx, gs = gx + w * dx, gs + w * ds
    return (x - x0) * gx, (s - s0) * gs


def attribute_contexts(days: DataFrame, score: Callable, features: list[str], statics: list[str], k: int, n_steps: int = 50, gradient: Callable | None = None, target: str | None = None) -> DataFrame:
    """What each day of its context, and each static, adds to the score of a target day.

    ``days`` holds one row for each cell and day: every feature a number or an array of hours, its base value beside it in
    ``<feature>_base``, statics and their ``_base`` likewise. ``score(x, s)`` gets numpy arrays x (rows, k, hours, features)
    and s (rows, statics) and gives a number for each row: it may couple all days. ``gradient(x, s)`` gives both
    derivatives; without it they are central differences, two scores for each element. The path integral is a
    Gauss-Legendre sum over whole contexts.

    Targets are days whose k days up to it all have a row (and where column ``target``, if given, is true). A missing value
    counts as its base value, and a missing base value as 0. Result: (lat_idx, lon_idx, time, ``attr_<feature>``, an array of k
    daily means over the hours; ``attr_<static>``; ``delta``, the score less that of the base; ``hours``).

    Series are dealt by cell once and sorted; a task holds one cell's series and a block of contexts at a time, so a context
    is never copied through a shuffle. Contexts of short series share a block: the score is called for a block, not for a cell.
    """
    names = [*features, *[f"{f}_base" for f in features], *statics, *[f"{s}_base" for s in statics]]
    wanted = F.lit(True) if target is None else F.coalesce(F.col(target), F.lit(False))
    there = F.col("date").isNotNull() & F.col("lat_idx").isNotNull() & F.col("lon_idx").isNotNull()
    rows = days.filter(there).select(*CELL, "date", wanted.alias("_target"), *names).repartition(*CELL).sortWithinPartitions(*CELL, "date")

    def contexts(batches):
        """Keys, contexts and statics of the targets of one cell after the other, at most a block at a time."""
        for lat, lon, table in cells(batches):
            parts = [matrix(table.column(f)) for f in features]
            hours = max([1, *(p.shape[1] for p in parts)])
            side = lambda end, hours=hours, table=table: np.stack([np.broadcast_to(matrix(table.column(f"{f}{end}")), (table.num_rows, hours)) for f in features], axis=2) if features else np.zeros((table.num_rows, hours, 0))
            fixed = lambda end, table=table: np.concatenate([matrix(table.column(f"{s}{end}")) for s in statics], axis=1) if statics else np.zeros((table.num_rows, 0))
            x0, s0 = np.nan_to_num(side("_base")), np.nan_to_num(fixed("_base"))
            x, s = side(""), fixed("")
            x, s = np.where(np.isnan(x), x0, x), np.where(np.isnan(s), s0, s)
            date = table.column("date").to_numpy().astype("datetime64[D]").astype(np.int64)
            end = np.flatnonzero(table.column("_target").to_numpy(zero_copy_only=False))
            end = end[end >= k - 1]
            end = end[(date[end] - date[end - k + 1] == k - 1)]
            size = max(1, BLOCK // max(1, k * hours * max(1, len(features))))
            for begin in range(0, len(end), size):
                some = end[begin : begin + size]
                context = some[:, None] + np.arange(-k + 1, 1)
                n = len(some)
                yield size, hours, (np.full(n, lat, np.int32), np.full(n, lon, np.int32), date[some], x[context], x0[context], s[some], s0[some])

    def attributed(hours, held):
        lat, lon, date, xs, x0s, ss, s0s = (np.concatenate(c) for c in zip(*held, strict=True))
        ax, as_ = path_integral(score, gradient, xs, ss, x0s, s0s, n_steps)
        delta = score(xs, ss) - score(x0s, s0s)
        columns = [pa.array(lat), pa.array(lon), pa.array(date.astype("datetime64[D]"))]
        columns += [nested(ax[..., i].mean(axis=2)) for i in range(len(features))] + [pa.array(as_[:, i]) for i in range(len(statics))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(delta, pa.float64()), pa.array(np.full(len(date), hours, np.int32))], names=out)

    def run(batches):
        held, count, shape = [], 0, 0
        for size, hours, part in contexts(batches):
            if held and (hours != shape or count + len(part[2]) > size):
                yield attributed(shape, held)
                held, count = [], 0
            held.append(part)
            count, shape = count + len(part[2]), hours
        if held:
            yield attributed(shape, held)

    out = [*CELL, "time", *[f"attr_{f}" for f in features], *[f"attr_{s}" for s in statics], "delta", "hours"]
    kinds = ["int", "int", "date", *["array<double>"] * len(features), *["double"] * len(statics), "double", "int"]
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(out, kinds, strict=True)))


def attributions_long(df: DataFrame, features: list[str]) -> DataFrame:
    """X9, long form: (lat_idx, lon_idx, time, context, feature, attr), context from -k + 1 to 0."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"attr_{f}").alias("attr")) for f in features])).alias("a")
    rows = df.select(*CELL, "time", each).select(*CELL, "time", "a.feature", F.size("a.attr").alias("k"), F.posexplode("a.attr").alias("at", "attr"))
    return rows.select(*CELL, "time", (F.col("at") + 1 - F.col("k")).alias("context"), "feature", "attr")


SAMPLE = (
    "coords struct<lat_idx:int,lon_idx:int,chunk_lat:int,chunk_lon:int,window_start:date,window_end:date,num_days:int,dayofyear:array<int>>, "
    "f_hourly array<array<array<double>>>, f_static array<double>, f_hourly_bl array<array<array<double>>>, f_static_bl array<double>, "
    "t_hourly_ts array<array<double>>, t_hourly_msc array<array<double>>, t_hourly_ano array<array<double>>, "
    "t_daily_ts array<double>, t_daily_msc array<double>, t_daily_ano array<double>"
)


#: Members of a sample, in the order of SAMPLE.
MEMBERS = ("f_hourly", "f_static", "f_hourly_bl", "f_static_bl", "t_hourly_ts", "t_hourly_msc", "t_hourly_ano", "t_daily_ts", "t_daily_msc", "t_daily_ano")
#: Rows of a batch of the long form; no date or hour there.
ROWS, NONE = 20_000, -(1 << 40)


def _samples(
    hourly: DataFrame,
    daily: DataFrame | None,
    msc_hourly: DataFrame,
    msc_daily: DataFrame | None,
    static: DataFrame,
    windows: DataFrame,
    stats: dict[str, tuple[float, float]],
    features: list[str],
    statics: list[str],
    target_hourly: str | None = None,
    target_daily: str | None = None,
    size: int = 20,
    precip_zero: bool = False,
    baseline: bool = True,
) -> tuple[DataFrame, Callable]:
    """The rows of all tables dealt by cell, and a function from a partition of them to what ``full_samples`` returns, as
    (lat_idx, lon_idx, window_start, window_end, num_days, days, doy, arrays of the members in the order of MEMBERS)."""
    names = [*dict.fromkeys([*features, *([target_hourly] if target_hourly else [])])]

    def tagged(df: DataFrame, kind: int, at, hour, values: list) -> DataFrame:
        there = F.col("lat_idx").isNotNull() & F.col("lon_idx").isNotNull() & at.isNotNull() & hour.between(0, 23)
        return df.filter(there).select(*CELL, F.lit(kind).alias("kind"), at.cast("int").alias("at"), hour.cast("int").alias("hour"), F.array(*[F.col(v).cast("double") for v in values]).cast("array<double>").alias("v"))

    none, day = F.lit(0), F.unix_date("date")
    parts = [
        tagged(static, 0, none, none, statics),
        tagged(msc_hourly, 1, F.col("doy"), F.col("hour"), [f"{c}_msc" for c in names]),
        tagged(hourly, 3, day, F.col("hour"), names),
    ]
    if target_daily:
        parts += [tagged(msc_daily, 2, F.col("doy"), none, [f"{target_daily}_msc"]), tagged(daily, 4, day, none, [target_daily])]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = rows.repartition(*CELL).sortWithinPartitions(*CELL)
    spans = [tuple(r) for r in windows.select(F.unix_date("start_context_date"), "start_window_date", "end_window_date", F.unix_date("end_window_date"), "num_window_days").collect()]  # one row a window
    one = np.array([stats.get(c, (0.0, 1.0)) for c in names], float).reshape(-1, 2)
    fixed = np.array([stats.get(c, (0.0, 1.0)) for c in statics], float).reshape(-1, 2)
    goal = stats.get(target_daily, (0.0, 1.0))
    dry = [i for i, f in enumerate(features) if f == "tp" and precip_zero]

    def samples(batches):
        for lat, lon, table in cells(batches):
            kind, at, hour = (table.column(c).to_numpy() for c in ("kind", "at", "hour"))
            lists = table.column("v").combine_chunks()
            first, values = lists.offsets.to_numpy()[:-1], lists.values.to_numpy(zero_copy_only=False).astype(float)

            def of(k, width):
                own = np.flatnonzero(kind == k)
                return own, values[first[own][:, None] + np.arange(width)] if width else np.zeros((len(own), 0))

            def dense(k, days, width, hours, day0=0):
                own, v = of(k, width)
                there = (at[own] >= day0) & (at[own] < day0 + days)
                out = np.full((days, hours, width), np.nan)
                out[at[own][there] - day0, hour[own][there]] = v[there]
                return out

            own, s = of(0, len(statics))
            s = s[0] if len(own) else np.full(len(statics), np.nan)
            cycle, cycle_daily = dense(1, 367, len(names), 24), dense(2, 367, 1, 1)
            for start, begin, end, last, num_days in spans:
                days = np.arange(start, last + 1).astype("datetime64[D]")
                doy = (days - days.astype("datetime64[Y]").astype("datetime64[D]")).astype(int) + 1
                x = (dense(3, len(days), len(names), 24, start) - one[:, 0]) / one[:, 1]
                m = (cycle[doy] - one[:, 0]) / one[:, 1]
                n = len(features)
                base = m[..., :n].copy()
                base[..., dry] = (0.0 - one[dry, 0]) / one[dry, 1]
                scaled = (s - fixed[:, 0]) / fixed[:, 1]
                hourly_targets = [None] * 3
                if target_hourly:
                    t = names.index(target_hourly)
                    hourly_targets = [x[..., t], m[..., t], x[..., t] - m[..., t]]
                daily_targets = [None] * 3
                if target_daily:
                    ts = (dense(4, len(days), 1, 1, start)[:, 0, 0] - goal[0]) / goal[1]
                    ms = (cycle_daily[doy][:, 0, 0] - goal[0]) / goal[1]
                    daily_targets = [ts, ms, ts - ms]
                members = [x[..., :n], scaled, base if baseline else None, np.zeros(len(statics)) if baseline else None, *hourly_targets, *daily_targets]
                yield lat, lon, begin, end, num_days, days, doy, members

    return rows, samples


def full_samples(
    hourly: DataFrame,
    daily: DataFrame | None,
    msc_hourly: DataFrame,
    msc_daily: DataFrame | None,
    static: DataFrame,
    windows: DataFrame,
    stats: dict[str, tuple[float, float]],
    features: list[str],
    statics: list[str],
    target_hourly: str | None = None,
    target_daily: str | None = None,
    size: int = 20,
    precip_zero: bool = False,
    baseline: bool = True,
) -> DataFrame:
    """One row of schema SAMPLE for each cell with a row and each window: hourly features [day][hour][feature], statics,
    the baselines of both, hourly and daily targets as series, seasonal cycle and anomaly, and coordinates.

    hourly: (cell, date, hour, features and target_hourly); msc_hourly: (cell, doy, hour, ``<name>_msc``); daily, msc_daily
    likewise without hours. Baselines are the seasonal cycle of each feature (0 for tp if ``precip_zero``) and the mean of each
    static. ``stats`` maps variables to (mean, standard deviation); all is scaled, anomalies by the deviation alone. Days run
    from the start of the context to the end of the window. What is missing is null; members that aren't asked for are null. A cell with statics or
    seasonal cycles only gives samples too (null series). Of rows that repeat a step of a cell, one counts.

    All tables are dealt by cell together, in one exchange, and sorted; a task holds the series of one cell.
    """
    rows, samples = _samples(hourly, daily, msc_hourly, msc_daily, static, windows, stats, features, statics, target_hourly, target_daily, size, precip_zero, baseline)

    def run(batches):
        for lat, lon, begin, end, num_days, _, doy, members in samples(batches):
            coords = {"lat_idx": lat, "lon_idx": lon, "chunk_lat": lat // size, "chunk_lon": lon // size, "window_start": begin, "window_end": end, "num_days": num_days, "dayofyear": doy.tolist()}
            made = [pa.nulls(1, f.type) if v is None else nested(v[None]).cast(f.type) for v, f in zip(members, list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([coords], arrow[0].type), *made], schema=arrow)

    number = pa.float64()
    one_deep, two_deep = pa.list_(number), pa.list_(pa.list_(number))
    three_deep = pa.list_(two_deep)
    where = pa.struct([(c, pa.int32()) for c in ("lat_idx", "lon_idx", "chunk_lat", "chunk_lon")] + [("window_start", pa.date32()), ("window_end", pa.date32()), ("num_days", pa.int32()), ("dayofyear", pa.list_(pa.int32()))])
    kinds = [where, three_deep, one_deep, three_deep, one_deep, two_deep, two_deep, two_deep, one_deep, one_deep, one_deep]
    arrow = pa.schema(list(zip(("coords", *MEMBERS), kinds, strict=True)))
    return rows.mapInArrow(run, SAMPLE)


def sample_rows(hourly: DataFrame, daily: DataFrame | None, msc_hourly: DataFrame, msc_daily: DataFrame | None, static: DataFrame, windows: DataFrame, stats: dict[str, tuple[float, float]], features: list[str], statics: list[str], **more) -> DataFrame:
    """X12, long form: what ``full_samples`` (same arguments) holds that isn't null, a row for each value.

    (lat_idx, lon_idx, window_start, date, hour, member, place, x): date is null for statics, hour for statics and daily
    members; place is the position in ``features`` or ``statics``, 0 for targets. Tasks hand on no nulls, so what moves grows
    with the values of a cell, not with the steps of its windows.
    """
    rows, samples = _samples(hourly, daily, msc_hourly, msc_daily, static, windows, stats, features, statics, **more)
    kinds = [pa.int32(), pa.int32(), pa.date32(), pa.date32(), pa.int32(), pa.string(), pa.int32(), pa.float64()]
    arrow = pa.schema(list(zip((*CELL, "window_start", "date", "hour", "member", "place", "x"), kinds, strict=True)))
    words = pa.array(MEMBERS)

    def packed(parts):
        lat, lon, begin, day, hour, member, place, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        dates = [pa.array(d.astype(np.int32), pa.int32()).cast(pa.date32()) for d in (begin, np.where(day == NONE, 0, day))]
        dates[1] = pc.if_else(pa.array(day != NONE), dates[1], None)
        hours = pa.array(hour.astype(np.int32), mask=hour == NONE)
        return pa.RecordBatch.from_arrays([pa.array(lat), pa.array(lon), *dates, hours, words.take(pa.array(member)), pa.array(place.astype(np.int32)), pa.array(x)], schema=arrow)

    def run(batches):
        held, count = [], 0
        for lat, lon, begin, _, _, days, _, members in samples(batches):
            first, start = days[0].astype(np.int64), np.datetime64(begin, "D").astype(np.int64)
            for i, values in enumerate(members):
                if values is None:
                    continue
                at = np.nonzero(~np.isnan(values))
                n = len(at[0])
                if not n:
                    continue
                none = np.full(n, NONE)
                fixed, hourly_ = MEMBERS[i].startswith("f_static"), "hourly" in MEMBERS[i]
                day = none if fixed else first + at[0]
                hour = at[1] if hourly_ else none
                place = at[-1] if MEMBERS[i].startswith("f_") else np.zeros(n, np.int64)
                held.append((np.full(n, lat, np.int32), np.full(n, lon, np.int32), np.full(n, start), day, hour, np.full(n, i), place, values[at]))
                count += n
            if count >= ROWS:
                yield packed(held)
                held, count = [], 0
        if held:
            yield packed(held)

    return rows.mapInArrow(run, "lat_idx int, lon_idx int, window_start date, date date, hour int, member string, place int, x double")
