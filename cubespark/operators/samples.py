"""Windows, samples and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubespark.functions.dates import leap_years
from cubespark.functions.grid import CELL
from cubespark.sources.scratch import numbered, written


def year_windows(years: DataFrame, context: int, window: int) -> DataFrame:
    """Distinct years as one sorted array, with the number of windows; bad arguments are errors.

    ``years`` has one column ``year``. The array holds calendar years, a few hundred at most.
    """
    row = years.select("year").distinct().agg(F.sort_array(F.collect_list("year")).alias("years"))
    n = F.size("years")
    width = n - context if window == -1 else F.lit(window)
    bad = F.when((F.lit(context) < 0) | (F.lit(context) >= n), "context out of range").when((width < 1) | (width > n), "window out of range").when((n - context) % width != 0, "years do not divide into windows")
    checked = F.when(bad.isNotNull(), F.raise_error(bad).cast("int")).otherwise(((n - context) / width).cast("int"))
    return row.select("years", checked.alias("n_windows"), width.alias("width"))


def date_windows(years: DataFrame, context: int, window: int) -> DataFrame:
    """Consecutive blocks of years after their context, as seven columns.

    The context starts a day later for each leap year in context and window, so that all samples are 365 days a year.
    """
    plan = year_windows(years, context, window).filter("n_windows > 0")
    rows = plan.select("years", "width", F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)).alias("i"))
    at = lambda k: F.get("years", k.cast("int"))
    start = F.col("i") * F.col("width")
    rows = rows.select(
        at(start).alias("start_context_year"), at(start + context).alias("start_window_year"), at(start + context + F.col("width") - 1).alias("end_window_year")
    )
    leaps = leap_years(F.col("start_context_year"), F.col("end_window_year"))
    rows = rows.withColumns(
        {
            "start_context_date": F.make_date("start_context_year", F.lit(1), leaps + 1),
            "start_window_date": F.make_date("start_window_year", F.lit(1), F.lit(1)),
            "end_window_date": F.make_date("end_window_year", F.lit(12), F.lit(31)),
        }
    )
    return rows.withColumn("num_window_days", F.datediff("end_window_date", "start_window_date") + 1)


def samples_by_windows(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """Every cell with every window; windows are at most one for each year."""
    return cells.crossJoin(F.broadcast(windows))


def attach_static(df: DataFrame, static: DataFrame) -> DataFrame:
    """Static features beside every step of their cell."""
    return df.join(static, CELL, "left")


def sample_sequence(df: DataFrame, chunk: list[str], order: list[str]) -> DataFrame:
    """Running position in the chunk, and how many come after."""
    at = F.row_number().over(Window.partitionBy(*chunk).orderBy(*order))
    return df.withColumn("seq", at).withColumn("remaining", F.count("*").over(Window.partitionBy(*chunk)) - F.col("seq"))


def fair_share(left: DataFrame, n: int, key: str = "chunk", have: str = "left") -> DataFrame:
    """A batch of n over chunks: floor(n / k) each, capped by what is left, the rest dealt round-robin.

    ``left`` holds one row for each buffered chunk, a handful. The turns of all chunks in order are the deal.
    """
    turns = left.select(key, F.explode(F.sequence(F.lit(1), F.least(have, F.lit(n)))).alias("turn")).filter(F.col("turn") >= 1)
    dealt = turns.withColumn("rank", F.row_number().over(Window.orderBy("turn", key))).filter(F.col("rank") <= n)
    shares = dealt.groupBy(key).agg(F.count("*").alias("take"))
    out = left.join(shares, key, "left").withColumn("take", F.coalesce("take", F.lit(0)))
    total = F.sum("take").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("take", F.when(total == n, F.col("take")).otherwise(F.raise_error(F.lit("too few samples are left")).cast("long")))


def sample_count(mask: DataFrame, windows: DataFrame, batch_size: int, drop_last: bool = False) -> DataFrame:
    """Number of samples and of batches."""
    sizes = mask.agg(F.count_if("mask").alias("cells")).crossJoin(windows.agg(F.count("*").alias("windows")))
    n = F.col("cells") * F.col("windows")
    return sizes.select(n.alias("samples"), (F.floor(n / batch_size) if drop_last else F.ceil(n / batch_size)).alias("batches"))


def assign_batches(samples: DataFrame, batch_size: int, buffer: int, seed: int, chunk: list[str], key: list[str], drop_last: bool = False) -> DataFrame:
    """X11: shuffled chunks in groups of ``buffer``; a group's samples, one chunk after the other in turns, form batches.

    Incomplete batches of all groups are merged into full ones (U4); the very last may be short and can be dropped.
    Windows span one buffer group each, or the leftovers (fewer than a batch for each group, numbered by running sums
    over groups), never all samples.
    """
    order = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in chunk], F.lit(str(seed))))
    chunks = samples.groupBy(*chunk).agg(F.count("*").alias("_n")).withColumn("_rank", F.row_number().over(Window.orderBy(order, *chunk)) - 1)
    chunks = chunks.withColumn("group", F.floor(F.col("_rank") / buffer))
    sizes = chunks.groupBy("group").agg(F.sum("_n").alias("_size"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    full, rest = F.floor(F.col("_size") / batch_size), F.col("_size") % batch_size
    sizes = sizes.select("group", full.alias("_full"), F.coalesce(F.sum(full).over(before), F.lit(0)).alias("_before"), F.coalesce(F.sum(rest).over(before), F.lit(0)).alias("_rest"), F.sum(full).over(Window.partitionBy(F.lit(0))).alias("_all"), F.sum(rest).over(Window.partitionBy(F.lit(0))).alias("_left"))
    rows = samples.join(chunks.select(*chunk, "group"), chunk).join(F.broadcast(sizes), "group")
    mine = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*chunk).orderBy(mine, *key)))
    at = F.row_number().over(Window.partitionBy("group").orderBy("_turn", *chunk)) - 1
    rows = rows.withColumn("_at", at)
    number = F.floor(F.col("_at") / batch_size)
    late = F.col("_rest") + F.col("_at") - F.col("_full") * batch_size
    batch = F.when(number < F.col("_full"), F.col("_before") + number).otherwise(F.col("_all") + F.floor(late / batch_size))
    rows = rows.withColumn("batch_id", batch)
    if drop_last:
        rows = rows.filter(F.col("batch_id") < F.col("_all") + F.floor(F.col("_left") / batch_size))
    return rows.select(*samples.columns, "batch_id")


def _entries(chunks: Column, buffer: int) -> Column:
    """A fold over the sizes of chunks in their order, in lists of lists (appending copies a list): for each chunk its place in
    the buffer and the turn at which it enters; at last the turns at which places run empty.

    A chunk enters the place that runs empty first, as each gives one sample a turn.
    """

    def enter(state: Column, chunk: Column) -> Column:
        first = F.array_min(state["ends"])
        place = (F.array_position(state["ends"], first) - 1).cast("int")
        ends = F.transform(state["ends"], lambda e, i: F.when(i == place, e + chunk["n"]).otherwise(e))
        return F.struct(ends.alias("ends"), F.array_append(state["found"], F.struct(chunk["rank"].alias("rank"), place.alias("place"), first.alias("enters"))).alias("found"))

    found = F.array().cast("array<struct<rank:int,place:int,enters:bigint>>")

    def some(state: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(state["ends"].alias("ends"), found.alias("found")), enter)
        bound = F.transform(F.array(done), lambda d: F.struct(d["ends"].alias("ends"), F.array_append(state["found"], d["found"]).alias("found")))
        return bound[0]

    parts = F.transform(F.sequence(F.lit(1), F.size(chunks), F.lit(64)), lambda i: F.slice(chunks, i, 64))
    none = F.array().cast("array<array<struct<rank:int,place:int,enters:bigint>>>")
    zero = F.struct(F.array_repeat(F.lit(0).cast("bigint"), buffer).alias("ends"), none.alias("found"))
    return F.aggregate(parts, zero, some, lambda s: F.struct(s["ends"].alias("ends"), F.flatten(s["found"]).alias("found")))


def rolling_batches(samples: DataFrame, batch_size: int, buffer: int, seed: int, chunk: list[str], key: list[str], drop_last: bool = False) -> DataFrame:
    """X11, rolling buffer: each turn deals one sample of each chunk in the buffer; a chunk that runs out makes room for the next.

    Chunks come in hash order. When a chunk enters and which place it takes follows from the sizes alone (one row for each
    chunk, a fold). Places are never idle before they run empty for good, so the position of a sample is the sum over
    places of the turns dealt before, and the places before its own in its turn: arithmetic on its row. Samples are numbered inside
    their chunk; they never meet beyond it. Adds ``batch_id``; the last batch may be short and can be dropped.
    """
    digest = lambda cols: F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))
    sizes = samples.groupBy(*chunk).agg(F.count("*").alias("_n"))
    sizes = written(sizes.withColumn("_rank", F.row_number().over(Window.orderBy(digest(chunk), *chunk))), "chunk-sizes")
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct(F.col("_rank").alias("rank"), F.col("_n").alias("n")))).alias("c")).filter(F.size("c") > 0)
    plan = written(listed.select(_entries(F.col("c"), buffer).alias("p")), "buffer-plan").select("p.ends", F.inline("p.found"))
    named = sizes.join(F.broadcast(plan), F.col("_rank") == F.col("rank")).select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(chunk)], "place", "enters", "ends")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(chunk)])
    rows = samples.join(named, same)
    turn = F.col("enters") + F.row_number().over(Window.partitionBy(*chunk).orderBy(digest(key), *key)) - 1
    rows = rows.withColumn("_turn", turn)
    before = F.aggregate("ends", F.lit(0).cast("bigint"), lambda s, e: s + F.least(e, F.col("_turn")))
    beside = F.size(F.filter("ends", lambda e, i: (i < F.col("place")) & (e > F.col("_turn"))))
    rows = rows.withColumn("batch_id", F.floor((before + beside) / batch_size))
    if drop_last:
        total = F.aggregate("ends", F.lit(0).cast("bigint"), lambda s, e: s + e)
        rows = rows.filter(F.col("batch_id") < F.floor(total / batch_size))
    return rows.select(*samples.columns, "batch_id")


def merge_partial_batches(parts: list[DataFrame], batch_size: int, order: list[str], drop_last: bool = False) -> DataFrame:
    """U4: leftovers of several frames renumbered into batches in one order, range by range."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = numbered(rows, order, "_at").withColumn("batch_id", F.floor(F.col("_at") / batch_size))
    if drop_last:
        rows = rows.filter(F.col("batch_id") < F.floor(F.col("_at_all") / batch_size))
    return rows.drop("_at", "_at_all")


def build_samples(df: DataFrame, msc: DataFrame, static: DataFrame, windows: DataFrame, stats: DataFrame, value: str = "v") -> DataFrame:
    """One row per (cell, window): coordinates, the scaled series with its seasonal part and anomaly, statics.

    Days run from the start of the context to the end of the window; ``num_days`` of them are scored.
    """
    # Windows, one for each year at most, come with the statistics and meet a date by its year.
    years = F.sequence(F.year("start_context_date"), F.year("end_window_date"))
    spans = windows.withColumns({"mean": stats.select("mean").scalar(), "std": stats.select("std").scalar()}).withColumn("_year", F.explode(years))
    rows = df.withColumns({"doy": F.dayofyear("date"), "_year": F.year("date")}).join(F.broadcast(spans), "_year")
    rows = rows.filter(F.col("date").between(F.col("start_context_date"), F.col("end_window_date"))).join(msc, [*CELL, "doy"], "left")
    scaled = lambda c: (c - F.col("mean")) / F.col("std")
    step = F.struct(
        "date",
        "doy",
        scaled(F.col(value)).alias("ts"),
        scaled(F.col(f"{value}_msc")).alias("msc"),
        ((F.col(value) - F.col(f"{value}_msc")) / F.col("std")).alias("ano"),
    )
    keys = [*CELL, "start_window_date", "end_window_date", "num_window_days"]
    series = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return series.join(static, CELL, "left")


def collate(samples: DataFrame, batch: str, members: list[str]) -> DataFrame:
    """The members of each batch as arrays in key order; a member that is null throughout stays null."""
    rows = samples.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(*CELL, *members))).alias("_s"), *[F.count(c).alias(f"_n_{c}") for c in members])
    some = [F.when(F.col(f"_n_{c}") > 0, F.transform("_s", lambda x, c=c: x[c])).alias(c) for c in members]
    return rows.select(batch, F.size("_s").alias("size"), *some)


def cells_for_samples(df: DataFrame, lat: list[int], lon: list[int]) -> DataFrame:
    """The cells (lat[i], lon[i])."""
    wanted = df.sparkSession.createDataFrame(list(zip(lat, lon, strict=True)), "lat_idx int, lon_idx int")
    return df.join(F.broadcast(wanted), CELL, "left_semi")
