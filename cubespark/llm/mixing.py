"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Documents of a source, in the order of a hash of their ids, form blocks of ``BLOCK_ROWS``, which are scheduled in parts of
``PART_ROWS``, one for each slot. Weights are whole multiples of 2^-31 of the largest. Periods of at most ``SLOTS`` slots,
cut where another 1/64 of the weight runs out, are worked out in parallel. What each source has got where a period starts follows from the
weights in closed form: sources are taken in the order in which they run out, and each gets its share of what those before
it leave, rounded down after an offset of its own is added. So shares add up to the slots, never fall, and stand still where
a source is used up, while the others share its slots; the offsets are spread evenly (multiples of the golden ratio), so
that what rounding leaves doesn't pile up in the last sources.
Within a period that gives a source q parts in n slots, part j is released at slot floor(j n / q) and due by slot
ceil((j + 1) n / q); each slot takes, of the released parts, the one with the earliest deadline. As the q add up to n, every
part meets its deadline: a source is less than a part away from the line between its two whole shares, and these are
one or two parts away from its unrounded target. So it stays within a block of it, however long the input is (the tests
measure at most 2.7 of the 4 parts of a block, with up to 2000 sources).

The work of a slot grows with the number of sources that have parts in its period, at most ``SLOTS``; that of a period
linearly with the number of all sources. There is no limit on either. ``within_target`` is true up to the slot where the first source
runs out; beyond it the targets are those of the sources left.

A null source is a source of its own. Repeated rows take places of their own; ties in the hash fall by id, and rows of
equal id and source are alike. Sources of equal weight and size are taken by name. Texts aren't read. An empty table gives
an empty table. Columns of the input named like a new one are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, small, unpacked, written

SLOTS, BLOCK_ROWS, PART_ROWS, TEMPERATURE, BUCKET_HEX = 256, 8, 2, 0.7, 3
NEW = ("block", "part", "release", "deadline", "slot", "position", "within_target")

#: Offsets are multiples of this share of FINE, the golden ratio.
FINE, GOLDEN = 1 << 20, 648_056
#: Sources that a fold keeps in one list: appending copies a list, so lists stay short.
CHUNK = 32
#: Parts that each source has got after ``at`` slots: a fold over the sources, chunk by chunk, in the order in which they run out.
SHARES = """flatten(aggregate(sources, named_struct('rest', {at}, 'got', cast(array() as array<array<bigint>>)),
  (s, c) -> transform(array(aggregate(c, named_struct('rest', s.rest, 'got', cast(array() as array<bigint>)),
    (t, x) -> transform(array(least(x.parts, (cast(t.rest as decimal(20, 0)) * x.weight + x.offset) div x.left)),
      q -> named_struct('rest', t.rest - q, 'got', array_append(t.got, q)))[0])),
    t -> named_struct('rest', t.rest, 'got', array_append(s.got, t.got)))[0],
  s -> s.got))"""


def _source_key(source: str) -> Column:
    return F.when(F.col(source).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(source)))


def release(nth: Column, q: Column, slots: Column | int) -> Column:
    return F.floor(nth * slots / q).cast("long")


def deadline(nth: Column, q: Column, slots: Column | int) -> Column:
    return F.ceil((nth + 1) * slots / q).cast("long")


def in_order(totals: DataFrame) -> DataFrame:
    """One row: ``sources``, structs (key, parts, weight, left) in the order in which they run out, ``slots`` in all, ``horizon``.

    totals: (key, n, weight) with n documents and a relative weight. ``left`` is the weight of a source and all after it.
    """
    whole = F.greatest(F.lit(1), F.round(F.col("weight") / F.max("weight").over(Window.partitionBy(F.lit(0))) * 2.0**31)).cast("bigint")
    rows = totals.select("key", F.ceil(F.col("n") / PART_ROWS).alias("parts"), whole.alias("w"))
    rows = rows.withColumn("ends", F.col("parts") / F.col("w"))
    # One row for each source, so these windows span a small table.
    order = Window.partitionBy(F.lit(0)).orderBy("ends", "key")
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"before": F.sum("parts").over(order) - F.col("parts"), "all": F.sum("w").over(onward), "total": F.sum("w").over(Window.partitionBy(F.lit(0))), "turn": F.row_number().over(order)})
    wide = lambda c: c.cast("decimal(20,0)")
    until = F.expr("before + cast(parts as decimal(20,0)) * cast(all as decimal(17,0)) div w")
    # Where the weight left passes a multiple of a 64th of all, or falls by a 64th of itself.
    cut = F.expr("w * 64 >= all OR all * 64 div total != (all - w) * 64 div total")
    offset = (F.col("turn").cast("bigint") * GOLDEN % FINE).cast("decimal(7,0)") * F.col("all").cast("decimal(17,0)")
    each = F.struct("turn", "key", "parts", (F.col("w") * FINE).cast("decimal(17,0)").alias("weight"), wide(offset).alias("offset"), (wide(F.col("all")) * FINE).cast("decimal(25,0)").alias("left"), until.alias("until"), cut.alias("cut"))
    row = rows.agg(F.sort_array(F.collect_list(each)).alias("sources"), F.sum("parts").alias("slots")).filter("slots > 0")
    chunks = F.transform(F.sequence(F.lit(1), F.size("sources"), F.lit(CHUNK)), lambda i: F.slice("sources", i, CHUNK))
    return row.select("sources", chunks.alias("chunks"), "slots", F.col("sources")[0]["until"].alias("horizon"))


#: Bits of a number in a packed part (deadline, source, number of the part), which sorts as these three do.
BITS = 10


def released(qs: Column, slots: Column) -> Column:
    """An array with the packed parts that each slot releases, for quotas ``qs`` that add up to ``slots``."""
    one = lambda q, i: F.transform(F.sequence(F.lit(0).cast("bigint"), q - 1), lambda j: F.struct(release(j, q, slots).alias("at"), ((deadline(j, q, slots) * (1 << BITS) + i) * (1 << BITS) + j).alias("part")))
    jobs = F.array(F.flatten(F.transform(qs, one)))  # bound to a name, so that it is worked out once
    of = lambda all_: F.transform(F.sequence(F.lit(0).cast("bigint"), slots - 1), lambda t: F.transform(F.filter(all_, lambda x: x["at"] == t), lambda x: x["part"]))
    return F.transform(jobs, of)[0]


def earliest_deadlines(news: Column) -> Column:
    """An array with one struct (i, nth) for each slot: the nth part of the i-th source is taken there.

    ``news`` are the packed parts that each slot releases. Waiting parts are a sorted list, sorted anew only when some come.
    """

    def step(state: Column, new: Column) -> Column:
        waiting = F.when(F.size(new) == 0, state["waiting"]).otherwise(F.sort_array(F.concat(state["waiting"], new)))
        take = lambda w: F.struct(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("waiting"), F.array_append(state["order"], F.get(w, F.lit(0))).alias("order"))
        return F.transform(F.array(waiting), take)[0]

    none = F.array().cast("array<bigint>")
    order = F.aggregate(news, F.struct(none.alias("waiting"), none.alias("order")), step)["order"]
    number = lambda x, bits: F.shiftright(x, bits).bitwiseAND(F.lit((1 << BITS) - 1))
    return F.transform(order, lambda x: F.struct(number(x, BITS).cast("int").alias("i"), number(x, 0).alias("nth")))


def schedule(totals: DataFrame, periods_per_task: int = 64) -> DataFrame:
    """(key, part, release, deadline, slot, within_target) for each part of each source."""
    plan = written(in_order(totals), "mix-sources")
    found = plan.select(F.ceil(F.col("slots") / SLOTS)).first()
    n = found[0] if found else 0
    tasks = max(n // periods_per_task, min(n, 4 * plan.sparkSession.sparkContext.defaultParallelism), 1)
    periods = plan.sparkSession.range(0, n, 1, tasks)
    ends = plan.select(F.explode(F.filter("sources", lambda x: x["cut"])["until"]).alias("at")).groupBy(F.floor(F.col("at") / SLOTS).alias("id")).agg(F.collect_set("at").alias("ends"))
    rows = periods.join(small(written(ends, "mix-ends")), "id", "left").crossJoin(F.broadcast(plan))  # one row of sources
    begin, none = F.col("id") * SLOTS, F.array().cast("array<bigint>")
    marks = F.array_union(F.array(begin, F.least(begin + SLOTS, "slots")), F.filter(F.coalesce("ends", none), lambda x: x < F.col("slots")))
    rows = rows.withColumn("marks", F.sort_array(marks))
    spans = F.transform(F.sequence(F.lit(1), F.size("marks") - 1), lambda i: F.struct(F.get("marks", i - 1).alias("begin"), (F.get("marks", i) - F.get("marks", i - 1)).alias("n")))
    rows = rows.select(F.explode(spans).alias("span"), F.col("chunks").alias("sources"), "horizon").select("span.begin", "span.n", "sources", "horizon")
    rows = rows.withColumn("key", F.flatten(F.transform("sources", lambda c: c["key"])))
    shares = rows.select("begin", "n", "horizon", "key", F.expr(SHARES.format(at="begin")).alias("before"), F.expr(SHARES.format(at="begin + n")).alias("upto"))
    # Written between the steps, so that no array is worked out again for each of its elements.
    q = lambda i: F.get("upto", i) - F.get("before", i)
    each = F.transform("key", lambda k, i: F.struct(k.alias("key"), F.get("before", i).alias("before"), q(i).alias("q")))
    rows = written(shares, "mix-shares").select("begin", "n", "horizon", F.array_sort(F.filter(each, lambda x: x["q"] > 0)).alias("active"))
    rows = written(rows, "mix-periods").withColumn("news", released(F.col("active.q"), F.col("n")))
    rows = written(rows, "mix-parts").withColumn("order", earliest_deadlines(F.col("news")))
    rows = rows.select("begin", "n", "horizon", "active", F.posexplode("order").alias("t", "taken"))
    rows = rows.withColumns({"source": F.get("active", F.col("taken.i")), "nth": F.col("taken.nth"), "slot": F.col("begin") + F.col("t")})
    return rows.select(
        F.col("source.key").alias("key"),
        (F.col("source.before") + F.col("nth")).alias("part"),
        (F.col("begin") + release(F.col("nth"), F.col("source.q"), F.col("n"))).alias("release"),
        (F.col("begin") + deadline(F.col("nth"), F.col("source.q"), F.col("n"))).alias("deadline"),
        "slot",
        (F.col("slot") < F.col("horizon")).alias("within_target"),
    )


def mix(df: DataFrame, weights: dict[str, float] | None = None, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Add ``block`` and ``part`` (in the source), ``release``, ``deadline``, ``slot``, ``position`` and ``within_target``.

    ``weights`` maps sources to relative weights; sources it doesn't name get the smallest of them. Without weights,
    a source's weight is its number of documents to the power ``TEMPERATURE``. Only ``doc_id`` and ``source`` decide.
    """
    inner = {"source": source, "id": doc_id}
    rows = packed(df, inner, NEW).withColumn("key", _source_key("source")).withColumn("hash", F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = rows.withColumn("bucket", F.substring("hash", 1, BUCKET_HEX))
    sizes = written(rows.groupBy("key", "bucket").agg(F.count("*").alias("n")), "mix-sizes")
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sizes.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "mix-offsets")
    totals = sizes.groupBy("key").agg(F.sum("n").alias("n"))
    if weights is None:
        weighed = totals.withColumn("weight", F.pow("n", F.lit(TEMPERATURE)))
    else:
        given = F.coalesce(*[F.when(F.col("key") == "1" + k, float(v)) for k, v in sorted(weights.items())], F.lit(float(min(weights.values()))))
        weighed = totals.withColumn("weight", given)
    plan = written(schedule(weighed), "mix-schedule")
    rank = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("hash", "id")) - 1
    placed = rows.withColumn("rank", rank).join(small(offsets), ["key", "bucket"]).withColumn("at", F.col("offset") + F.col("rank"))
    placed = placed.withColumns({"part": F.floor(F.col("at") / PART_ROWS), "block": F.floor(F.col("at") / BLOCK_ROWS)}).join(plan, ["key", "part"])
    placed = placed.withColumn("position", F.col("slot") * PART_ROWS + F.col("at") % PART_ROWS)
    return unpacked(placed, df, inner, NEW)
