"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the ``K`` smallest distinct 64-bit hashes of a text's five-word shingles. Sketches of
parts merge into the sketch of the whole, and estimate resemblance, containment and the number of distinct shingles.
A text of one to four words has its whole word sequence as its one shingle; a null text or one without words has an
empty sketch. Two empty sketches have resemblance 1, an empty and another one 0. Equal texts have equal sketches. Texts of
any length count whole. Repeated rows have equal sketches each. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubespark.functions.values import count_upto

from .common import SPACE, packed, unpacked, written

K, WORDS = 256, 5
_ENDS = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles, repeats included."""

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[w[i + j] for j in range(words)]))
        return F.when(F.size(w) >= words, many).otherwise(F.array(F.xxhash64(w)))

    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(_ENDS))
    none = F.array().cast("array<bigint>")
    return _let(trimmed, lambda t: F.when(t == "", none).otherwise(_let(F.split(t, SPACE), hashes)))


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together, from the sketches of either."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts; the key may have any number of parts.

    Hashes are spread over 64 sub-groups before the last step, so that a key with very many parts is no single task.
    """
    def least(frame: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("hash")
        return frame.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).drop("at")

    rows = df.select(key, F.explode_outer(column).alias("hash")).distinct()
    rows = least(rows.withColumn("salt", F.pmod("hash", F.lit(64))), [key, "salt"])
    out = least(rows.select(key, "hash"), [key]).groupBy(key)
    return out.agg(F.sort_array(F.collect_list("hash")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets; exact where both have fewer than k shingles."""

    def shared(u: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(a, b), u))
        return F.when(F.size(u) == 0, 1.0).otherwise(both / F.size(u))

    return _let(merged(a, b, k), shared)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.concat_ws(",", a.cast("array<string>"))


def with_next(df: DataFrame, id_col: str, text: str, extra: dict[str, Column]) -> DataFrame:
    """Add ``next_text`` (of the next row by id; of the first after the last) and the columns of ``extra``.

    ``extra`` maps names to functions of the text; each gives two columns, its own and ``next_<name>``. Rows are dealt
    into ranges of ids of like size, each a window of its own, and the first row of each range is handed to the one
    before: no window spans the table. Ids have any type that sorts; null ids come first, rows of equal ids are ordered by
    text. Columns named like a new one are replaced, all others pass through.
    """
    spark = df.sparkSession
    inner, new = {"id": id_col, "text": text}, ("next_text", *[c for k in extra for c in (k, f"next_{k}")])
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(F.col(id_col).alias("id"))
    # The smallest ids of n ranges: one array of at most n elements, in which each row finds its range by bisection.
    least = ids.repartitionByRange(n, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("least"))
    bounds = written(least.filter(F.col("least").isNotNull()).agg(F.sort_array(F.collect_set("least")).alias("bounds")), "bounds")
    dealt = lambda rows: rows.crossJoin(F.broadcast(bounds)).withColumn("at", F.greatest(F.lit(0), count_upto(F.col("bounds"), F.col("id")) - 1)).drop("bounds")
    firsts = dealt(ids).groupBy("at").agg(F.min(F.struct("id")).alias("f"))
    order = Window.orderBy("at")  # one row for each range
    first = F.first("f").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ring = written(firsts.select("at", F.coalesce(F.lead("f").over(order), first)["id"].alias("first_id")), "ranges")
    heads = df.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(ring), F.col("id").eqNullSafe(F.col("first_id")))
    heads = heads.groupBy("at").agg(F.min("text").alias("head_text"))
    heads = heads.select("*", *[f(F.col("head_text")).alias(f"head_{k}") for k, f in extra.items()])
    base = dealt(packed(df, inner, new).withColumn("text", F.coalesce("text", F.lit("")))).repartition(n // 4, "at")
    rows = base.select("*", *[f(F.col("text")).alias(f"own_{k}") for k, f in extra.items()])
    w = Window.partitionBy("at").orderBy("id", "text")
    led = rows.select("*", F.lead("text").over(w).alias("lead_text"), *[F.lead(f"own_{k}").over(w).alias(f"lead_{k}") for k in extra])
    out = led.join(heads, "at", "left").withColumns({f"next_{k}": F.coalesce(f"lead_{k}", f"head_{k}") for k in ("text", *extra)})
    return unpacked(out.withColumnsRenamed({f"own_{k}": k for k in extra}), df, inner, new)
