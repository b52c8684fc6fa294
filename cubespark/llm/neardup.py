"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

Each document's distinct shingle hashes fall into ``BUCKETS`` buckets by their leading bits. A bucket keeps, of its
smallest hash, the number of leading zeros and ten mantissa bits: two bytes. An empty bucket borrows the register of the
first filled one in an order of its own. ``BANDS`` bands of ``ROWS`` registers propose candidates (a pair of similarity
0.8 escapes all of them with a chance of 3e-6); a Jaccard estimate from the registers, corrected for chance collisions
of registers, drops those that are clearly below; the rest are compared on their full shingle sets.

No group is expanded into pairs. Equal sets are one class first, which has a number and one text. In each band bucket the
members are compared with one centre, and links give components. Only buckets that still hold several components go on:
small ones compare members of different components; in large ones what is outside the main component meets all members,
block by block, by registers. First each stray is compared with its likeliest partner; then, in buckets
that are still open, the texts of rows that can have a link at all meet in their block, until one link joins two
components there. So every candidate pair is either ruled out by its sizes or
registers, compared in full, or already joined by confirmed links.

A null text, or one without words, has no shingles and is linked with nothing. A text with fewer words than a shingle
has its whole sequence as its only shingle. Texts of any length count whole. ``doc_id`` has any type that sorts; rows of
equal id count as one document whether or not their texts are equal (but one without words stays alone), rows of null id are linked with nothing (null
component, not kept). ``component_id`` is the smallest id of a component; no other tie can arise. Columns other than id
and text aren't read, so their names don't matter. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, hot_keys, per_task, salted_join, small, with_python_columns, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS, BANDS, ROWS, MANTISSA = 256, 42, 6, 10
#: Standard errors below the limit at which an estimate rules a pair out.
MARGIN = 5.0
#: Members of a band bucket that are compared pair by pair; beyond, in blocks of BLOCK.
SMALL, BLOCK = 32, 256
#: Hashes of words of up to 64 bytes that a task remembers.
MEMORY, MEMORY_LENGTH = 250_000, 64


class WordHashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < MEMORY and len(word) <= MEMORY_LENGTH:
            self[word] = value
        return value


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int, hashes: dict) -> np.ndarray:
    """Hashes of the shingles of a whole text, A-Z lower-cased, in their order."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < words:
        return mixed(np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed=len(tokens))], np.uint64))
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = len(h) - words + 1
    out = h[:n].copy()
    for j in range(1, words):
        out = mixed(out) + h[j : j + n]
    return mixed(out)


def shingle_set(text: str | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    return np.unique(shingles(text, words, hashes))


class Sketcher:
    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        self.starts = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56)
        self.probes = np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])
        self.odd = rng.integers(1, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(1, 1 << 62, BANDS, dtype=np.uint64)

    def registers(self, s: np.ndarray) -> np.ndarray:
        """Registers of a non-empty sorted hash set."""
        at = np.searchsorted(s, self.starts)
        least = s[np.minimum(at, len(s) - 1)]
        full = (at < len(s)) & (least >> np.uint64(56) == np.arange(BUCKETS, dtype=np.uint64))
        part, power = np.frexp(((least << np.uint64(8)) >> np.uint64(11)).astype(np.float64))
        zeros = np.where(part > 0, 53 - power, 53)
        mantissa = np.where(part > 0, (2 * part - 1) * (1 << MANTISSA), 0)
        regs = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
        empty = np.flatnonzero(~full)
        if len(empty):
            order = self.probes[empty]
            regs[empty] = regs[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
        return regs

    def bands(self, regs: np.ndarray) -> np.ndarray:
        rows = regs[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        return mixed(mixed((rows * self.odd).sum(axis=1, dtype=np.uint64)) + self.salt).view(np.int64)


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that the registers of unrelated minima agree, for sets of a and b hashes."""
    i = np.arange(54)
    at = lambda n: np.exp(-np.outer(n / BUCKETS, 0.5 ** (i + 1))) - np.exp(-np.outer(n / BUCKETS, 0.5**i))
    return (at(a) * at(b)).sum(axis=1) / (1 << MANTISSA)


def may_link(share: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """From the share of equal registers and set sizes: whether the similarity may reach percent / 100."""
    c = chance(a, b)
    estimate = (share - c) / (1 - c)
    limit = percent / 100
    filled = BUCKETS * -np.expm1(-np.maximum(a, b) / BUCKETS)
    return estimate >= limit - MARGIN * np.sqrt(limit * (1 - limit) / np.maximum(filled, 1))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(df: DataFrame, words: int, text: str = "text") -> DataFrame:
    """Add ``n_shingles``, ``digest`` of the set, ``bands`` and ``regs`` (null where there are no shingles)."""

    def make():
        hashes, sketcher = per_task(WordHashes), Sketcher()

        def one(t):
            s = shingle_set(t, words, hashes)
            if not len(s):
                return 0, None, None, None
            regs = sketcher.registers(s)
            return len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketcher.bands(regs), regs.tobytes()

        return lambda texts: zip(*map(one, texts), strict=True)

    kinds = {"n_shingles": "bigint", "digest": "binary", "bands": "array<bigint>", "regs": "binary"}
    return with_python_columns(df, [text], kinds, make)


def components(links: DataFrame) -> DataFrame:
    """(cid, comp): the smallest number that each linked class reaches; least labels with pointer jumping."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    hubs = hot_keys(edges, "b")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = salted_join(edges, labels.withColumnRenamed("v", "b"), "b", "a", hubs).groupBy("a").agg(F.min("l").alias("m"))
        moved = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jumps = labels.select(F.col("v").alias("l"), F.col("l").alias("to"))
        moved = written(moved, "moved")
        moved = written(salted_join(moved, jumps, "l", "v", hot_keys(moved, "l")).select("v", "old", F.least("l", "to").alias("l")), "labels")
        labels = moved.select("v", "l")
        if moved.filter("old <> l").isEmpty():
            return labels.select(F.col("v").alias("cid"), F.col("l").alias("comp"))


def _likely(rows: DataFrame, percent: int) -> DataFrame:
    """Rows whose sizes na, nb and registers ra, rb allow a link."""
    rows = rows.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def estimate():
        def run(na, nb, ra, rb):
            if not na:
                return [[]]
            x = np.frombuffer(b"".join(ra), np.uint16).reshape(-1, BUCKETS)
            y = np.frombuffer(b"".join(rb), np.uint16).reshape(-1, BUCKETS)
            return [may_link((x == y).mean(axis=1), np.array(na), np.array(nb), percent)]

        return run

    return with_python_columns(rows, ["na", "nb", "ra", "rb"], {"likely": "boolean"}, estimate).filter("likely").select("a", "b")


def with_both(pairs: DataFrame, side) -> DataFrame:
    """Distinct pairs with the columns of both sides; a class that stands in very many pairs is dealt to several tasks."""
    return salted_join(salted_join(pairs, side("a"), "a", "b", hot_keys(pairs, "a")), side("b"), "b", "a", hot_keys(pairs, "b"))


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the written, distinct pairs (a, b) whose full sets are linked."""

    def confirm():
        hashes = per_task(WordHashes)

        def run(ta, tb):
            return [[linked(shingle_set(x, words, hashes), shingle_set(y, words, hashes), percent) for x, y in zip(ta, tb, strict=True)]]

        return run

    full = with_both(pairs, lambda x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"t{x}")))
    return with_python_columns(full, ["ta", "tb"], {"same": "boolean"}, confirm).filter("same").select("a", "b")


def _checked(pairs: DataFrame, reps: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the written, distinct pairs (a, b) that are linked: sizes, then registers, then full sets."""
    side = lambda x: reps.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    likely = written(_likely(with_both(pairs, side), percent), "likely")
    return _confirmed(likely, texts, words, percent)


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Large buckets cut into blocks: all that is outside the main component of a bucket (``stray``, in parts y) meets all members (in parts x).

    rows: (key, cid, comp) of open buckets, written. Gives (pooled, key, x, y, cid, comp, stray). Buckets with the same
    main component hold much the same members if they are made of one group of near copies. So they are put together in one
    pool, where each stray meets each member once, wherever that is no more work than bucket by bucket. What is known of each
    bucket, and of each pool, is a small table of its own, joined without dealing members out by bucket.
    """
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    known = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("m"), (F.sum("n") - F.max("n")).alias("s"))
    known = written(known, "large-buckets")
    at = written(rows.select("key", "cid", "comp").join(small(known), "key"), "large")
    pools = written(at.select("main", "cid", "comp").distinct(), "pools")
    work = known.groupBy("main").agg(F.sum(F.col("m") * F.col("s")).alias("work"))
    sums = pools.groupBy("main").agg(F.count("*").alias("m"), F.count_if(F.col("comp") != F.col("main")).alias("s"))
    pooled = small(written(sums.join(work, "main").filter("m * s <= work").drop("work"), "pooled"))
    kept = ["key", "cid", "comp", "main", "m", "s"]
    whole = pools.join(pooled, "main").select(F.lit(True).alias("pooled"), F.col("main").alias("key"), *kept[1:])
    alone = at.join(pooled.select("main"), "main", "left_anti").select(F.lit(False).alias("pooled"), *kept)
    parts = {"mb": F.ceil(F.col("m") / block), "sb": F.ceil(F.col("s") / block)}
    both = whole.union(alone).withColumns(parts)
    place = lambda n: F.pmod(F.xxhash64("cid", "key"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    out = lambda df, stray, x, y: df.select("pooled", "key", "cid", "comp", F.lit(stray).alias("stray"), x.alias("x"), y.alias("y"))
    # One generator in each projection.
    members = out(both, False, place("mb"), every("sb"))
    return members.union(out(both.filter("comp <> main"), True, every("mb"), place("sb")))


IN_BLOCK = ["pooled", "key", "x", "y"]


def _blocks(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Blocks of large buckets with sizes and registers."""
    blocks = written(in_blocks(rows, BLOCK), "blocks")
    side = reps.select("cid", "n_shingles", "regs")
    return salted_join(blocks, side, "cid", "y", hot_keys(blocks, "cid"))


def _partners(table: pa.Table, percent: int):
    """For each stray of a block its row, those of members that it may be linked to, and their shares of equal registers."""
    comp, size, stray = (np.array(table.column(c).to_pylist()) for c in ("comp", "n_shingles", "stray"))
    regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
    many = np.flatnonzero(~stray)
    for i in np.flatnonzero(stray):
        share = (regs[many] == regs[i]).mean(axis=1)
        fine = may_link(share, size[many], np.full(len(many), size[i]), percent) & (comp[many] != comp[i])
        fine &= 100 * np.minimum(size[many], size[i]) >= percent * np.maximum(size[many], size[i])
        yield i, many[fine], share[fine]


def _best(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): each stray with its likeliest partner in its block, one row at most for each."""

    def run(table: pa.Table) -> pa.Table:
        cid = np.array(table.column("cid").to_pylist())
        pairs = [(cid[i], cid[found[share.argmax()]]) for i, found, share in _partners(table, percent) if len(found)]
        a, b = np.sort(np.array(pairs, np.int64).reshape(-1, 2), axis=1).T
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.groupBy(*IN_BLOCK).applyInArrow(run, "a bigint, b bigint").distinct()


def _rest(blocks: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) in blocks, one at least between any two components that have some there.

    Registers say which rows of a block can have a link at all; the texts of these meet again in their block.
    """
    kept = [*IN_BLOCK, "cid", "comp", "stray"]

    def able(table: pa.Table) -> pa.Table:
        rows: set[int] = set()
        for i, found, _ in _partners(table, percent):
            if len(found):
                rows |= {int(i), *found.tolist()}
        return table.select(kept).take(pa.array(sorted(rows), pa.int64()))

    kinds = "pooled boolean, key bigint, x bigint, y bigint, cid bigint, comp bigint, stray boolean"
    full = written(blocks.groupBy(*IN_BLOCK).applyInArrow(able, kinds), "able").join(texts, "cid")

    def run(table: pa.Table) -> pa.Table:
        hashes, sketcher = per_task(WordHashes), Sketcher()
        cids, comps = (table.column(c).to_pylist() for c in ("cid", "comp"))
        sets = [shingle_set(t.as_py(), words, hashes) for t in table.column("text")]
        regs = pa.array([sketcher.registers(s).tobytes() for s in sets], pa.binary())
        table = table.append_column("regs", regs).append_column("n_shingles", pa.array(list(map(len, sets)), pa.int64()))
        links = []
        for i, found, _ in _partners(table, percent):
            done = set()
            for k in found.tolist():
                if comps[k] not in done and linked(sets[i], sets[k], percent):
                    done.add(comps[k])
                    links.append((min(cids[i], cids[k]), max(cids[i], cids[k])))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy(*IN_BLOCK).applyInArrow(run, "a bigint, b bigint").distinct()


def classes(sk: DataFrame) -> DataFrame:
    """One row for each distinct set: its number ``cid``, digest, size, bands, registers, smallest id and a row with its text."""
    some = sk.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    first = some.groupBy("digest").agg(F.min_by(F.struct("n_shingles", "bands", "regs"), F.struct("id", "mark")).alias("r"), F.min(F.struct("id", "mark")).alias("at"), F.count("*").alias("n"))
    return written(first.select(F.monotonically_increasing_id().alias("cid"), "digest", "n", "at.id", "at.mark", "r.*"), "classes")


def same_id(sk: DataFrame, reps: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links between classes that share an id: a row of one id with a text of another set."""
    pairs = sk.join(repeated.filter("low <> high").select("id", "low"), "id").filter("digest <> low").select("low", "digest").distinct()
    number = lambda name, digest: reps.select(F.col("cid").alias(name), F.col("digest").alias(digest))
    return pairs.join(number("a", "low"), "low").join(number("b", "digest"), "digest").select("a", "b")


def near_duplicates(
    df: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: kept is the smallest id of each component."""
    slim = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    sk = written(sketches(slim, words).drop("text"), "sketches")
    reps = classes(sk)
    buckets = reps.select("cid", "id", F.explode("bands").alias("band"))
    # The first document of a bucket: copies are more like what they were made from than like each other.
    centres = written(buckets.groupBy("band").agg(F.count("*").alias("m"), F.min_by("cid", "id").alias("centre")).filter("m > 1"), "centres")
    hot = small(written(centres.filter(F.col("m") > HOT_ROWS).select("band", F.ceil(F.col("m") / HOT_ROWS).alias("_parts")), "hot"))
    multi = written(salted_join(buckets.drop("id"), centres, "band", "cid", hot), "buckets")
    found = written(multi.select("cid").distinct().join(reps.select("cid", "id", "mark"), "cid"), "candidates")
    ids = sk.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    repeated = written(ids.filter("n > 1"), "repeated")
    texts = slim.join(small(found), ["id", "mark"]).select("cid", "text")
    texts = written(texts if repeated.isEmpty() else texts.groupBy("cid").agg(F.min("text").alias("text")), "texts")
    pairs = multi.filter("cid <> centre").select(F.least("centre", "cid").alias("a"), F.greatest("centre", "cid").alias("b"))
    tried = written(pairs.distinct(), "pairs")
    links = written(_checked(tried, reps, texts, words, percent).union(same_id(sk, reps, repeated)), "links")
    labels = components(links)

    def still_open(labels: DataFrame) -> DataFrame:
        """(band, cid, comp, m) of buckets that hold several components."""
        named = multi.join(labels, "cid", "left").select("band", "m", "cid", F.coalesce("comp", "cid").alias("comp"))
        named = written(named, "named-buckets")
        split = named.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("band")
        return written(salted_join(named, split, "band", "cid", hot), "open")

    def join_in(links: DataFrame, labels: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
        more = written(more, "links")
        return (links, labels) if more.isEmpty() else (links.union(more), components(links.union(more)))

    opened = still_open(labels)
    if opened.isEmpty():
        return named(sk, reps, labels)
    one, two = (opened.filter(F.col("m") <= SMALL).select("band", F.col("cid").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    pairs = one.join(two, "band").filter("a < b AND ca <> cb").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    more = _checked(written(pairs, "pairs"), reps, texts, words, percent)
    large = opened.filter(F.col("m") > SMALL).withColumnRenamed("band", "key")
    if large.isEmpty():
        return named(sk, reps, join_in(links, labels, more)[1])
    best = written(_best(_blocks(large, reps), percent).join(tried, ["a", "b"], "left_anti"), "best")
    links, labels = join_in(links, labels, more.union(_confirmed(best, texts, words, percent)).distinct())
    large = still_open(labels).filter(F.col("m") > SMALL).withColumnRenamed("band", "key")
    if not large.isEmpty():
        labels = join_in(links, labels, _rest(_blocks(large, reps), texts, words, percent))[1]
    return named(sk, reps, labels)


def named(sk: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """The component of each row, by its smallest id."""
    known = written(reps.select("cid", "digest", "n", "id").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "named")
    least = known.groupBy("comp").agg(F.min("id").alias("component_id"))
    sets = salted_join(known, least, "comp", "cid", hot_keys(known, "comp")).select("digest", "component_id")
    hot = written(reps.filter(F.col("n") > HOT_ROWS).select("digest", F.ceil(F.col("n") / HOT_ROWS).alias("_parts")), "hot")
    done = salted_join(sk.select("id", "n_shingles", "digest"), sets, "digest", "id", None if hot.isEmpty() else small(hot), how="left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return done.select(F.col("id").alias("doc_id"), "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(False)).alias("kept"))
