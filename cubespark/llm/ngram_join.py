"""Exact Jaccard self-join of documents on word n-grams, by prefixes under several global orders.

Sets of n shingles with a similarity of at least t share a shingle among the first n - ceil(t n) + 1 of both, under any
total order of all shingles. Three orders are used. The first is by rarity: ``SLOTS`` counters hold how many shingles of
all documents fall into each slot of the hash; slots are ranked by count, so what is common in the corpus comes last (any
order is right, so counters may mix rare shingles). The other two are hash orders of their own. The first order's prefixes
propose candidates: they are dealt by ranges of their values, packed, and what stands in one set only stays in its range.
Before texts move, a bitmap of each full set, about a bit for each shingle, rules pairs out: a bit is the parity of the
shingles that fall on it, so the bits in which two sets differ are at most as many as the shingles that only one of them has.
Texts are fetched for what is left alone. Such a candidate must share prefix shingles under both other orders too, then full
sets decide.

No group is expanded into pairs. Equal sets are one class first. In each bucket (a prefix shingle) members are compared with
the first document there, and links give components. Only buckets that still hold several components go on: small ones
compare members of different components; in large ones what is outside the main component meets all members, block by
block: bitmaps, then the other orders pick the rows that can have a link, and the full sets of these are compared by
products of incidence matrices, which yield one link for each row and component. So every pair that shares a prefix shingle
is ruled out by sizes or filters, compared in full, or already joined by confirmed links: no link is lost.

A null text, or one without words, has no shingles and is linked with nothing. A text with fewer words than a shingle has
its whole sequence as its only shingle. Texts of any length count whole. Ids have any type that sorts; rows of equal id
count as one document, rows of null id are linked with nothing (null component). ``component_id`` is the smallest id of a
component. Columns other than id and text aren't read, so their names don't matter. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, hot_keys, no_collection, per_worker, salted_join, slices, small, with_python_columns, written
from .neardup import IN_BLOCK, WordHashes, components, in_blocks, linked, mixed, named, same_id, shingle_set, shingles, with_both

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOT_BITS, SALTS = 18, (0x9E6C63D0876A9A47, 0x3C79AC492BA7B653)
#: Members of a bucket that are compared pair by pair; beyond, in blocks of BLOCK.
SMALL, BLOCK = 32, 256
#: Shingles that stand as columns of an incidence matrix at a time.
COLUMNS = 8192
#: Prefix shingles of a range, about, and those that a task packs at a time; low bits of a number that a packed shingle carries.
RANGE, PACKED, LOW = 250_000, 2_000_000, 15
#: Bitmaps of 2^LOW numbers that are broadcast.
BITMAPS = 16_384


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def first(keys: np.ndarray, k: int) -> np.ndarray:
    return np.sort(np.partition(keys, k - 1)[:k] if k < len(keys) else keys)


def parities(s: np.ndarray) -> np.ndarray:
    """The bitmap of a set as 64-bit words: a power of two of bits, at least one for each shingle, each the parity of those that fall on it."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((mixed(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def may_link(percent: int) -> Column:
    """Whether sets (n_shingles_a, bits_a) and (n_shingles_b, bits_b) may be linked by their bitmaps; never false for linked ones."""
    size = F.least(F.size("bits_a"), F.size("bits_b"))
    # The longer bitmap, folded once, is that of the shorter size.
    half = lambda c: F.when(F.size(c) == size, F.col(c)).otherwise(F.zip_with(F.slice(c, F.lit(1), size), F.slice(c, size + 1, size), lambda x, y: x.bitwiseXOR(y)))
    differ = F.aggregate(F.zip_with(half("bits_a"), half("bits_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda x, y: x + y)
    unlike = differ * (100 + percent) > (F.col("n_shingles_a") + F.col("n_shingles_b")) * (100 - percent)
    return (F.greatest(F.size("bits_a"), F.size("bits_b")) > 2 * size) | ~unlike


def slot_counts(df: DataFrame, words: int) -> np.ndarray:
    """How many shingles of all texts fall into each slot of the hash: an array of fixed size, added up by Spark."""

    def run(batches):
        with no_collection():
            hashes, counts = per_worker(WordHashes), np.zeros(1 << SLOT_BITS, np.int64)
            for batch in batches:
                for part in slices(batch, ["text"]):
                    found = [shingles(t, words, hashes) for t in part.column("text").to_pylist()]
                    if found:
                        at = (np.concatenate(found) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                        counts += np.bincount(at, minlength=1 << SLOT_BITS)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["slot", "n"])

    total = np.zeros(1 << SLOT_BITS, np.int64)
    summed = df.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    rows = written(summed, "slots").toArrow()  # at most 2^SLOT_BITS rows
    total[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return total


def prefixes(df: DataFrame, words: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Add ``n_shingles``, ``digest`` and bitmap (``bits``) of the set, and its first shingles by rarity (``one``)."""
    rank = np.zeros(1 << SLOT_BITS, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(1 << SLOT_BITS, dtype=np.uint64)
    ranks = df.sparkSession.sparkContext.broadcast(rank.astype(np.uint32))

    def make():
        hashes, rank, low = per_worker(WordHashes), ranks.value, np.uint64((1 << (64 - SLOT_BITS)) - 1)

        def one(text):
            s = shingle_set(text, words, hashes)
            if not len(s):
                return 0, None, None, None
            k = prefix_length(len(s), percent)
            # A bijection of the hash: the rank of its slot, then the rest.
            rare = (rank[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(64 - SLOT_BITS)) | (s & low)
            return len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), parities(s), first(rare, k).view(np.int64)

        return lambda texts: zip(*map(one, texts), strict=True)

    kinds = {"n_shingles": "bigint", "digest": "binary", "bits": "array<bigint>", "one": "array<bigint>"}
    return with_python_columns(df, ["text"], kinds, make)


def other_orders(s: np.ndarray, percent: int) -> list[np.ndarray]:
    """The first shingles of a set by both hash orders."""
    k = prefix_length(len(s), percent)
    return [(first(mixed(s ^ np.uint64(salt)), k) >> np.uint64(33)).astype(np.int32) for salt in SALTS]


def _only(sk: DataFrame, cids: DataFrame) -> Callable[[np.ndarray], np.ndarray] | None:
    """Which numbers of equal high bits are among ``cids``, by bitmaps that each task has; None where these are too many."""
    maps = written(cids.groupBy(F.shiftright("cid", LOW).alias("high")).agg(F.bitmap_construct_agg(F.col("cid").bitwiseAND(F.lit((1 << LOW) - 1))).alias("bits")), "kept")
    if maps.count() > BITMAPS:
        return None
    rows = maps.toArrow()  # a bit for each document
    held = sk.sparkSession.sparkContext.broadcast(dict(zip(rows.column("high").to_pylist(), rows.column("bits").to_pylist(), strict=True)))

    def among(cid: np.ndarray) -> np.ndarray:
        bits = held.value.get(int(cid[0]) >> LOW)
        if bits is None:
            return np.zeros(len(cid), bool)
        return np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[cid & ((1 << LOW) - 1)] == 1

    return among


def _members(sk: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(token, cid, m): the prefix shingles by rarity that stand in m > 1 of the distinct sets, and in which.

    Hardly any does, so all of them move packed, 10 bytes each: a row holds those of a range of values, spread by a bijection,
    and of documents whose numbers differ in their low bits only. A range is put in order in one task.
    """
    k = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    total = sk.filter("n_shingles > 0").agg(F.sum(k)).first()[0] or 0
    shift = np.uint64(64 - max(1, (int(total) // RANGE).bit_length()))
    some, among = sk.filter("n_shingles > 0").select("cid", "one"), _only(sk, reps.select("cid"))
    if among is None:
        some = some.join(small(reps.select("cid")), "cid", "left_semi")

    def packed(high: int, held: list) -> pa.RecordBatch:
        low, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
        tokens = mixed(tokens)
        order = np.argsort(tokens)
        low, tokens = low[order], tokens[order]
        ranges, at = np.unique(tokens >> shift, return_index=True)
        ends = [*at[1:].tolist(), len(tokens)]
        blobs = ([x[i:j].tobytes() for i, j in zip(at.tolist(), ends, strict=True)] for x in (tokens, low))
        return pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int64)), pa.array(np.full(len(ranges), high)), *[pa.array(b, pa.binary()) for b in blobs]], names=["range", "high", "tokens", "low"])

    def deal(batches):
        high, held, n = None, [], 0
        for batch in batches:
            numbers, lists = batch.column("cid").to_numpy(), batch.column("one")
            values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            highs = numbers >> LOW
            cuts = [0, *(np.flatnonzero(np.diff(highs)) + 1).tolist(), len(numbers)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if held and (highs[i] != high or n >= PACKED):
                    yield packed(high, held)
                    held, n = [], 0
                high, cid = int(highs[i]), numbers[i:j]
                fine = among(cid) if among else np.ones(len(cid), bool)
                sizes, tokens = np.diff(offsets[i : j + 1]), values[offsets[i] : offsets[j]]
                tokens = tokens[np.repeat(fine, sizes)]
                if len(tokens):
                    low = (cid[fine] & ((1 << LOW) - 1)).astype(np.uint16)
                    held.append((np.repeat(low, sizes[fine]), tokens))
                    n += len(tokens)
        if held:
            yield packed(high, held)
        pa.default_memory_pool().release_unused()

    def shared_ones(table: pa.Table) -> pa.Table:
        blobs = table.column("tokens").to_pylist()
        tokens = np.frombuffer(b"".join(blobs), np.uint64)
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint16)
        cid = np.repeat(table.column("high").to_numpy() << LOW, [len(b) // 8 for b in blobs]) | low
        order = np.argsort(tokens)
        tokens, cid = tokens[order], cid[order]
        at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        m = np.diff(np.append(at, len(tokens)))
        m = np.repeat(m, m)
        fine = m > 1
        return pa.table({"token": pa.array(tokens[fine].view(np.int64)), "cid": pa.array(cid[fine]), "m": pa.array(m[fine])})

    dealt = some.mapInArrow(deal, "range bigint, high bigint, tokens binary, low binary")
    return written(dealt.groupBy("range").applyInArrow(shared_ones, "token bigint, cid bigint, m bigint"), "members")


def _classes(sk: DataFrame) -> DataFrame:
    """One narrow row for each distinct set: its number ``cid``, digest, number of documents, smallest id and a row with its text."""
    some = sk.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    first = some.groupBy("digest").agg(F.min(F.struct("id", "mark", "cid")).alias("at"), F.count("*").alias("n"))
    return written(first.select("at.cid", "digest", "n", "at.id", "at.mark"), "classes")


def _checked(pairs: DataFrame, wide: DataFrame, texts_of: Callable[[DataFrame], DataFrame], words: int, percent: int) -> DataFrame:
    """Those of the written, distinct pairs (a, b) that are linked: sizes and bitmaps, then both other orders, then full sets."""

    def orders():
        hashes = per_worker(WordHashes)
        return lambda texts: zip(*(other_orders(shingle_set(t, words, hashes), percent) for t in texts), strict=True) if texts else ([], [])

    side = lambda df, *some: lambda x: df.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in some])
    sized = with_both(pairs, side(wide, "n_shingles", "bits")).filter(100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b"))
    able = written(sized.filter(may_link(percent)).select("a", "b"), "able")
    texts = written(with_python_columns(texts_of(able.select(F.col("a").alias("cid")).union(able.select("b"))), ["text"], {"two": "array<int>", "three": "array<int>"}, orders), "texts")
    both = with_both(able, side(texts, "two", "three"))
    likely = written(both.filter(F.arrays_overlap("two_a", "two_b") & F.arrays_overlap("three_a", "three_b")).select("a", "b"), "likely")
    full = with_both(likely, lambda x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"t{x}")))

    def confirm():
        hashes = per_worker(WordHashes)

        def run(ta, tb):
            return [[linked(shingle_set(x, words, hashes), shingle_set(y, words, hashes), percent) for x, y in zip(ta, tb, strict=True)]]

        return run

    return with_python_columns(full, ["ta", "tb"], {"same": "boolean"}, confirm).filter("same").select("a", "b")


def shared(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of distinct-element arrays has in common: products of incidence matrices, a range of columns at a time."""
    out = np.zeros((len(rows), len(others)), np.float32)
    x, y = np.concatenate(rows), np.concatenate(others)
    xr, yr = (np.repeat(np.arange(len(s)), list(map(len, s))) for s in (rows, others))
    common = np.intersect1d(x, y)
    for at in range(0, len(common), COLUMNS):
        some = common[at : at + COLUMNS]
        sides = []
        for values, who, n in ((x, xr, len(rows)), (y, yr, len(others))):
            place = np.minimum(np.searchsorted(some, values), len(some) - 1)
            hit = some[place] == values
            m = np.zeros((n, len(some)), np.float32)
            m[who[hit], place[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _near_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum.outer(a, b) >= percent * np.maximum.outer(a, b)


def _differ(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many bits a bitmap differs from each of others that are of one length; the longer is folded, see ``may_link``."""
    while others.shape[1] > len(one):
        others = others[:, : others.shape[1] // 2] ^ others[:, others.shape[1] // 2 :]
    while len(one) > others.shape[1]:
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    return np.bitwise_count((others ^ one).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _may_link(bits: list[np.ndarray], size: np.ndarray, out: np.ndarray, many: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``out`` and ``many`` may be linked by their bitmaps."""
    length = np.array([len(bits[i]) for i in many])
    fine = np.zeros((len(out), len(many)), bool)
    for some in (np.flatnonzero(length == x) for x in np.unique(length)):
        others = np.stack([bits[i] for i in many[some]])
        for row, i in enumerate(out):
            fine[row, some] = _differ(bits[i], others) * (100 + percent) <= (size[i] + size[many[some]]) * (100 - percent)
    return fine


def _blocks(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """Blocks of large buckets with sizes and bitmaps."""
    blocks = written(in_blocks(rows, BLOCK), "blocks")
    return salted_join(blocks, wide, "cid", "y", hot_keys(blocks, "cid"))


def _block_links(blocks: DataFrame, texts_of: Callable[[DataFrame], DataFrame], words: int, percent: int) -> DataFrame:
    """Links (a, b) in blocks: at least one between a stray and each other component that it has a link to there."""
    kept = [*IN_BLOCK, "cid", "comp", "stray"]

    def able(table: pa.Table) -> pa.Table:
        stray, comp, size = (np.array(table.column(c).to_pylist()) for c in ("stray", "comp", "n_shingles"))
        out, many = np.flatnonzero(stray), np.flatnonzero(~stray)
        if not len(out) or not len(many):
            return table.select(kept).slice(0, 0)
        fine = _near_sizes(size[out], size[many], percent) & (comp[out][:, None] != comp[many][None, :])
        fine &= _may_link([v.values.to_numpy() for v in table.column("bits")], size, out, many, percent)
        rows = np.union1d(out[fine.any(axis=1)], many[fine.any(axis=0)])
        return table.select(kept).take(pa.array(rows))

    kinds = "pooled boolean, key bigint, x bigint, y bigint, cid bigint, comp bigint, stray boolean"
    rows = written(blocks.groupBy(*IN_BLOCK).applyInArrow(able, kinds), "able")
    texts = written(texts_of(rows.select("cid")), "texts")
    full = salted_join(rows, texts, "cid", "y", hot_keys(rows, "cid"))

    def run(table: pa.Table) -> pa.Table:
        hashes = per_worker(WordHashes)
        cid, comp, stray = (np.array(table.column(c).to_pylist()) for c in ("cid", "comp", "stray"))
        sets = [shingle_set(t.as_py(), words, hashes) for t in table.column("text")]
        size = np.array([len(s) for s in sets])
        out, many = np.flatnonzero(stray), np.flatnonzero(~stray)
        pairs = np.zeros((0, 2), np.int64)
        if len(out) and len(many):
            fine = np.ones((len(out), len(many)), bool)
            for lists in zip(*(other_orders(s, percent) for s in sets), strict=True):
                lists = list(map(np.unique, lists))
                fine &= shared([lists[i] for i in out], [lists[i] for i in many]) > 0
            out, many = out[fine.any(axis=1)], many[fine.any(axis=0)]
        if len(out) and len(many):
            both = shared([sets[i] for i in out], [sets[i] for i in many]).astype(np.int64)
            link = (100 * both >= percent * (size[out][:, None] + size[many][None, :] - both)) & (comp[out][:, None] != comp[many][None, :])
            i, j = np.nonzero(link)
            _, one = np.unique(np.stack([cid[out[i]], comp[many[j]]]), axis=1, return_index=True) if len(i) else (None, [])
            pairs = np.sort(np.stack([cid[out[i[one]]], cid[many[j[one]]]], axis=1), axis=1) if len(i) else pairs
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return full.groupBy(*IN_BLOCK).applyInArrow(run, "a bigint, b bigint").distinct()


def jaccard_components(df: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; kept marks the smallest id of each component."""
    slim = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    sk = written(prefixes(slim, words, percent, slot_counts(slim, words)).drop("text").withColumn("cid", F.monotonically_increasing_id()), "prefixes")
    reps = _classes(sk)
    multi = _members(sk, reps, percent)
    hot = small(written(multi.filter(F.col("m") > HOT_ROWS).select("token", F.ceil(F.col("m") / HOT_ROWS).alias("_parts")).distinct(), "hot"))
    # The first document of a bucket: copies are more like what they were made from than like each other.
    centres = written(multi.join(small(reps.select("cid", "id")), "cid").groupBy("token").agg(F.min_by("cid", "id").alias("centre")), "centres")
    multi = written(salted_join(multi, centres, "token", "cid", hot), "buckets")
    found = written(multi.select("cid").distinct().join(reps.select("cid", "id", "mark"), "cid"), "candidates")
    wide = written(sk.select("cid", "n_shingles", "bits").join(small(found.select("cid")), "cid", "left_semi"), "bitmaps")
    ids = sk.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    repeated = written(ids.filter("n > 1"), "repeated")
    unique = repeated.isEmpty()

    def texts_of(cids: DataFrame) -> DataFrame:
        """(cid, text) of these candidates, each once."""
        keys = written(found.join(small(written(cids.distinct(), "wanted")), "cid", "left_semi"), "wanted")
        texts = slim.join(small(keys), ["id", "mark"]).select("cid", "text")
        return texts if unique else texts.groupBy("cid").agg(F.min("text").alias("text"))

    pairs = multi.filter("cid <> centre").select(F.least("centre", "cid").alias("a"), F.greatest("centre", "cid").alias("b"))
    tried = written(pairs.distinct(), "pairs")
    links = written(_checked(tried, wide, texts_of, words, percent).union(same_id(sk, reps, repeated)), "links")
    labels = components(links)
    # Buckets of several components.
    at = multi.select("token", "m", "cid").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    at = written(at, "named-buckets")
    split = at.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("token")
    opened = written(salted_join(at, split, "token", "cid", hot), "open")
    sized = opened.filter(F.col("m") <= SMALL).join(wide.select("cid", "n_shingles"), "cid")
    one, two = (sized.select("token", F.col("cid").alias(x), F.col("comp").alias(f"c{x}"), F.col("n_shingles").alias(f"n{x}")) for x in "ab")
    near = one.join(two, "token").filter(f"a < b AND ca <> cb AND 100 * least(na, nb) >= {percent} * greatest(na, nb)")
    near = written(near.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    more = _checked(near, wide, texts_of, words, percent)
    large = opened.filter(F.col("m") > SMALL).withColumnRenamed("token", "key")
    if not large.isEmpty():
        more = more.union(_block_links(_blocks(large, wide), texts_of, words, percent))
    more = written(more.distinct(), "links")
    return named(sk, reps, labels if more.isEmpty() else components(links.union(more)))
