"""Phrase collocations by direct-address tiling of frequency-ranked ids.

Words of each language are ranked by frequency; the ``WORDS`` most frequent of all get numbers in that order, language by
language. Texts are turned into these numbers once and written so; what follows reads numbers only. Two neighbours are a pair
of ranks. Pairs fall into tiles of ``SIDE`` x ``SIDE`` ranks: a tile that holds many pairs of a buffer (those of frequent
words) is counted in a dense array by bincount, the others together as sorted coordinates. Partial counts are added up by
Spark. Frequent pairs are ranked again, and a pair with the word behind it is a pair of ranks once more: so phrases of three
words (and more, for larger ``longest``) are counted in the same way. A phrase is looked at only if both its parts, without
the last and without the first word, are frequent, as a rarer part can't make a frequent phrase. Tables of ranks have a fixed
size. Frequent words and phrases beyond them are marked in a bit filter of fixed size (two bits each): what it doesn't know is
surely rare. Phrases whose first part has no rank are counted by their words' numbers side by side in one integer (three of 18
bits fit), those with a word that has no number by their text. That is exact too, only slower.

A phrase of k words can be cut after its first 1 to k - 1 words; with a = f(phrase), l and r the counts of both parts, the
score of a cut is floor(10^6 a a / (l r)), in decimals of 38 digits. The cut with the least score counts, the shortest first
part among equals. A candidate goes if a longer candidate, dropped or not, holds its words in a row and has at least
``cover`` percent of its occurrences.

A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends (10 to 13), words at space and tab. A null text is empty, a null
language is ``und``. Texts of any length count whole, repeated rows as often as they stand there; ties in the ranking go by
occurrences, then by the phrase's bytes. Columns other than language and text aren't read, so their names don't matter. An
empty table gives an empty table. Of each language the first ``top`` phrases are reported: they are taken from each of
``PARTS`` parts first, so one task never sees all of a language.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import no_collection, slices, small, written
from .neardup import mixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
LEAST, LONGEST, COVER, TOP = 10, 3, 50, 2000
#: Entries of the tables of ranked words and of ranked phrases of one length, over all languages, and bits of a filter.
WORDS, PHRASES, FILTER_BITS = 1 << 18, 1 << 20, 1 << 27
#: Ranks along a side of a tile, and pairs of a buffer from which a tile is counted densely.
SIDE, DENSE = 1024, 1 << 16
#: Pairs, or different words or phrases, that a task holds before it counts them or hands them on.
BUFFER, TEXTS = 1 << 20, 1 << 17
#: Numbers of words from which a row of them ends at the next break.
ROW = 1024
PARTS, BATCH = 16, 1 << 16
SHIFT = 32
#: Instead of a number: here phrases break (the piece ends, or the word or phrase is rare); it may be frequent, but has no rank.
BREAK, UNRANKED = -1, -2
#: No byte of UTF-8, so no part of a word.
END = b"\xff"
FOLD = bytes(ord(END) if chr(c) in ".,;:!?\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(texts: list[bytes]) -> list[bytes]:
    """The words of whole texts, with END behind each piece."""
    return END.join([*texts, b""]).translate(FOLD).replace(END, b" " + END + b" ").split()


def tiled(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of pairs of ranks: dense arrays for full tiles, sorted coordinates for all others."""
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = int(right.max()) // SIDE + 1
    tile = left // SIDE * width + right // SIDE
    full = np.bincount(tile) >= DENSE
    dense = full[tile]
    pair = (left << SHIFT) | right
    found = []
    for t in np.flatnonzero(full).tolist():
        own = tile == t
        i, j = t // width * SIDE, t % width * SIDE
        cells = np.bincount((left[own] - i) * SIDE + (right[own] - j), minlength=SIDE * SIDE)
        at = np.flatnonzero(cells)
        found.append(((at // SIDE + i << SHIFT) | (at % SIDE + j), cells[at]))
    found.append(np.unique(pair[~dense], return_counts=True))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


class Slots:
    """Rank of each pair: open addressing, a quarter full, all pairs looked up at once."""

    def __init__(self, pairs: np.ndarray) -> None:
        self.pairs = pairs
        self.mask = (1 << max(4, (4 * len(pairs)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, BREAK, np.int32)
        rank = np.arange(len(pairs), dtype=np.int32)
        at = self._first(pairs)
        while len(rank):
            free = self.slots[at] == BREAK
            self.slots[at[free]] = rank[free]
            left = self.slots[at] != rank
            rank, at = rank[left], (at[left] + 1) & self.mask

    def _first(self, pairs: np.ndarray) -> np.ndarray:
        return (mixed(pairs.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """Ranks, BREAK for pairs that have none."""
        at = self._first(pairs)
        out = self.slots[at]
        some = np.flatnonzero(out != BREAK)
        while len(some := some[self.pairs[out[some]] != pairs[some]]):
            at[some] = (at[some] + 1) & self.mask
            out[some] = self.slots[at[some]]
            some = some[out[some] != BREAK]
        return out


@dataclass
class Ranks:
    """Frequent words and phrases by number, at most frequent first (words: of each language in turn).

    ``texts``, ``langs`` and ``hashes`` have words by number. For phrases of two words, three and so on, ``pairs`` has pairs
    (rank one level below << SHIFT | number of the last word) by rank.
    """

    texts: pa.Array
    langs: pa.Array
    hashes: np.ndarray
    pairs: list[np.ndarray] = field(default_factory=list)

    @property
    def bits(self) -> int:
        return max(1, (len(self.texts) - 1).bit_length())

    def packs(self, length: int) -> bool:
        """Do the numbers of this many words fit into one?"""
        return self.bits * length < 63

    def packed(self, words: np.ndarray) -> np.ndarray:
        """One negative number for each row of words."""
        out = np.zeros(len(words), np.int64)
        for column in words.T:
            out = (out << self.bits) | column
        return -1 - out

    def phrases(self, pairs: np.ndarray, length: int) -> tuple[pa.Array, pa.Array]:
        """(languages, texts) of pairs one level above the last, or of packed words."""
        parts = []
        if len(pairs) and pairs[0] < 0:
            pairs = -1 - pairs
            parts = [(pairs >> (self.bits * k)) & ((1 << self.bits) - 1) for k in range(length)]
        else:
            for level in reversed(self.pairs):
                parts.append(pairs & ((1 << SHIFT) - 1))
                pairs = level[pairs >> SHIFT]
            parts += [pairs & ((1 << SHIFT) - 1), pairs >> SHIFT]
        return self.langs.take(pa.array(parts[-1])), pc.binary_join_element_wise(*(self.texts.take(pa.array(p)) for p in reversed(parts)), " ")


def _rows(lang: str | None, pairs: np.ndarray | None, texts: list[str] | None, n: np.ndarray | list[int]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(n), BATCH):
        size = min(BATCH, len(n) - at)
        p = pa.nulls(size, pa.int64()) if pairs is None else pa.array(pairs[at : at + size], pa.int64())
        t = pa.nulls(size, pa.string()) if texts is None else pa.array(texts[at : at + size], pa.string())
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), size), p, t, pa.array(n[at : at + size], pa.int64())], names=["lang", "pair", "phrase", "n"])


SCHEMA = "lang string, pair bigint, phrase string, n bigint"


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Words of all texts that a slice has of a language."""
    for batch in batches:
        for part in slices(batch, ["text"]):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                yield lang, tokens(some)


class Texts:
    """Counts by text, handed on as rows when there are many different ones."""

    def __init__(self) -> None:
        self.counts: dict[str, Counter] = {}
        self.size = 0

    def add(self, lang: str, phrases: list[bytes]) -> Iterator[pa.RecordBatch]:
        one = self.counts.setdefault(lang, Counter())
        self.size -= len(one)
        one.update(phrases)
        self.size += len(one)
        if self.size >= TEXTS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for lang, one in self.counts.items():
            one.pop(END, None)
            yield from _rows(lang, None, [k.decode() for k in one], list(one.values()))
        self.counts, self.size = {}, 0


def word_counts(df: DataFrame) -> DataFrame:
    """(lang, phrase, n) of all words; phrase null: all word occurrences of the language."""

    def run(batches):
        with no_collection():
            held, totals = Texts(), Counter()
            for lang, words in _by_language(batches):
                if n := len(words) - words.count(END):
                    totals[lang] += n
                    yield from held.add(lang, words)
            yield from held.flush()
            for lang, n in totals.items():
                yield from _rows(lang, None, None, [n])

    return df.mapInArrow(run, SCHEMA).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _ranked(rows: DataFrame, size: int, columns: list[str]) -> tuple[pd.DataFrame, DataFrame | None]:
    """These columns of the most frequent rows, as many as fit, and the others (None if there are none).

    Where not all fit, the limit comes from a histogram in steps of a 32nd of a power of two, so that no task sorts all rows.
    """
    rest = None
    if rows.count() > size:
        step = F.floor(F.log2("n") * 32)
        limit, held = 1 << 30, 0
        for s, c in sorted(rows.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect(), reverse=True):  # some 2000 rows at most
            held += c
            if held > size:
                break
            limit = s
        rows, rest = rows.filter(step >= limit), rows.filter(step < limit)
    return rows.select(*columns).toArrow().to_pandas(), rest  # at most ``size`` rows


def _hashes(lang: str, words: Iterable[bytes]) -> np.ndarray:
    begin = lang.encode() + b"\0"
    return np.array([xxhash.xxh64_intdigest(begin + w) for w in words], np.uint64)


def _longer(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases, by those of their first words and of their last word; so ranks play no part in them."""
    return mixed(hashes) + last


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, size = mixed(hashes), np.uint64(FILTER_BITS - 1)
    return (hashes & size).astype(np.int64), ((hashes >> np.uint64(32)) & size).astype(np.int64)


def _hit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = _bits(hashes)
    return ((bits[a >> 6] >> (a & 63).astype(np.uint64)) & (bits[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _filter(rows: DataFrame | None, length: int) -> np.ndarray | None:
    """A bit filter of (lang, phrase) of this many words: FILTER_BITS bits, whatever the number of rows."""
    if rows is None or rows.isEmpty():
        return None

    def run(batches):
        own = np.zeros(FILTER_BITS >> 6, np.uint64)
        for batch in batches:
            words: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                words.setdefault(lang, []).extend(phrase.encode().split(b" "))
            for lang, some in words.items():
                each = _hashes(lang, some).reshape(-1, length)
                hashes = each[:, 0]
                for k in range(1, length):
                    hashes = _longer(hashes, each[:, k])
                for at in _bits(hashes):
                    np.bitwise_or.at(own, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some].view(np.int64))], names=["at", "bits"])

    found = written(rows.select("lang", "phrase").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")), "filter").toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _numbered(df: DataFrame, numbers: dict[str, dict[bytes, int]], beyond: np.ndarray | None) -> DataFrame:
    """(lang, ids, rest): texts as numbers of their words, 32 bits each, cut at breaks only; rest: words that are UNRANKED.

    A run of breaks is one; a frequent word between breaks is in no phrase and left out.
    """
    model = df.sparkSession.sparkContext.broadcast((numbers, beyond))

    def rows(lang: str, words: list[bytes], ids: np.ndarray) -> pa.RecordBatch | None:
        ends = ids == BREAK
        before = np.concatenate([[True], ends[:-1]])
        ends |= before & np.concatenate([ends[1:], [True]])
        keep = np.flatnonzero(~ends | ~np.concatenate([[True], ends[:-1]]))
        ids = np.where(ends, BREAK, ids)[keep].astype(np.int32)
        if not len(ids):
            return None
        breaks = np.flatnonzero(ids == BREAK) + 1  # the last number is one
        cuts = np.unique(breaks[np.searchsorted(breaks, np.append(np.arange(ROW, len(ids), ROW), len(ids)))])
        bounds = np.concatenate([[0], cuts])
        at = np.flatnonzero(ids == UNRANKED)
        rest = [words[t] for t in keep[at].tolist()]
        parts = np.searchsorted(at, bounds).tolist()
        texts = [b" ".join(rest[a:b]).decode() if b > a else None for a, b in zip(parts, parts[1:], strict=False)]
        data = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids)])
        return pa.RecordBatch.from_arrays([pa.repeat(lang, len(cuts)), data, pa.array(texts, pa.string())], names=["lang", "ids", "rest"])

    def run(batches):
        with no_collection():
            numbers, beyond = model.value
            for lang, words in _by_language(batches):
                ids = np.fromiter(map(numbers.get(lang, {}).get, words, repeat(BREAK)), np.int64, len(words))
                if beyond is not None:
                    rare = np.flatnonzero(ids == BREAK).tolist()
                    some = list({words[t] for t in rare} - {END})
                    known = {w for w, hit in zip(some, _hit(beyond, _hashes(lang, some)).tolist(), strict=True) if hit}
                    ids[[t for t in rare if words[t] in known]] = UNRANKED
                if (batch := rows(lang, words, ids)) is not None:
                    yield batch
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, "lang string, ids binary, rest string")


def _counted(numbered: DataFrame, ranks: Ranks, filters: list[np.ndarray | None], length: int) -> DataFrame:
    """(lang, pair or phrase, n) of phrases of ``length`` words that may be frequent.

    A pair of ranks where the first part and the last word have one; else the words' numbers in one negative number if all
    have one and they fit; else the text. Language and text stand only where the text is what is counted.
    """
    model = numbered.sparkSession.sparkContext.broadcast((vars(ranks), filters))

    def run(batches):
        with no_collection():
            (fields, filters), held = model.value, Texts()
            ranks = Ranks(**fields)
            slots = [Slots(p) for p in ranks.pairs]
            tiles, packs, size = [], [], 0

            def ranked(ids: np.ndarray, hashes: np.ndarray | None) -> np.ndarray:
                """The rank of the phrase of length - 1 words that starts at each word."""
                at, own = ids, hashes
                for k in range(1, length - 1):
                    left, last = at[:-1], ids[k:]
                    at = np.full(len(left), BREAK)
                    fine = np.flatnonzero((left >= 0) & (last >= 0))
                    at[fine] = slots[k - 1].find((left[fine] << SHIFT) | last[fine])
                    if hashes is not None:
                        own = _longer(own[:-1], hashes[k:])
                    if filters[k] is not None:
                        some = np.flatnonzero((at == BREAK) & (left != BREAK) & (last != BREAK))
                        at[some[_hit(filters[k], own[some])]] = UNRANKED
                return at

            def count():
                if tiles:
                    pairs, n = tiled(*(np.concatenate(x) for x in zip(*tiles, strict=True)))
                    yield from _rows(None, pairs, None, n)
                if packs:
                    pairs, n = np.unique(np.concatenate(packs), return_counts=True)
                    yield from _rows(None, pairs, None, n)

            for batch in batches:
                for part in slices(batch, ["ids"]):
                    rows = part.column("ids").to_pylist()
                    ids = np.frombuffer(b"".join(rows), np.int32).astype(np.int64)
                    langs = part.column("lang").to_pylist()
                    starts = np.cumsum([0] + [len(r) >> 2 for r in rows])
                    rest = [(lang, w) for lang, t in zip(langs, part.column("rest").to_pylist(), strict=True) if t is not None for w in t.encode().split(b" ")]
                    spelled = dict(zip(np.flatnonzero(ids == UNRANKED).tolist(), rest, strict=True))
                    hashes = None
                    if any(f is not None for f in filters[1 : length - 1]):
                        hashes = ranks.hashes[ids]
                        hashes[list(spelled)] = [_hashes(lang, [w])[0] for lang, w in rest]
                    at = ranked(ids, hashes)
                    left, right, last = at[:-1], at[1:], ids[length - 1 :]
                    some = np.flatnonzero((left != BREAK) & (right != BREAK))
                    fine = (left[some] >= 0) & (last[some] >= 0)
                    if fine.any():
                        own = some[fine]
                        tiles.append((left[own], last[own]))
                        size += len(own)
                    some = some[~fine]
                    if len(some) and ranks.packs(length):
                        words = ids[some[:, None] + np.arange(length)]
                        fine = (words >= 0).all(axis=1)
                        if fine.any():
                            packs.append(ranks.packed(words[fine]))
                            size += int(fine.sum())
                        some = some[~fine]
                    texts: dict[str, list[bytes]] = {}
                    for t, row in zip(some.tolist(), (np.searchsorted(starts, some, "right") - 1).tolist(), strict=True):
                        words = [spelled[u][1] if i < 0 else ranks.texts[i].as_py().encode() for u, i in enumerate(ids[t : t + length].tolist(), t)]
                        texts.setdefault(langs[row], []).append(b" ".join(words))
                    for lang, own in texts.items():
                        yield from held.add(lang, own)
                    if size >= BUFFER:
                        yield from count()
                        tiles, packs, size = [], [], 0
            yield from count()
            yield from held.flush()
        pa.default_memory_pool().release_unused()

    return numbered.mapInArrow(run, SCHEMA).groupBy("lang", "pair", "phrase").agg(F.sum("n").alias("n"))


def _texts(rows: DataFrame, ranks: Ranks, length: int) -> DataFrame:
    """Languages and texts of phrases of this many words beside their pairs."""
    model = rows.sparkSession.sparkContext.broadcast(vars(ranks))

    def run(batches):
        ranks = Ranks(**model.value)
        for batch in batches:
            pair = batch.column("pair")
            for own in (pc.is_null(pair), pc.greater_equal(pair, 0), pc.less(pair, 0)):
                if (some := batch.filter(own)).num_rows:
                    lang, pairs, phrase, n = some.columns
                    if not pairs.null_count:
                        lang, phrase = ranks.phrases(pairs.to_numpy(), length)
                    yield pa.RecordBatch.from_arrays([lang, pairs, phrase, n], names=["lang", "pair", "phrase", "n"])

    return rows.mapInArrow(run, SCHEMA)


def frequent(df: DataFrame, least: int = LEAST, longest: int = LONGEST, tables: tuple[int, int] = (WORDS, PHRASES)) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, n) of all phrases of 1 to ``longest`` words with n >= least, (lang, n) with all words of each language)."""
    counts = word_counts(df)
    counts = written(counts.filter(F.col("phrase").isNull() | (F.col("n") >= least)), "words")
    totals = counts.filter(F.col("phrase").isNull()).select("lang", "n")
    level = counts.filter(F.col("phrase").isNotNull()).select("lang", "phrase", "n")
    out = level.select("lang", "phrase", F.lit(1).alias("k"), "n")
    found, rest = _ranked(level, tables[0], ["lang", "phrase", "n"])
    filters = [_filter(rest, 1)]
    found = found.sort_values(["lang", "n", "phrase"], ascending=[True, False, True])
    langs, words = found["lang"].tolist(), found["phrase"].tolist()
    numbers: dict[str, dict[bytes, int]] = {}
    for i, (lang, word) in enumerate(zip(langs, words, strict=True)):
        numbers.setdefault(lang, {})[word.encode()] = i
    hashes = [_hashes(lang, own) for lang, own in numbers.items()]
    ranks = Ranks(pa.array(words, pa.string()), pa.array(langs, pa.string()), np.concatenate([*hashes, np.zeros(2, np.uint64)]))  # BREAK and UNRANKED: 0
    numbered = written(_numbered(df, numbers, filters[0]), "numbers")
    for k in range(2, longest + 1):
        level = _counted(numbered, ranks, filters, k).filter(F.col("n") >= least)
        level = written(_texts(level, ranks, k), "phrases")
        out = out.union(level.select("lang", "phrase", F.lit(k).alias("k"), "n"))
        if k < longest:
            found, rest = _ranked(level.filter("pair >= 0"), tables[1], ["pair", "n"])
            # Phrases that are known by their words or text alone have no rank.
            others = level.filter("pair IS NULL OR pair < 0")
            filters.append(_filter(others if rest is None else rest.union(others), k))
            ranks.pairs.append(found.sort_values(["n", "pair"], ascending=[False, True])["pair"].to_numpy(np.int64))
    return out, totals


def collocations(df: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP, lang: str = "lang", text: str = "text", tables: tuple[int, int] = (WORDS, PHRASES)) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    slim = df.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    counted, totals = frequent(slim, least, longest, tables)
    every = written(counted, "frequent")
    parts = F.split("phrase", " ")
    many = every.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), parts.alias("w"))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    join = lambda begin, size: F.array_join(F.slice("w", begin, size), " ")
    cuts = many.select("lang", "phrase", "a", "w", "k", cut)
    cuts = cuts.select("lang", "phrase", "a", "cut", join(F.lit(1), F.col("cut")).alias("left"), join(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    known = lambda c, n: every.select("lang", F.col("phrase").alias(c), F.col("n").alias(n))
    cuts = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumns({"aa": wide("a") * wide("a"), "lr": wide("l") * wide("r")}).withColumn("score", F.expr("(cast(1000000 AS decimal(7,0)) * aa) div lr"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    sizes = F.sequence(F.lit(2), F.col("k") - 1)
    inner = F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda s: F.array_join(F.slice("w", s, m), " "))))
    covered = many.filter("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(covered, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    within = Window.partitionBy("lang", "part").orderBy(*order)
    first = left.withColumn("part", part).withColumn("at", F.row_number().over(within)).filter(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(small(written(totals, "totals")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
