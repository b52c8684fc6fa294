"""Whitening, the n-gram join and collocations against brute force."""

from __future__ import annotations

import math
import random
import re
import sys
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubespark.llm import collocations, common, neardup, ngram_join, queries, whitening

from test_corpus_stats import SF, brute_components, near_rows


def brute_whitening(rows):
    """{vec_id: (deviation, whitened)}, explained; plain numpy on doubles and Python integers."""
    x = {k: np.array([math.floor(1024 * float(c)) + 100_000 for c in v], object) for k, v in rows}
    n, total = len(x), sum(x.values())
    z = np.array([n * v - total for v in x.values()])
    v = np.array([[float(Fraction(int(a), n**3)) for a in r] for r in z.T @ z])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    w = (z.astype(float) / n) @ u / np.sqrt(np.where(e > 1e-9, e, np.nan))
    return {k: (int((zz * zz).sum()), ww) for k, zz, ww in zip(x, z, w, strict=True)}, e / e.sum(), n


def test_op11_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, explained, n = brute_whitening(rows)
    got = queries.op11_whitening(spark, SF).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    signs = {}
    for r in got:
        k = r["component"] - 1
        deviation, w = want[r["vec_id"]]
        sign = signs.setdefault(k, 1 if w[k] * r["whitened"] > 0 else -1)
        assert r["deviation"] == deviation and math.isclose(sign * r["whitened"], w[k], rel_tol=1e-6, abs_tol=1e-7)
        assert math.isclose(r["explained"], explained[k], rel_tol=1e-9) and r["identity_error"] < 1e-9


@pytest.mark.parametrize("low,high", [(0, 1), (-5, 900), (-(1 << 40), 1 << 41), (-(1 << 62), 1 << 62)])
def test_cross_products_are_exact(low, high):
    rng = random.Random(4)
    x = np.array([[rng.randrange(low, high) for _ in range(5)] for _ in range(150)], np.int64)
    x[:, 3] = x[0, 3]
    sums, products = whitening.cross_products(x)
    y = x.astype(object)
    assert (sums == y.sum(axis=0)).all() and (products == y.T @ y).all()
    assert all(sum(p << (40 * k) for k, p in enumerate(whitening._limbs(v))) == v for v in (0, -1, 1 << 150, -(1 << 150) + 7))


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (2, [0.25, -1.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [1.0]), (8, []), (9, [1e300, 0.0]), (10, [-3.0, 8.0])]
    df = spark.createDataFrame([(k, v, "x", k) for k, v in rows], "vec_id bigint, v array<double>, whitened string, n int")
    model = whitening.fit(df, "v")
    assert (model.dimension, model.n) == (2, 4)
    got = whitening.whiten(df, model, 8, "v").collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2, 2, 10] and got[0].asDict().keys() == {"vec_id", "v", "n", "whitened", "deviation"}
    assert whitening.identity_error(df, model, 8, "v") < 1e-9
    same = df.filter("vec_id = 2")
    model = whitening.fit(same, "v")
    assert [(r["whitened"], r["deviation"]) for r in whitening.whiten(same, model, 8, "v").collect()] == [([None, None], 0)] * 2
    assert model.explained == [None, None] and whitening.identity_error(same, model, 8, "v") is None
    none = whitening.fit(df.filter("vec_id = 3"), "v")
    assert none.n == 0 and whitening.whiten(df.filter("vec_id = 3"), none, 8, "v").count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, -1.0]) for i in range(20)], "vec_id bigint, v array<float>")
    model = whitening.fit(line, "v")
    got = whitening.whiten(line, model, 8, "v").collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in got)
    assert whitening.identity_error(line, model, 8, "v") < 1e-9


def test_wide_deviations_are_exact():
    z = np.array([[1 << 40, 3], [-(1 << 40), 0]], np.int64)
    assert whitening.deviations(z) == [(1 << 80) + 9, 1 << 80]


def joined(df, **kw):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df, **kw).collect()}


def test_op12_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op12_ngram_join(spark, SF).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs], 3, 90)


@pytest.mark.parametrize("percent,length", [(90, 60), (70, 40), (50, 8), (100, 12)])
def test_the_join_loses_no_link(spark, monkeypatch, percent, length):
    for name, value in (("SMALL", 6), ("BLOCK", 8), ("COLUMNS", 50), ("HOT_ROWS", 20)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = [t for _, t in near_rows(random.Random(percent), 3, 40, length)]
    rows += [f"{rows[0]} {rows[50]}", *rows[:30], "a", "a b", "A  b"]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert joined(df, words=2, percent=percent) == brute_components(rows, 2, percent)


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 90, 100):
        for n in (1, 2, 9, 10, 11, 57, 300):
            for cut in range(0, n // 2 + 1, max(1, n // 9)):
                base = rng.permutation(10 * n)
                a, b = base[:n], base[cut : n + cut]
                both = n - cut
                if both and 100 * both >= percent * (2 * n - both):
                    k = ngram_join.prefix_length(n, percent)
                    assert len(np.intersect1d(ngram_join.first(a, k), ngram_join.first(b, k)))


def test_bitmaps_keep_all_links(spark):
    rng = np.random.default_rng(11)
    rows, differ = [], []
    for n in (1, 2, 63, 64, 65, 128, 129, 600):
        for cut in (0, 1, n // 20, n // 4, n // 2, n):
            for more in (0, 1, n // 10, n):
                pool = rng.integers(0, 1 << 63, 3 * n + 2, dtype=np.int64).view(np.uint64)
                a, b = pool[:n], pool[cut : cut + n + more]
                rows.append((len(rows), n, ngram_join.parities(a).tolist(), n + more, ngram_join.parities(b).tolist()))
                both = len(np.intersect1d(a, b))
                differ.append((both, 2 * n + more - both))
    df = spark.createDataFrame(rows, "at int, n_shingles_a bigint, bits_a array<bigint>, n_shingles_b bigint, bits_b array<bigint>")
    for percent in (50, 90, 100):
        got = {r["at"]: r["may"] for r in df.select("at", ngram_join.may_link(percent).alias("may")).collect()}
        links = {at for at, (both, union) in enumerate(differ) if 100 * both >= percent * union}
        assert all(got[at] for at in links) and links
        assert sum(map(bool, got.values())) < len(links) + len(rows) // 3


@pytest.mark.parametrize("bitmaps", [0, 16_384])
def test_members_of_shared_prefix_shingles(spark, monkeypatch, bitmaps):
    for name, value in (("RANGE", 40), ("PACKED", 30), ("LOW", 3), ("BITMAPS", bitmaps)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(5)
    rows = [(7 + at * 3 + ((at % 4) << 33), [rng.randrange(-60, 60) << 50 for _ in range(rng.randrange(1, 12))]) for at in range(200)]
    rows = [(cid, sorted(set(one))) for cid, one in rows] + [(9, None), (10, [1, 1 << 62]), (1 << 40, [1, -5])]
    sk = spark.createDataFrame([(cid, len(one) * 10 if one else 0, one) for cid, one in rows], "cid bigint, n_shingles bigint, one array<bigint>")
    kept = {cid for cid, one in rows if one and cid % 5}
    reps = spark.createDataFrame([(cid,) for cid in sorted(kept)], "cid bigint")
    n = Counter(x for cid, one in rows if cid in kept for x in one)
    got = [(r["cid"], r["m"]) for r in ngram_join._members(sk, reps, 90).collect()]
    assert sorted(got) == sorted((cid, n[x]) for cid, one in rows if cid in kept for x in one if n[x] > 1)
    tokens = [r["n"] for r in ngram_join._members(sk, reps, 90).groupBy("token", "m").count().withColumnRenamed("count", "n").collect()]
    assert sorted(tokens) == sorted(x for x in n.values() if x > 1)


def test_texts_of_candidates_that_bitmaps_rule_out_stay_where_they_are(spark, monkeypatch):
    written = []

    def kept(df, name, real=ngram_join.written):
        written.append(real(df, name))
        return written[-1]

    for module in (common, ngram_join, neardup):
        monkeypatch.setattr(module, "written", kept)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5))
    rows = []
    for _ in range(150):  # 228 of 246 shingles are shared: too few for a link, too many for disjoint prefixes
        passage = [word() for _ in range(230)]
        rows += [" ".join([word() for _ in range(18)] + passage) for _ in range(2)]
    rows.append(rows[0] + " end")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    links = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df, 3, 90).collect()}
    assert links == {at: 0 if at == len(rows) - 1 else at for at in range(len(rows))}
    texts = [w for w in written if "text" in w.columns]
    assert 2 <= sum(t.count() for t in texts) <= 30
    size = sum(Path(f.removeprefix("file://")).stat().st_size for w in written for f in w.inputFiles())
    assert size < 1.2 * sum(map(len, rows))


def test_join_edges(spark):
    long = " ".join(f"v{i % 7919}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b"), (7, "a  b"), (8, long), (9, long + " end"), (9, long + " end"), (None, "a b"), (10, "p q r s"), (10, "k l m n"), (11, "k l m n")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, token string, cid int")
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(df, 3, 90).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 8), (None, None), (10, 10), (11, 10)}
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def brute_collocations(rows, least, longest, cover, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    many = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in many.items():
        if any(x == lang and len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in many.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    found = set()
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))[:top]
        found |= {(r[0], i + 1, r[3], r[2], r[4], r[5], r[6], r[1]) for i, r in enumerate(own)}
    return found


def mined(df, **kw):
    return {tuple(r) for r in collocations.collocations(df, **kw).collect()}


def test_op13_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute_collocations([(r["lang"], r["text"]) for r in docs], 10, 3, 50, 2000)
    assert {tuple(r) for r in queries.op13_collocations(spark, SF).collect()} == want


@pytest.mark.parametrize("table,longest", [(1 << 18, 4), (5, 4), (12, 3), (1, 2)])
def test_phrases_beyond_the_tables_count_too(spark, monkeypatch, table, longest):
    for name, value in (("SIDE", 4), ("DENSE", 3), ("BUFFER", 40), ("TEXTS", 30), ("BATCH", 7), ("FILTER_BITS", 128)):
        monkeypatch.setattr(collocations, name, value)
    rng = random.Random(table)
    words = ["the", "The", "of", "é", "ﬁn", "a", "b", "c", "d", "e\tf", "g;h", "", "x,y", "z\x1c"]
    rows = [(rng.choice(["en", "en", None, "fr"]), rng.choice([" ", "\t", "\n", "  ", ". "]).join(rng.choices(words, weights=range(14, 0, -1), k=rng.randrange(30)))) for _ in range(80)]
    rows += [("en", None), (None, ""), ("de", "one two"), ("und", "the of")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).repartition(3)
    assert mined(df, least=2, longest=longest, cover=60, top=25, tables=(table, table)) == brute_collocations(rows, 2, longest, 60, 25)


def test_collocation_edges(spark):
    df = spark.createDataFrame([("en", "a b " * 50_000), ("en", "a b")], "lang string, text string")
    assert mined(df) == brute_collocations([tuple(r) for r in df.collect()], 10, 3, 50, 2000)
    assert mined(df.limit(0)) == set()


def test_tiles():
    rng = np.random.default_rng(5)
    left, right = (rng.zipf(1.3, 300_000) % 5000).astype(np.int64), (rng.zipf(1.3, 300_000) % 5000).astype(np.int64)
    pairs, n = collocations.tiled(left, right)
    assert dict(zip(pairs.tolist(), n.tolist(), strict=True)) == Counter(((left << 32) | right).tolist())


@pytest.mark.parametrize("tables", [(1 << 18, 8), (6, 8), (6, 1 << 20)])
def test_phrases_without_rank_are_found_in_filters_of_their_real_size(spark, tables):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "fr"]), " ".join(rng.choices("the of a b c d é f g h".split(), weights=range(10, 0, -1), k=rng.randrange(30))) + ". x") for _ in range(120)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert mined(df, least=2, longest=4, cover=60, top=200, tables=tables) == brute_collocations(rows, 2, 4, 60, 200)


def test_texts_are_turned_into_numbers_once(spark, monkeypatch):
    monkeypatch.setattr(collocations, "ROW", 4)
    rows = [("en", "A b c. rare a, b  a rare rare c b"), ("en", None), ("en", "a"), ("en", "b\tc"), ("fr", "x rare")]
    found = collocations._numbered(spark.createDataFrame(rows, "lang string, text string").coalesce(1), {"en": {b"a": 0, b"b": 1, b"c": 2}, "fr": {b"x": 3}}, None).collect()
    assert [(r["lang"], np.frombuffer(r["ids"], np.int32).tolist(), r["rest"]) for r in found] == [("en", [0, 1, 2, -1], None), ("en", [1, 0, -1, 2, 1, -1], None), ("en", [1, 2, -1], None)]
    reads = []
    monkeypatch.setattr(collocations, "_numbered", lambda *a, f=collocations._numbered: reads.append(1) or f(*a))
    assert mined(spark.createDataFrame(rows, "lang string, text string"), least=1, longest=4) and reads == [1]


def test_slots():
    rng = np.random.default_rng(7)
    pairs = rng.permutation(np.unique(rng.integers(0, 1 << 50, 20_000)))
    slots, asked = collocations.Slots(pairs), np.concatenate([pairs[::-1], rng.integers(0, 1 << 50, 1000)])
    rank = {p: i for i, p in enumerate(pairs.tolist())}
    assert slots.find(asked).tolist() == [rank.get(p, -1) for p in asked.tolist()]
    assert collocations.Slots(pairs[:0]).find(asked[:3]).tolist() == [-1, -1, -1]


def test_a_task_leaves_nothing_in_its_worker():
    kept = common.per_worker(neardup.WordHashes)
    assert common.per_worker(neardup.WordHashes) is kept
    own = common.per_task(neardup.WordHashes)
    assert own is not kept and not own and not {"key", "value"} & set(vars(sys.modules["cubespark_worker"]))
    assert common.per_worker(neardup.WordHashes) is not kept
