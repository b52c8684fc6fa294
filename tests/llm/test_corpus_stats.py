"""Near duplicates, fingerprints, quality rules, mixing and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubespark.llm import fingerprints, mixing, neardup, quality_rules, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, n, percent=80):
    sets = {d: shingles(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_op10_brute_force(spark, docs):
    want = brute_components([(r["doc_id"], r["text"]) for r in docs], 2)
    got = queries.op10_near_duplicates(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(docs)


def near_rows(rng, groups, size, length):
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(length)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(length // 6)):
                words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    return list(enumerate(rows))


def test_large_near_group_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 8)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "ROWS", 1)  # buckets of whole groups, and of texts that aren't linked
    rows = near_rows(random.Random(6), 3, 70, 60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, words=2).collect()}
    assert got == brute_components(rows, 2)


def test_unequal_texts_of_one_id_keep_their_links(spark):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "a b c d e f"), (3, "p q r s t u"), (4, "p q r s t u v"), (5, "k l m")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df, words=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}
    named = df.selectExpr("concat('d', doc_id) AS doc_id", "text").filter("doc_id <> 'd1'")
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(named, words=2).collect()}
    assert got == {("d2", "d2"), ("d3", "d3"), ("d4", "d3"), ("d5", "d5")}


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    from cubespark.llm import common

    for module in (common, neardup):
        monkeypatch.setattr(module, "HOT_ROWS", 7)
    rows = near_rows(random.Random(8), 2, 40, 60)
    rows += [(100 + i, rows[3][1]) for i in range(50)] + [(200 + i, f"{rows[5][1]} y{i % 9}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, words=2).collect()}
    assert got == brute_components(rows, 2)


def test_near_duplicate_edges(spark):
    long = " ".join(f"v{i % 7919}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b"), (7, "a  b"), (8, long), (9, long + " end"), (9, long + " end"), (None, "a b")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, kept string, cid int")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, words=2).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 6, False), (8, 8, True), (9, 8, False), (9, 8, False), (None, None, False)], key=str)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_register_estimates():
    rng, sketcher = np.random.default_rng(1), neardup.Sketcher()
    off = []
    for n in (40, 400, 4000):
        for share in (0.3, 0.8):
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            cut = round(n * (1 - share) / (1 + share))
            a, b = base[: n - cut], base[cut:]
            agree = np.mean(sketcher.registers(np.sort(a)) == sketcher.registers(np.sort(b)))
            c = neardup.chance(np.array([len(a)]), np.array([len(b)]))[0]
            off.append(abs((agree - c) / (1 - c) - neardup_share(a, b)))
    assert max(off) < 0.25 and np.mean(off) < 0.08


def neardup_share(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["cid"]: r["comp"] for r in neardup.components(links).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def test_op5_brute_force(spark, docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs)
    got = {r["doc_id"]: r for r in queries.op5_fingerprints(spark, SF).collect()}
    off = []
    for i, (d, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = exact_set(text), exact_set(other)
            off.append(abs(near - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert len(got) == len(rows) and np.mean(off) < 0.02 and max(off) < 0.15
    same = Counter(t for _, t in rows)
    text = next(t for t, n in same.items() if n > 1)
    assert len({got[d]["fingerprint"] for d, t in rows if t == text}) == 1


def exact_set(text):
    w = WORD.findall(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_sketches_merge_and_estimate(spark):
    w = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(0, " ".join(w)), (1, " ".join(w[:3000])), (2, None), (3, "a b c"), (4, "a b c d e f g")], "i int, text string").withColumn("s", fingerprints.sketch(F.col("text")))
    s = {r["i"]: r["s"] for r in df.collect()}
    assert s[2] == [] and len(s[3]) == 1 and len(s[4]) == 3 and len(s[0]) == fingerprints.K
    pair = df.filter("i = 0").select(F.col("s").alias("a")).crossJoin(df.filter("i = 1").select(F.col("s").alias("b")))
    r = pair.select(fingerprints.resemblance(F.col("a"), F.col("b")), fingerprints.containment(F.col("b"), F.col("a")), fingerprints.distinct_count(F.col("a"))).first()
    assert abs(r[0] - 0.75) < 0.12 and r[1] > 0.85 and abs(r[2] - 3996) < 800
    parts = [" ".join(w[i * 500 : i * 500 + 504]) for i in range(8)]
    cut = spark.createDataFrame([("k", p) for p in parts], "k string, text string").select("k", fingerprints.sketch(F.col("text")).alias("s"))
    assert fingerprints.merge_groups(cut, "k", "s").first()["s"] == s[0]


def test_next_edges(spark):
    df = spark.createDataFrame([(5, "e"), (1, None), (3, "c")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df, "doc_id", "text", {}).collect()}
    assert got == {1: "c", 3: "e", 5: ""}
    one = fingerprints.with_next(df.filter("doc_id = 3"), "doc_id", "text", {"sketch": fingerprints.sketch}).first()
    assert one["next_text"] == "c" and one["sketch"] == one["next_sketch"]
    assert fingerprints.with_next(df.limit(0), "doc_id", "text", {}).count() == 0
    named = df.selectExpr("concat('d', doc_id) as name", "text", "1 as at", "2 as id", "3 as Next_Text", "4 as bounds")
    out = fingerprints.with_next(named, "name", "text", {})
    assert out.columns == ["name", "text", "at", "id", "bounds", "next_text"]
    assert {r["name"]: r["next_text"] for r in out.collect()} == {f"d{k}": v for k, v in got.items()}


def test_next_over_many_ranges(spark):
    """More rows than ranges, repeated ids, empty ranges: every row is followed by the next one by id."""
    ids = [i * i for i in range(300)] + [49, 100, 100]
    df = spark.createDataFrame([(d, f"t{d}-{i}") for i, d in enumerate(ids)], "doc_id bigint, text string")
    rows = sorted((r["doc_id"], r["text"]) for r in df.collect())
    after = {t: rows[(i + 1) % len(rows)][1] for i, (_, t) in enumerate(rows)}
    got = fingerprints.with_next(df, "doc_id", "text", {"n": F.length}).collect()
    assert len(got) == len(rows) and all(r["next_text"] == after[r["text"]] and r["next_n"] == len(r["next_text"]) for r in got)


def brute_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_op6_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs}
    got = queries.op6_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, dup, repeat = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and not (r["base_failed"] and r["kept"])


def test_counts_of_odd_texts():
    for t in (None, "", " ", "a", "a b c a b c a", "x\n\nx\n \nx", "é\x1f b\x85c", "a " * 100, "p q r s " * 3 + "t", "#$ <|>\r\n#$ <|>"):
        assert quality_rules.count_text(t) == brute_counts(t)


def test_outliers_go_and_normal_rows_stay(spark):
    rng = random.Random(3)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 400))) for _ in range(300)]
    junk = [c.replace(" ", "### ") for c in clean[:60]]
    rows = [(i, t, "en", "a" if i % 3 else None, "x") for i, t in enumerate(clean + junk)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, Kept string")
    kept = {r["doc_id"] for r in quality_rules.judge(df).filter("kept").collect()}
    assert kept == set(range(300))
    few = df.limit(5)
    assert quality_rules.judge(few).filter("kept").count() == 5
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_chi_square():
    assert quality_rules.chi2_quantile(0.95, 4) == pytest.approx(9.487729, abs=1e-5)
    assert quality_rules.chi2_below(12.591587, 6) == pytest.approx(0.95, abs=1e-6)


def test_concentration_finds_the_centre(spark):
    """The estimate of one group against the same steps in numpy."""
    rng = np.random.default_rng(8)
    n = 600
    rows = [(i, "en", "s", int(w), int(w * m), int(s), 0, 0, False) for i, (w, m, s) in enumerate(zip(rng.integers(60, 900, n), rng.normal(5, 0.4, n), np.where(np.arange(n) < 90, 3000, rng.integers(0, 4, n)), strict=True))]
    df = spark.createDataFrame(rows, "i int, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean")
    mu = quality_rules.fit(df).first()["mu"]
    good = [r for r in rows if r[5] < 3000]
    assert mu[0] == pytest.approx(np.mean([math.log(r[4] / r[3]) for r in good]), abs=0.03)
    assert mu[1] < 2


def test_the_determinant_is_the_least_of_all_subsets(spark, monkeypatch):
    """Small groups against every subset of three quarters of their rows."""
    monkeypatch.setattr(quality_rules, "MIN_GROUP", 5)
    rng = np.random.default_rng(4)
    rows, n, h, p = [], 12, 9, quality_rules.P
    for g in range(6):
        bad = 0 if g % 2 else 3
        for i in range(n):
            words, mean = int(rng.integers(60, 900)), rng.normal(5, 0.3)
            symbols, repeats = (int(rng.integers(900, 2000)), words // 2) if i < bad else (int(rng.integers(0, 9)), int(words * rng.uniform(0, 0.1)))
            rows.append((100 * g + i, "en", f"s{g}", words, int(words * mean), symbols, int(rng.integers(0, 3)), repeats, False))
    df = spark.createDataFrame(rows, "doc_id int, lang string, source string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean")
    stats = df.select("doc_id", *[s.alias(x) for s, x in zip(quality_rules.statistics(), quality_rules.XS, strict=True)]).toPandas().set_index("doc_id")
    cut = quality_rules.chi2_quantile(quality_rules.SUBSET, p)
    factor = quality_rules.SUBSET / quality_rules.chi2_below(cut, p + 2)
    found = {r["fine"][-2:]: r for r in quality_rules.fit(df).collect()}
    limit, exact = quality_rules.chi2_quantile(1 - quality_rules.TAIL, p), 0
    far = lambda x, mu, inv: np.einsum("ni,ij,nj->n", x - mu, inv, x - mu) > limit
    for g in range(6):
        x = stats.loc[100 * g : 100 * g + n - 1].to_numpy()
        best, members = min((quality_rules.regularised(np.cov(x[list(c)].T, bias=True), factor)[1], c) for c in itertools.combinations(range(n), h))
        mu, inv = x[list(members)].mean(axis=0), quality_rules.regularised(np.cov(x[list(members)].T, bias=True), factor)[0]
        got = np.array(found[f"s{g}"]["mu"]), np.reshape(found[f"s{g}"]["inv"], (p, p))
        assert best - 1e-6 <= -np.linalg.slogdet(got[1])[1] <= best + 0.1  # steps may end in a subset that is nearly as good
        exact += np.allclose(got[0], mu, atol=1e-6) and np.allclose(got[1], inv, rtol=1e-4, atol=1e-4)
        assert (far(x, *got) == far(x, mu, inv)).all() and far(x, *got).any() == (g % 2 == 0)
    assert exact >= 4


def test_half_repeated_documents_are_outliers(spark):
    rng = random.Random(9)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 400))) for _ in range(200)]
    line = " ".join(f"zq{i}" for i in range(24))
    rows = [(i, t, "en", "a", 1, 2, 3, "t") for i, t in enumerate(clean)] + [(1000 + i, f"{line} {' '.join(f'u{i}x{j}' for j in range(54))} {line}", "en", "a", 1, 2, 3, "t") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, mu int, inv int, fine int, `x0.y` string")
    got = quality_rules.judge(df)
    assert got.columns[:8] == df.columns and got.columns[8:] == list(quality_rules.NEW)
    assert {r["doc_id"] for r in got.collect() if r["kept"]} == set(range(200)) and {(r["mu"], r["inv"], r["fine"], r["x0.y"]) for r in got.collect()} == {(1, 2, 3, "t")}


def brute_schedule(q, slots):
    """Earliest deadline first over one period."""
    done, order = dict.fromkeys(q, 0), []
    for t in range(slots):
        ready = [(math.ceil((done[k] + 1) * slots / q[k]), k) for k in sorted(q) if done[k] < q[k] and math.floor(done[k] * slots / q[k]) <= t]
        k = min(ready)[1]
        order.append(k)
        done[k] += 1
    return order


def shares_of(parts, w, order, at):
    """Parts of each source after so many slots."""
    got, rest, left = {}, at, sum(w.values())
    for i, k in enumerate(order):
        offset = (i + 1) * mixing.GOLDEN % mixing.FINE
        got[k] = min(parts[k], (rest * w[k] * mixing.FINE + offset * left) // (left * mixing.FINE))
        rest, left = rest - got[k], left - w[k]
    assert rest == 0
    return got


SOURCES = [
    {"a": (800, 5.0), "b": (700, 3.0), "c": (400, 2.0)},
    {"a": (3000, 90.0), "b": (90, 7.3), "c": (31, 1.1), "d": (1, 0.2)},
    {"a": (77, 1.0)},
    {f"s{i:04}": (3 + i % 40, (1 + i % 40) ** 0.7) for i in range(600)} | {"hot": (9000, 900.0)},
]


@pytest.mark.parametrize("sources", SOURCES)
def test_schedule(spark, sources):
    rows = spark.createDataFrame([(k, n, w) for k, (n, w) in sources.items()], "key string, n bigint, weight double")
    got = sorted((r["slot"], r["key"], r["part"], r["release"], r["deadline"], r["within_target"]) for r in mixing.schedule(rows).collect())
    most = max(w for _, w in sources.values())
    parts = {k: -(-n // mixing.PART_ROWS) for k, (n, _) in sources.items()}
    w = {k: round(x / most * 2**31) for k, (_, x) in sources.items()}
    order = sorted(parts, key=lambda k: (parts[k] / w[k], k))
    total, left, ends, gone = sum(parts.values()), sum(w.values()), [], 0
    whole = left
    for k in order:
        ends.append((gone + parts[k] * left // w[k], w[k] * 64 >= left or left * 64 // whole != (left - w[k]) * 64 // whole))
        gone, left = gone + parts[k], left - w[k]
    marks = sorted({*range(0, total, mixing.SLOTS), total, *(x for x, cut in ends if cut and x < total)})
    want = []
    for begin, end in itertools.pairwise(marks):
        n = end - begin
        low, high = (shares_of(parts, w, order, x) for x in (begin, end))
        q = {k: high[k] - low[k] for k in sorted(parts) if high[k] > low[k]}
        assert min(high[k] - low[k] for k in parts) >= 0
        seen = dict(low)
        for t, k in enumerate(brute_schedule(q, n)):
            nth = seen[k] - low[k]
            want.append((begin + t, k, seen[k], begin + nth * n // q[k], begin - (-(nth + 1) * n // q[k])))
            seen[k] += 1
    assert [g[:5] for g in got] == want
    assert all(r <= s < d for s, _, _, r, d in want)
    # Against the unrounded target, for as long as no source has run out.
    seen, share = Counter(), {k: x / sum(x for _, x in sources.values()) for k, (_, x) in sources.items()}
    inside = [(s, k) for s, k, *_, within in got if within]
    for slot, key in inside:
        seen[key] += 1
        for k in (key, order[0], order[-1]):
            assert abs(seen[k] - share[k] * (slot + 1)) * mixing.PART_ROWS < mixing.BLOCK_ROWS
    assert len(inside) == ends[0][0]


@pytest.mark.parametrize("sources", [3, 40, 300])
def test_every_source_keeps_within_a_block_of_its_target(spark, sources):
    """From the places of documents alone: rows of a source so far against its share of all rows so far, after every slot."""
    rng = random.Random(sources)
    rows = [(f"s{s}",) for s in range(sources) for _ in range(rng.choice([5, 20, 60, 400 if sources < 100 else 30]))]
    df = spark.createDataFrame([(i, s) for i, (s,) in enumerate(rows)], "doc_id bigint, source string")
    got = mixing.mix(df).select("source", "slot", "within_target").distinct().collect()
    weight = {s: n**0.7 for s, n in Counter(s for (s,) in rows).items()}
    total, names = sum(weight.values()), sorted(weight)
    plan = {r["slot"]: r["source"] for r in got}
    assert sorted(plan) == list(range(len(plan))) and len(got) == len(plan)
    horizon = sum(r["within_target"] for r in got)
    assert horizon > 0
    share = np.array([weight[n] / total for n in names])
    taken = np.zeros((horizon, len(names)))
    taken[np.arange(horizon), [names.index(plan[t]) for t in range(horizon)]] = 1
    lag = taken.cumsum(axis=0) - share * np.arange(1, horizon + 1)[:, None]
    assert np.abs(lag * 2).max() < 8  # a slot takes 2 rows, a block has 8


def test_op9_places_every_document_once(spark, docs):
    got = queries.op9_mixing(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)
    assert len({r["position"] for r in got}) == len(got)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)


def test_mixing_edges(spark):
    rows = [(i, "hot" if i % 3 else ("b" if i % 2 else None)) for i in range(1200)] + [(0, "hot"), (None, "hot"), (7, "hot"), (7, "hot")]
    df = spark.createDataFrame([(*r, 5, "x", 1, 2) for r in rows], "doc_id bigint, source string, Slot int, _key string, `hash` int, `a.b` int")
    out = mixing.mix(df, {"hot": 2.0, "b": 1.0})
    assert out.columns == ["doc_id", "source", "_key", "hash", "a.b", *mixing.NEW]
    got = out.collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows) and len({r["position"] for r in got}) == len(rows)
    first = sorted((r["position"], r["source"]) for r in got)[:400]
    assert abs(sum(s == "hot" for _, s in first) - 200) <= 8 and abs(sum(s is None for _, s in first) - 100) <= 8
    assert {(r["_key"], r["hash"], r["a.b"]) for r in got} == {("x", 1, 2)}
    many = spark.range(2000).selectExpr("id as doc_id", "concat('s', id % 900) as source")
    assert mixing.mix(many).select("position").distinct().count() == 2000
    assert mixing.mix(df.limit(0)).count() == 0


def test_classifier_stage_rejects_junk_that_passes_the_rules(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    say = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(80, 200)))
    good, spam = ([f"{p}{a}{b}" for a in "aeiou" for b in "klmnprst" for p in ps] for ps in (("tor", "bel", "sa"), ("wug", "zax", "qi")))
    texts = [say(good) for _ in range(300)] + [say(spam).replace(" ", " ### ") for _ in range(60)] + [say(spam) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300)) for i in [*range(200), *range(300, 360)]], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    passed = corpus_pipeline.rules(spark, df, str(tmp_path))
    ids = {r["doc_id"] for r in passed.collect()}
    assert ids >= set(range(360, 380)) and ids.isdisjoint(range(300, 360))
    kept = {r["doc_id"] for r in corpus_pipeline.classifier(spark, passed, str(tmp_path)).collect()}
    assert kept == ids - set(range(360, 380))


def test_encoding_carries_the_mix(spark, docs):
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = corpus_pipeline.mix(spark, base, SF)
    order = [r["doc_id"] for r in mixed.select("doc_id").collect()]
    got = {r["doc_id"]: r["position"] for r in corpus_pipeline.encode(spark, mixed.repartition(3, "doc_id"), SF).collect()}
    want = {r["doc_id"]: r["position"] for r in queries.op9_mixing(spark, SF).collect()}
    assert got == want and sorted(got, key=got.get) == order and len(order) == len(docs)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    base = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("x")).withColumn("Slot", F.lit(1))
    clash = spark.createDataFrame([(10**6, None, None, None, None, "y", 2), (10**6 + 1, "", "en", None, 0, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, Slot int")
    now = base.unionByName(clash)
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        after = stage(spark, now, SF)
        empty = stage(spark, now.limit(0), SF)
        assert empty.count() == 0
        ids = [r["doc_id"] for r in after.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= set(before)
        if name != names[-1]:
            assert after.columns == now.columns
        if name in names[3:]:
            assert set(ids) == set(before)
        if name == names[2]:
            want = brute_components(list(before.items()), 5)
            assert set(ids) == {d for d, (_, c) in want.items() if c == d}
        if name == names[0]:
            assert 10**6 not in ids
        now = spark.createDataFrame(after.collect(), after.schema)
    run = corpus_pipeline.run(spark, SF)
    assert 0 < run.count() <= len(docs)
