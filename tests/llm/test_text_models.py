"""Encoders against the public libraries, classifiers by held-out accuracy, chat by round trips."""

from __future__ import annotations

import hashlib
import json
import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cubespark.llm import bpe, chat, langid, quality_classifier, queries, toxicity
from cubespark.llm.sampling import id_modulo

SF = "/root/testdata/sf0.001"
WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [None, "", " ", "a", "hello <|endoftext|>  world<|startoftext|>", "ΑΣΣΟΣ Σ İstanbul ǅ", "it's we're  x\x1cy \x85 z", "a\n\nb  c \n d", "日本語 123 ٣٤", "é é ﬁ 🙂", "x" * 3000, "<|endoftext", " lead", "trail ", "ab, cd. ef.\nGh " * 500]


def odd_frame(spark):
    rng = random.Random(4)
    more = ["".join(rng.choice("ab 's \nélΣ1٣!<|>\x1c\x85　🙂eiou") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    rows = [(i, t, "x", 1.5) for i, t in enumerate(ODD + more + ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, Token_IDs string, n_tokens double")


def test_encode_and_decode(spark):
    lib = Tokenizer.from_file(WORDS)
    for r in bpe.encode_decode(odd_frame(spark), WORDS).collect():
        want = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r['token_ids']) // 4}I", r["token_ids"])) == want
        assert r["decoded"] == lib.decode(want, skip_special_tokens=False)


def test_encode_then_decode_alone(spark):
    both = bpe.decode(bpe.encode(odd_frame(spark), WORDS), WORDS)
    assert both.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]
    assert both.exceptAll(bpe.encode_decode(odd_frame(spark), WORDS)).isEmpty()
    assert bpe.encode(odd_frame(spark).limit(0), WORDS).count() == 0


def test_token_counts(spark):
    lib = Tokenizer.from_file(BYTES)
    for r in bpe.count_tokens(odd_frame(spark), BYTES).collect():
        assert r["n_tokens"] == len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["n_bytes"] == len((r["text"] or "").encode())


def test_rare_characters_between_and_beside_pieces():
    word, byte, lib, blib = bpe.WordBpe(WORDS), bpe.TextBpe(BYTES), Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    rng = random.Random(11)
    parts = ["\u07fd", "\u0898", "\ua7ce", "\u1c89", "\U0001e130", "\U000107bb", "\U00010d50", "\U00016ea0", "\U00011938", "\U00011930", "🙂", "👩‍🔬", "𝒜", "𐐀", "e\u0301", "\u0301", "a", "Σ", "ß", "1", "²", "'s", "!", " ", "  ", "\n", "\u3000", "\x1c", "\x85", "the ", " dog", "<|"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert list(struct.unpack(f"<{len(word.encode(text)) // 4}I", word.encode(text))) == lib.encode(text, add_special_tokens=False).ids, ascii(text)
        assert byte.count(text) == len(blib.encode(text, add_special_tokens=False).ids), ascii(text)


def test_whole_tokens_encode_alone():
    lib, mine = Tokenizer.from_file(BYTES), bpe.TextBpe(BYTES)
    some = random.Random(1).sample(sorted(mine.whole), 500)
    assert all(len(lib.encode(t, add_special_tokens=False).ids) == 1 for t in some)


def test_op2_op4_equal_the_library(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    word, byte = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    two = queries.op2_bpe(spark, SF).collect()
    four = {r["doc_id"]: r for r in queries.op4_token_counts(spark, SF).collect()}
    assert len(two) == len(four) == len(texts)
    for r in two:
        ids = word.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        n = len(byte.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (four[r["doc_id"]]["n_tokens"], four[r["doc_id"]]["over_limit"]) == (n, n > 512)


RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}, "conversations", [("user", "a"), ("assistant", "")]),
    ({"instruction": "do", "input": "x", "output": "y"}, "instruction_input", [("user", "do\n\nx"), ("assistant", "y")]),
    ({"instruction": "do", "output": "y"}, "instruction", [("user", "do"), ("assistant", "y")]),
    ({"response": "y", "prompt": "x"}, "prompt_response", [("user", "x"), ("assistant", "y")]),
    ({"role": "system", "text": None}, "message", [("system", "")]),
    ({"surprise": 1}, None, []),
    ([1, 2], None, []),
    (None, None, []),
]


def test_every_kind_of_character_encodes_as_in_the_library():
    alike = [range(0x3400, 0xA000), range(0xAC00, 0xE000), range(0xE000, 0xF900), range(0x17000, 0x18CD6)]
    points = [c for c in range(0x20000) if not any(c in r for r in alike)]
    points += [c for lo in (0x2B720, 0x2CEA0, 0x323A0, 0x33470, 0x3CFF0, 0xE0100) for c in range(lo, lo + 40)] + [0x3400, 0xAC01, 0xE000, 0x17000]
    for path, make in ((WORDS, bpe.WordBpe), (BYTES, bpe.TextBpe)):
        library, own = Tokenizer.from_file(path), make(path)
        texts = [x for c in points for x in (f"a{chr(c)}b {chr(c)} Q1{chr(c)}{chr(c)}", f"a\u0301{chr(c)}\u0323\u0304")]
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        if make is bpe.WordBpe:
            off = [ascii(t) for t, w in zip(texts, want, strict=True) if list(memoryview(own.encode(t)).cast("I")) != w]
        else:
            off = [ascii(t) for t, w in zip(texts, want, strict=True) if own.count(t) != len(w) or own.encode(t) != w]
        assert not off, off[:5]


def test_layouts(spark):
    df = spark.createDataFrame([(i, json.dumps(r) if r is not None else None) for i, (r, _, _) in enumerate(RECORDS)] + [(99, "{bad")], "i int, record string")
    got = {r["i"]: r for r in chat.canonical_turns(df).collect()}
    for i, (_, mapping, turns) in enumerate(RECORDS):
        assert got[i]["mapping"] == mapping and [(t["role"], t["text"]) for t in got[i]["turns"]] == turns
    assert got[99]["turns"] == []


def test_escapes_are_reversible():
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice(["<", "|", "\\", "im_end", ">", "\n", "%", "%0A", "a"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.parse_turn(chat.format_turn(t, t)[0]) == (t, t)


def test_chat_edges(spark):
    rows = [
        (1, 1, '{"role": "human", "text": "a", "id": 7}', 5),
        (1, 2, '{"conversations": [{"from": "gpt", "value": "b"}], "x": {"y": 1}}', 5),
        (2, 1, '{"messages": [], "id": 7}', 5),
        (3, 1, '{"who": "x"}', 5),
        (4, 1, None, 5),
        (None, 1, '{"role": "assistant", "text": null}', 5),
        (None, 2, '{"role": "assistant", "text": "<|im_end|>"}', 5),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, record string, Mapping int")
    turns = chat.canonical_turns(df)
    got = {(r["conv_id"], r["turn"]): (r["mapping"], [tuple(t) for t in r["turns"]]) for r in turns.collect()}
    assert got[1, 1] == ("message", [("human", "a")]) and got[1, 2] == ("conversations", [("assistant", "b")])
    assert got[2, 1] == ("messages", []) and got[3, 1] == got[4, 1] == (None, [])
    assert sum(r["n"] for r in chat.unmapped(turns).collect()) == 2
    back = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.format_turns(chat.ordered_turns(turns))).collect()}
    assert back == {1: (2, 1), None: (2, 10)}
    empty = chat.read_back(chat.format_turns(chat.ordered_turns(chat.canonical_turns(df.limit(0)))))
    assert empty.count() == 0 and len(empty.columns) == 6


def test_kernel_ridge_by_the_book():
    """The Nyström weights against kernel ridge regression in its dual form, with every text a landmark."""
    import numpy as np

    rng = random.Random(3)
    texts = [" ".join(rng.choice(w) for _ in range(12)) for w in (["der", "und", "nicht", "ein"], ["the", "and", "not", "one"]) for _ in range(20)]
    langs = ["de"] * 20 + ["en"] * 20
    model = langid.fit(texts, langs)
    k = langid.kernel(langid.presences(texts), langid.presences(texts)).astype(float)
    y = np.where(np.array(langs)[:, None] == np.array(["de", "en"]), 1.0, -1.0)
    # Minimise sum of squares / 20 + ridge / 40 |f|^2 with a free intercept: (K + 20 ridge / 40) a + b = y, sum a = 0.
    n, pull = len(texts), 20 * langid.RIDGE / len(texts)
    system = np.block([[k + pull * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    a = np.linalg.solve(system, np.vstack([y, np.zeros((1, 2))]))
    new = langid.presences(["der und the", "and not one", "nicht ein"])
    want = langid.kernel(new, langid.presences(texts)).astype(float) @ a[:-1] + a[-1]
    got = langid.kernel(new, model["landmarks"].astype(np.float32)) @ model["weights"][:-1] + model["weights"][-1]
    assert np.allclose(got, want, atol=1e-2)


def test_dual_descent_closes_the_gap():
    """The hinge-loss objective at the weights against the dual bound of a long run."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [np.unique(np.concatenate([rng.integers(0, 300, 12), rng.integers(300 + 40 * (i % 2), 360 + 40 * (i % 2), 3)])) for i in range(200)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(200)])
    ratio = np.zeros(quality_classifier.DIMENSIONS)
    ratio[:500] = rng.normal(size=500)

    def objective(w):
        margins = []
        for r in rows:
            v = ratio[r] / np.sqrt(np.square(ratio[r]).sum())
            margins.append(w[r] @ v + w[-1])
        return 0.5 * (w @ w) + quality_classifier.COST * np.maximum(0, 1 - y * np.array(margins)).sum()

    def run(epochs):
        old, quality_classifier.EPOCHS = quality_classifier.EPOCHS, epochs
        try:
            return objective(quality_classifier.dual_descent(rows, y, ratio))
        finally:
            quality_classifier.EPOCHS = old

    best = run(600)
    assert best <= run(12) <= 1.05 * best


def test_token_labels_and_scores_by_hand(spark):
    """Stems, tags and the roll-up of marginals, each worked out again in plain Python."""
    import numpy as np

    docs, labels = labelled(spark)
    sample = docs.join(labels.filter("toxic is not null"), "doc_id").selectExpr("text", "toxic as label")
    rows = sample.collect()
    bad, good = ([set(map(toxicity.letters, r["text"].split())) - {""} for r in rows if r["label"] == k] for k in (1, 0))
    least = toxicity.least_support(len(rows), len(bad))
    every = {s for ws in bad for w in ws for s in toxicity.beginnings(w)}
    n = lambda s, where: sum(any(s in toxicity.beginnings(w) for w in ws) for ws in where)
    want = {s for s in every if n(s, bad) >= least and n(s, good) * len(bad) / len(good) <= toxicity.MOST_CLEAN * n(s, bad)}
    assert toxicity.toxic_stems(sample, len(good), len(bad)) == want and "moron" in want
    for r in toxicity.labelled_chains(sample, want).collect():
        assert [bool(t) for t in r["tags"]] == [bool(r["any"] and w and want & toxicity.beginnings(w)) for w in r["tokens"].split(" ")]
    model = toxicity.train(docs, labels)
    text = "so moronish, moronically indeed calm words"
    emissions = toxicity.Emissions(model["weights"], float(model["bias"]))
    p = toxicity.token_marginals([text], emissions, model["move"])[0]
    total, top, _ = next(toxicity.read_texts([text], emissions, model["move"]))
    assert total == pytest.approx(np.log1p(sum(x for x in p if x >= toxicity.COUNTED))) and top == pytest.approx(max(p))
    a, b, c = model["curve"]
    got = toxicity.tag(spark.createDataFrame([(text,)], "text string"), model).first()["score"]
    assert got == pytest.approx(1 / (1 + np.exp(-(a * total + b * top + c))))


def test_long_texts_are_read_in_pieces(monkeypatch):
    import numpy as np

    monkeypatch.setattr(toxicity, "PIECE", 50)
    text = " ".join(f"w{i}" for i in range(100)) + "  end " + "x" * 200
    parts = list(toxicity.pieces(text))
    assert len(parts) > 3 and all(text[a : a + len(p)] == p for a, p in parts)
    assert [w for _, p in parts for w in p.split()] == text.split() and list(toxicity.pieces(None)) == [(0, "")]
    weights = np.zeros(toxicity.DIMENSIONS)
    weights[toxicity.feature_ids("end")] = 5
    _, top, spans = next(toxicity.read_texts([text], toxicity.Emissions(weights, -8.0), np.zeros((3, 2))))
    assert [text[a:b] for a, b, _ in spans] == ["end"] and top > 0.8


def test_op3_brute_force(spark):
    rows = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    want: dict = {}
    for c, _, role, text in sorted(rows):
        n, turns, loss = want.get(c, (0, "", ""))
        want[c] = (n + 1, f"{turns}{role}\n{text}\n", loss + (text if role == "assistant" else ""))
    got = queries.op3_chat_format(spark, SF).collect()
    assert len(got) == len(want)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        n, turns, loss = want[r["conv_id"]]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (n, sha(turns), len(loss), sha(loss))


def test_language_held_out(spark):
    got = queries.op1_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").selectExpr("avg(cast(lang = lang_pred as int))").first()[0]
    assert held > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "der Hund und die Katze", "en" if i % 2 else "de") for i in range(20)] + [(90, None, "en"), (91, "x", None)], "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    rows = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "12 !!", 0), (4, "the dog", 0), (5, "die Katze " * 5000, 0)], "doc_id bigint, text string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(rows, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert (got[4][0], got[5][0]) == ("en", "de")
    nothing = langid.train(docs.filter("lang = 'xx'"))
    assert {r["lang_pred"] for r in langid.identify(rows, nothing).collect()} == {"und"}
    assert langid.identify(rows.limit(0), model).count() == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op7_toxicity", "toxic", 0.9), ("op8_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = getattr(queries, name)(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    held = got.filter("held_out")
    assert held.filter(id_modulo("doc_id", 5) != 0).count() == 0
    assert held.selectExpr(f"avg(cast({label} = predicted as int))").first()[0] >= least
    assert got.filter("score < 0 or score > 1 or score is null").count() == 0


def labelled(spark):
    docs = [(i, ("you are a moronish fool today and more words here" if i % 3 == 0 else "a calm and clean text about many other things") + f" n{i}") for i in range(90)]
    labels = [(i, int(i % 3 == 0), int(i % 3 != 0)) for i in range(90)] + [(5, None, None), (200, 1, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")


def test_toxic_spans_and_edges(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    rows = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "so moronish, é moronically indeed", 7), (4, "calm things " * 20_000, 7), (4, "calm things " * 20_000, 7)], "doc_id bigint, text string, Spans int")
    got = {r["doc_id"]: r for r in toxicity.tag(rows, model).collect()}
    assert got[3]["score"] > 0.5 and all(got[i]["score"] < 0.5 for i in (1, 2, 4))
    found = ["so moronish, é moronically indeed"[s["start"] : s["end"]] for s in got[3]["spans"]]
    assert any("moronish" in f for f in found) and got[1]["spans"] == []
    one = toxicity.train(docs, labels.filter("toxic = 0"))
    assert len({round(r["score"], 9) for r in toxicity.tag(rows, one).collect()}) == 1
    assert toxicity.tag(rows.limit(0), model).count() == 0


@pytest.mark.parametrize(("n", "toxic"), [(9000, 45), (20_000, 100)])
def test_rare_toxicity_with_a_wide_lexicon(spark, n, toxic):
    rng = random.Random(5)
    plain, bad = ([p + a + b + c for a in "aeiou" for b in "klmnprst" for c in ("a", "o", "in", "et")] for p in ("d", "g"))
    text = lambda i: " ".join(rng.choices(plain, k=30) + (rng.sample(bad, 12) if i % (n // toxic) == 0 else []))
    docs = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", f"int(doc_id % {n // toxic} = 0) as toxic")
    model = toxicity.train(docs, labels)
    fresh = spark.createDataFrame([(i, text(i // 20 * (n // toxic) + i % 20)) for i in range(1000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in toxicity.tag(fresh, model).collect()}
    assert all((got[i]["score"] >= 0.5) == (i % 20 == 0) for i in got)
    assert all(len(got[i]["spans"]) > 0 for i in got if i % 20 == 0)


def test_samples_fill_by_class(spark):
    from cubespark.llm.sampling import class_bounds, labelled_sample

    assert class_bounds(900, 100, 2000) == (900, 100) and class_bounds(90_000, 10_000, 8000) == (7000, 1000)
    assert class_bounds(99_500, 500, 8000) == (7500, 500) and class_bounds(50, 90_000, 8000) == (50, 7950)
    assert class_bounds(0, 9000, 8000) == (0, 8000) and class_bounds(60_000, 40_000, 8000) == (4800, 3200)
    docs = spark.range(4000).selectExpr("id as doc_id", "'a' as text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 200 = 0) as toxic")
    sample, more = labelled_sample(docs, labels, "toxic", 400)
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    assert counts == {0: 380, 1: 20} and more == pytest.approx(-2.349, abs=1e-3)


def test_forward_backward_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    score, move = rng.normal(size=(1, 5)), rng.normal(size=(3, 2))
    real = np.ones((1, 5), bool)
    real[0, 4] = False
    weight = {}
    for tags in itertools.product((0, 1), repeat=4):
        w = move[2, tags[0]] + sum(move[a, b] for a, b in itertools.pairwise(tags)) + sum(s for s, t in zip(score[0], tags, strict=False) if t)
        weight[tags] = np.exp(w)
    total = sum(weight.values())
    want = [sum(w for t, w in weight.items() if t[i]) / total for i in range(4)]
    p, moves = toxicity.marginals(score, real, move)
    assert np.allclose(p[0, :4], want) and p[0, 4] == 0
    assert np.isclose(moves[1, 1], sum(w * sum(a == b == 1 for a, b in itertools.pairwise(t)) for t, w in weight.items()) / total)


def test_quality_edges(spark):
    docs, labels = labelled(spark)
    model = quality_classifier.train(docs, labels)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a calm and clean text about many things"), (4, "x " * 30_000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(rows, model).collect()}
    assert got[1] == got[2] and got[3] > 0.5 and all(0 <= s <= 1 for s in got.values())
    one = quality_classifier.train(docs, labels.filter("quality = 1"))
    assert len({round(r["score"], 6) for r in quality_classifier.score(rows, one).collect()}) == 1
    assert quality_classifier.score(rows.limit(0), model).count() == 0


def test_quality_of_repeated_rows_and_clashing_columns(spark):
    docs, labels = labelled(spark)
    model = quality_classifier.train(docs.union(docs.limit(7)), labels)
    rows = spark.createDataFrame([(1, "a calm text", "x", 2), (1, "a calm text", "y", 3), (None, "a calm text", None, 4)], "doc_id bigint, text string, Score string, quality int")
    got = quality_classifier.score(rows, model)
    assert [c.lower() for c in got.columns].count("score") == 1 and {"doc_id", "text", "quality"} <= set(got.columns)
    assert len({r["score"] for r in got.collect()}) == 1 and sorted(r["quality"] for r in got.collect()) == [2, 3, 4]


def test_samples_are_bounded(spark):
    from cubespark.llm.sampling import first_of_each, labelled_sample

    docs, labels = labelled(spark)
    assert labelled_sample(docs, labels, "toxic", 10)[0].count() == 10
    rows = spark.range(30_000).selectExpr("id", "if(id % 3 = 0, 'few', 'many') as k").filter("k = 'many' or id < 90")
    rows = rows.union(rows.filter("id = 7").crossJoin(spark.range(500)).selectExpr("7L", "'many'"))
    sizes = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("bound", F.lit(100))
    got = first_of_each(rows, "k", "id", sizes).collect()
    hashed = rows.withColumn("h", F.xxhash64(F.col("id").cast("string"))).collect()
    for key, n in (("few", 30), ("many", 100)):
        want = [r["id"] for r in sorted((r for r in hashed if r["k"] == key), key=lambda r: (r["h"], r["id"]))[:n]]
        assert sorted(r["id"] for r in got if r["k"] == key) == sorted(want)
