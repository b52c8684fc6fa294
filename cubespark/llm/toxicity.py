"""Toxicity by a linear-chain conditional random field.

Tokens are runs of anything but white space, read by their letters. Labels exist for documents only, so training first
labels tokens: a token of a toxic document is toxic if a beginning of it (``PREFIXES`` letters, or the whole word)
stands in more toxic documents than chance explains and hardly ever in others. A two-state chain (clean, toxic) learns from these tokens;
its features are the whole word, its beginnings and its endings, hashed, so unseen forms of a known stem score too.
Forward-backward gives each token's marginal; a document's score is a logistic function of their largest and of the sum
of those of at least ``COUNTED``, so that the many small ones of a long clean text don't add up.
``spans`` are the offsets of tokens whose marginal is at least one half, neighbours joined.

Chains start anew every ``CHAIN`` tokens, in training and in scoring alike, and texts are read ``PIECE`` characters at a
time, so that texts of any length are read whole in bounded memory. Training uses at most ``SAMPLE`` labelled documents, at
least an eighth of them of each label where there are so many: their stems are counted and their chains cut by Spark, the
chain model is fitted on at most ``CHAINS`` chains, and the curve on the summaries of all of them, set back to the share of
toxic ones among all. Null and empty texts have no tokens and score as the curve's value at nothing. Labels other than 0
and 1 are left out; with no label of one class, all scores are the smoothed share of label 1. Repeated rows get equal
scores and count once in the sample; no ties arise. An empty table gives an empty table. Columns named ``score`` or
``spans`` are replaced, all others pass through.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import no_collection, slices, with_python_columns, written
from .sampling import fit_once, labelled_sample, logistic, probability

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS, SAMPLE, CHAINS, CHAIN, PREFIXES, SUFFIXES, STEPS, RIDGE = 17, 8000, 16_000, 128, (4, 5, 6), (3, 4), 150, 1e-4
#: Characters read at a time; letters of a word that counts as a whole; tokens that a task remembers.
PIECE, WORD, MEMORY = 1_000_000, 64, 200_000
DIMENSIONS = 1 << BITS
LEAST_SUPPORT, CHANCE, MOST_CLEAN, COUNTED = 4, 1e-6, 0.03, 0.2
_NO_LETTER, _TOKEN, _SPACE = re.compile(r"[\W\d_]+"), re.compile(r"\S+"), re.compile(r"\s")


def letters(token: str) -> str:
    return _NO_LETTER.sub("", token.lower())


def beginnings(word: str) -> set[str]:
    return {word[:n] for n in PREFIXES if len(word) >= n} | ({word + "$"} if len(word) <= WORD else set())


def feature_ids(word: str) -> list[int]:
    names = ["=" + word, *("<" + word[:n] for n in PREFIXES if len(word) >= n), *(">" + word[-n:] for n in SUFFIXES if len(word) >= n)]
    return [xxhash.xxh32_intdigest(n) >> (32 - BITS) for n in names if word]


def pieces(text: str | None) -> Iterator[tuple[int, str]]:
    """The text with its offsets, cut at white space after every ``PIECE`` characters."""
    text, at = text or "", 0
    while len(text) - at > PIECE and (space := _SPACE.search(text, at + PIECE)):
        yield at, text[at : space.start()]
        at = space.start()
    yield at, text[at:]


def chains(values: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Columns of CHAIN values, each from one document, and which of them are real."""
    n = np.array(lengths, np.int64)
    rows = -(-n // CHAIN)
    out, real = np.zeros((rows.sum(), CHAIN)), np.zeros((rows.sum(), CHAIN), bool)
    start = np.repeat(np.cumsum(rows * CHAIN) - rows * CHAIN, n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out.ravel()[start + within], real.ravel()[start + within] = values, True
    return out, real


def marginals(score: np.ndarray, real: np.ndarray, move: np.ndarray, with_moves: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Chance of the toxic state for each token and, if asked for, the expected transitions summed over all chains.

    score: log-potential of toxic against clean; move: log-potentials of transitions, row 2 those of the first token.
    With two states, a message is one number: what it says of toxic over what it says of clean.
    """
    up, t = np.exp(np.clip(score.T, -30, 30)), np.exp(move)
    on = np.ascontiguousarray(real.T)
    ahead, back = np.empty_like(up), np.ones_like(up)
    if not score.size:
        return np.zeros_like(score), np.zeros((3, 2))
    ahead[0] = up[0] * (t[2, 1] / t[2, 0])
    for i in range(1, len(up)):
        ahead[i] = up[i] * (t[0, 1] + ahead[i - 1] * t[1, 1]) / (t[0, 0] + ahead[i - 1] * t[1, 0])
    for i in range(len(up) - 2, -1, -1):
        b = back[i + 1] * up[i + 1]
        back[i] = np.where(on[i + 1], (t[1, 0] + b * t[1, 1]) / (t[0, 0] + b * t[0, 1]), 1.0)
    both = ahead * back
    p = np.where(on, both / (1 + both), 0.0)
    if not with_moves:
        return p.T, None
    moves = np.zeros((3, 2))
    moves[2] = [(1 - p[0])[on[0]].sum(), p[0].sum()]
    b, a = back[1:] * up[1:], ahead[:-1]
    each = [np.full_like(a, t[0, 0]), t[0, 1] * b, t[1, 0] * a, t[1, 1] * a * b]
    scale = on[1:] / sum(each)
    moves[:2] = np.array([(e * scale).sum() for e in each]).reshape(2, 2)
    return p.T, moves


class Emissions(dict):
    """Token -> its log-potential."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, token: str) -> float:
        value = float(self.weights[feature_ids(letters(token))].sum() + self.bias)
        if len(self) < MEMORY and len(token) <= WORD:
            self[token] = value
        return value


def least_support(labelled: int, toxic: int) -> float:
    """Toxic documents that a stem must stand in: so many are all toxic by chance with a probability of at most CHANCE."""
    return max(LEAST_SUPPORT, float(np.log(CHANCE) / np.log(min(0.99, max(1, toxic) / max(2, labelled)))))


def toxic_stems(sample: DataFrame, n0: int, n1: int) -> set[str]:
    """Beginnings that mark a word as toxic, from the (text, label) rows of a bounded sample."""

    def run(batches):
        with no_collection():
            for batch in batches:
                for part in slices(batch, ["text"]):
                    for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                        found: set[str] = set()
                        for _, piece in pieces(text):
                            found = found.union(*(beginnings(w) for w in map(letters, set(piece.split())) if w))
                        stems = pa.array(sorted(found), pa.string())
                        yield pa.RecordBatch.from_arrays([stems, pa.array([label] * len(stems), pa.int32())], names=["stem", "label"])

    counts = sample.mapInArrow(run, "stem string, label int").groupBy("stem")
    counts = counts.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    good = (F.col("n1") >= least_support(n0 + n1, n1)) & (F.col("n0") * (n1 / n0) <= MOST_CLEAN * F.col("n1"))
    # Part of the model: stems of a few thousand toxic documents that each stands in several of.
    return {r["stem"] for r in written(counts.filter(good).select("stem"), "stems").collect()}


def labelled_chains(sample: DataFrame, stems: set[str]) -> DataFrame:
    """(tokens, tags, any, mark): the chains of a sample, with one tag byte for each token and a hash that orders chains."""

    def run(batches):
        with no_collection():
            for batch in batches:
                for part in slices(batch, ["text"]):
                    out = []
                    for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                        for _, piece in pieces(text):
                            words = list(map(letters, piece.split()))
                            for i in range(0, len(words), CHAIN):
                                chain = words[i : i + CHAIN]
                                tags = bytes(bool(label and w and not stems.isdisjoint(beginnings(w))) for w in chain)
                                line = " ".join(chain)
                                out.append((line, tags, any(tags), xxhash.xxh64_intdigest(line) >> 1))
                    kinds = (pa.string(), pa.binary(), pa.bool_(), pa.int64())
                    cols = zip(*out, strict=True) if out else ([] for _ in kinds)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["tokens", "tags", "any", "mark"])

    return written(sample.mapInArrow(run, "tokens string, tags binary, any boolean, mark bigint"), "chains")


def fit(tokens: list[str], tags: list[bytes]) -> dict[str, np.ndarray]:
    """Weights of a chain model from chains of letters and the tags of their tokens."""
    rows = sorted(zip(tokens, tags, strict=True))
    kept = [t.split(" ") for t, _ in rows]
    lengths = [len(p) for p in kept]
    vocab = {w: i for i, w in enumerate(sorted({w for p in kept for w in p}))}
    ids = np.array([vocab[w] for p in kept for w in p], np.int64)
    of = [feature_ids(w) for w in vocab]
    word_of, feature = np.repeat(np.arange(len(of)), [len(f) for f in of]), np.array([x for f in of for x in f], np.int64)
    truth, real = chains(np.frombuffer(b"".join(t for _, t in rows), np.uint8).astype(float), lengths)
    gold = np.zeros((3, 2))
    np.add.at(gold, (truth[:, :-1][real[:, 1:]].astype(int), truth[:, 1:][real[:, 1:]].astype(int)), 1)
    np.add.at(gold[2], truth[:, 0][real[:, 0]].astype(int), 1)
    weights, bias, move = np.zeros(DIMENSIONS), 0.0, np.zeros((3, 2))
    scale, bias_scale, move_scale = np.full(DIMENSIONS, 1e-3), 1e-3, np.full((3, 2), 1e-3)
    for _ in range(STEPS if rows else 0):
        per_word = np.bincount(word_of, weights[feature], minlength=len(of)) + bias
        score, _ = chains(per_word[ids], lengths)
        p, moves = marginals(score, real, move)
        off = np.bincount(ids, (truth - p)[real], minlength=len(of))
        up = np.bincount(feature, off[word_of], minlength=DIMENSIONS) - RIDGE * len(kept) * weights
        scale += up**2
        bias_scale += off.sum() ** 2
        move_scale += (gold - moves) ** 2
        weights += 0.5 * up / np.sqrt(scale)
        bias += 0.5 * off.sum() / np.sqrt(bias_scale)
        move += 0.2 * (gold - moves) / np.sqrt(move_scale)
    return {"weights": weights, "bias": np.array(bias), "move": move}


def token_marginals(texts: list[str], emissions: dict, move: np.ndarray) -> list[np.ndarray]:
    """The toxic marginals of the tokens of each text."""
    tokens = [t.split() for t in texts]
    lengths = list(map(len, tokens))
    score, real = chains(np.array([v for ts in tokens for v in map(emissions.__getitem__, ts)], float), lengths)
    return np.split(marginals(score, real, move, with_moves=False)[0][real], np.cumsum(lengths)[:-1])


def read_texts(texts: list[str | None], emissions: dict, move: np.ndarray) -> Iterator[tuple[float, float, list[tuple[int, int, float]]]]:
    """For each text: log of the expected number of toxic tokens that count, largest marginal, and spans."""
    short = [t or "" if len(t or "") <= PIECE else "" for t in texts]
    for text, p in zip(texts, token_marginals(short, emissions, move), strict=True):
        parts = [(0, text or "", p)] if len(text or "") <= PIECE else [(at, x, token_marginals([x], emissions, move)[0]) for at, x in pieces(text)]
        total, top, spans = 0.0, 0.0, []
        for at, piece, q in parts:
            if len(q):
                total, top = total + q[q >= COUNTED].sum(), max(top, float(q.max()))
                if q.max() >= 0.5:
                    spans += [(a + at, b + at, s) for a, b, s in spans_of(piece, q)]
        yield float(np.log1p(total)), top, spans


def spans_of(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
    out: list[tuple[int, int, float]] = []
    last = -2
    for i, m in enumerate(_TOKEN.finditer(text)):
        if p[i] >= 0.5:
            if last == i - 1:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(p[i])))
            else:
                out.append((m.start(), m.end(), float(p[i])))
            last = i
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict[str, np.ndarray]:
    sample, more = labelled_sample(docs, labels, label, SAMPLE)
    n0, n1 = sample.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    prior = (1 + n1) / (2 + n0 + n1)
    nothing = {"weights": np.zeros(DIMENSIONS), "bias": np.array(0.0), "move": np.zeros((3, 2)), "curve": np.array([0.0, 0.0, np.log(prior / (1 - prior))])}
    if not n0 or not n1:
        return nothing
    found = labelled_chains(sample, toxic_stems(sample, n0, n1))
    toxic = found.filter("any").orderBy("mark", "tokens").limit(CHAINS // 2)
    others = found.filter("NOT any").orderBy("mark", "tokens").limit(min(CHAINS // 2, 4 * n1))
    model = fit_once(toxic.union(others), ["tokens", "tags"], fit)

    def summary():
        emissions = Emissions(model["weights"], float(model["bias"]))
        return lambda texts: zip(*[x[:2] for x in read_texts(texts, emissions, model["move"])], strict=True)

    rows = with_python_columns(sample, ["text"], {"total": "double", "top": "double"}, summary).select("total", "top", "label")
    curve = fit_once(rows, ["total", "top", "label"], lambda a, b, y: {"curve": logistic(np.array([a, b]).T, np.array(y, float), ridge=1e-2)})
    return model | {"curve": curve["curve"] + np.array([0.0, 0.0, more])}


def tag(df: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``spans`` (structs start, end, score; offsets in code points)."""
    keep = [c for c in df.columns if c.lower() not in ("score", "spans")]
    schema = T.StructType([f for f in df.schema if f.name in keep])
    schema = T.StructType([*schema, *T.StructType.fromDDL("score double, spans array<struct<start:bigint,end:bigint,score:double>>")])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        with no_collection():
            emissions, move = Emissions(model["weights"], float(model["bias"])), model["move"]
            for batch in batches:
                for part in slices(batch, [text]):
                    read = list(read_texts(part.column(text).to_pylist(), emissions, move))
                    score = probability(np.array([x[:2] for x in read]).reshape(-1, 2), model["curve"])
                    spans = [[dict(zip(("start", "end", "score"), s, strict=True)) for s in x[2]] for x in read]
                    made = [pa.array(score, pa.float64()), pa.array(spans, span)]
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=[*keep, "score", "spans"])

    return df.mapInArrow(run, schema)
