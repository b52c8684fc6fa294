"""Quality rules: base limits, then robust multivariate outliers for each language and source.

``text_counts`` reads each whole text once. ``fit`` looks, in each group, for the three quarters of the rows whose scatter
of four transformed statistics has the least determinant. From three starts (medians and median deviations; spatial
signs; the mean and covariance of what is near the medians) it takes concentration steps over all rows that pass the base
limits: squared Mahalanobis distances, the group's 0.75 quantile of them (a mergeable sketch), then the mean and covariance
of the rows up to it. Steps never raise the determinant; after ``TRIALS`` steps a group goes on with its best start only,
and stops when the determinant no longer falls. A variance floor on the diagonal (the regularised form of the estimate) keeps
constant statistics from turning every small difference into an outlier. ``judge`` rejects rows beyond a chi-square limit.

Groups are (lang, source); rows of groups with fewer than ``MIN_GROUP`` rows share a group with the like of their
language, and if those are too few, with all such rows. Groups below ``MIN_FIT`` rows reject nothing. Null texts have
no words and so fail the base limits; null lang or source is a value of its own. Texts of any length count whole. Repeated
rows count each and get equal results; rows at equal distances stay or go together, and of equal determinants the start
named first wins. An empty table gives an empty table. Columns named like a new one are replaced, all others pass through.
"""

from __future__ import annotations

import math
import sys
from collections import Counter

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, small, unpacked, with_python_columns, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"
MIN_GROUP, MIN_FIT, SUBSET = 50, 10, 0.75
#: Steps of all starts, and steps at most; a step must lower the log determinant by LEAST_FALL to count.
TRIALS, MOST_STEPS, LEAST_FALL = 2, 40, 1e-6
#: Least standard deviation of each statistic: log mean word length, log symbols per 1000 characters, and the square
#: roots of the shares of repeated lines and of repeated words.
FLOORS = (0.06, 0.6, 0.25, 0.11)
#: Chance that a document of a normal group is rejected.
TAIL = 1e-6
P = len(FLOORS)
XS = [f"x{i}" for i in range(P)]
UPPER = [(i, j) for i in range(P) for j in range(i, P)]
NEW = (*COUNTS, "base_failed", "distance2", "kept")


def count_text(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of a whole text. Words are runs of anything but ASCII white space."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeat = 0
    if len(set(grams)) < len(grams):
        often = {g for g, c in Counter(grams).items() if c > 1}
        upto = 0
        for i, g in enumerate(grams):
            if g in often:
                repeat += i + 3 - max(i, upto)
                upto = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add COUNTS and ``base_failed``: fewer than 50 words, or over half of them in repeated three-word windows."""

    def make():
        return lambda texts: zip(*map(count_text, texts), strict=True)

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return with_python_columns(df, [text], dict.fromkeys(COUNTS, "bigint"), make).withColumn("base_failed", failed)


def statistics() -> list:
    """The transformed statistics of COUNTS, as columns."""
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return [
        F.log(chars / words),
        F.log1p(1000 * F.col("n_symbols") / chars),
        F.sqrt(20 * F.col("n_dup_lines") / (words + 20)),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def _key(*cols: str):
    """A text for values of columns that keeps null apart from any string."""
    return F.concat_ws("\x1f", *[F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(c))) for c in cols])


def chi2_below(x: float, p: int) -> float:
    """Chi-square distribution function for an even p."""
    term, total = 1.0, 0.0
    for i in range(p // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, p) < q else (low, mid)
    return high


def _distance(values: list):
    """Squared Mahalanobis distance from columns ``mu`` and ``inv`` (row-major)."""
    off = [v - F.col("mu")[i] for i, v in enumerate(values)]
    return sum(off[i] * off[j] * F.col("inv")[i * P + j] for i in range(P) for j in range(P))


def regularised(cov: np.ndarray, factor: float) -> tuple[np.ndarray, float]:
    """The inverse of a covariance, scaled to the whole group and with the floors on its diagonal, and its log determinant."""
    k = cov * factor + np.diag(np.square(FLOORS))
    return np.linalg.inv(k), float(np.linalg.slogdet(k)[1])


def _inverted(params: DataFrame, factor: float) -> DataFrame:
    """Add ``inv`` and ``logdet`` of ``cov`` (upper triangle)."""

    def make():
        def one(upper):
            cov = np.zeros((P, P))
            cov[tuple(zip(*UPPER, strict=True))] = upper
            inv, logdet = regularised(cov + np.triu(cov, 1).T, factor)
            return inv.ravel().tolist(), logdet

        return lambda covs: zip(*map(one, covs), strict=True)

    return with_python_columns(params, ["cov"], {"inv": "array<double>", "logdet": "double"}, make).drop("cov")


def _moments(z: list, where=None) -> list:
    """Aggregates m0.. and s00..: means of z and of its products, where a condition holds."""
    only = (lambda v: F.when(where, v)) if where is not None else lambda v: v
    return [*[F.avg(only(v)).alias(f"m{i}") for i, v in enumerate(z)], *[F.avg(only(z[i] * z[j])).alias(f"s{i}{j}") for i, j in UPPER]]


def _centre(scale: list | None = None) -> list:
    """``mu`` and ``cov`` from moments about the old ``mu`` (in units of ``scale``)."""
    by = scale or [F.lit(1.0)] * P
    mu = F.array(*[F.col("mu")[i] + by[i] * F.coalesce(f"m{i}", F.lit(0.0)) for i in range(P)])
    cov = [by[i] * by[j] * F.coalesce(F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"), F.lit(0.0)) for i, j in UPPER]
    return [mu.alias("mu"), F.array(*cov).alias("cov")]


def group_sizes(slim: DataFrame) -> DataFrame:
    """Where each fine group is estimated: (fine, grp)."""
    sizes = slim.groupBy("fine", "coarse").agg(F.count("*").alias("n"))
    pooled = sizes.filter(F.col("n") < MIN_GROUP).groupBy("coarse").agg(F.sum("n").alias("pooled"))
    grp = (
        F.when(F.col("n") >= MIN_GROUP, F.concat(F.lit("s"), "fine"))
        .when(F.col("pooled") >= MIN_GROUP, F.concat(F.lit("l"), "coarse"))
        .otherwise("all")
    )
    return written(sizes.join(pooled, "coarse", "left").select("fine", grp.alias("grp")), "groups")


def starts(rows: DataFrame) -> DataFrame:
    """(grp, start, mu, inv, logdet): three first estimates of each group with MIN_FIT rows."""
    quantile = lambda v: F.percentile_approx(v, 0.5, 10_000)
    middle = rows.groupBy("grp").agg(F.count("*").alias("n"), *[quantile(x).alias(f"c{x}") for x in XS]).filter(F.col("n") >= MIN_FIT)
    middle = small(written(middle.select("grp", F.array(*[f"c{x}" for x in XS]).alias("mu")), "medians"))
    off = rows.join(middle, "grp").select("grp", *[(F.col(x) - F.col("mu")[i]).alias(x) for i, x in enumerate(XS)])
    wide = off.groupBy("grp").agg(*[quantile(F.abs(x)).alias(f"w{x}") for x in XS])
    width = [F.greatest(1.4826 * F.col(f"w{x}"), F.lit(f)) for x, f in zip(XS, FLOORS, strict=True)]
    wide = small(written(wide.select("grp", F.array(*width).alias("width")), "widths"))
    z = [F.col(x) / F.col("width")[i] for i, x in enumerate(XS)]
    length = F.sqrt(sum(v * v for v in z))
    sign = [F.when(length > 0, v / length).otherwise(0.0) for v in z]
    near = F.greatest(*[F.abs(v) for v in z]) <= 2
    scaled = off.join(wide, "grp")
    base = middle.join(wide, "grp")
    by = [F.col("width")[i] for i in range(P)]
    apart = F.array(*[by[i] * by[j] if i == j else F.lit(0.0) for i, j in UPPER])
    signs = scaled.groupBy("grp").agg(*_moments(sign)).join(base, "grp")
    trimmed = scaled.groupBy("grp").agg(*_moments(z, near)).join(base, "grp")
    spatial = F.array(*[P * by[i] * by[j] * F.col(f"s{i}{j}") for i, j in UPPER])
    first = base.select("grp", F.lit(0).alias("start"), "mu", apart.alias("cov"))
    first = first.unionByName(signs.select("grp", F.lit(1).alias("start"), "mu", spatial.alias("cov")))
    first = first.unionByName(trimmed.select("grp", F.lit(2).alias("start"), *_centre(by)))
    # No subset's determinant yet: the first step counts as an improvement.
    return written(_inverted(first, 1.0).withColumns({"logdet": F.lit(float("inf")), "open": F.lit(True)}), "starts")


def concentrated(rows: DataFrame, state: DataFrame, factor: float) -> DataFrame:
    """One concentration step of all open estimates; those that it doesn't improve stay as they are and are closed."""
    going = small(written(state.filter("open"), "open"))
    far = rows.join(going.select("grp", "start", "mu", "inv"), "grp").withColumn("d2", _distance([F.col(x) for x in XS]))
    cuts = written(far.groupBy("grp", "start").agg(F.percentile_approx("d2", SUBSET, 10_000).alias("cut")), "cuts")
    z = [F.col(x) - F.col("mu")[i] for i, x in enumerate(XS)]
    inner = far.join(small(cuts), ["grp", "start"]).filter(F.col("d2") <= F.col("cut"))
    moved = inner.groupBy("grp", "start").agg(*_moments(z)).join(going.select("grp", "start", "mu", F.col("logdet").alias("before")), ["grp", "start"])
    moved = _inverted(moved.select("grp", "start", "before", *_centre()), factor)
    better = moved.filter(F.col("logdet") < F.col("before") - LEAST_FALL).drop("before").withColumn("open", F.lit(True))
    better = written(better, "better")
    return written(better.unionByName(state.join(small(better.select("grp", "start")), ["grp", "start"], "left_anti").withColumn("open", F.lit(False))), "state")


def best_start(state: DataFrame) -> DataFrame:
    """The estimate of least determinant of each group."""
    best = state.groupBy("grp").agg(F.min(F.struct("logdet", "start")).alias("b")).select("grp", "b.start")
    return written(state.join(best, ["grp", "start"]), "state")


def fit(counted: DataFrame) -> DataFrame:
    """(fine, mu, inv) for each (lang, source) that can be judged, from columns lang, source, COUNTS and base_failed."""
    slim = written(
        counted.filter(~F.col("base_failed")).select(
            _key("lang", "source").alias("fine"), _key("lang").alias("coarse"), *[s.alias(x) for s, x in zip(statistics(), XS, strict=True)]
        ),
        "statistics",
    )
    where = group_sizes(slim)
    rows = written(slim.join(small(where), "fine").select("grp", *XS), "grouped")
    cut = chi2_quantile(SUBSET, P)
    factor = SUBSET / chi2_below(cut, P + 2)
    state = starts(rows)
    for step in range(1, MOST_STEPS + 1):
        state = concentrated(rows, state, factor)
        if step == TRIALS:
            state = best_start(state)
        if step >= TRIALS and state.filter("open").isEmpty():
            break
    return written(where.join(state.select("grp", "mu", "inv"), "grp").select("fine", "mu", "inv"), "params")


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", with_text: bool = True) -> DataFrame:
    """Add COUNTS, ``base_failed``, ``distance2`` (null where a group is too small) and ``kept``.

    Counts are written with their rows, so that texts are read once; ``with_text=False`` leaves the texts out of the result.
    """
    inner = {"lang": lang, "source": source} | {"text": text}
    counted = text_counts(packed(df, inner, NEW))
    if not with_text:
        inner.pop("text")
        df, counted = df.drop(text), counted.drop("text")
    counted = written(counted, "counted")
    out = counted.withColumn("fine", _key("lang", "source")).join(small(fit(counted)), "fine", "left").withColumn("distance2", _distance(statistics()))
    limit = chi2_quantile(1 - TAIL, P)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= limit))
    return unpacked(out, df, inner, NEW)
