"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Minimises  pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))  with the logistic loss over trusted positives P and unlabelled web
text U, for an estimated class prior pi, plus a ridge. With this loss both R_P(+) and the sum of the two parts are convex in the
weights, so the risk is the larger of two convex functions and has one minimum; each step minimises the larger of both with their
slopes at hand and the curvature of their mix, halved where the risk doesn't fall, until no step promises a fall above `TOLERANCE`
(8 to 10 steps in trials). The scorer is additive: every text feature is cut at its corpus quantiles and each bin has a weight.

Scale: a text is read once for its features (one Arrow pass, whole texts); the features, a few numbers for each
document, are written and all statistics come from them by distributed sums over all documents: quantiles, prior,
and for each step the gradients and Hessians of some hundred weights. The driver holds those sums alone.
Quantiles are read off counts on a fixed grid, and what a row adds to a sum is rounded to a power of two that lets the sum
be exact, so a run's scores don't depend on how rows are dealt to tasks or on the order in which tasks end.

The prior comes from P and U alone: U holds pi P and more, so its density over P's is at least pi in every bin of a feature. The prior is
the ratio in the bin where, with `DOUBT` standard errors of P's count added, it is least, among bins with 5% of P. Labelled negatives
train nothing.

Defined results: null counts as an empty text; without trusted positives every score is 0.5, or 0 if there are
labels and all are negative; a document labelled both ways isn't trusted; labels for unknown documents or with a null are ignored; an
empty table gives an empty result; further columns pass through `keep_quality`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.backends import tree_sums
from .common import held_out, materialise, spare_name

THRESHOLD, RIDGE, DOUBT, BINS = 0.3, 3.0, 2.0, 8
#: A step that promises less ends the search; passes over the rows it may take.
TOLERANCE, PASSES = 1e-8, 100
#: Steps of the grid on which quantiles are counted, per unit of a feature.
GRID = 1 << 15
FEATURES = ("size", "upper", "digit", "symbol", "space", "word_len", "distinct", "top_word", "repeat_next", "repeat_line", "repeat_pair", "marked_words", "bare_marks", "shouted", "stops", "line_len")
_UPPER, _DIGIT, _SPACE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c"
_SYMBOL, _STOP = b"#$%&*|<>{}[]\\^~=@_+/!", (b".", b",", b";", b":", b"?")


def features(text: str | None) -> list[float]:
    """The features of one whole text, each from 0 to about 1."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n, words = len(raw), raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    m, counts = len(words), {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    last = [w[-1:] for w in words]
    marked = sum(c in _SYMBOL for c in last)
    return [
        float(np.log1p(n) / 14),
        share(_UPPER),
        share(_DIGIT),
        share(_SYMBOL),
        share(_SPACE),
        min(n / m / 25, 2.0),
        len(counts) / m,
        max(counts.values()) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        1 - len(set(lines)) / len(lines),
        1 - pairs / (m - 1) if m > 1 else 0.0,
        marked / m,
        counts.get(b"|", 0) / m,
        sum(w.isupper() for w in counts) / len(counts),
        sum(c in _STOP for c in last) / m,
        float(np.log1p(n / len(lines)) / 14),
    ]


@dataclass
class QualityModel:
    cuts: list[list[float]] = field(default_factory=list)
    weights: np.ndarray | None = None
    prior: float = 0.5

    def design(self, x: np.ndarray) -> np.ndarray:
        """Rows of x as indices of active weights; 0 is the intercept."""
        cols, at = [np.zeros(len(x), np.int64)], 1
        for i, c in enumerate(self.cuts):
            cols.append(at + np.searchsorted(np.asarray(c), x[:, i], side="left"))
            at += len(c) + 1
        return np.stack(cols, axis=1)

    @property
    def n_weights(self) -> int:
        return 1 + sum(len(c) + 1 for c in self.cuts)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        z = self.weights[self.design(x)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def feature_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), x], ["doc_id", "x"])

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, x array<double>")


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), len(FEATURES))


def fit(table: DataFrame, labels: DataFrame, mod: int = 5, threshold_bins: int = BINS, ridge: float = RIDGE) -> QualityModel:
    """table: (doc_id, x). Uses labels of rows that aren't held out, and as unlabelled text every row that isn't."""
    train = table.filter(~held_out(F.col("doc_id"), mod))
    known = labels.select(F.col("doc_id").alias("known_id"), "quality").filter("quality is not null").groupBy("known_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    train = train.join(known, train["doc_id"] == known["known_id"], "left").select("x", F.coalesce(F.col("low") == 1, F.lit(False)).alias("trusted"), F.col("low").isNotNull().alias("known"))
    train = materialise(train, "pu-train")
    first = train.agg(F.count("*").alias("n"), F.sum(F.col("trusted").cast("long")).alias("p"), F.sum(F.col("known").cast("long")).alias("k")).first()
    n, p, k = first["n"] or 0, first["p"] or 0, first["k"] or 0
    model = QualityModel(prior=0.5 if p or not k else 0.0)
    if not p:
        return model
    model.cuts = _cuts(train, n, [i / threshold_bins for i in range(1, threshold_bins)] + [0.02, 0.05, 0.95, 0.98])
    model.prior = _prior(train, model, n, p)
    model.weights = _minimise(train, model, n, p, ridge)
    return model


def _minimise(train: DataFrame, model: QualityModel, n: int, p: int, ridge: float) -> np.ndarray:
    """Weights of the least risk: of `front` = pi R_P(+) and `front + rest`, the larger, plus the ridge."""
    pi, size = min(max(model.prior, 1e-3), 1 - 1e-3), model.n_weights
    penalty = np.full(size, ridge / n)
    penalty[0] = 0.0

    def risk(w: np.ndarray) -> tuple:
        """The risk, its two parts, their gradients, and the Hessians of their sum and of the first."""
        u_neg, p_pos, p_neg, g_u, g_p, g_pn, h_u, h_p = _risks(train, model, w, n)
        front, rest = pi * p_pos / p, u_neg / n - pi * p_neg / p
        return front + max(rest, 0.0) + 0.5 * (penalty * w * w).sum(), front, rest, pi * g_p / p, g_u / n - pi * g_pn / p, h_u / n, pi * h_p / p

    w, share = np.zeros(size), 1.0  # the share of the larger slope that `rest` has at the kink; 1 where rest is positive
    w[0] = math.log(pi / (1 - pi))
    at, passes = risk(w), 1
    while True:
        value, front, rest, g_front, g_rest, h_both, h_front = at
        for _ in range(4):  # curvature and share suit each other
            curved = share * h_both + (1 - share) * h_front + np.diag(penalty + 1e-6)
            a, b = np.linalg.solve(curved, np.stack([g_front + penalty * w, g_rest], axis=1)).T
            before, share = share, min(max(float((rest - g_rest @ a) / (g_rest @ b)), 0.0), 1.0)
            if abs(share - before) < 1e-6:
                break
        d = -(a + share * b)
        promised = value - front - g_front @ d - max(0.0, rest + g_rest @ d) - 0.5 * (penalty * (w + d) ** 2).sum()
        if promised < TOLERANCE:
            return w
        t = min(1.0, 8 / np.abs(d).max())
        while True:
            at, passes = risk(w + t * d), passes + 1
            if at[0] <= value - 1e-4 * t * promised:
                break
            t /= 2
            if passes >= PASSES or t < 1e-6:
                raise ArithmeticError(f"the risk doesn't settle: {promised} is still promised after {passes} passes")
        w = w + t * d


def _cuts(train: DataFrame, n: int, quantiles: list[float]) -> list[list[float]]:
    """For each feature its quantiles over all rows, up to the next step of the grid: one map-side-combined count by (feature, step).

    Features lie between 0 and 2, so there are at most 2 x GRID steps of each whatever the rows.
    """
    counts = train.select(F.posexplode("x").alias("i", "v")).groupBy("i", F.ceil(F.col("v") * GRID).alias("step")).count()
    upto = counts.withColumn("upto", F.sum("count").over(Window.partitionBy("i").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    ranks = [max(1, math.ceil(q * n)) for q in quantiles]
    rows = upto.groupBy("i").agg(F.array(*[F.min(F.when(F.col("upto") >= r, F.col("step"))) for r in ranks]).alias("steps")).collect()  # a row for each feature
    at = {r["i"]: r["steps"] for r in rows}
    return [sorted({step / GRID for step in at[i]}) for i in range(len(FEATURES))]


def _risks(train: DataFrame, model: QualityModel, w: np.ndarray, n: int):
    """Sums over the n training rows: losses, gradients and Hessians. Each task sends them once, packed, and narrower stages add them up.

    A loss is below 1 + the sum of the largest weights, so multiples of `unit` add up without rounding in any order.
    """
    size = len(w)
    most = 1 + float(np.abs(w).max(initial=0.0)) * (1 + len(model.cuts))
    unit = 2.0 ** (math.ceil(math.log2(max(n, 1))) + math.ceil(math.log2(most)) - 52)
    even = lambda v: np.round(v / unit) * unit

    def sums(b: pa.RecordBatch) -> dict:
        total = np.zeros(3 + 3 * size + 2 * size * size)
        if b.num_rows:
            rows, trusted = model.design(_matrix(b.column("x"))), b.column("trusted").to_numpy(zero_copy_only=False)
            z = w[rows].sum(axis=1)
            s = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            total[0] += even(np.logaddexp(0, z)).sum()
            total[1] += even(np.logaddexp(0, -z[trusted])).sum()
            total[2] += even(np.logaddexp(0, z[trusted])).sum()
            for at, rows_, v in ((3, rows, even(s)), (3 + size, rows[trusted], even(s[trusted] - 1)), (3 + 2 * size, rows[trusted], even(s[trusted]))):
                total[at : at + size] += np.bincount(rows_.ravel(), np.repeat(v, rows_.shape[1]), size)
            pairs, v = (rows[:, :, None] * size + rows[:, None, :]).reshape(len(rows), -1), even(s * (1 - s))
            for at, some in ((3 + 3 * size, slice(None)), (3 + 3 * size + size * size, trusted)):
                total[at : at + size * size] += np.bincount(pairs[some].ravel(), np.repeat(v[some], pairs.shape[1]), size * size)
        return {(0, "sums"): total}

    out = tree_sums(train.select("x", "trusted"), sums).get((0, "sums"), np.zeros(3 + 3 * size + 2 * size * size))
    g = [out[3 + i * size : 3 + (i + 1) * size] for i in range(3)]
    h_u, h_p = out[3 + 3 * size :].reshape(2, size, size)
    return out[0], out[1], out[2], *g, h_u, h_p


def _prior(train: DataFrame, model: QualityModel, n: int, p: int) -> float:
    g_u, g_p = _risks(train, model, np.zeros(model.n_weights), n)[3:5]
    u, pos = 2 * g_u[1:] / n, -2 * g_p[1:] / p  # at zero weights each row counts a half
    u, pos = u[pos > 0.05], pos[pos > 0.05]
    doubtful = u / pos * (1 + DOUBT * np.sqrt((1 - pos) / (pos * p)))
    return float(min(1.0, (u / pos)[doubtful.argmin()])) if len(pos) else 1.0


def scored(table: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) from a feature table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(_matrix(b.column("x"))))], ["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", mod: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    table = materialise(feature_table(docs, doc_id, text), "pu-features")
    model = fit(table, labels, mod)
    return scored(table, model).select("doc_id", held_out(F.col("doc_id"), mod).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", mod: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose own text scores at least the threshold. Features are worked out once and written beside the documents."""
    x = spare_name(docs, "quality_x")

    @F.pandas_udf("array<double>")
    def measured(texts):
        import pandas as pd

        return pd.Series([features(t) for t in texts])

    whole = materialise(docs.withColumn(x, measured(F.col(text))), "pu-docs")
    model = fit(whole.select(F.col(doc_id).alias("doc_id"), F.col(x).alias("x")), labels, mod)

    @F.pandas_udf("double")
    def score(rows):
        import pandas as pd

        return pd.Series(model.score(np.array(rows.tolist(), float).reshape(-1, len(FEATURES))))

    return whole.filter(score(F.col(x)) >= F.lit(threshold)).drop(x)
