"""Quality scores by positive-unlabelled learning with non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField, StructType

from aisle.llm.spans import Spans, slices, texts_of

_PUNCTUATION = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_CLASSES = np.zeros(256, np.int64)
_CLASSES[list(_PUNCTUATION)] = np.arange(1, 33)
_CLASSES[48:58], _CLASSES[65:91], _CLASSES[97:123] = 33, 34, 35
_CLASSES[128:], _CLASSES[[9, 11, 12, 13, 32]], _CLASSES[10] = 36, 37, 38
_N_CLASSES = 39
_UPPER, _LOWER, _HIGH, _NEWLINE = 34, 35, 36, 38

#: Columns of ``features``: shares of byte classes, then the shape of words and lines.
N_FEATURES = _N_CLASSES + 13


def _by(group: np.ndarray, values: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(group, values, minlength=n).astype(float)


def _distinct(group: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the commonest, per group."""
    if not len(group):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, group))
    g, h = group[order], hashes[order]
    start = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (h[1:] != h[:-1]))))
    count = np.diff(np.append(start, len(g)))
    top = np.zeros(n)
    np.maximum.at(top, g[start], count)
    return _by(g[start], None, n), top


def features(texts: Sequence[bytes]) -> np.ndarray:
    """Row of numbers for each text; only the text enters. An empty text has zeros but for its ratios."""
    n = len(texts)
    spans = Spans(texts)
    sizes = spans.ends - spans.starts
    owner = np.repeat(np.arange(n), sizes)
    kinds = _CLASSES[spans.bytes]
    classes = np.bincount(owner * _N_CLASSES + kinds, minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, :_N_CLASSES] = np.sqrt(classes / sizes[:, None])
    starts, ends, doc = spans.words()
    words = np.maximum(_by(doc, None, n), 1)
    hashes, long = spans.hashes(starts, ends), ends - starts
    distinct, top = _distinct(doc, hashes, n)
    follows = np.zeros(len(doc), bool)
    follows[1:] = doc[1:] == doc[:-1]
    same = follows & (np.roll(hashes, 1) == hashes)
    pairs = spans.hashes(np.roll(starts, 1), ends) if len(starts) else hashes
    pair_distinct, pair_top = _distinct(doc[follows], pairs[follows], n)
    first, last = kinds[starts], kinds[ends - 1]
    before = np.where(long > 1, kinds[np.maximum(ends - 2, 0)], 0)
    marked = lambda k: (k >= 1) & (k <= 32)
    breaks = np.flatnonzero((spans.bytes == 10) | np.isin(np.arange(len(owner)), spans.ends - 1))
    line_start = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else breaks
    line_doc = owner[breaks]
    lines = np.maximum(_by(line_doc, None, n), 1)
    line_distinct, _ = _distinct(line_doc, spans.hashes(line_start, breaks), n)
    out[:, _N_CLASSES:] = np.stack([
        np.log1p(words), np.log1p(sizes / words), _by(doc, long.astype(float) ** 2, n) / words / 100,
        distinct / words, top / words, _by(doc, same, n) / words, pair_distinct / words, pair_top / words,
        _by(doc, marked(last) & marked(before), n) / words, _by(doc, marked(last), n) / words,
        _by(doc, first == _UPPER, n) / words, line_distinct / lines, np.log1p(sizes / lines),
    ], axis=1)
    return out


class Model:
    """One hidden layer on standardised features; ``raw`` is a logit."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.parts = [draw.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden),
                      draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.shift = 0.0

    def _layers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.parts[0] + self.parts[1])
        return z, h, h @ self.parts[2] + self.parts[3][0]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._layers(x)[2]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) + self.shift, -40, 40)))

    def gradient(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Gradient of the sum of losses whose slopes by the logit are given."""
        z, h, _ = self._layers(x)
        back = slope[:, None] * self.parts[2] * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ slope, slope.sum(keepdims=True)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, steps: int = 600,
             batch: int = 2_048, rate: float = 0.01, seed: int = 0) -> Model:
    """Minimise the non-negative unbiased risk ``prior * R+(P) + max(0, R-(U) - prior * R-(P))``.

    Losses are logistic. Where a batch's estimate of the negatives' risk falls
    under zero, the step goes the other way on that part, so that the model does
    not fit the unlabelled rows by heart. Steps are Adam's, batches are drawn by
    a seeded generator, and weights decay a little.
    """
    draw = np.random.default_rng(seed)
    everything = np.concatenate([positive, unlabelled])
    model = Model(everything.mean(0), everything.std(0) + 1e-3, hidden, seed)
    first, second = [np.zeros_like(p) for p in model.parts], [np.zeros_like(p) for p in model.parts]
    for step in range(1, steps + 1):
        p = positive[draw.integers(0, len(positive), batch)]
        u = unlabelled[draw.integers(0, len(unlabelled), batch)]
        gp, gu = model.raw(p), model.raw(u)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        sign = 1.0 if negative >= 0 else -1.0
        toward = sign > 0
        slope_p = -prior * _sigmoid(-gp) * toward - sign * prior * _sigmoid(gp)
        found = [a + b for a, b in zip(
            model.gradient(p, slope_p / batch), model.gradient(u, sign * _sigmoid(gu) / batch), strict=True)]
        pace = rate * (1 - step / (steps + 1))
        for i, g in enumerate(found):
            g = g + 1e-4 * model.parts[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            model.parts[i] = model.parts[i] - pace * (first[i] / (1 - 0.9**step)) / (
                np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.5) -> float:
    """Share of positives among unlabelled rows, from the scores of both.

    In any set of scores, unlabelled rows hold at least the prior's share of the
    positives' share. So the prior is at most the ratio of the two shares above
    any cut; the least ratio over all cuts that leave the share ``least`` of the
    positives is the estimate.
    """
    cuts = np.sort(positive)
    p = 1 - np.arange(len(cuts)) / len(cuts)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    enough = p >= least
    return float(np.clip(u[enough] / p[enough], 0.02, 0.98).min())


def fit_prior_and_risk(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 0) -> tuple[Model | None, float]:
    """Model and estimated prior; no model if either side has fewer than ten rows.

    The prior is the mean of two estimates, each from a first model of one half
    of the rows by its scores of the other half; the final model is fitted on all
    rows with it.
    """
    if min(len(positive), len(unlabelled)) < 10:
        return None, 0.5
    estimates = []
    for half in (0, 1):
        first = fit_risk(positive[half::2], unlabelled[half::2], 0.5, steps=120, seed=seed)
        estimates.append(estimate_prior(first.raw(positive[1 - half :: 2]), first.raw(unlabelled[1 - half :: 2])))
    prior = float(np.mean(estimates))
    return fit_risk(positive, unlabelled, prior, seed=seed), prior


def in_fold(key: Column, folds: int) -> Column:
    """Whether crc32 of the key as text leaves no remainder; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, positives: int = 20_000, unlabelled: int = 20_000,
          key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """Fit on trusted positives (label 1) and rows without a label, outside the held-out fold.

    The fit takes at most ``positives`` and ``unlabelled`` rows, those with the
    lowest hashes of their keys; their features (not their texts) come to the
    driver. Labels of 0 are not used. A key that is labelled both 0 and 1 is no
    trusted positive.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_mark"))
    ids = docs.select(F.col(key).alias("_key")).where(~in_fold(F.col("_key"), folds)).distinct()
    marked = ids.join(marks, "_key", "left")
    order = [F.xxhash64("_key"), F.col("_key")]
    some = [
        marked.where(F.col("_mark") == 1).orderBy(*order).limit(positives).select("_key", F.lit(1).alias("_trusted")),
        marked.where(F.col("_mark").isNull()).orderBy(*order).limit(unlabelled)
        .select("_key", F.lit(0).alias("_trusted")),
    ]
    chosen = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(
        F.broadcast(some[0].unionByName(some[1])), "_key")
    schema = StructType([StructField("trusted", LongType()), StructField("key", LongType()),
                         StructField("x", ArrayType(FloatType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            for low, high in slices([len(t) for t in texts], 500_000):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high].cast(pa.int64()), batch.column(1)[low:high].cast(pa.int64()),
                     pa.array(list(features(texts[low:high])), pa.list_(pa.float32()))], schema=arrow)

    found = chosen.select("_trusted", F.xxhash64("_key").alias("h"), "_text").mapInArrow(run, schema)
    table = found.toArrow().sort_by([("key", "ascending")])
    trusted = table.column("trusted").to_numpy()
    flat = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(-1, N_FEATURES).astype(float)
    model, _ = fit_prior_and_risk(x[trusted == 1], x[trusted == 0])
    return model


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = 0.3,
          keep: Sequence[str] = ()) -> DataFrame:
    """Score every whole text: doc_id, score, predicted, then the columns in ``keep``.

    Only the text enters the score. Null and empty texts are scored like any
    other. Without a model every score is 0.5.
    """
    scores_of = _scorer(model) if model else None
    rows = docs.withColumn("_score", scores_of(F.col(text)) if model else F.lit(0.5))
    return rows.select(F.col(key).alias("doc_id"), F.col("_score").alias("score"),
                       (F.col("_score") >= threshold).cast("int").alias("predicted"), *[c for c in keep if c != key])


def _scorer(model: Model):
    """Column function from texts to scores. Only the text goes to Python, and only the score comes back."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        held = texts_of(texts)
        out = [model.scores(features(held[low:high])) for low, high in slices([len(t) for t in held], 500_000)]
        return pa.array(np.concatenate([*out, np.zeros(0)]), pa.float64())

    return scores
