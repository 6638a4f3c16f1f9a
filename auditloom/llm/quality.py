"""Quality classifier from trusted positives and unlabelled text.

Positive-unlabelled learning with the non-negative risk: with class prior
``pi``, risk = pi * E_P[l(+)] + max(0, E_U[l(-)] - pi * E_P[l(-)]). When a
batch's estimate of the negative part falls below zero the step undoes it
instead, so a flexible model can't profit from an impossible risk.

``pi`` is estimated from trusted positives and unlabelled text alone, by the
best bin: a first model tells positives from unlabelled text on one half of
each; on the other halves, the share of unlabelled scores above a threshold
over that of positives bounds ``pi`` from above; the threshold with the least
upper confidence bound is taken, and one standard error off its share.

The model is fitted on the driver from bounded samples of feature vectors:
``POSITIVES`` trusted documents and ``UNLABELLED`` ones to contrast them with,
those with the least hashes of their ids. Labels 0 are never looked at. Every
document is scored on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, let_go
from .textkit import gram_hashes, split_words, text_slices

#: Most documents of either kind that the model is fitted on.
POSITIVES, UNLABELLED = 8_000, 16_000
#: Labels are learnt from these folds only; the remaining one is held out.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 512, 3e-3, 1e-4, 11
#: Epochs of the model that the class prior is read from, and the confidence of its bounds.
PRIOR_EPOCHS, DELTA = 20, 0.1

# Byte classes: control, space, newline, digit, upper, lower, each ASCII symbol by itself, other.
_CLASS = np.zeros(256, np.int64)
_CLASS[9:14] = _CLASS[32] = 1
_CLASS[10] = 2
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 3, 4, 5, 6
_SYMBOLS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_SYMBOLS] = np.arange(7, 7 + len(_SYMBOLS))
CLASSES = 7 + len(_SYMBOLS)
_LENGTHS = (1, 2, 3, 4, 6, 8, 11, 15, 20, 30)
N_FEATURES = CLASSES + len(_LENGTHS) + 14


def features(column: pa.Array) -> np.ndarray:
    """Style features of each text, ``[text, N_FEATURES]``; nothing but the text enters.

    Shares of byte classes, word lengths, upper-case and symbol-ended words,
    repeats of words, word pairs and lines, and logarithms of sizes.
    """
    out = np.zeros((len(column), N_FEATURES), np.float32)
    for first, last, data, offsets in text_slices(column):
        n = last - first
        owner = np.repeat(np.arange(n), np.diff(offsets))
        counts = np.bincount(owner * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
        size = np.maximum(np.diff(offsets), 1)[:, None]
        words = split_words(data, offsets)
        doc, length = words.doc, words.end - words.start
        per = np.maximum(np.diff(words.bounds), 1)
        share = lambda mask: np.bincount(doc[mask], minlength=n) / per  # noqa: B023, E731
        lengths = np.bincount(doc * len(_LENGTHS) + np.searchsorted(_LENGTHS, length, "right") - 1, minlength=n * len(_LENGTHS)).reshape(n, -1)
        kind = _CLASS[data]
        first_kind, last_kind = kind[words.start], kind[words.end - 1]
        upper = np.concatenate([[0], np.cumsum(kind == 4)])
        uppers = upper[words.end] - upper[words.start]
        same = np.zeros(len(doc), bool)
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
        pair = np.zeros(len(doc), bool)
        pair[2:] = (words.hash[2:] == words.hash[:-2]) & (doc[2:] == doc[:-2])
        pairs = gram_hashes(words.hash, 2)
        stops = np.flatnonzero(data == 10)
        rows = np.empty((n, 14))
        for i in range(n):
            lo, hi = int(words.bounds[i]), int(words.bounds[i + 1])
            m = max(hi - lo, 1)
            _, c = np.unique(words.hash[lo:hi], return_counts=True)
            rows[i, 0] = len(c) / m
            rows[i, 1] = c.max(initial=0) / m
            rows[i, 2] = len(np.unique(pairs[lo : max(lo, hi - 1)])) / max(m - 1, 1)
        lines = np.bincount(np.searchsorted(offsets, stops, "right") - 1, minlength=n) + 1
        rows[:, 3] = np.log1p(np.diff(offsets)) / 10
        rows[:, 4] = np.log1p(np.diff(words.bounds)) / 10
        rows[:, 5] = np.log1p(np.diff(words.bounds) / lines) / 5
        rows[:, 6] = share(same)
        rows[:, 7] = share(pair)
        rows[:, 8] = share((uppers >= 2) & (uppers * 2 >= length))
        rows[:, 9] = share(first_kind == 4)
        rows[:, 10] = share(last_kind >= 7)
        rows[:, 11] = share(first_kind >= 7)
        rows[:, 12] = share(length == 1)
        rows[:, 13] = np.bincount(doc, length, n) / per / 20
        out[first:last] = np.concatenate([np.sqrt(counts / size), lengths / per[:, None], rows], axis=1)
    return out


@dataclass
class Model:
    """Standardisation, one hidden layer and an output weight vector."""

    mean: np.ndarray
    scale: np.ndarray
    parts: list[np.ndarray]

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        w1, b1, w2, b2 = self.parts
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled text, by the best bin; one half if either sample is empty."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    rng = np.random.default_rng(SEED)
    halves = [np.array_split(x[rng.permutation(len(x))], 2) for x in (positive, unlabelled)]
    model = fit(halves[0][0], halves[1][0], None, PRIOR_EPOCHS)
    p, u = (np.sort(model.logit(h[1])) for h in halves)
    # Thresholds at positive scores; shares of scores at or above them.
    above_p = 1 - np.arange(len(p)) / len(p)
    above_u = 1 - np.searchsorted(u, p, "left") / len(u)
    slack = np.sqrt(np.log(4 / DELTA) / (2 * len(p))) + np.sqrt(np.log(4 / DELTA) / (2 * len(u)))
    best = int(np.argmin((above_u + slack) / above_p))
    # One standard error below: a prior that is too high hides negatives, one that is a little too low costs nothing.
    share = above_u[best] - np.sqrt(above_u[best] * (1 - above_u[best]) / len(u))
    return float(np.clip(share / above_p[best], 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = EPOCHS) -> Model:
    """Minimise the non-negative risk with logistic loss by mini-batches; without a prior, tell the two samples apart."""
    rng = np.random.default_rng(SEED)
    if not len(unlabelled):
        unlabelled = positive if len(positive) else np.zeros((1, N_FEATURES))
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    d = unlabelled.shape[1]
    parts = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    model = Model(mean, scale, parts)
    if not len(positive):
        parts[2][:], parts[3][:] = 0, 0 if prior is None else np.log(prior / (1 - prior))
        return model
    zp, zu = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    m, v, t = [np.zeros_like(w) for w in parts], [np.zeros_like(w) for w in parts], 0
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    for epoch in range(epochs):
        rate = RATE * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(zu))
        for lo in range(0, len(order), BATCH):
            u, p = zu[order[lo : lo + BATCH]], zp[rng.integers(0, len(zp), BATCH)]
            x = np.concatenate([p, u])
            h = np.tanh(x @ parts[0] + parts[1])
            s = sigmoid(h @ parts[2] + parts[3][0])
            sp, su = s[: len(p)], s[len(p) :]
            # d l(+)/dg = s - 1 and d l(-)/dg = s.
            gp, gu = np.zeros(len(p)), np.zeros(len(u))
            if prior is None:
                gp += (sp - 1) / len(p)
                gu += su / len(u)
            elif prior * np.log1p(-sp + 1e-12).mean() - np.log1p(-su + 1e-12).mean() >= 0:
                gp += prior * (sp - 1) / len(p) - prior * sp / len(p)
                gu += su / len(u)
            else:
                gp += prior * sp / len(p)
                gu -= su / len(u)
            g = np.concatenate([gp, gu])
            back = np.outer(g, parts[2]) * (1 - h * h)
            grads = [x.T @ back + DECAY * parts[0], back.sum(0), h.T @ g + DECAY * parts[2], np.array([g.sum()])]
            t += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                parts[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def held_out(id_col: Column) -> Column:
    """Whether a document's labels may not be learnt."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on bounded samples. Trusted positives come from the training folds; unlabelled text is any document.

    Rows without an id or a label teach nothing, nor does an id that is labelled
    both ways. Of documents that share an id one is taken, whatever their
    number. Without positives every score is one half.
    """
    known = labels.select(F.col("doc_id").alias("_id"), "quality").where(F.col("_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("_id")))
    trusted = known.groupBy("_id").agg(F.min("quality").alias("q")).where("q = 1").select("_id")
    ids = docs.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    chosen = least_hashed(trusted, "_id", POSITIVES).withColumn("_kind", F.lit(1)).union(least_hashed(ids, "_id", UNLABELLED).withColumn("_kind", F.lit(0)))
    chosen = chosen.groupBy("_id").agg(F.max("_kind").alias("_positive"), F.min("_kind").alias("_least"))
    # At most POSITIVES + UNLABELLED ids: a proven bound for the broadcast.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_positive", "_least", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            x = features(batch.column(3))
            packed = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), batch.column(2), packed], ["id", "positive", "least", "x"])

    got = rows.mapInArrow(run, "id string, positive int, least int, x binary").groupBy("id", "positive", "least").agg(F.min("x").alias("x"))
    got = got.orderBy("id").toArrow()  # a row for each chosen id
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)
    positive, least_kind = (got.column(c).to_numpy() for c in ("positive", "least"))
    trusted, unlabelled = x[positive == 1], x[least_kind == 0]
    return fit(trusted, unlabelled, estimate_prior(trusted, unlabelled))


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row; null texts are scored as empty ones."""
    kept = [c for c in docs.columns if c != into]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            scores = model.score(features(batch.column(kept.index(text_col))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*kept, into])

    return docs.select(*kept).mapInArrow(run, f"{fields}, `{into}` double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, those without id or text included.

    Every row is scored by its own text, so repeated rows and ties need no
    rule; only the named columns are read. An empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col)
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
