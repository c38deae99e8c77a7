"""Quality classification by positive-unlabelled learning with the non-negative risk.

Trusted positives and unlabelled web text are all that is learned from.  The class prior is estimated
from them: a linear separator of the two, on measures of shape, scores parts it was not fitted on; the
share of unlabelled texts above a score that nearly all positives pass, over the share of positives
that pass it, is the prior, as far as hardly a negative passes.  The
model is a small two-layer net on hashed byte pairs and measures of shape, trained in numpy; where
the estimated negative risk of a batch falls below zero, the step ascends instead of descending.

Fitting uses a bounded sample (``most_positive`` and ``most_unlabelled`` documents, drawn by a
hash of the id, whole texts); scoring reads every whole text.

Results for odd input: null text counts as empty and gets the score of an empty text; without
labels of either kind every score is the prior, 0.5 if unknown; labels that are null or repeated
are ignored or counted per row; an empty table gives an empty result; repeated rows are scored
alike; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_buffer

PAIRS = 512
SHAPE = 12
HIDDEN = 16
THRESHOLD = 0.7


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features a document: square roots of hashed byte-pair shares, and its shape."""
    n = len(offsets) - 1
    out = np.zeros((n, PAIRS + SHAPE), np.float32)
    for k in range(n):
        own = raw[offsets[k] : offsets[k + 1]]
        size = len(own)
        if not size:
            continue
        if size > 1:
            code = own[:-1].astype(np.uint32)
            code <<= np.uint32(8)
            code |= own[1:]
            code *= np.uint32(0x9E3779B1)
            code >>= np.uint32(23)
            out[k, :PAIRS] = np.sqrt(np.bincount(code, minlength=PAIRS) / (size - 1))
        h = np.bincount(own, minlength=256)
        text = own.tobytes()
        spaces = h[32] + h[9:14].sum()
        upper = h[65:91].sum()
        letters = upper + h[97:123].sum() + h[128:].sum()
        marks = size - letters - spaces - h[48:58].sum()
        lines = text.split(b"\n")
        words = text.split()
        packed = len(zlib.compress(text[: 1 << 16], 1)) if size <= 1 << 16 else sum(len(zlib.compress(text[a : a + (1 << 16)], 1)) for a in range(0, size, 1 << 16))
        out[k, PAIRS:] = (
            np.log1p(size),
            upper / max(letters, 1),
            marks / size,
            h[48:58].sum() / size,
            spaces / size,
            1 - len(set(lines)) / len(lines),
            min(packed / size, 1.2),
            h[33] / size,
            (h[35] + h[36] + h[37] + h[38] + h[42]) / size,
            h[124] / size,
            sum(map(eq, words, words[1:])) / max(len(words), 1),
            len(set(words)) / max(len(words), 1),
        )
    return out


def squash(x: np.ndarray) -> np.ndarray:
    """Bounds standardised features; the measures of shape count more than single byte pairs."""
    x = np.clip(x, -8, 8)
    x[:, PAIRS:] *= 3
    return x


class PositiveUnlabelled:
    """Two-layer net fitted to the non-negative positive-unlabelled risk with the logistic loss."""

    def __init__(self, prior: float):
        self.prior = min(max(prior, 0.02), 0.98)
        self.mean = self.scale = None
        self.weights: list[np.ndarray] = []

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b, v, c = self.weights
        hidden = np.maximum(x @ w + b, 0)
        return hidden, hidden @ v + c[0]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, beta: float = 0.0) -> "PositiveUnlabelled":
        rng = np.random.default_rng(5)
        self.mean = unlabelled.mean(0)
        self.scale = unlabelled.std(0) + 1e-3
        p, u = (positive - self.mean) / self.scale, (unlabelled - self.mean) / self.scale
        p, u = squash(p), squash(u)
        d = p.shape[1]
        self.weights = [
            rng.normal(0, d**-0.5, (d, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
            np.zeros(1, np.float32),
        ]
        first, second = [np.zeros_like(a) for a in self.weights], [np.zeros_like(a) for a in self.weights]
        pi, step = self.prior, 0
        rounds = max(1, -(-max(len(p), len(u)) // batch))
        for _ in range(epochs):
            po, uo = rng.permutation(len(p)), rng.permutation(len(u))
            for k in range(rounds):
                a = p[po[np.arange(k * batch, (k + 1) * batch) % len(p)]]
                b = u[uo[np.arange(k * batch, (k + 1) * batch) % len(u)]]
                x = np.concatenate([a, b])
                hidden, g = self._forward(x)
                ga, gb = g[: len(a)], g[len(a) :]
                sa, sb = 1 / (1 + np.exp(-ga)), 1 / (1 + np.exp(-gb))
                negative = np.logaddexp(0, gb).mean() - pi * np.logaddexp(0, ga).mean()
                if negative >= -beta:
                    slope = np.concatenate([pi * (sa - 1) / len(a) - pi * sa / len(a), sb / len(b)])
                else:  # push the negative risk back up
                    slope = -np.concatenate([-pi * sa / len(a), sb / len(b)])
                w, _, v, _ = self.weights
                back = slope[:, None] * v[None] * (hidden > 0)
                grads = [x.T @ back + decay * w, back.sum(0), hidden.T @ slope + decay * v, np.array([slope.sum()])]
                step += 1
                for q, e, m, s in zip(self.weights, grads, first, second):
                    m += 0.1 * (e - m)
                    s += 0.001 * (e * e - s)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior)
        g = self._forward(squash((x - self.mean) / self.scale))[1]
        return 1 / (1 + np.exp(-np.clip(g.astype(np.float64), -40, 40)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 2, passing: float = 0.995, steps: int = 150) -> float:
    """The share of positives among the unlabelled rows, from the distribution of held-out scores."""
    rng = np.random.default_rng(3)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (squash((x - mean) / scale)[:, PAIRS:].astype(np.float64) for x in (positive, unlabelled))
    of_p, of_u = rng.permutation(len(p)) % folds, rng.permutation(len(u)) % folds
    found = []
    for fold in range(folds):
        a, b = p[of_p != fold], u[of_u != fold]
        held, rest = p[of_p == fold], u[of_u == fold]
        if not min(map(len, (a, b, held, rest))):
            continue
        x = np.concatenate([a, b])
        y = np.concatenate([np.ones(len(a)), np.zeros(len(b))])
        weight = np.concatenate([np.full(len(a), 0.5 / len(a)), np.full(len(b), 0.5 / len(b))])
        w, first, second = np.zeros(x.shape[1] + 1), 0.0, 0.0
        for k in range(1, steps + 1):
            slope = weight * (1 / (1 + np.exp(-(x @ w[1:] + w[0]))) - y)
            grad = np.concatenate([[slope.sum()], x.T @ slope + 1e-4 * w[1:]])
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
            w = w - 0.05 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        own, other = held @ w[1:], rest @ w[1:]
        bar = np.quantile(own, 1 - passing)
        found.append((other >= bar).mean() / (own >= bar).mean())
    return float(min(1.0, np.mean(found))) if found else 0.5


def _drawn(docs: DataFrame, most: int, name: str) -> DataFrame:
    total = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(name)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return docs.where(draw < (most / total if total else 1.0))


def _feature_rows(docs: DataFrame) -> np.ndarray:
    """Features of a bounded sample, made on the executors."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(*text_buffer(part.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy(F.xxhash64("doc_id")).select("text").mapInArrow(run, "x binary").collect()
    return np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float32).reshape(-1, PAIRS + SHAPE)


def train(docs: DataFrame, labels: DataFrame, learnable=None, most_positive: int = 2500, most_unlabelled: int = 5000) -> PositiveUnlabelled:
    """Fit on the labels and documents that ``learnable`` (a condition on doc_id) admits.

    Labels other than 1 serve only where there is no positive text: then all scores are their share of ones.
    """
    learnable = F.lit(True) if learnable is None else learnable
    known = labels.where(learnable & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", "quality")
    count = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col("quality").cast("double")), F.lit(0.5)).alias("share")).first()
    model = PositiveUnlabelled(count["share"])
    if not count["n"]:
        return model
    trusted = _drawn(known.where("quality = 1").select("doc_id").distinct(), most_positive, "trusted")
    # The trusted ids are at most about most_positive longs.
    positive = _feature_rows(docs.join(F.broadcast(trusted), "doc_id", "left_semi"))
    unlabelled = _feature_rows(_drawn(docs.where(learnable), most_unlabelled, "web"))
    if len(positive) and len(unlabelled):
        model = PositiveUnlabelled(estimated_prior(positive, unlabelled))
        model.fit(positive, unlabelled)
    return model


def score(docs: DataFrame, model: PositiveUnlabelled) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(*text_buffer(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.score(x).astype(np.float64))], names=["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id long, score double")


def good(docs: DataFrame, model: PositiveUnlabelled, least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(own.score(features(*text_buffer(part.column("text")))) >= least))

    return docs.mapInArrow(run, docs.schema)
