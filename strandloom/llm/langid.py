"""Language identification by a byte convolutional network trained in numpy.

Filters of several widths slide over the bytes of fixed-length windows; each filter's largest
response in a window feeds a softmax over the languages.  A text is cut into windows that cover
all of it, windows are scored in batches, and a document's score is the mean of its windows'
probabilities, weighted by their lengths.

The net is fitted on a bounded sample (``per_language`` documents of each language, one stretch of
``TRAIN_BYTES`` characters at a hashed place of each); scoring reads every byte of every text.

Results for odd input: null or empty texts, and texts without a letter, are ``und`` with score 0;
an empty table gives an empty result; without any labelled text everything is ``und``; repeated
rows are scored alike; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, text_buffer

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
TRAIN_BYTES = 400
UND = "und"


class ByteNet:
    """Embedding, multi-width convolutions, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)
        self.tables: list | None = None

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01) -> "ByteNet":
        """Adam on the cross entropy; windows is (n, WINDOW) bytes."""
        rng = np.random.default_rng(11)
        params = self.params()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                grads = self._gradients(windows[pick], labels[pick])
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, length = x.shape
        e = self.embed[x]
        flat, pooled, where = e.reshape(n, length * EMBED), [], []
        views = []
        for w, f in zip(WIDTHS, self.filters):
            view = np.lib.stride_tricks.sliding_window_view(flat, w * EMBED, axis=1)[:, ::EMBED]
            response = view @ f
            at = response.argmax(axis=1)
            views.append(view)
            where.append(at)
            pooled.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0])
        raw = np.concatenate(pooled, 1) + self.bias
        hidden = np.maximum(raw, 0)
        logits = hidden @ self.out + self.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.out.T) * (raw > 0)
        d_embed = np.zeros_like(self.embed)
        d_filters = []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            picked = views[k][np.arange(n)[:, None], where[k]]
            d_filters.append(np.einsum("nfi,nf->if", picked, g))
            d_in = (g[:, :, None] * f.T[None]).reshape(n, FILTERS, w, EMBED)
            spots = x[np.arange(n)[:, None, None], where[k][:, :, None] + np.arange(w)]
            np.add.at(d_embed, spots.ravel(), d_in.reshape(-1, EMBED))
        return [d_embed, *d_filters, back.sum(0), hidden.T @ p, p.sum(0)]

    def prepare(self) -> "ByteNet":
        """Tables of the convolutions' products, by pairs of neighbouring bytes.

        A response of width four is the sum of two table rows, one for each pair of bytes; widths
        two and three are the same with nothing for the bytes beyond.
        """
        first, second = [], []
        for w, f in zip(WIDTHS, self.filters):
            t = [self.embed @ f[j * EMBED : (j + 1) * EMBED] for j in range(w)] + [np.zeros((256, FILTERS), np.float32)] * (4 - w)
            first.append((t[0][:, None, :] + t[1][None, :, :]).reshape(-1, FILTERS))
            second.append((t[2][:, None, :] + t[3][None, :, :]).reshape(-1, FILTERS))
        self.tables = [np.ascontiguousarray(np.concatenate(first, 1)), np.ascontiguousarray(np.concatenate(second[1:], 1))]
        return self

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax outputs of (n, WINDOW) bytes."""
        n, length = windows.shape
        code = windows[:, :-1].astype(np.intp) * 256 + windows[:, 1:]
        total = self.tables[0].take(code[:, : length - 3], axis=0)
        total[:, :, FILTERS:] += self.tables[1].take(code[:, 2:], axis=0)
        pooled = [total.max(axis=1)]
        hidden = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        logits = hidden @ self.out + self.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def documents(self, raw: np.ndarray, offsets: np.ndarray, batch: int = 256) -> np.ndarray:
        """Mean probabilities of documents given as one buffer; the last window of each is padded."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        counts = np.maximum(1, -(-sizes // WINDOW))
        owner = np.repeat(np.arange(n), counts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        start = offsets[:-1][owner] + WINDOW * (np.arange(len(owner)) - first[owner])
        end = np.minimum(start + WINDOW, offsets[1:][owner])
        total = np.zeros((n, len(self.languages)))
        padded = np.concatenate([raw, np.full(WINDOW, 32, np.uint8)])
        for at in range(0, len(owner), batch):
            s, e = start[at : at + batch], end[at : at + batch]
            grid = s[:, None] + np.arange(WINDOW)
            x = padded[np.minimum(grid, len(padded) - 1)]
            x[grid >= e[:, None]] = 32
            np.add.at(total, owner[at : at + batch], self.probabilities(x) * np.maximum(e - s, 1)[:, None])
        return total / np.maximum(sizes, 1)[:, None]


def sample(docs: DataFrame, per_language: int, learnable) -> tuple[list[str], list[str]]:
    """A bounded, hashed sample of labelled stretches of text."""
    labelled = docs.where(learnable & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    place = 1 + F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - TRAIN_BYTES))
    rows = labelled.where(draw < F.element_at(share, F.col("lang"))).select("lang", F.col("text").substr(place.cast("int"), F.lit(TRAIN_BYTES)).alias("part")).collect()
    return [r["lang"] for r in rows], [r["part"] for r in rows]


def train(docs: DataFrame, per_language: int = 500, learnable=None) -> ByteNet | None:
    """Fit the net on a sample of ``docs`` (columns doc_id, text, lang)."""
    langs, parts = sample(docs, per_language, F.lit(True) if learnable is None else learnable)
    if not langs:
        return None
    languages = sorted(set(langs))
    rng = np.random.default_rng(3)
    windows, labels = [], []
    for lang, part in sorted(zip(langs, parts)):
        raw = part.encode()[:TRAIN_BYTES]
        for piece in (raw[:WINDOW], raw[-(24 + int(rng.integers(120))) :]):
            if piece:
                windows.append(np.frombuffer(piece.ljust(WINDOW, b" "), np.uint8))
                labels.append(languages.index(lang))
    return ByteNet(languages).fit(np.array(windows), np.array(labels)).prepare()


def _scored(net: ByteNet | None, docs: DataFrame):
    """A function from a string column to (labels, scores), for use on executors."""
    shared = docs.sparkSession.sparkContext.broadcast(None if net is None else (net.languages, net.params()))
    held: dict[str, ByteNet] = {}

    def scored(column: pa.Array) -> tuple[list[str], list[float]]:
        texts = column.to_pylist()
        letters = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        if shared.value is None:
            return [UND] * len(texts), [0.0] * len(texts)
        if "net" not in held:
            languages, params = shared.value
            own = held["net"] = ByteNet(languages)
            own.embed, *own.filters, own.bias, own.out, own.out_bias = params
            own.prepare()
        p = held["net"].documents(*text_buffer(column))
        best = p.argmax(1)
        names = held["net"].languages
        return (
            [names[b] if ok else UND for b, ok in zip(best, letters)],
            [float(min(1.0, p[k, b])) if ok else 0.0 for k, (b, ok) in enumerate(zip(best, letters))],
        )

    return scored


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = _scored(net, docs)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                labels, scores = scored(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, net: ByteNet | None, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more."""
    scored = _scored(net, docs)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                labels, scores = scored(part.column("text"))
                yield part.filter(pa.array([label != UND and s >= least for label, s in zip(labels, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
