"""Repetition coverage: how much of a text lies inside repeated n-grams and repeated lines.

Words are hashed once; hashes of n consecutive words roll from the hashes of n-1 words, so all
n-gram lengths cost one pass each in numpy.  A character counts as covered if its word lies in any
n-gram of that length that occurs at least twice in the text.

Results for odd input: a null or empty text has no words, zero counts and coverages of 0, and
fails the length rule; a text of any length is taken whole; repeated rows give equal results; an
empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ASCII_SPACE, slices

SYMBOLS = b"#*$%&|<>"
#: n-gram length -> largest share of characters inside repeated n-grams.  A sound text may quote one
#: long passage twice, so the limits lie above the 0.15 to 0.10 in print for large crawls.
COVERAGE_LIMITS = {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25}
#: Largest share of characters in lines that repeat an earlier line.
LINE_LIMIT = 0.30
MIN_WORDS = 50
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

MEASURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_coverage double, coverage array<double>, base_failed boolean, kept boolean"
)


def repeated(windows: np.ndarray) -> np.ndarray:
    """Marks the windows whose hash occurs at least twice."""
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    out = np.zeros(len(windows), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(marks: np.ndarray, n: int, size: int) -> np.ndarray:
    """Marks the words inside any marked window of n words."""
    edge = np.zeros(size + 1, np.int32)
    edge[: len(marks)] += marks
    edge[n : n + len(marks)] -= marks
    return np.cumsum(edge[:size]) > 0


def measure(text: str, limits: dict[int, float]) -> tuple:
    """The columns of one document, without its id."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, ASCII_SPACE)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    n_dup = dup_chars = line_chars = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            size = len(line)
            line_chars += size
            if line in seen:
                n_dup += 1
                dup_chars += size
            else:
                seen.add(line)
    n_repeat, shares = 0, [0.0] * len(limits)
    if n_words >= 2:
        hashes = np.fromiter(map(hash, words), np.int64, n_words).view(np.uint64) * _MIX
        sizes = None
        rolled = hashes
        for n in range(2, max(3, *limits) + 1):
            if n > n_words:
                break
            rolled = (rolled[:-1] * _STEP) ^ (hashes[n - 1 :] + (rolled[:-1] >> np.uint64(31)))
            if n != 3 and n not in limits:
                continue
            marks = repeated(rolled)
            if not marks.any():
                if n < 3:
                    continue
                break  # a repeated longer n-gram holds a repeated one of n words
            inside = covered(marks, n, n_words)
            if n == 3:
                n_repeat = int(inside.sum())
            if n in limits:
                if sizes is None:
                    # UTF-8 continuation bytes are not characters of their own.
                    sizes = np.fromiter(map(len, words), np.int64, n_words)
                    if len(raw) != len(text):
                        sizes = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n_words)
                shares[list(limits).index(n)] = float(sizes[inside].sum()) / word_chars
    line_share = dup_chars / line_chars if line_chars else 0.0
    failed = n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words
    kept = not failed and line_share <= LINE_LIMIT and all(s <= m for s, m in zip(shares, limits.values()))
    return n_words, word_chars, n_symbols, n_dup, n_repeat, line_share, shares, failed, kept


def repetition_rules(docs: DataFrame, limits: dict[int, float] | None = None) -> DataFrame:
    """Counts, coverages and the verdict of every document (see ``MEASURES``).

    ``limits``: length of n-grams, of 2 words or more, -> largest share of characters inside repeated ones.
    """
    limits = dict(sorted((limits or COVERAGE_LIMITS).items()))
    if min(limits) < 2:
        raise ValueError("n-grams have two words or more")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    types = [pa.int64()] * 5 + [pa.float64(), pa.list_(pa.float64()), pa.bool_(), pa.bool_()]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_coverage", "coverage", "base_failed", "kept"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                columns = zip(*[measure(t, limits) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    return texts.mapInArrow(run, MEASURES)
