"""Sequence packing along a space-filling curve.

Every document becomes a small hashed vector, the vector is projected to three dimensions, the
point's position on a Hilbert curve orders the corpus, and neighbours on the curve are packed into
the same training sequences.  A range sort keeps partitions even, however many copies share a key,
because the document id is part of the sort key; each range is packed where it lies, so there is no
global counter, no driver loop and no second shuffle.

Results for odd input: a null text is an empty document (one token, the separator); repeated rows
are packed once per row; an empty table gives no pieces; columns of the input other than
``doc_id`` and ``text`` play no part, whatever their names.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, text_buffer

DIMENSIONS = 256
AXES = 3
BITS = 10
SEPARATOR = 0
#: White space of the byte-level pattern other than the plain space and the line feed.
_ODD_SPACE = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def hashed_vectors(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors of hashed 4-byte shingles, one row per document."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        part = raw[offsets[lo] : offsets[hi]]
        if len(part) < 4:
            continue
        x = part[:-3].astype(np.uint32)
        x |= part[1:-2].astype(np.uint32) << np.uint32(8)
        x |= part[2:-1].astype(np.uint32) << np.uint32(16)
        x |= part[3:].astype(np.uint32) << np.uint32(24)
        x *= np.uint32(0x9E3779B1)
        x >>= np.uint32(24)
        cuts = np.clip(offsets[lo : hi + 1] - offsets[lo], 0, len(x))
        for k in range(hi - lo):
            own = x[cuts[k] : max(cuts[k], cuts[k + 1] - 3)]
            if len(own):
                out[lo + k] = np.bincount(own, minlength=DIMENSIONS)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def _projection() -> np.ndarray:
    return np.random.default_rng(20240607).standard_normal((DIMENSIONS, AXES)).astype(np.float32)


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points in [0, 2**bits)**d (Skilling's transform)."""
    x = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for k in range(d):
            hit = (x[k] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
        q >>= 1
    for k in range(1, d):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[d - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x = [v ^ turn for v in x]
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(d):
            key = (key << 1) | ((x[k] >> bit) & 1)
    return key


def curve_keys(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as one byte buffer with offsets."""
    low = hashed_vectors(raw, offsets) @ _projection()
    cell = np.clip((np.tanh(low) + 1.0) * 0.5 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_index(cell.astype(np.int64))


def hilbert_key(text: Column) -> Column:
    """The curve position of a text column, as a long."""

    @F.arrow_udf("long")
    def key(column: pa.Array) -> pa.Array:
        raw, offsets = text_buffer(column)
        return pa.array(curve_keys(raw, offsets), pa.int64())

    return key(text)


class ByteCoder:
    """Byte-level BPE ids of whole texts, as packed little-endian unsigned 32-bit integers.

    In a text whose white space is single spaces and line feeds, the byte-level pattern's
    look-ahead cannot matter, so a pattern without it (run by a plain automaton) gives the same
    pieces.  Every other text, and any with a special token's string, goes to the tokenizers
    library as it is.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.whole = Tokenizer.from_file(json_path)
        self.whole.no_truncation()
        self.whole.no_padding()
        tail = r"|\s+(?!\S)|\s+"
        self.fast = pattern.endswith(tail)
        self.quick = tiktoken.Encoding("ranks", pat_str=pattern.removesuffix(tail) + r"|\s", mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = re.compile(_ODD_SPACE)

    def plain(self, text: str) -> bool:
        return self.fast and not (
            "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(s in text for s in self.special) or self.odd.search(text)
        )

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        slow = []
        for k, text in enumerate(texts):
            if self.plain(text):
                out[k] = array("I", self.quick.encode_ordinary(text)).tobytes()
            else:
                slow.append(k)
        for k, e in zip(slow, self.whole.encode_batch([texts[k] for k in slow], add_special_tokens=False)):
            out[k] = array("I", e.ids).tobytes()
        return out


_CODERS: dict[tuple, ByteCoder] = {}


def coder(json_path: str, ranks_path: str, pattern: str) -> ByteCoder:
    """One coder a worker process."""
    key = (json_path, ranks_path, pattern)
    if key not in _CODERS:
        _CODERS[key] = ByteCoder(*key)
    return _CODERS[key]


def tail_lengths(rest: int) -> list[int]:
    """A last, short stretch as sequences whose lengths are powers of two, which need no padding."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    json_path: str,
    ranks_path: str,
    pattern: str,
    length: int = 1024,
    separator: int = SEPARATOR,
) -> DataFrame:
    """Pack documents into sequences of at most ``length`` tokens.

    Returns one row per piece: doc_id, start (tokens of the document before it), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.  A sequence id is the range's
    number shifted by 32 bits plus a count in the range.  Each range ends in sequences whose
    lengths are powers of two; all others are full, so nothing is padded.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("_curve", hilbert_key(F.col("text")))
    ordered = keyed.repartitionByRange("_curve", "doc_id").sortWithinPartitions("_curve", "doc_id")

    def run(batches):
        own = coder(json_path, ranks_path, pattern)
        last = struct.pack("<I", separator)
        base = TaskContext.get().partitionId() << 32
        seq, room, spot = 0, length, 0
        waiting: list[tuple] = []  # pieces of the open sequence: doc_id, start, ids, doc_tokens

        def emit(pieces):
            ids, starts, raws, totals, seqs, offs = zip(*pieces)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array([len(r) // 4 for r in raws], pa.int64()),
                    pa.array(raws, pa.binary()),
                    pa.array(totals, pa.int64()),
                    pa.array(seqs, pa.int64()),
                    pa.array(offs, pa.int64()),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                done: list[tuple] = []
                raws = own.encode(part.column("text").to_pylist())
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), raws):
                    raw += last
                    total, at = len(raw) // 4, 0
                    while at < total:
                        take = min(room, total - at)
                        waiting.append((doc_id, at, raw[4 * at : 4 * (at + take)], total, base | seq, spot))
                        at, spot, room = at + take, spot + take, room - take
                        if not room:
                            done += waiting
                            waiting, seq, room, spot = [], seq + 1, length, 0
                if done:
                    yield emit(done)
        if waiting:
            done = []
            sizes = iter(tail_lengths(spot))
            room, at_seq = next(sizes), 0
            for doc_id, start, raw, total, _, _ in waiting:
                at, n = 0, len(raw) // 4
                while at < n:
                    take = min(room, n - at)
                    done.append((doc_id, start + at, raw[4 * at : 4 * (at + take)], total, base | seq, at_seq))
                    at, at_seq, room = at + take, at_seq + take, room - take
                    if not room:
                        seq, at_seq, room = seq + 1, 0, next(sizes, 0)
            yield emit(done)

    return ordered.select("doc_id", "text").mapInArrow(run, PIECES)
