"""Word-level BPE encoding by a prefix-sharing trie, and decoding.

The BPE encoding of a prefix is fixed by its last token: exactly one vocabulary suffix of the
prefix can follow the encoding of what stands before it without some merge crossing the border.
So the distinct words of a batch form a trie, and a depth-first walk carries the last token of
every prefix down the tree; prefixes that words share are encoded once.  The tokens that end at a
letter come from an automaton over the vocabulary, whose state is carried down beside the token.

Sorted order is the trie's depth-first order, so a node is held only while its subtree is walked:
the path from the root is a stack of two integers a letter, however long a word or a batch is.

Results for odd input: null or empty text has no tokens and decodes to the empty string; repeated
rows are encoded alike; a text's or a word's length is not limited (a word costs a constant number
of steps a letter, times the number of vocabulary suffixes there); an empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import slices

INF = 1 << 60
#: Unicode white space, as the vocabulary's patterns see it (no file or group separators).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of text that share one trie.
BATCH = 4 << 20


def byte_letters() -> list[str]:
    """Printable stand-ins for the 256 bytes in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in shown}
    letters |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class Merges:
    """The merge table: which two tokens may stand side by side in a finished encoding."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.made = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in enumerate(merges)}
        self.lefts: dict[int, list[tuple[int, int]]] = {}
        self.rights: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}

    def edge(self, token: int, side: int, held: dict) -> list[tuple[int, int]]:
        """Tokens at one edge while ``token`` was built, each with the rank that consumed it."""
        found = held.get(token)
        if found is None:
            found, end = [], INF
            at = token
            while True:
                found.append((at, end))
                if at not in self.made:
                    break
                end = self.made[at][2]
                at = self.made[at][side]
            held[token] = found = found[::-1]
        return found

    def stable(self, left: int, right: int) -> bool:
        """No merge crosses the border between the two tokens."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            a, b = self.edge(left, 1, self.rights), self.edge(right, 0, self.lefts)
            i = j = 0
            known = True
            while True:
                (x, x_end), (y, y_end) = a[i], b[j]
                r = self.rank.get((x, y))
                # Equal ranks are merged from left to right: the left token's own merge comes first.
                if r is not None and r < x_end and r <= y_end:
                    known = False
                    break
                if x_end == INF and y_end == INF:
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) < 500_000:
                self.pairs[left << 32 | right] = known
        return known


class Suffixes:
    """Vocabulary suffixes of what was read, longest first: an automaton with failure links."""

    def __init__(self, inner: dict[str, int], final: dict[str, int], most_jumps: int = 500_000):
        self.steps: list[dict[str, int]] = [{}]
        own: list[list] = [[None, None]]
        for side, tokens in enumerate((inner, final)):
            for text, token in tokens.items():
                at = 0
                for letter in text:
                    to = self.steps[at].get(letter)
                    if to is None:
                        self.steps[at][letter] = to = len(self.steps)
                        self.steps.append({})
                        own.append([None, None])
                    at = to
                own[at][side] = (token, len(text))
        n = len(self.steps)
        self.back = [0] * n
        #: Tokens that end here, inside a word and at its end.
        self.inner: list[tuple] = [()] * n
        self.final: list[tuple] = [()] * n
        line = list(self.steps[0].values())
        for at in line:
            for side, out in enumerate((self.inner, self.final)):
                tail = out[self.back[at]]
                out[at] = (own[at][side], *tail) if own[at][side] else tail
            for letter, to in self.steps[at].items():
                self.back[to] = self.step(self.back[at], letter)
                line.append(to)
        self.left = most_jumps

    def step(self, at: int, letter: str) -> int:
        while at and letter not in self.steps[at]:
            at = self.back[at]
        return self.steps[at].get(letter, 0)

    def jump(self, at: int, letter: str) -> int:
        """A step over failure links, remembered while there is room."""
        to = self.step(at, letter)
        if self.left:
            self.left -= 1
            self.steps[at][letter] = to
        return to


class TrieEncoder:
    """Encodes sets of distinct words (already in byte letters)."""

    def __init__(self, merges: Merges, end: str):
        self.m = merges
        inner = {t: k for t, k in merges.vocab.items() if not t.endswith(end)}
        final = {t[: -len(end)]: k for t, k in merges.vocab.items() if t.endswith(end) and t != end}
        self.size = {k: len(t) for t, k in inner.items()}
        self.suffixes = Suffixes(inner, final)

    def encode(self, words) -> list[tuple[str, list[int]]]:
        """(word, ids) in sorted order."""
        steps, jump, inner, final = self.suffixes.steps, self.suffixes.jump, self.suffixes.inner, self.suffixes.final
        pairs, stable, size = self.m.pairs, self.m.stable, self.size
        out: list[tuple[str, list[int]]] = []
        # For every prefix of the word before: its last token and the automaton's state.
        lasts, states, before = array("i", [0]), array("i", [0]), ""
        for word in sorted(words):
            n, keep = len(word), 0
            most = min(n - 1, len(lasts) - 1)
            if before[:most] == word[:most]:
                keep = most
            else:
                while word[keep] == before[keep]:
                    keep += 1
            del lasts[keep + 1 :], states[keep + 1 :]
            state = states[keep]
            for depth in range(keep + 1, n + 1):
                letter = word[depth - 1]
                to = steps[state].get(letter)
                state = jump(state, letter) if to is None else to
                for token, length in inner[state] if depth < n else final[state]:
                    start = depth - length
                    if not start:
                        break
                    known = pairs.get(lasts[start] << 32 | token)
                    if known or known is None and stable(lasts[start], token):
                        break
                else:
                    raise ValueError(f"no token ends at {word[:depth]!r}")
                if depth < n:
                    lasts.append(token)
                    states.append(state)
            ids = [token]
            while start:
                token = lasts[start]
                ids.append(token)
                start -= size[token]
            ids.reverse()
            out.append((word, ids))
            before = word
        return out


class Encoded:
    """Ids of words: places of words in one flat array.  ``new`` is swapped for ``old`` when full."""

    def __init__(self, most: int):
        self.most = most
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])
        self.old_flat, self.old_ends = self.flat, self.ends

    def turn(self) -> None:
        if len(self.new) > self.most // 2:
            self.old, self.old_flat, self.old_ends = self.new, self.flat, self.ends
            self.new, self.flat, self.ends = {}, array("i"), array("q", [0])

    def put(self, word: str, ids) -> None:
        self.new[word] = len(self.ends) - 1
        self.flat.extend(ids)
        self.ends.append(len(self.flat))

    def fetch(self, words: set[str]) -> set[str]:
        """Words that are in neither generation; those of the older one move to the newer."""
        missing = words.difference(self.new)
        kept = missing.intersection(self.old)
        for word in kept:
            at = self.old[word]
            self.put(word, self.old_flat[self.old_ends[at] : self.old_ends[at + 1]])
        return missing - kept


def gather(flat: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` with the given numbers, one after another, and their n+1 ends."""
    starts, sizes = ends[index], ends[index + 1] - ends[index]
    to = np.zeros(len(index) + 1, np.int64)
    np.cumsum(sizes, out=to[1:])
    places = np.arange(to[-1]) + np.repeat(starts - to[:-1], sizes)
    return flat[places], to


class WordCoder:
    """Normalises, splits, encodes and decodes whole texts as the vocabulary file prescribes.

    ``cache`` bounds the words whose ids a worker remembers, in two generations.
    """

    def __init__(self, json_path: str, cache: int = 700_000):
        import regex

        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.trie = TrieEncoder(Merges(model["vocab"], merges), model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        text = {k: t for t, k in model["vocab"].items()} | {k: t for t, k in self.special.items()}
        self.text = pa.array([text.get(k, "") for k in range(max(text) + 1)], pa.string())
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # A line feed, which no chunk holds, is a piece of its own: many chunks are split in one call.
        self.pieces = regex.compile("\n|" + split.replace(r"\s", SPACE), regex.V0)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.mark = re.compile("|".join(sorted({re.escape(s[:2]) for s in self.special})))
        self.odd = re.compile("[\x1c-\x1f]")
        self.gaps = re.compile(f"[{SPACE}]+")
        self.letters = dict(enumerate(byte_letters()))
        self.known = Encoded(cache)

    def split(self, text: str) -> list[str]:
        if self.odd.search(text):
            return [c for c in self.gaps.split(text) if c]
        return text.split()

    def _pieces(self, joined: str) -> list[str]:
        """The words of plain text, line feeds between them."""
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined).replace("Σ", "σ")
        found, table = self.pieces.findall(joined.lower()), self.letters
        return [p if p == "\n" or p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(table) for p in found]

    def words(self, chunks: list[str], marked: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all chunks, and the n+1 ends of each chunk's words.

        In marked chunks a special token's string is a word as it stands.
        """
        found = self._pieces("\n".join(chunks))
        at = np.flatnonzero(np.fromiter((p == "\n" for p in found), bool, len(found)))
        flat = [p for p in found if p != "\n"]
        ends = [np.zeros(1, np.int64), at - np.arange(len(at)), [len(flat)] if chunks else []]
        for chunk in marked:
            for k, piece in enumerate(self.marks.split(chunk)):
                flat += [piece] if k % 2 else self._pieces(piece)
            ends.append([len(flat)])
        return flat, np.concatenate(ends).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after another, and their n+1 ends."""
        split = [self.split(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        chunks = list(dict.fromkeys(chain.from_iterable(split)))
        marked = [c for c in chunks if self.mark.search(c)]
        if marked:
            chunks = [c for c in chunks if not self.mark.search(c)]
        number = dict(zip(chain(chunks, marked), range(len(chunks) + len(marked))))
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        del split, number
        ends = np.zeros(len(texts) + 1, np.int64)
        if not len(at):
            return np.zeros(0, np.int32), ends
        words, parts = self.words(chunks, marked)
        self.known.turn()
        for word in (fresh := self.known.fetch(set(words))).intersection(self.special):
            self.known.put(word, (self.special[word],))
        for word, ids in self.trie.encode(fresh.difference(self.special)):
            self.known.put(word, ids)
        own = np.fromiter(map(self.known.new.__getitem__, words), np.int64, len(words))
        flat, stops = np.frombuffer(self.known.flat, np.int32), np.frombuffer(self.known.ends, np.int64)
        by_word, word_ends = gather(flat, stops, own)
        by_chunk, chunk_ends = gather(by_word, word_ends[parts], at)
        del flat, stops
        np.cumsum(sizes, out=ends[1:])
        return by_chunk, chunk_ends[ends]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The decoded texts: the ids' strings, joined by one space each."""
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.text.take(pa.array(ids)))
        return pc.binary_join(lists, " ")

    def code(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids (packed int32) and the decoded text of each text."""
        ids, ends = self.encode(texts)
        return [(ids[a:b].tobytes(), t) for a, b, t in zip(ends, ends[1:], self.decode(ids, ends).to_pylist())]


_CODERS: dict[str, WordCoder] = {}


def coder(json_path: str) -> WordCoder:
    """One coder a worker process."""
    if json_path not in _CODERS:
        _CODERS[json_path] = WordCoder(json_path)
    return _CODERS[json_path]


def encode_decode(docs: DataFrame, json_path: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (string) of every whole text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        own = coder(json_path)
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                ids, ends = own.encode(part.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, own.decode(ids, ends)], names=["doc_id", "ids", "decoded"])

    return texts.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
