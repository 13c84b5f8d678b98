"""Byte-pair encoding and decoding, equal to a ``tokenizers`` file that lower-cases and marks word ends.

A text is cut at white space into pieces (a word-end vocabulary never joins across white space), pieces into
words by the file's pattern. A worker keeps the ids of pieces it has met in a bounded cache. A long unsplit
word is encoded as a tree: its halves on their own, down to short leaves, then windows around each join are
encoded anew and grow until one whole token agrees with the left half and one with the right half. Neighbouring
tokens then always merge to themselves, which characterises the one encoding of the whole word.

Defined results: a null text counts as the empty one (no ids, empty decoded text); repeated rows give repeated
results; null ids of rows stay null; other columns of the input are ignored; no length is limited.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest word in bytes that is encoded at once; bytes on each side of a join in its first window.
LEAF, WINDOW = 64, 24
#: Pieces that a worker's cache holds before it starts anew, and the longest that goes into it.
CACHE, CACHED_LENGTH = 400_000, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Pieces(dict):
    """Piece to its ids and its tokens, each joined by spaces; None for pieces without a token."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[str, str] | None:
        ids = self.bpe.piece(piece)
        found = (" ".join(map(str, ids)), self.bpe.decode(ids)) if ids else None
        if len(piece) <= CACHED_LENGTH:
            self[piece] = found
        return found


class WordBpe:
    """A tokenizer file with word ends (``</w>``), NFC, lower case and a splitting pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.mark = os.path.commonprefix(list(self.special))
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.pieces = _Pieces(self)

    # -- one word -----------------------------------------------------------------------------------------

    def merge(self, ids: list[int]) -> list[int]:
        """Applies the merge of lowest rank, leftmost first, until none applies; for short inputs."""
        rank, none = self.rank, (1 << 60, -1)
        ids = list(ids)
        ranks = [rank.get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            ids[i] = best[1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), none)
        return ids

    def sizes(self, ids: list[int]) -> list[int]:
        """The bytes that each id of a word stands for."""
        return [len(t) - len(self.end) * t.endswith(self.end) if self.end else len(t) for t in (self.names[i] for i in ids)]

    def tree(self, symbols: list[int]) -> list[int]:
        """The encoding of one long unsplit word, given as one id a byte; levels are joined bottom up."""
        parts = [(at, self.merge(symbols[at : at + LEAF])) for at in range(0, len(symbols), LEAF)]
        while len(parts) > 1:
            joined = [(a[0], self.join(symbols, a[0], a[1], b[0], b[1])) for a, b in zip(parts[::2], parts[1::2])]
            parts = joined + parts[len(joined) * 2 :]
        return parts[0][1]

    def join(self, symbols: list[int], start: int, left: list[int], mid: int, right: list[int]) -> list[int]:
        """Exact encoding of two neighbouring parts of a word from those of each."""
        stop = mid + sum(self.sizes(right))
        reach = WINDOW
        while True:
            n_left, lo = self._edge(left[::-1], reach)
            n_right, hi = self._edge(right, reach)
            lo, hi = mid - lo, mid + hi
            window = self.merge(symbols[lo:hi]) if hi - lo <= 8 * LEAF else self.merge_heap(symbols[lo:hi])
            whole_left, whole_right = lo == start, hi == stop
            ok_left = whole_left or window[0] == left[len(left) - n_left]
            ok_right = whole_right or window[-1] == right[n_right - 1]
            if ok_left and ok_right and (len(window) > 1 or (whole_left and whole_right)):
                return left[: len(left) - n_left] + window + right[n_right:]
            reach *= 2

    def _edge(self, ids: list[int], reach: int) -> tuple[int, int]:
        """So many of the first ids that they cover reach bytes (or all), and the bytes they cover."""
        n = total = 0
        for n, size in enumerate(self.sizes(ids[: reach + 1]), 1):
            total += size
            if total >= reach:
                break
        return n, total

    def merge_heap(self, ids: list[int]) -> list[int]:
        """As merge, in n log n steps, for windows that have grown."""
        import heapq

        n, rank = len(ids), self.rank
        ids, nxt, prv, heap = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            if p := rank.get((ids[i], ids[i + 1])):
                heap.append((p[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank[a, b][1], -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (p := rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (p[0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return self.merge(symbols) if len(symbols) <= LEAF else self.tree(symbols)

    # -- texts --------------------------------------------------------------------------------------------

    @staticmethod
    def normalize(text: str) -> str:
        """NFC, then each character's own lower case (no rule for a final sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def piece(self, piece: str) -> list[int]:
        """The ids of a piece without white space (or with white space that the pattern drops)."""
        return [i for w in self.pattern.findall(self.normalize(piece)) for i in self.word(w)]

    def _plain(self, text: str) -> list[tuple[str, str]]:
        """Per piece its ids as decimals and its tokens, each joined by spaces; pieces without a token are left out."""
        # str.split() also cuts at U+001C..U+001F, which the pattern doesn't hold for white space
        pieces = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else regex.split(r"[\s--[\x1c-\x1f]]+", text, flags=regex.V1)
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        return [x for x in map(self.pieces.__getitem__, pieces) if x]

    def _all(self, text: str) -> list[tuple[str, str]]:
        """As _plain for a whole text; strings of special tokens give their ids."""
        if self.mark not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append((str(self.special[m[0]]), m[0]))
            at = m.end()
        return out + self._plain(text[at:])

    def round_trip(self, text: str) -> tuple[str, str]:
        """The ids of a whole text as decimals joined by one space, and the text decoded from them."""
        found = self._all(text)
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found])

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in self._all(text) for i in x[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """As the library does where a file names no decoder: the tokens joined by one space."""
        return " ".join(self.names[i] for i in ids)


_MODELS: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    """One per worker and file."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "")
                yield pa.RecordBatch.from_pylist([{"doc_id": i.as_py(), "ids": ids, "decoded": bpe.decode(ids)}], schema=_SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like encode, with the count of ids and SHA-256 of ids and decoded text in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for b in batches:
            n, a, d = [], [], []
            for text in b.column(1):
                joined, decoded = bpe.round_trip(text.as_py() or "")
                n.append(joined.count(" ") + 1 if joined else 0)
                a.append(hashlib.sha256(joined.encode()).hexdigest())
                d.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
