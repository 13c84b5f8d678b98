"""Packing of tokenised documents into training sequences by cutting-stock column generation.

1. Every document is tokenised whole and gets an end id. It is cut into full sequences and one rest, so each id
   lies in exactly one piece and at most one piece of a document is shorter than a sequence.
2. The histogram of piece lengths, in classes of WIDTH tokens, goes to the driver (at most capacity / WIDTH
   counts, however large the input). A linear program over patterns (how many pieces of each class share a
   sequence) is solved by column generation: the duals of the classes price new patterns by a knapsack dynamic
   program. Pattern counts are rounded down, what is left is packed first-fit decreasing.
3. Pieces are ranked within their class (in salted parts, so that no class meets in one task) and rank r takes
   the r-th place that the patterns hold for its class.

Defined results: a null or empty text is one piece of one id (the end id); repeated rows are packed each on
their own; null ids of documents stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import cut, give_back, shared_dir, small_batches

#: Tokens of a class of lengths; pieces that share a salted part of a class, about.
WIDTH, PART = 16, 50_000
#: Segments that a worker's cache holds before it starts anew, and the longest that goes into it.
CACHE, CACHED_LENGTH = 100_000, 64
#: Texts of more characters are looked through for runs of white space of so many; the pattern's engine recurses on them.
LONG, RUN = 5000, 1000
#: Unicode's White_Space, as the pattern's \\s.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Segments(dict):
    """Segment after a single space to the bytes of its ids; None where white space at an end could join its neighbours."""

    def __init__(self, core):
        super().__init__()
        self.core = core

    def __missing__(self, seg: str) -> bytes | None:
        if seg.isascii() and seg.isalpha():  # one token of the pattern
            found = _bytes(self.core.encode_single_piece(b" " + seg.encode()))
        else:
            found = None if not seg or seg[0].isspace() or seg[-1].isspace() else _bytes(self.core.encode_ordinary(" " + seg))
        if len(seg) <= CACHED_LENGTH:
            self[seg] = found
        return found


class ByteBpe:
    """Ids of a byte-level tokenizer file, as little-endian unsigned 32-bit integers.

    Single spaces between other characters always begin a token of the file's pattern, so segments between them
    are encoded apart and kept; a text in which spaces touch other white space is encoded at once. A long run of white
    space is cut out first: it is one piece of the pattern, but for its last character where something follows.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = encoding.encode_ordinary
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.mark = os.path.commonprefix(list(self.special))
        self.core = encoding._core_bpe
        self.segments = _Segments(self.core)

    def _part(self, text: str) -> bytes:
        if len(text) <= LONG:
            return self._short(text)
        out, at = [], 0
        for m in _BLANKS.finditer(text):
            end = m.end() - (m.end() < len(text))
            if end - m.start() >= RUN:
                out += [self._short(text[at : m.start()]), _bytes(self.core.encode_single_piece(text[m.start() : end].encode()))]
                at = end
        return b"".join([*out, self._short(text[at:])])

    def _short(self, text: str) -> bytes:
        if len(self.segments) > CACHE:
            self.segments.clear()
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            found = list(map(self.segments.__getitem__, rest))
            if None not in found:
                return _bytes(self.plain(first)) + b"".join(found)
        return _bytes(self.plain(text))

    def encode(self, text: str) -> bytes:
        if self.mark not in text:
            return self._part(text)
        return b"".join(_bytes([self.special[p]]) if p in self.special else self._part(p) for p in self.split.split(text) if p)


_MODELS: dict[str, ByteBpe] = {}


def model(path: str) -> ByteBpe:
    if path not in _MODELS:
        _MODELS[path] = ByteBpe(path)
    return _MODELS[path]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = model(path), int(end_id).to_bytes(4, "little")
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    for column, x in zip(rows, (i, at, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        bpe.segments.clear()  # what a worker remembers ends with its task
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


# -- the linear program ---------------------------------------------------------------------------------------


def price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best value of sizes that fit in room together (any number of each), and how many of each."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        best[w], took[w] = best[w - 1], -1
        n = np.searchsorted(sizes, w, "right")
        if n:
            value = best[w - sizes[:n]] + duals[:n]
            k = int(value.argmax())
            if value[k] > best[w] + 1e-12:
                best[w], took[w] = value[k], k
    count, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            count[took[w]] += 1
            w -= int(sizes[took[w]])
    return float(best[room]), count


def invert(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with pivoting: small matrices, without a threaded library that other Python workers share cores with."""
    n = len(matrix)
    a = np.hstack((matrix, np.eye(n)))
    for i in range(n):
        k = i + int(np.abs(a[i:, i]).argmax())
        a[[i, k]] = a[[k, i]]
        a[i] /= a[i, i]
        a -= np.outer(np.where(np.arange(n) == i, 0, a[:, i]), a[i])
    return a[:, n:]


def patterns(demand: dict[int, int], room: int, rounds: int = 4000, gap: float = 0.002) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each size, how often)], sizes in units with a sum of at most room, that hold all of demand."""
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    for turn in range(1, rounds + 1):
        if turn % 256 == 0:  # against the rounding errors of the updates
            inverse = invert(basis)
        value, column = price(np.maximum(inverse.sum(axis=0), 0), sizes, room)
        if value <= 1 + gap:  # no solution needs less than 1 / value of the sequences of this one
            break
        step = (inverse * column).sum(axis=1)
        up = step > 1e-9
        if not up.any():
            break
        amounts = np.maximum((inverse * need).sum(axis=1), 0)
        j = int(np.where(up, amounts / np.where(up, step, 1), np.inf).argmin())
        basis[:, j] = column
        row = inverse[j] / step[j]
        inverse -= np.outer(step, row)
        inverse[j] = row
    counts = np.floor(np.maximum((invert(basis) * need).sum(axis=1), 0) + 1e-9).astype(np.int64)
    out, left = [], need.astype(np.int64)
    for j in np.flatnonzero(counts):
        column = basis[:, j].astype(np.int64)
        out.append(({int(s): int(k) for s, k in zip(sizes, column, strict=True) if k}, int(counts[j])))
        left = left - column * counts[j]
    left = np.maximum(left, 0)
    while left.any():  # first-fit decreasing, many equal sequences at once
        free, take = room, np.zeros_like(left)
        for j in np.flatnonzero(left)[::-1]:
            take[j] = min(left[j], free // sizes[j])
            free -= int(take[j] * sizes[j])
        times = int((left[take > 0] // take[take > 0]).min())
        out.append(({int(s): int(k) for s, k in zip(sizes, take, strict=True) if k}, times))
        left = left - take * times
    return out


def places(found: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, end rank, pieces of the size in a sequence, first sequence, first slot): where ranks of a size go."""
    rows, used, sequence = [], {}, 0
    for pattern, times in found:
        slot = 0
        for size, k in sorted(pattern.items(), reverse=True):
            lo = used.get(size, 0)
            used[size] = lo + k * times
            rows.append((size, lo, used[size], k, sequence, slot))
            slot += k
        sequence += times
    return rows


def pack(parts: DataFrame, capacity: int = 2048, width: int = WIDTH, part: int = PART) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length and more); parts should be a written table."""
    spark = parts.sparkSession
    room = capacity // width
    classed = parts.withColumn("_class", F.expr(f"cast(least({room}, (length + {width - 1}) div {width}) as int)"))
    demand = {r["_class"]: r["n"] for r in classed.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = places(patterns(demand, room))
    slots = spark.createDataFrame(rows, "_c int, _lo long, _hi long, _k long, _seq long, _slot long")
    salts = max(16, sum(demand.values()) // part)
    salted = classed.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("_class", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_class", "_salt", (F.sum("_n").over(Window.partitionBy("_class").orderBy("_salt")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_class", "_salt").orderBy("doc_id", "start", "ids_crc32", "length"))
    ranked = salted.withColumn("_row", within).join(before, ["_class", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    r = F.col("_rank")
    placed = ranked.join(F.broadcast(slots), (F.col("_class") == F.col("_c")) & (r >= F.col("_lo")) & (r < F.col("_hi")))
    at = r - F.col("_lo")
    placed = placed.withColumn("sequence_id", F.col("_seq") + F.floor(at / F.col("_k"))).withColumn("_place", F.col("_slot") + F.pmod(at, F.col("_k")))
    run = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(run), F.lit(0)).cast("long")).select(*parts.columns, F.col("sequence_id").cast("long").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    parts = cut(pieces(docs, path, capacity, end_id), shared_dir(docs.sparkSession))
    return pack(parts, capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
