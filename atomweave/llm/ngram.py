"""Language-model scoring with an Elias-Fano n-gram trie of three levels.

Level 1 holds the vocabulary: sorted word hashes and running counts, in parts by the leading bits of the hash; a word's
id is its place. Level 2 holds for each context word its successors, level 3 for each pair the words that follow it:
pointers into the successors and the successors themselves (each range shifted by the vocabulary's size once more than
the one before, so that all rise and a successor is found without its range's pointers) are Elias-Fano sequences;
probabilities and back-off weights are codes of a byte. Parts of all levels are built by executors, written once to the
shared folder and memory-mapped by every worker that scores; nothing of the corpus or the model passes through the driver
but a row for each part.

Triples of neighbouring words are counted in batches, and each batch is dealt to the parts of levels 2 and 3 as one
compressed row a part. A part is a range of places: the running count of a context word and, within the word, the share
of the vocabulary below its successor; so parts hold about PART_TOKENS tokens, and the successors of a frequent word are
split by themselves. (The words after one pair stay in one part: as many as the vocabulary has, at most.)

The model interpolates absolute discounting through all orders, with all triples and pairs, those met once too:
P(w | u, v) = max(c(u, v, w) - D, 0) / c(u, v) + g(u, v) * P(w | v),  P(w | v) = max(c(v, w) - D, 0) / c(v) + g(v) * P(w),
P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)), where g is what the discounts leave, so probabilities of a context add to one
(but for the rounding of codes). The end token also stands before a text's first word.

Defined results: a null or empty text is its end token alone; without training texts every count is 0; rows without an
id are scored, not learned from, and not held out; repeated rows count as often as they stand there; other columns are
ignored; words are told apart by 64-bit hashes; texts are read whole, long ones in parts that share their context.
"""

from __future__ import annotations

import os
import urllib.parse
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, remove, shared_dir, small_batches
from .toxicity import fold

#: Words in a part of level 1 and tokens in one of levels 2 and 3, about; discount; decimals of a code's step.
PART_WORDS, PART_TOKENS, DISCOUNT, STEP = 1 << 20, 2_500_000, 0.75, 0.04
#: Words that a worker remembers, tokens whose words and triples it gathers before it hands them on, tokens that are split at
#: once, characters of a long text that are split into words at once, slots of the tables of found pairs and triples, parts
#: that a worker keeps open.
CACHE, GATHER, TOKENS, BATCH, CHARS, SLOTS, OPEN = 250_000, 2_000_000, 1_000_000, 250_000, 500_000, 1 << 20, 1 << 13
#: Batches of tokens that are scored at once, as each round of lookups visits the parts of the model; bytes of a token, about.
ROUND, TOKEN_BYTES = 6, 6
END = b" "  # no word holds a space
_U = np.uint64
#: Bits of a worker's own word numbers, three of which are one key: CACHE and the words of TOKENS tokens are fewer.
OWN = 21


# -- bytes in the shared folder ---------------------------------------------------------------------------------


def put(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes named arrays as one file; a repeated attempt of a task replaces it by the same bytes."""
    head, at, parts = [], 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        raw += bytes(-len(raw) % 8)
        head.append(f"{name},{a.dtype.str},{a.size},{at}")
        parts.append(raw)
        at += len(raw)
    first = (";".join(head) + "\n").encode()
    first += b" " * (-len(first) % 8)
    url = urllib.parse.urlparse(uri)
    body = [len(first).to_bytes(8, "little"), first, *parts]
    if url.scheme in ("", "file"):
        os.makedirs(os.path.dirname(url.path), exist_ok=True)
        temp = f"{url.path}.{os.getpid()}-{os.urandom(4).hex()}"
        with open(temp, "wb") as f:
            f.writelines(body)
        os.replace(temp, url.path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(path) as f:
            f.write(b"".join(body))


def get(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped where the shared folder is mounted, else read."""
    url = urllib.parse.urlparse(uri)
    if url.scheme in ("", "file"):
        raw = np.asarray(np.memmap(url.path, np.uint8, "r"))  # a plain array: each access to a memmap makes an object
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for item in raw[8 : 8 + n].tobytes().decode().strip().split(";"):
        name, kind, size, at = item.split(",")
        begin = 8 + n + int(at)
        out[name] = raw[begin : begin + int(size) * np.dtype(kind).itemsize].view(kind)
    return out


# -- Elias-Fano -------------------------------------------------------------------------------------------------


def ef_encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """A rising sequence as low bits (packed) and unary high bits with zeros counted before each 64."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, int(np.log2(max(top, 1) / n))) if n else 0
    v = values.astype(_U)
    high = (v >> _U(low)).astype(np.int64)
    size = -(-(n + (int(high[-1]) if n else 0) + 1) // 64) * 64
    bits = np.zeros(size, np.uint8)
    bits[high + np.arange(n)] = 1
    zeros = 64 - bits.reshape(-1, 64).sum(axis=1, dtype=np.int64)
    lows = np.zeros(n * low // 64 + 2, _U)
    if low:
        at = np.arange(n, dtype=np.int64) * low
        word, off = at >> 6, (at & 63).astype(_U)
        part = v & _U((1 << low) - 1)
        np.add.at(lows, word, part << off)  # bits don't meet
        over = off + _U(low) > _U(64)
        np.add.at(lows, word[over] + 1, part[over] >> (_U(64) - off[over]))
    return {f"{name}_low": lows, f"{name}_bits": np.packbits(bits, bitorder="little"), f"{name}_zeros": np.append(0, np.cumsum(zeros)), f"{name}_meta": np.array([n, low], np.int64)}


class EliasFano:
    """Vectorised access to an encoded sequence."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.low, self.zeros = arrays[f"{name}_low"], arrays[f"{name}_zeros"]
        self.bits = arrays[f"{name}_bits"].view("<u8")
        self.n, self.width = (int(x) for x in arrays[f"{name}_meta"])

    @property
    def ones(self) -> np.ndarray:
        return np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros

    def _select(self, k: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Place of bit number k (from 0): a one, or a zero if flip is all ones."""
        word = np.searchsorted(before, k, "right") - 1
        rest, x = (k - before[word]).astype(_U), self.bits[word] ^ _U(flip)
        s = x - ((x >> _U(1)) & _U(0x5555555555555555))
        s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
        s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH  # in byte i the ones of bytes 0 to i
        off = np.bitwise_count(((rest * _EACH) | _TOPS) - s & _TOPS).astype(_U) << _U(3)  # bytes that end before the bit
        rest -= ((s << _U(8)) >> off) & _U(255)
        return (word << 6) + (off + _BIT[(rest << _U(8)) | ((x >> off) & _U(255))]).astype(np.int64)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = i * self.width
        return (_window(self.low, at >> 6, (at & 63).astype(_U), (at >> 6) + 1) & _U((1 << self.width) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, self.ones, 0) - i) << self.width) | self.lows(i)

    def _run(self, place: np.ndarray, h: np.ndarray) -> np.ndarray:
        """How many ones stand from a place of the high bits on, where the zero number h ends them."""
        most = len(self.bits) - 1
        word = np.minimum(place >> 6, most)
        x = _window(self.bits, word, (place & 63).astype(_U), np.minimum(word + 1, most))
        n = np.bitwise_count(x & ~(x + _U(1))).astype(np.int64)
        long = np.flatnonzero(n >= 32)  # the window may end before the run does
        if len(long):
            n[long] = self._select(h[long], self.zeros, _ALL) - place[long]
        return n

    def find(self, value: np.ndarray) -> np.ndarray:
        """Place of each value, -1 if it isn't in the sequence: its high part names a run, whose low parts are searched.

        Values in order are found faster: neighbours in memory are read one after another.
        """
        out = np.full(len(value), -1, np.int64)
        high, low = value >> self.width, value & ((1 << self.width) - 1)
        ok = np.flatnonzero((value >= 0) & (high < self.zeros[-1])) if self.n else np.zeros(0, np.int64)
        if not len(ok):
            return out
        h, low = high[ok], low[ok]
        place = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, _ALL) + 1, 0)
        at = place - h
        end = at + self._run(place, h)
        stop = end.copy()
        alive = np.flatnonzero(at + 1 < stop)  # of one that is left, the last comparison tells
        while len(alive):  # halves of the run: a frequent context's may be long
            mid = (at[alive] + stop[alive]) // 2
            less = self.lows(mid) <= low[alive]
            at[alive[less]] = mid[less]
            stop[alive[~less]] = mid[~less]
            alive = alive[at[alive] + 1 < stop[alive]]
        inside = np.flatnonzero(at < end)
        hit = inside[self.lows(at[inside]) == low[inside]]
        out[ok[hit]] = at[hit]
        return out


_ALL, _EACH, _TOPS = 0xFFFFFFFFFFFFFFFF, _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of one number k of a byte x, at k << 8 | x.
_BIT = np.array([([i for i in range(8) if x >> i & 1] + [0] * 8)[k] for k in range(8) for x in range(256)], _U)


def _window(words: np.ndarray, word: np.ndarray, off: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The 64 bits from bit off of a word on."""
    return (words[word] >> off) | ((words[following] << _U(1)) << (_U(63) - off))


def runs(which: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of an array in order and where it stands."""
    begin = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(which) else np.zeros(0, np.int64)
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(which)], strict=len(begin) > 0):
        yield int(which[i]), slice(i, j)


# -- words of texts ------------------------------------------------------------------------------------------------


def slices(text: str) -> Iterator[tuple[str, bool]]:
    """A long text in parts that end at ASCII white space, and whether a part is the last."""
    at = 0
    while len(text) - at > CHARS:
        end = min((k for k in (text.find(c, at + CHARS) for c in " \t\n\v\f\r") if k >= 0), default=len(text))
        if end == len(text):
            break
        yield text[at:end], False
        at = end
    yield text[at:], True


def pieces(texts: list[str | None]) -> Iterator[tuple[int, bytes, int, bool]]:
    """(number of the text, bytes of a part of it, how many of its words an earlier part has given, whether the end stands last)."""
    for k, text in enumerate(texts):
        kept: list[bytes] = []
        for piece, last in slices(text or ""):
            body = b" ".join((*kept, piece.encode("utf-8", "surrogatepass").lower()))  # bytes know A-Z and ASCII white space only
            yield k, body, len(kept), last
            if not last:
                kept = body.rsplit(None, 2)[-2:]


def most_tokens(body: bytes) -> int:
    """As many tokens as a part of a text has, the end among them, or more where blanks follow one another."""
    return len(body) - len(body.translate(None, b" \t\n\v\f\r")) + 2


def parts_of(texts: list[str | None]) -> Iterator[tuple[int, list[bytes], int, bool]]:
    """The same with the words of each part, the end among them."""
    for k, body, skip, last in pieces(texts):
        yield k, [*body.split(), END] if last else body.split(), skip, last


def split(held: list[tuple[int, bytes, int, bool]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of parts, which of them stands at each place, and how many words each part has (without ends)."""
    lists = pc.ascii_split_whitespace(pa.array([body for _, body, _, _ in held], pa.large_binary()).view(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    _, offsets, data = coded.dictionary.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(coded.dictionary) + 1].tolist() if len(coded) else [0]
    raw = data.to_pybytes() if data else b""
    words = [raw[i:j] for i, j in zip(at, at[1:], strict=False)]
    code, offsets = coded.indices.to_numpy(), lists.offsets.to_numpy()
    real = np.ones(len(code), bool) if b"" not in words else code != words.index(b"")  # white space at a part's ends leaves empty ones
    before = np.concatenate(([0], np.cumsum(real)))
    return words, code[real], np.diff(before[offsets])


def words_of(text: str) -> list[bytes]:
    """All words, then the end."""
    return [w for _, words, skip, _ in parts_of([text]) for w in words[skip:]]


# -- level 1 ---------------------------------------------------------------------------------------------------------


def code_of(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 255).astype(np.uint8)


_VALUE = 10.0 ** (np.arange(256) * -STEP)


def value_of(code: np.ndarray) -> np.ndarray:
    return _VALUE[code]


class Vocabulary:
    """Word hash to id, id to count and to the counts before it; sizes and tokens of each part, in order."""

    def __init__(self, folder: str, sizes: list[int], tokens: list[int]):
        self.folder, self.shift = folder, 64 - (len(sizes) - 1).bit_length()
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(tokens))).astype(np.int64)
        self.size, self.total = int(self.first[-1]), int(self.before[-1])
        self.parts: dict[int, dict[str, np.ndarray]] = {}

    def part(self, k: int) -> dict[str, np.ndarray]:
        if k not in self.parts:
            if len(self.parts) >= OPEN:
                self.parts.clear()
            self.parts[k] = get(f"{self.folder}/words-{k}")
        return self.parts[k]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parts": {}}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids, -1 for words that training doesn't hold."""
        out = np.full(len(hashes), -1, np.int64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        which = (hashes >> _U(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(hashes), np.int64)
        for k, own in runs(which):
            if self.first[k] < self.first[k + 1]:
                mine = self.part(k)["hash"]
                at = np.minimum(np.searchsorted(mine, hashes[own]), len(mine) - 1)
                out[order[own]] = np.where(mine[at] == hashes[own], at + self.first[k], -1)
        return out

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the ids before, and of the ids themselves; 0 for -1."""
        before, count = np.zeros((2, len(ids)), np.int64)
        order = np.argsort(ids)
        order = order[np.searchsorted(ids, 0, sorter=order) :]
        for k, own in runs(np.searchsorted(self.first, ids[order], "right") - 1):
            running = self.part(k)["running"]
            at = ids[order[own]] - self.first[k]
            before[order[own]] = running[at] + self.before[k]
            count[order[own]] = running[at + 1] - running[at]
        return before, count

    def part_of(self, before: np.ndarray, count: np.ndarray, following: np.ndarray) -> np.ndarray:
        """The part of levels 2 and 3 that holds a context (by its places) and the word that follows it."""
        within = np.minimum((count * (following / max(self.size, 1))).astype(np.int64), np.maximum(count - 1, 0))
        return (before + within) // PART_TOKENS


class Numbers:
    """A worker's own numbers of the words it has met, from 2 on; 0 is none, 1 the end."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.of: dict[bytes, int] = {b"": 0}
        self.id, self.before, self.count = np.full(1, -1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.take([END])

    def take(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.of))
        if new:
            self.of.update(zip(new, range(len(self.of), len(self.of) + len(new)), strict=True))
            ids = self.vocabulary.find(np.fromiter(map(xxhash.xxh3_64_intdigest, new), _U, len(new)))
            before, count = self.vocabulary.places(ids)
            self.id, self.before, self.count = (np.concatenate(p) for p in ((self.id, ids), (self.before, before), (self.count, count)))
        return np.fromiter(map(self.of.__getitem__, words), np.int64, len(words))


class Tokens:
    """Parts of texts (their bytes or words) as one run of numbers, with what stands before and after each."""

    def __init__(self, numbers: Numbers, held: list[tuple[int, bytes | list[bytes], int, bool]]):
        words, code, lengths = split([(k, p if isinstance(p, bytes) else b" ".join(p[: len(p) - last]), skip, last) for k, p, skip, last in held])
        skip, last = np.array([p[2] for p in held]), np.array([p[3] for p in held])
        lengths = lengths + last
        ends = (np.cumsum(lengths) - 1)[lengths > 0]
        word = np.ones(int(lengths.sum()), bool)
        word[ends[last[lengths > 0]]] = False
        self.x = np.ones(len(word), np.int64)
        self.x[word] = numbers.take(words)[code]
        self.part = np.repeat(np.arange(len(held)), lengths)
        self.starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        self.prev = np.concatenate(([1], self.x[:-1]))
        self.prev[self.starts] = 1
        self.next = np.concatenate((self.x[1:], [0]))
        self.next[ends] = 0
        at = np.arange(len(self.x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.own = at >= skip[self.part]  # not given by an earlier part
        self.centre = at >= skip[self.part] - 1  # what follows the last word of a part is known in the next one
        self.centre[ends] &= last[lengths > 0]
        self.text = np.array([p[0] for p in held])[self.part]


# -- levels 2 and 3 ------------------------------------------------------------------------------------------------


def ranges(begin: np.ndarray, word: np.ndarray, n: int, size: int, name: str) -> dict[str, np.ndarray]:
    """Pointers and successors of n contexts; begin: the context of each successor, rising. Each range is shifted by size once more than the one before."""
    pointer = np.concatenate(([0], np.cumsum(np.bincount(begin, minlength=n))))
    return ef_encode(pointer, f"{name}_pointer") | ef_encode(word + begin * size, f"{name}_next")


class Level:
    """The successors of some contexts, by the place of the context."""

    def __init__(self, a: dict[str, np.ndarray], name: str, size: int):
        self.pointer, self.next, self.code, self.size = EliasFano(a, f"{name}_pointer"), EliasFano(a, f"{name}_next"), a[f"{name}_code"], size

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of the words among the successors of the contexts, -1 where they don't follow."""
        return self.next.find(context * self.size + word)


class Part:
    """Levels 2 and 3 of a range of places."""

    def __init__(self, a: dict[str, np.ndarray]):
        self.start, self.contexts, size = (int(v) for v in a["start"])
        self.pairs, self.triples, self.backoff = Level(a, "pair", size), Level(a, "triple", size), a["backoff"]

    def followers(self, ids: np.ndarray) -> np.ndarray:
        """How many words follow each context here."""
        h = ids - self.start
        ok = (h >= 0) & (h < self.contexts)
        h = np.where(ok, h, 0)
        return np.where(ok, self.pairs.pointer[h + 1] - self.pairs.pointer[h], 0)

    def pair(self, ids: np.ndarray, words: np.ndarray) -> np.ndarray:
        h = ids - self.start
        out = np.full(len(ids), -1, np.int64)
        ok = np.flatnonzero((h >= 0) & (h < self.contexts))
        if len(ok):
            out[ok] = self.pairs.find(h[ok], words[ok])
        return out


def _pack(arrays: list[np.ndarray], wide: bool) -> bytes:
    kind = "<i8" if wide else "<i4"
    return zstandard.compress(b"".join([np.array([len(arrays[0]), wide], "<i8").tobytes(), *[a.astype(kind).tobytes() for a in arrays]]), 1)


def _unpack(body: bytes) -> np.ndarray:
    raw = zstandard.decompress(body)
    n, wide = np.frombuffer(raw, "<i8", 2)
    return np.frombuffer(raw, "<i8" if wide else "<i4", 4 * int(n), 16).reshape(4, -1)


def _sorted(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Distinct triples in order, with the sums of n; w is -1 or more, v and w are below size."""
    bits, low = int(size).bit_length(), int(u.min())
    if (int(u.max()) - low).bit_length() + 2 * bits + 1 <= 63:
        order = np.argsort((u - low) << (2 * bits + 1) | v << (bits + 1) | (w + 1))
    else:
        order = np.lexsort((w, v, u))
    u, v, w, n = u[order], v[order], w[order], n[order]
    begin = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
    return u[begin], v[begin], w[begin], np.add.reduceat(n, begin)


def build(vocabulary: Vocabulary, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The arrays of a part from its triples (w is -1 after the end), its contexts and how many words follow each."""
    u, v, w, n = _sorted(u, v, w, n, vocabulary.size)
    begin = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))))
    n2, pu, pv = np.add.reduceat(n, begin), u[begin], v[begin]
    start, contexts = int(pu[0]), int(pu[-1] - pu[0]) + 1
    own, each, followers = np.unique(pu, return_inverse=True, return_counts=True)
    whole = vocabulary.places(own)[1]
    out = {"start": np.array([start, contexts, vocabulary.size], np.int64)} | ranges(pu - start, pv, contexts, vocabulary.size, "pair") | {"pair_code": code_of(np.log10((n2 - DISCOUNT) / whole[each]))}
    real = w >= 0
    pair = (np.cumsum(np.bincount(begin, minlength=len(u))) - 1)[real]
    kinds, total = np.bincount(pair, minlength=len(pu)), np.bincount(pair, n[real], minlength=len(pu))
    out |= ranges(pair, w[real], len(pu), vocabulary.size, "triple") | {"triple_code": code_of(np.log10((n[real] - DISCOUNT) / total[pair]))}
    out["backoff"] = code_of(np.log10(np.where(kinds > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)))
    return out, own, followers


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out() -> pa.RecordBatch:
        words, code, lengths = split(held)
        given = np.repeat(np.cumsum(lengths) - lengths + [skip for _, _, skip, _ in held], lengths)
        n = np.bincount(code[np.arange(len(code)) >= given], minlength=len(words))
        words, n = [*words, END], np.append(n, sum(last for *_, last in held))
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
        return pa.RecordBatch.from_arrays([pa.array(h[n > 0].view(np.int64)), pa.array(n[n > 0], pa.int64())], names=["hash", "n"])

    for b in batches:
        for piece in pieces(b.column(0).to_pylist()):
            held.append(piece)
            size += most_tokens(piece[1])
            if size >= GATHER:
                yield out()
                held.clear()
                size = 0
    if held:
        yield out()
    del held
    give_back()


class Model:
    """vocabulary, folder of the parts, and how many words follow each context that several parts hold."""

    def __init__(self, vocabulary: Vocabulary, folder: str, spread: dict[int, int]):
        self.vocabulary, self.folder, self.spread, self.parts = vocabulary, folder, spread, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parts": {}}

    def part(self, k: int) -> Part | None:
        if k not in self.parts:
            if len(self.parts) >= OPEN:
                self.parts.clear()
            try:
                self.parts[k] = Part(get(f"{self.folder}/part-{k}"))
            except FileNotFoundError:  # no pair has its place there
                self.parts[k] = None
        return self.parts[k]

    def followers(self, ids: np.ndarray, before: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How many different words follow each known id."""
        out = np.zeros(len(ids), np.int64)
        first, last = before // PART_TOKENS, (before + np.maximum(count, 1) - 1) // PART_TOKENS
        split = np.flatnonzero((count > 0) & (last > first))
        for i in split:  # contexts at the borders of parts
            k = int(ids[i])
            out[i] = self.spread[k] if k in self.spread else sum(int(p.followers(ids[i : i + 1])[0]) for p in map(self.part, range(int(first[i]), int(last[i]) + 1)) if p)
        one = np.flatnonzero((count > 0) & (last == first))
        one = one[np.argsort(ids[one])]  # and so by parts
        for k, own in runs(first[one]):
            if (part := self.part(k)) is not None:
                out[one[own]] = part.followers(ids[one[own]])
        return out


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """A model of all rows of docs, its levels written to a new folder of the shared store."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(_count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counted.write.parquet(f"{folder}/counts")
    counted = spark.read.parquet(f"{folder}/counts")
    size = counted.count()
    parts = 1 << max(0, int(np.ceil(np.log2(max(1, size / PART_WORDS)))))
    shift = 64 - (parts - 1).bit_length()

    def level1(key: tuple, t: pa.Table) -> pa.Table:
        h, n = t.column("hash").to_numpy().view(_U), t.column("n").to_numpy()
        order = np.argsort(h)
        put(f"{folder}/words-{key[0].as_py()}", {"hash": h[order], "running": np.concatenate(([0], np.cumsum(n[order])))})
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": [len(h)], "tokens": [int(n.sum())]})

    part = F.shiftrightunsigned("hash", shift).cast("int") if parts > 1 else F.lit(0)
    made = {r["part"]: r for r in counted.withColumn("part", part).groupBy("part").applyInArrow(level1, "part int, n long, tokens long").collect()}
    vocabulary = Vocabulary(folder, *[[made[k][c] if k in made else 0 for k in range(parts)] for c in ("n", "tokens")])
    remove(spark, f"{folder}/counts")

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held, keys, n = Numbers(vocabulary), [], [], 0

        def key() -> None:
            t = Tokens(numbers, held)
            keys.append((t.prev << (2 * OWN) | t.x << OWN | t.next)[t.centre])
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            k, count = np.unique(np.concatenate(keys), return_counts=True)
            keys.clear()
            mask = (1 << OWN) - 1
            p, v, w = k >> (2 * OWN), numbers.id[(k >> OWN) & mask], numbers.id[k & mask]
            part = vocabulary.part_of(numbers.before[p], numbers.count[p], v)
            order = np.argsort(part, kind="stable")
            u, v, w, count, part = numbers.id[p][order], v[order], w[order], count[order], part[order]
            begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            wide = vocabulary.size >= 1 << 31
            bodies = [_pack([a[i:j] for a in (u, v, w, count)], wide) for i, j in zip(begin, [*begin[1:], len(part)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(bodies, pa.binary())], names=["part", "body"])
            if len(numbers.of) > CACHE:
                numbers.clear()

        for b in batches:
            for piece in pieces(b.column(0).to_pylist()):
                held.append(piece)
                n += most_tokens(piece[1])
                if sum(map(len, keys)) + n >= TOKENS:
                    key()
                    n = 0
                    yield from out()
                elif n >= BATCH:
                    key()
                    n = 0
        if held:
            key()
        if keys:
            yield from out()
        del numbers
        give_back()

    def level23(key: tuple, t: pa.Table) -> pa.Table:
        k = key[0].as_py()
        u, v, w, n = (a.astype(np.int64) for a in np.concatenate([_unpack(x.as_py()) for x in t.column("body")], axis=1))
        arrays, own, followers = build(vocabulary, u, v, w, n)
        put(f"{folder}/part-{k}", arrays)
        give_back()
        return pa.table({"part": pa.array([k], pa.int64()), "u": [int(own[0])], "n": [int(followers[0])], "last_u": [int(own[-1])], "last_n": [int(followers[-1])]})

    borders: dict[int, list[int]] = {}
    dealt = texts.mapInArrow(triples, "part long, body binary") if size else None
    for r in dealt.groupBy("part").applyInArrow(level23, "part long, u long, n long, last_u long, last_n long").collect() if size else ():
        borders.setdefault(r["u"], []).append(r["n"])
        if r["last_u"] != r["u"]:
            borders.setdefault(r["last_u"], []).append(r["last_n"])
    return Model(vocabulary, folder, {u: sum(n) for u, n in borders.items() if len(n) > 1})


class Scorer:
    """Scores texts; a worker's words, pairs and triples keep what the trie says of them in stores of fixed size."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, model.vocabulary
        self.triple_key, self.triple_share = np.zeros(SLOTS * 2, _U), np.zeros(SLOTS * 2, np.float32)
        self.key, self.ref = np.full(SLOTS, _ALL, _U), np.zeros(SLOTS, np.int64)
        self.share, self.back = np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32)
        self.numbers = Numbers(model.vocabulary)
        self.clear()

    def clear(self) -> None:
        """Forgets the words; pairs and triples are known by ids and stay."""
        self.numbers.clear()
        self.single, self.rest = np.zeros(0), np.zeros(0)

    def _learn(self) -> None:
        """The probability of new words, and what they leave to words that don't follow them."""
        a, n = len(self.single), self.numbers
        ids, before, count = n.id[a:], n.before[a:], n.count[a:]
        v = self.vocabulary
        self.single = np.concatenate((self.single, (count + 0.5) / (v.total + 0.5 * (v.size + 1))))
        rest = np.where(count > 0, DISCOUNT * self.model.followers(ids, before, count) / np.maximum(count, 1), 1.0)
        self.rest = np.concatenate((self.rest, rest))

    def _pairs(self, prev: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Share, back-off weight and reference (part << 32 | place, -1 if unknown) of pairs of numbers."""
        n, size = self.numbers, _U(self.vocabulary.size)
        share, back, ref = np.zeros(len(x), np.float32), np.ones(len(x), np.float32), np.full(len(x), -1, np.int64)
        u, w = n.id[prev], n.id[x]
        known = np.flatnonzero((u >= 0) & (w >= 0))
        if not len(known):
            return share, back, ref
        key = u[known].view(_U) * size + w[known].view(_U)  # below 2 ** 64, as words are fewer than 2 ** 32
        slot = ((key * _U(0x9E3779B97F4A7C15)) >> _U(64 - (SLOTS - 1).bit_length())).astype(np.int64)
        share[known], back[known], ref[known] = self.share[slot], self.back[slot], self.ref[slot]
        miss = np.flatnonzero(self.key[slot] != key)
        if len(miss):
            order = miss[np.argsort(key[miss])]  # by places, and so by parts
            new = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
            first, each = order[new], np.cumsum(new) - 1
            keys, p, w = key[first], prev[known[first]], w[known[first]]
            s, b, r = np.zeros(len(keys), np.float32), np.ones(len(keys), np.float32), np.full(len(keys), -1, np.int64)
            for k, own in runs(self.vocabulary.part_of(n.before[p], n.count[p], w)):
                if (part := self.model.part(k)) is not None:
                    at = part.pair(n.id[p[own]], w[own])
                    hit = np.flatnonzero(at >= 0)
                    at, hit = at[hit], hit + own.start
                    s[hit], b[hit], r[hit] = value_of(part.pairs.code[at]), value_of(part.backoff[at]), k << 32 | at
            at = known[order]
            share[at], back[at], ref[at] = s[each], b[each], r[each]
            put_at = slot[first]
            self.key[put_at] = keys
            stay = np.flatnonzero(self.key[put_at] == keys)  # of two keys for one slot the later one stays
            put_at = put_at[stay]
            self.share[put_at], self.back[put_at], self.ref[put_at] = s[stay], b[stay], r[stay]
        return share, back, ref

    def _triples(self, ref: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Share of words after pairs, given by reference."""
        key = (ref.astype(_U) * _U(0xBF58476D1CE4E5B9)) ^ (word.astype(_U) * _U(0x94D049BB133111EB))
        key = (key ^ (key >> _U(31))) * _U(0x9E3779B97F4A7C15) | _U(1)
        slot = (key >> _U(64 - (2 * SLOTS - 1).bit_length())).astype(np.int64)
        share = self.triple_share[slot]
        miss = np.flatnonzero(self.triple_key[slot] != key)
        if len(miss):
            miss = miss[np.argsort(ref[miss])]  # by parts, and by places there
            r, w, s = ref[miss], word[miss], np.zeros(len(miss), np.float32)
            for k, own in runs(r >> 32):
                part = self.model.part(k)
                at = part.triples.find(r[own] & 0xFFFFFFFF, w[own])
                hit = np.flatnonzero(at >= 0)
                s[hit + own.start] = value_of(part.triples.code[at[hit]])
            share[miss] = s
            put_at, keys = slot[miss], key[miss]
            self.triple_key[put_at] = keys
            stay = np.flatnonzero(self.triple_key[put_at] == keys)
            self.triple_share[put_at[stay]] = s[stay]
        return share

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each text."""
        n_tokens, n_known = np.zeros((2, len(texts)), np.int64)
        base, log = np.zeros((2, len(texts)))
        held, n = [], 0

        def run() -> None:
            if len(self.numbers.of) > CACHE:
                self.clear()
            t = Tokens(self.numbers, held)
            self._learn()
            held.clear()
            word, single = self.numbers.id[t.x], self.single[t.x]
            share, back, ref = self._pairs(t.prev, t.x)
            p = share + self.rest[t.prev] * single
            ref, back = np.concatenate(([-1], ref[:-1])), np.concatenate(([1], back[:-1]))
            ref[t.starts], back[t.starts] = -1, 1  # of the pair before
            p *= back
            both = np.flatnonzero((ref >= 0) & (word >= 0))
            p[both] += self._triples(ref[both], word[both])
            own, text = t.own, t.text[t.own]
            for out, value in ((n_tokens, None), (n_known, (word >= 0).astype(float)), (base, np.log10(single)), (log, np.log10(p))):
                out += np.bincount(text, None if value is None else value[own], len(texts)).astype(out.dtype)

        for piece in pieces(texts):
            held.append(piece)
            n += most_tokens(piece[1])
            if n >= ROUND * BATCH:
                run()
                n = 0
        if held:
            run()
        return n_tokens, n_known, base, log


_KEPT: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """This worker's scorer of the model: what it knows of frequent pairs serves the next task too."""
    if model.folder not in _KEPT:
        _KEPT.clear()
        _KEPT[model.folder] = Scorer(model)
    return _KEPT[model.folder]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            found = scorer.score([text for b in held for text in b.column(1).to_pylist()])
            ids = pa.concat_arrays([b.column(0) for b in held])
            held.clear()
            n_tokens, n_known, base, log = map(pa.array, found)
            total = pa.array(np.full(len(ids), model.vocabulary.total, np.int64))
            return pa.RecordBatch.from_arrays([ids, n_tokens, n_known, total, base, log], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) >= ROUND * BATCH * TOKEN_BYTES:
                yield out()
        if held:
            yield out()
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_held_out(docs: DataFrame, folds: int = 5, out: int = 1) -> DataFrame:
    """Trains on the texts whose fold isn't out and scores all; held_out tells the others."""
    model = train(docs.where(fold("doc_id", folds) != out))
    held_out = F.coalesce(fold("doc_id", folds) == out, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
