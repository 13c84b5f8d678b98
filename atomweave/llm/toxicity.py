"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs, in numpy.

A word enters as its own vector (hashed table) and as what a bidirectional character network with attention makes of
its letters; a bidirectional word network with attention pools a window of words into one logit. Every text is
scored over all of its overlapping windows, one from every word that WIDTH words begin with; its score is that of its
worst window. Gates are piecewise linear, so a step is a few multiply-adds, and windows of many texts run as one batch.

Training takes a bounded sample of labelled documents (SAMPLE by label, the smallest hashes, drawn in the engine; of
these, the ones of up to SAMPLE_CHARS characters) to the driver, and looks at all windows of each. A label is of the
whole document, so windows are chosen in turns: those that tell the labels apart by word counts first, later the worst
one under the model itself.

Defined results: a null or empty text is one window of nothing and has that window's score; without labels of both
kinds every score is 0; repeated rows give repeated results; null ids stay null and are never trained on; other
columns of the input are ignored; texts are scored whole, and a run of more than LETTERS letters as the words that its
overlapping pieces are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, one_thread, small_batches

#: Words of a window, and from one to the next of those that training picks from; letters of a word (longer runs are several words)
#: and from one piece of a longer run to the next.
WIDTH, STRIDE, LETTERS, PIECE = 16, 8, 14, 7
#: Hashed word table, sizes of vectors and states.
TABLE, WORD_DIM, CHAR_DIM, CHAR_STATE, STATE = 1 << 14, 8, 8, 6, 8
#: Documents by label that training takes at most, and characters of one of them.
SAMPLE, SAMPLE_CHARS = {1: 1000, 0: 2000}, 200_000
EPOCHS, BATCH, RATE = 10, 128, 0.015
#: Windows of a batch when texts are scored (short texts; neighbours of a run of words); words that a worker remembers
#: (about 400 bytes each), words that are scored at once, characters of a long text that are split into words at once.
RUN, SPAN, CACHE, WORDS, CHARS = 4096, 2048, 80_000, 40_000, 200_000

_WORDS, _GAP = re.compile(r"[^\W\d_]+", re.UNICODE), re.compile(r"\s")
_ALPHABET = {c: i + 2 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzäöüßéèêëàâçîïôûùñíóáú'")}

_NUMBER = np.ones(max(map(ord, _ALPHABET)) + 2, np.int16)
_NUMBER[[ord(c) for c in _ALPHABET]] = list(_ALPHABET.values())
_NUMBER[0] = 0


def words_of(text: str) -> list[str]:
    """Runs of letters, lower case, long ones as overlapping pieces; what stands between letters of one word (as in l.o.s.e.r) is not undone."""
    found = _WORDS.findall(text.lower())
    if max(map(len, found), default=0) <= LETTERS:
        return found
    return [piece for w in found for piece in (pieces(w) if len(w) > LETTERS else (w,))]


def pieces(run: str) -> list[str]:
    """LETTERS letters from every PIECE-th on, and the last ones: every letter is in one, and eight in a row are in one together."""
    return [run[at : at + LETTERS] for at in range(0, len(run) - LETTERS, PIECE)] + [run[-LETTERS:]]


def letters_of(words: list[str]) -> np.ndarray:
    """A row of LETTERS letter numbers for each word: 0 after its end, 1 for letters outside the alphabet."""
    raw = "".join([w.ljust(LETTERS, "\0") for w in words]).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, "<u4").reshape(-1, LETTERS)
    return _NUMBER[np.minimum(codes, len(_NUMBER) - 1)]


def slot_of(word: str) -> int:
    return zlib.crc32(word.encode()) % TABLE


def _hard(x: np.ndarray) -> np.ndarray:
    """Sigmoid in three straight pieces."""
    return np.clip(0.25 * x + 0.5, 0, 1)


class Gru:
    """One direction; inputs (n, t, d), mask (n, t). Keeps what the gradient needs if asked."""

    def __init__(self, rng: np.random.Generator, d: int, h: int):
        self.h = h
        self.p = {"W": rng.normal(0, d**-0.5, (d, 3 * h)), "U": rng.normal(0, h**-0.5, (h, 3 * h)), "b": np.concatenate((np.full(h, -0.5), np.zeros(2 * h)))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (n, t, h) from gates = inputs @ W + b, already made."""
        n, t, _ = gates.shape
        h, u = self.h, self.p["U"]
        u1, u2 = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        s, out = np.zeros((n, h), np.float32), np.empty((n, t, h), np.float32)
        for i in range(t):
            x = gates[:, i]
            a = x[:, : 2 * h] + s @ u1
            z, r = _hard(a[:, :h]), _hard(a[:, h:])
            v = x[:, 2 * h :] + (r * s) @ u2
            c = np.clip(v, -1, 1)
            m = mask[:, i, None]
            new = s + m * z * (c - s)
            if keep is not None:
                keep.append((s, a, z, r, v, c, m))
            out[:, i] = s = new
        return out

    def backward(self, inputs: np.ndarray, d_out: np.ndarray, keep: list, grad: dict) -> np.ndarray:
        """Gradient of the inputs; adds those of the weights to grad."""
        h, w, u = self.h, self.p["W"], self.p["U"]
        d_in, ds = np.zeros_like(inputs), np.zeros_like(d_out[:, 0])
        for i in range(d_out.shape[1] - 1, -1, -1):
            s, a, z, r, v, c, m = keep[i]
            ds = ds + d_out[:, i]
            dz, dc = ds * m * (c - s), ds * m * z
            dprev = ds * (1 - m * z)
            dv = dc * (np.abs(v) < 1)
            drs = dv @ u[:, 2 * h :].T
            da = np.concatenate((dz, drs * s), axis=1) * (0.25 * (np.abs(a) < 2))
            dprev += drs * r + da @ u[:, : 2 * h].T
            dx = np.concatenate((da, dv), axis=1)
            grad["U"][:, : 2 * h] += s.T @ da
            grad["U"][:, 2 * h :] += (r * s).T @ dv
            grad["W"] += inputs[:, i].T @ dx
            grad["b"] += dx.sum(axis=0)
            d_in[:, i] = dx @ w.T
            ds = dprev
        return d_in


class Pool:
    """Attention pooling: a weight for each state, softmax over those that the mask shows."""

    def __init__(self, rng: np.random.Generator, h: int):
        self.p = {"q": rng.normal(0, 0.3, h).astype(np.float32)}

    def forward(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.where(mask > 0, (states * self.p["q"]).sum(axis=2), -1e4)
        e = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        a = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        return (a[:, :, None] * states).sum(axis=1), a

    def backward(self, states: np.ndarray, a: np.ndarray, d: np.ndarray, grad: dict) -> np.ndarray:
        da = (states * d[:, None, :]).sum(axis=2)
        de = a * (da - (a * da).sum(axis=1, keepdims=True))
        grad["q"] += (de[:, :, None] * states).sum(axis=(0, 1))
        return a[:, :, None] * d[:, None, :] + de[:, :, None] * self.p["q"]


class Both:
    """A network in either direction and its attention."""

    def __init__(self, rng: np.random.Generator, d: int, h: int):
        self.parts = {"f": Gru(rng, d, h), "b": Gru(rng, d, h), "a": Pool(rng, 2 * h)}

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((x @ self.parts[k].p["W"] + self.parts[k].p["b"]).astype(np.float32) for k in "fb")

    def pooled(self, gates: tuple[np.ndarray, np.ndarray], mask: np.ndarray) -> np.ndarray:
        f = self.parts["f"].forward(gates[0], mask)
        b = self.parts["b"].forward(gates[1][:, ::-1], mask[:, ::-1])[:, ::-1]
        return self.parts["a"].forward(np.concatenate((f, b), axis=2), mask)[0]

    def train_forward(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        kf, kb = [], []
        gf, gb = self.gates(x)
        f = self.parts["f"].forward(gf, mask, kf)
        b = self.parts["b"].forward(gb[:, ::-1], mask[:, ::-1], kb)[:, ::-1]
        states = np.concatenate((f, b), axis=2)
        out, a = self.parts["a"].forward(states, mask)
        self.kept = (x, states, a, kf, kb)
        return out

    def backward(self, d: np.ndarray, grads: dict) -> np.ndarray:
        x, states, a, kf, kb = self.kept
        ds = self.parts["a"].backward(states, a, d, grads["a"])
        h = ds.shape[2] // 2
        dx = self.parts["f"].backward(x, ds[:, :, :h], kf, grads["f"])
        return dx + self.parts["b"].backward(x[:, ::-1], ds[:, ::-1, h:], kb, grads["b"])[:, ::-1]

    def zeros(self) -> dict:
        return {k: {n: np.zeros_like(v) for n, v in part.p.items()} for k, part in self.parts.items()}


class Network:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.letters = rng.normal(0, 0.5, (len(_ALPHABET) + 2, CHAR_DIM)).astype(np.float32)
        self.letters[0] = 0
        self.table = np.zeros((TABLE, WORD_DIM), np.float32)  # words that training has not met add nothing
        self.chars = Both(rng, CHAR_DIM, CHAR_STATE)
        self.words = Both(rng, WORD_DIM + 2 * CHAR_STATE, STATE)
        self.out = rng.normal(0, 0.3, 2 * STATE).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.constant = False

    def vectors(self, letters: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Of distinct words: table row beside the pooled character states."""
        out = np.empty((len(slots), WORD_DIM + 2 * CHAR_STATE), np.float32)
        for at in range(0, len(slots), RUN):
            out[at : at + RUN, :WORD_DIM] = self.table[slots[at : at + RUN]]
            out[at : at + RUN, WORD_DIM:] = self.spelled(letters[at : at + RUN])
        return out

    def spelled(self, letters: np.ndarray) -> np.ndarray:
        """What chars.pooled makes of words of letters, one word a column, the longest first: a step takes those that have its letter."""
        h, n = CHAR_STATE, len(letters)
        length = (letters > 0).sum(axis=1)
        order = np.argsort(-length, kind="stable")
        columns = np.ascontiguousarray(letters[order].T)
        having = [int(k) for k in (length[:, None] > np.arange(LETTERS)).sum(axis=0)]
        states, weight = np.zeros((LETTERS, 2 * h, n), np.float32), np.full((LETTERS, n), -np.inf, np.float32)
        q = self.chars.parts["a"].p["q"]
        for k, side in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            p = self.chars.parts[k].p
            gates = (self.letters @ p["W"] + p["b"]).T.astype(np.float32)  # of every letter
            gates[: 2 * h] = 0.25 * gates[: 2 * h] + 0.5
            u1, u2 = np.ascontiguousarray(0.25 * p["U"][:, : 2 * h].T, np.float32), np.ascontiguousarray(p["U"][:, 2 * h :].T, np.float32)
            s = np.zeros((h, n), np.float32)
            for i in range(LETTERS) if k == "f" else range(LETTERS - 1, -1, -1):
                if m := having[i]:
                    x, now = gates[:, columns[i, :m]], s[:, :m]
                    a = u1 @ now
                    a += x[: 2 * h]
                    np.clip(a, 0, 1, out=a)
                    v = u2 @ (a[h:] * now)
                    v += x[2 * h :]
                    np.clip(v, -1, 1, out=v)
                    v -= now
                    v *= a[:h]
                    now += v
                    states[i, side, :m] = now
        for i, m in enumerate(having):
            weight[i, :m] = q @ states[i, :, :m]
        weight -= np.maximum(weight.max(axis=0), -1e30)
        np.exp(weight, out=weight)
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        out = np.empty((n, 2 * h), np.float32)
        out[order] = (weight[:, None] * states).sum(axis=0).T
        return out

    def train(self, docs: list[tuple[str, int]], seed: int = 2) -> Network:
        """docs: (text, 0 or 1)."""
        one_thread()
        rng = np.random.default_rng(seed)
        if len({y for _, y in docs}) < 2:
            self.constant = True
            return self
        ids: dict[str, int] = {}
        parts = []  # windows of ids, first row of each document
        count = (Counter(), Counter())
        tokens = [words_of(text) for text, _ in docs]
        for w, (_, y) in zip(tokens, docs, strict=True):
            count[y].update(set(w))
        n_y = [sum(y == k for _, y in docs) for k in (0, 1)]
        odds = {w: np.log((count[1][w] + 0.1) / (n_y[1] + 1)) - np.log((count[0][w] + 0.1) / (n_y[0] + 1)) for w in count[1] if count[1][w] >= 3}
        first, guess = [0], []
        for w in tokens:
            own = windows(w)
            guess.append(max(range(len(own)), key=lambda k: max((odds.get(x, 0) for x in own[k]), default=0)))
            parts.append(np.array([[ids.setdefault(x, len(ids) + 1) for x in win] + [0] * (WIDTH - len(win)) for win in own], np.int32))
            first.append(first[-1] + len(own))
        grid, first = np.concatenate(parts), np.array(first)
        del tokens, parts
        letters = letters_of(["", *ids])
        slots = np.array([0] + [slot_of(w) for w in ids], np.int32)
        labels = np.array([y for _, y in docs], np.float32)
        state: dict = {}
        step = 0
        for epoch in range(EPOCHS):
            if epoch >= 3:  # the worst window under the model
                score = self.logits(grid, self.vectors(letters, slots))
                guess = [int(score[a:b].argmax()) for a, b in zip(first, first[1:], strict=False)]
            chosen = first[:-1] + np.array(guess)
            other = np.array([rng.integers(a, b) for a, b in zip(first, first[1:], strict=False)])
            rows = np.concatenate((chosen, other[labels == 0]))
            y = np.concatenate((labels, np.zeros((labels == 0).sum(), np.float32)))
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                step += 1
                self._learn(grid[rows[pick]], y[pick], letters, slots, state, step, RATE * (1 - 0.9 * epoch / EPOCHS))
        return self

    def _learn(self, grid: np.ndarray, y: np.ndarray, letters: np.ndarray, slots: np.ndarray, state: dict, step: int, rate: float) -> None:
        used, inverse = np.unique(grid, return_inverse=True)
        inverse = inverse.reshape(grid.shape)
        own, mask = letters[used], (letters[used] > 0).astype(np.float32)
        pooled = self.chars.train_forward(self.letters[own], mask)
        vec = np.concatenate((self.table[slots[used]], pooled), axis=1)
        x, shown = vec[inverse], (grid > 0).astype(np.float32)
        h = self.words.train_forward(x, shown)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.bias, -30, 30)))
        d = ((p - y) / len(y)).astype(np.float32)
        g_words, g_chars = self.words.zeros(), self.chars.zeros()
        g_out = h.T @ d
        dx = self.words.backward(d[:, None] * self.out, g_words)
        d_vec = np.zeros_like(vec)
        np.add.at(d_vec, inverse.ravel(), dx.reshape(-1, dx.shape[2]))
        d_letters = self.chars.backward(d_vec[:, WORD_DIM:], g_chars)
        g_table = np.zeros_like(self.table)
        np.add.at(g_table, slots[used], d_vec[:, :WORD_DIM])
        g_let = np.zeros_like(self.letters)
        np.add.at(g_let, own.ravel(), d_letters.reshape(-1, CHAR_DIM))
        g_let[0] = 0
        todo = [("out", self.out, g_out), ("bias", self.bias, d.sum(keepdims=True)), ("table", self.table, g_table), ("letters", self.letters, g_let)]
        todo += [((n, k, m), part.p[m], g[k][m]) for n, both, g in (("w", self.words, g_words), ("c", self.chars, g_chars)) for k, part in both.parts.items() for m in part.p]
        for name, value, g in todo:  # Adam
            m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)

    def logits(self, grid: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Of windows of word numbers (0: none); vectors by number."""
        f, b = self.words.gates(vectors)
        out = np.empty(len(grid), np.float32)
        for at in range(0, len(grid), RUN):
            g = grid[at : at + RUN]
            pooled = self.words.pooled((f[g], b[g]), (g > 0).astype(np.float32))
            out[at : at + RUN] = pooled @ self.out + self.bias
        return out


def windows(words: list[str]) -> list[list[str]]:
    """The windows that training picks from: every word is in one, most are in WIDTH / STRIDE of them."""
    return [words[at : at + WIDTH] for at in range(0, max(1, len(words) - WIDTH + STRIDE), STRIDE)]


class Scorer:
    """Scores texts in batches; a worker's words keep their input gates in a bounded store."""

    def __init__(self, net: Network):
        one_thread()
        self.net, self.ids = net, {}
        self.clear()

    def clear(self) -> None:
        self.ids = {}
        f, b = self.net.words.gates(np.zeros((1, WORD_DIM + 2 * CHAR_STATE), np.float32))
        self.f, self.b = f, b

    def _room(self, n: int) -> None:
        if n > len(self.f):
            self.f, self.b = (np.concatenate((g, np.empty((max(n - len(g), len(g)), g.shape[1]), np.float32))) for g in (self.f, self.b))

    def numbers(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        new = list({w for w in words if w not in ids})
        if new:
            for w in new:
                ids[w] = len(ids) + 1
            f, b = self.net.words.gates(self.net.vectors(letters_of(new), np.array([slot_of(w) for w in new], np.int32)))
            self._room(len(ids) + 1)
            self.f[len(ids) + 1 - len(new) : len(ids) + 1], self.b[len(ids) + 1 - len(new) : len(ids) + 1] = f, b
        return np.fromiter(map(ids.__getitem__, words), np.int32, len(words))

    def every(self, numbers: np.ndarray) -> np.ndarray:
        """Logits of the windows from each of the words that WIDTH of them begin with; columns are windows."""
        net, h, n = self.net, STATE, len(numbers) - WIDTH + 1
        weight, value = np.empty((2, WIDTH, n), np.float32)
        q = net.words.parts["a"].p["q"]
        for k, gates in (("f", self.f), ("b", self.b)):
            x = np.ascontiguousarray(gates[numbers].T)
            x[: 2 * h] *= 0.25  # the slope of the gates
            x[: 2 * h] += 0.5
            u = net.words.parts[k].p["U"].T
            u1, u2 = np.ascontiguousarray(0.25 * u[: 2 * h], np.float32), np.ascontiguousarray(u[2 * h :])
            side = slice(0, h) if k == "f" else slice(h, 2 * h)
            ends = np.stack((q[side], net.out[side])).astype(np.float32)
            s = np.zeros((h, n), np.float32)
            a, v, rs = np.empty((2 * h, n), np.float32), np.empty((h, n), np.float32), np.empty((h, n), np.float32)
            for i in range(WIDTH) if k == "f" else range(WIDTH - 1, -1, -1):
                np.matmul(u1, s, out=a)
                a += x[: 2 * h, i : i + n]
                np.clip(a, 0, 1, out=a)
                np.multiply(a[h:], s, out=rs)
                np.matmul(u2, rs, out=v)
                v += x[2 * h :, i : i + n]
                np.clip(v, -1, 1, out=v)
                v -= s
                v *= a[:h]
                s += v
                e, g = ends @ s
                if k == "f":
                    weight[i], value[i] = e, g
                else:
                    weight[i] += e
                    value[i] += g
        weight = np.exp(weight - weight.max(axis=0))
        return (weight * value).sum(axis=0) / weight.sum(axis=0) + net.bias

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of each text; texts of any length, about WORDS words in memory at a time."""
        net = self.net
        if net.constant:
            return np.zeros(len(texts))
        best = np.full(len(texts), -np.inf)
        held, n = [], 0
        for k, text in enumerate(texts):
            for words in spans(text):
                held.append((k, words))
                n += len(words)
                if n >= WORDS:
                    self._raise(best, held)
                    held, n = [], 0
        self._raise(best, held)
        return 1 / (1 + np.exp(-np.clip(best, -30, 30)))

    def _raise(self, best: np.ndarray, held: list[tuple[int, list[str]]]) -> None:
        """Lifts best[k] to the logits of the windows of words, for each (k, words)."""
        if not held:
            return
        if len(self.ids) > CACHE:
            self.clear()
        net = self.net
        flat = self.numbers([w for _, words in held for w in words])
        lengths = np.array([len(words) for _, words in held])
        text = np.array([k for k, _ in held])
        starts = np.cumsum(lengths) - lengths
        padded = np.append(flat, 0)
        short = np.flatnonzero(lengths < WIDTH)  # one window each
        for at in range(0, len(short), RUN):
            o = short[at : at + RUN]
            inside = np.arange(WIDTH) < lengths[o, None]
            grid = padded[np.where(inside, starts[o, None] + np.arange(WIDTH), len(flat))]
            pooled = net.words.pooled((self.f[grid], self.b[grid]), (grid > 0).astype(np.float32))
            np.maximum.at(best, text[o], pooled @ net.out + net.bias)
        own = lengths >= WIDTH
        run = flat[np.repeat(own, lengths)]
        owner = np.repeat(np.flatnonzero(own), lengths[own])
        for at in range(0, len(run) - WIDTH + 1, SPAN):
            part = run[at : at + SPAN + WIDTH - 1]
            n = len(part) - WIDTH + 1
            first, last = owner[at : at + n], owner[at + WIDTH - 1 : at + WIDTH - 1 + n]
            logit = self.every(part)
            whole = np.flatnonzero(first == last)  # the others reach into the next text
            if len(whole):
                first, logit = first[whole], logit[whole]
                begin = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
                np.maximum.at(best, text[first[begin]], np.maximum.reduceat(logit, begin))


def spans(text: str) -> Iterator[list[str]]:
    """The words of a text, a long one's in parts of about WORDS that share all but one word of a window, so that every window is in one."""
    kept: list[str] = []
    for part in slices(text):
        words = kept + words_of(part)
        at = 0
        while len(words) - at > WORDS + WIDTH:
            yield words[at : at + WORDS]
            at += WORDS - WIDTH + 1
        if part is not text:  # more may follow
            kept = words[at:]
        else:
            yield words[at:]
            return
    yield kept


def slices(text: str) -> Iterator[str]:
    """A long text in parts of CHARS characters and on to the next white space; a shorter one as it is."""
    if len(text) <= CHARS:
        yield text
        return
    at = 0
    while at < len(text):
        gap = _GAP.search(text, min(len(text), at + CHARS))
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def fold(id_col: str, folds: int):
    """crc32 of the id as decimal text, modulo folds."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, where=None, sample: dict[int, int] = SAMPLE) -> Network:
    """A network from at most sample[label] documents of each label; where: a condition on labels' doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))  # an id labelled twice
    draw = F.xxhash64("doc_id")
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(draw, "doc_id").limit(sample[y])
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text").collect()  # the sampled ids are broadcast
    rows = sorted({r["doc_id"]: r for r in rows}.values(), key=lambda r: r["doc_id"])
    return Network().train([(r["text"], r["y"]) for r in rows])


def _scored(model, batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with the scores of their column number at; what a worker remembers ends with its task."""
    scorer = Scorer(model.value)
    for b in batches:
        for start in range(0, len(b), 128):
            part = b.slice(start, 128)
            yield part, scorer.score([t or "" for t in part.column(at).to_pylist()])
    del scorer
    give_back()


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # of a fixed size: TABLE and the states
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scored(model, batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, net: Network, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below the threshold, all columns as they were.

    Null and empty texts have the score of an empty window, repeated rows go or stay together, null ids and columns of
    other names pass through, an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _scored(model, batches, at):
            yield part.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, docs.schema)
