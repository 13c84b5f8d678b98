"""Atoms of two selections matched by name along the best global alignment, for superposition."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import measure

MATCH, MISMATCH, OPEN, EXTEND = 1.0, -1.0, -10.0, -1.0
#: Diagonals to each side that are tried first, and rows of the table from one that is held to the next, at least.
BAND, KEPT = 64, 256


def _row(s: np.ndarray, scores: np.ndarray, lows: tuple[int, int], open_: float, extend: float, back: np.ndarray | None) -> np.ndarray:
    """The row of scores after s; both begin at the columns lows. scores: of the pair that ends in each column.

    Scores end in a pair, in a gap of b, in a gap of a. back, if given, gets from which of these each came.
    """
    n, by = s.shape[1], lows[1] - lows[0]
    up, slant = np.full((3, n), -np.inf), np.full((3, n), -np.inf)  # of the row before: the same column and the one before
    up[:, : n - by] = s[:, by:]
    slant[:, 1 - min(by, 1) : n - by + 1] = s[:, max(by - 1, 0) : n - 1 + min(by, 1)]
    out = np.empty((3, n))
    out[0] = np.maximum(np.maximum(slant[0], slant[1]), slant[2]) + scores
    over = np.stack([up[0] + open_, up[1] + extend, up[2] + open_])
    out[1] = np.maximum(np.maximum(over[0], over[1]), over[2])
    # a gap of a goes on from any column before: the best start, less what the way to it would have cost
    k = np.arange(n) * extend
    starts = np.maximum(out[0], out[1]) + open_ - k
    out[2, 0] = -np.inf
    out[2, 1:] = np.maximum.accumulate(starts[:-1]) + k[:-1]
    if back is not None:
        beside = np.full((3, n), -np.inf)
        beside[:, 1:] = out[:, :-1] + np.array([[open_], [open_], [extend]])
        for q, came in enumerate((slant, over, beside)):
            back[q] = came.argmax(axis=0)
    return out


def _first(n: int, open_: float, extend: float) -> np.ndarray:
    s = np.full((3, n), -np.inf)
    s[0, 0] = 0
    s[2, 1:] = open_ + np.arange(n - 1) * extend
    return s


def align(a: Sequence, b: Sequence, score: Callable | None = None, open_: float = OPEN, extend: float = EXTEND) -> list[tuple[int, int]]:
    """Pairs of places of the best global alignment with affine gaps (a gap of n costs open + (n - 1) * extend).

    Without a score of one's own a band of the table is enough if no way that leaves it could be as good; it is widened
    until that holds. Of the rows one in KEPT or more is held, those between are made again on the way back.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if score is None:
        known: dict = {}
        p, q = (np.array([known.setdefault(x, len(known)) for x in side]) for side in (a, b))
    every = max(KEPT, math.isqrt(8 * n))
    band = BAND if score is None and open_ <= 0 and extend <= 0 else n + m
    while True:
        low, high = min(0, m - n) - band, max(0, m - n) + band  # diagonals, column less row
        width = min(m + 1, high - low + 1)
        begins = [max(0, min(i + low, m + 1 - width)) for i in range(n + 1)]

        def made(i: int, s: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
            at = begins[i]
            if score is None:
                found = np.where(q[max(at - 1, 0) : at + width - 1] == p[i - 1], MATCH, MISMATCH)
            else:
                found = np.array([score(a[i - 1], y) for y in b[max(at - 1, 0) : at + width - 1]], float)
            if at == 0:
                found = np.concatenate([[-np.inf], found])
            return _row(s, found, (begins[i - 1], at), open_, extend, back)

        kept, s = [], _first(m + 1, open_, extend)[:, :width]
        for i in range(n + 1):
            s = made(i, s) if i else s
            if i % every == 0:
                kept.append(s)
        k = int(s[:, -1].argmax())
        # outside the band a way has band + 1 gaps on one side and on the other, besides those that the lengths ask for
        rest = min(n, m) - (band + 1)
        if width == m + 1 or s[k, -1] > max(rest, 0) * MATCH + 2 * open_ + (2 * band + abs(n - m)) * max(open_, extend):
            break
        band *= 4
    out, i, j = [], n, m
    back = np.zeros((0, 3, width), np.int8)
    base = n + 1  # back holds the rows behind it
    while i and j:  # then only a gap is left
        if i <= base:
            base = (i - 1) // every * every
            back, s = np.zeros((i - base, 3, width), np.int8), kept[base // every]
            for r in range(base + 1, i + 1):
                s = made(r, s, back[r - base - 1])
        came = int(back[i - base - 1, k, j - begins[i]])
        if k == 0:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif k == 1:
            i -= 1
        else:
            j -= 1
        k = came
    return out[::-1]


def matches(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j: atoms of equal names that the alignment of both name sequences pairs."""
    own = list(keys) or ["_all"]
    if not keys:
        a, b = a.withColumn("_all", F.lit(0)), b.withColumn("_all", F.lit(0))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in a.schema if f.name in own)

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame(columns=[*own, "i", "j"])
        p, q = p.sort_values("atom_idx").reset_index(drop=True), q.sort_values("_b_idx").reset_index(drop=True)
        one, two = p.name_.tolist(), q._b_name.tolist()
        found = np.array([(i, j) for i, j in align(one, two) if one[i] == two[j]], int).reshape(-1, 2)
        out = pd.DataFrame({"i": p.atom_idx.to_numpy()[found[:, 0]], "j": q._b_idx.to_numpy()[found[:, 1]]})
        for k in own:
            out[k] = p[k][0]
        return out[[*own, "i", "j"]]

    side = lambda d: d.select(*own, "atom_idx", F.col("name").alias("name_")).groupBy(*own)
    b = b.select(*[F.col(k).alias(f"_b_{k}") for k in own], F.col("atom_idx").alias("_b_idx"), F.col("name").alias("_b_name")).groupBy(*[f"_b_{k}" for k in own])  # the sides of a cogroup must not share columns
    return side(a).cogroup(b).applyInPandas(run, f"{head}, i long, j long").drop("_all")


def fit_matching(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """rotation and shift that lay the matched atoms of a on those of b."""
    side = lambda d, n, c: d.select(*keys, F.col("atom_idx").alias(c), *[F.col(x).alias(f"{x}{n}") for x in "xyz"], F.col("mass").alias(f"m{n}"))
    met = matches(a, b, keys).join(side(a, 1, "i"), [*keys, "i"]).join(side(b, 2, "j"), [*keys, "j"])
    return measure.fit_pairs(met, keys)
