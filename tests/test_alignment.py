import itertools

import numpy as np
import pytest

from atomweave.operators import alignment


def plain(a, b, score=None, open_=alignment.OPEN, extend=alignment.EXTEND):
    """The whole table, cell by cell; of ways that are as good the first of pair, gap of b, gap of a."""
    score = score or (lambda x, y: 1.0 if x == y else -1.0)
    n, m = len(a), len(b)
    s, back = np.full((3, n + 1, m + 1), -np.inf), np.zeros((3, n + 1, m + 1), int)
    s[0, 0, 0] = 0
    for i, j in itertools.product(range(n + 1), range(m + 1)):
        for k, (p, q) in enumerate(((1, 1), (1, 0), (0, 1))):
            if i >= p and j >= q and i + j:
                came = [s[r, i - p, j - q] + (score(a[i - 1], b[j - 1]) if k == 0 else extend if r == k else open_) for r in range(3)]
                back[k, i, j] = int(np.argmax(came))
                s[k, i, j] = came[back[k, i, j]]
    out, i, j, k = [], n, m, int(s[:, n, m].argmax())
    while i or j:
        came = back[k, i, j]
        if k == 0:
            out.append((i - 1, j - 1))
        i, j, k = i - (k != 2), j - (k != 1), came
    return out[::-1]


@pytest.mark.parametrize(("band", "kept"), [(1, 2), (2, 3), (64, 256)])
def test_band_and_rows_made_again(monkeypatch, band, kept):
    monkeypatch.setattr(alignment, "BAND", band)
    monkeypatch.setattr(alignment, "KEPT", kept)
    monkeypatch.setattr(alignment.math, "isqrt", lambda n: 1)
    rng = np.random.default_rng(band)
    for n, m in [(0, 0), (0, 3), (4, 0), (1, 1), (1, 9), (9, 1), *rng.integers(1, 40, (60, 2)).tolist()]:
        a = rng.integers(0, 3, n).tolist()
        b = rng.integers(0, 3, m).tolist() if rng.random() < 0.4 else (a + [None, None] + a)[int(rng.integers(0, 5)) :][:m]
        for open_, extend in ((-10.0, -1.0), (-1.0, -1.0), (-2.0, -3.0), (0.0, 0.0)):
            assert alignment.align(a, b, open_=open_, extend=extend) == plain(a, b, open_=open_, extend=extend)
        own = lambda x, y: 3.0 if x == y else -2.0 if x is None or y is None else float(x - y)
        assert alignment.align(a, b, own) == plain(a, b, own)


def test_long_names():
    """20000 names against those without some in the middle: the whole table would take 10 GB."""
    a = [f"N{k * k % 7919}" for k in range(20000)]
    assert alignment.align(a, a[:9000] + a[9100:]) == [(k, k if k < 9000 else k - 100) for k in range(20000) if not 9000 <= k < 9100]


def test_fit_of_many_atoms(spark):
    """One group of 20000 atoms, of which some in the middle are missing on the other side."""
    from pyspark.sql import functions as F

    n = 20000
    p = spark.range(n).select(F.col("id").alias("atom_idx"), F.concat(F.lit("N"), F.pmod(F.col("id") * F.col("id"), F.lit(7919)).cast("string")).alias("name"), F.lit(1.0).alias("mass"), *[F.sin(F.col("id") * k + 1.0).alias(c) for k, c in enumerate("xyz", 1)])
    moved = p.where("atom_idx < 9000 or atom_idx >= 9100").withColumns({"x": -F.col("y") + 2.0, "y": F.col("x") + 1.0})
    fit = alignment.fit_matching(p, moved.withColumn("atom_idx", F.when(F.col("atom_idx") < 9000, F.col("atom_idx")).otherwise(F.col("atom_idx") - 100))).first()
    assert np.allclose(fit["rotation"], [0, -1, 0, 1, 0, 0, 0, 0, 1]) and np.allclose(fit["shift"], [2, 1, 0])
