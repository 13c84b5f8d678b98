"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

The queries are written to the shared folder in blocks. Rows stay where they are: a task takes its rows in blocks of
BLOCK vectors, sorts every random projection of a block once into an array, and searches it for all blocks of queries:
that is the stated query set against all rows, in blocks, with bounded memory, and no row is moved or repeated. A query opens a window around its own projection in each array;
virtual rehashing widens all windows together from radius to radius. A vector that lies in the windows of at least
THRESHOLD of the projections is verified by its cosine in double precision. The search of a block ends when as many
verified vectors as asked for lie within the radius, or when the radius covers the sphere (then all are verified).

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without an id; vectors only meet vectors of their own length; equal scores go to the smaller id; a repeated id counts
as another candidate unless it is the query's own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir
from .ngram import get, put

#: Vectors in a block of rows and in a block of queries; projections, and the share of them that a candidate collides in.
BLOCK, QUERY_BLOCK, PROJECTIONS, THRESHOLD = 4096, 2048, 64, 0.52
#: First radius (as a distance of unit vectors), factor from radius to radius, and the one that covers the sphere.
FIRST, GROWTH, LAST = 0.15, 1.3, 2.0


class Block:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = 17):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        axes = np.random.default_rng(seed).standard_normal((projections, vectors.shape[1]))
        self.axes = axes
        self.order = np.empty((projections, len(ids)), np.int32)
        self.sorted = np.empty((projections, len(ids)))
        unit = vectors / self.norms[:, None]
        for j in range(projections):
            at = (unit * axes[j]).sum(axis=1)
            self.order[j] = np.argsort(at, kind="stable")
            self.sorted[j] = at[self.order[j]]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (ids, cosines) of its k nearest found, nearest first."""
        m, n = self.order.shape
        need = int(np.ceil(THRESHOLD * m))
        norms = np.sqrt((queries * queries).sum(axis=1))
        centre = np.stack([(queries / norms[:, None] * a).sum(axis=1) for a in self.axes], axis=1)
        found: list = [None] * len(queries)
        counts = np.zeros((len(queries), n), np.uint16)
        score = np.full((len(queries), n), np.nan)
        lo = np.stack([np.searchsorted(self.sorted[j], centre[:, j]) for j in range(m)], axis=1)
        hi, radius, open_ = lo.copy(), FIRST, np.arange(len(queries))
        while len(open_):
            whole = radius >= LAST
            left = np.stack([np.searchsorted(self.sorted[j], centre[open_, j] - radius, "left") for j in range(m)], axis=1)
            right = np.stack([np.searchsorted(self.sorted[j], centre[open_, j] + radius, "right") for j in range(m)], axis=1)
            still = []
            for row, q in enumerate(open_):
                if whole:
                    new = np.flatnonzero(np.isnan(score[q]))
                else:
                    parts = [self.order[j, a:b] for j, (a, b) in enumerate(zip(left[row], lo[q], strict=True)) if a < b] + [self.order[j, a:b] for j, (a, b) in enumerate(zip(hi[q], right[row], strict=True)) if a < b]
                    if parts:
                        counts[q] += np.bincount(np.concatenate(parts), minlength=n).astype(np.uint16)
                    lo[q], hi[q] = np.minimum(lo[q], left[row]), np.maximum(hi[q], right[row])
                    new = np.flatnonzero((counts[q] >= need) & np.isnan(score[q]))
                if len(new):
                    score[q, new] = (self.vectors[new] * queries[q]).sum(axis=1) / (self.norms[new] * norms[q])
                near = np.flatnonzero(~np.isnan(score[q]) & (self.ids != own[q]))
                if whole or (len(near) >= k and (score[q, near] >= 1 - radius * radius / 2).sum() >= k):
                    best = near[np.lexsort((self.ids[near], -score[q, near]))[:k]]
                    found[q] = (self.ids[best], score[q, best])
                else:
                    still.append(q)
            open_, radius = np.array(still, np.int64), radius * GROWTH
        return found


def _matrix(t: pa.Table) -> np.ndarray:
    v = t.column("vector").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    inf = F.lit(float("inf"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda x: x != 0))


def search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest rows; both inputs hold id and vector."""
    folder = shared_dir(rows.sparkSession)
    asked = valid(queries, id_col, vector_col)
    parts = max(1, -(-asked.count() // query_block))

    def store(key: tuple, t: pa.Table) -> pa.Table:
        dim, part = (v.as_py() for v in key)
        put(f"{folder}/queries-{dim}-{part}", {"id": t.column("id").to_numpy(), "vector": _matrix(t).ravel()})
        return pa.table({"dim": pa.array([dim], pa.int32()), "part": pa.array([part], pa.int32())})

    dealt = asked.withColumns({"dim": F.size("vector"), "part": F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")})
    stored: dict[int, list[int]] = {}
    for r in dealt.groupBy("dim", "part").applyInArrow(store, "dim int, part int").collect():
        stored.setdefault(r["dim"], []).append(r["part"])
    names = ("query_id", "vec_id", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def found(dim: int) -> Iterator[pa.RecordBatch]:
            ids, vectors = (np.concatenate(p) for p in zip(*held.pop(dim), strict=True))
            for at in range(0, len(ids), block):
                index = Block(ids[at : at + block], vectors[at : at + block])
                for part in stored[dim]:
                    a = get(f"{folder}/queries-{dim}-{part}")
                    best = index.search(a["id"], a["vector"].reshape(-1, dim), k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a["id"], [len(f[0]) for f in best])), *[pa.array(np.concatenate([f[c] for f in best])) for c in (0, 1)]], names=names)

        for b in batches:
            ids, v = b.column(0).to_numpy(), b.column(1)
            lengths = v.value_lengths().to_numpy()
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                if dim not in stored:
                    continue  # no query of this length
                vectors = v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
                held.setdefault(int(dim), []).append((ids[own], vectors))
                if sum(len(i) for i, _ in held[int(dim)]) >= block:
                    yield from found(int(dim))
        for dim in list(held):
            yield from found(dim)

    met = valid(rows, id_col, vector_col).mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
