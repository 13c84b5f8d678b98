"""Near duplicates among texts: SuperMinHash, banding, verification on full shingle sets, union of the links.

1. Every text becomes its set of hashed word shingles; equal sets are one class, known by a 64-bit hash of the set.
   The signature is SuperMinHash: each element takes the places in an order of its own with ranks that grow from round
   to round, so places are filled evenly and the rounds stop once no later rank can win (for most texts after one).
2. Bands of the signature put classes into buckets. In every bucket each class is verified against the least one:
   as many pairs as members, however large the bucket.
3. Buckets that these links don't make one component go on: members outside the least one's component meet the others
   in blocks that hold their sets. Signatures are compared in place, the most alike pairs first; pairs that are joined
   already are passed over, the rest is verified there and then, and only links that join components leave the block.
   So no link between different texts is lost to the star of step 2, and no pair that fails becomes a row.

A pair of similarity 0.8 shares a band but for a probability of (1 - 0.8**ROWS)**BANDS = 3e-6, and fails the
comparison of signatures in step 3 with about 5e-6. Two different sets share a class with probability 2**-64.

Defined results: a text without words (null too) has an empty set and links with nothing; rows without an id have
null component and are kept; repeated rows get repeated results; an id with several texts is judged text by text;
other columns are ignored; texts of any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, remove, shared_dir, small_batches
from .graph import components

#: Bands of a signature and places in each.
BANDS, ROWS = 32, 5
#: Share of equal places from which step 3 verifies a pair, members of a block of it, classes that a broadcast may name.
ALIKE, BLOCK, BROADCAST = 0.66, 256, 2_000_000
#: Word hashes that a worker remembers.
CACHE = 200_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str, size: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; one of all words if there are fewer than size."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and only the six ASCII white-space characters
    n = len(found)
    if not n:
        return np.empty(0, _U)
    if len(words) > CACHE:
        words.clear()
    h = np.fromiter(map(words.__getitem__, found), _U, n)
    if n < size:
        size = n
    out = np.full(n - size + 1, size, _U)
    for i in range(size):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : n - size + 1 + i])
    return np.unique(out)


def signature(elements: np.ndarray, places: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash of a non-empty set: per place the least (round, fraction) as round << 32 | fraction."""
    n = len(elements)
    best = np.full(places, np.iinfo(np.uint64).max, _U)
    order = None
    for j in range(places):
        x = mix(elements + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + (((x & _U(0xFFFFFFFF)) * _U(places - j)) >> _U(32)).astype(np.int64)
        if j == 0:
            place, first = k, k
        else:
            rows = np.arange(n)
            if order is None:  # each element's order of the places, with the first exchange made
                order = np.tile(np.arange(places, dtype=np.int16), (n, 1))
                order[rows, first] = 0
                order[:, 0] = first
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
            order[:, j] = place
        np.minimum.at(best, place, (_U(j) << _U(32)) | (x >> _U(32)))
        if best.max() < _U(j + 1) << _U(32):
            break
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=_U))
    for i in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def similar(x, y, percent: int) -> bool:
    """Whether two sets (buffers of sorted hashes) have at least percent of their union in common."""
    both = np.concatenate((np.frombuffer(x, _U), np.frombuffer(y, _U)))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def set_hash(elements: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(elements.tobytes()), _U).view(np.int64))


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])


def signed(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (set size), node (class), bands and sig (a byte for each place); the last three null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = _Words(), {}
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text in b.column(1):
                s = shingle_set(text.as_py() or "", size, words)
                if not len(s):
                    row = (0, None, None, None)
                else:
                    node = set_hash(s)
                    if node not in last:
                        if len(last) > 2000:
                            last.clear()
                        sig = signature(s)
                        last[node] = (len(s), node, band_keys(sig), (mix(sig) & _U(255)).astype(np.uint8).tobytes())
                    row = last[node]
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())], schema=_SIGNED)
        del words, last
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, node long, bands array<long>, sig binary")


class Links:
    """Verification of pairs of classes, and the links that it has found."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, percent: int, folder: str, id_col: str, text_col: str):
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.classes, self.size, self.percent, self.folder, self.turn = classes, size, percent, folder, 0

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, elements of the classes named, made anew from the text of one document of each."""
        size = self.size
        ids = nodes.join(self.classes, "node").select(F.col("min_id").alias("doc_id")).distinct()
        small = ids.limit(BROADCAST + 1).count() <= BROADCAST
        texts = self.docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = _Words()
            for b in batches:
                for text in b.column(1):
                    s = shingle_set(text.as_py() or "", size, words)
                    if len(s):
                        yield pa.RecordBatch.from_arrays([pa.array([set_hash(s)], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["node", "elements"])
            del words
            give_back()

        made = texts.mapInArrow(run, "node long, elements binary")
        return made.groupBy("node").agg(F.first("elements").alias("elements"))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """a, b, linked of pairs (a, b) of classes, written to the shared folder."""
        percent, here = self.percent, f"{self.folder}/verify{self.turn}"
        self.turn += 1
        # sizes alone rule out most unlike pairs before any set is made
        n = self.classes.select("node", "n")
        sized = pairs.join(n.withColumnsRenamed({"node": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"node": "b", "n": "nb"}), "b")
        sized = cut(sized.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"), f"{here}-pairs")
        sets = cut(self.sets(sized.select(F.col("a").alias("node")).union(sized.select("b")).distinct()), f"{here}-sets")
        met = sized.join(sets.withColumnsRenamed({"node": "b", "elements": "eb"}), "b").join(sets.withColumnsRenamed({"node": "a", "elements": "ea"}), "a")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                linked = [similar(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked)], names=["a", "b", "linked"])

        return cut(met.select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long, linked boolean"), f"{here}-linked")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links), kept, one row per row of docs."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    marked = cut(signed(docs, size, id_col, text_col), f"{folder}/signed")
    known = marked.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut(known.groupBy("node").agg(F.min("doc_id").alias("min_id"), F.min("n").alias("n")), f"{folder}/classes")
    # one row of each class: its least id's (rows repeated within one id are equal)
    ones = known.join(classes.select("node", F.col("min_id").alias("doc_id")), ["node", "doc_id"], "left_semi").select("node", "bands").dropDuplicates(["node"])
    placed = ones.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("_last")).where("lead < _last").select("bucket", "lead")
    members = cut(placed.join(shared, "bucket").where("node != lead"), f"{folder}/members")
    links = Links(docs, classes, size, percent, folder, id_col, text_col)
    star = links.verify(members.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()).where("linked").select("a", "b")
    roots = cut(components(star, f"{folder}/star"), f"{folder}/roots")
    found = star.unionByName(cut(_inside_buckets(members, roots, known, links, percent, folder), f"{folder}/inside"))
    roots = cut(components(found, f"{folder}/all"), f"{folder}/components")
    for done in ("members", "star", "roots", "inside", "open", "open-sets", "blocks", "all", *[f"verify{k}-{t}" for k in range(links.turn) for t in ("pairs", "sets", "linked")]):
        remove(spark, f"{folder}/{done}")
    least = classes.join(roots, "node", "left").select("node", "min_id", F.coalesce("root", "node").alias("root"))
    named = least.join(least.groupBy("root").agg(F.min("min_id").alias("component_id")), "root").select("node", "component_id")
    out = marked.select("doc_id", "n", "node").join(named, "node", "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _inside_buckets(members: DataFrame, roots: DataFrame, known: DataFrame, links: Links, percent: int, folder: str) -> DataFrame:
    """Links (a, b) that join different components inside buckets: all that are needed to join them."""
    r = roots.withColumnsRenamed({"node": "lead", "root": "lead_root"})
    rooted = members.join(roots, "node", "left").join(r, "lead", "left")
    rooted = rooted.select("bucket", "band", "node", F.coalesce("root", "node").alias("root"), F.coalesce("lead_root", "lead").alias("lead_root"))
    sizes = rooted.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("s"), F.sum((F.col("root") != F.col("lead_root")).cast("long")).alias("out"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("_same"))
    # of buckets of the same members the first band's stays
    open_ = sizes.where("out > 0 and s > 1").groupBy("s", "_same").agg(F.min(F.struct("band", "bucket", "out")).alias("_b")).select("_b.bucket", "s", "_b.out")
    inside = rooted.join(open_, "bucket")
    nodes = cut(inside.select("node").distinct(), f"{folder}/open")
    sets = cut(links.sets(nodes), f"{folder}/open-sets")
    sigs = known.select("node", "sig", "bands", "n").join(nodes, "node", "left_semi").dropDuplicates(["node"])
    full = cut(inside.join(sigs.join(sets, "node"), "node"), f"{folder}/blocks")
    again = full.sparkSession.read.schema(full.schema).parquet(f"{folder}/blocks")  # the sides of a cogroup must not share columns
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    carried = ("node", "root", "sig", "bands", "n", "elements")
    left = full.where("root != lead_root").select("bucket", deal(F.col("out")).alias("x"), F.explode(F.sequence(F.lit(0), blocks(F.col("s")) - 1)).alias("y"), *carried)
    right = again.select("bucket", F.explode(F.sequence(F.lit(0), blocks(F.col("out")) - 1)).alias("x"), deal(F.col("s")).alias("y"), *carried, "band")
    need = int(ALIKE * BANDS * ROWS)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:  # a side without rows has no columns either
            return pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
        band = b.column("band")[0].as_py()
        (na, ra, za), (nb, rb, zb) = ([t.column(c).to_numpy() for c in ("node", "root", "n")] for t in (a, b))
        sa, sb = (np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1) for t in (a, b))
        ka, kb = (t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, BANDS) for t in (a, b))
        alike = []
        for i in range(len(na)):
            equal = (sb == sa[i]).sum(axis=1)
            fit = 100 * np.minimum(zb, za[i]) >= percent * np.maximum(zb, za[i])
            ok = np.flatnonzero((equal >= need) & (rb != ra[i]) & fit)
            # a pair is looked at under the first band that it shares only, told by the keys that made the buckets
            ok = ok[(kb[ok] == ka[i]).argmax(axis=1) == band]
            alike += [(-int(equal[j]), i, int(j)) for j in ok]
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        ea, eb = a.column("elements"), b.column("elements")
        out = []
        for _, i, j in sorted(alike):  # the most alike first; what is joined already needs no test
            p, q = find(int(ra[i])), find(int(rb[j]))
            if p != q and similar(ea[i].as_buffer(), eb[j].as_buffer(), percent):
                up[max(p, q)] = min(p, q)
                out.append((int(na[i]), int(nb[j])))
        return pa.table([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    key = ("bucket", "x", "y")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "a long, b long")


def drop_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but those whose id is in a group of near duplicates with a lesser id.

    Rows without an id and texts without words stay; repeated rows of one id stay or go together; columns of other names
    pass through; an empty table stays empty.
    """
    found = near_duplicates(docs, size, percent)
    gone = cut(found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("doc_id"), shared_dir(docs.sparkSession))
    small = gone.limit(BROADCAST + 1).count() <= BROADCAST
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti")
