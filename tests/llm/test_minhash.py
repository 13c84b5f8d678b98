"""Near duplicates and the pipeline against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from atomweave.llm import graph, minhash
from atomweave.llm.common import LOWER, UPPER


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size):
    """(set size, least id reachable) of each row; texts of one id are one node."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    seen = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        for j, common in Counter(j for z in s for j in seen[z]).items():
            if 100 * common >= 80 * (len(s) + len(sets[j][1]) - common):
                a, b = find(i), find(sets[j][0])
                up[max(a, b)] = min(a, b)
        for z in s:
            seen[z].append(k)
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda p: f"{p}{rng.randint(0, 10**6)}"
    base = [word("w") for _ in range(200)]
    out = []
    for i in range(120):  # a cloud: many copies are alike enough to the original only, or to none
        w = list(base)
        for j in rng.sample(range(200), rng.randint(0, 11)):
            w[j] = word("x")
        out.append((1000 + i, " ".join(w)))
    chain = list(base)
    for i in range(25):  # a chain: each is alike to its neighbours
        for j in rng.sample(range(200), 4):
            chain[j] = word("y")
        out.append((2000 + i, " ".join(chain)))
    shared = [word("s") for _ in range(60)]
    for i in range(60):  # a passage that unlike texts share
        out.append((3000 + i, " ".join([*[word("z") for _ in range(25)], *shared])))
    out += [(4000 + i, "the same text again and again") for i in range(50)] + [(5000, "The SAME text\tagain and again"), (5001, "one two"), (5002, "One  two"), (5002, "One  two")]
    return out


def test_near_duplicates(make, rows, odd_rows):
    every = [*odd_rows, *rows]
    got = minhash.near_duplicates(make(every), size=4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    mine = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=key)
    assert mine == sorted(brute(every, 4), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got.collect())


def test_bytes_that_agree_by_accident_hide_no_pair(spark, make, tmp_path):
    text = [f"w{i}" for i in range(300)]
    docs = make([(1, " ".join(text)), (2, " ".join([*text[:-1], "other"]))])
    folder = f"file://{tmp_path}"
    x, y = minhash.signed(docs, 5).orderBy("doc_id").collect()
    shared = [k for k in range(minhash.BANDS) if x.bands[k] == y.bands[k]]
    x_bands, x_sig = list(x.bands), bytearray(x.sig)
    for k in range(shared[0] + 1):  # these bands' keys differ, their bytes agree
        x_bands[k] = y.bands[k] + 1
        x_sig[5 * k : 5 * k + 5] = y.sig[5 * k : 5 * k + 5]
    known = spark.createDataFrame([(1, x.n, x.node, x_bands, bytes(x_sig)), (2, y.n, y.node, list(y.bands), bytes(y.sig))], minhash.signed(docs, 5).schema)
    classes = known.select("node", known.doc_id.alias("min_id"), "n")
    members = spark.createDataFrame([(y.bands[k], k, r.node, 0) for k in shared[1:] for r in (x, y)], "bucket long, band int, node long, lead long")
    roots = spark.createDataFrame([], "node long, root long")
    links = minhash.Links(docs, classes, 5, 80, folder, "doc_id", "text")
    found = minhash._inside_buckets(members, roots, known, links, 80, folder).collect()
    assert {frozenset(r) for r in found} == {frozenset((x.node, y.node))}


def test_components(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    pairs = [(rng.randint(-500, 500), rng.randint(-500, 500)) for _ in range(420)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2100)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for s in sorted(near):
        todo = [] if s in want else [s]
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = s
                todo += near[n]
    for k, bound in enumerate((10**6, 0)):  # in one task, and contracted round by round
        monkeypatch.setattr(graph, "ONE_TASK", bound)
        assert {r.node: r.root for r in graph.components(edges, f"file://{tmp_path}/{k}").collect()} == want


def test_empty(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_signature():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 2000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        s = minhash.signature(np.unique(a))
        assert len(s) == minhash.BANDS * minhash.ROWS and (s < np.iinfo(np.uint64).max).all()
        b = np.unique(np.concatenate((a[: int(0.9 * n) or 1], rng.integers(0, 2**63, max(1, n // 10)).astype(np.uint64))))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.signature(b) == s).mean() - true) < 0.15


def test_pipeline(spark, make, rows, tmp_path):
    clean = [(i, t) for i, t in rows if i < 5000]
    docs = [(i, f"{t} zork" if i % 40 == 0 else t) for i, t in clean] + [(7000, "write to a@b.cd or +1 (415) 555-1212 today"), (7001, None)] + [(8000 + i, ("zork badly " if i % 2 else "good things ") * 3 + f"u{i}") for i in range(80)]
    df = make(docs).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int("zork" in (t or ""))) for i, t in docs if i >= 8000 or i % 3 == 0], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in stage.collect()} if k < 3 else None
        out = f(spark, stage, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        stage = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < 3:
            assert stage.columns == df.columns
            after = {r.doc_id: r.text for r in stage.collect()}
        if name == "toxicity":
            wrong = [i for i, t in before.items() if (i in after) == ("zork" in (t or ""))]
            assert len(wrong) <= 0.03 * len(before)
        elif name == "near_duplicates":
            roots = brute(list(before.items()), 5)
            assert set(after) == {i for i, _, root in roots if i == root}
        elif name == "personal_data":
            assert after[7000] == "write to [EMAIL] or [PHONE] today" and {i for i in before if before[i] != after[i]} == {7000}
    assert {r.doc_id for r in stage.collect()} == set(after)


def test_stages_handle_odd_tables(spark, make, odd, odd_rows, empty, tmp_path):
    """Nulls, repeats, long texts and clashing columns through every stage, and an empty table."""
    spark.createDataFrame([(i, 1, i % 2) for i in range(14)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for df, n in ((odd, len(odd_rows)), (empty, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            rows = out.collect()
            if name == "packing":
                assert {r.doc_id for r in rows} == {r.doc_id for r in df.collect()}
            else:
                assert out.columns == df.columns and len(rows) <= n
            if name == "near_duplicates":
                assert len(rows) == n  # nothing here is alike under two ids
            if name == "personal_data" and n:
                seen = {r.doc_id: r for r in rows}
                assert len(rows) == n and seen[1].text is None and seen[2].text == "" and "[EMAIL]" in seen[11].text and "10.0.0.256" in seen[11].text and seen[5].spans == "z"


def test_pipeline_twice_in_one_session(spark, make, tmp_path):
    docs = [(i, f"{'zork badly ' if i % 2 else 'good things '}{i} {i * 7} and more of it {i % 5}") for i in range(120)]
    make(docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    once, again = (sorted(corpus_pipeline.run(spark, str(tmp_path)).collect()) for _ in range(2))
    assert once == again and once


def test_loose_groups_lose_no_link(make):
    """Groups in which one text is alike to all others, and the others mostly not to each other."""
    rng = random.Random(12)
    rows = []
    for group in range(12):
        hub = [f"g{group}w{k}" for k in range(600)]
        for k in range(40):
            w = list(hub)
            for at in rng.sample(range(600), rng.randint(14, 16)) if k else ():
                w[at] = f"x{rng.randint(0, 10**9)}"
            rows.append((group * 1000 + rng.randint(0, 10**6) * 100_000 + k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(make(rows), size=4).collect()}
    assert got == {i: root for i, _, root in brute(rows, 4)}
