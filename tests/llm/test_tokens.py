"""Encoding and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from atomweave.llm import bpe, packing  # noqa: E402
from atomweave.llm.queries import table, tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def texts(spark, sf_dir, odd_rows):
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdethining") for _ in range(rng.randint(60, 2500))) for _ in range(40)]
    made += ["".join(rng.choice("aé日1!-_=ñ") for _ in range(rng.randint(60, 900))) for _ in range(40)] + ["".join(rng.choice("ab \n\t é1.") for _ in range(60)) for _ in range(200)]
    made += ["ab" * 300, "the" * 500, "ÉÀ" * 200, "Σίσυφος ΟΔΟΣ", "don't we're I'LL", "<|endoftext|>a<|startoftext|> b", "'''s've", "a b c"]
    return [t for _, t in odd_rows] + made + [r.text for r in table(spark, sf_dir, "documents").collect()]


def test_word_bpe(texts):
    path = tokenizer_path("word_bpe_49k.json")
    lib, own = tokenizers.Tokenizer.from_file(path), bpe.WordBpe(path)
    for t in texts:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t or "") == want, (t or "")[:80]
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_tree_is_exact():
    own = bpe.WordBpe(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(9)
    for n in (65, 128, 129, 500, 4000):
        for letters in ("ab", "theinr", "aaaaaaaab"):
            raw = "".join(rng.choice(letters) for _ in range(n)).encode()
            symbols = [own.inner[b] for b in raw[:-1]] + [own.last[raw[-1]]]
            assert own.tree(symbols) == own.merge_heap(symbols)
            if n <= 500:
                assert own.merge(symbols) == own.merge_heap(symbols)


def test_query(odd, odd_rows, empty):
    path = tokenizer_path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    for r, (i, t) in zip(bpe.digests(odd, path).collect(), odd_rows, strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(empty, path).count() == 0 and bpe.encode(odd, path).where("doc_id = 8").first().ids[0] == 49407


def test_byte_bpe(texts):
    path = tokenizer_path("byte_bpe_50k.json")
    lib, own = tokenizers.Tokenizer.from_file(path), packing.ByteBpe(path)
    for t in texts:
        assert np.frombuffer(own.encode(t or ""), "<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids, (t or "")[:80]


def test_long_runs_of_white_space():
    path = tokenizer_path("byte_bpe_50k.json")
    lib, own = tokenizers.Tokenizer.from_file(path), packing.ByteBpe(path)
    for run in (" ", "\n", "\t ", " \n", "\u3000", "\x1c", " " * 999 + "\n"):
        for text in (run * 6000, f"a{run * 6000}b", f"{run * 6000} b", f"a{run * 3000}\nb{run * 3000}<|endoftext|>{run * 6000}"):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, (run[-2:], text[-3:])
    for text in (" " * 5_000_000 + "x", "\n" * 5_000_000, "z" * 5_000_000):
        assert len(own.encode(text)) > 0


def test_patterns():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 129, 3000)
    demand = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
    found = packing.patterns(demand, 128)
    held = defaultdict(int)
    for p, times in found:
        assert sum(s * k for s, k in p.items()) <= 128
        for s, k in p.items():
            held[s] += k * times
    assert all(held[s] >= n for s, n in demand.items())
    assert sum(t for _, t in found) <= 1.02 * sizes.sum() / 128 + 2 and packing.patterns({}, 128) == []


def test_packing(spark, sf_dir, make, odd_rows, empty):
    path = tokenizer_path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    rows = [*odd_rows, *[(r.doc_id + 1000, r.text) for r in table(spark, sf_dir, "documents").collect()]]
    got = packing.pack_documents(make(rows), path).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    for i, docs in want.items():
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        assert mine == sorted((at, len(d[at : at + 2048]), zlib.crc32(d[at : at + 2048].tobytes()), len(d)) for d in docs for at in range(0, len(d), 2048))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(b[0] == a[0] + a[1] for a, b in zip(parts, parts[1:], strict=False)) and parts[-1][0] + parts[-1][1] <= 2048
    assert 2048 * len(sequences) <= 1.05 * sum(r.length for r in got) + 2 * 2048
    assert packing.pack_documents(empty, path).count() == 0
