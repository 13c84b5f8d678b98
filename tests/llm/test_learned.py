"""Toxicity, page text, neighbours and language model: held-out accuracy or plain versions."""

import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from atomweave.llm import html_text, neighbours, ngram, toxicity


def test_network_learns_and_windows_cover():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    bad = ["zork", "quvex", "zorkling"]

    def doc(y):
        w = list(rng.choice(words, int(rng.integers(1, 120))))
        if y:
            w[int(rng.integers(0, len(w)))] = bad[int(rng.integers(0, 3))]
        return " ".join(w)

    docs = [(doc(k % 2), k % 2) for k in range(500)]
    net = toxicity.Network().train(docs)
    test = [(doc(k % 2), k % 2) for k in range(200)]
    score = toxicity.Scorer(net).score([t for t, _ in test])
    y = np.array([y for _, y in test])
    assert ((score >= 0.7) == y).mean() > 0.95
    one = toxicity.Scorer(net).score(["", "x " * 3, " ".join(words) + " zork " + " ".join(words)])
    assert one[0] < 0.7 and one[2] >= 0.7
    w = list(map(str, range(100)))
    assert {x for win in toxicity.windows(w) for x in win} == set(w) and toxicity.windows([]) == [[]]


def test_every_start_is_scored():
    rng = np.random.default_rng(3)
    net = toxicity.Network()
    net.table[:] = rng.normal(0, 1, net.table.shape)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 7, 15, 16, 17, 23, 24, 40, 300, 3, 5000, 16)]
    scorer = toxicity.Scorer(net)
    got = scorer.score(texts)
    for text, p in zip(texts, got, strict=True):
        w = scorer.numbers(toxicity.words_of(text)).tolist()
        grid = np.array([[*w[k : k + toxicity.WIDTH], *[0] * (toxicity.WIDTH - len(w))] for k in range(max(1, len(w) - toxicity.WIDTH + 1))])
        pooled = net.words.pooled((scorer.f[grid], scorer.b[grid]), (grid > 0).astype(np.float32))
        want = float((pooled @ net.out + net.bias).max())
        assert abs(p - 1 / (1 + math.exp(-want))) < 1e-5


def test_long_runs_are_read_whole():
    for n in (15, 16, 21, 22, 28, 29, 300):
        run = "".join(chr(0x4E00 + k) for k in range(n))
        parts = toxicity.words_of(f"a {run} b")[1:-1]
        assert all(len(p) == toxicity.LETTERS for p in parts)
        assert all(any(run[k : k + 8] in p for p in parts) for k in range(n - 7))
    assert toxicity.words_of("fourteenletter") == ["fourteenletter"]
    docs = [(f"{a}good{b}" * 2 if k % 2 else f"{a}idiot{b}" * 2, 1 - k % 2) for k in range(300) for a, b in [("people"[k % 3 :] + "nice", "person"[k % 4 :] + "other")]]
    net = toxicity.Network().train(docs)
    bad, good = toxicity.Scorer(net).score(["greenhousesidiotintherainyday", "greenhousesgoodintherainyday"])
    assert bad > good + 0.1


def test_gradients():
    rng = np.random.default_rng(1)
    both = toxicity.Both(rng, 3, 2)
    x, mask = rng.normal(0, 0.5, (2, 4, 3)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    for part in both.parts.values():
        part.p = {k: v.astype(np.float64) for k, v in part.p.items()}
    target = rng.normal(0, 1, (2, 4))
    loss = lambda: float((both.train_forward(x, mask) * target).sum())
    loss()
    grads = both.zeros()
    dx = both.backward(target, grads)
    for array, grad in [(x, dx), *[(both.parts[k].p[n], grads[k][n]) for k in both.parts for n in both.parts[k].p]]:
        for at in list(np.ndindex(array.shape))[:: max(1, array.size // 5)]:
            old, e = array[at], 1e-3
            array[at] = old + e
            up = loss()
            array[at] = old - e
            down = loss()
            array[at] = old
            assert abs((up - down) / (2 * e) - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_toxicity_tables(spark, odd, odd_rows, empty, make):
    docs = make([(i, ("zork bad thing " if i % 2 else "a good thing ") * 4) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels, where=toxicity.fold("doc_id", 3) != 1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(60))
    assert toxicity.score(odd, net).count() == len(odd_rows) and toxicity.score(empty, net).count() == 0
    kept = toxicity.keep_clean(docs, net, 0.5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(0, 60, 2))
    assert {r.score for r in toxicity.score(odd, toxicity.train(docs, labels.where("false"))).collect()} == {0.0}


def test_page_model_on_held_out_pages():
    m = html_text.trained()
    wrong = n = 0
    for page in html_text.labelled_pages(40, seed=77):
        dom = html_text.Dom(page)
        y = [0] * len(dom.tag)
        for i in range(1, len(y)):
            own = dom.attrs[i].get("data-y")
            y[i] = int(own) if own is not None else y[dom.parent[i]]
        wrong += sum((p > 0.5) != bool(t) for p, t in zip(m.marginals(dom), y, strict=True))
        n += len(y)
    assert wrong / n < 0.01


def test_marginals_are_exact():
    m = html_text.TreeModel()
    m.node = {"tag:p": 0.7, "tag:div": -0.4, "tag:b": 0.3}
    m.edge = {"section": [0.5, -0.2, 0.1, 0.9], "block": [0.3, 0.1, -0.6, 0.8], "inline": [0.2, -1.0, -0.5, 1.1]}
    dom = html_text.Dom("<div><p>a<b>b</b></p><p>c</p></div>")
    feats = html_text.features(dom)
    own = [sum(m.node.get(f, 0) for f in fs) for fs in feats]
    total, each = 0.0, np.zeros(len(own))
    for mask in range(1 << len(own)):
        y = [mask >> k & 1 for k in range(len(own))]
        e = math.exp(sum(o * v for o, v in zip(own, y, strict=True)) + sum(m.edge[html_text._kind(dom.tag[i])][2 * y[dom.parent[i]] + y[i]] for i in range(1, len(own))))
        total += e
        each += e * np.array(y)
    assert np.allclose(m.marginals(dom), each / total)


def test_page_text(spark):
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home page</a></li></ul></nav><div class="ad">Buy this now.</div><article><h1>The  head</h1><p><b>One &amp; two.<br><p>Three&nbsp;four\n five.</p></article><footer>&copy; all</footer></body></html>'
    rows = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 3), (None, "v", "", 3), (4, "w", "<p>un<b>closed", 3), (4, "w", "<p>un<b>closed", 3), (5, "x", "</div>" * 500 + "<div>" * 3000, 3)], "page_id long, url string, html string, text int")
    got = html_text.extract(rows).collect()
    assert got[0].text == "The head One & two. Three four five." and got[0].n_chars == len(got[0].text)
    assert [r.text for r in got[1:3]] == ["", ""] and got[3] == got[4] and len(got) == 6
    assert html_text.extract(rows.where("false")).count() == 0


def test_open_heads_and_closed_drawings_hide_no_text():
    shown = lambda page: " ".join(t.strip() for _, t in html_text.Dom(page).events if t and t.strip())
    assert shown("<html><head><title>T</title><meta charset=x><body><p>One two.</p>") == "One two."
    assert shown("<head><title>T</title><style>p{}</style><p>One two.</p>") == "One two." and shown("<head><title>T</title>One <b>two.</b>") == "One two."
    assert shown("<head><title>T</title><noscript><img><p>no</p></noscript><script>var x</script></head><body>One two.") == "One two."
    assert shown('<div><svg viewBox="0 0 1 1"/>One <b>two.</b></div>') == "One two." and shown("<div><svg><path d='m'/><text>no</text></svg>One two.<div/>three</div>") == "One two. three"


@pytest.mark.parametrize(("n", "blocks"), [(3, {}), (700, {}), (1500, {"block": 90, "query_block": 7})])
def test_neighbours(spark, n, blocks):
    rng = np.random.default_rng(n)
    x = rng.normal(0, 1, (n, 16)).astype(np.float32)
    x[: n // 3] = x[0]
    rows = [(i, [float(v) for v in r], 7) for i, r in enumerate(x)] + [(10000, None, 7), (10050, [0.0] * 16, 7), (10100, [float("nan")] * 16, 7), (10150, [None] * 16, 7), (None, [1.0] * 16, 7), (10005, [1.0, 2.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 50 = 0"), 5, **blocks).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = want = 0
    for q in range(0, n, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        best = np.lexsort((np.arange(n), -s))[: min(5, n - 1)]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, len(best) + 1)) and all(abs(v - u[i] @ u[q]) < 1e-12 for _, i, v in mine)
        hits += len({i for _, i, _ in mine} & set(best.tolist()))
        want += len(best)
    assert hits / want >= 0.9 and not set(got) & {10000, 10050, 10100, 10150}
    assert neighbours.search(df.where("false"), df.where("false"), 5).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 5), (1000, 10**6), (5000, 5200), (3000, 2**40), (10, 10)):
        v = np.sort(rng.choice(top, n, replace=False)) if top < 2 * 10**6 else np.unique(rng.integers(0, top, n))
        e = ngram.EliasFano(ngram.ef_encode(v, "x"), "x")
        assert (e[np.arange(len(v))] == v).all()
        q = np.concatenate((v, rng.integers(0, top + 50, 500), [-1]))
        place = {x: i for i, x in enumerate(v.tolist())}
        assert e.find(q).tolist() == [place.get(x, -1) for x in q.tolist()]
    flat = np.array([0, 0, 0, 3, 3, 7, 7, 7])
    assert (ngram.EliasFano(ngram.ef_encode(flat, "x"), "x")[np.arange(8)] == flat).all()


def plain_model(texts):
    """Probabilities of the interpolated model from plain counts."""
    counts = [Counter(), Counter(), Counter()]  # words, pairs, triples
    for text in texts:
        w = [ngram.END, *ngram.words_of(text or "")]
        counts[0].update(w[1:])
        counts[1].update(zip(w, w[1:], strict=False))
        counts[2].update(zip(w, w[1:], w[2:], strict=False))
    total, kinds = sum(counts[0].values()), len(counts[0])
    context, follow = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
    for k in (1, 2):
        for g, c in counts[k].items():
            context[k][g[:-1]] += c
            follow[k][g[:-1]] += 1

    def p(w, *before):
        k = len(before)
        if not k:
            return (counts[0][w] + 0.5) / (total + 0.5 * (kinds + 1))
        lower = p(w, *before[1:])
        if not context[k][before]:
            return lower
        return max(counts[k][(*before, w)] - ngram.DISCOUNT, 0) / context[k][before] + ngram.DISCOUNT * follow[k][before] / context[k][before] * lower

    return counts[0], total, p


def check_scores(got, rows):
    learned = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    count, total, p = plain_model(learned)
    gain = [0.0, 0.0]
    for r, (i, t) in zip(got, rows, strict=True):
        w = [ngram.END, *ngram.words_of(t or "")]
        b = sum(math.log10(p(x)) for x in w[1:])
        s = math.log10(p(w[1], w[0])) + sum(math.log10(p(x, u, v)) for u, v, x in zip(w, w[1:], w[2:], strict=False))
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held, len(w) - 1, sum(count[x] > 0 for x in w[1:]), total)
        assert abs(r.base_score - b) < 1e-6 * max(1, abs(b)) and abs(r.score - s) <= 0.03 * len(w), (i, r.score, s)
        if held:
            gain = [gain[0] + b, gain[1] + r.score]
    return gain


def test_language_model(spark, make, sf_dir, odd_rows, empty):
    """All pairs and triples, those met once too."""
    from atomweave.llm.queries import table

    rows = [*odd_rows, *[(r.doc_id + 1000, r.text) for r in table(spark, sf_dir, "documents").collect()]]
    gain = check_scores(ngram.score_held_out(make(rows)).collect(), rows)
    assert gain[1] > gain[0]
    assert ngram.score_held_out(empty).count() == 0
    assert {r.score for r in ngram.score_held_out(make([(None, "no id"), (None, "")])).collect()} == {0.0}


def test_split_contexts_and_texts(spark, sf_dir, odd_rows, monkeypatch):
    """Contexts over many parts, texts in parts, workers that forget; all in this process."""
    from atomweave.llm.queries import table

    for name, value in (("PART_TOKENS", 300), ("CHARS", 200), ("BATCH", 700), ("CACHE", 300), ("SLOTS", 256)):
        monkeypatch.setattr(ngram, name, value)
    rows = [*odd_rows, *[(r.doc_id + 1000, r.text) for r in table(spark, sf_dir, "documents").limit(60).collect()]]
    model = local_model([t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1])
    assert len(model.parts) > 20 and model.spread
    found = ngram.Scorer(model).score([t for _, t in rows])
    fold = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    got = [SimpleNamespace(doc_id=i, held_out=f, n_tokens=int(a), n_known=int(b), train_tokens=model.vocabulary.total, base_score=c, score=d) for (i, _), f, a, b, c, d in zip(rows, fold, *found, strict=True)]
    gain = check_scores(got, rows)
    assert gain[1] > gain[0]


def local_model(texts):
    """The trie built in this process, by the functions that the tasks run."""
    count = Counter(w for _, words, skip, _ in ngram.parts_of(texts) for w in words[skip:])
    pairs = sorted((ngram.xxhash.xxh3_64_intdigest(w), c) for w, c in count.items())
    n = np.array([c for _, c in pairs])
    vocabulary = ngram.Vocabulary("", [len(pairs)], [int(n.sum())])
    vocabulary.parts[0] = {"hash": np.array([h for h, _ in pairs], np.uint64), "running": np.concatenate(([0], np.cumsum(n)))}
    numbers = ngram.Numbers(vocabulary)
    t = ngram.Tokens(numbers, list(ngram.parts_of(texts)))
    u, v, w = (numbers.id[a[t.centre]] for a in (t.prev, t.x, t.next))
    part = vocabulary.part_of(numbers.before[t.prev[t.centre]], numbers.count[t.prev[t.centre]], v)
    model, borders = ngram.Model(vocabulary, "", {}), {}
    for k in range(int(vocabulary.total // ngram.PART_TOKENS) + 1):
        own = part == k
        model.parts[k] = None
        if own.any():
            arrays, ids, followers = ngram.build(vocabulary, u[own], v[own], w[own], np.ones(own.sum(), np.int64))
            model.parts[k] = ngram.Part(arrays)
            for c in {0, len(ids) - 1}:
                borders.setdefault(int(ids[c]), []).append(int(followers[c]))
    model.part = model.parts.get
    model.spread = {i: sum(n) for i, n in borders.items() if len(n) > 1}
    return model


def test_query_keeps_what_is_met_once(spark, tmp_path):
    from atomweave.llm.queries import op10_ngram

    docs = [(i, f"common common only{i} once{i} common") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op10_ngram(spark, str(tmp_path)).collect()}
    check_scores([got[i] for i, _ in docs], docs)


def test_parts_are_opened_once_and_read_in_few_steps(spark, sf_dir, odd_rows, monkeypatch):
    """With more parts than 256, as 6 GB of texts have, no part is opened again, and a round of lookups in a part finds its places in one step."""
    from atomweave.llm.queries import table

    for name, value in (("PART_TOKENS", 100), ("BATCH", 4000)):
        monkeypatch.setattr(ngram, name, value)
    texts = [t for _, t in odd_rows] + [r.text for r in table(spark, sf_dir, "documents").limit(60).collect()]
    local = local_model(texts)
    opened, finds, selects = [], [], []
    model = ngram.Model(local.vocabulary, "", local.spread)
    monkeypatch.setattr(ngram, "get", lambda uri: opened.append(uri) or uri)
    monkeypatch.setattr(ngram, "Part", lambda uri: local.parts[int(uri.rsplit("-", 1)[1])])
    plain_find, plain_select = ngram.Level.find, ngram.EliasFano._select
    monkeypatch.setattr(ngram.Level, "find", lambda *a: finds.append(1) or plain_find(*a))
    scorer = ngram.Scorer(model)
    want = ngram.Scorer(local).score(texts)
    finds.clear()
    for k in local.parts:  # pointers of words in the middle of a part are read for words, not for lookups
        model.part(k)
    monkeypatch.setattr(ngram.Model, "followers", lambda self, ids, before, count: np.ones(len(ids), np.int64))
    monkeypatch.setattr(ngram.EliasFano, "_select", lambda *a: selects.append(1) or plain_select(*a))
    for _ in range(2):
        scorer.score(texts)
    assert len(local.parts) > 300 and len(opened) == len(set(opened)) == len(local.parts)
    assert len(selects) <= 2 * len(finds)  # zeros before a run, and its end where it is long
    monkeypatch.undo()
    assert want[0].sum() == sum(len(ngram.words_of(t or "")) for t in texts)


def test_split_finds_the_words_of_plain_bytes(odd_rows, monkeypatch):
    monkeypatch.setattr(ngram, "CHARS", 50)
    texts = [t for _, t in odd_rows] + ["", None, " \t\n", "A\x0bb\x0cC\x1cd\x85e f\x00g  ", " x" * 200, "no-blank" * 40]
    held = list(ngram.pieces(texts))
    words, code, lengths = ngram.split(held)
    at = np.concatenate(([0], np.cumsum(lengths)))
    got = [[words[c] for c in code[i:j]] for i, j in zip(at, at[1:], strict=False)]
    assert got == [body.split() for _, body, _, _ in held]
    found = [[] for _ in texts]
    for (k, _, skip, _), part in zip(held, got, strict=True):
        found[k] += part[skip:]
    assert found == [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    assert all(len(part) + last <= ngram.most_tokens(body) for part, (_, body, _, last) in zip(got, held, strict=True))
