"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a binary variable (main content or not) with a potential from its own features, and every
parent-child edge has a potential by the kind of the child. Sum-product messages go from the leaves up and from the
root down; the marginals decide whose text is kept. The weights are trained by gradient ascent on the exact
likelihood of labelled pages (made here, see ``labelled_pages``), in a second or two on the driver.

Defined results: null or empty html gives an empty text; broken markup is read as browsers do, roughly (unclosed
elements end with their parent, stray end tags are ignored); repeated rows give repeated results; null ids and urls
stay null; other columns are ignored; no length is limited.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose characters are never page text.
SILENT = frozenset("script style noscript template head title iframe object svg textarea select option".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul br summary".split()
)
#: What an open head may hold; any other tag, or a text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements in which a tag may close itself.
FOREIGN = frozenset("svg math".split())
SECTION = frozenset("html body article aside div footer form header main nav section table ul ol dl".split())
#: An opening tag of the key ends an open element of these, unless a table cell or list stands between.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table ul ol dl div section article".split())


class Dom(HTMLParser):
    """Elements in page order: parent, tag, attributes; and the page's texts with the element that holds each."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.attrs = [-1], ["#root"], [{}]
        self.events: list[tuple[int, str | None]] = []  # (element, text), or None where a block begins or ends
        self.stack, self.silent = [0], 0
        self.feed(html)
        self.close()

    def _pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.tag[self.stack.pop()]
            self.silent -= tag in SILENT
            if tag in BLOCK:
                self.events.append((0, None))

    def _end_head(self, body: bool = False) -> None:
        """Pops an open head whose end tag was left out; by body also from inside one of its elements."""
        for at in range(len(self.stack) - 1, 0, -1):
            open_ = self.tag[self.stack[at]]
            if open_ == "head":
                self._pop_to(at)
                return
            if not body or open_ in ("body", "template", "svg"):
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self._end_head(tag == "body")
        if tag in BLOCK and tag != "br" and tag not in ("html", "body"):
            for at in range(len(self.stack) - 1, 0, -1):
                open_ = self.tag[self.stack[at]]
                if open_ == "p":
                    self._pop_to(at)
                    break
                if open_ in BLOCK:
                    break
        if ends := ENDS.get(tag):
            for at in range(len(self.stack) - 1, 0, -1):
                open_ = self.tag[self.stack[at]]
                if open_ in ends:
                    self._pop_to(at)
                    break
                if open_ in SCOPE:
                    break
        if tag in BLOCK:
            self.events.append((0, None))
        if tag in VOID:
            return
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.attrs.append(dict(attrs))
        self.stack.append(len(self.tag) - 1)
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and any(self.tag[i] in FOREIGN for i in self.stack):
            self._pop_to(len(self.stack) - 1)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[at]] == tag:
                self._pop_to(at)
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        if not self.silent:
            self.events.append((self.stack[-1], data))


def _bucket(n: float) -> int:
    """0 to 7, two doublings apart."""
    return min(7, int(math.log2(n + 1)) // 2)


def features(dom: Dom) -> list[list[str]]:
    """Names of the features of each element."""
    n = len(dom.tag)
    own, linked, sub, subl, kids = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i, text in dom.events:
        if text:
            own[i] += len(text.strip())
    for i in range(n - 1, 0, -1):
        sub[i] += own[i]
        subl[i] = sub[i] if dom.tag[i] == "a" else subl[i]
        p = dom.parent[i]
        sub[p] += sub[i]
        subl[p] += subl[i]
        kids[p] += 1
    out = []
    for i in range(n):
        tag, p = dom.tag[i], dom.parent[i]
        names = {t for a in ("class", "id", "role") for t in _words(dom.attrs[i].get(a))}
        f = ["bias", f"tag:{tag}", f"up:{dom.tag[p] if p >= 0 else '-'}", f"own:{_bucket(own[i])}", f"sub:{_bucket(sub[i])}", f"link:{int(4 * subl[i] / sub[i]) if sub[i] else -1}", f"kids:{_bucket(kids[i])}"]
        f += [f"name:{w}" for w in names]
        f.append("named" if names else "plain")
        out.append(f)
    return out


def _words(value: str | None) -> list[str]:
    """Words of a class, id or role: split at anything but letters, lower case, without a plural s."""
    words = "".join(c.lower() if c.isalpha() else " " for c in value or "").split()
    return [w[:-1] if len(w) > 3 and w.endswith("s") else w for w in words]


def _kind(tag: str) -> str:
    return "section" if tag in SECTION else "block" if tag in BLOCK else "inline"


def _log1p_ratio(a: float, b: float, c: float, d: float) -> float:
    """log((e^a + e^b) / (e^c + e^d))."""
    m, k = max(a, b), max(c, d)
    return m + math.log1p(math.exp(min(a, b) - m)) - k - math.log1p(math.exp(min(c, d) - k))


class TreeModel:
    """Weights of features (towards content) and, by kind of child, of the four states of an edge (parent, child)."""

    def __init__(self) -> None:
        self.node: dict[str, float] = {}
        self.edge = {k: [0.0, 0.0, 0.0, 0.0] for k in ("section", "block", "inline")}

    def messages(self, dom: Dom, feats: list[list[str]]) -> tuple[list[float], list[float], list[float]]:
        """Log odds of each element: from itself and below, sent up to its parent, and sent down to it."""
        n, get = len(feats), self.node.get
        below = [sum([get(f, 0.0) for f in fs]) for fs in feats]
        up, down = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            e = self.edge[_kind(dom.tag[i])]
            up[i] = _log1p_ratio(e[3] + below[i], e[2], e[1] + below[i], e[0])
            below[dom.parent[i]] += up[i]
        for i in range(1, n):
            p = dom.parent[i]
            t = below[p] + down[p] - up[i]
            e = self.edge[_kind(dom.tag[i])]
            down[i] = _log1p_ratio(e[3] + t, e[1], e[2] + t, e[0])
        return below, up, down

    def marginals(self, dom: Dom) -> list[float]:
        below, _, down = self.messages(dom, features(dom))
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, b + d)))) for b, d in zip(below, down, strict=True)]

    def train(self, pages: list[str], epochs: int = 25, rate: float = 0.3, shrink: float = 1e-4, seed: int = 5) -> TreeModel:
        """AdaGrad on the likelihood; a page's elements carry data-y="1" or "0", else their parent's."""
        ready = []
        for html in pages:
            dom = Dom(html)
            y = [0] * len(dom.tag)
            for i in range(1, len(y)):
                own = dom.attrs[i].get("data-y")
                y[i] = int(own) if own is not None else y[dom.parent[i]]
            ready.append((dom, features(dom), y))
        rng, seen, seen_e = random.Random(seed), {}, {k: [1e-6] * 4 for k in self.edge}
        for _ in range(epochs):
            rng.shuffle(ready)
            for dom, feats, y in ready:
                below, up, down = self.messages(dom, feats)
                grad: dict[str, float] = {}
                for i, fs in enumerate(feats):
                    diff = y[i] - 1 / (1 + math.exp(-max(-60.0, min(60.0, below[i] + down[i]))))
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + diff
                grad_e = {k: [0.0] * 4 for k in self.edge}
                for i in range(1, len(feats)):
                    p, kind = dom.parent[i], _kind(dom.tag[i])
                    e, t = self.edge[kind], below[p] + down[p] - up[i]
                    logs = [e[0], e[1] + below[i], e[2] + t, e[3] + t + below[i]]
                    top = max(logs)
                    z = [math.exp(x - top) for x in logs]
                    total = sum(z)
                    for s in range(4):
                        grad_e[kind][s] += (2 * y[p] + y[i] == s) - z[s] / total
                for f, g in grad.items():
                    g -= shrink * self.node.get(f, 0.0)
                    seen[f] = seen.get(f, 1e-6) + g * g
                    self.node[f] = self.node.get(f, 0.0) + rate * g / math.sqrt(seen[f])
                for k, gs in grad_e.items():
                    for s, g in enumerate(gs):
                        seen_e[k][s] += g * g
                        self.edge[k][s] += rate * g / math.sqrt(seen_e[k][s])
        return self

    def text(self, html: str | None) -> str:
        """Blocks of the kept elements in page order, joined by one space."""
        if not html:
            return ""
        dom = Dom(html)
        keep = [m > 0.5 for m in self.marginals(dom)]
        blocks, block = [], []
        for i, text in [*dom.events, (0, None)]:
            if text is None:
                if block:
                    blocks.append(" ".join("".join(block).split()))
                    block = []
            elif keep[i]:
                block.append(text)
        return " ".join(b for b in blocks if b)


# -- labelled pages -------------------------------------------------------------------------------------------

_AROUND = {
    "nav": "nav menu navbar navigation topnav breadcrumb toc pager", "header": "header masthead top branding logo site",
    "footer": "footer bottom copyright legal colophon credits", "aside": "sidebar aside rail widget related recommended popular tags",
    "notice": "notice cookie consent banner alert warning message gdpr popup modal", "ad": "ad ads advert advertisement sponsor sponsored promo promotion",
    "form": "form search newsletter subscribe login signup contact", "comment": "comment comments reply discussion respond feedback reader", "share": "share social follow author byline meta",
}
_INSIDE = "content article post entry story main body text page prose document"


def labelled_pages(n: int = 120, seed: int = 11) -> list[str]:
    """Made pages of many layouts, every element labelled by data-y (inherited where it is missing)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ta", "re", "on", "in", "el", "us", "mo", "pe", "li", "st")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(5, 25).capitalize() + rng.choice((".", ".", "!", "?"))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'

    def named(kind: str) -> str:
        return f' {rng.choice(("class", "class", "id"))}="{"-".join(rng.sample(_AROUND[kind].split(), rng.choice((1, 1, 2))))}"'

    def prose() -> str:
        out = []
        for _ in range(rng.randint(1, 4)):
            s = sentence()
            if rng.random() < 0.3:
                s = f"<{(t := rng.choice(('b', 'i', 'em', 'strong', 'a', 'span', 'code')))}>{s}</{t}>"
            out.append(s)
        return " ".join(out)

    def around(kind: str) -> str:
        if kind == "nav":
            items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9)))
            return rng.choice((f'<nav data-y="0"><ul>{items}</ul></nav>', f'<div data-y="0"{named(kind)}><ul>{items}</ul></div>', f'<ul data-y="0"{named(kind)}>{items}</ul>', f'<nav data-y="0"{named(kind)}>{items}</nav>'))
        if kind == "header":
            return rng.choice((f'<header data-y="0">{link()} {words(1, 6)}</header>', f'<div data-y="0"{named(kind)}><p>{words(2, 8)}</p>{link()}</div>', f'<header data-y="0"><h2>{words(1, 4)}</h2><p>{words(2, 9)}</p></header>'))
        if kind == "footer":
            return rng.choice((f'<footer data-y="0">&copy; {word()}.example.com &middot; {sentence()}</footer>', f'<div data-y="0"{named(kind)}><p>&copy; {words(2, 9)}</p>{link()}</div>', f'<footer data-y="0"><p>{prose()}</p>{link()}{link()}</footer>'))
        if kind == "aside":
            body = rng.choice((f"<h3>{words(1, 3)}</h3><ul>{''.join(f'<li>{link()}</li>' for _ in range(rng.randint(2, 6)))}</ul>", f"<h3>{words(1, 3)}</h3><p>{prose()}</p>", f"<p>{sentence()}</p>"))
            return rng.choice((f'<aside data-y="0">{body}</aside>', f'<div data-y="0"{named(kind)}>{body}</div>', f'<section data-y="0"{named(kind)}>{body}</section>'))
        if kind == "form":
            return rng.choice((f'<form data-y="0"><label>{words(1, 3)}</label><input><button>{word()}</button></form>', f'<div data-y="0"{named(kind)}><form><p>{sentence()}</p><button>{words(1, 2)}</button></form></div>'))
        if kind == "comment":
            items = "".join(rng.choice((f"<div{named(kind)}><p>{prose()}</p></div>", f"<li><p>{prose()}</p></li>", f"<p>{prose()}</p>", f"<article{named(kind)}><p>{prose()}</p></article>")) for _ in range(rng.randint(1, 5)))
            return f'<{(t := rng.choice(("section", "div", "ol")))} data-y="0"{named(kind)}><h3>{words(1, 3)}</h3>{items}</{t}>'
        body = rng.choice((sentence(), f"<p>{prose()}</p>", f"<p>{sentence()}</p>{link()}", f"{words(2, 8)} {link()}"))
        return f'<{(t := rng.choice(("div", "div", "section", "p") if kind != "notice" else ("div", "section")))} data-y="0"{named(kind)}>{sentence() if t == "p" else body}</{t}>'

    def article() -> str:
        parts = [f"<h1>{words(2, 9)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 9)):
            parts.append(
                rng.choices(
                    (f"<p>{prose()}</p>", f"<p><b>{sentence()}<br><p>{prose()}</p>", f"<h2>{words(1, 6)}</h2>", f"<ul>{''.join(f'<li>{rng.choice((sentence(), words(2, 6), prose()))}</li>' for _ in range(3))}</ul>", f"<blockquote><p>{sentence()}</p></blockquote>", f"<pre><code>{words(3, 12)}</code></pre>", f"<table><tr><th>{word()}</th><td>{words(1, 4)}</td></tr><tr><td>{word()}</td><td>{words(1, 9)}</td></tr></table>", f"<figure><figcaption>{sentence()}</figcaption></figure>", f"<div><p>{prose()}</p></div>", f"<section><h2>{words(1, 5)}</h2><p>{prose()}</p></section>", f"<p>{word()}.</p>"),
                    (9, 2, 2, 1, 1, 1, 1, 1, 1, 1, 2),
                )[0]
            )
        for kind in ("ad", "share", "aside", "form", "comment", "nav", "notice"):
            if rng.random() < 0.15:
                parts.insert(rng.randint(1, len(parts)), around(kind))
        name = f' class="{"-".join(rng.sample(_INSIDE.split(), rng.choice((1, 2))))}"'
        body = "".join(parts)
        return rng.choice((f'<article data-y="1">{body}</article>', f'<article data-y="1">{body}</article>', f'<article data-y="1"{name}>{body}</article>', f'<main><article data-y="1">{body}</article></main>', f'<div data-y="1"{name}>{body}</div>', f'<main data-y="1">{body}</main>', f'<div{name}><div data-y="1"{name}>{body}</div></div>'))

    pages = []
    for _ in range(n):
        before = [around(k) for k in ("nav", "header", "ad", "notice", "share", "form") if rng.random() < 0.45]
        after = [around(k) for k in ("aside", "comment", "ad", "form", "nav", "share", "notice") if rng.random() < 0.35]
        rng.shuffle(before)
        rng.shuffle(after)
        foot = around("footer") if rng.random() < 0.8 else ""
        body = "".join(before) + article() + "".join(after) + foot
        body = rng.choice((body, body, f'<div class="{rng.choice(("wrapper", "container", "page", "layout"))}">{body}</div>'))
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body>{body}</body></html>")
    return pages


@lru_cache(maxsize=1)
def trained() -> TreeModel:
    return TreeModel().train(labelled_pages())


def extract(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
