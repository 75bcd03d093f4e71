"""Main-text extraction by a recurrent block labeller.

A page is a sequence of leaf blocks. Each block's vector holds its hashed tag
path, its hashed words and a few measures; a bidirectional LSTM in numpy reads
the whole sequence, so that every block is judged with the page around it. The
network is trained here, on pages that a generator composes from page parts
whose role is known: see :func:`example`.
"""

from __future__ import annotations

import functools
import random
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .html_blocks import Leaf, Node, leaves
from .repeats import _texts
from .scratch import ship

PATH, WORDS, MEASURES, HIDDEN = 96, 32, 10, 24
WIDTH = PATH + WORDS + MEASURES
#: Pages composed for training, passes over them, and the seed of both.
EXAMPLES, PASSES, SEED = 900, 8, 11
THRESHOLD = 0.5


@functools.lru_cache(1 << 16)
def _slot(name: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
    return h % size, 1.0 if h & 0x80000000 else -1.0


@functools.lru_cache(1 << 14)
def _names_vector(names: tuple[str, ...], prefix: str) -> np.ndarray:
    out = np.zeros(PATH, np.float32)
    for name in names:
        k, sign = _slot(prefix + name, PATH)
        out[k] += sign
    return out


@functools.lru_cache(1 << 14)
def _own_vector(names: tuple[str, ...]) -> np.ndarray:
    return _names_vector(names, "") + _names_vector(names, "0:")


def _around(node: Node) -> np.ndarray:
    """What an element adds to the vectors of the blocks right inside its children:
    the names on its path, hashed, and its own names as those one step away. An
    element keeps the sums, so a page takes memory by its elements, however deep
    they stand in one another."""
    if node.around is None:
        todo, at = [], node
        while at is not None and at.total is None:
            todo.append(at)
            at = at.parent
        for n in reversed(todo):
            n.total = _names_vector(n.names, "") + (n.parent.total if n.parent else 0)
        node.around = node.total + _names_vector(node.names, "1:")
    return node.around


def _path_vector(node: Node | None, out: np.ndarray) -> None:
    """The names on a path, hashed; the inner ones also by their distance from the leaf."""
    if node is None:
        return
    if node.parent is None:
        out[:] = _own_vector(node.names)
    else:
        np.add(_around(node.parent), _own_vector(node.names), out=out)


class _WordCodes(dict):
    """Twice the slot of a word, and one more for a negative sign."""

    def __missing__(self, word: str) -> int:
        k, sign = _slot(word, WORDS)
        self[word] = code = 2 * k + (sign < 0)
        return code


_word_codes = _WordCodes()
#: Words whose codes are remembered from page to page.
REMEMBERED = 1 << 17
UPPER, DIGIT, STOP = 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    """For each code point whether it is an upper-case letter, a digit or a punctuation mark."""
    every = range(0x110000)
    out = np.fromiter(map(str.isupper, map(chr, every)), np.uint8, len(every)) * np.uint8(UPPER)
    out[np.fromiter(map(str.isdigit, map(chr, every)), bool, len(every))] = DIGIT
    out[[ord(c) for c in ".,;!?"]] = STOP
    return out


def vectors(blocks: list[Leaf]) -> np.ndarray:
    count = len(blocks)
    out = np.zeros((count, WIDTH), np.float32)
    if not count:
        return out
    for i, b in enumerate(blocks):
        _path_vector(b.node, out[i, :PATH])
    if len(_word_codes) > REMEMBERED:
        _word_codes.clear()
    words = [b.text.lower().split(" ") for b in blocks]
    n_words = np.array([len(w) for w in words])
    codes = np.fromiter(map(_word_codes.__getitem__, chain.from_iterable(words)), np.int64, int(n_words.sum()))
    seen = np.bincount(np.repeat(np.arange(count) * 2 * WORDS, n_words) + codes, minlength=2 * WORDS * count).reshape(count, WORDS, 2)
    out[:, PATH : PATH + WORDS] = (seen[:, :, 0] - seen[:, :, 1]) * (0.4 / np.sqrt(n_words))[:, None]
    n = np.array([len(b.text) for b in blocks])
    kind = _classes()[np.frombuffer("".join([b.text for b in blocks]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    begins = np.cumsum(n) - n
    share = lambda k: np.add.reduceat((kind == k).astype(np.int64), begins)
    i = np.arange(count)
    measures = (
        np.minimum(1.0, np.log1p(n) / 8),
        np.minimum(1.0, np.log1p(n_words) / 6),
        [b.links for b in blocks],
        [b.text[-1] in ".!?…:;\"”»" for b in blocks],
        np.minimum(1.0, share(STOP) * 10 / n),
        share(UPPER) / n,
        share(DIGIT) / n,
        i / count,
        1.0 / (1 + i),
        1.0 / (count - i),
    )
    for k, measure in enumerate(measures):
        out[:, PATH + WORDS + k] = measure
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        s = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"], self.p[f"h{d}"] = s(WIDTH, 4 * HIDDEN), s(HIDDEN, 4 * HIDDEN)
            self.p[f"c{d}"] = np.zeros(4 * HIDDEN, np.float32)
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p["o"], self.p["oc"] = s(2 * HIDDEN, 1), np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction over x (time, pages, WIDTH); and, to ``keep``, what the way back needs."""
        t, n, _ = x.shape
        a = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, saved = np.zeros((t, n, HIDDEN), np.float32), [None] * t
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = a[k] + h @ self.p[f"h{d}"]
            g = _sigmoid(z)
            i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN : 3 * HIDDEN], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            now = f * c + i * u
            tc = np.tanh(now)
            if keep:
                saved[k] = (h, c, i, f, o, u, tc, m)
            h, c = np.where(m, o * tc, h), np.where(m, now, c)
            out[k] = h
        return out, saved

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        f, sf = self._run(x, mask, "f", keep)
        b, sb = self._run(x, mask, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return _sigmoid(both @ self.p["o"] + self.p["oc"])[..., 0], both, sf, sb

    def _back(self, x, grad, saved, d, g):
        n = x.shape[1]
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        dz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        for k in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
            h, c, i, f, o, u, tc, m = saved[k]
            total = dh + grad[k]
            inner = np.where(m, total * o * (1 - tc * tc) + dc, 0)
            part = np.concatenate([inner * u * i * (1 - i), inner * c * f * (1 - f), np.where(m, total * tc * o * (1 - o), 0), inner * i * (1 - u * u)], axis=1)
            dz[k] = part
            g[f"h{d}"] += h.T @ part
            dh = np.where(m, part @ self.p[f"h{d}"].T, total)
            dc = np.where(m, inner * f, dc)
        flat = dz.reshape(-1, 4 * HIDDEN)
        g[f"x{d}"] += x.reshape(-1, WIDTH).T @ flat
        g[f"c{d}"] += flat.sum(axis=0)

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], passes: int = PASSES, seed: int = SEED) -> Labeller:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for turn in range(passes):
            order = rng.permutation(len(pages))
            order = [order[i : i + 24] for i in range(0, len(order), 24)]
            for group in order:
                x, mask, y = pad([pages[i] for i in group])
                p, both, sf, sb = self.forward(x, mask, keep=True)
                err = (np.where(mask, p - y, 0) / mask.sum()).astype(np.float32)[..., None]
                g = {k: np.zeros_like(w) for k, w in self.p.items()}
                g["o"] += both.reshape(-1, 2 * HIDDEN).T @ err.reshape(-1, 1)
                g["oc"] += err.sum()
                grad = err @ self.p["o"].T
                self._back(x, grad[..., :HIDDEN], sf, "f", g)
                self._back(x, grad[..., HIDDEN:], sb, "b", g)
                step += 1
                rate = 0.01 * (1 - turn / passes) + 1e-4
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page the probability of each block to belong to the main text."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group = order[at : at + max(1, min(128, 20_000 // len(pages[order[min(at + 127, len(order) - 1)]])))]
            at += len(group)
            x, mask, _ = pad([(pages[i], None) for i in group])
            p = self.forward(x, mask)[0]
            for j, i in enumerate(group):
                out[i] = p[: len(pages[i]), j]
        return out


def pad(pages):
    t = max(len(x) for x, _ in pages)
    x = np.zeros((t, len(pages), WIDTH), np.float32)
    mask, y = np.zeros((t, len(pages)), bool), np.zeros((t, len(pages)), np.float32)
    for j, (v, label) in enumerate(pages):
        x[: len(v), j], mask[: len(v), j] = v, True
        if label is not None:
            y[: len(v), j] = label
    return x, mask, y


#: Names that pages give to parts that are no main text.
NAV = "nav navbar navigation menu topmenu mainmenu breadcrumb breadcrumbs toc pagination pager tabs links".split()
HEAD = "header masthead banner topbar site-header logo branding tagline".split()
FOOT = "footer foot site-footer bottom copyright legal colophon imprint".split()
SIDE = "sidebar aside widget related recommended more popular trending side rail teaser archive tags categories".split()
ADS = "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense adbox".split()
NOTICE = "cookie cookies consent notice alert gdpr privacy-banner popup modal paywall newsletter subscribe".split()
FORMS = "form search login signup newsletter-form contact subscribe-form poll".split()
TALK = "comments comment commentlist comment-list discussion replies responses disqus reply comment-body reader-comments".split()
SHARE = "share social sharing follow meta byline author-box".split()
MAIN = "article content main post entry story body text article-body post-content entry-content main-content page".split()
SYLLABLES = "ba ce di fo gu la me ni or pu ra se ti un ver der tion que les en ing th er an st al is ou".split()


def _text(r: random.Random, least: int, most: int) -> str:
    out = []
    for _ in range(r.randint(least, most)):
        out.append("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))))
    text = " ".join(out).capitalize()
    if r.random() < 0.15:
        text = " ".join(w + r.choice(["***", "%%%", "$$$", "&amp;&amp;", "!!"]) for w in text.split())
    if r.random() < 0.07:
        text = text.upper()
    return text if r.random() < 0.12 else text + r.choice(".....!?")


def example(r: random.Random) -> list[tuple[str, bool]]:
    """A page as pieces (markup, whether it is main text)."""
    page: list[tuple[str, bool]] = []
    add = lambda s, main=False: page.append((s, main))

    def attrs(names, odds=0.8):
        if r.random() > odds:
            return ""
        name = r.choice(names)
        if r.random() < 0.3:
            name = f"{r.choice(['site', 'page', 'block', 'js', 'c', 'box', 'wrap'])}-{name}"
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def link(least=1, most=4):
        return f'<a href="/{r.randint(1, 99)}">{_text(r, least, most).rstrip(".!?")}</a>'

    def menu(names, tag=None):
        tag = tag or r.choice(["nav", "nav", "div", "ul"])
        add(f"<{tag}{attrs(names, 0.5 if tag == 'nav' else 1.0)}>" + ("<ul>" if tag != "ul" else ""))
        for _ in range(r.randint(2, 10)):
            add(f"<li>{link()}</li>")
        add(("</ul>" if tag != "ul" else "") + f"</{tag}>")

    def box(names, tags=("div", "section", "aside"), least=1, most=3, size=(2, 40)):
        tag = r.choice(tags)
        add(f"<{tag}{attrs(names, 1.0 if tag in ('div', 'section') else 0.6)}>")
        for _ in range(r.randint(least, most)):
            kind = r.random()
            if kind < 0.25:
                add(f"<h3>{_text(r, 1, 5)}</h3>")
            elif kind < 0.45:
                add(f"<ul><li>{link(1, 8)}</li><li>{link(1, 8)}</li></ul>")
            elif kind < 0.75:
                add(f"<p>{_text(r, *size)}</p>")
            else:
                add(_text(r, *size))
        add(f"</{tag}>")

    def form():
        add(f"<form{attrs(FORMS)}><label>{_text(r, 1, 3)}</label><input name=q><select><option>{_text(r, 1, 2)}<option>{_text(r, 1, 2)}</select><button>{_text(r, 1, 2)}</button></form>")

    def advert():
        add(f"<!-- ad {r.randint(0, 9)} -->")
        if r.random() < 0.6:
            add(f'<div{attrs(ADS, 1.0)}>{_text(r, 2, 40)}</div>')
        else:
            box(ADS, ("div", "aside"))

    def talk():
        add(f"<{(tag := r.choice(['section', 'div', 'div']))}{attrs(TALK, 1.0)}>")
        if r.random() < 0.7:
            add(f"<h2>{_text(r, 1, 3)}</h2>")
        inner = r.choice(["div", "li", "article"])
        for _ in range(r.randint(1, 6)):
            add(f'<{inner}{attrs(TALK, 0.9)}>' + (f"<b>{_text(r, 1, 2)}</b> " if r.random() < 0.4 else "") + f"<p>{_text(r, 3, 50)}</p></{inner}>")
        if r.random() < 0.4:
            form()
        add(f"</{tag}>")

    def body():
        for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            text = _text(r, *r.choice([(1, 4), (5, 40), (20, 120)]))
            if kind < 0.6:
                add(f"<p>{text}</p>", True)
            elif kind < 0.72:
                add(f"<p><b>{text}<br><p>{_text(r, 3, 50)}</p>", True)
            elif kind < 0.78:
                add(f"<h2>{_text(r, 1, 8)}</h2>", True)
            elif kind < 0.84:
                add(f"<ul><li>{_text(r, 2, 15)}</li><li>{_text(r, 2, 15)}</li></ul>", True)
            elif kind < 0.88:
                add(f"<blockquote>{text}</blockquote>", True)
            elif kind < 0.91:
                add(f"<p>{_text(r, 3, 20)} {link()} {_text(r, 3, 20)}</p>", True)
            elif kind < 0.93:
                add(f"<table><tr><td>{_text(r, 1, 3)}</td><td>{_text(r, 1, 3)}</td></tr></table>", True)
            elif kind < 0.95:
                add(f"<pre>{text}</pre>", True)
            elif kind < 0.97:
                add(f"<figure><figcaption>{_text(r, 2, 12)}</figcaption></figure>", True)
            else:
                r.choice([advert, lambda: box(SHARE, ("div", "ul"), 1, 2, (1, 4)), lambda: box(SIDE, ("aside", "div"))])()

    add(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{_text(r, 2, 14)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
    if r.random() < 0.25:
        box(NOTICE, ("div", "section"), 1, 2)
    if r.random() < 0.5:
        add(f"<header{attrs(HEAD, 0.5)}><h1>{_text(r, 1, 3)}</h1>" if r.random() < 0.6 else f"<div{attrs(HEAD, 1.0)}>{_text(r, 1, 6)}")
        if r.random() < 0.5:
            menu(NAV)
        add("</header></div>")
    if r.random() < 0.8:
        menu(NAV)
    for _ in range(r.choice([0, 0, 1, 1, 2])):
        r.choice([advert, advert, form, lambda: box(SIDE), lambda: box(NOTICE, ("div",)), lambda: menu(NAV)])()
    outer = "<main>" if r.random() < 0.3 else ""
    tag = r.choice(["article", "article", "article", "div", "section", "main"])
    add(outer + f"<{tag}{attrs(MAIN, 0.4 if tag in ('article', 'main') else 1.0)}>")
    if r.random() < 0.85:
        title = f"<h1>{_text(r, 1, 14)}</h1>"
        add(f"<header>{title}</header>" if r.random() < 0.15 else title, True)
    if r.random() < 0.2:
        box(SHARE, ("div", "ul"), 1, 2, (1, 4))
    body()
    add(f"</{tag}>")
    for _ in range(r.choice([0, 0, 1, 2])):
        r.choice([advert, lambda: box(SIDE), talk, talk, form, lambda: box(SHARE, ("div",), 1, 2, (1, 4))])()
    if outer:
        add("</main>")
    if r.random() < 0.3:
        box(SIDE)
    if r.random() < 0.85:
        add(f"<footer{attrs(FOOT, 0.4)}>&copy; {_text(r, 1, 20)} &middot; {_text(r, 2, 20)}</footer>" if r.random() < 0.7 else f"<div{attrs(FOOT, 1.0)}><p>{_text(r, 2, 25)}</p></div>")
    if r.random() < 0.15:
        box(NOTICE, ("div",), 1, 2)
    add("</body></html>" if r.random() < 0.9 else "")
    return page


def labelled(r: random.Random) -> tuple[list[Leaf], np.ndarray]:
    """A composed page's blocks and their labels. A mark inside each piece of text
    carries the label through the parser."""
    page = []
    for markup, main in example(r):
        page.append(markup.replace(">", ">\x01") if main else markup)
    blocks = leaves("".join(page))
    label = np.array([float("\x01" in b.text) for b in blocks], np.float32)
    for b in blocks:
        b.text = b.text.replace("\x01", "").strip()
    keep = [i for i, b in enumerate(blocks) if b.text]
    return [blocks[i] for i in keep], label[keep]


@functools.cache
def trained() -> Labeller:
    r = random.Random(SEED)
    pages = [labelled(r) for _ in range(EXAMPLES)]
    return Labeller().train([(vectors(b), y) for b, y in pages if b])


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    blocks = [leaves(p) for p in pages]
    labels = model.label([vectors(b) for b in blocks])
    return ["\n".join(b.text for b, p in zip(bs, ps) if p >= THRESHOLD) for bs, ps in zip(blocks, labels)]


def _extracted(model: Labeller):
    def run(batches):
        for batch in batches:
            pages = [p for (p,) in _texts(batch, "_html")]
            texts = [t for a in range(0, len(pages), 256) for t in main_texts(pages[a : a + 256], model)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    text: the blocks of the main text in page order, one a line; empty where
    there is none, as for null, empty or markup-only pages. Broken markup is read
    as far as it goes. Ids and URLs pass through as they are, null and repeated
    ones too; other columns are not read. An empty table gives no rows.
    """
    ship(pages.sparkSession)
    wide = pages.select("page_id", "url", F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    kind = wide.schema["page_id"].dataType.simpleString()
    return wide.mapInArrow(_extracted(trained()), f"page_id {kind}, url string, text string, n_chars long")
