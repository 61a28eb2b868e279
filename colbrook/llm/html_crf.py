"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with its open
elements. Every block gets features from its ancestors' tags, classes and ids and from its text
(length, share of link text, end punctuation, special signs). A two-label chain (article or not)
is trained on labelled pages and decoded by Viterbi; the article blocks joined by a line feed
are the main text. Scripts, styles, comments and form fields never become blocks.

The labelled pages are made here by `labelled_pages`, which writes pages of many templates with
known labels; their number is a parameter. The trained weights are a few hundred numbers and are
broadcast; extraction is map-only, so pages are never shuffled.

A page takes time and memory in proportion to its length, however deep its elements are nested:
open elements are linked to those around them and share their features.

Defined cases: a null or empty page gives an empty text; a page without article blocks too; tags
and comments that never end are read to the end of the page; a quote that never ends does not
count; of equally good labellings the one whose blocks leave the article first is taken; texts
of any length are whole; repeated rows repeat;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, prepare

#: Elements whose content is never text of the page.
HIDDEN = frozenset("script style noscript template title textarea select option button svg iframe object canvas audio video math datalist".split())
#: Elements that are part of a line of text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements around everything, which tell nothing of a block.
ROOTS = frozenset(("html", "body"))
#: Open tags that end an open element of the given kinds.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
#: A whole tag with its quoted values.
_TAG = re.compile(r"""</?[a-zA-Z][^\s/>]*+[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+>""")
_STOP = re.compile("[\"'>]")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WHITE = re.compile(r"[ \t\n\x0b\f\r]+")


class Element:
    """An open element, linked to the one around it, with what it tells of the blocks inside.

    signs: distinct features of it and those around it; tag, top: the nearest element, and the
    outermost that is no div; near: the beginning of the nearest class, id or role name; own:
    whether the nearest element has that name itself.
    """

    __slots__ = ("near", "name", "own", "parent", "signs", "tag", "top")

    def __init__(self, parent: Element | None, name: str, attributes: str, known):
        self.parent, self.name = parent, name
        words = [w.lower() for names in _NAMES.findall(attributes) for n in names if n for w in _SPLIT.findall(n)] if attributes else []
        root = name in ROOTS
        self.signs = around = parent.signs if parent else frozenset()
        self.tag, self.top = (parent.tag, parent.top) if parent else ("", "")
        self.near, self.own = (parent.near, parent.own and root) if parent else ("", False)
        signs = [f"named={w}" for w in words] + [f"like={w[:4]}" for w in words]
        if not root:
            signs.append(f"in={name}")
            self.tag = name
            if not self.top and name != "div":
                self.top = name
        if words:
            self.near, self.own = words[-1][:4], True
        new = {f for f in signs if f not in around and (known is None or f in known)}
        if new:
            self.signs = around | new


class Scanner:
    """Where tags end, in time proportional to the page whatever its quotes."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.broken, self.dead = False, set()

    def tag_end(self, start: int, attributes: int) -> int:
        """Where the ">" of the tag at `start` is; a quote that never ends does not count as one."""
        if not self.broken:
            if m := _TAG.match(self.page, start):
                return m.end() - 1
            self.broken = True
        at, seen = attributes, []
        while m := _STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            close = self.page.find(m[0], m.end())
            at = close + 1
            if close < 0 or at in self.dead:
                break
            seen.append(at)
        self.dead.update(seen)  # from these places on no tag ends
        return self.page.find(">", attributes)


def leaf_blocks(page: str, known=None) -> list[tuple[str, Element | None, int]]:
    """(text, innermost element, characters of link text) of every non-empty leaf block.

    With `known` (a set or dict) elements keep those features only, so that their number has a bound.
    """
    out: list[tuple[str, Element | None, int]] = []
    element: Element | None = None
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _WHITE.sub(" ", html.unescape("".join(parts))).strip(" ")
            if text:
                out.append((text, element, linked))
            parts.clear()
        linked = 0

    scan = Scanner(page)
    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        tag = _NAME.match(page, start) if start == at else None
        if start != at or not tag and page[at + 1 : at + 2] not in ("!", "?"):
            stop = at + 1 if start == at else start if start >= 0 else end
            parts.append(page[at:stop])
            if links:
                linked += len(page[at:stop].strip())
            at = stop
            continue
        if not tag:
            close = page.find("-->", at + 4) + 2 if page.startswith("<!--", at) else page.find(">", at) if at < scan.last else -1
            at = close + 1 if close > at else end
            continue
        if tag.end() > scan.last:
            break
        close = scan.tag_end(at, tag.end())
        name, closing, attributes = tag[1].lower(), page[at + 1] == "/", page[tag.end() : close]
        at = close + 1
        if name in HIDDEN and not closing:
            if not attributes.endswith("/") or name in ("script", "style", "title", "textarea"):
                shut = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at, scan.last + 1)
                at = shut.end() if shut else end
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                links = max(0, links + (-1 if closing else 1))
            continue
        flush()
        links = 0
        if closing:
            while opened[name]:
                opened[element.name] -= 1
                gone, element = element, element.parent
                if gone.name == name:
                    break
        elif name not in VOID:
            ends = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
            if element and element.name in ends:
                opened[element.name] -= 1
                element = element.parent
            element = Element(element, name, attributes, known)
            opened[name] += 1
    flush()
    return out


def features(blocks: list[tuple[str, Element | None, int]]) -> list[list[str]]:
    out = []
    for i, (text, element, linked) in enumerate(blocks):
        words = text.count(" ") + 1
        f = ["bias", f"words={min(5, words.bit_length())}", f"links={min(3, 4 * linked // max(1, len(text)))}", *(element.signs if element else ())]
        f.append("tag=" + (element.tag if element else ""))
        f.append("top=" + (element.top if element else ""))
        if element and element.near:
            f.append(f"near={element.near}")
            f.append(f"own={element.near}" if element.own else "far")
        if text[-1] in ".!?:;\"'”»…":
            f.append("stop")
        if "©" in text[:40] or "·" in text or "|" in text:
            f.append("sign")
        if i == 0:
            f.append("first")
        if i == len(blocks) - 1:
            f.append("last")
        out.append(sorted(f))
    return out


def forward_backward(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Log sums over all labellings before and after each block, and over all; t[a, b]: a to b."""
    n = len(s)
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    fwd[0] = s[0]
    for i in range(1, n):
        fwd[i] = s[i] + np.logaddexp(fwd[i - 1, 0] + t[0], fwd[i - 1, 1] + t[1])
    for i in range(n - 2, -1, -1):
        bwd[i] = np.logaddexp(t[:, 0] + s[i + 1, 0] + bwd[i + 1, 0], t[:, 1] + s[i + 1, 1] + bwd[i + 1, 1])
    return fwd, bwd, float(np.logaddexp(fwd[-1, 0], fwd[-1, 1]))


class Chain:
    """Two-label linear-chain CRF: weights of features for label 1, and transition scores."""

    def __init__(self, rounds: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 11):
        self.rounds, self.rate, self.decay, self.seed = rounds, rate, decay, seed
        self.weights: dict[str, float] = {}
        self.step = [[0.0, 0.0], [0.0, 0.0]]

    def fit(self, pages: list[tuple[list[list[str]], list[int]]]) -> Chain:
        """AdaGrad on the log-likelihood, with forward-backward marginals."""
        names = {f: i for i, f in enumerate(sorted({f for fs, _ in pages for b in fs for f in b}))}
        data = [([np.array([names[f] for f in b]) for b in fs], np.array(y)) for fs, y in pages if fs]
        w, a = np.zeros(len(names)), np.full(len(names), 1e-6)
        t, ta = np.zeros((2, 2)), np.full((2, 2), 1e-6)
        order = np.random.default_rng(self.seed)
        for _ in range(self.rounds):
            for k in order.permutation(len(data)):
                index, y = data[k]
                n = len(y)
                s = np.zeros((n, 2))
                s[:, 1] = [w[i].sum() for i in index]
                fwd, bwd, z = forward_backward(s, t)
                gap = y - np.exp(fwd[:, 1] + bwd[:, 1] - z)
                flat = np.concatenate(index)
                g = np.bincount(flat, weights=np.repeat(gap, [len(i) for i in index]), minlength=len(names)) - self.decay * w
                a += g * g
                w += self.rate * g / np.sqrt(a)
                if n > 1:
                    both = fwd[:-1, :, None] + t + (s[1:] + bwd[1:])[:, None, :] - z
                    tg = -np.exp(both).sum(0)
                    np.add.at(tg, (y[:-1], y[1:]), 1)
                    tg -= self.decay * t
                    ta += tg * tg
                    t += self.rate * tg / np.sqrt(ta)
        self.weights = {f: float(w[i]) for f, i in names.items()}
        self.step = t.tolist()
        return self

    def decode(self, blocks: list[list[str]]) -> list[int]:
        """Viterbi."""
        get = self.weights.get
        (t00, t01), (t10, t11) = self.step
        back: list[tuple[int, int]] = []
        p0 = p1 = 0.0
        for i, fs in enumerate(blocks):
            s = sum(get(f, 0.0) for f in fs)
            if i == 0:
                p0, p1 = 0.0, s
                back.append((0, 0))
                continue
            a, b = (0, p0 + t00) if p0 + t00 >= p1 + t10 else (1, p1 + t10)
            c, d = (0, p0 + t01) if p0 + t01 > p1 + t11 else (1, p1 + t11)
            back.append((a, c))
            p0, p1 = b, d + s
        label, out = int(p1 > p0), []
        for i in range(len(blocks) - 1, -1, -1):
            out.append(label)
            label = back[i][label]
        return out[::-1]


def labelled_pages(count: int = 800, seed: int = 5) -> list[tuple[str, list[str]]]:
    """(page, its article blocks): pages of many templates, written from a seed."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice("aeiou" if i % 2 else "bcdfghlmnprstvz") for i in range(r.randint(2, 9)))

    def line(low: int, high: int, stop: str = ".") -> str:
        return " ".join(word() for _ in range(r.randint(low, high))).capitalize() + stop

    def name(*options: str) -> str:
        n = r.choice(options)
        return r.choice((f' class="{n}"', f' id="{n}"', f" class='{n} c{r.randint(1, 9)}'"))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{line(1, 3, "")}</a></li>' for _ in range(n))

    def junk(kind: str) -> str:
        if kind == "nav":
            return r.choice((f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>", f"<div{name('nav', 'menu', 'navbar', 'breadcrumb', 'site-nav')}><ul>{links(r.randint(2, 8))}</ul></div>", f"<ul{name('menu', 'nav-list', 'pagination', 'tags')}>{links(4)}</ul>"))
        if kind == "header":
            return r.choice((f"<header><div{name('logo', 'brand', 'site-title')}>{line(1, 3, '')}</div><p>{line(2, 6)}</p></header>", f"<header>{line(2, 6, r.choice(('', '.')))}</header>", f"<header><{(t := r.choice(('h1', 'h2', 'p')))}>{line(1, 4, '')}</{t}></header>", f"<div{name('header', 'masthead', 'topbar', 'banner', 'site-header')}><h2>{line(1, 3, '')}</h2><p>{line(3, 20)}</p></div>"))
        if kind == "aside":
            inner = r.choice((f"<h3>{line(1, 3, '')}</h3><ul>{links(4)}</ul>", f"<p>{line(3, 40)}</p>" * r.randint(1, 3), line(3, 30)))
            return r.choice((f"<aside>{inner}</aside>", f"<div{name('sidebar', 'aside', 'widget', 'related', 'related-posts', 'recommended', 'popular')}>{inner}</div>", f"<section{name('related', 'sidebar', 'more-stories')}>{inner}</section>"))
        if kind == "ad":
            return f"<{(t := r.choice(('div', 'section', 'aside', 'p')))}{name('ad', 'ads', 'advert', 'advertisement', 'ad-slot', 'sponsored', 'promo', 'promotion')}>{line(2, 40)}</{t}>"
        if kind == "notice":
            return f"<{(t := r.choice(('div', 'section', 'p')))}{name('cookie', 'cookie-notice', 'consent', 'notice', 'alert', 'gdpr', 'popup', 'modal', 'newsletter', 'cookie-banner', 'paywall', 'disclaimer')}>{r.choice(('<p>' + line(4, 30) + '</p>', line(4, 30)))}</{t}>"
        if kind == "form":
            return r.choice((f"<form{r.choice(('', name('search', 'login', 'subscribe', 'signup', 'contact-form')))}><p>{line(2, 12)}</p><label>{line(1, 2, '')}</label><input name='q'><button>{word()}</button></form>", f"<form action='/{word()}'>{line(1, 14)}<input type='text'></form>"))
        if kind == "comments":
            one = "".join(r.choice((f"<div{name('comment', 'comment-body', 'reply', 'user-comment')}><p>{line(3, 40)}</p></div>", f"<p>{line(3, 40)}</p>", f"<li{name('comment', 'reply')}>{line(3, 40)}</li>", f"<article{name('comment', 'reply')}><p>{line(3, 40)}</p></article>")) for _ in range(r.randint(1, 5)))
            return f"<{(t := r.choice(('div', 'section', 'ol')))}{name('comments', 'comment-list', 'responses', 'disqus', 'discussion', 'replies', 'reader-comments')}><h3>{line(1, 3, '')}</h3>{one}</{t}>"
        if kind == "share":
            return f"<div{name('share', 'social', 'social-links', 'share-buttons', 'author-bio', 'meta')}>{links(3)}</div>"
        return r.choice((f"<footer>&copy; {line(2, 12)}</footer>", f"<footer><p>{line(2, 30)}</p><ul>{links(3)}</ul></footer>", f"<div{name('footer', 'site-footer', 'copyright', 'legal', 'colophon')}>&copy; {line(2, 20)}</div>"))

    out = []
    for _ in range(count):
        text: list[str] = []
        body: list[str] = []

        def block(tag: str, low: int, high: int, stop: str = ".") -> None:
            words = line(low, high, stop)
            text.append(words)
            cut = words.split(" ")
            if len(cut) > 4 and r.random() < 0.3:
                i = r.randrange(1, len(cut) - 2)
                cut[i] = r.choice((f"<b>{cut[i]}</b>", f'<a href="/x">{cut[i]}</a>', f"<em>{cut[i]}</em>"))
            body.append(f"<{tag}>{' '.join(cut)}</{tag}>" if r.random() > 0.05 or tag != "p" else f"<p>{' '.join(cut)}")

        bare = r.random() < 0.08
        x = r.random()
        if x < 0.75:
            block("h1", 1, 10, r.choice(("", "", ".")))
        elif x < 0.9 and not bare:
            body.append("<header>")
            block(r.choice(("h1", "h2")), 1, 10, "")
            body.append("</header>")
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.72:
                block("p", *r.choice(((1, 3), (3, 12), (12, 90), (12, 90))))
            elif x < 0.79:
                block(r.choice(("h2", "h3")), 1, 6, "")
            elif x < 0.84:
                body.append(r.choice(("<ul>", "<ol>")))
                for _ in range(r.randint(1, 4)):
                    block("li", 1, 15, r.choice(("", ".")))
                body.append("</ul>")
            elif x < 0.87:
                block("blockquote", 4, 40)
            elif x < 0.89:
                block(r.choice(("pre", "figcaption", "td", "div")), 3, 20)
            elif x < 0.97:
                body.append(junk(r.choice(("ad", "aside", "ad", "share", "form", "notice", "nav"))))
        inner = "".join(body)
        if r.random() < 0.12:
            inner += junk("comments")
        main = inner if bare else r.choice(("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div" + name("content", "article", "post", "entry-content", "story", "article-body", "main-content", "post-body") + ">{}</div>", "<section" + name("content", "post", "article-text") + ">{}</section>", "<article" + name("post", "entry", "article") + "><div" + name("entry-content", "body", "text") + ">{}</div></article>")).format(inner)
        top = [junk(k) for k in ("nav", "header", "ad", "notice", "form") if r.random() < 0.5]
        r.shuffle(top)
        low = [junk(k) for k in ("comments", "aside", "share", "ad", "form", "nav", "notice") if r.random() < 0.35]
        r.shuffle(low)
        foot = junk("footer") if r.random() < 0.85 else ""
        if bare and r.random() < 0.5:
            top, low, foot = [], [], ""
        pieces = "".join(top) + main + "".join(low) + foot
        if r.random() < 0.2:
            pieces = f"<div{name('page', 'wrapper', 'container', 'layout')}>{pieces}</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{line(1, 6)}</title></head><body>{pieces}</body></html>", text))
    return out


def labels_of(blocks: list[tuple[str, Element | None, int]], article: list[str]) -> list[int]:
    """1 for the blocks that are the article's, matched in order."""
    out, at = [], 0
    for text, *_ in blocks:
        hit = at < len(article) and text == article[at]
        out.append(int(hit))
        at += hit
    return out


def train(count: int = 800, seed: int = 5) -> Chain:
    pages = []
    for page, article in labelled_pages(count, seed):
        blocks = leaf_blocks(page)
        pages.append((features(blocks), labels_of(blocks, article)))
    return Chain().fit(pages)


def main_text(chain: Chain, page: str) -> str:
    blocks = leaf_blocks(page, chain.weights)
    return "\n".join(b[0] for b, y in zip(blocks, chain.decode(features(blocks))) if y)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark = pages.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(chain or train())
    kind = pages.schema["page_id"].dataType.simpleString()

    def make():
        own = sent.value

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(own, p) if p else "" for p in b.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return run

    return map_batches(pages.select("page_id", "url", "html"), make, f"page_id {kind}, url string, text string, n_chars long")
