"""Main text of web pages: gradient-boosted trees over the nodes of the page, decoded down the tree.

A tolerant scanner builds a tree of block elements whose leaves are text blocks (text between block boundaries, character references
decoded, white space one space). Inline elements only add to their block's figures; scripts, styles and other raw text hold no text, to the page's end where they aren't closed. What a browser draws
instead of showing its content (``DRAWN``) is left out where it is closed before the page's structure goes on; else its tag alone is. Time is linear in the page, however deep it is nested.

Each node has subtree density, link share, punctuation, attribute tokens (its own and inherited), tag, depth
and sibling statistics. What an attribute token says is learned: the log-odds of main text among the training nodes that have it (words of class, id, role and the like, and their first four letters). Boosted trees give the probability that a node holds main text; the decoding takes the likeliest labelling in which
no node holds main text under one that doesn't, and a holder keeps only the leaves that are labelled themselves.

There are no labelled pages, so tokens and trees are fitted on ``PAGES`` pages that ``invent`` writes from a fixed seed: articles in different layouts with
menus, headers, footers, sidebars, notices, adverts, forms and reader comments around them. Nothing is fitted to the input.

Nulls: a null html is empty, with an empty text. Other nulls are kept as they are. Repeated rows stay repeated, an empty table
gives an empty result, extra columns are ignored. A text is never cut short.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

PAGES, TREES, DEPTH, RATE, BINS, SEED = 500, 48, 4, 0.25, 32, 11

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
DRAWN = frozenset("button select datalist svg canvas audio video template noscript".split())
STRUCTURE = "article|main|section|nav|header|footer|aside|form|h[1-6]|body"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter nobr output progress q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br object map math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mspace mstyle semantics annotation".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",), "body": ("head",)}
KEEPS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
TAGS = {t: k for k, group in enumerate(("main article", "h1", "p", "blockquote pre", "h2 h3 h4 h5 h6", "figure figcaption", "table thead tbody tr td th", "section div center", "body html", "ol ul dl menu dir", "li dt dd", "header hgroup", "address details summary dialog", "aside", "form fieldset legend", "footer", "nav")) for t in group.split()}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_POINT = re.compile(r"[.,;:!?]")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[a-z]+")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: What comes first: the end of a drawn element, another of its kind, or the page's structure.
_STOPS = {t: re.compile(rf"(</{t}\s*>)|<{t}\b|</?(?:{STRUCTURE})\b", re.I) for t in DRAWN}


def tokens(name: str) -> set[str]:
    """Words of attribute values, and the first four letters of longer ones."""
    own = set(_WORD.findall(_HUMP.sub(" ", name).lower()))
    return own | {t[:4] + "*" for t in own if len(t) > 4}


class Page:
    """Nodes in page order, each after its parent; leaves have text."""

    __slots__ = ("tag", "parent", "name", "text", "links")

    def __init__(self, source: str):
        self.tag, self.parent, self.name, self.text, self.links = ["html"], [-1], [""], [None], [0]
        stack, held, linked, in_link = [0], [], 0, 0
        places: dict[str, list[int]] = {}  # of each open tag: where in the stack

        def flush():
            nonlocal held, linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self._add("#", stack[-1], "", text, min(linked, len(text)))
                held, linked = [], 0

        def close(at: int):
            """The element at this place of the stack ends, and with it all above."""
            for k in stack[at:]:
                places[self.tag[k]].pop()
            del stack[at:]

        def last(tag: str) -> int:
            return places[tag][-1] if places.get(tag) else 0

        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            end = m.start() if m else n
            if end > at:
                piece = entities.unescape(source[at:end])
                held.append(piece)
                if in_link:
                    linked += len(piece.strip())
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag in RAW:
                if not m[1] and not m[3].endswith("/"):
                    ends = _ENDS[tag].search(source, at)
                    at = ends.end() if ends else n
                continue
            if tag in DRAWN:
                if not m[1] and not m[3].endswith("/"):
                    stop = _STOPS[tag].search(source, at)
                    if stop and stop[1]:
                        at = stop.end()
                held.append(" ")
                continue
            if tag in INLINE:
                if tag == "a":
                    in_link = 0 if m[1] else 1
                elif tag == "br":
                    held.append("\n")
                continue
            flush()
            in_link = 0
            if tag in VOID:
                continue
            if m[1]:
                if last(tag):
                    close(last(tag))
                continue
            if tag == "html":
                continue
            if tag in CLOSES_P and last("p"):
                close(last("p"))
            edge = max((last(k) for k in KEEPS.get(tag, ())), default=0)
            for other in CLOSES.get(tag, ()):
                if last(other) > edge:
                    close(last(other))
            name = " ".join(x.strip("\"'") for x in _NAMES.findall(m[3])) if "=" in m[3] else ""
            places.setdefault(tag, []).append(len(stack))
            stack.append(self._add(tag, stack[-1], name, None, 0))
        flush()

    def _add(self, tag, parent, name, text, links) -> int:
        self.tag.append(tag), self.parent.append(parent), self.name.append(name), self.text.append(text), self.links.append(links)
        return len(self.tag) - 1


def features(page: Page, odds: dict[str, float]) -> list[list[float]]:
    """A row for each node. odds: what attribute tokens say."""
    n = len(page.tag)
    kind, depth, said, least = [0.0] * n, [0] * n, [0.0] * n, [0.0] * n
    chars, links, leaves, elements, points, kids, order, same = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    by_tag: dict = {}
    for i in range(n):
        p, text = page.parent[i], page.text[i]
        name = page.name[i]
        kind[i] = float(TAGS.get(page.tag[i], 7)) if text is None else kind[p]
        if name:
            found = [odds[t] for t in tokens(name) if t in odds]
            said[i], least[i] = sum(found), min(found, default=0.0)
        if p >= 0:
            depth[i] = depth[p] + 1
            order[i] = kids[p]
            kids[p] += 1
            by_tag[p, page.tag[i]] = by_tag.get((p, page.tag[i]), 0) + 1
        if text is None:
            elements[i] = 1
        else:
            chars[i], links[i], leaves[i], points[i] = len(text), page.links[i], 1, len(_POINT.findall(text))
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        leaves[p] += leaves[i]
        elements[p] += elements[i]
        points[p] += points[i]
    out, seen = [], 0
    up: list = [None] * n
    total = max(1, chars[0])
    for i in range(n):
        p = page.parent[i]
        over = up[p] if p >= 0 else (0.0, 0.0, 0.0, 99.0)
        # inherited: the least and the most that attributes say; the most and least main-like tag above
        up[i] = (min(over[0], least[i]), max(over[1], said[i]), max(over[2], kind[i]) if page.text[i] is None and kind[i] not in (8.0,) else over[2], min(over[3], kind[i]))
        c = chars[i]
        out.append([
            page.text[i] is not None, kind[i], depth[i], said[i], least[i], *up[i],
            c, links[i] / max(1, c), c / max(1, elements[i]), leaves[i], c / max(1, leaves[i]), points[i] / max(1, c), c / total,
            kids[p] if p >= 0 else 0, by_tag.get((p, page.tag[i]), 0), order[i] / max(1, kids[p]) if p >= 0 else 0, c / max(1, chars[p]) if p >= 0 else 1,
            seen / total, chars[p] / max(1, leaves[p]) if p >= 0 else 0, links[p] / max(1, chars[p]) if p >= 0 else 0, kind[p] if p >= 0 else 99,
        ])
        if page.text[i] is not None:
            seen += c
    return out


class Boosted:
    """Logistic gradient boosting with histogram splits; complete trees of one depth in arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.depth = depth
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        self.base = float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))
        f = np.full(len(y), self.base)
        self.feature, self.at, self.value = [], [], []
        inner = (1 << depth) - 1
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, at = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(depth):
                first, many = (1 << level) - 1, 1 << level
                best, pick, where = np.full(many, 1e-9), np.zeros(many, np.int64), np.full(many, -1)
                own = node - first
                for k in range(x.shape[1]):
                    if not len(cuts[k]):
                        continue
                    cell = own * bins + binned[:, k]
                    gs, hs = (np.bincount(cell, w, many * bins).reshape(many, bins).cumsum(axis=1) for w in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    b = gain.argmax(axis=1)
                    top = gain[np.arange(many), b]
                    better = (top > best) & (b < len(cuts[k]))
                    best[better], pick[better], where[better] = top[better], k, b[better]
                for j in np.flatnonzero(where >= 0):
                    feature[first + j], at[first + j] = pick[j], cuts[pick[j]][where[j]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > at[node])
            leaf = node - inner
            value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            f += value[leaf]
            self.feature.append(feature), self.at.append(at), self.value.append(value)

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, at, value in zip(self.feature, self.at, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > at[node])
            f += value[node - len(feature)]
        return 1 / (1 + np.exp(-f))


def decode(page: Page, p: np.ndarray) -> list[int]:
    """The leaves that the likeliest consistent labelling keeps, in page order."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    for i in range(len(yes) - 1, 0, -1):
        up = page.parent[i]
        yes[up] += max(yes[i], no[i])
        no[up] += no[i]
    keep, out = [True] + [False] * (len(yes) - 1), []
    for i in range(1, len(yes)):
        keep[i] = keep[page.parent[i]] and yes[i] > no[i]
        if keep[i] and page.text[i] is not None:
            out.append(i)
    return out


# Names that invented pages give to their parts.
PARTS = {
    "main": "content article post entry main story body text page prose read blog entryContent postBody article-body field-body richtext markdown news document",
    "menu": "nav navbar menu topbar navigation breadcrumbs crumb toolbar pagination pager tabs links skip siteNav",
    "head": "header masthead site-header top banner brand logo byline",
    "notice": "cookie notice consent alert cookie-banner gdpr privacy modal popup overlay message",
    "ad": "ad ads advert advertisement banner promo promotion sponsor sponsored ad-slot adsense dfp teaser",
    "share": "share social related recommended tags tag-list buttons follow more readmore",
    "side": "sidebar side widget related aside rail column secondary popular trending",
    "talk": "comments comment discussion responses reader-comments comment-list replies reply disqus feedback thread guestbook reactions",
    "form": "signup search newsletter login subscribe form register contact",
    "foot": "footer legal copyright foot colophon bottom imprint",
}


def invent(rng: np.random.Generator) -> tuple[str, list[str]]:
    """(html, its main blocks): a page of some layout, in made-up words."""
    one = lambda *xs: xs[int(rng.integers(len(xs)))]
    odd = lambda p: rng.random() < p
    sounds = "an be co de el fi go hu in ja ku la mo ne or pa qui re sa ti un ve wo xi ys zé ñe ü".split()
    word = lambda: "".join(sounds[k] for k in rng.integers(len(sounds), size=int(rng.integers(1, 5))))

    def line(n):
        ws = [word() + (one(",", "") if odd(0.15) else one("!!", "***", "&amp;") if noisy else "") for _ in range(max(1, n))]
        return " ".join(ws).capitalize() + (one(".", ".", "?", "") if n > 3 else "")

    noisy = odd(0.1)
    para = lambda: " ".join(line(int(rng.integers(1, 18))) for _ in range(int(rng.integers(1, one(2, 5, 9)))))
    links = lambda n: "".join(f'<li><a href="/{word()}">{line(int(rng.integers(1, 4)))}</a></li>' for _ in range(n))
    attr = lambda *names: one("class", "id", "class") + f'="{one("", "", "js-", "site-", "c-", "main-", word() + " ")}{one(*names)}{one("", "-" + word(), " " + word(), one("-", "_") + one("inner", "wrap", "box", "area", "block", "container"))}"'
    of = lambda part: PARTS[part].split()
    blocks: list[str] = []

    def main(tag, text, end=True):
        blocks.append(" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", text) if "<br>" in text else re.sub(r"<[^>]+>", "", text)).split()))
        return f"<{tag}>{text}" + (f"</{tag}>" if end else "")

    def story():
        out = [main("h1", line(int(rng.integers(2, 12))))] if odd(0.9) else []
        for _ in range(int(rng.integers(1, one(3, 8, 16)))):
            k = rng.random()
            if k < 0.75:
                t = para()
                if odd(0.2):
                    t = f'{t} <a href="/{word()}">{line(2)}</a> {line(4)}'
                if odd(0.12):
                    t = f"<b>{t}<br>"
                out.append(main("p", t, odd(0.9)))
            elif k < 0.83:
                out.append(main(one("h2", "h3"), line(int(rng.integers(1, 7)))))
            elif k < 0.9:
                out.append("<ul>" + "".join(main("li", line(int(rng.integers(2, 14)))) for _ in range(int(rng.integers(2, 5)))) + "</ul>")
            elif k < 0.95:
                out.append(f"<blockquote>{main('p', para())}</blockquote>")
            else:
                out.append(main("div", para()))
        return "".join(out)

    def box(inner, *names, tags=("div", "section")):
        return f"<{(t := one(*tags))} {attr(*names)}>{inner}</{t}>"

    head = f"<!DOCTYPE html><html><head><title>{line(4)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>"
    top, tail = [], []
    if odd(0.85):
        top.append(f"<nav>{one('', line(1))}<ul>{links(int(rng.integers(3, 9)))}</ul></nav>" if odd(0.6) else box(f"<ul>{links(int(rng.integers(3, 9)))}</ul>", *of("menu")))
    if odd(0.4):
        top.append(f"<header>{one('h1', 'p', 'div').join(('<', '>'))}{line(3)}</header>" if odd(0.5) else box(f"<p>{line(5)}</p>", *of("head")))
    if odd(0.4):
        top.append(box(f"<p>{para()}</p>" if odd(0.5) else para(), *of("notice")))
    ads = lambda: box(one(para(), line(8), f"<p>{para()}</p>"), *of("ad"), tags=("div", "div", "aside"))
    if odd(0.6):
        top.append(ads())
    middle = story()
    if odd(0.2):
        middle += ads()
    if odd(0.15):
        middle += box(f"<ul>{links(3)}</ul>", *of("share"))
    middle = one(f"<article>{middle}</article>", f"<article {attr(*of('main'))}>{middle}</article>", f"<main>{middle}</main>", box(middle, *of("main")), f"<main><article>{middle}</article></main>", f"<div><div {attr(*of('main'))}>{middle}</div></div>", middle if odd(0.4) else f"<article>{middle}</article>")
    if odd(0.4):
        side = f"<h3>{line(2)}</h3>" + one(f"<ul>{links(5)}</ul>", f"<p>{para()}</p>", f"<p>{line(9)}</p><ul>{links(3)}</ul>")
        (top if odd(0.3) else tail).append(f"<aside>{side}</aside>" if odd(0.6) else box(side, *of("side")))
    if odd(0.4):
        said = "".join(one(f"<div {attr(*of('talk'))}><b>{word()}</b><p>{para()}</p></div>", f"<li><p>{para()}</p></li>", f"<p>{para()}</p>") for _ in range(int(rng.integers(1, 6))))
        tail.append(box(f"{one('', f'<h2>{line(1)}</h2>', f'<h3>{line(2)}</h3>')}{said}", *of("talk"), tags=("div", "section", "section")))
    if odd(0.35):
        (tail if odd(0.7) else top).append(f'<form {attr(*of("form"))}><p>{line(5)}</p><label>{line(2)}</label><input><button>{line(1)}</button></form>')
    if odd(0.3):
        tail.append(ads())
    foot = one(f"&copy; {word()} &middot; {line(7)}", f"<p>{para()}</p>", f"<ul>{links(4)}</ul><p>{line(6)}</p>")
    if odd(0.9):
        tail.append(f"<footer>{foot}</footer>" if odd(0.7) else box(foot, *of("foot")))
    page = head + "".join(top) + middle + "".join(tail) + "</body></html>"
    return page, [b for b in blocks if b]


class Model:
    """What attribute tokens say, and the trees; both fitted on invented pages."""

    def __init__(self, pages: int = PAGES, seed: int = SEED):
        rng, made = np.random.default_rng(seed), []
        count: dict[str, list[int]] = {}
        for _ in range(pages):
            source, blocks = invent(rng)
            page = Page(source)
            label, k = [0.0] * len(page.tag), 0
            for i, t in enumerate(page.text):
                if t is not None and k < len(blocks) and t == blocks[k]:
                    k += 1
                    while i >= 0 and not label[i]:
                        label[i] = 1.0
                        i = page.parent[i]
            made.append((page, label))
            for name, y in zip(page.name, label, strict=True):
                for t in tokens(name) if name else ():
                    c = count.setdefault(t, [0, 0])
                    c[int(y)] += 1
        self.odds = {t: float(np.log((yes + 0.5) / (no + 0.5))) for t, (no, yes) in count.items() if yes + no >= 4}
        rows = [r for page, _ in made for r in features(page, self.odds)]
        self.trees = Boosted(np.array(rows, np.float64), np.array([y for _, label in made for y in label]))


_MODELS: dict = {}


def model(pages: int = PAGES, seed: int = SEED) -> Model:
    if (pages, seed) not in _MODELS:
        _MODELS[pages, seed] = Model(pages, seed)
    return _MODELS[pages, seed]


def main_texts(m: Model, sources: list[str]) -> list[str]:
    pages = [Page(s) for s in sources]
    rows = [features(p, m.odds) for p in pages]
    p = m.trees.predict(np.array([r for own in rows for r in own], np.float64)) if rows else np.zeros(0)
    out, at = [], 0
    for page, own in zip(pages, rows, strict=True):
        out.append("\n".join(page.text[i] for i in decode(page, p[at : at + len(own)])))
        at += len(own)
    return out


def extract(pages: DataFrame, trees: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trees or model())  # a fixed number of small trees

    def each(batches):
        m = shared.value
        for b in batches:
            for s in range(0, b.num_rows, 64):
                part = b.slice(s, 64)
                text = main_texts(m, [h or "" for h in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(each, "page_id long, url string, text string, n_chars long")
