"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the hierarchy.

``parse`` turns a page into a tree of elements; ``node_features`` describes every element: tag, attribute tokens of its own
and of its ancestors (any token, hashed, with the odds it showed in training), text, link and tag density of its subtree, depth, place among its siblings. Boosted
trees give each element a score for "main text". ``decode`` then decides top down, by the best total: an element's subtree is
kept whole, dropped whole, or left to its children, so no choice contradicts one above or below it.

The trees are trained here, on pages composed from the texts of a bounded sample of the corpus (``sample_pages`` pages
by hash of page_id) in many layouts whose main text is known; every page is then scored in Arrow batches.

Defined cases: a null or empty page gives the empty text; unclosed, misnested and unknown tags, stray ``<`` and very deep
or long pages are read whole in time that grows with their length; where a quote stays open to the end of a page, quotes
in tags are not heeded from there on; formulas and drawings give their text; repeated rows are extracted alike; equal
scores keep an element; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_PLAIN_TAG = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>")
_CDATA = re.compile(r"<!\[CDATA\[.*?\]\]>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|hidden|style|type)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# Fixed values of HTML: elements without content, elements whose content is not text, elements that flow within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template iframe canvas textarea title select option".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var "
    "math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics svg g text tspan".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
HOLDS = frozenset("article aside body div footer form header html main nav section table td ul ol dl blockquote figure".split())
# What a start tag ends, and the elements that it does not look beyond; all other blocks end a paragraph.
ENDS = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "p": (("p",), tuple(HOLDS)),
}

# Names that training pages give to their parts; no feature knows them.
WORDS = {
    "main": "article content main post entry story body text prose page",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toc pagination pager links",
    "head": "header head masthead topbar top logo brand hero",
    "foot": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside rail widget widgets related recommended recommendations more popular trending complementary",
    "note": "notice cookie cookies consent banner alert popup modal gdpr dialog message newsletter subscribe signup overlay toast",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted outbrain taboola adbox adsense",
    "form": "form search login comment-form input register subscribe contact",
    "comment": "comment comments commentlist reply replies discussion disqus responses reader respond",
    "share": "share sharing social tags meta author byline buttons tools print follow",
    "hidden": "hidden none invisible sr only skip",
}
TAGS = {t: i for i, t in enumerate("html body main article section div p h1 h2 h3 h4 ul ol li a nav header footer aside form table td blockquote pre figure figcaption span b dl button label".split())}
TAG_KINDS = [("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "button", "label", "fieldset"), ("p", "blockquote", "pre", "h1", "h2", "h3", "h4"), ("li", "ul", "ol")]
HASHES = 1 << 13  # slots of attribute tokens


@dataclass
class Page:
    """Elements in page order, and the pieces of text between them: (element, text), element -1 for a block's end."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    pieces: list[tuple[int, str]] = field(default_factory=list)


def parse(html: str | None) -> Page:
    page = Page()
    tags, parent, depth, attributes, pieces = page.tag, page.parent, page.depth, page.attributes, page.pieces
    open_: list[int] = []
    where: dict[str, list[int]] = defaultdict(list)  # places in open_ by tag

    def enter(tag: str, attribute: str) -> None:
        up = open_[-1] if open_ else -1
        tags.append(tag)
        parent.append(up)
        depth.append(depth[up] + 1 if up >= 0 else 0)
        attributes.append(attribute)
        where[tag].append(len(open_))
        open_.append(len(tags) - 1)

    def leave(place: int) -> None:
        while len(open_) > place:
            where[tags[open_.pop()]].pop()

    def top(names: tuple[str, ...] | frozenset[str]) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    enter("html", "")
    html = html or ""
    last, last_cdata = html.rfind(">"), html.rfind("]]>")
    never: set[str] = set()  # opaque elements that nothing ends from here on
    at = start = 0
    in_head, quotes = False, True
    while True:
        at = html.find("<", at)
        if at < 0 or at > last:  # no tag ends from here on
            at = len(html)
        m = _CDATA.match(html, at) if at < last_cdata and html.startswith("<![CDATA[", at) else None
        if not m and at < len(html):
            if quotes or not html[at + 1].isalpha():
                m = _TAG.match(html, at)
            if not m and (m := _PLAIN_TAG.match(html, at)):
                quotes = False
                tag, rest, end = m.group(1).lower(), m.group(2), None
            elif not m:
                at += 1  # a stray sign
                continue
            else:
                tag, rest, end = (m.group(2) or "").lower(), m.group(3) or "", m.group(1)
        elif m:
            tag, rest, end = "", "", None
        if at > start and not in_head:
            pieces.append((open_[-1], html[start:at]))
        if at >= len(html):
            break
        at = start = m.end()
        if end:
            end = end.lower()
            if end == "head":
                in_head = False
            elif end not in ("html", "body"):
                place = where[end][-1] if where.get(end) else -1
                if place > 0 and (end not in INLINE or place > top(HOLDS)):
                    leave(place)
                if end not in INLINE:
                    pieces.append((-1, ""))
        elif tag:
            if tag in OPAQUE:
                if not rest.rstrip().endswith("/") and tag not in never:
                    stop = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
                    ended = html.find(">", stop.end()) if stop else -1
                    if ended >= 0:
                        at = start = ended + 1
                    else:
                        never.add(tag)
                        if tag in ("script", "style", "textarea", "title"):
                            at = start = len(html)
                continue
            if tag == "head":
                in_head = True
                continue
            if tag in VOID:
                if tag in ("br", "hr", "img", "input"):
                    pieces.append((-1, ""))
                continue
            if tag == "html":
                continue
            in_head = in_head and tag not in CLOSES_P and tag != "body"
            if tag == "body":
                if len(tags) == 1:
                    enter("body", rest)
                continue
            if tag in CLOSES_P or tag in ENDS:
                ended, beyond = ENDS.get(tag, ENDS["p"])
                place = top(ended)
                if place > max(0, top(beyond)):
                    leave(place)
            if tag not in INLINE:
                pieces.append((-1, ""))
            if not rest.endswith("/") or tag in HOLDS:
                enter(tag, rest)
    return page


def _slot(token: str) -> int:
    return zlib.crc32(token.encode()) % HASHES


def _token_slots(attribute: str) -> tuple[int, ...]:
    """The slots of all tokens in the attributes."""
    found: set[int] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attribute):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            found.add(_slot("hidden"))
        if name not in ("style", "type"):
            found.update(_slot(w.lower()) for w in _PART.findall(value))
    return tuple(found)


_slots_of: dict[str, tuple[int, ...]] = {"": ()}
_KIND = {name: 1 << j for j, names in enumerate(TAG_KINDS) for name in names}


def node_features(page: Page) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of numbers for every element of a page, and its attribute tokens as (elements, slots)."""
    n = len(page.tag)
    parent, tag = page.parent, page.tag
    own, link, stops, first = [0.0] * n, [0.0] * n, [0.0] * n, [-1.0] * n
    at = 0
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tag[i] == "a" or in_link[parent[i]]
    for node, text in page.pieces:
        if node >= 0:
            size = len(text.strip())
            if size:
                own[node] += size
                stops[node] += text.count(".") + text.count(",")
                if in_link[node]:
                    link[node] += size
                if first[node] < 0:
                    first[node] = at
                at += size
    below, links, marks = own[:], link[:], stops[:]
    count, paragraphs = [1.0] * n, [float(t == "p") for t in tag]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        below[p] += below[i]
        links[p] += links[i]
        marks[p] += marks[i]
        count[p] += count[i]
        paragraphs[p] += paragraphs[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    children, nth = [0] * n, [0] * n
    same: dict[tuple[int, str], int] = defaultdict(int)
    mine, above = [_KIND.get(t, 0) for t in tag], [0] * n
    token_row, token_slot = [], []
    for i in range(n):
        a, p = page.attributes[i], parent[i]
        got = _slots_of.get(a)
        if got is None:
            if len(_slots_of) > 50_000:
                _slots_of.clear()
            got = _slots_of[a] = _token_slots(a)
        token_row += [i] * len(got)
        token_slot += got
        if p >= 0:
            above[i] = above[p] | mine[p]
            nth[i] = children[p]
            children[p] += 1
            same[p, tag[i]] += 1
    alike = [same.get((p, t), 0) for p, t in zip(parent, tag)]
    own, below, links, marks, count, paragraphs, first = (np.array(x) for x in (own, below, links, marks, count, paragraphs, first))
    total = max(1.0, below[0])
    up = np.maximum(0, np.array(parent))
    kind = np.array([TAGS.get(x, -1) for x in tag], float)
    numbers = [
        kind, np.minimum(page.depth, 30), np.log1p(own), np.log1p(below), below / total,
        links / np.maximum(1, below), marks / np.maximum(1, below), below / count, paragraphs, np.log1p(nth), np.log1p(alike), np.maximum(first, 0) / total,
        below / np.maximum(1, below[up]), np.log1p(below[up]), links[up] / np.maximum(1, below[up]), paragraphs[up],
        kind[up], own / np.maximum(1, below),
    ]
    kinds = np.unpackbits(np.array([mine, above], np.uint8).T, axis=1)
    return np.hstack([np.stack(numbers, 1), kinds]), np.array(token_row, np.int64), np.array(token_slot, np.int64)


def token_features(page: Page, row: np.ndarray, slot: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The least and the largest odds of the tokens of every element, and of those above it."""
    low, high = np.zeros(len(page.tag)), np.zeros(len(page.tag))
    np.minimum.at(low, row, odds[slot])
    np.maximum.at(high, row, odds[slot])
    low_of, high_of = low.tolist(), high.tolist()
    least, most = [0.0] * len(low_of), [0.0] * len(low_of)
    for i, p in enumerate(page.parent):
        if p >= 0:
            least[i], most[i] = min(least[p], low_of[p]), max(most[p], high_of[p])
    return np.stack([low, high, least, most], 1)


# --- boosted trees -----------------------------------------------------------------------------------
@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of each inner node, value of each leaf; odds of token slots."""

    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float
    odds: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, th, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > th[node])
            z += v[node - (len(v) - 1)]
        return z

    def score_pages(self, pages: list[Page]) -> np.ndarray:
        x = []
        for p in pages:
            numbers, row, slot = node_features(p)
            x.append(np.hstack([numbers, token_features(p, row, slot, self.odds)]))
        return self.score(np.concatenate(x))


def token_odds(slots: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """By slot, how the odds of "main text" change where a token stands (smoothed; 0 for tokens never seen)."""
    yes, no = np.bincount(slots, y, HASHES), np.bincount(slots, 1 - y, HASHES)
    return np.log((yes + 2 * prior) / (no + 2 * (1 - prior))) - np.log(prior / (1 - prior))


def boost(x: np.ndarray, y: np.ndarray, odds: np.ndarray, rounds: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 32) -> Trees:
    """Gradient boosting for the logistic loss, with histograms over quantile bins."""
    n, d = x.shape
    edge = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edge)], 1)
    start = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    z = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, th = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, width = (1 << level) - 1, 1 << level
            best = np.full(width, 1e-3)
            G, H = (np.bincount(node - base, w, width)[:, None] for w in (g, h))
            for j in range(d):
                size = len(edge[j]) + 1
                if size < 2:
                    continue
                cell = (node - base) * size + code[:, j]
                gs, hs = (np.cumsum(np.bincount(cell, w, width * size).reshape(width, size), 1)[:, :-1] for w in (g, h))
                gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                cut = gain.argmax(1)
                top = gain[np.arange(width), cut]
                better = top > best
                best[better] = top[better]
                f[base : base + width][better] = j
                th[base : base + width][better] = edge[j][cut[better]]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > th[node])
        leaf = node - ((1 << depth) - 1)
        v = -rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + 1)
        z += v[leaf]
        features.append(f)
        thresholds.append(th)
        values.append(v)
    return Trees(depth, np.array(features), np.array(thresholds), np.array(values), start, odds)


# --- decoding ------------------------------------------------------------------------------------------
SPLIT_COST = 0.5


def decode(page: Page, score: np.ndarray) -> np.ndarray:
    """Which elements' own text is kept: the best choice of keep all, drop all or split, for every subtree."""
    n = len(page.tag)
    weight = np.zeros(n)
    for node, text in page.pieces:
        if node >= 0:
            weight[node] += len(text.strip())
    weight = np.log1p(weight)
    s = np.clip(score, -6, 6)
    keep = weight * s
    child = np.zeros(n)  # best totals of the children
    for i in range(n - 1, 0, -1):
        own = keep[i] - weight[i] * s[i]
        bare = abs(weight[i] * s[i])
        best = max(keep[i], -keep[i], child[i] + bare - SPLIT_COST)
        child[page.parent[i]] += best
        keep[page.parent[i]] += own + weight[i] * s[i]
    out = np.zeros(n, bool)
    state: list[int] = [0] * n  # 1 keep, -1 drop, 0 split
    for i in range(n):
        up = state[page.parent[i]] if i else 0
        if up:
            state[i] = up
        else:
            options = (keep[i], -keep[i], child[i] + abs(weight[i] * s[i]) - SPLIT_COST)
            k = int(np.argmax(options))
            state[i] = (1, -1, 0)[k]
        out[i] = state[i] > 0 or (state[i] == 0 and s[i] > 0)
    return out


def text_of(page: Page, kept: np.ndarray) -> str:
    blocks, now = [], []
    for node, text in page.pieces:
        if node < 0:
            if now:
                blocks.append("".join(now))
                now = []
        elif kept[node]:
            now.append(text)
    if now:
        blocks.append("".join(now))
    whole = (" ".join(unescape(b).split()) for b in blocks)  # a block may turn out blank once decoded
    return " ".join(b for b in whole if b)


# --- training pages --------------------------------------------------------------------------------------
def compose(rng: random.Random, texts: list[str]) -> str:
    """A page in a random layout; elements of the main text carry the attribute ``keep``, which no feature sees."""

    def say(low: int, high: int) -> str:
        words = rng.choice(texts).split() or ["word"]
        k = rng.randint(low, high)
        i = rng.randrange(max(1, len(words) - k))
        return " ".join(words[i : i + k])

    def link(k: int) -> str:
        return f'<a href="/{rng.randrange(999)}">{say(1, k)}</a>'

    def list_of(n: int, k: int) -> str:
        return "<ul>" + "".join(f"<li>{link(k)}</li>" for _ in range(n)) + "</ul>"

    def named(group: str) -> str:
        w = rng.choice(WORDS[group].split())
        return rng.choice([f'class="{w}"', f'id="{w}"', f'class="{w} x{rng.randrange(9)}"', f'class="site-{w}"', f'class="{w}-box"', ""])

    def boiler(kind: str) -> str:
        if kind == "menu":
            return rng.choice([f"<nav>{list_of(rng.randint(2, 9), 3)}</nav>", f"<div {named('menu') or 'class=menu'}>{list_of(rng.randint(3, 9), 3)}</div>", f"<nav>{' '.join(link(2) for _ in range(4))}</nav>"])
        if kind == "advert":
            tag = rng.choice(["div", "section", "aside", "p"])
            return f"<{tag} class=\"{rng.choice(WORDS['advert'].split())}\">{say(2, 40)}</{tag}>"
        if kind == "head":
            return rng.choice([f"<header><h1>{say(1, 4)}</h1>{list_of(3, 2)}</header>", f"<header {named('head')}><p>{say(2, 12)}</p></header>", f"<div class=\"{rng.choice(['header', 'masthead', 'topbar'])}\">{say(1, 8)}</div>"])
        if kind == "foot":
            return rng.choice([f"<footer>&copy; {say(1, 12)} &middot; {link(2)}</footer>", f"<footer {named('foot')}><p>{say(3, 30)}</p>{list_of(3, 2)}</footer>", f"<div class=\"{rng.choice(['footer', 'copyright', 'legal'])}\">{say(2, 20)}</div>"])
        if kind == "side":
            return rng.choice([f"<aside><h3>{say(1, 3)}</h3>{list_of(4, 6)}</aside>", f"<aside {named('side')}><p>{say(5, 40)}</p></aside>", f"<div class=\"{rng.choice(WORDS['side'].split())}\"><h4>{say(1, 3)}</h4>{list_of(4, 8)}<p>{say(3, 25)}</p></div>"])
        if kind == "note":
            return f"<div class=\"{rng.choice(WORDS['note'].split())}\"><p>{say(4, 30)}</p><button>{say(1, 2)}</button></div>"
        if kind == "form":
            return rng.choice([f"<form><label>{say(1, 4)}</label><input type=text><button>{say(1, 2)}</button></form>", f"<form {named('form')}><p>{say(3, 14)}</p><input></form>"])
        if kind == "comment":
            word = rng.choice(WORDS["comment"].split())
            one = rng.choice(["div", "li", "article"])
            body = "".join(f"<{one} class=\"{rng.choice(['comment', 'reply', word])}\"><b>{say(1, 2)}</b><p>{say(5, 60)}</p></{one}>" for _ in range(rng.randint(1, 5)))
            return f"<{rng.choice(['section', 'div'])} {rng.choice(['class', 'id'])}=\"{word}\"><h2>{say(1, 2)}</h2>{body}".replace("<section", "<div") + "</div>"
        return f"<div class=\"{rng.choice(WORDS['share'].split())}\">{link(2)} {link(2)}</div>"

    kinds = ["menu", "advert", "head", "foot", "side", "note", "form", "comment", "share"]

    def noise() -> str:
        """A name that says nothing, on some elements."""
        return f' class="{"".join(rng.choices("bcdfghklmnprstvwz", k=5))}"' if rng.random() < 0.25 else ""

    def linked_list() -> str:
        """A list that belongs to the text: links with words around them, or links alone under a sentence."""
        tag, bare = rng.choice(["ul", "ol"]), rng.random() < 0.3
        items = "".join(f'<li keep><a keep href="/{rng.randrange(999)}">{say(1, 6)}</a> {"" if bare else say(1, 14)}' + rng.choice(["</li>", "</li>", ""]) for _ in range(rng.randint(2, 14)))
        return (f"<p keep>{say(4, 30)}</p>" if bare or rng.random() < 0.4 else "") + f"<{tag} keep>{items}</{tag}>"

    def lines() -> str:
        """Text without paragraphs: parts between line ends, some with a title in bold."""
        title = f"<{(t := rng.choice(['b', 'strong', 'font']))} keep>{say(1, 8)}</{t}><br><br>" if rng.random() < 0.6 else ""
        return title + "<br><br>".join(say(8, 70) for _ in range(rng.randint(1, 6)))

    def main_block() -> str:
        r = rng.random()
        if rng.random() < 0.12:
            return linked_list()
        if rng.random() < 0.06:
            return f"<div keep{noise()}>{lines()}</div>"
        if rng.random() < 0.05:
            rows = "".join("<tr keep>" + "".join(f"<td keep>{say(1, 12)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 6)))
            return f"<table keep>{rows}</table>"
        if r < 0.08:
            return f"<h2 keep{noise()}>{say(1, 8)}</h2>"
        if r < 0.14:
            return "<ul keep>" + "".join(f"<li keep>{say(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if r < 0.18:
            return f"<blockquote keep><p keep>{say(5, 40)}</p></blockquote>"
        if r < 0.24:
            return f"<p keep><b keep>{say(2, 20)}<br>"
        if r < 0.30:
            return f'<p keep>{say(3, 30)} <a keep href="/x">{say(1, 4)}</a> {say(3, 30)}</p>'
        if r < 0.34:
            return f"<{(t := rng.choice(['div', 'section']))} keep{noise()}>{say(5, 60)}</{t}>"
        if r < 0.37:
            return f"<pre keep>{say(3, 20)}</pre>"
        if r < 0.40:
            return f"<table keep><tr keep><td keep>{say(1, 6)}</td><td keep>{say(1, 6)}</td></tr></table>"
        return f"<p keep{noise()}>{say(1, 90)}</p>"

    blocks = [f"<h1 keep>{say(2, 12)}</h1>"] if rng.random() < 0.85 else []
    blocks += [main_block() for _ in range(rng.choice([1, 2, 3, 5, 8, 14, 25]))]
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):  # boilerplate within the article
        blocks.insert(rng.randint(1, len(blocks)), boiler(rng.choice(["advert", "share", "side", "note", "form", "comment"])))
    frame = rng.choice(['<article keep>%s</article>'] * 4 + ['<main keep>%s</main>', '<main keep><article keep>%s</article></main>', '<div keep class="content">%s</div>', '<div keep id="main">%s</div>',
                        '<div keep class="post-body">%s</div>', '<div keep>%s</div>', '<div keep><div keep class="entry">%s</div></div>', '<section keep>%s</section>'])
    shape = rng.random()
    if shape < 0.06:  # little text and nothing else
        few = "".join(rng.choice([f"<p keep>{say(1, 3)}</p>", f"<div keep>{say(1, 4)}</div>", f"<h1 keep>{say(1, 3)}</h1>", f"<p keep>{say(1, 20)}</p>"]) for _ in range(rng.randint(1, 2)))
        return f"<html><body>{few}</body></html>"
    if shape < 0.16:  # the text stands in the body itself
        inner = lines() if rng.random() < 0.5 else "".join(blocks)
        around = rng.choice([("", ""), (boiler("menu"), boiler("foot")), (boiler("head"), ""), ("", boiler("foot"))])
        return f"<html><head><title>{say(1, 5)}</title></head><body keep>{around[0]}{inner}{around[1]}</body></html>"
    if shape < 0.28:  # a table holds the layout
        text = lines() if rng.random() < 0.4 else "".join(blocks)
        menu = rng.choice(["<br>", "<p>", " | "]).join(link(2) for _ in range(rng.randint(3, 8)))
        cells = [f"<td{rng.choice(['', ' class=left', ' width=120', ' valign=top'])}>{menu}</td>", f"<td keep{rng.choice(['', ' valign=top', ' width=600'])}>{text}</td>"]
        if rng.random() < 0.3:
            cells.append(f"<td>{list_of(4, 3)}</td>")
        top = f"<tr><td colspan=2>{rng.choice([link(3), say(1, 5), '<img src=x>' + say(1, 4)])}</td></tr>" if rng.random() < 0.5 else ""
        low = f"<tr><td colspan=2>{rng.choice(['<font size=1>%s</font>', '<small>%s</small>', '<center>%s</center>', '%s']) % rng.choice(['Copyright ', '&copy; ', ''])}{say(2, 8)}</td></tr>".replace("</font>", "").replace("</small>", "").replace("</center>", "") if rng.random() < 0.8 else ""
        return f"<html><head><title>{say(1, 5)}</title></head><body><table>{top}<tr>{''.join(cells)}</tr>{low}</table></body></html>"
    before = [boiler(rng.choice(kinds)) for _ in range(rng.randint(0, 3))]
    after = [boiler(rng.choice(kinds)) for _ in range(rng.randint(0, 3))]
    if rng.random() < 0.7:
        before.insert(0, boiler("menu"))
    if rng.random() < 0.7:
        after.append(boiler("foot"))
    inner = "".join(before) + frame % "".join(blocks) + "".join(after)
    if rng.random() < 0.4:
        inner = f"<div class=\"{rng.choice(['wrap', 'container', 'page', 'site', 'layout'])}\">{inner}</div>"
    return f"<html><head><title>{say(1, 5)}</title></head><body>{inner}</body></html>"


def fit(texts: list[str], n_pages: int = 600, seed: int = 11) -> Trees:
    """Trees for the elements that hold text. Each half of the pages is described by the token odds of the other half, so
    that no element tells of its own label; the odds of all pages go with the trees."""
    rng = random.Random(seed)
    texts = [t for t in texts if t.split()] or ["some words of a text that stands for all others"]
    pages = [parse(compose(rng, texts)) for _ in range(n_pages)]
    known = []
    for page in pages:
        numbers, row, slot = node_features(page)
        y = np.array([bool(re.search(r"(^|\s)keep(\s|$)", a)) for a in page.attributes], float)
        held = np.zeros(len(page.tag))
        np.add.at(held, [i for i, t in page.pieces if i >= 0 and t.strip()], 1)
        use = (numbers[:, 3] > 0) & np.array([t != "html" and (t != "body" or n > 0) for t, n in zip(page.tag, held)])
        known.append((numbers, row, slot, y, use))
    prior = float(np.concatenate([y[use] for *_, y, use in known]).mean())

    def odds_of(part: list) -> np.ndarray:
        slots = [slot[use[row]] for _, row, slot, _, use in part]
        return token_odds(np.concatenate(slots), np.concatenate([y[row][use[row]] for _, row, _, y, use in part]), prior)

    halves = odds_of(known[1::2]), odds_of(known[::2])
    x = [np.hstack([numbers, token_features(pages[i], row, slot, halves[i % 2])])[use] for i, (numbers, row, slot, _, use) in enumerate(known)]
    return boost(np.concatenate(x), np.concatenate([y[use] for *_, y, use in known]), odds_of(known))


def plain_text(html: str | None) -> str:
    """All text of a page, for composing training pages."""
    page = parse(html)
    return text_of(page, np.ones(len(page.tag), bool))


def _plain_batches(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([plain_text(h) for h in b.column("html").to_pylist()], pa.string())], names=["text"])


def train(pages: DataFrame, sample_pages: int = 150) -> Trees:
    """Trees trained on pages composed from the texts of at most ``sample_pages`` pages (by hash of page_id)."""
    few = pages.where("html is not null").select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    few = few.mapInArrow(_plain_batches, "text string").collect()
    return fit(sorted(r.text for r in few))


def extract_batch(html: list[str | None], trees: Trees) -> list[str]:
    """The main texts of many pages; their elements are scored together."""
    out: list[str] = []
    i = 0
    while i < len(html):
        group, size = [], 0
        while i < len(html) and size < 2_000_000:
            group.append(parse(html[i]))
            size += len(html[i] or "")
            i += 1
        score = trees.score_pages(group)
        at = 0
        for p in group:
            out.append(text_of(p, decode(p, score[at : at + len(p.tag)])))
            at += len(p.tag)
    return out


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages(page_id, url, html)``."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in batches:
            text = extract_batch(b.column("html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
