"""Main-text extraction with a tree-structured graphical model.

A page is read into a tree of block elements whose leaves are text blocks.  Every node is content or
not; a node's own potential comes from its tag, the words of its class and id, its role and, for
leaves, its length and links, and that of the root from whether any element is named as the article's;
parent-child potentials connect neighbours.  Sum-product messages go
upward and downward, and a text block is kept if its content marginal is at least one half.

The weights are trained on labelled pages by maximum likelihood, whose gradient comes from the same
messages.  ``labelled_pages`` makes such pages: layouts of many kinds in which ``data-y`` marks content.

Head, script, style and other elements that show no text are dropped while reading.  Inside a block
white space becomes one space; blocks are joined by a line feed.

Null pages are empty, with an empty text; repeated rows give repeated results; an empty table gives
none.  A kept column named like a result gives way to it; a page of any length is read in linear time.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pathloom.llm.common import arrow_schema, kept

#: A whole tag; quotes count only after an equals sign.  Nothing in it backtracks.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+)>""")
#: What stands for a tag once one has run to the page's end unclosed.
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)([^<>]*+)>?")
_COMMENT = re.compile(r"<!--(?:-?>|.*?--!?>)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_CLOSED = re.compile(r"""(?:^|[\s"'])/\Z""")
_NAME = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Elements whose insides show no text.
SILENT = frozenset("script style template iframe svg head title textarea select datalist noembed noframes".split())
#: Those of them whose insides are characters, not tags, up to their own end tag; it is their last one in the second set if there is no end tag.
RAW = frozenset("script style iframe title textarea noembed noframes".split())
RUNS_ON = frozenset(["script", "style"])
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: What can stand in a head; any other opening tag ends it.
HEAD = frozenset("head html base basefont bgsound link meta noscript script style template title".split())
BLOCKS = frozenset("html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption form fieldset legend address details summary dialog hgroup menu search center button label".split())
#: Elements that an opening tag ends, if they are open above it.
CLOSES = {t: frozenset(["p"]) for t in BLOCKS - {"button", "label"}} | {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"])}
#: Elements that hide open ones from such ends.
SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"])}

TAGS = [["nav", "menu", "search"], ["header"], ["footer"], ["aside"], ["form", "fieldset", "button", "label", "legend", "dialog"], ["article"], ["main"], ["section"], ["div", "center"], ["p"], ["h1"], ["h2", "h3", "h4", "h5", "h6", "hgroup"], ["ul", "ol", "dl"], ["li", "dt", "dd"], ["table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"], ["blockquote", "pre"], ["figure", "figcaption"], ["address"], ["details", "summary"], ["html", "body"]]
NAMES = [
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner dfp taboola outbrain".split(),
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip topbar".split(),
    "header masthead head logo branding brand".split(),
    "footer foot copyright legal colophon imprint".split(),
    "sidebar side aside widget rail related recommended recommendations trending popular more teaser".split(),
    "comment comments reply replies respond disqus discussion feedback thread responses".split(),
    "cookie cookies consent gdpr notice notification alert popup modal overlay privacy announcement disclaimer warning toast message".split(),
    "newsletter subscribe subscription signup login form search contact register".split(),
    "share sharing social follow tags tools toolbar print byline meta author".split(),
    "content article post entry story text body main prose maincontent articlebody".split(),
]
_TAG_OF = {t: k for k, group in enumerate(TAGS) for t in group}
_NAME_OF = {w: k for k, group in enumerate(NAMES) for w in group}
_LEAF = len(TAGS) + len(NAMES) + 3
LENGTHS = (20, 60, 150, 400)
#: Bias, tags, names, other tag, role, hidden, then leaves: is one, lengths, link share; last, of the root: no element holds the article by its tag or names alone.
FEATURES = 1 + _LEAF + 1 + len(LENGTHS) + 1 + 3 + 1
_HOLDERS = frozenset(k for k in range(len(TAGS)) if TAGS[k][0] in ("article", "main")) | {len(TAGS) + len(NAMES) - 1}
_OTHERS = frozenset(range(len(TAGS), len(TAGS) + len(NAMES) - 1)) | frozenset(range(len(TAGS) + len(NAMES) + 1, _LEAF)) | frozenset(k for k in range(len(TAGS)) if TAGS[k][0] in ("nav", "header", "footer", "aside", "form"))


def holds(features: tuple[int, ...]) -> bool:
    """Whether an element's tag or names say that it is the article's, and nothing else."""
    kinds = {f - 1 for f in features}
    return not kinds.isdisjoint(_HOLDERS) and kinds.isdisjoint(_OTHERS)


@lru_cache(maxsize=20_000)
def element_features(tag: str, attributes: str) -> tuple[tuple[int, ...], str | None]:
    """Feature numbers of an element, and its label if it has one."""
    out, label = [0, 1 + _TAG_OF.get(tag, len(TAGS) + len(NAMES))], None
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            found = {_NAME_OF[w] for w in _NAME.findall(_HUMP.sub(" ", value).lower()) if w in _NAME_OF}
            out += [1 + len(TAGS) + k for k in found]
        elif name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form"):
            out.append(1 + len(TAGS) + len(NAMES) + 1)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            out.append(1 + len(TAGS) + len(NAMES) + 2)
        elif name == "data-y":
            label = value
    return tuple(dict.fromkeys(out)), label


def leaf_features(text: str, linked: int) -> tuple[int, ...]:
    n, start = len(text), 1 + _LEAF
    share = linked / max(n, 1)
    return (0, start, start + 1 + sum(n >= x for x in LENGTHS), start + 2 + len(LENGTHS) + (0 if share < 0.1 else 1 if share < 0.6 else 2))


def tokens(html: str):
    """(start, end, tag, closing, attributes) of every tag, comment (tag empty) and raw element's insides (tag empty), in linear time.

    As in browsers, insides of raw elements reach to their own end tag, whatever stands in them, and
    quotes count only around attribute values; a quote that isn't closed is part of a name.  Once a tag
    runs to the page's end unclosed, tags end at the next < or >, so that none is scanned twice.
    """
    at, trusted, unclosed, size = 0, True, set(), len(html)
    more_ends = more_comments = True
    while (at := html.find("<", at)) >= 0:
        mark = html[at + 1 : at + 2]
        if mark in ("!", "?") or (mark == "/" and not html[at + 2 : at + 3].isalpha()):
            if html.startswith("<!--", at) and more_comments:
                m = _COMMENT.match(html, at)
                more_comments = m is not None
                end = m.end() if m else size
            else:
                end = html.find(">", at) + 1 if more_ends else 0
                more_ends = end > 0
            if end:
                yield at, end, "", False, ""
            at = end or at + 1
            continue
        m = _TAG.match(html, at) if trusted else _BARE.match(html, at)
        if m is None and trusted and mark.isascii() and (mark.isalpha() or mark == "/"):
            trusted, m = False, _BARE.match(html, at)
        if m is None:
            at += 1
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        yield at, m.end(), tag, closing, attributes
        at = m.end()
        if tag in RAW and not closing and not _CLOSED.search(attributes) and tag not in unclosed:
            end = _END[tag].search(html, at)
            if end is None:
                unclosed.add(tag)
            if end or tag in RUNS_ON:
                stop = end.start() if end else size
                yield at, stop, "", False, ""
                at = stop


class Tree:
    """Nodes in page order (a parent before its children): parents, features, labels; leaves: node and text."""

    __slots__ = ("parent", "features", "label", "leaves")

    def __init__(self, html: str) -> None:
        self.parent, self.features, self.label, self.leaves = [-1], [(0,)], [None], []
        stack: list[tuple[str, int]] = [("", 0)]
        places: dict[str, list[int]] = {}  # where in the stack a tag is open
        parts: list[str] = []
        links = linked = at = 0
        silent, depth, foreign = "", 0, False

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                parts.clear()
                if text:
                    self._add(stack[-1][1], leaf_features(text, linked), None)
                    self.leaves.append((len(self.parent) - 1, text))
            linked = 0

        def cut(k: int) -> None:
            for name, _ in stack[k:]:
                places[name].pop()
            del stack[k:]

        for start, end, tag, closing, attributes in tokens(html):
            if start > at and not silent:
                parts.append(html[at:start])
                if links:
                    linked += start - at
            at = end
            if not tag:
                continue
            if silent:
                if tag == silent:
                    depth += -1 if closing else 1
                    if not depth:
                        silent = ""
                    continue
                if silent == "svg":
                    foreign = foreign or tag == "foreignobject"
                    if closing or foreign or tag not in BLOCKS:
                        continue
                elif silent == "head":
                    if closing or tag in HEAD or tag in SILENT:
                        continue
                elif silent == "template" or closing or tag not in BLOCKS:
                    continue
                silent = ""  # an element that can't stand in there: the silent one was left open
            if tag in SILENT:
                if not closing and not _CLOSED.search(attributes) and (tag not in RAW or html.startswith("</", at)):
                    silent, depth, foreign = tag, 1, False
                continue
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            if tag not in BLOCKS:
                continue
            flush()
            if closing:
                if places.get(tag):
                    cut(places[tag][-1])
                    links = 0
                continue
            if tag in SCOPES:
                border = max((places[t][-1] for t in SCOPES[tag] if places.get(t)), default=0)
                open_ = [places[t][i] for t in CLOSES[tag] if places.get(t) and (i := bisect_right(places[t], border)) < len(places[t])]
                if open_:
                    cut(min(open_))
            elif stack[-1][0] in CLOSES.get(tag, ()):
                cut(len(stack) - 1)
            features, label = element_features(tag, attributes) if len(attributes) < 500 else element_features.__wrapped__(tag, attributes)
            self._add(stack[-1][1], features, label)
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, len(self.parent) - 1))
        if not silent:
            parts.append(html[at:])
        flush()
        held = any(map(holds, set(self.features)))
        self.features[0] = (0,) if held else (0, FEATURES - 1)
        self.label[0] = "0" if held else "1"
        for k in range(1, len(self.parent)):
            if self.label[k] is None:
                self.label[k] = self.label[self.parent[k]]

    def _add(self, parent: int, features: tuple[int, ...], label: str | None) -> None:
        self.parent.append(parent)
        self.features.append(features)
        self.label.append(label)


class Forest:
    """Several trees as arrays, ordered by depth for the messages."""

    def __init__(self, trees: list[Tree]) -> None:
        sizes = [len(t.parent) for t in trees]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + s) for t, s in zip(trees, self.start, strict=False)])
        lengths = [len(f) for t in trees for f in t.features]
        self.node = np.repeat(np.arange(len(lengths)), lengths)
        self.feature = np.array([x for t in trees for f in t.features for x in f], np.int64)
        depth = np.zeros(len(self.parent), np.int64)
        level = np.flatnonzero(self.parent < 0)
        children_of = np.argsort(self.parent, kind="stable")
        sorted_parents = self.parent[children_of]
        self.levels = [level]
        while True:
            low, high = np.searchsorted(sorted_parents, level, "left"), np.searchsorted(sorted_parents, level, "right")
            n = high - low
            if not n.sum():
                break
            level = children_of[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            self.levels.append(level)
        del depth

    def marginals(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent's state, state) of each node but the roots (n x 2 x 2)."""
        own = np.bincount(self.node, weights=weights[self.feature], minlength=len(self.parent))
        up = np.stack([np.zeros(len(own)), own], 1)  # log belief from below, by state
        sent = np.zeros((len(own), 2))  # message to the parent, by the parent's state
        for level in self.levels[:0:-1]:
            joint = pair[None] + up[level][:, None, :]
            sent[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            np.add.at(up, self.parent[level], sent[level])
        full = up.copy()  # belief with everything
        both = np.zeros((len(own), 2, 2))
        for level in self.levels[1:]:
            rest = full[self.parent[level]] - sent[level]  # parent's belief without this child
            joint = rest[:, :, None] + pair[None] + up[level][:, None, :]
            full[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            total = np.logaddexp(full[level][:, 0], full[level][:, 1])
            both[level] = np.exp(joint - total[:, None, None])
        p = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500)))
        return p, both


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    """Pages of many layouts; data-y="1" opens content and data-y="0" what isn't content."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(1, 9)))
    text = lambda low, high: " ".join(word() for _ in range(r.randint(low, high)))
    links = lambda k: "".join(f'<li><a href="#">{text(1, 3)}</a></li>' for _ in range(k))

    named = lambda k: r.choice(NAMES[k])
    comment = lambda: f"<p>{text(3, 50)}</p>"

    def block() -> str:
        x = r.random()
        if x < 0.6:
            return f"<p>{text(1, r.choice((2, 6, 40, 120)))}.</p>"
        if x < 0.68:
            return f"<h2>{text(1, 6)}</h2>"
        if x < 0.75:
            return "<ul>" + "".join(f"<li>{text(2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if x < 0.8:
            return f"<blockquote><p>{text(5, 40)}</p></blockquote>"
        if x < 0.84:
            return f"<pre>{text(3, 20)}</pre>"
        if x < 0.88:
            return "<table>" + "".join(f"<tr><td>{text(1, 4)}</td><td>{text(1, 4)}</td></tr>" for _ in range(3)) + "</table>"
        if x < 0.92:
            return f"<p><a href='#'>{text(2, 8)}</a> {text(5, 40)}</p>"
        if x < 0.95:
            return f"<figure><figcaption>{text(3, 12)}</figcaption></figure>"
        return text(4, 30)

    def body() -> str:
        out = [f"<h1>{text(1, 10)}</h1>"] if r.random() < 0.6 else []
        for _ in range(r.choice((1, 1, 2, 3, 5, 8))):
            out.append(block())
            if r.random() < 0.12:
                tag = r.choice(("section", "div", "div", f"div class='{word()}'"))
                out.append(f"<{tag}>{''.join(block() for _ in range(r.randint(1, 3)))}</{tag.split()[0]}>")
        return "".join(out)

    def junk() -> str:
        long = f"<p>{text(3, 60)}</p>"
        kind = r.choice((0, 0, 1, 2, 3, 4, 5, 5, 6, 6, 7, 8, 9, 9))
        if kind == 0:
            tag, inner = r.choice(("div", "div", "aside", "section", "p")), r.choice((text(1, 40), long, f"<a href='#'>{text(2, 9)}</a>", f"<h3>{text(1, 5)}</h3>{long}"))
        elif kind == 1:
            tag, inner = r.choice(("nav", "nav", "div", "ul")), r.choice((f"<ul>{links(r.randint(1, 8))}</ul>", " | ".join(f"<a href='#'>{text(1, 2)}</a>" for _ in range(r.randint(2, 6))), text(1, 8)))
        elif kind == 2:
            tag, inner = r.choice(("header", "header", "div")), r.choice(("", f"<h1>{text(1, 4)}</h1>", f"<h1><a href='#'>{text(1, 4)}</a></h1>", f"<h2>{text(1, 5)}</h2>")) + r.choice((text(1, 6), long, f"<nav><ul>{links(4)}</ul></nav>"))
        elif kind == 3:
            tag, inner = r.choice(("footer", "footer", "div")), f"© {text(1, 12)}" + r.choice(("", long, f"<h3>{text(1, 3)}</h3><ul>{links(3)}</ul>"))
        elif kind == 4:
            tag, inner = r.choice(("aside", "aside", "div", "section")), r.choice(("", f"<h3>{text(1, 4)}</h3>")) + r.choice((f"<ul>{links(4)}</ul>", long, long + long))
        elif kind == 5:
            one = r.choice(("<div class='comment'>{}</div>", "<li>{}</li>", "<article class='comment'>{}</article>", "{}", "<div class='comment-body'>{}</div>"))
            many = "".join(one.format(comment()) for _ in range(r.randint(1, 5)))
            tag, inner = r.choice(("section", "div", "div", "aside")), r.choice(("", f"<h3>{text(1, 3)}</h3>")) + (f"<ol>{many}</ol>" if "<li>" in many else many)
        elif kind == 6:
            tag, inner = r.choice(("div", "div", "section", "p", "aside")), r.choice((text(4, 30), long, f"{text(4, 30)} <button>{text(1, 2)}</button>"))
        elif kind == 7:
            tag, inner = r.choice(("form", "form", "div", "section")), r.choice(("", f"<p>{text(3, 20)}</p>", f"<h3>{text(1, 4)}</h3>")) + f"<label>{text(1, 2)}</label><input><button>{text(1, 2)}</button>"
        elif kind == 8:
            tag, inner = r.choice(("div", "div", "ul", "p")), r.choice((text(1, 6), f"<a href='#'>{text(1, 2)}</a> <a href='#'>{text(1, 2)}</a>"))
        else:  # an element of telling tag without names, or of telling role
            tag, inner = r.choice(("nav", "aside", "footer", "header", "form")), r.choice((text(1, 20), long, f"<ul>{links(3)}</ul>", f"<h2>{text(1, 4)}</h2>{long}"))
            if r.random() < 0.2:
                return f"<div role='{r.choice(('navigation', 'banner', 'contentinfo', 'complementary', 'search'))}' data-y='0'>{inner}</div>"
            return f"<{tag} data-y='0'>{inner}</{tag}>"
        if tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.4:
            name = ""
        else:
            name = r.choice((f" class='{named(kind)}'", f" id='{named(kind)}'", f" class='{named(kind)}-{word()}'", f" class='{word()} {named(kind)}'"))
        if tag == "ul":
            inner = links(4)
        if tag == "p":
            inner = text(2, 30)
        return f"<{tag}{name} data-y='0'>{inner}</{tag}>"

    pages = []
    for _ in range(n):
        holder = r.choice(("article", "article", "article", "main", "main", "div class='content'", "div id='content'", "div class='post'", "div class='article-body'", "section class='entry'", "div class='story'", "div id='main'", "article class='post'"))
        parts = [body()]
        for _ in range(r.choice((0, 0, 1, 2, 3))):
            parts.append(junk())
            if r.random() < 0.6:
                parts.append(block())
        if r.random() < 0.2:
            parts.insert(0, junk())
        content = f"<{holder} data-y='1'>{''.join(parts)}</{holder.split()[0]}>"
        for _ in range(r.choice((0, 0, 1, 2))):
            wrap = r.choice(("div", "div class='wrap'", "div id='page'", "div class='container'", "section"))
            sides = [junk() for _ in range(r.choice((0, 1, 2)))]
            content = f"<{wrap}>{''.join(sides[:1])}{content}{''.join(sides[1:])}</{wrap.split()[0]}>"
        before, after = "".join(junk() for _ in range(r.randint(0, 4))), "".join(junk() for _ in range(r.randint(0, 4)))
        x = r.random()
        if x < 0.2:  # nothing holds the article but the page
            pages.append(f"<html><body data-y='1'>{before}{''.join(parts)}{after}</body></html>")
        elif x < 0.28:
            pages.append(f"<html><body>{before}<div data-y='1'>{''.join(parts)}</div>{after}</body></html>")
        elif x < 0.36:
            pages.append("<html><body data-y='1'>" * r.randint(0, 1) + "".join(f"<p data-y='1'>{text(1, 60)}</p>" for _ in range(r.randint(1, 4))))
        else:
            pages.append(f"<html><body>{before}{content}{after}</body></html>")
    return pages


def train(pages: list[str], steps: int = 700, l2: float = 0.0001) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the parent-child states, by likelihood ascent (Adam) on labelled pages."""
    trees = [Tree(p) for p in pages]
    forest = Forest(trees)
    y = np.array([x == "1" for t in trees for x in t.label], float)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    observed = np.bincount(forest.feature, weights=y[forest.node], minlength=FEATURES)
    theta = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        p, both = forest.marginals(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))
        gradient = np.concatenate([observed - np.bincount(forest.feature, weights=p[forest.node], minlength=FEATURES), (seen - both[child].sum(0)).ravel()]) / len(trees) - l2 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta[:FEATURES], theta[FEATURES:].reshape(2, 2)


@lru_cache(maxsize=1)
def default_model() -> tuple[np.ndarray, np.ndarray]:
    return train(labelled_pages())


def texts(pages: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page."""
    trees = [Tree(p) for p in pages]
    if not trees:
        return []
    forest = Forest(trees)
    p, _ = forest.marginals(*model)
    return ["\n".join(text for node, text in t.leaves if p[s + node] >= 0.5) for t, s in zip(trees, forest.start.tolist(), strict=False)]


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", model: tuple | None = None) -> DataFrame:
    """The columns in keep, text (empty if there is none) and n_chars of every row of pages."""
    keep = kept(keep, ["text", "n_chars"])
    model = model or default_model()
    kinds = {f.name: f.dataType for f in pages.schema}
    schema = StructType([StructField(c, kinds[c]) for c in keep] + [StructField("text", StringType()), StructField("n_chars", LongType())])
    arrow, n = arrow_schema(schema), len(keep)

    def run(batches):
        for b in batches:
            for low in range(0, b.num_rows, 200):
                part = b.slice(low, 200)
                found = texts([x or "" for x in part.column(n).to_pylist()], model)
                columns = [part.column(i) for i in range(n)] + [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return pages.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(html_col).alias("_html")).mapInArrow(run, schema)
