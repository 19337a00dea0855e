r"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements. Trees boosted on the nodes' features (densities of the subtree, attribute
tokens, depth, place among siblings, what encloses them, how they stand to the page's article and to the node with the
most paragraphs) give each node a probability of holding main text.
Hierarchical decoding then labels the whole page at once: the most likely labelling in which everything below a dropped
node is dropped as well, so ancestors and descendants never contradict each other. The trees are trained on pages that
training_pages() makes up with known labels, in which many names say nothing, are foreign or mislead; nothing of the
table is used. A heading in an article's own header is main text, a byline or a footer there is not.

Text that stands beside block elements, and text directly in the body, is a node of its own (an anonymous block, as
browsers lay it out), so it is judged like any other block.

The text of a kept node's blocks is joined in page order by two line feeds; white space in a block is one space.

Cases: null or empty html gives an empty text; unclosed and stray tags are mended as browsers do, and a tag that the
page's end cuts off is no text; a page is read once from start to end, however malformed; scripts, styles, the head,
comments and templates are never text; repeated rows are each extracted; a column named as the result is replaced, all
other columns of the input pass through.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import pieces
from .gbt import Boosted

SEED, PAGES, SLICE = 11, 1_200, 1 << 21
#: Trees, and levels of each.
TREES, DEPTH = 80, 5

# Element names of HTML, and words that sites put into class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg title select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input button".split())
PARAGRAPH = frozenset(("p",))
ANONYMOUS = "#text"
GROUPS = [("article", "main"), ("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "dialog"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("table", "thead", "tbody", "tr", "td", "th"), ("figure", "figcaption", "details", "summary"), ("head",), (ANONYMOUS,)]
WORDS = [
    ("article", "content", "main", "post", "entry", "story", "body", "text", "prose"),
    ("nav", "navigation", "menu", "navbar", "breadcrumb", "breadcrumbs", "topbar", "toc", "pagination", "pager"),
    ("header", "masthead", "branding", "banner"),
    ("footer", "copyright", "legal", "contentinfo", "colophon"),
    ("sidebar", "aside", "widget", "related", "recommended", "popular", "complementary", "more", "rail"),
    ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion"),
    ("cookie", "cookies", "consent", "notice", "alert", "gdpr", "newsletter", "popup", "modal", "overlay", "subscribe", "paywall", "message"),
    ("comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "reader", "feedback"),
    ("share", "social", "sharing", "follow", "tags", "meta", "byline", "author"),
    ("form", "search", "login", "signup", "register", "contact"),
]
_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g}
_WORD = {w: i for i, g in enumerate(WORDS) for w in g}
#: Start tags that end an open element of the second set.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th")}
#: What may follow `<`, and the rest of a tag: quotes count after an equals sign. Nothing is tried twice, so a page costs linear time.
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+")
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
FEATURES = len(GROUPS) + 2 * len(WORDS) + len(GROUPS) + 20


def tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name in lower case, attributes) of the tags of source; comments and declarations come without a name. A caller may send the place to go on from."""
    at = source.find("<")
    while at >= 0:
        end, closes, name, rest = at + 1, False, "", ""
        if m := _NAME.match(source, at + 1):
            r = _REST.match(source, m.end())
            end = r.end() + 1 if r.end() < len(source) else len(source)
            # a tag that never ends is dropped with what follows
            if r.end() < len(source):
                closes, name, rest = bool(m[1]), m[2].lower(), r[0]
        elif source.startswith("<!--", at):
            end = source.find("-->", at + 4) + 3
            end = end if end > 2 else len(source)
        elif source[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < len(source):
            end = source.find(">", at) + 1 or len(source)
        else:
            at = source.find("<", at + 1)
            continue
        to = yield at, end, closes, name, rest
        at = source.find("<", end if to is None else to)


def _raw_end(source: str, name: str, at: int) -> int:
    """Where the content of a raw element ends, its end tag included."""
    m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
    return (source.find(">", m.end()) + 1 or len(source)) if m else len(source)


class Page:
    """Block elements of a page in order, and the runs of text in them."""

    def __init__(self, source: str):
        self.tag: list[str] = ["body"]
        self.parent: list[int] = [-1]
        self.attrs: list[str] = [""]
        #: (node, text, of which characters in links)
        self.runs: list[tuple[int, str, int]] = []
        stack: list[tuple[str, int]] = [("body", 0)]
        opened: Counter = Counter()
        held: list[str] = []
        #: the last node that had begun when a run ended
        before: list[int] = []
        linked = 0

        def close_run():
            nonlocal linked
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                if text:
                    self.runs.append((stack[-1][1], text, min(linked, len(text))))
                    before.append(len(self.tag) - 1)
                held.clear()
            linked = 0

        def pop_to(depth: int):
            if any(t not in INLINE for t, _ in stack[depth:]):
                close_run()
            for t, _ in stack[depth:]:
                opened[t] -= 1
            del stack[depth:]

        def push(name: str, node: int):
            stack.append((name, node))
            opened[name] += 1

        at, scan = 0, tags(source)
        found = next(scan, None)
        while found:
            start, end, closes, name, rest = found
            if start > at:
                held.append(source[at:start])
                if opened["a"] > 0:
                    linked += start - at
            at, to = end, None
            if not name:
                pass
            elif closes:
                if opened[name] > 0:
                    for depth in range(len(stack) - 1, 0, -1):
                        if stack[depth][0] == name:
                            pop_to(depth)
                            break
                        if name in INLINE and stack[depth][0] not in INLINE:
                            break
                elif name in PARAGRAPH:
                    close_run()
            elif name in RAW:
                at = to = _raw_end(source, name, end)
                held.append(" ")
            elif name == "br" or name in ("img", "input", "wbr"):
                held.append(" ")
            elif name in INLINE:
                push(name, stack[-1][1])
            elif name in ("html", "body"):
                pass
            else:
                # a block ends an open paragraph, and what its name ends
                over = ("p", *_ENDS.get(name, ()))
                for depth in range(len(stack) - 1, 0, -1) if any(opened[x] > 0 for x in over) else ():
                    if stack[depth][0] in over:
                        pop_to(depth)
                        break
                    if stack[depth][0] not in INLINE and not (stack[depth][0] in ("tr", "td", "th") and name in _ENDS):
                        break
                close_run()
                if name not in VOID:
                    self.tag.append(name)
                    self.parent.append(stack[-1][1])
                    self.attrs.append(rest)
                    push(name, len(self.tag) - 1)
            try:
                found = next(scan) if to is None else scan.send(to)
            except StopIteration:
                found = None
        if at < len(source):
            held.append(source[at:])
        close_run()
        self._anonymous(before)

    def _anonymous(self, before: list[int]) -> None:
        """Give the runs of the root, and of nodes with block children, nodes of their own: numbered in page order, so a parent comes first."""
        inner = set(self.parent) | {0}
        if not any(node in inner for node, _, _ in self.runs):
            return
        order = [(i, 0, i) for i in range(len(self.tag))] + [(before[k], 1 + k, -1 - k) for k, run in enumerate(self.runs) if run[0] in inner]
        order.sort()
        number = {old: new for new, (_, _, old) in enumerate(order)}
        tag, parent, attrs, made = [], [], [], []
        for _, _, old in order:
            node = old if old >= 0 else self.runs[-1 - old][0]
            tag.append(self.tag[old] if old >= 0 else ANONYMOUS)
            parent.append(number[node] if old < 0 else number[self.parent[old]] if old else -1)
            attrs.append(self.attrs[old] if old >= 0 else "")
        for k, (node, text, linked) in enumerate(self.runs):
            made.append((number[-1 - k] if node in inner else number[node], text, linked))
        self.tag, self.parent, self.attrs, self.runs = tag, parent, attrs, made

    def features(self) -> np.ndarray:
        n = len(self.tag)
        own, link, runs = np.zeros(n), np.zeros(n), np.zeros(n)
        stops, signs = np.zeros(n), np.zeros(n)
        for node, text, linked in self.runs:
            own[node] += len(text)
            signs[node] += sum(map(text.count, "|\u00b7\u00a9\u00bb"))
            link[node] += linked
            runs[node] += 1
            stops[node] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
        parent = np.array(self.parent)
        size, text, links, paragraphs, marks = np.ones(n), own.copy(), link.copy(), np.array([t == "p" for t in self.tag], float), stops.copy()
        depth, order, siblings = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for a in (size, text, links, paragraphs, marks, signs):
                a[p] += a[i]
        kind, words = np.zeros((n, len(GROUPS))), np.zeros((n, len(WORDS)))
        over_kind, over_words = np.zeros((n, len(GROUPS))), np.zeros((n, len(WORDS)))
        for i in range(n):
            g = _GROUP.get(self.tag[i])
            if g is not None:
                kind[i, g] = 1
            if self.attrs[i]:
                for m in _ATTR.finditer(self.attrs[i]):
                    for w in _PART.findall((m[1] or m[2] or m[3] or "").lower()):
                        if w in _WORD:
                            words[i, _WORD[w]] = 1
            if i:
                p = parent[i]
                depth[i] = depth[p] + 1
                order[i] = siblings[p]
                siblings[p] += 1
                over_kind[i] = np.maximum(over_kind[p], kind[p])
                over_words[i] = np.maximum(over_words[p], words[p])
        of = siblings[np.maximum(parent, 0)]
        # the article or main element with the most text, and the node whose own paragraphs hold the most: is a node in it, and how much more does it hold
        held = np.zeros(n)
        for i in range(1, n):
            if self.tag[i] in ("p", ANONYMOUS):
                held[parent[i]] += own[i] - link[i]
        told = np.flatnonzero(kind[:, 0])
        best = [int(told[text[told].argmax()]) if len(told) else -1, int(held.argmax())]
        inside = np.zeros((n, 2))
        for i in range(n):
            inside[i] = [i == b or (i > 0 and inside[parent[i], k]) for k, b in enumerate(best)]
        total = max(text[0], 1.0)
        log = np.log1p
        dense = [log(own), log(text), links / np.maximum(text, 1), text / size, log(size), log(paragraphs), marks / np.maximum(text / 50, 1), depth, order / np.maximum(of, 1), log(of), text / total, text[np.maximum(parent, 0)] / total, (links / np.maximum(text, 1))[np.maximum(parent, 0)], runs]
        most = [text[b] if b >= 0 else 0.0 for b in best]
        dense += [inside[:, 0] if best[0] >= 0 else np.full(n, 0.5), np.full(n, most[0] / max(text[0], 1)), inside[:, 1], log(text) - np.log1p(most[1]), signs / np.maximum(text / 20, 1), np.full(n, log(text[0]))]
        return np.hstack([kind, words, over_kind, over_words, np.stack(dense, 1)])

    def decode(self, p: np.ndarray) -> np.ndarray:
        """Which nodes are kept, in the likeliest labelling without a kept node below a dropped one. The root holds no text of its own and is kept."""
        n = len(p)
        weight = np.ones(n)
        for node, text, _ in self.runs:
            weight[node] += np.log1p(len(text))
        p = np.clip(p, 1e-4, 1 - 1e-4)
        keep, drop = weight * np.log(p), weight * np.log(1 - p)
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            drop[up] += drop[i]
            keep[up] += max(keep[i], drop[i])
        kept = np.zeros(n, bool)
        kept[0] = True
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and keep[i] >= drop[i]
        return kept

    def text(self, kept: np.ndarray) -> str:
        return "\n\n".join(t for node, t, _ in self.runs if kept[node])


def training_pages(n: int, seed: int) -> Iterator[tuple[str, list[str]]]:
    """Made-up pages, and the blocks that are main text."""
    draw = random.Random(seed)

    def words(a, b):
        return " ".join("".join(draw.choice("aeiourstnlmdk") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(a, b)))

    def sentence(a=4, b=25):
        return words(a, b).capitalize() + draw.choice([".", ".", ".", "!", "?"])

    def passage(most=6):
        return " ".join(sentence() for _ in range(draw.randint(1, most)))

    def name(group, loose=0.35, plain=0.3, wrong=0.06):
        """An attribute of the group; with loose none, with plain one that says nothing, with wrong one of another group."""
        if draw.random() < loose:
            return ""
        kind = draw.random()
        word = draw.choice(WORDS[draw.randrange(len(WORDS)) if kind < wrong else group])
        word = draw.choice([word, word, f"{word}-{words(1, 1)}", f"site-{word}", f"{word} {words(1, 1)}"])
        if wrong <= kind < wrong + plain:
            word = draw.choice([words(1, 1), f"{words(1, 1)[:2]}{draw.randint(1, 99)}", f"{words(1, 1)}-{words(1, 1)}", f"css-{draw.randrange(1 << 24):x}"])
        return f' {draw.choice(["class", "class", "id"])}="{word}"'

    def outer(group, where):
        """The attribute of a block without a telling element: beside an article that tells it often says nothing, within one, or beside a text that does not tell itself, it tells."""
        return name(group, 0.25, 0.4) if where == "page" and tells else name(group, 0.0, 0.05, 0.0)

    def links(k):
        kind = draw.choice(["ul", "ul", "div", "p"])
        inner = "".join(f"<li><a href='#'>{words(1, 4)}</a></li>" if kind == "ul" else f"<a href='#'>{words(1, 4)}</a> " for _ in range(k))
        return f"<{kind}>{inner}</{kind}>"

    def bare():
        """Text without an element that is no main text: skip links, a line of links, a copyright line."""
        return draw.choice([f"<a href='#{words(1, 1)}'>{words(2, 4)}</a>", " | ".join(f"<a href='/{words(1, 1)}'>{words(1, 2)}</a>" for _ in range(draw.randint(2, 6))), " | ".join(words(1, 3) for _ in range(draw.randint(2, 5))), f"&copy; {words(1, 3)} {words(2, 5)}.", f"Copyright {draw.randint(1995, 2030)} {words(1, 4)}", words(1, 4), sentence(2, 5)])

    def junk(where):
        """A block that is no main text; where: page or article."""
        kind = draw.choice(["nav", "header", "footer", "aside", "ad", "notice", "comments", "share", "form"] if where == "page" else ["ad", "aside", "share", "notice", "form"])
        if kind == "nav":
            return f"<nav{name(1)}>{links(draw.randint(2, 12))}</nav>" if draw.random() < 0.6 else f"<div{outer(1, where)}>{links(draw.randint(2, 12))}</div>"
        if kind == "header":
            inner = f"<h1>{words(1, 5)}</h1>" * draw.randint(0, 1) + f"<p>{passage(2)}</p>" * draw.randint(0, 1) + links(draw.randint(1, 6))
            return f"<header{name(2)}>{inner}</header>" if draw.random() < 0.6 else f"<div{outer(2, where)}>{inner}</div>"
        if kind == "footer":
            inner = draw.choice([f"&copy; {words(1, 3)} &middot; {passage(2)}", f"<p>{passage(3)}</p>" + links(draw.randint(1, 6)), f"<p>{bare()}</p>", bare(), f"<p>{bare()}</p><p>{bare()}</p>", f"<p>{passage(1)}</p>"])
            return f"<footer{name(3)}>{inner}</footer>" if draw.random() < 0.7 else f"<div{outer(3, where)}>{inner}</div>"
        if kind == "aside":
            inner = f"<h3>{words(1, 4)}</h3>" * draw.randint(0, 1) + draw.choice([links(draw.randint(2, 8)), f"<p>{passage(3)}</p>", passage(2)])
            return f"<aside{name(4)}>{inner}</aside>" if draw.random() < 0.5 else f"<div{outer(4, where)}>{inner}</div>"
        if kind == "ad":
            return f"<div{outer(5, where)}>{draw.choice([passage(2), f'<p>{passage(2)}</p>', f'<a href=x>{sentence()}</a>'])}</div>"
        if kind == "notice":
            return f"<{(t := draw.choice(['div', 'section', 'p', 'dialog']))}{outer(6, where)}>{draw.choice([passage(3), f'<span>{passage(2)}</span> <button>ok</button>'])}</{t}>"
        if kind == "share":
            return f"<div{outer(8, where)}>{links(draw.randint(2, 5))}</div>"
        if kind == "form":
            return f"<form{name(9)}><label>{words(1, 3)}</label> <input name=q> <p>{sentence()}</p><button>{words(1, 2)}</button></form>"
        one = lambda: f"<{(t := draw.choice(['div', 'li', 'article']))}{name(7, 0.3)}>{draw.choice([f'<p>{passage(3)}</p>', passage(3), f'<b>{words(1, 2)}</b> <p>{passage(4)}</p>'])}</{t}>"
        head = f"<h3>{words(1, 3)}</h3>" * draw.randint(0, 1)
        return f"<{(t := draw.choice(['section', 'div', 'ol']))}{name(7, 0)}>{head}{''.join(one() for _ in range(draw.randint(1, 6)))}</{t}>"

    tells = True
    for _ in range(n):
        blocks: list[str] = []
        tag, attr = draw.choice([("article", ""), ("article", ""), ("article", name(0)), ("main", ""), ("div", name(0, 0, 0.1, 0.0)), ("div", name(0, 0, 0.1, 0.0)), ("section", name(0, 0, 0.1, 0.0)), ("div", "")])
        enclosed = draw.random() < 0.93
        tells = enclosed and (tag in ("article", "main") or bool(attr))

        def block(tag, text, blocks=blocks):
            blocks.append(text)
            return f"<{tag}>{text}</{tag}>" if draw.random() < 0.9 or tag != "p" else f"<p>{text}"

        body = [block("h1", words(2, 12))] if draw.random() < 0.8 else []
        for _ in range(draw.choice([1, 2, 3, 5, 8, 14, 30])):
            r = draw.random()
            if r < 0.06:
                # bare text between blocks
                text = draw.choice([passage(5), sentence()])
                if body and not body[-1].endswith(">"):
                    text = blocks.pop() + " " + text
                    body.pop()
                blocks.append(text)
                body.append(text)
            elif r < 0.7:
                body.append(block("p", draw.choice([passage(8), passage(3), sentence(1, 6), words(1, 3)])))
            elif r < 0.78:
                body.append(block(draw.choice(["h2", "h3"]), words(1, 8)))
            elif r < 0.86:
                body.append("<ul>" + "".join(block("li", draw.choice([sentence(), words(1, 6)])) for _ in range(draw.randint(1, 6))) + "</ul>")
            elif r < 0.9:
                body.append(block("blockquote", passage(3)))
            elif r < 0.93:
                body.append(f"<table><tr>{''.join(block('td', words(1, 4)) for _ in range(draw.randint(2, 4)))}</tr></table>")
            elif r < 0.95:
                body.append(f"<figure><img src=x>{block('figcaption', sentence())}</figure>")
            else:
                body.append(junk("article"))
        if draw.random() < 0.25:
            body.insert(draw.choice([0, len(body)]), junk("article"))
        if tells and draw.random() < 0.25:
            # the article's own header and footer: its heading belongs to the text, what else stands there does not
            line = lambda: draw.choice([words(2, 5).capitalize(), f"{words(1, 1).capitalize()} {words(1, 2)}, {draw.randint(1, 28)} {words(1, 1)} {draw.randint(1995, 2030)}", links(draw.randint(1, 3)), sentence(2, 6)])
            said = lambda: draw.choice([f"<p{name(8, 0.6)}>{line()}</p>", f"<div{name(8, 0.5)}>{line()}</div>", line()])
            first = body.pop(0) if body and body[0].startswith("<h1>") else ""
            if first or draw.random() < 0.5:
                body.insert(0, f"<header{name(2, 0.6)}>{first}{said()}</header>")
            if draw.random() < 0.6:
                body.append(f"<footer{name(3, 0.6)}>{said()}</footer>")
        inner = "".join(body)
        inner = f"<{tag}{attr}>{inner}</{tag}>" if enclosed else f"<hr>{inner}<hr>"
        if draw.random() < 0.3:
            inner = f"<{(t := draw.choice(['main', 'div', 'section']))}{name(0)}>{inner}{junk('page') * (draw.random() < 0.3)}</{t}>"
        before, after = "".join(junk("page") for _ in range(draw.randint(0, 4))), "".join(junk("page") for _ in range(draw.randint(0, 4)))
        if draw.random() < 0.2:
            inner = f"<div{name(draw.randint(0, 4), 0.7)[:0]} id='wrap'>{before}{inner}{after}</div>"
            before = after = ""
        before, after = bare() * (draw.random() < 0.15) + before + "<hr>" * (not before), "<hr>" * (not after) + after + bare() * (draw.random() < 0.15)
        yield f"<html><head><title>{words(2, 5)}</title></head><body>{before}{inner}{after}</body></html>", blocks


@functools.cache
def trained(pages: int = PAGES, seed: int = SEED) -> Boosted:
    """The boosted trees, from made-up pages."""
    xs, ys = [], []
    for source, blocks in training_pages(pages, seed):
        page = Page(source)
        wanted, good, below = iter(blocks), np.zeros(len(page.tag)), np.zeros(len(page.tag))
        now = next(wanted, None)
        for node, text, _ in page.runs:
            below[node] += 1
            if text == now:
                good[node] += 1
                now = next(wanted, None)
        for i in range(len(page.tag) - 1, 0, -1):
            good[page.parent[i]] += good[i]
            below[page.parent[i]] += below[i]
        on = below > 0
        xs.append(page.features()[on])
        # a node that encloses main text must be kept for it
        ys.append((good[on] > 0).astype(float))
    return Boosted(TREES, DEPTH).fit(np.concatenate(xs), np.concatenate(ys))


def extract_all(sources: list[str], model: Boosted) -> list[str]:
    pages = [Page(s or "") for s in sources]
    features = [p.features() for p in pages]
    edges = np.cumsum([0, *map(len, features)])
    p = model.predict(np.concatenate(features)) if pages else np.zeros(0)
    return [page.text(page.decode(p[a:b])) for page, a, b in zip(pages, edges, edges[1:], strict=False)]


def extract(pages: DataFrame, html_col: str = "html", to: str = "text") -> DataFrame:
    """pages with the main text of html_col."""
    model = trained()
    source = pages.drop(to).withColumn("_tl_html", F.coalesce(F.col(html_col).cast("string"), F.lit("")))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1)
            sizes = np.array([len(x.as_buffer() or b"") for x in values], np.int64)
            for a, b in pieces(np.r_[0, np.cumsum(sizes)], SLICE):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(extract_all(part.column(part.num_columns - 1).to_pylist(), model), pa.string())], schema.names)

    return source.mapInArrow(run, schema)
