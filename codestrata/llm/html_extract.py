"""Main text of web pages by site style trees (operator 1).

Pages of one host are merged into a style tree. A node is an element's path of
tags, classes and ids; each page adds the style (the run of child elements) and
the content (the text below) that it has there. With m pages at a node, l
styles, and a content that f of them share:

    presentation  P = - sum over styles of p * log_m p       (1 if m = 1)
    content       C = 1 - log_m f                            (a feature's entropy over pages)
    importance      = (1 - GAMMA**l) * P + GAMMA**l * C

Branches of low importance are removed from each page, besides those that HTML
itself says are no content (menus, forms, scripts and so on). Class words
("notice", "ad") are a prior only: they don't hold for what contains a main or
the page's articles, nor, on a page without either, for blocks that have nearly
all of its prose; those are left to the tree. Prose inside an ``article`` or
``main``, and every branch that holds such prose, whether it stands inside or
around them, is only removed by such marks: the same paragraph in many articles
is still text. Nor does the tree take more than half of the text of an
``article`` or ``main`` that is no prose by its tags.

A page meets the low branches of its host by (host, path, value), then those it
has by its own key, so a host with a third of all pages is spread like others.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words
from .shared import bounded, stored
from .url_filter import host_of

GAMMA = 0.9
LOW = 0.25
#: A node is judged by its style tree if so many pages have it: entropies to the base of few pages say nothing.
LEAST_PAGES = 8

#: Fixed values of HTML: elements without end, without content, and those that start a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hr html legend li link main menu meta nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ol ul dl dt dd blockquote pre table thead tbody tfoot tr td th figcaption figure article main body".split())
DROPPED = frozenset("head script style noscript template nav footer aside form iframe object embed svg canvas button select textarea input menu dialog noembed noframes title".split())
#: Words that, alone or joined ("cookie-notice"), are a whole class, id or role that marks what is no content.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs sidebar widget related recommended share sharing social comment comments"
    " commentlist disqus reply replies respond footer masthead toolbar pagination pager search skip complementary contentinfo form dialog".split()
)
#: Of these, the words of what readers write, which is never taken for the main text.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: On a page without article or main, marked prose that is so many times as long as all the rest is no mere notice.
FAR_MORE = 4
#: Start tags that end an open element of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPECIAL = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
HARD, READER, SOFT = 3, 2, 1


class Node:
    """An element. hard: it, or one around it, is no content by its tag; within: the nearest article or main, itself included."""

    __slots__ = ("tag", "parent", "children", "label", "mark", "dropped", "core", "prose", "hard", "within")

    def __init__(self, tag: str, parent: Node | None, label: str, mark: int):
        self.tag, self.parent, self.label, self.mark = tag, parent, label, mark
        self.children: list[Node | str] = []
        self.dropped = self.prose = False
        self.hard = mark == HARD or parent is not None and parent.hard
        self.within: Node | None = self if tag in ("article", "main") else parent and parent.within
        self.core = self.within is not None


def _gather(tops: list[Node], gone: Callable[[Node], bool]) -> str:
    """The text of these elements, references decoded, white space as one space."""
    out: list[str] = []
    ahead: list[Node | str] = tops[::-1]
    while ahead:
        x = ahead.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.tag in BLOCK:
            out.append("\n")
            ahead.append("\n")
        ahead += [c for c in reversed(x.children) if isinstance(c, str) or not gone(c)]
    return " ".join(html.unescape("".join(out)).split())


def _spans(root: Node, gone: Callable[[Node], bool]) -> tuple[list[str], dict[int, tuple[int, int]]]:
    """The words of a page, and of each block which of them are its own: blocks never share a word, so no text is joined twice."""
    words: list[str] = []
    spans: dict[int, tuple[int, int]] = {}
    run: list[str] = []
    ahead: list[tuple[Node | str, int]] = [(root, -1)]
    while ahead:
        x, begun = ahead.pop()
        if isinstance(x, str):
            run.append(x)
            continue
        block = x.tag in BLOCK
        if block or begun >= 0:
            words += html.unescape("".join(run)).split()
            run = []
        if begun >= 0:
            spans[id(x)] = (begun, len(words))
            continue
        if block:
            ahead.append((x, len(words)))
        ahead += [(c, -1) for c in reversed(x.children) if isinstance(c, str) or not gone(c)]
    return words + html.unescape("".join(run)).split(), spans


def _attributes(raw: str) -> tuple[str, int]:
    """Class and id of a tag as its label, and what it is marked as: 0, SOFT for no content, READER for readers' words or hidden ones."""
    if not raw or raw.isspace():
        return "", 0
    label, marked = "", 0
    for name, value in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), value.strip("\"' ").lower()
        if name in ("class", "id", "role"):
            label += f".{value}" if name != "role" else ""
            for words in map(_WORD.findall, value.split()):
                if words and MARKS.issuperset(words):
                    marked = max(marked, SOFT if READERS.isdisjoint(words) else READER)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            marked = READER
    return label, marked


def _marked(inner: list[Node]) -> list[Node]:
    """The marked elements around these; every element is looked at once."""
    found, seen = [], set()
    for node in inner:
        above = node.parent
        while above is not None and id(above) not in seen:
            seen.add(id(above))
            if above.mark:
                found.append(above)
            above = above.parent
    return found


def _settle(root: Node, nodes: list[Node]) -> None:
    """Sets dropped and prose, parents before children.

    Marks don't count on what contains a main; nor on what contains an article
    if no other is left and its articles have more text than the rest has; nor,
    without a main or article, on blocks whose prose is FAR_MORE than the rest.
    """

    def drop() -> None:
        for node in nodes:
            node.dropped = node.parent.dropped or bool(node.mark)

    def unmark(cores: list[Node]) -> list[Node]:
        """The marked elements around these, as far as nothing else drops them."""
        found = _marked([c for c in cores if not c.hard])
        for n in found:
            n.mark = 0
        return found

    outer = [n for n in nodes if n.tag in ("article", "main") and not n.parent.core]
    if outer:
        unmark([n for n in outer if n.tag == "main"])
    drop()
    if outer and all(n.dropped for n in outer):
        rest = len(_kept(root))
        found = unmark(outer)
        drop()
        if found and sum(len(_kept(n)) for n in outer if not n.dropped) <= rest:
            for n in found:
                n.mark = SOFT
            drop()
    if not outer and (large := _marked_prose(nodes)):
        rest = len(_kept(root))
        for n in large:
            n.mark = 0
        drop()
        if len(_kept(root)) - rest <= FAR_MORE * rest:
            for n in large:
                n.mark = SOFT
            drop()
    for node in nodes:
        above = node if node.core and node.tag in PROSE and not node.dropped else None
        while above is not None and not above.prose:
            above.prose, above = True, above.parent


def _marked_prose(nodes: list[Node]) -> list[Node]:
    """The elements dropped by a class word alone that have paragraphs or headings in them."""
    worst: dict[int, int] = {}
    inner = []
    for node in nodes:
        worst[id(node)] = max(node.mark, worst.get(id(node.parent), 0))
        if node.tag in ("p", "h1", "h2", "blockquote") and worst[id(node)] == SOFT:
            inner.append(node)
    return [*{id(n): n for n in [*_marked(inner), *(n for n in inner if n.mark)]}.values()]


def _kept(node: Node) -> str:
    return _gather([node], lambda n: n.dropped)


class _Tags:
    """Tags from left to right. A tag ends at the first > outside quotes, where there is none at the first at all.

    A search that came to the page's end in vain has marked the quotes it met, so
    that none of them is followed again: the whole page costs its length.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.vain: set[int] = set()

    def end(self, pos: int) -> int:
        """Where the > of a tag is whose attributes begin at pos; there is one somewhere behind."""
        at, met = pos, []
        while m := _SPECIAL.search(self.page, at):
            i = m.start()
            if self.page[i] == ">":
                return i
            if i in self.vain:
                break
            met.append(i)
            if i >= self.last[self.page[i]]:
                break
            at = self.page.index(self.page[i], i + 1) + 1
        self.vain.update(met)
        return self.page.index(">", pos)

    def __iter__(self) -> Iterator[tuple[str, str, str, int, int]]:
        """(slash, name, attributes, start, end); comments and declarations have no name. send() goes on elsewhere."""
        page, pos = self.page, 0
        while (at := page.find("<", pos)) >= 0:
            if page.startswith("<!--", at):
                close = page.find("-->", at + 4)
                pos = close + 3 if close >= 0 else len(page)
                found = "", "", ""
            elif at > self.last[">"]:  # only a comment can still begin
                pos = at + 1
                if (pos := page.find("<!--", pos)) < 0:
                    return
                continue
            elif page[at + 1] in "!?":
                pos = page.index(">", at) + 1
                found = "", "", ""
            else:
                slash = "/" * (page[at + 1] == "/")
                name = _NAME.match(page, at + 1 + len(slash))
                if not name:
                    pos = at + 1
                    continue
                end = self.end(name.end())
                found = slash, name[0], page[name.end() : end]
                pos = end + 1
            pos = (yield (*found, at, pos)) or pos


def parse(page: str) -> Node:
    """A tree of the page's elements. Every element that is open at its parent's end ends there.

    Open elements are a stack with their places by tag, so what a tag ends is
    looked up, however deep it lies.
    """
    root = Node("", None, "", 0)
    nodes: list[Node] = []
    stack, places = [root], {}
    blocks = [0]  # of the open elements that are blocks

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().tag].pop()
            while blocks[-1] >= len(stack):
                blocks.pop()

    tags, done, jump = _Tags(page), 0, None
    walk = iter(tags)
    while True:
        try:
            slash, name, raw, start, end = walk.send(jump)
        except StopIteration:
            break
        jump = None
        if start > done:
            stack[-1].children.append(page[done:start])
        done = end
        if not name:
            continue
        tag = name.lower()
        if slash:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in BLOCK and tag != "br" and stack[blocks[-1]].tag == "p":  # a block ends an open paragraph
            close(blocks[-1])
        if tag in CLOSES:
            scope = max((places[t][-1] for t in _SCOPE[tag] if places.get(t)), default=0)
            inside = [own[k] for t in CLOSES[tag] if (own := places.get(t)) and (k := bisect_right(own, scope)) < len(own)]
            if inside:
                close(min(inside))
        label, marked = _attributes(raw)
        at = stack[-1]
        hard = tag in DROPPED or (marked and tag == "article" and at.core) or (tag == "header" and not at.core)
        mark = HARD if hard else marked if tag not in ("html", "body", "article", "main") else 0
        node = Node(tag, at, tag + label, mark)
        at.children.append(node)
        nodes.append(node)
        if tag in RAW:
            ends = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, end, tags.last[">"] + 1)
            node.children.append(page[end : ends.start() if ends else len(page)])
            done = jump = ends.end() if ends else len(page)
        elif tag not in VOID and not raw.endswith("/"):
            if tag in BLOCK:
                blocks.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    if done < len(page):
        stack[-1].children.append(page[done:])
    _settle(root, nodes)
    return root


def _hash(text: str) -> int:
    x = xxhash.xxh3_64_intdigest(text)
    return x - (1 << 64) if x >> 63 else x


def _walk(root: Node) -> Iterator[tuple[Node, int]]:
    """Block elements that HTML does not drop, in order, with the hash of their path."""
    ahead = [(root, 0)]
    while ahead:
        node, path = ahead.pop()
        if node.tag in BLOCK and node.tag not in ("br", "html", "body"):
            yield node, path
        ahead += [(c, _hash(f"{path}/{c.label}")) for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]


def _removable(root: Node) -> list[tuple[Node, int, int]]:
    """(node, path, hash of its text) of the branches that the tree may remove."""
    words, spans = _spans(root, lambda node: False)
    found = [(node, path, *spans[id(node)]) for node, path in _walk(root) if not node.prose]
    found = [x for x in found if x[2] < x[3]]
    if not found:
        return []
    at = np.array([x[2:] for x in found])
    values = Words([" ".join(words).encode()]).ranges(at[:, 0], at[:, 1]).view(np.int64)
    return [(node, path, value) for (node, path, *_), value in zip(found, values.tolist(), strict=True)]


def _overcut(root: Node, low: list[Node]) -> set[int]:
    """Of the branches in low those that, together, are more than half of the text of the article or main nearest to them."""
    inside: dict[int, tuple[Node, list[Node]]] = {}
    for node in low:
        if node.core:
            inside.setdefault(id(node.within), (node.within, []))[1].append(node)
    if not inside:
        return set()
    words, spans = _spans(root, lambda node: node.dropped)
    size = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).astype(int)  # with the space behind it
    found: set[int] = set()
    for core, own in inside.values():
        begin, end = spans[id(core)]
        cut, done = 0, begin
        for a, b in sorted(spans[id(n)] for n in own):
            if b > done:
                cut, done = cut + size[b] - size[max(a, done)], b
        whole = size[end] - size[begin]
        if 2 * max(whole - cut - 1, 0) < max(whole - 1, 0):
            found |= {id(n) for n in own}
    return found


PRESENT, STYLE, CONTENT = 0, 1, 2
FEATURES = "host string, path long, kind int, value long"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FEATURES.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root = parse(page or "")
            seen = {(path, CONTENT, value) for _, path, value in _removable(root)}
            for node, path in _walk(root):
                seen.add((path, PRESENT, 0))
                style = [c.tag for c in node.children if isinstance(c, Node)]
                runs = [t for i, t in enumerate(style) if not i or style[i - 1] != t]
                seen.add((path, STYLE, _hash(" ".join(runs))))
            rows += ((host, *x) for x in seen)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=names)


BRANCHES = "page_id long, page_key long, host string, path long, value long"


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The removable branches of each page."""
    names = [f.split()[0] for f in BRANCHES.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for page_id, key, host, page in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            found = {(path, value) for _, path, value in _removable(parse(page or ""))}
            rows += ((page_id, key, host, *x) for x in found)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=names)


def style_tree(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The low-importance contents of each host's style tree: (host, path, value, importance)."""
    rows = pages.mapInArrow(_features, FEATURES)
    merged = stored(rows.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n")), "style-tree")
    total = merged.where(F.col("kind") == STYLE).groupBy("host", "path").agg(F.sum("n").alias("total"), F.count("*").alias("styles"))
    # entropy = log(total) - sum(n log n) / total, so no second look at the styles is needed
    spread = merged.where(F.col("kind") == STYLE).groupBy("host", "path").agg(F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    pages_at = merged.where((F.col("kind") == PRESENT) & (F.col("n") >= max(least_pages, 2))).select("host", "path", F.col("n").alias("m"))
    node = pages_at.join(total, ["host", "path"]).join(spread, ["host", "path"])
    node = node.withColumn("p", F.greatest(F.lit(0.0), (F.log("total") - F.col("nlogn") / F.col("total")) / F.log("m"))).select("host", "path", "m", "styles", "p")
    shared = merged.where((F.col("kind") == CONTENT) & (F.col("n") > 1)).select("host", "path", "value", "n")
    weight = F.pow(F.lit(GAMMA), F.col("styles"))
    importance = (1 - weight) * F.col("p") + weight * (1 - F.log("n") / F.log("m"))
    return shared.join(stored(node, "style-nodes"), ["host", "path"]).withColumn("importance", importance).where(F.col("importance") < LOW).select("host", "path", "value", "importance")


def main_text(page: str, noise: set[tuple[int, int]]) -> str:
    """The text of what is left of a page: inside its articles, else its main part, else its body."""
    root = parse(page)
    gone: set[int] = set()
    if noise:
        low = [node for node, path, value in _removable(root) if (path, value) in noise]
        gone = {id(node) for node in low} - _overcut(root, low)
    cut = lambda node: node.dropped or id(node) in gone

    def cores(tag: str) -> list[Node]:
        """The outermost elements of a tag."""
        found, ahead = [], [root]
        while ahead:
            node = ahead.pop()
            if node.tag == tag:
                found.append(node)
            else:
                ahead += [c for c in reversed(node.children) if isinstance(c, Node) and not cut(c)]
        return found

    return _gather(cores("article") or cores("main") or [root], cut)


RESULT = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, noise in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            texts.append(main_text(page or "", {(x["path"], x["value"]) for x in noise or ()}))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    White space inside a block becomes one space; blocks are joined in page
    order by one space. Null or empty html: empty text. Pages of any length are
    read whole, however deep their elements nest and whatever quotes they leave
    open, in time by their length. Nodes that fewer than ``least_pages`` pages of
    a host have (two at least) are left to HTML's own marks. A null url has the host ''. Repeated rows are pages like others.
    Other columns are ignored. No rows give no rows.
    """
    bounded(pages.sparkSession)
    html_of = F.col("html").cast("string")
    base = pages.select("page_id", "url", html_of.alias("html"), host_of(F.col("url")).alias("host"), F.xxhash64("url", html_of).alias("page_key"))
    low = stored(style_tree(base.select("host", "html"), least_pages).select("host", "path", "value"), "low")
    if low.isEmpty():
        return base.select("page_id", "url", "html", F.lit(None).cast("array<struct<path:bigint,value:bigint>>").alias("noise")).mapInArrow(_extract, RESULT)
    own = base.select("page_id", "page_key", "host", "html").mapInArrow(_branches, BRANCHES)
    noise = own.join(low, ["host", "path", "value"]).groupBy("page_id", "page_key").agg(F.collect_set(F.struct("path", "value")).alias("noise"))
    met = (F.col("page_id").eqNullSafe(F.col("of_id"))) & (F.col("page_key") == F.col("of_key"))
    noise = stored(noise.select(F.col("page_id").alias("of_id"), F.col("page_key").alias("of_key"), "noise"), "noise")
    return base.join(noise, met, "left").select("page_id", "url", "html", "noise").mapInArrow(_extract, RESULT)
