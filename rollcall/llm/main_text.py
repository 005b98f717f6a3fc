"""Main text of web pages.

A page becomes a flat list of text blocks. Each is described by its words and
links, by those of its neighbours and by what it stands in, and a decision
tree, trained on the labelled table below, says which blocks are the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.trees import Tree, decide

#: A tag; a quotation mark after "=" opens a value that may hold ">".
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTR = re.compile(r"""\b(class|id|role|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

# Elements by their part in a page.
SILENT = set("script style noscript template title svg math iframe object canvas audio video".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select "
             "summary table tbody td textarea tfoot th thead tr ul button".split())
_ENDS = {name: re.compile(f"</{name}\\b", re.I) for name in SILENT}
HOLDERS = BLOCKS - set("p h1 h2 h3 h4 h5 h6 hr li dt dd td th tr body html option".split())

# What class names, ids and roles call the parts of a page.
KINDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip".split(),
    "header": "header masthead banner topbar logo".split(),
    "footer": "footer contentinfo copyright colophon bottom".split(),
    "side": "aside sidebar side complementary widget widgets related recommended trending rail social share sharing tags".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal dialog overlay newsletter subscribe paywall warning toast".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense adbox".split(),
    "form": "form search login signup register contact".split(),
    "comment": "comment comments commentlist disqus reply replies respond discussion".split(),
    "article": "article main post entry story".split(),
}
_KIND_OF = {w: k for k, words in KINDS.items() for w in words}
_ELEMENT = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form",
            "fieldset": "form", "select": "form", "textarea": "form", "button": "form", "dialog": "notice", "article": "article",
            "main": "article"}
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "item", "within",
            *KINDS, "hidden", "apart"]
_APART = frozenset(KINDS) - {"article", "header"} | {"hidden"}
#: Parts whose name may stand on an element that wraps the whole page.
_WRAPS = _APART - {"hidden"}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    tag: str
    kinds: frozenset = frozenset()
    holder: int = -1


class Holders:
    """All elements that hold blocks, by number: parent (-1: none), kinds, and which are open."""

    def __init__(self):
        self.parent: list[int] = []
        self.kinds: list[frozenset] = []
        self.open: list[tuple[str, int]] = []
        self.at: dict[str, list[int]] = {}  # places in ``open``, by name

    def start(self, name: str, kinds: frozenset) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, len(self.parent)))
        self.parent.append(self.open[-2][1] if len(self.open) > 1 else -1)
        self.kinds.append(kinds)

    def end(self, name: str) -> None:
        """Close the last open element of that name, and all in it."""
        if not self.at.get(name):
            return
        for inner, _ in reversed(self.open[self.at[name][-1]:]):
            self.at[inner].pop()
            self.open.pop()

    def now(self) -> int:
        return self.open[-1][1] if self.open else -1


def kinds_of(name: str, attributes: str) -> frozenset:
    """The parts of a page that an element names."""
    found = {_ELEMENT[name]} if name in _ELEMENT else set()
    if attributes:
        for key, *value in _ATTR.findall(attributes):
            if key.lower() != "style":
                found |= {_KIND_OF[w] for w in re.split("[^a-z]+", "".join(value).lower()) if w in _KIND_OF}
        if _HIDDEN.search(attributes):
            found.add("hidden")
    return frozenset(found)


@lru_cache(maxsize=4096)
def _kinds(name: str, attributes: str) -> frozenset:
    return kinds_of(name, attributes)


class Tags:
    """The tags of a page from any place on.

    Each character is looked at a bounded number of times: where no ">" follows
    there are no more tags, and once a value is found never to close, no later
    quotation mark is believed.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quoted = page, page.rfind(">"), True

    def next(self, pos: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name, attributes) of the next one; comments and declarations have no name."""
        page = self.page
        while (start := page.find("<", pos)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, False, "", ""
            if start > self.last:
                return None
            m = _TAG.match(page, start) if self.quoted else None
            if m:
                return start, m.end(), bool(m[1]), m[2], m[3]
            if m := _NAME.match(page, start):
                self.quoted, end = False, page.find(">", m.end())
                return (start, end + 1, bool(m[1]), m[2], page[m.end():end]) if end >= 0 else None
            if page[start + 1] in "!?/":
                return start, page.find(">", start) + 1, False, "", ""
            pos = start + 1
        return None


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    holders = Holders()
    missing: set[str] = set()  # elements without a further end tag
    texts: list[str] = []
    links: list[str] = []
    tag, own, in_link, pos = "body", frozenset(), False, 0

    def flush():
        if texts:
            words = html.unescape("".join(texts)).split()
            if words:
                linked = len(html.unescape("".join(links)).split())
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), tag, own, holders.now()))
            texts.clear()
            links.clear()

    tags = Tags(page)
    while found := tags.next(pos):
        start, end, close, name, attributes = found
        if start > pos:
            texts.append(page[pos:start])
            if in_link:
                links.append(page[pos:start])
        pos, name = end, name.lower()
        if not name:
            continue
        if name in SILENT:
            if not close and not attributes.endswith("/") and name not in missing:
                stop = _ENDS[name].search(page, pos)
                if stop:
                    pos = page.find(">", stop.end()) + 1 or len(page)
                elif name in ("script", "style"):  # code to the end of the page
                    pos = len(page)
                else:
                    missing.add(name)
            texts.append(" ")
        elif name == "a":
            in_link = not close
        elif name == "br":
            texts.append(" ")
        elif name in BLOCKS:
            flush()
            own, in_link = frozenset(), False
            if name in HOLDERS:
                if close:
                    holders.end(name)
                else:
                    holders.start(name, _kinds(name, attributes))
            elif not close:
                own = _kinds(name, attributes)
            tag = "body" if close else name
    if pos < len(page):
        texts.append(page[pos:])
        if in_link:
            links.append(page[pos:])
    flush()
    _name_parts(out, holders)
    return out


def _name_parts(blocks: list[Block], holders: Holders) -> None:
    """Gives blocks the kinds of what they stand in: one pass up the elements, one down.

    An element that holds most of the page's words without a link, and in it an
    article or the first heading, wraps the page: that its name also speaks of
    a form or a sidebar says nothing of its blocks.
    """
    n = len(holders.parent)
    words, leads = [0] * n, ["article" in k for k in holders.kinds]
    for b in blocks:
        if b.holder >= 0:
            words[b.holder] += b.words - b.linked
            leads[b.holder] = leads[b.holder] or b.tag == "h1" or "article" in b.kinds
    for i in range(n - 1, -1, -1):
        if (up := holders.parent[i]) >= 0:
            words[up] += words[i]
            leads[up] = leads[up] or leads[i]
    whole = sum(b.words - b.linked for b in blocks)
    named: list[frozenset] = []
    for i, kinds in enumerate(holders.kinds):
        kinds = kinds - _WRAPS if leads[i] and 2 * words[i] > whole else kinds
        outer = named[holders.parent[i]] if holders.parent[i] >= 0 else frozenset()
        named.append(outer | kinds if kinds - outer else outer)
    for b in blocks:
        if b.holder >= 0:
            b.kinds = b.kinds | named[b.holder]


def features(blocks: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` per block."""
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.linked / b.words for b in blocks])
    pad = lambda x, a, b: np.concatenate([[0.0] * a, x, [0.0] * b])
    n = len(blocks)
    held = any("article" in b.kinds for b in blocks)
    flags = np.array([[b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag in ("li", "dt", "dd", "option"), held,
                       *(k in b.kinds for k in KINDS), "hidden" in b.kinds, bool(b.kinds & _APART)] for b in blocks], float).reshape(n, -1)
    around = [words, links, pad(words, 1, 0)[:n], pad(links, 1, 0)[:n], pad(words, 0, 1)[1:], pad(links, 0, 1)[1:]]
    return np.column_stack([*around, flags])


# The labelled table, as whole pages: the parts of a page in their order, and the blocks of a part, in order too. A part
# has its kinds (none: -), whether it is article, and blocks of a tag, least and most words, least and most share of
# linked words, and how often they come, least and most. Parts in brackets stand inside the article.
PARTS = """
menu: menu no; li 1-4 1-1 3-12
brand: header no; div 1-5 0-1 1-1, p 2-9 0-0 0-1
site: header no; h1 1-4 0-1 1-1
crumbs: menu no; li 1-4 1-1 2-4
cookies: notice no; div 5-30 0-0.2 1-1
banner: advert no; div 2-20 0.6-1 1-2
title: - yes; h1 3-14 0-0 1-1
intro: - yes; p 15-60 0-0.1 1-1
story: - yes; p 12-200 0-0.3 1-4, p 1-11 0-0 0-1, p 12-200 0-0.3 1-3
chapter: - yes; h2 1-10 0-0 1-1, p 12-200 0-0.3 1-4
points: - yes; p 8-40 0-0 1-1, li 2-25 0-0.2 2-6, p 12-90 0-0.2 1-1
figures: - yes; td 1-9 0-0 2-12, p 12-90 0-0.2 1-1
quote: - yes; div 5-60 0-0 1-1, p 12-90 0-0.2 1-1
[offer]: advert no; div 2-60 0-1 1-2
[join]: form no; div 1-9 0-0 1-2, p 3-30 0-0 0-1
[more]: side no; h2 1-4 0-0 1-1, li 3-12 1-1 2-5
[talk]: comment no; h2 1-3 0-0 1-1, p 3-120 0-0.1 1-6
[ask]: notice no; p 5-60 0-0.2 1-2
[off]: hidden no; p 3-90 0-0.2 1-1
share: side no; li 1-3 1-1 2-5
rail: side no; h2 1-4 0-0 1-1, li 2-12 1-1 3-8, p 5-60 0-0.2 0-2
replies: comment no; h2 1-3 0-0 1-1, p 3-120 0-0.1 1-6
search: form no; div 1-6 0-0 1-2
links: - no; h3 1-3 0-0 1-1, li 2-12 1-1 3-9
foot: footer no; p 3-25 0-0.4 1-2, li 1-3 1-1 2-6
"""
TOP, TAIL = "menu brand site crumbs cookies banner search".split(), "share rail links replies banner search foot".split()
BODY, ASIDE = "story chapter points figures quote".split(), "[offer] [join] [more] [talk] [ask] [off]".split()
#: Parts of pages whose names tell nothing: what their words and links, and those of their neighbours, give away.
PLAIN_TOP, PLAIN_TAIL = "menu crumbs banner".split(), "share links banner foot".split()


def _part_table() -> dict[str, tuple[frozenset, bool, list[list[str]]]]:
    out = {}
    for line in PARTS.strip().splitlines():
        name, rest = line.split(": ", 1)
        about, made = rest.split("; ")
        kinds, label = about.split()
        out[name] = (frozenset() if kinds == "-" else frozenset([kinds]), label == "yes", [b.split() for b in made.split(", ")])
    return out


def labelled_page(r: np.random.Generator, named: bool, held: bool) -> tuple[list[Block], list[bool]]:
    """A made-up page: its parts in order, with names or without, its article an element of its own or not."""
    table = _part_table()
    some = lambda names, share: [n for n in names if r.random() < share]
    core = ["title"] * (r.random() < 0.9) + ["intro"] * (r.random() < 0.3) + [str(v) for v in r.choice(BODY, size=r.integers(1, 6))]
    if named:
        for extra in some(ASIDE, 0.25):
            core.insert(int(r.integers(len(core) + 1)), extra)
    if r.random() < 0.1:  # a page with nothing beside its text
        top, tail = [], []
    else:
        top, tail = some(TOP if named else PLAIN_TOP, 0.6), some(TAIL if named else PLAIN_TAIL, 0.6)
    blocks, labels = [], []
    for place, part in [*((0, p) for p in top), *((1, p) for p in core), *((2, p) for p in tail)]:
        kinds, label, made = table[part]
        kinds = kinds if named else frozenset()
        if place == 1 and held:
            kinds = kinds | {"article"}
        for tag, words, links, times in made:
            (w0, w1), (l0, l1), (t0, t1) = (tuple(map(float, x.split("-"))) for x in (words, links, times))
            for _ in range(int(r.integers(t0, t1 + 1))):
                n = int(round(w0 * (w1 / w0) ** r.random()))
                share = l0 if l0 == l1 else l0 + (l1 - l0) * r.random() * (l0 > 0 or r.random() < 0.4)  # most blocks hold few links
                blocks.append(Block("", n, min(n, round(n * share)), tag, kinds))
                labels.append(label)
    return blocks, labels


def labelled_table(pages: int = 900, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages, in order, the same on every call.

    Of every six pages two name their parts and have an article element, two
    name their parts alone, one has the element alone and one has neither.
    """
    r, x, y = np.random.default_rng(seed), [], []
    for page in range(pages):
        blocks, labels = labelled_page(r, page % 6 < 4, page % 6 in (0, 1, 4))
        if blocks:
            x.append(features(blocks))
            y += labels
    return np.concatenate(x), np.array(y, float)


@lru_cache(maxsize=1)
def block_tree() -> Tree:
    return decide(*labelled_table(), depth=9)


def main_text(page: str | None, tree: Tree) -> str:
    """The blocks that the tree takes for the article, joined by blank lines."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    keep = tree.predict(features(blocks)) > 0
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def _extract(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree.value) for p in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    White space inside a block becomes one space. A null or blank page, or one
    without an article, has the empty text; pages of any length, depth and
    disorder are read whole, in time that grows with their length; repeated rows
    are kept, null ids and urls too; other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    tree = pages.sparkSession.sparkContext.broadcast(block_tree())
    return pages.mapInArrow(_extract(tree), "page_id long, url string, text string, n_chars long")
