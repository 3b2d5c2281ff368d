"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block tags. A block's features are its words and link density, those of the blocks
before and after it, and what its closest telling container says: article or boilerplate. A decision tree (Gini, grown
here) is fitted on the small labelled table below.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from stemma.llm.common import bound_arrow

#: Markup, as a browser cuts it: what isn't closed runs to the end, so that each character is looked at once.
_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)
      | <(?P<raw>script|style|textarea|title|noscript|iframe|template|svg|math|select|object|noframes|noembed|xmp)\b
        (?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+ (?:/>|>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)|\Z)
      | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)
      | <[!?/][^>]*(?:>|\Z)
      | (?P<text>[^<]+|<)""",
    re.S | re.I | re.X,
)
#: One attribute after the other, so that nothing inside a value or a longer name is taken for a name.
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")

# HTML's own element names by what they do here, and names that sites commonly give containers.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CHROME_NAMES = frozenset(
    "nav navbar navigation menu sidebar side aside ad ads adv advert advertisement advertising banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice alert popup modal overlay comment comments disqus replies reply respond footer header masthead "
    "topbar breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe subscription signup login search "
    "pagination pager widget toolbar copyright legal disclaimer form tags toc skip complementary contentinfo search".split()
)
HIDDEN_NAMES = frozenset("hidden visually-hidden sr-only screen-reader-text screen-reader-only d-none is-hidden u-hidden".split())
OTHERS_NAMES = frozenset("comment comments disqus reply replies respond".split())
MAIN_NAMES = frozenset("article content main post entry story body text articlebody".split())


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    hint: int = 0
    heading: int = 0

    def close(self) -> None:
        self.text = " ".join(entities.unescape("".join(self.parts)).split())
        self.words = len(self.text.split())
        self.density = min(1.0, self.linked / self.words) if self.words else 0.0


def attributes(attrs: str):
    """name, value of each attribute, names in lower case."""
    for m in _ATTR.finditer(attrs):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""


def hides(attrs: str) -> bool:
    """Whether an element is not shown."""
    for name, value in attributes(attrs):
        if name in ("hidden", "aria-hidden"):
            if value.lower() not in ("false", "no", "until-found") and (name == "hidden" or value.lower() == "true"):
                return True
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name == "class" and not HIDDEN_NAMES.isdisjoint(value.lower().split()):
            return True
    return False


def hint_of(tag: str, attrs: str, inside: int) -> int | None:
    """1: an article begins; -1: boilerplate begins; -2: boilerplate in which no article begins; None: the element says nothing.

    A page's header, footer and the like are boilerplate. In an article, its header isn't; its footer and the rest are.
    """
    if hides(attrs):
        return -1
    names: set[str] = set()
    both: set[int] = set()
    for name, value in attributes(attrs):
        if name in ("class", "id", "role"):
            for token in value.split():
                # what a class says of its surroundings or a state, and how boxes overflow, names no part of a page
                if not re.match(r"(?:has|with|no|is|overflow|backface)[-_]", token):
                    own = {x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", token)}
                    names |= own
                    both |= {-1} if own & CHROME_NAMES else {1} if own & MAIN_NAMES else set()
    if names & OTHERS_NAMES:
        return -2
    if tag == "form":  # some pages are a form as a whole: it says little of what is inside an article's elements
        return -1
    if tag in CHROME_TAGS:
        return None if tag == "header" and inside == 1 else -2
    if tag in MAIN_TAGS:
        return 1 if inside > -2 else None
    if len(both) == 2 and tag not in ("body", "html") and inside >= 0:  # one name says this, one that: words and links decide
        return 0
    if names & CHROME_NAMES and tag != "body":
        return None if inside == 1 and not names & (CHROME_NAMES - {"header", "text", "tags", "side"}) else -1
    if names & MAIN_NAMES and tag not in ("body", "html"):
        return 1 if inside >= 0 else None
    return None


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page that have words, closed."""
    out, now = [], Block()
    stack: list[tuple[str, int]] = []  # elements that aren't inline, each with the hint that holds inside
    depth: Counter[str] = Counter()
    linked = head = 0
    unseen: list[str] = []  # inline elements inside one that isn't shown, that one first

    def begin() -> None:
        nonlocal now
        now.close()
        if now.words:
            out.append(now)
        now = Block(hint=stack[-1][1] if stack else 0, heading=head)

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            if not depth["head"] and not unseen:
                now.parts.append(text)
                if linked:
                    now.linked += len(text.split())
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if unseen and (tag not in INLINE and tag not in VOID):
            unseen.clear()  # never closed: it ends at the next block
        if unseen and tag in INLINE:
            if not m["end"]:
                unseen.append(tag)
            elif tag in unseen:
                while unseen.pop() != tag:
                    pass
            continue
        if tag in INLINE and not m["end"] and hides(m["attrs"]):
            unseen.append(tag)
            continue
        if m["end"]:
            if tag == "a":
                linked = 0
            elif tag not in INLINE and tag not in VOID:
                if depth[tag]:
                    while True:
                        top, _ = stack.pop()
                        depth[top] -= 1
                        if top == tag:
                            break
                if tag in HEADINGS:
                    head = 0
                begin()
        elif tag == "a":
            linked = 1
        elif tag in INLINE:
            continue
        elif tag == "br":
            now.parts.append(" ")
        elif tag in VOID:
            if tag == "hr":
                begin()
        else:
            if tag == "body" and depth["head"]:  # a head that isn't closed ends here
                while depth["head"]:
                    depth[stack.pop()[0]] -= 1
            if stack and (stack[-1][0] == "p" or stack[-1][0] == tag == "li"):  # a paragraph that isn't closed ends at the next block
                depth[stack.pop()[0]] -= 1
            inside = stack[-1][1] if stack else 0
            says = hint_of(tag, m["attrs"], inside)
            hint = inside if says is None else says
            if tag in HEADINGS:
                head, linked = 1, 0
            stack.append((tag, hint))
            depth[tag] += 1
            begin()
            now.heading = head
    begin()
    return out


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """Words and link density of each block and of its neighbours (0 beyond the ends), hint, heading."""
    own = [(b.words, b.density) for b in found]
    edge = [(0, 0.0), *own, (0, 0.0)]
    return [(*edge[k + 1], *edge[k], *edge[k + 2], max(b.hint, -1), b.heading) for k, b in enumerate(found)]


#: The labelled table: pages as lists of blocks (words, link density, hint, heading, article or not), in page order.
LABELLED = [
    [(6, 1.0, -1, 0, 0), (12, 0.0, -1, 0, 0), (9, 0.0, 1, 1, 1), (80, 0.0, 1, 0, 1), (4, 0.0, 1, 0, 1), (25, 0.1, 1, 0, 1), (10, 0.0, -1, 0, 0)],
    [(1, 1.0, -1, 0, 0), (2, 0.0, 1, 1, 1), (2, 0.0, 1, 0, 1), (45, 0.0, -1, 0, 0), (8, 0.2, -1, 0, 0)],
    [(3, 0.0, 1, 1, 1), (14, 1.0, 1, 0, 1), (60, 0.0, -1, 0, 0), (120, 0.0, -1, 0, 0), (5, 1.0, -1, 0, 0)],
    [(5, 1.0, 0, 0, 0), (7, 1.0, 0, 0, 0), (8, 0.0, 0, 1, 1), (70, 0.0, 0, 0, 1), (55, 0.05, 0, 0, 1), (6, 0.0, 0, 1, 1), (90, 0.0, 0, 0, 1), (9, 0.9, 0, 0, 0), (6, 0.0, 0, 0, 0)],
    [(8, 0.0, 0, 0, 0), (2, 1.0, 1, 0, 1), (1, 1.0, 1, 1, 1), (11, 1.0, 1, 0, 1), (3, 0.0, 1, 0, 1), (7, 0.5, 1, 0, 1), (18, 0.0, -1, 0, 0), (9, 0.0, 0, 0, 0)],
    [(15, 1.0, 0, 0, 0), (1, 0.0, 1, 0, 1), (33, 0.9, 1, 0, 1), (6, 0.4, 1, 0, 1), (200, 0.0, -1, 0, 0), (2, 0.0, 1, 0, 1), (5, 0.0, 0, 0, 0)],
    [(3, 0.5, 0, 0, 0), (4, 1.0, 1, 1, 1), (5, 0.6, 1, 0, 1), (2, 1.0, 1, 0, 1), (1, 0.0, 1, 0, 1), (4, 1.0, 0, 0, 0)],
    [(40, 0.0, -1, 0, 0), (90, 0.0, -1, 0, 0), (28, 0.0, -1, 0, 0), (75, 0.0, -1, 0, 0), (55, 0.0, -1, 0, 0), (300, 0.0, -1, 0, 0), (65, 0.0, 1, 0, 1)],
    [(110, 0.0, 0, 0, 1), (34, 0.0, -1, 0, 0), (85, 0.0, -1, 0, 0), (50, 0.0, -1, 0, 0), (95, 0.0, 0, 0, 1)],
    [(2, 1.0, 0, 0, 0), (60, 0.0, 0, 0, 1), (45, 0.1, 0, 0, 1), (9, 1.0, 0, 0, 0)],
    [(3, 0.9, 0, 0, 0), (12, 0.8, 0, 0, 0), (7, 0.0, 0, 1, 1), (52, 0.0, 0, 0, 1), (38, 0.2, 0, 0, 1), (4, 0.6, 0, 0, 0), (10, 0.7, 0, 0, 0)],
    [(16, 0.7, 0, 0, 0), (64, 0.0, 0, 0, 1), (40, 0.5, 0, 0, 0), (5, 1.0, 0, 0, 0)],
    [(50, 0.0, 0, 0, 1)],
    [(46, 0.0, 0, 0, 1)],
    [(30, 0.8, 0, 0, 0), (20, 0.6, 0, 0, 0), (40, 0.0, 0, 0, 1), (14, 0.0, 0, 0, 1), (35, 0.1, 0, 0, 1), (4, 0.0, 0, 0, 0), (3, 0.7, 0, 0, 0)],
]


@dataclass
class Tree:
    label: int
    column: int = -1
    bound: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def says(self, row: tuple[float, ...]) -> int:
        node = self
        while node.low is not None:
            node = node.low if row[node.column] <= node.bound else node.high
        return node.label


def grow(rows: list[tuple[float, ...]], labels: list[int], depth: int = 5) -> Tree:
    """A binary tree by Gini impurity; ties go to the first column and the lowest bound."""
    n, ones = len(labels), sum(labels)
    node = Tree(int(2 * ones >= n))
    if depth == 0 or ones in (0, n):
        return node
    best = (n * 2 * (ones / n) * (1 - ones / n) - 1e-9, -1, 0.0)
    for c in range(len(rows[0])):
        values = sorted({r[c] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            bound, cost = (a + b) / 2, 0.0
            for side in (True, False):
                own = [y for r, y in zip(rows, labels, strict=True) if (r[c] <= bound) == side]
                p = sum(own) / len(own)
                cost += 2 * len(own) * p * (1 - p)
            if cost < best[0]:
                best = (cost, c, bound)
    if best[1] < 0:
        return node
    node.column, node.bound = best[1:]
    for name, side in (("low", True), ("high", False)):
        own = [(r, y) for r, y in zip(rows, labels, strict=True) if (r[node.column] <= node.bound) == side]
        setattr(node, name, grow([r for r, _ in own], [y for _, y in own], depth - 1))
    return node


@cache
def tree() -> Tree:
    rows, labels = [], []
    for page in LABELLED:
        found = []
        for words, density, hint, heading, label in page:
            b = Block(hint=hint, heading=heading)
            b.words, b.density = words, density
            found.append(b)
            labels.append(label)
        rows += features(found)
    return grow(rows, labels)


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify = tree().says
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if classify(row))


def extract_batches(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text (of the blocks the tree takes, joined by blanks), n_chars (code points).

    A null or empty page, and one of markup alone, has the empty text. Nulls in other columns stay; repeated rows give
    a row each; columns beyond page_id, url and html are ignored; an empty table gives an empty result. A map without a shuffle.
    """
    bound_arrow(pages.sparkSession)
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(extract_batches, "page_id long, url string, text string, n_chars long")
