"""Main text of web pages by composite text density.

A page becomes a tree of its block elements, links and marked elements; inline formatting only passes
its text on. Elements that by their tag, role, class or id are menus, headers, footers, sidebars,
notices, adverts, forms or reader comments are cut first. Of what is left every node has
    density = C / T * log_b(C / L * T / M),   b = ln(C / (C - L) * L + L_body / C_body * C + e)
with C characters, T tags (blocks and links), L characters in links and M links of its subtree (each at
least 1): characters per tag, less where they are links. The node whose children's densities have
the largest sum is the core (of equals the outermost); the least density on its path from the body is
the threshold. The article is the outermost article (or else main) element around the core with other
such elements at or above the threshold; without one, the core's subtree, widened while less than a
third of what is added are links, and every block beside it at or above the threshold. A title (h1)
ahead of an article that has none belongs to it. Lists of hardly anything but links are left out as menus.

Text is cut into blocks where a block element starts or ends. In a block all white space becomes
one space; a line break is white space; cells of a table row belong to one block.

Defined cases: null and empty pages, and pages whose text is all cut, give an empty text with 0
characters; plain text without tags is one block; very long and very deep pages are parsed whole in one
pass; elements that are never closed end with their parent, a tag without its end is text; of equal
sums the first and outermost node is taken; repeated rows each get their text; an empty table gives an
empty result; other columns are carried or not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import map_texts, read

# Kinds of elements in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
INLINE = frozenset(
    "abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of the second set, unless one of the third lies between.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "a": (frozenset(["a"]), frozenset("table td th caption".split())),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
HEAD = (frozenset(["head"]), frozenset())
PARAGRAPH = (frozenset(["p"]), frozenset("button caption object table td th".split()))
# Tags, roles and words of class and id names that mark what is no article text.
CUT_TAGS = frozenset(
    "script style noscript template iframe object embed applet canvas svg math audio video map textarea select button datalist input"
    " form nav aside footer header menu dialog head title xmp noembed noframes".split()
)
CUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion"
    " nav navbar navigation menu breadcrumb breadcrumbs pagination pager"
    " header masthead topbar footer copyright colophon"
    " sidebar aside rail widget widgets related recommended recommendations trending"
    " notice notices cookie cookies consent gdpr alert popup modal overlay paywall newsletter subscribe subscription"
    " comment comments disqus replies respond"
    " share sharing social login signup searchform".split()
)
#: First words of a name that speak of what an element has or lacks, not of what it is.
OTHERS = frozenset("has have with without no is".split())
#: Kept whatever their marks.
ROOTS = frozenset(["html", "body", "main"])
#: Elements left out of an article if they hold nothing but links.
MENUS = frozenset("ul ol dl div section table menu dir".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*>"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
MARKS = re.compile(r"(?:^|[\s/\"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s/]|$))", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE)


RAW_ENDS = {tag: raw_end(tag) for tag in RAW}


def marked(attributes: str) -> bool:
    """Whether an element's role, class or id says that it is no article text, or it is hidden."""
    for name, value in MARKS.findall(attributes):
        value = value.strip("\"'")
        kind = name.lower()
        if kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true"):
            return True
        if kind == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
        if kind == "role" and value.lower() in CUT_ROLES:
            return True
        if kind in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in PARTS.findall(word)]
                if parts and parts[0] not in OTHERS and (parts[0] in CUT_WORDS or parts[-1] in CUT_WORDS):
                    return True
    return False


class Page:
    """A page's tree: nodes in page order (0 is the page itself) and the flow of their texts and breaks."""

    def __init__(self, html: str):
        self.parent, self.tag, self.cut = [-1], ["body"], [0]  # cut: 1 by its marks, 2 by its kind
        self.flow: list[tuple[int, str | None]] = []  # (node, text), None: a block starts or ends
        self.open: list[tuple[str, int]] = []  # open elements: tag, node
        self.count: dict[str, int] = {}
        self.parse(html)

    def node(self) -> int:
        return self.open[-1][1] if self.open else 0

    def pop(self) -> None:
        tag, _ = self.open.pop()
        self.count[tag] -= 1
        if tag in BLOCKS:
            self.flow.append((self.node(), None))

    def close(self, wanted: frozenset[str], within: frozenset[str]) -> None:
        """End the innermost open element of `wanted` and all inside it, if none of `within` lies in between."""
        if not any(self.count.get(t) for t in wanted):
            return
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k][0]
            if tag in wanted:
                while len(self.open) > k:
                    self.pop()
                return
            if tag in within:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.close(*PARAGRAPH)
            self.close(*HEAD)
        if tag in ENDS:
            self.close(*ENDS[tag])
        above = self.node()
        if tag in BLOCKS:
            self.flow.append((above, None))
        elif tag in SPACED:
            self.flow.append((above, " "))
        if tag in VOID:
            return
        own = above
        cut = 1 if tag == "form" else 2 if tag in CUT_TAGS else int(bool(attributes) and tag not in ROOTS and marked(attributes))
        if cut or tag not in INLINE:
            own = len(self.parent)
            self.parent.append(above)
            self.tag.append(tag)
            self.cut.append(cut)
        self.open.append((tag, own))
        self.count[tag] = self.count.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if self.count.get(tag):
            while self.open[-1][0] != tag:
                self.pop()
            self.pop()

    def text(self, text: str) -> None:
        if text:
            self.flow.append((self.node(), unescape(text) if "&" in text else text))

    def parse(self, html: str) -> None:
        at = 0
        while (found := TOKEN.search(html, at)) is not None:
            self.text(html[at : found.start()])
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if found[1] or found[4]:
                self.end(tag)
                continue
            attributes = found[3] or found[6] or ""
            self.start(tag, attributes)
            if tag in RAW:
                closed = RAW_ENDS[tag].search(html, at)
                at = closed.end() if closed else len(html)
                self.end(tag)
        self.text(html[at:])


def density(chars: int, tags: int, link_chars: int, links: int, share: float) -> float:
    """Composite text density of a subtree's counts; share: characters in links of the whole page's."""
    if chars <= 0:
        return 0.0
    lc, ratio = max(1, link_chars), max(1, tags) / max(1, links)
    base = math.log(chars / max(1, chars - link_chars) * lc + share * chars + math.e)
    return chars / max(1, tags) * max(0.0, math.log(max(1.0, chars / lc * ratio)) / math.log(base))


class Counts:
    """Subtree counts and densities of a page's nodes, without those that are cut."""

    def __init__(self, page: Page):
        size, parent, tag = len(page.parent), page.parent, page.tag
        self.gone = gone = cut_nodes(page)
        linked = [False] * size
        own, own_links = [0] * size, [0] * size
        for k in range(1, size):
            linked[k] = linked[parent[k]] or tag[k] == "a"
        for k, text in page.flow:
            if text is not None and not gone[k]:
                n = len(text.strip())
                own[k] += n
                own_links[k] += n * linked[k]
        self.chars, self.link_chars = own[:], own_links[:]
        self.tags, self.links = [0] * size, [int(t == "a") for t in tag]
        for k in range(size - 1, 0, -1):
            if not gone[k]:
                for sums, add in ((self.chars, 0), (self.link_chars, 0), (self.tags, int(tag[k] in BLOCKS or tag[k] == "a")), (self.links, 0)):
                    sums[parent[k]] += sums[k] + add
        share = self.link_chars[0] / max(1, self.chars[0])
        counts = zip(self.chars, self.tags, self.link_chars, self.links, strict=True)
        self.density = [density(*c, share) for c in counts]
        #: Sum of the children's densities; text right in a node is a child of its own, in links one of density 0.
        self.total = [density(n - m, 1, 0, 0, share) for n, m in zip(own, own_links, strict=True)]
        for k in range(size - 1, 0, -1):
            if not gone[k]:
                self.total[parent[k]] += self.density[k]


def cut_nodes(page: Page) -> list[bool]:
    """Which nodes are in a subtree that is no article text by its kind or marks.

    A form or a marked element that holds an article or main element of its own is kept (a page's frame),
    and so is an article's own header with its title.
    """
    size, parent, tag = len(page.parent), page.parent, page.tag
    holds, headed, inside = [False] * size, [False] * size, [False] * size
    for k in range(size - 1, 0, -1):
        own = tag[k] in ("article", "main") and not page.cut[k]
        holds[parent[k]] |= own or (holds[k] and page.cut[k] < 2)
        headed[parent[k]] |= headed[k] or tag[k] in HEADINGS
    gone = [False] * size
    for k in range(1, size):
        inside[k] = inside[parent[k]] or tag[k] in ("article", "main")
        cut = page.cut[k] == 2 or (page.cut[k] == 1 and not holds[k])
        if tag[k] == "header" and inside[k] and headed[k]:
            cut = False
        gone[k] = gone[parent[k]] or cut
    return gone


def article_nodes(page: Page, found: Counts) -> list[bool]:
    """Which nodes belong to the article, from the densities' sums and the threshold of the core's path."""
    size, parent, tag, gone = len(page.parent), page.parent, page.tag, found.gone
    core = max(range(size), key=lambda k: (-1.0 if gone[k] else found.total[k], -k))
    path = [core]
    while path[-1]:
        path.append(parent[path[-1]])
    threshold = min(found.density[k] for k in path)
    framed = [k for k in path if tag[k] == "article"][-1:] or [k for k in path if tag[k] == "main"][-1:]
    root = framed[0] if framed else core
    while not framed and root and tag[above := parent[root]] not in ("html", "body"):  # wider, while what is added is text and not links
        chars, links = (sums[above] - sums[root] for sums in (found.chars, found.link_chars))
        if 3 * links > chars:
            break
        root = above
    above_root = set()
    k = root
    while k:
        k = parent[k]
        above_root.add(k)
    titled = any(tag[k] == "h1" and not gone[k] and within(parent, k, root) for k in range(size))
    chosen = [False] * size
    for k in range(size):
        if gone[k]:
            continue
        chosen[k] = k == root or (k > 0 and chosen[parent[k]])
        if not chosen[k] and k not in above_root:
            dense = found.chars[k] and found.density[k] >= threshold
            chosen[k] = bool(dense and (tag[k] == "article" if framed else tag[k] in BLOCKS)) or (tag[k] == "h1" and k < root and not titled)
        if chosen[k] and k != root and tag[k] in MENUS and found.links[k] > 1 and 10 * found.link_chars[k] >= 9 * found.chars[k]:
            chosen[k] = False  # and what is in it: a list of links
            gone[k] = True
        if gone[parent[k]] and k:
            gone[k], chosen[k] = True, False
    return chosen


def within(parent: list[int], k: int, root: int) -> bool:
    while k > root:
        k = parent[k]
    return k == root


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    found = Counts(page)
    if not found.chars[0]:
        return ""
    chosen = article_nodes(page, found)
    blocks, held = [], []
    for k, text in page.flow:
        if text is None:
            if held:
                blocks.append("".join(held))
                held = []
        elif chosen[k]:
            held.append(text)
    blocks.append("".join(held))
    return "\n".join(b for b in (" ".join(block.split()) for block in blocks) if b)


def extract(pages: DataFrame, html_col: str = "html", keep: dict[str, str] | None = None) -> DataFrame:
    """Columns `keep`, text and n_chars of every page."""

    def start():
        def work(column: pa.Array) -> dict[str, object]:
            texts = [main_text(html) for html in column.to_pylist()]
            return {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

        return work

    return map_texts(pages, html_col, "text string, n_chars bigint", start, keep)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"), keep={"page_id": "page_id", "url": "url"})
