"""Main-text extraction from HTML by tag-path ratios.

Every text node of a page has a path from the root, of tags (with the first class of block elements) and a last "a" if most of
its text is linked. Text length
and punctuation are added up per path and divided by the number of its nodes; both ratios are smoothed over the page's
sequence of text nodes and fused by a geometric mean. A path's score is the mean over its nodes, and the paths above the
page's own threshold select the content nodes.

The selected text places the article: in the article or main element that holds most of it, else in the deepest element
with nearly all of it. Inside, selected nodes are kept. What the threshold leaves out there is kept where it is part
of the article's flow (headings, short paragraphs and lists beside selected text) and dropped where it is not: parts
without any selected text that are mostly links, or that stand before or after all of the selected text in elements
of their own. Only of an article element nothing is dropped in this way.

Never content, whatever their ratio: scripts, styles, templates, menus, headers, footers, sidebars and hidden
elements. Forms, and elements whose class or id has a word for a notice, an advert, a menu, comments or the like,
aren't either, unless they hold the page's largest article or main element, or selected text that is most of the page's
text (nearly all of it, for comments, adverts and what is related). Inside an article, a word of many uses only excludes an
element of which the threshold leaves out most, and a class that has other words too one that is mostly links. Classes such as has-sidebar say nothing.

White space inside a block becomes one space, blocks are trimmed and joined in page order by a newline, and
character references are decoded. Defined results: null or empty html gives an empty text; text without markup is
one block; broken markup is read as far as it goes; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quire.session import ship

#: Elements by their role in HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("script style template noscript head title nav header footer aside menu dialog button select option textarea iframe object svg canvas audio video map label input fieldset search noembed noframes".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc sidebar rail widget related recommended recommendations trending popular teaser share sharing social follow comment comments commentlist respond reply replies disqus discussion "
    "footer header masthead copyright legal disclaimer toolbar skip hidden".split()
)
#: What stands beside an article, however long it is (fixed values).
BESIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promoted promotion cookie cookies consent gdpr legal related recommended recommendations trending popular teaser comment comments commentlist respond reply replies disqus discussion".split())
#: Words of the above that also name parts of articles, and words that name no part of their own (fixed values).
MANIFOLD = frozenset("legal notice notices notification alert copyright disclaimer discussion follow header hidden masthead popular promotion rail response respond share skip social trending widget".split())
GLUE = frozenset("area bar block box col column container content group holder inner item items left link links list main module outer panel post posts articles stories news pages products reading right row section slot story thread topics top unit wrap wrapper".split())
MOST, NEARLY_ALL, DOUBTFUL, UNCLEAR = 0.5, 0.9, 0.25, 0.1
LINKED = 0.5
#: First words of the classes of articles that are an item beside the article (fixed values).
ITEM_WORDS = frozenset("comment reply ad ads advert promo sponsored teaser related".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table html body article section div main aside nav form blockquote td th select menu".split())
ROOTS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are a piece of a text, and never all of it.
FLOW = HEADINGS | frozenset("p pre blockquote li dd dt td th tr tbody figcaption caption".split())
SMOOTH = (0.06136, 0.24477, 0.38774, 0.24477, 0.06136)  # a Gaussian of sigma 1 over two nodes to either side

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLASS = re.compile(r"(?:^|\s)class\s*=\s*[\"']?\s*([^\s\"'>]+)", re.I)
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?،؛؟。、，！？…]")
_WORD = re.compile(r"[a-z]+")
_MODIFIER = re.compile(r"(?:has|no|with|without)[-_].*|.*[-_](?:enabled|disabled)")


class Node:
    __slots__ = ("tag", "parent", "hard", "never", "path", "depth", "article", "header", "guard", "share", "linked")

    def __init__(self, tag: str, parent: Node | None, never: bool, share: float = 0.0, kind: str = ""):
        self.tag, self.parent = tag, parent
        # excluded by its words unless it holds more than this share; guard is the nearest such element, or itself
        self.share = share
        self.guard: Node | None = self if share else parent.guard if parent else None
        self.linked = tag == "a" or bool(parent and parent.linked)
        self.article = tag in ROOTS or bool(parent and parent.article)
        # of an article's own header, the headings stay
        own = tag == "header" and self.article
        self.header = own or bool(parent and parent.header)
        heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() or bool(parent and parent.header and not parent.never)
        self.hard = never and not own or bool(parent and parent.hard)
        self.never = self.hard or self.header and not heading
        self.path: str = f"{parent.path}/{tag}{kind}" if parent else tag
        self.depth: int = parent.depth + 1 if parent else 0


def _share(tag: str, raw: str, inside: bool) -> float:
    """The share of the page's text that, selected, lifts the exclusion of an element by its words; 0 where there is none.

    DOUBTFUL, inside an article, is lifted by what is selected of the element's own text, and UNCLEAR unless that is links.
    """
    share = MOST if tag == "form" else 0.0
    if tag in ROOTS or tag in ("html", "body"):
        return share
    for name, a, b, c in _ATTR.findall(raw):
        if name.lower() in ("class", "id", "data-role", "data-component"):
            for token in (a or b or c).lower().split():
                words = [] if _MODIFIER.fullmatch(token) else _WORD.findall(token)
                found = NEVER_WORDS.intersection(words)
                if found and inside and not all(w in NEVER_WORDS or w in GLUE for w in words):
                    share = share or UNCLEAR
                elif found and inside and found <= MANIFOLD:
                    share = max(share, DOUBTFUL)
                elif found & BESIDE_WORDS:
                    return NEARLY_ALL
                elif found:
                    share = MOST
    return share


def _kind(tag: str, raw: str) -> str:
    """What a path tells elements of one tag apart by: the first class of a block element."""
    found = _CLASS.search(raw) if tag in BLOCK and raw and not raw.isspace() else None
    return f".{found[1].lower()}" if found else ""


def _is_never(tag: str, raw: str) -> bool:
    if tag in NEVER:
        return True
    if not raw or raw.isspace() or tag in ("html", "body"):
        return False
    for name, a, b, c in _ATTR.findall(raw):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "data-role", "data-component"):
            if tag in ROOTS:
                if any(w[0] in ITEM_WORDS for x in value.split() if (w := _WORD.findall(x)) and w[-1] != "open"):
                    return True
        elif name == "role":
            if value in NEVER_ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class Block:
    """A piece of text: the element that it belongs to, the text, and how many of its characters are linked."""

    __slots__ = ("node", "text", "linked", "path")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, min(linked, len(text))
        self.path = node.path + "/a" if self.linked > LINKED * len(text) else node.path


def text_blocks(source: str) -> list[Block]:
    """The page's blocks in order."""
    root = Node("", None, False)
    at, out, held, owner, linked = root, [], [], root, 0

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = _SPACE.sub(" ", _html.unescape("".join(held))).strip()
            if text:
                out.append(Block(owner, text, linked))
            held, linked = [], 0

    def put(text: str) -> None:
        nonlocal owner, linked
        if at.never:
            return
        if not held:
            owner = at
        held.append(text)
        if at.linked:
            linked += len(text.strip())

    pos = 0
    while m := _TOKEN.match(source, pos):
        pos = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                put(text)
            elif text.startswith("<![CDATA["):
                put(_html.escape(text[9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if m[1]:  # an end tag closes up to its nearest open element, if there is one
            if tag == "br":
                if held:
                    held.append(" ")
                continue
            n = at
            while n is not root and n.tag != tag:
                n = n.parent
            if n is root:
                if tag == "p":
                    flush()
                continue
            if tag in BLOCK or n.never != n.parent.never or at.guard is not n.parent.guard or any(x in BLOCK for x in _between(at, n)):
                flush()
            at = n.parent
            continue
        if tag == "br" or tag == "wbr":
            if held and tag == "br":
                held.append(" ")
            continue
        if tag in BLOCK:
            flush()
            at = _close(at, root, tag)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        new = Node(tag, at, _is_never(tag, m[3]), _share(tag, m[3], at.article), _kind(tag, m[3]))
        if new.never and not at.never or new.guard is not at.guard:
            flush()
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, pos)
            pos = end.end() if end else len(source)
            continue
        at = new
    flush()
    return out


def _between(low: Node, high: Node) -> Iterator[str]:
    while low is not high:
        yield low.tag
        low = low.parent


def _close(at: Node, root: Node, tag: str) -> Node:
    """Where a block element starts: outside of an open paragraph, and of a list item or cell that it ends."""
    n = at
    while n is not root and n.tag not in SCOPES:
        if n.tag == "p" or tag[0] == "h" and len(tag) == 2 and tag[1].isdigit() and n.tag == tag:
            return _close(n.parent, root, tag)
        n = n.parent
    ends = CLOSED_BY.get(tag)
    if ends:
        n = at
        while n is not root and (n.tag in ends or n.tag not in SCOPES):
            if n.tag in ends:
                if n.parent is root or n.parent.tag not in ends:
                    return n.parent
            n = n.parent
    return at


def scores(blocks: list[Block]) -> dict[str, float]:
    """For each path, the mean over its nodes of the fused ratios: smoothed characters and punctuation per node of a path."""
    total: dict[str, list[float]] = {}
    for b in blocks:
        t = total.setdefault(b.path, [0, 0, 0])
        t[0] += len(b.text)
        t[1] += len(_PUNCT.findall(b.text))
        t[2] += 1
    chars = _smooth([total[b.path][0] / total[b.path][2] for b in blocks])
    marks = _smooth([(total[b.path][1] + 1) / total[b.path][2] for b in blocks])
    fused: dict[str, float] = {}
    for b, c, p in zip(blocks, chars, marks):
        fused[b.path] = fused.get(b.path, 0.0) + math.sqrt(c * p)
    return {path: f / total[path][2] for path, f in fused.items()}


def _smooth(x: list[float]) -> list[float]:
    out = []
    for i in range(len(x)):
        lo, hi = max(0, i - 2), min(len(x), i + 3)
        w = SMOOTH[lo - i + 2 : hi - i + 2]
        out.append(sum(a * b for a, b in zip(w, x[lo:hi])) / sum(w))
    return out


class Selection:
    """The paths above the threshold, and how much text is below each element: selected, linked and all of it."""

    def __init__(self, blocks: list[Block]):
        by_path = scores(blocks)
        fused = [by_path[b.path] for b in blocks]
        mean = sum(fused) / len(fused)
        threshold = mean - math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused)) / 2
        self.paths = {path for path, f in by_path.items() if f >= threshold}
        self.mass: dict[Node, float] = {}
        self.linked: dict[Node, float] = {}
        self.all: dict[Node, float] = {}
        self.chosen = 0.0
        for b in blocks:
            mine = len(b.text) if b.path in self.paths else 0
            self.chosen += mine
            n: Node | None = b.node
            while n is not None:
                self.mass[n] = self.mass.get(n, 0.0) + mine
                self.linked[n] = self.linked.get(n, 0.0) + b.linked
                self.all[n] = self.all.get(n, 0.0) + len(b.text)
                n = n.parent


def _allowed(blocks: list[Block]) -> list[Block]:
    """blocks without those in elements that their words exclude and their text doesn't bring back."""
    if all(b.node.guard is None for b in blocks):
        return blocks
    s = Selection(blocks)
    largest = max((n for n in s.mass if n.tag in ROOTS), key=lambda n: (s.mass[n], -n.depth), default=None)
    whole = sum(len(b.text) for b in blocks)

    def brought_back(n: Node) -> bool:
        if n.share == UNCLEAR:
            return s.linked[n] <= LINKED * s.all[n]
        return s.mass[n] > (MOST * s.all[n] if n.share == DOUBTFUL else n.share * whole)

    lifted = {n for n in s.mass if n.share and brought_back(n)}
    while largest is not None:
        lifted.add(largest)
        largest = largest.parent

    def free(n: Node) -> bool:
        g = n.guard
        while g is not None and g in lifted:
            g = g.parent.guard
        return g is None

    return [b for b in blocks if free(b.node)]


def _region(s: Selection) -> Node:
    """The element that the selected text places the article in."""
    named = max((n for n in s.mass if n.tag in ROOTS), key=lambda n: (s.mass[n], -n.depth), default=None)
    if named is not None and s.mass[named] >= MOST * s.chosen:
        return named
    best = max((n for n in s.mass if s.mass[n] >= NEARLY_ALL * s.chosen), key=lambda n: n.depth)
    while best.parent is not None and (best.tag not in BLOCK or best.tag in FLOW):
        best = best.parent
    return best


def _within(n: Node | None, top: Node) -> bool:
    while n is not None and n is not top:
        n = n.parent
    return n is top


def main_text(source: str | None) -> str:
    """The main text of one page."""
    blocks = _allowed([b for b in text_blocks(source or "") if not b.node.never])
    if not blocks:
        return ""
    s = Selection(blocks)
    top = _region(s)
    blocks = [b for b in blocks if _within(b.node, top)]
    taken = [i for i, b in enumerate(blocks) if b.path in s.paths]
    if top.tag == "article" or not taken:
        return "\n".join(b.text for b in blocks)
    first, last = taken[0], taken[-1]
    # headings right before the first selected node belong to it
    while first and blocks[first - 1].node.tag in HEADINGS:
        first -= 1
    beside = {blocks[i].node.parent for i in (taken[0], taken[-1])} | {blocks[i].node for i in (taken[0], taken[-1])}
    kept = []
    for i, b in enumerate(blocks):
        if b.path not in s.paths:
            part = b.node  # the largest part around it without selected text
            while part is not top and part.parent is not top and part.parent is not None and not s.mass[part.parent]:
                part = part.parent
            if s.mass[part] == 0 and s.linked[part] > LINKED * s.all[part]:
                continue
            if not first <= i <= last and part not in beside and part.parent not in beside:
                continue
        kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, max(b.num_rows, 1), 512):
                part = b.slice(at, 512)
                texts = [main_text(t.as_py()) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint")
