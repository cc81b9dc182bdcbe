"""HTML extraction by tag-path ratios.

A page is read into text blocks, each with its root-to-leaf tag path. For every path the text length and the punctuation of
its blocks are summed and divided by the number of blocks. The two ratios are smoothed along the page, fused by product and
multiplied by a bounded prior: less for what elements, roles and words of class or id mark as furniture, more in an article or main element
with a good part of the text. Paths that pass a threshold from the spread of the fused values are selected, marked or not; where none is,
nothing is content. Their blocks vote for the content element: the deepest one that holds nearly all of the votes, or the
article that it lies in. The result is the blocks of the selected paths and what else lies in the
content element (or, as a heading or lead, right before it) and isn't marked as furniture.

Defined results: null html counts as empty; a page without text gives an empty string and
0; unclosed, misnested and truncated tags are closed where HTML closes them; a page on
which no path stands out gives all blocks that aren't furniture. Rows are never merged, equal or not; columns other than
page_id, url and html are not read and may have any name. Work grows in proportion to a page's length, however deep its elements lie.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:[^>\"']++|\"[^\"]{0,65536}+\"|'[^']{0,65536}+')*+(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video)(?=[\s/>])(?:[^>\"']++|\"[^\"]{0,65536}+\"|'[^']{0,65536}+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]{0,65536}+\"|'[^']{0,65536}+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][\w:-]*+)(?P<attrs2>[^<>]*+)(?:>|\Z|(?=<))"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: One attribute after another, each with its value: a name inside a value or inside a longer name is no attribute.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TELLING = frozenset("class id role hidden aria-hidden".split())
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Fixed values of HTML: elements without content, elements that end a block, what an element closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div footer form header html main nav section table ul ol dl".split())
#: Elements, roles and words of class or id that mark page furniture.
FURNITURE = frozenset("nav footer aside form button menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert "
    "popup modal overlay sidebar aside widget widgets related recommended recommendations share sharing social comment comments commentlist reply replies "
    "respond disqus discussion nav navbar navigation menu breadcrumb breadcrumbs footer foot masthead topbar subscribe subscription newsletter signup signin login "
    "copyright toolbar pagination pager paywall disclaimer".split()
)
#: Of these words those that content is called by as well: they count as a weaker sign.
AMBIGUOUS = frozenset("social promotion notification widget widgets reply replies discussion foot".split())
WHOLE = frozenset("html body main article".split())
LINKS = frozenset(("a",))
#: Elements before the content that belong to it where they stand beside what holds it.
LEADS = frozenset("h1 h2 h3 h4 h5 h6 p".split())


#: Bounded priors of a ratio: by the sign of furniture (none, weak, strong), and of an article or main element that holds at least a share of the text that isn't furniture or linked.
FURNISHED, MAIN, MAIN_SHARE = (1.0, 1 / 4, 1 / 64), 16.0, 1 / 3
NONE, WEAK, STRONG = 0, 1, 2
#: The threshold in standard deviations of the fused values, and as a share of the greatest at least.
SPREAD, LEAST = 0.5, 0.02


@dataclass(slots=True)
class Element:
    name: str
    path: int
    furniture: int
    in_article: bool
    up: int
    depth: int


@dataclass(slots=True)
class Block:
    path: int
    element: int
    furniture: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class Open:
    """The open elements: a stack that knows for each name, for scopes and for blocks where the last one is."""

    def __init__(self):
        self.stack, self.scopes, self.blocks = [0], [0], [0]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, element: int, name: str) -> None:
        at = len(self.stack)
        self.stack.append(element)
        self.places[name].append(at)
        if name in SCOPE:
            self.scopes.append(at)
        if name in BLOCK:
            self.blocks.append(element)

    def pop(self, name: str) -> None:
        self.stack.pop()
        self.places[name].pop()
        if name in SCOPE:
            self.scopes.pop()
        if name in BLOCK:
            self.blocks.pop()

    def last(self, names: Iterable[str]) -> int:
        """The place of the last open element of these names that no scope has begun after; 0: none."""
        at = max((self.places[n][-1] for n in names if self.places.get(n)), default=0)
        return at if at > self.scopes[-1] else 0


def _furniture(name: str, attrs: str, in_article: bool) -> int:
    """The sign of page furniture that an element gives of itself."""
    if name in FURNITURE or name == "header" and not in_article:
        return STRONG
    sign = NONE
    if not attrs or name in WHOLE:
        return sign
    for key, *values in ATTRIBUTE.findall(attrs):
        key = key.lower()
        if key not in TELLING:
            continue
        value = "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return STRONG
        if key in ("class", "id"):
            told = WORDS.intersection(re.split(r"[^a-z]+", value)) | ({"header"} if "header" in re.split(r"[^a-z]+", value) and not in_article else set())
            sign = max(sign, STRONG if told - AMBIGUOUS else WEAK if told else NONE)
    return sign


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements in page order and the text blocks with the element each one lies in; a path is the number of its (path, name, furniture)."""
    elements = [Element("", 0, NONE, False, -1, 0)]
    paths: dict[tuple[int, str, int], int] = {}
    opened, blocks = Open(), []
    block: Block | None = None
    links = 0

    def pop(to: int) -> None:
        nonlocal links, block
        while len(opened.stack) > to:
            name = elements[opened.stack[-1]].name
            opened.pop(name)
            links -= name in LINKS
            if name in BLOCK:
                block = None

    for m in TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            if block is None:
                if text.isspace():
                    continue
                at = opened.blocks[-1]
                over = elements[opened.stack[-1]]
                # Furniture that isn't a block of its own, such as a button, has a path of its own.
                path = elements[at].path if over.furniture == elements[at].furniture else over.path
                block = Block(path, at, over.furniture)
                blocks.append(block)
            text = entities.unescape(text)
            block.parts.append(text)
            block.linked += len(text) if links else 0
            continue
        name = m["name"] or m["name2"]
        if not name:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            if places := opened.places.get(name):
                pop(places[-1])
            if name in BLOCK:
                block = None
            continue
        if name in BLOCK:
            block = None
            if at := opened.last(("p",)):
                pop(at)
        if name in CLOSES:
            while at := opened.last(CLOSES[name]):
                pop(at)
        if name in VOID:
            if block is not None and name in ("br", "wbr"):
                block.parts.append(" " if name == "br" else "")
            continue
        over = elements[opened.stack[-1]]
        furniture = over.furniture if over.furniture == STRONG else max(over.furniture, _furniture(name, m["attrs"] or m["attrs2"] or "", over.in_article))
        path = paths.setdefault((over.path, name, furniture), len(paths) + 1)
        elements.append(Element(name, path, furniture, over.in_article or name in ("article", "main"), opened.stack[-1], over.depth + 1))
        if furniture != over.furniture and name not in BLOCK:
            block = None
        opened.push(len(elements) - 1, name)
        links += name in LINKS
    for b in blocks:
        b.text = SPACE.sub(" ", "".join(b.parts)).strip()
    return elements, [b for b in blocks if b.text]


def below(elements: list[Element], own: dict[int, float]) -> list[float]:
    """Of each element the sum of what lies in it: every element comes after the one around it."""
    total = [0.0] * len(elements)
    for i, x in own.items():
        total[i] = x
    for i in range(len(elements) - 1, 0, -1):
        total[elements[i].up] += total[i]
    return total


def weights(elements: list[Element], blocks: list[Block]) -> np.ndarray:
    """What each block's elements say of it, as a factor: FURNISHED by their sign of furniture, MAIN in an article or main element with a good part of the text, else 1."""
    own: dict[int, float] = defaultdict(float)
    for b in blocks:
        own[b.element] += 0 if b.furniture else max(0, len(b.text) - b.linked)
    text = below(elements, own)
    main = [False] * len(elements)
    for i, e in enumerate(elements):
        main[i] = i > 0 and (main[e.up] or e.name in ("article", "main") and text[i] > 0 and text[i] >= MAIN_SHARE * text[0])
    return np.array([FURNISHED[b.furniture] * (MAIN if main[b.element] else 1.0) for b in blocks])


def content_paths(blocks: list[Block], weight: np.ndarray) -> set[int]:
    """Paths whose smoothed, fused and weighted ratio of text and punctuation to blocks passes the threshold."""
    count, length, marks = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        count[b.path] += 1
        length[b.path] += len(b.text) - b.linked
        marks[b.path] += len(PUNCTUATION.findall(b.text))
    text = np.array([max(0, length[b.path]) / count[b.path] for b in blocks])
    punctuation = np.array([marks[b.path] / count[b.path] for b in blocks])
    kernel = np.array([0.25, 0.5, 0.25])

    sign = np.array([b.furniture for b in blocks])

    def smooth(x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for level in set(sign.tolist()):  # furniture stands among furniture: it neither lends to the rest nor borrows from it
            own = sign == level
            out[own] = np.convolve(np.pad(x[own], 1, mode="edge"), kernel, mode="valid")
        return out

    fused = smooth(text) * smooth(1 + punctuation) * weight
    if not fused.max():
        return {b.path for b in blocks if not b.furniture} or {b.path for b in blocks}
    limit = max(min(SPREAD * fused.std(), fused.max()), LEAST * fused.max())
    total = defaultdict(float)
    for b, v in zip(blocks, fused, strict=True):
        total[b.path] += (v >= limit) / count[b.path]
    return {path for path, share in total.items() if share >= 0.5}


def content_element(elements: list[Element], blocks: list[Block], weight: np.ndarray, chosen: set[int]) -> int:
    """The deepest element that holds 9 of 10 votes, a block of a chosen path having its weight; the article or main element around it, if there is one.

    Never a block without others in it.
    """
    own: dict[int, float] = defaultdict(float)
    for b, w in zip(blocks, weight.tolist(), strict=True):
        if b.path in chosen:
            own[b.element] += w
    votes = below(elements, own)
    holds = [False] * len(elements)
    for b in blocks:
        at = elements[b.element].up
        while at >= 0 and not holds[at]:
            holds[at] = True
            at = elements[at].up
    holder = max((i for i, n in enumerate(votes) if holds[i] and n and 10 * n >= 9 * votes[0]), key=lambda i: elements[i].depth, default=0)
    at = holder
    while at > 0:
        if elements[at].name in ("article", "main"):
            return at
        at = elements[at].up
    return holder


def extract(page: str | None) -> str:
    elements, blocks = parse(page or "")
    if not blocks:
        return ""
    weight = weights(elements, blocks)
    chosen = content_paths(blocks, weight)
    if not chosen:
        return ""
    holder = content_element(elements, blocks, weight, chosen)
    after = next((i for i in range(holder + 1, len(elements)) if elements[i].depth <= elements[holder].depth), len(elements))
    apart = elements[holder].name in ("article", "main")
    above = set()
    at = elements[holder].up
    while at >= 0:
        above.add(at)
        at = elements[at].up

    def wanted(b: Block) -> bool:
        if b.path in chosen:
            return True
        inside = holder <= b.element < after
        leads = not apart and b.element < holder and elements[b.element].up in above and elements[b.element].name in LEADS
        return not b.furniture and (inside or leads) and (apart or b.linked < 0.8 * len(b.text))

    return "\n".join(b.text for b in blocks if wanted(b))


def html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(page) for page in b.column("html").to_pylist()]
            arrays = [b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return pages.select("page_id", "url", "html").mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
