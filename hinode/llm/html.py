"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at its block-level tags. A logistic classifier gives each block the cost of calling it
content and the cost of calling it boilerplate; these are the capacities of its edges to the two terminals. Blocks next
to each other are joined by smoothness edges, the stronger the nearer they are in the tree, and so are the blocks of one
parent. The minimum cut, found by maximum flow, is the labelling of least total cost; the content side is the text.

The classifier sees a block's shape (its length, links, punctuation, place) and what the markup around it says (tags, and
words of class and id, as five flags). Each half is fitted on a bounded sample of pages whose labels the other half gives:
the shape's weights where the markup speaks, the markup's weights where links, length and the page's title speak.

Defined results: a null, empty or text-free page gives the empty text and 0 characters; unclosed and misnested tags
close as their parents do; repeated rows give repeated results; a null page_id or url is carried through; an empty table
gives no rows. The whole html is read, whatever its length; other columns are left alone.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the classifier is fitted on at most; a hash of id and html chooses them. Of each at most SAMPLE_BLOCKS blocks.
SAMPLE_PAGES, SAMPLE_BLOCKS = 400, 200

#: Fixed tag sets.
DROPPED = frozenset("script style noscript template head title svg math iframe object textarea select option button canvas video audio datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
#: Fixed words in class, id and role that mark boilerplate or content.
BOILER_WORDS = frozenset(
    "nav navbar navigation menu menubar footer foot header masthead topbar sidebar sidenav side aside rail ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay toast comment comments commentlist discussion disqus respond reply replies reader feedback share sharing social "
    "related recommend recommended recommendations more trending popular newsletter subscribe subscription signup signin login register search breadcrumb breadcrumbs pagination pager widget widgets "
    "toolbar tags copyright legal disclaimer skip print contentinfo complementary form".split()
)
CONTENT_WORDS = frozenset("article articlebody content contents main maincontent post postbody entry story body text page prose".split())

#: Elements deeper than this are read as if they stood in the last one that isn't, as browsers do.
DEEPEST = 256
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
_QUOTE_OR_END = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ABOUT_LAYOUT = re.compile(r"(?:has|with|no|without|is|js)[-_]", re.I)


@dataclass
class Block:
    """Text between block-level tags, with what the labelling needs to know of it: the elements it is in, from the root
    on, and the flags of the markup around it."""

    text: str
    linked: int
    tag: str
    path: tuple[int, ...]
    markup: int


#: Flags of the markup around a block.
CONTENT_TAG, BOILER_TAG, CONTENT_WORD, BOILER_WORD, HIDDEN = 1, 2, 4, 8, 16


def _markup(tag: str, attributes: str, in_content: bool) -> int:
    """The flags of one element's tag and attributes."""
    flags = 0
    if tag in BOILER_TAGS or tag == "header" and not in_content:
        flags |= BOILER_TAG
    if tag in CONTENT_TAGS:
        flags |= CONTENT_TAG
    if attributes and tag not in ("html", "body"):
        names = [x for m in _ATTRIBUTE.finditer(attributes) for x in (m[2] or m[3] or m[4] or "").split() if not _ABOUT_LAYOUT.match(x)]
        words = {w.lower() for x in names for w in _WORDS.findall(x)}
        if words & BOILER_WORDS:
            flags |= BOILER_WORD
        elif words & CONTENT_WORDS:
            flags |= CONTENT_WORD
        if _HIDDEN.search(attributes):
            flags |= HIDDEN
    return flags


class Tokens:
    """Comments, declarations, CDATA sections and tags of a page, one after another.

    What a search didn't find isn't sought again, and an attempt that meets one that failed fails with it, so the time
    grows with the page, however it is malformed.
    """

    def __init__(self, page: str):
        self.page = page
        self.absent: dict[str, int] = {}
        self.mark = (0, -1)
        self.failed: set[int] = set()

    def find(self, needle: str, at: int) -> int:
        """Where needle stands from `at` on, -1 if nowhere."""
        if at >= self.absent.get(needle, len(self.page) + 1):
            return -1
        found = self.page.find(needle, at)
        if found < 0:
            self.absent[needle] = at
        return found

    def next_mark(self, at: int) -> int:
        """The next quote or >, the page's length if there is none."""
        first, found = self.mark
        if not first <= at <= found:
            m = _QUOTE_OR_END.search(self.page, at)
            found = m.start() if m else len(self.page)
            self.mark = (at, found)
        return found

    def tag_end(self, at: int) -> int:
        """The > that ends a tag whose attributes begin at `at`, outside of quotes; -1 if there is none."""
        passed = []
        while at not in self.failed:
            passed.append(at)
            mark = self.next_mark(at)
            if mark == len(self.page):
                break
            if self.page[mark] == ">":
                return mark
            close = self.find(self.page[mark], mark + 1)
            if close < 0:
                break
            at = close + 1
        self.failed.update(passed)
        return -1

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, kind, name, attributes) of the next token; kind is open, close, cdata or other."""
        page = self.page
        while (at := self.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, "other", "", ""
            if page.startswith("<![CDATA[", at) and (end := self.find("]]>", at + 9)) >= 0:
                return at, end + 3, "cdata", "", ""
            if page[at + 1 : at + 2] in ("!", "?"):
                if (end := self.find(">", at + 2)) >= 0:
                    return at, end + 1, "other", "", ""
            elif (m := _TAG.match(page, at)) and (end := self.tag_end(m.end())) >= 0:
                return at, end + 1, "close" if m[1] else "open", m[2].lower(), page[m.end() : end]
            at += 1
        return None


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page in order. An element's flags hold for all that is in it."""
    blocks: list[Block] = []
    # open elements: tag, its number, flags, dropped
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
    tokens = Tokens(page)
    number, at, links = 0, 0, 0
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                around = [e for e in stack if e[0] not in INLINE]
                blocks.append(Block(text, len(" ".join(entities.unescape(" ".join(linked)).split())), around[-1][0], tuple(e[1] for e in around), around[-1][2]))
            parts.clear()
            linked.clear()

    def say(text: str) -> None:
        if text and not stack[-1][3]:
            parts.append(text)
            if links:
                linked.append(text)

    while at < len(page):
        token = tokens.after(at)
        if token is None:
            rest = page[at:]
            # an unfinished tag at the end is no text
            unfinished = re.search(r"<[A-Za-z/!]", rest[rest.rfind(">") + 1 :])
            say(rest[: rest.rfind("<")] if unfinished else rest)
            break
        start, end, kind, tag, attributes = token
        say(page[at:start])
        at = end
        if kind in ("cdata", "other"):
            if kind == "cdata":
                say(page[start + 9 : end - 3])
            continue
        if kind == "close":
            if tag not in INLINE:
                flush()
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            # an inline element that a block inside it has outlived is closed only as far as that block
            if depth and not (tag in INLINE and any(e[0] not in INLINE for e in stack[depth + 1 :])):
                links -= sum(e[0] == "a" for e in stack[depth:])
                del stack[depth:]
            continue
        if tag == "br":
            say(" ")
            continue
        if tag not in INLINE:
            flush()
            if stack[-1][0] in INLINE:  # inline elements end where a block begins
                while stack[-1][0] in INLINE:
                    links -= stack[-1][0] == "a"
                    stack.pop()
            closes = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}.get(tag)
            if stack[-1][0] == closes or stack[-1][0] == "p" and tag not in VOID:
                stack.pop()
        if tag in VOID or attributes == "/" or attributes.endswith(" /"):
            continue
        if tag in RAW:
            closing = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
            at = closing.end() if closing else len(page)
            continue
        if len(stack) >= DEEPEST:
            continue
        number += 1
        _, _, flags, dropped = stack[-1]
        said = _markup(tag, attributes, bool(flags & (CONTENT_TAG | CONTENT_WORD))) if tag not in INLINE or attributes else 0
        stack.append((tag, number, flags | said, dropped or tag in DROPPED))
        links += tag == "a"
    flush()
    return blocks


SHAPE, MARKUP = 8, 5
_AGAINST = BOILER_TAG | BOILER_WORD | HIDDEN


def block_features(blocks: list[Block]) -> np.ndarray:
    """[blocks, SHAPE + MARKUP] numbers of each block: its shape, and the flags, of which those for content count only
    where none is against it."""
    rows = []
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        density = b.linked / max(1, len(b.text))
        near = blocks[max(0, k - 1) : k + 2]
        shape = (1.0, min(words, 80) / 80, min(words, 12) / 12, density, float(b.text[-1] in ".!?:;\"'»…"), float(b.tag in ("h1", "h2", "h3", "h4")), float(b.tag in ("li", "td", "dd")), sum(x.linked for x in near) / max(1, sum(len(x.text) for x in near)))
        flags = b.markup if b.markup & _AGAINST == 0 else b.markup & _AGAINST
        rows.append((*shape, *(float(bool(flags & f)) for f in (CONTENT_TAG, BOILER_TAG, CONTENT_WORD, BOILER_WORD, HIDDEN))))
    return np.array(rows, dtype=np.float64).reshape(len(rows), SHAPE + MARKUP)


#: Weights in use until enough pages have been seen, and those that fitted ones are drawn to: shape, then flags.
DEFAULT_WEIGHTS = np.array([-1.0, 2.0, 1.5, -3.0, 0.5, 0.5, -0.5, -1.0, 4.0, -6.0, 3.0, -6.0, -8.0])


def fit_logistic(features: np.ndarray, labels: np.ndarray, start: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression towards `start`, both classes weighing the same."""
    if not len(labels) or labels.min() == labels.max():
        return start.copy()
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum())) * min(len(labels), 1000)
    w = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        g = features.T @ ((p - labels) * weight) + penalty * (w - start)
        h = (features * (p * (1 - p) * weight)[:, None]).T @ features + penalty * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, g), -2, 2)
    return np.clip(w, -8, 8)


def fit_block_classifier(features: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Weights from blocks' features and seeds (1 content, 0 boilerplate, -1 unknown): each half on the other's labels."""
    shape, flags = features[:, :SHAPE], features[:, SHAPE:]
    told = flags.any(axis=1)
    by_markup = (flags[:, [0, 2]].any(axis=1)).astype(float)
    seen = seeds >= 0
    return np.concatenate((fit_logistic(shape[told], by_markup[told], DEFAULT_WEIGHTS[:SHAPE]), fit_logistic(flags[seen], seeds[seen].astype(float), DEFAULT_WEIGHTS[SHAPE:])))


_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.S | re.I)


def block_seeds(page: str, blocks: list[Block]) -> list[int]:
    """What links, length and the title tell of blocks without any look at the markup around them."""
    found = _TITLE.search(page)
    title = set(entities.unescape(found[1]).lower().split()) if found else set()
    out = []
    for b in blocks:
        words = b.text.lower().split()
        if 2 * b.linked > len(b.text):
            out.append(0)
        else:
            out.append(1 if len(words) >= 20 and not b.linked and len(title.intersection(words)) * 3 >= max(1, len(title)) else -1)
    return out


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a least cut. source, sink: capacities from and to the terminals; edges
    (a, b, capacity) count both ways.

    A node whose terminals differ by more than its open edges sum to is settled at once, and its edges become terminal
    capacities of its neighbours; what is left is cut by augmenting along shortest paths.
    """
    n = len(source)
    lean = [a - b for a, b in zip(source, sink, strict=True)]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        a = todo.popleft()
        if side[a] is None and abs(lean[a]) >= sum(near[a].values()):
            side[a] = lean[a] > 0
            for b, c in near[a].items():
                lean[b] += c if side[a] else -c
                del near[b][a]
                todo.append(b)
            near[a] = {}
    left = [a for a in range(n) if side[a] is None]
    if left:
        spare: dict[int, dict[int, float]] = {a: dict(near[a]) for a in left}
        s, t = -1, -2
        spare[s] = {a: lean[a] for a in left if lean[a] > 0}
        spare[t] = {}
        for a in left:
            if lean[a] > 0:
                spare[a][s] = 0.0
            elif lean[a] < 0:
                spare[a][t] = -lean[a]
                spare[t][a] = 0.0
        while True:
            before = {s: s}
            line = deque([s])
            while line and t not in before:
                a = line.popleft()
                for b, c in spare[a].items():
                    if c > 1e-9 and b not in before:
                        before[b] = a
                        line.append(b)
            if t not in before:
                break
            path, b = [], t
            while b != s:
                path.append((before[b], b))
                b = before[b]
            flow = min(spare[a][b] for a, b in path)
            for a, b in path:
                spare[a][b] -= flow
                spare[b][a] = spare[b].get(a, 0.0) + flow
        for a in left:
            side[a] = a in before
    return [bool(x) for x in side]


#: Capacity of the edge of neighbours whose elements are one, and of blocks of one parent with others between them.
ADJACENT, SAME_PARENT = 1.2, 0.6


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges of neighbours, weaker by each element that lies between them in the tree, and of the nearest of one parent."""
    edges, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            a = blocks[k - 1].path
            shared = next((i for i, (x, y) in enumerate(zip(a, b.path, strict=False)) if x != y), min(len(a), len(b.path)))
            # the two blocks' own elements are siblings at most: one step each
            apart = max(0, len(a) - shared - 1) + max(0, len(b.path) - shared - 1)
            edges.append((k - 1, k, ADJACENT / (1 + apart) ** 2))
        home = b.path[:-1]
        if last.get(home, k) < k - 1:
            edges.append((last[home], k, SAME_PARENT))
        last[home] = k
    return edges


def block_costs(blocks: list[Block], weights: np.ndarray) -> np.ndarray:
    """The classifier's log-odds of content."""
    return np.clip(block_features(blocks) @ weights, -12, 12)


def label_blocks(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    if not blocks:
        return []
    z = block_costs(blocks, weights)
    as_boiler, as_content = np.logaddexp(0, z), np.logaddexp(0, -z)  # -log of the probability of the label
    return minimum_cut(as_boiler.tolist(), as_content.tolist(), smoothness(blocks))


def extract_text(page: str, weights: np.ndarray = DEFAULT_WEIGHTS) -> str:
    """The content blocks of a page, one to a line."""
    blocks = page_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, weights), strict=True) if keep)


def train_block_classifier(pages: DataFrame, sample: int = SAMPLE_PAGES, html: str = "html", key: str = "page_id") -> np.ndarray:
    """Weights fitted on the blocks of at most `sample` pages. To the driver come these blocks' numbers, at most
    SAMPLE_BLOCKS a page, whatever ids are null or repeat."""
    total = pages.count()
    order = F.xxhash64(key, html)
    chance = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, labels = [], []
            for page in batch.column(0).to_pylist():
                blocks = page_blocks(page)
                rows += block_features(blocks)[:SAMPLE_BLOCKS].tolist()
                labels += block_seeds(page, blocks)[:SAMPLE_BLOCKS]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())], names=["x", "y"])

    some = pages.where(F.col(html).isNotNull() & (chance < min(1.0, 2 * sample / max(1, total)))).select(F.col(html).alias("html"), order.alias("order"))
    found = some.orderBy("order").limit(sample).select("html").mapInArrow(run, "x array<double>, y int").toArrow()
    x, y = found.column("x").to_pylist(), found.column("y").to_pylist()
    order_ = sorted(range(len(y)), key=lambda k: (y[k], x[k]))
    return fit_block_classifier(np.array([x[k] for k in order_]).reshape(-1, SHAPE + MARKUP), np.array([y[k] for k in order_], dtype=np.int64))


def extract_pages(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = train_block_classifier(pages, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(p or "", weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
