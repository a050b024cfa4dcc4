"""Main text of web pages by a tree-structured graphical model.

A page's block elements are the nodes of a tree; each is content or not. A node
has a potential from its features (kind of tag, cue words in class, id and role,
length, share of link text, punctuation), each parent and child share one.
Sum-product messages go up and then down the tree, which gives every node's
exact marginal; blocks of nodes above one half are the main text.

Training. At most `SAMPLE` pages (lowest hashes of page_id) whose own markup
tells content from the rest (article, main against nav, aside, header, footer,
form) are the labelled pages; cue words give no label. Feature weights are fitted
by penalised logistic regression on each page twice, once as it is and once with
the tags that gave the labels hidden, so that the other features carry weight of
their own; parent-child potentials are counted. What reaches the driver are counts
of distinct feature sets.

Reading is linear in the page: quotes are followed by state, a search that found
no end is not repeated. A tag that the page's end cuts off is markup, as in HTML.
Character references are decoded, white space inside a block becomes one space,
blocks are joined by an empty line. Nulls: null html counts as empty and gives an
empty text. Very long pages are one row's work. Nodes at just one half are no
content. Repeated rows get equal results, empty tables give empty ones, and
columns that clash with the result's are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 2000
#: Fixed sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe head title".split())
#: Elements that are left out with all below them; they end with their parent at the latest.
APART = frozenset("noscript template select button option svg object".split())
#: Start tags that end an svg (HTML's rule for foreign content), and those that end any element left out but a template.
BREAKS = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li menu ol p pre table ul".split())
ENDS_ALL = frozenset("article main body".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table")}

TAG_KINDS = [("content", "article main"), ("aside", "nav aside header footer menu"), ("form", "form fieldset"), ("para", "p blockquote pre"), ("head", "h1 h2 h3 h4 h5 h6"), ("list", "ul ol dl"), ("item", "li dt dd"), ("box", "div section"), ("top", "html body"), ("cell", "table tr td th tbody thead figure figcaption")]
TAG_BIT = {t: i for i, (_, names) in enumerate(TAG_KINDS) for t in names.split()}
BAD = re.compile(r"(?i)(^|[^a-z])(ads?|adverts?|advertisement|sponsor(ed)?|promo|banner|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|nav(bar|igation)?|menu|breadcrumbs?|header|masthead|foot(er)?|side(bar)?|aside|widget|related|recommend(ed)?|share|sharing|social|comments?|repl(y|ies)|disqus|respond|form|login|search|toolbar|tags|pagination|pager|legal|copyright|complementary|contentinfo)([^a-z]|$)|(side|nav|menu|foot|comment|cookie|advert)")
GOOD = re.compile(r"(?i)(article|(^|[^a-z])(main|content|post|entry|story|text|body)([^a-z]|$))")
#: Feature bits after the kinds of tags, and the weights that fitting starts from and is drawn towards.
NAMES = [k for k, _ in TAG_KINDS] + ["bad", "good", "empty", "short", "long", "links", "ends", "mark", "under"]
PRIOR = [2.0, -4.0, -4.0, 0.5, 0.3, -0.2, -0.2, 0.0, -0.5, 0.0, -4.0, 1.5, -0.3, -0.4, 1.0, -1.5, 0.6, -2.0, -3.0]
BIAS = 0.0
LABEL_BITS = (1 << NAMES.index("content")) | (1 << NAMES.index("aside")) | (1 << NAMES.index("form"))
#: log potentials [parent][child] to start from, 0 = not content.
EDGE_PRIOR = np.array([[6.0, 2.0], [0.5, 8.0]])

NAME, BETWEEN, ATTRIBUTE, EQUALS, BARE = (re.compile(p) for p in (r"[A-Za-z][^\s/>]*", r"[\s/]*", r"[^\s/>][^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
#: Attributes whose words are cues.
CUES = frozenset(("class", "id", "role"))


def read_tag(source: str, at: int) -> tuple[int, str, bool]:
    """End of a tag's attributes from `at` (-1: the page ends first), its cue words, and whether it closes itself."""
    cues, size = [], len(source)
    while True:
        gap = BETWEEN.match(source, at)
        at = gap.end()
        if at == size:
            return -1, "", False
        if source[at] == ">":
            return at + 1, " ".join(cues), gap.group()[-1:] == "/"
        m = ATTRIBUTE.match(source, at)
        name, at = m.group().lower(), m.end()
        eq = EQUALS.match(source, at)
        if not eq:
            continue
        at = eq.end()
        if source[at : at + 1] in ('"', "'") and at < size:
            end = source.find(source[at], at + 1)
            if end < 0:
                return -1, "", False
            value, at = source[at + 1 : end], end + 1
        else:
            m = BARE.match(source, at)
            value, at = m.group(), m.end()
        if name in CUES:
            cues.append(value)


class Page:
    """Nodes (parent, features) and blocks (node, text) of one page, in page order."""

    def __init__(self, source: str):
        self.parent, self.kind, self.tag = [-1], [0], ["#"]
        self.blocks: list[tuple[int, str]] = []
        self.open: list[tuple[str, int]] = [("#", 0)]
        self._at: dict[str, list[int]] = {}  # places in `open` by name
        self.size, self.link, self.tail = [0], [0], [""]
        self._parts: list[str] = []
        self._links = 0
        self._in_link = 0
        self._inline: dict[str, int] = {}
        self._apart = 0  # place in `open` of the outermost element left out, whose entries have no node
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at, size, lacking = 0, len(source), set()
        while at < size:
            start = source.find("<", at)
            while 0 <= start and not (source[start + 1 : start + 2].isascii() and source[start + 1 : start + 2].isalpha()) and source[start + 1 : start + 2] not in ("/", "!", "?"):
                start = source.find("<", start + 1)  # a bare <
            if start < 0:
                self._text(source[at:])
                return
            if start > at:
                self._text(source[at:start])
            end_tag = source[start + 1] == "/"
            m = NAME.match(source, start + 1 + end_tag)
            if m is None:  # a comment, or what counts as one
                comment = source.startswith("<!--", start)
                end = source.find("-->" if comment else ">", start + (4 if comment else 2))
                at = end + (3 if comment else 1) if end >= 0 else size
                continue
            name = m.group().lower()
            at, cues, closed = read_tag(source, m.end())
            if at < 0:
                return
            if end_tag:
                self._end(name)
            elif name in RAW and not (closed and self._apart):
                close = None if name in lacking else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                if close:
                    at = close.end()
                elif name in ("script", "style"):  # its text can't be told from the page's
                    return
                else:
                    lacking.add(name)
                    if name != "head":
                        self._start(name, cues, closed)
            else:
                self._start(name, cues, closed)

    def _text(self, data: str) -> None:
        if self._apart:
            return
        self._parts.append(data)
        if self._in_link:
            self._links += len(data)

    def _flush(self) -> None:
        if self._parts:
            raw = "".join(self._parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                node = self.open[self._apart - 1][1]
                self.blocks.append((node, text))
                self.size[node] += len(text)
                self.link[node] += min(self._links, len(text))
                self.tail[node] = text[-1]
            self._parts, self._links = [], 0

    def _close_to(self, depth: int) -> None:
        if not self._apart or depth < self._apart:  # what is left out does not part the text around it
            self._flush()
        if depth <= self._apart:
            self._apart = 0
        for name, _ in self.open[depth:]:
            self._at[name].pop()
        del self.open[depth:]

    def _push(self, name: str, node: int) -> None:
        self._at.setdefault(name, []).append(len(self.open))
        self.open.append((name, node))

    def _last(self, *names: str) -> int:
        """Place in `open` of the innermost of these elements, 0 if none is open."""
        return max((self._at[n][-1] for n in names if self._at.get(n)), default=0)

    def _start_apart(self, name: str, closed: bool) -> bool:
        """Start an element that is left out or stands below one; False if the tag ends what is left out."""
        if self._apart:
            root, below = self.open[self._apart][0], lambda n: self._last(n) >= self._apart
            if (name in ENDS_ALL and not below("template")) or (root == "svg" and name in BREAKS and not below("foreignobject")):
                self._close_to(self._apart)
                return False
        elif name not in APART and name not in RAW:
            return False
        if name == "option" and self.open[-1][0] == "option":
            self._close_to(len(self.open) - 1)
        if name not in VOID and not closed:
            self._apart = self._apart or len(self.open)
            self._push(name, -1)
        return True

    def _start(self, name: str, cues: str, closed: bool) -> None:
        if (self._apart or name in APART or name in RAW) and self._start_apart(name, closed):
            return
        if name in INLINE:
            self._in_link += name == "a"
            self._inline[name] = self._inline.get(name, 0) + 1
            return
        if name == "br":
            self._parts.append(" ")
            return
        if name in CLOSES_P and (d := self._last("p")) > self._last("td", "th", "li", "div", "article", "section", "body"):
            self._close_to(d)
        if name in SAME and (d := self._last(*SAME[name])) > self._last(*STOPS[name]):
            self._close_to(d)
        self._flush()
        if name in VOID:
            return
        bits = 1 << TAG_BIT[name] if name in TAG_BIT else 0
        if cues:
            bits |= bool(BAD.search(cues)) << 10 | bool(GOOD.search(cues)) << 11
        self.parent.append(self.open[-1][1])
        self.kind.append(bits)
        self.tag.append(name)
        self.size.append(0)
        self.link.append(0)
        self.tail.append("")
        self._push(name, len(self.parent) - 1)

    def _end(self, name: str) -> None:
        if self._apart and name in INLINE:
            if (d := self._last(name)) >= self._apart:
                self._close_to(d)
                return
            if not self._inline.get(name):
                return
            self._close_to(self._apart)
        if name in INLINE:
            self._inline[name] = max(0, self._inline.get(name, 0) - 1)
            if name == "a":
                self._in_link = max(0, self._in_link - 1)
            return
        if d := self._last(name):
            if self.open[d][1] >= 0:
                self._in_link = 0
                self._inline.clear()
            self._close_to(d)
            return
        if name == "p" and not self._apart:
            self._flush()

    def features(self, hide: int = 0) -> list[int]:
        """A bit set for each node; lengths and links count what stands below a node, too. `hide`: bits of kinds not looked at."""
        size, link = self.size[:], self.link[:]
        for i in range(len(self.parent) - 1, 0, -1):
            size[self.parent[i]] += size[i]
            link[self.parent[i]] += link[i]
        out = []
        kind = [k & ~hide for k in self.kind] if hide else self.kind
        for i, bits in enumerate(kind):
            n = size[i]
            bits |= (n == 0) << 12 | (0 < n < 40) << 13 | (n >= 120) << 14 | (link[i] * 2 > n) << 15
            out.append(bits | (self.tail[i] != "" and self.tail[i] in ".!?…:”\"»") << 16)
        apart = 1 << TAG_BIT["nav"] | 1 << TAG_BIT["form"] | 1 << 10
        for i in range(1, len(out)):  # what stands below a node that is set apart
            if kind[self.parent[i]] & apart or out[self.parent[i]] >> 18 & 1:
                out[i] |= 1 << 18
        for node, text in self.blocks:
            if "©" in text:
                out[node] |= 1 << 17
        return out

    def labels(self) -> list[int]:
        """1 below article or main, 0 elsewhere and below nav, aside, forms and the like; -1 if the page has no such tag."""
        if not any(t in ("article", "main") for t in self.tag):
            return [-1] * len(self.tag)
        out = [0]
        for t, k, p in zip(self.tag[1:], self.kind[1:], self.parent[1:], strict=True):
            apart = k & (1 << TAG_BIT["nav"] | 1 << TAG_BIT["form"])
            out.append(0 if apart else 1 if t in ("article", "main") else out[p])
        return out


def _marginals_of_chains(parent: list[int], unary: list[float], edge: np.ndarray) -> np.ndarray:
    """The same node by node, for trees about as deep as they have nodes."""

    def over(e: list[list[float]]) -> Callable[[float], float]:
        def add(a: float, b: float) -> float:
            return max(a, b) + math.log1p(math.exp(-abs(a - b)))

        return lambda x: add(e[1][0], e[1][1] + x) - add(e[0][0], e[0][1] + x)

    rise, fall = over(edge.tolist()), over(edge.T.tolist())
    up, full = [0.0] * len(parent), list(map(float, unary))
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] >= 0:
            up[i] = rise(full[i])
            full[parent[i]] += up[i]
    for i, p in enumerate(parent):
        if p >= 0:
            full[i] += fall(full[p] - up[i])
    return 1 / (1 + np.exp(-np.clip(np.array(full), -500, 500)))


def marginals(parent: np.ndarray, unary: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """P(content) of each node by sum-product on the forest; parents stand before their children.

    `unary`: log odds of content; `edge`: log potentials [parent][child]. Messages
    are log odds, level by level, deepest first on the way up.
    """
    n = len(parent)
    depth = np.zeros(n, np.int64)
    for i in range(n):
        if parent[i] >= 0:
            depth[i] = depth[parent[i]] + 1
    levels = int(depth.max()) + 1 if n else 0
    if levels * 8 > n:
        return _marginals_of_chains(parent.tolist(), unary.tolist(), edge)
    order = np.argsort(depth, kind="stable")
    by_level = np.split(order, np.cumsum(np.bincount(depth))[:-1])

    def across(x: np.ndarray, e: np.ndarray) -> np.ndarray:  # message over an edge, e[to][from]
        return np.logaddexp(e[1, 0], e[1, 1] + x) - np.logaddexp(e[0, 0], e[0, 1] + x)

    up, belief = np.zeros(n), unary.astype(float).copy()
    for level in by_level[:0:-1]:
        up[level] = across(belief[level], edge)
        np.add.at(belief, parent[level], up[level])
    full = belief.copy()
    for level in by_level[1:]:
        full[level] = belief[level] + across(full[parent[level]] - up[level], edge.T)
    return 1 / (1 + np.exp(-np.clip(full, -500, 500)))


def train(pages: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(weights with the bias last, log edge potentials)."""
    chosen = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    held = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id", "left_semi").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source in b.column("html").to_pylist():
                page = Page(source or "")
                y = page.labels()
                for f in (page.features(), page.features(LABEL_BITS)) if y[0] >= 0 else ():
                    rows += [(bits, y[i], y[p] if p >= 0 else -1) for i, (bits, p) in enumerate(zip(f, page.parent, strict=True))]
            f, y, p = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(y, pa.int32()), pa.array(p, pa.int32())], names=["f", "y", "p"])

    counts = held.mapInArrow(run, "f int, y int, p int").groupBy("f", "y", "p").agg(F.count(F.lit(1)).alias("n")).toPandas()
    prior = np.array([*PRIOR, BIAS])
    edge = EDGE_PRIOR.copy()
    for r in counts.itertuples():
        if r.p >= 0:
            edge[r.p, r.y] += r.n / 2  # each node is there twice
    edge = np.log(edge / edge.sum(1, keepdims=True))
    if not len(counts):
        return prior, edge
    f = counts["f"].to_numpy()
    x = np.hstack([(f[:, None] >> np.arange(len(PRIOR))) & 1, np.ones((len(f), 1), int)]).astype(float)
    y, n = counts["y"].to_numpy(float), counts["n"].to_numpy(float)
    w = prior.copy()
    for _ in range(60):  # Newton steps; each prior weight counts as some dozen nodes
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (n * (p - y)) + 12.0 * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 12.0 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, edge


def content(source: str, model: tuple[np.ndarray, np.ndarray], hide: int = 0) -> tuple[Page, np.ndarray]:
    """A page and the marginals of its nodes."""
    page, (weights, edge) = Page(source), model
    x = (np.array(page.features(hide))[:, None] >> np.arange(len(weights) - 1)) & 1
    return page, marginals(np.array(page.parent), x @ weights[:-1] + weights[-1], edge)


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None, out: str = "text") -> DataFrame:
    """Replace html by `out` (main text) and n_chars (its code points)."""
    weights, edge = model or train(pages)
    rest = [f for f in pages.schema.fields if f.name != "html" and f.name.lower() not in (out, "n_chars")]
    schema = T.StructType([*rest, T.StructField(out, T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, float] = {}

        def odds(f: int) -> float:
            got = known.get(f)
            if got is None:
                got = known[f] = float(weights[-1] + sum(w for i, w in enumerate(weights[:-1]) if f >> i & 1))
            return got

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                parent, unary, pages_ = [], [], []
                for source in b.column("html").to_pylist():
                    page = Page(source or "")
                    at = len(parent)
                    parent += [p + at if p >= 0 else -1 for p in page.parent]
                    unary += [odds(f) for f in page.features()]
                    pages_.append((at, page.blocks))
                p = marginals(np.array(parent, np.int64), np.array(unary), edge)
                texts = ["\n\n".join(t for node, t in blocks if p[at + node] > 0.5) for at, blocks in pages_]
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in rest], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[f.name for f in schema.fields])

    return pages.select("html", *[f.name for f in rest]).mapInArrow(run, schema)
