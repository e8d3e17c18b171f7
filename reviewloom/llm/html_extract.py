"""Main text of web pages: boosted trees over DOM nodes and a decoding over the whole tree."""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: Pages that the trees are fitted on, and rearranged copies made of each.
FIT_PAGES = 300
VARIANTS = 4
TREES, DEPTH = 20, 4

# Fixed values of HTML: elements without content, without text to show, and of block level.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend"
    " li main menu nav ol optgroup option p pre search section select summary table tbody td"
    " textarea tfoot th thead tr ul".split()
)
#: A start tag that ends an open element of these kinds, up to the nearest of its container.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: What an open paragraph is not closed through.
SCOPE = frozenset("article aside body button dd div dt footer form header html li main nav section table td th".split())

TAG_GROUPS = [
    {"article", "main"}, {"section", "div"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"},
    {"ul", "ol", "li", "dl", "dt", "dd", "menu", "dir"}, {"nav"}, {"header"}, {"footer", "address"}, {"aside"},
    {"form", "button", "label", "select", "option", "optgroup", "textarea", "fieldset", "legend", "search"},
    {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"},
    {"blockquote", "pre", "figure", "figcaption"},
]
#: Words of class, id and role that say what an element is for.
TOKEN_GROUPS = [
    "article content post entry story main text body prose page".split(),
    "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc".split(),
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner dfp".split(),
    "sidebar side aside widget widgets rail".split(),
    "header masthead topbar branding logo".split(),
    "footer bottom copyright colophon contentinfo legal".split(),
    "comment comments reply replies respond discussion disqus thread".split(),
    "cookie cookies consent notice alert newsletter subscribe subscription popup modal gdpr paywall".split(),
    "share sharing social facebook twitter follow".split(),
    "related recommended recommendations more popular trending outbrain taboola".split(),
    "form login signin signup search contact register".split(),
]
_BOILER_TAGS = frozenset().union(*TAG_GROUPS[5:10])
_TOKENS = [frozenset(x) for x in TOKEN_GROUPS]
_BOILER_TOKENS = frozenset().union(*_TOKENS[1:])
_WORDS = re.compile(r"[a-z]+")
_MARK = "data-is-main"


@dataclass
class Page:
    """Block elements in page order, and the runs of text between their borders."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    tokens: list[frozenset] = field(default_factory=lambda: [frozenset()])
    parents: list[int] = field(default_factory=lambda: [-1])
    marks: list[str | None] = field(default_factory=lambda: [None])
    #: ``node, text, characters in links`` of each run.
    runs: list[tuple[int, str, int]] = field(default_factory=list)


class _Builder(HTMLParser):
    """A forgiving parser: implied ends are added and stray ends are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open: list[tuple[str, int]] = [("html", 0)]
        #: Depths of the open elements of each tag, and of those of block level.
        self.depths: dict[str, list[int]] = {}
        self.block_depths: list[int] = [0]
        self.hidden = ""
        self.nested = 0
        self.text: list[str] = []
        self.linked = self.links = 0
        self.at = 0
        self.last_end: dict[str, int] = {}

    def parse_starttag(self, i):
        self.at = i
        return super().parse_starttag(i)

    def parse_marked_section(self, i, report=1):
        """Marked sections that are no CDATA end at the next bracket, as comments do in browsers."""
        if self.rawdata.startswith("<![CDATA[", i):
            return super().parse_marked_section(i, report)
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def _ends_later(self, tag: str) -> bool:
        """Whether the page has an end tag of this kind behind the start tag that is read."""
        if tag not in self.last_end:
            found = [m.start() for m in re.finditer(f"(?i)</{tag}", self.rawdata)]
            self.last_end[tag] = found[-1] if found else -1
        return self.last_end[tag] > self.at

    def _push(self, tag: str, node: int) -> None:
        self.depths.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.block_depths.append(len(self.open))
        self.open.append((tag, node))

    def _border(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.page.runs.append((self.open[-1][1], text, min(self.linked, len(text))))
        self.text, self.linked = [], 0

    def _pop(self, depth: int) -> None:
        if self.block_depths[-1] >= depth:
            self._border()
        for tag, _ in reversed(self.open[depth:]):
            self.depths[tag].pop()
            self.links -= tag == "a"
            if tag in BLOCK:
                self.block_depths.pop()
        del self.open[depth:]

    def _close(self, kinds, borders) -> None:
        """End the outermost open element of ``kinds`` inside the nearest of ``borders``."""
        mine = [self.depths[tag] for tag in kinds if self.depths.get(tag)]
        if not mine:
            return
        border = max((self.depths[tag][-1] for tag in borders if self.depths.get(tag)), default=0)
        found = [x[bisect_right(x, border)] for x in mine if x[-1] > border]
        if found:
            self._pop(min(found))

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            self.nested += tag == self.hidden
            return
        if tag in HIDDEN:
            if tag != "head" and (tag in ("script", "style") or self._ends_later(tag)):
                self.hidden, self.nested = tag, 1
            return
        if tag == "br" or tag not in BLOCK and tag in VOID:
            self.text.append(" " if tag == "br" else "")
            return
        if tag not in BLOCK:
            self._push(tag, self.open[-1][1])
            self.links += tag == "a"
            return
        if tag in ("html", "body"):
            return
        self._close({"p"}, SCOPE)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        self._border()
        if tag in VOID:
            return
        values = dict(attrs)
        names = " ".join(values.get(k) or "" for k in ("class", "id", "role"))
        words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower())
        page = self.page
        page.tags.append(tag)
        page.tokens.append(frozenset(words))
        page.parents.append(self.open[-1][1])
        page.marks.append(values.get(_MARK))
        self._push(tag, len(page.tags) - 1)

    def handle_startendtag(self, tag, attrs):
        if tag in HIDDEN:  # nothing is inside
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.hidden:
            self.nested -= tag == self.hidden
            if not self.nested:
                self.hidden = ""
            return
        if tag == "p":  # a stray end makes an empty paragraph
            self._border()
        places = self.depths.get(tag)
        if places and (tag in BLOCK or places[-1] > self.block_depths[-1]):
            self._pop(places[-1])

    def handle_data(self, data):
        if self.hidden:
            return
        self.text.append(data)
        if self.links > 0:
            self.linked += len(" ".join(data.split()))


def parse(html: str | None) -> Page:
    """A page's nodes and text; a tag cut off at the end of the page is dropped."""
    builder = _Builder()
    builder.feed(re.sub(r"<[A-Za-z/!?][^<>]*\Z", "", (html or "").replace("\x00", "")))
    builder.close()
    builder._border()
    return builder.page


#: Columns: place and size of the node, its siblings, its tag, its tokens, what is around it.
N_FEATURES = 18 + len(TAG_GROUPS) + len(TOKEN_GROUPS) + 3


def features(page: Page) -> np.ndarray:
    """One row per node."""
    n = len(page.tags)
    parents = page.parents
    depth, chars, links, own, own_links = ([0] * n for _ in range(5))
    punctuation, below, paragraphs, blocks = ([0] * n for _ in range(4))
    start = [-1] * n
    total = 0
    for node, text, linked in page.runs:
        own[node] += len(text)
        own_links[node] += linked
        blocks[node] += 1
        punctuation[node] += sum(map(text.count, ".,;:!?"))
        if start[node] < 0:
            start[node] = total
        total += len(text)
    chars[:], links[:] = own, own_links
    for i in range(n - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        punctuation[p] += punctuation[i]
        blocks[p] += blocks[i]
        below[p] += below[i] + 1
        paragraphs[p] += paragraphs[i] + (page.tags[i] == "p")
        if start[i] >= 0 and (start[p] < 0 or start[i] < start[p]):
            start[p] = start[i]
    kids: list[list[int]] = [[] for _ in range(n)]
    inside = np.zeros((n, 3))
    for i in range(1, n):
        kids[parents[i]].append(i)
    for i in range(n):
        p = parents[i]
        depth[i] = depth[p] + 1 if i else 0
        tag, tokens = page.tags[i], page.tokens[i]
        inside[i] = (
            tag in TAG_GROUPS[0] or bool(tokens & _TOKENS[0]),
            tag in _BOILER_TAGS,
            bool(tokens & _BOILER_TOKENS),
        )
        if i:
            inside[i] = np.maximum(inside[i], inside[p])
    out = np.zeros((n, N_FEATURES))
    out[0, 12] = out[0, 13] = 1
    log = np.log1p
    for i in range(n):
        size = chars[i] or 1
        out[i, :12] = (
            depth[i], log(chars[i]), log(own[i]), links[i] / size, own_links[i] / (own[i] or 1), log(below[i]),
            log(size / (1 + below[i])), chars[i] / (total or 1), log(paragraphs[i]), punctuation[i] / size,
            max(start[i], 0) / (total or 1), log(blocks[i]),
        )
        around = kids[i]
        if around:
            tags = [page.tags[k] for k in around]
            alike = Counter(tags)
            mean = sum(chars[k] for k in around) / len(around)
            for at, k in enumerate(around):
                out[k, 12:18] = (
                    at / len(around), log(len(around)), alike[tags[at]] / len(around),
                    log(chars[k]) - log(mean), log(chars[around[at - 1]]) if at else 0,
                    log(chars[around[at + 1]]) if at + 1 < len(around) else 0,
                )
        at = 18
        for group in TAG_GROUPS:
            out[i, at] = page.tags[i] in group
            at += 1
        for group in _TOKENS:
            out[i, at] = bool(page.tokens[i] & group)
            at += 1
        out[i, at:] = inside[i]
    return out


def texts_below(page: Page) -> np.ndarray:
    """Whether a node has any text in it."""
    found = np.zeros(len(page.tags), bool)
    found[[node for node, *_ in page.runs]] = True
    for i in range(len(page.tags) - 1, 0, -1):
        found[page.parents[i]] |= found[i]
    return found


def decode(page: Page, odds: np.ndarray) -> list[str]:
    """Blocks of the best consistent choice of nodes.

    A node can only be kept if its parent is. A kept node is worth its log odds and what its
    children are worth if that is above 0, a dropped one and all below it nothing; the choice
    worth most is read off from the root down.
    """
    worth = np.where(texts_below(page), odds, 0.0)
    for i in range(len(worth) - 1, 0, -1):
        worth[page.parents[i]] += max(worth[i], 0.0)
    keep = worth > 0
    keep[0] = True
    for i in range(1, len(keep)):
        keep[i] &= keep[page.parents[i]]
    return [text for node, text, _ in page.runs if keep[node] and (node or odds[0] > 0)]


def taught(page: Page) -> np.ndarray | None:
    """Labels by the page's own marks: 1 for nodes that hold main text.

    Text is main inside an article or main element, but not inside elements that say by tag or
    token that they are something else. A training copy's marks decide instead. None if the
    page has neither.
    """
    n = len(page.tags)
    state = np.zeros(n, int)  # 0 outside, 1 main, -1 something else inside main
    marked = any(m is not None for m in page.marks)
    for i in range(1, n):
        state[i] = state[page.parents[i]]
        tag, tokens = page.tags[i], page.tokens[i]
        if page.marks[i] is not None:
            state[i] = 1 if page.marks[i] == "1" else -1
        elif not marked and tag in TAG_GROUPS[0] and state[i] == 0:
            state[i] = 1
        elif not marked and state[i] == 1 and (tag in _BOILER_TAGS or tokens & _BOILER_TOKENS):
            state[i] = -1
    if not (state == 1).any():
        return None
    label = np.zeros(n, bool)
    for node, *_ in page.runs:
        label[node] |= state[node] == 1
    for i in range(n - 1, 0, -1):
        label[page.parents[i]] |= label[i]
    return label


def rearranged(page: Page, rng: random.Random) -> str:
    """A training copy: the page's main text in another container, among other elements.

    Everything is made of the page's own text. Marks say what is main text.
    """
    state = [False] * len(page.tags)
    label = taught(page)
    for i in range(1, len(page.tags)):
        state[i] = bool(label[i])
    main = [(page.tags[node], text) for node, text, _ in page.runs if state[node]] or [("p", "text")]
    words = " ".join(text for _, text, _ in page.runs).split() or ["word"]

    def some(least: int, most: int) -> str:
        n = rng.randint(least, most)
        at = rng.randrange(max(1, len(words) - n))
        return escape(" ".join(words[at : at + n]), quote=False)

    def named(tag: str, names: list[str], inner: str) -> str:
        name = rng.choice(names)
        attribute = rng.choice(["class", "id", "class"])
        extra = rng.choice(["", "", "-box", " block", "-list", "-1"])
        return f'<{tag} {attribute}="{name}{extra}" {_MARK}="0">{inner}</{tag}>'

    def plain(tag: str, inner: str) -> str:
        return f'<{tag} {_MARK}="0">{inner}</{tag}>'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/">{some(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def paragraphs(least: int, most: int) -> str:
        return "".join(f"<p>{some(3, 60)}</p>" for _ in range(rng.randint(least, most)))

    def other(kind: int) -> str:
        if kind == 0:
            inner = links(rng.randint(3, 9))
            return rng.choice([plain("nav", inner), named("div", TOKEN_GROUPS[1], inner)])
        if kind == 1:
            return named(rng.choice(["div", "section"]), TOKEN_GROUPS[2], some(3, 30))
        if kind == 2:
            inner = f"<h3>{some(1, 4)}</h3>" + rng.choice([links(5), paragraphs(1, 3)])
            return rng.choice([plain("aside", inner), named("div", TOKEN_GROUPS[3], inner)])
        if kind == 3:
            inner = f"<h2>{some(1, 6)}</h2>" + rng.choice(["", links(4)])
            return rng.choice([plain("header", inner), named("div", TOKEN_GROUPS[4], inner)])
        if kind == 4:
            inner = rng.choice([some(5, 25), f"<p>{some(5, 25)}</p>" + links(3)])
            return rng.choice([plain("footer", inner), named("div", TOKEN_GROUPS[5], inner)])
        if kind == 5:
            each = [
                rng.choice(["<div class=\"comment\">{}</div>", "<li>{}</li>", "<div>{}</div>"]).format(
                    f"<b>{some(1, 2)}</b>" + paragraphs(1, 3)
                )
                for _ in range(rng.randint(1, 6))
            ]
            tag = rng.choice(["div", "section", "ol", "ul"])
            return named(tag, TOKEN_GROUPS[6], f"<h3>{some(1, 2)}</h3>" + "".join(each))
        if kind == 6:
            return named("div", TOKEN_GROUPS[7], rng.choice([some(4, 30), paragraphs(1, 2)]))
        if kind == 7:
            return named("div", TOKEN_GROUPS[8], rng.choice([links(3), some(1, 6)]))
        if kind == 8:
            inner = f"<h3>{some(1, 3)}</h3>" + rng.choice([links(5), paragraphs(2, 4)])
            return named(rng.choice(["div", "section"]), TOKEN_GROUPS[9], inner)
        inner = f"<label>{some(1, 3)}</label><button>{some(1, 2)}</button>" + rng.choice(["", paragraphs(1, 1)])
        form = plain("form", inner)
        return rng.choice([form, named("div", TOKEN_GROUPS[10], form)])

    inside = []
    for tag, text in main:
        tag = tag if tag in BLOCK - {"html", "body", "div", "article", "main", "section"} else "p"
        tag = rng.choice([tag] * 9 + ["blockquote", "h2", "div"])
        inside.append(f"<{tag}>{escape(text, quote=False)}</{tag}>")
        if rng.random() < 0.08:
            inside.append(other(rng.choice([1, 1, 2, 6, 6, 7, 8, 9])))
    if rng.random() < 0.4:
        inside.append(other(rng.choice([4, 5, 5, 7, 8])))
    if rng.random() < 0.2:
        inside.insert(0, other(3))
    body = "".join(inside)
    box = rng.choice(["article", "article", "main", "div", "div", "section", "named", "named"])
    if box == "named":
        body = f'<div class="{rng.choice(TOKEN_GROUPS[0])}" {_MARK}="1">{body}</div>'
    else:
        body = f'<{box} {_MARK}="1">{body}</{box}>'
    before = [other(k) for k in (3, 0, 1, 6, 7, 9) if rng.random() < 0.5]
    after = [other(k) for k in (5, 2, 8, 4, 1, 9, 6) if rng.random() < 0.5]
    whole = "".join([*before, body, *after])
    for _ in range(rng.randrange(3)):
        whole = f"<div>{whole}</div>"
    return f"<html><body>{whole}</body></html>"


@dataclass
class Trees:
    """Boosted regression trees as arrays: a node's children, or itself for a leaf."""

    roots: np.ndarray
    weights: np.ndarray
    column: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def odds(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(rows), root)
            for _ in range(DEPTH):
                low = rows[each, self.column[at]] <= self.threshold[at]
                at = np.where(low, self.left[at], self.right[at])
            total += weight * self.value[at]
        return 2 * total

    @staticmethod
    def read(description: str) -> Trees:
        """From the text form that Spark ML gives of its trees."""
        roots, weights, nodes = [], [], []
        for line in map(str.strip, description.splitlines()):
            if m := re.match(r"Tree \d+ \(weight ([-\d.eE]+)\)", line):
                weights.append(float(m[1]))
                roots.append(len(nodes))
            elif m := re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line):
                nodes.append([int(m[1]), float(m[2]), -1, -1, 0.0])
            elif m := re.match(r"Predict: ([-\d.eE]+)", line):
                at = len(nodes)
                nodes.append([0, 0.0, at, at, float(m[1])])

        def link(i: int) -> int:
            """Set the children below node i, which stand behind it; the place after them."""
            if nodes[i][2] == i:
                return i + 1
            nodes[i][2] = i + 1
            nodes[i][3] = link(i + 1)
            return link(nodes[i][3])

        for root in roots:
            link(root)
        columns = [
            np.array(values, kind)
            for values, kind in zip(zip(*nodes), (int, float, int, int, float))
        ]
        return Trees(np.array(roots, int), np.array(weights), *columns)


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, labels = [], []
        for html in batch["html"].to_pylist():
            page = parse(html)
            if taught(page) is None:
                continue
            rng = random.Random(len(html))
            for one in [page, *(parse(rearranged(page, rng)) for _ in range(VARIANTS))]:
                found, label = features(one), taught(one)
                good = texts_below(one)
                rows += found[good].tolist()
                labels += label[good].astype(float).tolist()
        yield pa.record_batch(
            {"row": pa.array(rows, pa.list_(pa.float64())), "label": pa.array(labels, pa.float64())}
        )


def fit(pages: DataFrame, rows: int = FIT_PAGES) -> Trees | None:
    """Fit boosted trees on at most ``rows`` pages of ``html`` that mark their main text.

    The pages with the least hashes are taken, each different page once. Labels come from the
    pages' article and main elements; rearranged copies add other containers and the kinds of
    elements that the pages lack. None if no page has such marks.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    marked = pages.filter(F.lower("html").rlike("<(article|main)[\\s>]"))
    keys = marked.select(F.xxhash64("html").alias("digest")).distinct().orderBy("digest").limit(rows)
    sample = marked.withColumn("digest", F.xxhash64("html")).join(F.broadcast(keys), "digest")
    sample = stored(sample.dropDuplicates(["digest"]).select("html"), "sample")
    table = stored(
        sample.repartition(4).mapInArrow(_fit_rows, "row array<double>, label double"), "nodes"
    )
    if table.select("label").distinct().count() < 2:
        return None
    table = table.select(array_to_vector("row").alias("features"), "label")
    booster = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11)
    return Trees.read(booster.fit(table).toDebugString)


def by_names(page: Page, found: np.ndarray) -> np.ndarray:
    """Log odds without trees: elements that say they are something else are not main text."""
    return np.where(found[:, -2:].any(axis=1), -1.0, 1.0)


def extract(pages: DataFrame, trees: Trees | None) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of each row of ``page_id, url, html``.

    Blocks follow each other in page order, two line breaks apart; white space inside a block
    is one space. A null or empty page, or one without main text, has an empty text. Repeated
    rows and null ids or addresses stay as they are. The whole page is read, however long.
    Without trees (no page marks its main text), tags and tokens alone decide.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in slices(batches, 64):
            parsed = [parse(html) for html in batch["html"].to_pylist()]
            rows = [features(page) for page in parsed]
            if trees is None:
                odds = [by_names(*x) for x in zip(parsed, rows)]
            else:
                ends = np.cumsum([len(x) for x in rows])[:-1]
                odds = np.split(trees.odds(np.concatenate(rows)), ends)
            texts = ["\n\n".join(decode(*x)) for x in zip(parsed, odds)]
            yield pa.record_batch(
                {
                    "page_id": batch["page_id"],
                    "url": batch["url"],
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                }
            )

    rows = pages.selectExpr("cast(page_id as bigint) page_id", "url", "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
